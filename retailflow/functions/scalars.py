"""Column expressions. All are built-in functions, so they stay inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Labels of the user groups and the ODS topic prefix.
AGE_YOUNG = "20岁及以下"
AGE_MIDDLE = "21岁到30岁"
AGE_OLD = "30岁以上"
GENDER_MALE = "男"
GENDER_FEMALE = "女"
ODS_PREFIX = "ODS_"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def topic_name(table: Column | str) -> Column:
    return F.concat(F.lit(ODS_PREFIX), F.upper(_col(table)))


def day_of_ms(ms: Column | str) -> Column:
    """Epoch milliseconds to yyyy-MM-dd in the session time zone."""
    return F.timestamp_millis(_col(ms)).cast("date").cast("string")


def hour_of_ms(ms: Column | str) -> Column:
    """Epoch milliseconds to a two-digit hour in the session time zone."""
    return F.lpad(F.hour(F.timestamp_millis(_col(ms))).cast("string"), 2, "0")


def day_of_text(create_time: Column | str) -> Column:
    return F.get(F.split(_col(create_time), " "), F.lit(0))


def hour_of_text(create_time: Column | str) -> Column:
    clock = F.get(F.split(_col(create_time), " "), F.lit(1))
    return F.get(F.split(clock, ":"), F.lit(0))


def previous_day(day: Column | str) -> Column:
    return F.date_sub(_col(day).cast("date"), 1).cast("string")


def age_group(birthday: Column | str, as_of: Column | str) -> Column:
    """Whole 365-day years up to `as_of`, then three groups. The bounds test < 20 and > 30, so
    20 belongs to the middle group. A birthday that is no date gives NULL."""
    today = F.to_date(F.lit(as_of)) if isinstance(as_of, str) else as_of
    days = F.datediff(today, F.try_to_date(_col(birthday), "yyyy-MM-dd"))
    years = (days / F.lit(365)).cast("int")
    return (
        F.when(years.isNull(), F.lit(None))
        .when(years < 20, AGE_YOUNG)
        .when(years > 30, AGE_OLD)
        .otherwise(AGE_MIDDLE)
    )


def gender_name(gender: Column | str) -> Column:
    return F.when(_col(gender) == "M", GENDER_MALE).otherwise(GENDER_FEMALE)


def round_half_up(x: Column | str) -> Column:
    """Two decimals, ties up, on the double itself (so 1.005, which is stored below, gives 1.0)."""
    return F.floor(_col(x) * 100 + 0.5) / 100.0


def to_cents(x: Column | str) -> Column:
    """A double amount as whole cents. Exact for any two-decimal amount below 2**53 cents."""
    return F.floor(_col(x) * 100 + 0.5).cast("bigint")


def name_id(text: Column | str) -> Column:
    """A 60-bit number for a text, the same in every engine that has md5."""
    return F.conv(F.substring(F.md5(_col(text)), 1, 15), 16, 10).cast("bigint")


# Two moduli near 2**30 and a multiplier each: every step of number_id stays below 2**53.
ID_MODULI = ((1000000007, 1000003), (998244353, 786433))


def number_id(columns: list[Column]) -> Column:
    """A 60-bit number for a list of non-negative integers, by two polynomial hashes side by side.
    Plain arithmetic, so any engine gives the same."""
    halves = []
    for modulus, factor in ID_MODULI:
        half = F.lit(0).cast("bigint")
        for c in columns:
            half = (half * factor + c) % modulus
        halves.append(half)
    return halves[0] * 1073741824 + halves[1]


#: A word: a letter of a script written without spaces, or a run of letters, marks and digits of others.
_ALONE = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}"
_WORD = rf"[{_ALONE}]|[\p{{L}}\p{{M}}\p{{N}}&&[^{_ALONE}]]+"


def words(text: Column | str) -> Column:
    """Lower-case word list of a text, in any script, as a standard text analyser gives it; null for a null."""
    return F.regexp_extract_all(F.lower(_col(text)), F.lit(_WORD), F.lit(0))
