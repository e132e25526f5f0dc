"""Serving queries: daily actives, detail search, shares and sales.

Every function takes the whole table; `date` narrows to one day where a caller wants one.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from retailflow.functions import words
from retailflow.operators.active import first_seen

# The hours of a day, names of the indicator tiles, bucket limit of the by-hour
# report, bands of the sales map.
HOURS = 24
DAU_TILE = ("dau", "新增日活")
NEW_DEVICE_TILE = ("new_mid", "新增设备")
BAND_TOP = 600
BANDS = 6


def _hour_text(hour: Column) -> Column:
    return F.lpad(hour.cast("string"), 2, "0")


def on_day(startups: DataFrame, date: str | None, days_before: int = 0) -> DataFrame:
    """Startup logs of one day (and some before it), as a range on the raw milliseconds: that is
    a comparison the scan can use, a formatted date is not."""
    if date is None:
        return startups
    end = F.lit(dt.date.fromisoformat(date) + dt.timedelta(days=1))
    start = F.lit(dt.date.fromisoformat(date) - dt.timedelta(days=days_before))
    return startups.filter(
        (F.col("ts") >= F.unix_millis(start.cast("timestamp"))) & (F.col("ts") < F.unix_millis(end.cast("timestamp")))
    )


def index_total(docs: DataFrame, date: str | None = None) -> DataFrame:
    """Daily actives from the daily document index: the number of its documents. The day is a
    partition of the index."""
    rows = docs if date is None else docs.filter(F.col("dt") == date)
    return rows.groupBy("dt").agg(F.count(F.lit(1)).alias("total"))


def index_by_hour(docs: DataFrame, date: str | None = None) -> DataFrame:
    rows = docs if date is None else docs.filter(F.col("dt") == date)
    return rows.groupBy("dt", "hr").agg(F.count(F.lit(1)).alias("n"))


def _by_hour(startups: DataFrame) -> DataFrame:
    return (
        first_seen(startups)
        .groupBy("day", F.hour(F.timestamp_millis("ts")).alias("hour"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def dau_total(startups: DataFrame, date: str | None = None) -> DataFrame:
    return (
        first_seen(on_day(startups, date))
        .groupBy("day").agg(F.count(F.lit(1)).alias("total"))
        .select(F.col("day").cast("string").alias("dt"), "total")
    )


def dau_by_hour(startups: DataFrame, date: str | None = None) -> DataFrame:
    """Daily actives per hour of their first startup. Only hours seen have a row; a day has at
    most 24 of them, so the bucket limit of 24 never cuts anything."""
    return _by_hour(on_day(startups, date)).select(
        F.col("day").cast("string").alias("dt"), _hour_text(F.col("hour")).alias("hr"), "n"
    )


def dau_hour_map(startups: DataFrame, date: str | None = None) -> DataFrame:
    """The same as one map per day, busiest hour first. A list holds at most 24 entries."""
    entry = F.struct((-F.col("n")).alias("_down"), "hr", "n")
    ranked = F.sort_array(F.collect_list(entry))
    return dau_by_hour(startups, date).groupBy("dt").agg(
        F.map_from_entries(F.transform(ranked, lambda e: F.struct(e.hr, e.n))).alias("hours")
    )


def dau_hour_compare(startups: DataFrame, date: str | None = None) -> DataFrame:
    """Two series per day, `today` and `yesterday` (the day before), over the hours that have a
    bucket. Each count is emitted once for its own day and once for the next."""
    counts = _by_hour(on_day(startups, date, days_before=1))
    placed = counts.select(
        F.explode(
            F.array(
                F.struct(F.col("day"), F.lit("today").alias("label")),
                F.struct(F.date_add("day", 1).alias("day"), F.lit("yesterday").alias("label")),
            )
        ).alias("p"),
        "hour",
        "n",
    )
    if date is not None:
        placed = placed.filter(F.col("p.day") == F.lit(date).cast("date"))
    return placed.select(
        F.col("p.day").cast("string").alias("dt"), "p.label", _hour_text(F.col("hour")).alias("hr"), "n"
    )


def hour_zero_fill(compared: DataFrame) -> DataFrame:
    """Both series on all 24 hours of every day, 0 where there is no bucket. A day's buckets (at
    most 48) are collected and looked up, so this needs no join."""
    slot = F.struct(F.concat("label", "hr").alias("k"), F.col("n").alias("v"))
    per_day = compared.groupBy("dt").agg(F.map_from_entries(F.collect_list(slot)).alias("_found"))
    hours = F.explode(F.sequence(F.lit(0), F.lit(HOURS - 1))).alias("_hour")
    grid = per_day.select("dt", "_found", hours).withColumn("hr", _hour_text(F.col("_hour")))

    def series(label: str) -> Column:
        return F.coalesce(F.try_element_at("_found", F.concat(F.lit(label), F.col("hr"))), F.lit(0)).alias(label)

    return grid.select("dt", "hr", series("yesterday"), series("today"))


def kpi_tiles(startups: DataFrame) -> DataFrame:
    """Two indicators per day: devices active, and devices seen for the first time ever (0 for a
    day without any)."""
    seen = first_seen(startups)
    debut = seen.groupBy("mid").agg(F.min("day").alias("debut"))
    active = seen.groupBy("day").agg(F.count(F.lit(1)).alias("value"))
    fresh = debut.groupBy(F.col("debut").alias("day")).agg(F.count(F.lit(1)).alias("fresh"))
    both = active.join(fresh, "day", "left").select(
        F.col("day").cast("string").alias("dt"), "value", F.coalesce("fresh", F.lit(0)).alias("fresh")
    )

    def tile(names: tuple[str, str], value: str) -> DataFrame:
        return both.select("dt", F.lit(names[0]).alias("id"), F.lit(names[1]).alias("name"), F.col(value).alias("value"))

    return tile(DAU_TILE, "value").unionByName(tile(NEW_DEVICE_TILE, "fresh"))


def dashboard_filter(wide: DataFrame, date: str | None = None, keyword: str = "") -> DataFrame:
    """Detail rows of a day whose SKU name contains every word of the keyword; an empty keyword
    keeps all."""
    rows = wide if date is None else wide.filter(F.col("dt") == date)
    for word in keyword.split():
        rows = rows.filter(F.col("sku_name").contains(word))
    return rows


def _shares(rows: DataFrame, column: str) -> DataFrame:
    return with_share(rows.groupBy(F.col(column).alias("name")).agg(F.count(F.lit(1)).alias("value")))


def with_share(counts: DataFrame) -> DataFrame:
    """Adds each value's share of all. One row per group (two genders, three age groups) is what the window sees."""
    return counts.withColumn("share", F.col("value") / F.sum("value").over(Window.partitionBy()))


def gender_share(rows: DataFrame) -> DataFrame:
    return _shares(rows, "user_gender")


def age_share(rows: DataFrame) -> DataFrame:
    return _shares(rows, "user_age_group")


def province_sales(rows: DataFrame) -> DataFrame:
    """Pieces sold per province and the map's colour band (100 wide from 0 to 600; 7 is above)."""
    sold = rows.groupBy(F.col("province_name").alias("name")).agg(F.sum("sku_num").alias("value"))
    return sold.withColumn(
        "band", F.width_bucket(F.col("value").cast("double"), F.lit(0.0), F.lit(float(BAND_TOP)), F.lit(BANDS))
    )


def name_num_bars(rows: DataFrame) -> DataFrame:
    return rows.groupBy(F.col("sku_name").alias("name")).agg(F.sum("sku_num").alias("num"))


def page(rows: DataFrame, order: list[Column], start: int, size: int) -> DataFrame:
    """Rows start..start+size of the order: a bounded top-k, never a full sort."""
    return rows.orderBy(*order).offset(start).limit(size)


def page_order() -> list[Column]:
    """Most paid first."""
    return [F.desc("final_detail_amount"), F.asc("order_id"), F.asc("order_detail_id")]


def facet_counts(hits: DataFrame) -> DataFrame:
    """(section, name, value): total and both facets, from one aggregation."""
    groups = hits.groupBy("user_age_group", "user_gender").agg(F.count(F.lit(1)).alias("n"))
    return (
        groups.select(
            F.explode(
                F.array(
                    F.struct(F.lit("total").alias("section"), F.lit("total").alias("name")),
                    F.struct(F.lit("age").alias("section"), F.col("user_age_group").alias("name")),
                    F.struct(F.lit("gender").alias("section"), F.col("user_gender").alias("name")),
                )
            ).alias("s"),
            "n",
        )
        .groupBy("s.section", "s.name")
        .agg(F.sum("n").alias("value"))
    )


def ranked_page(rows: DataFrame, start: int, size: int) -> DataFrame:
    """One page with each row's `rank` in the whole order, from 1. The window sees the page only."""
    rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*page_order())) + start
    return page(rows, page_order(), start, size).withColumn("rank", rank)


def facet_search(wide: DataFrame, date: str | None, keyword: str, start: int, size: int) -> DataFrame:
    """One answer in long form: `section` is total, age, gender or detail (one page, with `rank`)."""
    hits = dashboard_filter(wide, date, keyword)
    detail = ranked_page(hits, start, size).select(
        F.lit("detail").alias("section"), F.col("sku_name").alias("name"), F.col("order_detail_id").alias("value"), "rank"
    )
    return facet_counts(hits).withColumn("rank", F.lit(None).cast("int")).unionByName(detail)


def facet_response(wide: DataFrame, date: str | None, keyword: str, start: int, size: int) -> DataFrame:
    """The answer as one row: total, detail (whole records in page order) and stat (age and gender
    groups). It holds one page and five groups."""
    hits = dashboard_filter(wide, date, keyword)
    record = F.struct("rank", *[c for c in wide.columns if c != "rank"])
    detail = ranked_page(hits, start, size).select(F.lit("detail").alias("section"), record.alias("record"))
    rows = facet_counts(hits).unionByName(detail, allowMissingColumns=True)
    pair = F.struct("name", "value")

    def part(section: str) -> Column:
        return F.sort_array(F.collect_list(F.when(F.col("section") == section, pair)))

    return rows.agg(
        F.coalesce(F.max(F.when(F.col("section") == "total", F.col("value"))), F.lit(0)).alias("total"),
        F.sort_array(F.collect_list("record")).alias("detail"),
        F.array(F.struct(part("age").alias("group")), F.struct(part("gender").alias("group"))).alias("stat"),
    )


def doc_search(
    docs: DataFrame,
    match: str,
    term: str,
    number: int | None = None,
    text: str = "name",
    nested: str = "actorList",
    number_column: str = "id",
) -> DataFrame:
    """Documents whose analysed text contains any word of `match` and whose nested list has an
    entry of exactly this name; optionally a number must match as well."""
    found = docs.filter(F.arrays_overlap(words(text), words(F.lit(match))))
    found = found.filter(F.exists(nested, lambda entry: entry["name"] == term))
    return found if number is None else found.filter(F.col(number_column) == number)


def topk_terms(rows: DataFrame, field: str, size: int = HOURS) -> DataFrame:
    """The most frequent values of a field with their counts; ties by value."""
    counts = rows.groupBy(F.col(field).alias("term")).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), "term").limit(size)


def kpi_of_day(startups: DataFrame, date: str) -> DataFrame:
    """Both tiles of one day; 0 where the day has no data."""
    active = first_seen(on_day(startups, date)).agg(F.count(F.lit(1)).alias("value"))
    debut = startups.groupBy("common.mid").agg(F.min("ts").alias("ts"))
    fresh = on_day(debut, date).agg(F.count(F.lit(1)).alias("value"))

    def tile(names: tuple[str, str], counted: DataFrame) -> DataFrame:
        return counted.select(F.lit(names[0]).alias("id"), F.lit(names[1]).alias("name"), "value")

    return tile(DAU_TILE, active).unionByName(tile(NEW_DEVICE_TILE, fresh))
