"""Distinct devices over ranges of days, from what each day keeps: a bitmap of its devices' numbers for the
exact figure, and a sketch for an estimate. Both merge, so a range reads a row or a few per day and no startups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Devices of one part of the numbering, about; a bitmap of Spark's has 32,768 places.
PART = 16_384
PLACES = 32_768
#: Logarithm of a sketch's registers: its standard error is about 1.04 / sqrt(2^LG), 1.6 % here.
LG = 12


def device_numbers(devices: DataFrame, device: str = "mid") -> DataFrame:
    """device, part, place: a number for each device, counted within parts of a hash. No order over all devices, and so no
    task that sees them all, is needed; a part's places lie in as many bitmaps as it fills."""
    known = devices.select(F.col(device).alias("device")).where("device IS NOT NULL").distinct()
    parts = max(1, -(-known.count() // PART))
    known = known.withColumn("part", F.pmod(F.xxhash64("device"), F.lit(parts)).cast("long"))
    place = F.row_number().over(Window.partitionBy("part").orderBy("device")) - 1
    return known.withColumn("place", place.cast("long"))


def daily_bitmaps(days: DataFrame, numbers: DataFrame, device: str = "mid", day: str = "dt") -> DataFrame:
    """dt, part, bucket, bits: the devices of each day. days: a row per device and day, or more."""
    seen = days.select(F.col(day).alias("dt"), F.col(device).alias("device")).distinct()
    rows = seen.join(numbers, "device").withColumn("bucket", F.expr(f"place div {PLACES}"))
    bit = F.bitmap_bit_position(F.expr(f"place % {PLACES} + 1"))
    return rows.groupBy("dt", "part", "bucket").agg(F.bitmap_construct_agg(bit).alias("bits"))


def daily_sketches(days: DataFrame, device: str = "mid", day: str = "dt") -> DataFrame:
    """dt, sketch: mergeable sketches of each day's devices, combined before the shuffle."""
    return days.groupBy(F.col(day).alias("dt")).agg(F.hll_sketch_agg(device, LG).alias("sketch"))


def _ranges_with_day(days: int) -> Column:
    """The ranges of so many days that hold a row's day: (days, last day)."""
    return F.transform(F.sequence(F.lit(0), F.lit(days - 1)), lambda i: F.struct(F.lit(days).alias("days"), F.date_add(F.col("dt").cast("date"), i).cast("string").alias("until")))


def _in_ranges(rows: DataFrame, lengths: tuple[int, ...]) -> DataFrame:
    """Each row once for every range that holds its day; ranges end on days there are."""
    present = rows.select(F.col("dt").alias("until")).distinct()
    spread = rows.select("*", F.explode(F.flatten(F.array(*[_ranges_with_day(n) for n in lengths]))).alias("r"))
    return spread.withColumns({"days": F.col("r.days"), "until": F.col("r.until")}).drop("r").join(present, "until", "left_semi")


def reach(bitmaps: DataFrame, lengths: tuple[int, ...] = (7, 30)) -> DataFrame:
    """dt, days, devices: how many different devices were active on a day or the days before it, `days` in all."""
    merged = _in_ranges(bitmaps, lengths).groupBy("until", "days", "part", "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
    return merged.groupBy(F.col("until").alias("dt"), "days").agg(F.sum(F.bitmap_count("bits")).alias("devices"))


def estimated_reach(sketches: DataFrame, lengths: tuple[int, ...] = (7, 30)) -> DataFrame:
    """The same by sketches: dt, days, estimate."""
    merged = _in_ranges(sketches, lengths).groupBy("until", "days").agg(F.hll_union_agg("sketch").alias("sketch"))
    return merged.select(F.col("until").alias("dt"), "days", F.hll_sketch_estimate("sketch").alias("estimate"))
