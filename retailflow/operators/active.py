"""Daily active devices."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from retailflow.functions import day_of_ms, hour_of_ms


def with_day_hour(logs: DataFrame, ms: str = "ts") -> DataFrame:
    return logs.withColumn("dt", day_of_ms(ms)).withColumn("hr", hour_of_ms(ms))


def dau_project(logs: DataFrame) -> DataFrame:
    """Startup log to the active-device record; columns other than these are kept behind."""
    fields = ["common", "ts", "dt", "hr"]
    rest = [c for c in logs.columns if c not in fields]
    return logs.select(
        *[F.col(f"common.{c}").alias(c) for c in ("mid", "uid", "ar", "ch", "vc")],
        "dt",
        "hr",
        F.lit("00").alias("mi"),
        "ts",
        *rest,
    )


def first_per_key(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row per key. A rank filtered to 1 makes the optimizer keep one row per key and
    task before the shuffle (WindowGroupLimit), so a key with very many rows costs no more
    shuffle than any other."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_rank", rank).filter(F.col("_rank") == 1).drop("_rank")


def dau_dedup(startups: DataFrame, tie_break: str = "seq") -> DataFrame:
    """First startup per device and day."""
    return first_per_key(dau_project(with_day_hour(startups)), ["dt", "mid"], ["ts", tie_break])


def first_seen(startups: DataFrame) -> DataFrame:
    """(day, mid, ts) of the first startup per device and day, for counting only. No payload, so
    this is a hash aggregate on fixed-width buffers, combined before the shuffle."""
    return (
        startups.select(
            F.timestamp_millis("ts").cast("date").alias("day"), F.col("common.mid").alias("mid"), "ts"
        )
        .groupBy("day", "mid")
        .agg(F.min("ts").alias("ts"))
    )


def first_seen_counts(startups: DataFrame) -> DataFrame:
    """(day, mid, n): how many startups each device had on each day."""
    return startups.groupBy(
        F.timestamp_millis("ts").cast("date").alias("day"), F.col("common.mid").alias("mid")
    ).agg(F.count(F.lit(1)).alias("n"))


def unseen(rows: DataFrame, seen: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows whose key is not in the seen table, one per key. Deduplicated first: that shrinks a
    hot key to one row before the anti join shuffles anything."""
    return first_per_key(rows, keys, order).join(seen.select(*keys), keys, "left_anti")
