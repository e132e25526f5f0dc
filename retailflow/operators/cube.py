"""A cube of sales: every combination of the dimensions, each as a level of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retailflow.functions import to_cents

DIMENSIONS = ("dt", "province_name", "user_age_group", "user_gender", "category3_name")
MEASURES = ("lines", "pieces", "paid_cents")


def finest(wide: DataFrame, dimensions: tuple[str, ...] = DIMENSIONS) -> DataFrame:
    """The measures of the wide table's lines by all dimensions: the one scan, combined before its shuffle."""
    return wide.groupBy(*dimensions).agg(
        F.count(F.lit(1)).alias("lines"), F.sum("sku_num").alias("pieces"), F.sum(to_cents("final_detail_amount")).alias("paid_cents"))


def cube(finest_level: DataFrame, dimensions: tuple[str, ...] = DIMENSIONS, measures: tuple[str, ...] = MEASURES) -> DataFrame:
    """All levels from the finest, with `level`: a bit for each dimension that is summed over, the first one the highest. A NULL
    of a dimension that is not is a value of its own.

    Levels derive from finer ones, dimension by dimension: a step gives each row once as it is and once with one dimension
    summed over, and combines these before its shuffle. So the wide table is scanned once, and no row is expanded by
    the 2^n levels there are."""
    rows = finest_level.withColumn("level", F.lit(0))
    for place, name in enumerate(dimensions):
        bit = 1 << (len(dimensions) - 1 - place)
        kind = finest_level.schema[name].dataType
        both = F.array(F.struct(F.col(name).alias("value"), F.col("level")), F.struct(F.lit(None).cast(kind).alias("value"), (F.col("level") + bit).alias("level")))
        others = [d for d in dimensions if d != name]
        rows = rows.select(*others, *measures, F.inline(both)).withColumnRenamed("value", name)
        rows = rows.groupBy(*dimensions, "level").agg(*[F.sum(m).alias(m) for m in measures])
    return rows.select(*dimensions, "level", *measures)


def grouping_sets(finest_level: DataFrame, sets: list[tuple[str, ...]], dimensions: tuple[str, ...] = DIMENSIONS, measures: tuple[str, ...] = MEASURES) -> DataFrame:
    """Only these levels, each named by the dimensions it keeps, in one aggregation."""
    columns = [[F.col(d) for d in s] for s in sets]
    sums = [F.sum(m).alias(m) for m in measures]
    return finest_level.groupingSets(columns, *[F.col(d) for d in dimensions]).agg(F.grouping_id().cast("int").alias("level"), *sums)
