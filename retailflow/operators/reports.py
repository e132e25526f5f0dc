"""Sales reports kept by deltas: what each batch of the wide table adds to them is stored under the batch's number.
A batch that is run again replaces its own contribution; the reports are sums of contributions and never scan
the wide table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from retailflow.operators import serving
from retailflow.sources import storage

KEYS = ("dt", "province_name", "user_age_group", "user_gender", "sku_name")
SUMS = ("lines", "sku_num")
CONTRIBUTION = T.StructType([*[T.StructField(k, T.StringType()) for k in KEYS], *[T.StructField(s, T.LongType()) for s in SUMS]])


def _summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*KEYS).agg(*[F.sum(s).alias(s) for s in SUMS])


def keep(rows: DataFrame, path: str, batch_id: int) -> None:
    """Stores what the wide rows of a batch add to the reports, in place of what the batch added before."""
    storage.write_batch(_summed(rows.withColumn("lines", F.lit(1).cast("bigint"))), path, batch_id)


def fold(spark: SparkSession, path: str, upto: int | None = None) -> None:
    """Contributions of all batches into one, which is then as large as the reports are, and no larger with time."""
    def one(rows: DataFrame) -> DataFrame:
        return rows.groupBy(*KEYS).agg(*[F.sum(s).alias(s) for s in SUMS], F.max("batch_id").alias("batch_id"))

    storage.fold(spark, path, CONTRIBUTION, one, upto)


def kept(spark: SparkSession, path: str, date: str | None = None) -> DataFrame:
    """The sums of all contributions, of one day if it is named."""
    rows = storage.read_batches(spark, path, CONTRIBUTION)
    return _summed(rows if date is None else rows.filter(F.col("dt") == date))


def shares(rows: DataFrame, column: str) -> DataFrame:
    """Lines per value of a column, and their share of all: `gender_share` and `age_share` of the rows behind the sums."""
    return serving.with_share(rows.groupBy(F.col(column).alias("name")).agg(F.sum("lines").alias("value")))


def province_sales(rows: DataFrame) -> DataFrame:
    return serving.province_sales(rows)


def name_num_bars(rows: DataFrame) -> DataFrame:
    return serving.name_num_bars(rows)
