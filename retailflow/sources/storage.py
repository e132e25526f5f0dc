"""Keyed tables and document indexes as partitioned parquet folders.

Every write names its batch and replaces exactly that batch's rows; reading takes the newest
row per key. So writes are idempotent under replay, and no update in place is needed. Batches fold
into a base from time to time; readers see the same rows before and after.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from retailflow.operators.active import first_per_key
from retailflow.session import SPENT_SHUFFLES, setting

LONG = T.LongType()

#: Up to so many days of a batch are read by folder; a batch with more is joined with the whole table.
MOST_DAYS = 1000
_NO_DAY = "__HIVE_DEFAULT_PARTITION__"


def _place(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def signature(spark: SparkSession, path: str) -> tuple:
    """Names, sizes and times of a table's files: another value when the table was replaced."""
    files, target = _place(spark, path)
    listed, found = files.listFiles(target, True), []
    while listed.hasNext():
        status = listed.next()
        found.append((status.getPath().toString(), status.getLen(), status.getModificationTime()))
    return tuple(sorted(found))


def exists(spark: SparkSession, path: str) -> bool:
    files, target = _place(spark, path)
    return files.exists(target)


def make_folder(spark: SparkSession, path: str) -> None:
    files, target = _place(spark, path)
    files.mkdirs(target)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder that this run made."""
    files, target = _place(spark, path)
    files.delete(target, True)


def _numbered(spark: SparkSession, path: str, name: str, nested: bool = False) -> dict[int, list[str]]:
    """Folders `name`=<number> below a path, and below its folders by day or month, by number."""
    files, target = _place(spark, path)
    found: dict[int, list[str]] = {}
    for pattern in (f"{path}/{name}=*", f"{path}/*=*/{name}=*") if nested else (f"{path}/{name}=*",):
        for status in files.globStatus(_place(spark, pattern)[1]) or []:
            place = status.getPath()
            if number := re.fullmatch(rf"{name}=(-?\d+)", place.getName()):
                found.setdefault(int(number[1]), []).append(place.toString())
    return found


def _bases(spark: SparkSession, path: str) -> list[int]:
    """The folds that are whole; one that is being written, or was left unfinished, is none yet."""
    return [n for n in _numbered(spark, f"{path}-folded", "upto") if exists(spark, f"{path}-folded/upto={n}/_SUCCESS")]


#: Tasks that write a folder where the session does not size them.
SPREAD = 8


def together(rows: DataFrame, *columns: str) -> DataFrame:
    """Brings rows of equal columns together before they are written into folders by these. Under adaptive execution a folder takes as
    many tasks as its data need. The batches of a stream run without it, where that hint does nothing and every task would write a
    file into every folder: there the rows of a folder go to `SPREAD` tasks."""
    if rows.sparkSession.conf.get("spark.sql.adaptive.enabled", "true") == "true":
        return rows.hint("rebalance", *[F.col(c) for c in columns])
    return rows.repartition(*[F.col(c) for c in columns], F.pmod(F.xxhash64(*rows.columns), F.lit(SPREAD)))


def write_batch(
    rows: DataFrame, path: str, batch_id: int, partitions: tuple[str, ...] = (), tasks: int | None = None, as_dealt: bool = False
) -> None:
    """Writes rows as batch `batch_id`. The batch has a folder of its own, below one folder per value
    of `partitions`, and is replaced as a whole.

    With partition columns the rows are brought together by folder first, so that there are not as
    many files as tasks times folders; a folder with much data is split over several tasks again.
    `tasks` sets the number of writing tasks for batches that fill very many small folders. With `as_dealt` the rows are
    written from where they are: for loads whose tasks hold enough rows of each folder for a file of its own.
    """
    if partitions and tasks:
        row_hash = F.xxhash64(*rows.columns)
        rows = rows.repartitionByRange(tasks, *[F.col(p) for p in partitions], row_hash)
    elif partitions and not as_dealt:
        rows = together(rows, *partitions)
    with setting(rows.sparkSession, SPENT_SHUFFLES, "true"):
        if not partitions:
            rows.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
            return
        numbered = rows.withColumn("batch_id", F.lit(batch_id).cast("bigint"))
        numbered.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partitions, "batch_id").parquet(path)


@contextmanager
def held(rows: DataFrame, root: str) -> Iterator[DataFrame]:
    """The rows as files for the time of a block: worked out once, whatever is written meanwhile. (Of cached rows a write drops
    those that were read from below its path, and what does not fit the memory takes more disk than files do.)"""
    spark, path = rows.sparkSession, f"{root}/held/{uuid.uuid4().hex}"
    with setting(spark, SPENT_SHUFFLES, "true"):
        rows.write.parquet(path)
    try:
        yield spark.read.schema(rows.schema).parquet(path)
    finally:
        remove(spark, path)


def nothing(spark: SparkSession, schema: T.StructType) -> DataFrame:
    """No rows, and the optimizer knows it: joins with them go before anything is shuffled. (Of the rows of a list it does not
    know how many there are.)"""
    return spark.createDataFrame([], schema).filter(F.lit(False))


def read_batches(
    spark: SparkSession, path: str, schema: T.StructType, before: int | None = None,
    day: str | None = None, days: list[str | None] | None = None,
) -> DataFrame:
    """All batches written so far (or those before one), with their `batch_id`; empty when nothing was
    written yet. With `days`, only the folders of these values of `day` are listed and read."""
    full = T.StructType([f for f in schema.fields if f.name != "batch_id"] + [T.StructField("batch_id", LONG)])

    def read(root: str, schema: T.StructType) -> DataFrame:
        paths = [root] if days is None else [f"{root}/{day}={_NO_DAY if d is None else d}" for d in days]
        paths = [p for p in paths if exists(spark, p)]
        if not paths:
            return nothing(spark, schema)
        return spark.read.option("basePath", root).schema(schema).parquet(*paths)

    rows = read(path, full)
    levels = [n for n in _bases(spark, path) if before is None or n < before]
    if levels:
        # What came in before its time after the fold (backfills) is not in the base yet.
        level = max(levels)
        folded = _folded_backfills(spark, path, level)
        missing = (F.col("batch_id") < 0) & ~F.col("batch_id").isin(folded) if folded else F.col("batch_id") < 0
        rows = read(f"{path}-folded/upto={level}", full).unionByName(rows.filter((F.col("batch_id") > level) | missing))
    return rows if before is None else rows.filter(F.col("batch_id") < before)


def read_days(
    spark: SparkSession, path: str, schema: T.StructType, batch: DataFrame, day: str, before: int | None = None
) -> DataFrame:
    """The stored rows of the days that occur in a batch."""
    days = days_of(batch, day)
    if days is not None:
        return read_batches(spark, path, schema, before, day, days)
    wanted = batch.select(day).distinct().withColumnRenamed(day, "_day")
    return read_batches(spark, path, schema, before).join(wanted, F.col(day).eqNullSafe(F.col("_day")), "left_semi")


def days_of(batch: DataFrame, day: str) -> list[str | None] | None:
    """The days that occur in a batch; None if there are more than are read by folder."""
    days = [r[0] for r in batch.select(day).distinct().limit(MOST_DAYS + 1).collect()]
    return days if len(days) <= MOST_DAYS else None


def read_batch(spark: SparkSession, path: str, schema: T.StructType, batch_id: int, day: str, days: list[str | None] | None) -> DataFrame:
    """What a batch wrote, of the folders of these values of `day` (None: of all)."""
    full = T.StructType([*schema.fields, T.StructField("batch_id", LONG)])
    if days is None:
        return spark.read.schema(full).parquet(path).filter(F.col("batch_id") == batch_id)
    paths = [f"{path}/{day}={_NO_DAY if d is None else d}/batch_id={batch_id}" for d in days]
    paths = [p for p in paths if exists(spark, p)]
    return spark.read.option("basePath", path).schema(full).parquet(*paths) if paths else nothing(spark, full)


def _folded_backfills(spark: SparkSession, path: str, level: int) -> list[int]:
    place = f"{path}-folded-backfills/upto={level}"
    return [r[0] for r in spark.read.schema("batch_id bigint").parquet(place).collect()] if exists(spark, place) else []


def fold(
    spark: SparkSession, path: str, schema: T.StructType, reduce: Callable[[DataFrame], DataFrame],
    upto: int | None = None, partitions: tuple[str, ...] = (),
) -> None:
    """Folds all batches up to `upto` (default: all there are) into a base of the rows that `reduce`
    leaves of them; `batch_id` stays theirs. Batches that the fold before this one took in, and
    older bases, are deleted: readers under way since then still find theirs."""
    batches = _numbered(spark, path, "batch_id", nested=True)
    earlier = sorted(_bases(spark, path))
    known = [n for n in batches if n >= 0] + earlier
    if upto is None:
        upto = max(known, default=None)
    if upto is None or upto in earlier or not any(n <= upto for n in batches):
        return  # also when a batch is run again: its fold is there
    backfills = [n for n in batches if n < 0]
    rows = reduce(read_batches(spark, path, schema, before=upto + 1))
    if backfills:
        spark.createDataFrame([(n,) for n in backfills], "batch_id bigint").write.mode("overwrite").parquet(f"{path}-folded-backfills/upto={upto}")
    with setting(rows.sparkSession, SPENT_SHUFFLES, "true"):
        rows.write.mode("overwrite").partitionBy(*partitions).parquet(f"{path}-folded/upto={upto}")
    last = max((n for n in earlier if n < upto), default=None)
    if last is not None:
        for n, places in batches.items():
            if 0 <= n <= last:
                for place in places:
                    remove(spark, place)
        for n in earlier:
            if n < last:
                remove(spark, f"{path}-folded/upto={n}")
                remove(spark, f"{path}-folded-backfills/upto={n}")


# -- dimensions ---------------------------------------------------------------------------------


def _with_seq(schema: T.StructType) -> T.StructType:
    return T.StructType(schema.fields + [T.StructField("seq", LONG)])


def upsert_dim(rows: DataFrame, path: str, batch_id: int, key: str = "id") -> None:
    """Keyed upsert of one micro-batch: the last row per key (by `seq`) is kept. Deduplicating
    keeps one row per key and task before the shuffle."""
    if "seq" not in rows.columns:
        rows = rows.withColumn("seq", F.lit(0).cast("bigint"))
    write_batch(first_per_key(rows, [key], [F.desc("seq")]), f"{path}/changes", batch_id)


def _newest(rows: DataFrame, key: str) -> DataFrame:
    return first_per_key(rows, [key], [F.desc("batch_id"), F.desc("seq")])


def read_dim(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    key: str = "id",
    only: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """The current row per key. `only` may narrow the stored rows by key; it is applied before
    versions are compared."""
    changes = read_batches(spark, f"{path}/changes", _with_seq(schema))
    if only is not None:
        changes = only(changes)
    return _newest(changes, key).select(*schema.fieldNames())


def compact_dim(spark: SparkSession, path: str, schema: T.StructType, key: str = "id", upto: int | None = None) -> None:
    """Folds the batches so far; afterwards readers touch only the base and later batches. A row of a
    backfill loses to any other, also one that was folded before it came."""
    fold(spark, f"{path}/changes", _with_seq(schema), lambda rows: _newest(rows, key), upto)


#: Up to so many ids of a lookup are named to the scan; more are joined.
NAMED_IDS = 1000
#: Bytes of a row group of a sorted table: what a lookup of one id reads.
ROW_GROUP = 4 << 20


def write_sorted(rows: DataFrame, path: str, key: str = "id") -> None:
    """A table whose files lie in order of the key, in small row groups with bounds and a Bloom filter of the key each:
    a lookup reads the row groups that may hold its ids."""
    (
        rows.repartitionByRange(key).sortWithinPartitions(key).write.mode("overwrite")
        .option("parquet.block.size", ROW_GROUP).option(f"parquet.bloom.filter.enabled#{key}", "true")
        # A filter is sized by what a row group may hold of rows of 64 bytes; by default it takes a megabyte.
        .option(f"parquet.bloom.filter.expected.ndv#{key}", max(64, ROW_GROUP // 64)).parquet(path)
    )


def lookup_sorted(spark: SparkSession, path: str, schema: T.StructType, ids: DataFrame, id_column: str, key: str = "id") -> DataFrame:
    """The rows of a sorted table whose key is among the ids (made distinct with map-side combine)."""
    table = spark.read.schema(schema).parquet(path)
    wanted = ids.select(F.col(id_column).cast(schema[key].dataType).alias("_wanted")).where("_wanted IS NOT NULL").distinct()
    named = [r[0] for r in wanted.limit(NAMED_IDS + 1).collect()]
    if len(named) <= NAMED_IDS:
        return table.filter(F.col(key).isin(named))
    return table.join(wanted, F.col(key) == F.col("_wanted"), "left_semi")


def write_bucketed(rows: DataFrame, name: str, path: str, key: str = "id", buckets: int | None = None) -> None:
    """A table spread over hash buckets of its key, sorted within: joins on the key with a table
    bucketed alike need no shuffle. A bucket is one task of such a join; by default there are as many as
    the session has shuffle partitions."""
    if buckets is None:
        buckets = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(name)


# -- document index per day ---------------------------------------------------------------------


def upsert_docs(rows: DataFrame, path: str, batch_id: int, day: str = "dt", tasks: int | None = None) -> None:
    """Documents into their day's index. The day is the event's day, not the day of writing."""
    write_batch(rows, path, batch_id, (day,), tasks)


def read_docs(spark: SparkSession, path: str, schema: T.StructType, key: str, day: str = "dt") -> DataFrame:
    """The newest document per day and id."""
    return _newest_docs(read_batches(spark, path, schema), key, day).select(*schema.fieldNames())


def _newest_docs(rows: DataFrame, key: str, day: str) -> DataFrame:
    return first_per_key(rows, [day, key], [F.desc("batch_id")])


def fold_docs(spark: SparkSession, path: str, schema: T.StructType, key: str, day: str = "dt", upto: int | None = None) -> None:
    fold(spark, path, schema, lambda rows: _newest_docs(rows, key, day), upto, (day,))


def index_views(docs: DataFrame, name: str, days: tuple[str, ...] = (), day: str = "dt") -> None:
    """A view over all days, `<name>_query`, and one per named day, `<name>_<day>_query`; the day
    is a partition filter."""
    docs.createOrReplaceTempView(f"{name}_query")
    for d in days:
        docs.filter(F.col(day) == d).createOrReplaceTempView(f"{name}_{d.replace('-', '_')}_query")


# -- analytical table and raw archive -----------------------------------------------------------


def by_month(rows: DataFrame, day: str = "dt") -> DataFrame:
    """Adds the month, by which tables of facts lie. Days would be folders of a few rows each."""
    return rows.withColumn("month", F.substring(day, 1, 7))


def monthly(schema: T.StructType) -> T.StructType:
    return T.StructType(schema.fields + [T.StructField("month", T.StringType())])


def append_olap(rows: DataFrame, path: str, batch_id: int, as_dealt: bool = False) -> None:
    """Wide rows into the analytical table, by month; a replayed batch replaces itself."""
    write_batch(by_month(rows), path, batch_id, ("month",), as_dealt=as_dealt)


def read_olap(spark: SparkSession, path: str, schema: T.StructType, date: str | None = None) -> DataFrame:
    """The table's rows, of one day if it is named: only that month's folder is read."""
    months = None if date is None else [date[:7]]
    rows = read_batches(spark, path, monthly(schema), day="month", days=months)
    return (rows if date is None else rows.filter(F.col("dt") == date)).select(*schema.fieldNames())


def append_olap_jdbc(
    rows: DataFrame, url: str, table: str, driver: str, writers: int | None = None, batch_size: int = 100
) -> None:
    """The same by JDBC, without a transaction: rows in inserts of `batch_size` over `writers`
    connections (default: one per partition). Not idempotent, and not tested here: it needs a
    database."""
    if writers is not None:
        rows = rows.coalesce(writers)
    (
        rows.write.mode("append").option("batchsize", batch_size).option("isolationLevel", "NONE")
        .option("driver", driver).jdbc(url, table)
    )


def archive_raw(lines: DataFrame, path: str, batch_id: int) -> None:
    """Raw log lines (dt, value) as text, one folder per day."""
    by_day = together(lines.select("dt", "value"), "dt")
    with setting(lines.sparkSession, SPENT_SHUFFLES, "true"):
        by_day.write.mode("overwrite").partitionBy("dt").text(f"{path}/batch_id={batch_id}")
