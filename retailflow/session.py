"""Session settings the package is designed for, and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

TIME_ZONE = "UTC"

# Settings that may change on a running session.
RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": TIME_ZONE,
    # Joins are left to the optimizer: it broadcasts a side only below
    # spark.sql.autoBroadcastJoinThreshold and splits skewed partitions at run time, also where
    # that costs one more shuffle (a hot key under two joins in a row).
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # A lookup of some ids asks row groups for each of them, not for the range between the least and the greatest.
    "spark.sql.parquet.pushdown.inFilterThreshold": "1000",
    # Keyed state lives in RocksDB, so it may outgrow the executor heap.
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    # A join of streams keeps one store a partition, not four; no row is looked up only to be counted.
    "spark.sql.streaming.join.stateFormatVersion": "3",
    "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false",
    # Tables of the shared folder and state are written for less disk.
    "spark.sql.parquet.compression.codec": "zstd",
    "spark.sql.streaming.stateStore.compression.codec": "zstd",
    "spark.sql.streaming.stateStore.rocksdb.compression": "zstd",
}

#: The files of a query's shuffles go when the query ends, not when the driver happens to collect its garbage.
SPENT_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(app: str = "retailflow", master: str | None = None, **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**RUNTIME_SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def configure(spark: SparkSession) -> SparkSession:
    """Applies the settings to a session built elsewhere."""
    for key, value in RUNTIME_SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A setting for the plans made within a block."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


@contextmanager
def stateful_start(spark: SparkSession) -> Iterator[None]:
    """A block that starts a query. Keyed state stays in as many partitions as the query started with, and every batch opens and
    commits each of them: two for a core, where the session's shuffles have more."""
    most = int(spark.conf.get("spark.sql.shuffle.partitions"))
    with setting(spark, "spark.sql.shuffle.partitions", str(min(most, 2 * spark.sparkContext.defaultParallelism))):
        yield


def shared_root(spark: SparkSession) -> str:
    """The folder all executors see. The cluster names it in spark.checkpoint.dir; only a session
    within one process (local tests) may do without and gets a fresh folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="retailflow-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def run_dir(spark: SparkSession, name: str) -> str:
    """A new sub-folder of the shared folder for one run of a job."""
    return f"{shared_root(spark)}/retailflow/{name}-{uuid.uuid4().hex[:12]}"
