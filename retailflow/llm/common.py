"""Helpers of the operators: tables, the shared folder, expressions over texts."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from retailflow.session import SPENT_SHUFFLES, run_dir, setting

#: The white space of all word rules: space and the control characters 09 to 0D.
SPACES = " \t\n\x0b\x0c\r"
#: Bytes of one Arrow batch on its way to a Python task; what a task holds is a small multiple of it.
BATCH_BYTES = 6 << 20
#: Bytes of texts that a task takes apart at once; arrays over their bytes and words are some thirty times as much.
PIECE_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: For tables of rows of a megabyte and more: row groups of few rows, whose size is looked at after each. A task buffers a row group
#: when it writes, and reads it as one batch; by default a size is looked at after a hundred rows.
LARGE_ROWS = {"parquet.block.size": str(16 << 20), "parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "1"}


def written(frame: DataFrame, name: str, options: dict[str, str] | None = None) -> DataFrame:
    """The rows as a table in the shared folder: computed once, and again by nobody when executors are lost. The
    shuffles that made them are spent then."""
    path = run_dir(frame.sparkSession, name)
    with setting(frame.sparkSession, SPENT_SHUFFLES, "true"):
        frame.write.options(**(options or {})).option("compression", "zstd").parquet(path)
    table = frame.sparkSession.read.schema(frame.schema).parquet(path)
    table.__dict__["_folder"] = path
    return table


def discard(*frames: DataFrame) -> None:
    """Deletes the folders of written tables that nothing reads any more: what was made of them is written itself."""
    for frame in frames:
        path = frame.__dict__.pop("_folder")
        spark = frame.sparkSession
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def bounded_batches(spark: SparkSession) -> None:
    """Bounds the Arrow batches that Python tasks get by bytes and not by rows alone."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def pieces(batches: Iterable[pa.RecordBatch], text: str = "text") -> Iterator[pa.RecordBatch]:
    """The rows of the batches, few texts at a time: those that begin within the same PIECE_BYTES of their batch."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch[text]), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        part = (np.cumsum(size) - size) // PIECE_BYTES
        heads = np.flatnonzero(np.r_[True, part[1:] != part[:-1]][: len(part)])
        for at, end in zip(heads.tolist(), [*heads[1:].tolist(), len(part)], strict=False):
            yield batch.slice(at, end - at)


def mounted(path: str) -> str:
    """The file path behind a shared folder's address. Workers map or append files there, which
    needs a folder mounted on every machine."""
    parts = urlparse(path)
    if parts.scheme not in ("", "file"):
        raise ValueError(f"{path}: spark.checkpoint.dir must be a folder mounted on every executor (file:...)")
    return unquote(parts.path) if parts.scheme else path


def fold(key: str | None) -> Column:
    """crc32 of an id as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")))


def renamed(frame: DataFrame, names: Iterable[str]) -> DataFrame:
    """Only the columns that an operator reads: extra ones cannot clash with its own."""
    return frame.select(*[F.col(f"`{n}`") for n in names])
