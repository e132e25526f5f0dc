"""Exact duplicates: documents grouped by a 128-bit hash of the text, bytes compared inside groups.

Texts are equal when identical after deleting white space (space, 09 to 0D). The document with the
most code points in the original text stays, then the one with the smallest id.

Stages: a narrow table of hashes and ids (no text) is grouped by hash. Only texts whose hash occurs
again, by a Bloom filter and then exactly, are shuffled to compare bytes; a group whose least and
greatest text are the same holds one text. Groups that do not are grouped by the texts themselves.

Defined cases: null text counts as empty, and all empty texts are one group. A null id orders after
all others. Repeated rows with the same id are copies: each gets its row, `kept` true for
all rows of the id that stays. Empty tables give no rows. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retailflow.llm import bloom
from retailflow.llm.common import SPACES, renamed, written



def normal(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), SPACES, "")


def content_hash(normalised: Column) -> Column:
    """128 bits, as 16 bytes."""
    return F.unhex(F.md5(normalised.cast("binary")))


def digest(normalised: Column) -> Column:
    return F.sha2(normalised.cast("binary"), 256)


def _group(rows: DataFrame, *keys: str) -> DataFrame:
    stays = F.struct((-F.col("code_points")).alias("fewer"), F.col("doc_id").isNull().alias("unknown"), "doc_id")
    return rows.groupBy(*keys).agg(F.min(stays).alias("stays"), F.count(F.lit(1)).alias("group_size"))


def groups(docs: DataFrame, hashed=content_hash) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every document."""
    docs = renamed(docs, ["doc_id", "text"]).select("doc_id", "text", normal(F.col("text")).alias("normal"))
    docs = docs.select("doc_id", "normal", hashed(F.col("normal")).alias("hash"), digest(F.col("normal")).alias("text_sha256"),
                       F.length(F.coalesce("text", F.lit(""))).cast("long").alias("code_points"))
    digests = written(docs.drop("normal"), "exact-digests")
    classes = _group(digests, "hash")
    again = written(classes.where("group_size > 1").select("hash"), "exact-repeated")

    # Bytes: the texts of repeated hashes meet by hash.
    texts = bloom.marked(docs.select("hash", "normal"), F.col("hash"), bloom.build(again, "hash"), "possible").where("possible")
    texts = texts.join(again, "hash", "left_semi")
    bounds = texts.groupBy("hash").agg(F.min("normal").alias("least"), F.max("normal").alias("greatest"))
    differ = written(bounds.where("least != greatest").select("hash"), "exact-collided")
    if differ.isEmpty():  # as good as always: 128 bits
        return _result(digests.join(classes, "hash"))
    proven = digests.join(differ, "hash", "left_anti").join(classes, "hash")
    collided = docs.join(differ, "hash", "left_semi")
    return _result(proven).unionByName(_result(collided.join(_group(collided, "normal"), "normal")))


def _result(rows: DataFrame) -> DataFrame:
    keep = F.col("stays.doc_id")
    return rows.select("doc_id", keep.alias("keep_id"), "group_size", F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256")


def deduplicated(docs: DataFrame) -> DataFrame:
    """The documents that stay, with all their columns: one row for each group, of the most code points."""
    keep = groups(docs).where("kept").select(F.col("doc_id").alias("kept_id"), F.col("text_sha256").alias("kept_sha256")).distinct()
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), digest(normal(F.col("text"))).alias("sha256"))
    same = rows["id"].eqNullSafe(keep["kept_id"]) & (rows["sha256"] == keep["kept_sha256"])
    # Rows of one id whose texts differ in white space: the longest, then one that is the same in every run.
    best = F.struct(F.length(F.coalesce("row.text", F.lit(""))), F.col("row.text").isNotNull(), F.xxhash64("row.text"))
    return rows.join(keep, same, "left_semi").groupBy("id", "sha256").agg(F.max_by("row", best).alias("row")).select("row.*")
