"""Hard negatives by inner product, with coordinate pruning.

Vectors are compared as whole numbers: floor(scale * x). An anchor's positives are the rows of its
label of highest inner product; a positive's negatives the highest rows of other labels within a window of
shares of the positive's score. Ties go by smaller id.

Search: rows lie in chunks of bounded size (a length of vector, a label, a hash), anchors in blocks; each pair of chunk
and block is a task's step, and passes on at most as many rows as are asked for. A chunk is an index: its
rows by descending length, cut into buckets, each with its unit vectors' coordinates as sorted
lists. For a score of at least t, an anchor q and a bucket of greatest length l, the cosine must reach
c = t / (|q| l): beyond 1 the bucket, and all after it, hold nothing. Otherwise, for a coordinate f of the unit
vectors, only values between q_f c - r and q_f c + r can do, r = sqrt((1 - c^2)(1 - q_f^2)) (with no upper end where c
< q_f, nor lower one where c < -q_f). The ranges of the anchor's largest coordinates, its focus, are cut from their lists
and intersected, and what is left is verified in whole numbers. t is the least score asked for, and rises to the
lowest of those found when there are enough.

Copies: of equal vectors of a label, only the first few by id can be among the rows asked for; the others are left out
before the search. That loses nothing, and a group of copies of any size takes no more room than a few rows.

Defined cases: rows with a null label, a null vector or any null or non-finite component take no part, nor do vectors whose
squared length in whole numbers reaches 2^62 (their products need not fit a long). Vectors of different lengths are not
compared. A null id is no anchor; as another row it comes after all others. A row of the anchor's own id is not another row.
Repeated rows are rows of their own, as anchors answered once. Empty tables give no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from retailflow.llm.common import bounded_batches, renamed, written

#: Components of a chunk, and of a block of anchors.
CHUNK = 1 << 20
BUCKET = 256
FOCUS = 4
#: Added to ranges, for the rounding of unit vectors.
SLACK = 1e-9
_NO_ID = np.iinfo(np.int64).max


@dataclass(frozen=True)
class Mining:
    anchors_of: int = 100  # anchors are the ids divisible by it
    positives: int = 5
    negatives: int = 10
    low: int = 30  # per cent of the positive's score
    high: int = 90
    scale: int = 256


class Index:
    """Rows of a chunk in buckets by length."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, unknown: np.ndarray, label: np.ndarray):
        length = np.sqrt((vectors.astype(float) ** 2).sum(axis=1))
        order = np.lexsort((ids, unknown, -length))
        self.vectors, self.ids, self.unknown, self.label, self.length = vectors[order], ids[order], unknown[order], label[order], length[order]
        unit = self.vectors / np.maximum(self.length, 1e-300)[:, None]
        self.unit = unit
        self.heads = list(range(0, len(order), BUCKET))
        # Sorted lists of each bucket: (dimensions, rows) of places, and the values in that order.
        self.lists = [np.argsort(unit[h : h + BUCKET], axis=0).T for h in self.heads]
        self.values = [np.take_along_axis(unit[h : h + BUCKET].T, lists, axis=1) for h, lists in zip(self.heads, self.lists, strict=True)]

    def candidates(self, bucket: int, unit: np.ndarray, focus: np.ndarray, cosine: float) -> np.ndarray:
        """Rows of a bucket that can reach the cosine with the unit vector."""
        head = self.heads[bucket]
        values, lists = self.values[bucket], self.lists[bucket]
        n = values.shape[1]
        if cosine <= -1:
            return np.arange(head, head + n)
        q = unit[focus]
        r = np.sqrt(np.maximum((1 - cosine**2) * (1 - q**2), 0))
        low = np.where(cosine < -q, -1.0, q * cosine - r) - SLACK
        high = np.where(cosine < q, 1.0, q * cosine + r) + SLACK
        met = np.zeros(n, np.int8)
        for f, lo, hi in zip(focus.tolist(), low.tolist(), high.tolist(), strict=True):
            from_, to = np.searchsorted(values[f], lo), np.searchsorted(values[f], hi, "right")
            met[lists[f, from_:to]] += 1
        return head + np.flatnonzero(met == len(focus))


def _first(scores: np.ndarray, index: Index, rows: np.ndarray, n: int) -> np.ndarray:
    """The n places of highest score, ties by id."""
    if len(rows) > 4 * n:  # all that reach the n-th highest score
        least = np.partition(scores, len(scores) - n)[len(scores) - n]
        near = np.flatnonzero(scores >= least)
        return near[np.lexsort((index.ids[rows[near]], index.unknown[rows[near]], -scores[near]))[:n]]
    return np.lexsort((index.ids[rows], index.unknown[rows], -scores))[:n]


def search(index: Index, vector: np.ndarray, own: int, label: int, windows: list[tuple[float, float, int]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each window (least score, greatest score, number), rows and scores of the highest within, ties by id.
    own, label: an id and a label (by its code) that are left out."""
    length = float(np.sqrt((vector.astype(float) ** 2).sum()))
    unit = vector / max(length, 1e-300)
    focus = np.argsort(-np.abs(unit))[:FOCUS]
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in windows]
    least = [low for low, _, _ in windows]
    for bucket, head in enumerate(index.heads):
        t, top = min(least), length * index.length[head]
        if t > top * (1 + SLACK) + 1e-6:  # this bucket and all shorter ones
            break
        # The bucket's lengths lie between its last and first: a positive score needs the most of the longest.
        reach = top if t > 0 else length * index.length[min(head + BUCKET, len(index.ids)) - 1]
        cosine = t / reach - SLACK * (1 + abs(t) / reach) if reach > 0 else -1.0
        rows = index.candidates(bucket, unit, focus, min(max(cosine, -1.0), 1.0))
        rows = rows[(index.unknown[rows] | (index.ids[rows] != own)) & (index.label[rows] != label)]
        if not len(rows):
            continue
        scores = index.vectors[rows] @ vector
        for i, (_, high, n) in enumerate(windows):
            some = np.flatnonzero((scores >= least[i]) & (scores <= high))
            if not len(some):
                continue
            all_rows, all_scores = np.r_[found[i][0], rows[some]], np.r_[found[i][1], scores[some]]
            keep = _first(all_scores, index, all_rows, n)
            found[i] = all_rows[keep], all_scores[keep]
            if len(keep) == n:
                least[i] = max(least[i], found[i][1][-1])
    return found


def prepared(vectors: DataFrame, label: Column, scale: int) -> DataFrame:
    """vec_id, label, vector (whole numbers), dims, copies of the rows that take part, equal ones as one."""
    rows = renamed(vectors, ["vec_id", "embedding", "label"])
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"), F.col("embedding").cast("array<double>").alias("x"))
    bad = F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    rows = rows.where(F.col("label").isNotNull() & F.col("x").isNotNull()).where(~bad)
    rows = rows.withColumn("x", F.transform("x", lambda v: F.when(F.abs(v) < float(1 << 40), F.floor(v * scale).cast("double")).otherwise(v)))
    rows = rows.where(F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v) < float(1 << 62))
    rows = rows.select("vec_id", "label", F.transform("x", lambda v: v.cast("long")).alias("vector"))
    return rows.groupBy("vec_id", "label", "vector").agg(F.count(F.lit(1)).alias("copies"), F.first(F.size("vector")).alias("dims"))


def _few(rows: DataFrame, n: int) -> DataFrame:
    """Of equal vectors of a label, n + 1 ids and n copies of each: the first n rows, whatever id is left out."""
    same = W.partitionBy("label", F.xxhash64("vector"), "vector").orderBy(F.col("vec_id").asc_nulls_last())
    rows = rows.withColumn("place", F.row_number().over(same)).where(F.col("place") <= n + 1)
    copy = F.explode(F.sequence(F.lit(1), F.least("copies", F.lit(n)).cast("int"))).alias("copy")
    return rows.select("vec_id", "label", "vector", "dims", copy)


def _index(table: pa.Table, code: dict) -> Index:
    ids = table["vec_id"].combine_chunks()
    label = np.array([code.setdefault(x, len(code)) for x in table["label"].to_pylist()], np.int64)
    return Index(_matrix(table), ids.fill_null(_NO_ID).to_numpy().astype(np.int64), ids.is_null().to_numpy(zero_copy_only=False), label)


def _matrix(table: pa.Table) -> np.ndarray:
    return table["vector"].combine_chunks().flatten().to_numpy().reshape(table.num_rows, -1)


def _searched(chunks: DataFrame, asked: DataFrame, windows, others: bool) -> DataFrame:
    """Blocks of anchors meet the chunks of the same place. windows: of an anchor, given its scores so far.
    others: rows of the anchor's label are left out. Rows anchor, window, found_id, score."""
    def meet(rows: pa.Table, asked: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if rows.num_rows and asked.num_rows:
            code: dict = {}
            index, vectors = _index(rows, code), _matrix(asked)
            names, own, labels, scores = (asked[c].to_pylist() for c in ("anchor", "anchor_id", "of_label", "scores"))
            for i, vector in enumerate(vectors):
                label = code.get(labels[i], -1) if others else -1
                for w, (at, found) in enumerate(search(index, vector, own[i], label, windows(scores[i]))):
                    out.extend((names[i], w, None if index.unknown[a] else int(index.ids[a]), int(s)) for a, s in zip(at.tolist(), found.tolist(), strict=True))
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64())
        return pa.table([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], ["anchor", "window", "found_id", "score"])

    return chunks.groupBy("place").cogroup(asked.groupBy("asked_place")).applyInArrow(meet, "anchor long, window int, found_id long, score long")


def _ranked(rows: DataFrame, keys: list[str], n: int) -> DataFrame:
    order = [F.col("score").desc(), F.col("found_id").asc_nulls_last()]
    return rows.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= n)


def _chunks_of(rows: Column, dims: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(rows * F.greatest(dims, F.lit(1)) / CHUNK)).cast("int")


def mined(vectors: DataFrame, label: Column, mining: Mining = Mining()) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score. label: of a row of
    `vectors` (vec_id, embedding, label)."""
    bounded_batches(vectors.sparkSession)
    everything = prepared(vectors, label, mining.scale)
    rows = written(_few(everything, max(mining.positives, mining.negatives)), "negatives-rows")
    anchors = everything.where(F.col("vec_id") % mining.anchors_of == 0)
    anchors = anchors.select(F.xxhash64("vec_id", "label", "vector").alias("anchor"), F.col("vec_id").alias("anchor_id"), F.col("label").alias("of_label"), "dims", "vector")
    anchors = written(anchors, "negatives-anchors")
    blocks, total = (
        f.agg(_chunks_of(F.count(F.lit(1)), F.coalesce(F.max("dims"), F.lit(1)))).first()[0] for f in (anchors, rows))
    block = F.pmod(F.col("anchor"), F.lit(blocks)).cast("int")
    every_block = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    spread = F.xxhash64("vec_id", "vector", "copy")

    # Positives: chunks of one label each, as many as its rows ask for.
    sizes = rows.groupBy("label", "dims").agg(F.count(F.lit(1)).alias("rows"))
    sizes = written(sizes.select("label", "dims", _chunks_of(F.col("rows"), F.col("dims")).alias("chunks")), "negatives-labels")
    place = F.struct("label", "dims", "chunk", "block").alias("place")
    chunks = rows.join(sizes, ["label", "dims"]).withColumn("chunk", F.pmod(spread, "chunks").cast("int")).withColumn("block", every_block)
    asked = anchors.withColumn("label", F.col("of_label")).join(sizes, ["label", "dims"]) \
        .withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).withColumn("block", block)
    asked = asked.select("anchor", "anchor_id", "of_label", "vector", F.lit(None).cast("array<long>").alias("scores"), place.alias("asked_place"))
    lowest, highest = -(1 << 63), (1 << 63) - 1
    found = _searched(chunks.select("vec_id", "label", "vector", place), asked, lambda _: [(lowest, highest, mining.positives)], False)
    found = _ranked(found, ["anchor"], mining.positives)
    positives = written(found.select("anchor", F.col("rank").alias("place"), F.col("found_id").alias("positive_id"), F.col("score").alias("positive_score")), "negatives-positives")

    # Negatives: all chunks, whatever their labels, for an anchor's windows at once.
    scores = positives.groupBy(F.col("anchor").alias("of")).agg(F.array_sort(F.collect_list(F.struct("place", "positive_score"))).alias("p"))
    asked = anchors.join(scores, F.col("anchor") == F.col("of")).withColumn("block", block)
    asked = asked.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(total - 1))))
    place = F.struct("dims", "chunk", "block").alias("place")
    asked = asked.select("anchor", "anchor_id", "of_label", "vector", F.col("p.positive_score").alias("scores"), place.alias("asked_place"))
    chunks = rows.withColumn("chunk", F.pmod(spread, F.lit(total)).cast("int")).withColumn("block", every_block)

    def windows(scores: list[int]) -> list[tuple[int, int, int]]:
        return [(-(-mining.low * s // 100), mining.high * s // 100, mining.negatives) for s in scores]

    found = _searched(chunks.select("vec_id", "label", "vector", place), asked, windows, True)
    found = _ranked(found, ["anchor", "window"], mining.negatives).withColumn("place", F.col("window") + 1)
    ids = anchors.select(F.col("anchor").alias("of"), "anchor_id")
    return found.join(positives, ["anchor", "place"]).join(ids, F.col("anchor") == F.col("of")).select(
        "anchor_id", "positive_id", "rank", F.col("found_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
