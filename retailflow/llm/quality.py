"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

A text's features are its words, hashed into BUCKETS and weighted by 1 + log count to length one, the
shares of kinds of bytes, word statistics, and the table's own `n_chars`. The score is the logistic
of w0 + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j; the pairs take time linear in the features by
    2 sum_{i<j} <v_i, v_j> x_i x_j = sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2).

Fitting uses at most `rows` labelled documents, those of least hash (a documented, bounded sample);
scoring reads every text whole. Labels, lang, source and doc_id are no features.

Fitting goes through the driver in sparse rows, a batch of which is made dense at a time.

Defined cases: null and empty texts have no words and statistics 0 and are scored like any other; a null
n_chars counts as missing, a feature of its own. Of several labels of one document the mean is learnt,
null labels not at all. Null ids are not learnt from. Of several rows of one labelled id one is, that of the greatest hash. Without labels every score is 0.5. Repeated
rows are scored each. Empty tables give no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retailflow.llm.common import bounded_batches, pieces
from retailflow.llm.words import PIECE, Words, ranges, scan

BUCKETS = 1 << 12
#: Kinds of bytes: space, line end, A-Z, a-z, digit, other ASCII, not ASCII.
_KIND = np.full(256, 5, np.uint8)
_KIND[[32, 9, 11, 12]], _KIND[[10, 13]] = 0, 1
_KIND[65:91], _KIND[97:123], _KIND[48:58], _KIND[128:] = 2, 3, 4, 6
KINDS = 7
STATISTICS = KINDS + 8


@dataclass(frozen=True)
class Fit:
    rows: int = 4000
    rank: int = 8
    steps: int = 300
    batch: int = 256
    rate: float = 0.01
    decay: float = 5e-3
    seed: int = 5


@dataclass
class Machine:
    bias: float
    weight: np.ndarray  # features
    factor: np.ndarray  # features x rank
    mean: np.ndarray  # of the statistics
    scale: np.ndarray


def _kinds(words: Words) -> np.ndarray:
    """Bytes of each kind, a row for each text."""
    out = np.zeros(words.rows * KINDS, np.int64)
    lo, hi = int(words.offsets[0]), int(words.offsets[-1])
    for at in range(lo, hi, PIECE):
        end = min(at + PIECE, hi)
        first, last = np.searchsorted(words.offsets, at, "right") - 1, np.searchsorted(words.offsets, end)
        lengths = np.diff(np.clip(words.offsets[first : last + 1], at, end))
        row = np.repeat(np.arange(last - first, dtype=np.int64), lengths)
        found = np.bincount(row * KINDS + _KIND[words.data[at:end]], minlength=(last - first) * KINDS)
        out[first * KINDS : last * KINDS] += found
    return out.reshape(-1, KINDS)


def features(texts: pa.Array, n_chars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words as (first, bucket, value), grouped by text with texts beginning at `first`, and the statistics.
    n_chars: float, NaN where missing."""
    words = scan(texts)
    n, row = words.rows, words.row()
    counts = np.diff(words.first)
    distinct_words = np.zeros(n)
    if len(row):
        order = np.lexsort((words.hash, row))
        h, r = words.hash[order], row[order]
        new = np.r_[True, (h[1:] != h[:-1]) | (r[1:] != r[:-1])]
        distinct_words = np.bincount(r[new], minlength=n)
        key, found = np.unique(r * BUCKETS + (h >> np.uint64(52)).astype(np.int64), return_counts=True)
    else:
        key, found = np.zeros(0, np.int64), np.zeros(0, np.int64)
    of, bucket = key // BUCKETS, (key % BUCKETS).astype(np.int32)
    value = 1 + np.log(np.maximum(found, 1))
    value /= np.sqrt(np.maximum(np.bincount(of, value**2, minlength=n), 1e-9))[of]
    first = np.searchsorted(of, np.arange(n + 1))

    kinds = _kinds(words)
    size = np.maximum(kinds.sum(1), 1)
    some = np.maximum(counts, 1)
    again = np.zeros(n)
    closed = np.zeros(n)
    if len(row):
        same = (words.hash[1:] == words.hash[:-1]) & (row[1:] == row[:-1])
        again = np.bincount(row[1:][same], minlength=n)
        ends = _KIND[words.data[words.end - 1]] == 5
        closed = np.bincount(row[ends], minlength=n)
    longest = np.zeros(n)
    np.maximum.at(longest, row, words.end - words.start)
    missing = np.isnan(n_chars)
    statistics = np.column_stack([
        kinds / size[:, None], np.log1p(size), distinct_words / some, again / some, closed / some,
        (kinds.sum(1) - kinds[:, 0] - kinds[:, 1]) / some, np.log1p(longest),
        np.log1p(np.maximum(np.where(missing, 0, n_chars), 0)), missing])
    return first, bucket, value.astype(np.float32), statistics


def _by_text(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of the rows of each text."""
    total = np.zeros((len(first) - 1, *x.shape[1:]))
    full = np.flatnonzero(np.diff(first))
    if len(full):
        total[full] = np.add.reduceat(x, first[full], axis=0)
    return total


def scores(machine: Machine, texts: pa.Array, n_chars: np.ndarray) -> np.ndarray:
    first, bucket, value, statistics = features(texts, n_chars)
    z = (statistics - machine.mean) / machine.scale
    v, w = machine.factor, machine.weight
    sums, squares, linear = z @ v[BUCKETS:], z**2 @ v[BUCKETS:] ** 2, z @ w[BUCKETS:]
    linear += _by_text(value * w[bucket], first)
    for f in range(v.shape[1]):  # a factor at a time: bounded memory
        part = value * v[bucket, f]
        sums[:, f] += _by_text(part, first)
        squares[:, f] += _by_text(part * part, first)
    raw = machine.bias + linear + 0.5 * (sums**2 - squares).sum(1)
    return 1 / (1 + np.exp(-np.clip(raw, -40, 40)))


@dataclass
class Rows:
    """Word values of texts, those of text i from first[i] on."""

    first: np.ndarray
    bucket: np.ndarray
    value: np.ndarray

    def __len__(self) -> int:
        return len(self.first) - 1

    def dense(self, rows: np.ndarray) -> np.ndarray:
        count = np.diff(self.first)[rows]
        at = np.repeat(self.first[rows], count) + ranges(np.r_[0, np.cumsum(count)])
        out = np.zeros((len(rows), BUCKETS), np.float32)
        out[np.repeat(np.arange(len(rows)), count), self.bucket[at]] = self.value[at]
        return out


def train(x: Rows, target: np.ndarray, statistics: np.ndarray, fit: Fit) -> Machine:
    """Adam steps on the logistic loss, with weight decay."""
    mean, scale = statistics.mean(0), statistics.std(0)
    scale = np.where(scale > 1e-9, scale, 1)
    z = ((statistics - mean) / scale).astype(np.float32)
    random = np.random.default_rng(fit.seed)
    share = np.clip(target.mean(), 0.01, 0.99)
    values = [np.array(np.log(share / (1 - share)), np.float32), np.zeros(BUCKETS + STATISTICS, np.float32),
              random.normal(0, 0.02, (BUCKETS + STATISTICS, fit.rank)).astype(np.float32)]
    moments = [(np.zeros_like(v), np.zeros_like(v)) for v in values]
    order = np.concatenate([random.permutation(len(x)) for _ in range(-(-fit.steps * fit.batch // len(x)))])
    for step in range(1, fit.steps + 1):
        rows = order[(step - 1) * fit.batch : step * fit.batch]
        b, t = np.hstack([x.dense(rows), z[rows]]), target[rows]
        bias, w, v = values
        s, b2 = b @ v, b * b
        raw = bias + b @ w + 0.5 * (s**2 - b2 @ v**2).sum(1)
        g = ((1 / (1 + np.exp(-np.clip(raw, -40, 40))) - t) / len(rows)).astype(np.float32)
        slopes = [g.sum(), b.T @ g + fit.decay * w, b.T @ (g[:, None] * s) - v * (b2.T @ g)[:, None] + fit.decay * v]
        for i, slope in enumerate(slopes):
            m, u = moments[i]
            m[...] = 0.9 * m + 0.1 * slope
            u[...] = 0.999 * u + 0.001 * slope * slope
            values[i] = values[i] - np.float32(fit.rate) * (m / (1 - 0.9**step)) / (np.sqrt(u / (1 - 0.999**step)) + 1e-8)
    bias, w, v = values
    return Machine(float(bias), w, v, mean, scale)


def _read(docs: DataFrame) -> DataFrame:
    n_chars = F.col("n_chars").cast("double") if "n_chars" in docs.columns else F.lit(None).cast("double")
    return docs.select("doc_id", "text", n_chars.alias("n_chars"))


def _numbers(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(float)


def fitted(docs: DataFrame, labels: DataFrame, fit: Fit = Fit()) -> Machine:
    """Learns from labelled documents: labels has doc_id and quality."""
    bounded_batches(docs.sparkSession)
    known = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.avg("quality").alias("target"))
    # At most fit.rows ids, bounded by the parameter, and so their texts' features.
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit.rows)
    chosen = docs.sparkSession.createDataFrame(chosen.collect(), known.schema)
    chosen = F.broadcast(chosen.withColumnRenamed("doc_id", "known"))
    rows = _read(docs).join(chosen, F.col("doc_id") == F.col("known")).drop("known")
    # As many rows as ids, whatever repeats.
    rows = rows.groupBy("doc_id").agg(F.max_by(F.struct("text", "n_chars", "target"), F.xxhash64("text", "n_chars")).alias("row")).select("doc_id", "row.*")

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            first, bucket, value, statistics = features(batch.column(1), _numbers(batch.column(2)))
            lists = lambda x, kind: pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(x, kind))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(3), lists(bucket, pa.int32()), lists(value, pa.float32()),
                 pa.array(list(statistics), pa.list_(pa.float64()))], ["doc_id", "target", "bucket", "value", "statistics"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    table = rows.mapInArrow(sparse, f"doc_id {kind}, target double, bucket array<int>, value array<float>, statistics array<double>") \
        .orderBy("doc_id").toArrow()
    if not table.num_rows:
        return Machine(0.0, np.zeros(BUCKETS + STATISTICS), np.zeros((BUCKETS + STATISTICS, fit.rank)), np.zeros(STATISTICS), np.ones(STATISTICS))
    bucket, value = table["bucket"].combine_chunks(), table["value"].combine_chunks()
    x = Rows(bucket.offsets.to_numpy().astype(np.int64), bucket.flatten().to_numpy(), value.flatten().to_numpy())
    statistics = table["statistics"].combine_chunks().flatten().to_numpy().reshape(table.num_rows, STATISTICS)
    return train(x, table["target"].to_numpy(), statistics, fit)


def scored(docs: DataFrame, machine: Machine) -> DataFrame:
    """doc_id, score of every document."""
    bounded_batches(docs.sparkSession)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores(machine, batch.column(1), _numbers(batch.column(2))))], ["doc_id", "score"])

    return _read(docs).mapInArrow(score, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")


def kept(docs: DataFrame, machine: Machine, least: float) -> DataFrame:
    """The documents with a score of at least `least`, whole and with all their columns."""
    bounded_batches(docs.sparkSession)
    read = _read(docs).columns
    rows = docs if "n_chars" in docs.columns else docs.withColumn("n_chars", F.lit(None).cast("double"))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, read[1]):
            by_name = dict(zip(batch.schema.names, batch.columns, strict=True))
            high = scores(machine, by_name[read[1]], _numbers(by_name[read[2]])) >= least
            yield batch.filter(pa.array(high))

    return rows.mapInArrow(keep, rows.schema).select(*docs.columns)
