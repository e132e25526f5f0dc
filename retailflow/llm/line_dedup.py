"""Lines that many documents share, dropped from all of them; documents may come and go.

A line's key is the line without white space at both ends, A-Z lower-cased. An index keeps, for all
documents inserted and not deleted, the exact number of documents that hold each key (by the key's
128-bit hash), and the documents themselves as (hash, copies). Over the keys that enough documents
hold it keeps cuckoo filters, one for each shard of the keys. Inserting or deleting documents adds
their keys' counts or takes them back, and moves into or out of the filters only the keys that so cross
the threshold; a filter that has no room is built again from the exact table. Every step writes
new tables, so an index is a value: what was is still there, and a step that is run again gives the same.

Judging documents: their distinct keys meet the filter of their shard; what passes is looked up in the exact
table, which removes false positives. Where the keys to drop are few (KEYS_IN_TASKS, counted) they
go to the tasks that read the texts; otherwise documents and keys are joined, and texts are shuffled once.

Defined cases: null and empty texts are one empty line. Keys shorter than `shortest` code points are
never dropped. Every row is a document, also repeated ones and those with null ids. Deleting more copies of a
document than the index holds deletes those it holds; a document is known by id and text. Empty tables
give no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from retailflow.llm.common import SPACES, bounded_batches, renamed, written
from retailflow.llm.cuckoo import Cuckoo, Full, built

KEYS_A_SHARD = 1 << 16
#: Keys to drop that tasks hold, 16 bytes each.
KEYS_IN_TASKS = 1 << 18
_KEY = ["h1", "h2"]


@dataclass(frozen=True)
class Rule:
    least: int = 10  # documents that hold a key
    shortest: int = 1  # code points of a key


@dataclass
class Lines:
    """lines: of all texts; first: where each text's begin, with one entry more; code: each line's key as a
    place in hashes; long: whether that key is long enough to be dropped."""

    lines: pa.Array
    first: np.ndarray
    code: np.ndarray
    hashes: np.ndarray
    long: np.ndarray

    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def split(texts: pa.Array, rule: Rule) -> Lines:
    lists = pc.split_pattern(texts.fill_null(""), "\n")
    lines = lists.flatten()
    keys = pc.ascii_lower(pc.ascii_trim(lines, characters=SPACES)).dictionary_encode()
    known = keys.dictionary
    hashes = b"".join(blake2b(k, digest_size=16).digest() for k in known.cast(pa.binary()).to_pylist())
    first = np.r_[0, np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]
    return Lines(lines, first, keys.indices.to_numpy(), np.frombuffer(hashes, np.int64).reshape(-1, 2),
                 pc.utf8_length(known).to_numpy(zero_copy_only=False) >= rule.shortest)


def _ident() -> list[Column]:
    """128 bits that tell documents apart."""
    row = [F.col("doc_id").isNull(), "doc_id", F.col("text").isNull(), "text"]
    return [F.xxhash64(*row).alias("i1"), F.xxhash64(F.lit(1), *row).alias("i2")]


def keys_of(docs: DataFrame, rule: Rule, weight: str | None = None) -> DataFrame:
    """h1, h2, documents: how many rows (times their weight) hold each key."""
    bounded_batches(docs.sparkSession)
    rows = docs.select("text", (F.col(weight) if weight else F.lit(1)).cast("long").alias("weight"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = split(batch.column(0), rule)
            held = np.unique(found.row() * len(found.hashes) + found.code)  # a key once for each document
            row, code = held // max(1, len(found.hashes)), held % max(1, len(found.hashes))
            times = np.zeros(len(found.hashes), np.int64)
            np.add.at(times, code, batch.column(1).to_numpy()[row])
            times[~found.long] = 0
            some = np.flatnonzero(times)
            yield pa.RecordBatch.from_arrays([pa.array(found.hashes[some, 0]), pa.array(found.hashes[some, 1]), pa.array(times[some])], [*_KEY, "documents"])

    found = rows.mapInArrow(count, "h1 long, h2 long, documents long")
    return found.groupBy(*_KEY).agg(F.sum("documents").alias("documents"))


@dataclass(frozen=True)
class LineIndex:
    """counts: h1, h2, documents, before (this index). present: i1, i2, copies. filters: shard, bits."""

    rule: Rule
    counts: DataFrame
    present: DataFrame
    filters: DataFrame
    shards: int = 1

    @classmethod
    def empty(cls, spark: SparkSession, rule: Rule = Rule()) -> LineIndex:
        none = lambda schema: spark.createDataFrame([], schema)
        return cls(rule, none("h1 long, h2 long, documents long"), none("i1 long, i2 long, copies long"), none("shard int, bits binary"))

    def inserted(self, docs: DataFrame) -> LineIndex:
        """The index with these documents as well (doc_id, text)."""
        docs = renamed(docs, ["doc_id", "text"])
        more = docs.select(*_ident()).groupBy("i1", "i2").agg(F.count(F.lit(1)).alias("copies"))
        return self._changed(keys_of(docs, self.rule), more)

    def deleted(self, docs: DataFrame) -> LineIndex:
        """The index without these documents."""
        docs = renamed(docs, ["doc_id", "text"]).select("text", *_ident())
        asked = docs.groupBy("i1", "i2").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("asked"))
        held = asked.join(self.present, ["i1", "i2"]).withColumn("fewer", F.least("asked", "copies"))
        held = written(held.select("i1", "i2", "text", "fewer"), "lines-deleted")
        keys = keys_of(held, self.rule, "fewer").withColumn("documents", -F.col("documents"))
        return self._changed(keys, held.select("i1", "i2", (-F.col("fewer")).alias("copies")))

    def _changed(self, keys: DataFrame, rows: DataFrame) -> LineIndex:
        both = self.counts.select(*_KEY, "documents", F.col("documents").alias("before")) \
            .unionByName(keys.withColumn("before", F.lit(0).cast("long")))
        counts = both.groupBy(*_KEY).agg(F.sum("documents").alias("documents"), F.sum("before").alias("before"))
        counts = written(counts, "lines-counts")
        present = self.present.unionByName(rows).groupBy("i1", "i2").agg(F.sum("copies").alias("copies")).where("copies > 0")
        shards = self.shards
        total = counts.count()
        while shards * KEYS_A_SHARD < total:
            shards *= 2
        new = replace(self, counts=counts.where("documents > 0").select(*_KEY, "documents"), present=written(present, "lines-present"), shards=shards)
        if shards != self.shards or self.filters.isEmpty():
            return replace(new, filters=written(new._filters(new._hot()), "lines-filters"))
        least = self.rule.least
        crossed = counts.where((F.col("documents") >= least) != (F.col("before") >= least)) \
            .select(self._shard(), *_KEY, (F.col("documents") >= least).alias("enters"))
        changed = self.filters.groupBy("shard").cogroup(crossed.groupBy("shard")).applyInArrow(_updated, "shard int, bits binary")
        changed = written(changed, "lines-filters")
        full = changed.where("bits IS NULL").select("shard")
        if not full.isEmpty():
            again = new._filters(new._hot().join(full, "shard", "left_semi"))
            changed = written(changed.where("bits IS NOT NULL").unionByName(again), "lines-filters")
        return replace(new, filters=changed)

    def _shard(self) -> Column:
        return F.pmod(F.xxhash64(*_KEY), F.lit(self.shards)).cast("int").alias("shard")

    def _hot(self) -> DataFrame:
        return self.counts.where(F.col("documents") >= self.rule.least).select(self._shard(), *_KEY)

    def _filters(self, hot: DataFrame) -> DataFrame:
        def build(key: tuple, group: pa.Table) -> pa.Table:
            return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "bits": pa.array([built(_pairs(group)).bits()], pa.binary())})

        return hot.groupBy("shard").applyInArrow(build, "shard int, bits binary")

    def dropped(self, keys: DataFrame) -> DataFrame:
        """h1, h2: those of the keys, distinct, that enough documents hold."""
        rows = self.filters.select("shard", "bits", F.lit(None).cast("long").alias("h1"), F.lit(None).cast("long").alias("h2")) \
            .unionByName(keys.select(self._shard(), F.lit(None).cast("binary").alias("bits"), *_KEY))
        rows = rows.repartition("shard").sortWithinPartitions("shard", F.col("bits").isNull())

        def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            shard, filter_ = -1, None
            for batch in batches:
                of = batch["shard"].to_numpy()
                heads = np.flatnonzero(np.r_[True, of[1:] != of[:-1]]) if len(of) else []
                for at, end in zip(heads, [*heads[1:], len(of)], strict=True):
                    part = batch.slice(at, end - at)
                    if of[at] != shard:
                        shard, filter_ = of[at], None
                    if part["bits"].null_count < len(part):  # comes first
                        filter_, part = Cuckoo(part["bits"][0].as_py()), part.slice(1)
                    if filter_ is not None and len(part):
                        yield part.select(_KEY).filter(pa.array(filter_.has(_pairs(part))))

        possible = written(rows.mapInArrow(probe, "h1 long, h2 long"), "lines-possible")
        return self.counts.where(F.col("documents") >= self.rule.least).join(possible, _KEY, "left_semi").select(*_KEY)


def _pairs(table: pa.Table | pa.RecordBatch) -> np.ndarray:
    return np.column_stack([table[k].to_numpy() for k in _KEY]).astype(np.int64)


def _updated(filters: pa.Table, crossed: pa.Table) -> pa.Table:
    """A shard's filter after its keys have crossed the threshold; no bits where it has no room for them."""
    shard = (filters if filters.num_rows else crossed)["shard"][0].as_py()
    keys, enters = _pairs(crossed), crossed["enters"].to_numpy(zero_copy_only=False).astype(bool)
    if filters.num_rows:
        filter_ = Cuckoo(filters["bits"][0].as_py())
        filter_.delete(keys[~enters])
        try:
            filter_.insert(keys[enters])
            bits = filter_.bits()
        except Full:
            bits = None
    else:
        bits = built(keys[enters]).bits()
    return pa.table({"shard": pa.array([shard], pa.int32()), "bits": pa.array([bits], pa.binary())})


def _kept(texts: pa.Array, found: Lines, drop: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Texts without the lines to drop, number of lines, number of those dropped."""
    n = np.diff(found.first)
    kept = np.add.reduceat(np.r_[~drop, False].astype(np.int64), found.first[:-1]) if len(n) else n
    first = np.r_[0, np.cumsum(kept)]
    lists = pa.ListArray.from_arrays(pa.array(first, pa.int32()), found.lines.filter(pa.array(~drop)))
    return pc.binary_join(lists, "\n"), n, n - kept


class Keys:
    """A set of keys (rows of two longs) in order."""

    def __init__(self, keys: np.ndarray):
        order = np.lexsort((keys[:, 1], keys[:, 0]))
        self.h1, self.h2 = np.ascontiguousarray(keys[order].T)
        heads = np.flatnonzero(np.r_[True, self.h1[1:] != self.h1[:-1]]) if len(order) else np.zeros(0, np.int64)
        self.run = int(np.diff(np.r_[heads, len(order)]).max(initial=0))

    def has(self, hashes: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.h1, hashes[:, 0])
        found = np.zeros(len(hashes), bool)
        for _ in range(self.run):  # one, but for keys that share half their hash
            near = np.minimum(at, len(self.h1) - 1)
            found |= (self.h1[near] == hashes[:, 0]) & (self.h2[near] == hashes[:, 1])
            at = at + 1
        return found


_JUDGED = ["doc_id", "kept_text", "n_lines", "n_dropped"]


def judged(docs: DataFrame, index: LineIndex, keys: DataFrame | None = None, keys_in_tasks: int = KEYS_IN_TASKS) -> DataFrame:
    """doc_id, kept_text, n_lines, n_dropped of every document. keys: h1, h2 of all keys of the documents (more
    do no harm), where they are at hand."""
    bounded_batches(docs.sparkSession)
    rule = index.rule
    docs = renamed(docs, ["doc_id", "text"])
    kind = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, kept_text string, n_lines long, n_dropped long"
    drop = written(index.dropped(keys_of(docs, rule) if keys is None else keys), "lines-dropped")

    def rows(ids: pa.Array, texts: pa.Array, dropping) -> pa.RecordBatch:
        found = split(texts, rule)
        kept, n, fewer = _kept(texts, found, dropping(found))
        return pa.RecordBatch.from_arrays([ids, kept, pa.array(n), pa.array(fewer)], _JUDGED)

    if drop.count() <= keys_in_tasks:
        sent = docs.sparkSession.sparkContext.broadcast(_pairs(drop.toArrow()).tobytes())

        def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            keys = Keys(np.frombuffer(sent.value, np.int64).reshape(-1, 2))
            for batch in batches:
                yield rows(batch.column(0), batch.column(1), lambda f: keys.has(f.hashes)[f.code])

        return docs.mapInArrow(within, kind)

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = split(batch["text"], rule)
            held = np.unique(found.row() * len(found.hashes) + found.code)
            row, code = held // max(1, len(found.hashes)), held % max(1, len(found.hashes))
            row, code = row[found.long[code]], code[found.long[code]]
            yield pa.RecordBatch.from_arrays([batch[c].take(pa.array(row)) for c in ("i1", "i2")] + [pa.array(found.hashes[code, i]) for i in (0, 1)], ["i1", "i2", *_KEY])

    docs = docs.select("*", *_ident())
    hits = docs.select("text", "i1", "i2").mapInArrow(lines, "i1 long, i2 long, h1 long, h2 long").join(drop, _KEY)
    hits = hits.groupBy("i1", "i2").agg(F.collect_set(F.struct(*_KEY)).alias("keys"))
    joined = docs.join(hits, ["i1", "i2"], "left").select("doc_id", "text", "keys.h1", "keys.h2")

    def apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            def dropping(found: Lines) -> np.ndarray:
                out = np.zeros(len(found.code), bool)
                for i in np.flatnonzero(batch["h1"].is_valid().to_numpy(zero_copy_only=False)).tolist():
                    own = np.column_stack([np.array(batch[k][i].as_py(), np.int64) for k in _KEY])
                    some = slice(found.first[i], found.first[i + 1])
                    out[some] = Keys(own).has(found.hashes[found.code[some]])
                return out

            yield rows(batch.column(0), batch.column(1), dropping)

    return joined.mapInArrow(apart, kind)


def digests(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of every document, judged by all of them."""
    index = LineIndex.empty(docs.sparkSession, rule).inserted(docs)
    rows = judged(docs, index, index.counts)
    return rows.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))
