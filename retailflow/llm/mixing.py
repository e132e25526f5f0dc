"""Mixing sources to target weights, in fixed-length blocks.

Each source's words, its documents laid end to end in a hashed order, are cut into blocks of `block`
words. An output shard is `shard` slots; the sources of its slots are drawn, so that the counts of a
shard are multinomial in the targets. Draws beyond a source's number of slots go to the sources that
were drawn too rarely, which makes the totals exact. Slot j of a source with n blocks takes block
permutation(epoch j div n)(j mod n): every block once before any a second time.

Targets: shares of all words by weight; no source gives more than `most` times its size, the excess
is shared again by weight until none is above. Weights repeat over the sources by code point, null last.

Every draw and permutation is a hash of names and numbers: reruns agree.

Defined cases: null and empty texts have size 0 and are taken 0 times; a source of size 0 has
target 0; null is a source of its own. Repeated rows are documents of their own, each laid down once.
With no words at all nothing is taken. Columns of other names are kept by mixed_documents, not read.
There may be any number of sources: they are a table, which shares meet by ranges; a row for each source passes through one task.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from retailflow.llm.common import discard, renamed, written

#: Prime multipliers of the permutations; one of them does not divide a source's number of blocks.
PRIMES = (33554393, 33554383, 33554371, 33554347, 33554341, 33554317, 33554311, 33554291)
#: Documents of one running sum, and shards of one.
BUCKET, SHARDS = 10_000, 1024
#: Cells that ranges are cut at, at least; four for each range.
CELLS = 1024


def size_of(text: Column) -> Column:
    """Number of words. Each begins where a non-space follows the begin of the text or a space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long"), F.lit(0).cast("long"))


@dataclass(frozen=True)
class Mix:
    weights: Sequence[float] = (5, 2, 1)
    share: float = 1.0
    most: int = 3
    block: int = 64
    shard: int = 4096
    seed: int = 17


@dataclass
class Mixed:
    """documents: doc_id, ident (hash of the text), copy, size, source_no, first (place of its first word in the source).
    sources: source_no, source, source_size, target, blocks, slots. slots: shard, slot, source_no,
    block. parts: _ROW, size, start, words, times: which words of a document are taken how often."""

    documents: DataFrame
    sources: DataFrame
    slots: DataFrame
    parts: DataFrame


def placed(docs: DataFrame, sources: DataFrame) -> DataFrame:
    """Adds `first`: running sums within buckets of a source, and over its buckets. A source of any
    size is spread over tasks; the sums over buckets are BUCKET times fewer rows."""
    numbers = sources.select("source_no", F.col("source").alias("s"), F.greatest(F.lit(1), F.ceil(F.col("source_rows") / BUCKET)).alias("buckets"))
    docs = docs.join(numbers, F.col("source").eqNullSafe(F.col("s"))) \
        .select("doc_id", "ident", "copy", "size", "source_no", F.pmod(F.xxhash64("doc_id", "ident", "copy"), "buckets").alias("bucket"))
    keys = ["source_no", "bucket"]
    upto = (W.unboundedPreceding, -1)
    base = F.sum("bucket_size").over(W.partitionBy("source_no").orderBy("bucket").rowsBetween(*upto))
    sums = docs.groupBy(keys).agg(F.sum("size").alias("bucket_size")).select(*keys, F.coalesce(base, F.lit(0)).alias("base"))
    inside = F.sum("size").over(W.partitionBy(keys).orderBy(F.col("doc_id").asc_nulls_last(), "ident", "copy").rowsBetween(*upto))
    return docs.withColumn("inside", F.coalesce(inside, F.lit(0))).join(sums, keys) \
        .select("doc_id", "ident", "copy", "size", "source_no", (F.col("base") + F.col("inside")).cast("long").alias("first"))


def targets(sources: DataFrame, mix: Mix) -> DataFrame:
    """source_no, source, source_rows, source_size, target, blocks, slots. A target is min(most * size, level * weight); the
    level follows from the sources at their limit, those of least limit by weight. One row per source."""
    order = W.orderBy(F.col("source").asc_nulls_last())
    weights = F.array(*[F.lit(float(w)) for w in mix.weights])
    rows = sources.withColumn("weight", F.get(weights, F.pmod(F.row_number().over(order) - 1, F.lit(len(mix.weights)))))
    rows = rows.withColumn("limit", F.lit(float(mix.most)) * F.col("source_size"))
    by_limit = W.orderBy((F.col("limit") / F.col("weight")), F.col("source").asc_nulls_last())
    all_rows = W.partitionBy(F.lit(1))
    rows = rows.withColumn("total", F.sum("source_size").over(all_rows) * F.lit(float(mix.share)))
    full = F.coalesce(F.sum("limit").over(by_limit.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    open_weight = F.sum("weight").over(by_limit.rowsBetween(0, W.unboundedFollowing))
    rows = rows.withColumn("level", (F.col("total") - full) / open_weight)
    # The first source, in this order, that the level leaves below its limit ends the filling.
    level = F.min(F.when(F.col("level") * F.col("weight") <= F.col("limit"), F.struct("limit_rank", "level"))).over(all_rows)["level"]
    rows = rows.withColumn("limit_rank", F.row_number().over(by_limit))
    rows = rows.withColumn("target", F.least("limit", F.coalesce(level * F.col("weight"), F.col("limit"))))
    blocks = F.ceil(F.col("source_size") / mix.block).cast("long")
    slots = F.when(F.col("source_size") > 0, F.round(F.col("target") * blocks / F.col("source_size"))).otherwise(0).cast("long")
    number = F.row_number().over(order).alias("source_no")
    return rows.select(number, "source", "source_rows", "source_size", "target", blocks.alias("blocks"), slots.alias("slots"))


def permuted(index: Column, n: Column, source: Column, epoch: Column, seed: int) -> Column:
    """A pseudorandom one-to-one map of 0..n-1: two rounds of a step by a multiplier prime to n, and an
    exchange of mirrored places by the hash of the lower one. For n below 2^38."""
    primes = F.array(*[F.lit(p).cast("long") for p in PRIMES])
    x = index
    for turn in range(2):
        prime = F.get(F.filter(primes, lambda p: n % p != 0), F.lit(turn))
        x = F.pmod(x * prime + F.pmod(F.xxhash64(source, epoch, F.lit(seed), F.lit(turn)), n), n)
        mirror = n - 1 - x
        coin = F.xxhash64(F.least(x, mirror), source, epoch, F.lit(seed + 7), F.lit(turn)).bitwiseAND(F.lit(1))
        x = F.when(coin == 1, mirror).otherwise(x)
    return x


def located(rows: DataFrame, at: str, ranges: DataFrame, total: int, number: int) -> DataFrame:
    """Rows with the columns of the range (low to high, without high) that holds their number `at`. The ranges, `number` of
    them, cover 0 to total and are cut at the borders of equal cells, by which both sides meet: a row meets the ranges of its cell."""
    width = max(1, total // max(CELLS, 4 * number))
    cells = F.sequence(F.expr(f"low div {width}"), F.expr(f"(high - 1) div {width}"))
    pieces = ranges.where("high > low").withColumn("cell", F.explode(cells))
    met = rows.withColumn("cell", F.expr(f"{at} div {width}")).join(pieces, "cell")
    return met.where((F.col(at) >= F.col("low")) & (F.col(at) < F.col("high"))).drop("cell")


def _cumulated(values: str) -> Column:
    """Sum over the sources before, in order of their numbers."""
    return F.coalesce(F.sum(values).over(W.orderBy("source_no").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).cast("long")


def _places(counts: DataFrame) -> DataFrame:
    """shard, source_no, before: how many slots of the source earlier shards have. Sums within SHARDS shards, and over these."""
    counts = counts.withColumn("part", F.expr(f"shard div {SHARDS}"))
    upto = (W.unboundedPreceding, -1)
    base = F.sum("m").over(W.partitionBy("source_no").orderBy("part").rowsBetween(*upto))
    parts = counts.groupBy("source_no", "part").agg(F.sum("n").alias("m")).select("source_no", "part", F.coalesce(base, F.lit(0)).alias("base"))
    inside = F.sum("n").over(W.partitionBy("source_no", "part").orderBy("shard").rowsBetween(*upto))
    return counts.withColumn("inside", F.coalesce(inside, F.lit(0))).join(parts, ["source_no", "part"]) \
        .select("shard", "source_no", (F.col("base") + F.col("inside")).alias("before"))


def draw(wanted: DataFrame, mix: Mix) -> DataFrame:
    """shard, slot, source_no, place of every slot of the output: the place-th slot of its source, from
    0 to wanted - 1. wanted: source_no, slots of each source."""
    spark = wanted.sparkSession
    number, total = wanted.agg(F.count(F.lit(1)), F.coalesce(F.sum("slots"), F.lit(0))).first()
    if not total:
        return spark.createDataFrame([], "shard long, slot long, source_no int, place long")
    # The draw: the slot's hash falls into a source's share of all slots.
    edges = wanted.select("source_no", _cumulated("slots").alias("low"), "slots").select("source_no", "low", (F.col("low") + F.col("slots")).alias("high"))
    slots = spark.range(total).select(F.col("id").alias("slot"), F.expr(f"id div {mix.shard}").alias("shard"))
    slots = slots.withColumn("u", F.pmod(F.xxhash64("slot", F.lit(mix.seed)), F.lit(total)))
    drawn = written(located(slots, "u", edges, total, number).select("shard", "slot", "source_no"), "mix-drawn")
    # Counts by shard and source; the slots of a source are numbered through all shards.
    counts = written(drawn.groupBy("shard", "source_no").agg(F.count(F.lit(1)).alias("n")), "mix-counts")
    order = F.row_number().over(W.partitionBy("shard", "source_no").orderBy("slot")) - 1
    numbered = drawn.withColumn("number", order).join(_places(counts), ["shard", "source_no"]) \
        .select("shard", "slot", "source_no", (F.col("before") + F.col("number")).cast("long").alias("place"))
    numbered = written(numbered, "mix-numbered")  # read twice below
    discard(drawn)
    # Draws beyond a source's slots are given, in order, to the places that no draw has filled.
    found = counts.groupBy("source_no").agg(F.sum("n").alias("found"))
    balance = wanted.select("source_no", "slots").join(found, "source_no", "left").withColumn("found", F.coalesce("found", F.lit(0)))
    balance = balance.withColumns({"over": F.greatest(F.col("found") - F.col("slots"), F.lit(0)), "under": F.greatest(F.col("slots") - F.col("found"), F.lit(0))})
    balance = written(balance.withColumns({"skipped": _cumulated("over"), "begins": _cumulated("under")}), "mix-balance")
    spare = balance.agg(F.sum("over")).first()[0]
    drawn = numbered.join(balance.select("source_no", "slots", "skipped"), "source_no")
    kept = drawn.where(F.col("place") < F.col("slots")).select("shard", "slot", "source_no", "place")
    if not spare:
        return kept
    free = drawn.where(F.col("place") >= F.col("slots")).select("shard", "slot", (F.col("place") - F.col("slots") + F.col("skipped")).alias("spare"))
    gaps = balance.select("source_no", "found", F.col("begins").alias("low"), (F.col("begins") + F.col("under")).alias("high"))
    moved = located(free, "spare", gaps, spare, number)
    return kept.unionByName(moved.select("shard", "slot", "source_no", (F.col("found") + F.col("spare") - F.col("low")).alias("place")))


def mixed(docs: DataFrame, mix: Mix = Mix()) -> Mixed:
    text = F.col("text")
    docs = renamed(docs, ["doc_id", "source", "text"]).select("doc_id", "source", F.xxhash64(text).alias("ident"), size_of(text).alias("size"))
    docs = docs.groupBy("doc_id", "source", "ident", "size").agg(F.count(F.lit(1)).alias("copies"))
    docs = written(docs.select("doc_id", "source", "ident", "size", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")), "mix-sizes")
    by_source = docs.groupBy("source").agg(F.count(F.lit(1)).alias("source_rows"), F.sum("size").alias("source_size"))
    sources = written(targets(by_source, mix), "mix-sources")
    docs = written(placed(docs, sources), "mix-placed")

    slots = draw(sources.select("source_no", "slots"), mix).join(sources.select("source_no", "blocks"), "source_no")
    block = permuted(F.expr("place % blocks"), F.col("blocks"), F.col("source_no"), F.expr("place div blocks"), mix.seed)
    slots = slots.select("shard", "slot", "source_no", block.alias("block"))
    times = slots.groupBy("source_no", "block").agg(F.count(F.lit(1)).alias("times"))

    # A document meets the blocks that it reaches into.
    reached = F.sequence(F.expr(f"first div {mix.block}"), F.expr(f"(first + size - 1) div {mix.block}"))
    spans = docs.where("size > 0").select("*", F.explode(reached).alias("block"))
    start = F.greatest(F.col("first"), F.col("block") * mix.block) - F.col("first")
    end = F.least(F.col("first") + F.col("size"), (F.col("block") + 1) * mix.block) - F.col("first")
    parts = spans.withColumn("start", start).withColumn("words", end - start).join(times, ["source_no", "block"])
    return Mixed(docs, sources, slots, parts.select(*_ROW, "size", "start", "words", "times"))


#: What tells the rows of `documents` apart.
_ROW = ["doc_id", "ident", "copy", "source_no"]


def _joined(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    right = right.select(*[F.col(k).alias(f"_{k}") if k in keys else F.col(k) for k in right.columns])
    same = [left[k].eqNullSafe(right[f"_{k}"]) for k in keys]
    return left.join(right, same, how).drop(*[f"_{k}" for k in keys])


def taken(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """doc_id, size, source_size, target, taken: a row per document."""
    got = mixed(docs, mix)
    words = got.parts.groupBy(_ROW).agg(F.sum(F.col("words") * F.col("times")).alias("taken"))
    rows = _joined(got.documents, words, _ROW, "left").join(got.sources.select("source_no", "source_size", "target"), "source_no")
    return rows.select("doc_id", "size", F.col("source_size").cast("long").alias("source_size"), "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """The words that the mix takes, as documents with the columns of `docs`: a row per document and
    pass, with the words that are taken at least that many times. A text taken whole is as it was;
    parts of a text are joined by single spaces. n_chars, where there is one, is that of the new text."""
    got = mixed(docs, mix)
    part = F.struct("start", "words", "times")
    plan = got.parts.groupBy(*_ROW, "size").agg(F.array_sort(F.collect_list(part)).alias("parts"), F.max("times").alias("passes"))
    # Rows of equal id, source and text share a plan row, which has what each of them gives.
    key = [k for k in _ROW if k != "copy"]
    number = got.documents.groupBy(*key).agg(F.max("copy").alias("copies"))
    plan = plan.groupBy(*key, "size").agg(F.collect_list(F.struct("copy", "parts", "passes")).alias("plans"))
    plan = _joined(plan, number, key, "inner").join(got.sources.select("source_no", F.col("source").alias("s")), "source_no")
    # A table of its own: what follows reads it twice, and the driver would plan all that leads to it for each.
    plan = written(plan.select("doc_id", "ident", "s", F.col("size").alias("words_in"), "plans", "copies"), "mix-plan")
    others = [c for c in docs.columns if c != "text"]
    rows = docs.select(F.struct(*others).alias("row"), "doc_id", "text", F.xxhash64("text").alias("ident"), F.col("source").alias("s"))
    rows = _joined(rows, plan, ["doc_id", "ident", "s"], "inner")
    alone = rows.where("copies = 1").withColumn("copy", F.lit(1))
    order = W.partitionBy("doc_id", "ident", "s").orderBy(F.xxhash64("row"))
    rows = alone.unionByName(rows.where("copies > 1").withColumn("copy", F.row_number().over(order)))
    rows = rows.withColumn("plan", F.get(F.filter("plans", lambda p: p["copy"] == F.col("copy")), F.lit(0)))
    rows = rows.where("plan IS NOT NULL").select("row", "text", F.col("words_in").alias("size"), "plan.parts", "plan.passes")
    rows = rows.withColumn("turn", F.explode(F.sequence(F.lit(1), F.col("passes").cast("int"))))
    rows = rows.withColumn("taken", F.filter("parts", lambda p: p["times"] >= F.col("turn")))
    length = F.aggregate("taken", F.lit(0).cast("long"), lambda n, p: n + p["words"])
    rows = rows.withColumn("whole", length == F.col("size"))
    words = F.when(~F.col("whole"), F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    rows = rows.withColumn("words", words)
    cut = F.flatten(F.transform("taken", lambda p: F.slice(F.col("words"), (p["start"] + 1).cast("int"), p["words"].cast("int"))))
    rows = rows.withColumn("text", F.when(F.col("whole"), F.col("text")).otherwise(F.array_join(cut, " ")))
    new = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return rows.select(*[new.get(c, F.col("row")[c]).alias(c) for c in docs.columns])
