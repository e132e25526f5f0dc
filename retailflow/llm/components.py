"""Connected components of links: every partition passes on a spanning forest of its links, then star
steps alternate over all of them. Every round is written to the shared folder."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retailflow.llm.common import discard, written


#: Nodes of one task's forest, about.
MOST_NODES = 1_000_000


def _least(edges: DataFrame) -> DataFrame:
    """Adds m, the least node that a is linked to, or a itself."""
    least = edges.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return edges.join(least, "a")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return _least(both).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = _least(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
    lower = down.where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return lower.unionByName(down.select("a", F.col("m").alias("b")))


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while parent.setdefault(top, top) != top:
            top = parent[top]
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    def passed_on() -> Iterator[pa.RecordBatch]:
        rows = [(x, root(x)) for x in list(parent)]
        for at in range(0, len(rows), 100_000):
            some = rows[at : at + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in some], pa.int64()) for i in (0, 1)], ["a", "b"])

    for batch in batches:
        for a, b in zip(batch["a"].to_pylist(), batch["b"].to_pylist(), strict=True):
            low, high = sorted((root(a), root(b)))
            parent[high] = low
        if len(parent) > MOST_NODES:  # the rest of the partition has a forest of its own
            yield from passed_on()
            parent.clear()
    yield from passed_on()


def components(links: DataFrame) -> DataFrame:
    """node, component (its least node) of all nodes that the links (a, b: long) name."""
    edges = written(links.select("a", "b").where("a != b").mapInArrow(_forest, "a long, b long").where("a != b").distinct(), "components")
    before = None
    while before != (before := _state(edges)):
        spent, edges = edges, written(_small_star(_large_star(edges)).where("a != b").distinct(), "components")
        discard(spent)
    roots = edges.select(F.col("b").alias("node")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots.withColumn("component", F.col("node")))
