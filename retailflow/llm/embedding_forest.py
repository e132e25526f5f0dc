"""Near-duplicate vectors by a forest of random-projection trees.

Vectors are compared only within a label (and length). Each tree splits the vectors of a label at the median
of their projection on a random direction, with an overlap: those near the median go to both sides.
Splitting ends at leaves of `leaf` vectors. Trees are begun on a bounded sample (`sample` vectors of
least hash over all labels, and at most SAMPLE_BYTES); every vector is then sent down every tree. Leaves that turn out larger
than `most` are split further, each by a tree on a sample of its own (LEAF_SAMPLE vectors), as often as it takes; so leaves are
of bounded size whatever the number of vectors and labels. Vectors are compared exactly, in double precision, within leaves; a leaf
that no direction splits is compared in blocks, pair of blocks by pair of blocks. A pair that several leaves hold counts in the first of them.

Equal vectors are one node with a number of copies, so groups of copies of any size are compared once.
Links count without being written out; each leaf passes on a root per vector for the components.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components link with nothing, nor
do vectors without label; their component is their own id. Null ids take part, and name no component unless all of it is
null. Repeated rows are copies that link with one another. Empty tables give no rows. Other columns are not read.

Pairs are found with a probability that rises with the number of trees; none is reported below `least`.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retailflow.llm.common import bounded_batches, discard, renamed, written
from retailflow.llm.components import components
from retailflow.llm.words import pair

SAMPLE_BYTES = 32 << 20
#: Vectors that a large leaf is split by, and rows of one task of its routing.
LEAF_SAMPLE, LEAF_ROWS = 4000, 100_000


@dataclass(frozen=True)
class Forest:
    least: float = 0.93
    trees: int = 12
    overlap: float = 0.08  # share of a node's vectors beyond the median that go to both sides
    leaf: int = 400
    most: int = 2000
    sample: int = 20_000
    seed: int = 3


@dataclass
class Split:
    """Vectors up to `high` go left, from `low` on right. A leaf is a number."""

    direction: np.ndarray
    low: float
    high: float
    left: Split | int
    right: Split | int


def grow(vectors: np.ndarray, weight: float, forest: Forest, random: np.random.Generator, leaves: list[int]) -> Split | int:
    """A tree over unit vectors, each of which stands for `weight` vectors. leaves: counts those made."""
    if len(vectors) * weight > forest.leaf and len(vectors) >= 32:
        direction = random.normal(size=vectors.shape[1])
        at = vectors @ (direction / np.linalg.norm(direction))
        low, high = np.quantile(at, (0.5 - forest.overlap, 0.5 + forest.overlap))
        left, right = at <= high, at >= low
        if max(left.sum(), right.sum()) < len(vectors):
            sides = (grow(vectors[s], weight, forest, random, leaves) for s in (left, right))
            return Split(direction / np.linalg.norm(direction), low, high, *sides)
    leaves[0] += 1
    return leaves[0] - 1


def visited(tree: Split | int, vectors: np.ndarray, rows: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Leaves and the rows that reach each."""
    if not len(rows):
        return
    if isinstance(tree, int):
        yield tree, rows
        return
    at = vectors[rows] @ tree.direction
    yield from visited(tree.left, vectors, rows[at <= tree.high])
    yield from visited(tree.right, vectors, rows[at >= tree.low])


def _plain(tree: Split | int) -> tuple | int:
    """A tree as tuples, which travel without their class."""
    return tree if isinstance(tree, int) else (tree.direction, tree.low, tree.high, _plain(tree.left), _plain(tree.right))


def _tree(plain: tuple | int) -> Split | int:
    return plain if isinstance(plain, int) else Split(*plain[:3], _tree(plain[3]), _tree(plain[4]))


def unit(vectors: np.ndarray) -> np.ndarray:
    vectors = vectors.astype(float)
    vectors /= np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def matrix(lists: pa.ListArray, rows: np.ndarray) -> np.ndarray:
    """The rows' vectors, all of one length."""
    some = lists.take(pa.array(rows))
    return some.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1)


def groups(labels: pa.Array, lists: pa.ListArray) -> Iterator[tuple[tuple, np.ndarray]]:
    """Rows by label and vector length."""
    by: dict[tuple, list[int]] = {}
    for row, key in enumerate(zip(labels.to_pylist(), lists.value_lengths().to_pylist(), strict=True)):
        by.setdefault(key, []).append(row)
    for key, rows in by.items():
        yield key, np.array(rows)


def usable(embedding: Column, label: Column) -> Column:
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(label.isNotNull() & (F.size(embedding) > 0) & ~bad & F.exists(embedding, lambda x: x != 0), F.lit(False))


def fitted(nodes: DataFrame, forest: Forest) -> dict[tuple, list[Split | int]]:
    """The trees of each label and length that the sample holds. Others are one leaf."""
    size = nodes.agg(F.count(F.lit(1)), F.max(F.size("embedding"))).first()
    if not size[0]:
        return {}
    bound = min(forest.sample, max(1, SAMPLE_BYTES // (8 * size[1])))
    sample = nodes.orderBy("node").select("label", "embedding").limit(bound).toArrow().combine_chunks()
    labels, lists = (sample[c].combine_chunks() for c in ("label", "embedding"))
    out = {}
    for number, (key, rows) in enumerate(groups(labels, lists)):
        vectors, random = unit(matrix(lists, rows)), np.random.default_rng([forest.seed, number])
        out[key] = [grow(vectors, size[0] / sample.num_rows, forest, random, [0]) for _ in range(forest.trees)]
    return out


_LEAF = ["label", "length", "leaf"]


def regrown(routed: DataFrame, forest: Forest) -> DataFrame:
    """Rows (node, label, copies, embedding, length, leaf, leaves) with leaves of at most `most` rows, as far as directions split them."""
    before, turn = None, 0
    while True:
        sizes = routed.groupBy(*_LEAF).agg(F.count(F.lit(1)).alias("rows"))
        large = written(sizes.where(F.col("rows") > forest.most), "forest-large")
        state = tuple(large.agg(F.count(F.lit(1)), F.sum("rows")).first())
        if not state[0] or state == before:
            break
        spent, routed = routed, written(_split_further(routed, large, forest, turn), "forest-leaves")
        discard(spent)
        before, turn = state, turn + 1
    if not turn:
        return routed
    every = routed.groupBy(F.col("node").alias("of")).agg(F.sort_array(F.collect_list("leaf")).alias("leaves"))
    return written(routed.drop("leaves").join(every, F.col("node") == F.col("of")).drop("of"), "forest-leaves")


def _split_further(routed: DataFrame, large: DataFrame, forest: Forest, turn: int) -> DataFrame:
    rows = routed.join(large, _LEAF)
    kinds = {c: routed.schema[c].dataType.simpleString() for c in ("label", "embedding")}
    chosen = rows.where(F.pmod(F.xxhash64("node", F.lit(turn)), "rows") < LEAF_SAMPLE).select(*_LEAF, "embedding", "rows")

    def fit(key: tuple, sample: pa.Table) -> pa.Table:
        vectors = unit(matrix(sample["embedding"].combine_chunks(), np.arange(sample.num_rows)))
        random = np.random.default_rng([forest.seed, turn, key[2].as_py() % (1 << 63)])
        tree = grow(vectors, sample["rows"][0].as_py() / sample.num_rows, forest, random, [0])
        return pa.table({"label": sample["label"].slice(0, 1), "length": sample["length"].slice(0, 1), "leaf": sample["leaf"].slice(0, 1),
                         "tree": pa.array([pickle.dumps(_plain(tree))], pa.binary())})

    trees = written(chosen.groupBy(*_LEAF).applyInArrow(fit, f"label {kinds['label']}, length int, leaf long, tree binary"), "forest-trees")
    parts = F.ceil(F.col("rows") / LEAF_ROWS).cast("int")
    given = trees.join(large, _LEAF).select(*_LEAF, F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), "tree")
    dealt = rows.select(*_LEAF, F.pmod(F.xxhash64("node"), parts).cast("int").alias("part"), "node", "copies", "embedding")
    dealt = given.unionByName(dealt, allowMissingColumns=True).repartition(*_LEAF, "part").sortWithinPartitions(*_LEAF, "part", F.col("tree").isNull())

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree: Split | int = 0
        for batch in batches:
            given = np.flatnonzero(batch["tree"].is_valid().to_numpy(zero_copy_only=False)).tolist()  # ahead of their rows
            for at, end in zip([-1, *given], [*given, len(batch)], strict=True):
                if at >= 0:
                    tree = _tree(pickle.loads(batch["tree"][at].as_py()))
                part = batch.slice(at + 1, end - at - 1)
                if not len(part):
                    continue
                found = list(visited(tree, unit(matrix(part["embedding"], np.arange(len(part)))), np.arange(len(part))))
                leaf = np.repeat(np.array([f[0] for f in found], np.uint64), [len(f[1]) for f in found])
                pick = np.concatenate([f[1] for f in found])
                old = part["leaf"].to_numpy().view(np.uint64)[pick]
                new = pair(old, leaf + (np.uint64(turn) << np.uint64(32))).view(np.int64)
                for some in range(0, len(pick), 20_000):
                    cut = slice(some, some + 20_000)
                    taken = part.take(pa.array(pick[cut]))
                    yield pa.RecordBatch.from_arrays([taken["node"], taken["label"], taken["copies"], taken["embedding"], taken["length"], pa.array(new[cut])],
                                                     ["node", "label", "copies", "embedding", "length", "leaf"])

    schema = f"node long, label {kinds['label']}, copies long, embedding {kinds['embedding']}, length int, leaf long"
    again = dealt.select("node", "label", "copies", "embedding", "length", "leaf", "tree").mapInArrow(route, schema)
    small = routed.join(large.select(*_LEAF), _LEAF, "left_anti")
    return small.unionByName(again.withColumn("leaves", F.array().cast("array<long>")))


def _least_reachable(linked: np.ndarray) -> np.ndarray:
    """The least row that links lead to, for each row."""
    root = np.arange(len(linked))
    while True:
        low = np.where(linked, root, len(root)).min(axis=1, initial=len(root))
        new = np.minimum(root, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _compared(table: pa.Table, least: float, leaf: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of each row that count in this leaf, and each row's root. Rows of two blocks are compared across."""
    vectors = unit(matrix(table["embedding"].combine_chunks(), np.arange(table.num_rows)))
    block = table["block"].to_numpy()
    near = vectors @ vectors.T >= least
    np.fill_diagonal(near, False)
    if (block != block[0]).any():
        near &= block[:, None] != block[None, :]
    some = near.any(axis=1)
    lists = table["leaves"].combine_chunks()
    row = np.repeat(np.arange(table.num_rows), lists.value_lengths().to_numpy())
    value = lists.flatten().to_numpy()
    earlier = (value < leaf) & some[row]
    names, place = np.unique(value[earlier], return_inverse=True)
    shared = np.zeros((table.num_rows, len(names)), np.float32)
    shared[row[earlier], place] = 1
    counts = (near & (shared @ shared.T == 0)) @ table["copies"].to_numpy()
    return counts, _least_reachable(near)


def _numbered(rows: DataFrame) -> DataFrame:
    """Adds node: a hash of label and vector that no two unlike ones share, null where the vector is of no use. Vectors that share
    the first hash, of which there are next to none, take another."""
    hashes = rows.withColumn("node", F.when(F.col("usable"), F.xxhash64("label", "embedding")))
    other = F.xxhash64(F.lit(1), "label", "embedding")
    bounds = hashes.where("usable").groupBy(F.col("node").alias("shared")).agg(F.min(other).alias("low"), F.max(other).alias("high"))
    shared = written(bounds.where("low != high").select("shared"), "forest-shared")
    if shared.isEmpty():
        return hashes
    return hashes.join(shared, F.col("node") == F.col("shared"), "left") \
        .withColumn("node", F.when(F.col("shared").isNull(), F.col("node")).otherwise(other)).drop("shared")


def linked(vectors: DataFrame, forest: Forest = Forest()) -> DataFrame:
    """vec_id, n_links, component_id, kept of every vector."""
    bounded_batches(vectors.sparkSession)
    rows = renamed(vectors, ["vec_id", "embedding", "label"])
    rows = _numbered(rows.withColumn("usable", usable(F.col("embedding"), F.col("label")))).drop("usable")
    usable_rows = rows.where("node IS NOT NULL")
    nodes = written(usable_rows.groupBy("node").agg(F.first("label").alias("label"), F.first("embedding").alias("embedding"),
                                                    F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("copies")), "forest-nodes")
    trees = fitted(nodes, forest)
    stride = 1 << 20  # more leaves than a tree has
    kinds = {c: nodes.schema[c].dataType.simpleString() for c in ("label", "embedding")}

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch["embedding"]
            for (label, length), own in groups(batch["label"], lists):
                x, forest_ = unit(matrix(lists, own)), trees.get((label, length), [0])
                found = [(t * stride + leaf, np.sort(at)) for t, tree in enumerate(forest_) for leaf, at in visited(tree, x, np.arange(len(own)))]
                leaf = np.repeat([f[0] for f in found], [len(f[1]) for f in found])
                at = np.concatenate([f[1] for f in found])
                order = np.lexsort((leaf, at))
                every = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(np.bincount(at, minlength=len(own)))], pa.int32()), pa.array(leaf[order], pa.int64()))
                for part in range(0, len(at), 20_000):
                    some = slice(part, part + 20_000)
                    pick = pa.array(own[at[some]])
                    yield pa.RecordBatch.from_arrays(
                        [batch["node"].take(pick), batch["label"].take(pick), batch["copies"].take(pick), lists.take(pick),
                         pa.array(leaf[some], pa.int64()), every.take(pa.array(at[some]))], ["node", "label", "copies", "embedding", "leaf", "leaves"])

    def compare(key: tuple, table: pa.Table) -> pa.Table:
        counts, root = _compared(table, forest.least, key[2].as_py())
        node = table["node"].to_numpy()
        some = np.flatnonzero((counts > 0) | (root != np.arange(len(root))))
        return pa.table({"node": pa.array(node[some]), "links": pa.array(counts[some].astype(np.int64)), "root": pa.array(node[root[some]])})

    routed = nodes.select("node", "label", "copies", "embedding").mapInArrow(
        route, f"node long, label {kinds['label']}, copies long, embedding {kinds['embedding']}, leaf long, leaves array<long>")
    routed = regrown(written(routed.select("*", F.size("embedding").alias("length")), "forest-leaves"), forest)
    sizes = routed.groupBy("label", "length", "leaf").agg(F.count(F.lit(1)).alias("rows"))
    large = sizes.where(F.col("rows") > forest.most).withColumn("blocks", F.ceil(F.col("rows") / forest.most).cast("int")).drop("rows")
    routed = routed.join(large, ["label", "length", "leaf"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    routed = routed.withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    routed = routed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    routed = routed.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
    found = written(routed.groupBy("label", "length", "leaf", "i", "j").applyInArrow(compare, "node long, links long, root long"), "forest-links")

    classes = nodes.select("node", "least", "copies").join(found.groupBy("node").agg(F.sum("links").alias("links")), "node", "left")
    joined = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    classes = classes.join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    named = classes.groupBy("component").agg(F.min("least").alias("component_id"))
    by_node = classes.join(named, "component").select(
        F.col("node").alias("of"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    full = usable_rows.join(by_node, F.col("node") == F.col("of")).select("vec_id", "n_links", "component_id")
    alone = rows.where("node IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return full.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
