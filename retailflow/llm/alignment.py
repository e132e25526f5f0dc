"""Alignment of two tokenizers over the bytes of a text.

A: a byte-level BPE vocabulary, given a space and the text. B: a sentencepiece model, given the text,
before which it puts a space itself. Both token sequences must spell the same bytes. Two tokens
link when their byte ranges overlap; where tokens of both end, a cut parts one group from the next.

Merging goes in lockstep: one state vector holds a pointer into A and one into B for every document of a
batch. A step links the tokens pointed at, notes a cut where both end, and moves on whichever ends
first, or both; finished documents leave the vector. Long documents enter as several lanes of LANE
tokens of A, each with the B token in which its first byte lies: a state that merging from the front
passes through as well. A step costs a few array operations, so a batch takes as many as its longest lane.

An id pair's count is the number of documents, of all, that hold it linked. The documents of a batch are
one stored row, with the pairs they hold once each; only these are counted, joined with the counts and brought
back, and the documents' links are places among them.

Defined cases: a text that is null or empty, or that the tokens of A or B do not spell (space + text), has no
tokens: zeros, and the empty text for a digest. Null ids and repeated rows are documents of their
own and count each. Empty tables give no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from types import ModuleType

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retailflow.llm.common import LARGE_ROWS, bounded_batches, renamed, written
from retailflow.llm.tokens import byte_names, located
from retailflow.llm.words import ranges

LANE = 512
#: Bytes of text, about, that are merged at once.
UNIT_BYTES = 1 << 20
#: A pair is a long: the id of A, then that of B.
B_BITS = 20


#: How texts part before merging, as the byte-level vocabulary was made for. A fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@dataclass
class Side:
    """encode: token ids of a text; spelled: the bytes of each id, by which `length` follows."""

    encode: Callable[[str], np.ndarray]
    spelled: list[bytes]

    def __post_init__(self):
        self.length = np.array([len(s) for s in self.spelled], np.int64)
        self.named = [np.array([f"{sep}{i}" for i in range(len(self.spelled))], object) for sep in ",;|"]

    def spell(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.spelled.__getitem__, ids.tolist()))


def byte_level(source: str) -> Side:
    """A byte-level vocabulary with merges in the order of its ids, as the `tokenizers` library applies it (tests
    compare): merged by `tiktoken`, which keeps nothing but ids and takes a quarter of the time."""
    import tiktoken

    with open(located(source), encoding="utf-8") as file:
        spec = json.load(file)
    model, splits = spec["model"], spec["pre_tokenizer"]
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    ordered = [model["vocab"][x + y] for x, y in pairs]
    if model["type"] != "BPE" or spec["normalizer"] or splits["type"] != "ByteLevel" or splits["add_prefix_space"] or ordered != sorted(ordered):
        raise ValueError(f"{source}: not a byte-level vocabulary in the order of its merges")
    special = {t["id"]: t["content"] for t in spec["added_tokens"]}
    byte = {name: b for b, name in enumerate(byte_names())}
    ranks = {bytes(byte[c] for c in name): i for name, i in model["vocab"].items() if i not in special}
    encoding = tiktoken.Encoding("byte-level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    spelled = {i: b for b, i in ranks.items()} | {i: t.encode() for i, t in special.items()}
    library: list = []

    def encode(text: str) -> np.ndarray:
        try:
            return encoding.encode_to_numpy(" " + text, disallowed_special=()).astype(np.int32)
        except ValueError:  # hundreds of thousands of spaces in a row are more than its pattern can go back over
            if not library:
                from tokenizers import Tokenizer

                library.append(Tokenizer.from_file(located(source)))
                library[0].encode_special_tokens = True
            return np.array(library[0].encode(" " + text, add_special_tokens=False).ids, np.int32)

    return Side(encode, [spelled.get(i, b"") for i in range(max(spelled) + 1)])


def pieces(source: str) -> Side:
    """A sentencepiece model; <0xHH> is a byte, U+2581 a space."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=located(source))

    def spell(i: int) -> bytes:
        piece = model.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if model.is_byte(i) else piece.replace("▁", " ").encode()

    return Side(lambda text: np.array(model.encode(text), np.int32), [spell(i) for i in range(model.get_piece_size())])


def sides(a: str, b: str) -> tuple[Side, Side]:
    """The two tokenizers of this worker process, loaded once."""
    kept = sys.modules.setdefault("_retailflow_sides", ModuleType("_retailflow_sides")).__dict__
    if (a, b) not in kept:
        kept[a, b] = byte_level(a), pieces(b)
    return kept[a, b]


@dataclass
class Aligned:
    """Tokens of all documents of a batch, one after the other: id, end (byte, over all documents) and first (where
    each document's begin, one entry more) of A and B; links: places of tokens (in A, in B); cuts: places in
    A, in order, of the last token of each group, and in B."""

    a: np.ndarray
    b: np.ndarray
    a_end: np.ndarray
    b_end: np.ndarray
    a_first: np.ndarray
    b_first: np.ndarray
    links: tuple[np.ndarray, np.ndarray]
    cuts: tuple[np.ndarray, np.ndarray]

    def document(self, places: np.ndarray) -> np.ndarray:
        """The documents in which tokens of A lie."""
        return np.searchsorted(self.a_first, places, "right") - 1

    def per_document(self, places: np.ndarray) -> np.ndarray:
        return np.bincount(self.document(places), minlength=len(self.a_first) - 1)


def merged(a_end: np.ndarray, b_end: np.ndarray, a_first: np.ndarray, lane: int = LANE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Links and cuts (see Aligned) of documents whose tokens end there."""
    sizes = np.diff(a_first)
    lanes = -(-sizes // lane)
    number = ranges(np.r_[0, np.cumsum(lanes)])
    i = np.repeat(a_first[:-1], lanes) + number * lane
    stop = np.minimum(i + lane, np.repeat(a_first[1:], lanes))
    start = np.where(i > 0, a_end[i - 1], 0) if len(i) else i
    j = np.searchsorted(b_end, start, "right")
    out: list[tuple[np.ndarray, ...]] = []
    while len(i):
        x, y = a_end[i], b_end[j]
        both = x == y
        out.append((i, j, i[both], j[both]))
        i, j = i + (x <= y), j + (y <= x)
        live = i < stop
        if not live.all():  # finished ones leave
            i, j, stop = i[live], j[live], stop[live]
    if not out:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    from_, to, cut_a, cut_b = (np.concatenate(x) for x in zip(*out, strict=True))
    return from_, to, np.sort(cut_a), np.sort(cut_b)


def aligned(texts: list[str | None], a: Side, b: Side) -> Aligned:
    none = np.zeros(0, np.int32)
    found_a, found_b = ([none] * len(texts) for _ in range(2))
    for i, text in enumerate(texts):
        if text:
            x, y, whole = a.encode(text), b.encode(text), b" " + text.encode()
            if a.spell(x) == whole and b.spell(y) == whole:
                found_a[i], found_b[i] = x, y
    flat = lambda lists: np.concatenate([none, *lists]).astype(np.int64)
    first = lambda lists: np.r_[0, np.cumsum([len(x) for x in lists], dtype=np.int64)]
    a_ids, b_ids, a_first = flat(found_a), flat(found_b), first(found_a)
    a_end, b_end = np.cumsum(a.length[a_ids]), np.cumsum(b.length[b_ids])
    *links, cut_a, cut_b = merged(a_end, b_end, a_first)
    return Aligned(a_ids, b_ids, a_end, b_end, a_first, first(found_b), tuple(links), (cut_a, cut_b))


def group_texts(found: Aligned, a: Side, b: Side) -> list[str]:
    """`a1,a2|b1;a3|b2,b3` of each document."""
    of_a = np.searchsorted(found.cuts[0], np.arange(len(found.a)))
    of_b = np.searchsorted(found.cuts[1], np.arange(len(found.b)))
    opens = lambda of: np.r_[True, of[1:] != of[:-1]] if len(of) else np.zeros(0, bool)
    names = np.r_[np.where(opens(of_a), a.named[1][found.a], a.named[0][found.a]), np.where(opens(of_b), b.named[2][found.b], b.named[0][found.b])]
    names = names[np.argsort(np.r_[2 * of_a, 2 * of_b + 1], kind="stable")].tolist()
    first = (found.a_first + found.b_first).tolist()
    return ["".join(names[x:y])[1:] for x, y in zip(first, first[1:], strict=False)]


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches (id, text) in parts of UNIT_BYTES or one text."""
    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch.column(1)).fill_null(0).to_numpy().astype(np.int64))
        heads = np.flatnonzero(np.r_[True, np.diff(ends // UNIT_BYTES) > 0])[: len(ends)].tolist()
        for at, end in zip(heads, [*heads[1:], len(ends)], strict=True):
            yield batch.slice(at, end - at)


def groups(docs: DataFrame, a: str, b: str) -> DataFrame:
    """doc_id, groups: of every document in order; each group its byte range in space + text and the ids of both sides."""
    bounded_batches(docs.sparkSession)
    kind = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, groups array<struct<start: long, end: long, a: array<int>, b: array<int>>>"

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, right = sides(a, b)
        for batch in _parts(batches):
            found = aligned(batch.column(1).to_pylist(), left, right)
            base = np.r_[0, found.a_end][found.a_first]
            stop = found.a_end[found.cuts[0]]
            of = found.document(found.cuts[0])
            start = np.r_[0, stop][:-1]
            lists = lambda ids, cuts: pa.ListArray.from_arrays(pa.array(np.r_[0, cuts + 1], pa.int32()), pa.array(ids, pa.int32()))
            rows = pa.StructArray.from_arrays([pa.array(start - base[of]), pa.array(stop - base[of]), lists(found.a, found.cuts[0]), lists(found.b, found.cuts[1])], ["start", "end", "a", "b"])
            first = np.r_[0, np.cumsum(found.per_document(found.cuts[0]))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(first, pa.int32()), rows)], ["doc_id", "groups"])

    return renamed(docs, ["doc_id", "text"]).mapInArrow(align, kind)


_COUNTS = ("n_a", "n_b", "n_groups", "n_links")


def _units(docs: DataFrame, a: str, b: str) -> DataFrame:
    """A row for each part of a batch of documents: unit; pairs, in order, and how many of its documents hold each; an entry for
    each document in ids, _COUNTS, digest, pairs_held; and for each pair a document holds: its place in pairs, and times."""
    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, right = sides(a, b)
        task, number = TaskContext.get().partitionId(), 0
        for batch in _parts(batches):
            found = aligned(batch.column(1).to_pylist(), left, right)
            n = len(batch)
            texts = group_texts(found, left, right)
            digest = [hashlib.sha256(t.encode()).hexdigest() if t else "" for t in texts]
            from_, to = found.links
            pairs, place = np.unique(found.a[from_] << B_BITS | found.b[to], return_inverse=True)
            held, times = np.unique(found.document(from_) * max(1, len(pairs)) + place, return_counts=True)
            row, place = held // max(1, len(pairs)), held % max(1, len(pairs))
            counts = [np.diff(found.a_first), np.diff(found.b_first), found.per_document(found.cuts[0]), found.per_document(from_)]
            one = lambda values, kind: pa.array([values], pa.list_(kind))
            yield pa.RecordBatch.from_arrays(
                [pa.array([task << 32 | number]), one(pairs, pa.int64()), one(np.bincount(place, minlength=len(pairs)), pa.int32()),
                 pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), batch.column(0)), *(one(c, pa.int64()) for c in counts), one(digest, pa.string()),
                 one(np.bincount(row, minlength=n), pa.int32()), one(place, pa.int32()), one(times, pa.int32())],
                ["unit", "pairs", "documents", "ids", *_COUNTS, "digest", "pairs_held", "place", "times"])
            number += 1

    kind = docs.schema["doc_id"].dataType.simpleString()
    counts = ", ".join(f"{c} array<long>" for c in _COUNTS)
    rows = docs.mapInArrow(align, f"unit long, pairs array<long>, documents array<int>, ids array<{kind}>, {counts}, "
                                  "digest array<string>, pairs_held array<int>, place array<int>, times array<int>")
    return written(rows, "align-units", LARGE_ROWS)


def scored(docs: DataFrame, a: str, b: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every document."""
    bounded_batches(docs.sparkSession)
    docs = renamed(docs, ["doc_id", "text"])
    units = _units(docs, a, b)
    counts = units.select(F.explode(F.arrays_zip("pairs", "documents")).alias("x")).groupBy(F.col("x.pairs").alias("pair")) \
        .agg(F.sum("x.documents").alias("n"))
    counts = written(counts.withColumn("a", F.shiftright("pair", B_BITS).cast("int")), "align-counts")
    # A row for each id of A: as many as the vocabulary has, at most.
    highest = F.broadcast(counts.groupBy("a").agg(F.max("n").alias("highest")))
    counts = counts.join(highest, "a").select("pair", "n", (F.col("n") == F.col("highest")).alias("best"))
    asked = units.select(F.col("unit").alias("of"), F.posexplode("pairs").alias("at", "pair"))
    answers = asked.join(counts, "pair").select("of", "at", "n", "best")
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, " + ", ".join(f"{c} long" for c in _COUNTS) + ", n_best long, count_sum long, groups_sha256 string"

    def sum_up(unit: pa.Table, answers: pa.Table) -> pa.Table:
        values = lambda c: unit[c].combine_chunks().flatten()
        numbers = lambda c: values(c).to_numpy(zero_copy_only=False)
        n, best = np.zeros(len(values("pairs")), np.int64), np.zeros(len(values("pairs")), bool)
        at = answers["at"].to_numpy()
        n[at], best[at] = answers["n"].to_numpy(), answers["best"].to_numpy()
        place, times = numbers("place"), numbers("times").astype(np.int64)
        first = np.r_[0, np.cumsum(numbers("pairs_held"))]
        total = lambda x: np.diff(np.r_[0, np.cumsum(x)][first])
        return pa.table([values("ids"), *(values(c) for c in _COUNTS), pa.array(total(times * best[place])), pa.array(total(times * n[place])), values("digest")],
                        ["doc_id", *_COUNTS, "n_best", "count_sum", "groups_sha256"])

    return units.groupBy("unit").cogroup(answers.groupBy("of")).applyInArrow(sum_up, schema)
