"""Best-fit packing into bins of several permitted lengths.

Every document takes its number of words and one more for its end; above the greatest permitted
length it is cut into pieces of that length and a rest. Pieces are dealt by hash into groups of
bounded size, and each group is packed by itself, longest pieces first. A piece goes to the open bin
that it leaves least room in, whatever that bin's length. Where none has room, a bin is opened: of
all permitted lengths that hold the piece the one of least expected cost for each place used. At the end every bin is
downsized to the least permitted length that holds its contents.

Cost of a bin: its length, its square by `attention` (a sequence's places meet one another), and `overhead`. Expected use: what the
piece leaves is filled with the pieces to come, longest first, as long as one fits; the bin then counts as downsized.
So short pieces open long bins only where nothing shorter would be filled as well. A group is packed so by all lengths and
by every run of neighbouring ones, and the cheapest packing is taken: no single length would have been cheaper.

Defined cases: null and empty texts take one place, for the end. A null id, and repeated rows, are
documents of their own; `piece` counts from 0 within a row. Empty tables give no rows. Other columns
are not read.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retailflow.llm.common import bounded_batches, pieces, renamed, written
from retailflow.llm.words import scan


@dataclass(frozen=True)
class Packing:
    lengths: Sequence[int] = (256, 512, 1024, 2048, 4096)
    overhead: float = 4.0
    attention: float = 32_768.0
    group: int = 20_000

    def cost(self, length: int) -> float:
        return length + length * length / self.attention + self.overhead


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, size of every document: words and the end."""
    bounded_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            n = np.diff(scan(batch.column(1)).first) + 1
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], ["doc_id", "size"])

    docs = renamed(docs, ["doc_id", "text"])
    return docs.mapInArrow(count, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, size long")


class Fill:
    """Pieces, longest first, and what of those to come would fill a room."""

    def __init__(self, pieces: Sequence[int]):
        self.shorter = [-p for p in pieces]  # in ascending order
        self.upto = list(accumulate(pieces, initial=0))

    def expected(self, room: int, after: int) -> int:
        """Places that pieces from `after` on would take of the room."""
        left, at = room, after
        while left:
            at = bisect.bisect_left(self.shorter, -left, at)
            if at == len(self.shorter):
                break
            # All of those that follow one another and fit together.
            end = bisect.bisect_right(self.upto, self.upto[at] + left) - 1
            left -= self.upto[end] - self.upto[at]
            at = end
        return room - left


def _packed(pieces: Sequence[int], fill: Fill, menu: Sequence[int], packing: Packing) -> tuple[list[int], list[int]]:
    """Bin number of each piece, and each bin's length, where bins of the menu's lengths may be opened."""
    lengths = sorted(packing.lengths)
    least = lambda used: lengths[bisect.bisect_left(lengths, used)]
    rooms: list[tuple[int, int]] = []  # (room left, bin), in order
    filled: list[int] = []
    chosen = []
    for number, piece in enumerate(pieces):
        at = bisect.bisect_left(rooms, (piece, -1))
        if at < len(rooms):
            room, bin_ = rooms.pop(at)
        else:
            def cost(length: int) -> float:
                used = piece + fill.expected(length - piece, number + 1)
                return packing.cost(least(used)) / used

            room = min((x for x in menu if x >= piece), key=cost)
            bin_ = len(filled)
            filled.append(0)
        filled[bin_] += piece
        chosen.append(bin_)
        if room > piece:
            bisect.insort(rooms, (room - piece, bin_))
    return chosen, [least(f) for f in filled]


def pack(pieces: Sequence[int], packing: Packing) -> tuple[list[int], list[int]]:
    """Bin number of each piece, and each bin's length: the cheapest of the packings by all lengths, and by every run of
    neighbouring lengths that holds the longest piece. Pieces must come longest first."""
    lengths, fill = sorted(packing.lengths), Fill(pieces)
    menus = [lengths[i:j] for j in range(len(lengths), 0, -1) for i in range(j) if not pieces or lengths[j - 1] >= pieces[0]]
    plans = (_packed(pieces, fill, menu, packing) for menu in menus)
    return min(plans, key=lambda plan: sum(map(packing.cost, plan[1])))


def packed(docs: DataFrame, packing: Packing = Packing()) -> DataFrame:
    """doc_id, piece, start, length, group_no, bin_no, bin_length, bin_start: a row for each piece of each
    document; a bin is (group_no, bin_no), bin_start the piece's first place in it."""
    # Repeated rows are numbered, not told apart by where they lie: reruns agree.
    rows = sizes(docs).groupBy("doc_id", "size").agg(F.count(F.lit(1)).cast("int").alias("copies"))
    rows = written(rows.select("doc_id", "size", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")), "packing-sizes")
    most = max(packing.lengths)
    total = rows.agg(F.sum(F.expr(f"(size + {most - 1}) div {most}"))).first()[0] or 0
    groups = max(1, -(-total // packing.group))
    piece = F.explode(F.sequence(F.lit(0), F.expr(f"cast((size - 1) div {most} as int)"))).alias("piece")
    rows = rows.select("doc_id", "copy", "size", piece)
    length = F.least(F.lit(most), F.col("size") - F.col("piece") * most).cast("int")
    rows = rows.select("doc_id", "copy", "piece", (F.col("piece") * most).cast("long").alias("start"), length.alias("length"),
                       F.pmod(F.xxhash64("doc_id", "copy", "piece", "size"), F.lit(groups)).cast("int").alias("group_no"))

    def fill(key: tuple, group: pa.Table) -> pa.Table:
        group = group.sort_by([("length", "descending"), ("doc_id", "ascending"), ("copy", "ascending"), ("piece", "ascending")])
        length = group["length"].to_numpy()
        bins, lengths = pack(length.tolist(), packing)
        bins = np.array(bins, np.int32)
        order = np.argsort(bins, kind="stable")
        ends = np.cumsum(length[order])
        heads = np.flatnonzero(np.r_[True, np.diff(bins[order]) > 0])
        starts = ends - length[order]
        starts -= np.repeat(starts[heads], np.diff(np.r_[heads, len(order)]))
        places = np.empty(len(order), np.int32)
        places[order] = starts
        return group.drop_columns(["copy"]).append_column("bin_no", pa.array(bins)) \
            .append_column("bin_length", pa.array(np.array(lengths, np.int32)[bins])).append_column("bin_start", pa.array(places))

    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.groupBy("group_no").applyInArrow(
        fill, f"doc_id {kind}, piece int, start long, length int, group_no int, bin_no int, bin_length int, bin_start int")
