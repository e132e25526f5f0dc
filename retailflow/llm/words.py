"""Words of Arrow text columns as 64-bit hashes, by array operations over the texts' bytes.

A word is a run of bytes other than space and 09 to 0D, with A-Z lower-cased. Its hash is a
polynomial in the bytes' table values, taken from prefix sums, and mixed at the end. Texts are read
in pieces of bounded size; a word that a cut divides is put together from its parts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

PIECE = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every bit of a 64-bit number over all bits; one to one."""
    x = x ^ (x >> np.uint64(33))  # a copy, which the rest changes in place
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of two hashes in this order."""
    return mix(a * np.uint64(0x9DDFEA08EB382D69) + mix(b ^ np.uint64(0xD6E8FEB86659FD93)))


_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POWER = _powers(_BASE, PIECE)
_INVERSE = _powers(pow(_BASE, -1, 1 << 64), PIECE)

#: Tokens that are no words.
END, BEGIN = (np.uint64(x) for x in mix(np.array([1, 2], np.uint64) << np.uint64(62)))


@dataclass
class Words:
    """hash, start, end (bytes): a row per word, in the order of the texts. first: where the words of
    each text begin in them, with one entry more. data, offsets: the texts' bytes."""

    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    data: np.ndarray
    offsets: np.ndarray

    @property
    def rows(self) -> int:
        return len(self.first) - 1

    def row(self) -> np.ndarray:
        return np.repeat(np.arange(self.rows), np.diff(self.first))

    def text(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a text column; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string())
    texts = texts.fill_null("")
    _, places, data = texts.buffers()
    offsets = np.frombuffer(places, np.int64)[texts.offset : texts.offset + len(texts) + 1] if places else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)), offsets


def scan(texts: pa.Array, lower: bool = True) -> Words:
    data, offsets = buffers(texts)
    lo, hi = int(offsets[0]), int(offsets[-1])
    values = _VALUE[_LOWER] if lower else _VALUE
    sums, starts, ends = [], [], []
    open_word = False  # the last word of the piece before goes on in this one
    for at in range(lo, hi, PIECE):
        part = data[at : min(at + PIECE, hi)]
        n = len(part)
        space = _SPACE[part]
        begins = np.zeros(n + 1, bool)  # of texts
        begins[offsets[np.searchsorted(offsets, at) : np.searchsorted(offsets, at + n, "right")] - at] = True
        first = ~space
        first[1:] &= space[:-1] | begins[1:-1]
        last = ~space
        last[:-1] &= space[1:] | begins[1:-1]
        s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
        prefix = np.zeros(n + 1, np.uint64)
        np.cumsum(values[part] * _POWER[:n], out=prefix[1:])
        h = (prefix[e] - prefix[s]) * _INVERSE[s]
        if open_word and len(s) and s[0] == 0 and not begins[0]:
            before = at - int(starts[-1][-1])
            joined = (int(sums[-1][-1]) + int(h[0]) * pow(_BASE, before, 1 << 64)) & _MASK
            sums[-1][-1], ends[-1][-1] = joined, at + e[0]
            s, e, h = s[1:], e[1:], h[1:]
        open_word = not space[-1]
        if len(s):
            sums.append(h)
            starts.append(s + at)
            ends.append(e + at)
    join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
    start, end = join(starts, np.int64), join(ends, np.int64)
    hashes = mix(join(sums, np.uint64) + (end - start).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    first = np.searchsorted(start, offsets)
    first[-1] = len(start)
    return Words(hashes, start, end, first, data, offsets)


def ranges(first: np.ndarray) -> np.ndarray:
    """Place of each row within its group, for groups that begin at `first`."""
    return np.arange(first[-1] - first[0]) - np.repeat(first[:-1] - first[0], np.diff(first))
