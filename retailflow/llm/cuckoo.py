"""Cuckoo filters: sets of 128-bit keys as 16-bit fingerprints, four to a bucket, with deletion.

A key's fingerprint lies in one of two buckets, each of which follows from the other and the
fingerprint; insertion moves fingerprints between their two buckets until one is free. A key that was
inserted is always found; another is taken for one with a probability of at most 8 in 65,535.
"""

from __future__ import annotations

import numpy as np

from retailflow.llm.words import mix

SLOTS = 4
KICKS = 500


class Full(Exception):
    """No free place was found."""


class Cuckoo:
    def __init__(self, bits: bytes):
        self.table = np.frombuffer(bits, np.uint16).reshape(-1, SLOTS).copy()
        self.mask = np.uint64(len(self.table) - 1)

    @classmethod
    def sized(cls, keys: int) -> Cuckoo:
        """An empty filter that so many keys fill by half."""
        buckets = 1 << max(4, (2 * keys // SLOTS).bit_length())
        return cls(bytes(2 * SLOTS * buckets))

    def bits(self) -> bytes:
        return self.table.tobytes()

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Fingerprint and both buckets of each key (rows of two longs)."""
        a, b = keys[:, 0].view(np.uint64), keys[:, 1].view(np.uint64)
        print_ = (mix(b) % np.uint64(65535) + np.uint64(1)).astype(np.uint16)
        first = mix(a) & self.mask
        return print_, first.astype(np.int64), self._other(first, print_)

    def _other(self, bucket: np.ndarray, print_: np.ndarray) -> np.ndarray:
        return ((bucket.astype(np.uint64) ^ mix(print_.astype(np.uint64))) & self.mask).astype(np.int64)

    def has(self, keys: np.ndarray) -> np.ndarray:
        print_, first, second = self._places(keys)
        return ((self.table[first] == print_[:, None]) | (self.table[second] == print_[:, None])).any(axis=1)

    def insert(self, keys: np.ndarray) -> None:
        random = np.random.default_rng(1)
        for print_, *buckets in zip(*(x.tolist() for x in self._places(keys)), strict=True):
            self._put(print_, buckets, random)

    def _put(self, print_: int, buckets: list[int], random: np.random.Generator) -> None:
        for bucket in buckets:
            free = np.flatnonzero(self.table[bucket] == 0)
            if len(free):
                self.table[bucket, free[0]] = print_
                return
        bucket = buckets[int(random.integers(2))]
        for _ in range(KICKS):
            slot = int(random.integers(SLOTS))
            print_, self.table[bucket, slot] = int(self.table[bucket, slot]), print_
            bucket = int(self._other(np.array([bucket]), np.array([print_]))[0])
            free = np.flatnonzero(self.table[bucket] == 0)
            if len(free):
                self.table[bucket, free[0]] = print_
                return
        raise Full

    def delete(self, keys: np.ndarray) -> None:
        """Keys that were inserted; each takes one of its fingerprints out."""
        for print_, *buckets in zip(*(x.tolist() for x in self._places(keys)), strict=True):
            for bucket in buckets:
                at = np.flatnonzero(self.table[bucket] == print_)
                if len(at):
                    self.table[bucket, at[0]] = 0
                    break


def built(keys: np.ndarray) -> Cuckoo:
    """A filter of the keys, with more room as long as they do not fit."""
    room = len(keys)
    while True:
        made = Cuckoo.sized(room)
        try:
            made.insert(keys)
            return made
        except Full:
            room = 2 * room + 8
