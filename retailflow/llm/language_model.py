"""Interpolated modified Kneser-Ney model of any order from two: counted in Spark, stored as sorted hash arrays
in the shared folder, and memory-mapped by the workers that score texts.

A text is its words, A-Z lower-cased, and an end; as many begins as the order less one stand before the first.
At the highest level c(hv) is the count of an n-gram, below it the number of different tokens before hv.
With the discounts D of each level from its counts of counts, and h' being h without its first token,
    p(v|h) = (c(hv) - D(c(hv))) / c(h) + g(h) p(v|h'),     g(h): the mass that the discounts free
    q(v)   = (k(v) - D'(k(v))) / sum k + g' / (V + 1)
where q, without any h, counts the different tokens before v (k), and its last term is shared by the V training
tokens and one class of unknown tokens. After an h that training has not met, p(v|h) = p(v|h').

Tokens are numbers, the most frequent first, by a vocabulary that is counted before all else and stored like the model. N-grams are
dealt to shards by their first token; those of the 4 x shards most frequent tokens, and so of every token with a quarter of a
shard's share, by all tokens: no shard grows with one word. What a task has for a shard goes as one row of bytes: the n-grams
in order, a plane for each byte of their numbers, compressed. A shard's arrays of one length are one file: sorted 64-bit
hashes, of which the leading bits are places in a table and 32 more are kept, and their values. A worker keeps at
most MAPS files mapped. All counts cover all training texts, and nothing is pruned.

Defined cases: null and empty texts are one token, the end. A null id counts as the empty text in the
choice of held-out documents. Repeated rows are counted and scored each. Without training
texts q is 1 for the one unknown class. Empty tables give no rows. Other columns are not read.
"""

from __future__ import annotations

import json
import mmap
import os
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from retailflow.llm.common import bounded_batches, discard, mounted, written
from retailflow.llm.words import END, Words, mix, scan
from retailflow.session import run_dir

#: Files that a worker keeps mapped.
MAPS = 2000
#: Tokens of the n-grams that a counting task holds before it passes them on.
HELD = 8_000_000
#: Numbers that are no words: the begin, by level what stands for its counts of counts in rows about shorter n-grams, what
#: training has not met. Words and the end are numbered from FIRST on.
_BEGIN, _COUNTS, FIRST, _UNKNOWN = 0, np.arange(64, dtype=np.uint32), 100, (1 << 32) - 1
_STEP, _SPREAD = np.uint64(0x9DDFEA08EB382D69), np.uint64(0x9E3779B97F4A7C15)
#: A count is one byte; this one stands for a count kept apart.
_LARGE = 255


@dataclass(frozen=True)
class Model:
    folder: str
    shards: int
    tokens: int  # of training
    distinct: int
    types: int  # different bigrams
    rates: tuple[tuple[float, float, float], ...]  # from level two: discounts of counts 1, 2, 3 and more
    unigram: tuple[float, float, float]
    freed: float  # g'

    @property
    def order(self) -> int:
        return len(self.rates) + 1


def discounts(n: list[int]) -> tuple[float, float, float]:
    """From the numbers of counts 1 to 4; where one of them is zero, the usual 0.5, 1, 1.5."""
    if not all(n):
        return 0.5, 1.0, 1.5
    y = n[0] / (n[0] + 2 * n[1])
    found = (i - (i + 1) * y * n[i] / n[i - 1] for i in (1, 2, 3))
    return tuple(float(min(max(d, 0.05), i)) for i, d in enumerate(found, 1))


def discounted(count: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return np.maximum(count - np.array([0, *d])[np.minimum(count, 3).astype(int)], 0)


def sequences(words: Words, number: np.ndarray, end: int, order: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The tokens of all texts with their ends, after columns of the tokens before each; and where each text begins.
    number: of each word."""
    first = words.first - words.first[0] + np.arange(words.rows + 1)
    after = np.empty(len(words.hash) + words.rows, np.uint32)
    own = np.ones(len(after), bool)
    own[first[1:] - 1] = False
    after[own], after[~own] = number, end
    columns = [after]
    while len(columns) < order:
        before = np.empty_like(after)
        before[1:] = columns[0][:-1]
        before[first[:-1]] = _BEGIN
        columns.insert(0, before)
    return columns, first


def hashed(columns: list[np.ndarray]) -> np.ndarray:
    """Hash of each n-gram. That of a pair is one to one."""
    out = columns[-1].astype(np.uint64)
    if len(columns) == 1:
        return mix(out + np.uint64(1))
    out = mix(out | columns[-2].astype(np.uint64) << np.uint64(32))
    for x in columns[-3::-1]:
        out = mix(out + x * _STEP)
    return out


def summed(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys, where each is first met, and sums of the values by key."""
    order = np.argsort(keys)
    k = keys[order]
    heads = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else np.zeros(0, np.int64)
    sums = [np.add.reduceat(v[order], heads) if len(heads) else v[:0] for v in values]
    return (k[heads], order[heads], *sums)


def encoded(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys as they are first met, and the place of each key among them: where keys repeat often, without a sort."""
    found = pa.array(keys).dictionary_encode()
    return found.dictionary.to_numpy(), found.indices.to_numpy()


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order, where one of each stands, and the place of each key among them."""
    order = np.argsort(keys)  # not stable, as np.unique has it with these results: several times as fast
    k = keys[order]
    new = np.r_[True, k[1:] != k[:-1]] if len(k) else np.zeros(0, bool)
    place = np.empty(len(keys), np.int64)
    place[order] = np.cumsum(new) - 1
    return k[new], order[new], place


def _dealt(shard: np.ndarray, shards: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each shard that is met, and the places it is met at, in order."""
    order = np.argsort(shard.astype(np.min_scalar_type(shards)), kind="stable")  # by radix up to 16 bits
    edges = np.r_[0, np.cumsum(np.bincount(shard, minlength=shards))]
    for s in np.flatnonzero(np.diff(edges)).tolist():
        yield s, order[edges[s] : edges[s + 1]]


def _shard(key: np.ndarray, shards: int) -> np.ndarray:
    return ((key * _SPREAD >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int32)


def _place(columns: list[np.ndarray], shards: int, key: np.ndarray | None = None) -> np.ndarray:
    """key: the hashes of the n-grams, where they are known."""
    if len(columns) == 1:
        return _shard(hashed(columns) if key is None else key, shards)
    spread = columns[0].astype(np.uint64)
    common = np.flatnonzero(columns[0] < FIRST + 4 * shards)
    spread[common] = hashed([x[common] for x in columns]) if key is None else key[common]
    return _shard(spread, shards)


def packed(columns: list[np.ndarray], values: list[np.ndarray], add: bool = False) -> bytes:
    """N-grams and their values as compressed bytes; with `add` each n-gram once, with the sums of its values."""
    bits = [int(x.max(initial=0)).bit_length() for x in columns]
    if sum(bits) <= 64:  # one number each, in the same order
        code = columns[0].astype(np.uint64)
        for x, n in zip(columns[1:], bits[1:], strict=True):
            code = code << np.uint64(n) | x
        order = np.argsort(code)
        new = np.diff(code[order]) != 0 if add else None
    else:
        order = np.lexsort(columns[::-1])
        new = np.logical_or.reduce([np.diff(x[order]) != 0 for x in columns]) if add else None
    values = [x[order] for x in values]
    if add:
        heads = np.flatnonzero(np.r_[True, new])
        order, values = order[heads], [np.add.reduceat(x, heads) for x in values]
    codes = np.stack([x[order] for x in columns])
    codes[0, 1:] -= codes[0, :-1].copy()  # steps of the first, which comes in order
    planes = np.ascontiguousarray(codes.astype("<u4").view(np.uint8).reshape(len(columns), -1, 4).transpose(0, 2, 1))
    values = [_narrow(x) for x in values]
    body = b"".join([planes.tobytes(), *(x.tobytes() for x in values)])
    head = np.array([len(order), len(body), *(x.dtype.itemsize for x in values)], np.int64)
    return head.tobytes() + pa.compress(body, "zstd", asbytes=True)


def unpacked(row: bytes, columns: int, values: int) -> list[np.ndarray]:
    """The columns and values of `packed`, in the n-grams' order."""
    head = np.frombuffer(row, np.int64, 2 + values)
    n, size = head[:2].tolist()
    body = np.frombuffer(pa.decompress(row[head.nbytes :], size, "zstd", asbytes=True), np.uint8)
    at = 4 * n * columns
    planes = body[:at].reshape(columns, 4, n)
    out = [np.ascontiguousarray(p.T).view("<u4").ravel() for p in planes]
    out[0] = np.cumsum(out[0], dtype=np.uint32)
    for width in head[2:].tolist():
        out.append(np.frombuffer(body[at : at + width * n].tobytes(), f"<u{width}").astype(np.int64))
        at += width * n
    return out


def _narrow(x: np.ndarray) -> np.ndarray:
    return x.astype(np.min_scalar_type(int(x.max(initial=0))))


def _stored(path: str, arrays: dict[str, np.ndarray]) -> None:
    """One file of arrays: its head's length, a head of (name, type, place, length), and the arrays. Written under another
    name first: a task that runs again replaces a whole file by an equal one."""
    os.makedirs(os.path.dirname(path), exist_ok=True)
    part, at, head = f"{path}.{TaskContext.get().taskAttemptId()}", 0, []
    for name, x in arrays.items():
        head.append((name, x.dtype.str, at, len(x)))
        at += -(-x.nbytes // 8) * 8
    text = json.dumps(head).encode()
    text += b" " * (-len(text) % 8)
    with open(part, "wb") as out:
        out.write(np.int64(len(text)).tobytes() + text)
        for x in arrays.values():
            out.write(x.tobytes() + bytes(-x.nbytes % 8))
    os.replace(part, path)


def _mapped(path: str) -> dict[str, np.ndarray]:
    if not os.path.exists(path):
        return {}
    with open(path, "rb") as file:
        data = np.frombuffer(mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ), np.uint8)
    size = 8 + int(data[:8].view(np.int64)[0])
    return {name: data[size + at : size + at + n * np.dtype(kind).itemsize].view(kind) for name, kind, at, n in json.loads(data[8:size].tobytes())}


def _keys(key: np.ndarray) -> dict[str, np.ndarray]:
    """Sorted hashes as arrays: `heads`, where those of each value of the leading bits begin, and 32 bits more of each."""
    bits = max(1, len(key).bit_length() - 4)
    heads = np.searchsorted(key >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))
    return {"heads": _narrow(heads), "keys": (key >> np.uint64(32 - bits)).astype(np.uint32)}


def _found(arrays: dict[str, np.ndarray], wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the wanted hashes that are there, and which those are."""
    if not arrays or not len(arrays["keys"]):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    heads, keys = arrays["heads"], arrays["keys"]
    bits = (len(heads) - 1).bit_length() - 1
    lead, rest = (wanted >> np.uint64(64 - bits)).astype(np.int64), (wanted >> np.uint64(32 - bits)).astype(np.uint32)
    low, high = heads[lead].astype(np.int64), heads[lead + 1].astype(np.int64)
    for n in range(int((high - low).max(initial=0)).bit_length(), 0, -1):  # all searched at once, by steps of powers of two
        last = low + ((1 << n - 1) - 1)
        less = keys.take(last, mode="clip") < rest
        less &= last < high
        np.add(last, 1, out=low, where=less)
    there = np.flatnonzero(low < high)
    there = there[keys[low[there]] == rest[there]]
    return low[there], there


def _small(arrays: dict[str, np.ndarray], kind: str, x: np.ndarray) -> None:
    """Adds a byte for each key, and apart the places and values of the few that need more."""
    large = np.flatnonzero(x >= _LARGE)
    arrays[kind] = np.minimum(x, _LARGE).astype(np.uint8)
    arrays[f"{kind}-places"], arrays[f"{kind}-large"] = _narrow(large), _narrow(x[large])


def _vocabulary(train: DataFrame, place: str, shards: int) -> int:
    """Stores the number of every training token and of the end, by its hash, and returns how many there are."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = scan(batch.column(0))
            key, at = encoded(words.hash)
            n = np.bincount(at, minlength=len(key))
            yield pa.RecordBatch.from_arrays([pa.array(np.r_[key, END].view(np.int64)), pa.array(np.r_[n, words.rows])], ["w", "n"])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.arange(at, at + len(batch))), pa.array(np.full(len(batch), part, np.int32))], ["w", "at", "part"])
            at += len(batch)

    counts = train.mapInArrow(count, "w long, n long").groupBy("w").agg(F.sum("n").alias("n"))
    counts = written(counts, "lm-counts")
    ordered = counts.repartitionByRange(F.desc("n"), "w").sortWithinPartitions(F.desc("n"), "w")
    rows = written(ordered.mapInArrow(number, "w long, at long, part int"), "lm-numbers")
    sizes = {r["part"]: r["n"] for r in rows.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a partition
    parts = np.zeros(max(sizes, default=0) + 2, np.int64)
    parts[np.array(list(sizes), np.int64) + 1] = list(sizes.values())
    base = np.cumsum(parts) + FIRST
    if base[-1] >= _UNKNOWN:
        raise ValueError(f"{base[-1]} different tokens")

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w, at, part = (batch[c].to_numpy() for c in ("w", "at", "part"))
            yield pa.RecordBatch.from_arrays([pa.array(_shard(w.view(np.uint64), shards)), batch["w"], pa.array(base[part] + at)], ["shard", "w", "number"])

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(b["w"].to_numpy().view(np.uint64), b["number"].to_numpy()) for b in batches]
        if parts:
            w, numbers = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.argsort(w)
            _stored(f"{place}/words-{TaskContext.get().partitionId():06d}", _keys(w[order]) | {"number": numbers[order].astype(np.uint32)})
        yield pa.RecordBatch.from_arrays([pa.array([len(parts)], pa.int64())], ["done"])

    rows.mapInArrow(deal, "shard int, w long, number long").repartitionById(shards, F.col("shard")).mapInArrow(store, "done long").agg(F.sum("done")).first()
    discard(counts, rows)
    return int(base[-1]) - FIRST


def fit(docs: DataFrame, order: int = 2) -> Model:
    """Counts the column `text` of all rows."""
    if not 2 <= order < len(_COUNTS):
        raise ValueError(f"order {order}: 2 to {len(_COUNTS) - 1}")
    spark = docs.sparkSession
    bounded_batches(spark)
    train = docs.select("text")
    shards = max(8, train.rdd.getNumPartitions() * (2 * order - 3))
    folder = run_dir(spark, "language-model")
    place = mounted(folder)
    _vocabulary(train, place, shards)
    # c: occurrences. k: different tokens before. s: total of the counts after, which c has in order two. n1 to n3: kinds after.
    kinds = ["c", "k", *(["s"] if order > 2 else []), "n1", "n2", "n3"]

    def rows(columns: list[np.ndarray], values: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        for s, own in _dealt(_place(columns, shards), shards):
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([packed([x[own] for x in columns], [x[own] for x in values], add=True)], pa.binary())], ["shard", "grams"])

    def read(batches: Iterator[pa.RecordBatch], columns: int, values: int) -> list[np.ndarray] | None:
        parts = [unpacked(row.as_py(), columns, values) for b in batches for row in b.column(1)]
        return [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else None

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, vocabulary = [], Maps(place, shards)

        def counted() -> Iterator[pa.RecordBatch]:
            columns = [np.concatenate(x) for x in zip(*waiting, strict=True)]
            waiting.clear()
            yield from rows(columns, [np.ones(len(columns[0]), np.int32)])

        for batch in batches:
            words = scan(batch.column(0))
            number = vocabulary.numbers(np.r_[words.hash, END])
            waiting.append(sequences(words, number[:-1], int(number[-1]), order)[0])
            if sum(len(x[0]) for x in waiting) * order > HELD:  # counted once for many batches, not with each
                yield from counted()
        if waiting:
            yield from counted()

    def level(n: int):
        """Sums n-grams, stores them, and passes on what they say about shorter ones."""
        names = ["c"] if n == order else kinds

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = read(batches, n, len(names))
            if found is None:
                return
            key, at, *sums = summed(hashed(found[:n]), *found[n:])
            tokens, values = [x[at] for x in found[:n]], dict(zip(names, sums, strict=True))
            del found, sums
            told = (tokens[0] > _BEGIN) & (tokens[0] < FIRST)  # counts of counts of longer ones
            passed = [x[told] for x in tokens[1:]], [values[x][told] if x in values else np.zeros(told.sum(), np.int64) for x in kinds]
            key, tokens, values = key[~told], [x[~told] for x in tokens], {x: v[~told] for x, v in values.items()}
            arrays = _keys(key)
            for kind in ["c"] if n == order else kinds[1:]:
                _small(arrays, kind, values[kind])
            _stored(f"{place}/grams{n}-{TaskContext.get().partitionId():06d}", arrays)
            count = values["c" if n == order else "k"]
            met = count > 0  # the rest are contexts only
            tokens, raw, count = [x[met] for x in tokens], values["c"][met], count[met]
            del key, values
            none, ones = np.zeros(len(count), np.int32), np.ones(len(count), np.int32)
            last = {"c": raw, "k": ones}
            before = {"c": np.where(tokens[0] == _BEGIN, count, 0) if order == 2 else none, "s": count, "n1": count == 1, "n2": count == 2, "n3": count >= 3}
            sums = [np.r_[last.get(x, none), before.get(x, none).astype(np.int64 if x in "cs" else np.int32)] for x in kinds]
            own = dict(zip(("c", "k", "n1", "n2"), ((count == i).sum() for i in (1, 2, 3, 4)), strict=True))
            yield from rows([np.r_[x, y, z, _COUNTS[n : n + 1]] for x, y, z in zip(tokens[1:], tokens[:-1], passed[0], strict=True)],
                            [np.r_[x, y, own.get(kind, 0)] for x, y, kind in zip(sums, passed[1], kinds, strict=True)])

        return run

    def table(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = read(batches, 1, len(kinds))
        if found is None:
            return
        key, at, *sums = summed(hashed(found[:1]), *found[1:])
        w = found[0][at]
        values = dict(zip(kinds, sums, strict=True))
        of_counts = [values[x][w == _COUNTS[n]].sum() for n in range(2, order + 1) for x in ("c", "k", "n1", "n2")]
        tokens = (w == _BEGIN) | (w >= FIRST)
        key, w, values = key[tokens], w[tokens], {x: v[tokens] for x, v in values.items()}
        arrays = _keys(key)
        for kind, array in values.items():
            arrays[kind] = _narrow(array)
        _stored(f"{place}/tokens-{TaskContext.get().partitionId():06d}", arrays)
        own, k = w != _BEGIN, values["k"]
        found = [values["c"][own].sum(), own.sum(), k.sum(), *((k == i).sum() for i in (1, 2, 3, 4)), *of_counts]
        yield pa.RecordBatch.from_arrays([pa.array([int(x)]) for x in found], names)

    names = ["tokens", "distinct", "types", *(f"l{n}_{i}" for n in range(1, order + 1) for i in (1, 2, 3, 4))]
    schema = "shard int, grams binary"
    counted = train.mapInArrow(grams, schema).repartitionById(shards, F.col("shard"))
    for n in range(order, 1, -1):
        counted = counted.mapInArrow(level(n), schema).repartitionById(shards, F.col("shard"))
    found = counted.mapInArrow(table, ", ".join(f"{n} long" for n in names)).agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names]).first()
    unigram, *rates = (discounts([found[f"l{n}_{i}"] for i in (1, 2, 3, 4)]) for n in range(1, order + 1))
    once, twice = found["l1_1"], found["l1_2"]
    freed = float(np.dot(unigram, (once, twice, found["distinct"] - once - twice)) / found["types"]) if found["types"] else 1.0
    return Model(place, shards, found["tokens"], found["distinct"], found["types"], tuple(rates), unigram, freed)


class Maps:
    """A model's files, mapped into memory; the pages that are read are shared by all workers of a machine."""

    def __init__(self, folder: str, shards: int):
        self.folder, self.shards, self.maps = folder, shards, OrderedDict()

    def arrays(self, shard: int, what: str) -> dict[str, np.ndarray]:
        key = (shard, what)
        if key not in self.maps:
            self.maps[key] = _mapped(f"{self.folder}/{what}-{shard:06d}")
            if len(self.maps) > MAPS:
                self.maps.popitem(last=False)
        self.maps.move_to_end(key)
        return self.maps[key]

    def found(self, key: np.ndarray, shard: np.ndarray, what: str) -> Iterator[tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]]:
        """The arrays of each shard, places of the keys in them, and which keys these are of."""
        for s, own in _dealt(shard, self.shards):
            arrays = self.arrays(s, what)
            at, there = _found(arrays, key[own])
            if len(at):
                yield arrays, at, own[there]

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each token."""
        w, place = encoded(hashes)
        out = np.full(len(w), _UNKNOWN, np.uint32)
        for arrays, at, own in self.found(w, _shard(w, self.shards), "words"):
            out[own] = arrays["number"][at]
        return out[place]


class Lookup(Maps):
    """The values of n-grams."""

    def __init__(self, model: Model):
        super().__init__(model.folder, model.shards)
        self.model = model

    def tokens(self, w: np.ndarray) -> dict[str, np.ndarray]:
        """c, k, s, n1, n2, n3 of tokens."""
        out = {x: np.zeros(len(w), np.int64) for x in ("c", "k", *(["s"] if self.model.order > 2 else []), "n1", "n2", "n3")}
        for arrays, at, own in self.found(hashed([w]), _place([w], self.shards), "tokens"):
            for x, values in out.items():
                values[own] = arrays[x][at]
        return out if "s" in out else out | {"s": out["c"]}

    def grams(self, columns: list[np.ndarray], kinds: list[str]) -> list[np.ndarray]:
        """The named values of n-grams; 0 of those that are not there."""
        key = hashed(columns)
        out = [np.zeros(len(columns[0]), np.int64) for _ in kinds]
        for arrays, at, own in self.found(key, _place(columns, self.shards, key), f"grams{len(columns)}"):
            for kind, values in zip(kinds, out, strict=True):
                count = arrays[kind][at].astype(np.int64)
                large = np.flatnonzero(count == _LARGE)
                if len(large):
                    count[large] = arrays[f"{kind}-large"][np.searchsorted(arrays[f"{kind}-places"], at[large])]
                values[own] = count
        return out


def scores(lookup: Lookup, texts: pa.Array) -> dict[str, np.ndarray]:
    """n_tokens, n_known, base_score, score of each text."""
    m = lookup.model
    words = scan(texts)
    number = lookup.numbers(np.r_[words.hash, END])
    columns, first = sequences(words, number[:-1], int(number[-1]), m.order)
    del words
    # One n-gram of begins alone in the end: what stands before the first token of a text.
    columns = [np.r_[x, np.uint32(_BEGIN)] for x in columns]
    w, at = encoded(columns[-1])
    known = lookup.tokens(w)
    c, k = known["c"], known["k"]
    own = at[:-1]
    base = np.log10((np.where(w == _BEGIN, 0, c) + 0.1) / (m.tokens + 0.1 * (m.distinct + 1)))
    p = (discounted(k, m.unigram) / max(m.types, 1) + m.freed / (m.distinct + 1))[at]
    total, *kinds = (known[x] for x in ("s", "n1", "n2", "n3"))
    for n in range(2, m.order + 1):
        # What stands before a token ends one place earlier: its totals are those found for the level below.
        before = np.r_[at[-1:], at[:-1]]
        before[first[:-1]] = at[-1]
        d = m.rates[n - 2]
        total = np.maximum(total, 1)
        back = np.where(sum(kinds) > 0, sum(x * y for x, y in zip(d, kinds, strict=True)) / total, 1)  # an h that is not met has no count
        _, one, at = distinct(hashed(columns[-n:]))
        count, *after = lookup.grams([x[one] for x in columns[-n:]], ["c"] if n == m.order else ["k", "s", "n1", "n2", "n3"])
        p = discounted(count, d)[at] / total[before] + back[before] * p
        if after:
            total, *kinds = after
    p = p[:-1]
    by_text = lambda x: np.add.reduceat(x, first[:-1]) if len(first) > 1 else x[:0]
    return {"n_tokens": np.diff(first), "n_known": by_text((c[own] > 0).astype(np.int64)), "base_score": by_text(base[own]), "score": by_text(np.log10(p))}


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score of every document."""
    bounded_batches(docs.sparkSession)
    kinds = {"n_tokens": "long", "n_known": "long", "base_score": "double", "score": "double"}

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = Lookup(model)
        for batch in batches:
            got = scores(lookup, batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(got[n]) for n in kinds)], ["doc_id", *kinds])

    schema = ", ".join([f"doc_id {docs.schema['doc_id'].dataType.simpleString()}", *(f"{n} {k}" for n, k in kinds.items())])
    return docs.select("doc_id", "text").mapInArrow(score, schema)
