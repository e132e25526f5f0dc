"""Token counts of a byte-pair tokenizer by compiled finite-state transducers.

The vocabulary and merges compile into a deterministic transducer over the bytes of a word. Its state
is the longest suffix read that begins a token, with the last token of the tokenization of each
prefix that ends inside it; a tokenization is right exactly when all its adjacent pairs are, so that
is all the past that matters. A transition carries the net number of tokens emitted, and a word's
last byte takes a closing transition. States are compiled when first reached.

Between white space texts are independent: a text's chunk acts on what is pending as a state map
(head, count, tail), the head finishing the pending word and the tail pending in turn. Short texts
are one chunk. Long ones are cut into chunks of bounded size that tasks map apart; maps compose by a
parallel prefix scan, whose step d joins a chunk's map with that of the chunks before, d = 1, 2, 4...

Counts are those of the `tokenizers` library without added begin and end tokens; special strings
inside a text count one.

Defined cases: null and empty texts have no bytes and tokens. Null ids and repeated rows are counted
each. Empty tables give no rows. Other columns are not read.
"""

from __future__ import annotations

import json
import os
import sys
import unicodedata
from collections.abc import Iterator
from types import ModuleType

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from retailflow.llm.common import bounded_batches, renamed, written
from retailflow.llm.words import Words, scan

CHUNK = 64 << 10
#: What a task keeps compiled or counted; beyond it begins anew, with the same results.
MOST_STATES = 60_000
MOST_WORDS = 1_000_000
MOST_PIECES = 300_000
_CLOSED = "</w>"
_SPACE_BYTES = b" \t\n\x0b\x0c\r"
#: White space of Unicode.
_WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


def byte_names() -> list[str]:
    """The visible characters by which byte-level vocabularies name bytes: printable Latin-1 bytes name
    themselves, the others get the characters from 256 on, in order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class Transducer:
    """Counts the tokens of words, compiling states when they are first reached."""

    def __init__(self, vocabulary: set[str], merges: list[tuple[str, str]]):
        self.vocabulary = vocabulary
        self.rank = {m: i for i, m in enumerate(merges)}
        self.prefixes = {t[:i] for t in vocabulary for i in range(1, len(t.removesuffix(_CLOSED)) + 1)}
        self.fits: dict[tuple[str, str], bool] = {}
        self.reset()

    def reset(self) -> None:
        start = ("", ((None, 0),))
        self.keys, self.ids = [start], {start: 0}
        self.next: list[dict[str, tuple[int, int]]] = [{}]
        self.close: list[dict[str, int]] = [{}]

    def merged(self, symbols: list[str]) -> list[str]:
        """The tokenization by merging, least rank first."""
        symbols = list(symbols)
        while len(symbols) > 1:
            rank, at = min((self.rank.get(p, 1 << 30), i) for i, p in enumerate(zip(symbols, symbols[1:], strict=False)))
            if rank == 1 << 30:
                break
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
        return symbols

    @staticmethod
    def symbols(token: str) -> list[str]:
        if not token.endswith(_CLOSED) or token == _CLOSED:
            return list(token)
        body = token.removesuffix(_CLOSED)
        return [*body[:-1], body[-1] + _CLOSED]

    def adjacent(self, left: str, right: str) -> bool:
        """Whether the two tokens may stand side by side in a tokenization."""
        key = (left, right)
        if key not in self.fits:
            if len(self.fits) > 2 * MOST_STATES:
                self.fits.clear()
            self.fits[key] = self.merged(self.symbols(left) + self.symbols(right)) == [left, right]
        return self.fits[key]

    def _last(self, state: int, c: str, closing: str) -> tuple[str, int]:
        """The last token once c is read, and the change of the number of tokens."""
        window, ends = self.keys[state]
        seen = window + c
        for n in range(len(seen), 0, -1):
            token = seen[-n:] + closing
            if token in self.vocabulary:
                before, count = ends[len(seen) - n]
                if before is None or self.adjacent(before, token):
                    return token, count + 1
        raise ValueError(f"no token ends with {seen!r}")

    def step(self, state: int, c: str) -> tuple[int, int]:
        window, ends = self.keys[state]
        token, emitted = self._last(state, c, "")
        seen = window + c
        ends = (*((t, n - emitted) for t, n in ends), (token, 0))
        keep = next((n for n in range(len(seen), 0, -1) if seen[-n:] in self.prefixes), 0)
        key = (seen[len(seen) - keep :], ends[len(seen) - keep :])
        to = self.ids.get(key)
        if to is None:
            to = self.ids[key] = len(self.keys)
            self.keys.append(key)
            self.next.append({})
            self.close.append({})
        self.next[state][c] = (to, emitted)
        return to, emitted

    def count(self, word: str) -> int:
        if len(self.keys) > MOST_STATES:
            self.reset()
        state, total = 0, 0
        steps = self.next
        for c in word[:-1]:
            go = steps[state].get(c) or self.step(state, c)
            state = go[0]
            total += go[1]
        close = self.close[state]
        last = word[-1]
        if last not in close:
            close[last] = self._last(state, last, _CLOSED)[1]
        return total + close[last]


class Tokenizer:
    """Counts the tokens of stretches of text without white space, and of texts."""

    def __init__(self, source: str):
        with open(located(source)) as file:
            spec = json.load(file)
        model, pre = spec["model"], spec["pre_tokenizer"]["pretokenizers"]
        if model["type"] != "BPE" or model["end_of_word_suffix"] != _CLOSED or [n["type"] for n in spec["normalizer"]["normalizers"]] != ["NFC", "Replace", "Lowercase"]:
            raise ValueError(f"{source}: not a lower-casing BPE vocabulary with word ends")
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.transducer = Transducer(set(model["vocab"]), pairs)
        pattern = pre[0]["pattern"]["Regex"].replace("\\s", _WHITE)
        self.pieces = regex.compile(pattern)
        self.special = regex.compile("|".join(regex.escape(t["content"]) for t in spec["added_tokens"]))
        self.names = dict(enumerate(byte_names()))
        self.white = regex.compile(f"[{_WHITE}]+")
        self.known = (np.zeros(0, np.uint64), np.zeros(0, np.int32))
        self.counts: dict[str, int] = {}

    def piece(self, text: str) -> int:
        """Tokens of one piece of lower-case text."""
        n = self.counts.get(text)
        if n is None:
            if len(self.counts) > MOST_PIECES:
                self.counts.clear()
            name = text if text.isascii() and text.isprintable() else text.encode().decode("latin-1").translate(self.names)
            n = self.counts[text] = self.transducer.count(name)
        return n

    def stretch(self, text: str) -> int:
        if text.isascii() and text.isalpha():  # one word
            return self.piece(text.lower())
        found = len(self.special.findall(text)) if "<|" in text else 0
        for part in self.special.split(text) if found else (text,):
            part = self.white.sub(" ", unicodedata.normalize("NFC", part))
            part = "".join(c.lower() for c in part) if "Σ" in part else part.lower()
            for piece in self.pieces.findall(part):
                found += self.piece(piece)
        return found

    def words(self, words: Words) -> np.ndarray:
        """Tokens of each word of a scan. Words not met before go through the transducer, once each."""
        h, at, inverse = np.unique(words.hash, return_index=True, return_inverse=True)
        keys, counts = self.known
        place = np.searchsorted(keys, h)
        place[place == len(keys)] = 0
        old = keys[place] == h if len(keys) else np.zeros(len(h), bool)
        out = np.zeros(len(h), np.int32)
        out[old] = counts[place[old]]
        new = np.flatnonzero(~old)
        start, end, data = words.start, words.end, words.data
        out[new] = [self.stretch(data[start[i] : end[i]].tobytes().decode()) for i in at[new].tolist()]
        keys, counts = (h, out) if len(keys) > MOST_WORDS else (np.r_[keys, h[new]], np.r_[counts, out[new]])
        order = np.argsort(keys)
        self.known = keys[order], counts[order]
        return out[inverse]

    def texts(self, texts: pa.Array) -> np.ndarray:
        words = scan(texts, lower=False)
        return np.diff(np.r_[0, np.cumsum(self.words(words))][words.first])


def compiled(source: str) -> Tokenizer:
    """The tokenizer of this worker process, which keeps what it has compiled from task to task."""
    kept = sys.modules.setdefault("_retailflow_compiled", ModuleType("_retailflow_compiled")).__dict__
    if source not in kept:
        kept[source] = Tokenizer(source)
    return kept[source]


def located(source: str) -> str:
    """A vocabulary's file: a path, or a name that the package of public vocabularies knows."""
    if os.path.exists(source):
        return source
    import public_tokenizers

    return public_tokenizers.path(source)


def cut(data: bytes, chunk: int) -> list[bytes]:
    """The text in chunks of at most `chunk` bytes, not cut within a character."""
    out, at = [], 0
    while len(data) - at > chunk:
        end = at + chunk
        while data[end] & 0xC0 == 0x80:
            end -= 1
        out.append(data[at:end])
        at = end
    return [*out, data[at:]]


#: A state map: open (no white space: all is head), head, count of the stretches between, tail.
Map = tuple[bool, bytes, int, bytes]


def ends(data: bytes) -> tuple[bool, bytes, bytes, bytes]:
    """open, head, middle, tail of a chunk."""
    first = next((i for i, b in enumerate(data) if b in _SPACE_BYTES), -1)
    if first < 0:
        return True, data, b"", b""
    last = next(i for i in range(len(data) - 1, -1, -1) if data[i] in _SPACE_BYTES)
    return False, data[:first], data[first : last + 1], data[last + 1 :]


def composed(count, a: Map, b: Map) -> Map:
    if a[0]:
        return b[0], a[1] + b[1], b[2], b[3]
    if b[0]:
        return False, a[1], a[2], a[3] + b[1]
    return False, a[1], a[2] + count(a[3] + b[1]) + b[2], b[3]


_CHUNK_ROW = "row long, doc_id {kind}, n_bytes long, chunks int, chunk_no int"
_MAP = "open boolean, head binary, count long, tail binary"


def counted(docs: DataFrame, source: str, chunk: int = CHUNK) -> DataFrame:
    """doc_id, n_bytes, n_tokens of every document."""
    spark, kind = docs.sparkSession, docs.schema["doc_id"].dataType.simpleString()
    bounded_batches(spark)
    docs = renamed(docs, ["doc_id", "text"]).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.withColumn("n_bytes", F.octet_length("text").cast("long"))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = compiled(source)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(tokenizer.texts(batch.column(1)), pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    short = docs.where(F.col("n_bytes") <= chunk).mapInArrow(whole, f"doc_id {kind}, n_bytes long, n_tokens long")
    long = docs.where(F.col("n_bytes") > chunk).withColumn("row", F.monotonically_increasing_id())
    return short.unionByName(_long(long, source, chunk, kind))


def _long(docs: DataFrame, source: str, chunk: int, kind: str) -> DataFrame:
    head = _CHUNK_ROW.format(kind=kind)
    names = ["row", "doc_id", "n_bytes", "chunks", "chunk_no"]

    def cuts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                parts = cut(row["text"][0].as_buffer().to_pybytes(), chunk)
                n = len(parts)
                for at in range(0, n, 64):
                    some = parts[at : at + 64]
                    same = lambda name, k=len(some), row=row: pa.concat_arrays([row[name]] * k)
                    yield pa.RecordBatch.from_arrays([same("row"), same("doc_id"), same("n_bytes"), pa.array([n] * len(some), pa.int32()),
                                                      pa.array(range(at, at + len(some)), pa.int32()), pa.array(some, pa.binary())], [*names, "part"])

    def maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = compiled(source)
        for batch in batches:
            found = [ends(part) for part in batch["part"].to_pylist()]
            counts = tokenizer.texts(pa.array([f[2].decode() for f in found], pa.string()))
            columns = [pa.array([f[0] for f in found]), pa.array([f[1] for f in found], pa.binary()), pa.array(counts, pa.int64()), pa.array([f[3] for f in found], pa.binary())]
            yield pa.RecordBatch.from_arrays([*(batch[n] for n in names), *columns], [*names, "open", "head", "count", "tail"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = compiled(source)
        count = lambda data: tokenizer.stretch(data.decode())
        for batch in batches:
            own = [tuple(x[k] for k in ("open", "head", "count", "tail")) for x in batch["own"].to_pylist()]
            before = [x and tuple(x[k] for k in ("open", "head", "count", "tail")) for x in batch["before"].to_pylist()]
            got = [composed(count, b, o) if b else o for b, o in zip(before, own, strict=True)]
            columns = [pa.array([g[0] for g in got]), pa.array([g[1] for g in got], pa.binary()), pa.array([g[2] for g in got], pa.int64()), pa.array([g[3] for g in got], pa.binary())]
            yield pa.RecordBatch.from_arrays([*(batch[n] for n in names), *columns], [*names, "open", "head", "count", "tail"])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = compiled(source)
        for batch in batches:
            n = [m["count"] + tokenizer.stretch(m["head"].decode()) + tokenizer.stretch(m["tail"].decode()) for m in batch["own"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["n_bytes"], pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    parts = docs.mapInArrow(cuts, f"{head}, part binary")
    state = written(parts.repartition(max(8, parts.sparkSession.sparkContext.defaultParallelism), "row", "chunk_no").mapInArrow(maps, f"{head}, {_MAP}"), "token-maps")
    own = F.struct("open", "head", "count", "tail")
    most, step = state.agg(F.max("chunks")).first()[0] or 1, 1
    while step < most:
        before = F.lag(own, step).over(W.partitionBy("row").orderBy("chunk_no"))
        state = state.select(*names, own.alias("own"), before.alias("before")).mapInArrow(join, f"{head}, {_MAP}")
        step *= 2
    return state.where("chunk_no = chunks - 1").select("doc_id", "n_bytes", own.alias("own")).mapInArrow(total, f"doc_id {kind}, n_bytes long, n_tokens long")
