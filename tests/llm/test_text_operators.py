"""Words, exact duplicates, token counts, language model, n-gram join."""

import math
import re
import time
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from retailflow.llm import common, exact_dedup, language_model, ngram_join, tokens, words

WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = {c: c + 32 for c in range(65, 91)}
TEXT = st.text(st.sampled_from("abAB éÉΣß中́\t\n\x0b.'s<|>"), max_size=40)
SCHEMA = "doc_id long, text string, hash string, node long, row int"  # the last three clash with names inside


def table(rows, texts):
    return rows([(i, t, "x", 7, 1) for i, t in texts], SCHEMA)


def as_dict(frame, *columns):
    return {r["doc_id"]: tuple(r[c] for c in columns) for r in frame.collect()}


@settings(max_examples=50, deadline=None)
@given(st.lists(st.none() | TEXT, max_size=8))
def test_words_are_those_of_the_pattern(texts):
    found = words.scan(pa.array(texts, pa.string()))
    want = [WORD.findall((t or "").translate(LOWER)) for t in texts]
    assert np.diff(found.first).tolist() == [len(w) for w in want]
    flat = [w for t in want for w in t]
    names = dict(zip(flat, found.hash.tolist(), strict=True))
    assert [names[w] for w in flat] == found.hash.tolist()
    assert len(set(names.values())) == len(names)


def test_a_word_longer_than_a_piece_is_one_word():
    long = "x" * (2 * words.PIECE + 5)
    found = words.scan(pa.array([f"a {long} b", long]))
    assert np.diff(found.first).tolist() == [3, 1]
    assert found.hash[1] == found.hash[3]


# exact duplicates


def brute_groups(texts):
    by = {}
    for i, t in texts:
        by.setdefault(re.sub("[\x20\x09-\x0d]", "", t or ""), []).append((-len(t or ""), i))
    return {i: (min(g)[1], len(g), i == min(g)[1]) for g in by.values() for _, i in g}


EQUAL = [(1, "a b"), (2, "ab"), (3, " a\tb "), (4, ""), (5, None), (6, " "), (7, "abc"), (8, "A b"), (9, "ab"), (10, "é" * 5000), (11, "a b ")]


@pytest.mark.parametrize("hashed", [exact_dedup.content_hash, lambda normal: F.length(normal).cast("string")])
def test_equal_texts_also_when_hashes_collide(rows, hashed):
    got = as_dict(exact_dedup.groups(table(rows, EQUAL), hashed), "keep_id", "group_size", "kept")
    assert got == brute_groups(EQUAL)


def test_exact_dedup_of_repeated_rows_null_ids_and_no_rows(rows):
    docs = table(rows, [(1, "x"), (1, "x"), (None, "x"), (None, "y")])
    got = sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.groups(docs).collect()), key=repr)
    assert got == sorted([(1, 1, 3, True), (1, 1, 3, True), (None, 1, 3, False), (None, None, 1, True)], key=repr)
    kept = exact_dedup.deduplicated(docs)
    assert kept.columns == docs.columns
    assert sorted((r.text, r.hash, r.node) for r in kept.collect()) == [("x", "x", 7), ("y", "x", 7)]
    assert exact_dedup.groups(table(rows, [])).count() == 0


def test_exact_dedup_of_any_kind_of_id(spark, rows):
    least = -(1 << 63)
    got = as_dict(exact_dedup.groups(rows([(least, "a b"), (0, "ab"), (1, "ab ")], "doc_id long, text string")), "keep_id", "group_size", "kept")
    assert got == {least: (least, 3, True), 0: (least, 3, False), 1: (least, 3, False)}
    got = as_dict(exact_dedup.groups(rows([("x", "ab"), ("w", "a b"), ("v", "ab")], "doc_id string, text string")), "keep_id", "kept")
    assert got == {"x": ("w", False), "w": ("w", True), "v": ("w", False)}


def test_the_longest_of_repeated_ids_stays(rows):
    texts = ["a b", "ab", " a  b ", "a \tb", "a\nb", "ab    "]
    for order in (texts, texts[::-1], texts[3:] + texts[:3]):
        docs = table(rows, [(i, t) for t in order for i in (4, 9)] + [(2, None), (2, ""), (None, "x"), (None, "x ")])
        got = sorted(((r.doc_id, r.text) for r in exact_dedup.deduplicated(docs).collect()), key=repr)
        longest = [t for t in texts if len(t) == 6]
        assert len(got) == 3 and got[1] == (4, got[1][1]) and got[1][1] in longest
        assert got[0] == (2, "") and got[2] == (None, "x ")
        assert order == texts or got == before
        before = got


# token counts


@pytest.fixture(scope="module")
def tokenizer():
    return tokens.Tokenizer("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.located("word_bpe_49k.json"))


def lengths(library, texts):
    return [len(e.ids) for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(max_size=30) | TEXT | st.sampled_from(["<|endoftext|>x", "I'LL don't", "<|ENDOFTEXT|>"]), max_size=6))
def test_token_counts_are_the_librarys(tokenizer, library, texts):
    assert tokenizer.texts(pa.array(texts, pa.string())).tolist() == lengths(library, texts)


def test_token_counts_when_compiled_states_are_dropped(library, monkeypatch):
    monkeypatch.setattr(tokens, "MOST_STATES", 20)
    monkeypatch.setattr(tokens, "MOST_PIECES", 5)
    monkeypatch.setattr(tokens, "MOST_WORDS", 5)
    texts = ["international commercialization of straightforwardness", "unbelievable things, happening"] * 3
    assert tokens.Tokenizer("word_bpe_49k.json").texts(pa.array(texts)).tolist() == lengths(library, texts)


def test_chunks_compose_to_whole_texts(rows, library):
    texts = ["", None, " ", "word " * 50, "é中" * 80, "a" * 300 + " b " + "c'll " * 30, "<|endoftext|>" * 9, "x́ y" * 40]
    got = as_dict(tokens.counted(table(rows, list(enumerate(texts))), "word_bpe_49k.json", chunk=16), "n_bytes", "n_tokens")
    assert got == {i: (len((t or "").encode()), n) for i, (t, n) in enumerate(zip(texts, lengths(library, texts), strict=True))}
    assert tokens.counted(table(rows, []), "word_bpe_49k.json").count() == 0


# language model


def brute_model(texts):
    runs = [[None, *WORD.findall((t or "").translate(LOWER)), 0] for t in texts]
    c = Counter(p for r in runs for p in zip(r, r[1:], strict=False))
    k, total, follow = Counter(v for _, v in c), Counter(), {}
    for (u, v), n in c.items():
        total[u] += n
        follow.setdefault(u, []).append(n)
    uni = Counter(v for r in runs for v in r[1:])

    def rates(counts):
        n = Counter(counts)
        return language_model.discounts([n[i] for i in (1, 2, 3, 4)])

    d, e = rates(c.values()), rates(k.values())
    less = lambda n, x: max(0, n - x[min(n, 3) - 1]) if n else 0
    types, freed = sum(k.values()), sum(min(n, n - less(n, e)) for n in k.values())
    low = lambda v: less(k[v], e) / types + freed / types / (len(uni) + 1)

    def p(v, u):
        if u not in total:
            return low(v)
        back = sum(n - less(n, d) for n in follow[u]) / total[u]
        return less(c[u, v], d) / total[u] + back * low(v)

    return p, uni


def test_model_equals_a_plain_one_and_adds_up_to_one(rows):
    train = ["a b a b c", "a b d", "b b B c a", None, "", "e f", "a b a b c", "the cat the dog the cow"] * 2 + ["g h i", "h i j"]
    ask = ["a b zz c", "zz zz", "", None, "the cat", "g"]
    model = language_model.fit(table(rows, list(enumerate(train))))
    got = as_dict(language_model.scored(table(rows, list(enumerate(ask))), model), "n_tokens", "n_known", "base_score", "score")
    p, uni = brute_model(train)
    n = sum(uni.values())
    assert (model.tokens, model.distinct) == (n, len(uni))
    for i, t in enumerate(ask):
        run = [None, *WORD.findall(t or ""), 0]
        base = sum(math.log10((uni[v] + 0.1) / (n + 0.1 * (len(uni) + 1))) for v in run[1:])
        want = sum(math.log10(p(v, u)) for u, v in zip(run, run[1:], strict=False))
        assert got[i][:2] == (len(run) - 1, sum(v in uni for v in run[1:]))
        assert got[i][2:] == pytest.approx((base, want))
    for u in ("a", "zz", None):
        assert sum(p(v, u) for v in [*uni, "unknown"]) == pytest.approx(1)


def brute_order(texts, order):
    """p(v, h) by the recursion itself, over tuples."""
    grams, raw = Counter(), Counter()
    for t in texts:
        run = [None] * (order - 1) + [*WORD.findall((t or "").translate(LOWER)), 0]
        grams.update(tuple(run[i - order + 1 : i + 1]) for i in range(order - 1, len(run)))
        raw.update(run[order - 1 :])
    levels = {order: grams}
    for n in range(order - 1, 0, -1):
        levels[n] = Counter(g[1:] for g in levels[n + 1])
    rates = {n: language_model.discounts([list(c.values()).count(i) for i in (1, 2, 3, 4)]) for n, c in levels.items()}

    def p(v, h):
        c, d = levels[len(h) + 1], rates[len(h) + 1]
        after = {g[-1]: n for g, n in c.items() if g[:-1] == h}
        low = 1 / (len(raw) + 1) if not h else p(v, h[1:])
        if not after:
            return low
        cut = {w: min(n, d[min(n, 3) - 1]) for w, n in after.items()}
        return (after.get(v, 0) - cut.get(v, 0) + sum(cut.values()) * low) / sum(after.values())

    return p, raw


@pytest.mark.parametrize("order", [2, 3, 4])
def test_model_of_each_order_equals_the_recursion(rows, order):
    train = ["a b a b c", "a b d", "b b B c a", None, "", "e f", "the cat the dog the cow", "a b a b d"] * 2 + ["g h i", "h i j"] + ["a a a"] * 300
    ask = ["a b a b c", "a b zz c", "zz zz", "", None, "the cat the", "a a a a", "g h j"]
    model = language_model.fit(table(rows, list(enumerate(train))), order)
    got = as_dict(language_model.scored(table(rows, list(enumerate(ask))), model), "score")
    p, raw = brute_order(train, order)
    for i, t in enumerate(ask):
        run = [None] * (order - 1) + [*WORD.findall(t or ""), 0]
        want = sum(math.log10(p(run[j], tuple(run[j - order + 1 : j]))) for j in range(order - 1, len(run)))
        assert got[i] == pytest.approx((want,))
    for h in (("a", "b", "a"), ("zz", "a", "b"), (None, None, None)):
        assert sum(p(v, h[3 - order + 1 :]) for v in [*raw, "unknown"]) == pytest.approx(1)


def test_model_of_no_rows_and_counts_above_a_byte(rows):
    empty = language_model.fit(table(rows, []))
    assert as_dict(language_model.scored(table(rows, [(1, "a")]), empty), "n_known", "score") == {1: (0, 0.0)}
    model = language_model.fit(table(rows, [(i, "a a") for i in range(400)]))
    p, _ = brute_model(["a a"] * 400)
    want = math.log10(p("a", None)) + math.log10(p("a", "a")) + math.log10(p(0, "a"))
    assert as_dict(language_model.scored(table(rows, [(1, "a a")]), model), "score")[1] == pytest.approx((want,))


@settings(max_examples=50, deadline=None)
@given(st.integers(0, 1 << 30), st.integers(1, 4), st.integers(0, 400))
def test_packed_rows_and_sorted_arrays_keep_everything(seed, columns, n):
    random = np.random.default_rng(seed)
    grams = [random.integers(0, 1 << 32, 50).astype(np.uint32)[random.integers(0, 50, n)] for _ in range(columns)]
    values = [random.choice([0, 1, 2, 300, 1 << 40], n) for _ in range(3)]
    if n:
        got = language_model.unpacked(language_model.packed(grams, values), columns, 3)
        assert sorted(zip(*(x.tolist() for x in got), strict=True)) == sorted(zip(*(x.tolist() for x in (*grams, *values)), strict=True))
    keys = np.unique(random.integers(0, (1 << 64) - 1, n, dtype=np.uint64))
    others = random.integers(0, (1 << 64) - 1, 50, dtype=np.uint64)
    at, there = language_model._found(language_model._keys(keys), np.r_[others, keys])
    assert (there >= 50).all() and at.tolist() == list(range(len(keys)))


def test_few_maps_and_null_ids(rows, monkeypatch):
    monkeypatch.setattr(language_model, "MAPS", 2)
    texts = [(None, "a b c"), (1, "a b c"), (1, "a b c"), (2, None), (None, "x y")]
    model = language_model.fit(table(rows, texts), 3)
    got = sorted(((r.doc_id, r.n_tokens, r.n_known, round(r.score, 9)) for r in language_model.scored(table(rows, texts), model).collect()), key=repr)
    assert len(got) == 5 and got[0] == got[1] and got[2][:3] == (2, 1, 1)
    assert got[4][3] == got[0][3]


def test_language_model_beats_the_base_on_held_out_texts(spark):
    from retailflow.llm.queries import QUERIES

    got = QUERIES["op1_language_model"](spark, "/root/testdata/sf0.001").where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > got[1]


# n-gram join


def brute_sets(texts):
    sets = {}
    for i, t in texts:
        w = WORD.findall((t or "").translate(LOWER))
        sets[i] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
    return sets


def brute_clusters(texts):
    sets = brute_sets(texts)
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sorted(sets):
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}


def edited(random, base, edits):
    out = list(base)
    for _ in range(edits):
        at = int(random.integers(len(out)))
        out[at : at + int(random.integers(2))] = [f"n{random.integers(10**6)}"] * int(random.integers(2))
    return out or ["x"]


def family_texts():
    random = np.random.default_rng(1)
    texts = [(0, None), (1, ""), (2, "Only Two"), (3, "only two"), (4, "a b c d e"), (5, "a b c d f")]
    for size in (5, 8, 9, 12, 30, 80, 200):
        base = [f"w{x}" for x in random.integers(0, 60, size)]
        texts += [(len(texts) + j, " ".join(edited(random, base, int(random.integers(0, 1 + size // 40 + 1))))) for j in range(9)]
    # A chain: neighbours are similar, the ends are not.
    chain = [f"c{x}" for x in range(60)]
    texts += [(len(texts) + j, " ".join(chain[j * 3 : j * 3 + 40])) for j in range(6)]
    # A family whose members are just below and above the bound to one another.
    base = [f"f{x}" for x in range(120)]
    return texts + [(len(texts) + j, " ".join(edited(random, base, 3))) for j in range(40)]


@pytest.mark.parametrize(("frequent", "most", "nodes"), [(256, 16, 2000), (3, 16, 5), (3, 2, 5)])
def test_clusters_of_near_copies(rows, monkeypatch, frequent, most, nodes):
    monkeypatch.setattr(ngram_join, "FREQUENT", frequent)
    monkeypatch.setattr(ngram_join, "MOST_BLOCKS", most)
    monkeypatch.setattr(ngram_join, "LEADERS", 1)
    monkeypatch.setattr(ngram_join, "BLOCK_NODES", nodes)
    texts = family_texts()
    assert as_dict(ngram_join.clusters(table(rows, texts)), "n_shingles", "component_id") == brute_clusters(texts)


def test_links_and_their_numbers(rows):
    texts = family_texts()
    pairs, documents = ngram_join.links(table(rows, texts))
    sets = brute_sets(texts)
    similar = lambda a, b: 100 * len(a & b) >= 80 * len(a | b)
    want = {i: sum(j != i and bool(sets[i]) and bool(sets[j]) and similar(sets[i], sets[j]) for j in sets) for i in sets}
    got = as_dict(ngram_join.with_links(table(rows, texts)), "n_shingles", "n_links")
    assert got == {i: (len(sets[i]), n) for i, n in want.items()}
    node = {r.doc_id: r.node for r in documents.collect()}
    linked = {(r.a, r.b) for r in pairs.collect()}
    assert linked == {tuple(sorted((node[i], node[j]))) for i in sets for j in sets if node[i] != node[j] and sets[i] and sets[j] and similar(sets[i], sets[j])}
    assert pairs.count() == len(linked) > 50


def test_blocks_pass_on_no_more_than_a_spanning_forest(rows, monkeypatch):
    random = np.random.default_rng(2)
    base = np.arange(300)
    sets = [np.sort(np.unique(np.r_[random.choice(base, 280, False), 1000 + random.integers(0, 3000, random.integers(0, 60))])) for _ in range(120)]
    some = np.arange(120) % 3
    for left, right in ((some == 0, some == 0), (some == 0, some == 1), (some >= 0, some >= 0)):
        component = np.arange(120) // 2  # known so far
        found = ngram_join.spanning(sets, component.copy(), left, right, 80)
        similar = [(i, j) for i in np.flatnonzero(left) for j in np.flatnonzero(right)
                   if i != j and 100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j]))]
        assert set(found) <= {*similar} and 0 < len(found) < 120 < len(similar)

        def roots(pairs, component=component):
            root = component.copy()
            for a, b in pairs:
                root[root == root[b]] = root[a]
            return [int(np.flatnonzero(root == r)[0]) for r in root]

        assert roots(found) == roots(similar)


def test_clusters_of_repeated_rows_null_ids_and_no_rows(rows):
    docs = table(rows, [(5, "a b c d e f"), (5, "a b c d e f"), (None, "a b c d e f"), (None, "z"), (None, "")])
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.clusters(docs).collect()), key=repr)
    assert got == sorted([(5, 2, 5), (5, 2, 5), (None, 2, 5), (None, 1, None), (None, 0, None)], key=repr)
    assert ngram_join.clusters(table(rows, [])).count() == 0
    kept = ngram_join.deduplicated(docs)
    assert kept.columns == docs.columns


def test_survivors_of_components_with_repeated_and_null_ids(rows):
    a, b, c = "a b c d e f", "p q r s t u", "k l m n o"
    docs = table(rows, [(5, a), (5, a), (None, a), (None, "z"), (None, ""), (None, ""), (None, None), (7, b), (7, c), (9, c), (8, " "), (6, ""), (3, "Z"), (None, "only null"), (None, "only  null")])
    got = sorted(((r.doc_id, r.text) for r in ngram_join.deduplicated(docs).collect()), key=repr)
    nulls = [x for x in got if x[1] in ("only null", "only  null")]
    assert len(nulls) == 1  # one set, no id to choose by
    assert [x for x in got if x not in nulls] == sorted([(5, a), (None, ""), (None, None), (7, b), (7, c), (8, " "), (6, ""), (3, "Z")], key=repr)
    assert sorted(((r.doc_id, r.text) for r in ngram_join.deduplicated(docs.repartition(3)).collect()), key=repr) == got


@settings(max_examples=300, deadline=None)
@given(st.integers(1, 400), st.integers(0, 400), st.integers(0, 10**6))
def test_linked_sets_share_a_key(size, differ, seed):
    random = np.random.default_rng(seed)
    join = ngram_join.Join()
    both = random.integers(0, 1 << 63, size).astype(np.uint64)
    x = np.concatenate([both, random.integers(0, 1 << 63, differ // 2).astype(np.uint64)])
    y = np.concatenate([both, random.integers(0, 1 << 63, differ - differ // 2).astype(np.uint64)])
    if 100 * size < 80 * (len(x) + len(y) - size) or not differ:
        return
    found = ngram_join.keys(ngram_join.Sets(np.r_[x, y], np.array([0, len(x), len(x) + len(y)])), join)
    shared = set(found.key[found.row == 0].tolist()) & set(found.key[found.row == 1].tolist())
    assert shared
    # And as many as each is said to need in one of its bands.
    for row in (0, 1):
        need = found.need[found.need_row == row]
        assert any(sum(k in shared for k in found.key[(found.row == row) & (found.lower == lower)].tolist()) >= n
                   for n, lower in zip(need.tolist(), found.need_lower[found.need_row == row].tolist(), strict=True))


def test_a_batch_looks_each_level_of_ngrams_up_once(rows, monkeypatch):
    texts = [(1, "a b c a b"), (2, "a b d"), (3, None)]
    model = language_model.fit(table(rows, texts), 4)
    asked, grams = [], language_model.Lookup.grams

    def counted(self, columns, kinds):
        asked.append(len(columns))
        return grams(self, columns, kinds)

    monkeypatch.setattr(language_model.Lookup, "grams", counted)
    language_model.scores(language_model.Lookup(model), pa.array([t for _, t in texts]))
    assert asked == [2, 3, 4]


def test_packed_rows_lie_in_the_order_of_their_numbers():
    grams = [np.array(x, np.uint32) for x in ([9, 2, 2, 9, 0], [1, 8, 3, 0, 7], [5, 5, 6, 1, 2])]
    wide = [grams[0], grams[1] + np.uint32((1 << 32) - 100), grams[2] + np.uint32((1 << 32) - 100)]  # more than 64 bits in all
    for columns in (grams, wide):
        got = language_model.unpacked(language_model.packed(columns, [np.ones(5, np.int64)]), 3, 1)
        assert list(zip(*(x.tolist() for x in got[:3]), strict=True)) == sorted(zip(*(x.tolist() for x in columns), strict=True))


def test_rows_of_ngrams_are_summed_where_they_are_sorted():
    random = np.random.default_rng(5)
    for size in (1 << 10, 1 << 32):  # 30 and 96 bits
        kinds = random.integers(size // 2, size, (3, 20)).astype(np.uint32)
        columns, values = list(kinds[:, random.integers(0, 20, 300)]), [random.integers(0, 9, 300), np.full(300, 1 << 40)]
        *grams, first, second = (x.tolist() for x in language_model.unpacked(language_model.packed(columns, values, add=True), 3, 2))
        want = {}
        for *gram, a, b in zip(*(x.tolist() for x in (*columns, *values)), strict=True):
            x, y = want.get(tuple(gram), (0, 0))
            want[tuple(gram)] = x + a, y + b
        assert list(zip(zip(*grams, strict=True), zip(first, second, strict=True), strict=True)) == sorted(want.items())


def test_hashes_of_pairs_are_one_to_one_and_shards_even():
    a, b = (x.ravel().astype(np.uint32) for x in np.meshgrid(np.arange(300), np.r_[np.arange(300), (1 << 32) - np.arange(1, 300)]))
    key = language_model.hashed([a, b])
    assert len(np.unique(key)) == len(key)
    for keys in (key, np.arange(100, 20_000, dtype=np.uint64)):
        dealt = np.bincount(language_model._shard(keys, 96), minlength=96)
        assert len(dealt) == 96 and dealt.min() > 0.75 * len(keys) / 96 and dealt.max() < 1.25 * len(keys) / 96


def test_a_task_takes_the_texts_of_a_batch_apart_piece_by_piece(monkeypatch):
    random = np.random.default_rng(3)
    texts = [None, "", *(" ".join(map(str, random.integers(0, 1000, random.integers(1, 300)))) for _ in range(60)), "w " * 2000, None]
    batch = pa.RecordBatch.from_arrays([pa.array(texts + texts, pa.string())], ["text"])
    whole = ngram_join._batch_keys(batch, ngram_join.Join())
    monkeypatch.setattr(common, "PIECE_BYTES", 1000)
    got = list(common.pieces([batch, batch.slice(0, 0)]))
    assert pa.Table.from_batches(got)["text"].to_pylist() == texts + texts
    assert len(got) > 20 and all(pc.sum(pc.binary_length(piece["text"][:-1])).as_py() < 1000 for piece in got if piece.num_rows > 1)
    for a, b in zip(whole, ngram_join._batch_keys(batch, ngram_join.Join()), strict=True):
        assert sorted(a.tolist()) == sorted(b.tolist())


def test_the_sets_of_a_batch_of_full_size_take_little_memory():
    batch = pa.RecordBatch.from_arrays([pa.array([" ".join(map(str, range(i, i + 400))) for i in range(0, 400_000, 100)])], ["text"])
    assert batch.nbytes > common.BATCH_BYTES
    tracemalloc.start()
    ngram_join._batch_keys(batch, ngram_join.Join())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100 << 20


def test_written_tables_leave_no_shuffle_files(spark):
    def files():
        found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")
        return {x.split("/")[-1] for x in found.splitlines()}

    before = files()
    sums = common.written(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "spent")
    for _ in range(50):
        left = {f for f in files() - before if f.startswith("shuffle_")}
        if not left:
            break
        time.sleep(0.1)
    assert not left and sums.count() == 7


def test_ngram_dedup_deals_texts_out_once(spark, rows, no_small_joins):
    texts = ["a b c d e f g", "a b c d e f g", "x y", "", ""]
    docs = rows([(1, texts[0]), (2, texts[1]), (None, texts[2]), (None, texts[2]), (3, texts[3]), (3, texts[4])], "doc_id long, text string")
    found = ngram_join.deduplicated(docs)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\((coalesce\()?id#", plan)
    assert sorted((tuple(r) for r in found.collect()), key=repr) == [(1, texts[0]), (3, ""), (None, "x y")]


@pytest.fixture
def no_small_joins(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
