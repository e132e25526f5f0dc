"""Line dedup, hard negatives, token alignment against brute force."""

import hashlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from retailflow.llm import alignment, common, cuckoo, line_dedup, negatives

SPACES = " \t\n\x0b\x0c\r"
LOWER = {c: c + 32 for c in range(65, 91)}


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# cuckoo filters


def some_keys(n, seed):
    return np.random.default_rng(seed).integers(-(1 << 63), (1 << 63) - 1, (n, 2))


def test_a_filter_finds_what_it_holds_and_forgets_what_is_deleted():
    keys, others = some_keys(5000, 1), some_keys(20000, 2)
    made = cuckoo.built(keys)
    assert made.has(keys).all() and made.has(others).mean() < 0.002
    made = cuckoo.Cuckoo(made.bits())
    made.delete(keys[:2500])
    assert made.has(keys[2500:]).all() and made.has(keys[:2500]).mean() < 0.01
    made.insert(keys[:2500])
    assert made.has(keys).all()
    made.delete(keys)
    assert not made.table.any()


def test_a_full_filter_says_so_and_is_built_larger():
    made = cuckoo.Cuckoo.sized(8)
    with pytest.raises(cuckoo.Full):
        made.insert(some_keys(2000, 3))
    same = np.repeat(some_keys(1, 4), 8, axis=0)  # as many as two buckets hold
    assert cuckoo.built(same).has(same).all()
    assert not cuckoo.built(same[:0]).has(same).any()


# lines


def brute_lines(texts, judged=None, least=3, shortest=1):
    split = lambda t: (t or "").split("\n")
    key = lambda line: line.strip(SPACES).translate(LOWER)
    held = Counter(k for _, t in texts for k in {key(x) for x in split(t)})
    drop = lambda line: len(key(line)) >= shortest and held[key(line)] >= least
    return sorted(((i, "\n".join(x for x in split(t) if not drop(x)), len(split(t)), sum(map(drop, split(t)))) for i, t in (judged or texts)), key=repr)


LINES = ["Head", " head\t", "x", "é É", "", "  ", "foot", "FOOT ", "a b", "\x0b", "one", "İ"]
TEXTS = [(i, "\n".join(LINES[(i * 7 + j * j) % len(LINES)] for j in range(i % 9))) for i in range(40)] + \
    [(None, "Head\nown"), (None, None), (3, "head"), (3, "head"), (90, None), (91, ""), (92, "\n\n"), (93, "foot\n" + "long " * 40000 + "\nhead")]
LINE_SCHEMA = "doc_id long, text string, h1 string, i1 int, documents int"  # the last three clash with names inside


def line_table(rows, texts):
    return rows([(i, t, "x", 1, 2) for i, t in texts], LINE_SCHEMA)


def as_rows(frame):
    return sorted(((r.doc_id, r.kept_text, r.n_lines, r.n_dropped) for r in frame.collect()), key=repr)


@pytest.mark.parametrize("keys_in_tasks", [line_dedup.KEYS_IN_TASKS, 0])
def test_lines_that_many_documents_share_go(spark, rows, keys_in_tasks):
    rule = line_dedup.Rule(3)
    docs = line_table(rows, TEXTS)
    index = line_dedup.LineIndex.empty(spark, rule).inserted(docs)
    assert as_rows(line_dedup.judged(docs, index, keys_in_tasks=keys_in_tasks)) == brute_lines(TEXTS)


def test_a_shortest_key_and_no_rows(spark, rows):
    rule = line_dedup.Rule(3, 4)
    docs = line_table(rows, TEXTS)
    assert as_rows(line_dedup.judged(docs, line_dedup.LineIndex.empty(spark, rule).inserted(docs))) == brute_lines(TEXTS, shortest=4)
    assert line_dedup.digests(line_table(rows, [])).count() == 0


def test_documents_come_and_go(spark, rows, monkeypatch):
    monkeypatch.setattr(line_dedup, "KEYS_A_SHARD", 8)  # more shards as keys come
    rule, docs = line_dedup.Rule(3), line_table(rows, TEXTS)
    index, held = line_dedup.LineIndex.empty(spark, rule), []
    steps = [("in", TEXTS[:20]), ("in", TEXTS[20:]), ("out", TEXTS[5:30]), ("in", TEXTS[5:10]), ("out", TEXTS[:5] + TEXTS[40:44])]
    for step, texts in steps:
        index = index.inserted(line_table(rows, texts)) if step == "in" else index.deleted(line_table(rows, texts))
        held = held + texts if step == "in" else [x for x in held if x not in texts]
        assert as_rows(line_dedup.judged(docs, index)) == brute_lines(held, TEXTS)
    assert index.shards > 1
    # Documents that the index does not hold, or holds fewer of, take nothing away.
    before = sorted(map(tuple, index.counts.collect()))
    assert sorted(map(tuple, index.deleted(line_table(rows, [(500, "head"), (0, "never")] * 2)).counts.collect())) == before
    gone = index.deleted(line_table(rows, held + held))
    assert gone.counts.count() == gone.present.count() == 0
    assert as_rows(line_dedup.judged(docs, gone)) == brute_lines([], TEXTS)


def test_digests(rows):
    texts = [(i, f"same\nown {i}") for i in range(10)] + [(10, "other")]
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.kept_sha256) for r in line_dedup.digests(line_table(rows, texts)).collect()}
    assert got == {i: (2, 1, sha(f"own {i}")) for i in range(10)} | {10: (1, 0, sha("other"))}
    fewer = line_dedup.digests(line_table(rows, texts[1:]))  # nine hold it: it stays
    assert fewer.where("n_dropped > 0").count() == 0


# hard negatives


def brute_negatives(vectors, label, mining):
    use = []
    for i, x, own in vectors:
        if own is not None and x is not None and all(v is not None and np.isfinite(v) for v in x):
            use.append((i, label(i, own), [int(np.floor(mining.scale * float(v))) for v in x]))
    out = []
    order = lambda r: (-r[1], r[0] is None, r[0] or 0)
    for a, own, q in {(a, b, tuple(c)): (a, b, c) for a, b, c in use}.values():
        if a is None or a % mining.anchors_of:
            continue
        others = [(i, sum(x * y for x, y in zip(q, v, strict=True)), lab) for i, lab, v in use if i != a and len(v) == len(q)]
        for p, ps, _ in sorted((o for o in others if o[2] == own), key=order)[: mining.positives]:
            fit = [o for o in others if o[2] != own and mining.low * ps <= 100 * o[1] <= mining.high * ps]
            for rank, (n, ns, _) in enumerate(sorted(fit, key=order)[: mining.negatives], 1):
                out.append((a, p, rank, n, ps, ns))
    return sorted(out, key=repr)


SCHEMA = "vec_id long, embedding array<float>, label int, vector int, place string, chunk int"


def mined(rows, vectors, mining):
    frame = rows([(i, x, own, 1, "x", 2) for i, x, own in vectors], SCHEMA)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 3).otherwise(F.col("label"))
    got = sorted((tuple(r) for r in negatives.mined(frame, label, mining).collect()), key=repr)
    return got, brute_negatives(vectors, lambda i, own: (own + 1) % 3 if i is not None and i % 7 == 0 else own, mining)


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(negatives, "CHUNK", 300)
    monkeypatch.setattr(negatives, "BUCKET", 16)


def test_negatives_equal_brute_force(rows, small):
    random = np.random.default_rng(5)
    centre = random.normal(size=(3, 6))
    vectors = []
    for i in range(400):
        x = centre[i % 3] + random.normal(size=6) * random.choice([0.2, 1.0])
        vectors.append((i, (x * random.choice([0.1, 0.5, 1, 4])).tolist(), i % 3))
    got, want = mined(rows, vectors, negatives.Mining(anchors_of=10, positives=4, negatives=6))
    assert got == want and len(got) > 200


def test_negatives_of_copies_ties_nulls_and_odd_rows(rows, small):
    vectors = [(i, [1.0, 0.5, 0.25], i % 2) for i in range(60)]  # one large group of copies
    vectors += [(100 + i, [0.9 - i / 200, 0.4, 0.1], 1) for i in range(30)]
    vectors += [(10, [1.0, 0.5, 0.25], 0)] * 15 + [(20, [0.5, 0.5, 0.5], 2)] * 3  # repeated rows, an id with two vectors
    vectors += [(None, [0.9, 0.4, 0.1], 2), (None, [0.9, 0.4, 0.1], 2), (200, None, 1), (210, [1.0, None, 0.0], 1), (220, [1.0, float("nan"), 0.0], 1),
                (230, [float("inf"), 0.0, 0.0], 0), (240, [0.3, 0.2, 0.1], None), (250, [0.0, 0.0, 0.0], 0), (260, [-1.0, -0.5, 0.0], 0), (270, [1.0, 0.5], 0),
                (281, [0.8, 0.5], 0), (290, [0.4, 0.3], 2), (300, [], 0), (310, [], 1), (320, [], 0)]
    got, want = mined(rows, vectors, negatives.Mining(anchors_of=10))
    assert got == want
    assert {20, 250, 270} <= {r[0] for r in got}


def test_no_negatives_of_no_rows_and_of_huge_components(rows):
    assert mined(rows, [], negatives.Mining()) == ([], [])
    frame = rows([(0, [1e30, 1.0], 0, 1, "", 1), (1, [1.0, 1.0], 0, 1, "", 1), (2, [0.5, 0.5], 1, 1, "", 1), (3, [1.0, 0.9], 0, 1, "", 1)], SCHEMA)
    got = negatives.mined(frame, F.col("label"), negatives.Mining(1)).collect()
    assert sorted((r.anchor_id, r.positive_id, r.negative_id) for r in got) == [(1, 3, 2), (3, 1, 2)]


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 1 << 30), st.integers(-3000, 3000))
def test_pruning_loses_no_candidate(seed, least):
    random = np.random.default_rng(seed)
    vectors = random.integers(-40, 40, (70, 4)) * random.choice([0, 1, 1, 3], (70, 1))
    index = negatives.Index(vectors, np.arange(70), np.zeros(70, bool), np.zeros(70, np.int64))
    query = random.integers(-40, 40, 4)
    (found, scores), = negatives.search(index, query, -1, -1, [(least, 1 << 40, 9)])
    every = vectors @ query
    order = np.lexsort((np.arange(70), -every))
    want = [int(i) for i in order if every[i] >= least][:9]
    assert index.ids[found].tolist() == want and scores.tolist() == every[want].tolist()


# alignment


A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"


@pytest.fixture(scope="module")
def both():
    return alignment.sides(A, B)


def spans(ids, side):
    out, at = [], 0
    for i in ids:
        out.append((at, at + len(side.spelled[i])))
        at = out[-1][1]
    return out


def brute_alignment(texts, a, b):
    """Per document: ids of A and B, groups, links; by the spans of all tokens."""
    out = []
    for t in texts:
        x, y = (side.encode(t).tolist() if t else [] for side in (a, b))
        spell = lambda ids, side: b"".join(side.spelled[i] for i in ids)
        if not t or spell(x, a) != (" " + t).encode() or spell(y, b) != (" " + t).encode():
            out.append(([], [], "", []))
            continue
        sx, sy = spans(x, a), spans(y, b)
        links = [(x[i], y[j]) for i, p in enumerate(sx) for j, q in enumerate(sy) if p[0] < q[1] and q[0] < p[1]]
        parts, at = [], 0
        for cut in sorted({e for _, e in sx} & {e for _, e in sy}):
            within = lambda s, ids, lo=at, hi=cut: ",".join(str(i) for i, (_, e) in zip(ids, s, strict=True) if lo < e <= hi)
            parts.append(f"{within(sx, x)}|{within(sy, y)}")
            at = cut
        out.append((x, y, ";".join(parts), links))
    return out


TEXT = st.text(st.sampled_from("abcdefgz ABéßñ中文字🙂▁́\n\t0123.,'<|>s"), max_size=60) | st.text(max_size=20).filter(lambda t: t.isprintable())
ODD = [None, "", " ", "<|endoftext|> and <s> </s> <unk> <0x41>", "word", "internationalization of straightforwardness", "é" * 40, "▁x", "\x00a", "  two  spaces ", "x" * 3000]
WIDE = "a" + " " * 1_000_000 + "b"  # more than a pattern can go back over


@settings(max_examples=60, deadline=None)
@given(st.lists(TEXT, max_size=5), st.sampled_from([1, 2, 7, 512]))
def test_lockstep_merging_equals_all_overlaps(both, texts, lane):
    a, b = both
    kept, alignment.merged.__defaults__ = alignment.merged.__defaults__, (lane,)
    try:
        found = alignment.aligned([*texts, *ODD], a, b)
    finally:
        alignment.merged.__defaults__ = kept
    want = brute_alignment([*texts, *ODD], a, b)
    assert alignment.group_texts(found, a, b) == [w[2] for w in want]
    of = found.document(found.links[0])
    for i, (x, y, _, links) in enumerate(want):
        assert found.a[found.a_first[i] : found.a_first[i + 1]].tolist() == x and found.b[found.b_first[i] : found.b_first[i + 1]].tolist() == y
        some = of == i
        assert sorted(zip(found.a[found.links[0][some]].tolist(), found.b[found.links[1][some]].tolist(), strict=True)) == sorted(links)


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=40) | TEXT)
def test_ids_of_a_are_the_librarys(both, text):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(alignment.located(A))
    library.encode_special_tokens = True
    for t in (text, *ODD[2:]):
        assert both[0].encode(t).tolist() == library.encode(" " + t, add_special_tokens=False).ids


def test_a_million_spaces(both):
    ids = both[0].encode(WIDE)
    assert both[0].spell(ids) == (" " + WIDE).encode()


DOCS = [(i, f"Words number {i % 7} and thé same ending.") for i in range(30)] + [(3, "again"), (3, "again"), (None, "no id"), (None, None), (50, ""), *((60 + i, t) for i, t in enumerate(ODD))] + \
    [(99, "long texts go on and on, " * 3000)]


def test_counts_over_all_documents(spark, rows, both):
    a, b = both
    frame = rows([(i, t, 1, "x") for i, t in DOCS], "doc_id long, text string, unit int, pairs string").repartition(5)
    got = sorted((tuple(r) for r in alignment.scored(frame, A, B).collect()), key=repr)
    found = []
    for i, t in DOCS:
        if i == 99:  # many times the same: by the merging tested above
            one = alignment.aligned([t], a, b)
            links = list(zip(one.a[one.links[0]].tolist(), one.b[one.links[1]].tolist(), strict=True))
            found.append((i, one.a, one.b, alignment.group_texts(one, a, b)[0], links))
        else:
            found.append((i, *brute_alignment([t], a, b)[0]))
    count = Counter(p for *_, links in found for p in set(links))
    best = {}
    for (x, _), n in count.items():
        best[x] = max(best.get(x, 0), n)
    want = [(i, len(x), len(y), g.count(";") + (g != ""), len(links), sum(count[p] == best[p[0]] for p in links), sum(count[p] for p in links), sha(g) if len(x) else "")
            for i, x, y, g, links in found]
    assert got == sorted(want, key=repr)
    assert alignment.scored(frame.limit(0), A, B).count() == 0


def test_groups_with_their_byte_ranges(rows, both):
    a, b = both
    texts = [(1, "unbelievable 中文 things"), (2, None), (3, "x"), (None, "naïve")]
    for r in alignment.groups(rows(texts, "doc_id long, text string"), A, B).collect():
        text = dict(texts)[r.doc_id]
        whole = (" " + text).encode() if text else b""
        assert b"".join(whole[g.start : g.end] for g in r.groups) == whole
        for g in r.groups:
            assert a.spell(np.array(g.a)) == b.spell(np.array(g.b)) == whole[g.start : g.end]


def test_rows_of_a_megabyte_lie_in_small_row_groups(spark, rows, monkeypatch):
    """A task buffers a row group when it writes and reads it as one batch; 60 rows of 2.4 MB were one."""
    asked = []
    monkeypatch.setattr(alignment, "written", lambda frame, name, options=None: asked.append((name, options)))
    alignment._units(rows([(1, "a")], "doc_id long, text string"), "a", "b")
    assert asked == [("align-units", common.LARGE_ROWS)]
    large = spark.range(0, 60, 1, 1).select("id", F.transform(F.sequence(F.lit(1), F.lit(300_000)), lambda x: F.xxhash64(x, "id")).alias("v"))
    table = common.written(large, "large", common.LARGE_ROWS)
    (path,) = table.inputFiles()
    file = pq.ParquetFile(path.removeprefix("file://"))
    assert max(file.metadata.row_group(i).num_rows for i in range(file.num_row_groups)) <= 8
    assert table.select(F.sum(F.size("v"))).first()[0] == 60 * 300_000
