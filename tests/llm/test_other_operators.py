"""Vectors, URLs, archives, mixing, packing, quality."""

import base64
import hashlib
import io
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from retailflow.llm import embedding_forest, mixing, packing, quality, url_filter, warc

# vectors


def brute_links(vectors):
    n, root = {}, {}
    ok = [(i, np.array(v, float), label) for i, v, label in vectors if v and label is not None and None not in v and np.isfinite(v).all() and any(v)]
    near = lambda a, b: a[2] == b[2] and len(a[1]) == len(b[1]) and a[1] @ b[1] / np.linalg.norm(a[1]) / np.linalg.norm(b[1]) >= 0.93
    for i, _, _ in vectors:
        n[i], root[i] = 0, i
    for a in ok:
        n[a[0]] = sum(near(a, b) for b in ok if b[0] != a[0])
    for _ in ok:
        for a in ok:
            for b in ok:
                if near(a, b):
                    root[a[0]] = root[b[0]] = min(root[a[0]], root[b[0]])
    return {i: (n[i], root[i], root[i] == i) for i in n}


VECTORS = "vec_id long, embedding array<float>, label int, node string, leaf long"


def test_links_of_vectors(rows):
    random = np.random.default_rng(2)
    vectors = [(0, None, 1), (1, [], 1), (2, [0.0, 0.0], 1), (3, [1.0, None], 1), (4, [float("nan"), 1.0], 1), (5, [float("inf"), 1.0], 1), (6, [1.0, 2.0], None)]
    for label in (1, 2):
        for _ in range(6):
            base = random.normal(size=16)
            vectors += [(len(vectors) + j, (base + random.normal(size=16) * s).astype(np.float32).tolist(), label) for j, s in enumerate((0, 0, 0.1, 0.2, 0.3, 1))]
    frame = rows([(*v, "x", 1) for v in vectors], VECTORS)
    want = brute_links(vectors)
    for forest in (embedding_forest.Forest(), embedding_forest.Forest(leaf=8, most=5, trees=20, overlap=0.2)):
        got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_forest.linked(frame, forest).collect()}
        assert got == want


def test_vectors_of_no_rows_repeated_rows_and_null_ids(rows):
    assert embedding_forest.linked(rows([], VECTORS)).count() == 0
    same = rows([(i, [1.0, 2.0], 1, "x", 1) for i in (4, 4, None)], VECTORS)
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in embedding_forest.linked(same).collect()), key=repr)
    assert got == sorted([(4, 2, 4, True), (4, 2, 4, True), (None, 2, 4, False)], key=repr)


def test_leaves_are_bounded_whatever_the_number_of_labels(spark, monkeypatch):
    """No label has enough vectors in the first sample for a split; large leaves are split by samples of their own."""
    monkeypatch.setattr(embedding_forest, "LEAF_ROWS", 70)  # several tasks a leaf
    sizes, kept = [], embedding_forest.written

    def written(frame, name):
        table = kept(frame, name)
        if name == "forest-leaves":
            sizes.append(table.groupBy("label", "length", "leaf").count().agg(F.max("count")).first()[0])
        return table

    monkeypatch.setattr(embedding_forest, "written", written)
    random = np.random.default_rng(6)
    base = np.repeat(random.normal(size=(900, 16)), 3, axis=0) + random.normal(size=(2700, 16)) * 0.15
    label = np.repeat(np.arange(900), 3) % 15
    frame = spark.createDataFrame([(i, v.tolist(), int(own)) for i, (v, own) in enumerate(zip(base, label, strict=True))], "vec_id long, embedding array<double>, label int")
    forest = embedding_forest.Forest(leaf=32, most=64, sample=200, trees=8)
    found = embedding_forest.linked(frame, forest).agg(F.sum("n_links")).first()[0]
    unit = base / np.linalg.norm(base, axis=1, keepdims=True)
    true = int(((unit @ unit.T >= 0.93) & (label[:, None] == label)).sum()) - len(base)
    assert 0.9 * true <= found <= true and true > 1000
    assert sizes[0] == 180 and sizes[-1] <= 64


def test_recall_of_the_forest(spark):
    """Against brute force, with leaves far smaller than labels: at least 0.9."""
    random = np.random.default_rng(4)
    base = np.repeat(random.normal(size=(300, 32)), 5, axis=0) + random.normal(size=(1500, 32)) * 0.2
    frame = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(base)], "vec_id long, embedding array<double>, label int")
    unit = base / np.linalg.norm(base, axis=1, keepdims=True)
    true = int((unit @ unit.T >= 0.93).sum()) - len(base)
    found = embedding_forest.linked(frame, embedding_forest.Forest(leaf=64)).agg(F.sum("n_links")).first()[0]
    assert 0.9 * true <= found <= true


# URLs


def test_rules_and_list(rows):
    pages = rows([
        (1, "http://a.NET/x"), (2, "https://Example.net/en/1#t"), (3, "http://www.example.com/de/"), (4, "http://example.com/en/1"), (5, "http://x.org/fr/q?a=1"),
        (6, None), (7, "no host"), (8, "http://bad.example.com/p/?b=2&utm_source=x&a=1"), (9, "http://BAD.example.com/p?a=1&b=2&ref=r#f"), (10, "http://bad.example.com/p?a=1"),
        (11, "http://net"), (12, "ftp://notnet.org"), (None, "http://b.net/"), (1, "http://a.NET/x"), (13, ""), (14, "http://example.network/en/")], "page_id long, url string")
    pages = pages.withColumn("host", F.lit("clash")).withColumn("possible", F.lit(True))
    listed = rows([("bad.example.com/p?a=1&b=2",), (None,), ("bad.example.com/p?a=1&b=2",)], "canonical string")
    got = sorted(((r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages, listed).collect()), key=repr)
    assert got == sorted([
        (1, "a.net", "/x", "net/", "block"), (1, "a.net", "/x", "net/", "block"), (2, "example.net", "/en/1", "example.net/en/", "allow"),
        (3, "www.example.com", "/de/", "example.com/de/", "block"), (4, "example.com", "/en/1", None, "allow"), (5, "x.org", "/fr/q", "org/fr/", "allow"),
        (6, "", "", None, "allow"), (7, "", "", None, "allow"), (8, "bad.example.com", "/p/", None, "block"), (9, "bad.example.com", "/p", None, "block"),
        (10, "bad.example.com", "/p", None, "allow"), (11, "net", "", None, "allow"), (12, "notnet.org", "", None, "allow"), (None, "b.net", "/", "net/", "block"),
        (13, "", "", None, "allow"), (14, "example.network", "/en/", None, "allow")], key=repr)
    assert url_filter.judge(pages.limit(0), listed.limit(0)).count() == 0


def test_bloom_filter_misses_no_key_and_stays_bounded(spark, monkeypatch):
    from retailflow.llm import bloom

    monkeypatch.setattr(bloom, "MAX_BLOCKS", 8)
    keys = spark.range(2000).select(F.col("id").cast("string").alias("k"))
    built = bloom.build(keys, "k")
    assert built[0].count() <= 8
    assert bloom.marked(keys, F.col("k"), built, "hit").where("NOT hit").count() == 0
    monkeypatch.undo()
    built = bloom.build(keys, "k")
    others = spark.range(10_000, 20_000).select(F.col("id").cast("string").alias("k"))
    assert bloom.marked(others, F.col("k"), built, "hit").where("hit").count() < 200


# archives


def digest(data):
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def test_archives_round_trip(rows):
    pages = [(3, "http://a/\r\nx", "same"), (1, "u", "same"), (2, None, None), (4, "v", ""), (5, "w", "é" * 300_000), (None, "n", "same"), (None, "n", "own"), (6, "t", "xx"), (6, "t", "xx")]
    frame = rows([(*p, "x") for p in pages], "page_id long, url string, html string, digest string")
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.round_trip(frame).collect()), key=repr)
    refers = {3: 1, 4: 2}
    want = [(i, len((h or "").encode()), digest((h or "").encode()), *(("revisit", r) if (r := 1 if (i, h) == (None, "same") else refers.get(i)) else ("response", None))) for i, _, h in pages]
    assert got == sorted(want, key=repr)
    assert warc.round_trip(frame.limit(0)).count() == 0
    small = {r.page_id: r.record_type for r in warc.round_trip(frame.where("page_id IS NOT NULL"), min_bytes=5).collect()}
    assert small[3] == small[4] == "response"


def test_archives_are_found_and_hold_payloads(spark, rows, tmp_path):
    frame = rows([(i, f"http://h/{i}", "text " * i) for i in range(20)], "page_id long, url string, html string")
    warc.write(frame, str(tmp_path), archive_bytes=500).collect()
    got = {r.page_id: bytes(r.payload) for r in warc.read(warc.listing(spark, str(tmp_path))).collect()}
    assert got == {i: (b"text " * i) for i in range(20)}


def test_reader_refuses_broken_archives():
    whole = warc.record(1, "u", b"payload" * 1000, digest(b"payload" * 1000), None)
    assert [p for _, _, p in warc.read_records(io.BytesIO(whole + whole))] == [b"payload" * 1000] * 2
    for broken in (whole[:-20], whole + whole[:30]):
        with pytest.raises(warc.WarcError):
            list(warc.read_records(io.BytesIO(broken)))
    pack = lambda data: (z := zlib.compressobj(6, zlib.DEFLATED, 31)).compress(data) + z.flush()
    plain = zlib.decompress(whole, 31)
    for changed in (plain.replace(b"payload", b"pAyload", 1), plain[:-10] + b"\r\n\r\n", plain + b"more", b"x" + plain, plain.replace(b"sha1:", b"sha1:A")):
        with pytest.raises(warc.WarcError):
            list(warc.read_records(io.BytesIO(pack(changed))))


# mixing


def water(sizes, mix=mixing.Mix()):
    """Targets by raising the level until all words are shared."""
    weights = {s: mix.weights[i % len(mix.weights)] for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s)))}
    low, high = 0.0, float(sum(sizes.values())) * 10
    for _ in range(200):
        level = (low + high) / 2
        total = sum(min(mix.most * n, level * weights[s]) for s, n in sizes.items())
        low, high = (level, high) if total < sum(sizes.values()) else (low, level)
    return {s: min(mix.most * n, level * weights[s]) for s, n in sizes.items()}


def test_mix(rows):
    random = np.random.default_rng(5)
    docs = []
    for source, n in (("a", 3), ("b", 60), ("é", 200), ("Z", 90), (None, 40), ("none", 2)):
        docs += [(len(docs) + i, " ".join(["w"] * (0 if source == "none" else int(random.integers(1, 300)))), source, "x") for i in range(n)]
    docs += [(None, "a b", "a", "x"), (7, None, "b", "x"), (9, "x y", "b", "x"), (9, "x y", "b", "x")]
    frame = rows(docs, "doc_id long, text string, source string, size string")
    first, again = ([tuple(r) for r in mixing.taken(frame).orderBy("doc_id", "size", "taken").collect()] for _ in range(2))
    assert first == again and len(first) == len(docs)
    sizes = {}
    for _, t, s, _ in docs:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = water(sizes)
    got, by_size = {}, {n: s for s, n in sizes.items()}
    for _, size, source_size, target, taken in first:
        assert taken <= 3 * size
        source = by_size[source_size]
        assert target == pytest.approx(want[source], rel=1e-6)
        got[source] = got.get(source, 0) + taken
    for source, n in got.items():
        assert abs(n - want[source]) <= 2 * 64
    texts = mixing.mixed_documents(frame)
    assert texts.columns == frame.columns
    assert texts.select(F.sum(mixing.size_of(F.col("text")))).first()[0] == sum(got.values())
    assert mixing.taken(frame.limit(0)).count() == 0


def test_many_sources_and_what_is_taken_by_a_plain_version(spark):
    docs = spark.range(9000).select(
        (F.col("id") % 8990).alias("doc_id"), F.concat(F.lit("s"), F.pow(F.lit(1.0009), F.col("id")).cast("int")).alias("source"),
        F.expr("repeat('w ', cast(id * 7919 % 300 as int))").alias("text"))
    mix = mixing.Mix(block=16, shard=50)
    got = mixing.mixed(docs, mix)
    sources = {r.source_no: r for r in got.sources.collect()}
    assert len(sources) > 1000
    slots = got.slots.collect()
    total = sum(r.slots for r in sources.values())
    assert sorted(r.slot for r in slots) == list(range(total))
    times = {}
    for r in slots:
        times.setdefault(r.source_no, {}).setdefault(r.block, []).append(r.slot)
    for no, r in sources.items():
        own = times.get(no, {})
        assert sum(map(len, own.values())) == r.slots and all(0 <= b < r.blocks for b in own)
        if r.slots:  # every block once before any a second time
            assert {len(own.get(b, [])) for b in range(r.blocks)} <= {r.slots // r.blocks, -(-r.slots // r.blocks)}
    # The documents of a source, end to end; a block gives its words as often as it has slots.
    want, place = {}, {}
    for r in sorted(got.documents.collect(), key=lambda r: (r.source_no, r.first, r.size)):
        assert r.first == place.get(r.source_no, 0)
        place[r.source_no] = r.first + r.size
        taken = sum(len(times.get(r.source_no, {}).get(word // 16, [])) for word in range(r.first, r.first + r.size))
        want[r.doc_id, r.size, taken] = want.get((r.doc_id, r.size, taken), 0) + 1
    found = {}
    for r in mixing.taken(docs, mix).collect():
        found[r.doc_id, r.size, r.taken] = found.get((r.doc_id, r.size, r.taken), 0) + 1
    assert found == want


def test_equal_ids_and_sizes_of_unlike_texts_stay_apart(rows):
    docs = [(1, f"a{i} b{i} c{i}", "s", i) for i in range(30)] + [(1, "x y z", "s", 100), (1, "x y z", "s", 101), (2, None, "s", 1)]
    frame = rows(docs, "doc_id long, text string, source string, n_chars int")
    taken = sum(r.taken for r in mixing.taken(frame, mixing.Mix(block=2)).collect())
    texts = [r.text for r in mixing.mixed_documents(frame, mixing.Mix(block=2)).collect()]
    assert sum(len(t.split()) for t in texts) == taken
    assert {w for t in texts for w in t.split()} <= {w for _, t, _, _ in docs for w in (t or "").split()}
    assert all(len({w[1:] for w in t.split()}) == 1 for t in texts if not set(t.split()) & set("xyz"))
    again = [r.text for r in mixing.mixed_documents(frame.repartition(5), mixing.Mix(block=2)).collect()]
    assert sorted(again) == sorted(texts)


def test_the_mix_is_planned_once_for_documents_and_their_repeats(rows):
    frame = rows([(i, "abc"[i % 3], f"w{i} x{i} y{i} z") for i in range(40)] + [(1, "b", "w1 x1 y1 z")], "doc_id long, source string, text string")
    plan = mixing.mixed_documents(frame, mixing.Mix(block=2))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") <= 2 and plan.count("Relation ") <= 4  # documents and what the mix takes of each, once for each of the two


@pytest.mark.parametrize("n", [1, 2, 3, 10, 997, 4096])
def test_permutations_are_one_to_one(spark, n):
    rows = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(3), F.lit(1), 17).alias("p")).collect()
    assert sorted(r.p for r in rows) == list(range(n))


def test_draws_fill_every_place_once(spark, monkeypatch):
    wanted = {1: 500, 2: 3, 3: 0, 4: 1200}
    monkeypatch.setattr(mixing, "SHARDS", 3)
    got = mixing.draw(spark.createDataFrame(list(wanted.items()), "source_no int, slots long"), mixing.Mix(shard=100)).collect()
    assert sorted(r.slot for r in got) == list(range(1703))
    assert sorted((r.source_no, r.place) for r in got) == [(s, p) for s, n in wanted.items() for p in range(n)]


# packing


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 64), min_size=1, max_size=60))
def test_bins_hold_what_they_are_given(pieces):
    settings_ = packing.Packing(lengths=(16, 32, 64))
    bins, lengths = packing.pack(sorted(pieces, reverse=True), settings_)
    filled = np.bincount(bins, sorted(pieces, reverse=True), minlength=len(lengths))
    for n, length in zip(filled, lengths, strict=True):
        assert length == min(x for x in settings_.lengths if x >= n)


def test_packing_places_every_word_once(rows):
    sizes = [0, 1, 5, 17, 40, 100, 63, 64, 3, 3]
    docs = rows([(i, None if i == 0 else "w " * n, 1) for i, n in enumerate(sizes)] + [(3, "w " * 17, 1), (None, "w", 1)], "doc_id long, text string, piece int")
    got = packing.packed(docs, packing.Packing(lengths=(16, 32, 64), group=8)).toPandas()
    again = packing.packed(docs, packing.Packing(lengths=(16, 32, 64), group=8)).toPandas()
    columns = list(got.columns)
    assert got.sort_values(columns).reset_index(drop=True).equals(again.sort_values(columns).reset_index(drop=True))
    whole = got.groupby("doc_id", dropna=False).length.sum()
    assert {None if np.isnan(k) else int(k): v for k, v in whole.items()} == {None: 2, **{i: (2 if i == 3 else 1) * (n + 1) for i, n in enumerate(sizes)}}
    for _, bin_ in got.groupby(["group_no", "bin_no"]):
        rows_ = bin_.sort_values("bin_start")
        assert rows_.bin_start.tolist() == [0, *rows_.length.cumsum().tolist()[:-1]]
        assert rows_.bin_length.iloc[0] == min(x for x in (16, 32, 64) if x >= rows_.length.sum())
    assert packing.packed(docs.limit(0)).count() == 0


def test_packing_wastes_little(spark):
    got = packing.packed(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).toPandas()
    bins = got.groupby(["group_no", "bin_no"]).agg(n=("length", "sum"), length=("bin_length", "first"))
    assert bins.n.sum() / bins.length.sum() > 0.98


def partitions(items):
    if not items:
        yield []
        return
    for rest in partitions(items[1:]):
        yield [[items[0]], *rest]
        for i in range(len(rest)):
            yield [*rest[:i], [items[0], *rest[i]], *rest[i + 1 :]]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), min_size=1, max_size=7), st.sampled_from([0.0, 4.0, 20.0]), st.sampled_from([32.0, 200.0, 1e9]))
def test_bins_cost_little_more_than_the_best_there_are(pieces, overhead, attention):
    packing_ = packing.Packing((16, 32, 64), overhead, attention)
    least = lambda n: min(x for x in packing_.lengths if x >= n)
    best = min(sum(packing_.cost(least(sum(b))) for b in p) for p in partitions(pieces) if max(map(sum, p)) <= 64)
    found = sum(map(packing_.cost, packing.pack(sorted(pieces, reverse=True), packing_)[1]))
    assert best - 1e-6 <= found <= 1.3 * best


def test_documents_open_several_lengths_and_no_single_one_is_cheaper(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    pieces = sorted((r.length for r in packing.packed(docs).select("length").collect()), reverse=True)
    packing_ = packing.Packing()
    total = lambda p: sum(map(packing_.cost, packing.pack(pieces, p)[1]))
    assert len(set(packing.pack(pieces, packing_)[1])) >= 4
    assert total(packing_) < 0.97 * total(packing.Packing((4096,)))
    short = [n for n in pieces if n <= 1024]
    for length in packing_.lengths[2:]:
        alone = packing.pack(short, packing.Packing((length,)))[1]
        assert sum(map(packing_.cost, packing.pack(short, packing_)[1])) <= sum(map(packing_.cost, alone))


# quality


def test_sum_of_squares_equals_the_pairs():
    random = np.random.default_rng(6)
    size = quality.BUCKETS + quality.STATISTICS
    machine = quality.Machine(0.1, random.normal(size=size) * 0.1, random.normal(size=(size, 3)) * 0.1, np.zeros(quality.STATISTICS), np.ones(quality.STATISTICS))
    texts, n_chars = pa.array(["a b a, C!", None, "", "x " * 5]), np.array([9, np.nan, 0, 10])
    got = quality.scores(machine, texts, n_chars)
    first, bucket, value, statistics = quality.features(texts, n_chars)
    for i in range(4):
        x = np.zeros(size)
        x[bucket[first[i] : first[i + 1]]] = value[first[i] : first[i + 1]]
        x[quality.BUCKETS :] = statistics[i]
        at = np.flatnonzero(x)
        pairs = sum(machine.factor[a] @ machine.factor[b] * x[a] * x[b] for k, a in enumerate(at) for b in at[k + 1 :])
        assert got[i] == pytest.approx(1 / (1 + np.exp(-(machine.bias + machine.weight @ x + pairs))))


def test_quality_on_held_out_labels(spark):
    from retailflow.llm.queries import QUERIES

    sf_dir = "/root/testdata/sf0.01"
    got = QUERIES["op10_quality"](spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert (got.predicted == got.quality).mean() > 0.95
    assert got.score.between(0, 1).all()


def test_quality_of_odd_rows(rows):
    docs = rows([(1, None, None, "q"), (2, "", 0, "q"), (3, "fine words here", 15, "q"), (3, "fine words here", 15, "q"), (None, "BAD!! BAD!!", None, "q")],
                "doc_id long, text string, n_chars long, target string")
    labels = rows([(3, 1), (3, None), (2, 0), (None, 1), (9, 1)], "doc_id long, quality int")
    machine = quality.fitted(docs, labels)
    assert quality.scored(docs, machine).where("score BETWEEN 0 AND 1").count() == 5
    assert quality.kept(docs, machine, 0.0).columns == docs.columns
    assert quality.scored(docs.drop("n_chars"), machine).count() == 5
    nothing = quality.fitted(docs, labels.limit(0))
    assert {r.score for r in quality.scored(docs, nothing).collect()} == {0.5}
    assert quality.scored(docs.limit(0), machine).count() == 0
