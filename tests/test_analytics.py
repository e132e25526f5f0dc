"""Ranked search, cube, versions as of a time, sessions, ranges of days: small cases by hand or brute force."""

import math
import re
import unicodedata
from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from retailflow.functions import words
from retailflow.operators import cube, reach, search, sessions, versions


# -- analyser and search ------------------------------------------------------------------------


def test_words_of_any_script(rows):
    texts = {1: "Red  WIDGET, it's 3.5!", 2: "红色手机 Pro", 3: "Éclair naïve ÑU", 4: "カメラ12", 5: "", 6: None, 7: "—…!", 8: "привет_мир"}
    got = {r.id: r.w for r in rows(list(texts.items()), "id int, t string").select("id", words("t").alias("w")).collect()}
    assert got == {1: ["red", "widget", "it", "s", "3", "5"], 2: ["红", "色", "手", "机", "pro"], 3: ["éclair", "naïve", "ñu"],
                   4: ["カ", "メ", "ラ", "12"], 5: [], 6: None, 7: [], 8: ["привет", "мир"]}


def alone(c):
    return unicodedata.name(c, "").startswith(("CJK UNIFIED", "HIRAGANA", "KATAKANA LETTER"))


def plain_words(text):
    return re.findall(r"\w+", "".join(f" {c} " if alone(c) else c for c in (text or "").lower()).replace("_", " "))


def brute_ranking(docs, text, k):
    terms = {i: plain_words(t) for i, t in docs}
    average = sum(map(len, terms.values())) / len(terms)
    df = Counter(w for ws in terms.values() for w in set(ws))
    scores = {}
    for w, times in Counter(plain_words(text)).items():
        idf = math.log(1 + (len(terms) - df[w] + 0.5) / (df[w] + 0.5))
        for i, ws in terms.items():
            if tf := ws.count(w):
                scores[i] = scores.get(i, 0) + times * idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(ws) / average))
    return sorted(((round(s, 6), i) for i, s in scores.items()), key=lambda x: (-x[0], x[1]))[:k]


VOCABULARY = ["red", "blue", "widget", "the", "手", "机", "phone", "case", "é", "rare", "x9"]
DOCS = [(i, " ".join(VOCABULARY[(i * i + j * (i % 5 + 1)) % len(VOCABULARY)] for j in range(i % 13))) for i in range(300)] + [(300, None), (301, "!"), (302, "the " * 50 + "unique")]
SEARCHES = ["red widget", "the the the", "手机 case", "unique", "nothing known", "", None, "x9 é rare the phone Red RED", "手"]


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    return search.build_index(spark.createDataFrame(DOCS, "doc_id long, text string").repartition(3), str(tmp_path_factory.mktemp("index") / "i"))


@pytest.mark.parametrize(("k", "start"), [(10, 0), (3, 5), (1000, 0)])
def test_ranking_equals_brute_force(index, rows, k, start):
    asked = rows(list(enumerate(SEARCHES)), "search_id int, text string")
    found = {}
    for r in search.search(index, asked, k, start).collect():
        found.setdefault(r.search_id, []).append((r["rank"], r.doc_id, r.score))
    for n, text in enumerate(SEARCHES):
        want = [(place, i, s) for place, (s, i) in enumerate(brute_ranking(DOCS, text, k + start), 1)][start:]
        assert [(p, i, pytest.approx(s, abs=1e-6)) for p, i, s in want] == sorted(found.get(n, [])), text


def test_many_terms_are_joined(index, rows, monkeypatch):
    asked = rows(list(enumerate(SEARCHES)), "search_id int, text string")
    named = sorted(map(tuple, search.search(index, asked, 5).collect()))
    monkeypatch.setattr(search, "NAMED_TERMS", 2)
    assert sorted(map(tuple, search.search(index, asked, 5).collect())) == named


def test_no_documents(spark, rows, tmp_path):
    empty = search.build_index(rows([], "doc_id long, text string"), str(tmp_path / "i"))
    assert search.search(empty, rows([(1, "red")], "search_id int, text string")).count() == 0


def scanned_rows(frame):
    """Rows that the scans of a plan gave out, after it has run."""
    plan, total, todo = frame._jdf.queryExecution().executedPlan(), 0, []
    frame.collect()
    todo.append(plan)
    while todo:
        node = todo.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
            continue
        if "QueryStage" in node.nodeName():
            todo.append(node.plan())
            continue
        if node.nodeName().startswith("Scan parquet"):
            total += node.metrics().apply("numOutputRows").value()
        children = node.children()
        todo.extend(children.apply(i) for i in range(children.size()))
    return total


def test_a_search_reads_its_terms_and_of_these_the_levels_that_matter(spark, rows, tmp_path):
    # A word in every document, with frequencies that differ, and ten thousand others.
    docs = spark.range(40_000).select(F.col("id").alias("doc_id"), F.concat_ws(
        " ", F.expr("repeat('common ', cast(1 + id % 7 as int))"), F.concat(F.lit("w"), F.pmod("id", F.lit(10_000))), F.when(F.col("id") % 4000 == 5, "seldom")).alias("text"))
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        built = search.build_index(docs, str(tmp_path / "i"))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    postings = built.postings().count()
    assert postings == 80_010

    def wanted(text):
        return search.levels_to_read(built, rows([(1, text)], "search_id int, text string"), 10).select("term", "level").collect()

    whole = built.dictionary().where("term = 'common'").count()
    assert whole > 3
    assert len(wanted("common")) < whole  # low frequencies cannot be among the ten best
    seldom = {(r.term, r.level) for r in wanted("seldom")}
    assert {term for term, _ in seldom} == {"seldom"}
    found = search.search(built, rows([(1, "seldom")], "search_id int, text string"))
    assert found.count() == 10
    reads = built.postings().where(F.col("term").isin(["seldom"]))
    assert scanned_rows(reads) < postings / 3  # other terms' row groups are skipped


# -- cube ---------------------------------------------------------------------------------------


def test_cube_has_every_level_and_tells_missing_values_from_totals(rows):
    data = [("a", "x", 1, 10), ("a", None, 2, 20), (None, "x", 3, 30), (None, None, 4, 40), ("a", "x", 5, 50)]
    finest = rows(data, "p string, q string, n long, m long").groupBy("p", "q").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))
    got = sorted(map(tuple, cube.cube(finest, ("p", "q"), ("n", "m")).collect()), key=repr)
    want = Counter()
    for p, q, n, m in data:
        for kept in (s for size in range(3) for s in combinations(("p", "q"), size)):
            key = (p if "p" in kept else None, q if "q" in kept else None, 2 * ("p" not in kept) + ("q" not in kept))
            want[(*key, "n")] += n
            want[(*key, "m")] += m
    assert got == sorted(((*k[:3], v, want[(*k[:3], "m")]) for k, v in want.items() if k[3] == "n"), key=repr)
    some = cube.grouping_sets(finest, [("p",), ()], ("p", "q"), ("n", "m"))
    assert sorted(map(tuple, some.collect()), key=repr) == sorted((r for r in got if r[2] in (1, 3)), key=repr)


def test_cube_scans_once(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(100).select(*[F.col("id").alias(d) for d in cube.DIMENSIONS], F.col("id").alias("sku_num"), F.lit(1.0).alias("final_detail_amount")).write.parquet(path)
    plan = cube.cube(cube.finest(spark.read.parquet(path)))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation") == 1


# -- versions -----------------------------------------------------------------------------------


def test_version_as_of_a_time(rows):
    changes = [("k", 10, "a"), ("k", 20, "b"), ("h", 15, "c"), ("h", 25, None), (None, 1, "never"), ("k", None, "never")]
    facts = [(1, "k", 9), (2, "k", 10), (3, "k", 19), (4, "k", 20), (5, "k", 99), (6, "h", 14), (7, "h", 30), (8, "z", 5), (9, None, 50), (10, "k", None), (5, "k", 99)]
    given = rows(changes, "k string, at int, v string").withColumn("since", F.col("at"))
    for salts in (1, 4):
        got = versions.as_of(rows(facts, "id int, key string, t int"), given, "key", "t", "k", "at", ["v", "since"], salts)
        assert got.columns == ["id", "key", "t", "v", "since"]
        assert sorted((r.id, r.v, r.since) for r in got.collect()) == [
            (1, None, None), (2, "a", 10), (3, "a", 10), (4, "b", 20), (5, "b", 20), (5, "b", 20), (6, None, None), (7, None, 25), (8, None, None), (9, None, None), (10, None, None)]


def test_facts_of_a_hot_key_lie_in_many_tasks(spark):
    facts = spark.range(8000).select("id", F.lit("hot").alias("k"), (F.col("id") % 100).alias("t"))
    changes = spark.range(0, 100, 7).select(F.lit("hot").alias("k"), F.col("id").alias("at"), F.col("id").alias("v"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = versions.as_of(facts, changes, "k", "t", "k", "at", ["v"])
        sizes = [r.n for r in got.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(sizes) > 4 and max(sizes) < 4000
    assert got.where("v != t - t % 7").count() == 0


def test_versions_are_copied_for_hot_keys_only_and_no_more_than_there_are_facts(spark):
    facts = spark.range(900).select("id", F.when(F.col("id") < 300, "hot").when(F.col("id") < 600, "many").otherwise(F.col("id").cast("string")).alias("k"), (F.col("id") % 100).alias("t"))
    at = spark.range(100).select(F.col("id").alias("at"), F.col("id").alias("v"))
    hot, many = at.where("at % 50 = 0").withColumn("k", F.lit("hot")), at.unionByName(at.select((F.col("at") + 100).alias("at"), "v")).withColumn("k", F.lit("many"))
    rest = spark.range(600, 900).select(F.col("id").cast("string").alias("k"), F.lit(0).alias("at"), F.lit(0).alias("v"))
    changes = hot.unionByName(many).unionByName(rest)
    for limit in (100, 10_000):
        got = versions.as_of(facts, changes, "k", "t", "k", "at", ["v"], 16, limit)
        assert {r.k: r.n for r in got.groupBy(F.when(F.col("id") < 300, "hot").when(F.col("id") < 600, "many").alias("k")).agg(F.count("v").alias("n")).collect()} == {"hot": 300, "many": 300, None: 300}
        assert got.where("k = 'hot' and v != t - t % 50 or k = 'many' and v != t").count() == 0
    assert "Generate" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_validity_ends_where_the_next_version_begins(rows):
    got = versions.with_validity(rows([("k", 1, 1, "a"), ("k", 5, 1, "b"), ("k", 5, 2, "c"), ("h", 3, 1, "d")], "k string, at int, n int, v string"), "k", "at", "n")
    assert sorted((r.k, r.v, r.valid_from, r.valid_to) for r in got.collect()) == [("h", "d", 3, None), ("k", "a", 1, 5), ("k", "c", 5, None)]


# -- sessions -----------------------------------------------------------------------------------


def test_sessions_end_after_a_gap(rows):
    seconds = {"a": [0, 10, 69, 128, 188, 400], "b": [5], None: [7]}
    data = [(d, s) for d, all_ in seconds.items() for s in all_] + [("a", 10)]
    events = rows(data, "d string, s long").select("d", F.timestamp_seconds("s").alias("at"))
    got = sessions.sessions(events, "d", "at", "60 seconds").select("device", F.unix_seconds("session_start"), F.unix_seconds("last_seen"), "events")
    # 128 to 188 is a whole gap, which still joins; 188 to 400 is more.
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([("a", 0, 188, 6), ("a", 400, 400, 1), ("b", 5, 5, 1), (None, 7, 7, 1)], key=repr)


# -- ranges of days -----------------------------------------------------------------------------


def test_reach_counts_each_device_once(rows, monkeypatch):
    monkeypatch.setattr(reach, "PART", 5)
    monkeypatch.setattr(reach, "PLACES", 4)  # several bitmaps a part
    data = [(f"2024-01-{d:02d}", f"m{(d * k) % 17}") for d in (1, 2, 3, 9, 10, 20) for k in range(12)] + [("2024-01-03", None)]
    days = rows(data, "dt string, mid string")
    numbers = reach.device_numbers(days)
    assert numbers.count() == numbers.select("part", "place").distinct().count() == 17
    got = {(r.dt, r.days): r.devices for r in reach.reach(reach.daily_bitmaps(days, numbers), (1, 7)).collect()}
    for (dt, n), count in got.items():
        end = int(dt[-2:])
        assert count == len({m for d, m in data if m and end - n < int(d[-2:]) <= end})
    assert {dt for dt, _ in got} == {d for d, _ in data} and len(got) == 12


def test_sketches_stay_within_their_error(spark):
    days = spark.range(200_000).select(F.concat(F.lit("2024-01-0"), (F.col("id") % 7 + 1).cast("string")).alias("dt"), F.pmod(F.xxhash64("id"), F.lit(60_000)).cast("string").alias("mid"))
    exact = days.where("dt <= '2024-01-07'").select("mid").distinct().count()
    last = reach.estimated_reach(reach.daily_sketches(days), (7,)).where("dt = '2024-01-07'").first().estimate
    assert abs(last - exact) <= 4 * 1.04 / 2 ** (reach.LG / 2) * exact


def test_a_posting_travels_once_for_all_searches_and_blocks_agree(rows, tmp_path, monkeypatch):
    docs = [(i, " ".join(["red"] * (i % 3 + 1) + ["ball"] * (i % 2) + [f"w{i % 7}"])) for i in range(200)]
    built = search.build_index(rows(docs, "doc_id long, text string").repartition(3), str(tmp_path / "i"))
    asked = rows([(i, f"red ball w{i % 7} red") for i in range(40)], "search_id int, text string")
    plain = sorted(map(tuple, search.search(built, asked, 7, 2).collect()))
    assert len(plain) == 40 * 7
    monkeypatch.setattr(search, "BLOCK_POSTINGS", 20)
    found = search.search(built, asked, 7, 2)
    assert sorted(map(tuple, found.collect())) == plain
    plan = found._jdf.queryExecution().executedPlan().toString()
    # Below the tasks that rank, no join brings searches and documents together.
    below = plan[plan.index("MapInArrow"):]
    assert not [line for line in below.splitlines() if "Join" in line and "search_id" in line]


def test_equal_documents_beyond_the_page_stay_in_their_block(rows, tmp_path):
    built = search.build_index(rows([(i, "red ball") for i in range(500)], "doc_id long, text string"), str(tmp_path / "i"))
    found = search.search(built, rows([(None, "ball"), (1, "red blue")], "search_id int, text string"), 3, 2).collect()
    assert sorted(((r.search_id or 0), r["rank"], r.doc_id) for r in found) == [(s, k, k - 1) for s in (0, 1) for k in (3, 4, 5)]
