"""The registered queries against SQL, and the pipeline's stages against brute force."""

import re

import pytest
from compare import oracle_connection, oracle_rows, spark_rows
from conftest import SF_DIR
from pyspark.sql import functions as F
from test_text_operators import brute_clusters, brute_groups

import corpus_pipeline
from retailflow.llm import quality
from retailflow.llm.queries import ORACLES, QUERIES

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, name):
    got, want = spark_rows(QUERIES[name](spark, SF_DIR)), oracle_rows(oracle_connection(SF_DIR), ORACLES[name])
    assert got == want


def test_a_query_for_each_operator():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES if n != "pipeline") == list(range(1, 14))


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF_DIR).persist()
        seen[name] = (docs, out)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == COLUMNS
        docs = out
    ids = lambda frame: sorted(r.doc_id for r in frame.select("doc_id").collect())
    texts = lambda frame: [(r.doc_id, r.text) for r in frame.collect()]

    before, after = seen["quality"]
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet").where(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) != 2)
    machine = quality.fitted(before, labels)
    assert ids(after) == ids(quality.scored(before, machine).where("score >= 0.7"))
    known = after.join(labels, "doc_id").toPandas()
    assert (known.quality == 1).mean() > 0.95

    before, after = seen["exact_dedup"]
    assert ids(after) == sorted(i for i, (_, _, kept) in brute_groups(texts(before)).items() if kept)

    before, after = seen["ngram_join"]
    assert ids(after) == sorted({root for _, root in brute_clusters(texts(before)).values()})

    before, after = seen["mixing"]
    own = dict(texts(before))
    words = {}
    for i, t in texts(after):
        words[i] = words.get(i, 0) + len(t.split())
        assert set(t.split()) <= set(own[i].split())
    assert all(n <= 3 * len(own[i].split()) for i, n in words.items())
    total = sum(len((t or "").split()) for t in own.values())
    assert abs(sum(words.values()) - total) < 0.05 * total

    before, after = seen["packing"]
    placed = {r.doc_id: r.n for r in after.groupBy("doc_id").agg(F.sum("length").alias("n")).collect()}
    want = {}
    for i, t in texts(before):
        want[i] = want.get(i, 0) + len(t.split()) + 1
    assert placed == want
