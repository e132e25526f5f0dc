"""The operators as queries over whole tables, and their SQL counterparts where SQL has the means."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retailflow.llm import alignment, embedding_forest, exact_dedup, language_model, line_dedup, mixing, negatives, ngram_join, packing, quality, tokens, url_filter, warc
from retailflow.llm.common import fold, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(run: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = oracle
        return run

    return register


#: Tokens of the longest n-grams that are counted.
ORDER = 3


@query("op1_language_model")
def op1_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns from nine tenths of the documents and scores all."""
    docs = table(spark, sf_dir, "documents")
    held_out = F.pmod(fold("doc_id"), F.lit(10)) == 0
    model = language_model.fit(docs.where(~held_out), ORDER)
    return language_model.scored(docs, model).select(
        "doc_id", held_out.alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")


@query("op2_embedding_forest")
def op2_embedding_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_forest.linked(table(spark, sf_dir, "embeddings"))


#: Canonical URLs whose digest begins so are listed: an eighth of all.
LISTED_DIGESTS = "^[4c]"


@query("op3_url_filter", r"""
WITH parts AS (
    SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
page AS (
    SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
           regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, regexp_extract(rest, '^[^?#]*\?([^#]*)', 1) AS query FROM parts),
named AS (
    SELECT *, CASE WHEN starts_with(host, 'www.') THEN substr(host, 5) ELSE host END || rtrim(path, '/') AS place,
           array_to_string(list_sort(list_filter(string_split(query, '&'), lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[a-z]+|ref)(=|$)'))), '&') AS kept
    FROM page),
judged AS (
    SELECT page_id, host, path, host <> '' AND regexp_matches(md5(place || CASE WHEN kept <> '' THEN '?' || kept ELSE '' END), '^[4c]') AS listed FROM named)
SELECT *, CASE WHEN starts_with(coalesce(rule, ''), 'example.net') OR starts_with(coalesce(rule, ''), 'org') THEN 'allow'
               WHEN rule IS NOT NULL THEN 'block' WHEN listed THEN 'block' ELSE 'allow' END AS verdict
FROM (SELECT page_id, host, path, listed,
             CASE WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
                  WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
                  WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
                  WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule
      FROM judged)""")
def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judges every page. The list: an eighth of all canonical URLs, by their digests; a page is listed
    in whatever spelling its url comes."""
    pages = table(spark, sf_dir, "pages")
    canonical = url_filter.canonical(F.col("url"))
    listed = pages.select(canonical.alias("canonical")).where(F.md5("canonical").rlike(LISTED_DIGESTS))
    return url_filter.judge(pages, listed)


@query("op4_exact_dedup", r"""
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS n, translate(coalesce(text, ''), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '') AS s FROM documents)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256
FROM (SELECT doc_id, first_value(doc_id) OVER (PARTITION BY s ORDER BY n DESC, doc_id) AS keep_id,
             count(*) OVER (PARTITION BY s) AS group_size, sha256(s) AS text_sha256 FROM t)""")
def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.groups(table(spark, sf_dir, "documents"))


@query("op8_mix_sources")
def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(table(spark, sf_dir, "documents"))


VOCABULARY = "word_bpe_49k.json"
MOST_TOKENS = 2048


@query("op5_token_counts")
def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.counted(table(spark, sf_dir, "documents"), VOCABULARY).withColumn("over_limit", F.col("n_tokens") > MOST_TOKENS)


@query("op6_ngram_jaccard_join")
def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.clusters(table(spark, sf_dir, "documents"))


@query("op7_warc", r"""
SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, refers_to, CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type, payload_digest
FROM (SELECT page_id, html, nullif(min(page_id) OVER (PARTITION BY coalesce(html, '')), page_id) AS refers_to,
             (SELECT string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (CAST('0x' || substr(sha1(coalesce(html, '')), 1 + 5 * (i // 4), 5) AS BIGINT) >> (15 - 5 * (i % 4))) % 32, 1), '' ORDER BY i)
              FROM range(32) AS r(i)) AS payload_digest
      FROM pages)""")
def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


@query("op9_best_fit_packing")
def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"))


#: Scores from here on count as good.
LEAST_QUALITY = 0.7


@query("op10_quality")
def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns from three quarters of the labels; the last is held out."""
    docs = table(spark, sf_dir, "documents")
    held_out = F.pmod(fold("doc_id"), F.lit(4)) == 2
    machine = quality.fitted(docs, table(spark, sf_dir, "labels").where(~held_out))
    return quality.scored(docs, machine).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= LEAST_QUALITY).cast("int").alias("predicted"))


@query("op11_line_dedup", r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT r, doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS i FROM d),
k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
hot AS (SELECT key AS hot FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT r) >= 10)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(hot) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE hot IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN hot ON key = hot GROUP BY r""")
def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digests(table(spark, sf_dir, "documents"))


@query("op12_hard_negatives", r"""
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS x FROM embeddings
           WHERE label IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, CAST(list_inner_product(a.x, b.x) AS BIGINT) AS score
      FROM v AS a JOIN v AS b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, other_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id)
QUALIFY row_number() OVER w <= 10""")
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mined(table(spark, sf_dir, "embeddings"), label)


BYTE_LEVEL, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"


@query("op13_token_alignment")
def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.scored(table(spark, sf_dir, "documents"), BYTE_LEVEL, PIECES)


query("pipeline", corpus_pipeline.ORACLE_SQL)(corpus_pipeline.run)
