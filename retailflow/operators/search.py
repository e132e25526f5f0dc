"""Ranked text search over an inverted index kept as tables.

Postings (term, document, frequency, length) carry a level, their frequency's share of a score in LEVELS
steps, and lie sorted by term and level in folders by a hash of the term: what is read of them is a matter of
folders and of row groups' bounds. The dictionary has a row for each term and level, with how many postings there are
and the least and greatest share among them.

A search never looks at all postings of its terms. The dictionary alone gives a lower bound of the k-th best
score: the k best postings of one term already reach it. A posting whose own share and the greatest shares of all the search's
other terms together stay below that bound belongs to no document among the first k; its level is not read. What
is left travels once, whatever the number of searches, to a block of documents; the searches come there one after the other,
sum their terms' postings by document, and pass on the documents that may be among their first k. The k best of all blocks
are the answer, exactly.

Scores are BM25: a term found in df of N documents weighs ln(1 + (N - df + 0.5) / (df + 0.5)), and a frequency tf in
a document of `length` terms counts tf (k1 + 1) / (tf + k1 (1 - b + b length / average)). A term that a search repeats
counts as often. Ties go by document id.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from retailflow.functions.scalars import words
from retailflow.session import run_dir

K1 = 1.2
B = 0.75
LEVELS = 16
#: Postings of a folder, about.
FOLDER_ROWS = 20_000_000
#: Up to so many different terms of all searches are named to the scan; more are joined.
NAMED_TERMS = 5_000
#: Decimals of a score; equal beyond them is a tie.
DECIMALS = 6
#: Scores are compared with bounds with so much room: ties of rounded scores must not be cut.
_ROOM = 2 * 10.0**-DECIMALS
#: Postings of a block of documents, about.
BLOCK_POSTINGS = 1_000_000


@dataclass(frozen=True)
class SearchIndex:
    """Where an index lies, and the numbers of its documents that scores need."""

    spark: SparkSession
    path: str
    documents: int
    average: float
    folders: int
    id_type: str

    def postings(self) -> DataFrame:
        schema = f"term string, level int, doc_id {self.id_type}, tf int, length int, share double, folder int"
        return self.spark.read.schema(schema).parquet(f"{self.path}/postings")

    def dictionary(self) -> DataFrame:
        return self.spark.read.schema("term string, level int, postings long, low double, high double, folder int").parquet(f"{self.path}/dictionary")


def share(tf: Column, length: Column, average: float) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / average))


def _folder(term: Column, folders: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(folders)).cast("int")


def build_index(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> SearchIndex:
    """Indexes every document (its id must be its own). A document without a word is in no posting, but counts as a document."""
    spark = docs.sparkSession
    terms = docs.select(F.col(doc_id).alias("doc_id"), F.array_sort(F.coalesce(words(text), F.array().cast("array<string>"))).alias("terms"))
    # Words in order: equal ones stand together, so frequencies need no shuffle.
    at = F.transform("terms", lambda t, i: F.when((i == 0) | (F.get("terms", i - 1) != t), i))
    terms = terms.select("doc_id", "terms", F.size("terms").alias("length"), F.filter(at, lambda i: i.isNotNull()).alias("at"))
    counted = F.transform("at", lambda i, n: F.struct(F.get("terms", i).alias("term"), (F.coalesce(F.get("at", n + 1), F.col("length")) - i).alias("tf")))
    terms.select("doc_id", "length", F.inline_outer(counted)).write.parquet(f"{path}/frequencies")
    rows = spark.read.parquet(f"{path}/frequencies")
    # Every document has a row, be it one without a term.
    sums = rows.agg(F.sum(F.coalesce("tf", F.lit(0))), F.count("term")).first()
    documents = docs.count()
    average = (sums[0] or 0) / max(1, documents) or 1.0
    rows = rows.where("term IS NOT NULL")
    folders = max(1, -(-sums[1] // FOLDER_ROWS))
    value = share(F.col("tf"), F.col("length"), average)
    level = F.least(F.lit(LEVELS - 1), F.floor(value / (K1 + 1) * LEVELS)).cast("int")
    rows = rows.select("term", level.alias("level"), "doc_id", "tf", "length", value.alias("share"), _folder(F.col("term"), folders).alias("folder"))
    # By range, so that a term found nearly everywhere is spread over files, and its levels over row groups.
    order = ["folder", "term", "level", "doc_id"]
    rows.repartitionByRange(*order).sortWithinPartitions(*order).write.partitionBy("folder").parquet(f"{path}/postings")
    index = SearchIndex(spark, path, documents, average, folders, docs.schema[doc_id].dataType.simpleString())
    entries = index.postings().groupBy("folder", "term", "level").agg(F.count(F.lit(1)).alias("postings"), F.min("share").alias("low"), F.max("share").alias("high"))
    order = ["folder", "term", "level"]
    entries.repartitionByRange(*order).sortWithinPartitions(*order).write.partitionBy("folder").parquet(f"{path}/dictionary")
    return index


def _of_terms(rows: DataFrame, index: SearchIndex, terms: DataFrame) -> DataFrame:
    """The rows of the named terms."""
    named = [r[0] for r in terms.limit(NAMED_TERMS + 1).collect()]
    if len(named) > NAMED_TERMS:
        wanted = terms.select("term", _folder(F.col("term"), index.folders).alias("folder"))
        return rows.join(wanted, ["folder", "term"], "left_semi")
    here = terms.sparkSession.createDataFrame([(t,) for t in named], "term string")
    folders = [r[0] for r in here.select(_folder(F.col("term"), index.folders)).distinct().collect()]
    return rows.where(F.col("folder").isin(folders) & F.col("term").isin(named))


def levels_to_read(index: SearchIndex, searches: DataFrame, k: int) -> DataFrame:
    """search_id, term, level, weight, least: the postings that a search must read, and the score that its k-th best
    document reaches. searches: search_id, text."""
    asked = searches.select("search_id", F.explode(words("text")).alias("term")).groupBy("search_id", "term").agg(F.count(F.lit(1)).alias("times"))
    entries = _of_terms(index.dictionary(), index, asked.select("term").distinct())
    df = entries.groupBy("term").agg(F.sum("postings").alias("df"), F.max("high").alias("top"))
    idf = F.log(1 + (index.documents - F.col("df") + 0.5) / (F.col("df") + 0.5))
    asked = asked.join(df, "term").select("search_id", "term", (F.col("times") * idf).alias("weight"), "top")
    rows = asked.join(entries.select("term", "level", "postings", "low", "high"), "term")
    # The k best postings of a term: their least share bounds the k-th best score from below.
    down = Window.partitionBy("search_id", "term").orderBy(F.desc("level"))
    rows = rows.withColumn("reached", F.sum("postings").over(down) >= k)
    search = Window.partitionBy("search_id")
    rows = rows.withColumn("least", F.coalesce(F.max(F.when(F.col("reached"), F.col("weight") * F.col("low"))).over(search), F.lit(0.0)))
    # A term's greatest share stands in each of its level rows; once is enough.
    once = F.when(F.row_number().over(down) == 1, F.col("weight") * F.col("top"))
    rows = rows.withColumn("once", once).withColumn("all", F.sum("once").over(search))
    others = F.col("all") - F.col("weight") * F.col("top")
    return rows.where(F.col("weight") * F.col("high") + others >= F.col("least") - _ROOM).select("search_id", "term", "level", "weight", "least")


class _Block:
    """The postings of a block's documents by term, the higher levels first: those that a search reads are a run.
    postings: in the order of doc_id."""

    def __init__(self, postings: pa.Table):
        ids = postings["doc_id"].combine_chunks().dictionary_encode(null_encoding="encode")
        terms = postings["term"].combine_chunks().dictionary_encode()
        self.ids, self.terms = ids.dictionary, terms.dictionary
        key = self._key(terms.indices.to_numpy(), postings["level"].to_numpy())
        order = np.argsort(key, kind="stable")
        self.key, self.place, self.share = key[order], ids.indices.to_numpy()[order], postings["share"].to_numpy()[order]

    @staticmethod
    def _key(term: np.ndarray, level: np.ndarray | int) -> np.ndarray:
        return term.astype(np.int64) * LEVELS + (LEVELS - 1 - level)

    def best(self, runs: list[tuple[int, int, float]], least: float, most: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of the documents that may be among the first `most` of all blocks. runs: of postings, and their weights."""
        places = np.concatenate([self.place[a:b] for a, b, _ in runs])
        scores = np.bincount(places, np.concatenate([self.share[a:b] * weight for a, b, weight in runs]), len(self.ids))
        if len(scores) > most:
            least = max(least, np.partition(scores, -most)[-most])
        places = np.flatnonzero((scores > 0) & (scores >= least - _ROOM))
        places = places[np.argsort(-scores[places], kind="stable")]
        # Of documents with the same score only so many, those of least id, can be among the first.
        at, scores = np.arange(len(places)), scores[places]
        heads = np.r_[True, scores[1:] != scores[:-1]][: len(at)]
        keep = at - np.maximum.accumulate(np.where(heads, at, 0)) < most
        return places[keep], scores[keep]

    def answers(self, asked: pa.StructArray, most: int) -> pa.RecordBatch:
        """search_id, doc_id, score for all of these searches."""
        lists = asked.field("terms")
        flat, first = lists.flatten(), np.r_[0, np.cumsum(lists.value_lengths().to_numpy())]
        term = pc.fill_null(pc.index_in(flat.field("term"), value_set=self.terms), len(self.terms)).to_numpy()
        begin = np.searchsorted(self.key, self._key(term, LEVELS - 1))
        end = np.searchsorted(self.key, self._key(term, flat.field("level").to_numpy()), "right")
        runs = list(zip(begin.tolist(), end.tolist(), flat.field("weight").to_numpy().tolist(), strict=True))
        of, places, scores = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        for i, least in enumerate(asked.field("least").to_pylist()):
            own = [run for run in runs[first[i] : first[i + 1]] if run[0] < run[1]]
            if own:
                found, score = self.best(own, least, most)
                of.append(np.full(len(found), i))
                places.append(found)
                scores.append(score)
        of, places, scores = (pa.array(np.concatenate(x)) for x in (of, places, scores))
        return pa.RecordBatch.from_arrays([asked.field("search_id").take(of), self.ids.take(places), scores], ["search_id", "doc_id", "score"])


def _met(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Rows of blocks, each one's postings before its searches."""
    number, pending, block = None, [], None
    for batch in batches:
        numbers, asks = batch["block"].to_numpy(), batch["asked"].is_valid().to_numpy(zero_copy_only=False)
        heads = np.flatnonzero(np.r_[True, (numbers[1:] != numbers[:-1]) | (asks[1:] != asks[:-1])][: len(numbers)])
        for at, end in zip(heads.tolist(), [*heads[1:].tolist(), len(numbers)], strict=False):
            if numbers[at] != number:
                number, pending, block = numbers[at], [], None
            if not asks[at]:
                pending.append(batch.select(["term", "level", "doc_id", "share"]).slice(at, end - at))
                continue
            if pending:
                block, pending = _Block(pa.Table.from_batches(pending)), []
            if block is not None:  # else no document of the block holds a term of any search
                yield block.answers(batch["asked"].slice(at, end - at), most)


def search(index: SearchIndex, searches: DataFrame, k: int = 10, start: int = 0) -> DataFrame:
    """search_id, rank (from 1), doc_id, score: documents `start` to `start + k` of each search's ranking. searches:
    search_id, text; a document need hold only one of a text's words."""
    spark, most = index.spark, start + k
    path = run_dir(spark, "search-levels")
    levels = levels_to_read(index, searches, most)
    levels.write.parquet(path)
    wanted = spark.read.schema(levels.schema).parquet(path)
    # Who reads a level reads all higher ones.
    terms = wanted.groupBy("search_id", "term").agg(F.min("level").alias("level"), F.first("weight").alias("weight"), F.first("least").alias("least"))
    lowest = wanted.groupBy("term").agg(F.min("level").alias("lowest"))
    read = lambda rows: rows.join(lowest, "term").where("level >= lowest")
    many = read(index.dictionary()).agg(F.sum("postings")).first()[0] or 0
    blocks = max(spark.sparkContext.defaultParallelism, -(-many // BLOCK_POSTINGS))
    postings = read(_of_terms(index.postings(), index, lowest.select("term")))
    block = F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).cast("int")
    postings = postings.select(block.alias("block"), "term", "level", "doc_id", "share")
    asked = terms.groupBy("search_id").agg(F.first("least").alias("least"), F.array_sort(F.collect_list(F.struct("term", "level", "weight"))).alias("terms"))
    asked = asked.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.struct("search_id", "least", "terms").alias("asked"))
    rows = postings.unionByName(asked, allowMissingColumns=True).repartitionById(blocks, "block")
    rows = rows.sortWithinPartitions("block", F.col("asked").isNotNull(), "doc_id")
    schema = StructType([wanted.schema["search_id"], *index.postings().select("doc_id", F.col("share").alias("score")).schema])
    found = rows.mapInArrow(lambda batches: _met(batches, most), schema).withColumn("score", F.round("score", DECIMALS))
    rank = F.row_number().over(Window.partitionBy("search_id").orderBy(F.desc("score"), F.asc("doc_id")))
    return found.withColumn("rank", rank).where((F.col("rank") <= most) & (F.col("rank") > start)).select("search_id", "rank", "doc_id", "score")
