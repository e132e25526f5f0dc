"""Dimension versions with their validity, and facts joined with the version of their own time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from retailflow.operators import running

SALTS = 16
#: A key with more facts may be dealt over several places.
HOT_FACTS = 4_000


def with_validity(changes: DataFrame, key: str, at: str, tie: str | None = None) -> DataFrame:
    """A row per version of a key: `valid_from` (its own time) and `valid_to`, when the next one begins (NULL for the current
    one). Of several changes at one time the last by `tie` counts."""
    last = changes
    if tie is not None:
        rank = F.row_number().over(Window.partitionBy(key, at).orderBy(F.desc(tie)))
        last = changes.withColumn("_rank", rank).where(F.col("_rank") == 1).drop("_rank")
    following = F.lead(at).over(Window.partitionBy(key).orderBy(at))
    return last.withColumn("valid_from", F.col(at)).withColumn("valid_to", following)


def as_of(
    facts: DataFrame, versions: DataFrame, key: str, at: str, version_key: str, version_at: str, columns: list[str], salts: int = SALTS,
    hot_rows: int = HOT_FACTS, sizes_from: DataFrame | None = None,
) -> DataFrame:
    """Facts with `columns` of the version of their key that was the latest at their time (the same instant counts); NULLs where
    there was none, or the fact has no key or time. A key has at most one version at a time.

    Facts and versions of a key are sorted once, by time, and the last version is carried forward to the facts behind it:
    no fact meets any other version. The facts of a key above `hot_rows` are dealt over up to `salts` places, with a copy of its
    versions each, so a key with very many facts is as many tasks' work. There are only as many places as keep the copies below
    the key's own facts and versions together; other keys' versions are there once.
    `sizes_from` may name a cheaper frame with at least the same keys, a row for each fact, to find such keys in."""
    names = facts.columns
    carried = F.struct(*[F.col(c) for c in columns])
    own = facts.select(
        F.col(key).alias("_key"), F.col(at).alias("_at"), F.lit(1).alias("_kind"), F.xxhash64(*names).alias("_hash"), F.struct(*names).alias("_fact"))
    given = versions.where(F.col(version_key).isNotNull() & F.col(version_at).isNotNull()).select(
        F.col(version_key).alias("_key"), F.col(version_at).alias("_at"), F.lit(0).alias("_kind"), carried.alias("_version"))
    keys = (facts if sizes_from is None else sizes_from).select(F.col(key).alias("_key")).where("_key IS NOT NULL")
    large = running.large_groups(keys, "_key", hot_rows)
    if large is None:
        own, given = own.withColumn("_places", F.lit(1)), given.withColumn("_salt", F.lit(0))
    else:
        each = given.groupBy("_key").agg(F.count(F.lit(1)).alias("_versions"))
        places = F.coalesce(F.least(F.lit(salts), F.expr("1 + _n div _versions")), F.lit(salts)).cast("int")
        large = large.join(each, "_key", "left").select("_key", places.alias("_places"))
        own = own.join(large, "_key", "left").withColumn("_places", F.coalesce("_places", F.lit(1)))
        copies = F.explode(F.sequence(F.lit(0), F.coalesce("_places", F.lit(1)) - 1))
        given = given.join(large, "_key", "left").withColumn("_salt", copies).drop("_places")
    # Facts of no key have no version to meet.
    own = own.withColumn("_salt", F.pmod("_hash", F.when(F.col("_key").isNull(), salts).otherwise(F.col("_places"))).cast("int")).drop("_hash", "_places")
    rows = own.unionByName(given, allowMissingColumns=True)
    before = Window.partitionBy("_key", "_salt").orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = F.last("_version", ignorenulls=True).over(before)
    rows = rows.withColumn("_found", found).where(F.col("_kind") == 1)
    return rows.select("_fact.*", *[F.when(F.col("_key").isNotNull() & F.col("_at").isNotNull(), F.col(f"_found.{c}")).alias(c) for c in columns])
