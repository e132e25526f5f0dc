"""Blocked Bloom filter as a table: a block is 512 bits in eight longs, a key sets one bit of each.

A filter is sized to its keys, 16 bits each, and has at most MAX_BLOCKS rows of nine longs (38 MB, for 17 million
keys), so that it may be broadcast. Beyond that it only gets less selective: it never misses a key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_BLOCKS = 1 << 19
KEYS_A_BLOCK = 32
_WORDS = 8


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def _masks(key: Column) -> list[Column]:
    bits = F.xxhash64(key, F.lit(1))
    one = F.lit(1).cast("long")
    return [F.call_function("shiftleft", one, F.shiftright(bits, 6 * i).bitwiseAND(F.lit(63)).cast("int")) for i in range(_WORDS)]


def build(keys: DataFrame, key: str) -> tuple[DataFrame, int]:
    """The filter of a column's non-null keys (rows: block, bits) and its number of blocks."""
    keys = keys.select(F.col(key).alias("key")).where("key IS NOT NULL")
    blocks = min(MAX_BLOCKS, 1 + keys.count() // KEYS_A_BLOCK)
    masked = keys.select(_block(F.col("key"), blocks).alias("bloom_block"), *[m.alias(f"m{i}") for i, m in enumerate(_masks(F.col("key")))])
    sets = masked.groupBy("bloom_block").agg(*[F.bit_or(f"m{i}").alias(f"m{i}") for i in range(_WORDS)])
    return sets.select("bloom_block", F.array(*[f"m{i}" for i in range(_WORDS)]).alias("bloom_bits")), blocks


def marked(frame: DataFrame, key: Column, bloom: tuple[DataFrame, int], name: str) -> DataFrame:
    """Adds `name`: false where the key is surely not among the filter's keys (null keys too)."""
    bits, blocks = bloom
    probe = frame.withColumn("bloom_block", _block(key, blocks)).join(F.broadcast(bits), "bloom_block", "left")
    hit = key.isNotNull() & F.col("bloom_bits").isNotNull()
    for i, mask in enumerate(_masks(key)):
        hit = hit & (F.col("bloom_bits")[i].bitwiseAND(mask) == mask)
    return probe.withColumn(name, F.coalesce(hit, F.lit(False))).drop("bloom_block", "bloom_bits")
