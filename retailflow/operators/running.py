"""Running totals within groups of any size.

A window function puts every group into one task. That is right for ordinary groups, but one
group may hold a large share of all rows. Groups above `limit` rows are therefore cut into
blocks along the order column; a block's rows start from the totals of the blocks before it.
The result is the same for both. Where there is no such group, which is counted first, there is
one window and nothing else.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOT_ROWS = 1_000_000
#: Sampled rows of a block, by which its borders are set.
SAMPLED = 16


def large_groups(rows: DataFrame, key: str, limit: int = HOT_ROWS) -> DataFrame | None:
    """(key, _n) of the groups above `limit` rows, None if there are none."""
    if rows.count() <= limit:
        return None
    large = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > limit)
    return None if large.isEmpty() else large


def block_borders(rows: DataFrame, key: str, order: str, limit: int = HOT_ROWS) -> DataFrame | None:
    """(key, _borders) of the groups above `limit` rows, None if there are none: values of the order
    column that cut a group into blocks of about `limit` rows, wherever its values lie.

    The borders are taken from the rows whose order value has a hash of few, so they are the same
    in every run. They stay a table, which the plan joins: there may be as many of them as rows/limit.
    """
    limit = max(int(limit), 1)
    large = large_groups(rows, key, limit)
    if large is None:
        return None
    drawn = F.pmod(F.xxhash64(order), F.lit(limit)) < SAMPLED
    values = F.array_sort(F.collect_list(F.when(drawn, F.col(order))))
    step = max(1, min(SAMPLED, limit))
    borders = F.filter(values, lambda v, i: i % step == step - 1)
    return rows.select(key, order).join(large, key, "left_semi").groupBy(key).agg(borders.alias("_borders"))


def with_block(rows: DataFrame, borders: DataFrame, key: str, order: str) -> DataFrame:
    """Adds `_block`: how many borders of its group lie at or before a row; NULL in ordinary groups."""
    return rows.join(borders, key, "left").withColumn("_block", F.size(F.filter("_borders", lambda b: b <= F.col(order)))) \
        .withColumn("_block", F.when(F.col("_borders").isNotNull(), F.col("_block"))).drop("_borders")


def _before(rows: DataFrame, keys: list[str], order: str, sums: dict[str, str]) -> DataFrame:
    before = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.select("*", *[F.sum(v).over(before).alias(n) for n, v in sums.items()])


def running_totals(
    rows: DataFrame,
    key: str,
    order: str,
    sums: dict[str, str],
    limit: int = HOT_ROWS,
    sizes_from: DataFrame | None = None,
) -> DataFrame:
    """Adds each sum (result name to value column) over the rows before this one in its group; NULL
    on a group's first row. Groups may have any size. `sizes_from` may name a cheaper frame with at
    least the same (key, order) pairs to find large groups in."""
    borders = block_borders((rows if sizes_from is None else sizes_from).select(key, order), key, order, limit)
    if borders is None:
        return _before(rows, [key], order, sums)
    blocked = with_block(rows, borders, key, order)
    # Totals of whole blocks are combined before their shuffle; only large groups have blocks.
    totals = blocked.filter(F.col("_block").isNotNull()).groupBy(key, "_block").agg(*[F.sum(v).alias(f"_s_{n}") for n, v in sums.items()])
    starts = _before(totals, [key], "_block", {f"_t_{n}": f"_s_{n}" for n in sums}).select(key, "_block", *[f"_t_{n}" for n in sums])
    joined = _before(blocked, [key, "_block"], order, sums).join(starts, [key, "_block"], "left")

    def combined(n: str) -> Column:
        start, inner = F.col(f"_t_{n}"), F.col(n)
        return F.when(start.isNotNull() | inner.isNotNull(), F.coalesce(start, F.lit(0)) + F.coalesce(inner, F.lit(0)))

    return joined.select(*rows.columns, *[combined(n).alias(n) for n in sums])
