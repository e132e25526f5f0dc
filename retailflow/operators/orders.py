"""Order enrichment: day and hour, first-order flag, user state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retailflow.functions import day_of_text, hour_of_text


def with_create_day_hour(orders: DataFrame) -> DataFrame:
    return orders.withColumn("create_date", day_of_text("create_time")).withColumn(
        "create_hour", hour_of_text("create_time")
    )


def _number(text_id: str) -> Column:
    """The state table keeps ids as text. Comparing numbers leaves the orders' side of a join as
    it is partitioned already."""
    return F.expr(f"try_cast({text_id} AS bigint)")


def order_flag_lookup(orders: DataFrame, user_state: DataFrame) -> DataFrame:
    """Flag from the state table alone: "0" for users known to have consumed, else "1"."""
    state = user_state.select(_number("user_id").alias("_user"), "if_consumed")
    return (
        orders.join(state, F.col("user_id") == F.col("_user"), "left")
        .withColumn(
            "if_first_order", F.when(F.coalesce("if_consumed", F.lit("")) == "1", "0").otherwise("1")
        )
        .drop("_user", "if_consumed")
    )


def first_orders(orders: DataFrame, user_state: DataFrame | None = None) -> DataFrame:
    """(user_id, id) of the earliest order of every user who had not consumed before. One row per
    user and task is shuffled, however many orders a user has."""
    earliest = (
        orders.groupBy("user_id")
        .agg(F.min(F.struct("create_time", "id")).alias("_first"))
        .select("user_id", F.col("_first.id").alias("id"))
    )
    if user_state is None:
        return earliest
    consumed = user_state.filter(F.col("if_consumed") == "1").select(_number("user_id").alias("_user"))
    return earliest.join(consumed, F.col("user_id") == F.col("_user"), "left_anti")


def set_first_flag(orders: DataFrame, firsts: DataFrame) -> DataFrame:
    """Sets `if_first_order` from the ids of first orders.

    The flag comes back by order id, not by user: order ids are unique, so a user with a large
    part of all orders loads no single task, and the join with the order lines that follows can
    reuse the partitioning by order id.
    """
    flags = firsts.select("id", F.lit("1").alias("_flag"))
    kept = [c for c in orders.columns if c != "if_first_order"]
    return (
        orders.select(*kept)
        .join(flags, "id", "left")
        .withColumn("if_first_order", F.coalesce("_flag", F.lit("0")))
        .drop("_flag")
    )


def first_order_flag(orders: DataFrame, user_state: DataFrame | None = None) -> DataFrame:
    """"1" on the earliest order (create_time, then id) of a user without earlier consumption,
    "0" on all others."""
    return set_first_flag(orders, first_orders(orders, user_state))


def user_firsts(user_state: DataFrame) -> DataFrame:
    """What the state says of each user: `known` (consumed before all orders there are) or the first order so far,
    as (create_time, id). A user may have several rows, of orders found to be earlier and earlier."""
    order = F.struct("create_time", F.col("order_id").alias("id"))
    consumed = user_state.filter(F.col("if_consumed") == "1")
    return consumed.groupBy(_number("user_id").alias("_user")).agg(
        F.bool_or(F.col("order_id").isNull()).alias("_known"), F.min(F.when(F.col("order_id").isNotNull(), order)).alias("_so_far"))


def flags_and_corrections(orders: DataFrame, user_state: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The orders with their flags, and the orders (id, create_time) that lose theirs to an earlier order of this batch.

    "1" is on the earliest order (create_time, then id) of a user of all that came so far, whatever order
    they came in. An order that comes again keeps its flag, unless it has lost it since."""
    earliest = orders.groupBy("user_id").agg(F.min(F.struct("create_time", "id")).alias("_first"))
    both = earliest.join(user_firsts(user_state), F.col("user_id") == F.col("_user"), "left").where("NOT coalesce(_known, false)")
    first = F.when(F.col("_so_far").isNull() | (F.col("_first") < F.col("_so_far")), F.col("_first")).otherwise(F.col("_so_far"))
    flagged = set_first_flag(orders, both.select(first["id"].alias("id")))
    lost = both.where(F.col("_first") < F.col("_so_far")).select("_so_far.id", "_so_far.create_time")
    return flagged, lost


def new_consumers(orders: DataFrame) -> DataFrame:
    first = orders.filter(F.col("if_first_order") == "1")
    return first.select(F.col("user_id").cast("string").alias("user_id"), F.lit("1").alias("if_consumed"), F.col("id").alias("order_id"), "create_time")
