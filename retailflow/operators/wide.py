"""Order lines joined with their orders, and the paid amount split over the lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retailflow import schemas
from retailflow.functions import to_cents
from retailflow.operators import running
from retailflow.operators.active import first_per_key

SUMS_BEFORE = {"_gross_before": "_gross", "_share_before": "_share"}


def gross_line_amount(sku_num: Column | str = "sku_num", price: Column | str = "sku_price") -> Column:
    num = F.col(sku_num) if isinstance(sku_num, str) else sku_num
    unit = F.col(price) if isinstance(price, str) else price
    return num * unit


# Fields of the wide record that come from the order line, and fields with another name there.
FROM_DETAIL = {
    "order_detail_id": "id", "sku_id": "sku_id", "sku_price": "order_price", "sku_num": "sku_num",
    "sku_name": "sku_name", "spu_id": "spu_id", "tm_id": "tm_id", "category3_id": "category3_id",
    "spu_name": "spu_name", "tm_name": "tm_name", "category3_name": "category3_name",
}
RENAMED_FROM_ORDER = {"order_id": "id", "dt": "create_date"}


def wide_columns(order: str, detail: str) -> list[Column]:
    """The wide record from a join of both sides under these aliases. `final_detail_amount` is 0
    until the paid amount is split."""

    def source(name: str) -> Column:
        if name == "final_detail_amount":
            return F.lit(0.0)
        if name in FROM_DETAIL:
            return F.col(f"{detail}.{FROM_DETAIL[name]}")
        return F.col(f"{order}.{RENAMED_FROM_ORDER.get(name, name)}")

    return [source(f.name).cast(f.dataType).alias(f.name) for f in schemas.ORDER_WIDE.fields]


def wide_merge(orders: DataFrame, details: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """Inner join on the order id, projected to the wide record. `carry` names further detail
    columns to keep."""
    return (
        orders.alias("o")
        .join(details.alias("d"), F.col("o.id") == F.col("d.order_id"), "inner")
        .select(*wide_columns("o", "d"), *[F.col(f"d.{c}").alias(c) for c in carry])
    )


def order_detail_join(orders: DataFrame, details: DataFrame) -> DataFrame:
    """Plain inner join of both records, as (order struct, detail struct) pairs by order id."""
    o = orders.select(F.col("id").alias("order_id"), F.struct(*orders.columns).alias("order"))
    d = details.select("order_id", F.struct(*details.columns).alias("detail"))
    return o.join(d, "order_id", "inner")


def detail_dedup(rows: DataFrame, order: list[str], keys: tuple[str, ...] = ("order_id", "order_detail_id")) -> DataFrame:
    """First occurrence per order line."""
    return first_per_key(rows, list(keys), order)


def proportional_share(gross: str, paid: str, original: str) -> Column:
    """gross * paid / original in whole cents, rounded half up on the exact quotient; 0 for an
    original of 0. Factors of up to 2**31 cents stay in bigint arithmetic, larger ones go through
    decimals."""
    small = f"abs({gross}) < 2147483648 AND abs({paid}) < 2147483648 AND abs({original}) < 2147483648"
    narrow = f"(2 * {gross} * {paid} + {original}) div (2 * {original})"
    g, p, o = (f"CAST({c} AS DECIMAL(18,0))" for c in (gross, paid, original))
    broad = f"((2 * {g} * {p} + {o}) div (2 * {o}))"
    return F.expr(
        f"CASE WHEN {original} = 0 THEN 0L WHEN {small} THEN {narrow} ELSE {broad} END"
    )


def with_cents(wide: DataFrame) -> DataFrame:
    return (
        wide.withColumn("_gross", to_cents(gross_line_amount()))
        .withColumn("_paid", to_cents("final_total_amount"))
        .withColumn("_original", to_cents("original_total_amount"))
        .withColumn("_share", proportional_share("_gross", "_paid", "_original"))
    )


def _close(rows: DataFrame, close_on: str) -> DataFrame:
    """The line whose gross amount completes the target total takes what is left of the paid
    amount; every other line takes its proportional share."""
    target = {"original": F.col("_original"), "final": F.col("_paid")}[close_on]
    reached = F.coalesce("_gross_before", F.lit(0)) + F.col("_gross") == target
    # Zero-amount lines after the closing one must not close again.
    closes = reached & ((F.col("_gross") != 0) | F.col("_gross_before").isNull())
    left = F.col("_paid") - F.coalesce("_share_before", F.lit(0))
    cents = F.when(closes, left).otherwise(F.col("_share"))
    helpers = ["_gross", "_paid", "_original", "_share", "_gross_before", "_share_before"]
    return rows.withColumn("final_detail_amount", cents / 100.0).drop(*helpers)


def _totals(wide: DataFrame, hot_rows: int, sizes_from: DataFrame | None) -> DataFrame:
    return running.running_totals(
        with_cents(wide), "order_id", "order_detail_id", SUMS_BEFORE, hot_rows, sizes_from
    )


def pay_apportion(
    wide: DataFrame,
    close_on: str = "original",
    hot_rows: int = running.HOT_ROWS,
    sizes_from: DataFrame | None = None,
) -> DataFrame:
    """Splits every order's paid total over its lines, in line-id order, to the cent. `close_on`
    names the total that tells the last line: "original" is right, "final" is the variant that
    only sees a last line when nothing was reduced."""
    return _close(_totals(wide, hot_rows, sizes_from), close_on)


def pay_apportion_on(
    wide: DataFrame,
    sums: DataFrame,
    close_on: str = "original",
    hot_rows: int = running.HOT_ROWS,
    sizes_from: DataFrame | None = None,
) -> DataFrame:
    """The same for lines of orders that may have lines in earlier batches: `sums` holds their
    (order_id, gross, share) increments in cents."""
    earlier = sums.groupBy(F.col("order_id").alias("_order")).agg(
        F.sum("gross").alias("_gross_earlier"), F.sum("share").alias("_share_earlier")
    )
    rows = _totals(wide, hot_rows, sizes_from)
    rows = rows.join(earlier, F.col("order_id") == F.col("_order"), "left")

    def added(inside: str, before: str) -> Column:
        nothing = F.col(inside).isNull() & F.col(before).isNull()
        return F.when(~nothing, F.coalesce(inside, F.lit(0)) + F.coalesce(before, F.lit(0)))

    rows = rows.withColumn("_gross_before", added("_gross_before", "_gross_earlier"))
    rows = rows.withColumn("_share_before", added("_share_before", "_share_earlier"))
    return _close(rows, close_on).drop("_order", "_gross_earlier", "_share_earlier")


def order_sums(split: DataFrame) -> DataFrame:
    """Gross and paid amount of these lines per order, in cents, with the order's day."""
    return split.groupBy("order_id", "dt").agg(
        F.sum(to_cents(gross_line_amount())).alias("gross"), F.sum(to_cents("final_detail_amount")).alias("share")
    )


def order_running_sums(
    wide: DataFrame, hot_rows: int = running.HOT_ROWS, sizes_from: DataFrame | None = None
) -> DataFrame:
    """Per line: gross and proportional share of the order's lines up to this one, in cents."""
    rows = _totals(wide, hot_rows, sizes_from)
    return rows.withColumn("gross_so_far", F.coalesce("_gross_before", F.lit(0)) + F.col("_gross")).withColumn(
        "share_so_far", F.coalesce("_share_before", F.lit(0)) + F.col("_share")
    )


def order_wide(
    orders: DataFrame,
    details: DataFrame,
    close_on: str = "original",
    hot_rows: int = running.HOT_ROWS,
    sizes_from: DataFrame | None = None,
) -> DataFrame:
    """Join, merge and split in one plan. One shuffle of the lines by order id serves the join and
    the running totals; oversized partitions of the join are split at run time. `sizes_from` may
    name the details before enrichment, so that looking for large orders reads two columns."""
    lines = (sizes_from if sizes_from is not None else details).select("order_id", F.col("id").alias("order_detail_id"))
    return pay_apportion(wide_merge(orders, details), close_on, hot_rows, lines)
