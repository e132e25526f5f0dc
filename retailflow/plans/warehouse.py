"""The warehouse layers as batch plans over the source tables."""

from __future__ import annotations

from pyspark.sql import DataFrame

from retailflow import schemas
from retailflow.operators import dimensions, orders, wide
from retailflow.session import run_dir
from retailflow.sources import storage, tables
from retailflow.sources.tables import AS_OF, Tables


def users(t: Tables) -> DataFrame:
    return dimensions.user_dim(t.user_rows, AS_OF)


def skus(t: Tables) -> DataFrame:
    return dimensions.sku_dims(t.sku_rows, t.category3, t.trademark, t.spu)


def dwd_orders(t: Tables) -> DataFrame:
    """Orders with every field filled. What is joined by user comes first and shares one
    partitioning, what is joined by order id comes last and shares another, which the join with
    the lines reuses: orders are shuffled twice in all."""
    placed = dimensions.order_user(t.order_placed, users(t))
    placed = dimensions.order_province(orders.with_create_day_hour(placed), t.province)
    priced = tables.with_totals(placed, t.raw("lineitem"))
    return orders.set_first_flag(priced, orders.first_orders(t.order_heads, t.user_state))


def dwd_details(t: Tables) -> DataFrame:
    return dimensions.detail_sku(t.order_detail, skus(t))


def order_wide(t: Tables) -> DataFrame:
    return wide.order_wide(dwd_orders(t), dwd_details(t), sizes_from=t.order_detail)


#: Source tables of the wide table.
WIDE_SOURCES = ("orders", "customer", "lineitem", "part", "nation", "region")
_STORED: dict[tuple, str] = {}


def stored_wide(t: Tables, date: str | None = None) -> DataFrame:
    """The wide table as the analytical store holds it, by month: what the reports read. Built by the first report of an
    application that asks, and again when a source table's files are others."""
    sources = tuple(storage.signature(t.spark, f"{t.sf_dir}/{name}.parquet") for name in WIDE_SOURCES)
    key = (t.spark.sparkContext.applicationId, t.sf_dir, sources)
    if key not in _STORED:
        path = run_dir(t.spark, "order-wide")
        # Tasks hold all months' rows in quantity: bringing these together would be the largest shuffle of all.
        storage.append_olap(order_wide(t), path, 0, as_dealt=True)
        for old in [k for k in _STORED if k[:2] == key[:2]]:
            del _STORED[old]
        _STORED[key] = path
    return storage.read_olap(t.spark, _STORED[key], schemas.ORDER_WIDE, date)
