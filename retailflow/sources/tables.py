"""Warehouse records derived from the star-schema tables.

The tables have no application logs, no CDC envelopes and no derived totals, so this module
states how each input record of the warehouse comes from them. Everything is a row-wise
projection, a lookup join or an aggregate with map-side combine; only what a caller asks for
is computed.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from retailflow.functions import name_id, number_id, to_cents
from retailflow.session import configure

AS_OF = "2021-02-16"


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = configure(spark)
        self.sf_dir = sf_dir.rstrip("/")

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def raw_stream(self, name: str, files_per_trigger: int | None = None) -> DataFrame:
        """The same table as a stream of its files. The bracket makes the path a pattern, so a
        table may be one file or a folder of files."""
        reader = self.spark.readStream.schema(self.raw(name).schema)
        if files_per_trigger:
            reader = reader.option("maxFilesPerTrigger", files_per_trigger)
        return reader.parquet(f"{self.sf_dir}/{name}.parque[t]")

    # -- application logs -------------------------------------------------------------------

    @cached_property
    def startups(self) -> DataFrame:
        return startups(self.raw("events"))

    @cached_property
    def app_logs(self) -> DataFrame:
        return app_logs(self.raw("events"))

    # -- order records ----------------------------------------------------------------------

    @cached_property
    def order_heads(self) -> DataFrame:
        return order_heads(self.raw("orders"))

    @cached_property
    def order_placed(self) -> DataFrame:
        return order_placed(self.raw("orders"), self.raw("customer"))

    @cached_property
    def order_info(self) -> DataFrame:
        return order_info(self.raw("orders"), self.raw("customer"), self.raw("lineitem"))

    @cached_property
    def order_detail(self) -> DataFrame:
        return order_detail(self.raw("lineitem"))

    # -- dimensions -------------------------------------------------------------------------

    @cached_property
    def province(self) -> DataFrame:
        region = self.raw("region")
        nation = self.raw("nation")
        return nation.join(region, nation.n_regionkey == region.r_regionkey, "left").select(
            F.col("n_nationkey").cast("string").alias("id"),
            F.col("n_name").alias("name"),
            F.col("r_name").alias("area_code"),
            F.concat(F.lit("CN-"), F.col("n_nationkey").cast("string")).alias("iso_code"),
            F.concat(F.lit("ISO-"), F.col("n_nationkey").cast("string")).alias("iso_3166_2"),
        )

    @cached_property
    def user_rows(self) -> DataFrame:
        return user_rows(self.raw("customer"))

    @cached_property
    def sku_rows(self) -> DataFrame:
        return sku_rows(self.raw("part"))

    @cached_property
    def category3(self) -> DataFrame:
        return (
            self.raw("part").select(F.col("p_type").alias("name")).distinct()
            .select(
                name_id("name").cast("string").alias("id"),
                "name",
                F.length("name").cast("string").alias("category2_id"),
            )
        )

    @cached_property
    def trademark(self) -> DataFrame:
        return (
            self.raw("part").select(F.col("p_brand").alias("tm_name")).distinct()
            .select(name_id("tm_name").cast("string").alias("tm_id"), "tm_name")
        )

    @cached_property
    def spu(self) -> DataFrame:
        return (
            self.raw("part").select(F.col("p_name").alias("spu_name")).distinct()
            .select(name_id("spu_name").cast("string").alias("id"), "spu_name")
        )

    @cached_property
    def user_state(self) -> DataFrame:
        """Users known to have ordered before: every tenth customer."""
        return (
            self.raw("customer")
            .filter(F.col("c_custkey") % 10 == 0)
            .select(F.col("c_custkey").cast("string").alias("user_id"), F.lit("1").alias("if_consumed"))
        )


def _ms(ts: str) -> Column:
    return F.unix_millis(F.col(ts).cast("timestamp"))


def _device() -> Column:
    user = F.col("user_id").cast("string")
    event = F.col("event_id")
    return F.struct(
        user.alias("mid"),
        user.alias("uid"),
        F.concat(F.lit("area_"), (event % 34).cast("string")).alias("ar"),
        F.concat(F.lit("channel_"), (event % 5).cast("string")).alias("ch"),
        F.concat(F.lit("v1."), (event % 4).cast("string")).alias("vc"),
    )


def startups(events: DataFrame) -> DataFrame:
    """Every event as a startup log (typed form); `seq` is its position in the topic."""
    return events.select(_device().alias("common"), _ms("ts").alias("ts"), F.col("event_id").alias("seq"))


def app_logs(events: DataFrame) -> DataFrame:
    """Every event as a JSON log line: signups and views carry a `start` object, errors an empty
    one, the rest none."""
    common = _device().alias("common")
    ts = _ms("ts").alias("ts")
    opened = F.to_json(F.struct(common, F.struct(F.col("event_type").alias("entry")).alias("start"), ts))
    empty = F.to_json(F.struct(common, F.lit("").alias("start"), ts))
    action = F.to_json(F.struct(common, F.struct(F.col("event_type").alias("id")).alias("action"), ts))
    return events.select(
        F.col("event_id").alias("seq"),
        F.when(F.col("event_type").isin("signup", "view"), opened)
        .when(F.col("event_type") == "error", empty)
        .otherwise(action)
        .alias("value"),
    )


def order_heads(orders: DataFrame) -> DataFrame:
    """Orders as the shop's database knows them, without province and totals. The date column
    holds midnights; the time of day comes from the key."""
    created = F.date_format(
        F.expr("timestampadd(SECOND, o_orderkey * 7919 % 86400, o_orderdate)"), "yyyy-MM-dd HH:mm:ss"
    )
    return orders.select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("user_id"),
        F.col("o_orderstatus").alias("order_status"),
        created.alias("create_time"),
    )


def order_totals(lineitem: DataFrame) -> DataFrame:
    """Original and paid total per order, in cents."""
    original = to_cents("l_extendedprice")
    paid = to_cents(F.col("l_extendedprice") * (1 - F.col("l_discount")))
    return lineitem.groupBy(F.col("l_orderkey").alias("id")).agg(
        F.sum(original).alias("_original"), F.sum(paid).alias("_paid")
    )


def order_placed(orders: DataFrame, customer: DataFrame) -> DataFrame:
    """Order heads with the province of their user."""
    home = customer.select(
        F.col("c_custkey").alias("user_id"), F.col("c_nationkey").cast("bigint").alias("province_id")
    )
    return order_heads(orders).join(home, "user_id", "left")


def with_totals(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    """Adds the amounts of an order, which the tables only have per line."""
    original = F.coalesce("_original", F.lit(0))
    paid = F.coalesce("_paid", F.lit(0))
    return (
        orders.join(order_totals(lineitem), "id", "left")
        .withColumn("final_total_amount", paid / 100.0)
        .withColumn("benefit_reduce_amount", (original - paid) / 100.0)
        .withColumn("original_total_amount", original / 100.0)
        .withColumn("feight_fee", F.lit(0.0))
        .drop("_original", "_paid")
    )


def order_info(orders: DataFrame, customer: DataFrame, lineitem: DataFrame) -> DataFrame:
    return with_totals(order_placed(orders, customer), lineitem)


def order_detail(lineitem: DataFrame) -> DataFrame:
    """Order lines. (l_orderkey, l_linenumber) repeats, whole rows do not, so the id is a number
    taken from the whole row: no ranking, hence no shuffle, and any order may be arbitrarily long.
    Being 60 bits it is unique within an order; it is always used together with order_id."""
    row = [
        *[F.col(c).cast("bigint") for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity")],
        *[to_cents(c) for c in ("l_extendedprice", "l_discount", "l_tax")],
        *[F.ascii(c).cast("bigint") for c in ("l_returnflag", "l_linestatus")],
        F.unix_date(F.col("l_shipdate").cast("date")).cast("bigint"),
    ]
    return lineitem.select(
        number_id(row).alias("id"),
        F.col("l_orderkey").alias("order_id"),
        F.col("l_partkey").alias("sku_id"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("order_price"),
        F.col("l_quantity").cast("bigint").alias("sku_num"),
    )


def user_rows(customer: DataFrame) -> DataFrame:
    key = F.col("c_custkey")
    return customer.select(
        key.cast("string").alias("id"),
        F.col("c_mktsegment").alias("user_level"),
        F.date_add(F.lit("1960-01-01").cast("date"), (key * 37 % 20000).cast("int")).cast("string").alias("birthday"),
        F.when(key % 2 == 0, "M").otherwise("F").alias("gender"),
    )


def sku_rows(part: DataFrame) -> DataFrame:
    return part.select(
        F.col("p_partkey").cast("string").alias("id"),
        name_id("p_name").cast("string").alias("spu_id"),
        F.format_string("%.2f", "p_retailprice").alias("price"),
        F.col("p_name").alias("sku_name"),
        name_id("p_brand").cast("string").alias("tm_id"),
        name_id("p_type").cast("string").alias("category3_id"),
        F.lit("2020-01-01 00:00:00").alias("create_time"),
    )


def change_log(rows: DataFrame, table: str, number: str) -> DataFrame:
    """Rows as single-row CDC envelopes (JSON text). The change type goes by the row's number:
    one in ten is a delete, two an update, one a bootstrap row, the rest inserts. `seq` is the
    position in the topic."""
    digit = F.col(number).cast("bigint") % 10
    kind = (
        F.when(digit == 0, "delete").when(digit.isin(1, 2), "update")
        .when(digit == 3, "bootstrap-insert").otherwise("insert")
    )
    return rows.select(
        F.col(number).cast("bigint").alias("seq"),
        F.to_json(
            F.struct(F.lit(table).alias("table"), kind.alias("type"), F.struct(*rows.columns).alias("data"))
        ).alias("value"),
    )


def change_log_arrays(rows: DataFrame, table: str, number: str) -> DataFrame:
    """Rows as CDC envelopes with a `data` array of zero to three elements: the row itself and
    its later versions (the field `version` tells them apart)."""
    count = (F.col(number).cast("bigint") % 4).cast("int")
    versions = F.when(count > 0, F.sequence(F.lit(1), F.greatest(count, F.lit(1)))).otherwise(
        F.array().cast("array<int>")
    )
    data = F.transform(
        versions, lambda v: F.struct(*[F.col(c) for c in rows.columns], v.alias("version"))
    )
    return rows.select(
        F.col(number).cast("bigint").alias("seq"),
        F.to_json(F.struct(F.lit(table).alias("table"), data.alias("data"))).alias("value"),
    )
