"""Dimension rows and the lookups against them.

No join here carries a broadcast hint. The optimizer broadcasts a dimension when its size,
estimated or measured at run time, is below the session's threshold; above it the join is a
shuffled one in which oversized partitions of the fact side are split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retailflow.functions import age_group, gender_name


def lookup(facts: DataFrame, dim: DataFrame, fact_key: Column, dim_key: str, columns: dict[str, Column]) -> DataFrame:
    """Left join that adds `columns` (name to dimension expression); a miss gives NULLs. Columns
    of the same name in the facts are replaced."""
    side = dim.select(F.col(dim_key).alias("_dim_key"), *[c.alias(f"_dim_{n}") for n, c in columns.items()])
    kept = [c for c in facts.columns if c not in columns]
    return (
        facts.withColumn("_fact_key", fact_key)
        .join(side, F.col("_fact_key") == F.col("_dim_key"), "left")
        .select(*kept, *[F.col(f"_dim_{n}").alias(n) for n in columns])
    )


def user_dim(users: DataFrame, as_of: Column | str) -> DataFrame:
    """User rows with age group (on the day `as_of`) and gender label."""
    derived = {"age_group": age_group("birthday", as_of), "gender_name": gender_name("gender")}
    kept = [c for c in users.columns if c not in derived]
    return users.select(*kept, *[c.alias(n) for n, c in derived.items()])


def sku_dims(skus: DataFrame, category3: DataFrame, trademark: DataFrame, spu: DataFrame) -> DataFrame:
    """SKU rows with the names of category, brand and product."""
    named = lookup(skus, category3, F.col("category3_id"), "id", {"category3_name": F.col("name")})
    named = lookup(named, spu, F.col("spu_id"), "id", {"spu_name": F.col("spu_name")})
    return lookup(named, trademark, F.col("tm_id"), "tm_id", {"tm_name": F.col("tm_name")})


def order_province(orders: DataFrame, province: DataFrame) -> DataFrame:
    return lookup(
        orders,
        province,
        F.col("province_id").cast("string"),
        "id",
        {
            "province_name": F.col("name"),
            "province_area_code": F.col("area_code"),
            "province_iso_code": F.col("iso_code"),
            "province_iso_3166_2": F.col("iso_3166_2"),
        },
    )


def order_user(orders: DataFrame, users: DataFrame) -> DataFrame:
    return lookup(
        orders,
        users.withColumn("_id", F.expr("try_cast(id AS bigint)")),
        F.col("user_id"),
        "_id",
        {"user_age_group": F.col("age_group"), "user_gender": F.col("gender_name")},
    )


def detail_sku(details: DataFrame, skus: DataFrame) -> DataFrame:
    """Adds product, brand and category; the SKU's name fills in where the line has none."""
    own_name = F.col("sku_name") if "sku_name" in details.columns else F.lit(None).cast("string")
    named = lookup(
        details.withColumn("_own_name", own_name),
        skus.withColumn("_id", F.expr("try_cast(id AS bigint)")),
        F.col("sku_id"),
        "_id",
        {
            "spu_id": F.expr("try_cast(spu_id AS bigint)"),
            "tm_id": F.expr("try_cast(tm_id AS bigint)"),
            "category3_id": F.expr("try_cast(category3_id AS bigint)"),
            "spu_name": F.col("spu_name"),
            "tm_name": F.col("tm_name"),
            "category3_name": F.col("category3_name"),
            "sku_name": F.col("sku_name"),
        },
    )
    return named.withColumn("sku_name", F.coalesce("_own_name", "sku_name")).drop("_own_name")


def dim_lookup_in(
    dim: DataFrame, ids: DataFrame, dim_key: str, id_column: str, broadcast_up_to: int | None = None
) -> DataFrame:
    """Only the dimension rows whose key occurs among the ids. The ids are made distinct with
    map-side combine first, so a hot id is shuffled once per task.

    `broadcast_up_to` is for micro-batches: the distinct ids are counted, and up to that many are
    broadcast, so that a large dimension is scanned but not shuffled. More are joined as usual.
    """
    wanted = ids.select(F.col(id_column).cast("string").alias("_wanted")).distinct()
    if broadcast_up_to is not None and wanted.count() <= broadcast_up_to:
        wanted = F.broadcast(wanted)
    return dim.join(wanted, F.col(dim_key) == F.col("_wanted"), "left_semi")


def unmatched(rows: DataFrame, column: str) -> Column:
    """Aggregate for `observe`: how many rows a lookup left without a partner."""
    return F.count(F.when(F.col(column).isNull(), 1)).alias(f"unmatched_{column}")
