"""Queries that go through a sink and read back what it holds. Each run has its own folder below
the shared one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retailflow import schemas
from retailflow.functions import to_cents
from retailflow.operators import active, dimensions, routing, serving, wide
from retailflow.plans import warehouse
from retailflow.plans.oracle import sql
from retailflow.plans.registry import query
from retailflow.plans.table_queries import amounts_only, line_ids
from retailflow.session import run_dir
from retailflow.sources import storage, tables, topics
from retailflow.sources.tables import AS_OF, Tables


def field(name: str, kind: str = "bigint"):
    return F.get_json_object("value", f"$.{name}").cast(kind)


@query("s2_topic_replay", sql("""
    SELECT id, id % 4 AS batch_id FROM heads WHERE id % 4 IN (1, 2)""", "heads"))
def topic_replay(t: Tables) -> DataFrame:
    """Four batches in a topic, of which the second and third are replayed."""
    root = run_dir(t.spark, "s2")
    messages = t.order_heads.select(
        F.lit("ODS_ORDER_INFO").alias("topic"), F.col("id").alias("seq"), *schemas.encode("id", t.order_heads.columns)
    )
    for n in range(4):
        topics.write_topic(messages.filter(F.col("seq") % 4 == n), root, n)
    return topics.read_topic(t.spark, root, "ODS_ORDER_INFO", from_batch=1, until_batch=3).select(
        field("id").alias("id"), "batch_id"
    )


@query("s4_topic_sink", sql("""
    SELECT CAST(id AS VARCHAR) AS key, id, user_id, create_time, substr(create_time, 1, 10) AS create_date,
           province_name, age_group AS user_age_group, if_first_order
    FROM full_orders""", "full_orders"))
def topic_sink(t: Tables) -> DataFrame:
    """Enriched orders as keyed messages, written twice as the same batch."""
    root = run_dir(t.spark, "s4")
    placed = schemas.conform(warehouse.dwd_orders(t), schemas.ORDER_INFO)
    messages = placed.select(
        F.lit("DWD_ORDER_INFO").alias("topic"), F.col("id").alias("seq"), *schemas.encode("id", placed.columns)
    )
    for _ in range(2):
        topics.write_topic(messages, root, 0)
    decoded = schemas.decode(topics.read_topic(t.spark, root, "DWD_ORDER_INFO"), schemas.ORDER_INFO)
    return decoded.select("key", "id", "user_id", "create_time", "create_date", "province_name", "user_age_group",
                          "if_first_order")


@query("s6_dim_upsert", sql("""
    SELECT CAST(user_id AS VARCHAR) AS id, CASE WHEN user_id % 3 = 0 THEN 'GOLD' ELSE user_level END AS user_level,
           birthday, age_group, gender_name
    FROM users""", "users"))
def dim_upsert(t: Tables) -> DataFrame:
    """All users, then two more versions of every third in one batch, of which the last wins."""
    path = run_dir(t.spark, "s6")
    users = warehouse.users(t)
    storage.upsert_dim(users, path, 0)
    third = users.filter(F.col("id").cast("bigint") % 3 == 0)
    versions = third.withColumn("user_level", F.lit("SILVER")).withColumn("seq", F.lit(1).cast("bigint"))
    latest = third.withColumn("user_level", F.lit("GOLD")).withColumn("seq", F.lit(2).cast("bigint"))
    storage.upsert_dim(versions.unionByName(latest), path, 1)
    current = storage.read_dim(t.spark, path, schemas.USER_INFO)
    return current.select("id", "user_level", "birthday", "age_group", "gender_name")


@query("s7_dim_scan_full", sql("""
    SELECT CAST(id AS VARCHAR) AS id, CASE WHEN id % 2 = 0 THEN name || '!' ELSE name END AS name, area_code, iso_code,
           iso_3166_2
    FROM provinces""", "provinces"))
def dim_scan_full(t: Tables) -> DataFrame:
    """The whole current dimension: a snapshot and the batch after it."""
    path = run_dir(t.spark, "s7")
    storage.upsert_dim(t.province, path, 0)
    storage.compact_dim(t.spark, path, schemas.PROVINCE)
    even = t.province.filter(F.col("id").cast("bigint") % 2 == 0)
    storage.upsert_dim(even.withColumn("name", F.concat("name", F.lit("!"))), path, 1)
    return storage.read_dim(t.spark, path, schemas.PROVINCE)


@query("s9_doc_upsert_daily", sql("""
    SELECT mid, dt, hr, CASE WHEN seq % 2 = 0 THEN 'v2' ELSE 'v1.' || (seq % 4) END AS vc, ms AS ts FROM firsts""", "firsts"))
def doc_upsert_daily(t: Tables) -> DataFrame:
    """Daily documents, the same batch once more, then newer documents for some ids."""
    path = run_dir(t.spark, "s9")
    docs = active.dau_dedup(t.startups)
    for _ in range(2):
        storage.upsert_docs(docs.drop("seq"), path, 0)
    newer = docs.filter(F.col("seq") % 2 == 0).withColumn("vc", F.lit("v2"))
    storage.upsert_docs(newer.drop("seq"), path, 1)
    return storage.read_docs(t.spark, path, schemas.DAU_INFO, "mid").select("mid", "dt", "hr", "vc", "ts")


def stored_dau(t: Tables, name: str) -> DataFrame:
    path = run_dir(t.spark, name)
    storage.upsert_docs(active.dau_dedup(t.startups).drop("seq"), path, 0)
    return storage.read_docs(t.spark, path, schemas.DAU_INFO, "mid")


@query("a1_index_total", sql("SELECT dt, count(DISTINCT mid) AS total FROM logs GROUP BY 1", "logs"))
def index_total(t: Tables) -> DataFrame:
    """Daily actives as the document count of each day's index."""
    return serving.index_total(stored_dau(t, "a1"))


@query("a2_index_by_hour", sql("SELECT dt, hr, count(*) AS n FROM firsts GROUP BY 1, 2", "firsts"))
def index_by_hour(t: Tables) -> DataFrame:
    return serving.index_by_hour(stored_dau(t, "a2"))


@query("s11_index_alias", sql("""
    SELECT 'all' AS name, dt, count(*) AS n FROM firsts GROUP BY dt
    UNION ALL SELECT 'day', dt, count(*) FROM firsts WHERE dt = '2024-01-03' GROUP BY dt""", "firsts"))
def index_alias(t: Tables) -> DataFrame:
    """SQL over the view of all days and over the view of one."""
    storage.index_views(stored_dau(t, "s11"), "dau_info", ("2024-01-03",))
    return t.spark.sql("""
        SELECT 'all' AS name, dt, count(*) AS n FROM dau_info_query GROUP BY dt
        UNION ALL SELECT 'day', dt, count(*) FROM dau_info_2024_01_03_query GROUP BY dt""")


@query("s12_olap_append", sql("""
    SELECT order_id, order_detail_id, final_cents FROM split""", "split"))
def olap_append(t: Tables) -> DataFrame:
    """Two appends, the second of them repeated."""
    path = run_dir(t.spark, "s12")
    rows = schemas.conform(wide.pay_apportion(amounts_only(t), sizes_from=line_ids(t)), schemas.ORDER_WIDE)
    for n, part in ((0, 0), (1, 1), (1, 1)):
        storage.append_olap(rows.filter(F.col("order_id") % 2 == part), path, n)
    stored = storage.read_olap(t.spark, path, schemas.ORDER_WIDE)
    return stored.select("order_id", "order_detail_id", to_cents("final_detail_amount").alias("final_cents"))


@query("s8_lookup_sorted", sql("""
    SELECT CAST(user_id AS VARCHAR) AS id, user_level, age_group, gender_name FROM users
    WHERE user_id IN (SELECT user_id FROM heads WHERE substr(create_time, 1, 10) IN ('1998-03-04', '1995-06-17'))""", "users", "heads"))
def lookup_sorted(t: Tables) -> DataFrame:
    """The users of two days' orders, from a table sorted by id whose row groups can tell what they hold."""
    path = run_dir(t.spark, "s8-sorted")
    storage.write_sorted(schemas.conform(warehouse.users(t), schemas.USER_INFO), path)
    placed = t.order_heads.filter(F.substring("create_time", 1, 10).isin("1998-03-04", "1995-06-17"))
    return storage.lookup_sorted(t.spark, path, schemas.USER_INFO, placed, "user_id").select("id", "user_level", "age_group", "gender_name")


@query("s13_backfill", sql("""
    SELECT CAST(user_id AS VARCHAR) AS id,
           CASE WHEN user_id % 10 IN (1, 2) THEN 'CHANGED' ELSE user_level END AS user_level, age_group, gender_name
    FROM users WHERE user_id % 10 <> 0""", "users"))
def backfill(t: Tables) -> DataFrame:
    """Existing rows go through the change path as the batch before all others, then changes
    follow. The change log marks every tenth row as deleted, which the path leaves out."""
    root, path = run_dir(t.spark, "s13-topics"), run_dir(t.spark, "s13-dim")

    def through(rows: DataFrame, n: int) -> None:
        accepted = routing.cdc_filter_route(tables.change_log(rows, "user_info", "id"))
        topics.write_topic(accepted, root, n)
        batch = topics.read_topic(t.spark, root, "ODS_USER_INFO", from_batch=n, until_batch=n + 1)
        decoded = schemas.decode(batch.select("seq", "value"), schemas.USER_INFO)
        storage.upsert_dim(dimensions.user_dim(schemas.split_corrupt(decoded)[0], AS_OF), path, n)

    through(t.user_rows, topics.BACKFILL_BATCH)
    changed = t.user_rows.filter((F.col("id").cast("bigint") % 10).isin(1, 2))
    through(changed.withColumn("user_level", F.lit("CHANGED")), 0)
    return storage.read_dim(t.spark, path, schemas.USER_INFO).select("id", "user_level", "age_group", "gender_name")


@query("s13_backfill_after_snapshot", sql("""
    SELECT CAST(user_id AS VARCHAR) AS id, CASE WHEN user_id % 3 = 0 THEN 'CHANGED' WHEN user_id % 3 = 1 THEN 'BACKFILL' ELSE 'SECOND' END AS user_level
    FROM users""", "users"))
def backfill_after_snapshot(t: Tables) -> DataFrame:
    """Every third user changes; the table is folded twice, and rows come in from before all
    changes between and after the folds. They fill gaps and lose to what was there."""
    path = run_dir(t.spark, "s13-folded")
    users = warehouse.users(t)
    third = F.col("id").cast("bigint") % 3

    def put(rows: DataFrame, level: str, n: int) -> None:
        storage.upsert_dim(rows.withColumn("user_level", F.lit(level)), path, n)

    put(users.filter(third == 0), "CHANGED", 0)
    storage.compact_dim(t.spark, path, schemas.USER_INFO)
    put(users.filter(third <= 1), "BACKFILL", topics.BACKFILL_BATCH)
    put(users.filter(third == 0), "CHANGED", 1)
    storage.compact_dim(t.spark, path, schemas.USER_INFO)
    put(users, "SECOND", topics.BACKFILL_BATCH - 1)
    return storage.read_dim(t.spark, path, schemas.USER_INFO).select("id", "user_level")


@query("s10_doc_put_one", sql("""
    SELECT mid, dt, hr, CASE WHEN row_number() OVER (ORDER BY dt, mid) = 1 THEN 'put' ELSE 'v1.' || (seq % 4) END AS vc FROM firsts""", "firsts"))
def doc_put_one(t: Tables) -> DataFrame:
    """One document is put over an existing one of a full index."""
    path = run_dir(t.spark, "s10")
    docs = active.dau_dedup(t.startups).drop("seq")
    storage.upsert_docs(docs, path, 0)
    one = docs.orderBy("dt", "mid").limit(1).withColumn("vc", F.lit("put"))
    storage.upsert_docs(one, path, 1)
    return storage.read_docs(t.spark, path, schemas.DAU_INFO, "mid").select("mid", "dt", "hr", "vc")


@query("s14_salted_table", sql("""
    SELECT u.province_id AS province_id, u.age_group, count(*) AS orders
    FROM heads h JOIN users u USING (user_id) GROUP BY 1, 2""", "heads", "users"))
def salted_table(t: Tables) -> DataFrame:
    """Users and orders bucketed alike on the user, so that their join needs no shuffle."""
    root = run_dir(t.spark, "s14")
    suffix = root.rsplit("-", 1)[1]
    homes = t.raw("customer").select(F.col("c_custkey").cast("string").alias("id"), F.col("c_nationkey").alias("province_id"))
    users = warehouse.users(t).join(homes, "id")
    placed = t.order_heads.select(F.col("user_id").cast("string").alias("id"), F.col("id").alias("order_id"))
    storage.write_bucketed(users, f"users_{suffix}", f"{root}/users")
    storage.write_bucketed(placed, f"orders_{suffix}", f"{root}/orders")
    # The join below reads the tables; they go with the warehouse folder of the run.
    joined = t.spark.table(f"orders_{suffix}").join(t.spark.table(f"users_{suffix}"), "id")
    return joined.groupBy("province_id", "age_group").agg(F.count(F.lit(1)).alias("orders"))


@query("s15_raw_archive", sql("""
    SELECT dt, count(*) AS lines, count(*) FILTER (WHERE event_type IN ('signup', 'view')) AS startups,
           CAST(sum(ms) AS BIGINT) AS ts_sum
    FROM logs GROUP BY 1""", "logs"))
def raw_archive(t: Tables) -> DataFrame:
    path = run_dir(t.spark, "s15")
    lines = active.with_day_hour(t.app_logs.withColumn("ts", field("ts")))
    storage.archive_raw(lines, path, 0)
    stored = t.spark.read.schema("value string, dt string, batch_id bigint").text(path)
    started = F.col("topic") == routing.STARTUP_TOPIC
    return routing.route_log(stored).groupBy("dt").agg(
        F.count(F.lit(1)).alias("lines"),
        F.count(F.when(started, 1)).alias("startups"),
        F.sum(field("ts")).alias("ts_sum"),
    )
