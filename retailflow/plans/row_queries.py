"""Queries for the row-wise operators: routing, decoding, derived fields, filters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retailflow import schemas
from retailflow.functions import age_group, gender_name, previous_day, round_half_up, to_cents, topic_name
from retailflow.operators import active, orders, routing, serving, wide
from retailflow.plans import warehouse
from retailflow.plans.oracle import change_kind, sql
from retailflow.plans.registry import query
from retailflow.sources import tables
from retailflow.sources.tables import AS_OF, Tables


def field(name: str, kind: str = "bigint"):
    return F.get_json_object("value", f"$.{name}").cast(kind)


@query("p1_route_log", sql(f"""
    SELECT seq, mid, CASE WHEN event_type IN ('signup', 'view') THEN '{routing.STARTUP_TOPIC}'
                          ELSE '{routing.EVENT_TOPIC}' END AS topic
    FROM logs""", "logs"))
def route_log(t: Tables) -> DataFrame:
    return routing.route_log(t.app_logs).select("seq", field("common.mid", "string").alias("mid"), "topic")


@query("p2_cdc_array_flatten", """
    SELECT 'ODS_USER_INFO' AS topic, c_custkey AS seq, CAST(c_custkey AS VARCHAR) AS id,
           unnest(range(1, c_custkey % 4 + 1)) AS version
    FROM customer""")
def cdc_array_flatten(t: Tables) -> DataFrame:
    changes = tables.change_log_arrays(t.user_rows, "user_info", "id")
    return routing.cdc_array_flatten(changes).select(
        "topic", "seq", field("id", "string").alias("id"), field("version").alias("version")
    )


def database_changes(t: Tables) -> DataFrame:
    """Single-row envelopes of six tables; `supplier_info` is none of those taken over."""
    suppliers = t.raw("supplier").select(F.col("s_suppkey").cast("string").alias("id"), F.col("s_name").alias("name"))
    details = t.order_detail.withColumn("order_number", F.col("order_id"))
    return (
        tables.change_log(t.order_heads, "order_info", "id")
        .unionByName(tables.change_log(details, "order_detail", "order_number"))
        .unionByName(tables.change_log(t.user_rows, "user_info", "id"))
        .unionByName(tables.change_log(t.sku_rows, "sku_info", "id"))
        .unionByName(tables.change_log(t.province, "base_province", "id"))
        .unionByName(tables.change_log(suppliers, "supplier_info", "id"))
    )


_KIND = change_kind("seq")


@query("p3_cdc_filter_route", sql(f"""
    SELECT topic, seq, id FROM (
        SELECT 'ODS_ORDER_INFO' AS topic, id AS seq, id FROM heads
        UNION ALL SELECT 'ODS_ORDER_DETAIL', order_id, id FROM details
        UNION ALL SELECT 'ODS_USER_INFO', c_custkey, c_custkey FROM customer
        UNION ALL SELECT 'ODS_SKU_INFO', p_partkey, p_partkey FROM part
        UNION ALL SELECT 'ODS_BASE_PROVINCE', n_nationkey, n_nationkey FROM nation)
    WHERE {_KIND} <> 'delete' AND (topic <> 'ODS_ORDER_INFO' OR {_KIND} = 'insert')""", "heads", "details"))
def cdc_filter_route(t: Tables) -> DataFrame:
    return routing.cdc_filter_route(database_changes(t)).select("topic", "seq", field("id").alias("id"))


@query("p4_topic_name", """
    SELECT 'ODS_' || upper(event_type) AS topic, count(*) AS n FROM events GROUP BY 1""")
def topic_names(t: Tables) -> DataFrame:
    return t.raw("events").groupBy(topic_name("event_type").alias("topic")).agg(F.count(F.lit(1)).alias("n"))


@query("p5_date_hour_from_ms", sql("SELECT seq, ms AS ts, dt, hr FROM logs", "logs"))
def date_hour_from_ms(t: Tables) -> DataFrame:
    return active.with_day_hour(t.startups).select("seq", "ts", "dt", "hr")


@query("p6_date_hour_from_text", sql("""
    SELECT id, create_time, substr(create_time, 1, 10) AS create_date, substr(create_time, 12, 2) AS create_hour
    FROM heads""", "heads"))
def date_hour_from_text(t: Tables) -> DataFrame:
    return orders.with_create_day_hour(t.order_heads).select("id", "create_time", "create_date", "create_hour")


@query("p7_dau_project", sql("""
    SELECT mid, mid AS uid, 'area_' || (seq % 34) AS ar, 'channel_' || (seq % 5) AS ch, 'v1.' || (seq % 4) AS vc,
           dt, hr, '00' AS mi, ms AS ts
    FROM logs""", "logs"))
def dau_project(t: Tables) -> DataFrame:
    return active.dau_project(active.with_day_hour(t.startups)).select(*schemas.DAU_INFO.fieldNames())


@query("p8_age_group", sql("SELECT CAST(user_id AS VARCHAR) AS id, birthday, age_group FROM users", "users"))
def age_groups(t: Tables) -> DataFrame:
    return t.user_rows.select("id", "birthday", age_group("birthday", AS_OF).alias("age_group"))


@query("p9_gender_name", sql("SELECT CAST(user_id AS VARCHAR) AS id, gender, gender_name FROM users", "users"))
def gender_names(t: Tables) -> DataFrame:
    return t.user_rows.select("id", "gender", gender_name("gender").alias("gender_name"))


@query("p10_wide_merge", sql("""
    SELECT order_detail_id, order_id, order_status, create_time, user_id, sku_id, gross AS gross_cents,
           sku_num, sku_name, (original - paid) / 100.0 AS benefit_reduce_amount,
           original / 100.0 AS original_total_amount, CAST(0 AS DOUBLE) AS feight_fee, paid / 100.0 AS final_total_amount,
           CAST(0 AS DOUBLE) AS final_detail_amount, if_first_order, province_name, province_area_code,
           user_age_group, user_gender, dt, spu_id, tm_id, category3_id, spu_name, tm_name, category3_name
    FROM wide""", "wide"))
def wide_merge(t: Tables) -> DataFrame:
    merged = wide.wide_merge(warehouse.dwd_orders(t), warehouse.dwd_details(t))
    return merged.withColumn("gross_cents", to_cents(wide.gross_line_amount())).drop("sku_price")


@query("p11_new_consumers", sql("""
    SELECT CAST(user_id AS VARCHAR) AS user_id, '1' AS if_consumed FROM flagged WHERE if_first_order = '1'""", "flagged"))
def new_consumers(t: Tables) -> DataFrame:
    return orders.new_consumers(orders.first_order_flag(t.order_heads, t.user_state)).select("user_id", "if_consumed")


@query("p12_gross_line_amount", sql("SELECT id, order_id, gross AS gross_cents FROM details", "details"))
def gross_line_amount(t: Tables) -> DataFrame:
    gross = wide.gross_line_amount("sku_num", "order_price")
    return t.order_detail.select("id", "order_id", to_cents(gross).alias("gross_cents"))


@query("p13_order_flag_lookup", sql("""
    SELECT id, user_id, CASE WHEN user_id % 10 = 0 THEN '0' ELSE '1' END AS if_first_order FROM heads""", "heads"))
def order_flag_lookup(t: Tables) -> DataFrame:
    return orders.order_flag_lookup(t.order_heads, t.user_state).select("id", "user_id", "if_first_order")


def product_docs(t: Tables) -> DataFrame:
    """Parts as search documents: a name, a number, a score and a nested list of named entries."""
    return t.raw("part").select(
        F.col("p_partkey").alias("doc_id"),
        F.col("p_size").cast("bigint").alias("id"),
        F.col("p_name").alias("name"),
        F.col("p_retailprice").alias("score"),
        F.array(
            F.struct(F.col("p_brand").alias("name")), F.struct(F.col("p_type").alias("name"))
        ).alias("actorList"),
    )


@query("p14_doc_search_filter", """
    SELECT p_partkey AS doc_id, p_name AS name, p_retailprice AS score FROM part
    WHERE list_contains(string_split(lower(p_name), ' '), 'red') AND (p_brand = 'PROMO' OR p_type = 'PROMO')""")
def doc_search_filter(t: Tables) -> DataFrame:
    return serving.doc_search(product_docs(t), "red", "PROMO").select("doc_id", "name", "score")


@query("p14_doc_search_number", """
    SELECT p_partkey AS doc_id, p_name AS name, p_size AS size FROM part
    WHERE list_contains(string_split(lower(p_name), ' '), 'red') AND p_size = 1
      AND (p_brand = 'PROMO' OR p_type = 'PROMO')""")
def doc_search_number(t: Tables) -> DataFrame:
    found = serving.doc_search(product_docs(t), "red", "PROMO", number=1)
    return found.select("doc_id", "name", F.col("id").cast("int").alias("size"))


@query("p15_dashboard_filter", sql("""
    SELECT order_detail_id, order_id, sku_name, dt FROM wide
    WHERE dt = '1998-03-04' AND contains(sku_name, 'red')""", "wide"))
def dashboard_filter(t: Tables) -> DataFrame:
    rows = warehouse.stored_wide(t, "1998-03-04")
    return serving.dashboard_filter(rows, "1998-03-04", "red").select("order_detail_id", "order_id", "sku_name", "dt")


@query("p15_dashboard_keyword", sql("""
    SELECT order_detail_id, order_id, sku_name, dt FROM wide WHERE contains(sku_name, 'ring')""", "wide"))
def dashboard_keyword(t: Tables) -> DataFrame:
    rows = warehouse.stored_wide(t)
    return serving.dashboard_filter(rows, None, "ring").select("order_detail_id", "order_id", "sku_name", "dt")


@query("s3_json_decode", sql("""
    SELECT id AS seq, CASE WHEN id % 97 = 0 THEN -1 ELSE id END AS id,
           CASE WHEN id % 97 = 0 THEN -1 ELSE user_id END AS user_id,
           CASE WHEN id % 97 = 0 THEN '' ELSE create_time END AS create_time,
           CAST(id % 97 = 0 AS INTEGER) AS corrupt
    FROM heads""", "heads"))
def json_decode(t: Tables) -> DataFrame:
    """Every 97th message is cut short, so it must land in quarantine without stopping the rest."""
    whole = t.order_heads.select(F.col("id").alias("seq"), F.to_json(F.struct("*")).alias("value"))
    broken = F.substring_index("value", ",", 2)
    messages = whole.withColumn("value", F.when(F.col("seq") % 97 == 0, broken).otherwise(F.col("value")))
    decoded = schemas.decode(messages, schemas.ORDER_INFO)
    bad = F.col("_corrupt_record").isNotNull()
    return decoded.select(
        "seq",
        F.when(bad, -1).otherwise(F.col("id")).alias("id"),
        F.when(bad, -1).otherwise(F.col("user_id")).alias("user_id"),
        F.when(bad, "").otherwise(F.col("create_time")).alias("create_time"),
        bad.cast("int").alias("corrupt"),
    )


@query("s5_json_encode", sql("""
    SELECT CAST(id AS VARCHAR) AS key, id, user_id, create_time, CASE WHEN id % 3 = 0 THEN 3 ELSE 4 END AS fields
    FROM heads""", "heads"))
def json_encode(t: Tables) -> DataFrame:
    """Every third order has no status: the field must be missing from its JSON."""
    rows = t.order_heads.withColumn("order_status", F.when(F.col("id") % 3 != 0, F.col("order_status")))
    return rows.select(*schemas.encode("id")).select(
        "key",
        field("id").alias("id"),
        field("user_id").alias("user_id"),
        field("create_time", "string").alias("create_time"),
        F.size(F.json_object_keys("value")).alias("fields"),
    )


@query("s16_doc_mapping", sql("""
    SELECT id, province_id, order_status, user_id, paid / 100.0 AS final_total_amount,
           (original - paid) / 100.0 AS benefit_reduce_amount, original / 100.0 AS original_total_amount,
           CAST(0 AS DOUBLE) AS feight_fee, create_time, create_date, create_hour, if_first_order, province_name,
           province_area_code, province_iso_code, province_iso_3166_2, age_group AS user_age_group,
           gender_name AS user_gender
    FROM full_orders""", "full_orders"))
def doc_mapping(t: Tables) -> DataFrame:
    docs = schemas.conform(warehouse.dwd_orders(t), schemas.ORDER_DOCUMENT)
    return docs.withColumn("create_date", F.col("create_date").cast("string")).drop("expire_time", "operate_time")


@query("w6_day_before", sql("""
    SELECT dt, strftime(CAST(dt AS DATE) - 1, '%Y-%m-%d') AS day_before, count(*) AS n FROM logs GROUP BY 1, 2""", "logs"))
def day_before(t: Tables) -> DataFrame:
    days = active.with_day_hour(t.startups).groupBy("dt").agg(F.count(F.lit(1)).alias("n"))
    return days.select("dt", previous_day("dt").alias("day_before"), "n")


@query("f1_round_half_up", """
    SELECT p_partkey AS id, floor(p_retailprice / 7 * 100 + 0.5) / 100.0 AS rounded FROM part""")
def rounding(t: Tables) -> DataFrame:
    seventh = F.col("p_retailprice") / 7
    return t.raw("part").select(F.col("p_partkey").alias("id"), round_half_up(seventh).alias("rounded"))
