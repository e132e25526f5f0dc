"""Queries for joins, aggregations, ordered computations and the serving reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retailflow.functions import to_cents
from retailflow.operators import active, dimensions, orders, serving, wide
from retailflow.plans import warehouse
from retailflow.plans.oracle import sql
from retailflow.plans.registry import query
from retailflow.sources.tables import Tables, startups

LINE = ("order_id", "order_detail_id")


# -- joins --------------------------------------------------------------------------------------


@query("j1_sku_dims", sql("""
    SELECT CAST(id AS VARCHAR) AS id, sku_name, CAST(spu_id AS VARCHAR) AS spu_id, CAST(tm_id AS VARCHAR) AS tm_id,
           CAST(category3_id AS VARCHAR) AS category3_id, printf('%.2f', price) AS price,
           spu_name, tm_name, category3_name
    FROM skus""", "skus"))
def sku_dims(t: Tables) -> DataFrame:
    return warehouse.skus(t).drop("create_time")


@query("j2_order_province", sql("""
    SELECT h.id, p.id AS province_id, p.name AS province_name, p.area_code AS province_area_code,
           p.iso_code AS province_iso_code, p.iso_3166_2 AS province_iso_3166_2
    FROM heads h JOIN users u USING (user_id) JOIN provinces p ON u.province_id = p.id""", "heads", "users", "provinces"))
def order_province(t: Tables) -> DataFrame:
    return dimensions.order_province(t.order_info, t.province).select(
        "id", F.col("province_id").cast("int").alias("province_id"), "province_name", "province_area_code",
        "province_iso_code", "province_iso_3166_2",
    )


@query("j3_order_user", sql("""
    SELECT id, user_id, age_group AS user_age_group, gender_name AS user_gender
    FROM heads LEFT JOIN users USING (user_id)""", "heads", "users"))
def order_user(t: Tables) -> DataFrame:
    return dimensions.order_user(t.order_heads, warehouse.users(t)).select(
        "id", "user_id", "user_age_group", "user_gender"
    )


@query("j4_detail_sku", sql("""
    SELECT d.id, d.order_id, d.sku_id, d.sku_num, s.sku_name, s.spu_id, s.tm_id, s.category3_id, s.spu_name,
           s.tm_name, s.category3_name
    FROM details d LEFT JOIN skus s ON d.sku_id = s.id""", "details", "skus"))
def detail_sku(t: Tables) -> DataFrame:
    return warehouse.dwd_details(t).drop("order_price")


@query("j5_order_user_state", sql("""
    SELECT if_first_order, count(*) AS orders, count(DISTINCT user_id) AS users
    FROM (SELECT user_id, CASE WHEN user_id % 10 = 0 THEN '0' ELSE '1' END AS if_first_order FROM heads)
    GROUP BY 1""", "heads"))
def order_user_state(t: Tables) -> DataFrame:
    flagged = orders.order_flag_lookup(t.order_heads, t.user_state)
    # Per user first: the distinct count then needs no second copy of the rows.
    per_user = flagged.groupBy("if_first_order", "user_id").agg(F.count(F.lit(1)).alias("n"))
    return per_user.groupBy("if_first_order").agg(
        F.sum("n").alias("orders"), F.count(F.lit(1)).alias("users")
    )


@query("j7_order_detail_join", sql("""
    SELECT d.id AS detail_id, d.order_id, o.user_id, o.create_time, d.sku_id
    FROM details d JOIN heads o ON d.order_id = o.id""", "details", "heads"))
def order_detail_join(t: Tables) -> DataFrame:
    return wide.order_detail_join(t.order_heads, t.order_detail).select(
        F.col("detail.id").alias("detail_id"),
        "order_id",
        F.col("order.user_id").alias("user_id"),
        F.col("order.create_time").alias("create_time"),
        F.col("detail.sku_id").alias("sku_id"),
    )


@query("j8_seen_set_antijoin", sql("""
    SELECT dt, mid, hr, ms AS ts, seq FROM firsts f
    WHERE NOT EXISTS (SELECT 1 FROM logs s WHERE s.event_type = 'signup' AND s.dt = f.dt AND s.mid = f.mid)""", "firsts"))
def seen_set_antijoin(t: Tables) -> DataFrame:
    """Devices of a day not among those that signed up that day (the seen set)."""
    events = t.raw("events")
    signups = active.with_day_hour(startups(events.filter(F.col("event_type") == "signup")))
    seen = signups.select("dt", F.col("common.mid").alias("mid")).distinct()
    rows = active.dau_project(active.with_day_hour(t.startups))
    return active.unseen(rows, seen, ["dt", "mid"], ["ts", "seq"]).select("dt", "mid", "hr", "ts", "seq")


@query("s8_dim_lookup_in", sql("""
    SELECT CAST(user_id AS VARCHAR) AS id, age_group, gender_name FROM users
    WHERE user_id IN (SELECT user_id FROM heads)""", "users", "heads"))
def dim_lookup_in(t: Tables) -> DataFrame:
    found = dimensions.dim_lookup_in(warehouse.users(t), t.order_heads, "id", "user_id")
    return found.select("id", "age_group", "gender_name")


# -- daily actives ------------------------------------------------------------------------------


@query("d1_dau_dedup", sql("""
    SELECT mid, mid AS uid, 'area_' || (seq % 34) AS ar, 'channel_' || (seq % 5) AS ch, 'v1.' || (seq % 4) AS vc,
           dt, hr, '00' AS mi, ms AS ts
    FROM firsts""", "firsts"))
def dau_dedup(t: Tables) -> DataFrame:
    return active.dau_dedup(t.startups).drop("seq")


@query("a1_dau_total", sql("SELECT dt, count(DISTINCT mid) AS total FROM logs GROUP BY 1", "logs"))
def dau_total(t: Tables) -> DataFrame:
    return serving.dau_total(t.startups)


@query("a2_dau_by_hour", sql("SELECT dt, hr, count(*) AS n FROM firsts GROUP BY 1, 2", "firsts"))
def dau_by_hour(t: Tables) -> DataFrame:
    return serving.dau_by_hour(t.startups)


@query("a2_dau_hour_map", sql("""
    SELECT dt, string_agg(hr || '=' || n, ',' ORDER BY n DESC, hr) AS hours
    FROM (SELECT dt, hr, count(*) AS n FROM firsts GROUP BY 1, 2) GROUP BY 1""", "firsts"))
def dau_hour_map(t: Tables) -> DataFrame:
    """The map form, written out as text, busiest hour first."""
    pairs = F.transform(
        F.map_entries("hours"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))
    )
    return serving.dau_hour_map(t.startups).select("dt", F.array_join(pairs, ",").alias("hours"))


_COMPARED = """
    counts AS (SELECT dt, hr, count(*) AS n FROM firsts GROUP BY 1, 2),
    compared AS (
        SELECT dt, 'today' AS label, hr, n FROM counts
        UNION ALL
        SELECT strftime(CAST(dt AS DATE) + 1, '%Y-%m-%d'), 'yesterday', hr, n FROM counts)"""


@query("a3_dau_hour_compare", sql("SELECT dt, label, hr, n FROM compared", "firsts", then=_COMPARED))
def dau_hour_compare(t: Tables) -> DataFrame:
    return serving.dau_hour_compare(t.startups)


@query("a4_hour_zero_fill", sql("""SELECT d.dt, lpad(CAST(h.hour AS VARCHAR), 2, '0') AS hr,
           CAST(coalesce(sum(c.n) FILTER (WHERE c.label = 'yesterday'), 0) AS BIGINT) AS yesterday,
           CAST(coalesce(sum(c.n) FILTER (WHERE c.label = 'today'), 0) AS BIGINT) AS today
    FROM (SELECT DISTINCT dt FROM compared) d CROSS JOIN range(24) h(hour)
         LEFT JOIN compared c ON c.dt = d.dt AND CAST(c.hr AS BIGINT) = h.hour
    GROUP BY 1, 2""", "firsts", then=_COMPARED))
def hour_zero_fill(t: Tables) -> DataFrame:
    return serving.hour_zero_fill(serving.dau_hour_compare(t.startups))


@query("a5_kpi_tiles", sql(f"""
    SELECT dt, '{serving.DAU_TILE[0]}' AS id, '{serving.DAU_TILE[1]}' AS name, count(*) AS value FROM firsts GROUP BY dt
    UNION ALL
    SELECT dt, '{serving.NEW_DEVICE_TILE[0]}', '{serving.NEW_DEVICE_TILE[1]}',
           count(*) FILTER (WHERE dt = (SELECT min(dt) FROM firsts p WHERE p.mid = f.mid))
    FROM firsts f GROUP BY dt""", "firsts"))
def kpi_tiles(t: Tables) -> DataFrame:
    return serving.kpi_tiles(t.startups)


@query("a5_kpi_of_day", sql(f"""
    SELECT '{serving.DAU_TILE[0]}' AS id, '{serving.DAU_TILE[1]}' AS name, count(*) AS value
    FROM firsts WHERE dt = '2024-01-02'
    UNION ALL
    SELECT '{serving.NEW_DEVICE_TILE[0]}', '{serving.NEW_DEVICE_TILE[1]}', count(*)
    FROM (SELECT mid FROM firsts GROUP BY mid HAVING min(dt) = '2024-01-02')""", "firsts"))
def kpi_of_day(t: Tables) -> DataFrame:
    return serving.kpi_of_day(t.startups, "2024-01-02")


# -- orders -------------------------------------------------------------------------------------


@query("w1_first_order_flag", sql("SELECT id, user_id, create_time, if_first_order FROM flagged", "flagged"))
def first_order_flag(t: Tables) -> DataFrame:
    return orders.first_order_flag(t.order_heads, t.user_state).select("id", "user_id", "create_time", "if_first_order")


@query("a6_orders_by_user_group", sql("""
    SELECT user_id, count(*) AS orders, min(create_time) AS first_time, max(create_time) AS last_time
    FROM heads GROUP BY 1""", "heads"))
def orders_by_user_group(t: Tables) -> DataFrame:
    """What a user's group is needed for, without bringing the group together."""
    return t.order_heads.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("orders"),
        F.min("create_time").alias("first_time"),
        F.max("create_time").alias("last_time"),
    )


@query("w2_sort_by_time", sql("""
    SELECT user_id, create_time, id FROM heads ORDER BY user_id, create_time, id""", "heads"))
def sort_by_time(t: Tables) -> DataFrame:
    return t.order_heads.select("user_id", "create_time", "id").orderBy("user_id", "create_time", "id")


def _money(*names: str) -> list:
    return [to_cents(n).alias(n.replace("_amount", "") + "_cents") for n in names]


@query("a7_order_running_sums", sql("""
    SELECT order_id, order_detail_id, gross_so_far, share_so_far FROM sums""", "sums"))
def order_running_sums(t: Tables) -> DataFrame:
    return wide.order_running_sums(amounts_only(t), sizes_from=line_ids(t)).select(*LINE, "gross_so_far", "share_so_far")


@query("w3_pay_apportion", sql("""
    SELECT order_id, order_detail_id, paid AS final_total_cents, final_cents AS final_detail_cents FROM split""", "split"))
def pay_apportion(t: Tables) -> DataFrame:
    return wide.pay_apportion(amounts_only(t), sizes_from=line_ids(t)).select(*LINE, *_money("final_total_amount", "final_detail_amount"))


@query("w3_pay_apportion_blocks", sql("""
    SELECT order_id, order_detail_id, paid AS final_total_cents, final_cents AS final_detail_cents FROM split""", "split"))
def pay_apportion_blocks(t: Tables) -> DataFrame:
    """The path for very large orders, taken here by every order of more than three lines."""
    return wide.pay_apportion(amounts_only(t), hot_rows=3, sizes_from=line_ids(t)).select(
        *LINE, *_money("final_total_amount", "final_detail_amount")
    )


@query("w3_pay_apportion_final", sql("""
    SELECT order_id, order_detail_id,
           CASE WHEN gross_so_far = paid THEN paid - (share_so_far - share) ELSE share END AS final_detail_cents
    FROM sums""", "sums"))
def pay_apportion_final(t: Tables) -> DataFrame:
    """The variant that recognises the last line by the paid total."""
    return wide.pay_apportion(amounts_only(t), close_on="final", sizes_from=line_ids(t)).select(*LINE, *_money("final_detail_amount"))


def line_ids(t: Tables) -> DataFrame:
    return t.order_detail.select("order_id", F.col("id").alias("order_detail_id"))


def amounts_only(t: Tables) -> DataFrame:
    """Order lines with the amounts of their order, nothing else filled in."""
    bare_orders = t.order_info
    for name in ("create_date", "if_first_order", "province_name", "province_area_code", "user_age_group", "user_gender"):
        bare_orders = bare_orders.withColumn(name, F.lit(None).cast("string"))
    details = t.order_detail
    for name in ("sku_name", "spu_id", "tm_id", "category3_id", "spu_name", "tm_name", "category3_name"):
        details = details.withColumn(name, F.lit(None))
    return wide.wide_merge(bare_orders, details).select(
        *LINE, "sku_num", "sku_price", "original_total_amount", "final_total_amount", "final_detail_amount"
    )


@query("d2_detail_dedup", sql("""
    SELECT order_id, id AS order_detail_id, sku_id, (order_id // 5) * 5 - 5 AS first_window FROM details""", "details"))
def detail_dedup(t: Tables) -> DataFrame:
    """Lines seen once per overlapping window (10 s long, every 5 s), then once again."""
    seen = t.order_detail.select(
        "order_id", F.col("id").alias("order_detail_id"), "sku_id",
        F.explode(overlapping_windows(F.timestamp_seconds("order_id"))).alias("window_start"),
    )
    return wide.detail_dedup(seen, ["window_start"]).select(*LINE, "sku_id", F.col("window_start").alias("first_window"))


def overlapping_windows(ts, length: int = 10, slide: int = 5):
    """Starts (epoch seconds) of all windows of this length and slide that hold the time."""
    last = F.floor(F.unix_seconds(ts) / slide).cast("bigint") * slide
    return F.sequence(last - (length - slide), last, F.lit(slide).cast("bigint"))


@query("t2_sliding_window", """
    SELECT strftime(start, '%Y-%m-%d %H:%M:%S') AS window_start, count(*) AS n, count(DISTINCT user_id) AS users FROM (
        SELECT unnest([time_bucket(INTERVAL 5 MINUTE, ts), time_bucket(INTERVAL 5 MINUTE, ts) - INTERVAL 5 MINUTE]) AS start,
               user_id
        FROM events)
    GROUP BY 1""")
def sliding_window(t: Tables) -> DataFrame:
    """Events and users per window, 10 minutes long every 5."""
    span = F.window(F.col("ts").cast("timestamp"), "10 minutes", "5 minutes")
    per_user = t.raw("events").groupBy(span.alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return per_user.groupBy("w").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("users")).select(
        F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "n", "users"
    )


@query("wide_fact", sql("""
    SELECT order_detail_id, order_id, order_status, create_time, user_id, sku_id, gross AS gross_cents, sku_num, sku_name,
           original - paid AS benefit_reduce_cents, original AS original_total_cents, paid AS final_total_cents,
           final_cents AS final_detail_cents, if_first_order, province_name, province_area_code, user_age_group,
           user_gender, dt, spu_id, tm_id, category3_id, spu_name, tm_name, category3_name
    FROM split""", "split"))
def wide_fact(t: Tables) -> DataFrame:
    """The whole way from orders, lines and dimensions to the wide table."""
    amounts = ("benefit_reduce_amount", "original_total_amount", "final_total_amount", "final_detail_amount")
    rows = warehouse.order_wide(t)
    kept = [c for c in rows.columns if c not in (*amounts, "sku_price", "feight_fee")]
    return rows.select(*kept, to_cents(wide.gross_line_amount()).alias("gross_cents"), *_money(*amounts))


# -- reports over the wide table ----------------------------------------------------------------


@query("a8_batch_count", sql("""
    SELECT (SELECT count(*) FROM logs) AS rows_in, (SELECT count(*) FROM firsts) AS rows_kept""", "firsts"))
def batch_count(t: Tables) -> DataFrame:
    """Input and kept rows of the device deduplication."""
    kept = active.first_seen_counts(t.startups)
    return kept.agg(F.sum("n").alias("rows_in"), F.count(F.lit(1)).alias("rows_kept"))


@query("a9_gender_share", sql("""
    SELECT user_gender AS name, count(*) AS value, count(*) / CAST(sum(count(*)) OVER () AS BIGINT) AS share
    FROM wide GROUP BY 1""", "wide"))
def gender_share(t: Tables) -> DataFrame:
    return serving.gender_share(warehouse.stored_wide(t))


@query("a10_age_share", sql("""
    SELECT user_age_group AS name, count(*) AS value, count(*) / CAST(sum(count(*)) OVER () AS BIGINT) AS share
    FROM wide GROUP BY 1""", "wide"))
def age_share(t: Tables) -> DataFrame:
    return serving.age_share(warehouse.stored_wide(t))


@query("a11_province_sales", sql("""
    SELECT province_name AS name, CAST(sum(sku_num) AS BIGINT) AS value,
           CASE WHEN sum(sku_num) >= 600 THEN 7 ELSE CAST(floor(sum(sku_num) / 100.0) AS BIGINT) + 1 END AS band
    FROM wide GROUP BY 1""", "wide"))
def province_sales(t: Tables) -> DataFrame:
    return serving.province_sales(warehouse.stored_wide(t))


@query("a12_name_num_bars", sql("""
    SELECT sku_name AS name, CAST(sum(sku_num) AS BIGINT) AS num FROM wide GROUP BY 1""", "wide"))
def name_num_bars(t: Tables) -> DataFrame:
    return serving.name_num_bars(warehouse.stored_wide(t))


_HITS = """hits AS (SELECT * FROM split WHERE contains(sku_name, 'red')),
    ranked AS (SELECT *, row_number() OVER (ORDER BY final_cents DESC, order_id, order_detail_id) AS n FROM hits)"""


@query("a13_facet_search", sql("""
    SELECT 'total' AS section, 'total' AS name, count(*) AS value, NULL AS rank FROM hits
    UNION ALL SELECT 'age', user_age_group, count(*), NULL FROM hits GROUP BY 2
    UNION ALL SELECT 'gender', user_gender, count(*), NULL FROM hits GROUP BY 2
    UNION ALL SELECT 'detail', sku_name, order_detail_id, n FROM ranked WHERE n BETWEEN 21 AND 30""", "split",
    then=_HITS))
def facet_search(t: Tables) -> DataFrame:
    """Third page of ten, with the counts over all hits of the keyword."""
    return serving.facet_search(warehouse.stored_wide(t), None, "red", 20, 10)


@query("a13_facet_response", sql("""
    SELECT (SELECT count(*) FROM hits) AS total,
           (SELECT string_agg(order_id || ' ' || order_detail_id || ' ' || sku_name || ' ' || dt || ' ' || province_name || ' ' || final_cents, ', ' ORDER BY n)
            FROM ranked WHERE n BETWEEN 21 AND 30) AS detail,
           (SELECT string_agg(user_age_group || ' ' || n, ', ' ORDER BY user_age_group) FROM (SELECT user_age_group, count(*) AS n FROM hits GROUP BY 1)) AS age,
           (SELECT string_agg(user_gender || ' ' || n, ', ' ORDER BY user_gender) FROM (SELECT user_gender, count(*) AS n FROM hits GROUP BY 1)) AS gender""",
    "split", then=_HITS))
def facet_response(t: Tables) -> DataFrame:
    """The same as one row; its lists as text, the page in its order."""
    answer = serving.facet_response(warehouse.stored_wide(t), None, "red", 20, 10)
    text = lambda items, *columns: F.array_join(F.transform(items, lambda x: F.concat_ws(" ", *[x[c] for c in columns])), ", ")
    record = F.transform("detail", lambda x: F.concat_ws(
        " ", x["order_id"], x["order_detail_id"], x["sku_name"], x["dt"], x["province_name"], to_cents(x["final_detail_amount"])))
    stat = lambda i: text(F.col("stat")[i]["group"], "name", "value")
    return answer.select("total", F.array_join(record, ", ").alias("detail"), stat(0).alias("age"), stat(1).alias("gender"))


@query("w4_page_sort_limit", """
    SELECT p_partkey AS doc_id, p_name AS name, p_retailprice AS score FROM part
    ORDER BY p_retailprice DESC, p_partkey LIMIT 20 OFFSET 40""")
def page_sort_limit(t: Tables) -> DataFrame:
    docs = t.raw("part").select(
        F.col("p_partkey").alias("doc_id"), F.col("p_name").alias("name"), F.col("p_retailprice").alias("score")
    )
    return serving.page(docs, [F.desc("score"), F.asc("doc_id")], 40, 20)


@query("w5_topk_terms", """
    SELECT p_name AS term, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey
    GROUP BY 1 ORDER BY n DESC, term LIMIT 24""")
def topk_terms(t: Tables) -> DataFrame:
    named = dimensions.lookup(t.order_detail, t.sku_rows, F.col("sku_id").cast("string"), "id", {"sku_name": F.col("sku_name")})
    return serving.topk_terms(named, "sku_name")
