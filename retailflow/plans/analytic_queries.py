"""Ranked search, cube, versions as of a time, sessions, ranges of days."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retailflow.functions import to_cents
from retailflow.operators import active, cube, reach, search, sessions, versions
from retailflow.plans import warehouse
from retailflow.plans.oracle import cents, sql
from retailflow.plans.registry import query
from retailflow.plans.stream_queries import finished, staged
from retailflow.session import run_dir
from retailflow.sources.tables import Tables

_TERMS = r"regexp_extract_all(regexp_replace(lower(text), '([\p{Han}\p{Hiragana}\p{Katakana}])', ' \1 ', 'g'), '[\p{L}\p{M}\p{N}]+')"
_RANKED = f"""
    WITH d AS (SELECT doc_id, {_TERMS} AS terms FROM documents),
    size AS (SELECT count(*) AS n, coalesce(sum(len(terms)), 0) / count(*) AS average FROM d),
    tf AS (SELECT doc_id, term, count(*) AS tf, any_value(length) AS length
           FROM (SELECT doc_id, len(terms) AS length, unnest(terms) AS term FROM d) GROUP BY 1, 2),
    idf AS (SELECT term, ln(1 + (n - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM tf, size GROUP BY term, n),
    q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark) GROUP BY 1, 2),
    scored AS (SELECT item_id AS search_id, doc_id,
                      round(sum(times * idf * (tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * length / average)))), {search.DECIMALS}) AS score
               FROM q JOIN tf USING (term) JOIN idf USING (term), size GROUP BY 1, 2),
    ranked AS (SELECT search_id, CAST(row_number() OVER (PARTITION BY search_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scored)
    SELECT * FROM ranked WHERE """


def benchmark_searches(t: Tables) -> tuple[search.SearchIndex, DataFrame]:
    """An index over all documents, and every benchmark item as a search."""
    index = search.build_index(t.raw("documents").select("doc_id", "text"), run_dir(t.spark, "search"))
    return index, t.raw("benchmark").select(F.col("item_id").alias("search_id"), "text")


@query("p14_ranked_search", _RANKED + "rank <= 10")
def ranked_search(t: Tables) -> DataFrame:
    """The ten most relevant documents for each benchmark item."""
    return search.search(*benchmark_searches(t), 10)


@query("w4_ranked_page", _RANKED + "rank > 20 AND rank <= 25")
def ranked_page(t: Tables) -> DataFrame:
    """A later page of the same rankings."""
    return search.search(*benchmark_searches(t), 5, start=20)


_CUBE = f"""
    SELECT dt, province_name, user_age_group, user_gender, category3_name,
           CAST(grouping_id(dt, province_name, user_age_group, user_gender, category3_name) AS INTEGER) AS level,
           count(*) AS lines, CAST(sum(sku_num) AS BIGINT) AS pieces, CAST(sum(final_cents) AS BIGINT) AS paid_cents
    FROM split GROUP BY """


@query("a11_sales_cube", sql(_CUBE + "CUBE (dt, province_name, user_age_group, user_gender, category3_name)", "split"))
def sales_cube(t: Tables) -> DataFrame:
    return cube.cube(cube.finest(warehouse.stored_wide(t)))


@query("a13_sales_levels", sql(_CUBE + "GROUPING SETS ((dt), (province_name, category3_name), (user_age_group, user_gender), ())", "split"))
def sales_levels(t: Tables) -> DataFrame:
    """The levels that the dashboard's reports show, and no others."""
    sets = [("dt",), ("province_name", "category3_name"), ("user_age_group", "user_gender"), ()]
    return cube.grouping_sets(cube.finest(warehouse.stored_wide(t)), sets)


def price_versions(t: Tables) -> DataFrame:
    """A SKU's list price from the day a line of it was shipped: the highest price of that day's lines."""
    price = to_cents(F.col("l_extendedprice") / F.col("l_quantity"))
    day = F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss")
    return t.raw("lineitem").groupBy(F.col("l_partkey").alias("sku_id"), day.alias("changed")).agg(F.max(price).alias("list_cents"))


_VERSIONS = f"""v AS (
    SELECT l_partkey AS sku_id, strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') AS changed,
           max({cents('l_extendedprice / l_quantity')}) AS list_cents FROM lineitem GROUP BY 1, 2)"""


@query("t8_dim_as_of", sql("""
    SELECT f.order_id, f.id AS detail_id, f.sku_id, f.create_time, v.list_cents, v.changed AS since
    FROM (SELECT d.*, h.create_time FROM details d JOIN heads h ON d.order_id = h.id) f
    ASOF LEFT JOIN v ON f.sku_id = v.sku_id AND f.create_time >= v.changed""", "details", "heads", then=_VERSIONS))
def dim_as_of(t: Tables) -> DataFrame:
    """Every order line with its SKU's list price as of the order's time."""
    created = t.order_heads.select(F.col("id").alias("order_id"), "create_time")
    lines = t.order_detail.select("order_id", F.col("id").alias("detail_id"), "sku_id").join(created, "order_id")
    prices = price_versions(t).withColumn("since", F.col("changed"))
    return versions.as_of(lines, prices, "sku_id", "create_time", "sku_id", "changed", ["list_cents", "since"], sizes_from=t.order_detail)


@query("t8_version_validity", sql("""
    SELECT sku_id, changed AS valid_from, lead(changed) OVER (PARTITION BY sku_id ORDER BY changed) AS valid_to, list_cents FROM v""", then=_VERSIONS))
def version_validity(t: Tables) -> DataFrame:
    return versions.with_validity(price_versions(t), "sku_id", "changed").select("sku_id", "valid_from", "valid_to", "list_cents")


#: Startups of the test tables lie hours apart.
SESSION_GAP = "6 hours"
SESSIONS_SQL = sql("""
    SELECT mid AS device, min(ms) AS started, max(ms) AS last_seen, count(*) AS events
    FROM (SELECT *, sum(fresh) OVER (PARTITION BY mid ORDER BY ms, seq) AS session
          FROM (SELECT *, CASE WHEN ms - lag(ms) OVER (PARTITION BY mid ORDER BY ms, seq) <= 21600000 THEN 0 ELSE 1 END AS fresh FROM logs))
    GROUP BY mid, session""", "logs")


def session_rows(found: DataFrame) -> DataFrame:
    return found.select("device", F.unix_millis("session_start").alias("started"), F.unix_millis("last_seen").alias("last_seen"), "events")


@query("t2_device_sessions", SESSIONS_SQL)
def device_sessions(t: Tables) -> DataFrame:
    logs = t.startups.select(F.col("common.mid").alias("mid"), F.timestamp_millis("ts").alias("at"))
    return session_rows(sessions.sessions(logs, "mid", "at", SESSION_GAP))


_REACH = """
    SELECT a.dt, n AS days, count(DISTINCT b.mid) AS {0}
    FROM (SELECT DISTINCT dt FROM logs) a, (VALUES (7), (30)) w(n),
         (SELECT DISTINCT dt, mid FROM logs) b
    WHERE CAST(b.dt AS DATE) <= CAST(a.dt AS DATE) AND CAST(b.dt AS DATE) > CAST(a.dt AS DATE) - n GROUP BY 1, 2"""


def device_days(t: Tables) -> DataFrame:
    """A row per device and day."""
    return active.with_day_hour(t.startups).select("dt", F.col("common.mid").alias("mid")).distinct()


def bitmaps_of_days(t: Tables, days: DataFrame) -> DataFrame:
    """The daily bitmaps as a stored table, which is all that a range of days reads."""
    path = run_dir(t.spark, "daily-bitmaps")
    reach.daily_bitmaps(days, reach.device_numbers(days)).write.parquet(path)
    return t.spark.read.parquet(path)


@query("a1_actives_of_ranges", sql(_REACH.format("devices"), "logs"))
def actives_of_ranges(t: Tables) -> DataFrame:
    """Devices active within 7 and 30 days up to each day, exactly, from daily bitmaps."""
    return reach.reach(bitmaps_of_days(t, device_days(t)))


@query("a5_estimated_actives", sql(f"SELECT dt, days, exact, true AS near FROM ({_REACH.format('exact')})", "logs"))
def estimated_actives(t: Tables) -> DataFrame:
    """The same by sketches, next to the exact figures: within four standard errors of them."""
    days = device_days(t)
    exact = reach.reach(bitmaps_of_days(t, days)).withColumnRenamed("devices", "exact")
    near = F.abs(F.col("estimate") - F.col("exact")) <= F.greatest(F.lit(1.0), 4 * 1.04 / 2 ** (reach.LG / 2) * F.col("exact"))
    return exact.join(reach.estimated_reach(reach.daily_sketches(days)), ["dt", "days"]).select("dt", "days", "exact", near.alias("near"))


@query("t2_device_sessions_stream", SESSIONS_SQL)
def device_sessions_stream(t: Tables) -> DataFrame:
    """The same from a stream. A session comes out when the watermark has passed its end, so a last row, of no
    device and a long time after all others, closes those that are open."""
    logs = t.startups.select(F.col("common.mid").alias("mid"), F.timestamp_millis("ts").alias("at"))
    closing = logs.agg(F.lit(None).cast("string").alias("mid"), (F.max("at") + F.expr("INTERVAL 100 DAYS")).alias("at"))
    arriving = staged(logs.unionByName(closing), f"{run_dir(t.spark, 't2-sessions')}/in").withWatermark("at", "1 hour")
    found = finished(sessions.sessions(arriving, "mid", "at", SESSION_GAP), "t2-sessions-out")
    return session_rows(found.where("device IS NOT NULL"))
