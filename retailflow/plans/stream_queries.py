"""Queries that run as streams, to the end of what is there, and read back their output. A run
takes all files in one micro-batch unless it says otherwise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from retailflow import schemas
from retailflow.functions import to_cents
from retailflow.operators import orders, reports, routing, wide
from retailflow.plans import warehouse
from retailflow.plans.oracle import change_kind, sql
from retailflow.plans.registry import query
from retailflow.plans.row_queries import database_changes
from retailflow.session import run_dir, stateful_start
from retailflow.sources import storage, tables, topics
from retailflow.sources.tables import AS_OF, Tables
from retailflow.streaming import jobs, keyed, state


def finished(rows: DataFrame, name: str) -> DataFrame:
    """Runs a stream to the end into files and returns these."""
    path = run_dir(rows.sparkSession, name)
    stream = rows.writeStream.format("parquet").option("path", f"{path}/out").option(
        "checkpointLocation", f"{path}/checkpoint"
    )
    with stateful_start(rows.sparkSession):
        query = stream.trigger(availableNow=True).start()
    query.awaitTermination()
    return rows.sparkSession.read.schema(rows.schema).parquet(f"{path}/out")


def warehouse_at(t: Tables, name: str, files_per_trigger: int | None = None) -> jobs.Warehouse:
    return jobs.Warehouse(
        t.spark, run_dir(t.spark, name), available_now=True, files_per_trigger=files_per_trigger,
        write_tasks=t.spark.sparkContext.defaultParallelism,
    )


def staged(rows: DataFrame, path: str) -> DataFrame:
    """Rows as a stream: written as files of the shared folder, read back file by file."""
    rows.write.parquet(path)
    return rows.sparkSession.readStream.schema(rows.schema).parquet(path)


def to_topic(rows: DataFrame, wh: jobs.Warehouse, topic: str, batch_id: int = 0) -> None:
    topics.write_topic(rows.withColumn("topic", F.lit(topic)), wh.topics, batch_id)


@query("s1_topic_source", sql("""
    SELECT seq, mid, ms AS ts FROM logs WHERE event_type IN ('signup', 'view')""", "logs"))
def topic_source(t: Tables) -> DataFrame:
    """The startup topic read as a stream."""
    wh = warehouse_at(t, "s1")
    topics.write_topic(routing.route_log(t.app_logs), wh.topics, 0)
    startups = schemas.decode(wh.stream(routing.STARTUP_TOPIC).select("seq", "value"), schemas.STARTUP_LOG)
    return finished(startups.select("seq", F.col("common.mid").alias("mid"), "ts"), "s1-out")


@query("t1_microbatch", """
    SELECT event_type AS kind, count(*) AS n FROM events GROUP BY 1""")
def microbatch(t: Tables) -> DataFrame:
    """At least three files, one per micro-batch; the counts of the batches are added up."""
    root = run_dir(t.spark, "t1")
    events = t.raw("events").select("event_id", "event_type")
    for n in range(3):
        storage.write_batch(events.filter(F.col("event_id") % 3 == n), f"{root}/in/part={n}", n)
    source = t.spark.readStream.schema("event_id bigint, event_type string, part bigint, batch_id bigint").option(
        "maxFilesPerTrigger", 1).parquet(f"{root}/in")

    def handle(batch: DataFrame, n: int) -> None:
        counts = batch.groupBy(F.col("event_type").alias("kind")).agg(F.count(F.lit(1)).alias("n"))
        storage.write_batch(counts, f"{root}/out", n)

    wh = jobs.Warehouse(t.spark, root, available_now=True)
    wh.launch(source, "t1", handle).awaitTermination()
    return t.spark.read.parquet(f"{root}/out").groupBy("kind").agg(F.sum("n").alias("n"))


@query("t2_sliding_window_stream", """
    SELECT strftime(start, '%Y-%m-%d %H:%M:%S') AS window_start, count(*) AS n FROM (
        SELECT unnest([time_bucket(INTERVAL 12 HOUR, ts), time_bucket(INTERVAL 12 HOUR, ts) - INTERVAL 12 HOUR]) AS start
        FROM events)
    GROUP BY 1""")
def sliding_window_stream(t: Tables) -> DataFrame:
    """Rows per window, 24 hours long every 12, each window as it stands at the end."""
    root = run_dir(t.spark, "t2")
    events = t.raw_stream("events").select(F.col("ts").cast("timestamp").alias("ts"))
    counts = events.withWatermark("ts", "1 hour").groupBy(F.window("ts", "24 hours", "12 hours").alias("w")).agg(
        F.count(F.lit(1)).alias("n"))
    rows = counts.select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "n")

    def handle(batch: DataFrame, n: int) -> None:
        storage.write_batch(batch, f"{root}/out", n)

    stream = rows.writeStream.outputMode("update").foreachBatch(handle).option("checkpointLocation", f"{root}/checkpoint")
    stream.trigger(availableNow=True).start().awaitTermination()
    written = t.spark.read.parquet(f"{root}/out")
    return written.groupBy("window_start").agg(F.max_by("n", "batch_id").alias("n"))


@query("t3_dau_state_ttl", sql("SELECT dt, mid FROM firsts", "firsts"))
def dau_state_ttl(t: Tables) -> DataFrame:
    """Active devices by the state store. Which of a device's startups is processed first is not
    fixed within a micro-batch, so only day and device are compared."""
    return finished(state.stream_dau(tables.startups(t.raw_stream("events"))).select("dt", "mid"), "t3")


def at_second(n: Column) -> Column:
    """The n-th second of 2024 (a stream's watermark starts at the epoch, so times must lie after it)."""
    return F.timestamp_seconds(n + 1704067200)


_NEAR = sql("""
    SELECT d.order_id, d.id AS order_detail_id, h.user_id
    FROM details d JOIN heads h ON d.order_id = h.id WHERE d.sku_num <= 5""", "details", "heads")


def window_join(t: Tables, name: str, salts: int) -> DataFrame:
    path = run_dir(t.spark, name)
    placed = t.order_heads.withColumn("order_time", at_second(F.col("id")))
    arrival = at_second(F.col("order_id") + F.col("sku_num"))
    named = t.order_detail.withColumn("detail_time", arrival)
    pairs = state.stream_order_detail_join(
        staged(placed, f"{path}/orders"), staged(named, f"{path}/details"), salts=salts
    )
    return finished(pairs.select("d.order_id", F.col("d.id").alias("order_detail_id"), "o.user_id"), f"{name}-out")


@query("j6_order_detail_window_join", _NEAR)
def order_detail_window_join(t: Tables) -> DataFrame:
    """Order k arrives at second k, a line of q pieces q seconds later; pairs up to 5 seconds
    apart match."""
    return window_join(t, "j6", salts=1)


@query("j6_window_join_salted", _NEAR)
def window_join_salted(t: Tables) -> DataFrame:
    """The same with every order's lines spread over four keys."""
    return window_join(t, "j6s", salts=4)


@query("t4_join_seen_state", sql("SELECT order_id, id AS order_detail_id FROM details", "details"))
def join_seen_state(t: Tables) -> DataFrame:
    """Every line arrives twice within the watermark and comes out once."""
    path = run_dir(t.spark, "t4")
    lines = t.order_detail.select("order_id", F.col("id").alias("order_detail_id"))
    twice = lines.select("*", F.explode(F.array(F.lit(0), F.lit(5))).alias("late"))
    source = staged(twice.withColumn("at", at_second(F.col("order_id") + F.col("late"))), f"{path}/in")
    once = source.withWatermark("at", "10 seconds").dropDuplicatesWithinWatermark(["order_id", "order_detail_id"])
    return finished(once.select("order_id", "order_detail_id"), "t4-out")


def order_messages(placed: DataFrame) -> DataFrame:
    return placed.select(F.col("id").alias("seq"), *schemas.encode("id", placed.columns))


def feed_orders(t: Tables, wh: jobs.Warehouse, parts: list[DataFrame]) -> None:
    """Users with earlier orders are known; then each part goes through the order job as a micro-batch."""
    known = schemas.conform(t.user_state, schemas.USER_STATE)
    storage.write_batch(known, wh.folder("state", "user_state"), topics.BACKFILL_BATCH)
    for n, part in enumerate(parts):
        to_topic(order_messages(part), wh, "ODS_ORDER_INFO", n)
        jobs.order_info(wh).awaitTermination()


@query("t5_user_first_order_state", sql("SELECT id, user_id, if_first_order FROM flagged", "flagged"))
def user_first_order_state(t: Tables) -> DataFrame:
    """The order job over three micro-batches, each with a third of each user's
    orders, by time: so the first order of a user comes first."""
    wh = warehouse_at(t, "t5")
    third = F.ntile(3).over(Window.partitionBy("user_id").orderBy("create_time", "id"))
    placed = t.order_heads.withColumn("third", third)
    feed_orders(t, wh, [placed.filter(F.col("third") == n).drop("third") for n in (1, 2, 3)])
    return jobs.order_docs(wh).select("id", "user_id", "if_first_order")


_REPEATED = sql("""
    SELECT 'document' AS sink, id, user_id, if_first_order FROM flagged
    UNION ALL SELECT 'message', id, user_id, if_first_order FROM flagged""", "flagged")


@query("t9_repeated_orders", _REPEATED)
def repeated_orders(t: Tables) -> DataFrame:
    """Every order comes twice, in different micro-batches: the flag stays what it was, in the documents
    and in every message."""
    wh = warehouse_at(t, "t9r")
    even = t.order_heads.filter(F.col("user_id") % 2 == 0)
    odd = t.order_heads.filter(F.col("user_id") % 2 == 1)
    feed_orders(t, wh, [even, even.unionByName(odd), odd])
    documents = jobs.order_docs(wh).select(F.lit("document").alias("sink"), "id", "user_id", "if_first_order")
    messages = schemas.decode(topics.read_topic(t.spark, wh.topics, jobs.DWD_ORDER_INFO), schemas.ORDER_INFO)
    distinct = messages.select(F.lit("message").alias("sink"), "id", "user_id", "if_first_order").distinct()
    return documents.unionByName(distinct)


_LINES = sql("SELECT order_id, order_detail_id, dt, paid AS final_total_cents, final_cents AS final_detail_cents FROM split", "split")


def wide_result(wh: jobs.Warehouse) -> DataFrame:
    return jobs.wide_rows(wh).select(
        "order_id", "order_detail_id", "dt", to_cents("final_total_amount").alias("final_total_cents"),
        to_cents("final_detail_amount").alias("final_detail_cents"))


def line_thirds(t: Tables) -> DataFrame:
    """Wide rows, the lines of each order in three parts by line id."""
    rows = wide.wide_merge(orders.with_create_day_hour(t.order_info.withColumns({
        c: F.lit(None).cast("string") for c in ("if_first_order", "province_name", "province_area_code", "user_age_group", "user_gender")})),
        t.order_detail.withColumns({c: F.lit(None) for c in ("sku_name", "spu_id", "tm_id", "category3_id", "spu_name", "tm_name", "category3_name")}))
    return rows.withColumn("third", F.ntile(3).over(Window.partitionBy("order_id").orderBy("order_detail_id")))


@query("t6_order_split_state", _LINES)
def order_split_state(t: Tables) -> DataFrame:
    """The lines of every order over three micro-batches, in line order: line by line what one batch gives."""
    wh = warehouse_at(t, "t6")
    with storage.held(line_thirds(t), wh.root) as rows:
        for n in range(3):
            jobs.wide_batch(wh, rows.filter(F.col("third") == n + 1).drop("third"), n)
    return wide_result(wh)


@query("t4_wide_repeats_after_weeks", _LINES)
def wide_repeats_after_weeks(t: Tables) -> DataFrame:
    """After more than two weeks of micro-batches lines come again, with the ones that close their
    orders; the tables have been folded twice by then."""
    wh = warehouse_at(t, "t4w")
    with storage.held(line_thirds(t), wh.root) as rows:
        jobs.wide_batch(wh, rows.filter("third = 1").drop("third"), 0)
        jobs.wide_fold(wh, 0)
        jobs.wide_batch(wh, rows.filter("third <= 2").drop("third"), 300_000)
        jobs.wide_fold(wh, 300_000)
        jobs.wide_batch(wh, rows.drop("third"), 600_000)
    return wide_result(wh)


@query("t10_wide_late_orders", _LINES)
def wide_late_orders(t: Tables) -> DataFrame:
    """Orders and their lines in three micro-batches against the order of their own times, with all of the
    micro-batch before once more. They meet by arrival."""
    wh = warehouse_at(t, "t10w")
    third = F.ntile(3).over(Window.orderBy(F.desc("day")))
    days = t.order_heads.select(F.to_date("create_time").alias("day")).distinct().withColumn("third", third)
    placed = orders.with_create_day_hour(t.order_info.join(days, F.to_date("create_time") == F.col("day")).drop("day")).persist()
    lines = t.order_detail.join(placed.select(F.col("id").alias("order_id"), "third"), "order_id").persist()
    for n in range(3):
        now = F.col("third").isin(n, n + 1)
        to_topic(order_messages(placed.filter(now).drop("third")), wh, jobs.DWD_ORDER_INFO, n)
        to_topic(order_messages(lines.filter(now).drop("third")), wh, jobs.DWD_ORDER_DETAIL, n)
        # Machines that run queries are slow: what was sent together may arrive minutes apart.
        jobs.order_wide(wh, tolerance="1 hour", watermark="1 hour").awaitTermination()
    placed.unpersist()
    lines.unpersist()
    return wide_result(wh)


def heartbeat(t: Tables, wh: jobs.Warehouse, batch_id: int, days: int) -> None:
    """Some orders and their lines once more, days later: time goes on, and with it what waits."""
    later = F.current_timestamp() + F.expr(f"INTERVAL {days} DAYS")
    placed = orders.with_create_day_hour(t.order_info).filter(F.col("id") % 50 == 0)
    some = t.order_detail.filter(F.col("order_id") % 50 == 0)
    to_topic(order_messages(placed).withColumn("arrived", later), wh, jobs.DWD_ORDER_INFO, batch_id)
    to_topic(order_messages(some).withColumn("arrived", later), wh, jobs.DWD_ORDER_DETAIL, batch_id)
    jobs.order_wide(wh).awaitTermination()


_NONE_WAITS = sql("""
    SELECT 'wide' AS sink, order_id, order_detail_id, paid AS final_total_cents, final_cents AS final_detail_cents FROM split""", "split")


def wide_and_waiting(wh: jobs.Warehouse) -> DataFrame:
    """The wide rows, and the lines that still wait, which should be none."""
    done = wide_result(wh).select(F.lit("wide").alias("sink"), "order_id", "order_detail_id", "final_total_cents", "final_detail_cents")
    nothing = F.lit(None).cast("bigint")
    waiting = jobs.waiting_lines(wh).select(
        F.lit("waiting").alias("sink"), "order_id", F.col("id").alias("order_detail_id"), nothing.alias("final_total_cents"), nothing.alias("final_detail_cents"))
    return done.unionByName(waiting)


@query("t10_late_partners", _NONE_WAITS)
def late_partners(t: Tables) -> DataFrame:
    """Half of the orders come a day after their lines, the others a day before them; the job runs with its own settings. All
    lines find their orders, once each, and none waits in the end."""
    wh = warehouse_at(t, "t10p")
    placed, even = orders.with_create_day_hour(t.order_info), F.col("id") % 2 == 0
    lines, of_even = t.order_detail, F.col("order_id") % 2 == 0
    for n, (some_orders, some_lines) in enumerate([(placed.filter(~even), lines.filter(of_even)), (placed.filter(even), lines.filter(~of_even))]):
        arrived = F.current_timestamp() + F.expr(f"INTERVAL {n} DAYS")
        to_topic(order_messages(some_orders).withColumn("arrived", arrived), wh, jobs.DWD_ORDER_INFO, n)
        to_topic(order_messages(some_lines).withColumn("arrived", arrived), wh, jobs.DWD_ORDER_DETAIL, n)
        jobs.order_wide(wh).awaitTermination()
    heartbeat(t, wh, 2, 3)
    heartbeat(t, wh, 3, 5)
    return wide_and_waiting(wh)


@query("s13_order_backfill", sql("""
    SELECT 'document' AS sink, id, if_first_order FROM flagged
    UNION ALL SELECT 'message', id, if_first_order FROM flagged
    UNION ALL SELECT DISTINCT 'wide', order_id, if_first_order FROM details JOIN flagged f ON order_id = f.id""", "flagged", "details"))
def order_backfill(t: Tables) -> DataFrame:
    """Orders come youngest third first, each user's, and all from before as bootstrap rows of the change log. Documents,
    newest messages and wide rows hold the flags that all orders together give."""
    wh = warehouse_at(t, "s13o")
    known = schemas.conform(t.user_state, schemas.USER_STATE)
    storage.write_batch(known, wh.folder("state", "user_state"), topics.BACKFILL_BATCH)
    to_topic(order_messages(t.order_detail), wh, jobs.DWD_ORDER_DETAIL)
    third = F.ntile(3).over(Window.partitionBy("user_id").orderBy(F.desc("create_time"), F.desc("id")))
    placed = t.order_info.withColumn("third", third).persist()
    for n in range(3):
        part = placed.filter(F.col("third") == n + 1).drop("third")
        envelope = F.struct(F.lit("order_info").alias("table"), F.lit("bootstrap-insert").alias("type"), F.struct(*part.columns).alias("data"))
        changes = part.select(F.col("id").alias("seq"), F.to_json(envelope).alias("value"))
        routed = routing.cdc_filter_route(changes, order_kinds=("insert", "bootstrap-insert"))
        topics.write_topic(routed, wh.topics, n, "backfill")
        jobs.order_info(wh).awaitTermination()
        jobs.order_wide(wh).awaitTermination()
    placed.unpersist()
    # Time goes on, by messages of no consequence.
    for n, days in ((10, 2), (11, 4)):
        for topic in (jobs.DWD_ORDER_INFO, jobs.DWD_ORDER_DETAIL):
            last = topics.read_topic(t.spark, wh.topics, topic).filter(F.col("seq") % 50 == 0)
            newest = Window.partitionBy("key").orderBy(F.desc("arrived"))
            again = last.withColumn("place", F.row_number().over(newest)).filter("place = 1")
            again = again.select("key", "value", "seq", (F.current_timestamp() + F.expr(f"INTERVAL {days} DAYS")).alias("arrived"))
            to_topic(again, wh, topic, n)
        jobs.order_wide(wh).awaitTermination()
    documents = jobs.order_docs(wh).select(F.lit("document").alias("sink"), "id", "if_first_order")
    messages = topics.read_topic(t.spark, wh.topics, jobs.DWD_ORDER_INFO)
    decoded = schemas.decode(messages.select("value", "arrived"), schemas.ORDER_INFO)
    newest = decoded.groupBy("id").agg(F.max_by("if_first_order", "arrived").alias("if_first_order"))
    rows = jobs.wide_rows(wh).select(F.lit("wide").alias("sink"), F.col("order_id").alias("id"), "if_first_order").distinct()
    return documents.unionByName(newest.select(F.lit("message").alias("sink"), "id", "if_first_order")).unionByName(rows)


def dims_ready(t: Tables, wh: jobs.Warehouse) -> None:
    storage.upsert_dim(t.province, wh.folder("dim", "base_province"), 0)
    storage.upsert_dim(warehouse.users(t), wh.folder("dim", "user_info"), 0)


@query("t7_fan_out", sql("""
    SELECT 'documents' AS sink, id, user_id, if_first_order, province_name FROM fresh
    UNION ALL SELECT 'messages', id, user_id, if_first_order, province_name FROM fresh
    UNION ALL SELECT 'user_state', id, user_id, if_first_order, NULL FROM fresh WHERE if_first_order = '1'""",
    "full_orders", then="""fresh AS (
        SELECT * REPLACE (CASE WHEN row_number() OVER (PARTITION BY user_id ORDER BY create_time, id) = 1
                               THEN '1' ELSE '0' END AS if_first_order) FROM full_orders)"""))
def fan_out(t: Tables) -> DataFrame:
    """The order job, starting without any user state, and what its three sinks hold."""
    wh = warehouse_at(t, "t7")
    dims_ready(t, wh)
    to_topic(order_messages(t.order_info), wh, "ODS_ORDER_INFO")
    jobs.order_info(wh).awaitTermination()
    fields = ["id", "user_id", "if_first_order", "province_name"]
    messages = schemas.decode(topics.read_topic(t.spark, wh.topics, jobs.DWD_ORDER_INFO), schemas.ORDER_INFO)
    states = storage.read_batches(t.spark, wh.folder("state", "user_state"), schemas.USER_STATE)
    states = states.select(F.col("order_id").alias("id"), F.col("user_id").cast("bigint").alias("user_id"),
                           F.col("if_consumed").alias("if_first_order"), F.lit(None).cast("string").alias("province_name"))
    rows = {"documents": jobs.order_docs(wh).select(fields), "messages": messages.select(fields), "user_state": states}
    parts = [frame.select(F.lit(sink).alias("sink"), *fields) for sink, frame in rows.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("t8_dim_refresh", sql("""
    SELECT d.order_id, d.id AS detail_id, CASE WHEN d.order_id % 2 = 0 THEN s.tm_name ELSE s.tm_name || '+' END AS tm_name
    FROM details d JOIN skus s ON d.sku_id = s.id""", "details", "skus"))
def dim_refresh(t: Tables) -> DataFrame:
    """Even orders' lines are processed, then the brand names change, then the odd ones'."""
    wh = warehouse_at(t, "t8")
    skus = warehouse.skus(t)
    lines = t.order_detail.select(F.col("order_id").alias("seq"), *schemas.encode("id", t.order_detail.columns))
    for n in (0, 1):
        named = skus if n == 0 else skus.withColumn("tm_name", F.concat("tm_name", F.lit("+")))
        storage.upsert_dim(named, wh.folder("dim", "sku_info"), n)
        to_topic(lines.filter(F.col("seq") % 2 == n), wh, "ODS_ORDER_DETAIL", n)
        jobs.order_detail(wh).awaitTermination()
    messages = schemas.decode(topics.read_topic(t.spark, wh.topics, jobs.DWD_ORDER_DETAIL), schemas.ORDER_DETAIL)
    return messages.select("order_id", F.col("id").alias("detail_id"), "tm_name")


@query("t9_at_least_once", sql("SELECT dt, mid, hr, ms AS ts FROM firsts", "firsts"))
def at_least_once(t: Tables) -> DataFrame:
    """A batch is run a second time, as after a failure between output and commit."""
    wh = warehouse_at(t, "t9")
    to_topic(startup_messages(t), wh, routing.STARTUP_TOPIC)
    batch = topics.read_topic(t.spark, wh.topics, routing.STARTUP_TOPIC)
    for _ in range(2):
        jobs.dau_batch(wh, batch, 0)
    return jobs.dau_docs(wh).select("dt", "mid", "hr", "ts")


def startup_messages(t: Tables) -> DataFrame:
    value = F.to_json(F.struct("common", F.lit("1").alias("start"), "ts")).alias("value")
    return t.startups.select("seq", value)


@query("t10_late_data", sql("SELECT dt, mid, hr, ms AS ts FROM firsts", "firsts"))
def late_data(t: Tables) -> DataFrame:
    """The second half of the month comes first; late startups count like any others."""
    wh = warehouse_at(t, "t10")
    second_half = F.get_json_object("value", "$.ts").cast("bigint") >= 1705363200000
    for n, part in enumerate((second_half, ~second_half)):
        to_topic(startup_messages(t).filter(part), wh, routing.STARTUP_TOPIC, n)
        jobs.dau(wh).awaitTermination()
    return jobs.dau_docs(wh).select("dt", "mid", "hr", "ts")


@query("t11_stream_route", sql(f"""
    SELECT CASE WHEN event_type IN ('signup', 'view') THEN '{routing.STARTUP_TOPIC}' ELSE '{routing.EVENT_TOPIC}' END
           AS topic, event_id AS seq, CAST(NULL AS BIGINT) AS id FROM events
    UNION ALL
    SELECT topic, seq, id FROM (
        SELECT 'ODS_ORDER_INFO' AS topic, o_orderkey AS seq, o_orderkey AS id FROM orders
        UNION ALL SELECT 'ODS_ORDER_DETAIL', order_id, id FROM details
        UNION ALL SELECT 'ODS_USER_INFO', c_custkey, c_custkey FROM customer
        UNION ALL SELECT 'ODS_SKU_INFO', p_partkey, p_partkey FROM part
        UNION ALL SELECT 'ODS_BASE_PROVINCE', n_nationkey, n_nationkey FROM nation)
    WHERE {change_kind('seq')} <> 'delete' AND (topic <> 'ODS_ORDER_INFO' OR {change_kind('seq')} = 'insert')""", "details"))
def stream_route(t: Tables) -> DataFrame:
    """Both routing jobs at work on staged files."""
    wh = warehouse_at(t, "t11")
    jobs.split_logs(wh, staged(t.app_logs, f"{wh.root}/in/logs")).awaitTermination()
    jobs.split_changes(wh, staged(database_changes(t), f"{wh.root}/in/changes")).awaitTermination()
    routed = t.spark.read.parquet(wh.topics)
    return routed.select("topic", "seq", F.get_json_object("value", "$.id").cast("bigint").alias("id"))


@query("t11_two_routers", sql(f"""
    SELECT 'ODS_USER_INFO' AS topic, 'split_changes' AS producer, c_custkey AS id FROM customer WHERE {change_kind('c_custkey')} <> 'delete'
    UNION ALL SELECT 'ODS_USER_INFO', 'split_changes_arrays', c_custkey FROM customer
    UNION ALL SELECT 'ODS_SKU_INFO', 'split_changes_arrays', p_partkey FROM part
    UNION ALL SELECT 'quarantine', producer, NULL FROM (VALUES ('split_changes'), ('split_changes_arrays')) v(producer)"""))
def two_routers(t: Tables) -> DataFrame:
    """Both forms of the change router write into one topic, each its first batch; a message that is no
    envelope goes to each one's quarantine."""
    wh = warehouse_at(t, "t11r")
    broken = t.spark.createDataFrame([(0, '{"table": ')], "seq bigint, value string")

    def arrays(rows: DataFrame, table: str) -> DataFrame:
        envelope = F.to_json(F.struct(F.lit(table).alias("table"), F.array(F.struct(*rows.columns)).alias("data")))
        return rows.select(F.col("id").cast("bigint").alias("seq"), envelope.alias("value"))

    single = tables.change_log(t.user_rows, "user_info", "id").select("seq", "value").unionByName(broken)
    many = arrays(t.user_rows, "user_info").unionByName(arrays(t.sku_rows, "sku_info")).unionByName(broken)
    jobs.split_changes(wh, staged(single, f"{wh.root}/in/single")).awaitTermination()
    jobs.split_changes(wh, staged(many, f"{wh.root}/in/many"), arrays=True).awaitTermination()
    routed = t.spark.read.parquet(wh.topics).select("topic", "producer", F.get_json_object("value", "$.id").cast("bigint").alias("id"))
    for job in ("split_changes", "split_changes_arrays"):
        bad = t.spark.read.parquet(wh.folder("quarantine", job))
        routed = routed.unionByName(bad.select(F.lit("quarantine").alias("topic"), F.lit(job).alias("producer"), F.lit(None).cast("bigint").alias("id")))
    return routed


@query("t12_stream_warehouse", sql(f"""
    SELECT order_id, order_detail_id, user_id, sku_name, tm_name, category3_name, province_name, user_age_group, user_gender,
           if_first, dt, paid AS final_total_cents, final_cents AS final_detail_cents
    FROM split JOIN (
        SELECT id, CASE WHEN row_number() OVER (PARTITION BY user_id ORDER BY create_time, id) = 1 THEN '1' ELSE '0' END
               AS if_first
        FROM heads WHERE {change_kind('id')} = 'insert') ON id = order_id""", "split"))
def stream_warehouse(t: Tables) -> DataFrame:
    """All jobs in a row, from change records to the wide table. Every change record of a SKU or
    user is an insert here, so that the dimensions are whole."""
    wh = warehouse_at(t, "t12")
    run_all(t, wh, batches=1)
    rows = jobs.wide_rows(wh)
    return rows.select(
        "order_id", "order_detail_id", "user_id", "sku_name", "tm_name", "category3_name", "province_name",
        "user_age_group", "user_gender", F.col("if_first_order").alias("if_first"), "dt",
        to_cents("final_total_amount").alias("final_total_cents"),
        to_cents("final_detail_amount").alias("final_detail_cents"),
    )


def run_all(t: Tables, wh: jobs.Warehouse, batches: int) -> None:
    """Feeds the source tables as changes in `batches` parts (by order) through every job."""
    created = t.order_heads.select(F.col("id").alias("order_id"), "create_time")
    details = t.order_detail.join(created, "order_id").withColumn("number", F.col("order_id"))

    def inserts(rows: DataFrame, table: str) -> DataFrame:
        data = F.struct(*rows.columns)
        envelope = F.to_json(F.struct(F.lit(table).alias("table"), F.lit("insert").alias("type"), data.alias("data")))
        return rows.select(F.monotonically_increasing_id().alias("seq"), envelope.alias("value"))

    dims = {
        "base_province": t.province, "user_info": t.user_rows, "base_category3": t.category3,
        "base_trademark": t.trademark, "spu_info": t.spu, "sku_info": t.sku_rows,
    }
    changes = None
    for table, rows in dims.items():
        changes = inserts(rows, table) if changes is None else changes.unionByName(inserts(rows, table))
    facts = tables.change_log(t.order_info, "order_info", "id").unionByName(
        tables.change_log(details, "order_detail", "number"))
    arriving = f"{wh.root}/in/changes"
    changes.write.parquet(arriving)
    source = t.spark.readStream.schema(changes.schema).parquet(arriving)
    jobs.split_changes(wh, source).awaitTermination()
    for table in dims:
        jobs.dim(wh, table, AS_OF).awaitTermination()
    for part in range(batches):
        facts.filter(F.col("seq") % batches == part).write.mode("append").parquet(arriving)
        jobs.split_changes(wh, source).awaitTermination()
        jobs.order_info(wh).awaitTermination()
        jobs.order_detail(wh).awaitTermination()
    jobs.order_wide(wh, tolerance="1 hour", watermark="1 hour").awaitTermination()


@query("t3_touch_expiry", sql("""
    SELECT mid, ms AS ts FROM (SELECT *, lag(ms) OVER (PARTITION BY mid ORDER BY ms) AS before FROM (SELECT DISTINCT mid, ms FROM logs))
    WHERE before IS NULL OR ms - before >= 86400000""", "logs"))
def touch_expiry(t: Tables) -> DataFrame:
    """Devices that start after a day or more without a touch, by the state store; the stream comes in three parts, by time, and
    the query starts again for each."""
    path = run_dir(t.spark, "t3-touch")
    logs = t.startups.select(F.col("common.mid").alias("mid"), "ts")
    bounds = logs.agg(F.min("ts"), F.max("ts")).first()
    step = (bounds[1] - bounds[0]) // 3 + 1 if bounds[0] is not None else 1
    for n in range(3):
        part = logs.filter(F.expr(f"(ts - {bounds[0] or 0}) div {step}") == n)
        part.write.mode("append").parquet(f"{path}/in")
        rows = keyed.stream_active(t.spark.readStream.schema(logs.schema).parquet(f"{path}/in"))
        writer = rows.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint")
        writer.trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.schema("mid string, ts bigint").parquet(f"{path}/out")


#: Blocks of users that lie in one state each.
USER_BLOCKS = 2048


@query("t5_state_from_table", sql("""
    SELECT user_id, id, false AS known FROM flagged WHERE if_first_order = '1'
    UNION ALL SELECT CAST(c_custkey AS BIGINT), NULL, true FROM customer WHERE c_custkey % 10 = 0""", "flagged"))
def state_from_table(t: Tables) -> DataFrame:
    """Users' first orders as keyed state that starts from the table of known users, over three runs of the query, the youngest
    orders first; then the state itself, read as a table."""
    path = run_dir(t.spark, "t5-table")
    known = schemas.conform(t.user_state, schemas.USER_STATE)
    third = F.ntile(3).over(Window.partitionBy("user_id").orderBy(F.desc("create_time"), F.desc("id")))
    placed = t.order_heads.select("user_id", "create_time", "id", third.alias("third")).persist()
    for n in range(3):
        placed.filter(F.col("third") == n + 1).drop("third").write.mode("append").parquet(f"{path}/in")
        arriving = t.spark.readStream.schema(placed.drop("third").schema).parquet(f"{path}/in")
        writer = keyed.stream_first_orders(arriving, known, USER_BLOCKS).writeStream.outputMode("update").option("checkpointLocation", f"{path}/checkpoint")
        writer.foreachBatch(lambda batch, n: storage.write_batch(batch, f"{path}/out", n)).trigger(availableNow=True).start().awaitTermination()
    placed.unpersist()
    return keyed.read_first_orders(t.spark, f"{path}/checkpoint").select("user_id", "id", "known")


@query("a12_reports_by_deltas", sql("""
    SELECT 'gender' AS report, user_gender AS name, count(*) AS value FROM wide GROUP BY 2
    UNION ALL SELECT 'age', user_age_group, count(*) FROM wide GROUP BY 2
    UNION ALL SELECT 'province', province_name, CAST(sum(sku_num) AS BIGINT) FROM wide GROUP BY 2
    UNION ALL SELECT 'sku', sku_name, CAST(sum(sku_num) AS BIGINT) FROM wide GROUP BY 2""", "wide"))
def reports_by_deltas(t: Tables) -> DataFrame:
    """The wide rows in three batches. The second is run twice, the first time with rows of the third as well, as after a failure;
    contributions are folded in between. The reports equal those of the whole table."""
    path = run_dir(t.spark, "reports")
    third = F.pmod(F.xxhash64("order_id", "order_detail_id"), F.lit(3))
    rows = warehouse.stored_wide(t).withColumn("third", third)
    reports.keep(rows.filter("third = 0"), path, 0)
    reports.fold(t.spark, path)
    reports.keep(rows.filter("third >= 1"), path, 1)
    reports.keep(rows.filter("third = 1"), path, 1)
    reports.fold(t.spark, path)
    reports.keep(rows.filter("third = 2"), path, 2)
    sums = reports.kept(t.spark, path)
    parts = {"gender": reports.shares(sums, "user_gender"), "age": reports.shares(sums, "user_age_group"),
             "province": reports.province_sales(sums), "sku": reports.name_num_bars(sums).withColumnRenamed("num", "value")}
    named = [rows.select(F.lit(name).alias("report"), "name", "value") for name, rows in parts.items()]
    return named[0].unionByName(named[1]).unionByName(named[2]).unionByName(named[3])
