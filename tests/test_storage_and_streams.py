import json
import time
import uuid

import pytest
from pyspark.sql import functions as F

from retailflow import schemas
from retailflow.operators import active, orders, routing, wide
from retailflow.plans import stream_queries
from retailflow.session import run_dir, shared_root
from retailflow.sources import storage, topics
from retailflow.streaming import jobs, state

DAY = 1612137600000  # 2021-02-01 00:00 UTC
HOUR = 3600_000


@pytest.fixture
def wh(spark):
    return jobs.Warehouse(spark, run_dir(spark, "test"), available_now=True)


def send(rows, wh, topic, records, batch_id):
    data = [(topic, None, json.dumps(r), i) for i, r in enumerate(records)]
    topics.write_topic(rows(data, "topic string, key string, value string, seq bigint"), wh.topics, batch_id)


# -- storage ------------------------------------------------------------------------------------


def test_dim_versions_and_compaction(spark, rows):
    path = run_dir(spark, "dim")
    schema = "id string, spu_name string, seq bigint"
    read = lambda: {r.id: r.spu_name for r in storage.read_dim(spark, path, schemas.SPU_INFO).collect()}
    assert read() == {}
    storage.upsert_dim(rows([("1", "a", 0), ("1", "b", 1), ("2", "c", 0)], schema), path, 0)
    assert read() == {"1": "b", "2": "c"}
    storage.upsert_dim(rows([("2", "d", 0)], schema), path, 1)
    storage.upsert_dim(rows([("2", "d", 0)], schema), path, 1)  # replay
    assert read() == {"1": "b", "2": "d"}
    storage.compact_dim(spark, path, schemas.SPU_INFO)
    storage.upsert_dim(rows([("3", "e", 0), ("1", "f", 0)], schema), path, 2)
    assert read() == {"1": "f", "2": "d", "3": "e"}
    storage.compact_dim(spark, path, schemas.SPU_INFO)
    assert read() == {"1": "f", "2": "d", "3": "e"}
    # A backfill after the fold fills gaps and loses to what is there.
    storage.upsert_dim(rows([("4", "g", 0), ("1", "old", 0)], schema), path, -1)
    assert read() == {"1": "f", "2": "d", "3": "e", "4": "g"}
    storage.upsert_dim(rows([("5", "h", 0)], schema), path, 3)
    storage.compact_dim(spark, path, schemas.SPU_INFO)
    assert read() == {"1": "f", "2": "d", "3": "e", "4": "g", "5": "h"}


def test_single_document(spark, rows):
    path = run_dir(spark, "doc")
    doc = ("m", "u", "a", "c", "v", "2021-02-01", "00", "00", 1)
    storage.upsert_docs(spark.createDataFrame([doc], schemas.DAU_INFO), path, 0)
    storage.upsert_docs(spark.createDataFrame([doc[:4] + ("v2",) + doc[5:]], schemas.DAU_INFO), path, 1)
    assert [r.vc for r in storage.read_docs(spark, path, schemas.DAU_INFO, "mid").collect()] == ["v2"]


def test_topic_replay_prunes_batches(spark, rows, wh):
    for n in range(4):
        send(rows, wh, "T", [{"n": n}], n)
    replay = topics.read_topic(spark, wh.topics, "T", 1, 3)
    assert sorted(r.batch_id for r in replay.collect()) == [1, 2]
    assert "batch_id" in replay._jdf.queryExecution().executedPlan().toString().split("PartitionFilters")[1]
    assert topics.read_topic(spark, wh.topics, "none").count() == 0


def test_kafka_options():
    options = topics.kafka_options("h:1", ["a"], "g", {"a": {0: 5, 1: 7}})
    assert options["subscribe"] == "a" and options["kafka.group.id"] == "g"
    assert json.loads(options["startingOffsets"]) == {"a": {"0": 5, "1": 7}}
    assert topics.kafka_options("h:1", ["a"])["startingOffsets"] == "latest"


# -- daily actives ------------------------------------------------------------------------------


def startup(mid, ts):
    return {"common": {"mid": mid, "uid": mid, "ar": "1", "ch": "c", "vc": "v"}, "start": "x", "ts": ts}


@pytest.mark.parametrize("job", [jobs.dau, jobs.dau_with_expiry])
def test_dau_over_batches(spark, rows, wh, job):
    send(rows, wh, routing.STARTUP_TOPIC, [startup("a", DAY), startup("a", DAY + HOUR), startup("b", DAY)], 0)
    job(wh).awaitTermination()
    # a restart from the checkpoint: only the new batch is read
    send(rows, wh, routing.STARTUP_TOPIC, [startup("a", DAY + 2 * HOUR), startup("c", DAY), startup("a", DAY + 25 * HOUR)], 1)
    job(wh).awaitTermination()
    got = sorted((r.dt, r.mid) for r in jobs.dau_docs(wh).collect())
    assert got == [("2021-02-01", "a"), ("2021-02-01", "b"), ("2021-02-01", "c"), ("2021-02-02", "a")]


def test_late_startup_counts_by_index_not_by_expiry(spark, rows):
    """A startup three days late: the index job takes it, the job with expiry drops it."""
    counts = {}
    for job in (jobs.dau, jobs.dau_with_expiry):
        wh = jobs.Warehouse(spark, run_dir(spark, "late"), available_now=True)
        send(rows, wh, routing.STARTUP_TOPIC, [startup("a", DAY + 96 * HOUR)], 0)
        job(wh).awaitTermination()
        send(rows, wh, routing.STARTUP_TOPIC, [startup("b", DAY)], 1)
        job(wh).awaitTermination()
        counts[job.__name__] = jobs.dau_docs(wh).count()
    assert counts == {"dau": 2, "dau_with_expiry": 1}


def test_malformed_message_goes_to_quarantine(spark, rows, wh):
    send(rows, wh, routing.STARTUP_TOPIC, [startup("a", DAY)], 0)
    bad = rows([(routing.STARTUP_TOPIC, None, "{oops", 9)], "topic string, key string, value string, seq bigint")
    topics.write_topic(bad, wh.topics, 1)
    jobs.dau(wh).awaitTermination()
    assert jobs.dau_docs(wh).count() == 1
    stored = spark.read.parquet(wh.folder("quarantine", "dau"))
    assert [r._corrupt_record for r in stored.collect()] == ["{oops"]


# -- orders -------------------------------------------------------------------------------------


def order(i, user, time, original=120.0, final=100.0):
    return {"id": i, "user_id": user, "province_id": 1, "create_time": time, "original_total_amount": original,
            "final_total_amount": final, "benefit_reduce_amount": original - final, "feight_fee": 0.0}


def line(i, order_id, time, price=40.0):
    return {"id": i, "order_id": order_id, "sku_id": 1, "order_price": price, "sku_num": 1, "sku_name": "s", "create_time": time}


def test_first_order_over_batches_and_replay(spark, rows, wh):
    send(rows, wh, "ODS_ORDER_INFO", [order(2, 1, "2021-02-13 10:00:00"), order(1, 1, "2021-02-13 09:00:00")], 0)
    jobs.order_info(wh).awaitTermination()
    # An earlier order that arrives later takes the flag; the one that had it goes out again without.
    send(rows, wh, "ODS_ORDER_INFO", [order(3, 1, "2021-02-12 00:00:00"), order(4, 2, "2021-02-13 00:00:00")], 1)
    jobs.order_info(wh).awaitTermination()
    want = {1: "0", 2: "0", 3: "1", 4: "1"}
    flags = lambda: {r.id: r.if_first_order for r in jobs.order_docs(wh).collect()}
    assert flags() == want
    # The first batch once more, as after a failure before its commit.
    batch = topics.read_topic(spark, wh.topics, "ODS_ORDER_INFO", 0, 1)
    jobs.order_batch(wh, batch, 0)
    assert flags() == want
    assert topics.read_topic(spark, wh.topics, jobs.DWD_ORDER_INFO).count() == 5


def run_wide(wh):
    # What is sent together may arrive minutes apart on a slow machine.
    jobs.order_wide(wh, tolerance="1 hour", watermark="1 hour").awaitTermination()


def test_wide_job_late_line_and_repeated_line(spark, rows, wh):
    """Three lines of one order: two with the order, one of them sent twice, the third in a later
    batch and dated a day before; with it an order of last year and its line."""
    t0 = "2021-02-13 10:00:00"
    send(rows, wh, "ODS_ORDER_INFO", [order(1, 1, t0)], 0)
    send(rows, wh, "ODS_ORDER_DETAIL", [line(1, 1, t0), line(2, 1, t0), line(2, 1, t0)], 0)
    for job in (jobs.order_info, jobs.order_detail, run_wide):
        (done := job(wh)) and done.awaitTermination()
    send(rows, wh, "ODS_ORDER_INFO", [order(9, 1, "2020-01-01 00:00:00", 40.0, 40.0)], 1)
    send(rows, wh, "ODS_ORDER_DETAIL", [line(3, 1, "2021-02-12 10:00:04"), line(4, 9, "2020-01-01 00:00:00"), line(1, 1, t0)], 1)
    for job in (jobs.order_info, jobs.order_detail, run_wide):
        (done := job(wh)) and done.awaitTermination()
    got = {r.order_detail_id: round(r.final_detail_amount * 100) for r in jobs.wide_rows(wh).collect()}
    assert got == {1: 3333, 2: 3333, 3: 3334, 4: 4000}
    assert jobs.wide_rows(wh).count() == 4


def test_wide_job_keeps_what_it_cannot_join(spark, rows, wh):
    """A line without an order, and messages that are no records."""
    def put(topic, values, n):
        data = [(topic, None, v, i) for i, v in enumerate(values)]
        topics.write_topic(rows(data, "topic string, key string, value string, seq bigint"), wh.topics, n)

    jobs.order_wide(wh, "1 second", "1 second").awaitTermination()  # before there is any message
    put(jobs.DWD_ORDER_INFO, [json.dumps(order(1, 1, "2021-02-13 10:00:00")), "{oops"], 0)
    put(jobs.DWD_ORDER_DETAIL, [json.dumps(line(7, 5, "2021-02-13 10:00:00"))], 0)
    jobs.order_wide(wh, "1 second", "1 second").awaitTermination()
    time.sleep(3)
    for n in (1, 2):
        put(jobs.DWD_ORDER_INFO, [json.dumps(order(10 + n, 1, "2021-02-13 10:00:00"))], n)
        put(jobs.DWD_ORDER_DETAIL, [json.dumps(line(10 + n, 99, "2021-02-13 10:00:00"))], n)
        jobs.order_wide(wh, "1 second", "1 second").awaitTermination()
        time.sleep(3)
    bad = spark.read.parquet(wh.folder("quarantine", "order_wide"))
    assert [r._corrupt_record for r in bad.collect()] == ["{oops"]
    alone = spark.read.parquet(wh.folder("unmatched", "order_wide"))
    assert 7 in {json.loads(r._unmatched)["id"] for r in alone.collect()}
    assert jobs.wide_rows(wh).count() == 0


def test_folds_leave_readers_what_they_read(spark, rows, wh):
    for n, (i, user) in enumerate([(1, 1), (2, 1), (3, 2), (3, 2), (4, 3)]):
        send(rows, wh, "ODS_ORDER_INFO", [order(i, user, f"2021-02-1{n} 00:00:00")], n)
        jobs.order_info(wh).awaitTermination()
        want = sorted((r.id, r.if_first_order) for r in jobs.order_docs(wh).collect())
        jobs.order_fold(wh, n)
        assert sorted((r.id, r.if_first_order) for r in jobs.order_docs(wh).collect()) == want
    assert {r.id: r.if_first_order for r in jobs.order_docs(wh).collect()} == {1: "1", 2: "0", 3: "1", 4: "1"}
    state_path = wh.folder("state", "user_state")
    assert storage.read_batches(spark, state_path, schemas.USER_STATE).count() == 3
    # Batches that an earlier fold took in are gone, the rest is there for readers under way.
    assert min(storage._numbered(spark, state_path, "batch_id")) == 4


def test_jobs_fold_by_themselves(spark, rows, wh):
    wh.fold_every = 2
    for n in range(4):
        send(rows, wh, routing.STARTUP_TOPIC, [startup(f"m{n}", DAY)], n)
        jobs.dau(wh).awaitTermination()
    assert jobs.dau_docs(wh).count() == 4
    assert storage.exists(spark, wh.folder("docs", "dau_info") + "-folded/upto=1")


def test_a_cluster_must_name_the_shared_folder():
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError):
        shared_root(Session())


def test_wide_batch_replay(spark, rows, wh):
    base = {"create_time": "2021-02-13 10:00:00", "sku_num": 1, "sku_price": 40.0, "original_total_amount": 120.0, "final_total_amount": 100.0}

    def batch(*ids):
        return schemas.conform(rows([(1, i) for i in ids], "order_id bigint, order_detail_id bigint").select(
            "*", *[F.lit(v).alias(k) for k, v in base.items()]), schemas.ORDER_WIDE)

    jobs.wide_batch(wh, batch(1, 2), 0)
    for _ in range(2):
        jobs.wide_batch(wh, batch(3, 2), 1)
    got = {r.order_detail_id: round(r.final_detail_amount * 100) for r in jobs.wide_rows(wh).collect()}
    assert got == {1: 3333, 2: 3333, 3: 3334}


def parts(frame, path, n, by):
    """The frame as n files, one per micro-batch."""
    for i in range(n):
        frame.filter(F.pmod(F.col(by), F.lit(n)) == i).coalesce(1).write.mode("append").parquet(path)
    return frame.sparkSession.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_stream_dau_over_micro_batches(spark, tables):
    starts = tables.startups.withColumn("third", F.floor((F.col("ts") - F.lit(1704067200000)) / (10 * 24 * HOUR)))
    stream = parts(starts, run_dir(spark, "dau"), 3, "third").drop("third")
    got = stream_queries.finished(state.stream_dau(stream).select("dt", "mid"), "dau-out")
    want = active.dau_dedup(tables.startups).select("dt", "mid")
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_warehouse_in_several_batches(spark, tables):
    """All jobs, the facts in three parts, against the batch operators on the same change log."""
    wh = jobs.Warehouse(spark, run_dir(spark, f"all-{uuid.uuid4().hex[:4]}"), available_now=True, write_tasks=8)
    stream_queries.run_all(tables, wh, batches=3)
    kept = F.col("id") % 10 >= 4
    placed = orders.first_order_flag(tables.order_info.filter(kept))
    lines = tables.order_detail.join(placed.select(F.col("id").alias("order_id")), "order_id", "left_semi")
    rows = jobs.wide_rows(wh)
    assert rows.count() == lines.count()
    per_order = rows.groupBy("order_id").agg(
        F.round(F.sum("final_detail_amount"), 2).alias("got"), F.max("final_total_amount").alias("want"))
    assert per_order.filter("got <> want").count() == 0
    assert rows.filter("sku_name IS NULL OR tm_name IS NULL OR user_gender IS NULL OR province_name IS NULL").count() == 0
    firsts = jobs.order_docs(wh).groupBy("user_id").agg(F.sum(F.col("if_first_order").cast("int")).alias("n"))
    assert {r.n for r in firsts.collect()} == {1}
    sums = wide.order_sums(rows)
    state_sums = storage.read_batches(spark, wh.folder("state", "order_sums"), storage.monthly(jobs.ORDER_SUMS)).groupBy("order_id", "dt").agg(
        F.sum("gross").alias("gross"), F.sum("share").alias("share"))
    assert sums.exceptAll(state_sums).count() == 0


def test_a_batch_of_a_stream_writes_few_files_a_folder(spark, tmp_path):
    """The batches of a stream run without adaptive execution; their tasks do not all write into all folders."""
    before = {c: spark.conf.get(c) for c in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    rows = spark.range(6400).select((F.col("id") % 2).cast("string").alias("month"), F.col("id").cast("string").alias("value")).repartition(64)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        storage.write_batch(rows, str(tmp_path / "table"), 3, ("month",))
        topics.write_topic(rows.withColumnRenamed("month", "topic"), str(tmp_path / "topics"), 3)
        storage.archive_raw(rows.withColumnRenamed("month", "dt"), str(tmp_path / "archive"), 3)
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    for place, read in (("table", spark.read.parquet), ("topics", spark.read.parquet), ("archive/batch_id=3", spark.read.text)):
        got = read(str(tmp_path / place))
        assert len(got.inputFiles()) <= 2 * storage.SPREAD, place
        assert got.select("value").distinct().count() == 6400


def test_a_join_of_streams_keeps_one_store_a_partition(spark, tmp_path):
    from retailflow.streaming import state

    at = F.timestamp_seconds(F.col("id") + 1704067200)
    spark.range(100).select("id", at.alias("order_time")).write.parquet(str(tmp_path / "orders"))
    spark.range(100).select("id", F.col("id").alias("order_id"), at.alias("detail_time")).write.parquet(str(tmp_path / "details"))
    placed = spark.readStream.schema("id long, order_time timestamp").parquet(str(tmp_path / "orders"))
    lines = spark.readStream.schema("id long, order_id long, detail_time timestamp").parquet(str(tmp_path / "details"))
    pairs = state.stream_order_detail_join(placed, lines).select("d.order_id")
    writer = pairs.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c"))
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 100
    joins = [s for p in query.recentProgress for s in p["stateOperators"] if s["operatorName"] == "symmetricHashJoin"]
    assert joins and all(s["numStateStoreInstances"] == s["numShufflePartitions"] for s in joins)


def test_handlers_of_a_stream_run_adaptively_and_its_state_in_few_partitions(spark, rows, wh, tmp_path):
    before, seen, names = spark.conf.get("spark.sql.shuffle.partitions"), [], ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")
    spark.range(100).select(F.timestamp_seconds(F.col("id") + 1704067200).alias("at"), "id").write.parquet(str(tmp_path / "in"))
    once = spark.readStream.schema("at timestamp, id long").parquet(str(tmp_path / "in")).withWatermark("at", "1 hour").dropDuplicatesWithinWatermark(["id"])

    def handle(batch, n):
        seen.append(([batch.sparkSession.conf.get(c) for c in names], batch.count(), batch.count()))

    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        wh.launch(once, "adaptive", handle, held=True).awaitTermination()
        assert spark.conf.get("spark.sql.shuffle.partitions") == "64"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert seen == [(["true", "64"], 100, 100)]
    offsets = spark.read.text(f"{wh.folder('checkpoint', 'adaptive')}/offsets/0").filter("value LIKE '{%'").first()[0]
    assert int(json.loads(offsets)["conf"]["spark.sql.shuffle.partitions"]) == 2 * spark.sparkContext.defaultParallelism


def test_held_rows_are_worked_out_once_whatever_is_written(spark, tmp_path):
    place = str(tmp_path / "table")
    storage.write_batch(spark.range(10), place, 0)
    drawn = storage.read_batches(spark, place, spark.range(1).schema).withColumn("drawn", F.expr("uuid()"))
    with storage.held(drawn, str(tmp_path)) as kept:
        first = {r.id: r.drawn for r in kept.collect()}
        storage.write_batch(kept.select("id"), place, 1)
        assert {r.id: r.drawn for r in kept.collect()} == first and len(first) == 10
    assert not list((tmp_path / "held").iterdir())


def test_routers_neither_keep_nor_shuffle_the_texts(spark, rows, wh, monkeypatch):
    kept, write = [], topics.write_topic

    def written(messages, *others, **named):
        kept.append(spark._jsc.sc().getPersistentRDDs().size())
        assert "Exchange" not in messages._jdf.queryExecution().executedPlan().toString()
        write(messages, *others, **named)

    def shuffled(*_):
        raise AssertionError("messages are brought together by topic")

    monkeypatch.setattr(topics, "write_topic", written)
    monkeypatch.setattr(topics, "together", shuffled)
    before = spark._jsc.sc().getPersistentRDDs().size()
    change = json.dumps({"table": "user_info", "type": "insert", "data": {"id": "7"}})
    changes = rows([(0, change), (1, '{"table": ')], "seq long, value string")
    logs = rows([(0, json.dumps({"start": {"entry": "a"}, "ts": DAY})), (1, json.dumps({"action": {}, "ts": DAY}))], "seq long, value string")
    jobs.split_changes(wh, parts(changes, f"{wh.root}/in/changes", 1, "seq")).awaitTermination()
    query = jobs.split_logs(wh, parts(logs, f"{wh.root}/in/logs", 1, "seq"))
    query.awaitTermination()
    assert kept == [before, before]
    assert {(r.topic, r.seq) for r in spark.read.parquet(wh.topics).collect()} == {("ODS_USER_INFO", 0), (routing.STARTUP_TOPIC, 0), (routing.EVENT_TOPIC, 1)}
    assert spark.read.parquet(wh.folder("quarantine", "split_changes")).count() == 1
    assert sorted(r.value for r in spark.read.text(wh.folder("archive", "applog")).collect()) == sorted(r.value for r in logs.collect())
    assert [p["observedMetrics"]["logs"].rows for p in query.recentProgress if p["numInputRows"]] == [2]


def test_a_wide_batch_keeps_no_rows_in_memory(spark, tables, tmp_path, monkeypatch):
    """A write drops cached rows that were read from the same table: they would be worked out twice."""
    kept, append = [], storage.append_olap

    def seen(frame, *others):
        kept.append(spark._jsc.sc().getPersistentRDDs().size())
        append(frame, *others)
        kept.append(spark._jsc.sc().getPersistentRDDs().size())

    monkeypatch.setattr(storage, "append_olap", seen)
    wh, before = jobs.Warehouse(spark, str(tmp_path)), spark._jsc.sc().getPersistentRDDs().size()
    rows = stream_queries.line_thirds(tables).filter("order_id < 100")
    for n in range(2):
        jobs.wide_batch(wh, rows.filter(F.col("third") == n + 1).drop("third"), n)
    assert kept == [before] * 4
    stored = storage.read_batches(spark, wh.folder("state", "order_sums"), storage.monthly(jobs.ORDER_SUMS))
    sums = stored.groupBy("order_id").agg(F.sum("gross").alias("gross"), F.sum("share").alias("share"))
    want = wide.order_sums(jobs.wide_rows(wh)).select("order_id", "gross", "share")
    assert sums.exceptAll(want).count() == 0 and want.exceptAll(sums).count() == 0
