"""The warehouse as micro-batch jobs over one shared folder.

Every job applies the same functions as the batch plans to one micro-batch and writes under the
batch's number, so a batch that is run again replaces what it wrote before. What a job reads as
its own state is limited to earlier batches, so the second run sees what the first one saw.
Dimensions are read anew in every batch. Every `fold_every` batches a job folds its tables.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from retailflow import schemas
from retailflow.operators import active, dimensions, orders, reports, routing, wide
from retailflow.session import setting, stateful_start
from retailflow.sources import storage, topics
from retailflow.streaming import state

# The length of a micro-batch and the topics of the detail layer.
INTERVAL = "5 seconds"
DWD_ORDER_INFO = "DWD_ORDER_INFO"
DWD_ORDER_DETAIL = "DWD_ORDER_DETAIL"

DIMENSIONS = {
    "base_province": (schemas.PROVINCE, "id"),
    "user_info": (schemas.USER_INFO, "id"),
    "base_category3": (schemas.CATEGORY3, "id"),
    "base_trademark": (schemas.TRADEMARK, "tm_id"),
    "spu_info": (schemas.SPU_INFO, "id"),
    "sku_info": (schemas.SKU_INFO, "id"),
}

# Up to this many ids of a micro-batch are broadcast to where a large dimension or state table lies
# (20 MB of numbers as text); beyond, both sides are shuffled.
BROADCAST_IDS = 1_000_000

ORDER_SUMS = T.StructType(
    [
        T.StructField("order_id", T.LongType()),
        T.StructField("dt", T.StringType()),
        T.StructField("gross", T.LongType()),
        T.StructField("share", T.LongType()),
    ]
)


@dataclass
class Warehouse:
    """Where everything lies below one folder that all executors see. `write_tasks` is for loads
    of many days at once, which fill many daily folders per batch."""

    spark: SparkSession
    root: str
    available_now: bool = False
    files_per_trigger: int | None = None
    write_tasks: int | None = None
    fold_every: int = 720  # an hour of micro-batches
    reports: bool = False  # whether the wide job keeps the reports as well

    @property
    def topics(self) -> str:
        return f"{self.root}/topics"

    @property
    def order_wide(self) -> str:
        return f"{self.root}/olap/order_wide"

    def folder(self, kind: str, name: str) -> str:
        return f"{self.root}/{kind}/{name}"

    def stream(self, topic: str) -> DataFrame:
        return topics.stream_topic(self.spark, self.topics, topic, self.files_per_trigger)

    def dim(self, table: str) -> DataFrame:
        """All current rows of a dimension."""
        schema, key = DIMENSIONS[table]
        return storage.read_dim(self.spark, self.folder("dim", table), schema, key)

    def dim_of(self, table: str, batch: DataFrame, id_column: str) -> DataFrame:
        """The current rows of a large dimension that this batch refers to."""
        schema, key = DIMENSIONS[table]
        return storage.read_dim(
            self.spark, self.folder("dim", table), schema, key,
            only=lambda rows: dimensions.dim_lookup_in(rows, batch, key, id_column, BROADCAST_IDS),
        )

    def launch(
        self, rows: DataFrame, job: str, handle: Callable[[DataFrame, int], None], reused: bool = True,
        fold: Callable[[int], None] | None = None, held: bool = False,
    ) -> StreamingQuery:
        """Starts a job. `reused`: the handler looks at its batch more than once. Empty batches are then passed over, and
        its source is read for each look; with `held` the batch lies in files for its time, so that a stateful operator is not
        run twice. `fold` folds the job's tables up to a batch; it is called ahead of a batch with the number of the one
        before, which is committed.

        Streams run without adaptive execution, for the sake of their state. What the handler makes of a batch has none and
        runs with it: its shuffles take as many tasks as their data need, not as many as the session allows."""
        partitions = self.spark.conf.get("spark.sql.shuffle.partitions")

        def adaptive(batch: DataFrame, n: int) -> None:
            spark = batch.sparkSession
            with setting(spark, "spark.sql.adaptive.enabled", "true"), setting(spark, "spark.sql.shuffle.partitions", partitions):
                keep(batch, n) if reused else handle(batch, n)

        def keep(batch: DataFrame, n: int) -> None:
            if fold is not None and n and n % self.fold_every == 0:
                fold(n - 1)
            if not held:
                if not batch.isEmpty():
                    handle(batch, n)
                return
            with storage.held(batch, self.root) as kept:
                if not kept.isEmpty():
                    handle(kept, n)

        writer = rows.writeStream.queryName(job).foreachBatch(adaptive).option("checkpointLocation", self.folder("checkpoint", job))
        with stateful_start(self.spark):
            if self.available_now:
                return writer.trigger(availableNow=True).start()
            return writer.trigger(processingTime=INTERVAL).start()

    def good(self, batch: DataFrame, schema: T.StructType, job: str, n: int) -> DataFrame:
        """The batch's decoded rows; what cannot be decoded goes to the job's quarantine folder."""
        decoded = schemas.decode(batch.select("seq", "value"), schema)
        good, bad = schemas.split_corrupt(decoded)
        storage.write_batch(bad.select("_corrupt_record"), self.folder("quarantine", job), n)
        return good


def counted(rows: DataFrame, name: str) -> DataFrame:
    """Row count of every micro-batch in the query's progress, without a job of its own."""
    return rows.observe(name, F.count(F.lit(1)).alias("rows"))


# -- routing ------------------------------------------------------------------------------------


def split_logs_batch(wh: Warehouse, batch: DataFrame, n: int) -> None:
    topics.write_topic(routing.route_log(batch), wh.topics, n, "split_logs", as_dealt=True)
    # Every line is in one of the two topics: read from there, the batch is gone through and counted once.
    lines = topics.read_batch(batch.sparkSession, wh.topics, [routing.STARTUP_TOPIC, routing.EVENT_TOPIC], n, "split_logs")
    ms = F.get_json_object("value", "$.ts").cast("bigint")
    storage.archive_raw(active.with_day_hour(lines.withColumn("ts", ms)), wh.folder("archive", "applog"), n)


def split_logs(wh: Warehouse, logs: DataFrame) -> StreamingQuery:
    """Log lines (seq, value) to the archive and the two log topics."""
    return wh.launch(counted(logs, "logs"), "split_logs", lambda batch, n: split_logs_batch(wh, batch, n), reused=False)


def split_changes(wh: Warehouse, changes: DataFrame, arrays: bool = False) -> StreamingQuery:
    """Database changes (seq, value) to one topic per table; what is no change goes to quarantine."""
    route = routing.cdc_array_flatten if arrays else routing.cdc_filter_route
    job = "split_changes_arrays" if arrays else "split_changes"

    def handle(batch: DataFrame, n: int) -> None:
        key = F.get_json_object("value", "$.id")
        topics.write_topic(route(batch).withColumn("key", key), wh.topics, n, job, as_dealt=True)
        bad = routing.malformed(batch, arrays=arrays).select(F.col("value").alias("_corrupt_record"))
        storage.write_batch(bad, wh.folder("quarantine", job), n)

    return wh.launch(changes, job, handle)


# -- daily actives ------------------------------------------------------------------------------


def dau_batch(wh: Warehouse, batch: DataFrame, n: int) -> None:
    """Devices not yet in their day's index. The index itself is the set of devices seen, so a
    late startup is checked like any other and nothing expires. Only the days of this batch are
    read from it."""
    rows = active.dau_project(active.with_day_hour(wh.good(batch, schemas.STARTUP_LOG, "dau", n)))
    rows = rows.select(*schemas.DAU_INFO.fieldNames(), "seq")
    path = wh.folder("docs", "dau_info")
    seen = storage.read_days(wh.spark, path, schemas.DAU_INFO, rows, "dt", before=n)
    fresh = active.unseen(rows, seen, ["dt", "mid"], ["ts", "seq"]).drop("seq")
    storage.upsert_docs(fresh, path, n)


def dau(wh: Warehouse) -> StreamingQuery:
    fold = lambda n: storage.fold_docs(wh.spark, wh.folder("docs", "dau_info"), schemas.DAU_INFO, "mid", upto=n)
    return wh.launch(wh.stream(routing.STARTUP_TOPIC), "dau", lambda batch, n: dau_batch(wh, batch, n), fold=fold)


def dau_with_expiry(wh: Warehouse, ttl: str = "24 hours") -> StreamingQuery:
    """The same with the devices in the state store, forgotten `ttl` after their time."""
    startups = schemas.decode(wh.stream(routing.STARTUP_TOPIC).select("seq", "value"), schemas.STARTUP_LOG)
    fresh = state.stream_dau(schemas.split_corrupt(startups)[0], ttl)

    def handle(batch: DataFrame, n: int) -> None:
        storage.upsert_docs(batch.select(*schemas.DAU_INFO.fieldNames()), wh.folder("docs", "dau_info"), n)

    return wh.launch(fresh, "dau_with_expiry", handle, reused=False)


def dau_docs(wh: Warehouse) -> DataFrame:
    return storage.read_docs(wh.spark, wh.folder("docs", "dau_info"), schemas.DAU_INFO, "mid")


# -- dimensions ---------------------------------------------------------------------------------


def dim_batch(wh: Warehouse, table: str, batch: DataFrame, n: int, as_of: Column | str) -> None:
    schema, key = DIMENSIONS[table]
    rows = wh.good(batch, schema, f"dim_{table}", n)
    if table == "user_info":
        rows = dimensions.user_dim(rows, as_of)
    if table == "sku_info":
        rows = rows.drop("category3_name", "spu_name", "tm_name")
        rows = dimensions.sku_dims(rows, wh.dim("base_category3"), wh.dim("base_trademark"), wh.dim("spu_info"))
    storage.upsert_dim(
        rows.select(*schema.fieldNames(), "seq"), wh.folder("dim", table), n, key
    )


def dim(wh: Warehouse, table: str, as_of: Column | str | None = None) -> StreamingQuery:
    """Keeps one dimension current from its topic. Ages count up to `as_of`, by default the day
    of processing."""
    day = F.current_date() if as_of is None else as_of
    schema, key = DIMENSIONS[table]
    fold = lambda n: storage.compact_dim(wh.spark, wh.folder("dim", table), schema, key, n)
    handle = lambda batch, n: dim_batch(wh, table, batch, n, day)
    return wh.launch(wh.stream(f"ODS_{table.upper()}"), f"dim_{table}", handle, fold=fold)


# -- detail layer -------------------------------------------------------------------------------


def order_batch(wh: Warehouse, batch: DataFrame, n: int) -> None:
    """One enriched batch to three places: user state, order documents, detail-layer topic."""
    state_path = wh.folder("state", "user_state")
    plain = orders.with_create_day_hour(wh.good(batch, schemas.ORDER_INFO, "order_info", n))
    before = storage.read_batches(wh.spark, state_path, schemas.USER_STATE, before=n)
    before = dimensions.dim_lookup_in(before, plain, "user_id", "user_id", BROADCAST_IDS)
    flagged, lost = orders.flags_and_corrections(plain, before)
    users = wh.dim_of("user_info", plain, "user_id")
    rows = dimensions.order_user(dimensions.order_province(flagged, wh.dim("base_province")), users)
    with storage.held(rows, wh.root) as placed:
        storage.write_batch(orders.new_consumers(placed), state_path, n)
        corrected = corrected_orders(wh, lost, placed, n)
        docs = schemas.conform(placed, schemas.ORDER_DOCUMENT).unionByName(corrected)
        storage.upsert_docs(docs, wh.folder("docs", "order_info"), n, day="create_date", tasks=wh.write_tasks)
        message = schemas.conform(placed, schemas.ORDER_INFO).unionByName(schemas.conform(corrected, schemas.ORDER_INFO))
        topics.write_topic(_messages(message, DWD_ORDER_INFO), wh.topics, n, "order_info", as_dealt=True)


def corrected_orders(wh: Warehouse, lost: DataFrame, batch: DataFrame, n: int) -> DataFrame:
    """The documents of orders that lost the first-order flag to an earlier one, without it: they replace the documents of
    before and go out as messages once more. Orders that this batch holds itself have their flags already."""
    lost = orders.with_create_day_hour(lost).select("id", "create_date").join(batch.select("id"), "id", "left_anti").persist()
    try:
        if lost.isEmpty():
            return wh.spark.createDataFrame([], schemas.ORDER_DOCUMENT)
        stored = storage.read_days(wh.spark, wh.folder("docs", "order_info"), schemas.ORDER_DOCUMENT, lost, "create_date", before=n)
        stored = dimensions.dim_lookup_in(stored, lost, "id", "id", BROADCAST_IDS)
        newest = active.first_per_key(stored, ["create_date", "id"], [F.desc("batch_id")])
        return schemas.conform(newest.withColumn("if_first_order", F.lit("0")), schemas.ORDER_DOCUMENT)
    finally:
        lost.unpersist()


def _messages(record: DataFrame, topic: str) -> DataFrame:
    return record.select(F.lit(topic).alias("topic"), F.col("id").alias("seq"), *schemas.encode("id", record.columns))


def order_fold(wh: Warehouse, n: int | None = None) -> None:
    """User state down to one row per user, order documents to the newest per day and id."""
    storage.fold(
        wh.spark, wh.folder("state", "user_state"), schemas.USER_STATE,
        lambda rows: active.first_per_key(rows, ["user_id"], [F.asc_nulls_first("create_time"), F.asc_nulls_first("order_id")]), n)
    storage.fold_docs(wh.spark, wh.folder("docs", "order_info"), schemas.ORDER_DOCUMENT, "id", "create_date", n)


def order_info(wh: Warehouse) -> StreamingQuery:
    handle = lambda batch, n: order_batch(wh, batch, n)
    return wh.launch(wh.stream("ODS_ORDER_INFO"), "order_info", handle, fold=lambda n: order_fold(wh, n))


def detail_batch(wh: Warehouse, batch: DataFrame, n: int) -> None:
    plain = wh.good(batch, schemas.ORDER_DETAIL, "order_detail", n)
    named = schemas.conform(dimensions.detail_sku(plain, wh.dim_of("sku_info", plain, "sku_id")), schemas.ORDER_DETAIL)
    topics.write_topic(_messages(named, DWD_ORDER_DETAIL), wh.topics, n, "order_detail", as_dealt=True)


def order_detail(wh: Warehouse) -> StreamingQuery:
    return wh.launch(wh.stream("ODS_ORDER_DETAIL"), "order_detail", lambda batch, n: detail_batch(wh, batch, n))


def order_docs(wh: Warehouse) -> DataFrame:
    path = wh.folder("docs", "order_info")
    return storage.read_docs(wh.spark, path, schemas.ORDER_DOCUMENT, "id", day="create_date")


# -- wide table ---------------------------------------------------------------------------------


def wide_batch(wh: Warehouse, batch: DataFrame, n: int) -> None:
    """Splits the paid totals of the pairs of one batch and appends them. Running sums of orders
    whose lines came in several batches are kept as a table of increments. Both tables lie by the
    order's month; a batch reads the months of its orders, however long ago, and no others.

    Rows that lie by order stay where they are: seen lines and sums come to them, by order alone. Rows that
    lie otherwise are shuffled by all keys."""
    with setting(batch.sparkSession, "spark.sql.requireAllClusterKeysForCoPartition", "false"):
        _wide_batch(wh, batch, n)


def _wide_batch(wh: Warehouse, batch: DataFrame, n: int) -> None:
    sums_path = wh.folder("state", "order_sums")
    lines = ["order_id", "order_detail_id"]
    by_month, wide_schema = storage.by_month(batch), storage.monthly(schemas.ORDER_WIDE)
    months = storage.days_of(by_month, "month")

    def stored(path: str, schema: T.StructType) -> DataFrame:
        if months is None:
            return storage.read_days(wh.spark, path, schema, by_month, "month", before=n)
        return storage.read_batches(wh.spark, path, schema, n, "month", months)

    fresh = active.unseen(batch, stored(wh.order_wide, wide_schema), lines, ["create_time"])
    split = wide.pay_apportion_on(fresh, stored(sums_path, storage.monthly(ORDER_SUMS)), sizes_from=batch)
    storage.append_olap(split.select(*schemas.ORDER_WIDE.fieldNames()), wh.order_wide, n)
    # What was written is read again: a write drops cached rows of a plan that reads from the same table.
    written = storage.read_batch(batch.sparkSession, wh.order_wide, wide_schema, n, "month", months)
    storage.write_batch(storage.by_month(wide.order_sums(written)), sums_path, n, ("month",))
    if wh.reports:
        reports.keep(written.drop("month", "batch_id"), wh.folder("reports", "sales"), n)


def wide_fold(wh: Warehouse, n: int | None = None) -> None:
    """Sums down to one row per order; the wide table's batches into one."""
    def added(rows: DataFrame) -> DataFrame:
        return rows.groupBy("order_id", "dt", "month").agg(F.sum("gross").alias("gross"), F.sum("share").alias("share"), F.max("batch_id").alias("batch_id"))

    storage.fold(wh.spark, wh.folder("state", "order_sums"), storage.monthly(ORDER_SUMS), added, n, ("month",))
    storage.fold(wh.spark, wh.order_wide, storage.monthly(schemas.ORDER_WIDE), lambda rows: rows, n, ("month",))


WIDE_ORDERS = T.StructType([*schemas.ORDER_INFO.fields, T.StructField("arrived", T.TimestampType())])
LINE_IDS = T.StructType([T.StructField("order_id", T.LongType()), T.StructField("id", T.LongType())])
FLAGS = T.StructType([T.StructField("id", T.LongType()), T.StructField("if_first_order", T.StringType())])


def _newest_orders(rows: DataFrame) -> DataFrame:
    return active.first_per_key(rows, ["id"], [F.desc("batch_id"), F.desc("arrived")])


def waiting_lines(wh: Warehouse, before: int | None = None) -> DataFrame:
    """Lines without an order so far: those that no order met in time, less those that one met since."""
    texts = storage.read_batches(wh.spark, wh.folder("unmatched", "order_wide"), T.StructType([T.StructField("_unmatched", T.StringType())]), before)
    line = F.from_json("_unmatched", schemas.ORDER_DETAIL).alias("d")
    met = storage.read_batches(wh.spark, wh.folder("state", "wide_met"), LINE_IDS, before).select("order_id", "id").distinct()
    return texts.select("batch_id", "_unmatched", line).select("d.*", "batch_id", "_unmatched").join(met, ["order_id", "id"], "left_anti")


def late_pairs(wh: Warehouse, placed: DataFrame, lines: DataFrame, n: int) -> DataFrame:
    """Wide rows of the orders and lines that missed each other: lines that wait, with this batch's orders, and this batch's
    unmatched lines, with all orders so far. Each pair comes up in the batch that brings the later of the two, and
    what it reads lies before that batch or in it: a batch that is run again gives the same."""
    waiting = dimensions.dim_lookup_in(waiting_lines(wh, before=n), placed, "order_id", "id", BROADCAST_IDS)
    earlier = storage.read_batches(wh.spark, wh.folder("state", "wide_orders"), WIDE_ORDERS, before=n)
    known = dimensions.dim_lookup_in(earlier, lines, "id", "order_id", BROADCAST_IDS)
    known = _newest_orders(known.unionByName(placed.withColumn("batch_id", F.lit(n).cast("bigint"))))
    both = [wide.wide_merge(known, lines), wide.wide_merge(placed, waiting)]
    return both[0].unionByName(both[1]).dropDuplicates(["order_id", "order_detail_id"])


def changed_flags(wh: Warehouse, versions: DataFrame, placed: DataFrame, n: int) -> DataFrame:
    """(id, if_first_order) of orders that came with another flag before, in this batch or an earlier one."""
    earlier = storage.read_batches(wh.spark, wh.folder("state", "wide_orders"), WIDE_ORDERS, before=n)
    earlier = dimensions.dim_lookup_in(earlier, placed, "id", "id", BROADCAST_IDS).select("id", "if_first_order")
    before = earlier.unionByName(versions.select("id", "if_first_order")).select("id", F.col("if_first_order").alias("_before"))
    now = placed.select("id", "if_first_order")
    return now.join(before, "id").filter(~F.col("_before").eqNullSafe(F.col("if_first_order"))).select("id", "if_first_order").distinct()


def late_fold(wh: Warehouse, n: int | None = None) -> None:
    """Orders down to their newest versions, waiting lines down to those that still wait, flags to the last."""
    storage.fold(wh.spark, wh.folder("state", "wide_orders"), WIDE_ORDERS, _newest_orders, n)
    met = storage.read_batches(wh.spark, wh.folder("state", "wide_met"), LINE_IDS).select("order_id", "id").distinct()

    def waiting(rows: DataFrame) -> DataFrame:
        line = F.from_json("_unmatched", schemas.ORDER_DETAIL)
        return rows.withColumns({"order_id": line["order_id"], "id": line["id"]}).join(met, ["order_id", "id"], "left_anti").drop("order_id", "id")

    storage.fold(wh.spark, wh.folder("unmatched", "order_wide"), T.StructType([T.StructField("_unmatched", T.StringType())]), waiting, n)
    storage.fold(wh.spark, wh.folder("state", "wide_flags"), FLAGS, lambda rows: active.first_per_key(rows, ["id"], [F.desc("batch_id")]), n)


def order_wide(wh: Warehouse, tolerance: str = "10 seconds", watermark: str = "10 seconds", salts: int = state.SALTS) -> StreamingQuery:
    """Joins the order and line topics and keeps the wide table.

    An order and a line meet when they arrived within `tolerance` of each other, whatever their own
    times say. A line that no order joined by then waits among the unmatched, until its order comes or, if that was there
    before, at once (`late_pairs`). An order that comes again with another first-order flag corrects its wide rows. A
    message that cannot be decoded is kept in quarantine; the query's progress counts both (`wide`)."""

    def topic(name: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
        return schemas.split_corrupt(schemas.decode(wh.stream(name).select("value", "arrived"), schema))

    placed, bad_orders = topic(DWD_ORDER_INFO, schemas.ORDER_INFO)
    named, bad_lines = topic(DWD_ORDER_DETAIL, schemas.ORDER_DETAIL)
    met = state.stream_order_detail_join(placed, named, "arrived", "arrived", tolerance, watermark, salts, unmatched=True)
    line = F.to_json(F.struct(*[F.col(f"d.{c}") for c in schemas.ORDER_DETAIL.fieldNames()]))
    pairs = met.select(*wide.wide_columns("o", "d"), F.when(F.col("o.id").isNull(), line).alias("_unmatched"))
    bad = bad_orders.select("_corrupt_record").unionByName(bad_lines.select("_corrupt_record"))
    # The orders as they come, for lines that come too early or too late for them.
    orders_ = placed.select(F.struct(*WIDE_ORDERS.fieldNames()).alias("_order"))
    rows = pairs.unionByName(bad, allowMissingColumns=True).unionByName(orders_, allowMissingColumns=True).observe(
        "wide", F.count(F.when(F.col("_unmatched").isNotNull(), 1)).alias("unmatched"), F.count("_corrupt_record").alias("corrupt"))

    def handle(batch: DataFrame, n: int) -> None:
        for column, kind in (("_corrupt_record", "quarantine"), ("_unmatched", "unmatched")):
            storage.write_batch(batch.filter(F.col(column).isNotNull()).select(column), wh.folder(kind, "order_wide"), n)
        versions = batch.filter("_order IS NOT NULL").select("_order.*")
        placed = _newest_orders(versions.withColumn("batch_id", F.lit(n))).drop("batch_id")
        storage.write_batch(placed, wh.folder("state", "wide_orders"), n)
        placed = batch.sparkSession.read.schema(WIDE_ORDERS).parquet(f"{wh.folder('state', 'wide_orders')}/batch_id={n}")
        storage.write_batch(changed_flags(wh, versions, placed, n), wh.folder("state", "wide_flags"), n)
        unmatched = batch.filter("_unmatched IS NOT NULL").select(F.from_json("_unmatched", schemas.ORDER_DETAIL).alias("d")).select("d.*")
        with storage.held(late_pairs(wh, placed, unmatched, n), wh.root) as late:
            storage.write_batch(late.select("order_id", F.col("order_detail_id").alias("id")), wh.folder("state", "wide_met"), n)
            good = batch.filter("_corrupt_record IS NULL AND _unmatched IS NULL AND _order IS NULL")
            fields = schemas.ORDER_WIDE.fieldNames()
            wide_batch(wh, good.select(*fields).unionByName(late.select(*fields)), n)

    def fold(n: int) -> None:
        wide_fold(wh, n)
        late_fold(wh, n)
        if wh.reports:
            reports.fold(wh.spark, wh.folder("reports", "sales"), n)

    return wh.launch(rows, "order_wide", handle, fold=fold, held=True)


def wide_rows(wh: Warehouse) -> DataFrame:
    """The wide table, with the first-order flags of orders that were corrected since their lines came."""
    rows = storage.read_olap(wh.spark, wh.order_wide, schemas.ORDER_WIDE)
    changes = storage.read_batches(wh.spark, wh.folder("state", "wide_flags"), FLAGS)
    newest = active.first_per_key(changes, ["id"], [F.desc("batch_id")]).select(F.col("id").alias("_id"), F.col("if_first_order").alias("_flag"))
    flag = F.coalesce("_flag", "if_first_order").alias("if_first_order")
    return rows.join(newest, F.col("order_id") == F.col("_id"), "left").select(*[flag if c == "if_first_order" else c for c in schemas.ORDER_WIDE.fieldNames()])
