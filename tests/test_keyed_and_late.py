"""Keyed state processors, late partners, corrected flags, lookups of sorted tables, report deltas, the store's key."""

import shutil

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F
from test_analytics import scanned_rows

from retailflow import schemas
from retailflow.operators import orders, reports, routing
from retailflow.plans import warehouse
from retailflow.plans.stream_queries import order_messages, to_topic
from retailflow.sources import storage, topics
from retailflow.sources.tables import Tables
from retailflow.streaming import jobs, keyed

HOUR = 3_600_000
START = 1_704_067_200_000


def streamed(spark, frames, path, build):
    """Runs a query once for each frame that comes, each time from its checkpoint."""
    out = []
    for frame in frames:
        frame.write.mode("append").parquet(f"{path}/in")
        rows = build(spark.readStream.schema(frame.schema).parquet(f"{path}/in"))
        writer = rows.writeStream.outputMode("append" if build is not first_orders else "update").option("checkpointLocation", f"{path}/checkpoint")
        writer.foreachBatch(lambda batch, n: out.extend(map(tuple, batch.collect()))).trigger(availableNow=True).start().awaitTermination()
    return out


# -- expiry after the last touch ----------------------------------------------------------------


def touched(rows, hours):
    return rows([(m, START + int(h * HOUR)) for m, h in hours], "mid string, ts bigint")


def test_a_device_is_forgotten_a_day_after_its_last_touch(spark, rows, tmp_path):
    batches = [
        [("a", 0), ("a", 23), ("b", 5), ("c", 5), ("c", 29.5), ("c", 5)],  # c: two spans in one batch
        [("a", 46.9), ("b", 29)],  # a: renewed; b: exactly a day later
        [("a", 60), ("a", 70.9), ("c", 50)],
        [("a", 95), ("d", 96)],
    ]
    got = streamed(spark, [touched(rows, b) for b in batches], tmp_path, keyed.stream_active)
    hours = sorted((m, (ts - START) / HOUR) for m, ts in got)
    assert hours == [("a", 0), ("a", 95), ("b", 5), ("b", 29), ("c", 5), ("c", 29.5), ("d", 96)]


def test_state_of_silent_devices_goes(spark, rows, tmp_path):
    frames = [touched(rows, [("a", 0), ("b", 0)]), touched(rows, [("b", 200)]), touched(rows, [("b", 201)])]
    streamed(spark, frames, tmp_path, keyed.stream_active)
    left = keyed.read_state(spark, f"{tmp_path}/checkpoint", "last").select("key.mid").collect()
    assert [r.mid for r in left] == ["b"]


# -- state from a table -------------------------------------------------------------------------


STATE = "user_id string, order_id bigint, create_time string"
PLACED = "user_id bigint, create_time string, id bigint"


def first_orders(placed):
    return keyed.stream_first_orders(placed, placed.sparkSession.createDataFrame([("1", None, None), ("2", 50, "2020-01-05"), ("x", None, None)], STATE))


def test_first_orders_start_from_a_table_and_go_on_after_a_restart(spark, rows, tmp_path):
    frames = [
        rows([(1, "2020-01-01", 7), (2, "2020-01-06", 60), (3, "2020-01-03", 9), (3, "2020-01-03", 8)], PLACED),
        rows([(2, "2020-01-04", 40), (3, "2020-01-09", 1)], PLACED),
        rows([(2, "2020-01-04", 41), (3, "2020-01-02", 99), (4, "2020-01-01", 5)], PLACED),
    ]
    got = streamed(spark, frames, tmp_path, first_orders)
    assert got == [(3, "2020-01-03", 8), (2, "2020-01-04", 40)] + sorted(got[2:]) and sorted(got[2:]) == [(3, "2020-01-02", 99), (4, "2020-01-01", 5)]
    state = {r.key.user_id: (r.value.known, r.value.id) for r in keyed.read_state(spark, f"{tmp_path}/checkpoint", "first").collect()}
    assert state == {1: (True, None), 2: (False, 40), 3: (False, 99), 4: (False, 5), None: (True, None)}
    before = {r.key.user_id: r.value.id for r in keyed.read_state(spark, f"{tmp_path}/checkpoint", "first", batch_id=0).collect()}
    assert before[2] == 50 and before[3] == 8


def test_first_orders_kept_by_blocks_are_those_kept_by_user(spark, rows, tmp_path):
    great = 2**60
    frames = [
        rows([(1, "2020-01-01", 7), (2, "2020-01-06", great), (2, "2020-01-06", great + 1), (3, "2020-01-03", 9), (None, None, 4), (5, None, None)], PLACED),
        rows([(2, "2020-01-04", 40), (3, "2020-01-03", 8), (great + 1, "2020-01-01", great + 3), (1, "2019-01-01", 1)], PLACED),
    ]
    start = rows([("1", None, None), ("2", great + 5, "2020-01-06"), (str(great), None, None), ("1", 6, "2018-01-01")], STATE)
    kept = {}
    for blocks in (None, 2):
        path = tmp_path / str(blocks)
        out = []
        for n, frame in enumerate(frames):
            frame.write.mode("append").parquet(f"{path}/in")
            stream = keyed.stream_first_orders(spark.readStream.schema(frame.schema).parquet(f"{path}/in"), start.coalesce(1), blocks)
            writer = stream.writeStream.outputMode("update").option("checkpointLocation", f"{path}/checkpoint")
            writer.foreachBatch(lambda batch, _, n=n: out.extend((n, *r) for r in batch.collect())).trigger(availableNow=True).start().awaitTermination()
        if blocks:
            state = keyed.read_first_orders(spark, f"{path}/checkpoint")
            assert keyed.read_state(spark, f"{path}/checkpoint", "first").count() == 2  # one state a block, not one a user
        else:
            state = keyed.read_state(spark, f"{path}/checkpoint", "first").select("key.user_id", "value.*")
        kept[blocks] = sorted(out, key=repr), sorted(map(tuple, state.select("user_id", "known", "create_time", "id").collect()), key=repr)
    assert kept[2] == kept[None]
    assert (0, 2, "2020-01-06", great) in kept[2][0] and (great, True, None, None) in kept[2][1] and (1, True, None, None) in kept[2][1]


# -- corrected flags ----------------------------------------------------------------------------


def test_an_earlier_order_takes_the_flag(rows):
    placed = rows([(10, 1, "2020-01-02 00:00:00"), (11, 1, "2020-01-03 00:00:00"), (12, 2, "2020-01-01 00:00:00"), (13, 3, "2020-01-05 00:00:00"), (14, 4, "2020-01-01 00:00:00")],
                  "id bigint, user_id bigint, create_time string")
    state = rows([("1", "1", 20, "2020-01-09 00:00:00"), ("1", "1", 21, "2020-01-04 00:00:00"), ("2", "1", None, None), ("3", "1", 5, "2020-01-04 00:00:00")],
                 "user_id string, if_consumed string, order_id bigint, create_time string")
    flagged, lost = orders.flags_and_corrections(placed, state)
    assert {r.id: r.if_first_order for r in flagged.collect()} == {10: "1", 11: "0", 12: "0", 13: "0", 14: "1"}
    assert [tuple(r) for r in lost.collect()] == [(21, "2020-01-04 00:00:00")]


def test_orders_pass_as_bootstrap_rows_only_when_asked(rows):
    envelope = '{"table": "order_info", "type": "%s", "data": {"id": %d}}'
    changes = rows([(1, envelope % ("insert", 1)), (2, envelope % ("bootstrap-insert", 2)), (3, envelope % ("update", 3)), (4, '{"table": "order_info", "data": {"id": 4}}')], "seq bigint, value string")
    kinds = ("insert", "bootstrap-insert")
    assert [r.seq for r in routing.cdc_filter_route(changes).collect()] == [1]
    assert [r.seq for r in routing.cdc_filter_route(changes, order_kinds=kinds).collect()] == [1, 2]


# -- late partners ------------------------------------------------------------------------------


ORDER = {"id": 1, "user_id": 5, "create_time": "2020-03-04 10:00:00", "create_date": "2020-03-04", "final_total_amount": 9.0, "original_total_amount": 10.0, "if_first_order": "1"}


def put(spark, wh, n, hours, order=None, lines=()):
    at = F.timestamp_seconds(F.lit(1_704_067_200 + int(hours * 3600)))
    if order:
        frame = schemas.conform(spark.createDataFrame([order]), schemas.ORDER_INFO)
        to_topic(order_messages(frame).withColumn("arrived", at), wh, jobs.DWD_ORDER_INFO, n)
    if lines:
        data = [{"id": i, "order_id": o, "sku_id": 7, "order_price": 5.0, "sku_num": 1} for i, o in lines]
        frame = schemas.conform(spark.createDataFrame(data), schemas.ORDER_DETAIL)
        to_topic(order_messages(frame).withColumn("arrived", at), wh, jobs.DWD_ORDER_DETAIL, n)


def test_lines_wait_for_their_order_and_are_joined_once(spark, tmp_path):
    wh = jobs.Warehouse(spark, str(tmp_path), available_now=True, fold_every=2)
    run = lambda: jobs.order_wide(wh).awaitTermination()
    other = ORDER | {"id": 99, "user_id": 6}
    put(spark, wh, 0, 0, other, [(1, 1), (2, 1), (3, 2)])  # lines of orders 1 and 2, which have not come
    run()
    put(spark, wh, 1, 5, other, [(9, 99)])
    run()
    assert sorted((r.order_id, r.id) for r in jobs.waiting_lines(wh).collect()) == [(1, 1), (1, 2), (2, 3)]
    put(spark, wh, 2, 24, ORDER, [(9, 99)])
    put(spark, wh, 3, 26, other, [(9, 99)])
    run()
    put(spark, wh, 4, 48, other, [(4, 1)])  # a line long after its order
    put(spark, wh, 5, 50, other, [(9, 99)])
    run()
    jobs.late_fold(wh)
    assert sorted((r.order_id, r.id) for r in jobs.waiting_lines(wh).collect()) == [(2, 3)]
    wide = sorted((r.order_id, r.order_detail_id, r.if_first_order) for r in jobs.wide_rows(wh).collect())
    assert [w for w in wide if w[0] == 1] == [(1, 1, "1"), (1, 2, "1"), (1, 4, "1")]
    assert [w for w in wide if w[0] == 99] == [(99, 9, "1")]
    # The order comes again without its flag: its rows change.
    put(spark, wh, 6, 72, ORDER | {"if_first_order": "0"}, [(9, 99)])
    run()
    assert {r.if_first_order for r in jobs.wide_rows(wh).where("order_id = 1").collect()} == {"0"}


def test_a_batch_of_late_pairs_run_twice_gives_the_same(spark, rows, tmp_path):
    wh = jobs.Warehouse(spark, str(tmp_path), available_now=True)
    line = '{"id": 1, "order_id": 1, "sku_id": 7, "order_price": 5.0, "sku_num": 1}'
    storage.write_batch(rows([(line,)], "_unmatched string"), wh.folder("unmatched", "order_wide"), 0)
    placed = schemas.conform(spark.createDataFrame([ORDER]), schemas.ORDER_INFO).withColumn("arrived", F.current_timestamp())
    none = spark.createDataFrame([], schemas.ORDER_DETAIL)
    for _ in range(2):
        late = jobs.late_pairs(wh, placed, none, 1)
        assert [(r.order_id, r.order_detail_id) for r in late.collect()] == [(1, 1)]
        storage.write_batch(late.select("order_id", F.col("order_detail_id").alias("id")), wh.folder("state", "wide_met"), 1)
        assert jobs.waiting_lines(wh).count() == 0
    assert jobs.late_pairs(wh, placed, none, 2).count() == 0


# -- lookups of sorted tables -------------------------------------------------------------------


@pytest.mark.parametrize("named", [1000, 1])
def test_a_lookup_reads_few_rows_of_a_sorted_table(spark, rows, tmp_path, monkeypatch, named):
    monkeypatch.setattr(storage, "ROW_GROUP", 32 << 10)
    schema = schemas._schema("id string, text string")
    table = spark.range(200_000).select(F.lpad(F.col("id").cast("string"), 8, "0").alias("id"), F.sha2(F.col("id").cast("string"), 256).alias("text"))
    storage.write_sorted(table, str(tmp_path / "t"))
    monkeypatch.setattr(storage, "NAMED_IDS", named)
    ids = rows([("00000042",), ("00150000",), ("nothing",), (None,), ("00000042",)], "k string")
    found = storage.lookup_sorted(spark, str(tmp_path / "t"), schema, ids, "k")
    assert sorted(r.id for r in found.collect()) == ["00000042", "00150000"]
    if named > 1:
        assert scanned_rows(storage.lookup_sorted(spark, str(tmp_path / "t"), schema, ids, "k")) < 200_000 / 4


# -- reports by deltas --------------------------------------------------------------------------


def test_contributions_of_replaced_batches_are_taken_back(spark, rows, tmp_path):
    path = str(tmp_path / "r")
    sale = lambda *data: rows([("2020-01-01", p, "a", "g", s, n) for p, s, n in data], "dt string, province_name string, user_age_group string, user_gender string, sku_name string, sku_num bigint")
    reports.keep(sale(("P", "x", 1), ("P", "x", 2), (None, "y", 4)), path, 0)
    reports.keep(sale(("P", "x", 100)), path, 1)
    reports.keep(sale(("Q", "y", 5)), path, 1)  # the batch once more, with other rows
    bars = lambda: {r.name: r.num for r in reports.name_num_bars(reports.kept(spark, path)).collect()}
    assert bars() == {"x": 3, "y": 9}
    reports.fold(spark, path)
    reports.keep(sale(("Q", "y", 1)), path, 2)
    assert bars() == {"x": 3, "y": 10}
    share = {r.name: (r.value, r.share) for r in reports.shares(reports.kept(spark, path), "user_gender").collect()}
    assert share == {"g": (5, 1.0)}
    assert reports.kept(spark, path, "2020-01-02").count() == 0


# -- the stored wide table ----------------------------------------------------------------------


def test_the_stored_wide_table_follows_its_sources(spark, tmp_path):
    folder = tmp_path / "sf"
    shutil.copytree("/root/testdata/sf0.001", folder)
    before = warehouse.stored_wide(Tables(spark, str(folder))).count()
    assert warehouse.stored_wide(Tables(spark, str(folder))).count() == before
    lines = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").limit(1000)
    (folder / "lineitem.parquet").unlink()
    lines.write.parquet(str(folder / "lineitem.parquet"))
    assert warehouse.stored_wide(Tables(spark, str(folder))).count() == 1000 < before


def test_topics_keep_the_time_they_are_given(spark, rows, tmp_path):
    at = F.timestamp_seconds(F.lit(1_000_000))
    topics.write_topic(rows([("t", "v")], "topic string, value string").withColumn("arrived", at), str(tmp_path), 0)
    assert topics.read_topic(spark, str(tmp_path), "t").select(F.unix_seconds("arrived")).first()[0] == 1_000_000


class Kept:
    """A value state in memory that counts the calls to it."""

    def __init__(self):
        self.value, self.calls = None, 0

    def get(self):
        self.calls += 1
        return self.value

    def exists(self):
        self.calls += 1
        return self.value is not None

    def update(self, value):
        self.calls += 1
        self.value = value


def test_a_users_orders_of_a_batch_cost_two_calls_to_the_state_at_most():
    processor, state = keyed.FirstOrder(), Kept()
    processor.first = state
    order = lambda time, number: Row(create_time=time, id=number)
    out = lambda orders: [tuple(r) for r in processor.handleInputRows((7,), iter(orders), None)]
    assert out([order("b", 2), order("a", 9), order("a", 3), order(None, 1)]) == [(7, "a", 3)] and state.calls == 2
    assert out([order("a", 4)]) == [] and out([order("a", 2)]) == [(7, "a", 2)] and state.calls == 5
    processor.handleInitialState((7,), Row(order_id=1, create_time="0"), None)  # an earlier row of the table stays
    assert state.value == (False, "a", 2)
