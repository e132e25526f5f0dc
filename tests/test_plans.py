"""Physical plans are the intended ones, with broadcasts of small tables switched off where the
point is what happens to large ones."""

import re

import pytest
from conftest import SF_DIR
from pyspark.sql import functions as F
from pyspark.sql import types as T

from retailflow.operators import active, orders, running, serving
from retailflow.plans import row_queries, stream_queries, table_queries, warehouse  # noqa: F401
from retailflow.plans.registry import QUERIES
from retailflow.sources import storage
from retailflow.streaming import jobs

SINKS = ("s1_", "s2_", "s4_", "s6_", "s7_", "s9_", "s11_", "s12_", "s13_", "s14_", "s15_", "t", "j6_", "a1_index", "a2_index")
BATCH = sorted(n for n in QUERIES if not n.startswith(SINKS) or n.startswith(("t2_sliding_window",)) and "stream" not in n)


def plan(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_no_cross_joins_and_no_python(spark, no_broadcast):
    for name in BATCH:
        text = plan(QUERIES[name](spark, SF_DIR))
        assert not re.search("Cartesian|NestedLoop|Python|Pandas", text), name


def test_dedup_keeps_one_row_per_key_before_the_shuffle(tables):
    text = plan(active.dau_dedup(tables.startups))
    before_shuffle = text.split("Exchange hashpartitioning")[1]
    assert "WindowGroupLimit" in before_shuffle and "Partial" in before_shuffle
    assert text.count("Exchange hashpartitioning") == 1


def test_counting_actives_reads_two_columns_and_hashes(tables):
    text = plan(serving.dau_total(tables.startups))
    assert "ReadSchema: struct<ts:timestamp_ntz,user_id:bigint>" in text
    assert "SortAggregate" not in text and "Sort " not in text


def test_one_user_loads_no_single_task(tables, no_broadcast):
    """Orders go through a shuffle by id, never by user; by user goes one row per user and task."""
    text = plan(orders.first_order_flag(tables.order_heads, tables.user_state))
    by_user = [line for line in text.split("\n") if re.search(r"Exchange hashpartitioning\((user_id|_user)", line)]
    assert len(by_user) == 2
    assert "partial_min" in text.split(by_user[0])[1].split("Exchange")[0]


def test_wide_shuffles(tables, no_broadcast):
    """Orders: once by user, once by id. The lines: once by SKU, once by order id, which serves the
    join and the window. Nothing is enriched twice."""
    text = plan(warehouse.order_wide(tables))
    lines = text.split("\n")
    top = next(i for i, line in enumerate(lines) if "Window" in line)
    join = next(i for i, line in enumerate(lines) if "SortMergeJoin" in line)
    assert not any("Exchange" in line for line in lines[top:join])
    # The order side: everything joined by id sits on one shuffle of the orders.
    order_side = [line for line in lines if re.search(r"Exchange hashpartitioning\(id#", line)]
    assert len(order_side) == 2  # orders, first-order ids
    assert "Union" not in text


def test_blocks_carry_no_broadcast_hint_and_are_even(spark, tables):
    """An id far from all others does not put the others into one block."""
    text = plan(QUERIES["w3_pay_apportion_blocks"](spark, SF_DIR))
    assert "hint" not in text.lower()
    rows = spark.range(999).select(F.lit(1).alias("k"), F.col("id").alias("o")).unionByName(
        spark.createDataFrame([(1, 10**15)], "k int, o long"))
    for limit, most in ((10, 10), (100, 220)):
        blocks = running.with_block(rows, running.block_borders(rows, "k", "o", limit), "k", "o").groupBy("_block").count()
        assert max(r["count"] for r in blocks.collect()) <= most


def test_borders_stay_on_the_executors(spark):
    rows = spark.range(999).select((F.col("id") % 100).alias("k"), F.col("id").alias("o"))
    text = running.block_borders(rows, "k", "o", 3)._jdf.queryExecution().analyzed().toString()
    assert "LogicalRDD" not in text and "LocalRelation" not in text


def test_the_wide_table_is_written_from_where_its_lines_are(spark, tables, monkeypatch):
    """After the join by order id nothing brings the wide rows together once more."""
    written = []
    monkeypatch.setattr(storage, "append_olap", lambda rows, path, batch_id, as_dealt=False: written.append(as_dealt))
    monkeypatch.setattr(storage, "read_olap", lambda *args: None)
    monkeypatch.setattr(warehouse, "_STORED", {})
    warehouse.stored_wide(tables)
    assert written == [True]


def test_rows_written_as_dealt(spark, tmp_path):
    rows = spark.range(600).select((F.col("id") % 200).cast("string").alias("n"), F.when(F.col("id") < 300, "2020-01").alias("month")).repartition(3)
    storage.write_batch(rows, str(tmp_path / "t"), 0, ("month",), as_dealt=True)
    got = spark.read.parquet(str(tmp_path / "t"))
    assert len(got.inputFiles()) == 6 and got.count() == 600 and got.where("month IS NULL").count() == 300


def test_reports_scan_the_stored_wide_table(spark, tables):
    stored = warehouse.stored_wide(tables)
    text = plan(serving.gender_share(stored))
    assert text.count("Scan parquet") == 1 and text.count("Exchange") <= 2
    assert "ReadSchema: struct<user_gender:string>" in text
    day = stored.select("dt").first().dt
    one = serving.dashboard_filter(warehouse.stored_wide(tables, day), day)
    assert plan(one).count("Scan parquet") == 1 and one.count() > 0
    assert all(f"month={day[:7]}" in name for name in one.inputFiles())


def test_day_filter_is_a_range_on_the_raw_time(tables):
    text = plan(serving.dau_total(tables.startups, "2024-01-03"))
    condition = next(line for line in text.split("\n") if "Filter" in line)
    assert ">=" in condition and "<" in condition and "date_format" not in condition


def test_page_is_a_bounded_top_k(tables):
    docs = tables.raw("part")
    text = plan(serving.page(docs, [F.desc("p_retailprice")], 40, 20))
    assert "TakeOrderedAndProject" in text and "Exchange" not in text


def test_day_of_the_index_is_a_partition_filter(spark, tables):
    from retailflow.plans.storage_queries import stored_dau

    text = plan(serving.index_total(stored_dau(tables, "plan"), "2024-01-03"))
    assert re.search(r"PartitionFilters: \[[^\]]*dt[^\]]*2024-01-03", text)


def test_wide_batches_stay_where_their_orders_lie(spark, tables, no_broadcast, tmp_path, monkeypatch):
    plans, append = [], storage.append_olap

    def seen(frame, *others):
        plans.append(plan(frame))
        append(frame, *others)

    monkeypatch.setattr(storage, "append_olap", seen)
    wh = jobs.Warehouse(spark, str(tmp_path))
    rows = stream_queries.line_thirds(tables).persist()
    for n in range(2):
        jobs.wide_batch(wh, rows.filter(F.col("third") == n + 1).drop("third"), n)
    rows.unpersist()
    by_line = re.compile(r"hashpartitioning\(order_id\S*, order_detail_id")
    assert len(plans) == 2 and not any(by_line.search(p) for p in plans)
    assert spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition") == "true"


def test_joins_with_nothing_are_planned_away(spark, no_broadcast, tmp_path):
    rows = spark.range(10).withColumnRenamed("id", "order_id")
    empty = storage.read_batches(spark, str(tmp_path / "none"), T.StructType([T.StructField("order_id", T.LongType())]))
    assert "Exchange" not in plan(rows.join(empty, "order_id", "left_anti")) and empty.count() == 0
