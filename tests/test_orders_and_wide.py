import pytest
from pyspark.sql import functions as F

from retailflow.operators import active, dimensions, orders, running, wide

ORDER = "id bigint, user_id bigint, create_time string"


def flags(frame):
    return {r.id: r.if_first_order for r in frame.select("id", "if_first_order").collect()}


def test_first_order_flag(rows):
    placed = rows(
        [
            (3, 1, "2021-02-13 10:00:00"), (1, 1, "2021-02-13 12:00:00"), (2, 1, "2021-02-13 09:00:00"),  # out of order
            (4, 2, "2021-02-13 08:00:00"),  # consumed before
            (6, 3, "2021-02-13 08:00:00"), (5, 3, "2021-02-13 08:00:00"),  # same time: lower id
        ],
        ORDER,
    )
    state = rows([("2", "1"), ("3", "0")], "user_id string, if_consumed string")
    got = flags(orders.first_order_flag(placed, state))
    assert got == {1: "0", 2: "1", 3: "0", 4: "0", 5: "1", 6: "0"}
    assert sorted(r.user_id for r in orders.new_consumers(orders.first_order_flag(placed, state)).collect()) == ["1", "3"]


def test_flag_lookup(rows):
    placed = rows([(1, 1, "t"), (2, 2, "t"), (3, 3, "t")], ORDER)
    state = rows([("1", "1"), ("2", "0")], "user_id string, if_consumed string")
    assert flags(orders.order_flag_lookup(placed, state)) == {1: "0", 2: "1", 3: "1"}


def test_lookups_keep_unmatched(rows):
    placed = rows([(1, 10, 1), (2, 11, 99)], "id bigint, user_id bigint, province_id bigint")
    province = rows([("1", "P", "010", "CN-1", "ISO-1")], "id string, name string, area_code string, iso_code string, iso_3166_2 string")
    users = rows([("10", "a", "b"), ("x", "c", "d")], "id string, age_group string, gender_name string")
    got = dimensions.order_user(dimensions.order_province(placed, province), users).orderBy("id")
    assert [(r.province_name, r.user_age_group) for r in got.collect()] == [("P", "a"), (None, None)]
    missing = got.agg(dimensions.unmatched(got, "province_name")).first()[0]
    assert missing == 1
    details = rows([(1, 5, "own"), (2, 6, None), (3, 7, None)], "id bigint, sku_id bigint, sku_name string")
    skus = rows([("5", "1", "2", "3", "s", "t", "c", "sku"), ("6", "1", "2", "3", "s", "t", "c", "sku")],
                "id string, spu_id string, tm_id string, category3_id string, spu_name string, tm_name string, category3_name string, sku_name string")
    named = dimensions.detail_sku(details, skus).orderBy("id").collect()
    assert [(r.sku_name, r.spu_id) for r in named] == [("own", 1), ("sku", 1), (None, None)]


WIDE = "order_id bigint, order_detail_id bigint, sku_num bigint, sku_price double, original_total_amount double, final_total_amount double"


def split(frame, **options):
    got = wide.pay_apportion(frame, **options).orderBy("order_id", "order_detail_id").collect()
    return [round(r.final_detail_amount * 100) for r in got]


CASES = {
    "three equal lines": ([(1, i, 1, 40.0, 120.0, 100.0) for i in (1, 2, 3)], [3333, 3333, 3334]),
    "one line": ([(1, 1, 3, 40.0, 120.0, 99.99)], [9999]),
    "line missing": ([(1, i, 1, 40.0, 120.0, 100.0) for i in (1, 2)], [3333, 3333]),
    "nothing paid": ([(1, i, 1, 40.0, 80.0, 0.0) for i in (1, 2)], [0, 0]),
    "original 0": ([(1, i, 1, 0.0, 0.0, 0.0) for i in (1, 2)], [0, 0]),
    "original 0, freight": ([(1, i, 1, 0.0, 0.0, 5.0) for i in (1, 2)], [500, 0]),
    "gift after the last line": ([(1, 1, 1, 30.0, 60.0, 50.01), (1, 2, 1, 30.0, 60.0, 50.01), (1, 3, 1, 0.0, 60.0, 50.01)],
                                 [2501, 2500, 0]),
    "gift first": ([(1, 1, 1, 0.0, 60.0, 50.0), (1, 2, 2, 30.0, 60.0, 50.0)], [0, 5000]),
    "half a cent": ([(1, 1, 1, 0.01, 0.02, 0.01), (1, 2, 1, 0.01, 0.02, 0.01)], [1, 0]),
    "paid more than the lines": ([(1, i, 1, 10.0, 20.0, 25.0) for i in (1, 2)], [1250, 1250]),
}


@pytest.mark.parametrize("hot_rows", [running.HOT_ROWS, 2, 0])
def test_pay_apportion(rows, hot_rows):
    """All cases as orders of one frame."""
    names = sorted(CASES)
    data = [(n, *line[1:]) for n, name in enumerate(names) for line in CASES[name][0]]
    got = {name: [] for name in names}
    split_rows = wide.pay_apportion(rows(data, WIDE), hot_rows=hot_rows).orderBy("order_id", "order_detail_id")
    for r in split_rows.collect():
        got[names[r.order_id]].append(round(r.final_detail_amount * 100))
    assert got == {name: CASES[name][1] for name in names}


def test_pay_apportion_close_on_final(rows):
    """By the paid total the last line is missed (and its cent lost) unless nothing was reduced."""
    data = [(1, i, 1, 40.0, 120.0, 100.0) for i in (1, 2, 3)] + [(2, i, 1, 40.0, 120.0, 120.0) for i in (1, 2, 3)]
    assert split(rows(data, WIDE), close_on="final") == [3333, 3333, 3333, 4000, 4000, 4000]


def test_pay_apportion_large_amounts(rows):
    """Totals far beyond 2**31 cents."""
    data = [(1, i, 1000, 1234567.89, 3 * 1234567890.0, 3 * 1234567890.0 - 0.01) for i in (1, 2, 3)]
    got = split(rows(data, WIDE))
    assert sum(got) == 3 * 123456789000 - 1
    assert max(got) - min(got) <= 1


@pytest.mark.parametrize("hot_rows", [running.HOT_ROWS, 500, 7])
def test_one_order_holds_a_third(spark, hot_rows):
    """Brute force over orders of which one holds a third of all lines."""
    lines = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 400 + 2).alias("order_id"),
        # ids spread over the whole range, as hashes are
        F.xxhash64("id").alias("order_detail_id"),
        (F.col("id") % 5 + 1).alias("sku_num"),
        ((F.col("id") * 37 % 9973 + 1) / 100).alias("sku_price"),
    )
    cents = F.floor(F.col("sku_num") * F.col("sku_price") * 100 + 0.5)
    totals = lines.groupBy("order_id").agg((F.sum(cents) / 100).alias("original_total_amount"),
                                           (F.sum(F.floor(cents * 9 / 10)) / 100).alias("final_total_amount"))
    frame = lines.join(totals, "order_id")
    got = {(r.order_id, r.order_detail_id): round(r.final_detail_amount * 100)
           for r in wide.pay_apportion(frame, hot_rows=hot_rows).collect()}

    want = {}
    by_order = {}
    for r in frame.collect():
        by_order.setdefault(r.order_id, []).append(r)
    for order, members in by_order.items():
        members.sort(key=lambda r: r.order_detail_id)
        original = round(members[0].original_total_amount * 100)
        paid = round(members[0].final_total_amount * 100)
        gross_sum = share_sum = 0
        for r in members:
            gross = round(r.sku_num * r.sku_price * 100)
            gross_sum += gross
            share = paid - share_sum if gross_sum == original else (2 * gross * paid + original) // (2 * original)
            share_sum += share
            want[(order, r.order_detail_id)] = share
        assert share_sum == paid
    assert got == want


def test_running_totals_blocks_span_the_bigint_range(rows):
    data = [(1, v, 1) for v in (-(2**63), -5, 0, 7, 2**63 - 1)]
    frame = rows(data, "k bigint, o bigint, v bigint")
    got = running.running_totals(frame, "k", "o", {"before": "v"}, limit=2).orderBy("o").collect()
    assert [r.before for r in got] == [None, 1, 2, 3, 4]


def test_apportion_over_two_batches(rows):
    """An order whose lines come in two batches is split as if they had come together."""
    data, want = CASES["three equal lines"]
    first = wide.pay_apportion(rows(data[:2], WIDE)).withColumn("dt", F.lit("2021-02-13"))
    sums = wide.order_sums(first)
    second = wide.pay_apportion_on(rows(data[2:], WIDE), sums)
    got = first.select("final_detail_amount").collect() + second.select("final_detail_amount").collect()
    assert [round(r[0] * 100) for r in got] == want


def test_dedup_keeps_first(rows):
    frame = rows([(1, 1, 10, "b"), (1, 1, 5, "a"), (1, 2, 7, "c")], "order_id bigint, order_detail_id bigint, w bigint, tag string")
    assert sorted(r.tag for r in wide.detail_dedup(frame, ["w"]).collect()) == ["a", "c"]


def test_unseen(rows):
    frame = rows([("d", "m1", 2), ("d", "m1", 1), ("d", "m2", 1)], "dt string, mid string, ts bigint")
    seen = rows([("d", "m2"), ("e", "m1")], "dt string, mid string")
    got = active.unseen(frame, seen, ["dt", "mid"], ["ts"]).collect()
    assert [(r.mid, r.ts) for r in got] == [("m1", 1)]


def test_skewed_user(spark):
    """One user has a third of all orders; every user still gets exactly one first order."""
    placed = spark.range(3000).select(
        "id",
        F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 100 + 2).alias("user_id"),
        F.concat(F.lit("2021-02-13 10:00:"), F.lpad((F.col("id") * 7 % 60).cast("string"), 2, "0")).alias("create_time"),
    )
    flagged = orders.first_order_flag(placed)
    per_user = flagged.groupBy("user_id").agg(F.sum(F.col("if_first_order").cast("int")).alias("n"))
    assert {r.n for r in per_user.collect()} == {1}
    assert flagged.count() == 3000
