import json

import pytest
from pyspark.sql import functions as F

from retailflow import schemas
from retailflow.functions import age_group, day_of_text, gender_name, hour_of_text, previous_day, round_half_up, to_cents
from retailflow.functions.scalars import AGE_MIDDLE, AGE_OLD, AGE_YOUNG, GENDER_FEMALE, GENDER_MALE
from retailflow.operators import active, routing


def values(frame, *names):
    return [tuple(r) for r in frame.select(*names).collect()]


@pytest.mark.parametrize(
    "text, startup",
    [
        ('{"start": {"entry": "icon"}, "ts": 1}', True),
        ('{"start": "x"}', True),
        ('{"start": ""}', False),
        ('{"start": null}', False),
        ('{"action": "click"}', False),
        ("not json", False),
    ],
)
def test_route_log(rows, text, startup):
    routed = routing.route_log(rows([(text,)], "value string"))
    want = routing.STARTUP_TOPIC if startup else routing.EVENT_TOPIC
    assert values(routed, "topic") == [(want,)]


def test_cdc_array_flatten_sizes(rows):
    lines = [json.dumps({"table": "sku_info", "type": "DELETE", "data": [{"id": i} for i in range(n)]}) for n in (0, 1, 3)]
    lines.append('{"table": "sku_info", "data": null}')
    flat = routing.cdc_array_flatten(rows([(v,) for v in lines], "value string"))
    assert sorted(values(flat, "topic", "position", "value")) == [
        ("ODS_SKU_INFO", 0, '{"id":0}'),
        ("ODS_SKU_INFO", 0, '{"id":0}'),
        ("ODS_SKU_INFO", 1, '{"id":1}'),
        ("ODS_SKU_INFO", 2, '{"id":2}'),
    ]


@pytest.mark.parametrize(
    "envelope, kept",
    [
        ({"table": "order_info", "type": "insert", "data": {"id": 1}}, True),
        ({"table": "order_info", "type": "update", "data": {"id": 1}}, False),
        ({"table": "order_info", "type": "bootstrap-insert", "data": {"id": 1}}, False),
        ({"table": "user_info", "type": "update", "data": {"id": 1}}, True),
        ({"table": "user_info", "type": "delete", "data": {"id": 1}}, False),
        ({"table": "user_info", "data": {"id": 1}}, True),
        ({"table": "order_info", "data": {"id": 1}}, False),
        ({"table": "other", "type": "insert", "data": {"id": 1}}, False),
        ({"type": "insert", "data": {"id": 1}}, False),
        ({"table": "sku_info", "type": "insert", "data": {}}, False),
        ({"table": "sku_info", "type": "insert", "data": None}, False),
        ({"table": "sku_info", "type": "insert"}, False),
    ],
)
def test_cdc_filter_route(rows, envelope, kept):
    routed = routing.cdc_filter_route(rows([(json.dumps(envelope),)], "value string"))
    got = values(routed, "topic", "value")
    assert got == ([("ODS_" + envelope["table"].upper(), '{"id":1}')] if kept else [])


def test_age_group_without_birthday(rows):
    frame = rows([("no date",), (None,)], "b string").select(age_group("b", "2021-02-16").alias("g"))
    assert values(frame, "g") == [(None,), (None,)]


def test_age_group_bounds(rows):
    days = {19: AGE_YOUNG, 20: AGE_MIDDLE, 30: AGE_MIDDLE, 31: AGE_OLD}
    for years, want in days.items():
        frame = rows([(years * 365,)], "n int").select(
            age_group(F.date_sub(F.lit("2021-02-16").cast("date"), F.col("n")).cast("string"), "2021-02-16").alias("g")
        )
        assert values(frame, "g") == [(want,)]


def test_gender_name(rows):
    frame = rows([("M",), ("F",), ("",), (None,)], "g string").select(gender_name("g").alias("n"))
    assert values(frame, "n") == [(GENDER_MALE,), (GENDER_FEMALE,), (GENDER_FEMALE,), (GENDER_FEMALE,)]


def test_time_fields(rows):
    frame = rows([("2021-02-13 09:05:01",), ("2021-02-13",), (None,)], "t string")
    assert values(frame.select(day_of_text("t").alias("d"), hour_of_text("t").alias("h")), "d", "h") == [
        ("2021-02-13", "09"), ("2021-02-13", None), (None, None)]
    assert values(rows([("2024-03-01",)], "d string").select(previous_day("d").alias("p")), "p") == [("2024-02-29",)]
    logs = active.with_day_hour(rows([(1612137600000,), (1612223999999,)], "ts bigint"))
    assert values(logs, "dt", "hr") == [("2021-02-01", "00"), ("2021-02-01", "23")]


def test_rounding(rows):
    frame = rows([(1.005,), (2.675,), (0.125,), (33.333,)], "x double")
    assert [r[0] for r in frame.select(round_half_up("x")).collect()] == [1.0, 2.68, 0.13, 33.33]
    cents = rows([(0.29,), (1.15,), (104999.91,)], "x double").select(to_cents("x"))
    assert [r[0] for r in cents.collect()] == [29, 115, 10499991]


def test_decode_quarantines(rows):
    messages = rows([('{"id": 1, "user_id": 2, "extra": 3}',), ('{"id": ',)], "value string")
    good, bad = schemas.split_corrupt(schemas.decode(messages, schemas.ORDER_INFO).cache())
    assert values(good, "id", "user_id", "create_time") == [(1, 2, None)]
    assert values(bad, "_corrupt_record") == [('{"id": ',)]


def test_encode_leaves_out_nulls(rows):
    encoded = rows([(1, None, "x")], "id bigint, a string, b string").select(*schemas.encode("id"))
    assert values(encoded, "key", "value") == [("1", '{"id":1,"b":"x"}')]
