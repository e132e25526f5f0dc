from pyspark.sql import functions as F

from retailflow.operators import serving

WIDE = "order_id bigint, order_detail_id bigint, sku_name string, sku_num bigint, dt string, user_gender string, user_age_group string, province_name string, final_detail_amount double"


def wide(rows):
    return rows(
        [
            (1, 1, "red ring", 2, "2019-03-04", "f", "a", "X", 5.0),
            (1, 2, "blue ring", 700, "2019-03-04", "f", "a", "X", 9.0),
            (2, 3, "red bolt", 1, "2019-03-04", "m", "b", "Y", 7.0),
            (3, 4, "red ring", 1, "2019-03-05", "m", "b", "Y", 1.0),
        ],
        WIDE,
    )


def startups(rows, data):
    frame = rows(data, "mid string, ts bigint, seq bigint")
    return frame.select(F.struct("mid", *[F.lit("").alias(c) for c in ("uid", "ar", "ch", "vc")]).alias("common"), "ts", "seq")


HOUR = 3600_000
DAY0 = 1612137600000  # 2021-02-01


def test_daily_actives_of_one_day(rows):
    logs = startups(rows, [("a", DAY0 - HOUR, 0), ("a", DAY0 + HOUR, 1), ("a", DAY0 + 2 * HOUR, 2), ("b", DAY0 + HOUR, 3),
                           ("c", DAY0 + 25 * HOUR, 4)])
    assert [tuple(r) for r in serving.dau_total(logs, "2021-02-01").collect()] == [("2021-02-01", 2)]
    assert [tuple(r) for r in serving.dau_by_hour(logs, "2021-02-01").collect()] == [("2021-02-01", "01", 2)]
    compared = serving.dau_hour_compare(logs, "2021-02-01")
    assert sorted(tuple(r) for r in compared.collect()) == [
        ("2021-02-01", "today", "01", 2), ("2021-02-01", "yesterday", "23", 1)]
    filled = serving.hour_zero_fill(compared).collect()
    assert len(filled) == 24
    assert {(r.hr, r.yesterday, r.today) for r in filled if r.yesterday or r.today} == {("01", 0, 2), ("23", 1, 0)}
    assert [r.value for r in serving.kpi_of_day(logs, "2021-02-01").collect()] == [2, 1]
    assert [r.value for r in serving.kpi_of_day(logs, "2022-01-01").collect()] == [0, 0]


def test_dashboard_filter(rows):
    frame = wide(rows)
    assert serving.dashboard_filter(frame, "2019-03-04", "").count() == 3
    assert serving.dashboard_filter(frame, "2019-03-04", "red ring").count() == 1
    assert serving.dashboard_filter(frame, None, "ring").count() == 3
    assert serving.dashboard_filter(frame, "2019-03-04", "green").count() == 0


def test_shares_and_sales(rows):
    frame = wide(rows)
    assert {(r.name, r.value, r.share) for r in serving.gender_share(frame).collect()} == {("f", 2, 0.5), ("m", 2, 0.5)}
    assert {(r.name, r.value, r.band) for r in serving.province_sales(frame).collect()} == {("X", 702, 7), ("Y", 2, 1)}
    assert {(r.name, r.num) for r in serving.name_num_bars(frame).collect()} == {("red ring", 3), ("blue ring", 700), ("red bolt", 1)}


def test_facets(rows):
    response = serving.facet_response(wide(rows), "2019-03-04", "", 1, 1).first()
    assert response.total == 3
    assert [(d.sku_name, d.order_detail_id, d.rank) for d in response.detail] == [("red bolt", 3, 2)]
    assert [[(g.name, g.value) for g in part.group] for part in response.stat] == [[("a", 2), ("b", 1)], [("f", 2), ("m", 1)]]
    long = serving.facet_search(wide(rows), "2019-03-04", "", 0, 10).where("section = 'detail'").orderBy("rank").collect()
    assert [r.value for r in long] == [d.order_detail_id for d in serving.facet_response(wide(rows), "2019-03-04", "", 0, 10).first().detail]
    beyond = serving.facet_response(wide(rows), "2019-03-04", "", 50, 10).first()
    assert beyond.total == 3 and beyond.detail == []
    nothing = serving.facet_response(wide(rows), "1999-01-01", "", 0, 10).first()
    assert nothing.total == 0 and nothing.detail == []


def test_page_beyond_the_end(rows):
    frame = wide(rows)
    order = [F.desc("final_detail_amount"), F.asc("order_detail_id")]
    assert [r.order_detail_id for r in serving.page(frame, order, 1, 2).collect()] == [3, 1]
    assert serving.page(frame, order, 10, 5).count() == 0


def test_doc_search(rows):
    docs = rows(
        [(1, "deep red sea", [("actor one",)]), (2, "Red cliff", [("actor one",)]),
         (1, "reddish", [("actor one",)]), (1, "red", [("actor",)]), (1, "blue", [("actor one",)])],
        "id bigint, name string, actorList array<struct<name: string>>",
    )
    assert {r.name for r in serving.doc_search(docs, "red", "actor one").collect()} == {"deep red sea", "Red cliff"}
    assert {r.name for r in serving.doc_search(docs, "red", "actor one", 1).collect()} == {"deep red sea"}
    assert {r.name for r in serving.doc_search(docs, "cliff sea", "actor one").collect()} == {"deep red sea", "Red cliff"}


def test_topk(rows):
    frame = rows([("a",), ("b",), ("b",), ("c",), ("c",)], "x string")
    assert [tuple(r) for r in serving.topk_terms(frame, "x", 2).collect()] == [("b", 2), ("c", 2)]
