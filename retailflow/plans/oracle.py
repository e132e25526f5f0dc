"""SQL texts shared by the reference queries of the catalogue."""

from __future__ import annotations

from retailflow.functions.scalars import AGE_MIDDLE, AGE_OLD, AGE_YOUNG, GENDER_FEMALE, GENDER_MALE, ID_MODULI
from retailflow.sources.tables import AS_OF


def cents(x: str) -> str:
    return f"CAST(floor(({x}) * 100 + 0.5) AS BIGINT)"


def name_id(x: str) -> str:
    return f"CAST('0x' || substr(md5({x}), 1, 15) AS BIGINT)"


def change_kind(number: str) -> str:
    return (
        f"CASE {number} % 10 WHEN 0 THEN 'delete' WHEN 1 THEN 'update' WHEN 2 THEN 'update' "
        f"WHEN 3 THEN 'bootstrap-insert' ELSE 'insert' END"
    )


def number_id(values: list[str]) -> str:
    halves = []
    for modulus, factor in ID_MODULI:
        half = "CAST(0 AS BIGINT)"
        for value in values:
            half = f"(({half} * {factor} + {value}) % {modulus})"
        halves.append(half)
    return f"({halves[0]} * 1073741824 + {halves[1]})"


_LINE = (
    [f"CAST({c} AS BIGINT)" for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity")]
    + [cents(c) for c in ("l_extendedprice", "l_discount", "l_tax")]
    + ["ascii(l_returnflag)", "ascii(l_linestatus)", "date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE))"]
)

CTES = {
    "logs": """
        SELECT event_id AS seq, event_type, CAST(user_id AS VARCHAR) AS mid, epoch_us(ts) // 1000 AS ms,
               strftime(ts, '%Y-%m-%d') AS dt, strftime(ts, '%H') AS hr
        FROM events""",
    "firsts": """
        SELECT * FROM logs QUALIFY row_number() OVER (PARTITION BY dt, mid ORDER BY ms, seq) = 1""",
    "heads": """
        SELECT o_orderkey AS id, o_custkey AS user_id, o_orderstatus AS order_status,
               strftime(o_orderdate + to_seconds(o_orderkey * 7919 % 86400), '%Y-%m-%d %H:%M:%S') AS create_time
        FROM orders""",
    "totals": f"""
        SELECT l_orderkey AS id, CAST(sum({cents('l_extendedprice')}) AS BIGINT) AS original,
               CAST(sum({cents('l_extendedprice * (1 - l_discount)')}) AS BIGINT) AS paid
        FROM lineitem GROUP BY 1""",
    "flagged": """
        SELECT *, CASE WHEN user_id % 10 <> 0 AND row_number() OVER (PARTITION BY user_id ORDER BY create_time, id) = 1
                       THEN '1' ELSE '0' END AS if_first_order
        FROM heads""",
    "users": f"""
        SELECT c_custkey AS user_id, c_mktsegment AS user_level, c_nationkey AS province_id,
               strftime(DATE '1960-01-01' + CAST(c_custkey * 37 % 20000 AS INTEGER), '%Y-%m-%d') AS birthday,
               CASE WHEN c_custkey % 2 = 0 THEN 'M' ELSE 'F' END AS gender,
               CASE WHEN c_custkey % 2 = 0 THEN '{GENDER_MALE}' ELSE '{GENDER_FEMALE}' END AS gender_name,
               CASE WHEN (DATE '{AS_OF}' - (DATE '1960-01-01' + CAST(c_custkey * 37 % 20000 AS INTEGER))) // 365 < 20
                    THEN '{AGE_YOUNG}'
                    WHEN (DATE '{AS_OF}' - (DATE '1960-01-01' + CAST(c_custkey * 37 % 20000 AS INTEGER))) // 365 > 30
                    THEN '{AGE_OLD}' ELSE '{AGE_MIDDLE}' END AS age_group
        FROM customer""",
    "provinces": """
        SELECT n_nationkey AS id, n_name AS name, r_name AS area_code, 'CN-' || n_nationkey AS iso_code,
               'ISO-' || n_nationkey AS iso_3166_2
        FROM nation LEFT JOIN region ON n_regionkey = r_regionkey""",
    "skus": f"""
        SELECT p_partkey AS id, p_name AS sku_name, {name_id('p_name')} AS spu_id, {name_id('p_brand')} AS tm_id,
               {name_id('p_type')} AS category3_id, p_name AS spu_name, p_brand AS tm_name, p_type AS category3_name,
               p_retailprice AS price
        FROM part""",
    "full_orders": """
        SELECT f.id, f.user_id, f.order_status, f.create_time, f.if_first_order,
               substr(f.create_time, 1, 10) AS create_date, substr(f.create_time, 12, 2) AS create_hour,
               u.province_id, u.age_group, u.gender_name, p.name AS province_name, p.area_code AS province_area_code,
               p.iso_code AS province_iso_code, p.iso_3166_2 AS province_iso_3166_2,
               coalesce(t.original, 0) AS original, coalesce(t.paid, 0) AS paid
        FROM flagged f LEFT JOIN users u USING (user_id) LEFT JOIN provinces p ON u.province_id = p.id
             LEFT JOIN totals t ON f.id = t.id""",
    "details": f"""
        SELECT {number_id(_LINE)} AS id, l_orderkey AS order_id, l_partkey AS sku_id, CAST(l_quantity AS BIGINT) AS sku_num,
               {cents('CAST(l_quantity AS BIGINT) * (l_extendedprice / l_quantity)')} AS gross
        FROM lineitem""",
    "wide": """
        SELECT d.id AS order_detail_id, d.order_id, o.order_status, o.create_time, o.user_id, d.sku_id, d.sku_num,
               s.sku_name, o.original, o.paid, o.if_first_order, o.province_name, o.province_area_code,
               o.age_group AS user_age_group, o.gender_name AS user_gender, o.create_date AS dt,
               s.spu_id, s.tm_id, s.category3_id, s.spu_name, s.tm_name, s.category3_name, d.gross,
               (2 * d.gross * o.paid + o.original) // (2 * o.original) AS share
        FROM details d JOIN full_orders o ON d.order_id = o.id LEFT JOIN skus s ON d.sku_id = s.id""",
    "sums": """
        SELECT *,
               CAST(sum(gross) OVER (PARTITION BY order_id ORDER BY order_detail_id) AS BIGINT) AS gross_so_far,
               CAST(sum(share) OVER (PARTITION BY order_id ORDER BY order_detail_id) AS BIGINT) AS share_so_far
        FROM wide""",
    "split": """
        SELECT *, CASE WHEN gross_so_far = original THEN paid - (share_so_far - share) ELSE share END AS final_cents
        FROM sums""",
}

# Which fragments a fragment reads.
NEEDS = {
    "firsts": ("logs",),
    "flagged": ("heads",),
    "full_orders": ("flagged", "users", "provinces", "totals"),
    "wide": ("details", "full_orders", "skus"),
    "sums": ("wide",),
    "split": ("sums",),
}


def sql(body: str, *fragments: str, then: str = "") -> str:
    """`body` after a WITH clause of the fragments and what they read; `then` holds further
    clauses of its own."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for needed in NEEDS.get(name, ()):
            add(needed)
        if name not in ordered:
            ordered.append(name)

    for name in fragments:
        add(name)
    clauses = [f"{name} AS ({CTES[name]})" for name in ordered] + ([then] if then else [])
    return f"WITH {', '.join(clauses)} {body}" if clauses else body
