"""Times the headline queries and prints one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_QUERIES
(comma-separated names, default the list below). Every query writes all its rows to a sink that
discards them; each is run once to warm up the session's first use of its code path, then timed.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from retailflow.plans.catalogue import QUERIES  # noqa: E402
from retailflow.plans.warehouse import stored_wide  # noqa: E402
from retailflow.session import build_session  # noqa: E402
from retailflow.sources.tables import Tables  # noqa: E402

HEADLINE = [
    "p1_route_log",
    "p3_cdc_filter_route",
    "d1_dau_dedup",
    "a1_dau_total",
    "a2_dau_by_hour",
    "a3_dau_hour_compare",
    "a5_kpi_tiles",
    "w1_first_order_flag",
    "j1_sku_dims",
    "j3_order_user",
    "j4_detail_sku",
    "j7_order_detail_join",
    "j8_seen_set_antijoin",
    "d2_detail_dedup",
    "w3_pay_apportion",
    "wide_fact",
    "a9_gender_share",
    "a11_province_sales",
    "a13_facet_search",
    "a11_sales_cube",
    "t8_dim_as_of",
    "a1_actives_of_ranges",
    "t2_device_sessions",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = build_session(
        "retailflow-bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "8g"),
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}
    if any(n.startswith(("a9", "a1", "p15")) for n in names):
        # The reports read the stored wide table; building it is timed by itself, and warm like the rest.
        QUERIES["wide_fact"](spark, sf_dir).write.format("noop").mode("overwrite").save()
        start = time.perf_counter()
        stored_wide(Tables(spark, sf_dir))
        times["stored_wide_build"] = round(time.perf_counter() - start, 3)
    for name in names:
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    spark.stop()
    sf = Path(sf_dir).name.removeprefix("sf")
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
    }))


if __name__ == "__main__":
    main()
