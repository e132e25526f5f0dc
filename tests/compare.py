"""Runs registered queries next to their SQL counterparts: python tests/compare.py [sf_dir] [name part ...]"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def oracle_connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


def spark_rows(frame):
    names = sorted(frame.columns)
    return names, sorted((tuple(r) for r in frame.select(*names).collect()), key=repr)


def oracle_rows(connection, text: str):
    result = connection.execute(text)
    columns = [c[0] for c in result.description]
    names = sorted(columns)
    places = [columns.index(n) for n in names]
    return names, sorted((tuple(r[p] for p in places) for r in result.fetchall()), key=repr)


def main() -> int:
    from retailflow.plans.catalogue import ORACLES, QUERIES
    from retailflow.session import build_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    wanted = sys.argv[2:]
    spark = build_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
                                                "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    connection = oracle_connection(sf_dir)
    bad = 0
    for name, run in QUERIES.items():
        if wanted and not any(w in name for w in wanted):
            continue
        start = time.time()
        try:
            got = spark_rows(run(spark, sf_dir))
            took = time.time() - start
            if name not in ORACLES:
                print(f"{name}: {len(got[1])} rows, no oracle, {took:.1f}s", flush=True)
                continue
            want = oracle_rows(connection, ORACLES[name])
            same = got == want
            print(f"{name}: {'ok' if same else 'DIFFERS'} {len(got[1])}/{len(want[1])} rows {took:.1f}s", flush=True)
            if not same:
                bad += 1
                print("  ", got[0], want[0])
                print("   spark ", [r for r in got[1] if r not in set(want[1])][:3])
                print("   oracle", [r for r in want[1] if r not in set(got[1])][:3])
        except Exception as error:  # report and go on
            bad += 1
            print(f"{name}: FAILED {str(error)[:1500]}", flush=True)
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main())
