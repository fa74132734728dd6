"""Run registered queries next to their SQL checks: ``python tests/compare.py sf0.01 [query ...]``."""

from __future__ import annotations

import datetime as dt
import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duckdb_views(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _cell(v) -> str:
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "\0null"
    if isinstance(v, float):
        return repr(0.0 if v == 0 else v)
    if isinstance(v, (dt.date, dt.datetime)):
        return v.isoformat()
    return str(v)


def rows_of(columns, rows) -> tuple[list[str], list[tuple]]:
    """Rows with columns in name order, sorted as text."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(spark, con, name: str, query, sql: str, sf_dir: str) -> str | None:
    """None if both agree, else what differs."""
    df = query(spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    result = con.execute(sql)
    want = rows_of([c[0] for c in result.description], result.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} != {want[0]}"
    if len(got[1]) != len(want[1]):
        return f"rows {len(got[1])} != {len(want[1])}; first only here {sorted(set(got[1]) - set(want[1]))[:2]}, there {sorted(set(want[1]) - set(got[1]))[:2]}"
    bad = [(a, b) for a, b in zip(got[1], want[1]) if a != b]
    if bad:
        here, there = sorted(set(got[1]) - set(want[1])), sorted(set(want[1]) - set(got[1]))
        return f"{len(here)} rows differ of {len(want[1])}; {got[0]}\n   here  {str(here[:2])[:900]}\n   there {str(there[:2])[:900]}"
    return None


def main() -> int:
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf_dir = f"/root/testdata/{sys.argv[1]}"
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false").config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb_views(sf_dir)
    failed = 0
    sqls = entry.oracle_sql()
    for name, query in entry.queries().items():
        if len(sys.argv) > 2 and name not in sys.argv[2:]:
            continue
        started = time.time()
        try:
            problem = compare(spark, con, name, query, sqls[name], sf_dir) if name in sqls else "no SQL"
        except Exception as e:  # noqa: BLE001
            problem = str(e)[:700]
        failed += problem is not None
        print(f"{name:24s} {time.time() - started:6.2f}s {'ok' if problem is None else problem}", flush=True)
    return failed


if __name__ == "__main__":
    sys.exit(main())
