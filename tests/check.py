"""Compare named queries with their SQL: python tests/check.py [sf_dir] [name ...]."""

from __future__ import annotations

import math
import sys
import time
import traceback
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.9g}")
    return value


def normalised(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def compare(df, con, sql) -> tuple[bool, str]:
    got_cols, got = normalised(df.columns, [tuple(r) for r in df.collect()])
    result = con.execute(sql)
    want_cols, want = normalised([d[0] for d in result.description], result.fetchall())
    if got_cols != want_cols:
        return False, f"columns {got_cols} vs {want_cols}"
    if got == want:
        return True, f"{len(got)} rows"
    extra, missing = [r for r in got if r not in set(want)][:2], [r for r in want if r not in set(got)][:2]
    return False, f"{len(got)} vs {len(want)} rows; only here {extra}; only in SQL {missing}"


def main() -> None:
    from pyspark.sql import SparkSession

    from __spark_entry__ import oracle_sql, queries
    from xrel.session import tuned

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    builder = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
    builder = builder.config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    spark = tuned(builder.config("spark.driver.memory", "8g")).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls, bad = connect(sf_dir), oracle_sql(), 0
    for name, query in queries().items():
        if len(sys.argv) > 2 and name not in sys.argv[2:]:
            continue
        start = time.time()
        try:
            df = query(spark, sf_dir)
            ok, note = compare(df, con, sqls[name]) if name in sqls else (True, f"no SQL, {df.count()} rows")
        except Exception:  # noqa: BLE001 - the report goes on with the next query
            ok, note = False, traceback.format_exc()[-1500:]
        bad += not ok
        print("ok  " if ok else "FAIL", name, f"{time.time() - start:.1f}s", note[:1500], flush=True)
    print("failed:", bad)


if __name__ == "__main__":
    main()
