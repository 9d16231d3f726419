"""Run queries beside their SQL in DuckDB and compare the results."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def canonical(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return round(value, 5) + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(canonical(v) for v in value)
    return value


def compare(spark_df, sql: str, sf_dir: str, tables) -> str | None:
    """None when both agree, else what differs."""
    con = duckdb.connect()
    for name in tables:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    expected = cur.fetchall()
    if sorted(names) != sorted(spark_df.columns):
        return f"columns {sorted(spark_df.columns)} != {sorted(names)}"
    order = sorted(names)
    got = [tuple(canonical(row[c]) for c in order) for row in spark_df.collect()]
    at = [names.index(c) for c in order]
    want = [tuple(canonical(row[i]) for i in at) for row in expected]
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}; spark {got[:2]} sql {want[:2]}"
    key = lambda r: tuple((v is None, str(type(v)), v) for v in r)
    got.sort(key=key)
    want.sort(key=key)
    for a, b in zip(got, want):
        if a != b:
            return f"{order}: spark {str(a)[:400]} sql {str(b)[:400]}"
        for x, y in zip(a, b):
            if type(x) is not type(y):
                return f"types {type(x)} {type(y)} in {order}: {a}"
    return None


def main(argv: list[str]) -> int:
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry
    from storyloom import model

    sf = os.environ.get("SF", "0.001")
    sf_dir = f"/root/testdata/sf{sf}"
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false").config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries, checks = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, fn in queries.items():
        if argv and not any(name.startswith(a) for a in argv):
            continue
        start = time.time()
        try:
            df = fn(spark, sf_dir)
            if name in checks:
                problem = compare(df, checks[name], sf_dir, model.TABLES)
                n = "-" if problem else df.count() if os.environ.get("COUNT") else ""
            else:
                rows = df.collect()
                problem, n = None, f"rows={len(rows)} {str(rows[:1])[:200]}"
        except Exception as exc:  # noqa: BLE001
            problem, n = f"{type(exc).__name__}: {str(exc)[:700]}", ""
        bad += problem is not None
        print(f"{'BAD ' if problem else 'ok  '} {name} {time.time() - start:.1f}s {n} {problem or ''}", flush=True)
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    raise SystemExit(main(sys.argv[1:]))
