"""Compare the registered queries with their SQL: ``python tests/oracle_check.py [sf] [name ...]``."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def canon(v):
    if v is None:
        return "~null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return f"{round(v, 6) + 0.0:.6f}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(canon(x) for x in v) + "]"
    return str(v)


def kind(v):
    return "null" if v is None else type(v).__name__


def compare(names_a, rows_a, names_b, rows_b) -> str | None:
    if sorted(names_a) != sorted(names_b):
        return f"columns {sorted(names_a)} vs {sorted(names_b)}"
    if len(rows_a) != len(rows_b):
        return f"rows {len(rows_a)} vs {len(rows_b)}"
    ia = [names_a.index(n) for n in sorted(names_a)]
    ib = [names_b.index(n) for n in sorted(names_b)]
    for x, y, n in zip(ia, ib, sorted(names_a)):
        ka = {kind(r[x]) for r in rows_a} - {"null"}
        kb = {kind(r[y]) for r in rows_b} - {"null"}
        if ka != kb and ka and kb:
            return f"type of {n}: {ka} vs {kb}"
    a = sorted(tuple(canon(r[i]) for i in ia) for r in rows_a)
    b = sorted(tuple(canon(r[i]) for i in ib) for r in rows_b)
    if a != b:
        diff = [(p, q) for p, q in zip(a, b) if p != q]
        return f"{len(diff)} rows differ, columns {sorted(names_a)}, first {str(diff[0])[:600]}"
    return None


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def run_sql(con, sql):
    cur = con.execute(sql)
    return [d[0] for d in cur.description], cur.fetchall()


def main() -> None:
    import __spark_entry__ as entry
    from pyspark.sql import SparkSession

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    wanted = sys.argv[2:]
    sf_dir = f"/root/testdata/sf{sf}"
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false").config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    con = connect(sf_dir)
    qs, sql = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, fn in qs.items():
        if wanted and name not in wanted and not any(w.endswith("*") and name.startswith(w[:-1]) for w in wanted):
            continue
        t = time.time()
        try:
            df = fn(spark, sf_dir)
            rows = [tuple(r) for r in df.collect()]
            took = time.time() - t
            if name in sql:
                t = time.time()
                names_b, rows_b = run_sql(con, sql[name])
                msg = compare(df.columns, rows, names_b, rows_b)
                sq = time.time() - t
            else:
                msg, sq = ("no rows" if not rows else None), 0.0
            flag = "ok  " if msg is None else "FAIL"
            if not rows:
                flag = "ZERO"
            bad += flag != "ok  "
            print(f"{flag} {name:28s} {took:6.2f}s sql {sq:5.2f}s rows {len(rows)} {'' if name in sql else '(rows only)'} {msg or ''}", flush=True)
        except Exception as e:  # noqa: BLE001 - the report goes on with the next query
            bad += 1
            print(f"ERR  {name:28s} {time.time() - t:6.2f}s {type(e).__name__}: {str(e)[:900]}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main()
