"""Run a registered query on Spark and its check SQL on DuckDB, and compare all rows."""

from __future__ import annotations

import math
import os
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        path = os.path.join(sf_dir, f"{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _key(value):
    if value is None:
        return "~null"
    if isinstance(value, float):
        return "~nan" if math.isnan(value) else repr(value + 0.0)
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_key(r[i]) for i in order) for r in rows), sorted(columns)


def compare(spark, con, fn, sql, sf_dir):
    start = time.time()
    df = fn(spark, sf_dir)
    got, got_cols = rows_of(df.columns, df.collect())
    mid = time.time()
    types = dict(df.dtypes)
    if sql is None:
        return {"rows": len(got), "ok": None, "spark": mid - start, "types": types}
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    want, want_cols = rows_of(cols, cur.fetchall())
    problem = ""
    if got_cols != want_cols:
        problem = f"columns {got_cols} / {want_cols}"
    elif got != want:
        a, b = set(got) - set(want), set(want) - set(got)
        problem = f"rows {len(got)}/{len(want)} only-spark {list(a)[:2]} only-sql {list(b)[:2]}"
    return {"rows": len(got), "ok": not problem, "problem": problem, "spark": mid - start,
            "sql": time.time() - mid, "types": types}


if __name__ == "__main__":
    import sys
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from causalspark.session import get_session
    wanted = sys.argv[2:]
    sf = f"/root/testdata/sf{sys.argv[1]}"
    spark = get_session(master="local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
        "spark.driver.memory": "12g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("OFF")
    con = connect(sf)
    sqls, fns = entry.oracle_sql(), entry.queries()
    bad = 0
    for name, fn in fns.items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        try:
            r = compare(spark, con, fn, sqls.get(name), sf)
            flag = {True: "ok  ", False: "BAD ", None: "rows"}[r["ok"]]
            bad += r["ok"] is False
            zero = " ZERO" if r["rows"] == 0 else ""
            print(f"{flag} {name} rows={r['rows']}{zero} spark={r['spark']:.2f}s sql={r.get('sql', 0):.2f}s {r.get('problem', '')}", flush=True)
        except Exception as ex:  # report and go on with the next query
            bad += 1
            print(f"ERR  {name} {type(ex).__name__}: {str(ex)[:700]}", flush=True)
    print("bad:", bad)
