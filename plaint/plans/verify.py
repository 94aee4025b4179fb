"""Run registered queries in Spark and their DuckDB twins and compare the results.

Usage: ``python -m plaint.plans.verify [sf_dir] [name ...]``.  Rows are compared as
multisets after sorting columns by name; doubles are compared to 1e-9 relative.
"""

from __future__ import annotations

import math
import sys
import time

import duckdb

from plaint.sources.tables import TABLES


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return ("~",)
    if isinstance(v, float):
        if math.isnan(v):
            return ("nan",)
        if math.isinf(v):
            return ("inf", v > 0)
        return ("f", float(f"{v:.12g}"))
    if isinstance(v, (dict, list)):
        return ("s", repr(v))
    if hasattr(v, "isoformat"):
        return ("t", str(v)[:19] if len(str(v)) > 10 else str(v))
    if isinstance(v, bool):
        return ("b", v)
    if isinstance(v, int):
        return ("i", v)
    return ("s", str(v))


def _duck_type(spark_type) -> str:
    from pyspark.sql import types as T
    names = {T.LongType: "BIGINT", T.IntegerType: "INTEGER", T.DoubleType: "DOUBLE", T.StringType: "VARCHAR",
             T.BooleanType: "BOOLEAN", T.TimestampNTZType: "TIMESTAMP", T.DateType: "DATE",
             T.TimestampType: "TIMESTAMP WITH TIME ZONE"}
    return names.get(type(spark_type), spark_type.simpleString())


def rows_of(columns: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    return sorted(out, key=repr)


def compare(spark, con, name: str, fn, sql: str | None, sf_dir: str) -> dict:
    t0 = time.time()
    sdf = fn(spark, sf_dir)
    s_rows = [tuple(r) for r in sdf.collect()]
    s_cols = sdf.columns
    t_spark = time.time() - t0
    res = {"name": name, "spark_rows": len(s_rows), "spark_s": round(t_spark, 2)}
    if sql is None:
        res["status"] = "rows-only"
        return res
    rel = con.sql(sql)
    d_cols = rel.columns
    d_rows = rel.fetchall()
    res["duck_rows"] = len(d_rows)
    if sorted(s_cols) != sorted(d_cols):
        res["status"] = f"COLUMNS differ: spark={sorted(s_cols)} duck={sorted(d_cols)}"
        return res
    s_types = {f.name: _duck_type(f.dataType) for f in sdf.schema.fields}
    d_types = {c: str(t) for c, t in zip(d_cols, rel.types)}
    if s_types != d_types:
        res["status"] = f"TYPES differ: {[(c, s_types[c], d_types[c]) for c in s_types if s_types[c] != d_types[c]]}"
        return res
    a, b = rows_of(s_cols, s_rows), rows_of(d_cols, d_rows)
    if len(a) != len(b):
        res["status"] = "ROWCOUNT differs"
        return res
    diffs = [(x, y) for x, y in zip(a, b) if x != y]
    res["status"] = "ok" if not diffs else f"VALUES differ in {len(diffs)} rows; first: {diffs[0]}"
    return res


def main(argv: list[str]) -> int:
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    names = argv[2:]
    sys.path.insert(0, ".")
    from plaint.plans.catalog import REGISTRY
    from plaint.session import local_session
    spark = local_session()
    con = duck(sf_dir)
    bad = 0
    for name, (fn, sql) in REGISTRY.items():
        if names and name not in names:
            continue
        try:
            r = compare(spark, con, name, fn, sql, sf_dir)
        except Exception as exc:  # report and continue with the next query
            r = {"name": name, "status": f"ERROR {type(exc).__name__}: {str(exc)[:400]}"}
        if r["status"] not in ("ok", "rows-only"):
            bad += 1
        print(r, flush=True)
    print(f"{bad} problem(s)")
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main(sys.argv))
