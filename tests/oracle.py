"""Compare registered queries with their SQL in an in-process DuckDB."""

from __future__ import annotations

import time

import duckdb
import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def rows(frame: pd.DataFrame) -> list[str]:
    if frame.empty:
        return []
    return sorted(frame[sorted(frame.columns)].astype(object).map(repr_value).agg("\x1f".join, axis=1).tolist())


def repr_value(v) -> str:
    if v is None or v is pd.NA or (isinstance(v, float) and v != v):
        return "null"
    if isinstance(v, float):
        return f"{v:.9g}"
    return str(v)


def types_of(spark_df, rel) -> list[str]:
    names = {"LONG": "BIGINT", "INT": "INTEGER", "STRING": "VARCHAR", "BOOLEAN": "BOOLEAN", "DOUBLE": "DOUBLE", "FLOAT": "FLOAT", "BIGINT": "BIGINT"}
    ours = {f.name: names.get(f.dataType.simpleString().upper(), f.dataType.simpleString()) for f in spark_df.schema}
    theirs = dict(zip(rel.columns, map(str, rel.types)))
    return [f"{c}: {ours.get(c)} / {theirs.get(c)}" for c in sorted({*ours, *theirs}) if ours.get(c) != theirs.get(c)]


def compare(spark, con, name, run, sql, sf_dir) -> dict:
    start = time.time()
    df = run(spark, sf_dir)
    got = df.toPandas()
    took = time.time() - start
    if sql is None:
        return {"name": name, "ok": None, "rows": len(got), "sec": took}
    start = time.time()
    rel = con.sql(sql)
    diff = types_of(df, rel)
    want = rel.df()
    duck = time.time() - start
    same = sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)
    return {"name": name, "ok": same and not diff, "rows": len(got), "want": len(want), "types": diff, "sec": took, "duck": duck, "frames": (got, want)}
