"""Run a registered query and its SQL twin side by side and compare the rows."""

from __future__ import annotations

import math
from collections import Counter

import duckdb
from pyspark.sql import SparkSession

from asset_atlas.driver.views import TABLES


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(_cell(x) for x in v)
    return v


def _rows(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(spark: SparkSession, sf_dir: str, con, fn, sql: str | None) -> dict:
    df = fn(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    if sql is None:
        return {"rows": len(got), "ok": True}
    res = con.execute(sql)
    names = [c[0] for c in res.description]
    want = res.fetchall()
    left, right = _rows(df.columns, got), _rows(names, want)
    return {
        "rows": len(got),
        "want": len(want),
        "columns": sorted(df.columns) == sorted(names),
        "ok": sorted(df.columns) == sorted(names) and left == right,
        "types": {f.name: f.dataType.simpleString() for f in df.schema},
        "duck_types": {c[0]: str(c[1]) for c in res.description},
        "extra": list((left - right).items())[:3],
        "missing": list((right - left).items())[:3],
    }
