"""Registry of checked queries and the side-by-side comparison with DuckDB."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from checks.views import oracle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = oracle(sql)
        return fn
    return register


def duck(sf: str):
    import duckdb
    con = duckdb.connect()
    con.execute("set threads=8")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    if isinstance(v, (list, tuple)):
        return [_norm(x) for x in v]
    if isinstance(v, bool) or v is None:
        return v
    if type(v).__name__ == "Decimal":
        return repr(float(v))
    return str(v)


def compare(spark, sf: str, name: str, df: DataFrame | None = None) -> str | None:
    """None when the Spark result equals the DuckDB result, else a short reason."""
    df = QUERIES[name](spark, sf) if df is None else df
    cols = sorted(df.columns)
    got = [[_norm(v) for v in r] for r in df.select(*[f"`{c}`" for c in cols]).collect()]
    if name not in ORACLE:
        return None if got else "no rows"
    rel = duck(sf).execute(ORACLE[name])
    names = [d[0] for d in rel.description]
    if sorted(names) != cols:
        return f"columns {cols} != {sorted(names)}"
    at = [names.index(c) for c in cols]
    want = [[_norm(r[i]) for i in at] for r in rel.fetchall()]
    if len(got) != len(want):
        return f"{len(got)} rows, oracle has {len(want)}"
    a, b = sorted(map(repr, got)), sorted(map(repr, want))
    for x, y in zip(a, b):
        if x != y:
            return f"first difference in {cols}: {x} | oracle {y}"
    return None if got else "both empty"
