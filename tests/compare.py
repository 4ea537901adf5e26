"""Rows of a Spark query and of its SQL, made comparable."""

from __future__ import annotations

import math
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6)
    return value


def rows(columns: list[str], got: list) -> Counter:
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return Counter(tuple(plain(r[i]) for i in order) for r in got)


def differences(spark_df, con: duckdb.DuckDBPyConnection, sql: str) -> str:
    """Empty if the results are equal."""
    told = con.execute(sql)
    names = [d[0] for d in told.description]
    want, got = rows(names, told.fetchall()), rows(spark_df.columns, spark_df.collect())
    if sorted(names) != sorted(spark_df.columns):
        return f"columns {sorted(spark_df.columns)} and {sorted(names)}"
    return "" if want == got else f"{sum((got - want).values())} rows of {sum(got.values())} only here, such as {list(got - want)[:2]}; {sum((want - got).values())} of {sum(want.values())} only there, such as {list(want - got)[:2]}"
