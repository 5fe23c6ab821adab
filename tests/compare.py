"""Spark queries against their DuckDB twins."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _cell(x):
    if isinstance(x, float):
        return None if math.isnan(x) else float(f"{x:.9g}")
    return str(x) if hasattr(x, "isoformat") else x


def spark_rows(df):
    names = sorted(df.columns)
    return names, sorted((tuple(_cell(r[c]) for c in names) for r in df.collect()), key=repr)


def duck_rows(sql, sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    found = con.sql(sql)
    names = found.columns
    rows = found.fetchall()
    order = sorted(range(len(names)), key=names.__getitem__)
    return [names[i] for i in order], sorted((tuple(_cell(r[i]) for i in order) for r in rows), key=repr)
