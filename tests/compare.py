"""Spark results and DuckDB results as comparable lists."""

import math
from pathlib import Path

import duckdb


def cell(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return round(float(v), 6) + 0.0 if isinstance(v, float) or type(v).__name__ == "Decimal" else v


def rows(df):
    names = sorted(df.columns)
    return sorted((tuple(cell(r[n]) for n in names) for r in df.collect()), key=repr)


def oracle(sql, sf_dir):
    con = duckdb.connect()
    for path in Path(sf_dir).glob("*.parquet"):
        con.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    found = con.sql(sql)
    at = sorted(range(len(found.columns)), key=lambda i: found.columns[i])
    return sorted((tuple(cell(r[i]) for i in at) for r in found.fetchall()), key=repr)
