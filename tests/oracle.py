"""Comparing registered queries with their SQL in DuckDB."""

import glob
import math
from pathlib import Path

import duckdb


def connect(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        source = path if Path(path).is_file() else f"{path}/*.parquet"
        con.sql(f"create view {Path(path).stem} as select * from '{source}'")
    return con


def normal(rows):
    def value(v):
        if isinstance(v, float):
            return None if math.isnan(v) else round(v, 6) + 0.0
        return v

    return sorted((tuple(value(v) for v in r) for r in rows), key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r))


def compare(spark, con, name, query, sql, sf_dir):
    got = query(spark, sf_dir)
    want = con.sql(sql)
    columns = sorted(got.columns)
    assert columns == sorted(want.columns), (name, columns, want.columns)
    a = normal(tuple(r) for r in got.select(*[f"`{c}`" for c in columns]).collect())
    b = normal(con.sql("select " + ", ".join(f'"{c}"' for c in columns) + f" from ({sql})").fetchall())
    assert len(a) == len(b), (name, len(a), len(b))
    wrong = [(x, y) for x, y in zip(a, b) if x != y]
    assert not wrong, (name, len(wrong), wrong[:3])
    return len(a)
