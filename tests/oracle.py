"""Compare a query with its SQL, run by DuckDB on the same files."""

import math
from pathlib import Path

import duckdb


def connect(folder):
    con = duckdb.connect()
    for f in sorted(Path(folder).glob("*.parquet")):
        files = f / "*.parquet" if f.is_dir() else f
        con.execute(f"create view {f.stem} as select * from read_parquet('{files}')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return v


def check(con, spark, folder, query, sql):
    df = query(spark, folder)
    names = sorted(df.columns)
    got = sorted((tuple(plain(x) for x in r) for r in df.select(*names).collect()), key=repr)
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    assert sorted(columns) == names
    at = [columns.index(n) for n in names]
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in result.fetchall()), key=repr)
