"""Order-free comparison of a query with its SQL in DuckDB."""

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def rows(frame):
    def text(x):
        if x is None or x is pd.NA or x is pd.NaT or (isinstance(x, float) and x != x):
            return "~"
        if isinstance(x, float):
            return str(int(x)) if x == int(x) else repr(float(x))
        return str(x)

    frame = frame[sorted(frame.columns)]
    return list(frame.columns), sorted(tuple(map(text, r)) for r in frame.astype(object).itertuples(index=False))


def same(con, found, sql):
    a, b = rows(found.toPandas()), rows(con.execute(sql).df())
    assert a[0] == b[0]
    assert a[1] == b[1]
