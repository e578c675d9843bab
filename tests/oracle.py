"""Compare a query with its SQL in DuckDB."""
import glob
import os

import duckdb


def compare(spark, d: str, query, sql: str) -> None:
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for p in glob.glob(f"{d}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    df = query(spark, d)
    cols = sorted(df.columns)
    got = [tuple(r[c] for c in cols) for r in df.collect()]
    res = con.execute(sql)
    names = [x[0] for x in res.description]
    assert sorted(names) == cols
    want = [tuple(dict(zip(names, r))[c] for c in cols) for r in res.fetchall()]

    def key(rows):
        return sorted([tuple(repr(v + 0.0) if isinstance(v, float) else repr(v) for v in r) for r in rows])

    assert key(got) == key(want)
