import os

import duckdb


def tables(sf_dir):
    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        path = f"{sf_dir}/{name}"
        con.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    return con


def plain(rows):
    return sorted(tuple("NULL" if v is None else f"{v:.9g}" if isinstance(v, float) else str(v) for v in r) for r in rows)


def same(df, con, sql):
    """Whether a Spark result and a SQL query have the same columns and rows."""
    cols = sorted(df.columns)
    want = con.sql(sql)
    assert cols == sorted(want.columns)
    got = plain([tuple(r[c] for c in cols) for r in df.collect()])
    return got == plain(con.sql(f"SELECT {', '.join(cols)} FROM ({sql})").fetchall())
