"""Rows of a Spark result against DuckDB's for the same tables."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def told(v):
    return repr(round(v, 9) + 0.0) if isinstance(v, float) else repr(v)


def same(df, sql, connection):
    """Nothing, or what differs."""
    r = connection.sql(sql)
    if sorted(df.columns) != sorted(r.columns):
        return f"columns {sorted(df.columns)} and {sorted(r.columns)}"
    names = sorted(df.columns)
    at = [r.columns.index(c) for c in names]
    a = sorted(tuple(told(row[c]) for c in names) for row in df.collect())
    b = sorted(tuple(told(row[i]) for i in at) for row in r.fetchall())
    return "" if a == b else f"{len(a)} and {len(b)} rows; only Spark {sorted(set(a) - set(b))[:2]}, only DuckDB {sorted(set(b) - set(a))[:2]}"
