"""Holding a query against its SQL in DuckDB."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(frame):
    """The rows as sorted tuples of texts, columns by name, numbers to nine decimals."""
    names = sorted(frame.columns)
    say = lambda v: "∅" if v is None or v != v else repr(round(float(v), 9)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return names, sorted(tuple(map(say, r)) for r in frame[names].astype(object).itertuples(index=False))


def same(spark, query, sql, folder):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    got, wanted = rows(query(spark, folder).toPandas()), rows(con.execute(sql).df())
    assert got == wanted
