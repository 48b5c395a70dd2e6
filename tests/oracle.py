"""Compare a query's rows with its SQL in DuckDB."""

import os

import duckdb


def rows(frame):
    columns = sorted(frame.columns)
    frame = frame[columns].astype(object).where(frame[columns].notna(), None)
    return columns, sorted(str(tuple(v.item() if hasattr(v, "item") else v for v in r)) for r in frame.itertuples(index=False))


def assert_same(spark, sf_dir, query, sql, folder):
    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{sf_dir}/{name}'")
    query(spark, sf_dir).write.mode("overwrite").parquet(str(folder))
    got = con.execute(f"SELECT * FROM '{folder}/*.parquet'").fetch_df()
    want = con.execute(sql).fetch_df()
    assert rows(got) == rows(want)
    assert {c: got[c].dtype for c in got} == {c: want[c].dtype for c in want} or not len(want)
    return len(want)
