"""Compare a Spark query with its SQL on DuckDB."""

import os
from numbers import Number
from pathlib import Path

import duckdb

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    """A nullable integer column comes as numbers of one kind or another: small whole numbers compare as floats."""
    return float(value) if isinstance(value, Number) and abs(value) < 2**53 else value


def rows(frame):
    columns = sorted(frame.columns)
    values = frame[columns].astype(object).where(frame[columns].notna(), None)
    return columns, sorted(repr([plain(v) for v in row]) for row in values.itertuples(index=False, name=None))


def assert_same(spark, query, sql, sf=SF):
    con = duckdb.connect()
    for t in TABLES:
        if Path(f"{sf}/{t}.parquet").exists():
            con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    assert rows(query(spark, sf).toPandas()) == rows(con.sql(sql).df())
