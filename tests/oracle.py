"""Holds a registered query against its DuckDB SQL."""

import decimal
import os

import duckdb

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, float):
        return float(f"{value:.9g}")
    if isinstance(value, decimal.Decimal):
        return float(value)
    return tuple(map(plain, value)) if isinstance(value, list | tuple) else value


def assert_same(spark, query, sql):
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    df = query(spark, SF)
    columns = sorted(df.columns)
    assert columns == sorted(con.sql(sql).columns)
    ours = sorted(([plain(v) for v in r] for r in df.select(*columns).collect()), key=repr)
    theirs = sorted(([plain(v) for v in r] for r in con.sql(f"SELECT {', '.join(columns)} FROM ({sql})").fetchall()), key=repr)
    assert ours == theirs
