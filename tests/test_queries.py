"""Every query with SQL gives DuckDB's rows over the smallest tables."""

import datetime
import decimal
import math
import os

import duckdb
import pytest

from tidemark import plans

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(data_folder="/root/testdata/sf0.001"):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{data_folder}/{t}.parquet"):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{data_folder}/{t}.parquet'")
    con.sql("SET timezone = 'UTC'")
    return con


def plain(x):
    if isinstance(x, decimal.Decimal):
        return float(x)
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 9)
    return x


def table(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(repr([plain(r[i]) for i in order]) for r in rows)


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, data, duck, name):
    got = plans.QUERIES[name](spark, data)
    rows = got.collect()
    if name in plans.SQL:
        want = duck.execute(plans.SQL[name])
        columns = [c[0] for c in want.description]
        assert sorted(got.columns) == sorted(columns)
        assert table(got.columns, rows) == table(columns, want.fetchall())
