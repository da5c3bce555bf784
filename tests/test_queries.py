"""Every registered routing query against its SQL."""

import datetime
import decimal
import os

import duckdb
import pytest

from rivernet.jobs import queries, sql

SF = "/root/testdata/sf0.01"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
ORACLE = sql.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def plain(value):
    if isinstance(value, (int, float, decimal.Decimal)) and not isinstance(value, bool):
        return float(value) + 0.0
    return value.isoformat() if isinstance(value, datetime.date) else value


def test_every_query_has_its_sql():
    assert set(queries.queries()) == set(ORACLE)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_against_sql(spark, duck, name):
    want = duck.execute(ORACLE[name])
    columns = [d[0] for d in want.description]
    found = queries.queries()[name](spark, SF)
    assert sorted(found.columns) == sorted(columns)
    rows = lambda rs: sorted((tuple(map(plain, r)) for r in rs), key=repr)
    assert rows(map(tuple, found.select(*columns).collect())) == rows(want.fetchall())


def test_the_round_trip_gives_the_whole_kernel_back(spark):
    rows = lambda df: sorted(map(tuple, df.collect()))
    kernel = queries.K.long_kernel(queries._chain_kernel(spark, SF)).select("dst", "src", "lag", queries.rounded("weight").alias("weight"))
    back, last = rows(queries.kernel_block_roundtrip(spark, SF)), queries.data.chain32(spark, SF).agg({"reach_id": "max"}).first()[0]
    assert back == rows(kernel) and any(r[0] == last for r in back)
