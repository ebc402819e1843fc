"""Every named query against DuckDB on the same tables."""

import datetime
import decimal
import math

import duckdb
import pytest

from skerry.plans import catalogue

DATA = "/root/testdata/sf0.001"
ORACLE = catalogue.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in catalogue.TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return con


def plain(x):
    if isinstance(x, bool) or x is None or isinstance(x, str):
        return x
    if isinstance(x, (int, float, decimal.Decimal)):
        return "nan" if math.isnan(x) else round(float(x), 6) + 0.0
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None)
    return x


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i].lower())
    return sorted(([plain(r[i]) for i in order] for r in found), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_matches_sql(spark, duck, name):
    df = catalogue.queries()[name](spark, DATA)
    result = duck.execute(ORACLE[name])
    names = [d[0] for d in result.description]
    assert sorted(c.lower() for c in df.columns) == sorted(n.lower() for n in names)
    got, want = rows(df.columns, df.collect()), rows(names, result.fetchall())
    assert len(got) == len(want)
    assert got == want
