"""Random filters and aggregates against DuckDB, nulls included."""

import duckdb
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from skerry.session import Engine

ROWS = "(SELECT o_orderkey, nullif(o_custkey % 7, 3) AS a, nullif(o_orderkey % 5, 2) AS b, nullif(o_orderstatus, 'P') AS s FROM orders WHERE o_orderkey < 400)"
number = st.sampled_from(["a", "b", "o_orderkey % 11", "a + b", "b * 2 - a"])
leaf = st.one_of(
    st.tuples(number, st.sampled_from(["=", "<>", "<", "<=", ">", ">="]), st.integers(-1, 7)).map(lambda t: f"{t[0]} {t[1]} {t[2]}"),
    st.tuples(number, st.sampled_from(["IS NULL", "IS NOT NULL"])).map(lambda t: f"({t[0]}) {t[1]}"),
    st.tuples(number, st.lists(st.integers(0, 6), min_size=1, max_size=3)).map(lambda t: f"{t[0]} IN ({', '.join(map(str, t[1]))})"),
    st.sampled_from(["s LIKE 'O%'", "s NOT LIKE 'F'", "s = 'F'", "coalesce(s, 'x') = 'x'"]),
)
test = st.recursive(leaf, lambda x: st.one_of(st.tuples(x, st.sampled_from(["AND", "OR"]), x).map(lambda t: f"({t[0]} {t[1]} {t[2]})"), x.map(lambda t: f"NOT ({t})")), max_leaves=5)
key = st.sampled_from(["a", "b", "s"])


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck), derandomize=True)
@given(where=test, by=key, over=number)
def test_random_aggregates(spark, where, by, over):
    spark.read.parquet("/root/testdata/sf0.001/orders.parquet").createOrReplaceTempView("orders")
    text = f"SELECT {by} AS k, count(*) AS n, count({over}) AS c, cast(sum({over}) AS bigint) AS s, min({over}) AS lo FROM {ROWS} t WHERE {where} GROUP BY {by}"
    con = duckdb.connect()
    con.execute("CREATE VIEW orders AS SELECT * FROM '/root/testdata/sf0.001/orders.parquet'")
    got = sorted(map(tuple, Engine(spark).sql(text).collect()), key=repr)
    assert got == sorted(con.execute(text).fetchall(), key=repr)
