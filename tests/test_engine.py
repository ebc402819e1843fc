"""What the catalogue's queries do not show: dialect, errors, constraints, transactions, relations, streams."""

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from skerry.functions import kernels, temporal
from skerry.operators.relation import ColumnExpression, ConstantExpression, CountExpression, relation
from skerry.operators.statements import ConstraintError
from skerry.plans import compat, dialect
from skerry.session import Engine, connect
from skerry.sources.ingest import read_documents, to_frame
from skerry.streaming import events as streams


@pytest.fixture
def db(spark, tmp_path):
    return Engine(spark, f"file://{tmp_path}/db")


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("SELECT v[1] FROM t", "SELECT try_element_at(v, 1) FROM t"),
        ("SELECT (a)[2][1] FROM t", "SELECT try_element_at(try_element_at((a), 2), 1) FROM t"),
        ("SELECT 'x[1] = ANY (SELECT 1)' -- = ANY (SELECT 2)\n", "SELECT 'x[1] = ANY (SELECT 1)'"),
        ('SELECT "a b" FROM t WHERE x = $2', "SELECT `a b` FROM t WHERE x = :p2"),
        ("SELECT ARRAY[1, 2]", "SELECT array(1, 2)"),
        ("SELECT x::int4, cast(y AS text) FROM t", "SELECT x :: int, cast(y AS string) FROM t"),
    ],
)
def test_rewrites(text, want):
    assert dialect.rewrite(text) == want


def test_any_all_with_nulls(spark):
    spark.sql("SELECT * FROM VALUES (1), (5), (NULL) AS t(x)").createOrReplaceTempView("xs")
    spark.sql("SELECT * FROM VALUES (2), (NULL) AS t(y)").createOrReplaceTempView("ys")
    e = Engine(spark)
    assert got(e.sql("SELECT x FROM xs WHERE x > ANY (SELECT y FROM ys)")) == [(5,)]
    assert got(e.sql("SELECT x FROM xs WHERE x > ALL (SELECT y FROM ys)")) == []
    assert len(got(e.sql("SELECT x FROM xs WHERE x > ALL (SELECT y FROM ys WHERE y > 9)"))) == 3
    assert got(e.sql("SELECT x FROM xs WHERE x <> ANY (SELECT y FROM ys)")) == [(1,), (5,)]


def test_recursion_beyond_the_default_depth(spark):
    assert Engine(spark).sql("WITH RECURSIVE t(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM t WHERE n < 150) SELECT max(n) AS m FROM t").first().m == 150


def test_dynamic_tables(db):
    db.sql("CREATE TABLE mt ()")
    db.sql("INSERT INTO mt (id, val) VALUES (1, 1), (2, 2)")
    db.sql("INSERT INTO mt (id, val) VALUES (3, 'hello')")
    db.sql("INSERT INTO mt (id, a.b, a.c) VALUES (4, 7, 8)")
    with pytest.raises(ValueError, match="ambiguous"):
        db.sql("SELECT val FROM mt")
    assert got(db.sql("SELECT id, val::?string FROM mt WHERE val::?string IS NOT NULL")) == [(3, "hello")]
    assert db.execute("SELECT * FROM mt").columns == ["id", "val", "val", "a/b", "a/c"]
    assert got(db.sql("SELECT mt #>> '{a,b}' AS b FROM mt WHERE mt ? 'a.b'")) == [(7,)]
    assert db.sql("SELECT mt -> 'a' FROM mt").columns == ["b", "c"]
    assert db.sql("SELECT mt #- 'a.b' FROM mt").columns == ["id", "val#bigint", "val#string", "a/c"]
    with pytest.raises(ValueError, match="ends in"):
        db.sql("SELECT id FROM mt WHERE mt -> 'a' = 1")
    assert db.sql("SELECT count(*) AS n FROM mt WHERE mt ?& array[]").first().n == 4
    assert db.sql("SELECT count(*) AS n FROM mt WHERE mt ?| array[]").first().n == 0
    db.sql("ALTER TABLE mt DROP COLUMN val")
    assert "val" not in db.execute("SELECT * FROM mt").columns


def test_constraints(db):
    db.sql("CREATE TABLE p (a int, b int, PRIMARY KEY (a, b))")
    db.sql("INSERT INTO p VALUES (1, 1), (1, 2)")
    with pytest.raises(ConstraintError, match="unique"):
        db.sql("INSERT INTO p VALUES (1, 1)")
    db.sql("CREATE TABLE c (id int, x int, y int, FOREIGN KEY (x, y) REFERENCES p (a, b) MATCH FULL)")
    db.sql("INSERT INTO c VALUES (1, 1, 2), (2, NULL, NULL)")
    with pytest.raises(ConstraintError, match="in part"):
        db.sql("INSERT INTO c VALUES (3, 1, NULL)")
    with pytest.raises(ConstraintError, match="no row"):
        db.sql("INSERT INTO c VALUES (3, 9, 9)")
    with pytest.raises(ConstraintError, match="would leave"):
        db.sql("DELETE FROM p WHERE b = 2")
    assert db.sql("SELECT count(*) AS n FROM p").first().n == 2
    db.sql("CREATE TABLE n (v int NOT NULL, w int CHECK (w > 0 OR w < -5))")
    db.sql("INSERT INTO n VALUES (1, NULL), (2, -9)")
    for bad in ("(NULL, 1)", "(1, -3)"):
        with pytest.raises(ConstraintError):
            db.sql(f"INSERT INTO n VALUES {bad}")
    with pytest.raises(ConstraintError):
        db.sql("UPDATE n SET v = NULL WHERE v = 1")
    with pytest.raises(ConstraintError):
        db.sql("ALTER TABLE n ADD CONSTRAINT small CHECK (v < 2)")


def test_types_and_returning(db):
    db.sql("CREATE TYPE mood AS ENUM ('sad', 'ok', 'happy')")
    db.sql("CREATE TYPE pair AS (a int, b text)")
    db.sql("CREATE TABLE t (id int, m mood, v int[3], p pair)")
    db.sql("INSERT INTO t VALUES (1, 'ok', ARRAY[1, 2, 3], ROW(1, 'x')), (2, 'sad', ARRAY[4], NULL)")
    assert got(db.sql("SELECT id, v[1], v[4], (p).b FROM t")) == [(1, 1, None, "x"), (2, 4, None, None)]
    for bad in ("(3, 'glad', NULL, NULL)", "(3, 'ok', ARRAY[1, 2, 3, 4], NULL)"):
        with pytest.raises(Exception):
            db.sql(f"INSERT INTO t VALUES {bad}")
    assert got(db.sql("DELETE FROM t WHERE id = 2 RETURNING id, m")) == [(2, "sad")]
    assert got(db.sql("UPDATE t SET id = $1 WHERE id = $2 RETURNING *", [7, 1]))[0][:2] == (7, "ok")


def test_transactions_and_writers(db, spark):
    db.sql("CREATE TABLE t (k int)")
    other = Engine(spark, db.catalog.folder)
    db.sql("BEGIN")
    db.sql("INSERT INTO t VALUES (1)")
    assert db.sql("SELECT count(*) AS n FROM t").first().n == 1
    assert other.sql("SELECT count(*) AS n FROM t").first().n == 0
    other.sql("INSERT INTO t VALUES (2)")
    with pytest.raises(RuntimeError, match="another writer"):
        db.sql("COMMIT")
    again = Engine(spark, db.catalog.folder)
    assert got(again.sql("SELECT k FROM t")) == [(2,)]
    again.sql("DELETE FROM t")
    assert again.sql("VACUUM").first()[0] >= 1


def test_catalogue_objects(db):
    db.sql("CREATE DATABASE IF NOT EXISTS d")
    db.sql("CREATE TABLE t (k int)")
    db.sql("CREATE INDEX i ON t USING hash (k)")
    db.sql("CREATE SEQUENCE s START WITH 5 INCREMENT BY -2")
    db.sql("CREATE VIEW v AS SELECT k FROM t")
    with pytest.raises(ValueError, match="CASCADE"):
        db.sql("DROP TABLE t")
    db.sql("DROP TABLE t CASCADE")
    state = db.catalog.now
    assert not state["views"] and not state["indexes"] and state["sequences"]["s"]["increment"] == -2
    db.sql("DROP SEQUENCE s")
    db.sql("DROP TABLE IF EXISTS t")
    db.sql("DROP DATABASE d")
    db.sql("SET TIMEZONE 'UTC'")


def test_parser_extension(spark):
    e = Engine(spark)
    e.add_parser_extension(lambda text: "SELECT 42 AS answer" if text == "ANSWER" else None)
    assert e.sql("ANSWER").first().answer == 42


def test_relations(spark):
    left, right = relation(spark, {"id": [1, 2, 3], "l": ["a", "b", "c"]}), relation(spark, pa.table({"rid": [2, 3, 4], "r": ["x", "y", "z"]}))
    both = left.join(right, ColumnExpression("id") == ColumnExpression("rid")).order(ColumnExpression("id").desc())
    assert both.fetchone() == (3, "c", 3, "y") and both.fetchmany(5) == [(2, "b", 2, "x")]
    pay = relation(spark, pd.DataFrame({"dept": ["a", "a", "b"], "salary": [10, 20, 30]}))
    assert pay.group(["dept"], [ColumnExpression("salary").avg().alias("m"), CountExpression().alias("n")]).order("dept").fetchall() == [("a", 15.0, 2), ("b", 30.0, 1)]
    assert pay.project((ColumnExpression("salary") * 2 + ConstantExpression(1)).alias("x")).fetchall() == [(21,), (41,), (61,)]
    with pytest.raises(TypeError):
        pay.filter("salary > 1")
    with pytest.raises(ValueError):
        pay.project(ColumnExpression("salary").sum())
    assert len(left.cross(right).fetchall()) == 9 and left.limit(2).columns == ["id", "l"]


def test_ingestion(spark, tmp_path):
    frame = pd.DataFrame({"f": [1.0, np.nan], "c": pd.Categorical(["x", "y"]), "t": pd.to_datetime(["2024-01-01", None]), "m": [1, "a"]})
    rows = to_frame(spark, frame).collect()
    assert rows[1].f is None and rows[0].c == "x" and rows[1].t is None and rows[0].m == "1"
    assert to_frame(spark, np.arange(6).reshape(3, 2)).columns == ["column0", "column1"]
    assert to_frame(spark, pd.DataFrame([[1, 2]], columns=["a", "a"])).columns == ["a", "a_1"]
    assert to_frame(spark, [{"a": 1}, {"a": 2}]).count() == 2
    (tmp_path / "d.json").write_text('{"a": {"b": 1, "c": {"d": "x"}}, "e": [1]}\n')
    assert read_documents(spark, f"file://{tmp_path}/d.json").columns == ["a/b", "a/c/d", "e"]


def test_kernels(spark):
    r = kernels.Registry()
    r.add("f", lambda x: x + 1, "long", takes=["bigint"])
    r.add("f", lambda s: s.upper(), "string", takes=["string"])
    df = spark.createDataFrame([(1, "a")], "n long, s string")
    assert tuple(df.select(r.call(df, "f", F.col("n")), r.call(df, "f", F.col("s"))).first()) == (2, "A")
    with pytest.raises(TypeError):
        r.call(df, "f", F.col("n"), F.col("s"))


def test_temporal(spark):
    assert temporal.parse_interval("1 year 2 months 3 days 04:05:06.5") == (14, 3, 14_706_500_000)
    row = spark.range(1).select(
        temporal.date_plus(F.lit("2024-01-31").cast("date"), temporal.interval(months=1)).cast("string"),
        (temporal.sort_key(temporal.interval(months=1)) == temporal.sort_key(temporal.interval(days=30))),
        temporal.scale(temporal.interval(months=3, days=5), 0.5)["months"],
        temporal.time_plus(F.lit(temporal.DAY_US - 1), temporal.interval(us=2)),
        temporal.timetz_key(F.struct(F.lit(7200_000_000).alias("us"), F.lit(3600).alias("zone"))),
    ).first()
    assert tuple(row) == ("2024-02-29", True, 2, 1, 3600_000_000)


def test_compat(spark):
    df = spark.createDataFrame([("a\nb", "héllo", 7, 0), (None, None, None, 2)], "s string, u string, a int, b int")
    out = df.select(compat.like_line(F.col("s"), "a%b"), compat.byte_substring(F.col("u"), 0, 3), compat.byte_length(F.col("u")), compat.divide(F.col("a"), F.col("b"))).collect()
    assert tuple(out[0]) == (False, "hé", 6, None)
    with pytest.raises(ZeroDivisionError):
        compat.divide(F.col("a"), 0)
    assert df.where(compat.not_in(F.col("a"), [1])).count() == 2


def test_stream_state_and_late_rows(spark, tmp_path):
    rows = spark.read.parquet("/root/testdata/sf0.001/events.parquet").repartition(3)
    rows.write.parquet(f"file://{tmp_path}/in")
    stream = streams.read_stream(spark, f"file://{tmp_path}/in", rows.schema)
    out = streams.run_once(streams.running_totals(stream), "totals", "update").groupBy("user_id").agg(F.max("n").alias("n"))
    assert got(out) == got(rows.groupBy("user_id").agg(F.count("*").alias("n")))
    assert streams.run_once(streams.without_repeats(stream, ["event_id"], "60 days"), "once").count() == rows.count()


def test_plans(spark):
    e = Engine(spark).load("/root/testdata/sf0.001", "lineitem", "supplier", "nation")
    scan = e.sql("SELECT l_orderkey FROM lineitem WHERE l_quantity > 45")._jdf.queryExecution().toString()
    assert "GreaterThan(l_quantity,45.0)" in scan and "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in scan
    join = e.sql("SELECT n_name, count(*) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name")._jdf.queryExecution().toString()
    assert "BroadcastHashJoin" in join


def test_connection(spark, tmp_path):
    c = connect(spark, f"file://{tmp_path}/c")
    c.execute("CREATE TABLE t (k int)")
    c.execute("BEGIN")
    c.execute("INSERT INTO t VALUES (1), (2)")
    c.commit()
    assert [tuple(r) for r in c.execute("SELECT k FROM t ORDER BY k")] == [(1,), (2,)]
    assert c.execute("SELECT k FROM t ORDER BY k").fetchmany(1) == [(1,)]


def test_types():
    from skerry.functions import types

    assert types.scalar("ubigint").simpleString() == "decimal(20,0)" and types.scalar("int4[3]").simpleString() == "array<int>"
    assert types.scalar("timestamptz").simpleString() == "timestamp" and types.decimal_type(10, 2).simpleString() == "decimal(10,2)"
    assert types.union_type({"a": types.scalar("int"), "b": types.scalar("text")}).fieldNames() == ["tag", "a", "b"]
    assert types.array_type(types.scalar("int"), 3).metadata == {"length": 3} and types.enum_type(["x"]).metadata["enum"] == ["x"]
    assert types.promote("int2", "int8") == "bigint" and types.promote("hugeint", "float8") == "double"


def test_fixpoint_limit(spark):
    from skerry.operators.recursive import fixpoint

    with pytest.raises(RuntimeError, match="no fixpoint"):
        fixpoint(spark.range(1), lambda new: new.select(F.col("id") + 1), most=3)
