"""Queries built on the DataFrame interfaces: name -> (function, the same in SQL or None)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.functions import kernels, temporal
from skerry.operators import joins, relation
from skerry.plans import compat
from skerry.session import Engine
from skerry.shared import shared_folder
from skerry.streaming import events as streams


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _engine(spark: SparkSession, sf_dir: str, *tables: str) -> Engine:
    """An engine with a catalogue of its own in the shared folder, and the tables as views."""
    return Engine(spark, f"{shared_folder(spark)}/skerry-db-{uuid.uuid4().hex}").load(sf_dir, *tables)


# --- schema-less tables and paths

EVENT_DOCS = "SELECT event_id, named_struct('k', cast(get_json_object(props, '$.k') AS bigint), 'kind', event_type) AS p, value FROM events"


def _docs(spark: SparkSession, sf_dir: str) -> Engine:
    e = _engine(spark, sf_dir, "events")
    e.sql("CREATE TABLE d ()")
    e.sql(f"INSERT INTO d {EVENT_DOCS}")
    return e


def json_nav(spark, sf_dir):
    return _docs(spark, sf_dir).sql("SELECT event_id, d -> 'p' ->> 'k' AS k, d #>> '{p,kind}' AS kind FROM d WHERE d ->> 'p.k' > 50")


def json_expand(spark, sf_dir):
    return _docs(spark, sf_dir).sql("SELECT event_id, d -> 'p' FROM d")


def json_exists(spark, sf_dir):
    return _docs(spark, sf_dir).sql("SELECT count(*) AS n FROM d WHERE d ? 'event_id' AND d ?| array['nothing', 'p.k'] AND d ?& array['p.k', 'p.kind'] AND NOT (d ? 'absent')")


def json_delete(spark, sf_dir):
    return _docs(spark, sf_dir).sql("SELECT d - 'p' FROM d")


def dynamic_insert_evolve(spark, sf_dir):
    e = _engine(spark, sf_dir, "events")
    e.sql("CREATE TABLE t ()")
    e.sql("INSERT INTO t (event_id) SELECT event_id FROM events WHERE event_type = 'view'")
    e.sql("INSERT INTO t (event_id, extra) SELECT event_id, event_type FROM events WHERE event_type <> 'view'")
    return e.sql("SELECT event_id, extra FROM t")


def multitype_variant(spark, sf_dir):
    e = _engine(spark, sf_dir, "events")
    e.sql("CREATE TABLE t ()")
    e.sql("INSERT INTO t (id, val) SELECT event_id, user_id FROM events WHERE event_type = 'click'")
    e.sql("INSERT INTO t (id, val) SELECT event_id, event_type FROM events WHERE event_type <> 'click'")
    return e.sql("SELECT id, val::?bigint AS num, val::?string AS txt FROM t")


# --- changing tables


def _copy(spark, sf_dir) -> Engine:
    e = _engine(spark, sf_dir, "nation", "region", "supplier")
    e.sql("CREATE TABLE n (k int NOT NULL, name text, r int DEFAULT 0)")
    e.sql("INSERT INTO n SELECT n_nationkey, n_name, n_regionkey FROM nation")
    return e


def dml_insert_select(spark, sf_dir):
    e = _copy(spark, sf_dir)
    e.sql("INSERT INTO n (k, name) VALUES (100, 'NEW')")
    e.sql("INSERT INTO n (k, name, r) SELECT n_nationkey + 200, lower(n_name), n_regionkey FROM nation WHERE n_regionkey = 1")
    return e.sql("SELECT k, name, r FROM n")


def dml_update(spark, sf_dir):
    e = _copy(spark, sf_dir)
    e.sql("UPDATE n SET r = r * 10 + 1, name = lower(name) WHERE k % 3 = 0")
    return e.sql("SELECT k, name, r FROM n")


def update_operators(spark, sf_dir):
    e = _copy(spark, sf_dir)
    e.sql("ALTER TABLE n ADD COLUMN x double")
    e.sql("UPDATE n SET x = k ^ 2 + |/ (r + 0.25) + ||/ 27 + @ (r - k), r = (k << 2 | 1) # (k >> 1) & 6 + r !")
    return e.sql("SELECT k, round(x, 6) AS x, r FROM n")


def dml_update_from(spark, sf_dir):
    e = _copy(spark, sf_dir)
    e.sql("UPDATE n SET name = region.r_name FROM region WHERE n.r = region.r_regionkey AND region.r_regionkey < 2")
    return e.sql("SELECT k, name FROM n")


def dml_delete(spark, sf_dir):
    e = _copy(spark, sf_dir)
    e.sql("DELETE FROM n WHERE name LIKE 'A%' OR r IN (SELECT r_regionkey FROM region WHERE r_name = 'ASIA')")
    return e.sql("SELECT k, name FROM n")


def dml_delete_using(spark, sf_dir):
    e = _copy(spark, sf_dir)
    e.sql("DELETE FROM n USING supplier WHERE n.k = supplier.s_nationkey AND supplier.s_acctbal > 5000")
    return e.sql("SELECT k, name FROM n")


def dml_returning(spark, sf_dir):
    return _copy(spark, sf_dir).sql("UPDATE n SET r = r + 5 WHERE k >= 20 RETURNING k, r AS new_r, name")


def dml_insert_returning(spark, sf_dir):
    return _copy(spark, sf_dir).sql("INSERT INTO n (k, name) VALUES (300, 'x'), (301, 'y') RETURNING k, r, upper(name) AS name")


def fk_cascade(spark, sf_dir):
    e = _engine(spark, sf_dir, "nation", "region")
    e.sql("CREATE TABLE p (k int PRIMARY KEY, name text)")
    e.sql("CREATE TABLE c (k int, r int REFERENCES p (k) ON DELETE CASCADE)")
    e.sql("INSERT INTO p SELECT r_regionkey, r_name FROM region")
    e.sql("INSERT INTO c SELECT n_nationkey, n_regionkey FROM nation")
    e.sql("DELETE FROM p WHERE k IN (1, 3)")
    return e.sql("SELECT k, r FROM c")


def fk_set_null(spark, sf_dir):
    e = _engine(spark, sf_dir, "nation", "region")
    e.sql("CREATE TABLE p (k int PRIMARY KEY)")
    e.sql("CREATE TABLE c (k int, r int, FOREIGN KEY (r) REFERENCES p (k) ON DELETE SET NULL)")
    e.sql("INSERT INTO p SELECT r_regionkey FROM region")
    e.sql("INSERT INTO c SELECT n_nationkey, n_regionkey FROM nation")
    e.sql("DELETE FROM p WHERE k = 2")
    return e.sql("SELECT k, r FROM c")


def check_violation(spark, sf_dir):
    """A statement that breaks a check changes nothing."""
    e = _engine(spark, sf_dir, "nation")
    e.sql("CREATE TABLE t (k int, r int CHECK (r >= 1))")
    e.sql("INSERT INTO t SELECT n_nationkey, n_regionkey FROM nation WHERE n_regionkey >= 1")
    try:
        e.sql("INSERT INTO t SELECT n_nationkey, n_regionkey FROM nation")
    except ValueError:
        return e.sql("SELECT count(*) AS n FROM t")
    raise AssertionError("the check did not hold")


def transaction_rollback(spark, sf_dir):
    e = _copy(spark, sf_dir)
    e.sql("BEGIN")
    e.sql("DELETE FROM n WHERE k < 10")
    e.sql("ROLLBACK")
    e.sql("BEGIN")
    e.sql("DELETE FROM n WHERE k >= 20")
    e.sql("COMMIT")
    return e.sql("SELECT count(*) AS n, min(k) AS lo, max(k) AS hi FROM n")


def alter_table(spark, sf_dir):
    e = _copy(spark, sf_dir)
    e.sql("ALTER TABLE n ADD COLUMN extra text DEFAULT 'none'")
    e.sql("ALTER TABLE n RENAME COLUMN name TO title")
    e.sql("ALTER TABLE n DROP COLUMN r")
    return e.sql("SELECT k, title, extra FROM n")


def view(spark, sf_dir):
    e = _copy(spark, sf_dir)
    e.sql("CREATE VIEW v AS SELECT k, r FROM n WHERE r > 1")
    e.sql("CREATE VIEW w AS SELECT r, count(*) AS n FROM v GROUP BY r")
    return e.sql("SELECT r, n FROM w WHERE n > 1")


def matview(spark, sf_dir):
    e = _copy(spark, sf_dir)
    e.sql("CREATE MATERIALIZED VIEW m AS SELECT r, count(*) AS n FROM n GROUP BY r")
    e.sql("DELETE FROM n WHERE r = 0")
    before = e.sql("SELECT count(*) AS before FROM m").first()[0]
    e.sql("REFRESH MATERIALIZED VIEW m")
    return e.sql(f"SELECT r, n, cast({before} AS bigint) AS before FROM m")


def enum_order(spark, sf_dir):
    orders = _t(spark, sf_dir, "orders")
    rank = temporal.enum_key(F.col("o_orderstatus"), ["P", "O", "F"])
    return orders.select("o_orderkey", "o_orderstatus").orderBy(rank, "o_orderkey")


# --- functions


def udf_scalar(spark, sf_dir):
    e = _engine(spark, sf_dir, "nation")
    e.register_udf("plus_tax", lambda x: None if x is None else x * 100 + 19, "long")
    return e.sql("SELECT n_nationkey, plus_tax(n_regionkey) AS taxed FROM nation")


def udf_vector(spark, sf_dir):
    e = _engine(spark, sf_dir, "part")
    e.register_udf("halved", lambda s: s // 2, "long", "vector")
    return e.sql("SELECT p_partkey, halved(p_size) AS half FROM part WHERE halved(p_size) > 10")


def udaf_grouped(spark, sf_dir):
    """A range (largest less smallest) with a state that merges."""
    spread = kernels.Aggregate(lambda: None, lambda s, x: [min(x.min(), s[0]), max(x.max(), s[1])] if s is not None else [x.min(), x.max()], lambda a, b: list(b) if a is None else [min(a[0], b[0]), max(a[1], b[1])], lambda s: int(s[1] - s[0]), "array<int>", "long")
    return spread.apply(_t(spark, sf_dir, "part"), ["p_brand"], "p_size", "spread")


def udtf(spark, sf_dir):
    class Steps:
        def eval(self, n: int):
            for i in range(n):
                yield (i,)

    spark.udtf.register("steps", F.udtf(Steps, returnType="i int"))
    _t(spark, sf_dir, "nation").createOrReplaceTempView("nation")
    return spark.sql("SELECT n_nationkey, i FROM nation, LATERAL steps(n_regionkey)")


def sql_macro(spark, sf_dir):
    e = _engine(spark, sf_dir, "nation")
    e.sql("CREATE FUNCTION twice(x bigint) AS 'x * 2'")
    return e.sql("SELECT n_nationkey, twice(n_regionkey) AS t FROM nation")


# --- relations, parameters, quirks


def relation_query(spark, sf_dir):
    c, count = relation.ColumnExpression, relation.CountExpression
    orders, customers = (relation.relation(spark, _t(spark, sf_dir, t)) for t in ("orders", "customer"))
    joined = orders.filter(c("o_totalprice") > 100000).join(customers, c("o_custkey") == c("c_custkey"))
    return joined.group(["c_mktsegment"], [count().alias("n"), c("o_orderkey").max().alias("hi")]).order("c_mktsegment").frame


def parameters(spark, sf_dir):
    return Engine(spark).load(sf_dir, "orders").sql("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey BETWEEN $1 AND $2 AND o_orderstatus <> $3", [100, 400, "P"])


def compat_not_equal(spark, sf_dir):
    """Two-valued logic: NOT (x = 5) keeps nulls."""
    rows = _t(spark, sf_dir, "orders").select("o_orderkey", F.nullif("o_orderstatus", F.lit("F")).alias("s"))
    return rows.where(~compat.two_valued(F.col("s") == "O")).select("o_orderkey", F.coalesce("s", F.lit("-")).alias("s"))


def compat_integer_average(spark, sf_dir):
    return _t(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(compat.avg_as(F.col("l_linenumber"), "int").alias("a"), compat.sum_as(F.col("l_linenumber"), "int").cast("long").alias("s"))


def compat_bytes(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents")
    return docs.select("doc_id", compat.byte_length(F.col("text")).alias("bytes"))


def interval_compare(spark, sf_dir):
    """1 month = 30 days; parts add up on their own."""
    n = _t(spark, sf_dir, "nation")
    i = temporal.add(temporal.interval(months=F.col("n_regionkey")), temporal.interval(days=F.col("n_nationkey")))
    return n.select("n_nationkey", (temporal.sort_key(i) / temporal.DAY_US).cast("long").alias("days"), (temporal.sort_key(i) > temporal.sort_key(temporal.interval(months=1))).alias("over_a_month"))


def time_arithmetic(spark, sf_dir):
    n = _t(spark, sf_dir, "nation")
    return n.select("n_nationkey", temporal.time_plus(F.col("n_nationkey").cast("long") * 3_600_000_000, temporal.interval(us=3_600_000_000 * 5)).alias("us"))


def timestamp_months(spark, sf_dir):
    e = _t(spark, sf_dir, "events")
    return e.select("event_id", temporal.timestamp_plus(F.col("ts"), temporal.interval(months=1, days=2, us=1_500_000)).alias("later"))


# --- order and time


def asof_join(spark, sf_dir):
    e = _t(spark, sf_dir, "events")
    left = e.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    right = e.where("event_type = 'view'").select("user_id", F.col("ts").alias("seen"), F.col("value").alias("last_value"))
    return joins.asof_join(left, right, ["user_id"], "ts", "seen", ["last_value"]).select("event_id", "user_id", "last_value")


def range_join(spark, sf_dir):
    points = _t(spark, sf_dir, "part").select("p_partkey", F.col("p_retailprice").alias("price"))
    bands = _t(spark, sf_dir, "nation").select("n_nationkey", (F.lit(900.0) + F.col("n_nationkey") * 40).alias("lo"), (F.lit(1000.0) + F.col("n_nationkey") * 40).alias("hi"))
    return joins.range_join(points, bands, F.col("price"), F.col("lo"), F.col("hi"), 100.0).select("p_partkey", "n_nationkey")


def win_sliding(spark, sf_dir):
    return streams.sliding(_t(spark, sf_dir, "events"))


def win_session(spark, sf_dir):
    return streams.sessions(_t(spark, sf_dir, "events"), "12 hours")


def stream_tumbling(spark, sf_dir):
    """The tumbling windows again, as a stream over the file, complete at its end."""
    table = _t(spark, sf_dir, "events")
    folder = spark.readStream.schema(table.schema).option("pathGlobFilter", "events*.parquet").parquet(sf_dir)
    return streams.run_once(streams.tumbling(folder), f"tumbling_{uuid.uuid4().hex}", "complete")


def distinct_on(spark, sf_dir):
    from pyspark.sql import Window

    first = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return _t(spark, sf_dir, "orders").withColumn("rn", F.row_number().over(first)).where("rn = 1").select("o_custkey", "o_orderkey")


def cte_recursive_union(spark, sf_dir):
    """Reachable nations in a graph with cycles: each goes to (7 k + 3) mod 25 and (k + 5) mod 25."""
    from skerry.operators.recursive import fixpoint

    edges = _t(spark, sf_dir, "nation").select("n_nationkey", F.explode(F.array((F.col("n_nationkey") * 7 + 3) % 25, (F.col("n_nationkey") + 5) % 25)).alias("to"))
    start = spark.createDataFrame([(4,)], "k int")
    return fixpoint(start, lambda new: new.join(edges, new["k"] == edges["n_nationkey"]).select("to"))


N = "(SELECT n_nationkey AS k, n_name AS name, n_regionkey AS r FROM nation)"
DOCS = "(SELECT event_id, cast(props ->> '$.k' AS bigint) AS k, event_type AS kind, value FROM events)"

QUERIES = {
    "cte_recursive_union": (cte_recursive_union, "WITH RECURSIVE t(k) AS (SELECT 4 UNION SELECT unnest([(k * 7 + 3) % 25, (k + 5) % 25]) FROM t) SELECT k FROM t"),
    "json_nav": (json_nav, f"SELECT event_id, k, kind FROM {DOCS} d WHERE k > 50"),
    "json_expand": (json_expand, f"SELECT event_id, k, kind FROM {DOCS} d"),
    "json_exists": (json_exists, f"SELECT count(*) AS n FROM {DOCS} d WHERE k IS NOT NULL"),
    "json_delete": (json_delete, "SELECT event_id, value FROM events"),
    "dynamic_insert_evolve": (dynamic_insert_evolve, "SELECT event_id, nullif(event_type, 'view') AS extra FROM events"),
    "multitype_variant": (multitype_variant, "SELECT event_id AS id, CASE WHEN event_type = 'click' THEN user_id END AS num, nullif(event_type, 'click') AS txt FROM events"),
    "dml_insert_select": (dml_insert_select, f"SELECT * FROM {N} n UNION ALL SELECT 100, 'NEW', 0 UNION ALL SELECT k + 200, lower(name), r FROM {N} n WHERE r = 1"),
    "dml_update": (dml_update, f"SELECT k, CASE WHEN k % 3 = 0 THEN lower(name) ELSE name END AS name, CASE WHEN k % 3 = 0 THEN r * 10 + 1 ELSE r END AS r FROM {N} n"),
    "update_operators": (update_operators, f"SELECT k, round(power(k, 2) + sqrt(r + 0.25) + 3 + abs(r - k), 6) AS x, cast(xor((k << 2) | 1, (k >> 1) & (6 + factorial(r::int))) AS int) AS r FROM {N} n"),
    "dml_update_from": (dml_update_from, f"SELECT k, coalesce(r_name, name) AS name FROM {N} n LEFT JOIN region ON r = r_regionkey AND r_regionkey < 2"),
    "dml_delete": (dml_delete, f"SELECT k, name FROM {N} n WHERE NOT (name LIKE 'A%' OR r IN (SELECT r_regionkey FROM region WHERE r_name = 'ASIA'))"),
    "dml_delete_using": (dml_delete_using, f"SELECT k, name FROM {N} n WHERE k NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000)"),
    "dml_returning": (dml_returning, f"SELECT k, r + 5 AS new_r, name FROM {N} n WHERE k >= 20"),
    "dml_insert_returning": (dml_insert_returning, "SELECT * FROM (VALUES (300, 0, 'X'), (301, 0, 'Y')) t(k, r, name)"),
    "fk_cascade": (fk_cascade, f"SELECT k, r FROM {N} n WHERE r NOT IN (1, 3)"),
    "fk_set_null": (fk_set_null, f"SELECT k, nullif(r, 2) AS r FROM {N} n"),
    "check_violation": (check_violation, f"SELECT count(*) AS n FROM {N} n WHERE r >= 1"),
    "transaction_rollback": (transaction_rollback, f"SELECT count(*) AS n, min(k) AS lo, max(k) AS hi FROM {N} n WHERE k < 20"),
    "alter_table": (alter_table, f"SELECT k, name AS title, 'none' AS extra FROM {N} n"),
    "view": (view, f"SELECT r, count(*) AS n FROM {N} n WHERE r > 1 GROUP BY r HAVING count(*) > 1"),
    "matview": (matview, f"SELECT r, count(*) AS n, (SELECT count(DISTINCT r) FROM {N} n) AS before FROM {N} n WHERE r <> 0 GROUP BY r"),
    "enum_order": (enum_order, "SELECT o_orderkey, o_orderstatus FROM orders ORDER BY CASE o_orderstatus WHEN 'P' THEN 1 WHEN 'O' THEN 2 ELSE 3 END, o_orderkey"),
    "udf_scalar": (udf_scalar, "SELECT n_nationkey, cast(n_regionkey * 100 + 19 AS bigint) AS taxed FROM nation"),
    "udf_vector": (udf_vector, "SELECT p_partkey, cast(p_size // 2 AS bigint) AS half FROM part WHERE p_size // 2 > 10"),
    "udaf_grouped": (udaf_grouped, "SELECT p_brand, cast(max(p_size) - min(p_size) AS bigint) AS spread FROM part GROUP BY p_brand"),
    "udtf": (udtf, "SELECT n_nationkey, cast(i AS int) AS i FROM nation, LATERAL (SELECT unnest(range(n_regionkey)) AS i) t"),
    "sql_macro": (sql_macro, "SELECT n_nationkey, cast(n_regionkey * 2 AS bigint) AS t FROM nation"),
    "relation_query": (relation_query, "SELECT c_mktsegment, count(*) AS n, max(o_orderkey) AS hi FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 100000 GROUP BY c_mktsegment"),
    "parameters": (parameters, "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey BETWEEN 100 AND 400 AND o_orderstatus <> 'P'"),
    "compat_not_equal": (compat_not_equal, "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN '-' ELSE o_orderstatus END AS s FROM orders WHERE o_orderstatus <> 'O'"),
    "compat_integer_average": (compat_integer_average, "SELECT l_returnflag, cast(floor(avg(l_linenumber)) AS int) AS a, cast(sum(l_linenumber) AS bigint) AS s FROM lineitem GROUP BY l_returnflag"),
    "compat_bytes": (compat_bytes, "SELECT doc_id, strlen(text) AS bytes FROM documents"),
    "interval_compare": (interval_compare, "SELECT n_nationkey, cast(n_regionkey * 30 + n_nationkey AS bigint) AS days, n_regionkey * 30 + n_nationkey > 30 AS over_a_month FROM nation"),
    "time_arithmetic": (time_arithmetic, "SELECT n_nationkey, cast((n_nationkey + 5) % 24 AS bigint) * 3600000000 AS us FROM nation"),
    "timestamp_months": (timestamp_months, "SELECT event_id, ts + INTERVAL 1 MONTH + INTERVAL 2 DAY + INTERVAL 1500 MILLISECOND AS later FROM events"),
    "asof_join": (asof_join, "SELECT l.event_id, l.user_id, r.value AS last_value FROM (SELECT * FROM events WHERE event_type = 'purchase') l ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') r ON l.user_id = r.user_id AND l.ts >= r.ts"),
    "range_join": (range_join, "SELECT p_partkey, n_nationkey FROM part JOIN nation ON p_retailprice >= 900 + n_nationkey * 40 AND p_retailprice < 1000 + n_nationkey * 40"),
    "win_sliding": (win_sliding, "SELECT w_start, event_type, count(*) AS n FROM (SELECT event_type, date_trunc('hour', ts) - unnest([INTERVAL 0 HOUR, INTERVAL 1 HOUR]) AS w_start FROM events) t GROUP BY ALL"),
    "win_session": (win_session, "SELECT user_id, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS new FROM events) a) b GROUP BY user_id, s"),
    "stream_tumbling": (stream_tumbling, "SELECT date_trunc('hour', ts) AS w_start, event_type, count(*) AS n FROM events GROUP BY ALL"),
    "distinct_on": (distinct_on, "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey FROM orders ORDER BY o_custkey, o_orderdate, o_orderkey"),
}
