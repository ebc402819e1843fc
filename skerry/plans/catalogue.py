"""Named queries over the tables of a folder, each with the same query in SQL.

A query is given as SQL text that both engines read alike, as a pair of texts
where the dialects differ, or as a function on DataFrames with its SQL. Sums
of money are taken in whole cents, so that no result hangs on the order of addition.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from skerry.plans import frames
from skerry.session import Engine

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

# Money in whole cents and rates in whole percent: sums are exact whatever their order, and stay in generated code.
CENTS = "cast(round(l_extendedprice * 100) AS bigint)"
OFF = "cast(round(l_discount * 100) AS bigint)"
NET = f"{CENTS} * (100 - {OFF})"
YEAR = "extract(year FROM l_shipdate)"


def money(of: str, parts: int) -> str:
    return f"cast(sum({of}) AS double) / {parts}.0"



SAME = {
    # scans, filters, projections
    "scan_filter_project": "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity >= 45 AND l_returnflag = 'R'",
    "scan_no_from": "SELECT 1 AS one, 'x' AS name, cast(NULL AS int) AS nothing",
    "values_rows": "SELECT a, b FROM (VALUES (1, 'one'), (2, 'two'), (3, NULL)) AS v(a, b)",
    "point_lookup": "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderkey = 7",
    "range_lookup": "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey BETWEEN 100 AND 200",
    "predicates_in_between_like": "SELECT p_partkey, p_name FROM part WHERE p_size BETWEEN 5 AND 25 AND p_brand IN ('Brand#11', 'Brand#22', 'Brand#33') AND p_name NOT LIKE '%zzz%'",
    "predicates_not_in_list": "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey NOT IN (1, 3)",
    "predicates_compare": "SELECT c_custkey FROM customer WHERE (c_acctbal <> 0 AND c_acctbal < 1000) OR (NOT (c_nationkey <= 20) AND c_acctbal >= 9000)",
    "between_symmetric": ("SELECT p_partkey FROM part WHERE p_size + 1 BETWEEN SYMMETRIC 30 AND 10 AND NOT p_size NOT BETWEEN SYMMETRIC 40 AND p_partkey % 7", "SELECT p_partkey FROM part WHERE p_size + 1 BETWEEN least(30, 10) AND greatest(30, 10) AND p_size BETWEEN least(40, p_partkey % 7) AND greatest(40, p_partkey % 7)"),
    "null_tests": "SELECT count(*) AS n_rows, count(x) AS n_known, sum(CASE WHEN x IS NULL THEN 1 ELSE 0 END) AS n_null FROM (SELECT nullif(l_returnflag, 'N') AS x FROM lineitem) t",
    "case_when": "SELECT l_returnflag, CASE WHEN l_quantity < 10 THEN 'low' WHEN l_quantity < 30 THEN 'mid' ELSE 'high' END AS band, count(*) AS n FROM lineitem GROUP BY 1, 2",
    "case_simple": "SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 1 WHEN 'F' THEN 2 END AS code FROM orders",
    "coalesce": "SELECT o_orderkey, coalesce(nullif(o_orderstatus, 'O'), 'open') AS status FROM orders",
    "greatest_least": "SELECT l_orderkey, l_linenumber, greatest(l_quantity, 25.0) AS g, least(l_discount, l_tax) AS l FROM lineitem",
    "arithmetic_int_div_mod": ("SELECT o_orderkey, o_orderkey div 7 AS q, o_orderkey % 7 AS r, -o_orderkey AS neg, o_orderkey * 3 - 5 AS lin FROM orders", "SELECT o_orderkey, o_orderkey // 7 AS q, o_orderkey % 7 AS r, -o_orderkey AS neg, o_orderkey * 3 - 5 AS lin FROM orders"),
    "divide_by_zero_column": ("SELECT l_orderkey, l_linenumber, try_divide(l_linenumber, l_linenumber - 1) AS ratio FROM lineitem", "SELECT l_orderkey, l_linenumber, l_linenumber / nullif(l_linenumber - 1, 0) AS ratio FROM lineitem"),
    "math_functions": "SELECT p_partkey, ceil(p_retailprice) * 1.0e0 AS up, floor(p_retailprice) * 1.0e0 AS down, abs(p_size - 25) AS off, sqrt(cast(p_size AS double)) AS root FROM part",
    "bit_operations": ("SELECT p_partkey, p_partkey & 6 AS a, p_partkey | 9 AS o, p_partkey ^ 5 AS x, shiftleft(p_partkey, 2) AS l, shiftright(p_partkey, 1) AS r, ~p_partkey AS inv FROM part", "SELECT p_partkey, p_partkey & 6 AS a, p_partkey | 9 AS o, xor(p_partkey, 5) AS x, p_partkey << 2 AS l, p_partkey >> 1 AS r, ~p_partkey AS inv FROM part"),
    # strings
    "string_substring_length_regexp": ("SELECT p_partkey, substring(p_name, greatest(-2, 1), 5) AS head, octet_length(p_name) * 1L AS bytes, regexp_replace(p_name, '([aeiou])', '<$1>') AS marked FROM part", "SELECT p_partkey, substring(p_name, greatest(-2, 1), 5) AS head, strlen(p_name) AS bytes, regexp_replace(p_name, '([aeiou])', '<\\1>', 'g') AS marked FROM part"),
    "like_regexp_docs": ("SELECT doc_id, char_length(text) * 1L AS n, octet_length(text) * 1L AS bytes FROM documents WHERE text LIKE '%the%' AND text RLIKE '[0-9]{3}'", "SELECT doc_id, length(text) AS n, strlen(text) AS bytes FROM documents WHERE text LIKE '%the%' AND regexp_matches(text, '[0-9]{3}')"),
    "string_functions": "SELECT n_name, lower(n_name) AS low, upper(n_name) AS up, replace(n_name, 'A', 'a') AS swapped, concat(n_name, '-', n_regionkey) AS joined, trim(concat('  ', n_name, ' ')) AS trimmed FROM nation",
    "ilike": "SELECT count(*) AS n FROM part WHERE p_name ILIKE '%A%'",
    # joins
    "join_inner": "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'",
    "join_left": "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'F' GROUP BY c_custkey",
    "join_right": "SELECT n_name, count(s_suppkey) AS n FROM supplier RIGHT JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name",
    "join_full": "SELECT coalesce(a.k, -1) AS a_key, coalesce(b.k, -1) AS b_key, count(*) AS n FROM (SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 8000) a FULL JOIN (SELECT s_nationkey AS k FROM supplier WHERE s_acctbal < 4000) b ON a.k = b.k GROUP BY 1, 2",
    "join_cross": "SELECT r_name, n_name FROM region CROSS JOIN nation",
    "join_theta": "SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey",
    "join_multi_key": "SELECT a.l_orderkey, a.l_linenumber FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber + 1 WHERE a.l_quantity > b.l_quantity",
    "join_self": "SELECT a.n_name AS one, b.n_name AS other FROM nation a, nation b WHERE a.n_regionkey = b.n_regionkey AND a.n_name < b.n_name",
    "join_null_keys": "SELECT a.k AS k, b.v AS v FROM (SELECT nullif(n_regionkey, 2) AS k FROM nation) a LEFT JOIN (SELECT nullif(r_regionkey, 2) AS k, r_name AS v FROM region) b ON a.k = b.k",
    "join_using": "SELECT n_regionkey AS k, count(*) AS n FROM nation JOIN (SELECT DISTINCT n_regionkey FROM nation WHERE n_nationkey > 10) t USING (n_regionkey) GROUP BY n_regionkey",
    "join_three_way_agg": f"SELECT n_name, {money(CENTS, 100)} AS price, count(*) AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name",
    "semi_join": "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)",
    "anti_join": "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)",
    # aggregates
    "agg_groupby": "SELECT o_orderstatus, o_orderpriority, count(*) AS n, min(o_orderkey) AS lo, max(o_orderkey) AS hi FROM orders GROUP BY o_orderstatus, o_orderpriority",
    "agg_global": "SELECT count(*) AS n, min(l_shipdate) AS first_ship, max(l_shipdate) AS last_ship, cast(sum(l_linenumber) AS bigint) AS s, avg(l_linenumber) AS a FROM lineitem",
    "agg_empty_input": "SELECT count(*) AS n, cast(sum(l_linenumber) AS bigint) AS s, max(l_quantity) AS m FROM lineitem WHERE l_quantity < 0",
    "agg_count_distinct": "SELECT l_returnflag, count(DISTINCT l_suppkey) AS n_supp, cast(sum(DISTINCT l_linenumber) AS bigint) AS s_line FROM lineitem GROUP BY l_returnflag",
    "agg_sum_case": "SELECT o_orderpriority, cast(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS bigint) AS done, count(*) AS n FROM orders GROUP BY o_orderpriority",
    "agg_expr_arith": f"SELECT l_returnflag, {money(NET, 10000)} AS net, cast(sum(l_linenumber) + max(l_linenumber) AS bigint) AS mixed FROM lineitem GROUP BY l_returnflag",
    "agg_filter_clause": "SELECT o_orderstatus, count(*) FILTER (WHERE o_orderkey % 2 = 0) AS even FROM orders GROUP BY o_orderstatus",
    "having": "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 15",
    "having_hidden_agg": "SELECT o_custkey FROM orders GROUP BY o_custkey HAVING max(o_totalprice) > 400000 AND count(DISTINCT o_orderpriority) = 5",
    "cube": "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)",
    "rollup": "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)",
    "grouping_sets": "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())",
    "agg_statistics": "SELECT l_returnflag, round(stddev_samp(l_quantity), 4) AS sd, round(var_pop(l_quantity), 4) AS vp FROM lineitem GROUP BY l_returnflag",
    # order, limits, sets, CTEs
    "sort_nulls": "SELECT k, n FROM (SELECT nullif(o_orderstatus, 'O') AS k, o_orderkey AS n FROM orders) t ORDER BY k DESC NULLS FIRST, n",
    "sort_expr": "SELECT p_partkey, p_size FROM part ORDER BY p_size % 7, p_partkey",
    "topk": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10",
    "limit_offset": "SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 10 OFFSET 20",
    "distinct": "SELECT DISTINCT p_brand, p_size FROM part WHERE p_size < 10",
    "union_all": "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier",
    "union_distinct": "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier",
    "intersect": "SELECT l_partkey AS k FROM lineitem WHERE l_quantity > 40 INTERSECT SELECT p_partkey FROM part WHERE p_size < 10",
    "except": "SELECT p_partkey AS k FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 45",
    "cte": "WITH big AS (SELECT o_custkey, o_totalprice FROM orders WHERE o_totalprice > 200000), per AS (SELECT o_custkey, count(*) AS n FROM big GROUP BY o_custkey) SELECT c_name, n FROM per JOIN customer ON c_custkey = o_custkey",
    "cte_recursive": "WITH RECURSIVE t(n, f) AS (SELECT cast(1 AS bigint), cast(1 AS bigint) UNION ALL SELECT n + 1, f * (n + 1) FROM t WHERE n < 15) SELECT n, f FROM t",
    "cte_recursive_join": "WITH RECURSIVE up(k, depth) AS (SELECT n_nationkey, 0 FROM nation WHERE n_nationkey = 24 UNION ALL SELECT n.n_nationkey, depth + 1 FROM up JOIN nation n ON n.n_nationkey = k - 5) SELECT k, depth FROM up",
    # subqueries
    "subq_scalar": "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.5 FROM orders)",
    "subq_scalar_having": "SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY l_suppkey HAVING count(*) > (SELECT count(*) / 100 FROM lineitem)",
    "subq_exists": "SELECT n_name FROM nation WHERE EXISTS (SELECT 1 FROM region WHERE r_name = 'ASIA')",
    "subq_not_exists": "SELECT n_name FROM nation WHERE NOT EXISTS (SELECT 1 FROM region WHERE r_name = 'NOWHERE')",
    "subq_in": "SELECT s_suppkey FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)",
    "subq_not_in": "SELECT s_suppkey FROM supplier WHERE s_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 3)",
    "subq_any": "SELECT p_partkey FROM part WHERE p_retailprice < ANY (SELECT p_retailprice FROM part WHERE p_size = 1)",
    "subq_all": "SELECT p_partkey FROM part WHERE p_retailprice >= ALL (SELECT p_retailprice FROM part WHERE p_size = 1)",
    "subq_all_empty": "SELECT count(*) AS n FROM part WHERE p_size > ALL (SELECT p_size FROM part WHERE p_size < 0)",
    "subq_any_equal": "SELECT n_name FROM nation WHERE n_regionkey = ANY (SELECT r_regionkey FROM region WHERE r_name LIKE 'A%')",
    "subq_from": "SELECT k % 10 AS digit, count(*) AS n FROM (SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'P') AS sub GROUP BY 1",
    "subq_correlated": "SELECT o.o_orderkey FROM orders o WHERE o.o_totalprice = (SELECT max(i.o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)",
    # dates, arrays, structs
    "date_add_interval": "SELECT o_orderkey, cast(cast(o_orderdate AS date) + INTERVAL 40 DAY AS date) AS due, cast(cast(o_orderdate AS date) - INTERVAL 1 MONTH AS date) AS before FROM orders",
    "date_diff": ("SELECT l_orderkey, l_linenumber, cast(datediff(l_shipdate, o_orderdate) AS bigint) AS days FROM lineitem JOIN orders ON l_orderkey = o_orderkey", "SELECT l_orderkey, l_linenumber, cast(l_shipdate AS date) - cast(o_orderdate AS date) AS days FROM lineitem JOIN orders ON l_orderkey = o_orderkey"),
    "ts_interval": "SELECT event_id, ts + INTERVAL 90 MINUTE AS later, ts - INTERVAL 2 DAY AS sooner FROM events",
    "month_clamp": "SELECT cast(DATE '2024-01-31' + INTERVAL 1 MONTH AS date) AS feb, cast(DATE '2023-01-31' + INTERVAL 1 MONTH AS date) AS feb_short, cast(DATE '2024-03-31' - INTERVAL 1 MONTH AS date) AS back",
    "date_parts": "SELECT extract(year FROM o_orderdate) * 1 AS y, extract(month FROM o_orderdate) * 1 AS m, count(*) AS n FROM orders GROUP BY 1, 2",
    "array_subscript": ("SELECT vec_id, round(embedding[1], 5) AS first, cardinality(embedding) AS n FROM embeddings", "SELECT vec_id, round(cast(embedding[1] AS double), 5) AS first, cast(len(embedding) AS int) AS n FROM embeddings"),
    "array_literal": ("SELECT n_nationkey, ARRAY[n_nationkey, n_regionkey, 7][2] AS second FROM nation", "SELECT n_nationkey, [n_nationkey, n_regionkey, 7][2] AS second FROM nation"),
    "array_unnest": ("SELECT n_nationkey, v FROM nation LATERAL VIEW explode(array(n_nationkey, n_regionkey * 10)) e AS v", "SELECT n_nationkey, unnest([n_nationkey, n_regionkey * 10]) AS v FROM nation"),
    "struct_field": ("SELECT n_nationkey, s.name AS name, s.k + 1 AS next FROM (SELECT n_nationkey, named_struct('name', n_name, 'k', n_regionkey) AS s FROM nation) t", "SELECT n_nationkey, s.name AS name, s.k + 1 AS next FROM (SELECT n_nationkey, {'name': n_name, 'k': n_regionkey} AS s FROM nation) t"),
    "json_nav_text": ("SELECT event_id, get_json_object(props, '$.k') AS k FROM events", "SELECT event_id, props ->> '$.k' AS k FROM events"),
    # windows
    "window_rank": "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS dr FROM orders",
    "window_frame": "SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS n, max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS top FROM events",
    "window_lag_lead": "SELECT event_id, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next FROM events",
    "win_tumbling": ("SELECT date_trunc('hour', ts) AS w, event_type, count(*) AS n FROM events GROUP BY 1, 2",) * 2,
    # workloads
    "tpch_q1": f"""SELECT l_returnflag, l_linestatus, cast(sum(cast(l_quantity AS bigint)) AS double) AS sum_qty, {money(CENTS, 100)} AS sum_base, {money(NET, 10000)} AS sum_disc,
        {money(f"{NET} * (100 + cast(round(l_tax * 100) AS bigint))", 1000000)} AS sum_charge, count(*) AS n
        FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus""",
    "tpch_q3": f"""SELECT l_orderkey, {money(NET, 10000)} AS revenue, o_orderdate
        FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
        WHERE c_mktsegment = 'BUILDING' AND o_orderdate < TIMESTAMP '1996-03-15 00:00:00' AND l_shipdate > TIMESTAMP '1996-03-15 00:00:00'
        GROUP BY l_orderkey, o_orderdate ORDER BY revenue DESC, l_orderkey LIMIT 10""",
    "tpch_q5": f"""SELECT n_name, {money(NET, 10000)} AS revenue
        FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey
        JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
        WHERE r_name = 'ASIA' AND o_orderdate >= TIMESTAMP '1996-01-01 00:00:00' AND o_orderdate < TIMESTAMP '1997-01-01 00:00:00' GROUP BY n_name""",
    "tpch_q6": f"""SELECT {money(f"{CENTS} * {OFF}", 10000)} AS revenue FROM lineitem
        WHERE l_shipdate >= TIMESTAMP '1996-01-01 00:00:00' AND l_shipdate < TIMESTAMP '1997-01-01 00:00:00' AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24""",
    "tpch_q7": f"""SELECT n1.n_name AS supp_nation, n2.n_name AS cust_nation, {YEAR} * 1 AS l_year, {money(NET, 10000)} AS revenue
        FROM supplier JOIN lineitem ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey
        JOIN nation n1 ON s_nationkey = n1.n_nationkey JOIN nation n2 ON c_nationkey = n2.n_nationkey
        WHERE n1.n_regionkey = 2 AND n2.n_regionkey = 3 AND l_shipdate BETWEEN TIMESTAMP '1995-01-01 00:00:00' AND TIMESTAMP '1996-12-31 00:00:00' GROUP BY 1, 2, 3""",
    "tpch_q8": f"""SELECT extract(year FROM o_orderdate) * 1 AS o_year, cast(sum(CASE WHEN n2.n_regionkey = 1 THEN {NET} ELSE 0 END) AS double) / cast(sum({NET}) AS double) AS share
        FROM part JOIN lineitem ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey
        JOIN nation n1 ON c_nationkey = n1.n_nationkey JOIN region ON n1.n_regionkey = r_regionkey JOIN nation n2 ON s_nationkey = n2.n_nationkey
        WHERE r_name = 'AMERICA' AND p_size < 20 GROUP BY 1""",
    "tpch_q10": f"""SELECT c_custkey, c_name, {money(NET, 10000)} AS revenue, n_name
        FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN nation ON c_nationkey = n_nationkey
        WHERE l_returnflag = 'R' AND o_orderdate >= TIMESTAMP '1996-10-01 00:00:00' AND o_orderdate < TIMESTAMP '1997-01-01 00:00:00'
        GROUP BY c_custkey, c_name, n_name ORDER BY revenue DESC, c_custkey LIMIT 20""",
    "late_lines_by_priority": """SELECT o_orderpriority, count(*) AS n, cast(sum(CASE WHEN l_shipdate > o_orderdate THEN 1 ELSE 0 END) AS bigint) AS late
        FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderpriority""",
    "tpch_q14": f"""SELECT {money(f"CASE WHEN p_type LIKE 'PROMO%' THEN {NET} ELSE 0 END", 10000)} AS promo, {money(NET, 10000)} AS total
        FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_shipdate >= TIMESTAMP '1996-09-01 00:00:00' AND l_shipdate < TIMESTAMP '1996-10-01 00:00:00'""",
    "tpch_q15": f"""WITH revenue AS (SELECT l_suppkey AS k, sum({NET}) AS total FROM lineitem
            WHERE l_shipdate >= TIMESTAMP '1996-01-01 00:00:00' AND l_shipdate < TIMESTAMP '1996-04-01 00:00:00' GROUP BY l_suppkey)
        SELECT s_suppkey, s_name, cast(total AS double) / 10000.0 AS total FROM supplier JOIN revenue ON s_suppkey = k WHERE total = (SELECT max(total) FROM revenue)""",
    "tpch_q18": """SELECT o_orderkey, o_custkey, o_orderdate, o_totalprice, qty
        FROM (SELECT l_orderkey AS k, cast(sum(cast(l_quantity AS bigint)) AS double) AS qty FROM lineitem GROUP BY l_orderkey HAVING sum(cast(l_quantity AS bigint)) > 250) big
        JOIN orders ON o_orderkey = k ORDER BY o_totalprice DESC, o_orderkey LIMIT 100""",
    "ssb_q1": f"""SELECT {money(f"{CENTS} * {OFF}", 10000)} AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey
        WHERE extract(year FROM o_orderdate) = 1996 AND l_discount BETWEEN 0.01 AND 0.03 AND l_quantity < 25""",
    "ssb_q2": f"""SELECT extract(year FROM o_orderdate) * 1 AS d_year, p_brand, {money(CENTS, 100)} AS revenue
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
        JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'AMERICA' AND p_brand LIKE 'Brand#1%' GROUP BY 1, 2""",
    "ssb_q3": f"""SELECT cn.n_name AS c_nation, sn.n_name AS s_nation, extract(year FROM o_orderdate) * 1 AS d_year, {money(CENTS, 100)} AS revenue
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
        JOIN nation cn ON c_nationkey = cn.n_nationkey JOIN nation sn ON s_nationkey = sn.n_nationkey
        WHERE cn.n_regionkey = 2 AND sn.n_regionkey = 2 GROUP BY 1, 2, 3""",
    # comparisons with subqueries under NOT, with nulls and with expressions on the left
    "subq_any_not_null": ("SELECT n_nationkey FROM nation WHERE NOT (nullif(n_regionkey, 2) > ANY (SELECT r_regionkey FROM region))", "SELECT n_nationkey FROM nation WHERE NOT (nullif(n_regionkey, 2) > (SELECT min(r_regionkey) FROM region))"),
    "subq_any_expression": ("SELECT p_partkey FROM part WHERE p_size * 2 + 1 > ANY (SELECT p_size + 60 FROM part WHERE p_partkey % 10 = 0) AND -p_size < ALL (SELECT r_regionkey - 3 FROM region)", "SELECT p_partkey FROM part WHERE p_size * 2 + 1 > (SELECT min(p_size + 60) FROM part WHERE p_partkey % 10 = 0) AND -p_size < -3"),
    "subq_all_nulls": ("SELECT count(*) FILTER (WHERE t) AS yes, count(*) FILTER (WHERE NOT t) AS no, count(*) FILTER (WHERE t IS NULL) AS unknown FROM (SELECT n_nationkey > ALL (SELECT nullif(r_regionkey, 1) FROM region) AS t FROM nation) q", "SELECT 0 AS yes, count(*) FILTER (WHERE n_nationkey <= 4) AS no, count(*) FILTER (WHERE n_nationkey > 4) AS unknown FROM nation"),
    "distinct_on_sql": "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_totalprice FROM orders WHERE o_orderstatus <> 'P' ORDER BY o_custkey, o_orderdate DESC, o_orderkey",
    "join_theta_pure": "SELECT a.n_nationkey AS a, b.s_suppkey AS b FROM nation a JOIN supplier b ON a.n_nationkey * 400 < b.s_acctbal AND a.n_regionkey < b.s_nationkey % 4",
    "agg_ordered_percentile": ("SELECT p_brand, percentile_cont(0.5) WITHIN GROUP (ORDER BY p_size) AS mid, array_join(array_sort(collect_set(p_size)), ',') AS sizes FROM part GROUP BY p_brand", "SELECT p_brand, quantile_cont(p_size, 0.5) AS mid, array_to_string(list_sort(list(DISTINCT p_size)), ',') AS sizes FROM part GROUP BY p_brand"),
    "ts_diff": ("SELECT event_id, cast(timestampdiff(SECOND, TIMESTAMP_NTZ '2024-01-01 00:00:00', ts) AS bigint) AS s FROM events", "SELECT event_id, cast(floor(epoch(ts) - epoch(TIMESTAMP '2024-01-01 00:00:00')) AS bigint) AS s FROM events"),
    "star": "SELECT * FROM nation",
    "subscript_where": ("SELECT vec_id FROM embeddings WHERE embedding[2] > 0.1 AND embedding[1] < embedding[3]", "SELECT vec_id FROM embeddings WHERE embedding[2] > cast(0.1 AS double) AND embedding[1] < embedding[3]"),
    "struct_star": ("SELECT s.* FROM (SELECT named_struct('k', n_nationkey, 'name', n_name) AS s FROM nation) t", "SELECT n_nationkey AS k, n_name AS name FROM nation"),
    "clicks_by_type": "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, min(ts) AS first_ts FROM events GROUP BY event_type",
}


def _sql_query(text: str) -> Callable[[SparkSession, str], DataFrame]:
    used = [t for t in TABLES if re.search(rf"\b{t}\b", text)]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        engine = Engine(spark)
        for name in used:
            spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)
        return engine.sql(text)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = {k: _sql_query(v if isinstance(v, str) else v[0]) for k, v in SAME.items()}
    return own | {k: f for k, (f, _) in frames.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    own = {k: v if isinstance(v, str) else v[1] for k, v in SAME.items()}
    return own | {k: sql for k, (_, sql) in frames.QUERIES.items() if sql}
