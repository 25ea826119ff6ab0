"""Projection, filters, joins, subqueries, set operations, sorting and limits."""

from __future__ import annotations

SAME = {
    "scan_parquet_pruned": "SELECT l_orderkey, l_partkey FROM lineitem WHERE l_quantity > 45 AND l_shipdate >= timestamp '1997-01-01 00:00:00'",
    "project_expressions": "SELECT o_orderkey, o_totalprice * 2 AS twice, o_orderkey % 7 AS m, upper(o_orderpriority) AS p, o_orderkey + 1 AS nxt FROM orders",
    "filter_three_valued": """SELECT event_id, CASE WHEN v IS NULL THEN 'null' WHEN v > 50 THEN 'high' ELSE 'low' END AS c FROM (SELECT event_id, nullif(value, 0) AS v, event_type FROM events) t
WHERE NOT (v > 90) OR v IS NULL OR event_type IN ('click', 'view', NULL)""",
    "filter_is_true_false": "SELECT count(*) AS n, sum(CASE WHEN (value > 50) IS TRUE THEN 1 ELSE 0 END) AS t, sum(CASE WHEN (value > 50) IS NOT TRUE THEN 1 ELSE 0 END) AS nt, sum(CASE WHEN (nullif(value, value) > 1) IS FALSE THEN 1 ELSE 0 END) AS f FROM events",
    "filter_between_in_like": "SELECT p_partkey, p_name FROM part WHERE p_size BETWEEN 3 AND 17 AND p_brand IN ('Brand#11', 'Brand#22', 'Brand#33', 'Brand#12', 'Brand#13') AND p_name LIKE '%e%' AND p_name NOT LIKE '%zz%'",
    "limit_offset": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 25 OFFSET 100",
    "topn_heap": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50",
    "sort_nulls_first": "SELECT event_id, k FROM (SELECT event_id, nullif(event_type, 'click') AS k FROM events) t ORDER BY k NULLS FIRST, event_id",
    "sort_nulls_last_desc": "SELECT event_id, k FROM (SELECT event_id, nullif(event_type, 'click') AS k FROM events) t ORDER BY k DESC NULLS LAST, event_id",
    "sort_ordinal_alias": "SELECT n_name AS nm, n_regionkey AS rk FROM nation ORDER BY 2 DESC, nm LIMIT 10",
    "topn_rank_ties": "SELECT p_partkey, p_size FROM (SELECT p_partkey, p_size, rank() OVER (ORDER BY p_size DESC) AS r FROM part) t WHERE r <= 10",
    "topn_dense_rank_ties": "SELECT p_brand, p_partkey, p_size FROM (SELECT p_brand, p_partkey, p_size, dense_rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS r FROM part) t WHERE r <= 2",
    "topn_row_number": "SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) t WHERE r <= 3",
    "join_inner": "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 5000",
    "join_left_outer": "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 300000",
    "join_right_outer": "SELECT c_custkey, o_orderkey FROM orders RIGHT JOIN customer ON c_custkey = o_custkey AND o_orderstatus = 'P'",
    "join_full_outer": "SELECT a.k AS ak, b.k AS bk FROM (SELECT DISTINCT l_suppkey AS k FROM lineitem WHERE l_quantity > 49) a FULL OUTER JOIN (SELECT s_suppkey AS k FROM supplier WHERE s_acctbal > 0) b ON a.k = b.k",
    "join_left_semi": "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')",
    "join_left_anti": "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)",
    "join_null_aware_anti": "SELECT n_nationkey FROM nation WHERE n_nationkey NOT IN (SELECT nullif(s_nationkey, -1) FROM supplier WHERE s_acctbal > 5000)",
    "join_not_in_with_null": "SELECT n_nationkey FROM nation WHERE n_nationkey NOT IN (SELECT nullif(s_nationkey, 3) FROM supplier)",
    "join_theta_range": "SELECT a.n_name AS a, b.r_name AS b FROM nation a JOIN region b ON a.n_nationkey > b.r_regionkey * 5 AND a.n_regionkey <> b.r_regionkey",
    "join_theta_left": "SELECT a.n_nationkey AS a, b.r_regionkey AS b FROM nation a LEFT JOIN region b ON a.n_nationkey < b.r_regionkey",
    "join_theta_anti": "SELECT a.n_nationkey FROM nation a WHERE NOT EXISTS (SELECT 1 FROM region b WHERE a.n_nationkey < b.r_regionkey)",
    "join_cross": "SELECT a.r_name AS a, b.r_name AS b FROM region a CROSS JOIN region b",
    "join_using": "SELECT l_orderkey, n FROM (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey) a JOIN (SELECT o_orderkey AS l_orderkey FROM orders WHERE o_orderstatus = 'O') b USING (l_orderkey)",
    "join_comma": "SELECT n_name, r_name FROM nation, region WHERE n_regionkey = r_regionkey",
    "join_residual_outer": "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > c_acctbal * 40",
    "join_self": "SELECT a.n_nationkey AS x, b.n_nationkey AS y FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey",
    "subquery_scalar_correlated": "SELECT p_partkey, (SELECT count(*) FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 25) AS n FROM part",
    "subquery_in_select_exists": "SELECT c_custkey, CASE WHEN EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) THEN 1 ELSE 0 END AS has FROM customer",
    "subquery_or_exists": "SELECT c_custkey FROM customer WHERE c_acctbal > 9000 OR EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)",
    "cte_multi_use": "WITH t AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) SELECT a.o_custkey, a.n FROM t a JOIN (SELECT max(n) AS m FROM t) b ON a.n = b.m",
    "cte_recursive": "WITH RECURSIVE r(n, f) AS (SELECT 1 AS n, 1 AS f UNION ALL SELECT n + 1, f * (n + 1) FROM r WHERE n < 10) SELECT n, f FROM r",
    "set_union_all": "SELECT n_nationkey AS k FROM nation UNION ALL SELECT r_regionkey FROM region",
    "set_union_distinct": "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier",
    "set_intersect": "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier INTERSECT SELECT n_nationkey FROM nation WHERE n_nationkey > 3",
    "set_except": "SELECT nullif(n_nationkey, 4) AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_nationkey > 10",
    "set_except_with_null": "SELECT k FROM (VALUES (cast(NULL as int)), (1)) t(k) EXCEPT SELECT k FROM (VALUES (cast(NULL as int))) u(k)",
    "set_intersect_all": "SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier",
    "set_except_all": "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier",
    "set_values": "SELECT a, b FROM (VALUES (1, 'x'), (2, 'y'), (3, cast(NULL as varchar(5)))) t(a, b)",
    "select_distinct": "SELECT DISTINCT p_brand, p_size FROM part",
    "assert_num_rows": "SELECT (SELECT max(o_totalprice) FROM orders) AS m, r_name FROM region",
    "case_simple_searched": "SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 1 WHEN 'F' THEN 2 ELSE 0 END AS a, CASE WHEN o_totalprice > 200000 THEN 'big' WHEN o_totalprice > 100000 THEN 'mid' END AS b FROM orders",
}

BOTH = {
    "arithmetic_zero_divisor": (
        "SELECT l_orderkey, l_linenumber, l_quantity / (l_linenumber - 1) AS d, l_linenumber % (l_linenumber - 1) AS m, l_linenumber + l_suppkey AS s FROM lineitem",
        "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber <> 1 THEN l_quantity / (l_linenumber - 1) END AS d, CASE WHEN l_linenumber <> 1 THEN l_linenumber % (l_linenumber - 1) END AS m, l_linenumber + l_suppkey AS s FROM lineitem",
    ),
    "cast_bad_is_null": (
        "SELECT p_partkey, cast(p_name as int) AS a, cast(p_size as string) AS b, cast(cast(p_size as string) as double) AS c, cast(concat('2024-01-', lpad(p_size, 2, '0')) as date) AS d FROM part",
        "SELECT p_partkey, try_cast(p_name as int) AS a, cast(p_size as varchar) AS b, cast(p_size as double) AS c, try_cast('2024-01-' || lpad(cast(p_size as varchar), 2, '0') as date) AS d FROM part",
    ),
    "null_safe_equal_join": (
        "SELECT a.event_id AS x, b.r_regionkey AS y FROM (SELECT event_id, nullif(user_id % 7, 3) AS k FROM events) a JOIN (SELECT r_regionkey, nullif(r_regionkey, 3) AS k FROM region) b ON a.k <=> b.k",
        "SELECT a.event_id AS x, b.r_regionkey AS y FROM (SELECT event_id, nullif(user_id % 7, 3) AS k FROM events) a JOIN (SELECT r_regionkey, nullif(r_regionkey, 3) AS k FROM region) b ON a.k IS NOT DISTINCT FROM b.k",
    ),
    "join_right_semi": ("SELECT c_custkey FROM customer LEFT SEMI JOIN orders ON o_custkey = c_custkey AND o_totalprice > c_acctbal", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > c_acctbal)"),
    "join_broadcast_hint": ("SELECT /*+ BROADCAST(nation) */ c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey", "SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey"),
    "join_shuffle_hash_hint": ("SELECT /*+ SHUFFLE_HASH(orders) */ o_orderkey, count(*) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey", "SELECT o_orderkey, count(*) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey"),
    "like_ilike_regexp": (
        "SELECT p_partkey, p_name LIKE '%a_e%' AS a, p_name ILIKE '%A%' AS b, p_type RLIKE '^[A-Z]+ ' AS c, NOT (p_name RLIKE '[xyz]') AS d FROM part",
        "SELECT p_partkey, p_name LIKE '%a_e%' AS a, p_name ILIKE '%A%' AS b, regexp_matches(p_type, '^[A-Z]+ ') AS c, NOT regexp_matches(p_name, '[xyz]') AS d FROM part",
    ),
    "generate_series": ("SELECT generate_series AS g FROM TABLE(generate_series(2, 30, 4))", "SELECT g FROM generate_series(2, 30, 4) t(g)"),
    "generate_series_down": ("SELECT generate_series AS g FROM TABLE(generate_series(10, 1, -3))", "SELECT g FROM generate_series(10, 1, -3) t(g)"),
    "late_materialisation": (
        "SELECT o.* FROM (SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 15) k JOIN orders o USING (o_orderkey)",
        "SELECT o.* FROM (SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 15) k JOIN orders o USING (o_orderkey)",
    ),
    "meta_scan_min_max": ("SELECT min(l_orderkey) AS lo, max(l_orderkey) AS hi, count(*) AS n FROM lineitem", "SELECT min(l_orderkey) AS lo, max(l_orderkey) AS hi, count(*) AS n FROM lineitem"),
    "typeof_info": ("SELECT typeof(p_partkey) AS a, typeof(p_name) AS b FROM part", "SELECT lower(typeof(p_partkey)) AS a, 'string' AS b FROM part"),
    "info_functions": ("SELECT current_database() AS db, version() IS NOT NULL AS v, current_user() IS NOT NULL AS u", "SELECT 'default' AS db, true AS v, true AS u"),
}

QUERIES = {name: (sql, sql) for name, sql in SAME.items()} | BOTH
