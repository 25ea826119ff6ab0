"""Aggregation forms and the dialect's aggregate functions, each against plain SQL."""

from __future__ import annotations

G = "FROM lineitem GROUP BY l_returnflag"

QUERIES = {
    "agg_count_distinct": (
        "SELECT l_returnflag, count(*) AS n, count(DISTINCT l_suppkey) AS d, multi_distinct_count(l_suppkey, l_linenumber) AS d2, multi_distinct_sum(l_linenumber) AS sd " + G,
        "SELECT l_returnflag, count(*) AS n, count(DISTINCT l_suppkey) AS d, count(DISTINCT (l_suppkey, l_linenumber)) AS d2, sum(DISTINCT l_linenumber)::bigint AS sd " + G,
    ),
    "agg_count_if": ("SELECT l_returnflag, count_if(l_quantity > 25) AS n " + G, "SELECT l_returnflag, count(*) FILTER (WHERE l_quantity > 25) AS n " + G),
    "agg_sum_min_max": (
        "SELECT o_orderstatus, sum(o_custkey) AS s, min(o_totalprice) AS lo, max(o_orderpriority) AS hi, min(o_orderdate) AS d FROM orders GROUP BY o_orderstatus",
        "SELECT o_orderstatus, sum(o_custkey)::bigint AS s, min(o_totalprice) AS lo, max(o_orderpriority) AS hi, min(o_orderdate) AS d FROM orders GROUP BY o_orderstatus",
    ),
    "agg_avg": ("SELECT event_type, avg(user_id) AS a FROM events GROUP BY event_type", "SELECT event_type, avg(user_id) AS a FROM events GROUP BY event_type"),
    "agg_any_value": ("SELECT n_regionkey, any_value(n_regionkey * 10) AS v FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, any_value(n_regionkey * 10) AS v FROM nation GROUP BY n_regionkey"),
    "agg_bool": (
        "SELECT event_type, bool_or(value > 99) AS a, bool_or(nullif(value, value) > 1) AS nulls, boolor_agg(value > 1000) AS b, every(value >= 0) AS c, booland_agg(value > 1) AS d FROM events GROUP BY event_type",
        "SELECT event_type, bool_or(value > 99) AS a, false AS nulls, bool_or(value > 1000) AS b, bool_and(value >= 0) AS c, bool_and(value > 1) AS d FROM events GROUP BY event_type",
    ),
    "agg_variance_population": (
        "SELECT l_returnflag, round(variance(l_quantity), 6) AS a, round(var_pop(l_quantity), 6) AS b, round(variance_samp(l_quantity), 6) AS c, round(stddev(l_quantity), 6) AS d, round(std(l_quantity), 6) AS e, round(stddev_samp(l_quantity), 6) AS f " + G,
        "SELECT l_returnflag, round(var_pop(l_quantity), 6) AS a, round(var_pop(l_quantity), 6) AS b, round(var_samp(l_quantity), 6) AS c, round(stddev_pop(l_quantity), 6) AS d, round(stddev_pop(l_quantity), 6) AS e, round(stddev_samp(l_quantity), 6) AS f " + G,
    ),
    "agg_covar_corr": (
        "SELECT l_returnflag, round(covar_pop(l_quantity, l_discount), 6) AS a, round(covar_samp(l_quantity, l_discount), 6) AS b, round(corr(l_quantity, l_extendedprice), 6) AS c " + G,
        "SELECT l_returnflag, round(covar_pop(l_quantity, l_discount), 6) AS a, round(covar_samp(l_quantity, l_discount), 6) AS b, round(corr(l_quantity, l_extendedprice), 6) AS c " + G,
    ),
    "agg_max_by_min_by": (
        "SELECT o_orderstatus, max_by(o_orderkey, o_totalprice * 1000000 + o_orderkey) AS a, min_by(nullif(o_orderkey, 5), o_orderkey) AS b, max_by_v2(o_custkey, o_orderkey) AS c, min_by_v2(nullif(o_orderkey, o_orderkey), o_orderkey) AS d FROM orders GROUP BY o_orderstatus",
        "SELECT o_orderstatus, arg_max(o_orderkey, o_totalprice * 1000000 + o_orderkey) AS a, arg_min(nullif(o_orderkey, 5), o_orderkey) FILTER (WHERE o_orderkey <> 5) AS b, arg_max(o_custkey, o_orderkey) AS c, cast(NULL as bigint) AS d FROM orders GROUP BY o_orderstatus",
    ),
    "agg_group_concat": (
        "SELECT n_regionkey, group_concat(n_name) AS a, group_concat(DISTINCT n_name ORDER BY n_name DESC SEPARATOR '|') AS b, string_agg(n_name, '; ') AS c FROM nation GROUP BY n_regionkey",
        "SELECT n_regionkey, left(string_agg(n_name, ',' ORDER BY n_name), 1024) AS a, string_agg(DISTINCT n_name, '|' ORDER BY n_name DESC) AS b, string_agg(n_name, '; ' ORDER BY n_name) AS c FROM nation GROUP BY n_regionkey",
    ),
    "agg_array_agg": (
        "SELECT n_regionkey, array_agg(n_nationkey ORDER BY n_nationkey DESC) AS a, array_agg_distinct(n_nationkey % 3) AS b, array_unique_agg(array(n_nationkey % 2, n_nationkey % 5)) AS c FROM nation GROUP BY n_regionkey",
        "SELECT n_regionkey, list(n_nationkey ORDER BY n_nationkey DESC) AS a, list_sort(list(DISTINCT n_nationkey % 3)) AS b, list_sort(list_distinct(flatten(list([n_nationkey % 2, n_nationkey % 5])))) AS c FROM nation GROUP BY n_regionkey",
    ),
    "agg_map_agg": (
        "SELECT n_regionkey, size(m) AS n, k, v FROM (SELECT n_regionkey, map_agg(n_name, n_nationkey) AS m FROM nation GROUP BY n_regionkey) u LATERAL VIEW explode(m) e AS k, v",
        "SELECT n_regionkey, (count(*) OVER (PARTITION BY n_regionkey))::int AS n, n_name AS k, n_nationkey AS v FROM nation",
    ),
    "agg_sum_map": (
        "SELECT o_orderstatus, k, v FROM (SELECT o_orderstatus, sum_map(map(o_orderpriority, o_custkey)) AS m FROM orders GROUP BY o_orderstatus) t LATERAL VIEW explode(m) x AS k, v",
        "SELECT o_orderstatus, o_orderpriority AS k, sum(o_custkey)::double AS v FROM orders GROUP BY o_orderstatus, o_orderpriority",
    ),
    "agg_min_n_max_n": (
        "SELECT l_returnflag, min_n(l_orderkey, 4) AS a, max_n(l_orderkey, 4) AS b " + G,
        "SELECT l_returnflag, min(l_orderkey, 4) AS a, list_sort(max(l_orderkey, 4)) AS b " + G,
    ),
    "agg_approx_count_distinct": (
        "SELECT l_returnflag, abs(ndv(l_orderkey) - count(DISTINCT l_orderkey)) <= 0.15 * count(DISTINCT l_orderkey) AS near, abs(ds_hll_count_distinct(l_orderkey) - count(DISTINCT l_orderkey)) <= 0.1 * count(DISTINCT l_orderkey) AS hll, abs(ds_theta_count_distinct(l_orderkey) - count(DISTINCT l_orderkey)) <= 0.1 * count(DISTINCT l_orderkey) AS theta " + G,
        "SELECT l_returnflag, true AS near, true AS hll, true AS theta " + G,
    ),
    "agg_hll_union": (
        "SELECT abs(hll_union_agg(s) - (SELECT count(DISTINCT l_partkey) FROM lineitem)) < 0.1 * (SELECT count(DISTINCT l_partkey) FROM lineitem) AS near, hll_cardinality(hll_union(s)) > 0 AS some FROM (SELECT l_suppkey, hll_raw_agg(l_partkey) AS s FROM lineitem GROUP BY l_suppkey) t",
        "SELECT true AS near, true AS some",
    ),
    "agg_bitmap": (
        "SELECT l_returnflag, bitmap_agg(l_linenumber) AS a, bitmap_union_count(l_suppkey) AS b, size(bitmap_union_int(l_suppkey)) AS c " + G,
        "SELECT l_returnflag, list_sort(list(DISTINCT l_linenumber::bigint)) AS a, count(DISTINCT l_suppkey) AS b, count(DISTINCT l_suppkey)::int AS c " + G,
    ),
    "agg_bitmap_bucketed_count": (
        "SELECT l_returnflag, sum(bitmap_count(bm)) AS n FROM (SELECT l_returnflag, bitmap_bucket_number(l_partkey) AS b, array_size(collect_set(l_partkey)) AS bm0, collect_set(l_partkey) AS bm FROM lineitem GROUP BY l_returnflag, bitmap_bucket_number(l_partkey)) t GROUP BY l_returnflag",
        "SELECT l_returnflag, count(DISTINCT l_partkey) AS n " + G,
    ),
    "agg_percentiles": (
        "SELECT l_returnflag, percentile_cont(0.5) WITHIN GROUP (ORDER BY l_quantity) AS a, percentile_disc(l_quantity, 0.5) AS b, percentile(l_quantity, 0.25) AS c, percentile_approx_weighted(l_quantity, l_linenumber, 0.5) AS d " + G,
        """SELECT l_returnflag, quantile_cont(l_quantity, 0.5) AS a, list_sort(list(l_quantity))[cast(ceil((count(*) - 1) * 0.5) as int) + 1] AS b, quantile_cont(l_quantity, 0.25) AS c,
  (SELECT quantile_cont(x.l_quantity, 0.5) FROM lineitem x, range(0, 7) r(i) WHERE r.i < x.l_linenumber AND x.l_returnflag = lineitem.l_returnflag) AS d """ + G,
    ),
    "agg_percentile_approx": (
        "SELECT l_returnflag, abs(percentile_approx(l_orderkey, 0.5, 10000) - percentile(l_orderkey, 0.5)) < 0.01 * max(l_orderkey) AS near " + G,
        "SELECT l_returnflag, true AS near " + G,
    ),
    "agg_approx_top_k": (
        "SELECT l_returnflag, l_linenumber, n FROM (SELECT l_returnflag, approx_top_k(l_linenumber, 3) AS top FROM lineitem GROUP BY l_returnflag) t LATERAL VIEW inline(top) u AS l_linenumber, n",
        "SELECT l_returnflag, l_linenumber, n FROM (SELECT l_returnflag, l_linenumber, count(*) AS n, row_number() OVER (PARTITION BY l_returnflag ORDER BY count(*) DESC, l_linenumber) AS r FROM lineitem GROUP BY l_returnflag, l_linenumber) t WHERE r <= 3",
    ),
    "agg_dict_merge": (
        "SELECT dict_merge(array(p_brand)) AS d FROM part",
        "SELECT list_sort(list(DISTINCT p_brand)) AS d FROM part",
    ),
    "agg_bitmap_union_count": (
        "SELECT l_returnflag, bitmap_union_count(array_to_bitmap(array(l_suppkey, l_linenumber))) AS a, bitmap_union_count(l_linenumber) AS b " + G,
        "SELECT l_returnflag, (SELECT count(DISTINCT v) FROM (SELECT l_suppkey AS v FROM lineitem k WHERE k.l_returnflag = t.l_returnflag UNION ALL SELECT l_linenumber FROM lineitem k WHERE k.l_returnflag = t.l_returnflag) u) AS a, b FROM (SELECT l_returnflag, count(DISTINCT l_linenumber) AS b " + G + ") t",
    ),
    "agg_histogram": ("SELECT o_orderstatus, histogram(o_custkey, 8) AS h FROM orders GROUP BY o_orderstatus", None),
    "agg_mann_whitney": ("SELECT o_orderstatus, mann_whitney_u_test(o_totalprice, o_orderkey % 2 = 0) AS t FROM orders GROUP BY o_orderstatus", None),
    "agg_decimal_rules": (
        "SELECT l_returnflag, cast(sum(cast(l_quantity as decimal(10,2))) / count(*) as decimal(38,8)) AS a, sum_dec(cast(l_discount as decimal(8,3)), 3) AS s " + G,
        "SELECT l_returnflag, cast(round(sum(cast(l_quantity as decimal(10,2)))::decimal(28,8) / count(*), 8) as decimal(38,8)) AS a, cast(sum(cast(l_discount as decimal(8,3))) as decimal(38,3)) AS s " + G,
    ),
    "group_rollup": (
        "SELECT l_returnflag, l_linestatus, count(*) AS n, grouping(l_linestatus) AS g, grouping_id(l_returnflag, l_linestatus) AS gid FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)",
        "SELECT l_returnflag, l_linestatus, count(*) AS n, grouping(l_linestatus) AS g, grouping_id(l_returnflag, l_linestatus) AS gid FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)",
    ),
    "group_cube": (
        "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)",
        "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)",
    ),
    "group_grouping_sets": (
        "SELECT l_returnflag, l_linestatus, l_linenumber, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_linenumber), ())",
        "SELECT l_returnflag, l_linestatus, l_linenumber, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_linenumber), ())",
    ),
    "group_having": ("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12"),
    "group_by_nested": (
        "SELECT a, s.x AS x, count(*) AS n FROM (SELECT array(n_regionkey, n_nationkey % 2) AS a, named_struct('x', n_regionkey) AS s FROM nation) t GROUP BY a, s",
        "SELECT a, s.x AS x, count(*) AS n FROM (SELECT [n_regionkey, n_nationkey % 2] AS a, {'x': n_regionkey} AS s FROM nation) t GROUP BY a, s",
    ),
    "group_global_empty": ("SELECT count(*) AS n, sum(o_custkey) AS s, max(o_orderkey) AS m FROM orders WHERE o_orderkey < 0", "SELECT count(*) AS n, sum(o_custkey)::bigint AS s, max(o_orderkey) AS m FROM orders WHERE o_orderkey < 0"),
}
