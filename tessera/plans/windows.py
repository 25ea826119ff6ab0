"""Window functions and frames; ANSI frames where the dialect is silent."""

from __future__ import annotations

W = "OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)"
F = "FROM orders"


def same(body: str) -> tuple[str, str]:
    return body, body


QUERIES = {
    "win_ranking": same(f"""SELECT o_orderkey, cast(row_number() {W} as bigint) AS rn, cast(rank() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus) as bigint) AS r, cast(dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus) as bigint) AS d,
  cume_dist() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus) AS c, percent_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus) AS p, cast(ntile(4) {W} as bigint) AS nt {F}"""),
    "win_lead_lag": same(f"SELECT o_orderkey, lead(o_orderkey, 2, -1) {W} AS a, lag(o_orderkey) {W} AS b, lag(o_orderkey, 1, o_custkey) {W} AS c {F}"),
    "win_first_last": same(f"SELECT o_orderkey, first_value(o_orderkey) {W} AS a, last_value(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS b {F}"),
    "win_ignore_nulls": (
        f"SELECT o_orderkey, last_value(x, true) OVER w AS a, first_value(x, true) OVER w AS b, lag(x, 1) IGNORE NULLS OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS c FROM (SELECT *, nullif(o_orderkey % 3, 0) AS x {F}) t WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)",
        f"SELECT o_orderkey, last_value(x IGNORE NULLS) OVER w AS a, first_value(x IGNORE NULLS) OVER w AS b, lag(x, 1 IGNORE NULLS) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS c FROM (SELECT *, nullif(o_orderkey % 3, 0) AS x {F}) t WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)",
    ),
    "win_frames_rows": same(f"SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS a, sum(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 FOLLOWING AND 4 FOLLOWING) AS b, max(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS c {F}".replace("sum(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 FOLLOWING AND 4 FOLLOWING)", "cast(sum(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 FOLLOWING AND 4 FOLLOWING) as bigint)")),
    "win_range_peers": same(f"SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderstatus) AS a, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderstatus RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b {F}"),
    "win_aggregates": same(f"SELECT o_orderkey, min(o_totalprice) {W} AS lo, max(o_totalprice) {W} AS hi, avg(o_custkey) {W} AS a, round(var_samp(o_totalprice / 1000) {W}, 2) AS v, round(stddev_samp(o_totalprice / 1000) {W}, 4) AS s {F}"),
    "win_covar": same(f"SELECT o_orderkey, round(covar_pop(o_orderkey, o_custkey) OVER (PARTITION BY o_orderstatus), 4) AS a, round(covar_samp(o_orderkey, o_totalprice) OVER (PARTITION BY o_orderstatus), 2) AS b, round(corr(o_orderkey, o_totalprice) OVER (PARTITION BY o_orderstatus), 8) AS c {F}"),
    "win_bool_or": (f"SELECT o_orderkey, bool_or(o_totalprice > 400000) {W} AS a {F}", f"SELECT o_orderkey, coalesce(bool_or(o_totalprice > 400000) {W}, false) AS a {F}"),
    "win_array_agg": (f"SELECT o_orderkey, collect_list(o_orderkey) {W} AS a, size(collect_set(o_orderstatus) {W}) AS b {F}", f"SELECT o_orderkey, list(o_orderkey) {W} AS a, len(list_distinct(list(o_orderstatus) {W}))::int AS b {F}"),
    "win_max_by": (f"SELECT o_orderkey, max_by_v2(o_orderkey, o_totalprice) {W} AS a, min_by_v2(o_orderkey, o_totalprice) {W} AS b {F}", f"SELECT o_orderkey, arg_max(o_orderkey, o_totalprice) {W} AS a, arg_min(o_orderkey, o_totalprice) {W} AS b {F}"),
    "win_bitmap_union_count": (f"SELECT o_orderkey, size(collect_set(o_custkey % 7) OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey ROWS BETWEEN 20 PRECEDING AND CURRENT ROW)) AS a {F}", f"SELECT o_orderkey, len(list_distinct(list(o_custkey % 7) OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey ROWS BETWEEN 20 PRECEDING AND CURRENT ROW)))::int AS a {F}"),
    "win_approx_top_k": (
        f"SELECT o_orderkey, transform(approx_top_k(o_orderstatus, 2) {W}, x -> x.count) AS top {F}",
        f"SELECT o_orderkey, list_reverse_sort([len(list_filter(l, lambda y: y = x)) for x in list_distinct(l)])[1:2] AS top FROM (SELECT o_orderkey, list(o_orderstatus) {W} AS l {F}) t",
    ),
    "win_nulls_order": same(f"SELECT o_orderkey, cast(row_number() OVER (PARTITION BY o_custkey ORDER BY nullif(o_orderstatus, 'F') NULLS FIRST, o_orderkey) as bigint) AS a, cast(row_number() OVER (PARTITION BY o_custkey ORDER BY nullif(o_orderstatus, 'F') DESC NULLS LAST, o_orderkey) as bigint) AS b {F}"),
    "win_qualify": same("SELECT p_brand, p_partkey FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) = 1"),
}
