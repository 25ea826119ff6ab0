"""Reports of the shapes that decision-support suites ask: roll-ups over joins, year over year, shares, set logic of customers."""

from __future__ import annotations

MONEY = "cast(cast(sum(cast({0} as decimal(18,2))) as decimal(28,2)) as double)"


def same(sql: str) -> tuple[str, str]:
    return sql, sql


PRICE, TOTAL = MONEY.format("l_extendedprice"), MONEY.format("o_totalprice")

QUERIES = {
    "report_rollup_over_joins": same(
        f"""SELECT r_name, n_name, cast(grouping(r_name) + grouping(n_name) as bigint) AS level, {PRICE} AS revenue, count(*) AS n
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
GROUP BY ROLLUP (r_name, n_name)"""
    ),
    "report_year_over_year": same(
        f"""WITH y AS (SELECT c_nationkey, cast(year(o_orderdate) as bigint) AS yr, {TOTAL} AS total FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_nationkey, year(o_orderdate))
SELECT a.c_nationkey, a.yr, a.total, b.total AS before, round(a.total / b.total, 6) AS ratio FROM y a JOIN y b ON a.c_nationkey = b.c_nationkey AND a.yr = b.yr + 1 WHERE b.total > 0"""
    ),
    "report_share_of_class": same(
        f"""SELECT p_brand, p_type, revenue, round(revenue * 100 / sum(revenue) OVER (PARTITION BY p_brand), 6) AS share
FROM (SELECT p_brand, p_type, {PRICE} AS revenue FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand, p_type) t"""
    ),
    "report_rank_in_rollup": same(
        f"""SELECT p_brand, p_type, revenue, cast(rank() OVER (PARTITION BY level, CASE WHEN level = 0 THEN p_brand END ORDER BY revenue DESC) as bigint) AS place
FROM (SELECT p_brand, p_type, cast(grouping(p_brand) + grouping(p_type) as bigint) AS level, {PRICE} AS revenue FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ROLLUP (p_brand, p_type)) t"""
    ),
    "report_above_own_average": same(
        """SELECT o_custkey, o_orderkey FROM orders o WHERE o_totalprice > (SELECT 1.5 * avg(o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)"""
    ),
    "report_channels_intersect": same(
        """SELECT count(*) AS n FROM (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O') t"""
    ),
    "report_channels_except": same(
        """SELECT c_mktsegment, count(*) AS n FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') GROUP BY c_mktsegment"""
    ),
    "report_union_of_channels": same(
        f"""SELECT channel, k, total FROM (SELECT 'supplier' AS channel, l_suppkey AS k, {PRICE} AS total FROM lineitem GROUP BY l_suppkey
UNION ALL SELECT 'customer', o_custkey, {TOTAL} FROM orders GROUP BY o_custkey) t WHERE total > (SELECT avg(o_totalprice) FROM orders) * 20"""
    ),
    "report_buckets_pivot": same(
        """SELECT l_returnflag, sum(CASE WHEN l_quantity BETWEEN 1 AND 10 THEN 1 ELSE 0 END) * 1.0 / count(*) > 0.1 AS many_small, cast(sum(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END) as bigint) AS still_open,
cast(sum(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END) as bigint) AS done, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY l_returnflag"""
    ),
    "report_moving_average": same(
        f"""SELECT yr, mo, total, round(avg(total) OVER (ORDER BY yr, mo ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS smooth, round(total - lag(total) OVER (ORDER BY yr, mo), 2) AS step
FROM (SELECT cast(year(o_orderdate) as bigint) AS yr, cast(month(o_orderdate) as bigint) AS mo, {TOTAL} AS total FROM orders GROUP BY year(o_orderdate), month(o_orderdate)) t"""
    ),
    "report_top_per_group": same(
        """SELECT c_nationkey, c_custkey, n FROM (SELECT c_nationkey, c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_nationkey, c_custkey) t QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY n DESC, c_custkey) <= 3"""
    ),
    "report_first_and_last": same(
        """SELECT o_custkey, min(o_orderdate) AS first_day, max(o_orderdate) AS last_day, count(*) AS n FROM orders GROUP BY o_custkey HAVING max(o_orderdate) > min(o_orderdate)"""
    ),
}
