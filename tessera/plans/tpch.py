"""Decision-support queries over the star schema: TPC-H shapes and star-schema (SSB) flights, as far as the tables allow.

Money is summed as DECIMAL, so that sums don't depend on the order of rows.
"""

from __future__ import annotations


def total(x: str) -> str:
    return f"cast(sum(cast({x} as decimal(18,4))) as double)"


NET = "l_extendedprice * (1 - l_discount)"
# Six places and more, so exact decimals: a row's rounding isn't left to binary fractions.
CHARGE = "cast(l_extendedprice as decimal(12,2)) * cast(1 - l_discount as decimal(6,4)) * cast(1 + l_tax as decimal(6,4))"

SQL = {
    "tpch_q1": f"""
SELECT l_returnflag, l_linestatus, {total('l_quantity')} AS sum_qty, {total('l_extendedprice')} AS sum_base_price,
  {total(NET)} AS sum_disc_price, cast(sum({CHARGE}) as double) AS sum_charge,
  {total('l_quantity')} / count(*) AS avg_qty, {total('l_extendedprice')} / count(*) AS avg_price, {total('l_discount')} / count(*) AS avg_disc, count(*) AS count_order
FROM lineitem WHERE l_shipdate <= timestamp '1998-09-02 00:00:00'
GROUP BY l_returnflag, l_linestatus""",
    "tpch_q2_min_cost_supplier": """
SELECT s_acctbal, s_name, n_name, p_partkey
FROM (SELECT l_partkey, l_suppkey, min(l_extendedprice / l_quantity) AS cost FROM lineitem GROUP BY l_partkey, l_suppkey) ps
JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
WHERE p_size < 15 AND cost = (SELECT min(x.l_extendedprice / x.l_quantity) FROM lineitem x JOIN supplier y ON x.l_suppkey = y.s_suppkey WHERE x.l_partkey = part.p_partkey)""",
    "tpch_q3": f"""
SELECT l_orderkey, {total(NET)} AS revenue, o_orderdate
FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
WHERE c_mktsegment = 'BUILDING' AND o_orderdate < timestamp '1995-03-15 00:00:00' AND l_shipdate > timestamp '1995-03-15 00:00:00'
GROUP BY l_orderkey, o_orderdate ORDER BY revenue DESC, l_orderkey LIMIT 10""",
    "tpch_q4": """
SELECT o_orderpriority, count(*) AS order_count FROM orders
WHERE o_orderdate >= timestamp '1993-07-01 00:00:00' AND o_orderdate < timestamp '1996-10-01 00:00:00'
  AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_shipdate > o_orderdate)
GROUP BY o_orderpriority""",
    "tpch_q5": f"""
SELECT n_name, {total(NET)} AS revenue
FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey
JOIN nation ON s_nationkey = n_nationkey AND c_nationkey = s_nationkey JOIN region ON n_regionkey = r_regionkey
WHERE r_name = 'ASIA' GROUP BY n_name""",
    "tpch_q6": f"""
SELECT {total('l_extendedprice * l_discount')} AS revenue FROM lineitem
WHERE l_shipdate >= timestamp '1994-01-01 00:00:00' AND l_shipdate < timestamp '1996-01-01 00:00:00' AND l_discount BETWEEN 0.02 AND 0.08 AND l_quantity < 24""",
    "tpch_q7": f"""
SELECT a.n_name AS supp_nation, b.n_name AS cust_nation, cast(extract(YEAR FROM l_shipdate) as bigint) AS l_year, {total(NET)} AS revenue
FROM supplier JOIN lineitem ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey
JOIN nation a ON s_nationkey = a.n_nationkey JOIN nation b ON c_nationkey = b.n_nationkey
WHERE a.n_regionkey = 1 AND b.n_regionkey = 2 GROUP BY a.n_name, b.n_name, extract(YEAR FROM l_shipdate)""",
    "tpch_q8": f"""
SELECT cast(extract(YEAR FROM o_orderdate) as bigint) AS o_year,
  {total("CASE WHEN b.n_name = (SELECT min(n_name) FROM nation) THEN " + NET + " ELSE 0 END")} / {total(NET)} AS mkt_share
FROM part JOIN lineitem ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey JOIN orders ON l_orderkey = o_orderkey
JOIN customer ON o_custkey = c_custkey JOIN nation a ON c_nationkey = a.n_nationkey JOIN region ON a.n_regionkey = r_regionkey JOIN nation b ON s_nationkey = b.n_nationkey
WHERE p_size < 20 GROUP BY extract(YEAR FROM o_orderdate)""",
    "tpch_q9": f"""
SELECT n_name, cast(extract(YEAR FROM o_orderdate) as bigint) AS o_year, {total(NET)} AS profit
FROM part JOIN lineitem ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey JOIN nation ON s_nationkey = n_nationkey
WHERE p_name LIKE '%a%' GROUP BY n_name, extract(YEAR FROM o_orderdate)""",
    "tpch_q10": f"""
SELECT c_custkey, c_name, {total(NET)} AS revenue, c_acctbal, n_name
FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN nation ON c_nationkey = n_nationkey
WHERE l_returnflag = 'R' GROUP BY c_custkey, c_name, c_acctbal, n_name ORDER BY revenue DESC, c_custkey LIMIT 20""",
    "tpch_q11": f"""
SELECT l_partkey, {total('l_extendedprice')} AS value FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
GROUP BY l_partkey HAVING sum(cast(l_extendedprice as decimal(18,4))) > (SELECT sum(cast(l_extendedprice as decimal(18,4))) * 0.0007 FROM lineitem)""",
    "tpch_q12": """
SELECT l_linestatus, sum(CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END) AS high, sum(CASE WHEN o_orderpriority NOT IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END) AS low
FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_shipdate >= timestamp '1994-01-01 00:00:00' GROUP BY l_linestatus""",
    "tpch_q13": """
SELECT c_count, count(*) AS custdist FROM (
  SELECT c_custkey, count(o_orderkey) AS c_count FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus <> 'P' GROUP BY c_custkey) t
GROUP BY c_count""",
    "tpch_q14": f"""
SELECT 100.0 * {total("CASE WHEN p_type LIKE 'PROMO%' OR p_size > 25 THEN " + NET + " ELSE 0 END")} / {total(NET)} AS promo_revenue
FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "tpch_q15": f"""
WITH revenue AS (SELECT l_suppkey AS supplier_no, {total(NET)} AS total_revenue FROM lineitem GROUP BY l_suppkey)
SELECT s_suppkey, s_name, total_revenue FROM supplier JOIN revenue ON s_suppkey = supplier_no WHERE total_revenue = (SELECT max(total_revenue) FROM revenue)""",
    "tpch_q16": """
SELECT p_brand, p_type, p_size, count(DISTINCT l_suppkey) AS supplier_cnt FROM lineitem JOIN part ON p_partkey = l_partkey
WHERE p_size IN (1, 4, 9, 14, 19, 23, 36, 45, 49) AND l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0)
GROUP BY p_brand, p_type, p_size""",
    "tpch_q17": f"""
SELECT {total('l_extendedprice')} / 7.0 AS avg_yearly FROM lineitem JOIN part ON p_partkey = l_partkey
WHERE p_size < 10 AND l_quantity < (SELECT 0.5 * avg(x.l_quantity) FROM lineitem x WHERE x.l_partkey = p_partkey)""",
    "tpch_q18": f"""
SELECT c_name, c_custkey, o_orderkey, o_totalprice, {total('l_quantity')} AS qty
FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey
WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING sum(l_quantity) > 200)
GROUP BY c_name, c_custkey, o_orderkey, o_totalprice ORDER BY o_totalprice DESC, o_orderkey LIMIT 100""",
    "tpch_q19": f"""
SELECT {total(NET)} AS revenue FROM lineitem JOIN part ON p_partkey = l_partkey
WHERE (p_size BETWEEN 1 AND 5 AND l_quantity BETWEEN 1 AND 11) OR (p_size BETWEEN 6 AND 10 AND l_quantity BETWEEN 10 AND 20) OR (p_size BETWEEN 11 AND 15 AND l_quantity BETWEEN 20 AND 30)""",
    "tpch_q20": """
SELECT s_name FROM supplier WHERE s_suppkey IN (
  SELECT l_suppkey FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size < 10) GROUP BY l_suppkey, l_partkey HAVING sum(l_quantity) > 60)""",
    "tpch_q21": """
SELECT s_name, count(*) AS numwait FROM supplier JOIN lineitem l1 ON s_suppkey = l1.l_suppkey JOIN orders ON o_orderkey = l1.l_orderkey
WHERE o_orderstatus = 'F' AND EXISTS (SELECT 1 FROM lineitem l2 WHERE l2.l_orderkey = l1.l_orderkey AND l2.l_suppkey <> l1.l_suppkey)
  AND NOT EXISTS (SELECT 1 FROM lineitem l3 WHERE l3.l_orderkey = l1.l_orderkey AND l3.l_suppkey <> l1.l_suppkey AND l3.l_returnflag = 'R')
GROUP BY s_name""",
    "tpch_q22": """
SELECT c_nationkey, count(*) AS numcust, cast(sum(cast(c_acctbal as decimal(18,4))) as double) AS totacctbal FROM customer
WHERE c_acctbal > (SELECT avg(c_acctbal) FROM customer WHERE c_acctbal > 0) AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)
GROUP BY c_nationkey""",
    "ssb_q1": f"""
SELECT {total('l_extendedprice * l_discount')} AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey
WHERE extract(YEAR FROM o_orderdate) = 1993 AND l_discount BETWEEN 0.01 AND 0.03 AND l_quantity < 25""",
    "ssb_q2": f"""
SELECT {total('l_extendedprice')} AS revenue, cast(extract(YEAR FROM o_orderdate) as bigint) AS d_year, p_brand
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
WHERE r_name = 'AMERICA' GROUP BY extract(YEAR FROM o_orderdate), p_brand""",
    "ssb_q3": f"""
SELECT c.n_name AS c_nation, s.n_name AS s_nation, cast(extract(YEAR FROM o_orderdate) as bigint) AS d_year, {total('l_extendedprice')} AS revenue
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
JOIN nation c ON c_nationkey = c.n_nationkey JOIN nation s ON s_nationkey = s.n_nationkey
WHERE c.n_regionkey = 2 AND s.n_regionkey = 2 GROUP BY c.n_name, s.n_name, extract(YEAR FROM o_orderdate)""",
    "ssb_q4": f"""
SELECT cast(extract(YEAR FROM o_orderdate) as bigint) AS d_year, n_name, {total('l_extendedprice - l_extendedprice * l_discount')} AS profit
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN part ON l_partkey = p_partkey
WHERE n_regionkey = 1 AND p_size BETWEEN 5 AND 25 GROUP BY extract(YEAR FROM o_orderdate), n_name""",
}

#: The same text runs on both sides.
QUERIES = {name: (sql, sql) for name, sql in SQL.items()}
