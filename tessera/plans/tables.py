"""Scripts of DDL and DML in the writable catalog; each query is what its last statement reads."""

from __future__ import annotations

from ..engine import Engine
from ..session import shared_folder

INPUTS = ["nation", "customer", "orders", "lineitem", "part"]


def script(sql: str):
    def run(spark, sf_dir):
        engine = Engine(spark, warehouse=shared_folder(spark))
        for name in INPUTS:
            if name in sql:
                engine.register_parquet(name, f"{sf_dir}/{name}.parquet")
        return engine.execute(sql.replace("{sf_dir}", sf_dir))

    return run


QUERIES = {
    "ddl_insert_truncate": (
        script("""CREATE DATABASE shop; USE shop;
CREATE TABLE t (k INT, name VARCHAR(25), region INT, note STRING DEFAULT 'none') DUPLICATE KEY(k) DISTRIBUTED BY HASH(k) BUCKETS 4;
INSERT INTO t (k, name, region) SELECT n_nationkey, n_name, n_regionkey FROM nation; TRUNCATE TABLE t;
INSERT INTO t (k, name, region) SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_regionkey <> 2; INSERT INTO t VALUES (-1, 'none', NULL, 'typed');
SELECT k, name, region, note FROM shop.t"""),
        "SELECT n_nationkey AS k, n_name AS name, n_regionkey AS region, 'none' AS note FROM nation WHERE n_regionkey <> 2 UNION ALL SELECT -1, 'none', NULL, 'typed'",
    ),
    "ddl_create_as_select": (
        script("CREATE TABLE t AS SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand; INSERT OVERWRITE t SELECT p_brand, n + 1 FROM t; SELECT p_brand, n FROM t"),
        "SELECT p_brand, count(*) + 1 AS n FROM part GROUP BY p_brand",
    ),
    "dml_delete_segments": (
        script("""CREATE TABLE t (k BIGINT, st STRING, price DOUBLE);
INSERT INTO t SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus = 'F'; INSERT INTO t SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus <> 'F';
DELETE FROM t WHERE st = 'F' AND price > 100000; SELECT k, st, price FROM t"""),
        "SELECT o_orderkey AS k, o_orderstatus AS st, o_totalprice AS price FROM orders WHERE NOT (o_orderstatus = 'F' AND o_totalprice > 100000)",
    ),
    "dml_primary_key_loads": (
        script("""CREATE TABLE c (k BIGINT, bal DOUBLE, seg STRING) PRIMARY KEY(k);
INSERT INTO c SELECT c_custkey, c_acctbal, c_mktsegment FROM customer;
INSERT INTO c SELECT c_custkey, c_acctbal, 'again' FROM customer WHERE c_nationkey < 5;
INSERT INTO c PROPERTIES ("merge_condition" = "bal") SELECT c_custkey, CASE WHEN c_nationkey < 10 THEN c_acctbal + 1 ELSE c_acctbal - 1 END, 'richer' FROM customer;
INSERT INTO c (k, seg) PROPERTIES ("partial_update" = "true") SELECT c_custkey, 'part' FROM customer WHERE c_nationkey = 20;
SELECT k, bal, seg FROM c"""),
        "SELECT c_custkey AS k, CASE WHEN c_nationkey < 10 THEN c_acctbal + 1 ELSE c_acctbal END AS bal, CASE WHEN c_nationkey = 20 THEN 'part' WHEN c_nationkey < 10 THEN 'richer' ELSE c_mktsegment END AS seg FROM customer",
    ),
    "ddl_aggregate_key_table": (
        script("""CREATE TABLE g (k BIGINT, s DECIMAL(38,2) SUM, lo INT MIN, hi INT MAX, b BITMAP BITMAP_UNION) AGGREGATE KEY(k);
INSERT INTO g SELECT l_suppkey, l_quantity, l_linenumber, l_linenumber, to_bitmap(l_linenumber) FROM lineitem WHERE l_returnflag = 'R';
INSERT INTO g SELECT l_suppkey, l_quantity, l_linenumber, l_linenumber, to_bitmap(l_linenumber) FROM lineitem WHERE l_returnflag <> 'R';
SELECT k, cast(s AS DOUBLE) AS s, lo, hi, b FROM g"""),
        "SELECT l_suppkey::bigint AS k, sum(cast(l_quantity as decimal(28,2)))::double AS s, min(l_linenumber)::int AS lo, max(l_linenumber)::int AS hi, list_sort(list(DISTINCT l_linenumber::bigint)) AS b FROM lineitem GROUP BY l_suppkey",
    ),
    "ddl_schema_change": (
        script("""CREATE TABLE t (k INT, name STRING, gone INT); INSERT INTO t SELECT n_nationkey, n_name, 0 FROM nation;
ALTER TABLE t ADD COLUMN v INT DEFAULT 7; ALTER TABLE t MODIFY COLUMN k BIGINT; ALTER TABLE t RENAME COLUMN name TO label; ALTER TABLE t DROP COLUMN gone; INSERT INTO t (k) VALUES (99);
SELECT k, label, v FROM t"""),
        "SELECT n_nationkey::bigint AS k, n_name AS label, 7 AS v FROM nation UNION ALL SELECT 99, NULL, 7",
    ),
    "ddl_add_files": (
        script("CREATE TABLE t (n_nationkey INT, n_name STRING, n_regionkey INT); INSERT INTO t VALUES (1000, 'own', 9); ALTER TABLE t ADD FILES FROM '{sf_dir}/nation.parquet'; DELETE FROM t WHERE n_regionkey = 1; SELECT n_nationkey AS k, n_name FROM t"),
        "SELECT n_nationkey::int AS k, n_name FROM nation WHERE n_regionkey <> 1 UNION ALL SELECT 1000, 'own'",
    ),
    "mv_refreshed": (
        script("""CREATE TABLE t (c BIGINT, price DOUBLE); INSERT INTO t SELECT o_custkey, o_totalprice FROM orders WHERE o_orderstatus = 'O';
CREATE MATERIALIZED VIEW m REFRESH ASYNC AS SELECT c, count(*) AS n, max(price) AS top FROM t GROUP BY c;
INSERT INTO t SELECT o_custkey, o_totalprice FROM orders WHERE o_orderstatus <> 'O'; SELECT c, n, top FROM m"""),
        "SELECT o_custkey::bigint AS c, count(*) AS n, max(o_totalprice) AS top FROM orders GROUP BY o_custkey",
    ),
    "information_schema_columns": (
        script("CREATE DATABASE d; CREATE TABLE d.t (a INT, b DATETIME DEFAULT '2024-01-01', c DECIMAL(10,2)) UNIQUE KEY(a); SELECT table_schema, table_name, column_name, ordinal_position, data_type, column_key FROM information_schema.columns"),
        "SELECT * FROM (VALUES ('d', 't', 'a', 1::bigint, 'int', 'PRI'), ('d', 't', 'b', 2, 'timestamp_ntz', ''), ('d', 't', 'c', 3, 'decimal(10,2)', '')) v(table_schema, table_name, column_name, ordinal_position, data_type, column_key)",
    ),
    "dml_auto_increment": (
        script("CREATE TABLE t (id BIGINT AUTO_INCREMENT, name STRING) PRIMARY KEY(id); INSERT INTO t (name) SELECT n_name FROM nation; INSERT INTO t VALUES (1000000000000, 'far'); INSERT INTO t (name) VALUES ('next'); SELECT count(*) AS n, count(DISTINCT id) AS d, max(id) AS top, min(id) AS low FROM t"),
        "SELECT count(*) + 2 AS n, count(*) + 2 AS d, 1000000000001::bigint AS top, 1::bigint AS low FROM nation",
    ),
}
