"""Tables written in each file format and layout and read back, against the tables themselves."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import shared_folder
from ..sources import files, iceberg


def _t(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _customer(spark, sf_dir):
    return _t(spark, sf_dir, "customer").selectExpr("cast(c_custkey AS bigint) AS k", "c_name AS name", "c_acctbal AS bal", "nullif(c_mktsegment, 'BUILDING') AS seg")


CUSTOMER = "SELECT c_custkey::bigint AS k, c_name AS name, c_acctbal AS bal, nullif(c_mktsegment, 'BUILDING') AS seg FROM customer"
SCHEMA = "k bigint, name string, bal double, seg string"


def orc(spark, sf_dir):
    path = shared_folder(spark)
    _customer(spark, sf_dir).write.orc(path)
    return spark.read.orc(path)


def csv(spark, sf_dir):
    path = shared_folder(spark)
    _customer(spark, sf_dir).write.option("sep", "|").option("compression", "gzip").csv(path)
    return files.read_csv(spark, path, SCHEMA, sep="|")


def json(spark, sf_dir):
    path = shared_folder(spark)
    _customer(spark, sf_dir).select(F.to_json(F.struct("k", F.struct("name", "bal").alias("in"), "seg")).alias("value")).write.text(path)
    return files.read_json(spark, path, SCHEMA, {"k": "$.k", "name": "$.in.name", "bal": "$.in.bal", "seg": "$.seg"})


def partitioned(spark, sf_dir):
    path = shared_folder(spark)
    files.write_partitioned(_t(spark, sf_dir, "orders").selectExpr("o_orderkey", "o_totalprice", "o_orderstatus AS st"), path, ["st"])
    return spark.read.parquet(path).where("st = 'F'")


def compaction(spark, sf_dir):
    path, out = shared_folder(spark), shared_folder(spark)
    _customer(spark, sf_dir).repartition(12).write.parquet(path)
    files.compact(spark, path, out)
    return spark.read.parquet(out)


def join_bucketed(spark, sf_dir):
    """Both sides dealt into the same buckets once; the join itself shuffles nothing."""
    path, tag = shared_folder(spark), shared_folder(spark)[-8:]
    files.write_bucketed(_t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), f"bucketed_orders_{tag}", ["o_orderkey"], 16, path=f"{path}/o")
    files.write_bucketed(_t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_quantity"), f"bucketed_lineitem_{tag}", ["o_orderkey"], 16, path=f"{path}/l")
    o, l = spark.table(f"bucketed_orders_{tag}"), spark.table(f"bucketed_lineitem_{tag}")
    return o.hint("merge").join(l, "o_orderkey").groupBy("o_orderkey").agg(F.count("*").alias("n"), F.max("l_quantity").alias("top"))


def iceberg_scan(spark, sf_dir):
    """Two appends; the first snapshot is still readable."""
    path, rows = shared_folder(spark), _customer(spark, sf_dir)
    iceberg.append(rows.where("bal > 0"), path)
    iceberg.append(rows.where("bal <= 0"), path)
    return iceberg.scan(spark, path)


def iceberg_files(spark, sf_dir):
    path, rows = shared_folder(spark), _customer(spark, sf_dir)
    iceberg.append(rows.where("bal > 0"), path)
    iceberg.append(rows.where("bal <= 0"), path)
    return iceberg.files(spark, path).groupBy("sequence_number").agg(F.sum("record_count").alias("n"), F.max("file_format").alias("format"))


QUERIES = {
    "scan_iceberg": (iceberg_scan, CUSTOMER),
    "iceberg_files_table": (iceberg_files, "SELECT CASE WHEN c_acctbal > 0 THEN 1 ELSE 2 END::bigint AS sequence_number, count(*) AS n, 'PARQUET' AS format FROM customer GROUP BY 1"),
    "scan_orc": (orc, CUSTOMER),
    "scan_csv_gzip": (csv, CUSTOMER),
    "scan_json_paths": (json, CUSTOMER),
    "sink_partitioned": (partitioned, "SELECT o_orderkey, o_totalprice, o_orderstatus AS st FROM orders WHERE o_orderstatus = 'F'"),
    "sink_compaction": (compaction, CUSTOMER),
    "join_bucketed": (join_bucketed, "SELECT o_orderkey, count(*) AS n, max(l_quantity) AS top FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey"),
}
