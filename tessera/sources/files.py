"""Reading and writing files: Parquet, ORC, CSV and JSON loads, JDBC, partitioned and bucketed sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_csv(spark: SparkSession, path: str, schema: str, sep: str = ",", enclose: str = '"', escape: str = "\\", header: bool = False, skip_bad: bool = False) -> DataFrame:
    """A load file with a declared schema; bad cells are NULL, or with skip_bad their rows are left out."""
    mode = "DROPMALFORMED" if skip_bad else "PERMISSIVE"
    return spark.read.schema(schema).options(sep=sep, quote=enclose, escape=escape, header=header, mode=mode).csv(path)


def read_json(spark: SparkSession, path: str, schema: str, jsonpaths: dict[str, str] | None = None, strip_outer_array: bool = False) -> DataFrame:
    """JSON lines, or with strip_outer_array files of one array each; jsonpaths give a column's place."""
    if not jsonpaths:
        return spark.read.schema(schema).json(path, multiLine=strip_outer_array)
    text = spark.read.text(path, wholetext=strip_outer_array)
    if strip_outer_array:
        text = text.select(F.explode(F.from_json("value", "array<variant>")).alias("v")).select(F.to_json("v").alias("value"))
    from pyspark.sql.types import StructType

    fields = StructType.fromDDL(schema).fields
    return text.select(*[F.get_json_object("value", jsonpaths[f.name]).try_cast(f.dataType).alias(f.name) for f in fields])


def read_jdbc(spark: SparkSession, url: str, table: str, properties: dict[str, str] | None = None, partition: tuple[str, int, int, int] | None = None) -> DataFrame:
    """A JDBC table; filters, columns and limits are pushed into its SQL. partition: column, lower, upper, number."""
    args = {"properties": properties or {}}
    if partition:
        column, low, high, n = partition
        args |= {"column": column, "lowerBound": low, "upperBound": high, "numPartitions": n}
    return spark.read.jdbc(url, table, **args)


def read_iceberg(spark: SparkSession, name: str, path: str | None = None) -> DataFrame:
    """An Iceberg table where the runtime is on the class path, else the files that the metadata at path lists."""
    try:
        spark._jvm.java.lang.Class.forName("org.apache.iceberg.spark.SparkCatalog")
    except Exception:
        if path is None:
            raise
        from . import iceberg

        return iceberg.scan(spark, path)
    return spark.table(name)


def write_partitioned(df: DataFrame, path: str, by: list[str], mode: str = "overwrite") -> None:
    """Parquet in folders by the columns; rows of a folder are brought together first, and large folders split again."""
    df.hint("rebalance", *by).write.mode(mode).partitionBy(*by).parquet(path)


def write_bucketed(df: DataFrame, table: str, by: list[str], buckets: int, mode: str = "overwrite", path: str | None = None) -> None:
    """A table bucketed and sorted by the keys, so that later joins and aggregations on them need no shuffle; at path, where one is given.

    Rows are dealt by the keys first, so that each bucket is one file.
    """
    writer = df.repartition(buckets, *by).write.mode(mode).format("parquet").bucketBy(buckets, *by).sortBy(*by)
    (writer.option("path", path) if path else writer).saveAsTable(table)


def compact(spark: SparkSession, path: str, out: str, target_bytes: int = 128 << 20) -> None:
    """The files of path as fewer files of about target_bytes each."""
    df = spark.read.parquet(path)
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    df.repartition(max(1, -(-size // target_bytes))).write.mode("overwrite").parquet(out)
