"""The embedded API: open, register, query."""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from .catalog import Catalog
from .functions.dialect import GROUP_CONCAT_MAX_LEN, expand, statements
from .functions.udfs import NAMES, register
from .session import configure


_SET = re.compile(r"set\s+(?:session\s+)?@{0,2}group_concat_max_len\s*=\s*(\d+)\s*;?", re.IGNORECASE)
#: What the catalog runs, or names that it has; a session without either never opens one.
_CATALOG = re.compile(r"\s*(create\s+(database|table|external|materialized)|drop\s+(database|table|materialized)|use|set\s+catalog|insert|truncate|delete|alter\s+table|refresh)\b|.*\binformation_schema\s*\.", re.IGNORECASE | re.DOTALL)
_NUMBER_AS_DATE = re.compile(r"\bcast\s*\(\s*([\w.`]+)\s+as\s+date\s*\)", re.IGNORECASE)


class Engine:
    """A catalog of named inputs and SQL in the dialect over them. Names are case-insensitive.

    The engine works in a session of its own, so its settings and views don't
    reach the caller's. Tables that statements create live below warehouse, a
    folder that all machines share (by default in the session's), and outlast
    the engine.
    """

    def __init__(self, spark: SparkSession, warehouse: str | None = None):
        self.spark = spark.newSession()
        for key, value in spark.conf.getAll.items():
            if spark.conf.isModifiable(key):
                self.spark.conf.set(key, value)
        configure(self.spark)
        self._udfs: set[str] = set()
        self._names: set[str] = set()
        self.group_concat_max_len = 1024
        self._warehouse, self._catalog = warehouse, None
        if warehouse is not None:
            self.catalog  # its tables are known from the start

    @property
    def catalog(self) -> Catalog:
        if self._catalog is None:
            self._catalog = Catalog(self, self._warehouse or f"{self.spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/tessera")
        return self._catalog

    def register_parquet(self, name: str, path: str) -> DataFrame:
        return self.register(name, self.spark.read.parquet(path))

    def register_orc(self, name: str, path: str) -> DataFrame:
        return self.register(name, self.spark.read.orc(path))

    def has(self, name: str) -> bool:
        return name.lower() in self._names

    def register(self, name: str, df: DataFrame) -> DataFrame:
        if df.sparkSession is not self.spark:  # its plan in this engine's session, where the view belongs
            rows = self.spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(self.spark._jsparkSession, df._jdf.queryExecution().analyzed())
            df = DataFrame(rows, self.spark)
        df.createOrReplaceTempView(name.lower())
        self._names.add(name.lower())
        return df

    def register_dir(self, path: str, names: list[str]) -> Engine:
        for name in names:
            self.register_parquet(name, f"{path}/{name}.parquet")
        return self

    def query(self, sql: str) -> DataFrame:
        """The statement's result; a statement that changes the catalog gives no rows. SET group_concat_max_len = n is the engine's own setting."""
        if m := _SET.fullmatch(sql.strip()):
            self.group_concat_max_len = int(m[1])
            return self.spark.createDataFrame([("group_concat_max_len", m[1])], "key string, value string")
        if _CATALOG.match(sql) and self.catalog.run(sql):
            return self.spark.createDataFrame([], "status string")
        sql = self._prepared(sql)
        try:
            return self.spark.sql(sql)
        except AnalysisException as e:
            if "CAST_" not in (e.getCondition() or "") or "DATE" not in str(e):
                raise
            # A number as a date: its digits are year, month and day.
            return self.spark.sql(_NUMBER_AS_DATE.sub(r"to_date(cast(\1 as string), 'yyyyMMdd')", sql))

    def _prepared(self, sql: str) -> str:
        """The SQL expanded, and the Arrow functions that it names made known to the session."""
        if self._catalog is not None:
            sql = self._catalog.resolved(sql)
        token = GROUP_CONCAT_MAX_LEN.set(self.group_concat_max_len)
        try:
            sql = expand(sql)
        finally:
            GROUP_CONCAT_MAX_LEN.reset(token)
        new = (NAMES & {w.lower() for w in re.findall(r"\w+", sql)}) - self._udfs
        register(self.spark, new)
        self._udfs |= new
        return sql

    def explain(self, sql: str, mode: str = "formatted") -> str:
        return self.spark.sql(f"EXPLAIN {mode.upper()} {self._prepared(sql)}").first()[0]

    def execute(self, script: str) -> DataFrame | None:
        """Statements separated by semicolons; the last one's result."""
        out = None
        for statement in statements(script):
            out = self.query(statement)
        return out

    def tables(self) -> DataFrame:
        """information_schema.tables: name, kind and whether temporary."""
        return self.spark.sql("SHOW TABLES")

    def columns(self, name: str) -> DataFrame:
        """information_schema.columns of one table."""
        fields = self.spark.table(name).schema.fields
        return self.spark.createDataFrame([(i + 1, f.name, f.dataType.simpleString(), f.nullable) for i, f in enumerate(fields)], "ordinal_position int, column_name string, data_type string, is_nullable boolean")
