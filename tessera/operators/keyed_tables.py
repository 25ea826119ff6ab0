"""Table models by key over plain DataFrames: duplicate, aggregate, unique and primary keys; upserts and deletes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import running_total


def _merged(op: str, c: str, version: Column) -> Column:
    op = op.upper()
    if op == "REPLACE":
        return F.max_by(c, version).alias(c)
    if op == "REPLACE_IF_NOT_NULL":
        return F.max_by(c, F.when(F.col(c).isNotNull(), version)).alias(c)
    if op == "BITMAP_UNION":
        return F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
    if op == "HLL_UNION":
        return F.hll_union_agg(c).alias(c)
    if op == "PERCENTILE_UNION":
        return F.flatten(F.collect_list(c)).alias(c)
    return {"SUM": F.sum, "MIN": F.min, "MAX": F.max}[op](c).alias(c)


def aggregate_key(df: DataFrame, keys: list[str], ops: dict[str, str], version: str) -> DataFrame:
    """Rows of a key merged by each column's operation; versions order what REPLACE takes."""
    return df.groupBy(*keys).agg(*[_merged(op, c, F.col(version)) for c, op in ops.items()])


def unique_key(df: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The last version of each key. max_by aggregates before the shuffle, which a row_number window would not."""
    rest = [c for c in df.columns if c not in keys]
    last = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(version)).alias("__last"))
    return last.select(*keys, *[F.col(f"__last.{c}").alias(c) for c in rest])


def upsert(base: DataFrame, changes: DataFrame, keys: list[str], deleted: str | None = None, condition: Column | None = None) -> DataFrame:
    """base with changes put in by key: full rows, or of some columns only (partial update).

    changes have a key once. deleted names a boolean column of changes whose
    rows take the key out. condition, over columns prefixed old_ and new_, says
    whether a change applies.
    """
    values = [c for c in base.columns if c not in keys]
    given = [c for c in changes.columns if c in values]
    new = changes.select(*keys, *[F.col(c).alias(f"new_{c}") for c in given], F.lit(True).alias("__new"), *([F.col(deleted).alias("__gone")] if deleted else []))
    old = base.select(*keys, *[F.col(c).alias(f"old_{c}") for c in values], F.lit(True).alias("__old"))
    both = old.join(new, keys, "full_outer")
    if deleted:
        both = both.where(~F.coalesce("__gone", F.lit(False)))
    applies = F.col("__new").isNotNull()
    if condition is not None:
        applies = applies & (F.col("__old").isNull() | condition)
    return both.select(*keys, *[(F.when(applies, F.col(f"new_{c}")).otherwise(F.col(f"old_{c}")) if c in given else F.col(f"old_{c}")).alias(c) for c in values]).select(*base.columns)


def delete_where(df: DataFrame, predicate: Column) -> DataFrame:
    """The rows for which the predicate isn't TRUE."""
    return df.where(~F.coalesce(predicate, F.lit(False)))


def auto_increment(df: DataFrame, column: str, by: list[str], start: int = 1, descending: bool = False) -> DataFrame:
    """Gapless numbers in the order of by, whose values should be distinct."""
    return running_total(df, by, F.lit(1), column, descending).withColumn(column, F.col(column) + (start - 1))


def assert_num_rows(df: DataFrame, n: int, relation: str = "<=") -> DataFrame:
    """df, or an error where its number of rows isn't as said."""
    count = df.agg(F.count("*").alias("__n"))
    ok = {"=": F.col("__n") == n, "!=": F.col("__n") != n, "<": F.col("__n") < n, "<=": F.col("__n") <= n, ">": F.col("__n") > n, ">=": F.col("__n") >= n}[relation]
    checked = count.select(F.assert_true(ok, F.lit(f"expected {relation} {n} rows")).alias("__ok"))
    return df.crossJoin(F.broadcast(checked)).where("__ok IS NULL").drop("__ok")


def split_route(df: DataFrame, routes: dict[str, Column]) -> dict[str, DataFrame]:
    """One DataFrame a route: the rows for which its condition is TRUE."""
    return {name: df.where(c) for name, c in routes.items()}
