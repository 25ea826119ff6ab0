"""Running sums and row numbers over a whole table, without one task that orders all rows.

The order is cut into ranges by bounds from a sample; a range's rows are summed
by a window of their own, and what stands before a range comes from one row a
range. Bounds are values in the plan, so every evaluation cuts alike.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANGES, SAMPLE_ROWS = 48, 4096


def range_of(df: DataFrame, by: list[str], ranges: int = RANGES, sample_rows: int = SAMPLE_ROWS) -> Column:
    """The number of each row's range in the order of the columns."""
    sample = df.select(*by).orderBy(F.xxhash64(*by)).limit(sample_rows).orderBy(*by).collect()
    bounds = sorted({i * len(sample) // ranges for i in range(1, ranges)}) if sample else []
    types = [df.schema[c].dataType for c in by]
    key = F.struct(*by)
    above = [F.when(key >= F.struct(*[F.lit(v).cast(t).alias(c) for v, t, c in zip(sample[i], types, by, strict=True)]), 1).otherwise(0) for i in bounds]
    return reduce(lambda a, b: a + b, above, F.lit(0))


def running_total(df: DataFrame, by: list[str], value: Column, out: str, descending: bool = False) -> DataFrame:
    """df with the sum of value over the rows up to each in the order of by, whose values should be distinct."""
    cut = df.withColumn("__range", range_of(df, by)).withColumn("__value", value)
    order = [F.desc(c) if descending else F.asc(c) for c in by]
    inside = F.sum("__value").over(Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    sums = cut.groupBy("__range").agg(F.sum("__value").alias("__sum"))  # a row a range
    w = Window.orderBy(F.desc("__range") if descending else F.asc("__range")).rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select("__range", F.coalesce(F.sum("__sum").over(w), F.lit(0)).alias("__before"))
    return cut.withColumn("__inside", inside).join(F.broadcast(before), "__range").withColumn(out, F.col("__inside") + F.col("__before")).drop("__range", "__value", "__inside", "__before")
