"""Event analytics: sessions, funnels, retention."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import running_total


def with_session_number(df: DataFrame, x: str, delta: int, keys: list[str], order: list, out: str = "session") -> DataFrame:
    """1, 2, ... along the order: a new session where x is over delta above the last non-NULL x. NULL x gives NULL."""
    w = Window.partitionBy(*keys).orderBy(*order)
    last = F.last(x, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    flagged = df.withColumn("__opens", F.coalesce((F.col(x) - last > delta).cast("int"), F.lit(0)))
    return flagged.withColumn(out, F.when(F.col(x).isNotNull(), F.sum("__opens").over(w.rowsBetween(Window.unboundedPreceding, 0)) + 1)).drop("__opens")


def retention(df: DataFrame, keys: list[str], conditions: list[Column], out: str = "retention") -> DataFrame:
    """Whether each condition held for a key, those after the first only together with the first; at most 31 count."""
    flags = [F.coalesce(F.bool_or(c), F.lit(False)).alias(f"__c{i}") for i, c in enumerate(conditions[:31])]
    met = df.groupBy(*keys).agg(*flags)
    return met.select(*keys, F.array(F.col("__c0"), *[F.col("__c0") & F.col(f"__c{i}") for i in range(1, len(flags))]).alias(out))


def window_funnel(df: DataFrame, keys: list[str], ts: str, window_seconds: int, conditions: list[Column], deduplicate: bool = False, fixed: bool = False, increase: bool = False, out: str = "level") -> DataFrame:
    """The longest chain of conditions met in turn within window_seconds of its first event.

    Events are folded in order of time over an array: for each level the start
    of the latest chain that reached it. deduplicate ends a chain at an event
    it already has; fixed ends it at an event out of turn; increase wants
    strictly rising times.
    """
    n = len(conditions)
    level = reduce(lambda rest, p: F.when(p[1], p[0]).otherwise(rest), [(i + 1, c) for i, c in enumerate(conditions)], F.lit(0))
    seen = df.select(*keys, F.unix_micros(F.col(ts).cast("timestamp")).alias("__t"), level.alias("__l")).where("__l > 0")
    rows = seen.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("__t", "__l"))).alias("__e"))
    none = F.lit(None).cast("bigint")
    empty = F.struct(F.array(*[none] * n).alias("start"), F.array(*[none] * n).alias("last"), F.lit(0).alias("best"))

    def fold(acc: Column, e: Column) -> Column:
        t, at = e["__t"], e["__l"]
        prev, prev_last = F.get(acc["start"], at - 2), F.get(acc["last"], at - 2)
        near = prev.isNotNull() & (t - prev <= window_seconds * 1_000_000)
        if increase:
            near = near & (prev_last < t)
        begun = F.when(at == 1, t).when(near, prev)
        moved = F.transform(acc["start"], lambda x, i: F.when((i == at - 1) & begun.isNotNull(), begun).otherwise(x))
        lasts = F.transform(acc["last"], lambda x, i: F.when((i == at - 1) & begun.isNotNull(), t).otherwise(x))
        stop = F.lit(False)
        if deduplicate:
            stop = stop | F.get(acc["start"], at - 1).isNotNull()
        if fixed:
            stop = stop | ((at > 1) & F.get(acc["start"], at - 2).isNull() & F.get(acc["start"], F.lit(0)).isNotNull())
        fresh = F.transform(acc["start"], lambda x, i: F.when((i == 0) & (at == 1), t))
        reached = F.when(begun.isNotNull() & ~stop, F.greatest(acc["best"], at)).otherwise(acc["best"])
        return F.struct(F.when(stop, fresh).otherwise(moved).alias("start"), F.when(stop, fresh).otherwise(lasts).alias("last"), reached.alias("best"))

    levels = rows.select(*keys, F.aggregate("__e", empty, fold, lambda acc: acc["best"]).alias(out))
    return df.select(*keys).distinct().join(levels, keys, "left").select(*keys, F.coalesce(out, F.lit(0)).alias(out))


def equi_height_histogram(df: DataFrame, column: str, buckets: int) -> DataFrame:
    """low, high, rows (up to and with the bucket) and repeats (of high); a bucket closes at its size and extends over ties.

    Values are counted first, so what is ordered is the distinct values.
    """
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(F.count("*").alias("c"))
    total = counts.agg(F.sum("c").alias("n"))
    upto = running_total(counts, ["v"], F.col("c"), "upto").crossJoin(F.broadcast(total))
    bucket = F.ceil(F.col("upto") * buckets / F.col("n")).cast("int")
    rows = upto.withColumn("bucket", bucket).groupBy("bucket")
    return rows.agg(F.min("v").alias("low"), F.max("v").alias("high"), F.max("upto").alias("rows"), F.max_by("c", "v").alias("repeats"))


def mann_whitney_u(df: DataFrame, by: list[str], x: str, group: str) -> DataFrame:
    """by, n1, n2, u and z of the Mann-Whitney U test of x between rows whose group is false and true.

    Ranks come from counts a value, so neither rows of a group nor its values
    are gathered. Rows with a NULL are left out; u is the smaller one, z has the
    continuity correction, and both are NULL where a sample is empty.
    """
    n1, n2 = F.count_if(~F.col(group)), F.count_if(F.col(group))
    counts = df.where(F.col(x).isNotNull() & F.col(group).isNotNull()).groupBy(*by, x).agg(n1.alias("a"), n2.alias("b"))
    w = Window.partitionBy(*by).orderBy(x).rowsBetween(Window.unboundedPreceding, -1)
    ranked = counts.withColumn("t", F.col("a") + F.col("b")).withColumn("rank", F.coalesce(F.sum("t").over(w), F.lit(0)) + (F.col("t") + 1) / 2)
    t = F.col("t").cast("double")
    sums = ranked.groupBy(*by).agg(F.sum("a").alias("n1"), F.sum("b").alias("n2"), F.sum(F.col("rank") * F.col("a")).alias("ranks"), F.sum(t * t * t - t).alias("ties"))
    n, pairs = F.col("n1") + F.col("n2"), F.col("n1") * F.col("n2")
    u1 = F.col("ranks") - F.col("n1") * (F.col("n1") + 1) / 2
    sd = F.sqrt(pairs / 12.0 * (n + 1 - F.col("ties") / (n * (n - 1))))
    both = F.when(pairs > 0, F.least(u1, pairs - u1))
    z = F.when(pairs > 0, F.when(sd > 0, (F.greatest(u1, pairs - u1) - pairs / 2.0 - 0.5) / sd).otherwise(0.0))
    return sums.select(*by, "n1", "n2", both.alias("u"), z.alias("z"))
