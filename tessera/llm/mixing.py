"""Mixing sources to target weights by Sainte-Laguë apportionment.

The mix is cut into blocks of equal size in words. Blocks go to sources by
highest quotients target / (2 k + 1), then each source's blocks go to its
shards by the same rule over the shards' sizes. So every shard has an integer
quota before anything is selected, and shards need not know of one another.
Within a shard the documents stand in a seeded order, and the quota takes
whole passes over them and then a prefix.

Defined cases. Null text has size 0 and is never taken. A null source is a
source of its own, last in order. Repeated rows are rows of their own. Sources
of size 0 get target 0. An empty table gives an empty result.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, as_bytes, passing, tidy

WEIGHTS = (3, 1, 2)
BLOCK_WORDS = 64
SHARD_DOCS = 4096
SEED = 20_240_229


def apportion(targets: np.ndarray, seats: int) -> np.ndarray:
    """Sainte-Laguë: seats go one by one to the highest quotient target / (2 k + 1); ties to the smaller index.

    All seats whose quotients surely stand among the highest are given at
    once; the heap only deals out the last ones, about half as many as there
    are targets.
    """
    targets = np.asarray(targets, dtype=np.float64)
    given = np.zeros(len(targets), np.int64)
    total = targets.sum()
    if seats <= 0 or total <= 0:
        return given
    # With this divisor at most `seats` quotients reach it, as each target rounds up by a half at most.
    spare = seats - (targets > 0).sum() / 2
    if spare > 0:
        given = np.floor(targets / (total / spare) * (1 - 1e-12) + 0.5).astype(np.int64)
    heap = [(-t / (2 * int(g) + 1), i) for i, (t, g) in enumerate(zip(targets, given, strict=True)) if t > 0]
    heapq.heapify(heap)
    for _ in range(seats - int(given.sum())):
        _, i = heap[0]
        given[i] += 1
        heapq.heapreplace(heap, (-targets[i] / (2 * int(given[i]) + 1), i))
    return given


def filled(sizes: np.ndarray, weights: np.ndarray, total: float, most: float) -> np.ndarray:
    """total shared by weight, each share stopping at most times its size, the excess reshared until none is above."""
    caps = most * sizes.astype(np.float64)
    open_ = caps > 0
    out = np.zeros(len(sizes))
    left = min(total, caps.sum())
    while open_.any():
        share = left * weights / weights[open_].sum()
        over = open_ & (share >= caps)
        if not over.any():
            out[open_] = share[open_]
            break
        out[over] = caps[over]
        left -= caps[over].sum()
        open_ &= ~over
    return out


def _sizes(batches):
    for batch in batches:
        n = pa.array([len(t.split()) for t in as_bytes(batch.column("text"))], pa.int64())
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("__row", "doc_id", "source")), n], names=["__row", "doc_id", "source", "size"])


def row_key(seed: int):
    """Nulls count: a hash passes over them, so where they stand is hashed too."""
    row = ["doc_id", "source", "text", *(F.col(c).isNull() for c in ("doc_id", "source", "text"))]
    return F.concat_ws(":", F.xxhash64(*row), F.xxhash64(F.lit(seed), *row))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = 1.5, most: float = 2.0, block_words: int = BLOCK_WORDS, shard_docs: int = SHARD_DOCS, seed: int = SEED) -> DataFrame:
    """__row (128-bit content key as text), doc_id, source, size, source_size, target, taken for each row of docs.

    weights repeat over the sources in code point order; share is the mix's
    size over that of all documents; most bounds how often a source, and so a
    document, is taken.
    """
    spark = docs.sparkSession
    with Scratch(spark) as scratch:
        rows = docs.select(row_key(seed).alias("__row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), "text")
        rows = rows.mapInArrow(_sizes, "__row string, doc_id long, source string, size long")
        rows = scratch.table(rows, "rows", keep=True)

        # Equal rows share a hash; the salt deals them, and each source, over shards of bounded size.
        source = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("__n"))

        def targets(key, pdf):
            pdf = pdf.assign(__b=[None if s is None else s.encode() for s in pdf["source"]])
            pdf = pdf.sort_values("__b", na_position="last", kind="stable").reset_index(drop=True)
            sizes = pdf["source_size"].to_numpy()
            total = share * sizes.sum()
            w = np.array([weights[i % len(weights)] for i in range(len(pdf))], dtype=np.float64)
            t = filled(sizes, w, total, most)
            pdf["target"] = t
            pdf["__blocks"] = apportion(t, int(round(min(total, t.sum()) / block_words)))
            pdf["__shards"] = (pdf["__n"] // shard_docs + 1).astype(np.int64)
            return pdf[["source", "source_size", "target", "__blocks", "__shards"]]

        # One row a source is small beside the rows it stands for; the write bounds what is computed twice.
        source = scratch.table(source.withColumn("__all", F.lit(0)).groupBy("__all").applyInPandas(targets, "source string, source_size long, target double, __blocks long, __shards long"), "sources", keep=True)
        order = F.xxhash64(F.lit(seed), "__row")
        dealt = (
            rows.join(source, rows["source"].eqNullSafe(source["source"]))
            .select("__row", "doc_id", rows["source"], "size", "source_size", "target", "__blocks", "__shards")
            .withColumn("__shard", F.pmod(F.xxhash64("__row", F.lit("shard")), F.col("__shards")))
        )
        shards = dealt.groupBy("source", "__shard").agg(F.sum("size").alias("__size"), F.first("__blocks").alias("__blocks"))

        def quotas(key, pdf):
            pdf = pdf.sort_values("__shard").reset_index(drop=True)
            pdf["__quota"] = apportion(pdf["__size"].to_numpy(), int(pdf["__blocks"].iloc[0]))
            return pdf[["source", "__shard", "__size", "__quota"]]

        # A shard is thousands of documents, so even a source with a third of all rows has few rows here.
        quota = scratch.table(shards.groupBy("source").applyInPandas(quotas, "source string, __shard long, __size long, __quota long"), "quotas", keep=True)
        q = quota.select(F.col("source").alias("__s"), F.col("__shard").alias("__sh"), "__size", "__quota")
        taken_of = F.least(F.col("__quota") * block_words, F.floor(F.col("__size") * most))
        before = F.coalesce(F.sum("size").over(Window.partitionBy("source", "__shard").orderBy(order, "__row", "doc_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        passes = F.floor(F.try_divide(F.col("__take"), F.col("__size")))
        prefix = F.greatest(F.lit(0), F.least(F.col("size"), F.col("__take") - passes * F.col("__size") - F.col("__before")))
        return (
            dealt.join(q, dealt["source"].eqNullSafe(q["__s"]) & (dealt["__shard"] == q["__sh"]))
            .withColumn("__take", taken_of)
            .withColumn("__before", before)
            .select("__row", "doc_id", "source", "size", "source_size", "target", F.coalesce((passes * F.col("size") + prefix).cast("long"), F.lit(0).cast("long")).alias("taken"))
        )


def mix_digest(docs: DataFrame) -> DataFrame:
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself, with the columns of docs: each whole pass over a document is a row, then a row with its first words, if any.

    n_chars, where present, is counted anew. Of equal rows each is taken by itself. Other columns may have any names.
    """
    return passing(docs, ("doc_id", "source", "text", "n_chars"), lambda d: _mixed(d, **options))


def _mixed(docs: DataFrame, **options) -> DataFrame:
    names = docs.columns
    plan = mix(docs, **options).where("taken > 0").groupBy(F.col("__row").alias("__key"), F.col("size").alias("__size")).agg(F.sort_array(F.collect_list("taken"), asc=False).alias("__takes"))
    keyed = docs.withColumn("__key", row_key(options.get("seed", SEED)))
    nth = keyed.withColumn("__nth", F.row_number().over(Window.partitionBy("__key").orderBy("__key")))

    def taken(batches):
        for batch in batches:
            at, texts = [], []
            plans = (batch.column(c).to_pylist() for c in ("__size", "__takes", "__nth"))
            for i, (text, size, takes, n) in enumerate(zip(as_bytes(batch.column("text")), *plans, strict=True)):
                passes, rest = divmod(takes[n - 1], size) if n <= len(takes) else (0, 0)
                at += [i] * (passes + (rest > 0))
                texts += [text] * passes
                if rest:
                    texts.append(first_words(text, rest))
            at = pa.array(at, pa.int64())
            cols = {c: batch.column(c).take(at) for c in names}
            cols["text"] = pa.array(texts, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_pydict(cols)

    joined = nth.join(plan, "__key").select(*[F.col(f"`{c}`") for c in names], "__size", "__takes", "__nth")
    out = joined.mapInArrow(tidy(taken), docs.schema)
    return out.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in names else out


def first_words(text: bytes, n: int) -> bytes:
    """The text up to the end of its n-th word."""
    rest = text.split(None, n)
    return text if len(rest) <= n else text[: len(text) - len(rest[n])].rstrip(b" \t\n\x0b\x0c\r")
