"""Approximate nearest neighbours with an inverted multi-index.

Each vector half is quantised by its own K centroids, so K * K cells come from
2 K centroids. A query orders the centroids of either half by distance (the
negative inner product, as the nearness is the inner product) and walks the
pairs by summed distance with a heap, until the cells seen hold enough
entries. All entries of those cells are reranked with the exact measure.

Centroids are fitted on at most SAMPLE_ROWS vectors, the first by a hash of
vec_id; every vector is indexed. What goes to the driver is that sample and at
most K * K cell counts. Reranking runs over tiles of a strip of cells (some
first-half centroids) by block of queries by block of entries, so a cell with
very many equal vectors spreads over tiles, and each tile keeps the best few.

Defined cases. Vectors that are null, zero, of another length than most, or
hold null or non-finite components take no part, as query or entry. Ties go to
the smaller vec_id. Repeated rows of a vec_id: one of them counts, the first by
its components. Null vec_id takes no part. An empty table gives no rows.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

SAMPLE_ROWS = 20_000
MOST_CENTROIDS, STRIPS = 128, 16
QUERIES_A_TASK = 128
PROBE_SHARE, LEAST_PROBED = 0.4, 2000
BLOCK = 2048
SEED = 5


def kmeans(x: np.ndarray, k: int, seed: int, rounds: int = 15) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        own = (x @ c.T - (c * c).sum(axis=1) / 2).argmax(axis=1)
        n = np.bincount(own, minlength=k)
        s = np.zeros_like(c)
        np.add.at(s, own, x)
        c = np.where(n[:, None] > 0, s / np.maximum(n, 1)[:, None], x[rng.choice(len(x), k)])
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (x @ c.T - (c * c).sum(axis=1) / 2).argmax(axis=1)


def walk(first: np.ndarray, second: np.ndarray, counts: dict[int, int], enough: int) -> list[int]:
    """Cells i * K + j by rising first[i] + second[j] until they hold enough entries (the multi-sequence algorithm)."""
    k = len(second)
    a, b = first.argsort(kind="stable"), second.argsort(kind="stable")
    heap, seen, cells, held = [(first[a[0]] + second[b[0]], 0, 0)], {(0, 0)}, [], 0
    while heap and held < enough:
        _, i, j = heapq.heappop(heap)
        cell = int(a[i]) * k + int(b[j])
        if n := counts.get(cell):
            cells.append(cell)
            held += n
        for p, q in ((i + 1, j), (i, j + 1)):
            if p < len(a) and q < k and (p, q) not in seen:
                seen.add((p, q))
                heapq.heappush(heap, (first[a[p]] + second[b[q]], p, q))
    return cells


def usable(vectors: DataFrame, scratch: Scratch) -> tuple[DataFrame, int]:
    """vec_id and v (array<double>) of the rows that take part, and the length of v."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null and size(v) > 0")
    # A second half for vectors of one component.
    rows = rows.withColumn("v", F.when(F.size("v") == 1, F.concat("v", F.array(F.lit(0.0)))).otherwise(F.col("v")))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = rows.where(F.coalesce(finite, F.lit(False)) & F.exists("v", lambda x: x != 0))
    rows = scratch.table(rows.groupBy("vec_id").agg(F.min("v").alias("v")), "vectors", keep=True)
    size = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return (rows.where(F.size("v") == size["d"]), size["d"]) if size else (rows, 0)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def search(vectors: DataFrame, every: int, k: int = 20, share: float = PROBE_SHARE, least: int = LEAST_PROBED, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest to each vector whose id is divisible by every."""
    out = "query_id long, vec_id long, score double"
    with Scratch(vectors.sparkSession) as scratch:
        rows, d = usable(vectors, scratch)
        n = rows.count()
        if not n:
            return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
        half = d // 2
        got = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample_rows).collect()
        sample = np.array([r["v"] for r in got])
        kc = max(1, min(MOST_CENTROIDS, len(sample) // 16))
        wide = -(-kc // STRIPS) * kc  # cells in a strip
        c1, c2 = kmeans(sample[:, :half], kc, SEED), kmeans(sample[:, half:], kc, SEED + 1)

        def cells(batches):
            for batch in batches:
                x = _matrix(batch.column("v"))
                cell = nearest(x[:, :half], c1).astype(np.int64) * kc + nearest(x[:, half:], c2)
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(cell)], names=["vec_id", "v", "cell"])

        index = scratch.table(rows.mapInArrow(cells, "vec_id long, v array<double>, cell long"), "index", keep=True)
        counts = {r["cell"]: r["count"] for r in index.groupBy("cell").count().collect()}  # kc * kc rows at most
        enough = max(least, int(share * n)) + 1

        def probes(batches):
            for batch in batches:
                x, at, strips, visited = _matrix(batch.column("v")), [], [], []
                near1, near2 = -(x[:, :half] @ c1.T), -(x[:, half:] @ c2.T)
                for i in range(len(x)):
                    cells = np.array(walk(near1[i], near2[i], counts, enough), np.int64)
                    bits = np.zeros((-(-kc * kc // wide), wide), bool)
                    bits[cells // wide, cells % wide] = True
                    own = np.flatnonzero(bits.any(axis=1))
                    at += [i] * len(own)
                    strips += own.tolist()
                    visited += [np.packbits(bits[j]).tobytes() for j in own]
                at = pa.array(at, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("vec_id").take(at), batch.column("v").take(at), pa.array(strips, pa.int64()), pa.array(visited, pa.binary())],
                    names=["query_id", "q", "strip", "cells"],
                )

        asked = rows.where(F.col("vec_id") % every == 0)
        asked = asked.repartition(max(1, -(-asked.count() // QUERIES_A_TASK)), "vec_id")
        asked = scratch.table(asked.mapInArrow(probes, "query_id long, q array<double>, strip long, cells binary"), "probes", keep=True)
        strip = F.floor(F.col("cell") / wide).cast("long")
        sizes = index.groupBy(strip.alias("strip")).count().withColumnRenamed("count", "__v").join(asked.groupBy("strip").count().withColumnRenamed("count", "__q"), "strip")
        blocks = {r["strip"]: (-(-r["__v"] // BLOCK), -(-r["__q"] // BLOCK)) for r in sizes.collect()}  # STRIPS rows at most
        by = F.create_map(*[F.lit(x) for s, (v, q) in blocks.items() for x in (s, F.struct(F.lit(v).alias("v"), F.lit(q).alias("q")))]) if blocks else None
        if by is None:
            return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
        entries = index.select("vec_id", "v", (F.col("cell") % wide).cast("int").alias("cell"), strip.alias("strip")).withColumn("b", by[F.col("strip")]).where("b is not null")
        entries = entries.withColumn("vb", F.pmod(F.xxhash64("vec_id"), F.col("b.v"))).withColumn("qb", F.explode(F.sequence(F.lit(0).cast("long"), F.col("b.q").cast("long") - 1))).drop("b")
        ask = asked.withColumn("b", by[F.col("strip")]).withColumn("qb", F.pmod(F.xxhash64("query_id"), F.col("b.q"))).withColumn("vb", F.explode(F.sequence(F.lit(0).cast("long"), F.col("b.v").cast("long") - 1))).drop("b")

        def rerank(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            if left.empty or right.empty:
                return pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
            v, ids, cell = np.stack(left["v"].to_numpy()), left["vec_id"].to_numpy(), left["cell"].to_numpy()
            found = []
            for qid, q, own in zip(right["query_id"], right["q"], right["cells"], strict=True):
                seen = np.unpackbits(np.frombuffer(own, np.uint8), count=wide).view(bool)
                at = np.flatnonzero(seen[cell] & (ids != qid))
                if not len(at):
                    continue
                rough = v[at] @ q
                if len(at) > k:  # all that may stand among the best, equal ones included
                    at = at[rough >= np.partition(rough, len(rough) - k)[len(rough) - k] - 1e-9]
                score = (v[at] * q).sum(axis=1)
                best = np.lexsort((ids[at], -score))[:k]
                found.append((np.full(len(best), qid), ids[at][best], score[best]))
            cols = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]
            return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), cols, strict=True)))

        tile = ["strip", "vb", "qb"]
        near = entries.groupBy(*tile).cogroup(ask.groupBy(*tile)).applyInPandas(rerank, out)
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        return near.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
