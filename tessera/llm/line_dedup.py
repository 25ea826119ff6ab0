"""Line deduplication by range-partitioned line hashes.

Each line becomes a row of 128-bit line hash, document and position. The rows
are range-partitioned by (hash, document) and sorted by (hash, document,
position), so that one pass over a partition sees a line's occurrences in
order. A very frequent line spreads over several partitions; what its pieces
count is put together from one row per piece. The result is a compressed keep
bitmap per document, not text.

Defined cases. Null text: one empty line. A document is a pair of doc_id and
text: repeated equal rows count once and get the same result; a null doc_id is
a value like others. Empty keys never count. An empty table gives an empty
result. Only doc_id and text are read; other columns pass through untouched.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, as_bytes, content_key, passing, tidy

LINE_ROWS = "__h1 long, __h2 long, doc_id long, __k1 long, __k2 long, __pos int"
STREAMED = "__kind int, __h1 long, __h2 long, __k1 long, __k2 long, __pos int, __part int, __first boolean, __n long"
DROP, OPEN, COUNT = 0, 1, 2


def line_key(line: bytes) -> bytes:
    """The line without [\\x20\\x09-\\x0D] at its ends, A-Z in lower case."""
    return line.strip(b" \t\n\x0b\x0c\r").lower()


def _line_rows(min_chars: int):
    def rows(batches):
        for batch in batches:
            digests, at, pos = bytearray(), [], []
            for i, text in enumerate(as_bytes(batch.column("text"))):
                for p, key in enumerate(map(line_key, text.split(b"\n"))):
                    if key and (min_chars <= 1 or len(key.decode()) >= min_chars):
                        digests += xxhash.xxh3_128_digest(key)
                        at.append(i)
                        pos.append(p)
            h = np.frombuffer(bytes(digests), dtype="<i8").reshape(-1, 2)
            at = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.ascontiguousarray(h[:, 0])),
                    pa.array(np.ascontiguousarray(h[:, 1])),
                    *(batch.column(c).take(at) for c in ("doc_id", "__k1", "__k2")),
                    pa.array(pos, pa.int32()),
                ],
                names=["__h1", "__h2", "doc_id", "__k1", "__k2", "__pos"],
            )

    return rows


def _stream(min_docs: int, keep_first: bool):
    """One pass over sorted rows. Runs inside a partition are settled at once.

    The first and the last run of a partition may go on in a neighbour: each
    gives a COUNT row, and where its own documents do not reach min_docs, its
    rows stay OPEN. So what is buffered is under min_docs documents' rows.
    """

    def out(kind, h, rows, first, part, n=0):
        size = len(rows)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(size, kind, np.int32)),
                pa.array(np.full(size, h[0], np.int64)) if isinstance(h, tuple) else pa.array(h[:, 0]),
                pa.array(np.full(size, h[1], np.int64)) if isinstance(h, tuple) else pa.array(h[:, 1]),
                *(pa.array(np.ascontiguousarray(rows[:, j])) for j in (0, 1)),
                pa.array(rows[:, 2].astype(np.int32)),
                pa.array(np.full(size, part, np.int32)),
                pa.array(np.asarray(first, dtype=bool)),
                pa.array(np.full(size, n, np.int64)),
            ],
            names=["__kind", "__h1", "__h2", "__k1", "__k2", "__pos", "__part", "__first", "__n"],
        )

    def settle(h, rows, docs, boundary, part, started):
        """The rows of one run, or of its latest piece; started: earlier rows of the run are out."""
        first = np.zeros(len(rows), bool)
        if len(rows) and not started:
            first[0] = True
        if docs >= min_docs:
            gone = rows[~first] if keep_first else rows
            if len(gone):
                yield out(DROP, h, gone, np.zeros(len(gone), bool), part)
            if keep_first and boundary and first.any():
                yield out(OPEN, h, rows[:1], [True], part)
        elif boundary and len(rows):
            yield out(OPEN, h, rows, first, part)

    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        h, rows, docs, last, started, is_first, before = None, np.empty((0, 3), np.int64), 0, None, False, True, None
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("__h1", "__h2", "__k1", "__k2", "__pos")]
            hs = np.stack(cols[:2], axis=1)
            body = np.stack([cols[2], cols[3], cols[4].astype(np.int64)], axis=1)
            row = np.concatenate([hs, body], axis=1)
            once = np.r_[before is None or bool((row[0] != before).any()), (row[1:] != row[:-1]).any(axis=1)]  # equal rows are one
            before = row[-1]
            if not once.any():
                continue
            hs, body = hs[once], body[once]
            new_run = np.r_[True, (hs[1:] != hs[:-1]).any(axis=1)]
            new_doc = new_run | np.r_[True, (body[1:, :2] != body[:-1, :2]).any(axis=1)]
            starts = np.flatnonzero(new_run)
            ends = np.r_[starts[1:], len(hs)]
            counts = np.add.reduceat(new_doc.astype(np.int64), starts)
            plain = np.zeros(len(hs), bool)
            for j in np.flatnonzero((counts >= min_docs) | (np.arange(len(starts)) == 0) | (np.arange(len(starts)) == len(starts) - 1)):
                s, e, here = starts[j], ends[j], (int(hs[starts[j], 0]), int(hs[starts[j], 1]))
                if h == here:
                    more = int(counts[j]) - int(last == tuple(body[s, :2]))
                    rows, docs = np.concatenate([rows, body[s:e]]), docs + more
                else:
                    if h is not None:
                        yield from settle(h, rows, docs, is_first, part, started)
                        if is_first:
                            yield out(COUNT, h, np.zeros((1, 3), np.int64), [False], part, docs)
                        is_first = False
                    if 0 < j < len(starts) - 1:
                        plain[s + keep_first : e] = True
                        h = None
                        continue
                    h, rows, docs, started = here, body[s:e], int(counts[j]), False
                last = tuple(body[e - 1, :2])
                if docs >= min_docs:  # settled whatever follows: nothing to keep in memory
                    yield from settle(h, rows, docs, True, part, started)
                    rows, started = np.empty((0, 3), np.int64), True
            if plain.any():
                yield out(DROP, hs[plain], body[plain], np.zeros(int(plain.sum()), bool), part)
        if h is not None:
            yield from settle(h, rows, docs, True, part, started)
            yield out(COUNT, h, np.zeros((1, 3), np.int64), [False], part, docs)

    return run


def _bitmaps(batches):
    for batch in batches:
        maps, n = [], []
        for gone in batch.column("__gone").to_pylist():
            bits = np.ones(max(gone) // 8 * 8 + 8, np.uint8)
            bits[gone] = 0
            maps.append(zlib.compress(np.packbits(bits, bitorder="little").tobytes()))
            n.append(len(gone))
        yield pa.RecordBatch.from_arrays(
            [batch.column("__k1"), batch.column("__k2"), pa.array(n, pa.int64()), pa.array(maps, pa.binary())],
            names=["__k1", "__k2", "n_dropped", "keep_bitmap"],
        )


def keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.withColumn("__text", text).select("*", *content_key("doc_id", "__text")).drop("__text")


def line_keep_bitmaps(docs: DataFrame, min_docs: int = 10, keep: str = "none", min_chars: int = 1) -> DataFrame:
    """Keep bitmaps of the documents that lose lines: __k1, __k2, n_dropped, keep_bitmap.

    A key found in at least min_docs documents loses all its lines (keep
    "none") or all but its first by doc_id and position (keep "first"). A
    bitmap is zlib-compressed, little-endian bits, 1 for a line that stays;
    lines beyond its end stay.
    """
    if keep not in ("none", "first"):
        raise ValueError("keep is 'none' or 'first'")
    spark = docs.sparkSession
    with Scratch(spark) as scratch:
        lines = keyed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).mapInArrow(tidy(_line_rows(min_chars)), LINE_ROWS)
        lines = scratch.table(lines, "lines")  # range bounds are sampled from this, not from the texts again
        by = ["__h1", "__h2", "doc_id", "__k1", "__k2"]
        streamed = lines.repartitionByRange(*by).sortWithinPartitions(*by, "__pos").mapInArrow(tidy(_stream(min_docs, keep == "first")), STREAMED)
        streamed = scratch.table(streamed, "streamed")
        # At most two COUNT rows a partition, so this fits a broadcast.
        whole = streamed.where(F.col("__kind") == COUNT).groupBy("__h1", "__h2").agg(F.sum("__n").alias("__docs"), F.min("__part").alias("__from")).where(F.col("__docs") >= min_docs)
        opened = streamed.where(F.col("__kind") == OPEN).join(F.broadcast(whole), ["__h1", "__h2"])
        if keep == "first":
            opened = opened.where(~(F.col("__first") & (F.col("__part") == F.col("__from"))))
        gone = streamed.where(F.col("__kind") == DROP).select("__k1", "__k2", "__pos").union(opened.select("__k1", "__k2", "__pos"))
        lists = gone.groupBy("__k1", "__k2").agg(F.collect_set("__pos").alias("__gone"))
        return scratch.table(lists.mapInArrow(_bitmaps, "__k1 long, __k2 long, n_dropped long, keep_bitmap binary"), "bitmaps", keep=True)


def kept_lines(text: bytes, bitmap: bytes | None) -> tuple[bytes, int]:
    lines = text.split(b"\n")
    if bitmap is None:
        return text, len(lines)
    bits = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), bitorder="little")
    return b"\n".join(x for i, x in enumerate(lines) if i >= len(bits) or bits[i]), len(lines)


def _with_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    return keyed(docs).join(bitmaps.hint("shuffle_hash"), ["__k1", "__k2"], "left")


def _digest(batches):
    for batch in batches:
        n, sha = [], []
        for text, bitmap in zip(as_bytes(batch.column("text")), batch.column("keep_bitmap").to_pylist(), strict=True):
            kept, lines = kept_lines(text, bitmap)
            n.append(lines)
            sha.append(hashlib.sha256(kept).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(n, pa.int64()), batch.column("n_dropped").fill_null(0), pa.array(sha)],
            names=["doc_id", "n_lines", "n_dropped", "kept_sha256"],
        )


def line_dedup_digest(docs: DataFrame, min_docs: int = 10) -> DataFrame:
    """doc_id, n_lines, n_dropped and the SHA-256 of what each document keeps."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    joined = _with_bitmaps(docs, line_keep_bitmaps(docs, min_docs)).select("doc_id", "text", "n_dropped", "keep_bitmap")
    return joined.mapInArrow(_digest, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


def line_dedup(docs: DataFrame, min_docs: int = 10, keep: str = "none") -> DataFrame:
    """The documents with their kept lines as text; n_chars, where present, is counted anew. Other columns may have any names."""
    return passing(docs, ("doc_id", "text", "n_chars"), lambda d: _line_dedup(d, min_docs, keep))


def _line_dedup(docs: DataFrame, min_docs: int, keep: str) -> DataFrame:
    names = docs.columns

    def rebuilt(batches):
        for batch in batches:
            out = [kept_lines(t, b)[0] for t, b in zip(as_bytes(batch.column("text")), batch.column("__bitmap").to_pylist(), strict=True)]
            cols = {c: batch.column(c) for c in names}
            cols["text"] = pa.array(out, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_pydict(cols)

    bitmaps = line_keep_bitmaps(docs, min_docs, keep).select("__k1", "__k2", F.col("keep_bitmap").alias("__bitmap"))
    changed = _with_bitmaps(docs, bitmaps).select(*[F.col(f"`{c}`") for c in names], "__bitmap").mapInArrow(tidy(rebuilt), docs.schema)
    return changed.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in names else changed
