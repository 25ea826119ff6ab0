"""N-gram Jaccard self-join and its classes.

A document's set is its distinct word shingles, as 64-bit ids that begin with a
class: that of the shingle's rarest word, by counts which a sketch of fixed size
takes over all documents. So sorted ids stand in one common order, rare ones
first. Equal sets are one node. Of n shingles the first n - ceil(t n) + 1 name
the tiles that the set is in: two sets with similarity t or more share a tile
(prefix filter).

Inside a tile a set is compared only with those whose sizes allow a link, and
hashed bitmaps of the sets bound the overlap from above: the overlap is at most
(|A| + |B| - differing bits) / 2. What passes in a tile by short bitmaps is
deduplicated, passes long ones, and is decided by intersecting the sorted
arrays. Tiles beyond BLOCK rows are cut by size band and hash: each row has one
block at home, and only rows outside the component that is the tile's main one
visit the other blocks of their own and the neighbouring bands, streaming by.

First each node is compared with one pivot of its tiles; linked nodes become
components. Then tiles are searched for pairs across components. A tile puts
forward all that the bitmaps allow while these are few for its rows, else the
likeliest few for each edge of a spanning forest of its components; such tiles
are searched again, and after FORESTS rounds one last step decides every pair
still allowed; a round without new pairs makes the next one the last. So large groups of near copies cost about their size, and no link
between different components is lost; many sets all alike and all just below
the threshold cost the square of their number in comparisons of bitmaps.

Defined cases. Null or empty text, or text without words, has an empty set and
is its own class. Fewer words than a shingle's: the whole sequence is the one
shingle. A null doc_id takes no part and has class null. Repeated rows get
equal results; ties between pivots go to the smaller node. An empty table gives
an empty result. Whole texts are read; other columns aren't, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, content_key, few, only, tidy, unused

BLOCK = 8192
BITS_PER_DIFFERENCE = 12
SHORT_BITS = 512
FORESTS = 4
SMALL_TILE, PAIRS_AT_ONCE = 32, 1 << 16
TILE_SHINGLES = 1 << 21
SKETCH_BITS, CHUNK = 20, 4096
HASH_BITS = 57
BYTES_AT_ONCE = 1 << 19
U64 = np.uint64


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit integers."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class Words:
    """Word hashes of whole texts, over the bytes of many texts at once: A-Z lowered, words parted by ASCII white space."""

    BASE = 0x9E3779B97F4A7C15

    def __init__(self):
        letters = np.arange(256, dtype=np.uint8)
        letters[65:91] += 32
        self.value = mixed(letters.astype(U64) * U64(0xD6E8FEB86659FD93) + U64(0x1234567))
        self.space = np.zeros(256, bool)
        self.space[[32, *range(9, 14)]] = True
        self.powers = self.inverses = np.ones(1, U64)

    def _grow(self, n: int) -> None:
        if len(self.powers) < n:
            n = max(n, BYTES_AT_ONCE)
            back = U64(pow(self.BASE, -1, 1 << 64))
            self.powers, self.inverses = (np.cumprod(np.r_[U64(1), np.full(n - 1, b, U64)]) for b in (U64(self.BASE), back))

    def of(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """hash of each word, and where each text's words begin (and the last one's end). data: UTF-8; bounds: the texts' bounds in it."""
        space = self.space[data]
        first, last = ~space, ~space
        first[1:] &= space[:-1]
        last[:-1] &= space[1:]
        inner = bounds[(bounds > 0) & (bounds < len(data))]
        first[inner] = ~space[inner]
        last[inner - 1] = ~space[inner - 1]
        s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
        out = np.empty(len(s), U64)
        at = 0
        while at < len(s):  # a polynomial in the bytes, from running sums over stretches of words
            to = max(at + 1, int(np.searchsorted(e, s[at] + BYTES_AT_ONCE, side="right")))
            lo, hi = int(s[at]), int(e[to - 1])
            self._grow(hi - lo + 1)
            run = np.zeros(hi - lo + 1, U64)
            np.cumsum(self.value[data[lo:hi]] * self.powers[: hi - lo], out=run[1:])
            b, f = s[at:to] - lo, e[at:to] - lo
            out[at:to] = mixed((run[f] - run[b]) * self.inverses[b] + (f - b).astype(U64))
            at = to
        return out, np.searchsorted(s, bounds)


def texts_of(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Of a string column, runs of texts as (first row, bytes, bounds); null is empty. A run ends at BYTES_AT_ONCE, texts are whole."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = pc.fill_null(column, b"")
    _, offsets, data = column.buffers()
    if not len(column):
        return
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + BYTES_AT_ONCE, side="right")) - 1)
        yield at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


class Shingler:
    """Sorted distinct shingle ids of texts. common: the class of each slot of the word sketch."""

    def __init__(self, words: int, common: np.ndarray):
        self.words, self.common, self.reader = words, common.astype(U64), Words()

    def _ids(self, h: np.ndarray, wide: int) -> np.ndarray:
        n = len(h) - wide + 1
        out, kind = np.full(n, wide, U64), np.full(n, 127, U64)
        own = self.common[slot(h)]
        for i in range(wide):
            out = mixed(out * U64(0x9E3779B97F4A7C15) + h[i : i + n])
            kind = np.minimum(kind, own[i : i + n])
        return (kind << U64(HASH_BITS)) | (out >> U64(64 - HASH_BITS))

    def sets(self, column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
        for row, data, bounds in texts_of(column):
            h, at = self.reader.of(data, bounds)
            ids = self._ids(h, self.words) if len(h) >= self.words else h
            for i, (s, e) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True), row):
                if e - s >= self.words:
                    own = np.sort(ids[s : e - self.words + 1])
                    new = own[1:] != own[:-1]
                    yield i, own if new.all() else own[np.r_[True, new]]
                else:
                    yield i, self._ids(h[s:e], e - s) if e > s else h[:0]


class Bands:
    """Size bands and the numbers that follow from them. threshold is num / den."""

    def __init__(self, num: int, den: int):
        self.num, self.den, self.starts = num, den, [1]

    def of(self, size: int) -> int:
        while self.starts[-1] <= size:
            self.starts.append(self.starts[-1] * self.den // self.num + 1)
        return int(np.searchsorted(self.starts, size, side="right")) - 1

    def start(self, band: int) -> int:
        while len(self.starts) <= band:
            self.starts.append(self.starts[-1] * self.den // self.num + 1)
        return self.starts[band]

    def linked(self, a: int, b: int, overlap: int) -> bool:
        return self.den * overlap >= self.num * (a + b - overlap)

    def width(self, band: int) -> int:
        """Bits of this band's bitmaps: a power of two, some times as many as linked sets may differ in."""
        most = (self.start(band + 1) - 1) * (self.den - self.num) // self.num + 1
        return max(SHORT_BITS, 1 << (BITS_PER_DIFFERENCE * most - 1).bit_length())


def bitmap(h: np.ndarray, width: int) -> np.ndarray:
    """The parity of the set's ids by slot: every element in which two sets differ changes one bit at most."""
    slots = (mixed(h ^ U64(0xA5A5)) & U64(width - 1)).astype(np.int64)
    return np.packbits((np.bincount(slots, minlength=width) & 1).astype(bool), bitorder="little")


def folded(bits: np.ndarray) -> np.ndarray:
    """A longer bitmap cut down to SHORT_BITS: what bitmap() gives for that width."""
    return np.bitwise_xor.reduce(bits.reshape(-1, SHORT_BITS // 8), axis=0)


def slot(h: np.ndarray) -> np.ndarray:
    return (h >> U64(64 - SKETCH_BITS)).astype(np.int64)


def rarest(ids: np.ndarray, num: int, den: int) -> np.ndarray:
    """The set's first ids in the common order, as many as the prefix filter needs."""
    n = len(ids)
    return ids[: n - -(-num * n // den) + 1]


def _counts(batches):
    """The word sketch's counters over a partition, in chunks."""
    reader, total = Words(), np.zeros(1 << SKETCH_BITS, np.int64)
    for batch in batches:
        for _, data, bounds in texts_of(batch.column("text")):
            at, n = np.unique(slot(reader.of(data, bounds)[0]), return_counts=True)
            total[at] += n
    for i, part in enumerate(total.reshape(-1, CHUNK)):
        if part.any():
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([part.astype("<i8").tobytes()], pa.binary())], names=["chunk", "counts"])


def _added(batches):
    """Sums of the counters of equal chunks, which stand side by side."""
    last, total = None, None
    for batch in batches:
        for chunk, raw in zip(batch.column("chunk").to_pylist(), batch.column("counts").to_pylist(), strict=True):
            if chunk != last:
                if last is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([last], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["chunk", "counts"])
                last, total = chunk, np.zeros(CHUNK, np.int64)
            total += np.frombuffer(raw, "<i8")
    if last is not None:
        yield pa.RecordBatch.from_arrays([pa.array([last], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["chunk", "counts"])


def commonness_of(docs: DataFrame) -> np.ndarray:
    """For each slot of the word sketch a class by its count, two to a power of two: of fixed size, over all documents."""
    kind = "chunk int, counts binary"
    parts = docs.select("text").mapInArrow(tidy(_counts), kind)
    total = np.zeros(1 << SKETCH_BITS, np.int64).reshape(-1, CHUNK)
    summed = few(parts.repartition("chunk"), total.shape[0]).sortWithinPartitions("chunk").mapInArrow(_added, kind)
    for row in summed.collect():  # as many rows as chunks
        total[row["chunk"]] = np.frombuffer(row["counts"], np.int64)
    return (2 * np.log2(1.0 + total.reshape(-1))).astype(np.uint8)


SETS = "doc_id long, __k1 long, node long, n long, band int, keys array<long>, short binary, bits binary"


def node_of(ids: np.ndarray) -> int:
    x = xxhash.xxh3_64_intdigest(ids.tobytes())
    return x if x < 1 << 63 else x - (1 << 64)


def _sets(words: int, num: int, den: int, common):
    """One row a document; keys and bitmaps only at a set's first row in a partition. bits is null where the short one is all."""

    def run(batches):
        shingler, bands, seen = Shingler(words, common.value), Bands(num, den), set()
        for batch in batches:
            nodes, sizes, band, keys, short, bits = [], [], [], [], [], []
            for doc_id, (_, ids) in zip(batch.column("doc_id").to_pylist(), shingler.sets(batch.column("text")), strict=True):
                node = node_of(ids) if len(ids) and doc_id is not None else None
                nodes.append(node)
                sizes.append(len(ids))
                band.append(bands.of(len(ids)) if len(ids) else -1)
                if node is None or node in seen:
                    for c in (keys, short, bits):
                        c.append(None)
                    continue
                seen.add(node)
                keys.append(rarest(ids, num, den).view(np.int64))
                own = bitmap(ids, bands.width(band[-1]))
                short.append(folded(own).tobytes())
                bits.append(own.tobytes() if 8 * len(own) > SHORT_BITS else None)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), batch.column("__k1"), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(band, pa.int32()),
                    pa.array(keys, pa.list_(pa.int64())), pa.array(short, pa.binary()), pa.array(bits, pa.binary()),
                ],
                names=["doc_id", "__k1", "node", "n", "band", "keys", "short", "bits"],
            )

    return run


def _shared(batches):
    """Of rows sorted by key and node, those whose key has several nodes, with the key's first node as pivot and their place in the tile."""
    key = pivot = last = None
    n, alone = 0, False  # nodes of the last key so far; whether its first row is held back
    for batch in batches:
        if not batch.num_rows:
            continue
        k, v = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "node"))
        new = np.r_[key is None or k[0] != key or v[0] != last, (k[1:] != k[:-1]) | (v[1:] != v[:-1])]
        k, v = k[new], v[new]
        if not len(k):
            continue
        if key is not None and k[0] == key and alone:
            k, v, n = np.r_[key, k], np.r_[pivot, v], 0
        goes_on = key is not None and n and k[0] == key
        starts = np.flatnonzero(np.r_[not goes_on, k[1:] != k[:-1]])
        run = np.searchsorted(starts, np.arange(len(k)), side="right") - 1
        first = starts[np.maximum(run, 0)] if len(starts) else np.zeros(len(k), int)
        pivots = np.where(run >= 0, v[first], pivot if goes_on else 0)
        nth = np.where(run >= 0, np.arange(len(k)) - first, np.arange(len(k)) + n)
        many = np.r_[starts[1:], len(k)] - starts > 1
        keep = np.where(run >= 0, many[np.maximum(run, 0)], True) if len(starts) else np.ones(len(k), bool)
        yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (k, v, pivots, nth)], names=["key", "node", "pivot", "nth"])
        alone = bool(len(starts)) and not many[-1]
        key, pivot, last, n = k[-1], pivots[-1], v[-1], int(nth[-1]) + 1


def arrays(docs: DataFrame, nodes: DataFrame, words: int, common, scratch: Scratch, name: str) -> DataFrame:
    """node, h: the arrays of the nodes, from their texts again. nodes, of a written table: __k1, the key of a text of each."""

    def run(batches):
        shingler, seen = Shingler(words, common.value), set()
        for batch in batches:
            rows, own = [], []
            for k, (_, ids) in zip(batch.column("__k1").to_pylist(), shingler.sets(batch.column("text")), strict=True):
                if k not in seen:
                    seen.add(k)
                    own.append(node_of(ids))
                    rows.append(ids.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array(rows, pa.binary())], names=["node", "h"])

    text = only(docs.select("__k1", "text").where("text is not null"), nodes, "__k1").mapInArrow(tidy(run), "node long, h binary")
    return scratch.table(few(text.dropDuplicates(["node"]), nodes.count(), 2000), name)


def overlap(x: np.ndarray, y: np.ndarray) -> int:
    """The size of the intersection of sorted arrays."""
    both = np.concatenate((x, y))
    both.sort()
    return int((both[1:] == both[:-1]).sum())


def _verify(num: int, den: int):
    def run(batches):
        bands = Bands(num, den)
        for batch in batches:
            keep = []
            for a, b in zip(batch.column("ha"), batch.column("hb"), strict=True):
                x, y = np.frombuffer(a.as_buffer(), U64), np.frombuffer(b.as_buffer(), U64)
                keep.append(bands.linked(len(x), len(y), overlap(x, y)))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], names=["a", "b"])

    return run


def _allowed(num: int, den: int):
    """Of pairs with both bitmaps, those that the bound lets be linked."""

    def run(batches):
        for batch in batches:
            keep = []
            for n, m, x, y in zip(*(batch.column(c).to_pylist() for c in ("na", "nb", "xa", "xb")), strict=True):
                x, y = sorted((np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)), key=len)
                if len(y) > len(x):  # the wider bitmap, folded
                    y = np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0)
                most = (n + m - int(np.bitwise_count(y ^ x).sum())) // 2
                keep.append(den * most >= num * (n + m - most))
            keep = pa.array(keep, pa.bool_())
            names = ["a", "b", "ka", "kb"]
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(keep) for c in names], names=names)

    return run


def allowed(pairs: DataFrame, info: DataFrame, num: int, den: int, rows: int) -> DataFrame:
    """Of distinct pairs a, b, at most so many rows, those that the long bitmaps let be linked, with the keys of a text of each."""
    own = info.select("node", "n", "__k1", F.coalesce("bits", "short").alias("x"))
    one = pairs.join(own.toDF("b", "nb", "kb", "xb"), "b")
    both = one.join(own.toDF("a", "na", "ka", "xa"), "a")
    return few(both, rows, 20_000).select("a", "b", "ka", "kb", "na", "nb", "xa", "xb").mapInArrow(_allowed(num, den), "a long, b long, ka long, kb long")


def verified(pairs: DataFrame, docs: DataFrame, words: int, common, scratch: Scratch, name: str, num: int, den: int) -> DataFrame:
    """The pairs a, b that are linked, by intersecting sorted arrays, which only these pairs' nodes get. pairs: a written table, with ka, kb."""
    arr = arrays(docs, pairs.select(F.col("ka").alias("__k1")).union(pairs.select("kb")), words, common, scratch, f"{name}-arrays")
    one = pairs.select("a", "b").join(arr.toDF("a", "ha"), "a")
    both = few(one.join(arr.toDF("b", "hb"), "b"), pairs.count(), 2000)
    links = scratch.table(both.select("a", "b", "ha", "hb").mapInArrow(_verify(num, den), "a long, b long"), f"{name}-links")
    scratch.drop(f"{name}-arrays")
    return links


def _star(large: bool):
    """Of distinct edges sorted by u and v, one star operation: u's neighbours go to the smallest of them and u.

    Large stars read edges both ways and move the larger neighbours; small stars read edges to smaller nodes and move u and all of them.
    """

    def run(batches):
        u0 = m0 = v0 = None
        for batch in batches:
            if not batch.num_rows:
                continue
            u, v = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("u", "v"))
            new = np.r_[u0 is None or u[0] != u0 or v[0] != v0, (u[1:] != u[:-1]) | (v[1:] != v[:-1])]
            starts = np.flatnonzero(np.r_[u0 is None or u[0] != u0, u[1:] != u[:-1]])
            run = np.searchsorted(starts, np.arange(len(u)), side="right") - 1
            least = np.minimum(u, v)[starts] if len(starts) else u[:0]
            m = np.where(run >= 0, least[np.maximum(run, 0)], m0 if m0 is not None else 0) if len(starts) else np.full(len(u), m0)
            u0, m0, v0 = u[-1], m[-1], v[-1]
            move = new & ((v > u) if large else (v != m))
            out = [v[move]], [m[move]]
            if not large:
                out[0].append(u[starts])
                out[1].append(m[starts])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], names=["u", "v"])

    return run


def components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """node, comp: for each node of the links a, b the smallest node it reaches (large and small stars in turn)."""
    edges = scratch.table(few(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v"), links.count()), f"{name}-edges")
    last, rows = None, edges.count()

    def starred(pairs: DataFrame, large: bool) -> DataFrame:
        return few(pairs.repartition("u"), 2 * rows).sortWithinPartitions("u", "v").mapInArrow(_star(large), "u long, v long")

    for i in range(200):
        both = edges.union(edges.select("v", "u"))
        edges = scratch.table(starred(starred(both, True), False), f"{name}-round{i}")
        now = edges.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40)))).first()
        if now == last:
            break
        last = now
    else:
        raise RuntimeError("components did not settle")
    roots = few(edges.select("v").distinct(), rows)
    return edges.toDF("node", "comp").union(roots.select("v", F.col("v").alias("comp")))


def _forest(a: np.ndarray, b: np.ndarray, slack: np.ndarray, most: int) -> np.ndarray:
    """Of pairs between components a and b, the `most` of highest slack for each edge of a spanning forest."""
    low, high = np.minimum(a, b), np.maximum(a, b)
    order = np.lexsort((-slack, high, low))
    low, high, slack = low[order], high[order], slack[order]
    starts = np.flatnonzero(np.r_[True, (low[1:] != low[:-1]) | (high[1:] != high[:-1])])
    ends = np.r_[starts[1:], len(order)]
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = root.setdefault(up, up)
            x = root[x]
        return x

    kept = []
    left = len(np.unique(np.r_[low, high])) - 1
    for e in (-slack[starts]).argsort(kind="stable"):
        x, y = find(int(low[starts[e]])), find(int(high[starts[e]]))
        if x != y:
            root[x] = y
            kept.append(order[starts[e] : min(ends[e], starts[e] + most)])
            left -= 1
            if not left:
                break
    return np.concatenate(kept)


class Tiles:
    """Pairs across components that bitmaps allow, from rows of tiles. cols: key, gband, block, visit, main, n, node, comp, bits."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den

    def passing(self, n, bits, comp, i: np.ndarray, j: np.ndarray):
        """Of rows i and j the pairs allowed, with how far they are above the bound."""
        a, b = n[i], n[j]
        ok = (comp[i] != comp[j]) & (self.den * np.minimum(a, b) >= self.num * np.maximum(a, b))
        i, j, total = i[ok], j[ok], (a + b)[ok]
        most = (total - np.bitwise_count(bits[i] ^ bits[j]).sum(axis=1, dtype=np.int64)) // 2
        slack = self.den * most - self.num * (total - most)
        ok = slack >= 0
        return i[ok], j[ok], slack[ok] / total[ok]

    def small(self, starts: np.ndarray, length: int, n, bits, comp):
        """All pairs of tiles of one length, some tiles at a time."""
        x, y = np.triu_indices(length, 1)
        step = max(1, PAIRS_AT_ONCE // len(x))
        for at in range(0, len(starts), step):
            s = starts[at : at + step, None]
            yield self.passing(n, bits, comp, (s + x).ravel(), (s + y).ravel())

    def large(self, s: int, e: int, n, bits, comp):
        """Pairs among the rows s to e: each row outside the tile's main component with the run of rows of fitting size."""
        order = s + n[s:e].argsort(kind="stable")
        size, own = n[order], comp[order]
        names, count = np.unique(own, return_counts=True)
        main = own == names[count.argmax()]
        lo = np.searchsorted(size, -(-self.num * size // self.den))
        hi = np.searchsorted(size, self.den * size // self.num, side="right")
        for i in np.flatnonzero(~main):
            run = np.arange(lo[i], hi[i])
            run = order[run[main[run] | (run > i)]]
            for at in range(0, len(run), PAIRS_AT_ONCE):
                j = run[at : at + PAIRS_AT_ONCE]
                yield self.passing(n, bits, comp, np.full(len(j), order[i]), j)

    def visits(self, home: slice, visitors: slice, main, n, node, bits, comp):
        """Each visitor with the rows at home, which hold other components' rows; of two that visit each other's, the smaller node does it."""
        at_home = np.arange(home.start, home.stop)
        for i in range(visitors.start, visitors.stop):
            j = at_home[(comp[home] == main[i]) | (node[home] > node[i])]
            yield self.passing(n, bits, comp, np.full(len(j), i), j)


def _tile_pairs(num: int, den: int, most_pairs: int | None):
    """a, b: pairs of nodes in different components to be decided next, all where most_pairs is None; key: of tiles that held back some.

    Rows come sorted by key, gband, block and visit, so a block's rows at home stand before its visitors.
    """
    names = ("key", "gband", "block", "visit", "main", "n", "node", "comp")

    def run(batches):
        tiles, held, paired = Tiles(num, den), None, False  # paired: the rows held, all at home, have been compared with each other

        def kept(rows, found, node, comp):
            """Pairs of one tile or several small ones; many of a large one are cut down to a forest."""
            found = [f for f in found if len(f[0])]
            if not found:
                return None
            i, j, slack = (np.concatenate(z) for z in zip(*found, strict=True))
            cut = most_pairs is not None and rows and len(i) > 4 * rows
            if cut:
                at = _forest(comp[i], comp[j], slack, most_pairs)
                cut = len(at) < len(i)
                i, j = i[at], j[at]
            return np.minimum(node[i], node[j]), np.maximum(node[i], node[j]), bool(cut)

        def search(cols, bits, paired):
            key, gband, block, visit, main, n, node, comp = cols
            bits = np.frombuffer(b"".join(bits), U64).reshape(len(key), -1)
            starts = np.flatnonzero(np.r_[True, np.any([c[1:] != c[:-1] for c in cols[:3]], axis=0)])
            ends = np.r_[starts[1:], len(key)]
            small = (ends - starts <= SMALL_TILE) & (visit[ends - 1] == 0)
            if paired:
                small[0] = False
            out, more = [], []
            for length in np.unique((ends - starts)[small]):
                if length > 1:
                    out += [kept(0, [f], node, comp) for f in tiles.small(starts[small & (ends - starts == length)], int(length), n, bits, comp)]
            for t in np.flatnonzero(~small):
                s, e = int(starts[t]), int(ends[t])
                h = s + int(np.searchsorted(visit[s:e], 1))  # rows at home end here
                if h == s:
                    continue
                found = [] if paired and t == 0 else list(tiles.large(s, h, n, bits, comp))
                found += tiles.visits(slice(s, h), slice(h, e), main, n, node, bits, comp)
                got = kept(e - s, found, node, comp)
                if got:
                    out.append(got)
                    more += [int(key[s])] if got[2] else []
            out = [o for o in out if o]
            a, b = (np.concatenate(z) for z in list(zip(*out, strict=True))[:2]) if out else (np.empty(0, np.int64),) * 2
            if len(a):
                order = np.lexsort((b, a))
                a, b = a[order], b[order]
                new = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]
                a, b = a[new], b[new]
            none = pa.nulls(len(more), pa.int64())
            return pa.RecordBatch.from_arrays(
                [pa.concat_arrays([pa.array(a), none]), pa.concat_arrays([pa.array(b), none]), pa.concat_arrays([pa.nulls(len(a), pa.int64()), pa.array(more, pa.int64())])], names=["a", "b", "key"]
            )

        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in names]
            bits = batch.column("short").to_pylist()
            if held is not None:
                cols, bits = [np.concatenate(z) for z in zip(held[0], cols, strict=True)], held[1] + bits
            last = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols[:3]], axis=0))
            s = int(last[-1]) + 1 if len(last) else 0
            if cols[3][-1]:  # visitors don't wait: only the rows at home are held
                yield search(cols, bits, paired)
                e, paired = s + int(np.searchsorted(cols[3][s:], 1)), True
            else:
                e = len(bits)
                if s:
                    yield search([c[:s] for c in cols], bits[:s], paired)
                    paired = False
            held = ([c[s:e] for c in cols], bits[s:e]) if e > s else None
            paired = paired and held is not None
        if held is not None and not paired:
            yield search(*held, False)

    return run


def across(members: DataFrame, comp: DataFrame, info: DataFrame, scratch: Scratch, name: str, num: int, den: int, most_pairs: int | None) -> tuple[DataFrame, DataFrame]:
    """Pairs a, b across components to be decided next, and the key of each tile that held back some."""
    own = info.join(comp, "node", "left").select("node", "n", "band", "short", F.coalesce("comp", "node").alias("comp"))
    rows = members.select("key", "node").join(own, "node")
    big = members.where(F.col("nth") >= BLOCK).select("key").distinct()
    cuts = bool(big.head(1))
    plain = [F.lit(0).alias(c) for c in ("gband", "block", "visit", "main")]
    names = ["key", "gband", "block", "visit", "main", "n", "node", "comp", "short"]
    if cuts:
        per = members.join(big, "key", "left_semi").groupBy("key").agg(F.count("*").alias("held"), F.min("pivot").alias("node")).join(comp, "node", "left")
        per = scratch.table(per.select("key", F.ceil(F.col("held") / BLOCK).alias("blocks"), F.coalesce("comp", "node").alias("main")), f"{name}-cut")
        cut = rows.join(per, "key").withColumn("home", F.pmod(F.xxhash64("node"), F.col("blocks")))
        there = F.explode(F.expr("transform(sequence(0L, 3 * blocks - 1), x -> named_struct('gband', band - 1 + cast(x div blocks as int), 'block', x % blocks))"))
        visits = cut.where("comp <> main").withColumn("to", there).where("to.gband <> band or to.block <> home")
        visits = visits.select("key", "to.gband", "to.block", F.lit(1).alias("visit"), *names[4:])
        cut = cut.select("key", F.col("band").alias("gband"), F.col("home").alias("block"), F.lit(0).alias("visit"), *names[4:])
        rows = rows.join(per, "key", "left_anti").select("*", *plain).select(*names).union(cut).union(visits)
    else:
        rows = rows.select("*", *plain).select(*names)
    by = names[:3]
    dealt = rows.repartition(*by) if cuts else few(rows.repartition(*by), members.count(), 20_000)
    found = dealt.sortWithinPartitions(*names[:4]).mapInArrow(tidy(_tile_pairs(num, den, most_pairs)), "a long, b long, key long")
    found = scratch.table(found, f"{name}-found")
    short = found.where("a is not null").select("a", "b").distinct()
    pairs = scratch.table(allowed(short, info, num, den, found.count()), f"{name}-pairs")
    return pairs, found.where("key is not null").select("key")


def _decide(num: int, den: int):
    """Linked pairs, from rows sorted by tile, a tile's arrays (a is null, b the node) before its pairs."""

    def run(batches):
        bands, tile, sets = Bands(num, den), None, {}
        for batch in batches:
            linked = []
            for comp, bi, bj, a, b, h in zip(*(batch.column(c).to_pylist() for c in ("comp", "bi", "bj", "a", "b", "h")), strict=True):
                if (comp, bi, bj) != tile:
                    tile, sets = (comp, bi, bj), {}
                if a is None:
                    sets[b] = np.frombuffer(h, U64)
                    continue
                x, y = sets[a], sets[b]
                if bands.linked(len(x), len(y), overlap(x, y)):
                    linked.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in linked], pa.int64()) for i in (0, 1)], names=["a", "b"])

    return run


def decided(pairs: DataFrame, docs: DataFrame, info: DataFrame, words: int, common, scratch: Scratch, name: str, num: int, den: int) -> DataFrame:
    """The pairs a, b that are linked, as verified finds them, but of many pairs: an array goes once to each tile that holds pairs of it."""
    group, rows = components(pairs, scratch, name), pairs.count()
    sized = group.join(info.select("node", "n", "__k1"), "node")
    blocks = sized.groupBy("comp").agg(F.ceil(F.sum("n") / TILE_SHINGLES).alias("blocks"))
    placed = sized.join(blocks, "comp").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    placed = scratch.table(few(placed.select("node", "__k1", "comp", "block"), 2 * rows), f"{name}-placed")
    one = pairs.join(placed.select(F.col("node").alias("a"), "comp", F.col("block").alias("x")), "a")
    both = one.join(placed.select(F.col("node").alias("b"), F.col("block").alias("y")), "b")
    tile = ["comp", "bi", "bj"]
    dealt = scratch.table(few(both.select("comp", F.least("x", "y").alias("bi"), F.greatest("x", "y").alias("bj"), "a", "b"), rows), f"{name}-dealt")
    arr = arrays(docs, placed.select("__k1"), words, common, scratch, f"{name}-arrays")
    held = dealt.select(*tile, F.col("a").alias("node")).union(dealt.select(*tile, "b")).distinct().join(arr, "node")
    held = held.select(*tile, F.lit(None).cast("long").alias("a"), F.col("node").alias("b"), "h")
    rows = held.union(dealt.select(*tile, "a", "b", F.lit(None).cast("binary").alias("h")))
    links = rows.repartition(*tile).sortWithinPartitions(*tile, F.asc_nulls_first("a")).mapInArrow(_decide(num, den), "a long, b long")
    links = scratch.table(links, f"{name}-links")
    scratch.drop(f"{name}-arrays")
    return links


def joined_across(links: DataFrame, members: DataFrame, info: DataFrame, docs: DataFrame, words: int, common, scratch: Scratch, num: int, den: int) -> DataFrame:
    """node, comp: the components when every pair across them that the bitmaps allow has been decided. links: to pivots."""
    settled, last = None, FORESTS == 0
    # A pivot's pivot will do for the first search: what is taken for two components costs a comparison, no link.
    up = links.select(F.col("b").alias("a"), F.col("a").alias("up"))
    comp = links.join(up, "a", "left").select(F.col("b").alias("node"), F.coalesce("up", "a").alias("comp"))
    for i in range(FORESTS + 1):
        pairs, more = across(members, comp, info, scratch, f"round{i}", num, den, None if last else 4 ** (i + 1))
        if settled is not None:
            pairs = scratch.table(few(pairs.join(settled, ["a", "b"], "left_anti"), pairs.count()), f"round{i}-new")
        found = bool(pairs.head(1))
        if found:
            if last:
                links = links.union(decided(pairs, docs, info, words, common, scratch, f"round{i}", num, den))
            else:
                links = links.union(verified(pairs, docs, words, common, scratch, f"round{i}", num, den))
            settled = pairs.select("a", "b") if settled is None else settled.union(pairs.select("a", "b"))
        if last or not more.head(1):
            break
        last = i + 1 == FORESTS or not found
        comp = components(links, scratch, f"round{i}-joined")
        members = scratch.table(few(members.join(more.distinct(), "key", "left_semi"), members.count()), f"round{i}-members")
    return components(links, scratch, "joined")


def resolved(docs: DataFrame, words: int, num: int, den: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """sets: a row for each of docs (doc_id, __k1, text), with its node; comp: node, comp for nodes linked with others."""
    common = docs.sparkSession.sparkContext.broadcast(commonness_of(docs))
    sets = scratch.table(docs.mapInArrow(tidy(_sets(words, num, den, common)), SETS), "sets")
    owned = sets.where("keys is not null")
    keys = owned.select(F.explode("keys").alias("key"), "node")
    # Equal sets come once a partition; what is left of them stands side by side here.
    shared = keys.repartition("key").sortWithinPartitions("key", "node").mapInArrow(_shared, "key long, node long, pivot long, nth long")
    members = scratch.table(shared, "members")
    nodes = members.select("node").distinct()
    first = F.min(F.struct("__k1", "n", "band", "short", "bits")).alias("of")
    info = owned.select("node", "__k1", "n", "band", "short", "bits").join(nodes, "node", "left_semi").groupBy("node").agg(first).select("node", "of.*")
    info = scratch.table(few(info, members.count(), 100_000), "info")
    # Of a node's pivots the one that it shares most tiles with; nodes are dealt once for both counts and for their bitmaps.
    counted = members.where("node <> pivot").select("node", "pivot").repartition("node").groupBy("node", "pivot").agg(F.count("*").alias("c"))
    pivots = counted.groupBy("node").agg(F.min(F.struct((-F.col("c")).alias("c"), "pivot")).alias("best")).select(F.col("best.pivot").alias("a"), F.col("node").alias("b"))
    pivots = scratch.table(allowed(pivots, info, num, den, info.count()), "pivots-allowed")
    links = verified(pivots, docs, words, common, scratch, "pivots", num, den)
    comp = joined_across(links, members, info, docs, words, common, scratch, num, den)
    common.destroy()
    return sets, comp


def near_duplicate_classes(docs: DataFrame, words: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id for each row: the smallest doc_id that links of similarity num / den or more reach."""
    with Scratch(docs.sparkSession) as scratch:
        docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), content_key("text")[0], "text")
        sets, comp = resolved(docs, words, num, den, scratch)
        rep = sets.where("doc_id is not null and node is not null").groupBy("node").agg(F.min("doc_id").alias("rep"))
        rep = rep.join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        least = rep.groupBy("comp").agg(F.min("rep").alias("least"))
        every = sets.select("doc_id", "node", F.col("n").alias("n_shingles")).join(rep.join(least, "comp").select("node", "least"), "node", "left")
        own = F.when(F.col("doc_id").isNotNull(), F.coalesce("least", "doc_id"))
        return scratch.table(few(every.select("doc_id", "n_shingles", own.alias("component_id")), sets.count()), "result", keep=True)


LAST_ID = (1 << 63) - 1


def without_near_duplicates(docs: DataFrame, words: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """One row of docs for each class: that of the smallest doc_id (null comes last), of those the one whose text hashes lowest.

    Rows without words are classes of their own and stay, however often they are repeated. Of other rows
    equal in doc_id and text any one stays. Other columns pass through, whatever their names.
    """
    i, k = unused(docs, "__id", "__text")
    row = docs.withColumns({i: F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)), k: content_key("text")[0]})
    with Scratch(docs.sparkSession) as scratch:
        sets, comp = resolved(row.select(F.col(i).alias("doc_id"), F.col(k).alias("__k1"), "text"), words, num, den, scratch)
        own = sets.where("node is not null").groupBy("node", F.col("doc_id").alias(i), F.col("__k1").alias(k)).agg(F.count("*").alias("times"))
        own = scratch.table(few(own.join(comp, "node", "left").select(i, k, "times", F.coalesce("comp", "node").alias("comp")), sets.count()), "own")
        best = own.groupBy("comp").agg(F.min(F.struct(i, k)).alias("best"))
        gone = scratch.table(few(own.join(best, "comp").where(F.struct(i, k) != F.col("best")).select(i, k), own.count()), "gone", keep=True)
        again = scratch.table(few(own.where("times > 1").select(i, k), own.count()), "again", keep=True)
    out = only(row, gone, i, k, how="left_anti")
    if again.head(1):
        out = only(out, again, i, k, how="left_anti").union(only(out, again, i, k).dropDuplicates([i, k]))
    return out.select(*docs.columns)
