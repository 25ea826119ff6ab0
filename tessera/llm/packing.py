"""Best-fit packing by a grouping genetic algorithm on islands.

Documents become token pieces; full pieces are sequences as they are. The
rest is dealt over shards of bounded size by a hash. Each shard is evolved on
several islands at once, a row each: a chromosome is a list of bins. Crossover
injects whole well-filled bins of one parent into the other, removes the bins
that hold duplicates, and best-fits the documents displaced; mutation dissolves
the emptiest bins in the same way. After each epoch every island's elite goes
to its neighbour. An island stops as soon as it needs no more bins than the
sum of lengths does. What a shard could not fill well is dissolved and packed
again together with that of other shards, level by level.

Defined cases. Null or empty text is one end-of-text id. Repeated rows are
packed each. Null doc_id stays null. An empty table gives an empty result.
Only doc_id and text are read.
"""

from __future__ import annotations

import random
import re
import struct
import unicodedata
import zlib
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, tidy

CAPACITY = 2048
END = 0
TOKENIZER = "word_bpe_49k.json"
ISLANDS, EPOCHS, GENERATIONS, POPULATION = 3, 3, 6, 4
SHARD_ITEMS, LEVELS, WELL_FILLED = 4096, 3, 0.98
SHARDS_A_TASK = 16
CACHE_WORDS, BYTES_AT_ONCE = 450_000, 1 << 22

#: A line: lower-case letters with or without punctuation behind, which are separate pieces to the tokenizer; else two empty groups.
_PLAIN = re.compile(rb"^(?:([a-z\x80-\xff]+)([!-&(-/:-@\[-`{-~]+)?|.*)$", re.MULTILINE)


def as_ids(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class WordEncoder:
    """Token ids of whole texts as little-endian unsigned 32-bit integers.

    The tokenizer drops white space and never joins across it, so a text's ids
    are those of its words one after another; words' ids are remembered, up to
    a bound. Special tokens' strings become their ids, as the file has it.
    """

    def __init__(self, name: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
        self.known: dict[bytes, bytes] = {}
        self.of_id = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size())]
        # The byte-level alphabet: printable bytes stand for themselves, the others for characters from 256 on.
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        self.byte_letters = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in plain)}

    def letters(self, cores: list[bytes]) -> list[bytes]:
        """Learns runs of lower-case letters straight from the model; returns those that the normaliser might change."""
        known, of_id, tokenize, normal = self.known, self.of_id, self.tokenizer.model.tokenize, unicodedata.is_normalized
        others = []
        for core, s in zip(cores, b"\n".join(cores).decode().split("\n"), strict=True):
            if not s.isascii():
                if not (s.isalpha() and s == s.lower() and normal("NFC", s)):
                    others.append(core)
                    continue
                s = core.decode("latin-1").translate(self.byte_letters)
            known[core] = b"".join([of_id[t.id] for t in tokenize(s)])
        return others

    def whole(self, words: list[bytes]) -> None:
        encoded = self.tokenizer.encode_batch_fast([w.decode() for w in words], add_special_tokens=False) if words else []
        for w, e in zip(words, encoded, strict=True):
            self.known[w] = as_ids(e.ids)

    def ids_of(self, words: list[bytes]) -> list[bytes]:
        """The ids of distinct words: of letters and of the punctuation behind, which are separate pieces, or of the whole word."""
        found = _PLAIN.findall(b"\n".join(words))
        cores, tails = set(map(itemgetter(0), found)), set(map(itemgetter(1), found))
        others = [w for w, core in zip(words, found, strict=True) if not core[0]]
        known = self.known
        if len(known) + len(cores) + len(others) > CACHE_WORDS:  # what these texts use stays
            known = self.known = {w: known[w] for part in (cores, tails, others) for w in part if w in known}
        known[b""] = b""
        if plain := list(cores.difference(known)):
            others += self.letters(plain)
        self.whole([w for part in (others, tails) for w in part if w not in known])
        return [known[core] + known[tail] if tail else known[core or w] for w, (core, tail) in zip(words, found, strict=True)]

    def encode(self, texts: list[bytes]) -> list[bytes]:
        return list(self.encoded(pa.array(texts, pa.binary()).cast(pa.string())))

    def encoded(self, texts: pa.Array) -> Iterator[bytes]:
        """The ids of each text, BYTES_AT_ONCE at a time; a longer text goes in stretches of words."""
        sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes)
        at = 0
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(ends, ends[at] - sizes[at] + BYTES_AT_ONCE, side="right")))
            if sizes[at] > BYTES_AT_ONCE:
                yield b"".join(x for part in stretches(texts[at].as_py().encode(), BYTES_AT_ONCE) for x in self._some(pa.array([part.decode()])))
                to = at + 1
            else:
                yield from self._some(texts.slice(at, to - at))
            at = to

    def _some(self, texts: pa.Array) -> list[bytes]:
        """Each distinct word is looked up once; the texts' ids are gathered by the words' codes."""
        split = pc.ascii_split_whitespace(pc.ascii_lower(texts))  # ASCII only, as the tokenizer would
        codes = split.flatten().dictionary_encode()
        words = codes.dictionary.cast(pa.binary()).to_pylist()  # with an empty one where white space stands at an end
        own = self.ids_of(words) if words else []
        lengths = np.fromiter(map(len, own), np.int64, len(own)) // 4
        at = np.cumsum(lengths) - lengths
        code = codes.indices.to_numpy()
        n = lengths[code]
        ends = np.cumsum(n)
        ids = np.frombuffer(b"".join(own), "<u4")
        ids = ids[np.repeat(at[code] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]
        bounds = np.r_[0, ends][split.offsets.to_numpy() - split.offsets[0].as_py()].tolist()
        out = [ids[s:e].tobytes() for s, e in zip(bounds[:-1], bounds[1:], strict=True)]
        # Special tokens are looked for before letters are lowered.
        for i in np.flatnonzero(pc.match_substring(texts, "<|").to_numpy(zero_copy_only=False)).tolist():
            out[i] = as_ids(self.tokenizer.encode(texts[i].as_py(), add_special_tokens=False).ids)
        return out


_SPACE = re.compile(rb"[ \t-\r]")


def stretches(text: bytes, size: int) -> Iterator[bytes]:
    """The text cut at white space into stretches of about this size."""
    at = 0
    while at < len(text):
        space = _SPACE.search(text, at + size)
        to = space.start() if space else len(text)
        yield text[at:to]
        at = to


def encoder(name: str) -> WordEncoder:
    """One per Python worker, kept between its tasks."""
    import sys
    import types

    kept = sys.modules.setdefault("_tessera_worker", types.ModuleType("_tessera_worker"))
    if getattr(kept, "encoder_name", None) != name:
        kept.encoder, kept.encoder_name = WordEncoder(name), name
    return kept.encoder


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: documents' ids with the end id, cut only where longer than capacity."""

    def run(batches):
        enc, end = encoder(tokenizer), END.to_bytes(4, "little")
        for batch in batches:
            at, rows = [], []
            texts = pc.fill_null(batch.column("text"), "")
            for i, ids in enumerate(enc.encoded(texts)):
                ids += end
                n = len(ids) // 4
                for p, s in enumerate(range(0, n, capacity)):
                    at.append(i)
                    rows.append((p, s, min(capacity, n - s), zlib.crc32(ids[4 * s : 4 * (s + capacity)])))
            cols = list(zip(*rows, strict=True)) or [()] * 4
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(at, pa.int64())), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(run), PIECES)


class Bins:
    """Bins open for best fit: the fullest bin that still takes an item, found over a bit mask of free space."""

    def __init__(self, capacity: int, lengths: list[int]):
        self.capacity, self.lengths = capacity, lengths
        self.bins: list[list[int]] = []
        self.free: list[int] = []
        self.by_free: dict[int, list[int]] = {}
        self.mask = 0

    def _offer(self, b: int) -> None:
        f = self.free[b]
        if f:
            self.by_free.setdefault(f, []).append(b)
            self.mask |= 1 << f

    def add(self, items: list[int]) -> None:
        self.bins.append(list(items))
        self.free.append(self.capacity - sum(self.lengths[i] for i in items))
        self._offer(len(self.bins) - 1)

    def place(self, i: int) -> None:
        size = self.lengths[i]
        m = self.mask >> size
        if not m:
            self.add([i])
            return
        f = size + (m & -m).bit_length() - 1
        own = self.by_free[f]
        b = own.pop()
        if not own:
            self.mask &= ~(1 << f)
        self.bins[b].append(i)
        self.free[b] = f - size
        self._offer(b)

    def place_all(self, items: list[int]) -> None:
        for i in sorted(items, key=self.lengths.__getitem__, reverse=True):
            self.place(i)


class Breeder:
    """The grouping genetic algorithm on one shard. A solution is (fitness, bins); fewer bins, then fuller ones, win."""

    def __init__(self, lengths: list[int], capacity: int, seed: int):
        self.lengths, self.capacity, self.rng = lengths, capacity, random.Random(seed)
        self.least = -(-sum(lengths) // capacity)

    def rated(self, bins: list[list[int]]) -> tuple:
        fill = sum((sum(self.lengths[i] for i in b) / self.capacity) ** 2 for b in bins)
        return ((-len(bins), fill / max(1, len(bins))), bins)

    def first(self, k: int) -> tuple:
        """Best fit by falling length; for k > 0 the order is shaken."""
        made = Bins(self.capacity, self.lengths)
        shake = self.capacity * 0.05 * k
        for i in sorted(range(len(self.lengths)), key=lambda i: self.lengths[i] + self.rng.uniform(0, shake), reverse=True):
            made.place(i)
        return self.rated(made.bins)

    def cross(self, giver: tuple, taker: tuple) -> tuple:
        filled = [b for b in giver[1] if sum(self.lengths[i] for i in b) >= self.capacity * WELL_FILLED]
        inject = self.rng.sample(filled, max(1, len(filled) // 3)) if filled else []
        held = {i for b in inject for i in b}
        made, displaced = Bins(self.capacity, self.lengths), []
        for b in inject:
            made.add(b)
        for b in taker[1]:
            if held.isdisjoint(b):
                made.add(b)
            else:
                displaced += [i for i in b if i not in held]
        made.place_all(displaced)
        return self.rated(made.bins)

    def mutate(self, solution: tuple) -> tuple:
        bins = sorted(solution[1], key=lambda b: sum(self.lengths[i] for i in b))
        n = min(len(bins), 3 + self.rng.randrange(1 + len(bins) // 10))
        picked = set(range(min(2, n))) | set(self.rng.sample(range(len(bins)), max(0, n - 2)))
        made, displaced = Bins(self.capacity, self.lengths), []
        for j, b in enumerate(bins):
            if j in picked:
                displaced += b
            else:
                made.add(b)
        made.place_all(displaced)
        return self.rated(made.bins)

    def done(self, population: list[tuple]) -> bool:
        return bool(population) and len(population[0][1]) <= self.least

    def epoch(self, population: list[tuple], generations: int, size: int) -> list[tuple]:
        """The population after so many generations, best first; it ends early at the least possible number of bins."""
        while len(population) < size and not self.done(population):
            population = sorted([*population, self.first(len(population))], key=lambda s: s[0], reverse=True)
        for _ in range(generations):
            if self.done(population):
                break
            mother, father = population[0], population[self.rng.randrange(len(population))]
            children = [self.cross(mother, father), self.cross(father, mother), self.mutate(population[self.rng.randrange(len(population))])]
            population = sorted([*population, *children], key=lambda s: s[0], reverse=True)[:size]
        return population


STATE = "shard long, island int, lengths array<int>, population array<array<int>>"


def _as_bins(where: list[int]) -> list[list[int]]:
    bins: list[list[int]] = [[] for _ in range(max(where, default=-1) + 1)]
    for i, b in enumerate(where):
        bins[b].append(i)
    return bins


def _as_places(bins: list[list[int]], n: int) -> list[int]:
    where = [0] * n
    for b, items in enumerate(bins):
        for i in items:
            where[i] = b
    return where


def _evolve(capacity: int, generations: int, size: int, seed: int):
    def run(batches):
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                breeder = Breeder(row["lengths"], capacity, hash((seed, row["shard"], row["island"])))
                seen = [x for x in [*(row["population"] or []), *([row["incoming"]] if row["incoming"] else [])]]
                population = sorted((breeder.rated(_as_bins(x)) for x in seen), key=lambda s: s[0], reverse=True)[:size]
                population = breeder.epoch(population, generations, size)
                kept = population[:1] if breeder.done(population) else population
                out.append([_as_places(bins, len(row["lengths"])) for _, bins in kept])
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("shard", "island", "lengths")), pa.array(out, pa.list_(pa.list_(pa.int32())))],
                names=["shard", "island", "lengths", "population"],
            )

    return run


def _place(capacity: int, level: int, last: bool):
    """Rows of uid, length, sequence_id and offset; sequence_id null: dissolved for the next level."""

    def run(batches):
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                bins = _as_bins(row["best"])
                fills = [sum(row["lengths"][i] for i in b) for b in bins]
                worst = min(range(len(bins)), key=fills.__getitem__, default=None)
                for b, items in enumerate(bins):
                    at, again = 0, not last and (b == worst or fills[b] < capacity * WELL_FILLED)
                    for i in items:
                        rows.append((row["uids"][i], row["lengths"][i], None if again else (level << 58) + (row["shard"] << 20) + b, at))
                        at += row["lengths"][i]
            cols = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["uid", "length", "sequence_id", "offset"])

    return run


def evolve_islands(shards: DataFrame, scratch: Scratch, name: str, capacity: int, islands: int, epochs: int, seed: int) -> DataFrame:
    """shard, best: each shard's best solution over its islands, as the bin of each item."""
    own = shards.select("shard", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"), "lengths")
    state = own.select("*", F.lit(None).cast("array<array<int>>").alias("population"), F.lit(None).cast("array<int>").alias("incoming"))
    for e in range(epochs):
        state = scratch.table(state.mapInArrow(tidy(_evolve(capacity, GENERATIONS, POPULATION, seed + e)), STATE), f"{name}-epoch{e}")
        elite = state.select("shard", ((F.col("island") + 1) % islands).alias("island"), F.col("population")[0].alias("incoming"))
        state = state.join(elite, ["shard", "island"])
    needed = F.array_max(F.col("incoming"))
    return state.groupBy("shard").agg(F.min_by("incoming", F.struct(needed, "island")).alias("best"))


def pack(pieces: DataFrame, scratch: Scratch, capacity: int = CAPACITY, islands: int = ISLANDS, epochs: int = EPOCHS, seed: int = 11) -> DataFrame:
    """uid, sequence_id, offset for a written table of uid and length; lengths are below capacity."""
    placed, items = [], pieces.select("uid", F.col("length").cast("int").alias("length"))
    for level in range(LEVELS):
        n_shards = -(-items.count() // SHARD_ITEMS)
        last = n_shards <= 1 or level == LEVELS - 1
        shard = F.pmod(F.xxhash64("uid", F.lit(level)), F.lit(max(1, n_shards)))
        both = F.array_sort(F.collect_list(F.struct("uid", "length")))
        shards = items.groupBy(shard.alias("shard")).agg(both.alias("b")).select("shard", F.col("b.uid").alias("uids"), F.col("b.length").alias("lengths"))
        # A row a shard: dealt out anew, so that islands of one shard run beside those of others.
        shards = scratch.table(shards.repartition(max(1, min(n_shards, 200), n_shards // SHARDS_A_TASK), "shard"), f"shards{level}")
        best = evolve_islands(shards, scratch, f"level{level}", capacity, islands, epochs, seed + 100 * level)
        rows = shards.join(best, "shard").mapInArrow(_place(capacity, level, last), "uid long, length long, sequence_id long, offset long")
        rows = scratch.table(rows, f"placed{level}", keep=True)
        placed.append(rows.where("sequence_id is not null").select("uid", "sequence_id", "offset"))
        if last:
            break
        items = rows.where("sequence_id is null").select("uid", F.col("length").cast("int").alias("length"))
    out = placed[0]
    for x in placed[1:]:
        out = out.unionByName(x)
    return out


def packed(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    with Scratch(docs.sparkSession) as scratch:
        pieces = token_pieces(docs, capacity, tokenizer).withColumn("uid", F.monotonically_increasing_id())
        pieces = scratch.table(pieces, "pieces", keep=True)
        names = ["doc_id", "piece", "start", "length", "ids_crc32"]
        full = pieces.where(F.col("length") == capacity).select(*names, (-F.col("uid") - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
        rest = pieces.where(F.col("length") < capacity)
        return rest.join(pack(rest, scratch, capacity), "uid").select(*names, "sequence_id", "offset").unionByName(full)
