"""Toxicity by a weighted finite-state pattern grammar over clauses.

A lexicon maps words to symbols: insult, threat, target, negation, report,
other. Three transducers read a clause's symbols and are composed into one:
negation marks what stands within three words after a negator; reported speech
marks what follows a verb of saying; the pattern grammar joins insults and
threats with a target within five words. What comes out is the matched
patterns of each clause with their weights, not isolated words.

Two things are learned, from labelled rows alone: which words and word
beginnings the lexicon takes in besides the fixed ones, with their weights, and
how the patterns' sums make up a score (logistic regression). Both use at most
SAMPLE_ROWS labelled rows, the first by a hash of doc_id, and never rows whose
crc32(doc_id) mod 3 is 1.

The lexicon takes in at most MOST_ENTRIES learned entries, those of the highest
z, ties by the entry's name; a parameter of the model, whatever the input's size.

Defined cases. Null or empty text has no clauses and gets the score of a text
without any pattern. Without usable labels the fixed lexicon and the fixed
weights hold. Whole texts are read. Null doc_id: held_out is false. Repeated
rows get equal scores; of a doc_id with several labels 1 counts. An empty table
gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, as_texts, tidy

SAMPLE_ROWS = 20_000
ENTRIES_AT_ONCE = 200_000
LEAST_DOCS, LEAST_Z, LEAST_PRECISION, MOST_ENTRIES = 5, 6.0, 0.7, 4000
STEMS = (4, 5, 6, 7)
THRESHOLD = 0.7

#: The lexicon before learning, by symbol.
INSULTS = "idiot idiots moron morons loser losers scum trash worthless pathetic disgusting stupid clown clowns imbecile cretin dumb filth vermin bastard idiota estúpido imbécil basura idiote stupide crétin ordure dummkopf abschaum trottel".split()
THREATS = "kill hurt destroy beat burn stab shoot strangle crush matar matarte tuer détruire töten umbringen".split()
TARGETS = "you your youre u he she they them him her his their this these those everyone tú usted ellos tu vous toi ils du ihr euch sie".split()
NEGATORS = "not no never isnt arent wasnt dont doesnt didnt cannot without ni nunca jamás pas jamais nicht kein keine nie".split()
REPORTS = "said says say called calls wrote writes claimed reported quoted dijo dice llamó dit disait appelé sagte sagt nannte".split()

OTHER, TARGET, INSULT, THREAT, NEGATOR, REPORT = "O", "T", "I", "H", "N", "R"
NEGATED, SAID = "J", "S"
PATTERNS = ("plain", "aimed", "negated", "said", "menace", "threat")


class Transducer:
    """Deterministic and letter to letter: step(state, symbol) gives state, symbol or pattern, weight."""

    def __init__(self, start, step):
        self.start, self.step = start, step

    def __rshift__(self, other: Transducer) -> Transducer:
        """Composition: what this one puts out, the other reads; weights multiply."""

        def step(state, symbol):
            a, out, w = self.step(state[0], symbol)
            b, out, v = other.step(state[1], out)
            return (a, b), out, w * v

        return Transducer((self.start, other.start), step)

    def table(self, alphabet: str) -> dict:
        """All transitions from states that can be reached, states numbered from 0."""
        number, todo, out = {self.start: 0}, [self.start], {}
        for state in todo:
            for symbol in alphabet:
                to, put, w = self.step(state, symbol)
                if to not in number:
                    number[to] = len(number)
                    todo.append(to)
                out[number[state], symbol] = (number[to], put, w)
        return out


def _negation(state: int, symbol: str):
    if symbol == NEGATOR:
        return 3, OTHER, 1.0
    if state and symbol in (INSULT, THREAT):
        return state - 1, NEGATED, 1.0
    return max(0, state - 1), symbol, 1.0


def _reported(state: int, symbol: str):
    if symbol == REPORT:
        return 1, OTHER, 1.0
    return state, SAID if state and symbol in (INSULT, THREAT) else symbol, 1.0


def _patterns(state: tuple[int, int], symbol: str):
    """state: words left in which a target, and a pending insult or threat, still count."""
    target, pending = state
    near = (max(0, target - 1), max(0, pending - 1) if pending > 0 else min(0, pending + 1))
    if symbol == TARGET:
        put = "aimed" if pending > 0 else "threat" if pending < 0 else None
        return (5, 0), put, 0.5
    if symbol == INSULT:
        return (near[0], 5), "aimed" if target else "plain", 1.0
    if symbol == THREAT:
        return (near[0], -5), "threat" if target else "menace", 1.0
    if symbol in (NEGATED, SAID):
        return near, "negated" if symbol == NEGATED else "said", 1.0
    return near, None, 1.0


MACHINE = Transducer(0, _negation) >> Transducer(0, _reported) >> Transducer((0, 0), _patterns)
ALPHABET = OTHER + TARGET + INSULT + THREAT + NEGATOR + REPORT

_WORD = re.compile(r"[^\W\d_]+")
_CLAUSE = re.compile(r"[.!?;:\n]+")


def words_and_stems(text: str) -> set[str]:
    """Distinct words of a text and, marked by a star, their beginnings."""
    words = set(_WORD.findall(text.lower()))
    return words | {w[:n] + "*" for w in words for n in STEMS if len(w) > n}


class Grammar:
    """Lexicon and machine. entries: learned word or stem to weight."""

    def __init__(self, entries: dict[str, float]):
        self.weights = {**dict.fromkeys(INSULTS, 1.0), **{e: w for e, w in entries.items() if not e.endswith("*")}}
        self.stems = {e[:-1]: w for e, w in entries.items() if e.endswith("*")}
        self.threats = set(THREATS)
        self.others = {**dict.fromkeys(TARGETS, TARGET), **dict.fromkeys(NEGATORS, NEGATOR), **dict.fromkeys(REPORTS, REPORT)}
        self.table = MACHINE.table(ALPHABET)
        self.seeds = ahocorasick.Automaton()
        for e in {*self.weights, *self.stems, *self.threats}:
            self.seeds.add_word(e, len(e))
        self.seeds.make_automaton()

    def symbol(self, word: str) -> tuple[str, float]:
        if word in self.weights:
            return INSULT, self.weights[word]
        if word in self.threats:
            return THREAT, 1.0
        if word in self.others:
            return self.others[word], 1.0
        best = max((self.stems.get(word[:n], 0.0) for n in STEMS), default=0.0)
        return (INSULT, best) if best else (OTHER, 1.0)

    def sums(self, text: str) -> list[float]:
        """For each pattern, the sum of weights over the text's clauses."""
        text = text.lower()
        out = dict.fromkeys(PATTERNS, 0.0)
        if any(end < n or not text[end - n].isalpha() for end, n in self.seeds.iter(text)):  # a seed begins a word
            for clause in _CLAUSE.split(text):
                found = [self.symbol(w) for w in _WORD.findall(clause)]
                if not any(s in (INSULT, THREAT) for s, _ in found):
                    continue
                state, last = 0, 1.0
                for s, w in found:
                    state, pattern, v = self.table[state, s]
                    last = w if s in (INSULT, THREAT) else last
                    if pattern:
                        out[pattern] += v * last
        return [out[p] for p in PATTERNS]


#: Bias and pattern weights where nothing can be learned.
DEFAULT = [-4.0, 7.0, 8.0, 2.0, 3.0, 1.0, 4.0]


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 60, ridge: float = 0.05) -> list[float]:
    """Logistic regression by Newton's method; pattern weights are kept from falling below 0.

    The ridge pulls the log odds of a text without or with one match of a pattern to what the fixed
    values give, so a pattern that the sample doesn't show keeps them, whatever the bias.
    """
    x = np.c_[np.ones(len(x)), x]
    w = np.array(DEFAULT)
    one = np.c_[np.ones(len(w)), math.log(2) * np.eye(len(w))[:, 1:]]
    odds = one @ w
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        pull = ridge * one.T @ (odds - one @ w)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * one.T @ one + 1e-9 * np.eye(len(w)), x.T @ (y - p) + pull)
        w = w + np.clip(step, -2, 2)
        w[1:] = np.maximum(w[1:], 0)
        if np.abs(step).max() < 1e-6:
            break
    return w.tolist()


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, scratch: Scratch, sample_rows: int = SAMPLE_ROWS) -> tuple[dict[str, float], list[float]]:
    """Lexicon entries and regression weights, from sample_rows labelled rows that aren't held out."""
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("__y"))
    rows = rows.where(F.col("doc_id").isNotNull() & F.col("__y").isin(0, 1) & ~held_out()).groupBy("doc_id").agg(F.max("__y").alias("__y"))
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    # sample_rows bounds the broadcast.
    sample = scratch.table(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(rows), "doc_id"), "sample")
    totals = {r["__y"]: r["n"] for r in sample.groupBy("__y").agg(F.count("*").alias("n")).collect()}
    if min(totals.get(0, 0), totals.get(1, 0)) < LEAST_DOCS:
        return {}, DEFAULT

    def count(batches):
        seen = {0: Counter(), 1: Counter()}

        def counted():
            entries = list(seen[0] | seen[1])
            counts = [pa.array([seen[y][e] for e in entries], pa.int64()) for y in (1, 0)]
            for y in seen:
                seen[y].clear()
            return pa.RecordBatch.from_arrays([pa.array(entries, pa.string()), *counts], names=["entry", "__pos", "__neg"])

        for batch in batches:
            for text, y in zip(as_texts(batch.column("text")), batch.column("__y").to_pylist(), strict=True):
                seen[y].update(words_and_stems(text))
                if len(seen[0]) + len(seen[1]) > ENTRIES_AT_ONCE:  # what a task holds is bounded; the sum is taken behind it
                    yield counted()
        yield counted()

    # The sample's bound is that of the entries.
    every = sample.mapInArrow(tidy(count), "entry string, __pos long, __neg long").groupBy("entry").agg(F.sum("__pos").alias("__pos"), F.sum("__neg").alias("__neg"))
    rate = totals[1] / (totals[0] + totals[1])
    n = F.col("__pos") + F.col("__neg")
    z = (F.col("__pos") - n * rate) / F.sqrt(n * rate * (1 - rate))
    rated = every.where(F.col("__pos") >= LEAST_DOCS).select("entry", (F.col("__pos") / n).alias("p"), z.alias("z")).where((F.col("z") >= LEAST_Z) & (F.col("p") >= LEAST_PRECISION))
    found = rated.orderBy(F.desc("z"), "entry").limit(MOST_ENTRIES).collect()
    entries = {r["entry"]: float(min(1.0, (r["p"] - rate) / (1 - rate))) for r in found}

    def features(batches):
        grammar = Grammar(entries)
        for batch in batches:
            sums = [[math.log1p(v) for v in grammar.sums(t)] for t in as_texts(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("__y"), pa.array(sums, pa.list_(pa.float64()))], names=["__y", "__x"])

    got = sample.mapInArrow(tidy(features), "__y int, __x array<double>").collect()  # sample_rows short rows at most
    got.sort(key=lambda r: (r["__y"], r["__x"]))
    return entries, fit(np.array([r["__x"] for r in got]), np.array([r["__y"] for r in got], dtype=float))


def toxicity(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, out: str = "__score") -> DataFrame:
    """docs with the score, from 0 to 1, as column out, in the place of one of that name; other columns pass through, whatever their names."""
    docs = docs.drop(out)
    with Scratch(docs.sparkSession) as scratch:
        entries, weights = learn(docs, labels, scratch, sample_rows)

    def score(batches):
        grammar = Grammar(entries)
        for batch in batches:
            scores = []
            for text in as_texts(batch.column("text")):
                v = weights[0] + sum(w * math.log1p(s) for w, s in zip(weights[1:], grammar.sums(text), strict=True))
                scores.append(1 / (1 + math.exp(-max(-30.0, min(30.0, v)))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=[*batch.schema.names, out])

    from pyspark.sql.types import DoubleType, StructField, StructType

    return docs.mapInArrow(tidy(score), StructType([*docs.schema.fields, StructField(out, DoubleType())]))


def toxicity_digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored = toxicity(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), labels)
    return scored.select("doc_id", held_out().alias("held_out"), F.col("__score").alias("score"), (F.col("__score") >= THRESHOLD).cast("int").alias("predicted"))
