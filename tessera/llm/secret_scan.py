"""Secret scan with a trigram inverted index.

Each rule's regex gives a Boolean query over trigrams: a literal run gives the
conjunction of its trigrams, a branch the disjunction of what its alternatives
give. Each Arrow batch of documents is one segment of the index: posting sets
of the trigrams that some query names. The query is evaluated over the
postings, and only the documents left are matched against the regex. A rule
without a mandatory trigram scans every document. Trigrams are of texts and
literals in ASCII lower case, so letters of either case are found. A rule that
ignores case beyond ASCII takes trigrams of ASCII letters only, and every text
with other characters is a candidate of it.

Defined cases. Null text is empty and has no spans. Whole texts are scanned,
however long; spans are in code points, end exclusive, sorted by start, then by
the rules' order. Repeated rows get equal results, a null doc_id stays null, an
empty table gives an empty result. Only doc_id and text are read, so other
columns may have any names.
"""

from __future__ import annotations

import hashlib
import re
from re import _parser as sre

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_texts

#: Kind, pattern, flags, group whose length counts, least length. The first three are the base.
RULES = [
    ("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII, 2, 6),
    ("access", r"AKIA[A-Z0-9]+", re.ASCII, 0, 20),
    ("hex", r"[0-9a-f]+", re.ASCII, 0, 24),
    ("private_key", r"-----BEGIN (?:RSA |EC |DSA |OPENSSH |PGP )?PRIVATE KEY", re.ASCII, 0, 0),
    ("github", r"(?:ghp|gho|ghu|ghs|ghr)_[A-Za-z0-9]{36,}", re.ASCII, 0, 0),
    ("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", re.ASCII, 0, 0),
    ("google", r"AIza[A-Za-z0-9_-]{35}", re.ASCII, 0, 0),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", re.ASCII, 0, 0),
    ("stripe", r"[sr]k_live_[A-Za-z0-9]{16,}", re.ASCII, 0, 0),
]
N_BASE = 3
ALL = ("all",)


def _and(parts: list) -> tuple:
    parts = [p for p in dict.fromkeys(parts) if p != ALL]
    return ALL if not parts else parts[0] if len(parts) == 1 else ("and", *parts)


def _or(parts: list) -> tuple:
    parts = list(dict.fromkeys(parts))
    return ALL if ALL in parts or not parts else parts[0] if len(parts) == 1 else ("or", *parts)


_LOWER = {c: c + 32 for c in range(65, 91)}


def beyond_ascii(flags: int) -> bool:
    """Whether letters match others of which one isn't ASCII, as k and the Kelvin sign."""
    return bool(flags & re.IGNORECASE) and not flags & re.ASCII


def _run(literal: str) -> tuple:
    return _and([("tri", literal[i : i + 3]) for i in range(len(literal) - 2)])


def trigram_query(pattern: str, flags: int = 0) -> tuple:
    """("all",), ("tri", t), ("and", ...) or ("or", ...): what a text in ASCII lower case must hold for the pattern to match."""
    parsed = sre.parse(pattern, flags)
    wide = beyond_ascii(parsed.state.flags)

    def fixed(items) -> str | None:
        """The one string that the items match, if there is just one."""
        out = ""
        for op, arg in items:
            if op is sre.LITERAL and not (wide and arg > 127):
                out += chr(arg)
            elif op is sre.SUBPATTERN and (s := fixed(arg[3])) is not None:
                out += s
            elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[0] == arg[1] and (s := fixed(arg[2])) is not None:
                out += s * arg[0]
            else:
                return None
        return out

    def query(items) -> tuple:
        parts, literal = [], ""
        for op, arg in items:
            if (s := fixed([(op, arg)])) is not None:
                literal += s.translate(_LOWER)
                continue
            parts.append(_run(literal))
            literal = ""
            if op is sre.SUBPATTERN:
                parts.append(query(arg[3]))
            elif op is sre.BRANCH:
                parts.append(_or([query(x) for x in arg[1]]))
            elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[0] > 0:
                parts.append(query(arg[2]))
        parts.append(_run(literal))
        return _and(parts)

    return query(parsed)


def trigrams(query: tuple) -> set[str]:
    return {query[1]} if query[0] == "tri" else set().union(*map(trigrams, query[1:])) if query != ALL else set()


def candidates(query: tuple, postings: dict[str, set[int]], every: set[int]) -> set[int]:
    if query == ALL:
        return every
    if query[0] == "tri":
        return postings[query[1]]
    found = [candidates(q, postings, every) for q in query[1:]]
    return set.intersection(*found) if query[0] == "and" else set.union(*found)


class SecretIndex:
    """One index segment: the postings of the trigrams that the rules' queries name."""

    def __init__(self, rules=None):
        self.rules = [(kind, re.compile(p, f), group, least) for kind, p, f, group, least in rules or RULES]
        self.queries = [trigram_query(p, f) for _, p, f, _, _ in rules or RULES]
        self.wanted = sorted(set().union(*map(trigrams, self.queries)))

    def postings(self, texts: list[str]) -> dict[str, set[int]]:
        lower = [t.lower() if t.isascii() else t.translate(_LOWER) for t in texts]
        return {g: {i for i, t in enumerate(lower) if g in t} for g in self.wanted}

    def find(self, texts: list[str]) -> list[list[tuple[int, int, int]]]:
        """(start, index of the rule, end) of each text's matches, sorted."""
        postings, every = self.postings(texts), set(range(len(texts)))
        others = {i for i, t in enumerate(texts) if not t.isascii()}
        out: list[list] = [[] for _ in texts]
        for k, ((_, pattern, group, least), query) in enumerate(zip(self.rules, self.queries, strict=True)):
            found = candidates(query, postings, every)
            for i in found | others if beyond_ascii(pattern.flags) else found:
                out[i] += [(m.start(), k, m.end()) for m in pattern.finditer(texts[i]) if m.end(group) - m.start(group) >= least]
        return [sorted(x) for x in out]


def _finder(rules=None):
    index = SecretIndex(rules)

    def run(batches):
        for batch in batches:
            yield batch, index, index.find(as_texts(batch.column("text")))

    return run


def secret_spans(docs: DataFrame, rules=None) -> DataFrame:
    """doc_id and its spans as structs of kind, start and end."""

    def run(batches):
        span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
        for batch, index, found in _finder(rules)(batches):
            spans = [[{"kind": index.rules[k][0], "start": s, "end": e} for s, k, e in x] for x in found]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(spans, pa.list_(span))], names=["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, spans array<struct<kind string, start long, end long>>")


def secret_digest(docs: DataFrame) -> DataFrame:
    """Per document: how often each base kind stands, the base spans' SHA-256, and all spans as text."""

    def run(batches):
        for batch, index, found in _finder()(batches):
            names = [r[0] for r in index.rules]
            listed = [[f"{names[k]}:{s}:{e}" for s, k, e in x] for x in found]
            base = [",".join(f"{names[k]}:{s}:{e}" for s, k, e in x if k < N_BASE) for x in found]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    *(pa.array([sum(k == b for _, k, _ in x) for x in found], pa.int64()) for b in range(N_BASE)),
                    pa.array([hashlib.sha256(b.encode()).hexdigest() for b in base]),
                    pa.array([",".join(x) for x in listed]),
                ],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
