"""License scan: exact phrases, and short notices with bounded errors.

Text is read as words: A-Z in lower case, runs of letters, digits and
non-ASCII characters, joined by single spaces. A notice of m characters may
differ by k = m // 16 edits, four at most. Cut into k + 1 pieces, at least one piece of it
stands unchanged in any such text, so an Aho-Corasick pass over all pieces
finds every candidate place; there the regex library's bounded-error matching
verifies the edits and gives the span.

Defined cases. Null or empty text: no words, no labels, score 0. Whole texts
are scanned, however long. Repeated rows get equal results, a null doc_id stays
null, an empty table gives an empty result. Of equally good matches at a place
the regex library's first one counts. Only doc_id and text are read, so other
columns may have any names.
"""

from __future__ import annotations

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes

#: The phrases whose places count, with their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: Wording of well-known notices, as words, with their labels.
NOTICES = [
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("gpl", "this work is licensed under the gnu general public license"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", "licensed under the gnu lesser general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license"),
    ("cc-by", "this work is licensed under a creative commons attribution"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
]

MOST_EDITS = 4

_WORD = set(range(0x30, 0x3A)) | set(range(0x41, 0x5B)) | set(range(0x61, 0x7B)) | set(range(0x80, 0x100))
_TO_WORDS = bytes((c + 32 if 0x41 <= c < 0x5B else c) if c in _WORD else 0x20 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_TO_WORDS).split()


def pieces(notice: str, edits: int) -> list[tuple[int, str]]:
    """The notice in edits + 1 pieces of nearly equal length, with their offsets."""
    n, cut = len(notice), edits + 1
    at = [i * n // cut for i in range(cut + 1)]
    return [(at[i], notice[at[i] : at[i + 1]]) for i in range(cut)]


class NoticeFinder:
    def __init__(self, notices: list[tuple[str, str]], one_in: int = 16):
        self.notices = [(label, text, min(MOST_EDITS, len(text) // one_in)) for label, text in notices]
        by_piece: dict[str, list[tuple[int, int]]] = {}
        for i, (_, text, k) in enumerate(self.notices):
            for offset, piece in pieces(text, k):
                by_piece.setdefault(piece, []).append((i, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, where in by_piece.items():
            self.automaton.add_word(piece, (len(piece), where))
        self.automaton.make_automaton()
        self.fuzzy = [regex.compile(f"(?e)(?:{regex.escape(t, special_only=True)}){{e<={k}}}") for _, t, k in self.notices]

    def find(self, norm: str) -> list[tuple[str, int, int, int, float]]:
        """(label, start, end, edits, similarity) in norm, for each notice and each of its separate places."""
        windows: dict[int, list[list[int]]] = {}
        for end, (size, where) in self.automaton.iter(norm):
            for i, offset in where:
                _, text, k = self.notices[i]
                lo = max(0, end - size + 1 - offset - k)
                hi = min(len(norm), end - size + 1 - offset + len(text) + k)
                own = windows.setdefault(i, [])
                own.append([lo, hi])
                while len(own) > 1 and own[-1][0] <= own[-2][1]:  # a later piece may open its window further left
                    lo, hi = own.pop()
                    own[-1] = [min(lo, own[-1][0]), max(hi, own[-1][1])]
        found = []
        for i, own in windows.items():
            label, text, _ = self.notices[i]
            for lo, hi in own:
                for m in self.fuzzy[i].finditer(norm, lo, hi):
                    edits = sum(m.fuzzy_counts)
                    found.append((label, m.start(), m.end(), edits, 1 - edits / len(text)))
        return sorted(found, key=lambda x: (x[1], x[2], x[0]))


def phrase_places(norm: bytes, phrase: bytes) -> list[int]:
    """Word indexes at which the phrase's words stand consecutively; norm: words joined by single spaces."""
    framed, sought, at, out = b" " + norm + b" ", b" " + phrase + b" ", -1, []
    while (at := framed.find(sought, at + 1)) >= 0:
        out.append(framed.count(b" ", 0, at))
    return out


def scan(text: bytes, finder: NoticeFinder, phrases: dict[bytes, str]) -> dict:
    words = words_of(text)
    norm = b" ".join(words)
    base = sorted((p, label) for phrase, label in phrases.items() if phrase in norm for p in phrase_places(norm, phrase))
    as_text = norm.decode()
    notices = finder.find(as_text)
    spans = [(label, as_text.count(" ", 0, s), as_text.count(" ", 0, e - 1), edits, sim) for label, s, e, edits, sim in notices]
    return {"n_words": len(words), "base": base, "notices": spans}


def _scanner(notices, one_in):
    return NoticeFinder(notices, one_in), {p.encode(): label for p, label in PHRASES.items()}


MATCHES = "doc_id long, n_words long, phrases array<struct<word long, label string>>, notices array<struct<label string, first_word long, last_word long, edits int, similarity double>>"


def license_matches(docs: DataFrame, notices: list[tuple[str, str]] = NOTICES, one_in: int = 16) -> DataFrame:
    """Every phrase place and every notice span of each document; one edit in one_in characters is allowed, and MOST_EDITS at most."""

    def run(batches):
        finder, phrases = _scanner(notices, one_in)
        for batch in batches:
            rows = [scan(t, finder, phrases) for t in as_bytes(batch.column("text"))]
            place = pa.struct([("word", pa.int64()), ("label", pa.string())])
            span = pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("edits", pa.int32()), ("similarity", pa.float64())])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([r["n_words"] for r in rows], pa.int64()),
                    pa.array([[{"word": p, "label": x} for p, x in r["base"]] for r in rows], pa.list_(place)),
                    pa.array([[dict(zip(("label", "first_word", "last_word", "edits", "similarity"), n, strict=True)) for n in r["notices"]] for r in rows], pa.list_(span)),
                ],
                names=["doc_id", "n_words", "phrases", "notices"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, MATCHES)


def license_digest(docs: DataFrame) -> DataFrame:
    """Per document: counts and word range of the phrases, their labels, all labels, and a score.

    The score is 1 where a phrase stands, else the best similarity of a notice, else 0.
    """
    m = license_matches(docs)
    where = F.transform("phrases", lambda p: p.word)
    base = F.array_sort(F.array_distinct(F.transform("phrases", lambda p: p.label)))
    every = F.array_sort(F.array_union(base, F.transform("notices", lambda x: x.label)))
    return m.select(
        "doc_id", "n_words", F.size("phrases").cast("long").alias("n_base"), F.array_min(where).alias("first_word"), F.array_max(where).alias("last_word"),
        F.array_join(base, ",").alias("base_labels"), F.array_join(every, ",").alias("labels"),
        F.when(F.size("phrases") > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max(F.transform("notices", lambda x: x.similarity)), F.lit(0.0))).alias("score"),
    )
