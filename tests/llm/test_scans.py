import re

from tessera.llm.license_scan import NOTICES, NoticeFinder, license_digest, license_matches, scan
from tessera.llm.secret_scan import RULES, SecretIndex, secret_digest, secret_spans, trigram_query

MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy"


def test_license_words_and_phrases(spark):
    rows = [(1, "The MIT License, mit-license; Apache   LICENSE"), (2, None), (3, ""), (4, "summit license"), (5, "gnu general public license mit license mit license"), (6, "x " * 50_000 + "cc by")]
    got = {r.doc_id: r for r in license_digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (got[1].n_words, got[1].n_base, got[1].first_word, got[1].last_word, got[1].base_labels) == (7, 3, 1, 5, "apache,mit")
    assert (got[2].n_words, got[2].n_base, got[2].first_word, got[2].labels, got[2].score) == (0, 0, None, "", 0.0)
    assert got[4].n_base == 0 and got[5].n_base == 3 and got[5].last_word == 6 and got[6].first_word == 50_000
    assert all(0 <= r.score <= 1 for r in got.values())


def test_fuzzy_notices_within_and_beyond_the_bound():
    finder = NoticeFinder(NOTICES)
    phrases = {}
    one = scan(MIT.replace("granted", "grantd").encode(), finder, phrases)["notices"]
    assert [(n[0], n[3]) for n in one] == [("mit", 1)]
    assert scan(MIT.replace("hereby granted", "now given").replace("free of charge", "for money").encode(), finder, phrases)["notices"] == []
    (exact,) = scan(("a b " + MIT).encode(), finder, phrases)["notices"]
    assert (exact[1], exact[2], exact[3], exact[4]) == (2, 14, 0, 1.0)


def test_license_spans_column(spark):
    (r,) = license_matches(spark.createDataFrame([(1, "So: " + MIT, 3)], "doc_id long, text string, notices int")).collect()
    assert r.notices[0].label == "mit" and r.notices[0].edits == 0


SECRETS = [
    (1, 'é token = "abc123def456" end PASSWORD:hunter2x'), (2, None), (3, ""), (4, "apikey=short secret: 12345"), (5, "AKIA" + "A1" * 8 + " AKIAXX"),
    (6, "z" + "0123456789abcdef" * 2), (7, "ghp_" + "a" * 36 + " xoxb-1234567890ab"), (8, "no secrets " * 20_000), (9, "toKen = abcdefgh"), (10, "-----BEGIN RSA PRIVATE KEY-----"),
]


def plain(text):
    out = []
    for k, (kind, p, f, g, least) in enumerate(RULES):
        out += [(m.start(), k, f"{kind}:{m.start()}:{m.end()}") for m in re.finditer(p, text or "", f) if m.end(g) - m.start(g) >= least]
    return [x[2] for x in sorted(out)]


def test_secret_spans_equal_a_full_scan(spark):
    df = spark.createDataFrame(SECRETS, "doc_id long, text string")
    got = {r.doc_id: r for r in secret_digest(df).collect()}
    for i, text in SECRETS:
        assert got[i].spans == ",".join(plain(text)), i
    assert (got[1].n_assign, got[5].n_access, got[6].n_hex, got[4].n_assign, got[9].n_assign) == (2, 1, 1, 0, 0)
    spans = {r.doc_id: r.spans for r in secret_spans(df).collect()}
    assert [s.kind for s in spans[10]] == ["private_key"]


def test_trigram_queries():
    assert trigram_query("abcd") == ("and", ("tri", "abc"), ("tri", "bcd"))
    assert trigram_query("[0-9a-f]+") == ("all",)
    assert trigram_query("(foo|barx)") == ("or", ("tri", "foo"), ("and", ("tri", "bar"), ("tri", "arx")))
    assert trigram_query("(foo|[ab]+)") == ("all",) and trigram_query("ab?cde") == ("tri", "cde")
    index = SecretIndex()
    assert index.find([]) == []


def test_notices_equal_a_plain_fuzzy_search():
    import random

    import regex

    rng = random.Random(3)
    notices = [("twice", "free of charge and free of charge to all who ask"), ("once", "licensed for use by anyone at no cost")]
    finder = NoticeFinder(notices)
    for _ in range(1500):
        label, text = rng.choice(notices)
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(text))
            text = rng.choice([text[:at] + text[at + 1 :], text[:at] + "q" + text[at:], text[:at] + "q" + text[at + 1 :]])
        norm = " ".join(f"a b {text} c d".split())
        for name, notice, k in finder.notices:
            plain = regex.search(f"(?:{notice}){{e<={k}}}", norm)
            assert bool(plain) == any(f[0] == name for f in finder.find(norm)), (norm, name)


def test_secret_rules_beyond_ascii_equal_a_full_scan():
    texts = ["ÄÖÜ=abcdef", "äöü=abcdef", "to\u212aen1 tokens", "TOKEN9", "ſecret7", "x", "", "straße=1"]
    rules = [("umlaut", "ÄÖÜ=[a-z]{6}", 0, 0, 0), ("umlaut_i", "ÄÖÜ=[a-z]{6}", re.IGNORECASE, 0, 0), ("token", "token[0-9a-z]", re.IGNORECASE, 0, 0), ("secret", "(?i)secret[0-9]", 0, 0, 0), ("ascii", "TOKEN[0-9]", re.ASCII, 0, 0), ("sharp", "straße", re.IGNORECASE | re.ASCII, 0, 0)]
    got = SecretIndex(rules).find(texts)
    for text, found in zip(texts, got, strict=True):
        assert found == sorted((m.start(), k, m.end()) for k, (_, p, f, _, _) in enumerate(rules) for m in re.finditer(p, text, f))


def test_scans_of_empty_tables_and_repeated_rows(spark):
    for digest in (license_digest, secret_digest):
        assert digest(spark.createDataFrame([], "doc_id long, text string")).collect() == []
        rows = digest(spark.createDataFrame([(1, "mit license token=abcdefgh")] * 2 + [(None, "x")], "doc_id long, text string")).collect()
        assert rows[0] == rows[1] and rows[2].doc_id is None
