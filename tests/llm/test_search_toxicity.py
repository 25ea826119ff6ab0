import random
import zlib

import numpy as np

from tessera.llm import multi_index as mi
from tessera.llm import toxicity as tx


def test_search_finds_and_ranks(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(1500, 16))
    v[5:15] = v[5]
    rows = [(i, [float(x) for x in np.float32(r)], i % 3) for i, r in enumerate(v)]
    rows += [(5000, None, 1), (5020, [0.0] * 16, 1), (5040, [1.0, None] * 8, 1), (5060, [float("nan")] * 16, 1), (5080, [1.0, 2.0], 1), (None, [1.0] * 16, 1), rows[20]]
    got = mi.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>, cell int"), every=20, k=20, share=0.5, least=200).collect()
    x = np.float32(v).astype(float)
    hit, by = 0, {}
    for r in got:
        by.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(by) == set(range(0, 1500, 20))
    for q, found in by.items():
        found.sort()
        assert [r for r, _, _ in found] == list(range(1, 21)) and q not in {i for _, i, _ in found}
        assert all(abs(s - x[i] @ x[q]) < 1e-12 for _, i, s in found)
        assert found == sorted(found, key=lambda f: (-f[2], f[1]))
        s = x @ x[q]
        s[q] = -9
        hit += len({i for _, i, _ in found} & set(np.lexsort((np.arange(1500), -s))[:20].tolist()))
    assert hit / (20 * len(by)) >= 0.9


def test_walk_goes_by_summed_distance():
    rng = np.random.default_rng(1)
    a, b = rng.random(9), rng.random(9)
    cells = mi.walk(a, b, {i: 1 for i in range(81)}, 40)
    want = sorted(range(81), key=lambda c: a[c // 9] + b[c % 9])[:40]
    assert cells == want


def test_search_of_few_and_none(spark):
    kind = "vec_id long, embedding array<float>"
    assert mi.search(spark.createDataFrame([], kind), every=20).collect() == []
    few = mi.search(spark.createDataFrame([(0, [1.0, 0.0]), (20, [0.5, 0.5]), (3, [0.0, 1.0])], kind), every=20).collect()
    assert sorted((r.query_id, r.rank, r.vec_id) for r in few) == [(0, 1, 20), (0, 2, 3), (20, 1, 0), (20, 2, 3)]


def test_grammar_scores_clauses():
    g = tx.Grammar({})
    at = dict(zip(tx.PATTERNS, range(6), strict=True))
    assert g.sums("You idiot")[at["aimed"]] == 1 and g.sums("an idiot box")[at["plain"]] == 1
    assert g.sums("he is not an idiot")[at["negated"]] == 1 and g.sums("she said idiot")[at["said"]] == 1
    assert g.sums("I will kill you")[at["threat"]] == 0.5 and g.sums("kill the light")[at["menace"]] == 1
    assert g.sums("You. Idiot")[at["plain"]] == 1, "a target of another clause doesn't count"
    assert g.sums("") == [0.0] * 6 == g.sums("idiotic words only")


def labelled():
    rng = random.Random(6)
    words = [f"word{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(200)]
    rows, labels = [], []
    for i in range(900):
        text = rng.choices(words, k=40)
        toxic = int(rng.random() < 0.2)
        if toxic:
            for _ in range(3):
                text.insert(rng.randrange(40), rng.choice(["grobblik", "snarfo", "idiot", "vexu" + rng.choice("abcdefgh")]))
        rows.append((i, " ".join(text), 1))
        labels.append((i, 1, toxic))
    return rows + [(5000, None, 1), (5001, "", 1), (None, "you idiot", 1)], labels


def test_learned_scores_hold_out(spark):
    rows, labels = labelled()
    docs = spark.createDataFrame(rows, "doc_id long, text string, entry int")
    lab = spark.createDataFrame([*labels, labels[0], (None, 1, 1), (7777, 0, None)], "doc_id long, quality int, toxic int")
    got = tx.toxicity_digest(docs, lab).collect()
    y = {i: t for i, _, t in labels}
    assert len(got) == len(rows)
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
    held = [(y[r.doc_id], r.predicted) for r in got if r.held_out and r.doc_id in y]
    assert sum(a == b for a, b in held) / len(held) > 0.97 and len(held) > 200


def test_patterns_the_sample_does_not_show_keep_their_odds():
    x = np.zeros((600, 6))
    x[:120, 0] = np.log1p(3)
    w = tx.fit(x, np.r_[np.ones(120), np.zeros(480)])
    fixed = [tx.DEFAULT[0] + np.log(2) * v for v in tx.DEFAULT[1:]]
    assert np.allclose([w[0] + np.log(2) * v for v in w[2:]], fixed[1:], atol=1e-3)
    assert 1 / (1 + np.exp(-(w[0] + np.log(2) * w[2]))) >= tx.THRESHOLD > 0.5 > 1 / (1 + np.exp(-w[0]))
    assert -10 < w[0] < -4


def test_every_entry_has_its_clean_count(spark, monkeypatch):
    from tessera.llm.common import Scratch

    monkeypatch.setattr(tx, "MOST_ENTRIES", 1)
    rng = random.Random(8)
    words = [f"{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(200)]
    docs = spark.createDataFrame([(i, " ".join(rng.choices(words, k=40))) for i in range(600)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(600)], "doc_id long, toxic int")
    with Scratch(spark) as scratch:
        assert tx.learn(docs, labels, scratch)[0] == {}


def test_without_labels_and_documents(spark):
    docs = spark.createDataFrame([(1, "you idiot, you moron"), (2, "fine words")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.doc_id: r.predicted for r in tx.toxicity_digest(docs, none).collect()} == {1: 1, 2: 0}
    assert tx.toxicity_digest(spark.createDataFrame([], docs.schema), none).collect() == []
