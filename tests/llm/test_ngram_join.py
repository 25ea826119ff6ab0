import random
from collections import defaultdict

import numpy as np

from tessera.llm import ngram_join as nj


def plain(rows, words, num, den):
    sets = {}
    for i, text in rows:
        w = (text or "").encode().lower().split()
        sets[i] = frozenset(tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))) if w else frozenset()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def fixture():
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(40)]
    base = [rng.choices(vocabulary, k=rng.choice([1, 2, 8, 25, 60, 120])) for _ in range(30)]
    rows = []
    for i in range(180):  # near copies of few texts, around the threshold
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        rows.append((i, " ".join(w).upper() if i % 7 == 0 else "  ".join(w)))
    return rows + [(500, None), (501, ""), (502, " \n "), (503, "one"), (504, "ONE"), (505, "one two"), (506, " ".join(map(str, range(30_000)))), (507, " ".join(map(str, range(29_000))))]


def test_classes_equal_all_pairs(spark):
    rows = fixture()
    df = spark.createDataFrame([(*r, 1) for r in [*rows, rows[3], (None, "one two")]], "doc_id long, text string, node int").repartition(6)
    for words, num, den in ((3, 9, 10), (5, 4, 5)):
        want = plain(rows, words, num, den)
        got = nj.near_duplicate_classes(df, words, num, den).collect()
        assert len(got) == len(rows) + 2
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == want
        assert [r.component_id for r in got if r.doc_id is None] == [None]


def test_large_tiles_are_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(nj, "BLOCK", 8)
    rows = fixture()
    got = nj.near_duplicate_classes(spark.createDataFrame(rows, "doc_id long, text string"), 3, 9, 10).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == plain(rows, 3, 9, 10)


def test_many_alike_below_the_threshold(spark):
    words = [f"w{i}" for i in range(42)]
    rows = [(i, " ".join([*words[:20], f"own{i}", *words[21:]])) for i in range(500)]  # 37 of 43 shingles shared
    rows += [(1000 + i, rows[i][1] + " more") for i in range(20)]  # 40 of 41
    got = nj.near_duplicate_classes(spark.createDataFrame(rows, "doc_id long, text string"), 3, 9, 10).collect()
    assert {r.doc_id: r.component_id for r in got} == {i: i % 1000 for i, _ in rows}


def test_last_step_alone_finds_all_links(spark, monkeypatch):
    monkeypatch.setattr(nj, "FORESTS", 0)
    monkeypatch.setattr(nj, "TILE_SHINGLES", 500)
    rows = fixture()
    got = nj.near_duplicate_classes(spark.createDataFrame(rows, "doc_id long, text string"), 3, 9, 10).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == plain(rows, 3, 9, 10)


def test_one_document_of_each_class_stays(spark):
    rows = fixture()
    out = nj.without_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 5, 4, 5)
    assert sorted(r.doc_id for r in out.collect()) == sorted({c for _, c in plain(rows, 5, 4, 5).values()})


def test_one_row_of_repeated_and_null_ids_stays(spark):
    text, other = " ".join(f"w{i}" for i in range(60)), " ".join(f"v{i}" for i in range(60))
    rows = [(5, text, 1), (5, text, 1), (7, text + " x", 2), (7, other, 3), (None, other + " x", 4), (None, "alone", 5), (None, "alone", 5), (9, "", 6), (9, "", 6), (None, None, 7)]
    for extra in ("__id", "node"):
        out = nj.without_near_duplicates(spark.createDataFrame(rows, f"doc_id long, text string, {extra} int").repartition(3), 5, 4, 5)
        assert out.columns == ["doc_id", "text", extra]
        assert sorted(r[extra] for r in out.collect()) == [1, 3, 5, 6, 6, 7]


def test_empty_table(spark):
    assert nj.without_near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    assert nj.near_duplicate_classes(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_bitmaps_bound_the_overlap_from_above():
    rng = np.random.default_rng(1)
    for _ in range(50):
        a = np.unique(rng.integers(0, 400, 150).astype(np.uint64))
        b = np.unique(rng.integers(0, 400, 150).astype(np.uint64))
        differ = int(np.bitwise_count(nj.bitmap(a, 256) ^ nj.bitmap(b, 256)).sum())
        assert len(np.intersect1d(a, b)) <= (len(a) + len(b) - differ) // 2


def test_bands_hold_all_that_can_be_linked():
    for num, den in ((9, 10), (4, 5)):
        bands = nj.Bands(num, den)
        for a in range(1, 600):
            for b in range(a, a * den // num + 1):
                assert bands.of(b) - bands.of(a) in (0, 1)


def test_linked_sets_share_a_tile():
    rng = np.random.default_rng(2)
    common = rng.integers(0, 3, 1 << 16).astype(np.uint8)
    ranked = lambda x: np.sort((common[(x >> np.uint64(48)).astype(np.int64)].astype(np.uint64) << np.uint64(57)) | (x >> np.uint64(7)))
    for _ in range(300):
        n = int(rng.integers(2, 80))
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2))
        b = np.unique(np.r_[a[rng.random(len(a)) > 0.06], rng.integers(0, 2**63, 2).astype(np.uint64)])
        both = len(np.intersect1d(a, b))
        if len(b) and 10 * both >= 9 * (len(a) + len(b) - both):
            assert set(nj.rarest(ranked(a), 9, 10).tolist()) & set(nj.rarest(ranked(b), 9, 10).tolist())


def test_words_and_shingles_are_those_of_the_plain_reading():
    import pyarrow as pa

    rng = random.Random(3)
    texts = ["", None, "  ", "a", " A b", "b a", "x\x0by\tz\x1cq r", "É é É é É", "ab c", "a bc", *("".join(rng.choices("aB é\n\x0c", k=rng.randrange(80))) for _ in range(300))]
    plain = [tuple(t.encode().lower().split()) if t else () for t in texts]
    for limit in (1, 50, 1 << 19):
        nj.BYTES_AT_ONCE, kept = limit, nj.BYTES_AT_ONCE
        try:
            got = [ids.tolist() for _, ids in nj.Shingler(2, np.zeros(1 << nj.SKETCH_BITS, np.uint8)).sets(pa.array(["skip", *texts]).slice(1))]
        finally:
            nj.BYTES_AT_ONCE = kept
        name = {}
        for w, ids in zip(plain, got, strict=True):
            want = {w[k : k + 2] for k in range(max(1, len(w) - 1))} if w else set()
            assert ids == sorted(set(ids)) and len(ids) == len(want)
            name.setdefault(frozenset(want), ids)
            assert name[frozenset(want)] == ids
        assert len({tuple(v) for v in name.values()}) == len(name)


def test_blocks_and_visitors_find_every_pair_once_put_together():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 60, rng.integers(20, 40)).astype(np.uint64)) for _ in range(120)]
    comp, bands = rng.integers(0, 6, 120), nj.Bands(4, 5)
    rows = []
    for i, s in enumerate(sets):
        b = bands.of(len(s))
        at = [(b, i % 3, 0)] + [(b + d, k, 1) for d in (-1, 0, 1) for k in range(3) if comp[i] != 0 and (d or k != i % 3)]
        rows += [(7, g, k, visit, 0, len(s), i, int(comp[i]), nj.bitmap(s, nj.SHORT_BITS).tobytes()) for g, k, visit in at]
    import pyarrow as pa

    rows.sort(key=lambda r: r[:4])
    names = ["key", "gband", "block", "visit", "main", "n", "node", "comp", "short"]
    for step in (1, 7, 1000):
        batches = [pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows[k : k + step]]) for k in range(0, len(rows), step)]
        got = {(r["a"], r["b"]) for out in nj._tile_pairs(4, 5, None)(batches) for r in out.to_pylist()}
        for a in range(120):
            for b in range(a + 1, 120):
                both = len(np.intersect1d(sets[a], sets[b]))
                if comp[a] != comp[b] and 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both):
                    assert (a, b) in got
                assert comp[a] != comp[b] or (a, b) not in got


def test_components_of_a_long_chain(spark):
    from tessera.llm.common import Scratch

    links = spark.createDataFrame([(i, i + 1) for i in range(0, 60)] + [(100, 101)], "a long, b long")
    with Scratch(spark) as scratch:
        got = defaultdict(set)
        for r in nj.components(links, scratch, "t").collect():
            got[r.comp].add(r.node)
    assert dict(got) == {0: set(range(61)), 100: {100, 101}}
