import heapq
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tessera.llm.mixing import apportion, filled, first_words, mix_digest, mixed
from tessera.llm.packing import Breeder, WordEncoder, packed


def test_apportion_is_sainte_lague():
    rng = random.Random(1)
    for _ in range(60):
        t = [rng.choice([0, 1, 5, 5, rng.random() * 100]) for _ in range(rng.randrange(1, 9))]
        seats = rng.randrange(0, 60)
        heap = [(-x, i, 0) for i, x in enumerate(t) if x > 0]
        heapq.heapify(heap)
        want = [0] * len(t)
        for _ in range(seats if heap else 0):
            q, i, g = heapq.heappop(heap)
            want[i] += 1
            heapq.heappush(heap, (-t[i] / (2 * g + 3), i, g + 1))
        got = apportion(np.array(t), seats)
        assert got.sum() == sum(want) and sorted(t[i] / (2 * want[i] - 1) for i in range(len(t)) if want[i]) == sorted(t[i] / (2 * int(got[i]) - 1) for i in range(len(t)) if got[i])


def test_targets_stop_at_twice_their_source():
    sizes = np.array([100, 1000, 1000, 0])
    out = filled(sizes, np.array([3.0, 1.0, 2.0, 3.0]), 1.5 * 2100, 2.0)
    assert out[0] == 200 and out[3] == 0 and abs(out.sum() - 3150) < 1e-9 and (out <= 2 * sizes + 1e-9).all()


def mix_rows():
    rng = random.Random(4)
    rows = [(i, " ".join(["w"] * rng.randrange(0, 300)), rng.choice(["a", "a", "a", "b", "é", None]), 1) for i in range(400)]
    return rows + [(900, None, "b", 1), (901, "", None, 1), (902, "x " * 4000, "b", 1), rows[0], rows[0]]


def test_mix_keeps_targets_and_reruns(spark):
    df = spark.createDataFrame(mix_rows(), "doc_id long, text string, source string, taken int").repartition(6)
    one = sorted(map(tuple, mix_digest(df).collect()), key=str)
    assert one == sorted(map(tuple, mix_digest(df.repartition(3)).collect()), key=str)
    assert len(one) == len(mix_rows())
    by = defaultdict(int)
    for _, size, source_size, target, taken in one:
        assert 0 <= taken <= 2 * size
        by[source_size, target] += taken
    assert all(abs(taken - target) <= 64 for (_, target), taken in by.items())
    assert abs(sum(t for _, t in by) - 1.5 * sum(r[1] for r in one)) < 1e-6


def test_mixed_rows_hold_what_is_taken(spark):
    df = spark.createDataFrame(mix_rows(), "doc_id long, text string, source string, taken int")
    plan = sum(r.taken for r in mix_digest(df).collect())
    out = mixed(df)
    assert out.columns == df.columns
    assert sum(len((r.text or "").split()) for r in out.collect()) == plan
    assert first_words(b" a  b c ", 2) == b" a  b"


def test_empty_mix_and_pack(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mix_digest(empty).collect() == [] and packed(empty).collect() == []


def test_packing(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choices(["alpha", "Beta,", "gämma", "don't", "12.5", "zzz!!", "ſtrange", "…"], k=rng.choice([0, 3, 50, 400, 900])))) for i in range(150)]
    rows += [(1000, None), (1001, ""), (1002, "word " * 9000), rows[5], (None, "a b c"), (1003, "<|endoftext|> x"), (1004, "x a<|endoftext|>B <|ENDOFTEXT|> <|startoftext|>"), (1005, " it's  WE'LL\u00a0ok \x1c x²  Ünd"), (1006, "né " * 3000)]
    got = packed(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, uid int")).collect()
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = []
    for i, text in rows:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        want += [(i or -1, p, s, len(ids[s : s + 2048]), zlib.crc32(ids[s : s + 2048].tobytes())) for p, s in enumerate(range(0, len(ids), 2048))]
    assert sorted((r.doc_id or -1, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(by) <= -(-sum(r.length for r in got) // 2048) + 1


def test_genetic_search_reaches_a_perfect_packing():
    rng = random.Random(7)
    lengths = []
    for _ in range(40):  # each bin of 100 can be filled exactly
        a, b = sorted(rng.sample(range(20, 80), 2))
        lengths += [a, b - a, 100 - b]
    breeder = Breeder(lengths, 100, 1)
    first, last = breeder.first(0), breeder.epoch([], 60, 6)[0]
    assert sorted(i for b in last[1] for i in b) == list(range(len(lengths)))
    assert all(sum(lengths[i] for i in b) <= 100 for b in last[1]) and len(last[1]) <= len(first[1])
    child = breeder.cross(breeder.first(1), breeder.first(2))
    assert sorted(i for b in child[1] for i in b) == list(range(len(lengths)))


def test_word_encoder_cuts_long_texts_at_white_space(monkeypatch):
    rng = random.Random(4)
    text = " ".join("".join(rng.choices("abé'.1", k=rng.randrange(1, 9))) for _ in range(400))
    want = WordEncoder("word_bpe_49k.json").encode([text.encode(), b"", b"a"])
    monkeypatch.setattr("tessera.llm.packing.BYTES_AT_ONCE", 50)
    assert WordEncoder("word_bpe_49k.json").encode([text.encode(), b"", b"a"]) == want


def test_word_encoder_forgets_and_still_agrees(monkeypatch):
    monkeypatch.setattr("tessera.llm.packing.CACHE_WORDS", 3)
    enc = WordEncoder("word_bpe_49k.json")
    for text in ("One two three four", "five SIX, seven.", "one"):
        want = np.array(enc.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        assert enc.encode([text.encode()]) == [want]
