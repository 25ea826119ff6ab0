import hashlib
import random
from collections import defaultdict

from tessera.llm.line_dedup import line_dedup, line_dedup_digest, line_key

SCHEMA = "doc_id long, text string, __h1 string, n_dropped int"


def fixture():
    rng = random.Random(3)
    pool = ["Home | About ", "home | about", "ALL RIGHTS", "x", " ", "é", "É"] + [f"line {i}" for i in range(30)]
    rows = [(i, "\n".join(rng.choices(pool, k=rng.randrange(1, 9)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "a\n" * 3000), (103, " x \n\t x\r")]
    rows += [(i, "copy one\ncopy two") for i in range(200, 230)]
    return rows + [rows[0]] + [(None, "home | about\nfree")]


def plain(rows, min_docs, keep):
    docs = defaultdict(set)
    for r in set(rows):
        for line in (r[1] or "").encode().split(b"\n"):
            if line_key(line):
                docs[line_key(line)].add(r)
    seen, out = set(), {}
    for r in sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0)):
        kept, lines = [], (r[1] or "").encode().split(b"\n")
        for line in lines:
            k = line_key(line)
            if k and len(docs[k]) >= min_docs and (keep == "none" or k in seen):
                continue
            if k:
                seen.add(k)
            kept.append(line)
        out[r] = (len(lines), len(lines) - len(kept), b"\n".join(kept))
    return out


def test_digest_equals_plain(spark):
    rows = fixture()
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA).repartition(7)
    got = sorted((r.doc_id or -1, r.n_lines, r.n_dropped, r.kept_sha256) for r in line_dedup_digest(df, 10).collect())
    want = plain(rows, 10, "none")
    assert got == sorted((r[0] or -1, want[r][0], want[r][1], hashlib.sha256(want[r][2]).hexdigest()) for r in rows)


def test_first_occurrence_stays(spark):
    rows = fixture()
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA).repartition(5)
    out = line_dedup(df, 10, "first")
    assert out.columns == df.columns
    want = plain(rows, 10, "first")
    assert sorted((r.doc_id or -1, (r.text or "")) for r in out.collect()) == sorted((r[0] or -1, want[r][2].decode()) for r in rows)


def test_empty_table(spark):
    assert line_dedup_digest(spark.createDataFrame([], "doc_id long, text string"), 10).collect() == []
