import random
import re

import pytest


import corpus_pipeline
from tessera.llm.line_dedup import line_key
from tessera.llm.toxicity import THRESHOLD, toxicity

from .test_search_toxicity import labelled


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(9)
    rows, labels = labelled()
    docs = [(i, None if t is None else t.replace(" word", "\nword", 1), rng.choice(["en", "de"]), rng.choice(["a", "a", "b", None]), len(t or "")) for i, t, _ in rows]
    docs += [(6000 + i, "shared header line\n" + docs[40 + i][1], "en", "a", 1) for i in range(12)]
    docs += [(7000, docs[1][1] + " tail", "en", "b", 1), (7001, docs[1][1], "en", "b", 1)]
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages_are_the_named_ones():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "ngram_join", "source_mixing", "packing"]
    assert "ImportError" not in open(corpus_pipeline.__file__).read()


def test_each_stage_on_what_the_last_one_kept(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names, kept = docs.columns, []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        assert i == 4 or docs.columns == names
        kept.append([r.asDict() for r in docs.collect()])
    toxic, lines, near, mix, packs = kept
    first = spark.read.parquet(f"{folder}/documents.parquet")
    scored = toxicity(first, spark.read.parquet(f"{folder}/labels.parquet")).collect()
    assert sorted(r.doc_id or -1 for r in scored if r["__score"] < THRESHOLD) == sorted(r["doc_id"] or -1 for r in toxic)
    assert not any(re.search(r"\b(idiot|grobblik|snarfo)\b", r["text"] or "") for r in toxic)
    # A frequent line is left once.
    assert sum(line_key(x) == b"shared header line" for r in lines for x in (r["text"] or "").encode().split(b"\n")) == 1
    assert len(lines) == len(toxic) and all(r["n_chars"] == len(r["text"]) for r in lines if r["text"] is not None)
    ids = {r["doc_id"] for r in near}
    assert ids <= {r["doc_id"] for r in lines} and not ids & {7000, 7001, *range(6000, 6012)}
    own = {r["doc_id"]: r["text"] or "" for r in near}
    for r in mix:
        assert own[r["doc_id"]].startswith(r["text"])
    words = sum(len(t.split()) for t in own.values())
    assert abs(sum(len(r["text"].split()) for r in mix) - 1.5 * words) < 0.02 * words
    at = {}
    for r in packs:
        at.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert all(sum(n for _, n in x) <= 2048 for x in at.values()) and len({r["doc_id"] for r in packs}) == len({r["doc_id"] for r in mix})
