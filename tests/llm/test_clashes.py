"""Columns whose names the operators use themselves, and empty tables, through every operator that passes columns on."""

import pytest
from pyspark.sql import functions as F

from tessera.llm.line_dedup import line_dedup
from tessera.llm.media_columns import build, media_columns
from tessera.llm.mixing import mixed
from tessera.llm.ngram_join import without_near_duplicates
from tessera.llm.surrogates import with_surrogates
from tessera.llm.toxicity import toxicity

NAMES = ["__text", "__k1", "__k2", "__bitmap", "keep_bitmap", "n_dropped", "__key", "__nth", "__size", "__takes", "__row", "__put", "__kinds", "h", "found", "node", "key", "size", "__other0", "Text2", "__id"]
ROWS = [(1, "one line\ntwo words here", "a"), (2, "other text a@b.example.com", "a"), (None, None, None), (3, "", "b")]


def operators(spark):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    return {
        "line_dedup": line_dedup,
        "mixed": lambda d: mixed(d, block_words=1),
        "with_surrogates": lambda d: with_surrogates(d, "k").drop("n_entities", "kinds"),
        "without_near_duplicates": without_near_duplicates,
        "toxicity": lambda d: toxicity(d, labels).drop("__score"),
    }


@pytest.mark.parametrize("name", ["line_dedup", "mixed", "with_surrogates", "without_near_duplicates", "toxicity"])
def test_columns_keep_their_names_and_values(spark, name):
    operator = operators(spark)[name]
    df = spark.createDataFrame(ROWS, "doc_id long, text string, source string").withColumns({c: F.lit(f"own {c}") for c in NAMES})
    out = operator(df)
    assert out.columns == df.columns
    got = out.collect()
    assert got and all(r[c] == f"own {c}" for r in got for c in NAMES)
    assert operator(df.limit(0)).collect() == []


def test_media_column_is_replaced(spark):
    df = spark.createDataFrame([(1, build(b"x" * 192), 5), (2, None, 6), (2, b"", 6)], "media_id long, raw binary, media int")
    got = media_columns(df, "raw").collect()
    assert got[0].media.tracks[0].n_samples == 1 and got[1].media.error and got[2].media.error
