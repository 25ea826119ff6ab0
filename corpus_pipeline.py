"""A training corpus from documents: toxicity, line dedup, near duplicates, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written
as Parquet and read again as the next stage's docs. All but the last return
the columns of documents.

Defined cases. Null and empty texts are kept by every stage but the mix, which
takes words. A null doc_id is a value like others, the last one where the
smallest counts. Of repeated rows with words one stays. Empty tables give empty
results. Further columns pass through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, table, unused
from tessera.llm.line_dedup import line_dedup
from tessera.llm.mixing import mixed
from tessera.llm.ngram_join import without_near_duplicates
from tessera.llm.packing import packed
from tessera.llm.toxicity import THRESHOLD, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below the threshold; the score is learned from the labels of these documents."""
    (score,) = unused(docs, "__score")
    return toxicity(docs, table(spark, sf_dir, "labels"), out=score).where(F.col(score) < THRESHOLD).select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A line found in 10 documents or more stays only where it stands first, so that copies don't erase their original."""
    return line_dedup(docs, min_docs=10, keep="first")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class: shingles of five words, similarity 0.8 or more."""
    return without_near_duplicates(docs, words=5, num=4, den=5)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a document that is taken more than once is as many rows, the last perhaps a part of it."""
    return mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packed(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("ngram_join", drop_near_duplicates),
    ("source_mixing", mix_sources),
    ("packing", pack_sequences),
]

#: No SQL says what a learned score, a seeded mix and a genetic packing do; the tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn over documents."""
    scratch, docs = Scratch(spark), table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = scratch.table(stage(spark, docs, sf_dir), f"{i}-{name}", keep=True)
    return docs
