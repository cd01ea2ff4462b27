"""A corpus from raw documents to packed training sequences.

Five stages, each one operator of twinspan.llm over all that the stage before it kept: quality
classifier, toxicity, near duplicates, mixing sources to target weights, best-fit packing.

A null or empty text is judged by the classifiers' intercepts alone and has size 0 in the mix; a null source is a source of its
own. Rows without doc_id are no near duplicates of others; of rows that repeat one, the near-duplicate stage keeps one.
Further columns go through to the mix. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinspan.llm import jaccard_join, mixing, packing, quality_classifier, toxicity
from twinspan.llm.words import word_count
from twinspan.plans.scratch import free, release, save
from twinspan.sources.tables import table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Near duplicates: shingles of five words, Jaccard similarity of 0.8 or more.
SHINGLE, SIMILARITY = 5, (4, 5)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    return quality_classifier.keep(docs, table(spark, sf_dir, "labels"))


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't found toxic."""
    return toxicity.keep(docs, table(spark, sf_dir, "labels"))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of the smallest id."""
    return jaccard_join.keep_one(docs, SHINGLE, SIMILARITY)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it: not at all, once or twice."""
    return mixing.mixed(docs, word_count(F.col("text")))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of 2048 tokens."""
    return packing.pack_documents(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", keep_quality),
    ("toxicity", keep_clean),
    ("jaccard_join", keep_one_of_each),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: SQL can express neither trained models nor tokenizers; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder, each stage's rows written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, save(stage(spark, docs, sf_dir), name)
        free(before)
        release(spark)
    return STAGES[-1][1](spark, docs, sf_dir)
