"""The pipeline over documents: five stages, each one operator, written and read again between them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortflow.llm import exact, language, packing, quality, simhash
from cohortflow.llm.common import ROW, fold, scratch, table, without
from cohortflow.llm.encoding import tokenizer_path

# A document goes if most of its places are unseen by the language model and no language leads clearly. Both are per word or
# place, so they mean the same for one word and for a book.
UNSEEN = 0.6
MARGIN = 0.5  # in log frequency per word


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the discriminant calls good; it learns from the labels outside the held-out fold."""
    found = quality.classify(docs, table(spark, sf_dir, "labels"))
    return without(docs, found.where("predicted = 0"))


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the model knows; it learns from their own ``lang`` outside the held-out fold."""
    model = language.fit(docs.where(fold("doc_id", 4) != 2))
    found = language.identify(docs, model)
    foreign = (F.col("unseen") > UNSEEN) & (F.col("margin") < MARGIN)
    return without(docs, found.where((F.col("lang_pred") == language.UNKNOWN) | foreign))


def exact_copies_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return without(docs, exact.duplicates(docs).where("NOT kept"))


def near_copies_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return without(docs, simhash.near_duplicates(docs).where("NOT kept"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all pieces of what is left."""
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"), end_id=1)


STAGES = [("quality", good_quality), ("language", known_language), ("exact_dedup", exact_copies_out),
          ("near_dedup", near_copies_out), ("packing", packed)]

#: Stages with trained models and tokenizers aren't SQL: tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is written in the shared folder and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
