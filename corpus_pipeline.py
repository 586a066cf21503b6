"""A corpus pipeline over documents: five stages, each written as Parquet and read again as the next one's input."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from reelspan.llm import decontaminate, packing, quality_rules, secret_scan
from reelspan.llm import near_dedup as near_dedup_stage
from reelspan.sources import scratch


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, without boilerplate lines. Near-duplicates are one document where lines are counted, so that a text that is
    copied often with small changes is not taken for boilerplate of its copies; which of them stays is the next stage's matter.

    Null and empty texts have no words and go; a null source is a host of its own; repeated rows are judged alike and stay repeated.
    """
    classes = near_dedup_stage.classes(docs.select("doc_id", "text"), quality_rules.text_key())
    return quality_rules.cleaned(docs, classes=classes)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: a Jaccard similarity of five-word shingles of 0.8 or more.

    The least doc_id stays (a null one counts as the greatest), among equal ones that of the least digest; repeated rows stay once.
    """
    return near_dedup_stage.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no benchmark item.

    Null texts leak nothing and stay; an empty benchmark lets all documents stay; repeated rows stay or go together.
    """
    return decontaminate.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their secrets redacted; null and empty texts stay as they are."""
    return secret_scan.redacted(docs, words=public_tokenizers.path("byte_bpe_50k.json"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences; a null or empty text is its end id, a null doc_id stays null."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality_rules", quality), ("near_dedup", near_dedup), ("decontamination", decontamination), ("secret_scan", secrets), ("packing", pack)]

ORACLE_SQL = None  # the stages hash shingles, price passwords and tokenise, which SQL cannot express


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Every stage reads what its predecessor wrote; further columns of documents, whatever
    their names, go through all stages but the last. Texts are taken whole. A stage's intermediate tables are deleted
    when it is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch.new_path(spark, f"pipeline-{name}")
        with scratch.released(spark):
            result = stage(spark, docs, sf_dir)
            result.write.parquet(path)
        docs = spark.read.schema(result.schema).parquet(path)
    return docs
