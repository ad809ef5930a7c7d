"""The corpus pipeline: language ID, near duplicates, decontamination, mixing and sharding, each stage on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pagemill.llm.common import stored
from pagemill.llm.decontam import without_overlaps
from pagemill.llm.langid import fit_languages, identified
from pagemill.llm.mixing import mixed_rows
from pagemill.llm.ngram_join import without_near_copies
from pagemill.llm.sharding import shard_documents


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognisable language go: null or letterless texts, and those of a score under 0.3.

    With no labelled row there is no language to recognise and all go. Null ids, sources and languages are no reason to go.
    """
    return identified(docs, fit_languages(docs), least=0.3)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one document, an id and its text, stays: that of the smallest id.

    Of a group the rows without an id go if another has one, else one of them stays. One id on two texts is two documents;
    of repeated rows one stays. Texts without words always stay.
    """
    return without_near_copies(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap with a benchmark item go; null texts overlap with nothing and rows are judged one by one."""
    return without_overlaps(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document stands as often as the mix takes it; the null source is a source, and texts of no words cost nothing."""
    return mixed_rows(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every row that is left, copies and rows of equal ids included."""
    return shard_documents(docs)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("mix", mix), ("shard", shard)]

#: The language model and the seeds have no SQL form; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, name)
    return docs
