"""The training-data pipeline: quality rules, line dedup, near-duplicates, mixing and packing over `documents`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.line_dedup import dedup_passages
from tickloom.llm.mixing import mixed_documents
from tickloom.llm.packing import pack
from tickloom.llm.quality import keep_quality
from tickloom.llm.queries import vocabulary
from tickloom.llm.shared import cut
from tickloom.llm.simhash import keep_one


def _sized(docs: DataFrame) -> DataFrame:
    """n_chars follows the text where a stage may change it."""
    return docs.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_quality(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _sized(dedup_passages(docs))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _sized(mixed_documents(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [("quality rules", quality), ("line dedup", lines), ("near-duplicates", near_copies), ("mixing", mixed), ("packing", packed)]

#: Fingerprints, repeats and token ids have no SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
