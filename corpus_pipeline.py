"""A corpus pipeline of five stages over the documents table."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphstream.llm.decontamination import decontaminate
from glyphstream.llm.line_dedup import line_dedup
from glyphstream.llm.minhash import minhash_dedup
from glyphstream.llm.packing import best_fit_pack
from glyphstream.llm.quality_rules import quality_rules
from glyphstream.llm.shared import ROW_GROUP_BYTES, scratch, shared_dir

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _documents(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the learnt quality rules keep."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_rules(docs, labels).filter("kept").select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier one has."""
    return _documents(line_dedup(docs))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near-duplicates."""
    kept = minhash_dedup(docs, shingle_words=5, percent=80).filter("kept and doc_id is not null").select("doc_id").distinct()
    return docs.join(kept, "doc_id", "left_semi").unionByName(docs.filter("doc_id is null")).select(*COLUMNS)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages; those that are mostly such passages go."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    judged = decontaminate(docs, benchmark, width=10)
    return _documents(judged.filter(~F.col("dropped")).withColumn("text", F.when(F.col("text").isNotNull(), F.col("cleaned"))))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 4096 tokens."""
    return best_fit_pack(docs, public_tokenizers.path("word_bpe_49k.json"), size=4096, end_id=1)


STAGES = [
    ("quality rules", keep_good),
    ("line dedup", drop_repeated_lines),
    ("minhash near-dedup", keep_one_of_each),
    ("benchmark decontamination", remove_benchmark),
    ("best-fit packing", pack),
]
#: Learnt rules, confirmed near-duplicates, automata and packing have no SQL; see tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/{name.replace(' ', '-')}-{uuid.uuid4().hex}"
        with scratch(spark):  # what a stage wrote on its way goes once its result is written
            kept = stage(spark, docs, sf_dir)
            kept.write.option("parquet.block.size", ROW_GROUP_BYTES).parquet(path)
        docs = spark.read.schema(kept.schema).parquet(path)
    return docs
