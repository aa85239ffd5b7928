"""From raw documents to packed training sequences, in five stages.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that the one before
kept. All but the last return the columns of ``documents``. The session reads
and hands to Python fewer rows at a time from the first stage on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stutter.llm.decontamination import decontaminated
from stutter.llm.jaccard_join import jaccard_join
from stutter.llm.language_id import identified
from stutter.llm.line_chunks import without_repeats
from stutter.llm.packing import pack_documents
from stutter.llm.shared import in_small_batches, with_few, written
from stutter.operators.blocks import scratch


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in some language, with ``lang`` filled in where it is null and can be told; null texts and those without a letter go."""
    in_small_batches(spark)
    return identified(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated chunks of lines are cut out; documents stay."""
    in_small_batches(spark)
    return without_repeats(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies stays.

    Of rows with one id and text, the one whose other columns come first as JSON
    stays, so the same rows are kept in every run. Texts without words and rows
    with a null id are near copies of nothing and stay; an empty table stays empty.
    """
    in_small_batches(spark)
    groups = written(jaccard_join(docs).select("doc_id", "component_id"))
    gone = written(groups.where("doc_id <> component_id").select("doc_id").distinct())
    kept = with_few(docs, gone, "doc_id", "left_anti")
    repeated = written(groups.where("doc_id = component_id").groupBy("doc_id").count().where("count > 1").select("doc_id"))
    if repeated.isEmpty():
        return kept.select(*docs.columns)
    once = with_few(kept, repeated, "doc_id", "left_anti").select(*docs.columns)
    several = with_few(kept, repeated, "doc_id").select(*docs.columns)
    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")])
    several = several.groupBy("doc_id", "text").agg(F.min_by(rest, F.to_json(rest)).alias("_rest"))
    columns = [F.col(c) if c in ("doc_id", "text") else F.col("_rest")[c].alias(c) for c in docs.columns]
    return once.unionByName(several.select(*columns))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of a test item go.

    Equal rows go or stay together. Null and empty texts stay, and rows with a
    null id are judged by their text; without test items all rows stay.
    """
    in_small_batches(spark)
    return decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in sequences.

    A null or empty text is a piece of one id; equal rows are packed each on its
    own, remainders of equal size by id; an empty table gives no pieces.
    """
    in_small_batches(spark)
    return pack_documents(docs)


STAGES = [
    ("language_id", languages),
    ("line_dedup", lines),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontaminate),
    ("packing", packing),
]

ORACLE_SQL = None  # a trained model, rolling hashes and a tokenizer are not for SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = scratch(spark, "pipeline")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
