"""The corpus pipeline: from raw documents to packed sequences. Each stage works on all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import decontaminate, language, lines, neardup, packing
from plumbline.llm.common import forget, keep, with_text_key
from plumbline.llm.queries import SPECIAL_TOKENS, held_out, tokenizer_files

# Nearer than this the two likeliest languages of a text cannot be told apart.
REJECT_MARGIN = 0.01


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter and those whose language stays ambiguous go."""
    found = language.identify(docs, train=~held_out("doc_id", 5, 0), margin=REJECT_MARGIN)
    rejected = found.where(F.col("ambiguous") | (F.col("lang_pred") == language.UNKNOWN))
    rejected = keep(rejected.select(F.col("t1").alias("__a"), F.col("t2").alias("__b")).distinct(), "rejected")
    keyed = with_text_key(docs, "text", "__t1", "__t2")
    return keyed.join(rejected, (F.col("__t1") == F.col("__a")) & (F.col("__t2") == F.col("__b")), "left_anti").select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines similar to an earlier one go; n_chars follows the text."""
    return lines.remove_similar_lines(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def simhash_neardup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays."""
    return neardup.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold too much of a benchmark item go."""
    return decontaminate.without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents and their places in sequences."""
    return packing.pack_documents(docs, *tokenizer_files(), special=SPECIAL_TOKENS)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("simhash_neardup", simhash_neardup),
    ("decontamination", decontamination),
    ("best_fit_packing", best_fit_packing),
]

# Learned classifiers, fingerprints and tokens cannot be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, keep(stage(spark, docs, sf_dir), name)
        forget(spark, before)  # of the tables written here; the input stays
    return STAGES[-1][1](spark, docs, sf_dir)
