"""From raw documents to tokens: quality rules, line dedup, near dedup, mixing, encoding.

Every stage takes what its predecessor kept, written as Parquet, and all but the last
return the columns of documents.  Rows without an id are documents like any other;
repeated rows are one document to the dedup stages.  Empty tables give empty ones, and extra
columns may have any name.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leakscope.llm import bpe, lines, mixing, neardup, quality
from leakscope.llm.queries import RANKS
from leakscope.session import materialize


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the rejected documents, and without lines that more than 20 distinct texts of
    a source share.  A source has any number of texts, so no share of them is asked for."""
    return quality.clean(docs, fraction=0.0, at_least=20)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without lines that equal or nearly equal an earlier one, and without documents that
    lose more than nine tenths of their words so: copies of earlier ones, not remnants to keep."""
    return lines.dedup_lines(docs, least_left=0.1)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8."""
    return neardup.keep_one(docs, width=5, percent=80)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each source at its target: documents repeat as often as they are taken."""
    rows = docs.select("doc_id", "text", "source", F.struct(*docs.columns).alias("_document"))
    mixed = mixing.mix(rows, mixing.word_count(F.col("text")), keep=("_document",))
    taken = mixed.select("_document", F.col("_document.text").alias("text"), "taken", "size")
    out = mixing.repeat_documents(taken, F.col("taken"), F.col("size"))
    changed = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return out.select(*[changed.get(c, F.col("_document")[c]).alias(c) for c in docs.columns])


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document of the mix."""
    return bpe.encode_documents(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_dedup), ("near_dedup", near_dedup),
          ("source_mix", source_mix), ("byte_bpe", encode)]

# Near dedup and encoding are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
