"""A training corpus from documents: quality, toxicity, near-duplicates, benchmark passages, packing.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that the stage before
kept.  All but the last return rows of ``docs`` with the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framesleuth.llm import scratch
from framesleuth.llm.decontaminate import decontaminate
from framesleuth.llm.minhash import near_duplicates
from framesleuth.llm.packing import pack_documents
from framesleuth.llm.quality import resample
from framesleuth.llm.registry import table
from framesleuth.llm.toxicity import score_toxicity

CAPACITY = 2048
#: Similarity in a hundred from which word-shingle sets count as near copies here (op10 has its own), and
#: bands for it: a pair at 0.80 shares no band of 6 coordinates with probability 3e-7.
NEAR_PERCENT, NEAR_BANDS, NEAR_ROWS = 80, 50, 6


def _rowed(docs: DataFrame) -> DataFrame:
    """Id and text, and the rest of each row in a struct, where an operator's columns cannot take its columns' place."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", F.struct(F.lit(0).alias("_"), *rest).alias("rest_of_row"))


def _unrowed(rows: DataFrame, docs: DataFrame) -> DataFrame:
    return rows.select(*(F.col(c) if c in ("doc_id", "text") else F.col("rest_of_row")[c].alias(c) for c in docs.columns))


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling keeps."""
    return _unrowed(resample(_rowed(docs), table(spark, sf_dir, "labels")).where("kept"), docs)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain does not call toxic."""
    return _unrowed(score_toxicity(_rowed(docs), table(spark, sf_dir, "labels")).where(~F.coalesce("toxic", F.lit(False))), docs)


def drop_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each near-duplicate group at similarity 0.80; of rows with equal id and text one stays."""
    found = near_duplicates(docs, NEAR_PERCENT, bands=NEAR_BANDS, rows=NEAR_ROWS).select("doc_id", F.col("row_key").alias("near_key"), "group_key")
    first = found.where("group_key IS NOT NULL").groupBy("group_key").agg(F.min(F.struct("doc_id", "near_key"))["near_key"].alias("first_key"))
    gone = found.join(first, "group_key").where("near_key <> first_key").select("near_key").distinct()
    rows = _rowed(docs).withColumn("own_key", F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")))
    return _unrowed(rows.join(gone, rows["own_key"] == gone["near_key"], "left_anti").dropDuplicates(["own_key"]), docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces in sequences of at most 2048, with their ids (16-bit, little-endian)."""
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), 0, CAPACITY, encode_special_tokens=False)


STAGES = [
    ("quality", keep_quality),
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_duplicates),
    ("decontamination", drop_leaks),
    ("packing", pack_sequences),
]

#: Trained models and tokenizers cannot be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the documents; each result is written and read back before the next."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs, path = scratch.write(stage(spark, docs, sf_dir), f"stage-{name}")
        if before:
            scratch.drop(spark, before)
        before = path
    return docs
