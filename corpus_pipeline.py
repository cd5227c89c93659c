"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again.

Every stage works on all rows that the one before kept, and all but the last return the columns of
documents. Null, empty, very long and repeated texts pass through each stage as its operator says.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noteloom.llm import decontam, neardup, packing, quality, sufdedup
from noteloom.llm.common import Scratch, table
from noteloom.llm.queries import vocabulary

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents with a score of at least 0.3. The model learns from ``labels`` and from ``docs``."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model, keep=[*COLUMNS, "text"]).filter("score >= 0.3").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near duplicates: five words, similarity 0.8. Of rows
    that share a kept id all stay."""
    members, _ = neardup.near_duplicates(docs, neardup.Rule(shingle=5, under=80))
    gone = members.filter("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts byte strings of 200 bytes that also start earlier; the first copy stays. A character cut in two goes
    whole. Documents of which nothing but white space is left go; those that lost nothing are unchanged."""
    left = sufdedup.dedup(docs, length=200, keep_first=True, keep=COLUMNS, whole_characters=True)
    text = F.when(F.col("n_removed") == 0, F.col("text")).otherwise(F.col("kept").cast("string"))
    left = left.withColumn("text", text).filter((F.col("n_removed") == 0) | F.col("text").rlike(r"\S"))
    return left.withColumn("n_chars", F.when(F.col("n_removed") == 0, F.col("n_chars")).otherwise(F.length("text").cast("long"))).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in which no window of 13 words (or whole shorter item) of ``benchmark`` occurs."""
    hit = decontam.hits(decontam.search(docs, table(spark, sf_dir, "benchmark"), window=13))
    gone = hit.filter("n_hit > 0").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens: one row per piece."""
    pieces = packing.pack(docs, vocabulary(), tokens=2048)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality_classifier),
    ("MinHash near-dedup", near_duplicates),
    ("suffix-array dedup", suffix_dedup),
    ("benchmark decontamination", decontamination),
    ("packing", packed),
]

#: Hashing, training and tokenising are not expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for name, stage in STAGES[:-1]:
        docs = scratch.save(name.replace(" ", "-"), stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
