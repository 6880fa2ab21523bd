"""Stages of the corpus pipeline: (spark, docs, sf_dir) to the kept documents, with the columns of documents.

All stages: a null text counts as empty, columns besides those of documents are dropped, no rows give no rows, and
texts of any length are read whole. What becomes of ties, repeated rows and null ids is said at each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import queries
from .byte_cnn import classify_documents
from .mixing import mix_sources
from .near_dup import near_duplicates
from .packing import best_fit_packing
from .substring_dedup import remove_repeats

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go. Each row is judged by itself, repeated ones alike; null ids stay possible."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return classify_documents(docs.select(*COLUMNS), labels).where("predicted = 1").select(*COLUMNS)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the least doc_id; shingles of five words, similarity of 0.8 or more.

    doc_id names a document: rows that repeat a doc_id that stays all stay. Null doc_ids stay if no document with an id is like them.
    """
    kept = near_duplicates(docs).where("kept").select(F.col("doc_id").alias("_kept"))
    return docs.select(*COLUMNS).join(kept, F.col("doc_id").eqNullSafe(F.col("_kept")), "left_semi").select(*COLUMNS)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sentences in repeats of an earlier passage go; every document stays, n_chars follows. Rows alike in doc_id and text are cut alike."""
    return remove_repeats(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents chosen for the target weights, four fifths of all tokens; no second epoch, so that nothing is repeated. Rows alike in doc_id are taken together."""
    return mix_sources(docs.select(*COLUMNS), queries.mixture(docs), max_epochs=1, share=0.8).where("copies > 0").select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents and their places in sequences. Each row is a document, repeated ones too."""
    return best_fit_packing(docs, queries.tokenizer("byte_bpe_50k.json"), queries.SIZE, queries.END)
