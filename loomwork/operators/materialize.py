"""Chunks kept up to date: each build adds what has changed since the last one, and nothing else.

A table of chunks is a folder of builds, numbered. A build holds pages (key, content_hash, policy, gone, n_chunks), a row for each document
that was new, changed or gone, and chunks of these documents. What is current of a document is what the last build that names it says. A
build counts once its pages are written, which comes last: a writer that is lost leaves nothing that is read, and the next run
does the same build again. Two writers at once are not looked after.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import chunk_hash
from ..sources import store


def builds(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the complete builds."""
    out = []
    while store.exists(spark, f"{path}/build-{len(out) + 1}/pages/_SUCCESS"):
        out.append(len(out) + 1)
    return out


def _union(spark: SparkSession, path: str, name: str, numbers: list[int]) -> DataFrame:
    return spark.read.parquet(*(f"{path}/build-{n}/{name}" for n in numbers))


def pages(spark: SparkSession, path: str, key: str) -> DataFrame | None:
    """(key, content_hash, policy, n_chunks, build) of every document that is there now; None before the first build."""
    numbers = builds(spark, path)
    if not numbers:
        return None
    rows = _union(spark, path, "pages", numbers)
    last = rows.groupBy(key).agg(F.max_by(F.struct("content_hash", "policy", "gone", "n_chunks", "build"), "build").alias("_p"))
    return last.where("not _p.gone").select(key, "_p.content_hash", "_p.policy", "_p.n_chunks", "_p.build")


def current(spark: SparkSession, path: str, key: str) -> DataFrame:
    """The chunks of every document that is there now."""
    now = pages(spark, path, key)
    if now is None:
        raise ValueError(f"no build at {path}")
    chunks = _union(spark, path, "chunks", builds(spark, path))
    return chunks.join(now.select(key, "build"), [key, "build"], "left_semi").drop("build")


def refresh(docs: DataFrame, key: str, text: str, policy: Column, chunker: Callable[[DataFrame], DataFrame], path: str) -> int:
    """Brings the chunks at path up to docs; the number of rows written, 0 if nothing had changed.

    A document is fresh if its text (white space at its ends and characters without width apart) and its policy are those of its last
    build, and it has chunks or its text is blank. chunker turns rows (key, text, policy) into chunks with key, and is given the
    documents that are not fresh, nothing else. Documents that docs lacks are marked as gone. Keys should not be null and not repeat:
    rows without one are left out, and of rows that share one the one with the greatest hash stands for all.
    """
    spark = docs.sparkSession
    wanted = docs.where(F.col(key).isNotNull()).select(key, F.coalesce(F.col(text), F.lit("")).alias(text), policy.alias("policy")).withColumn("content_hash", chunk_hash(F.col(text)))
    wanted = wanted.groupBy(key).agg(F.max_by(F.struct("content_hash", text, "policy"), "content_hash").alias("_d")).select(key, "_d.content_hash", f"_d.{text}", "_d.policy")
    have = pages(spark, path, key)
    number = len(builds(spark, path)) + 1
    if have is None:
        stale, gone = wanted, wanted.where("false").select(key, "content_hash", "policy")
    else:
        blank = chunk_hash(F.lit(""))
        fresh = have.where((F.col("n_chunks") > 0) | (F.col("content_hash") == blank))
        same = (wanted[key] == fresh[key]) & (wanted["content_hash"] == fresh["content_hash"]) & wanted["policy"].eqNullSafe(fresh["policy"])
        stale = wanted.join(fresh, same, "left_anti")
        gone = have.join(wanted.select(key), key, "left_anti").select(key, "content_hash", "policy")
    folder = f"{path}/build-{number}"
    if have is not None and stale.select(key).unionByName(gone.select(key)).isEmpty():
        return 0
    stale.write.mode("overwrite").parquet(f"{folder}/stale")  # so that chunks and pages are of the same rows
    stale = spark.read.schema(stale.schema).parquet(f"{folder}/stale")
    chunker(stale.select(key, text, "policy")).withColumn("build", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/chunks")
    counts = spark.read.parquet(f"{folder}/chunks").groupBy(key).agg(F.count("*").alias("n_chunks"))
    named = stale.select(key, "content_hash", "policy", F.lit(False).alias("gone")).unionByName(gone.withColumn("gone", F.lit(True))).join(counts, key, "left")
    named = named.select(key, "content_hash", "policy", "gone", F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"), F.lit(number).alias("build"))
    named.write.mode("overwrite").parquet(f"{folder}/pages")
    store.remove(spark, f"{folder}/stale")
    return spark.read.parquet(f"{folder}/pages").count() + spark.read.parquet(f"{folder}/chunks").count()


def compacted(spark: SparkSession, path: str, key: str, to: str) -> None:
    """Writes what is current at path as the one build of a new table at to."""
    chunks = current(spark, path, key)
    chunks.withColumn("build", F.lit(1)).write.mode("overwrite").parquet(f"{to}/build-1/chunks")
    pages(spark, path, key).withColumn("build", F.lit(1)).withColumn("gone", F.lit(False)).write.mode("overwrite").parquet(f"{to}/build-1/pages")
