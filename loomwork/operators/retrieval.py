"""Ranked retrieval: BM25, nearest vectors, fusion, reranking, diversity and budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def postings(docs: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field, term, tf, length) of every term of every field. Worth writing, by term, for many queries."""
    parts = []
    for f in fields:
        words = docs.select(key, T.normalized_words(F.col(f)).alias("w"))
        parts.append(words.select(key, F.lit(f).alias("field"), F.size("w").alias("length"), F.explode("w").alias("term")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy(key, "field", "length", "term").agg(F.count("*").alias("tf"))


def _equals(term: str):
    return lambda x: x == term


def bm25(docs: DataFrame, key: str, field: str, terms: list[str], k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(key, score) of the documents with any of terms: idf = ln(1 + (N - df + 0.5) / (df + 0.5)).

    Only the query's terms leave the scan: a document is tokenised, counted and filtered in its row, without a shuffle of
    the corpus; document frequencies and the mean length are one row.
    """
    terms = list(dict.fromkeys(terms))
    words = docs.select(key, T.normalized_words(F.col(field)).alias("w"))
    tf = words.select(key, F.size("w").alias("length"), F.array(*(F.size(F.filter("w", _equals(t))) for t in terms)).alias("tf"))
    stats = F.broadcast(tf.agg(F.count("*").alias("n"), F.avg("length").alias("mean"), *(F.count(F.when(F.col("tf")[i] > 0, 1)).alias(f"df{i}") for i in range(len(terms)))))
    # A generator, not a filter: a filter would be pushed below the counts, and every text tokenised again for each term.
    row = F.struct("length", *(F.col("tf")[i].alias(f"tf{i}") for i in range(len(terms))))
    hit = tf.select(key, F.inline(F.when(F.exists("tf", lambda n: n > 0), F.array(row)).otherwise(F.array().cast(f"array<struct<length:int,{','.join(f'tf{i}:int' for i in range(len(terms)))}>>")))).crossJoin(stats)
    score: Column = F.lit(0.0)
    for i in range(len(terms)):
        n, df = F.col(f"tf{i}").cast("double"), F.col(f"df{i}")
        idf = F.log(1 + (F.col("n") - df + 0.5) / (df + 0.5))
        score = score + idf * n * (k1 + 1) / (n + k1 * (1 - b + b * F.col("length") / F.col("mean")))
    return hit.select(key, score.alias("score"))


def cosine_distance(left: Column, right: Column) -> Column:
    """1 - cosine, in double precision; 1 where a vector is zero."""
    dot = lambda a, c: F.aggregate(F.zip_with(a, c, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = F.sqrt(dot(left, left)) * F.sqrt(dot(right, right))
    return 1 - F.when(norm == 0, 0.0).otherwise(dot(left, right) / norm)


def nearest(vectors: DataFrame, key: str, vector: str, query: DataFrame, k: int, most_distance: float) -> DataFrame:
    """(key, dist): the k nearest of vectors to the one row (q) of query, after a cut at most_distance. A scan and a top-k."""
    scored = vectors.crossJoin(F.broadcast(query)).select(key, cosine_distance(F.col(vector), F.col("q")).alias("dist"))
    return scored.orderBy("dist", key).limit(2 * k).where(F.col("dist") <= most_distance).orderBy("dist", key).limit(k)


def ranked(df: DataFrame, key: str, order: list[Column], limit: int) -> DataFrame:
    """(key, rank) of the first limit rows. Ranks are given to the rows that the top-k kept."""
    return df.orderBy(*order).limit(limit).withColumn("rank", F.row_number().over(Window.orderBy(*order))).select(key, "rank")


def reciprocal_rank_fusion(rankings: dict[str, DataFrame], key: str, k: int = 60) -> DataFrame:
    """(key, score, origins) from rankings (key, rank), which are top-k lists."""
    parts = [df.select(key, "rank", F.lit(name).alias("origin")) for name, df in rankings.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy(key).agg(F.round(F.sum(1 / (k + F.col("rank"))), 6).alias("score"), F.array_join(F.array_sort(F.collect_set("origin")), ",").alias("origins"))


def diversity_cap(hits: DataFrame, group: str, content: Column, order: list[Column], cap: int = 2) -> DataFrame:
    """hits without repeated content, at most cap of each group; only rows that survive the first count for the second."""
    first = hits.withColumn("_c", F.sha2(content, 256)).withColumn("_n", F.row_number().over(Window.partitionBy("_c").orderBy(*order))).where("_n = 1")
    return first.withColumn("_n", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("_n") <= cap).drop("_c", "_n")


def budget_pack(hits: DataFrame, order: list[Column], size: Column, budget: int, most: int) -> DataFrame:
    """The first rows whose sizes fit in budget together, most at the most; the first always does. hits is a top-k list."""
    seq = Window.orderBy(*order)
    placed = hits.withColumn("position", F.row_number().over(seq)).withColumn("used", F.sum(size).over(seq.rowsBetween(Window.unboundedPreceding, 0)))
    return placed.where(((F.col("used") <= budget) | (F.col("position") == 1)) & (F.col("position") <= most))


def relevance_cut(hits: DataFrame, group: str, score: str, share: float = 0.55) -> DataFrame:
    """Rows of the groups whose best score is at least share of the best of all; all rows if that is not positive."""
    best = hits.groupBy(group).agg(F.max(score).alias("_best"))
    top = F.broadcast(best.agg(F.max("_best").alias("_top")))
    keep = best.crossJoin(top).where((F.col("_top") <= 0) | (F.col("_best") >= share * F.col("_top"))).select(group)
    return hits.join(keep, group, "left_semi")


def rerank_score(base: Column, text: Column, terms: list[str], kind_bonus: Column) -> Column:
    """base, plus 0.08 for each of the first four query terms in the text, plus the bonus of its kind."""
    low = F.lower(text)
    overlap = sum((low.contains(t).cast("int") for t in terms), F.lit(0))
    return base + 0.08 * F.least(overlap, F.lit(4)) + kind_bonus


def ranking_metrics(hits: DataFrame, by: str, order: list[Column], relevant: str, k: int) -> DataFrame:
    """(by, mrr, precision, ndcg) at k of lists with graded relevance, ranked by order. Both rankings keep k rows of a list in each task before
    they are shuffled; whole lists are never ranked."""
    gain = lambda rank: (F.pow(F.lit(2.0), F.col(relevant)) - 1) / F.log2(F.col(rank) + 1.0)
    first = lambda name, *by_: hits.withColumn(name, F.row_number().over(Window.partitionBy(by).orderBy(*by_))).where(F.col(name) <= k)
    ideal = first("_i", F.desc(relevant), *order).groupBy(by).agg(F.sum(gain("_i")).alias("_ideal"))
    got = first("_r", *order).groupBy(by).agg(F.coalesce(F.max(F.when(F.col(relevant) > 0, 1 / F.col("_r"))), F.lit(0.0)).alias("mrr"), (F.sum((F.col(relevant) > 0).cast("int")) / k).alias("precision"), F.sum(gain("_r")).alias("_dcg"))
    return got.join(ideal, by).select(by, "mrr", "precision", F.when(F.col("_ideal") > 0, F.col("_dcg") / F.col("_ideal")).otherwise(0.0).alias("ndcg"))
