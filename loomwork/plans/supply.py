"""Retrieval in its parts: what may be shown, vectors, words on pages and chunks, and what is covered."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import retrieval as R
from .registry import query
from .retrieval import TERMS, _query_vector

#: Documents that may be shown: not a copy, with a vector, and of an allowed source.
_VISIBLE = """v AS (SELECT d.doc_id, d.source, d.text, e.embedding FROM documents d JOIN embeddings e ON e.vec_id = d.doc_id
WHERE d.doc_id IN (SELECT min(doc_id) FROM documents GROUP BY sha256(text)) AND d.source IN (SELECT source FROM documents GROUP BY source HAVING count(*) > 1))"""


def _visible(table):
    docs = table("documents")
    first = docs.groupBy(F.sha2("text", 256).alias("h")).agg(F.min("doc_id").alias("doc_id")).select("doc_id")
    allowed = docs.groupBy("source").agg(F.count("*").alias("n")).where("n > 1").select("source")
    seen = docs.select("doc_id", "source", "text").join(first, "doc_id", "left_semi").join(allowed, "source", "left_semi")
    return seen.join(table("embeddings").select(F.col("vec_id").alias("doc_id"), "embedding"), "doc_id")


@query(f"WITH {_VISIBLE} SELECT source, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM v GROUP BY 1")
def visible_documents(table):
    return _visible(table).groupBy("source").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


@query(f"""WITH {_VISIBLE}, q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 0), d AS (SELECT doc_id, source, 1 - round(list_cosine_similarity(embedding::DOUBLE[], q::DOUBLE[]), 9) AS dist FROM v, q)
SELECT doc_id, source, round(dist, 6) AS dist, row_number() OVER (ORDER BY dist, doc_id) AS rank FROM (SELECT * FROM d ORDER BY dist, doc_id LIMIT 40) WHERE dist <= 0.9 QUALIFY rank <= 20""")
def vector_supply(table):
    """The nearest of what may be shown: twice as many candidates as wanted, then a cut by distance."""
    d = _visible(table).crossJoin(F.broadcast(_query_vector(table))).select("doc_id", "source", F.round(R.cosine_distance(F.col("embedding"), F.col("q")), 9).alias("dist"))
    top = d.orderBy("dist", "doc_id").limit(40).where("dist <= 0.9")
    rank = F.row_number().over(Window.orderBy("dist", "doc_id"))
    return top.select("doc_id", "source", F.round("dist", 6).alias("dist"), rank.cast("long").alias("rank")).where("rank <= 20")


_MATCH = " + ".join(f"CAST(contains(low, '{t}') AS INT) * {i + 1}" for i, t in enumerate(TERMS))
_LEXICAL = f"""c AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS chunk FROM documents),
s AS (SELECT doc_id, source, chunk, {_MATCH} AS score FROM (SELECT *, lower(line) AS low FROM c) WHERE {_MATCH} > 0),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, chunk) AS place FROM s),
p AS (SELECT doc_id, {_MATCH} AS page_score FROM (SELECT doc_id, lower(text) AS low FROM documents)),
t AS (SELECT doc_id, k.source, chunk, round(score + 0.35 * page_score, 6) AS score FROM k JOIN p USING (doc_id) WHERE place <= 3)"""


def _matches(text):
    low = F.lower(text)
    return sum((F.contains(low, F.lit(t)).cast("int") * (i + 1) for i, t in enumerate(TERMS)), F.lit(0))


def _lexical(table):
    """(doc_id, source, chunk, score): the three best chunks of each page, chunk score + 0.35 * page score. Chunks are scored where
    they are read; only those that match are shuffled."""
    lines = table("documents").select("doc_id", "source", F.posexplode(F.split("text", "\n")).alias("pos", "line"), _matches(F.col("text")).alias("page"))
    hits = lines.select("doc_id", "source", (F.col("pos") + 1).cast("long").alias("chunk"), _matches(F.col("line")).alias("score"), "page").where("score > 0")
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("score"), "chunk"))
    return hits.withColumn("place", place).where("place <= 3").select("doc_id", "source", "chunk", F.round(F.col("score") + 0.35 * F.col("page"), 6).alias("score"))


@query(f"WITH {_LEXICAL} SELECT doc_id, source, chunk, CAST(score AS DOUBLE) AS score FROM t")
def lexical_supply(table):
    return _lexical(table)


@query(f"""WITH {_LEXICAL}, {_VISIBLE}, q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 0),
a AS (SELECT doc_id, chunk, row_number() OVER (ORDER BY score DESC, doc_id DESC, chunk) AS rank FROM t QUALIFY rank <= 100),
b AS (SELECT doc_id, 1 AS chunk, row_number() OVER (ORDER BY 1 - round(list_cosine_similarity(embedding::DOUBLE[], q::DOUBLE[]), 9), doc_id) AS rank FROM v, q QUALIFY rank <= 100),
f AS (SELECT doc_id, chunk, round(sum(1.0 / (60 + rank)), 6) AS score, string_agg(origin, ',' ORDER BY origin) AS origins FROM (SELECT *, 'fulltext' AS origin FROM a UNION ALL SELECT *, 'vector' FROM b) GROUP BY 1, 2),
g AS (SELECT f.*, source, row_number() OVER (PARTITION BY source ORDER BY f.score DESC, f.doc_id, f.chunk) AS place FROM f JOIN documents USING (doc_id)),
h AS (SELECT *, max(score) OVER (PARTITION BY source) AS best, max(score) OVER () AS top FROM g WHERE place <= 2)
SELECT doc_id, chunk, source, CAST(score AS DOUBLE) AS score, origins, row_number() OVER (ORDER BY score DESC, doc_id, chunk) AS rank FROM h WHERE best >= 0.55 * top""")
def hybrid_chunks(table):
    """Chunks by words and by vectors, fused by rank; two a source, and sources far below the best go."""
    words = _lexical(table).orderBy(F.desc("score"), F.desc("doc_id"), "chunk").limit(100)
    words = words.select("doc_id", "chunk", F.row_number().over(Window.orderBy(F.desc("score"), F.desc("doc_id"), "chunk")).alias("rank"), F.lit("fulltext").alias("origin"))
    near = _visible(table).crossJoin(F.broadcast(_query_vector(table))).select("doc_id", F.round(R.cosine_distance(F.col("embedding"), F.col("q")), 9).alias("dist")).orderBy("dist", "doc_id").limit(100)
    near = near.select("doc_id", F.lit(1).cast("long").alias("chunk"), F.row_number().over(Window.orderBy("dist", "doc_id")).alias("rank"), F.lit("vector").alias("origin"))
    fused = words.unionByName(near).groupBy("doc_id", "chunk").agg(F.round(F.sum(1 / (60 + F.col("rank"))), 6).alias("score"), F.array_join(F.array_sort(F.collect_set("origin")), ",").alias("origins"))
    # At most 200 rows from here on.
    held = F.broadcast(fused).join(table("documents").select("doc_id", "source"), "doc_id")
    place = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("score"), "doc_id", "chunk"))
    kept = R.relevance_cut(held.withColumn("place", place).where("place <= 2").drop("place"), "source", "score")
    return kept.select("doc_id", "chunk", "source", "score", "origins", F.row_number().over(Window.orderBy(F.desc("score"), "doc_id", "chunk")).cast("long").alias("rank"))


@query(f"""WITH {_LEXICAL} SELECT source, count(*) AS snippets, count(DISTINCT doc_id) AS docs, count(DISTINCT doc_id) >= 2 AS covered, CASE WHEN count(*) < 2 THEN 'too_few_snippets' WHEN count(DISTINCT doc_id) < 2 THEN 'one_source' WHEN max(score) < 3 THEN 'weak' ELSE 'ok' END AS reason FROM t GROUP BY 1""")
def coverage(table):
    """How well each source covers the question, and the first rule that says otherwise."""
    docs = F.count_distinct("doc_id")
    reason = F.when(F.count("*") < 2, "too_few_snippets").when(docs < 2, "one_source").when(F.max("score") < 3, "weak").otherwise("ok")
    return _lexical(table).groupBy("source").agg(F.count("*").alias("snippets"), docs.alias("docs"), (docs >= 2).alias("covered"), reason.alias("reason"))


@query("""WITH h AS (SELECT sha256(text) AS h, doc_id, text FROM documents), r AS (SELECT h, min(doc_id) AS canonical FROM h JOIN embeddings ON vec_id = doc_id GROUP BY 1)
SELECT h.doc_id, canonical FROM h JOIN r USING (h) LEFT JOIN embeddings e ON e.vec_id = h.doc_id WHERE e.vec_id IS NULL""")
def reused_vectors(table):
    """Documents without a vector whose text another one has a vector for: the least such id."""
    h = table("documents").select("doc_id", F.sha2("text", 256).alias("h"))
    ids = table("embeddings").select(F.col("vec_id").alias("doc_id"))
    have = h.join(ids, "doc_id", "left_semi").groupBy("h").agg(F.min("doc_id").alias("canonical"))
    return h.join(ids, "doc_id", "left_anti").join(have, "h").select("doc_id", "canonical")


@query("""WITH h AS (SELECT sha256(text) AS h, doc_id FROM documents), d AS (SELECT min(doc_id) AS gone FROM h GROUP BY h HAVING count(*) > 1), l AS (SELECT * FROM h WHERE doc_id NOT IN (SELECT gone FROM d)) SELECT min(doc_id) AS promoted, count(*) AS n FROM l GROUP BY h HAVING count(*) >= 1 AND h IN (SELECT h FROM h GROUP BY h HAVING count(*) > 1)""")
def promoted_duplicates(table):
    """When the first of equal documents is deleted, the next one stands for the others."""
    h = table("documents").select("doc_id", F.sha2("text", 256).alias("h"))
    gone = h.groupBy("h").agg(F.min("doc_id").alias("gone"), F.count("*").alias("of")).where("of > 1")
    return h.join(gone, "h").where("doc_id <> gone").groupBy("h").agg(F.min("doc_id").alias("promoted"), F.count("*").alias("n")).drop("h")
