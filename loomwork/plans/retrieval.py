"""Search queries over documents and embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import retrieval as R
from .registry import query
from .search import document_index

TERMS = ["the", "ofthe", "tion", "der", "les"]


def _bm25_sql(terms: list[str]) -> str:
    tf = ", ".join(f"len(list_filter(w, lambda x: x = '{t}')) AS tf{i}" for i, t in enumerate(terms))
    df = ", ".join(f"count(*) FILTER (tf{i} > 0) AS df{i}" for i in range(len(terms)))
    score = " + ".join(f"ln(1 + (n - df{i} + 0.5) / (df{i} + 0.5)) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * length / mean))" for i in range(len(terms)))
    return f"""w AS (SELECT doc_id, source, regexp_extract_all(lower(text), '[a-zа-яё0-9]+') AS w FROM documents),
t AS (SELECT doc_id, source, len(w) AS length, {tf} FROM w), st AS (SELECT count(*) AS n, avg(length) AS mean, {df} FROM t),
hits AS (SELECT doc_id, source, {score} AS score FROM t, st WHERE {" OR ".join(f"tf{i} > 0" for i in range(len(terms)))})"""


@query(f"WITH {_bm25_sql(TERMS)} SELECT doc_id, round(score, 6) AS score FROM hits")
def bm25_scores(table):
    """Scores of all documents with a term of the query."""
    return R.bm25(table("documents"), "doc_id", "text", TERMS).withColumn("score", F.round("score", 6))


@query(f"WITH {_bm25_sql(TERMS)} SELECT doc_id, round(score, 6) AS score FROM hits ORDER BY round(score, 6) DESC, doc_id LIMIT 10")
def bm25_search(table):
    """The ten best documents, from the written index: only the terms' postings are read, and of these only blocks that may hold one."""
    return document_index(table).search(TERMS, 10).select(F.col("doc").alias("doc_id"), "score")


_KNN = """q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 0),
d AS (SELECT vec_id, label, 1 - round(list_cosine_similarity(embedding::DOUBLE[], q::DOUBLE[]), 9) AS dist FROM embeddings, q)"""


def _query_vector(table):
    return table("embeddings").where("vec_id = 0").select(F.col("embedding").alias("q")).limit(1)


@query(f"WITH {_KNN} SELECT vec_id, round(dist, 6) AS dist FROM (SELECT * FROM d ORDER BY dist, vec_id LIMIT 40) WHERE dist <= 0.9 ORDER BY dist, vec_id LIMIT 20")
def knn_cosine(table):
    e = table("embeddings")
    return R.nearest(e, "vec_id", "embedding", _query_vector(table), 20, 0.9).withColumn("dist", F.round("dist", 6))


@query(f"WITH {_KNN} SELECT label, count(*) AS n, round(min(dist), 6) AS nearest, round(avg(dist), 6) AS mean FROM d GROUP BY 1")
def distance_by_label(table):
    d = table("embeddings").crossJoin(F.broadcast(_query_vector(table))).select("label", R.cosine_distance(F.col("embedding"), F.col("q")).alias("d"))
    return d.groupBy("label").agg(F.count("*").alias("n"), F.round(F.min("d"), 6).alias("nearest"), F.round(F.avg("d"), 6).alias("mean"))


@query("""WITH w AS (SELECT doc_id, source, lower(substring(text, 1, 80)) AS head, lower(text) AS body FROM documents),
u AS (SELECT doc_id, source, 'head' AS field, (length(head) - length(replace(head, 'the', ''))) / 3.0 * 3 AS score FROM w UNION ALL SELECT doc_id, source, 'body', (length(body) - length(replace(body, 'the', ''))) / 3.0 FROM w)
SELECT doc_id, round(max(score), 6) AS score, arg_max(field, (score, field)) AS field FROM u GROUP BY 1""")
def field_max_union(table):
    """The best of two fields' scores."""
    def count(c):
        return (F.length(c) - F.length(F.replace(c, F.lit("the"), F.lit("")))) / 3.0

    d = table("documents").select("doc_id", F.lower(F.substring("text", 1, 80)).alias("head"), F.lower("text").alias("body"))
    u = d.select("doc_id", F.lit("head").alias("field"), (count(F.col("head")) * 3).alias("score")).unionByName(d.select("doc_id", F.lit("body").alias("field"), count(F.col("body")).alias("score")))
    return u.groupBy("doc_id").agg(F.round(F.max("score"), 6).alias("score"), F.max_by("field", F.struct("score", "field")).alias("field"))


_FUSED = f"""WITH {_bm25_sql(TERMS)}, s AS (SELECT doc_id, round(score, 6) AS score FROM hits),
a AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM s QUALIFY rank <= 100),
q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 0),
b AS (SELECT doc_id, row_number() OVER (ORDER BY 1 - round(list_cosine_similarity(embedding::DOUBLE[], q::DOUBLE[]), 9), doc_id) AS rank FROM documents JOIN embeddings ON doc_id = vec_id, q QUALIFY rank <= 100),
f AS (SELECT doc_id, round(sum(1.0 / (60 + rank)), 6) AS score, string_agg(origin, ',' ORDER BY origin) AS origins
      FROM (SELECT *, 'lexical' AS origin FROM a UNION ALL SELECT *, 'vector' FROM b) GROUP BY 1)"""


def _rankings(table):
    lexical = document_index(table).search(TERMS, 100).withColumnRenamed("doc", "doc_id")
    # A document's vector has its id; documents without one are found by words alone.
    vectors = table("documents").select("doc_id").join(table("embeddings"), F.col("doc_id") == F.col("vec_id")).crossJoin(F.broadcast(_query_vector(table)))
    near = vectors.select("doc_id", F.round(R.cosine_distance(F.col("embedding"), F.col("q")), 9).alias("dist"))
    return {"lexical": R.ranked(lexical, "doc_id", [F.desc("score"), F.col("doc_id")], 100), "vector": R.ranked(near, "doc_id", [F.col("dist"), F.col("doc_id")], 100)}


@query(_FUSED + " SELECT doc_id, score, origins FROM f")
def rrf_fusion(table):
    return R.reciprocal_rank_fusion(_rankings(table), "doc_id")


@query(_FUSED + """, g AS (SELECT f.doc_id, f.score, source, length(text) AS n, row_number() OVER (PARTITION BY sha256(text) ORDER BY f.score DESC, f.doc_id) AS c FROM f JOIN documents USING (doc_id)),
h AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, doc_id) AS k FROM g WHERE c = 1) SELECT doc_id, source, score FROM h WHERE k <= 2""")
def diversity_cap(table):
    """Two documents a source after repeated contents are gone."""
    fused = R.reciprocal_rank_fusion(_rankings(table), "doc_id").join(table("documents").select("doc_id", "source", "text"), "doc_id")
    return R.diversity_cap(fused, "source", F.col("text"), [F.desc("score"), F.col("doc_id")]).select("doc_id", "source", "score")


@query(_FUSED + """, p AS (SELECT doc_id, score, row_number() OVER o AS position, sum(length(text)) OVER (o ROWS UNBOUNDED PRECEDING) AS used FROM f JOIN documents USING (doc_id) WINDOW o AS (ORDER BY score DESC, doc_id))
SELECT doc_id, score, position, CAST(used AS BIGINT) AS used FROM p WHERE (used <= 60000 OR position = 1) AND position <= 6""")
def budget_pack(table):
    fused = R.reciprocal_rank_fusion(_rankings(table), "doc_id").join(table("documents").select("doc_id", F.length("text").alias("n")), "doc_id")
    return R.budget_pack(fused, [F.desc("score"), F.col("doc_id")], F.col("n"), 60_000, 6).select("doc_id", "score", F.col("position").cast("long").alias("position"), "used")


@query(_FUSED + """, d AS (SELECT f.*, source FROM f JOIN documents USING (doc_id)), best AS (SELECT source, max(score) AS best FROM d GROUP BY 1)
SELECT doc_id, source, score FROM d WHERE source IN (SELECT source FROM best WHERE best >= 0.55 * (SELECT max(best) FROM best))""")
def relevance_cut(table):
    fused = R.reciprocal_rank_fusion(_rankings(table), "doc_id").join(table("documents").select("doc_id", "source"), "doc_id")
    return R.relevance_cut(fused, "source", "score").select("doc_id", "source", "score")


@query(_FUSED + """, h AS (SELECT f.doc_id, f.score, lower(text) AS t, length(text) AS n, source FROM f JOIN documents USING (doc_id))
SELECT doc_id, round(score + 0.08 * least(4, CAST(contains(t, 'the') AS INT) + CAST(contains(t, 'ofthe') AS INT) + CAST(contains(t, 'tion') AS INT) + CAST(contains(t, 'der') AS INT) + CAST(contains(t, 'les') AS INT)) + CASE WHEN n > 5000 THEN 0.05 ELSE 0.12 END, 6) AS score FROM h""")
def rerank(table):
    fused = R.reciprocal_rank_fusion(_rankings(table), "doc_id").join(table("documents").select("doc_id", "text"), "doc_id")
    bonus = F.when(F.length("text") > 5000, 0.05).otherwise(0.12)
    return fused.select("doc_id", F.round(R.rerank_score(F.col("score"), F.col("text"), TERMS, bonus), 6).alias("score"))


@query(_FUSED + " SELECT doc_id, source, score, origins, sha256(substring(text, 1, 2600)) AS head_sha256 FROM f JOIN documents USING (doc_id) ORDER BY score DESC, doc_id LIMIT 10")
def hybrid_search(table):
    """The ten best documents by fused rankings; texts are joined to the ids that are left."""
    top = R.reciprocal_rank_fusion(_rankings(table), "doc_id").orderBy(F.desc("score"), "doc_id").limit(10)
    return top.join(table("documents"), "doc_id").select("doc_id", "source", "score", "origins", F.sha2(F.substring("text", 1, 2600), 256).alias("head_sha256"))


@query("""WITH q AS (SELECT embedding AS q, label AS ql FROM embeddings WHERE vec_id = 0), d AS (SELECT vec_id % 7 AS list, CAST(label = ql AS INT) AS rel, row_number() OVER (PARTITION BY vec_id % 7 ORDER BY 1 - list_cosine_similarity(embedding::DOUBLE[], q::DOUBLE[]), vec_id) AS rank FROM embeddings, q WHERE vec_id > 0),
i AS (SELECT list, rel, row_number() OVER (PARTITION BY list ORDER BY rel DESC, rank) AS i FROM d), dcg AS (SELECT list, max(CASE WHEN rel > 0 THEN 1.0 / rank ELSE 0 END) AS mrr, sum(rel) / 10.0 AS precision, sum((2 ** rel - 1) / log2(rank + 1)) AS dcg FROM d WHERE rank <= 10 GROUP BY 1),
ideal AS (SELECT list, sum((2 ** rel - 1) / log2(i + 1)) AS ideal FROM i WHERE i <= 10 GROUP BY 1)
SELECT list, round(mrr, 6) AS mrr, round(precision, 6) AS precision, round(CASE WHEN ideal > 0 THEN dcg / ideal ELSE 0 END, 6) AS ndcg FROM dcg JOIN ideal USING (list)""")
def quality_metrics(table):
    """MRR, precision and NDCG at 10 of seven ranked lists; a vector is relevant if it has the query's label."""
    q = F.broadcast(table("embeddings").where("vec_id = 0").select(F.col("embedding").alias("q"), F.col("label").alias("ql")).limit(1))
    d = table("embeddings").where("vec_id > 0").crossJoin(q).select((F.col("vec_id") % 7).alias("list"), "vec_id", (F.col("label") == F.col("ql")).cast("int").alias("rel"), R.cosine_distance(F.col("embedding"), F.col("q")).alias("dist"))
    m = R.ranking_metrics(d, "list", [F.col("dist"), F.col("vec_id")], "rel", 10)
    return m.select("list", *(F.round(c, 6).alias(c) for c in ("mrr", "precision", "ndcg")))


@query("""SELECT label, count(*) AS n, count(*) FILTER (len(embedding) = 64 AND NOT list_contains(list_transform(embedding, lambda x: isnan(x)), true)) AS valid FROM embeddings GROUP BY 1""")
def embedding_validation(table):
    valid = (F.size("embedding") == 64) & F.forall("embedding", lambda x: ~F.isnan(x))
    return table("embeddings").groupBy("label").agg(F.count("*").alias("n"), F.count(F.when(valid, 1)).alias("valid"))


@query(r"""WITH h AS (SELECT sha256(trim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) AS h, doc_id FROM documents) SELECT h AS input, min(doc_id) AS first_doc, count(*) AS n_docs FROM h GROUP BY 1""")
def embedding_inputs(table):
    """One input for all documents of equal text: what a batch embedder has to compute, and for how many."""
    return table("documents").groupBy(T.chunk_hash(F.col("text")).alias("input")).agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("n_docs"))
