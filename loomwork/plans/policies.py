"""Queries that classify rows, search histories and follow links."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import url as U
from ..operators import hygiene
from ..operators import pages as P
from ..operators import policy
from .registry import query


@query("""SELECT page_id, CASE WHEN url IS NULL THEN 'no_url' WHEN url LIKE '%/login%' THEN 'auth' WHEN length(html) > 5000 THEN 'too_big' WHEN regexp_extract(html, '<title>([^<]*)</title>', 1) = '' THEN 'no_title'
WHEN len(regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1)) >= 12 THEN 'hub' WHEN length(html) < 1200 THEN 'low_content' ELSE 'ready' END AS status FROM pages""")
def page_status(table):
    """The first of an ordered chain of conditions."""
    html = F.col("html")
    rules = [
        (F.col("url").isNull(), "no_url"), (F.col("url").contains("/login"), "auth"), (F.length(html) > 5000, "too_big"), (F.regexp_extract(html, "<title>([^<]*)</title>", 1) == "", "no_title"),
        (F.size(U.links(html)) >= 12, "hub"), (F.length(html) < 1200, "low_content"),
    ]
    return table("pages").select("page_id", policy.first_match(rules, "ready").alias("status"))


@query(r"""SELECT doc_id, CASE WHEN len(regexp_extract_all(text, '\|')) >= 10 THEN 'table_dump' WHEN length(text) > 20000 THEN 'too_big' WHEN trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) = '' THEN 'empty' END AS reason FROM documents
WHERE len(regexp_extract_all(text, '\|')) >= 10 OR length(text) > 20000 OR trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) = ''""")
def metadata_only(table):
    """Documents that are indexed by their metadata alone, and why."""
    text = F.col("text")
    rules = [(F.regexp_count(text, F.lit(r"\|")) >= 10, "table_dump"), (F.length(text) > 20_000, "too_big"), (F.btrim(text, F.lit(T.WHITE)) == "", "empty")]
    return table("documents").select("doc_id", policy.first_match(rules).alias("reason")).where("reason is not null")


@query("""WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-zа-яё0-9]+') AS w FROM documents), g AS (SELECT doc_id, unnest([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)]) AS shingle FROM w WHERE len(w) >= 3)
SELECT shingle, count(DISTINCT doc_id) AS doc_count, count(*) AS total_count FROM g GROUP BY 1""")
def corpus_shingle_frequency(table):
    """Documents and places of each word trigram, counted in each task by blocks of documents first, and shuffled once."""
    counts = hygiene.trigram_counts(table("documents"), None, "doc_id", "text")
    return counts.select(F.col("trigram").alias("shingle"), F.col("n_docs").alias("doc_count"), F.col("n").alias("total_count"))


@query("""SELECT c_custkey, c_mktsegment, o_orderkey, o_totalprice FROM customer LEFT JOIN LATERAL (SELECT * FROM orders WHERE o_custkey = c_custkey AND o_orderstatus <> 'P' ORDER BY o_totalprice DESC, o_orderkey LIMIT 1) ON true""")
def best_order_of_customer(table):
    """A lateral top-1 as a join and a window."""
    orders = table("orders").where("o_orderstatus <> 'P'").select("o_custkey", "o_orderkey", "o_totalprice")
    best = policy.best_match(table("customer"), orders, F.col("o_custkey") == F.col("c_custkey"), ["c_custkey"], [F.desc_nulls_last("o_totalprice"), F.col("o_orderkey")])
    return best.select("c_custkey", "c_mktsegment", "o_orderkey", "o_totalprice")


@query("""SELECT conv_id, min(turn) AS first_turn, count(*) AS hits FROM conversations WHERE role = 'user' AND contains(lower(text), 'the') AND contains(lower(text), 'tion') GROUP BY 1""")
def history_search(table):
    """Conversations with a question that holds all terms."""
    text = F.lower("text")
    return table("conversations").where((F.col("role") == "user") & text.contains("the") & text.contains("tion")).groupBy("conv_id").agg(F.min("turn").alias("first_turn"), F.count("*").alias("hits"))


@query("""WITH l AS (SELECT DISTINCT rtrim(lower(coalesce(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]*)', 1), '')), '.') AS host, unnest(regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1)) AS href FROM pages)
SELECT host, count(*) AS edges, count(*) FILTER (NOT starts_with(href, '/') AND NOT starts_with(href, '#')) AS external FROM l GROUP BY 1""")
def link_graph(table):
    """Distinct edges of each host, and those that leave it."""
    edges = P.link_edges(table("pages")).select("host", "href").distinct()
    leaves = ~F.col("href").startswith("/") & ~F.col("href").startswith("#")
    return edges.groupBy("host").agg(F.count("*").alias("edges"), F.count(F.when(leaves, 1)).alias("external"))


@query("""SELECT page_id, url FROM pages WHERE regexp_matches(url, '/(en|de)/[0-9]+') OR regexp_matches(url, '^https://m[.]')""")
def allowed_urls(table):
    """Pages that a user's patterns allow; the unsafe one is dropped, not obeyed."""
    return table("pages").select("page_id", "url").where(policy.allowed(F.col("url"), ["/(en|de)/[0-9]+", "^(a+)+$", "^https://m[.]"]))


@query("""WITH h AS (SELECT date_trunc('hour', ts)::TIMESTAMP AS hour, event_type, count(*) AS n FROM events GROUP BY 1, 2), f AS (SELECT *, CASE WHEN lag(hour) OVER w + INTERVAL 1 HOUR = hour THEN 0 ELSE 1 END AS new FROM h WHERE n >= 3 WINDOW w AS (PARTITION BY event_type ORDER BY hour)),
k AS (SELECT *, sum(new) OVER (PARTITION BY event_type ORDER BY hour ROWS UNBOUNDED PRECEDING) AS k FROM f) SELECT event_type, min(hour) AS run_start, max(hour) AS run_end, count(*) AS n FROM k GROUP BY event_type, k HAVING count(*) >= 2""")
def alert_runs(table):
    """Alerts that last: at least two hours in a row with three events or more."""
    h = table("events").groupBy(F.date_trunc("hour", "ts").alias("hour"), "event_type").agg(F.count("*").alias("n_events"))
    return policy.firing_runs(h, ["event_type"], "hour", "n_events >= 3", "1 hour", 2)


@query("""WITH q AS (SELECT conv_id, turn, sha256(trim(regexp_replace(lower(text), '[ \\t\\n\\v\\f\\r]+', ' ', 'g'))) AS key, length(text) AS n FROM conversations WHERE role = 'user')
SELECT key, count(*) - 1 AS observed_again, CAST(sum(n) - arg_min(n, (conv_id, turn)) AS BIGINT) AS saved_chars FROM q GROUP BY 1 HAVING count(*) > 1""")
def repeated_questions(table):
    """Questions that a cache of answers would have served, and what that saves."""
    q = table("conversations").where("role = 'user'").select("conv_id", "turn", F.sha2(T.cache_question(F.col("text")), 256).alias("key"), F.length("text").alias("n"))
    return q.groupBy("key").agg((F.count("*") - 1).alias("observed_again"), (F.sum("n") - F.min_by("n", F.struct("conv_id", "turn"))).alias("saved_chars")).where("observed_again > 0")


@query("""SELECT doc_id, substring(text, 1, 20) AS head, CASE WHEN length(text) <= 150 THEN text ELSE substring(text, 1, 150) || '...' END AS preview, CAST(strlen(text) AS BIGINT) AS bytes, substring(text, 5001) = '' AS shown_whole FROM documents""")
def document_previews(table):
    t = F.col("text")
    return table("documents").select("doc_id", F.substring(t, 1, 20).alias("head"), T.preview(t).alias("preview"), F.octet_length(t).cast("long").alias("bytes"), (F.length(t) <= 5000).alias("shown_whole"))
