"""Ranked search over written indexes of documents and pages, and what questions ask for."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import questions as Q
from ..functions import url as U
from ..operators.search_index import WEIGHTS, Field, SearchIndex, field, index_of
from .registry import query

BODY = [Field("text", 1.0, 0.75)]
FIELDS = {"title": "title", "slug": "slug", "heading": "header", "body": "body"}


def document_index(table) -> SearchIndex:
    """The index of the whole texts of documents, one field of weight 1: plain BM25."""
    return index_of(table("documents"), table("documents").select("doc_id", "text"), "doc_id", BODY, "documents")


def page_fields(pages: DataFrame) -> DataFrame:
    """(page_id, title, slug, heading, body): the fields of a page; body is all text outside of head, scripts and styles."""
    html = F.coalesce(F.col("html"), F.lit(""))
    body = F.regexp_replace(F.regexp_replace(html, "(?s)<head>.*?</head>|<script>.*?</script>|<style>.*?</style>|<!--.*?-->", " "), "<[^>]*>", " ")
    return pages.select("page_id", F.regexp_extract(html, "<title>([^<]*)</title>", 1).alias("title"), U.slug(F.col("url")).alias("slug"), F.regexp_extract(html, "<h1>([^<]*)</h1>", 1).alias("heading"), body.alias("body"))


def page_index(table) -> SearchIndex:
    return index_of(table("pages"), page_fields(table("pages")), "page_id", [field(name, kind) for name, kind in FIELDS.items()], "pages")


_PAGE_FIELDS = r"""p AS (SELECT page_id, regexp_extract(coalesce(html, ''), '<title>([^<]*)</title>', 1) AS title,
  trim(regexp_replace(lower(concat_ws(' ', rtrim(lower(coalesce(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]*)', 1), '')), '.'), coalesce(regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1), ''), coalesce(regexp_extract(url, '^[^?#]*[?]([^#]*)', 1), ''))), '[^a-z0-9]+', ' ', 'g'), ' ') AS slug,
  regexp_extract(coalesce(html, ''), '<h1>([^<]*)</h1>', 1) AS heading,
  regexp_replace(regexp_replace(coalesce(html, ''), '(?s)<head>.*?</head>|<script>.*?</script>|<style>.*?</style>|<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g') AS body FROM pages),
a AS (SELECT page_id, regexp_extract_all(lower(title), '[a-zа-яё0-9]+') AS title, flatten(list_transform([3, 4, 5], lambda n: list_transform(range(1, length(slug) - n + 2), lambda i: '~' || substring(slug, i, n)))) AS slug,
  regexp_extract_all(lower(heading), '[a-zа-яё0-9]+') AS heading, regexp_extract_all(lower(body), '[a-zа-яё0-9]+') AS body FROM p)"""


def _means() -> str:
    return ", ".join(f"avg(len({name})) AS mean_{name}" for name in FIELDS)


@query(f"""WITH {_PAGE_FIELDS}, t AS ({" UNION ALL ".join(f"SELECT page_id, '{name}' AS field, unnest({name}) AS term FROM a" for name in FIELDS)})
SELECT term, count(DISTINCT page_id) AS pages, {", ".join(f"count(*) FILTER (field = '{name}') AS in_{name}" for name in FIELDS)} FROM t GROUP BY 1""")
def page_index_terms(table):
    """Every term of the index of pages: how many pages hold it, and how often each field does."""
    index = page_index(table)
    sums = [F.sum(F.col("tf")[i]).alias(f"in_{f.name}") for i, f in enumerate(index.fields)]
    return index.postings().groupBy("term").agg(F.count("*").alias("pages"), *sums)


PAGE_QUERY = "example the tion und"
_PAGE_TERMS = [*PAGE_QUERY.split(), *(f"~{PAGE_QUERY[i : i + n]}" for n in (3, 4, 5) for i in range(len(PAGE_QUERY) - n + 1))]
_PARTS = " + ".join(f"coalesce({WEIGHTS[kind][0]} * count(*) FILTER (field = '{name}') / (1 - {WEIGHTS[kind][1]} + {WEIGHTS[kind][1]} * any_value(len_{name}) / nullif(any_value(mean_{name}), 0)), 0)" for name, kind in FIELDS.items())


@query(f"""WITH {_PAGE_FIELDS}, st AS (SELECT count(*) AS n, {_means()} FROM a), q AS (SELECT DISTINCT unnest({_PAGE_TERMS!r}) AS term),
t AS ({" UNION ALL ".join(f"SELECT page_id, '{name}' AS field, unnest({name}) AS term, {', '.join(f'len({m}) AS len_{m}' for m in FIELDS)} FROM a" for name in FIELDS)}),
f AS (SELECT page_id, term, any_value(n) AS n, {_PARTS} AS f FROM t JOIN q USING (term), st GROUP BY 1, 2),
d AS (SELECT term, count(*) AS df FROM f GROUP BY 1)
SELECT page_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * 2.2 * f / (1.2 + f)), 6) AS score FROM f JOIN d USING (term) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""")
def bm25f_pages(table):
    """The ten best pages for a query in title, url, heading and body: BM25F with its usual weights, from the index."""
    index = page_index(table)
    return index.search(index.analyzed(PAGE_QUERY)).withColumnRenamed("doc", "page_id")


_STOP = ", ".join(f"'{w}'" for w in Q.STOP)
_CONTENT = r"regexp_full_match({0}, '[\p{{L}}\p{{N}}]{{2,}}') AND NOT list_contains([" + _STOP + "], {0})"
_TERMS = rf"""q AS (SELECT conv_id, turn, coalesce(text, '') AS t, list_transform(regexp_extract_all(coalesce(text, ''), '[\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}\s]+'), lambda x: lower(x)) AS w,
  regexp_extract_all(coalesce(text, ''), '"([^"]+)"', 1) AS quoted, regexp_extract_all(coalesce(text, ''), '[\p{{Ll}}\p{{N}},;] (\p{{Lu}}[\p{{L}}\p{{N}}]*(?: \p{{Lu}}[\p{{L}}\p{{N}}]*)*)', 1) AS names FROM conversations WHERE role = 'user'),
i AS (SELECT conv_id, turn, lower(trim(x, chr(32) || chr(9) || chr(10) || chr(13))) AS term, weight, place FROM (
  SELECT conv_id, turn, quoted[k] AS x, 10.0 AS weight, k AS place FROM (SELECT *, unnest(range(1, len(quoted) + 1)) AS k FROM q) UNION ALL
  SELECT conv_id, turn, names[k], 8.0, 1000000000 + k FROM (SELECT *, unnest(range(1, len(names) + 1)) AS k FROM q) UNION ALL
  SELECT conv_id, turn, w[k] || ' ' || w[k + 1], 5.0, 2000000000 + k FROM (SELECT *, unnest(range(1, len(w))) AS k FROM q) WHERE {_CONTENT.format("w[k]")} AND {_CONTENT.format("w[k + 1]")} UNION ALL
  SELECT conv_id, turn, w[k], 2.0, 3000000000 + k FROM (SELECT *, unnest(range(1, len(w) + 1)) AS k FROM q) WHERE {_CONTENT.format("w[k]")})),
s AS (SELECT conv_id, turn, term, sum(weight) AS weight, min(place) AS place FROM i WHERE length(term) >= 2 AND NOT list_contains([{_STOP}], term) GROUP BY 1, 2, 3),
b AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY weight DESC, place) AS n FROM s QUALIFY n <= 8),
terms AS (SELECT conv_id, turn, string_agg(term, ' | ' ORDER BY n) AS terms, CAST(sum(weight) AS DOUBLE) AS weight FROM b GROUP BY 1, 2)"""
_MODES = ", ".join(f"({' OR '.join(f'''contains(lower(t), '{p}')''' for p in parts)}) AS {mode}" for mode, parts in Q.MODES.items())


def _user_turns(table) -> DataFrame:
    return table("conversations").where("role = 'user'").select("conv_id", "turn", "text")


@query(f"WITH {_TERMS} SELECT conv_id, turn, coalesce(terms, '') AS terms, coalesce(weight, 0) AS weight, {_MODES} FROM q LEFT JOIN terms USING (conv_id, turn)")
def question_profiles(table):
    """Terms, their weight together and the kinds of answer of every question of a user."""
    turns = _user_turns(table)
    found = Q.question_terms(turns, ["conv_id", "turn"], "text")
    asked = turns.select("conv_id", "turn", *(c.alias(m) for m, c in Q.modes(F.col("text")).items()))
    return asked.join(found, ["conv_id", "turn"]).select("conv_id", "turn", F.array_join("terms", " | ").alias("terms"), F.aggregate("weights", F.lit(0.0), lambda s, x: s + x).alias("weight"), *Q.MODES)


@query(rf"""WITH {_TERMS}, first AS (SELECT conv_id, turn FROM q ORDER BY conv_id, turn LIMIT 1),
v AS (SELECT v AS term, max(weight) / 10 AS w FROM (SELECT unnest(regexp_extract_all(lower(term), '[a-zа-яё0-9]+')) AS v, weight FROM b JOIN first USING (conv_id, turn)) GROUP BY 1),
words AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-zа-яё0-9]+') AS w FROM documents), st AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM words),
tf AS (SELECT doc_id, term, count(*) AS tf, any_value(length) AS length, any_value(v.w) AS w FROM (SELECT doc_id, len(w) AS length, unnest(w) AS term FROM words) JOIN v USING (term) GROUP BY 1, 2),
d AS (SELECT term, count(*) AS df FROM tf GROUP BY 1)
SELECT doc_id, round(sum(w * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))), 6) AS score FROM tf JOIN d USING (term), st GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""")
def question_search(table):
    """The ten best documents for the first question of a user, rewritten to its eight heaviest terms."""
    first = _user_turns(table).orderBy("conv_id", "turn").limit(1)
    row = Q.question_terms(first, ["conv_id", "turn"], "text").first()  # one question
    index = document_index(table)
    weights = Q.term_weights(row["terms"], row["weights"], index.analyzed) if row else {}
    return index.search(weights).withColumnRenamed("doc", "doc_id")
