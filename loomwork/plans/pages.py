"""Queries over crawled pages: urls, links, titles, visits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import url as U
from ..operators import html_blocks as B
from ..operators import pages as P
from ..operators import scheduling as S
from .registry import query

_HOST = "rtrim(lower(coalesce(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]*)', 1), '')), '.')"
_PATH = "coalesce(regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1), '')"
_IGNORED = ", ".join(f"'{p}'" for p in U.IGNORED)


@query(f"""WITH p AS (SELECT page_id, {_HOST} AS host, {_PATH} AS path, list_filter(string_split(regexp_extract(url, '^[^?#]*[?]([^#]*)', 1), '&'), lambda x: x <> '' AND string_split(x, '=')[1] NOT IN ({_IGNORED})) AS q, url FROM pages)
SELECT page_id, 'https://' || host || path || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END AS queue_url, regexp_replace(regexp_replace(url, '#.*$', ''), '/+$', '') AS canonical,
trim(regexp_replace(lower(concat_ws(' ', host, path, regexp_extract(url, '^[^?#]*[?]([^#]*)', 1))), '[^a-z0-9]+', ' ', 'g')) AS slug FROM p""")
def url_normalize(table):
    u = F.col("url")
    return table("pages").select("page_id", U.queue_url(u).alias("queue_url"), U.canonical(u).alias("canonical"), U.slug(u).alias("slug"))


_LINKS = f"""l AS (SELECT page_id, {_HOST} AS host, unnest(regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1)) AS href FROM pages)"""


@query("""SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(html, '<html[^>]* lang="([^"]*)"', 1) AS lang, len(regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1)) AS n_links,
len(list_filter(regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1), lambda x: starts_with(x, '/'))) AS n_internal FROM pages""")
def html_title_links(table):
    links = U.links(F.col("html"))
    return table("pages").select(
        "page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.regexp_extract("html", '<html[^>]* lang="([^"]*)"', 1).alias("lang"), F.size(links).cast("long").alias("n_links"), F.size(F.filter(links, lambda x: x.startswith("/"))).cast("long").alias("n_internal")
    )


@query(f"""WITH {_LINKS} SELECT host, href, count(*) AS n, count(DISTINCT page_id) AS pages FROM l GROUP BY 1, 2""")
def inlinks(table):
    """Links to each target of a host."""
    l = P.link_edges(table("pages"))
    return l.groupBy("host", "href").agg(F.count("*").alias("n"), F.countDistinct("page_id").alias("pages"))


@query(f"""WITH {_LINKS}, t AS (SELECT DISTINCT host, href FROM l), p AS (SELECT page_id, {_HOST} AS host, {_PATH} AS path FROM pages) SELECT page_id, host FROM p WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.host = p.host AND t.href = p.path)""")
def orphans(table):
    """Pages to whose path no page of their host links."""
    p = table("pages").select("page_id", U.host(F.col("url")).alias("host"), U.path(F.col("url")).alias("href"))
    return p.join(P.link_edges(table("pages")).select("host", "href").distinct(), ["host", "href"], "left_anti").select("page_id", "host")


@query(f"""WITH {_LINKS}, p AS (SELECT page_id, {_HOST} AS host, {_PATH} AS path FROM pages), e AS (SELECT DISTINCT l.page_id AS a, p.page_id AS b FROM l JOIN p ON p.host = l.host AND p.path = l.href WHERE l.page_id <> p.page_id),
f AS (SELECT coalesce(x.a, y.b) AS a, coalesce(x.b, y.a) AS b, CASE WHEN x.a IS NOT NULL AND y.a IS NOT NULL THEN 'mutual' WHEN x.a IS NOT NULL THEN 'out' ELSE 'in' END AS relation FROM e x FULL JOIN e y ON x.a = y.b AND x.b = y.a)
SELECT page_id AS page, coalesce(relation, 'none') AS relation, count(*) AS n FROM pages LEFT JOIN f ON a = page_id GROUP BY 1, 2""")
def link_groups(table):
    """Mutual, outgoing and incoming neighbours of each page, by the links whose host and path are another page's; none: without any."""
    targets = table("pages").select(F.col("page_id").alias("b"), U.host(F.col("url")).alias("host"), U.path(F.col("url")).alias("href"))
    e = P.link_edges(table("pages")).withColumnRenamed("page_id", "a").join(targets, ["host", "href"]).where("a <> b").select("a", "b").distinct()
    groups = P.link_groups(e, "a", "b").withColumnRenamed("a", "page")
    return table("pages").select(F.col("page_id").alias("page")).join(groups, "page", "left").groupBy("page", F.coalesce("relation", F.lit("none")).alias("relation")).agg(F.count("*").alias("n"))


@query(f"""SELECT {_HOST} AS host, count(*) AS n, count(*) FILTER (url LIKE 'https:%') AS secure, CAST(sum(length(html)) AS BIGINT) AS chars FROM pages GROUP BY 1""")
def pages_per_host(table):
    return table("pages").groupBy(U.host(F.col("url")).alias("host")).agg(F.count("*").alias("n"), F.count(F.when(F.col("url").startswith("https:"), 1)).alias("secure"), F.sum(F.length("html")).alias("chars"))


@query("""WITH k AS (SELECT page_id, regexp_replace(regexp_replace(url, '[?#].*$', ''), '/+$', '') AS k, url FROM pages), r AS (SELECT *, first_value(page_id) OVER (PARTITION BY k ORDER BY length(url), page_id) AS c FROM k) SELECT page_id, c AS canonical FROM r WHERE page_id <> c""")
def duplicate_urls(table):
    """Pages whose url is another's but for query, fragment or slash; the shortest one stays."""
    k = table("pages").select("page_id", "url", F.regexp_replace(F.regexp_replace("url", "[?#].*$", ""), "/+$", "").alias("k"))
    first = k.groupBy("k").agg(F.min(F.struct(F.length("url").alias("n"), "page_id")).alias("f")).select("k", F.col("f.page_id").alias("canonical"))
    return k.join(first, "k").where("page_id <> canonical").select("page_id", "canonical")


@query("""SELECT page_id, CASE WHEN length(html) % 3 = 0 THEN greatest(1, c // 2) ELSE least(90, CAST(floor(c * 1.5) AS BIGINT)) END AS days FROM (SELECT page_id, html, CASE WHEN page_id % 40 = 0 THEN 7 ELSE page_id % 40 END AS c FROM pages)""")
def visit_intervals(table):
    """The next interval of pages, a third of which changed."""
    return table("pages").select("page_id", S.next_interval(F.col("page_id") % 40, F.length("html") % 3 == 0).cast("long").alias("days"))


@query(None)
def html_to_markdown(table):
    """Main text and structure of each page."""
    return P.extracted(table("pages"), "page_id", "html").select("page_id", "title", "n_headings", "n_lists", "n_paragraphs", F.length("markdown").alias("chars"), F.sha2("markdown", 256).alias("markdown_sha256"))


#: As HTML has it, &amp and &quot need no semicolon: titles cut to a length end in the middle of one.
_BLOCKS = r"""b AS (SELECT page_id, regexp_split_to_array(regexp_replace(html, '(?s)<head>.*?</head>|<nav>.*?</nav>|<footer>.*|<div class="ad">[^<]*</div>|<!--.*?-->', '', 'g'), '</?(?:h1|p|article|body|html)(?: [^>]*)?>|<!DOCTYPE html>') AS s FROM pages),
t AS (SELECT page_id, i, list_filter(list_transform(string_split(regexp_replace(regexp_replace(regexp_replace(replace(replace(s[i], chr(10), ' '), '<br>', chr(10)), '<[^>]*>', '', 'g'), '&quot;?', '"', 'g'), '&amp;?', '&', 'g'), chr(10)), lambda x: trim(regexp_replace(x, '[ \t]+', ' ', 'g'))), lambda x: x <> '') AS l FROM (SELECT *, unnest(range(1, len(s) + 1)) AS i FROM b)),
n AS (SELECT page_id, array_to_string(l, chr(10)) AS body, row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS block FROM t WHERE len(l) > 0),
h AS (SELECT page_id, body AS heading FROM n WHERE block = 0)"""


@query(f"WITH {_BLOCKS} SELECT page_id, CAST(block AS INT) AS block, CASE WHEN block = 0 THEN 'heading' ELSE 'paragraph' END AS kind, heading AS section_path, sha256(body) AS body_sha256 FROM n JOIN h USING (page_id)")
def html_blocks(table):
    """Every block of every page, with the headings above it."""
    b = B.html_blocks(table("pages"), "page_id", "html")
    return b.select("page_id", "block", "kind", "section_path", F.sha2("body", 256).alias("body_sha256"))


@query(f"""WITH {_BLOCKS}, m AS (SELECT page_id, string_agg(CASE WHEN block = 0 THEN '# ' || body ELSE body END, chr(10) || chr(10) ORDER BY block) AS m, count(*) FILTER (block = 0) AS n_headings, count(*) FILTER (block > 0) AS n_paragraphs FROM n GROUP BY 1)
SELECT page_id, sha256(m) AS markdown_sha256, '1:' || heading AS outline, CAST(len(list_filter(regexp_split_to_array(m, '\\s+'), lambda x: x <> '')) AS INT) AS n_words, n_headings, n_paragraphs FROM m JOIN h USING (page_id)""")
def page_documents(table):
    """Every page put together from its blocks: text in markdown, outline and counts."""
    d = B.documents(B.html_blocks(table("pages"), "page_id", "html"), "page_id")
    outline = F.array_join(F.transform("outline", lambda o: F.concat(o["level"].cast("string"), F.lit(":"), o["section_path"])), "\n")
    return d.select("page_id", F.sha2("markdown", 256).alias("markdown_sha256"), outline.alias("outline"), "n_words", "n_headings", "n_paragraphs")
