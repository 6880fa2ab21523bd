"""Rules on urls from a table. The tables have none, so each host and folder of pages gives some, of all kinds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import url as U
from ..operators import url_rules
from .registry import query


def rule_table(table) -> DataFrame:
    """(rule_id, site, host, subdomains, pattern): five rules for each host and first folder of its pages; even hosts' rules hold below their parent."""
    u = F.col("url")
    sites = table("pages").select(U.host(u).alias("site"), F.regexp_extract(U.path(u), "^/([a-z]*)/", 1).alias("folder")).where("site <> ''").distinct()
    kinds = F.array(F.lit("/[0-9]*[02468]([?]|$)"), F.lit("/[0-9]+[?]page="), F.lit("ref="), F.lit("(/+)+$"), F.lit("/?[0-9]+$|/none"))
    rows = sites.select("site", "folder", (F.length("site") % 2 == 0).alias("subdomains"), F.posexplode(kinds).alias("kind", "tail"))
    host = F.when(F.col("subdomains"), F.regexp_replace("site", "^[^.]*[.]", "")).otherwise(F.col("site"))
    pattern = F.when(F.col("kind") == 2, F.col("tail")).otherwise(F.concat(F.lit("^/"), "folder", "tail"))
    return rows.select(F.concat_ws(":", "site", "folder", "kind").alias("rule_id"), "site", host.alias("host"), "subdomains", pattern.alias("pattern"))


_HOST = "rtrim(lower(coalesce(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]*)', 1), '')), '.')"
_RULES = rf"""p AS (SELECT page_id, url, {_HOST} AS own, coalesce(regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1), '') AS path, coalesce(regexp_extract(url, '^[^?#]*[?]([^#]*)', 1), '') AS q FROM pages),
s AS (SELECT DISTINCT own AS site, regexp_extract(path, '^/([a-z]*)/', 1) AS folder FROM p WHERE own <> ''), k(kind, tail) AS (VALUES (0, '/[0-9]*[02468]([?]|$)'), (1, '/[0-9]+[?]page='), (2, 'ref='), (4, '/?[0-9]+$|/none')),
r AS (SELECT site || ':' || folder || ':' || kind AS rule_id, site, length(site) % 2 = 0 AS below, CASE WHEN length(site) % 2 = 0 THEN regexp_replace(site, '^[^.]*[.]', '') ELSE site END AS host, CASE WHEN kind = 2 THEN tail ELSE '^/' || folder || tail END AS pattern FROM s, k),
m AS (SELECT page_id, rule_id, site, own, url FROM p JOIN r ON (own = host OR (below AND ends_with(own, '.' || host))) AND regexp_matches(path || CASE WHEN q <> '' THEN '?' || q ELSE '' END, pattern))"""


@query(f"WITH {_RULES} SELECT page_id, rule_id FROM m")
def rule_matches(table):
    """Every page with every rule that fits its url."""
    return url_rules.matches(table("pages"), "page_id", "url", rule_table(table))


@query(rf"""WITH {_RULES}, a AS (SELECT page_id, max(CAST(m.own = m.site AS INT)) = 1 AS fits FROM m GROUP BY 1),
n AS (SELECT page_id, own, 'https://' || own || path || CASE WHEN len(list_filter(string_split(q, '&'), lambda x: x <> '' AND string_split(x, '=')[1] NOT IN ({", ".join(f"'{i}'" for i in U.IGNORED)}))) > 0 THEN '?' || array_to_string(list_filter(string_split(q, '&'), lambda x: x <> '' AND string_split(x, '=')[1] NOT IN ({", ".join(f"'{i}'" for i in U.IGNORED)})), '&') ELSE '' END AS queue, url FROM p),
f AS (SELECT page_id, coalesce(queue <> url OR own <> '' AND NOT coalesce(fits, false), false) AS filtered, CASE WHEN page_id % 3 = 0 THEN 'excluded_rules' WHEN page_id % 3 = 1 THEN 'http_4xx' END AS was FROM n LEFT JOIN a USING (page_id)),
o AS (SELECT *, CASE WHEN filtered THEN 'excluded_rules' WHEN was = 'excluded_rules' THEN NULL ELSE was END AS status_error FROM f) SELECT page_id, filtered, status_error, status_error IS DISTINCT FROM was AS changed FROM o""")
def reapplied_rules(table):
    """What the rules of its site make of each page's status."""
    was = F.when(F.col("page_id") % 3 == 0, "excluded_rules").when(F.col("page_id") % 3 == 1, "http_4xx")
    pages = table("pages").select("page_id", "url", was.alias("status_error"), U.host(F.col("url")).alias("site"))
    return url_rules.reapplied(pages, "page_id", "url", "status_error", "site", rule_table(table))
