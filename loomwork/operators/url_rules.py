"""Tables of rules on urls, asked through an index: a url meets the few rules that its host and the start of its path can fit.

A rule has a host and a regular expression on path and query. Its keys are the host and the fixed start of the expression, up
to the last slash among the first DEPTH folders. A url has a key for each of its host's suffixes with each of its path's starts.
Equal keys meet in one join, and only then is an expression tried. So thousands of rules cost a join, not an
expression each, and no pair of a url and a rule is made that the index can tell apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import url as U
from ..functions.text import let

DEPTH, LONGEST = 3, 256


def is_safe(pattern: Column) -> Column:
    """A regular expression of bounded length without look-around, back references and nested repeats. It is not compiled here: one that
    is broken in another way fails the query that tries it."""
    return F.coalesce((F.length(pattern) > 0) & (F.length(pattern) <= LONGEST) & ~pattern.rlike(r"\(\?[=!<]|\\[1-9]|[+*}]\)?[+*{]|\([^()]*[+*][^()]*\)[+*{]"), F.lit(False))


def fixed_start(pattern: Column) -> Column:
    """The start that whatever fits pattern has, up to a slash and DEPTH folders; empty if it is not tied to the start or has alternatives."""
    plain = F.regexp_extract(pattern, r"^\^([A-Za-z0-9/_-]*)(.?)", 1)
    after = F.regexp_extract(pattern, r"^\^([A-Za-z0-9/_-]*)(.?)", 2)
    sure = F.when(after.isin("?", "*", "{", "+"), F.substr(plain, F.lit(1), F.greatest(F.length(plain) - 1, F.lit(0)))).otherwise(plain)
    return F.when(F.contains(pattern, F.lit("|")), "").otherwise(F.regexp_extract(sure, rf"^((?:/[^/]*){{0,{DEPTH - 1}}}/)", 1))


def host_suffixes(host: Column) -> Column:
    """The host and its parents, the shortest last; none of an empty host."""
    return let(F.split(host, "[.]"), lambda p: F.when(host == "", F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.size(p)), lambda i: F.array_join(F.slice(p, i, F.size(p) - i + 1), "."))))


def path_starts(path: Column) -> Column:
    """The empty start, and the path up to each of its first DEPTH slashes."""
    cut = F.transform(F.sequence(F.lit(1), F.lit(DEPTH)), lambda i: F.concat(F.call_function("substring_index", path, F.lit("/"), i), F.lit("/")))
    slashes = F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit("")))
    return F.concat(F.array(F.lit("")), F.slice(cut, F.lit(1), F.least(slashes, F.lit(DEPTH))))


def matches(pages: DataFrame, key: str, url: str, rules: DataFrame) -> DataFrame:
    """(key, rule_id) of each page and each rule that fits its url.

    rules: (rule_id, host, subdomains, pattern). A rule fits urls of its host, with subdomains also of hosts below it, whose path with query
    its pattern finds a match in. Unsafe patterns fit nothing, so do null ones and rules without a host. Hosts are compared in
    lower case. A url without a host meets no rule. Many pages of one host are one key only with the same start of the path;
    what is hot still is split by Spark's skewed join, as each key has few rules.
    """
    r = rules.where(is_safe(F.col("pattern")) & (F.col("host") != "")).select("rule_id", F.lower("host").alias("_host"), F.coalesce("subdomains", F.lit(False)).alias("_below"), "pattern", fixed_start(F.col("pattern")).alias("_start"))
    u = F.col(url)
    # A fragment is no part of what rules see.
    query = U.query(u)
    p = pages.select(F.col(key).alias("_key"), U.host(u).alias("_own"), F.concat(U.path(u), F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")).alias("_part"), U.path(u).alias("_path"))
    keys = p.select("_key", "_own", "_part", "_path", F.explode(host_suffixes(F.col("_own"))).alias("_host"))
    keys = keys.join(r.select("_host").distinct(), "_host", "left_semi")  # most hosts may have no rule at all
    keys = keys.select("_key", "_own", "_part", "_host", F.explode(path_starts(F.col("_path"))).alias("_start"))
    fits = (F.col("_below") | (F.col("_own") == F.col("_host"))) & F.rlike(F.col("_part"), F.col("pattern"))
    return keys.join(r, ["_host", "_start"]).where(fits).select(F.col("_key").alias(key), "rule_id")


def reapplied(pages: DataFrame, key: str, url: str, status_error: str, site: str, rules: DataFrame) -> DataFrame:
    """(key, filtered, status_error, changed) of each page after its site's rules: (site, rule_id, host, subdomains, pattern), which all allow.

    A page is filtered if its url is not the one that a queue would hold, or if its site has safe rules and none fits. It is excluded_rules
    then; a page that was and is no more is nothing. changed: whether that is another status than before. A page without a url
    is never filtered. Keys of pages should not repeat. As rules come and go the outcome follows, back too.
    """
    ruled = rules.where(is_safe(F.col("pattern"))).select(site).distinct().withColumn("_ruled", F.lit(True))
    own = rules.select("rule_id", F.col(site).alias("_site"))
    fits = matches(pages, key, url, rules).join(own, "rule_id").select(key, F.col("_site").alias(site)).distinct().withColumn("_fits", F.lit(True))
    u = F.col(url)
    rows = pages.select(key, url, status_error, site).join(ruled, site, "left").join(fits, [key, site], "left")
    filtered = F.coalesce((U.queue_url(u) != u) | (F.col("_ruled") & F.col("_fits").isNull()), F.lit(False)) & F.coalesce(u != "", F.lit(False))
    now = F.when(filtered, "excluded_rules").when(F.col(status_error) == "excluded_rules", None).otherwise(F.col(status_error))
    return rows.select(key, filtered.alias("filtered"), now.alias("status_error"), (~now.eqNullSafe(F.col(status_error))).alias("changed"))


def by_variants(pages: DataFrame, key: str, url: str, asked: DataFrame) -> DataFrame:
    """(asked_url, key) of each asked (asked_url) and the page that it is, with or without a slash at the end; of several pages the one with just this url, then the least key."""
    bare = lambda c: F.regexp_replace(c, "/$", "")
    found = asked.select("asked_url", bare(F.col("asked_url")).alias("_bare")).distinct().join(pages.select(F.col(key), F.col(url).alias("_url"), bare(F.col(url)).alias("_bare")), "_bare")
    return found.groupBy("asked_url").agg(F.min(F.struct(F.col("_url") != F.col("asked_url"), F.col(key).alias("_k"))).alias("_m")).select("asked_url", F.col("_m._k").alias(key))
