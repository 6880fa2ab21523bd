"""Queries over the state of a crawl and of an index: links, visits, statuses, JSON settings, reports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import jsons as J
from ..functions import text as T
from ..functions import url as U
from ..operators import analytics as A
from ..operators import hygiene
from .pages import _HOST, _LINKS, _PATH
from .registry import query

#: When the questions about lateness are asked.
NOW = "2024-06-01 00:00:00"


@query(f"""WITH v AS (SELECT page_id, (epoch_ms(TIMESTAMP '{NOW}') // 1000) - (epoch_ms(TIMESTAMP '2024-01-01') // 1000 + page_id * 3600 + (1 + page_id % 90) * 86400) AS overdue, page_id % 7 = 0 AS never FROM pages)
SELECT page_id, overdue, row_number() OVER (ORDER BY never DESC, overdue DESC, page_id) AS place FROM v WHERE never OR overdue > 0 QUALIFY place <= 50""")
def overdue_pages(table):
    """The first fifty pages to visit again: those never visited, then by how many seconds they are late."""
    late = F.unix_timestamp(F.lit(NOW)) - (F.unix_timestamp(F.lit("2024-01-01 00:00:00")) + F.col("page_id") * 3600 + (1 + F.col("page_id") % 90) * 86400)
    v = table("pages").select("page_id", late.alias("overdue"), (F.col("page_id") % 7 == 0).alias("never")).where("never or overdue > 0")
    order = [F.desc("never"), F.desc("overdue"), F.col("page_id")]
    top = v.orderBy(*order).limit(50)
    return top.select("page_id", "overdue", F.row_number().over(Window.orderBy(*order)).cast("long").alias("place"))


@query(f"""WITH {_LINKS}, p AS (SELECT page_id, {_HOST} AS host, {_PATH} AS path, html FROM pages), k AS (SELECT host, path, min(page_id) AS target, max(length(html)) AS n FROM p GROUP BY 1, 2)
SELECT l.page_id, l.href, CASE WHEN NOT starts_with(l.href, '/') THEN 'external' WHEN target IS NULL THEN 'missing' WHEN contains(l.href, 'login') THEN 'auth_required' WHEN n < 1200 THEN 'not_indexed' ELSE 'ok' END AS status
FROM (SELECT DISTINCT * FROM l) l LEFT JOIN k ON k.host = l.host AND k.path = l.href""")
def link_status(table):
    """What each distinct link of a page leads to."""
    pages = table("pages").select("page_id", U.host(F.col("url")).alias("host"), U.path(F.col("url")).alias("href"), "html")
    known = pages.groupBy("host", "href").agg(F.min("page_id").alias("target"), F.max(F.length("html")).alias("n"))
    links = pages.select("page_id", "host", F.explode(U.links(F.col("html"))).alias("href")).distinct().join(known, ["host", "href"], "left")
    status = F.when(~F.col("href").startswith("/"), "external").when(F.col("target").isNull(), "missing").when(F.col("href").contains("login"), "auth_required").when(F.col("n") < 1200, "not_indexed").otherwise("ok")
    return links.select("page_id", "href", status.alias("status"))


@query(f"""WITH {_LINKS}, p AS (SELECT DISTINCT {_HOST} AS host, {_PATH} AS path FROM pages) SELECT DISTINCT host, href FROM l WHERE starts_with(href, '/') AND NOT EXISTS (SELECT 1 FROM p WHERE p.host = l.host AND p.path = l.href)""")
def missing_targets(table):
    """Link targets of a host that are wanted and not found among its pages."""
    found = table("pages").select(U.host(F.col("url")).alias("host"), U.path(F.col("url")).alias("href"))
    wanted = table("pages").select(U.host(F.col("url")).alias("host"), F.explode(U.links(F.col("html"))).alias("href")).where(F.col("href").startswith("/")).distinct()
    return wanted.join(found, ["host", "href"], "left_anti")


@query(f"""WITH p AS (SELECT page_id, {_HOST} AS host FROM pages) SELECT host, min(page_id) AS source_page, count(*) AS n FROM p GROUP BY 1""")
def host_sources(table):
    """The source of each host: the first page that names it wins."""
    return table("pages").groupBy(U.host(F.col("url")).alias("host")).agg(F.min("page_id").alias("source_page"), F.count("*").alias("n"))


@query(r"""SELECT source, CAST(sum(len(s)) AS BIGINT) AS places, count(DISTINCT shingle) AS shingles FROM (SELECT source, s, unnest(s) AS shingle FROM (SELECT source, [w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)] AS s
FROM (SELECT source, regexp_extract_all(lower(text), '[a-zа-яё0-9]+') AS w FROM documents) WHERE len(w) >= 3)) GROUP BY 1""".replace("CAST(sum(len(s)) AS BIGINT)", "count(*)"))
def shingles_per_source(table):
    """Places and distinct trigrams of each source; hashes are shuffled, not words, and counted a task first."""
    grams = hygiene.block_trigrams(table("documents"), "source", "text").select("source", F.xxhash64("trigram").alias("h"), "n")
    return grams.groupBy("source", "h").agg(F.sum("n").alias("n")).groupBy("source").agg(F.sum("n").alias("places"), F.count("*").alias("shingles"))


@query("""WITH r AS (SELECT user_id, ts, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events),
s AS (SELECT user_id, count(*) AS n, count(*) FILTER (event_type = 'error') AS bad FROM r WHERE k <= 3 GROUP BY 1)
SELECT user_id, n = 3 AND bad = 3 AS limited, CASE WHEN n = 3 AND bad = 3 THEN least(30, 2 * (1 + user_id % 20)) ELSE 1 + user_id % 20 END AS delay FROM s""")
def limited_delay(table):
    """Users whose last three events all failed wait twice as long, thirty at most."""
    last = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    r = table("events").select("user_id", "event_type", F.row_number().over(last).alias("k")).where("k <= 3")
    s = r.groupBy("user_id").agg(F.count("*").alias("n"), F.count(F.when(F.col("event_type") == "error", 1)).alias("bad"))
    limited, delay = (F.col("n") == 3) & (F.col("bad") == 3), 1 + F.col("user_id") % 20
    return s.select("user_id", limited.alias("limited"), F.when(limited, F.least(F.lit(30), 2 * delay)).otherwise(delay).alias("delay"))


@query("""SELECT event_type, arg_max(event_id, (ts, event_id)) AS last_event, CAST((epoch_ms(max(ts)) - epoch_ms(min(ts))) // 1000 AS BIGINT) AS seconds, round(avg(value), 4) AS mean, round(median(value), 4) AS median FROM events GROUP BY 1""")
def run_durations(table):
    """The span, last event, mean and median of each kind of event."""
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    spans = table("events").groupBy("event_type").agg(
        F.max_by("event_id", F.struct("ts", "event_id")).alias("last_event"), F.floor((F.max(ms) - F.min(ms)) / 1000).alias("seconds"), F.round(F.avg("value"), 4).alias("mean")
    )
    return spans.join(A.median(table("events").select("event_type", "value"), ["event_type"], "value").withColumn("median", F.round("median", 4)), "event_type")


@query("""WITH h AS (SELECT event_type, user_id, count(*) AS n FROM events GROUP BY 1, 2), b AS (SELECT *, max(n) OVER (PARTITION BY event_type) AS best FROM h)
SELECT event_type, max(best) AS best, arg_max(user_id, (n, -user_id)) AS best_user, min(user_id) FILTER (n >= 0.9 * best) AS least_near, max(user_id) FILTER (n >= 0.9 * best) AS most_near FROM b GROUP BY 1""")
def near_peak_zone(table):
    """The best user of each kind, and the range of those within a tenth of the best."""
    n = table("events").groupBy("event_type", "user_id").agg(F.count("*").alias("n"))
    best = n.groupBy("event_type").agg(F.max("n").alias("best"))  # a maximum and a join, as a kind may hold most users
    near = F.when(F.col("n") >= 0.9 * F.col("best"), F.col("user_id"))
    return n.join(best, "event_type").groupBy("event_type").agg(F.max("best").alias("best"), F.max_by("user_id", F.struct("n", -F.col("user_id"))).alias("best_user"), F.min(near).alias("least_near"), F.max(near).alias("most_near"))


@query("""SELECT event_type, CAST(CAST(json_extract(props, '$.k') AS BIGINT) // 10 AS BIGINT) AS bucket, count(*) AS n, count(*) FILTER (json_extract(props, '$.k') IS NOT NULL) AS with_k, count(*) FILTER (json_type(props) = 'OBJECT') AS objects FROM events GROUP BY 1, 2""")
def json_types(table):
    """Kinds and values of JSON properties."""
    k = F.get_json_object("props", "$.k")
    return table("events").groupBy("event_type", F.floor(k.cast("long") / 10).alias("bucket")).agg(
        F.count("*").alias("n"), F.count(k).alias("with_k"), F.count(F.when(F.schema_of_variant(F.try_parse_json("props")).startswith("OBJECT"), 1)).alias("objects")
    )


@query("""SELECT user_id, CAST(sum(coalesce(TRY_CAST(json_extract_string(props, '$.usage.total') AS BIGINT), TRY_CAST(json_extract_string(props, '$.total') AS BIGINT), TRY_CAST(json_extract_string(props, '$.k') AS BIGINT), 0)) AS BIGINT) AS tokens, count(*) AS n FROM events GROUP BY 1""")
def token_usage(table):
    """Tokens of each user: the first of the places where providers write them, nested or not."""
    first = F.coalesce(*(F.get_json_object("props", p).try_cast("long") for p in ("$.usage.total", "$.total", "$.k")), F.lit(0))
    return table("events").groupBy("user_id").agg(F.sum(first).alias("tokens"), F.count("*").alias("n"))


@query("""SELECT event_id, CASE WHEN CAST(json_extract(props, '$.k') AS INT) % 2 = 0 THEN '{"k":' || json_extract_string(props, '$.k') || ',"type":"' || event_type || '"}' ELSE '{"type":"' || event_type || '"}' END AS merged FROM events""")
def json_merge(table):
    """Properties patched with the event's type; a null in the patch takes a key away (here: odd k)."""
    have = F.from_json("props", "map<string,bigint>")
    kept = F.map_filter(F.transform_values(have, lambda _, v: v.cast("string")), lambda k, v: v.cast("long") % 2 == 0)
    pairs = F.concat(F.transform(F.map_entries(kept), lambda e: F.concat(F.lit('"'), e["key"], F.lit('":'), e["value"])), F.array(F.concat(F.lit('"type":"'), F.col("event_type"), F.lit('"'))))
    return table("events").select("event_id", F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}")).alias("merged"))


@query(r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), r AS (SELECT doc_id, len(string_split(line, '|')) AS width FROM l WHERE contains(line, '|')), c AS (SELECT doc_id, width, count(*) AS n FROM r GROUP BY 1, 2)
SELECT doc_id, CAST(sum(n) AS BIGINT) AS n_rows, arg_max(width, (n, -width)) AS mode_width, round(max(n) / sum(n), 6) AS consistency FROM c GROUP BY 1""")
def table_widths(table):
    """Rows with cells of each document: the commonest width, and the share of rows that have it."""
    lines = table("documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line")).where(F.col("line").contains("|"))
    c = lines.groupBy("doc_id", F.size(F.split("line", r"\|")).cast("long").alias("width")).agg(F.count("*").alias("n"))
    return c.groupBy("doc_id").agg(F.sum("n").alias("n_rows"), F.max_by("width", F.struct("n", -F.col("width"))).alias("mode_width"), F.round(F.max("n") / F.sum("n"), 6).alias("consistency"))


@query(r"""WITH w AS (SELECT doc_id, list_filter(string_split_regex(text, '[ \t\n\x0B\f\r|]+'), lambda x: x <> '') AS w FROM documents)
SELECT doc_id, len(w) AS cells, len(list_filter(w, lambda x: regexp_full_match(x, '[-+]?[0-9]+([.,][0-9]+)?%?'))) AS numeric_cells, len(list_filter(w, lambda x: regexp_full_match(x, '[a-z]+'))) AS natural_cells,
len(w) > 0 AND len(list_filter(w, lambda x: regexp_full_match(x, '[-+]?[0-9]+([.,][0-9]+)?%?'))) >= 0.55 * len(w) AND len(list_filter(w, lambda x: regexp_full_match(x, '[a-z]+'))) <= 0.25 * len(w) AS dump FROM w""")
def cell_ratios(table):
    """Shares of numbers and plain words; mostly numbers and few words make a statistical dump."""
    w = table("documents").select("doc_id", F.filter(F.split("text", r"[ \t\n\x0B\f\r|]+"), lambda x: x != "").alias("w"))
    count = lambda p: F.size(F.filter("w", lambda x: x.rlike(p)))
    c = w.select("doc_id", F.size("w").cast("long").alias("cells"), count(r"^[-+]?[0-9]+([.,][0-9]+)?%?$").cast("long").alias("numeric_cells"), count("^[a-z]+$").cast("long").alias("natural_cells"))
    return c.withColumn("dump", (F.col("cells") > 0) & (F.col("numeric_cells") >= 0.55 * F.col("cells")) & (F.col("natural_cells") <= 0.25 * F.col("cells")))


@query(r"""WITH l AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line FROM documents), p AS (SELECT source, doc_id, sum(length(line)) AS chars, sum(CASE WHEN length(line) < 20 OR regexp_matches(line, '[#*$%&|<>]{2}') THEN length(line) ELSE 0 END) AS noise FROM l GROUP BY 1, 2)
SELECT source, count(*) AS n_docs, round(CASE WHEN sum(chars) > 0 THEN sum(noise) / sum(chars) ELSE 0 END, 6) AS noise_ratio, count(*) FILTER (noise > 0.5 * chars) AS noisy FROM p GROUP BY 1""")
def noise_ratio(table):
    """Characters in noisy lines, of all of a source's: a ratio of sums; and its documents that are mostly noise."""
    lines = table("documents").select("source", "doc_id", F.explode(F.split("text", "\n")).alias("line")).withColumn("n", F.length("line"))
    noisy = F.when((F.col("n") < 20) | F.col("line").rlike("[#*$%&|<>]{2}"), F.col("n")).otherwise(0)
    p = lines.groupBy("source", "doc_id").agg(F.sum("n").alias("chars"), F.sum(noisy).alias("noise"))
    ratio = F.when(F.sum("chars") > 0, F.sum("noise") / F.sum("chars")).otherwise(0.0)
    return p.groupBy("source").agg(F.count("*").alias("n_docs"), F.round(ratio, 6).alias("noise_ratio"), F.count(F.when(F.col("noise") > 0.5 * F.col("chars"), 1)).alias("noisy"))


@query(r"""SELECT doc_id, CASE WHEN length(text) <= 200 THEN text ELSE substring(text, 1, 95) || chr(10) || '...' || chr(10) || substring(text, length(text) - 99, 100) END AS shortened, substring(text, 151) AS rest FROM documents""")
def truncated_middle(table):
    """A long text's two ends, and what follows a preview of 150 characters."""
    t = F.col("text")
    ends = F.concat(F.substring(t, 1, 95), F.lit("\n...\n"), F.substring(t, F.length(t) - 99, F.lit(100)))
    return table("documents").select("doc_id", F.when(F.length(t) <= 200, t).otherwise(ends).alias("shortened"), F.substring(t, F.lit(151), F.length(t)).alias("rest"))


@query(r"""WITH t AS (SELECT page_id, trim(regexp_replace(replace(replace(replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '&amp;', '&'), '&lt;', '<'), '&middot;', '·'), '[ \t\n\r]+', ' ', 'g')) AS title FROM pages)
SELECT page_id, CASE WHEN title = '' OR length(title) > 220 OR len(string_split(title, ' ')) > 30 OR regexp_full_match(title, '[a-z0-9]+([-_][a-z0-9]+)+') THEN NULL ELSE title END AS title FROM t""")
def page_titles(table):
    """Titles with entities resolved and spaces joined; none if empty, over 220 characters or 30 words, or a slug."""
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    for entity, char in (("&amp;", "&"), ("&lt;", "<"), ("&middot;", "·")):
        title = F.replace(title, F.lit(entity), F.lit(char))
    title = F.trim(F.regexp_replace(title, r"[ \t\n\r]+", " "))
    bad = (F.col("t") == "") | (F.length("t") > 220) | (F.size(F.split("t", " ")) > 30) | F.col("t").rlike("^[a-z0-9]+([-_][a-z0-9]+)+$")
    return table("pages").select("page_id", title.alias("t")).select("page_id", F.when(~bad, F.col("t")).alias("title"))


@query("""WITH f AS (SELECT user_id, ts, event_id, epoch_ms(ts) // 900000 AS slot FROM events WHERE event_type = 'error'), n AS (SELECT user_id, slot, count(*) AS failures, min(ts)::TIMESTAMP AS first_failure FROM f GROUP BY 1, 2)
SELECT user_id, slot, failures, first_failure, failures >= 3 AS locked FROM n""")
def failure_locks(table):
    """Failures of each user in quarters of an hour, and whether they lock the account."""
    f = table("events").where("event_type = 'error'").withColumn("slot", F.floor(F.unix_millis(F.col("ts").cast("timestamp")) / 900_000))
    return f.groupBy("user_id", "slot").agg(F.count("*").alias("failures"), F.min("ts").alias("first_failure")).withColumn("locked", F.col("failures") >= 3)


@query("""SELECT conv_id, role, string_agg(coalesce(text, ''), '' ORDER BY turn) AS message, count(*) AS parts, CAST(max(length(text)) AS BIGINT) AS most FROM conversations GROUP BY 1, 2""")
def joined_parts(table):
    """A role's parts of a conversation as one message, in order, and the longest of them."""
    parts = F.array_sort(F.collect_list(F.struct("turn", F.coalesce("text", F.lit("")).alias("text"))))
    return table("conversations").groupBy("conv_id", "role").agg(F.array_join(F.transform(parts, lambda p: p["text"]), "").alias("message"), F.count("*").alias("parts"), F.max(F.length("text")).cast("long").alias("most"))


@query(f"""SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' AND o_orderdate < TIMESTAMP '1997-01-01' - INTERVAL 30 DAY THEN 'closed' ELSE o_orderstatus END AS status FROM orders""")
def zombie_runs(table):
    """Runs that have been open for over thirty days are closed."""
    old = (F.col("o_orderstatus") == "P") & (F.col("o_orderdate").cast("timestamp") < F.to_timestamp(F.lit("1997-01-01 00:00:00")) - F.expr("interval 30 days"))
    return table("orders").select("o_orderkey", F.when(old, "closed").otherwise(F.col("o_orderstatus")).alias("status"))


@query("""SELECT l_orderkey, count(*) FILTER (l_linestatus = 'O') AS pending, count(*) AS n, count(*) FILTER (l_linestatus = 'O') = 0 AS completed FROM lineitem GROUP BY 1""")
def pending_parts(table):
    """Open parts of each order; it is completed when none is left."""
    pending = F.count(F.when(F.col("l_linestatus") == "O", 1))
    return table("lineitem").groupBy("l_orderkey").agg(pending.alias("pending"), F.count("*").alias("n"), (pending == 0).alias("completed"))


@query("""WITH s AS (SELECT doc_id, trim(text) AS t FROM documents), k AS (SELECT t, min(doc_id) AS first_doc, count(*) AS n FROM s WHERE t <> '' GROUP BY 1) SELECT first_doc AS doc_id, n, row_number() OVER (ORDER BY first_doc) AS place FROM k QUALIFY place <= 100""")
def kept_first(table):
    """The first hundred of a list without repeats, in its order."""
    t = F.trim("text")
    k = table("documents").select("doc_id", F.xxhash64(t).alias("h"), F.sha2(t, 256).alias("t")).where(t != "").groupBy("h", "t").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"))
    return k.orderBy("doc_id").limit(100).select("doc_id", "n", F.row_number().over(Window.orderBy("doc_id")).cast("long").alias("place"))


_PATCHES = """p AS (SELECT event_id, props, json_object('type', event_type, 'meta', json_object('user', user_id, 'at', json_object('k', json_extract(props, '$.k'), 'old', 1), 'tags', json_array(event_type, user_id)), 'note', 'x') AS one,
  CASE event_id % 5 WHEN 0 THEN '{"k":null,"meta":{"at":{"old":null,"new":[1,{"a":null}]}}}' WHEN 1 THEN '{"meta":{"tags":null,"user":{"id":7}},"note":null}' WHEN 2 THEN '{"meta":[1,2],"type":null}' WHEN 3 THEN '{"meta":{"at":"ü"},"deep":{"a":{"b":{"c":null,"d":{}}}}}' ELSE '{}' END AS two FROM events)"""


_PATHS = {"k": "$.k", "type": "$.type", "note": "$.note", "user": "$.meta.user", "at_k": "$.meta.at.k", "at_old": "$.meta.at.old", "at_new": "$.meta.at.new", "tags": "$.meta.tags", "deep": "$.deep"}


@query(f"""WITH {_PATCHES}, m AS (SELECT event_id, json_merge_patch(json_merge_patch(props, one), two) AS m FROM p)
SELECT event_id, array_to_string(list_sort(json_keys(m)), ',') AS keys, coalesce(array_to_string(list_sort(json_keys(m, '$.meta')), ','), '') AS meta_keys, {", ".join(f"json_extract_string(m, '{p}') AS {c}" for c, p in _PATHS.items())} FROM m""")
def json_merge_patches(table):
    """Properties after two patches: nested objects, keys taken away, arrays and texts in place of objects."""
    two = F.element_at(F.array(*map(F.lit, [
        '{"k":null,"meta":{"at":{"old":null,"new":[1,{"a":null}]}}}', '{"meta":{"tags":null,"user":{"id":7}},"note":null}', '{"meta":[1,2],"type":null}', '{"meta":{"at":"ü"},"deep":{"a":{"b":{"c":null,"d":{}}}}}', "{}",
    ])), (F.col("event_id") % 5 + 1).cast("int"))
    k = F.get_json_object("props", "$.k")
    one = F.concat(F.lit('{"type":"'), "event_type", F.lit('","meta":{"user":'), "user_id", F.lit(',"at":{"k":'), k, F.lit(',"old":1},"tags":["'), "event_type", F.lit('",'), "user_id", F.lit(']},"note":"x"}'))
    m = table("events").select("event_id", J.merge_patch(J.merge_patch(F.col("props"), one), two).alias("m"))
    keys = lambda text: F.array_join(F.array_sort(F.json_object_keys(text)), ",")
    return m.select("event_id", keys(F.col("m")).alias("keys"), F.coalesce(keys(F.get_json_object("m", "$.meta")), F.lit("")).alias("meta_keys"), *(F.get_json_object("m", p).alias(c) for c, p in _PATHS.items()))
