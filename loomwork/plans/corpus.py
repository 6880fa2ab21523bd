"""Queries over documents: hygiene, chunks, personal data, progress."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import pii
from ..functions import text as T
from ..operators import chunking, hygiene, personal, splitting
from .registry import query

_WORDS = "regexp_extract_all(lower(text), '[a-zа-яё0-9]+')"
_TRIGRAMS = f"""w AS (SELECT doc_id, source, {_WORDS} AS w FROM documents),
g AS (SELECT DISTINCT doc_id, source, unnest([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)]) AS trigram FROM w WHERE len(w) >= 3)"""


@query("""WITH r AS (SELECT source, doc_id, first_value(doc_id) OVER (PARTITION BY source, sha256(text) ORDER BY length(text), doc_id) AS canonical FROM documents)
SELECT source, doc_id, canonical FROM r WHERE doc_id <> canonical""")
def exact_duplicates_in_source(table):
    return hygiene.exact_duplicates(table("documents"), ["source"], F.col("text"), [F.length("text"), F.col("doc_id")], "doc_id")


@query("""WITH r AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY sha256(text)) AS canonical FROM documents) SELECT doc_id, canonical FROM r WHERE doc_id <> canonical""")
def exact_duplicates(table):
    return hygiene.exact_duplicates(table("documents"), [], F.col("text"), [F.col("doc_id")], "doc_id")


@query(f"""WITH {_TRIGRAMS} SELECT source, trigram, count(*) AS n_docs FROM g GROUP BY 1, 2""")
def trigram_df(table):
    return hygiene.trigram_frequency(table("documents"), "source", "doc_id", "text")


@query(f"""WITH {_TRIGRAMS}, t AS (SELECT source, count(*) AS total FROM documents WHERE length(text) > 0 GROUP BY 1 HAVING count(*) >= 5)
SELECT source, trigram, count(*) AS n_docs FROM g JOIN t USING (source) GROUP BY source, trigram, total HAVING count(*) > 0.1 * total""")
def boilerplate(table):
    """At a tenth of a source's documents: these tables hold nothing at the usual share of 0.4."""
    return hygiene.boilerplate(table("documents"), "source", "doc_id", "text", share=0.1)


@query(f"""WITH {_TRIGRAMS}, t AS (SELECT source, count(*) AS total FROM documents WHERE length(text) > 0 GROUP BY 1 HAVING count(*) >= 5),
f AS (SELECT source, trigram FROM g JOIN t USING (source) GROUP BY source, trigram, total HAVING count(*) > 0.1 * total),
b AS (SELECT source, doc_id, l.i AS block, regexp_extract_all(lower(string_split(text, chr(10))[l.i]), '[a-zа-яё0-9]+') AS w FROM documents, range(1, 1000000) l(i) WHERE l.i <= len(string_split(text, chr(10)))),
n AS (SELECT b.source, doc_id, block, count(*) AS n, count(f.trigram) AS hits FROM (
  SELECT DISTINCT source, doc_id, block, unnest([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)]) AS trigram FROM b WHERE len(w) >= 3) b LEFT JOIN f ON b.source = f.source AND b.trigram = f.trigram GROUP BY ALL)
SELECT source, doc_id, count(*) AS dropped FROM n WHERE n >= 3 AND hits >= 0.5 * n GROUP BY 1, 2""")
def boilerplate_blocks(table):
    """How many blocks boilerplate removal drops from each document that loses any."""
    docs = table("documents").where(F.col("text").isNotNull())
    frequent = hygiene.boilerplate(docs, "source", "doc_id", "text", share=0.1)
    return hygiene.without_boilerplate(docs, frequent, "source", "doc_id", "text").where("not kept").groupBy("source", "doc_id").agg(F.count("*").alias("dropped"))


_SETS = r"""l AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(regexp_replace(regexp_replace(lower(x), '[0-9]+(?:[./:-][0-9]+)+', '<date>', 'g'), '[0-9]+', '<num>', 'g'), '[ \t\r\v\f]+', ' ', 'g'))), lambda x: x <> '') AS l FROM documents),
s AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(l) < 3 THEN l ELSE [l[i] || chr(10) || l[i + 1] || chr(10) || l[i + 2] FOR i IN range(1, len(l) - 1)] END)) AS s FROM l),
c AS (SELECT min(doc_id) AS doc_id, s FROM s WHERE len(s) > 0 GROUP BY s)"""


@query(f"""WITH {_SETS} SELECT a.doc_id AS "left", b.doc_id AS "right", round(len(list_intersect(a.s, b.s)) / len(list_distinct(list_concat(a.s, b.s))), 6) AS similarity
FROM c a JOIN c b ON a.doc_id < b.doc_id WHERE list_has_any(a.s, b.s) AND len(list_intersect(a.s, b.s)) >= 0.5 * len(list_distinct(list_concat(a.s, b.s)))""")
def near_duplicates(table):
    """Pairs of different documents (least ids of equal ones) that share half of their line shingles."""
    return hygiene.similar_by_lines(table("documents"), "doc_id", "text", 0.5).withColumn("similarity", F.round("similarity", 6))


_PAIRS = f"""{_SETS}, pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, len(list_intersect(a.s, b.s)) / len(list_distinct(list_concat(a.s, b.s))) AS similarity FROM c a JOIN c b ON a.doc_id < b.doc_id WHERE list_has_any(a.s, b.s))"""


@query(f"WITH {_PAIRS} SELECT a AS \"left\", b AS \"right\", round(similarity, 6) AS similarity FROM pairs WHERE similarity >= 0.9")
def near_duplicates_strict(table):
    """The same for pairs that count as unchanged: nine tenths in common."""
    return hygiene.similar_by_lines(table("documents"), "doc_id", "text", 0.9).withColumn("similarity", F.round("similarity", 6))


@query(f"""WITH {_PAIRS}, n AS (SELECT d, count(*) AS n FROM (SELECT a AS d FROM pairs WHERE similarity >= 0.1 UNION ALL SELECT b FROM pairs WHERE similarity >= 0.1) GROUP BY 1)
SELECT s.doc_id, c.doc_id AS class, count(*) OVER (PARTITION BY c.doc_id) AS n_members, coalesce(n.n, 0) AS n_links FROM s JOIN c USING (s) LEFT JOIN n ON n.d = c.doc_id""")
def near_duplicate_members(table):
    """Every document with its class of equal sets, and how many other classes share a tenth of their shingles with it."""
    return hygiene.near_duplicate_members(table("documents"), "doc_id", "text", 0.1)


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents),
h AS (SELECT *, min(pos) OVER (PARTITION BY doc_id, sha256(trim(line, chr(32) || chr(9) || chr(11) || chr(12) || chr(13)))) AS canonical FROM l)
SELECT doc_id, pos, canonical FROM h WHERE pos <> canonical""")
def chunk_duplicates(table):
    """Lines of a document that repeat an earlier one."""
    lines = table("documents").where(F.col("text").isNotNull()).select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return hygiene.chunk_duplicates(lines, ["doc_id"], ["pos"], "line").where("pos <> canonical").select("doc_id", F.col("pos").cast("long").alias("pos"), F.col("canonical").cast("long").alias("canonical"))


@query(None)
def chunk_windows(table):
    """Overlapping token windows of whole documents, word offsets included."""
    return chunking.window_chunks(table("documents"), "doc_id", "text").select("doc_id", "chunk", "start", "end", "n_tokens", F.sha2("text", 256).alias("text_sha256"))


@query(None)
def chunk_stats(table):
    chunks = chunking.structured_chunks(table("documents"), "doc_id", "text")
    return chunks.groupBy("kind").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"), F.max("n_tokens").alias("most_tokens"))


_RE = {k: v.replace("'", "''") for k, v in pii.PATTERNS.items()}


@query(f"""SELECT doc_id, array_to_string(list_filter([{", ".join(f"CASE WHEN regexp_matches(text, '{p}') THEN '{k}' END" for k, p in _RE.items())}], lambda x: x IS NOT NULL), ',') AS reasons
FROM documents WHERE {" OR ".join(f"regexp_matches(text, '{p}')" for p in _RE.values())}""")
def pii_reasons(table):
    r = table("documents").select("doc_id", pii.reasons(F.col("text")).alias("r"))
    return r.where(F.size("r") > 0).select("doc_id", F.array_join("r", ",").alias("reasons"))


@query(r"""WITH m AS (SELECT doc_id, text, regexp_replace(regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}', '***', 'g'), '[+]?[0-9](?:[ ()-]{0,2}[0-9]){9,15}', '***', 'g') AS masked FROM documents)
SELECT doc_id, sha256(masked) AS masked_sha256 FROM m WHERE masked <> text""")
def pii_mask(table):
    m = table("documents").select("doc_id", "text", pii.masked(F.col("text")).alias("masked"))
    return m.where("masked <> text").select("doc_id", F.sha2("masked", 256).alias("masked_sha256"))


@query("""SELECT source, count(*) AS n, count(*) FILTER (quality = 0) AS errors, count(*) FILTER (doc_id NOT IN (SELECT doc_id FROM labels)) AS pending, count(*) FILTER (quality = 1 AND toxic = 0) AS ready, count(*) FILTER (quality = 1 AND toxic = 1) AS excluded
FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1""")
def source_progress(table):
    """Each document in one bucket: errors, pending, ready or excluded."""
    d = table("documents").select("doc_id", "source").join(table("labels"), "doc_id", "left")
    n = lambda cond, name: F.count(F.when(cond, 1)).alias(name)
    q, t = F.col("quality"), F.col("toxic")
    return d.groupBy("source").agg(F.count("*").alias("n"), n(q == 0, "errors"), n(q.isNull(), "pending"), n((q == 1) & (t == 0), "ready"), n((q == 1) & (t == 1), "excluded"))


@query("""SELECT source, count(*) AS docs, CAST(sum(strlen(text)) AS BIGINT) AS bytes, CAST(sum(length(text)) AS BIGINT) AS chars, count(*) FILTER (length(text) > 10000) AS big FROM documents GROUP BY 1""")
def source_size(table):
    return table("documents").groupBy("source").agg(F.count("*").alias("docs"), F.sum(F.octet_length("text")).alias("bytes"), F.sum(F.length("text")).alias("chars"), F.count(F.when(F.length("text") > 10_000, 1)).alias("big"))


@query("""SELECT lang, source, count(*) AS n, grouping(lang) AS g_lang, grouping(source) AS g_source FROM documents GROUP BY CUBE (lang, source)""")
def document_cube(table):
    return table("documents").cube("lang", "source").agg(F.count("*").alias("n"), F.grouping("lang").cast("long").alias("g_lang"), F.grouping("source").cast("long").alias("g_source"))


@query("""SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def unlabeled_documents(table):
    return table("documents").select("doc_id", "source").join(table("labels"), "doc_id", "left_anti")


@query("""SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)""")
def labeled_semi(table):
    return table("documents").select("doc_id", "lang").join(table("labels").where("toxic = 1"), "doc_id", "left_semi")


@query(r"""SELECT doc_id, len(regexp_extract_all(text, '[^ \t\n\v\f\r]+')) AS n_words FROM documents WHERE len(regexp_extract_all(text, '[^ \t\n\v\f\r]+')) BETWEEN 1 AND 40 AND length(trim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) <= 250""")
def low_content(table):
    d = table("documents").where(T.low_content(F.col("text")))
    return d.select("doc_id", F.size(F.split(F.btrim("text", F.lit(T.WHITE)), "[ \t\n\x0b\x0c\r]+")).cast("long").alias("n_words"))


@query("""WITH r AS (SELECT source, doc_id, length(text) AS n, row_number() OVER (PARTITION BY source ORDER BY length(text) DESC, doc_id) AS rank FROM documents) SELECT source, doc_id, n, rank FROM r WHERE rank <= 3""")
def longest_per_source(table):
    """Top three of each source: the window keeps three rows a task before the shuffle."""
    from pyspark.sql import Window

    order = Window.partitionBy("source").orderBy(F.desc("n"), "doc_id")
    return table("documents").select("source", "doc_id", F.length("text").alias("n")).withColumn("rank", F.row_number().over(order)).where("rank <= 3")


@query(r"""WITH a AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-zа-яё0-9]+') AS w FROM documents), b AS (SELECT item_id, regexp_extract_all(lower(text), '[a-zа-яё0-9]+') AS w FROM benchmark),
x AS (SELECT DISTINCT doc_id, unnest([array_to_string(w[i:i + 12], ' ') FOR i IN range(1, len(w) - 11)]) AS g FROM a WHERE len(w) >= 13),
y AS (SELECT DISTINCT item_id, unnest([array_to_string(w[i:i + 12], ' ') FOR i IN range(1, len(w) - 11)]) AS g FROM b WHERE len(w) >= 13)
SELECT doc_id, item_id, count(*) AS shared FROM x JOIN y USING (g) GROUP BY 1, 2""")
def contamination(table):
    """Benchmark items with which a document shares a run of 13 words, and how many runs."""
    runs = lambda t, key: t.select(key, F.explode(F.array_distinct(T.windows(T.normalized_words(F.col("text")), 13, " "))).alias("g"))
    return runs(table("documents"), "doc_id").join(runs(table("benchmark"), "item_id"), "g").groupBy("doc_id", "item_id").agg(F.count("*").alias("shared"))


SPLIT = 900
_SPLIT = rf"""b AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), w AS (SELECT doc_id, regexp_replace(t, '^\s+|\s+$', '', 'g') AS t FROM b),
para AS (SELECT doc_id, k AS pk, regexp_replace(p[k], '^\s+|\s+$', '', 'g') AS t FROM (SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS k FROM (SELECT doc_id, CASE WHEN length(t) <= {SPLIT} THEN [t] ELSE regexp_split_to_array(t, '\n\s*\n') END AS p FROM w)) WHERE p[k] <> ''),
sent AS (SELECT doc_id, pk, k AS sk, s[k] AS s, length(s[k]) AS n FROM (SELECT *, unnest(range(1, len(s) + 1)) AS k FROM (SELECT doc_id, pk, CASE WHEN length(t) <= {SPLIT} THEN [t] ELSE list_filter(regexp_split_to_array(regexp_replace(t, '([.!?。！？])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') END AS s FROM para))),
pack AS (WITH RECURSIVE r AS (
  SELECT doc_id, pk, sk, n, 1 AS part, n AS size FROM sent WHERE sk = 1 UNION ALL
  SELECT s.doc_id, s.pk, s.sk, s.n, r.part + CASE WHEN r.n > {SPLIT} OR r.size + 1 + s.n > {SPLIT} THEN 1 ELSE 0 END, CASE WHEN r.n > {SPLIT} OR r.size + 1 + s.n > {SPLIT} THEN s.n ELSE r.size + 1 + s.n END
  FROM r JOIN sent s ON s.doc_id = r.doc_id AND s.pk = r.pk AND s.sk = r.sk + 1) SELECT * FROM r),
hard AS (WITH RECURSIVE r AS (
  SELECT doc_id, pk, sk, 0 AS hk, '' AS piece, s AS rest FROM sent WHERE n > {SPLIT} UNION ALL
  SELECT doc_id, pk, sk, hk + 1, regexp_replace(rest[:c], '\s+$', ''), regexp_replace(rest[c + 1:], '^\s+', '') FROM (
    SELECT *, CASE WHEN length(rest) <= {SPLIT} THEN length(rest) WHEN contains(rest[2:{SPLIT}], ' ') THEN {SPLIT} - instr(reverse(rest[:{SPLIT}]), ' ') ELSE {SPLIT} END AS c FROM r WHERE rest <> '')) SELECT * FROM r WHERE hk > 0),
parts AS (SELECT doc_id, pk, min(sk) AS sk, 0 AS hk, string_agg(s, ' ' ORDER BY sk) AS body FROM pack JOIN sent USING (doc_id, pk, sk, n) WHERE n <= {SPLIT} GROUP BY doc_id, pk, part UNION ALL SELECT doc_id, pk, sk, hk, piece FROM hard)"""


@query(rf"WITH {_SPLIT} SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pk, sk, hk) - 1 AS part, length(body) AS n_chars, sha256(body) AS body_sha256 FROM parts")
def split_blocks(table):
    """Parts of at most 900 characters of every text: paragraphs, else runs of sentences, else words."""
    parts = splitting.split_blocks(table("documents"), "doc_id", "text", SPLIT)
    return parts.select("doc_id", F.col("part").cast("long").alias("part"), F.length("body").cast("long").alias("n_chars"), F.sha2("body", 256).alias("body_sha256"))


@query("""WITH RECURSIVE l AS (SELECT l_orderkey, '| ' || l_linenumber || ' | ' || l_partkey || ' | ' || l_shipdate::DATE || ' |' || CASE WHEN l_returnflag = 'R' THEN ' came back' ELSE '' END AS line, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS k FROM lineitem),
n AS (SELECT *, len(string_split(line, ' ')) AS n FROM l), r AS (
  SELECT l_orderkey, k, line, 0 AS part, n AS used FROM n WHERE k = 1 UNION ALL
  SELECT n.l_orderkey, n.k, n.line, r.part + CASE WHEN r.used + n.n > 16 THEN 1 ELSE 0 END, CASE WHEN r.used + n.n > 16 THEN n.n ELSE r.used + n.n END FROM r JOIN n ON n.l_orderkey = r.l_orderkey AND n.k = r.k + 1)
SELECT l_orderkey AS order_key, CAST(part AS BIGINT) AS part, min(k) - 1 AS first_row, count(*) AS n_rows, sha256('| line | part | shipped |' || chr(10) || '| --- | --- | --- |' || chr(10) || string_agg(line, chr(10) ORDER BY k)) AS body_sha256 FROM r GROUP BY 1, 2""")
def split_tables(table):
    """Every order as a table in markdown (an order has few lines), its rows dealt to parts of 30 tokens that repeat the header."""
    row = F.concat(F.lit("| "), F.concat_ws(" | ", "l_linenumber", "l_partkey", F.to_date("l_shipdate")), F.lit(" |"), F.when(F.col("l_returnflag") == "R", " came back").otherwise(""))
    lines = table("lineitem").groupBy(F.col("l_orderkey").alias("order_key")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", row.alias("line")))).alias("rows"))
    text = F.array_join(F.concat(F.array(F.lit("| line | part | shipped |"), F.lit("| --- | --- | --- |")), F.col("rows.line")), "\n")
    parts = splitting.split_tables(lines.select("order_key", text.alias("text")), "order_key", "text", 30)
    return parts.select("order_key", *(F.col(c).cast("long").alias(c) for c in ("part", "first_row", "n_rows")), F.sha2("body", 256).alias("body_sha256"))


def _digit_sql(weights: list[int]) -> str:
    return "(" + " + ".join(f"CAST(x[{i}] AS INT) * {w}" for i, w in enumerate(weights, 1)) + ") % 11 % 10"


_RIGHT = {
    "inn_ru": f"lambda x: CASE WHEN length(x) = 10 THEN CAST(x[10] AS INT) = {_digit_sql(personal.INN_10)} ELSE CAST(x[11] AS INT) = {_digit_sql(personal.INN_11)} AND CAST(x[12] AS INT) = {_digit_sql(personal.INN_12)} END",
    "snils_ru": "lambda x: CAST(x[10:11] AS INT) = (" + " + ".join(f"CAST(x[{i}] AS INT) * {10 - i}" for i in range(1, 10)) + ") % 101 % 100",
}
_FOUND = {k: f"regexp_extract_all(coalesce(text, ''), '{p}')" for k, p in personal.KINDS.items()}
_FOUND = {k: f"list_filter(list_transform({f}, lambda x: regexp_replace(x, '[^0-9]', '', 'g')), {_RIGHT[k]})" if k in _RIGHT else f for k, f in _FOUND.items()}


@query(f"""WITH d AS (SELECT doc_id, text FROM documents UNION ALL SELECT 1000000000 + event_id, 'ИНН ' || CAST(7700000000 + event_id AS VARCHAR) || ', СНИЛС 112-233-' || lpad(CAST(event_id % 1000 AS VARCHAR), 3, '0') || ' ' || lpad(CAST(event_id % 97 AS VARCHAR), 2, '0') FROM events),
n AS (SELECT doc_id, {", ".join(f"len({f}) AS {k}" for k, f in _FOUND.items())} FROM d)
SELECT *, CASE WHEN {" + ".join(k for k in personal.KINDS if k.endswith("_ru"))} > 0 THEN 'block' WHEN email > 0 THEN 'mask' ELSE 'pass' END AS verdict FROM n""")
def personal_data(table):
    """How many finds of each kind every document has, and every event as a text of two numbers, most of which have wrong check digits."""
    numbers = F.concat(F.lit("ИНН "), (F.lit(7_700_000_000) + F.col("event_id")).cast("string"), F.lit(", СНИЛС 112-233-"), F.lpad((F.col("event_id") % 1000).cast("string"), 3, "0"), F.lit(" "), F.lpad((F.col("event_id") % 97).cast("string"), 2, "0"))
    texts = table("documents").select("doc_id", "text").unionByName(table("events").select((F.col("event_id") + 1_000_000_000).alias("doc_id"), numbers.alias("text")))
    rows = personal.gate(personal.personal_data(texts, "doc_id", "text"), "input", [personal.ANY])
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(k)
    return rows.select("doc_id", *(count(k) for k in personal.KINDS), "verdict")
