"""One query for each operator of this subpackage, over its whole table, and its SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ann import nearest_neighbours
from .byte_cnn import classify_documents
from .chat_trie import conversation_digests, prefix_tree
from .exact_dedup import exact_duplicates
from .fill_in_middle import fill_in_middle, restored
from .importance import importance_resample
from .lm_scoring import score_texts
from .mixing import leaf_plan, mark, token_counts
from .near_dup import near_duplicates
from .packing import best_fit_packing
from .quality_rules import quality_rules
from .store import cut, written
from .substring_dedup import remove_repeats
from .url_filter import UrlRule, host_of, url_filter

SIZE, END = 1024, 2


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_sentences, n_removed, removed, and the text that is left."""
    return remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    probe = "</s>[INST] ok [/INST]"
    rows = rows.unionByName(spark.createDataFrame([(-1, 0, "user", probe), (-1, 1, "assistant", probe)], rows.schema))
    ranks = tokenizer("byte_bpe_50k.tiktoken")
    return conversation_digests(*prefix_tree(rows, ranks), ranks)


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), k=2)


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return classify_documents(docs, table(spark, sf_dir, "labels"), with_text=False)


def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.tiktoken"))


MIX_SHARE, MIX_EPOCHS, MIX_SEED = 0.6, 2, 17


def mixture(docs: DataFrame) -> DataFrame:
    """A tree of four domains over the languages and sources of docs, with weights by name and number."""
    number = F.coalesce(F.regexp_extract("source", "([0-9]{1,6})$", 1).try_cast("int"), F.lit(0))
    leaves = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    return leaves.select(
        F.concat(F.lit("d"), (number % 4).cast("string")).alias("domain"),
        "lang",
        "source",
        (4 - number % 4).cast("long").alias("domain_weight"),
        F.when(F.col("lang") == "en", 5).when(F.col("lang").isin("de", "fr"), 2).otherwise(1).cast("long").alias("lang_weight"),
        (1 + number % 3).cast("long").alias("source_weight"),
    )


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sizes = written(token_counts(docs), "mixing-sizes")
    plan = cut(leaf_plan(sizes, mixture(docs), MIX_SHARE, MIX_EPOCHS, MIX_SEED))
    return mark(sizes, plan, MIX_SEED).select("doc_id", "domain", "lang", "source", "n_tokens", "copies")


OP8_SQL = """
WITH sizes AS (
  SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS n_tokens
  FROM documents),
have AS (
  SELECT lang, source, CAST(sum(n_tokens) AS BIGINT) AS tokens, coalesce(TRY_CAST(regexp_extract(source, '([0-9]{1,6})$', 1) AS INT), 0) AS number
  FROM sizes GROUP BY lang, source),
leaves AS (
  SELECT 'd' || (number % 4) AS domain, lang, source, 4 - number % 4 AS domain_weight,
         CASE WHEN lang = 'en' THEN 5 WHEN lang IN ('de', 'fr') THEN 2 ELSE 1 END AS lang_weight, 1 + number % 3 AS source_weight,
         tokens, tokens * 2 AS capacity FROM have),
langs AS (SELECT domain, lang, max(domain_weight) AS domain_weight, max(lang_weight) AS lang_weight, CAST(sum(capacity) AS BIGINT) AS capacity FROM leaves GROUP BY domain, lang),
domains AS (SELECT domain, max(domain_weight) AS w, CAST(sum(capacity) AS BIGINT) AS capacity FROM langs GROUP BY domain),
total AS (SELECT CAST(floor(sum(tokens) * CAST(0.6 AS DOUBLE)) AS BIGINT) AS total FROM have),
d1 AS (
  SELECT domain, w, capacity, CAST(capacity AS DOUBLE) / w AS ratio,
         CAST(total - coalesce(sum(capacity) OVER (ORDER BY CAST(capacity AS DOUBLE) / w, domain ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
           / sum(w) OVER (ORDER BY CAST(capacity AS DOUBLE) / w, domain ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM domains, total),
d2 AS (SELECT *, (SELECT arg_min(level, (ratio, domain)) FROM d1 WHERE ratio > level) AS shared FROM d1),
d3 AS (SELECT domain, CASE WHEN ratio <= level THEN capacity ELSE CAST(floor(w * shared) AS BIGINT) END AS budget FROM d2),
l1 AS (
  SELECT domain, lang, lang_weight AS w, capacity, CAST(capacity AS DOUBLE) / lang_weight AS ratio,
         CAST(budget - coalesce(sum(capacity) OVER (PARTITION BY domain ORDER BY CAST(capacity AS DOUBLE) / lang_weight, lang ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
           / sum(lang_weight) OVER (PARTITION BY domain ORDER BY CAST(capacity AS DOUBLE) / lang_weight, lang ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM langs JOIN d3 USING (domain)),
l2 AS (SELECT a.*, b.shared FROM l1 a LEFT JOIN (SELECT domain, arg_min(level, (ratio, lang)) AS shared FROM l1 WHERE ratio > level GROUP BY domain) b USING (domain)),
l3 AS (SELECT domain, lang, CASE WHEN ratio <= level THEN capacity ELSE CAST(floor(w * shared) AS BIGINT) END AS budget FROM l2),
s1 AS (
  SELECT domain, lang, source, source_weight AS w, tokens, capacity, CAST(capacity AS DOUBLE) / source_weight AS ratio,
         CAST(budget - coalesce(sum(capacity) OVER (PARTITION BY domain, lang ORDER BY CAST(capacity AS DOUBLE) / source_weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
           / sum(source_weight) OVER (PARTITION BY domain, lang ORDER BY CAST(capacity AS DOUBLE) / source_weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM leaves JOIN l3 USING (domain, lang)),
s2 AS (SELECT a.*, b.shared FROM s1 a LEFT JOIN (SELECT domain, lang, arg_min(level, (ratio, source)) AS shared FROM s1 WHERE ratio > level GROUP BY domain, lang) b USING (domain, lang)),
s3 AS (SELECT domain, lang, source, tokens, CASE WHEN ratio <= level THEN capacity ELSE CAST(floor(w * shared) AS BIGINT) END AS budget FROM s2),
s4 AS (SELECT *, CASE WHEN tokens > 0 THEN budget // tokens ELSE 0 END AS epochs FROM s3),
keyed AS (
  SELECT z.*, s4.domain, s4.epochs, s4.budget - s4.epochs * s4.tokens AS room,
         md5(concat_ws(':', '17', CAST(epochs AS VARCHAR), coalesce(CAST(doc_id AS VARCHAR), ''))) AS key
  FROM sizes z JOIN s4 USING (lang, source))
SELECT doc_id, domain, lang, source, n_tokens,
       epochs + CASE WHEN sum(n_tokens) OVER (PARTITION BY lang, source ORDER BY key RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) <= room THEN 1 ELSE 0 END AS copies
FROM keyed
"""


URL_RULES = [UrlRule("block", "net", "/"), UrlRule("allow", "example.net", "/en/"), UrlRule("block", "example.com", "/de/"), UrlRule("allow", "org", "/fr/")]


def thin_urls(pages: DataFrame) -> DataFrame:
    """(url): those of pages with three symbols in a row, or with at most two paragraphs; a share of them that does not fade with their number."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    return pages.where(html.rlike("[#*$%]{3}") | (F.regexp_count(html, F.lit("<p>")) <= 2)).select("url")


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return url_filter(pages, URL_RULES, thin_urls(pages), by="url")


OP9_SQL = """
WITH p AS (
  SELECT page_id, url,
         translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
b AS (SELECT url FROM pages WHERE (regexp_matches(coalesce(html, ''), '[#*$%]{3}') OR len(regexp_extract_all(coalesce(html, ''), '<p>')) <= 2) AND url IS NOT NULL),
r(rule_host, rule_path, rule_verdict) AS (
  VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
m AS (
  SELECT p.page_id, p.url, p.host, p.path, r.rule_host || r.rule_path AS rule, r.rule_verdict,
         row_number() OVER (PARTITION BY p.page_id, p.url ORDER BY length(r.rule_host || r.rule_path) DESC NULLS LAST) AS k
  FROM p LEFT JOIN r ON (p.host = r.rule_host OR ends_with(p.host, '.' || r.rule_host)) AND starts_with(p.path, r.rule_path))
SELECT page_id, host, path, rule,
       coalesce(rule_verdict, CASE WHEN url IN (SELECT url FROM b) THEN 'block' ELSE 'allow' END) AS verdict
FROM m WHERE k = 1
"""


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), SIZE, END)


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = exact_duplicates(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP11_SQL = """
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS norm
  FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       row_number() OVER w = 1 AS kept, sha256(norm) AS text_sha256
FROM t WINDOW w AS (PARTITION BY norm ORDER BY n DESC, doc_id NULLS LAST)
"""


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fill_in_middle(table(spark, sf_dir, "documents"))
    digests = [F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256")]
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


OP12_SQL = """
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\n]*\\n|[^\\n]+') AS lines,
         sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents),
d AS (
  SELECT *, len(lines) AS n, CAST('0x' || h[1:8] AS BIGINT) % (len(lines) + 1) AS a, CAST('0x' || h[9:16] AS BIGINT) % (len(lines) + 1) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR CAST('0x' || h[17:24] AS BIGINT) % 100 >= 100 THEN 'plain'
              WHEN CAST('0x' || h[25:32] AS BIGINT) % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM t),
p AS (
  SELECT *, array_to_string(lines[:least(a, b)], '') AS prefix, array_to_string(lines[least(a, b) + 1:greatest(a, b)], '') AS middle,
         array_to_string(lines[greatest(a, b) + 1:], '') AS suffix
  FROM d),
o AS (
  SELECT *, CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                 ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END AS output FROM p)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars, sha256(output) AS output_sha256, sha256(text) AS restored_sha256
FROM o
"""


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = importance_resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return rows.select("doc_id", "n_features", "weight", "score", "rank")


#: The checksum runs over the bytes of each distinct feature; its table follows from the polynomial.
OP13_SQL = """
WITH crc_table AS (
  SELECT list(list_reduce(range(8), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, b) ORDER BY b) AS crcs
  FROM range(256) t(b)),
texts AS (SELECT true AS raw, doc_id AS id, text FROM documents UNION ALL SELECT false, item_id, text FROM benchmark),
w AS (
  SELECT raw, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM texts),
one AS (SELECT raw, id, unnest(w) AS feature FROM w),
two AS (SELECT raw, id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS feature FROM w),
f AS (SELECT raw, id, feature, count(*) AS n FROM (SELECT * FROM one UNION ALL SELECT * FROM two) GROUP BY ALL),
spelled AS (SELECT feature, hex(encode(feature)) AS x FROM (SELECT DISTINCT feature FROM f)),
crc AS (
  SELECT feature, xor(4294967295, list_reduce(list_transform(range(octet_length(encode(feature))), lambda i: CAST('0x' || x[2 * i + 1:2 * i + 2] AS BIGINT)),
    lambda c, byte: xor(c >> 8, crcs[(xor(c, byte) & 255) + 1]), 4294967295)) AS crc
  FROM spelled, crc_table),
b AS (SELECT raw, id, crc % 10000 AS bucket, n FROM f JOIN crc USING (feature)),
c AS (SELECT bucket, coalesce(sum(n) FILTER (raw), 0) AS s, coalesce(sum(n) FILTER (NOT raw), 0) AS t FROM b GROUP BY 1),
g AS (SELECT bucket, floor(1000 * ln((t + 1) * ((SELECT sum(s) FROM c) + 10000) / ((s + 1) * ((SELECT sum(t) FROM c) + 10000))::DOUBLE)) AS gain FROM c),
x AS (SELECT id AS doc_id, sum(n) AS n, sum(n * gain) AS total FROM b JOIN g USING (bucket) WHERE raw GROUP BY 1),
s AS (
  SELECT doc_id, len(w) AS n_words, CAST(coalesce(x.n, 0) AS BIGINT) AS n_features, CAST(coalesce(floor(total / x.n), 0) AS BIGINT) AS weight,
         CAST(floor(-1000 * ln(-ln((CAST('0x' || sha256('7:' || w.id)[1:8] AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS noise
  FROM w LEFT JOIN x ON w.id = x.doc_id WHERE w.raw),
r AS (SELECT *, weight + noise AS score, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY weight + noise DESC, doc_id) AS k, count(*) FILTER (n_words >= 20) OVER () AS long_docs FROM s)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND k <= 25 * long_docs // 100 THEN k END AS rank
FROM r
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_chat_formatting": op2_chat_formatting,
    "op3_near_duplicates": op3_near_duplicates,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_nearest_neighbours": op5_nearest_neighbours,
    "op6_quality_rules": op6_quality_rules,
    "op7_lm_scoring": op7_lm_scoring,
    "op8_source_mixing": op8_source_mixing,
    "op9_url_filter": op9_url_filter,
    "op10_best_fit_packing": op10_best_fit_packing,
    "op11_exact_dedup": op11_exact_dedup,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_importance_resampling": op13_importance_resampling,
}

ORACLE_SQL: dict[str, str] = {"op8_source_mixing": OP8_SQL, "op9_url_filter": OP9_SQL, "op11_exact_dedup": OP11_SQL, "op12_fill_in_middle": OP12_SQL, "op13_importance_resampling": OP13_SQL}
