"""Chunks of documents, built and brought up to date."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import materialize
from ..operators.policy import first_match
from ..sources import store
from .registry import query

MOST_CHARS = 8000


def policy(text: Column) -> Column:
    """metadata_only for texts that are too big to index whole or look like a dump of a table."""
    return first_match([(F.length(text) > MOST_CHARS, "metadata_only"), (F.regexp_count(text, F.lit(r"\|")) >= 10, "metadata_only")], "full_text")


def line_chunks(docs: DataFrame) -> DataFrame:
    """(doc_id, chunk, kind, body): a chunk for each line with text; of documents by metadata alone one with the start of the text."""
    lines = docs.where("policy = 'full_text'").select("doc_id", F.posexplode(F.split("text", "\n")).alias("chunk", "body")).where(F.btrim("body", F.lit(T.WHITE)) != "").withColumn("kind", F.lit("text"))
    alone = docs.where("policy = 'metadata_only'").select("doc_id", F.lit(0).alias("chunk"), F.substring("text", 1, 500).alias("body"), F.lit("file_summary").alias("kind"))
    return lines.unionByName(alone).select("doc_id", "chunk", "kind", "body")


_WHITE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


@query(rf"""WITH now AS (SELECT doc_id, text FROM documents WHERE lang IS DISTINCT FROM 'es'), old AS (SELECT doc_id, CASE WHEN length(text) % 3 = 0 THEN 'Draft. ' || text WHEN length(text) % 3 = 1 THEN '  ' || text || chr(10) ELSE text END AS text FROM documents WHERE lang IS DISTINCT FROM 'fr'),
h AS (SELECT *, trim(text, {_WHITE}) AS body, CASE WHEN length(text) > {MOST_CHARS} OR len(regexp_extract_all(text, '\|')) >= 10 THEN 'metadata_only' ELSE 'full_text' END AS policy FROM now),
o AS (SELECT *, trim(text, {_WHITE}) AS body, CASE WHEN length(text) > {MOST_CHARS} OR len(regexp_extract_all(text, '\|')) >= 10 THEN 'metadata_only' ELSE 'full_text' END AS policy FROM old),
b AS (SELECT h.doc_id, h.policy, CASE WHEN o.doc_id IS NOT NULL AND o.body = h.body AND o.policy = h.policy THEN 1 ELSE 2 END AS build, CASE WHEN o.body = h.body AND o.policy = h.policy THEN o.text ELSE h.text END AS text FROM h LEFT JOIN o USING (doc_id))
SELECT doc_id, policy, CAST(build AS INT) AS build, CASE WHEN policy = 'metadata_only' THEN 1 ELSE len(list_filter(string_split(text, chr(10)), lambda x: trim(x, {_WHITE}) <> '')) END AS n_chunks FROM b""")
def chunk_builds(table):
    """In which of two builds each document's chunks were made: the first saw drafts of some texts, lacked one language and had another that is gone."""
    docs = table("documents").select("doc_id", "text", "lang")
    kind = F.length("text") % 3
    draft = F.when(kind == 0, F.concat(F.lit("Draft. "), "text")).when(kind == 1, F.concat(F.lit("  "), "text", F.lit("\n"))).otherwise(F.col("text"))
    path = f"{store.shared_dir(docs.sparkSession)}/chunk-builds-{uuid.uuid4().hex}"
    for version in (docs.where("not lang <=> 'fr'").withColumn("text", draft), docs.where("not lang <=> 'es'")):
        materialize.refresh(version, "doc_id", "text", policy(F.col("text")), line_chunks, path)
    return materialize.pages(docs.sparkSession, path, "doc_id").select("doc_id", "policy", "build", "n_chunks")
