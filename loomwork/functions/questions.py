"""What a question asks for: weighted search terms and the kind of answer."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Words that say nothing of what is sought.
STOP = ["a", "an", "and", "are", "can", "does", "for", "how", "is", "list", "show", "summarize", "tell", "the", "what", "when", "where", "which", "who", "why", "как", "где", "дай", "что", "это"]
#: Parts of a question that ask for tables, for quotes or for all of something.
MODES = {
    "table_mode": ["table", "таблиц", "column", "колонк", "header", "строк", "row"],
    "quote_mode": ["quote", "citation", "source", "цитат", "дослов", "источник"],
    "enumeration_mode": ["all", "list", "enumerate", "перечис", "спис", "какие", "все"],
}
#: What a term of each kind weighs.
QUOTED, ENTITY, PHRASE, WORD = 10.0, 8.0, 5.0, 2.0

#: A name: words with a capital, after a word that stands before them in the sentence.
_NAME = r"[\p{Ll}\p{N},;] (\p{Lu}[\p{L}\p{N}]*(?: \p{Lu}[\p{L}\p{N}]*)*)"
_PIECE = r"[\p{L}\p{N}]+|[^\p{L}\p{N}\s]+"


def _found(terms: Column, weight: float, first: int) -> Column:
    return F.transform(terms, lambda t, i: F.struct(F.lower(F.btrim(t, F.lit(" \t\n\r"))).alias("term"), F.lit(weight).alias("weight"), (F.lit(first).cast("long") + i).alias("place")))


def question_terms(questions: DataFrame, keys: list[str], text: str, most: int = 8, stop: list[str] = STOP) -> DataFrame:
    """(keys, terms, weights) of each question: its most heaviest terms, heaviest first, the earlier found one first among equals.

    Quoted passages weigh 10, names 8, pairs of content words next to each other 5 and content words 2; what is found again adds
    its weight. Content words are words of two characters or more that are no stop words; without a grammar, every one counts as
    a content word. All is in lower case. Terms are counted by question in a shuffle of narrow rows, so that long texts are no
    trouble. A question without terms has empty lists; questions that share their keys are one.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    words = F.transform(F.regexp_extract_all(t, F.lit(_PIECE), 0), F.lower)
    q = questions.select(*keys, t.alias("_t"), words.alias("_w"))
    content = lambda w: w.rlike(r"^[\p{L}\p{N}]{2,}$") & ~w.isin(stop)
    pairs = F.filter(F.arrays_zip(F.col("_w").alias("a"), F.slice("_w", F.lit(2), F.greatest(F.size("_w") - 1, F.lit(0))).alias("b")), lambda p: content(p["a"]) & F.coalesce(content(p["b"]), F.lit(False)))
    span = 1 << 40
    found = F.concat(
        _found(F.regexp_extract_all("_t", F.lit('"([^"]+)"'), 1), QUOTED, 0),
        _found(F.regexp_extract_all("_t", F.lit(_NAME), 1), ENTITY, span),
        _found(F.transform(pairs, lambda p: F.concat_ws(" ", p["a"], p["b"])), PHRASE, 2 * span),
        _found(F.filter("_w", content), WORD, 3 * span),
    )
    items = q.select(*keys, F.inline(found)).where((F.length("term") >= 2) & ~F.col("term").isin(stop))
    sums = items.groupBy(*keys, "term").agg(F.sum("weight").alias("weight"), F.min("place").alias("place"))
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("weight"), "place"))
    best = sums.withColumn("n", n).where(F.col("n") <= most).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("n", "term", "weight"))).alias("found"))
    same = [F.col(f"q.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    every = q.select(*keys).distinct().alias("q").join(best.alias("b"), same, "left")
    none = lambda c, kind: F.coalesce(F.col("found")[c], F.array().cast(f"array<{kind}>"))
    return every.select(*(F.col(f"q.{k}").alias(k) for k in keys), none("term", "string").alias("terms"), none("weight", "double").alias("weights"))


def modes(text: Column) -> dict[str, Column]:
    """Whether the question holds a part that asks for each kind of answer."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return {mode: reduce(or_, (F.contains(low, F.lit(p)) for p in parts)) for mode, parts in MODES.items()}


def term_weights(terms: list[str], weights: list[float], analyzed) -> dict[str, float]:
    """The weight of each term of an index in a search for terms: that of the heaviest one that holds it, in tenths. analyzed: a text's terms in the index."""
    out: dict[str, float] = {}
    for term, w in zip(terms, weights, strict=True):
        for t in analyzed(term):
            out[t] = max(out.get(t, 0.0), w / 10)
    return out
