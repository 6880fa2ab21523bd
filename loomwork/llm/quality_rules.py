"""Quality rules combined by weak supervision, in DataFrame functions only."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import cut

_SPACE = "\t\n\x0b\x0c\r "
_SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """Votes good where good holds, bad where bad holds (which wins), and abstains elsewhere."""

    name: str
    good: Column
    bad: Column


def text_counts(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_shouted, n_marks, n_commas_stops) of each row.

    Words are runs of other than white space (space, 0x09-0x0D). word_chars: code points in words. n_symbols:
    characters of #*$%&|<>. n_dup_lines: lines with a word that equal an earlier line. n_repeat_words: words
    inside 5-word windows that the text holds at least twice. All of it is computed inside the row, so a text
    of any length or a hot source needs no shuffle. A null text counts as empty: all counts are 0.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    t = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    t = t.withColumn("squeezed", F.btrim("text", F.lit(_SPACE)))
    t = t.withColumn("words", F.when(F.col("squeezed") == "", F.array().cast("array<string>")).otherwise(F.split("squeezed", "[\\x20\\x09-\\x0D]+")))
    grams = F.when(F.size("words") < 5, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(1), F.size("words") - 4), lambda i: F.xxhash64(F.slice("words", i, 5))))
    t = t.withColumn("grams", grams)
    # Windows found twice are next to each other once sorted; positions of all their words, each counted once.
    placed = F.array_sort(F.transform("grams", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
    t = t.withColumn("placed", F.when(F.size(F.array_distinct("grams")) < F.size("grams"), placed).otherwise(F.array().cast("array<struct<g:bigint,i:int>>")))
    twice = F.filter("placed", lambda x, k: (F.get("placed", k - 1)["g"] == x["g"]) | F.coalesce(F.get("placed", k + 1)["g"] == x["g"], F.lit(False)))
    t = t.withColumn("at", F.array_sort(F.transform(twice, lambda x: x["i"])))
    covered = F.aggregate(F.transform("at", lambda p, k: F.least(F.lit(5), F.coalesce(F.get("at", k + 1) - p, F.lit(5)))), F.lit(0).cast("long"), lambda s, x: s + x)
    lines = F.filter(F.split("text", "\n"), lambda s: s.rlike("[^\\x20\\x09-\\x0D]"))
    without = lambda chars: F.length("text") - F.length(F.translate("text", chars, ""))
    return t.withColumn("lines", lines).select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.translate("text", _SPACE, "")).cast("long").alias("word_chars"),
        without(_SYMBOLS).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        covered.alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        without("ABCDEFGHIJKLMNOPQRSTUVWXYZ").cast("long").alias("n_upper"),
        without("!?").cast("long").alias("n_marks"),
        without(".,").cast("long").alias("n_stops"),
    )


def default_rules() -> list[Rule]:
    """Thresholds are shares of words or characters, the same for every corpus.

    Junk mostly shows one sign only, so the rules that vote good abstain at the sight of any of them.
    """
    n, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    symbols, upper, marks = F.col("n_symbols") / n, F.col("n_upper") / chars, F.col("n_marks") / n
    stops, length = F.col("n_stops") / n, F.col("word_chars") / n
    dup = F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))
    repeat = F.col("n_repeat_words") / n
    plain = (symbols < 0.05) & (upper < 0.1) & (marks < 0.05)
    never = F.lit(False)
    return [
        Rule("sentences", plain & (stops > 0.03) & (stops < 0.5), stops < 0.01),
        Rule("words", plain & (length > 3) & (length < 8), (length < 2) | (length > 15)),
        Rule("repeated_words", plain & (repeat < 0.05) & (dup < 0.3), repeat > 0.15),
        Rule("repeated_lines", never, dup > 0.5),
        Rule("symbols", never, symbols > 0.2),
        Rule("shouting", never, upper > 0.3),
        Rule("marks", never, marks > 0.2),
    ]


def posterior(rules: list[str], accuracy: list[float], balance: float) -> Column:
    """P(good | votes) for votes 1, -1 and 0 (abstains) in the columns named rules; an abstention says nothing."""
    logit = F.lit(math.log(balance / (1 - balance)))
    for rule, right in zip(rules, accuracy, strict=True):
        logit = logit + F.col(rule) * math.log(right / (1 - right))
    return 1 / (1 + F.exp(-logit))


def fit(votes: DataFrame, rules: list[str], rounds: int = 30, balance: float = 0.5, start: float = 0.9, weight: float = 20.0, tolerance: float = 1e-4) -> list[float]:
    """The accuracy of each rule: how often its votes, where it votes, are right.

    Expectation-maximisation over the counts of vote patterns (at most 3 ** len(rules) rows, whatever the
    corpus): each round is one aggregation. Each accuracy starts at start, with the weight of so many votes, and
    stays from 0.55 to 0.99, so that no rule is turned round or decides alone. balance is the share of good texts
    taken for granted. No rows leave the start values.
    """
    patterns = cut(votes.groupBy(*rules).agg(F.count("*").alias("n")))
    accuracy = [start] * len(rules)
    for _ in range(rounds):
        p = patterns.withColumn("p", posterior(rules, accuracy, balance))
        right = [F.sum(F.when(F.col(r) == 1, F.col("n") * F.col("p")).when(F.col(r) == -1, F.col("n") * (1 - F.col("p")))).alias(f"{r}_right") for r in rules]
        voted = [F.sum(F.when(F.col(r) != 0, F.col("n"))).alias(f"{r}_voted") for r in rules]
        s = p.agg(*right, *voted).first()
        before = accuracy
        accuracy = [min(0.99, max(0.55, ((s[f"{r}_right"] or 0.0) + weight * start) / ((s[f"{r}_voted"] or 0) + weight))) for r in rules]
        if max(abs(x - y) for x, y in zip(before, accuracy, strict=True)) < tolerance:
            break
    return accuracy


def quality_rules(docs: DataFrame, rules: list[Rule] | None = None, least: float = 0.5) -> DataFrame:
    """text_counts of docs (doc_id, text), base_failed, quality (the posterior probability) and kept.

    base_failed: under 10 words, or over a fifth of them in repeated windows. kept: not base_failed and quality at
    least least. Rules vote or abstain; fit() estimates how far each may be trusted from their agreement over
    all rows, without labels. Ties of quality and least keep. Null and empty texts fail the base rule; repeated
    rows and null doc_ids are rows like others; no rows give no rows. Other columns are not read.
    """
    rules = rules or default_rules()
    names = [f"vote_{r.name}" for r in rules]
    counts = text_counts(docs)
    votes = {f"vote_{r.name}": F.when(F.coalesce(r.bad, F.lit(False)), -1).when(F.coalesce(r.good, F.lit(False)), 1).otherwise(0) for r in rules}
    counts = cut(counts.withColumns(votes).drop("n_upper", "n_marks", "n_stops", "n_lines"))
    accuracy, balance = fit(counts, names), 0.5
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return counts.withColumn("base_failed", failed).withColumn("quality", posterior(names, accuracy, balance)).withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= least))
