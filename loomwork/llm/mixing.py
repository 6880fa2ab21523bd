"""Mixing sources to target weights by hierarchical token budgets, in DataFrame functions only."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import cut, written

LEAF = ["domain", "lang", "source"]
#: Hexadecimal digits of a document's key by which a leaf is dealt into groups: 4096 of them.
_DIGITS = 3


def token_counts(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, source, n_tokens): tokens are runs of other than white space. Null lang, source: empty; null text: 0 tokens."""
    squeezed = F.btrim(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit("\t\n\x0b\x0c\r "))
    n = F.when(squeezed == "", 0).otherwise(F.size(F.split(squeezed, "[\\x20\\x09-\\x0D]+")))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")), n.cast("long").alias("n_tokens"))


def fill(nodes: DataFrame, parent: list[str], child: str, weight: str, capacity: str, budget: Column) -> Column:
    """Each node's part of its parent's budget: in proportion to weight, but no more than its capacity; what one cannot
    take goes to its siblings, in proportion again, and so on. Whole tokens, rounded down.

    With siblings by ascending capacity / weight, the ones that are full come first; the others share the rest.
    """
    ratio = F.when(F.col(weight) > 0, F.col(capacity) / F.col(weight))
    order = Window.partitionBy(*parent).orderBy(ratio.asc_nulls_last(), child)
    taken = F.coalesce(F.sum(F.when(F.col(weight) > 0, F.col(capacity))).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sharing = F.sum(weight).over(order.rowsBetween(0, Window.unboundedFollowing))
    level = F.when(F.col(weight) > 0, (budget - taken) / sharing)
    full = F.coalesce(ratio <= level, F.lit(False))
    shared = F.first(F.when(~full, level), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return F.when(full, F.col(capacity)).otherwise(F.floor(F.coalesce(F.col(weight) * shared, F.lit(0.0)))).cast("long")


def leaf_budgets(sizes: DataFrame, mixture: DataFrame, share: float, max_epochs: int) -> DataFrame:
    """(domain, lang, source, tokens, budget) of each leaf of mixture that has documents."""
    have = sizes.groupBy("lang", "source").agg(F.sum("n_tokens").alias("tokens"))
    leaves = cut(mixture.join(have, ["lang", "source"]).withColumn("capacity", F.col("tokens") * max_epochs))
    langs = leaves.groupBy("domain", "lang").agg(F.max("domain_weight").alias("domain_weight"), F.max("lang_weight").alias("lang_weight"), F.sum(F.when(F.col("source_weight") > 0, F.col("capacity")).otherwise(0)).alias("capacity"))
    domains = langs.groupBy("domain").agg(F.max("domain_weight").alias("domain_weight"), F.sum(F.when(F.col("lang_weight") > 0, F.col("capacity")).otherwise(0)).alias("capacity"))
    total = have.agg(F.floor(F.coalesce(F.sum("tokens"), F.lit(0)) * share).cast("long").alias("total"))
    domains = domains.crossJoin(F.broadcast(total)).withColumn("all", F.lit(1))
    domains = domains.withColumn("domain_budget", fill(domains, ["all"], "domain", "domain_weight", "capacity", F.col("total")))
    langs = langs.join(domains.select("domain", "domain_budget"), "domain")
    langs = langs.withColumn("lang_budget", fill(langs, ["domain"], "lang", "lang_weight", "capacity", F.col("domain_budget")))
    leaves = leaves.join(langs.select("domain", "lang", "lang_budget"), ["domain", "lang"])
    return leaves.withColumn("budget", fill(leaves, ["domain", "lang"], "source", "source_weight", "capacity", F.col("lang_budget"))).select(*LEAF, "tokens", "budget")


def _key(seed: int, epochs: Column) -> Column:
    """A document's place in the leaf's last epoch: other epochs and seeds give other orders."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epochs.cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))


def leaf_plan(sizes: DataFrame, mixture: DataFrame, share: float, max_epochs: int, seed: int) -> DataFrame:
    """(domain, lang, source, epochs, last_key): all documents of a leaf are taken epochs times, and once more those with a
    key up to last_key, the longest prefix of the seeded order that fits in what is left of the budget.

    Running sums go over 4096 groups of a leaf first, then over the documents of the one group where the budget
    ends, so that a leaf with a third of all documents is no window of its own.
    """
    budgets = leaf_budgets(sizes, mixture, share, max_epochs)
    whole = F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens"))).otherwise(0).cast("long")
    budgets = cut(budgets.withColumn("epochs", whole).withColumn("left", F.col("budget") - F.col("epochs") * F.col("tokens")))
    keyed = sizes.join(budgets.select(*LEAF, "epochs", "left"), ["lang", "source"]).withColumn("key", _key(seed, F.col("epochs"))).withColumn("group", F.substring("key", 1, _DIGITS))
    groups = keyed.groupBy(*LEAF, "left", "group").agg(F.sum("n_tokens").alias("n"))
    upto = F.sum("n").over(Window.partitionBy(*LEAF).orderBy("group").rowsBetween(Window.unboundedPreceding, 0))
    ends = groups.withColumn("upto", upto).where(F.col("upto") > F.col("left"))
    ends = ends.groupBy(*LEAF).agg(F.min_by(F.struct("group", (F.col("left") - F.col("upto") + F.col("n")).alias("room")), "group").alias("end")).select(*LEAF, "end.group", "end.room")
    # Documents with equal keys (those without a doc_id) are taken together or not at all: one row from here on.
    inside = keyed.join(ends, [*LEAF, "group"]).groupBy(*LEAF, "group", "room", "key").agg(F.sum("n_tokens").alias("n_tokens"))
    inside = inside.withColumn("used", F.sum("n_tokens").over(Window.partitionBy(*LEAF, "group").orderBy("key").rowsBetween(Window.unboundedPreceding, 0)))
    last = inside.where(F.col("used") <= F.col("room")).groupBy(*LEAF).agg(F.max("key").alias("key"))
    plan = budgets.select(*LEAF, "epochs").join(ends.select(*LEAF, "group"), LEAF, "left").join(last, LEAF, "left")
    return plan.select(*LEAF, "epochs", F.coalesce("key", "group", F.lit("")).alias("last_key"))


def mark(docs: DataFrame, plan: DataFrame, seed: int) -> DataFrame:
    """docs (doc_id, lang, source, ...) with domain and copies; leaves that plan lacks: null and 0."""
    prefix = f"plan_{uuid.uuid4().hex}_"  # no column of docs has such a name
    plan = plan.select(*(F.col(c).alias(prefix + c) for c in plan.columns))
    mine = lambda c: F.col(prefix + c)
    same = (F.coalesce(F.col("lang").cast("string"), F.lit("")) == mine("lang")) & (F.coalesce(F.col("source").cast("string"), F.lit("")) == mine("source"))
    names = [f"`{c}`" for c in docs.columns if c not in ("domain", "copies")]
    copies = F.coalesce(mine("epochs"), F.lit(0)) + F.when(_key(seed, mine("epochs")) <= mine("last_key"), 1).otherwise(0)
    return docs.join(plan, same, "left").select(*names, mine("domain").alias("domain"), copies.cast("long").alias("copies"))


def mix_sources(docs: DataFrame, mixture: DataFrame, max_epochs: int = 2, share: float = 0.6, seed: int = 17) -> DataFrame:
    """docs (doc_id, text, lang, source, ...) with domain and copies: how many times a document is taken.

    mixture (domain, lang, source, domain_weight, lang_weight, source_weight) is a tree: a domain's languages, their sources;
    each source belongs to one domain. The budget is share of all tokens of docs. Weights are propagated from
    the top; a source gives its tokens max_epochs times at most. What a leaf cannot give is taken from its siblings, in
    proportion to their weights, and only what they cannot give either from the siblings of its parent, as each
    node's capacity is the sum of its children's. In each leaf whole epochs come first, then the prefix of the
    next epoch's seeded order that fits in the rest of the budget, so a budget is missed by less than a document.

    Documents of leaves that mixture lacks get 0 copies; null lang and source count as empty texts, null texts have
    no tokens; ties in the order (repeated rows, and rows of a leaf without a doc_id) are taken together or not at all. No rows give no rows. Other
    columns are passed on, but those named domain and copies.
    """
    sizes = written(token_counts(docs), "mixing-sizes")
    plan = cut(leaf_plan(sizes, mixture, share, max_epochs, seed))
    return mark(docs, plan, seed)
