"""Exact deduplication by a tree of combining steps, none of which a hot text can overload.

Equal texts are those that are the same once white space (space, 0x09-0x0D) is deleted. A claim on a group of equal
texts is one number: the code points of the original text, then the smaller doc_id. Three steps take its maximum:

1. each task combines its own rows (the partial aggregate, before anything is shuffled);
2. what tasks send is merged by digest and salt, where the salt numbers the sending task: a text that every task holds
   meets in salts places, not in one;
3. the winners of the salts, at most salts for each text, are combined by digest.

The full text is part of the key at each step, so texts are compared whole, and a collision of digests joins nothing.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import written

_SPACE = " \t\n\x0b\x0c\r"
_CLAIM = "decimal(38,0)"  # a decimal, as it has room for both numbers and is combined in place by hash aggregates


def normalised(text: Column) -> Column:
    """text without white space; null is empty. Passes of replace are several times faster than one translation of every character."""
    return reduce(lambda t, c: F.replace(t, F.lit(c), F.lit("")), _SPACE, F.coalesce(text.cast("string"), F.lit("")))


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _number(n: int) -> Column:
    return F.lit(str(n)).cast(_CLAIM)


_STEP = 1 << 65  # doc_ids take 64 bits and a null


def _claim(text: Column, doc_id: Column) -> Column:
    """Greater for more code points, then for the smaller doc_id; null doc_ids come last."""
    place = F.coalesce(_number(1 << 63) - doc_id.cast(_CLAIM), _number(0))
    return (F.length(F.coalesce(text.cast("string"), F.lit(""))).cast(_CLAIM) * _number(_STEP) + place).cast(_CLAIM)


def _claimant(claim: Column) -> Column:
    place = (claim % _number(_STEP)).cast(_CLAIM)
    return F.when(place > 0, (_number(1 << 63) - place).cast("long"))


def _combined(rows: DataFrame, *key: str) -> DataFrame:
    return rows.groupBy(*key).agg(F.max("claim").alias("claim"), F.sum("size").alias("size"))


def combine(docs: DataFrame, salts: int = 256, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """(digest, content, claim, size) of each distinct text of docs: the three steps.

    The digest only says where texts meet, so that they can be sent on by it alone; any function of the text gives the same
    groups. Step 2 aggregates before its shuffle; step 3 moves by digest, so that texts of one digest can be counted in place.
    """
    content = normalised(F.col("text"))
    rows = docs.select(content.alias("content"), _claim(F.col("text"), F.col("doc_id")).alias("claim"), F.lit(1).cast("long").alias("size"))
    rows = rows.select(digest(F.col("content")).alias("digest"), "content", "claim", "size", (F.spark_partition_id() % salts).alias("salt"))
    return _combined(_combined(rows, "digest", "salt", "content").repartition("digest"), "digest", "content")


def exact_duplicates(docs: DataFrame, salts: int = 256, digest: Callable[[Column], Column] = sha256, most_hot: int = 10_000) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, digest) of each row of docs (doc_id, text), dropped ones too.

    Of equal texts, the row with the most code points in its original text, then the smallest doc_id, stays. digest is that of
    the text without white space. Groups go back to their rows by digest: one of more than a most_hot-th part of all rows (there
    are fewer than most_hot) by a broadcast of a row each, the others by a shuffle in which no digest has more rows than that.
    Where different texts share a digest, and only there, the text itself is joined too.

    Null texts are empty texts, and equal to texts of white space. A null doc_id stays only if no row of its text with as many
    code points has an id. Rows that repeat doc_id and length of the row that stays all stay; no rows give no rows; other columns
    are not read, whatever their names.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    content = normalised(F.col("text"))
    members = written(docs.select("doc_id", digest(content).alias("digest"), _claim(F.col("text"), F.col("doc_id")).alias("own")), "exact-members")
    groups = combine(docs, salts, digest)
    by_digest = groups.groupBy("digest").agg(F.count("*").alias("texts"), F.max("claim").alias("claim"), F.sum("size").alias("size"))
    by_digest = written(by_digest, "exact-groups")

    found = F.col("own").alias("own"), F.col("doc_id"), F.col("digest"), F.col("claim"), F.col("size")
    n = members.count()
    hot = by_digest.where((F.col("texts") == 1) & (F.col("size") * most_hot > n)).select("digest", "claim", "size")
    cold = by_digest.where((F.col("texts") == 1) & (F.col("size") * most_hot <= n)).select("digest", "claim", "size")
    parts = [
        members.join(F.broadcast(hot), "digest").select(*found),
        members.join(F.broadcast(hot), "digest", "left_anti").join(cold, "digest").select(*found),
    ]
    shared = by_digest.where("texts > 1").select("digest")
    if not shared.isEmpty():
        texts = docs.select("doc_id", content.alias("content"), _claim(F.col("text"), F.col("doc_id")).alias("own")).withColumn("digest", digest(F.col("content"))).join(shared, "digest", "left_semi")
        parts.append(texts.join(groups, ["digest", "content"]).select(*found))
    rows = reduce(DataFrame.unionByName, parts)
    return rows.select("doc_id", _claimant(F.col("claim")).alias("keep_id"), F.col("size").alias("group_size"), (F.col("own") == F.col("claim")).alias("kept"), "digest")
