"""URL filters: longest-match rules, and exact lists as a cascade of Bloom filters."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import cut

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bits of a bitmap of bitmap_construct_agg.
_BUCKET = 32_768
#: Keys for each task at least: levels shrink, and so does the number of their tasks.
_TASK_KEYS = 1 << 16


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null or without ://."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end; empty for null or without ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


@dataclass
class Cascade:
    """levels[i]: a bitmap and its seed. Odd levels (from 1) hold listed keys, even ones the others that came through."""

    bits: int
    levels: list[tuple[np.ndarray, int]] = field(default_factory=list)
    shard: int = 0
    shards: int = 1


def _places(h1: Column, h2: Column, seed: int, hashes: int, size: int) -> Column:
    """The bits that a key sets in a level: double hashing of two 64-bit hashes, other ones for each level."""
    base, step = F.pmod(F.xxhash64(h1, h2, F.lit(seed)), F.lit(1 << 40)), F.pmod(F.xxhash64(h2, h1, F.lit(seed)), F.lit(1 << 40))
    return F.array(*(F.pmod(base + F.lit(i) * step, F.lit(size)) for i in range(hashes)))


def _seen(bitmap: np.ndarray, places: np.ndarray) -> np.ndarray:
    return (bitmap[places >> 3] >> (places & 7).astype(np.uint8) & 1).astype(bool)


def _passes(h1: Column, h2: Column, level: tuple, hashes: int) -> Column:
    shared, seed, size = level

    @F.pandas_udf("boolean")
    def test(*places: pd.Series) -> pd.Series:
        bitmap = shared.value
        out = np.ones(len(places[0]), bool)
        for p in places:
            out &= _seen(bitmap, p.to_numpy())
        return pd.Series(out)

    return test(*(_places(h1, h2, seed, hashes, size)[i] for i in range(hashes)))


def _passing(keys: DataFrame, level: tuple, hashes: int) -> DataFrame:
    """The keys (h1, h2, listed) that pass a level. No filter, as one would go below coalesce and start Python for each part."""
    shared, seed, size = level

    def passing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = shared.value
        for batch in batches:
            out = np.ones(batch.num_rows, bool)
            for i in range(hashes):
                out &= _seen(bitmap, batch[f"p{i}"].to_numpy())
            yield batch.select(["h1", "h2", "listed"]).filter(pa.array(out))

    places = _places(F.col("h1"), F.col("h2"), seed, hashes, size)
    return keys.select("h1", "h2", "listed", *(places[i].alias(f"p{i}") for i in range(hashes))).mapInArrow(passing, "h1 long, h2 long, listed boolean")


def _level(keys: DataFrame, n: int, seed: int, hashes: int, bits_per_key: float) -> tuple[np.ndarray, int]:
    """A Bloom filter of keys (h1, h2): bitmaps of 4 KB are built by Spark, pre-aggregated in each task."""
    size = max(64, math.ceil(n * bits_per_key))
    places = keys.select(F.explode(F.transform(_places(F.col("h1"), F.col("h2"), seed, hashes, size), lambda p: p + 1)).alias("p"))
    maps = places.groupBy(F.bitmap_bucket_number("p").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("map"))
    bitmap = np.zeros((size + _BUCKET) // 8 + 1, np.uint8)
    # Spark's bitmaps count positions from 1: bucket 1 holds 1 to 32,768. One job for all partitions; most_bytes bounds the whole.
    for batch in maps.toArrow().to_batches():
        for bucket, part in zip(batch["bucket"].to_pylist(), batch["map"], strict=True):
            at = (bucket - 1) * _BUCKET // 8
            bitmap[at : at + _BUCKET // 8] |= np.frombuffer(part.as_buffer(), np.uint8)
    return bitmap, size


def _sizes(keys: DataFrame) -> tuple[int, int]:
    """Numbers of listed and other keys."""
    n = {row["listed"]: row["count"] for row in keys.groupBy("listed").count().collect()}
    return n.get(True, 0), n.get(False, 0)


def _gathered(keys: DataFrame, n: int) -> DataFrame:
    """keys, n in number, in no more tasks than they fill; nothing is shuffled."""
    return keys.coalesce(max(1, math.ceil(n / _TASK_KEYS)))


def build_cascade(keys: DataFrame, bits_per_key: float = 6.0, hashes: int = 3, most_bytes: int = 64 << 20, most_levels: int = 60) -> list[Cascade]:
    """Filter cascades for keys (key, listed), the whole universe of keys that will ever be asked for.

    Level 1 holds the listed keys; level 2 the other keys that pass level 1; level 3 the listed keys that pass
    level 2; and so on until nothing passes wrongly, so that membership is exact over the universe. Deeper levels
    are geometrically smaller. A level's bits number bits_per_key times its keys, so the whole is proportional
    to the list. Where the first level alone would take over most_bytes, keys are dealt by hash into shards, each with
    a cascade of its own of about that size, which are asked one after the other: what is broadcast at once stays
    bounded. Repeated keys count once, listed if any row is; null keys are left out.
    """
    spark = keys.sparkSession
    keys = keys.where("key is not null").groupBy("key").agg(F.max(F.coalesce(F.col("listed"), F.lit(False))).alias("listed"))
    keys = cut(keys.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("second"), F.col("key")).alias("h2"), "listed"))
    n, others = _sizes(keys)
    keys = _gathered(keys, n + others)
    shards = max(1, math.ceil(n * bits_per_key / 8 / most_bytes))
    out = []
    for shard in range(shards):
        own = keys.where(F.pmod("h1", F.lit(shards)) == shard) if shards > 1 else keys
        inside, outside = own.where("listed"), own.where(~F.col("listed"))
        left = _sizes(own)[0] if shards > 1 else n
        cascade = Cascade(0, shard=shard, shards=shards)
        while left and len(cascade.levels) < most_levels:
            seed = len(cascade.levels) + 1
            bitmap, size = _level(inside, left, seed, hashes, bits_per_key)
            shared = spark.sparkContext.broadcast(bitmap)
            cascade.levels.append((shared, seed, size))
            cascade.bits += size
            passed = cut(_passing(outside, cascade.levels[-1], hashes))
            left = passed.count()
            inside, outside = _gathered(passed, left), inside
        if left:
            raise RuntimeError("keys with equal 128-bit hashes cannot be told apart")
        out.append(cascade)
    return out


def listed(df: DataFrame, key: str, cascades: list[Cascade], hashes: int = 3, name: str = "listed") -> DataFrame:
    """df with name: is its key (of the cascades' universe) listed? Without a join; a null key is not listed."""
    h1, h2 = F.xxhash64(F.col(key)), F.xxhash64(F.lit("second"), F.col(key))
    parts = []
    for c in cascades:
        mine = F.pmod(h1, F.lit(c.shards)) == c.shard
        # A key's place is the first level that it fails: after an odd number of levels it is not listed.
        verdict = F.lit(len(c.levels) % 2 == 1)
        for i in range(len(c.levels) - 1, -1, -1):
            verdict = F.when(_passes(h1, h2, c.levels[i], hashes), verdict).otherwise(F.lit(i % 2 == 1))
        verdict = verdict & F.col(key).isNotNull()
        parts.append((df.where(mine) if c.shards > 1 else df).withColumn(name, verdict))
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


@dataclass(frozen=True)
class UrlRule:
    verdict: str
    host: str
    path: str


def longest_rule(rules: list[UrlRule], host: Column, path: Column) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls. A rule fits its host and subdomains, if path starts with its own."""
    if len(rules) > 1000:
        raise ValueError("rules become one expression; a list of that length is one for the cascade")
    rule = verdict = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.host + r.path), r.host, r.path)):
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        rule, verdict = F.when(fits, r.host + r.path).otherwise(rule), F.when(fits, r.verdict).otherwise(verdict)
    return rule, verdict


def universe(pages: DataFrame, block_list: DataFrame, by: str) -> DataFrame:
    """(key, listed) of every host or url (by) that pages or block_list have."""
    keys = host_of(F.col("url").cast("string")) if by == "host" else F.col(by).cast("string")
    return pages.select(keys.alias("key"), F.lit(False).alias("listed")).unionByName(block_list.select(F.col(by).cast("string").alias("key"), F.lit(True).alias("listed")))


def url_filter(pages: DataFrame, rules: list[UrlRule], block_list: DataFrame, by: str = "host") -> DataFrame:
    """(page_id, host, path, rule, verdict) of each row of pages (page_id, url).

    verdict: allow or block, that of the longest rule that fits, else block if the host (by host) or the whole url (by url) is in
    block_list, which has a column of that name, else allow. The list is asked through a filter cascade over all hosts or urls of
    pages. A null url, or one without ://, has an empty host and path; so has an empty url. A null url is in no list of urls.
    Repeated rows and null page_ids are rows like others; an empty list blocks nothing; nulls in it and its other columns are not
    read, nor are those of pages.
    """
    asked = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"))
    asked = asked.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    judged = listed(asked, by, build_cascade(universe(pages, block_list, by)))
    rule, verdict = longest_rule(rules, F.col("host"), F.col("path"))
    return judged.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"))
