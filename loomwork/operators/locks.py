"""Windows that begin with the first event after the last window: counters with a time to live, and the locks that they set.

What ends one window begins the next, so windows are a chain. Of each event the one that would begin the next window is found in
slices of time; chains then start wherever a window must, and grow by jumps that double in each round. Neither a key nor a long
chain is walked through by one task, and the rounds number the logarithm of the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources import store


def _slices(df: DataFrame, length: int) -> DataFrame:
    return df.withColumn("slice", F.floor(F.col("t") / length))


def _successors(times: DataFrame, length: int) -> DataFrame:
    """(key, t, next, safe) of distinct (key, t): the first t at least length later; safe: nothing lies less than length before t."""
    rows = _slices(times, length)
    spans = rows.groupBy("key", "slice").agg(F.min("t").alias("first"), F.max("t").alias("last"))
    # A row for each slice of a key that has events.
    order = Window.partitionBy("key").orderBy("slice")
    spans = spans.withColumn("after", F.lead("first").over(order))
    # An event asks for t + length in the next slice, where events at or after it are behind it in order.
    asked = rows.select("key", "t", (F.col("t") + length).alias("v"), (F.col("slice") + 1).alias("slice"), F.lit(1).alias("asks"))
    both = asked.unionByName(rows.select("key", "t", F.col("t").alias("v"), "slice", F.lit(0).alias("asks")))
    in_slice = Window.partitionBy("key", "slice").orderBy("v", F.desc("asks"))
    found = F.min(F.when(F.col("asks") == 0, F.col("v"))).over(in_slice.rowsBetween(0, Window.unboundedFollowing))
    # The last event before is in the same slice or the one before.
    earlier = F.max(F.when(F.col("asks") == 0, F.col("v"))).over(Window.partitionBy("key", "slice").orderBy("v").rangeBetween(Window.unboundedPreceding, -1))
    both = both.withColumn("found", found).withColumn("earlier", earlier)
    here = both.where("asks = 0").select("key", "t", "slice", "earlier")
    beyond = both.where("asks = 1").select("key", "t", "found", "slice")
    previous = spans.select("key", (F.col("slice") + 1).alias("slice"), F.col("last").alias("_last"))
    here = here.join(previous, ["key", "slice"], "left").select("key", "t", (F.col("t") - F.coalesce("earlier", "_last", F.col("t") - length) >= length).alias("safe"))
    # Without one in the next slice it is the first of the slice after: of the next slice itself, or of this one if that is empty.
    after_next = spans.select("key", "slice", F.col("after").alias("_next_after"), F.lit(True).alias("_there"))
    after_own = spans.select("key", (F.col("slice") + 1).alias("slice"), F.col("after").alias("_own_after"))
    beyond = beyond.join(after_next, ["key", "slice"], "left").join(after_own, ["key", "slice"], "left")
    beyond = beyond.select("key", "t", F.coalesce("found", F.when(F.col("_there"), F.col("_next_after")).otherwise(F.col("_own_after"))).alias("next"))
    return here.join(beyond, ["key", "t"])


def _chains(jumps: DataFrame) -> DataFrame:
    """(key, t) of the starts of windows: safe ones, and what jumps reach from them."""
    jump = store.written(jumps.select("key", "t", "next"), "lock-jumps")
    reached = store.written(jumps.where("safe").select("key", "t"), "lock-starts")
    n = reached.count()
    while True:
        further = reached.join(jump, ["key", "t"]).where("next is not null").select("key", F.col("next").alias("t"))
        reached = store.written(reached.unionByName(further).distinct(), "lock-starts")
        before, n = n, reached.count()
        if n == before:
            return reached
        twice = jump.select("key", F.col("t").alias("next"), F.col("next").alias("_n"))
        jump = store.written(jump.where("next is not null").join(twice, ["key", "next"]).where("_n is not null").select("key", "t", F.col("_n").alias("next")), "lock-jumps")


def failure_windows(events: DataFrame, key: str, millis: str, length: int = 900_000, most: int = 10) -> DataFrame:
    """(key, window_start, failures, locked_at, locked_until), in milliseconds, of every window of each key.

    A window begins with a failure that is in no earlier window, and lasts length milliseconds. At the failure that is the most-th of its
    window the key is locked, and for length milliseconds from each further one in it. Failures at the same time all count; null keys and
    times are left out.
    """
    times = events.where(F.col(key).isNotNull() & F.col(millis).isNotNull()).groupBy(F.col(key).alias("key"), F.col(millis).alias("t")).agg(F.count("*").alias("n"))
    times = store.written(times, "lock-times")
    starts = _slices(_chains(_successors(times.select("key", "t"), length)), length)
    # A window reaches into the next slice: its start is put there too.
    reach = starts.withColumn("_at", F.explode(F.array(F.lit(0), F.lit(1)))).select("key", F.col("t").alias("v"), (F.col("slice") + F.col("_at")).alias("slice"), F.col("t").alias("start"), F.lit(0).cast("long").alias("n"))
    both = _slices(times, length).select("key", F.col("t").alias("v"), "slice", F.lit(None).cast("long").alias("start"), "n").unionByName(reach)
    upto = Window.partitionBy("key", "slice").orderBy("v").rangeBetween(Window.unboundedPreceding, 0)
    placed = both.withColumn("window_start", F.max("start").over(upto)).where("n > 0").select("key", "window_start", F.col("v").alias("t"), "n")
    counts = placed.groupBy("key", "window_start").agg(F.sum("n").alias("failures"), F.max("t").alias("last"))
    first = Window.partitionBy("key", "window_start").orderBy("t")
    reached = placed.withColumn("k", F.row_number().over(first)).where(F.col("k") <= most)  # as many times are enough
    reached = reached.withColumn("upto", F.sum("n").over(first.rowsBetween(Window.unboundedPreceding, 0))).where(F.col("upto") >= most).groupBy("key", "window_start").agg(F.min("t").alias("locked_at"))
    return counts.join(reached, ["key", "window_start"], "left").select(F.col("key").alias(key), "window_start", "failures", "locked_at", F.when(F.col("locked_at").isNotNull(), F.col("last") + length).alias("locked_until"))
