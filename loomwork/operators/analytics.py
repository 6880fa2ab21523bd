"""Aggregates over activity: days, calendars, percentiles, concurrency, sessions, counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def local_day(ts: Column, hours: int = 0) -> Column:
    """The day of a UTC time in a zone so many hours ahead."""
    return F.date_trunc("day", ts + F.make_dt_interval(F.lit(0), F.lit(hours), F.lit(0), F.lit(0)))


def millis(ts: str) -> Column:
    """Milliseconds since 1970 of a time with or without a zone, UTC."""
    return F.unix_millis(F.col(ts).cast("timestamp"))


def gap_filled(df: DataFrame, day: str, counts: list[str]) -> DataFrame:
    """A row for each day from the first to the last, with 0 where df has none. One row a day: the calendar stays small."""
    span = df.agg(F.min(day).alias("lo"), F.max(day).alias("hi"))
    calendar = span.select(F.explode(F.sequence("lo", "hi", F.expr("interval 1 day"))).alias(day))
    return calendar.join(df, day, "left").select(day, *(F.coalesce(c, F.lit(0)).alias(c) for c in counts))


def nearest_rank(df: DataFrame, by: list[str], value: str, percents: list[int], buckets: int = 4096) -> DataFrame:
    """Nearest-rank percentiles of each group, exact: equal values are counted first, a histogram finds the bucket that holds a
    rank, and only that bucket's values are put in order. So no task orders a group; nulls and NaN take no part."""
    counts = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).groupBy(*by, F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
    spans = counts.groupBy(*by).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.sum("_n").alias("_total"))
    width = F.col("_hi") - F.col("_lo")
    bucket = F.when(width > 0, F.least(F.floor((F.col("_v") - F.col("_lo")) / width * buckets), F.lit(buckets - 1))).otherwise(0)
    placed = counts.join(spans, by).withColumn("_b", bucket)
    order = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    sums = placed.groupBy(*by, "_b", "_total").agg(F.sum("_n").alias("_m")).withColumn("_upto", F.sum("_m").over(order))
    ranks = F.array(*(F.struct(F.lit(p).alias("p"), F.greatest(F.ceil(F.col("_total") * (p / 100)), F.lit(1)).alias("rank")) for p in percents))
    wanted = sums.withColumn("_w", F.explode(ranks)).where((F.col("_upto") >= F.col("_w.rank")) & (F.col("_upto") - F.col("_m") < F.col("_w.rank")))
    wanted = wanted.select(*by, "_b", "_w.p", (F.col("_w.rank") - F.col("_upto") + F.col("_m")).alias("_rest"))
    inside = Window.partitionBy(*by, "p").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    found = placed.join(wanted, [*by, "_b"]).withColumn("_upto", F.sum("_n").over(inside)).where(F.col("_upto") >= F.col("_rest"))
    return found.groupBy(*by).agg(*(F.min(F.when(F.col("p") == p, F.col("_v"))).alias(f"p{p}") for p in percents))


def peak_concurrency(intervals: DataFrame, by: list[str], start: str, end: str, slice_width: int = 3_600_000) -> DataFrame:
    """The most intervals open at once in each group; one that ends as another starts is still open.

    Starts and ends are summed by slices of time first; running sums go over the slices' totals, then over the moments
    inside each slice, so that a group is spread over as many tasks as it has slices."""
    ends = intervals.select(*by, F.col(start).alias("t"), F.lit(1).alias("d")).unionByName(intervals.select(*by, F.col(end).alias("t"), F.lit(-1).alias("d")))
    ends = ends.groupBy(*by, "t", "d").agg(F.sum("d").alias("n")).withColumn("slice", F.floor(F.col("t") / slice_width))
    before = Window.partitionBy(*by).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    totals = ends.groupBy(*by, "slice").agg(F.sum("n").alias("n")).select(*by, "slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    order = Window.partitionBy(*by, "slice").orderBy("t", F.desc("d")).rowsBetween(Window.unboundedPreceding, 0)
    running = ends.withColumn("open", F.sum("n").over(order)).groupBy(*by, "slice").agg(F.max("open").alias("open"))
    return running.join(totals, [*by, "slice"]).groupBy(*by).agg(F.max(F.col("before") + F.col("open")).alias("peak"))


def median(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, median): the mean of the two middle values, which are nearest ranks from below and from above."""
    low = nearest_rank(df, by, value, [50])
    high = nearest_rank(df.withColumn(value, -F.col(value)), by, value, [50]).withColumnRenamed("p50", "_high")
    return low.join(high, by).select(*by, ((F.col("p50") - F.col("_high")) / 2).alias("median"))


def sessions(events: DataFrame, by: list[str], ts: str, gap_s: int) -> DataFrame:
    """(by, session_start, session_end, n_events): runs of events less than gap_s apart.

    Time is cut in slices of gap_s, each ordered by itself: an event begins a session if it is far from the one before it in its slice, or
    from the last one of the slice before. Sessions are numbered by sums over the slices' totals, so that a group is spread
    over as many tasks as it has slices.
    """
    gap = gap_s * 1000
    e = events.select(*by, F.col(ts).alias("_ts"), millis(ts).alias("_ms")).withColumn("_slice", F.floor(F.col("_ms") / gap))
    last = e.groupBy(*by, "_slice").agg(F.max("_ms").alias("_last")).withColumn("_slice", F.col("_slice") + 1)
    on = [F.col(f"e.{c}").eqNullSafe(F.col(f"l.{c}")) for c in by] + [F.col("e._slice") == F.col("l._slice")]
    e = e.alias("e").join(last.alias("l"), on, "left").select("e.*", "_last")
    order = Window.partitionBy(*by, "_slice").orderBy("_ms")
    before = F.coalesce(F.lag("_ms").over(order), "_last")
    e = e.withColumn("_new", F.when(F.col("_ms") - before < gap, 0).otherwise(1))
    e = e.withColumn("_k", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    parts = e.groupBy(*by, "_slice", "_k").agg(F.min("_ts").alias("_start"), F.max("_ts").alias("_end"), F.count("*").alias("_n"), F.max("_new").alias("_new"))
    # A row for each piece of a session in a slice from here on.
    running = Window.partitionBy(*by).orderBy("_slice", "_k").rowsBetween(Window.unboundedPreceding, 0)
    parts = parts.withColumn("_session", F.sum("_new").over(running))
    return parts.groupBy(*by, "_session").agg(F.min("_start").alias("session_start"), F.max("_end").alias("session_end"), F.sum("_n").alias("n_events")).drop("_session")


def sliding_count(events: DataFrame, by: list[str], ts: str, seconds: int) -> DataFrame:
    """events with n_recent: how many of the group's events lie in the seconds up to each, itself included.

    Each event is counted in the slice of time that it lies in, and in the next one, which its seconds reach into: a group is spread
    over as many tasks as it has slices.
    """
    width = seconds * 1000
    own = events.withColumn("_ms", millis(ts)).withColumn("_at", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("_slice", F.floor(F.col("_ms") / width) + F.col("_at"))
    order = Window.partitionBy(*by, "_slice").orderBy("_ms").rangeBetween(-(width - 1), 0)
    return own.withColumn("n_recent", F.count("*").over(order)).where("_at = 0").drop("_ms", "_at", "_slice")


def last_writer(df: DataFrame, key: list[str], version: list[str], values: list[str]) -> DataFrame:
    """The values of each key's greatest version: an aggregate, so a hot key is combined before the shuffle."""
    return df.groupBy(*key).agg(F.max_by(F.struct(*values), F.struct(*version)).alias("w")).select(*key, *(F.col(f"w.{v}").alias(v) for v in values))


def upsert_counters(df: DataFrame, key: list[str], version: list[str], amount: str) -> DataFrame:
    """What inserts and conflict updates leave: times seen after the first, and the sum of the later amounts."""
    return df.groupBy(*key).agg((F.count("*") - 1).alias("observed_again"), (F.sum(amount) - F.min_by(amount, F.struct(*version))).alias("saved"), F.max(version[0]).alias("last_seen"))
