"""Windows from the first failure: by jumps on a table and by state on a stream, against walking through them."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwork.operators import locks
from loomwork.streaming import events as S


def walk(rows, length, most):
    out = []
    for key in {k for k, _ in rows if k is not None}:
        times = sorted(t for k, t in rows if k == key and t is not None)
        while times:
            own = [t for t in times if t < times[0] + length]
            at = own[most - 1] if len(own) >= most else None
            out.append((key, own[0], len(own), at, None if at is None else own[-1] + length))
            times = times[len(own) :]
    return sorted(out)


def read(df, key="k"):
    return sorted((r[key], r["window_start"], r["failures"], r["locked_at"], r["locked_until"]) for r in df.collect())


@pytest.mark.parametrize("seed", range(4))
def test_windows_match_walking(spark, seed):
    """Dense and sparse keys, equal times, gaps of just the length, long chains."""
    rng = np.random.default_rng(seed)
    steps = [[0, 1, 3, 99, 100, 101], [1, 2], [100], [50, 60, 99, 100, 350, 1000]][seed]
    rows = [(k, int(t)) for k in ("a", "b", "c") for t in np.cumsum(rng.choice(steps, 120)) + int(rng.integers(-500, 500))] + [(None, 5), ("d", None), ("e", 7)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "k string, t long, key string, n int").repartition(3)
    assert read(locks.failure_windows(df, "k", "t", 100, 4)) == walk(rows, 100, 4)


def test_no_failures(spark):
    assert locks.failure_windows(spark.createDataFrame([], "k string, t long"), "k", "t").count() == 0


def test_stream_and_table_give_the_same_locks(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    rng = np.random.default_rng(7)
    rows = [(k, start + dt.timedelta(seconds=int(s))) for k in ("a", "b") for s in np.cumsum(rng.choice([10, 60, 200, 900, 2000], 80))]
    rows.sort(key=lambda r: r[1])
    for i in range(0, len(rows), 40):  # files in order of time, rows within them in any order
        part = [rows[j] for j in rng.permutation(range(i, min(i + 40, len(rows))))]
        spark.createDataFrame(part, "k string, ts timestamp").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{i:04d}")
    spark.createDataFrame([("z", start + dt.timedelta(days=9)), ("z", start + dt.timedelta(days=10))], "k string, ts timestamp").coalesce(1).write.parquet(f"{tmp_path}/in/9999")
    stream = spark.readStream.schema("k string, ts timestamp").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    q = S.failure_locks(stream, "k", "ts", most=4, late="30 days").writeStream.format("memory").queryName("locks").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("locks").count() == 0  # nothing is certain yet
    q = S.failure_locks(stream, "k", "ts", most=4, late="12 hours").writeStream.format("memory").queryName("locks_2").outputMode("append").option("checkpointLocation", f"{tmp_path}/c2").start()
    q.processAllAvailable()
    q.stop()
    ms = [(k, int(t.replace(tzinfo=dt.UTC).timestamp() * 1000)) for k, t in rows]
    table = spark.createDataFrame(rows, "k string, ts timestamp").select("k", F.unix_millis("ts").alias("t"))
    want = walk(ms, 900_000, 4)
    assert read(locks.failure_windows(table, "k", "t", most=4)) == want
    assert [r for r in read(spark.table("locks_2")) if r[0] != "z"] == want


def test_single_use_and_fill(spark, tmp_path):
    """Keys are let through once while they are remembered."""
    at = dt.datetime(2024, 1, 1)
    spark.createDataFrame([("n1", at), ("n1", at + dt.timedelta(seconds=5)), ("n2", at)], "k string, ts timestamp").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("k string, ts timestamp").parquet(f"{tmp_path}/in")
    q = S.once(stream, "ts", ["k"], "180 seconds").writeStream.format("memory").queryName("once_keys").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r["k"] for r in spark.table("once_keys").collect()) == ["n1", "n2"]
