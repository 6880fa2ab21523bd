"""Connected components of a distributed edge list."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import cut


def _local_forest(kind: str):
    def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Union-find within a task: its links become one star for each local group."""
        parent: dict = {}

        def root(x):
            top = x
            while parent.setdefault(top, top) != top:
                top = parent[top]
            while parent[x] != top:
                parent[x], x = top, parent[x]
            return top

        for batch in batches:
            for a, b in zip(batch["u"].to_pylist(), batch["v"].to_pylist(), strict=True):
                a, b = root(a), root(b)
                if a != b:
                    parent[max(a, b)] = min(a, b)
        stars = [(x, root(x)) for x in parent if root(x) != x]
        for i in range(0, len(stars), 10_000):
            part = stars[i : i + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array([s[k] for s in part], pa.binary() if kind == "binary" else pa.int64()) for k in (0, 1)], ["u", "v"])

    return contract


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node that an edge (u, v) names; component is the least node reachable.

    Tasks first contract their own links by union-find; then large-star and small-star rounds hook each
    node to the least neighbour until only stars are left. All of it stays distributed: a hub is
    pre-aggregated by a partial minimum, and the join that follows may split it. Edges with u = v name
    a node of its own; repeated edges count once; no edges give no rows. u and v are not null.
    """
    kind = edges.schema["u"].dataType.simpleString()
    alone = edges.where("u = v").select(F.col("u").alias("node"), F.col("v").alias("component")).distinct()
    e = cut(edges.where("u <> v").mapInArrow(_local_forest(kind), f"u {kind}, v {kind}").distinct())
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Checkpointed, so that the join has an exchange on either side and Spark can split a hub.
        least = cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = cut(large)
        least = cut(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        e = cut(small)
        tops = e.select(F.col("v").alias("u")).distinct()
        if e.join(tops, "u", "left_semi").isEmpty() and e.groupBy("u").count().where("count > 1").isEmpty():
            break
    found = e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")))
    return found.unionByName(alone).groupBy("node").agg(F.min("component").alias("component"))
