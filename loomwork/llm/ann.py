"""Approximate nearest neighbours by learned partitions of a neighbour graph."""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .store import written


@dataclass
class Router:
    """A network with one hidden layer that gives a vector's chances to belong to each part."""

    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    scale: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(x / self.scale @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    def log_chances(self, x: np.ndarray) -> np.ndarray:
        z = self.logits(x)
        z -= z.max(1, keepdims=True)
        return z - np.log(np.exp(z).sum(1, keepdims=True))


@dataclass
class Tree:
    """A router to coarse parts and, where there are many parts, one in each coarse part; each has width parts (1: no more).

    Part = coarse part * width + part in it. A query's parts are looked for in its most probable coarse ones, wide of them.
    """

    top: Router
    below: list[Router | None]
    width: int = 1
    wide: int = 64

    @property
    def parts(self) -> int:
        return len(self.below) * self.width

    def part(self, x: np.ndarray) -> np.ndarray:
        coarse = self.top.logits(x).argmax(1)
        out = coarse * self.width
        for c in np.unique(coarse):
            if self.below[c] is not None:
                own = np.flatnonzero(coarse == c)
                out[own] += self.below[c].logits(x[own]).argmax(1)
        return out

    def order(self, x: np.ndarray) -> list[np.ndarray]:
        """The parts of each vector, most probable first."""
        z = self.top.log_chances(x)
        if self.width == 1:
            return list(np.argsort(-z, 1, kind="stable"))
        near = np.argsort(-z, 1, kind="stable")[:, : self.wide]
        chances = np.empty((len(x), near.shape[1], self.width))
        for c in np.unique(near):
            row, place = np.nonzero(near == c)
            own = np.full((len(row), self.width), -np.log(self.width)) if self.below[c] is None else self.below[c].log_chances(x[row])
            chances[row, place] = z[row, c][:, None] + own
        parts = (near[:, :, None] * self.width + np.arange(self.width)).reshape(len(x), -1)
        return list(np.take_along_axis(parts, np.argsort(-chances.reshape(len(x), -1), 1, kind="stable"), 1))


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """(n, k): the k others with the largest inner products."""
    out = np.empty((len(x), k), np.int64)
    for i in range(0, len(x), 1024):
        s = -(x[i : i + 1024] @ x.T)
        s[np.arange(len(s)), np.arange(i, i + len(s))] = np.inf
        out[i : i + 1024] = np.argpartition(s, k - 1, 1)[:, :k]
    return out


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, slack: float = 1.1, rounds: int = 20) -> np.ndarray:
    """Parts of about equal size that cut few edges of the graph.

    Starts from recursive halving along main directions; then nodes move to the part where most of their neighbours
    are, greatest gain first, as long as it has room and theirs does not become too small.
    """
    n = len(x)
    label, next_label = np.zeros(n, np.int64), 1
    todo = [(np.arange(n), parts, 0)]
    while todo:
        own, p, at = todo.pop()
        if p == 1:
            label[own] = at
            continue
        c = x[own] - x[own].mean(0)
        way = np.linalg.eigh(c.T @ c)[1][:, -1]
        order = own[np.argsort(c @ way, kind="stable")]
        half = len(own) * (p // 2) // p
        todo += [(order[:half], p // 2, at), (order[half:], p - p // 2, next_label)]
        next_label += 1
    most, least = math.ceil(slack * n / parts), math.floor((2 - slack) * n / parts)
    both = np.concatenate((np.repeat(np.arange(n), graph.shape[1]), graph.ravel())), np.concatenate((graph.ravel(), np.repeat(np.arange(n), graph.shape[1])))
    for _ in range(rounds):
        votes = np.zeros((n, parts), np.int32)
        np.add.at(votes, (both[0], label[both[1]]), 1)
        best = votes.argmax(1)
        gain = votes[np.arange(n), best] - votes[np.arange(n), label]
        size, moved = np.bincount(label, minlength=parts), 0
        for i in np.argsort(-gain, kind="stable"):
            if gain[i] <= 0:
                break
            if size[best[i]] < most and size[label[i]] > least:
                size[label[i]] -= 1
                size[best[i]] += 1
                label[i] = best[i]
                moved += 1
        if not moved:
            break
    return label


def train_router(x: np.ndarray, label: np.ndarray, parts: int, hidden: int = 128, epochs: int = 40, batch: int = 128, rate: float = 0.01, seed: int = 1) -> Router:
    rng = np.random.default_rng(seed)
    scale = float(np.sqrt((x * x).sum(1).mean()) / np.sqrt(x.shape[1])) or 1.0
    x = x / scale
    p = [rng.normal(0, np.sqrt(2 / x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, np.sqrt(1 / hidden), (hidden, parts)), np.zeros(parts)]
    m, v, t = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    for epoch in range(epochs):
        order = rng.permutation(len(x))
        for i in range(0, len(x), batch):
            own = order[i : i + batch]
            h = np.maximum(x[own] @ p[0] + p[1], 0)
            z = h @ p[2] + p[3]
            z = np.exp(z - z.max(1, keepdims=True))
            d = z / z.sum(1, keepdims=True)
            d[np.arange(len(own)), label[own]] -= 1
            d /= len(own)
            dh = (d @ p[2].T) * (h > 0)
            g = [x[own].T @ dh + 1e-4 * p[0], dh.sum(0), h.T @ d + 1e-4 * p[2], d.sum(0)]
            t += 1
            step = rate * (1 - epoch / epochs)
            for k in range(4):
                m[k], v[k] = 0.9 * m[k] + 0.1 * g[k], 0.999 * v[k] + 0.001 * g[k] ** 2
                p[k] = p[k] - step * m[k] / (1 - 0.9**t) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    return Router(*p, scale)


def _matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def usable(v: Column) -> Column:
    """Neither null nor zero, and all components are finite numbers."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(v.isNotNull() & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def train_part(x: np.ndarray, parts: int, k: int, **train_with) -> Router:
    return train_router(x, balanced_parts(x, neighbour_graph(x, min(k, len(x) - 1)), parts), parts, **train_with)


def _below(parts: int, k: int, sample: int):
    def below(table: pa.Table) -> pa.Table:
        """The router inside a coarse part, from a bounded sample of it."""
        table = table.sort_by([("h", "ascending"), ("vec_id", "ascending")]).slice(0, sample)
        router = train_part(_matrix(table["v"]), parts, k, hidden=32)
        weights = [w.astype(np.float32) for w in (router.w1, router.b1, router.w2, router.b2)]
        return pa.table({"coarse": table["coarse"].slice(0, 1), "router": pa.array([pickle.dumps((*weights, router.scale))], pa.binary())})

    return below


def fit(vectors: DataFrame, rows_per_part: int = 2000, least_parts: int = 8, most_coarse: int = 64, sample: int = 4096, k: int = 20) -> Tree | None:
    """Routers to about a part for each rows_per_part vectors (vec_id, v), least_parts at least; none for under 32 vectors a part.

    Up to most_coarse parts are told apart by one router, learned from at most sample vectors, the first by a hash of
    vec_id. Beyond, there are about as many coarse parts as parts in each, so that either number grows with the root of
    the table: the coarse router learns from 32 vectors a part if that is more than sample, and the routers inside are
    trained by tasks, each from at most sample vectors of its part. What comes to the driver: these samples, 128 bytes a
    part of routers.
    """
    n = vectors.count()
    parts = max(least_parts, n // rows_per_part)
    if n < 32 * least_parts:
        return None
    coarse = parts if parts <= most_coarse else max(most_coarse, math.ceil(parts**0.5))
    rows = vectors.select(F.xxhash64("vec_id").alias("h"), "vec_id", "v").orderBy("h", "vec_id").limit(max(sample, 32 * coarse)).select("v").toArrow()
    tree = Tree(train_part(_matrix(rows["v"]), coarse, k), [None] * coarse)
    if parts <= most_coarse:
        return tree
    tree.width = math.ceil(parts / coarse)
    placed = written(vectors.select("vec_id", "v").mapInArrow(_part_of(tree, 1), "vec_id long, v array<double>, part int"), "ann-coarse").withColumnRenamed("part", "coarse")
    sizes = placed.groupBy("coarse").count()  # a row for each coarse part
    few = placed.join(F.broadcast(sizes), "coarse").withColumn("h", F.xxhash64("vec_id", F.lit("below")))
    few = few.where((F.col("count") >= 32 * tree.width) & (F.pmod("h", F.lit(1 << 20)) * F.col("count") < (1 << 20) * 1.2 * sample)).select("coarse", "h", "vec_id", "v")
    for row in few.groupBy("coarse").applyInArrow(_below(tree.width, k, sample), "coarse int, router binary").collect():
        tree.below[row["coarse"]] = Router(*pickle.loads(row["router"]))
    return tree


def _measure(ids: np.ndarray, q: np.ndarray, k: int):
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The k best vectors of a batch for each of a few queries, with their parts."""
        for batch in batches:
            if not len(batch):
                continue
            s = q @ _matrix(batch["v"]).T
            s[ids[:, None] == batch["vec_id"].to_numpy()[None]] = -np.inf
            top = min(k, len(batch))
            best = np.argpartition(-s, top - 1, 1)[:, :top]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(q), dtype=np.int32), top)), batch["part"].take(pa.array(best.ravel())), pa.array(np.take_along_axis(s, best, 1).ravel())], ["query", "part", "score"])

    return measure


def probes_needed(placed: DataFrame, tree: Tree, k: int, target: float = 0.95, queries: int = 200) -> int:
    """The least number of most probable parts that hold target of the true k nearest of some queries, by brute force over all
    vectors; the queries are the first by a hash of vec_id."""
    some = placed.select(F.xxhash64("vec_id", F.lit("probe")).alias("h"), "vec_id", "v").orderBy("h", "vec_id").limit(queries).toArrow()
    ids, q = some["vec_id"].to_numpy(), _matrix(some["v"])
    best = placed.select("vec_id", "v", "part").mapInArrow(_measure(ids, q, k), "query int, part int, score double")
    best = best.withColumn("n", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score")))).where(F.col("n") <= k).select("query", "part").toArrow()
    ranks = []
    for order in tree.order(q):
        ranks.append(np.full(tree.parts, tree.parts - 1))
        ranks[-1][order] = np.arange(len(order))
    place = np.array(ranks)[best["query"].to_numpy(), best["part"].to_numpy()]
    found = np.cumsum(np.bincount(place, minlength=tree.parts)) / len(place)
    return int(np.searchsorted(found, target)) + 1


def _part_of(tree: Tree | None, width: int | None = None):
    def part_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = tree.part(_matrix(batch["v"])) // (width and tree.width or 1) if tree and len(batch) else np.zeros(len(batch))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(part.astype(np.int32))], [*batch.schema.names, "part"])

    return part_of


def _route(tree: Tree | None, probes: int, sizes: dict[int, int], enough: int):
    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The most probable parts of each query, at least probes and so many that they hold enough vectors; and how many
        vectors they hold."""
        for batch in batches:
            lists, scanned = [], []
            for order in tree.order(_matrix(batch["v"])) if tree and len(batch) else [np.zeros(1, np.int64)] * len(batch):
                have = np.cumsum([sizes.get(int(p), 0) for p in order])
                n = min(max(int((have < enough).sum()) + 1, probes), len(order))
                lists.append(order[:n].astype(np.int32))
                scanned.append(int(have[n - 1]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lists, pa.list_(pa.int32())), pa.array(scanned, pa.int64())], [*batch.schema.names, "parts", "scanned"])

    return route


def exact_scores(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Inner products of rows, summed in one fixed order, so that equal vectors have equal scores."""
    out = np.zeros(len(q))
    for d in range(q.shape[1]):
        out += q[:, d] * v[:, d]
    return out


_NEAR = pa.list_(pa.struct([("away", pa.float64()), ("vec_id", pa.int64())]))


def _nearest(k: int):
    def nearest(left: pa.Table, right: pa.Table) -> pa.Table:
        """A row for each query (right) of a block: its k nearest vectors (left), as pairs of minus the score and vec_id."""
        out: list[pa.Array] = []
        queries = right["query_id"].to_numpy()
        if left.num_rows and right.num_rows:
            left = left.sort_by("vec_id")
            ids, v, q = left["vec_id"].to_numpy(), _matrix(left["v"]), _matrix(right["v"])
            for i in range(0, len(q), 256):
                s = q[i : i + 256] @ v.T
                s[ids[None] == queries[i : i + 256, None]] = -np.inf
                top = min(k, len(ids))
                last = np.partition(s, len(ids) - top, 1)[:, len(ids) - top]
                # All that may be among the k, by less than the rounding of s, are scored again in a fixed order.
                near = 1e-9 * (np.abs(last) + 1)
                row, col = np.nonzero((s >= np.where(np.isfinite(last), last - near, -np.inf)[:, None]) & (s > -np.inf))
                score = exact_scores(q[i + row], v[col])
                order = np.lexsort((ids[col], -score, row))
                row, col, score = row[order], col[order], score[order]
                keep = np.arange(len(row)) - np.searchsorted(row, row) < k
                row, col, score = row[keep], col[keep], score[keep]
                pairs = pa.StructArray.from_arrays([pa.array(-score), pa.array(ids[col])], ["away", "vec_id"])
                out.append(pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(len(s) + 1)), pa.int32()), pairs))
        lists = pa.chunked_array(out, _NEAR) if out else pa.chunked_array([pa.array([], _NEAR)])
        return pa.table({"query_id": pa.array(queries[: len(lists)], pa.int64()), "near": lists})

    return nearest


def nearest_neighbours(vectors: DataFrame, queries: Column, k: int = 20, block: int = 4096, **fit_with) -> DataFrame:
    """(query_id, rank, vec_id, score, n_parts, n_scanned): the k nearest of vectors (vec_id, embedding) found for each row where
    queries holds; n_parts and n_scanned: how many parts it asked, and how many vectors these hold.

    Nearness: the largest inner product, in double precision on the vectors as they are; ties go to the smaller vec_id.
    Rows with the query's own vec_id are not its candidates. Vectors that are null, empty or zero, or hold null or
    non-finite components take no part; nor do null vec_ids. A query meets the vectors of its own length: those of the
    commonest length by parts, others in one part for each length, whole. Repeated rows are candidates each. With fewer
    than k candidates all are returned; no rows give no rows. Other columns are not read.

    Every vector belongs to the part that small networks find most probable; they learned balanced parts of neighbour
    graphs of bounded samples. Queries go to their most probable parts, as many as hold 95 % of the true
    neighbours of 200 measured queries: few where vectors have clusters, most of them where they have none. A part is
    searched in blocks of about block vectors by block queries, dealt by hash, so that a part that copies have swollen takes
    more tasks, not longer ones; each block gives one list of k a query, and these are merged.
    """
    base = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"), queries.alias("asks")).where(F.col("vec_id").isNotNull() & usable(F.col("v")))
    common = base.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    usual, rest = base.where(F.size("v") == (common["n"] if common else 0)), base.where(F.size("v") != (common["n"] if common else 0))
    tree = fit(usual, k=k, **fit_with)
    kind = "vec_id long, v array<double>, asks boolean, part int"
    placed = usual.mapInArrow(_part_of(tree), kind).unionByName(rest.withColumn("part", -F.size("v")))
    placed = written(placed, "ann-vectors")
    probes = probes_needed(placed.where("part >= 0"), tree, k) if tree else 1
    sizes = {r["part"]: r["count"] for r in placed.groupBy("part").count().collect()}  # a row for each part
    asks = placed.where("asks").select(F.col("vec_id").alias("query_id"), "v", "part")
    asked = asks.where("part >= 0").drop("part").mapInArrow(_route(tree, probes, sizes, 4 * k), "query_id long, v array<double>, parts array<int>, scanned long")
    others = F.broadcast(vectors.sparkSession.createDataFrame([(p, n) for p, n in sizes.items() if p < 0], "part int, scanned long"))
    asked = asked.unionByName(asks.where("part < 0").join(others, "part").select("query_id", "v", F.array("part").alias("parts"), "scanned"))
    asked = written(asked.select("query_id", "v", F.size("parts").alias("n_parts"), F.col("scanned").alias("n_scanned"), F.explode("parts").alias("part")), "ann-queries")
    asking = {r["part"]: r["count"] for r in asked.groupBy("part").count().collect()}
    grid = [(p, math.ceil(n / block), max(1, math.ceil(asking.get(p, 0) / block))) for p, n in sizes.items()]
    spark = vectors.sparkSession
    grid = F.broadcast(spark.createDataFrame(grid, "part int, v_blocks int, q_blocks int"))
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    left = placed.join(grid, "part").select("vec_id", "v", "part", deal("vec_id", "v_blocks").alias("v_block"), F.explode(F.sequence(F.lit(0), F.col("q_blocks") - 1)).alias("q_block"))
    right = asked.join(grid, "part").select("query_id", "v", "part", F.explode(F.sequence(F.lit(0), F.col("v_blocks") - 1)).alias("v_block"), deal("query_id", "q_blocks").alias("q_block"))
    keys = ["part", "v_block", "q_block"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_nearest(k), "query_id long, near array<struct<away:double,vec_id:bigint>>")
    best = found.groupBy("query_id").agg(F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k).alias("near"))
    work = asked.groupBy("query_id").agg(F.max("n_parts").alias("n_parts"), F.max("n_scanned").alias("n_scanned"))
    ranked = best.join(work, "query_id").select("query_id", "n_parts", "n_scanned", F.posexplode("near").alias("place", "x"))
    return ranked.select("query_id", (F.col("place") + 1).cast("int").alias("rank"), "x.vec_id", (-F.col("x.away")).alias("score"), "n_parts", "n_scanned")
