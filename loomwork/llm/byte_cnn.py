"""A quality classifier: a convolutional network over the bytes of a text, in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textbytes import text_blocks

#: Chunks are two cells long and start at every cell, so that they overlap by half.
CELL = 256


@dataclass
class ByteCnn:
    """filters[j, byte, f]: what a byte at place j adds to filter f; weights: of the means and the maxima over chunks."""

    filters: np.ndarray
    bias: np.ndarray
    weights: np.ndarray
    intercept: float

    def pairs(self) -> list[np.ndarray]:
        """Tables for two bytes at once: (65536, filters) each."""
        return [(self.filters[j][:, None] + self.filters[j + 1][None]).reshape(65536, -1).astype(np.float32) for j in range(0, len(self.filters), 2)]


def cells(offsets: np.ndarray, data: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Texts padded with width - 1 zeros at least to whole cells, and the bounds of each text's cells. So no window of
    width bytes that starts in a text reaches into the next one; those that start in the last width - 1 zeros may."""
    lens = np.diff(offsets)
    n = np.maximum(1, -(-(lens + width - 1) // CELL))
    bounds = np.concatenate(([0], np.cumsum(n)))
    out = np.zeros(int(bounds[-1]) * CELL + width, np.uint8)
    out[np.repeat(bounds[:-1] * CELL - offsets[:-1], lens) + np.arange(len(data))] = data
    return out, bounds


def convolve(x: np.ndarray, tables: list[np.ndarray], bias: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Filter values at each byte, (cells, CELL, filters); none (-inf) at the end of the last cells of texts, where windows
    hold nothing of the text and may reach into the next one."""
    n = len(x) // CELL * CELL
    two = x[:-1].astype(np.uint16) << 8 | x[1:]
    out = tables[0][two[:n]]
    for j, t in enumerate(tables[1:], 1):
        out += t[two[2 * j : 2 * j + n]]
    out += bias
    out = out.reshape(-1, CELL, len(bias))
    out[last, CELL + 1 - 2 * len(tables) :] = -np.inf
    return out


def chunk_bounds(bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each chunk its two cells (the same one, where a text has one cell), and the bounds of each text's chunks."""
    n = np.diff(bounds)
    chunks = np.maximum(1, n - 1)
    ends = np.concatenate(([0], np.cumsum(chunks)))
    left = np.repeat(bounds[:-1] - ends[:-1], chunks) + np.arange(int(ends[-1]))
    return left, np.minimum(left + 1, np.repeat(bounds[1:] - 1, chunks)), ends


def pooled(cell_max: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of each text: over its chunks, the mean and the maximum of each filter's largest value (0 at least)."""
    left, right, ends = chunk_bounds(bounds)
    chunk = np.maximum(np.maximum(cell_max[left], cell_max[right]), 0)
    return np.concatenate((np.add.reduceat(chunk, ends[:-1]) / np.diff(ends)[:, None], np.maximum.reduceat(chunk, ends[:-1])), 1), chunk


def train(texts: list[bytes], labels: list[int], width: int = 6, n_filters: int = 12, epochs: int = 10, least_steps: int = 400, batch: int = 32, rate: float = 0.01, decay: float = 1e-4, seed: int = 1) -> ByteCnn:
    """Fits by Adam, by epochs passes and at least least_steps steps. Without texts of both kinds, a network that gives the smoothed share of label 1 to all."""
    rng = np.random.default_rng(seed)
    y = np.array(labels, np.float64)
    share = (y.sum() + 1) / (len(y) + 2)
    p = {"filters": rng.normal(0, 0.1, (width, 256, n_filters)), "bias": np.zeros(n_filters), "weights": rng.normal(0, 0.1, 2 * n_filters), "intercept": np.array([np.log(share / (1 - share))])}
    if not 0 < y.sum() < len(y):
        return ByteCnn(p["filters"], p["bias"], p["weights"] * 0, float(p["intercept"][0]))
    m, v, t = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}, 0
    epochs = max(epochs, -(-least_steps * batch // len(texts)))
    for epoch in range(epochs):
        order = rng.permutation(len(texts))
        for i in range(0, len(order), batch):
            own = order[i : i + batch]
            lens = np.array([len(texts[k]) for k in own])
            x, bounds = cells(np.concatenate(([0], np.cumsum(lens))), np.frombuffer(b"".join(texts[k] for k in own), np.uint8), width)
            net = ByteCnn(p["filters"], p["bias"], p["weights"], 0.0)
            a = convolve(x, net.pairs(), p["bias"].astype(np.float32), bounds[1:] - 1)
            best = a.argmax(1)  # (cells, filters)
            top = np.take_along_axis(a, best[:, None], 1)[:, 0]
            at = best + np.arange(len(a))[:, None] * CELL
            features, chunk = pooled(top, bounds)
            left, right, ends = chunk_bounds(bounds)
            z = features @ p["weights"] + p["intercept"]
            dz = (1 / (1 + np.exp(-z)) - y[own]) / len(own)
            g = {"weights": features.T @ dz + decay * p["weights"], "intercept": np.array([dz.sum()])}
            text = np.repeat(np.arange(len(own)), np.diff(ends))
            d = np.outer(dz / np.diff(ends), p["weights"][:n_filters])[text]
            d += np.where(chunk == features[text, n_filters:], np.outer(dz, p["weights"][n_filters:])[text], 0)
            d *= chunk > 0
            where = np.where(top[left] >= top[right], at[left], at[right])
            g["bias"] = d.sum(0)
            flat = np.zeros(width * 256 * n_filters)
            for j in range(width):
                np.add.at(flat, ((j * 256 + x[where + j].astype(np.int64)) * n_filters + np.arange(n_filters)).ravel(), d.ravel())
            g["filters"] = flat.reshape(width, 256, n_filters) + decay * p["filters"]
            t += 1
            step = rate * (1 - epoch / epochs) + 0.001
            for k in p:
                m[k], v[k] = 0.9 * m[k] + 0.1 * g[k], 0.999 * v[k] + 0.001 * g[k] ** 2
                p[k] = p[k] - step * m[k] / (1 - 0.9**t) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    return ByteCnn(p["filters"], p["bias"], p["weights"], float(p["intercept"][0]))


def score_block(offsets: np.ndarray, data: np.ndarray, net: ByteCnn, tables: list[np.ndarray]) -> np.ndarray:
    """Probabilities of label 1 for a block of texts; a long text's cells are convolved in parts."""
    x, bounds = cells(offsets, data, len(net.filters))
    step, bias = 256 * CELL, net.bias.astype(np.float32)
    last, total = bounds[1:] - 1, int(bounds[-1]) * CELL
    top = np.concatenate([convolve(x[i : min(i + step, total) + len(net.filters)], tables, bias, last[(last >= i // CELL) & (last < (i + step) // CELL)] - i // CELL).max(1) for i in range(0, total, step)])
    features, _ = pooled(top, bounds)
    return 1 / (1 + np.exp(-(features.astype(np.float64) @ net.weights + net.intercept)))


def _score(net: ByteCnn, names: list[str]):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = net.pairs()
        for batch in batches:
            parts = [score_block(offsets, data, net, tables) for _, offsets, data in text_blocks(batch["text"], 1 << 19)]
            scores = pa.array(np.concatenate(parts) if parts else np.zeros(0))
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in names), scores], [*names, "score"])

    return score


def fit(docs: DataFrame, labels: DataFrame, sample: int = 3000, sample_bytes: int = 64 << 20, **train_with) -> ByteCnn:
    """Trains on at most sample labelled documents of at most sample_bytes together, the first by a hash of doc_id, whole
    texts of any length.

    So what comes to the driver is bounded by the parameters. Rows whose crc32(doc_id) mod 4 is 2 are held out; null
    labels and doc_ids are left out; a doc_id with several labels counts with its least one.
    """
    known = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("int").alias("label"))
    known = known.where(~held_out(F.col("doc_id")))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("key"))
    order = [F.xxhash64("doc_id"), F.col("doc_id"), F.col("key")]
    # Sizes and hashes meet the labels, never the texts: those of the sample are fetched by a broadcast of their names.
    sizes = texts.select("doc_id", "key", F.octet_length("text").alias("size")).join(known, "doc_id").orderBy(*order).limit(sample).collect()
    total, taken = 0, []
    for r in sizes:  # at most sample rows
        total += r["size"]
        if total > sample_bytes and taken:
            break
        taken.append((r["doc_id"], r["key"], r["label"]))
    if not taken:
        return train([], [], **train_with)
    chosen = docs.sparkSession.createDataFrame(sorted(set(taken)), "doc_id long, key long, label int")
    rows = texts.join(F.broadcast(chosen), ["doc_id", "key"]).orderBy(*order).limit(len(taken)).collect()
    return train([r["text"].encode() for r in rows], [r["label"] for r in rows], **train_with)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def classify_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, with_text: bool = True, **fit_with) -> DataFrame:
    """docs (doc_id, text, ...) with held_out, score and predicted; all other columns are passed on, but those of these
    names, and text unless with_text.

    score: the probability of label 1 (quality in labels), from the bytes of the whole text alone: learned filters of six
    bytes slide over chunks of 512 bytes that overlap by half, each chunk keeps each filter's maximum, and the
    chunks' mean and maximum are combined by one logistic unit. predicted: 1 if score >= threshold, ties included.
    A null text counts as empty; empty texts have a score, that of an empty chunk. Null doc_ids are never held out.
    Repeated rows are scored one by one; no rows give no rows; without labels of both kinds all get their smoothed share.
    """
    net = fit(docs, labels, **fit_with)
    base = docs.drop("held_out", "score", "predicted")
    names = [c for c in base.columns if with_text or c != "text"]
    schema = ", ".join(f"`{c}` {base.schema[c].dataType.simpleString()}" for c in names)
    scored = base.mapInArrow(_score(net, names), f"{schema}, score double")
    return scored.select(*names, held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
