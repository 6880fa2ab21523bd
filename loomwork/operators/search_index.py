"""A written inverted index over the fields of documents, and ranked search that reads only what a query needs of it.

Scores are BM25 over weighted fields (BM25F): with F(t, d) = sum over fields of weight * tf / (1 - b + b * length / mean
length), a document has the sum over the query's terms of weight(t) * idf(t) * (k1 + 1) * F / (k1 + F), where idf(t) =
ln(1 + (N - df + 0.5) / (df + 0.5)) and df counts the documents that hold t in any field.

What is written, all in Parquet:

* postings (bucket, term, block, docs, tf, length, n, peak): a row for each term of each block, with all of the block's documents that hold
  it: their keys, and tf and length of each field, one document after the other; n of them, the greatest f among them. A
  folder for each bucket of term checksums; rows in order of term and block, so that files and row groups cover few terms each. A
  very frequent term is spread over files by its blocks, as rows are dealt by range of all three.
* fields, last: names, weights, b, mean lengths, and how many rows share a key at most. An index without them is not complete.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import store

#: Weight and b of each kind of field.
WEIGHTS = {"title": (4.0, 0.20), "slug": (0.8, 0.10), "header": (3.0, 0.30), "section": (2.0, 0.30), "entities": (2.5, 0.20), "body": (1.0, 0.75)}

#: Marks a character run, which no word begins with.
GRAM = "~"

Tokens = tuple[np.ndarray, pa.Array]  # the row of each token, and the tokens


def word_tokens(texts: pa.Array) -> Tokens:
    """Lower-case runs of Latin and Cyrillic letters and digits."""
    lists = pc.split_pattern_regex(pc.utf8_lower(texts), "[^a-zа-яё0-9]+")
    tokens, rows = lists.flatten(), pc.list_parent_indices(lists)
    full = pc.greater(pc.binary_length(tokens), 0)
    return rows.filter(full).to_numpy().astype(np.int64), tokens.filter(full)


def gram_tokens(texts: pa.Array, least: int = 3, most: int = 5) -> Tokens:
    """All runs of least to most characters of the lower-case text, each marked: parts of a url are found inside its words."""
    rows, tokens = [], []
    for i, text in enumerate(pc.utf8_lower(texts).to_pylist()):
        found = [GRAM + text[j : j + n] for n in range(least, most + 1) for j in range(len(text) - n + 1)]
        tokens += found
        rows += [i] * len(found)
    return np.array(rows, np.int64), pa.array(tokens, pa.string())


ANALYZERS: dict[str, Callable[[pa.Array], Tokens]] = {"words": word_tokens, "grams": gram_tokens}


@dataclass(frozen=True)
class Field:
    name: str
    weight: float = 1.0
    b: float = 0.75
    analyzer: str = "words"


def field(name: str, kind: str) -> Field:
    """A field with the weights of its kind; slugs are cut into character runs."""
    return Field(name, *WEIGHTS[kind], "grams" if kind == "slug" else "words")


def _counts(fields: list[Field], docs_per_block: int, most_bytes: int = 8 << 20) -> Callable:
    """For mapInArrow: (term, block, docs, tf, length) of each term of a block of rows, tf and length in order of documents and fields; term null
    once a block, for all its documents. A block is docs_per_block rows of a task at most. Numbers come round after 32,768 tasks or 65,536 blocks of one: blocks
    of one number count as one block, whose bounds hold for all of them."""
    ints, width = pa.int32(), len(fields)

    def lists(values: pa.Array, bounds: np.ndarray, kind: pa.DataType) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), values).cast(pa.list_(kind))

    def block(batch: pa.RecordBatch, number: int) -> Iterator[pa.RecordBatch]:
        keys, n = batch.column(0), batch.num_rows
        found = [ANALYZERS[f.analyzer](batch.column(i + 1)) for i, f in enumerate(fields)]
        rows = np.concatenate([r for r, _ in found])
        of = np.repeat(np.arange(width), [len(r) for r, _ in found])
        coded = pa.chunked_array([t.cast(pa.string()) for _, t in found]).combine_chunks().dictionary_encode()
        lengths = np.bincount(rows * width + of, minlength=n * width).reshape(n, width)
        # One sort of numbers that stand for (term, row, field) counts them all.
        places, times = np.unique((coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) * n + rows) * width + of, return_counts=True)
        pair = places // width
        new = np.diff(pair, prepend=-1) != 0
        tf = np.zeros((int(new.sum()), width), np.int64)
        tf[np.cumsum(new) - 1, places % width] = times
        code, row = np.divmod(pair[new], n)
        heads = np.append(np.flatnonzero(np.diff(code, prepend=-1)), len(code))

        def out(terms: pa.Array, row: np.ndarray, tf: np.ndarray, bounds: np.ndarray) -> pa.RecordBatch:
            flat = lambda matrix: lists(pa.array(matrix.ravel().astype(np.int32)), bounds * width, ints)
            columns = [terms, pa.array(np.full(len(terms), number, np.int32)), lists(keys.take(pa.array(row)), bounds, keys.type), flat(tf), flat(lengths[row])]
            return pa.RecordBatch.from_arrays(columns, ["term", "block", "docs", "tf", "length"])

        yield out(pa.nulls(1, pa.string()), np.arange(n), np.zeros((n, width)), np.array([0, n]))
        for i in range(0, len(heads) - 1, 10_000):
            bounds = heads[i : i + 10_001]
            low, high = bounds[0], bounds[-1]
            yield out(coded.dictionary.take(pa.array(code[bounds[:-1]])), row[low:high], tf[low:high], bounds - low)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first, number = (TaskContext.get().partitionId() & 0x7FFF) << 16, 0
        for batch in batches:
            # Rows of about most_bytes at a time; a longer row is taken alone.
            start = 0
            sizes = np.cumsum(np.sum([pc.fill_null(pc.binary_length(batch.column(i + 1)), 0).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(width)], axis=0))
            while start < batch.num_rows:
                before = sizes[start - 1] if start else 0
                end = min(max(start + 1, int(np.searchsorted(sizes, before + most_bytes, "right"))), start + docs_per_block)
                yield from block(batch.slice(start, end - start), first | number & 0xFFFF)
                start, number = end, number + 1

    return run


def _unpacked(rows: DataFrame, width: int) -> DataFrame:
    """rows with doc, tf and length of each document in place of docs and the lists of all of them."""
    one = lambda i: F.struct(F.get("docs", i).alias("doc"), F.slice("tf", i * width + 1, F.lit(width)).alias("tf"), F.slice("length", i * width + 1, F.lit(width)).alias("length"))
    others = [c for c in rows.columns if c not in ("docs", "tf", "length", "n", "peak")]
    return rows.select(*others, F.inline(F.transform(F.sequence(F.lit(0), F.size("docs") - 1), one)))


def _f(fields: Iterable[Field], means: Iterable[float], tf: Callable[[int], Column], length: Callable[[int], Column]) -> Column:
    """The weighted frequency of a term in a document."""
    f: Column = F.lit(0.0)
    for i, (part, mean) in enumerate(zip(fields, means, strict=True)):
        if mean:
            f = f + F.lit(part.weight) * tf(i) / (F.lit(1 - part.b) + F.lit(part.b) * length(i) / F.lit(mean))
    return f


@dataclass(frozen=True)
class SearchIndex:
    """An index at path: n documents, at most copies of them with the same key; buckets folders."""

    spark: SparkSession
    path: str
    fields: tuple[Field, ...]
    n: int
    buckets: int
    copies: int
    kind: str  # type of the keys
    means: tuple[float, ...]  # lengths of the fields

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> SearchIndex:
        rows = spark.read.parquet(f"{path}/fields").orderBy("place").collect()
        return cls(spark, path, tuple(Field(r["name"], r["weight"], r["b"], r["analyzer"]) for r in rows), rows[0]["n"], rows[0]["buckets"], rows[0]["copies"], rows[0]["kind"], tuple(r["mean"] for r in rows))

    def postings(self, terms: Iterable[str] | None = None) -> DataFrame:
        """Rows of terms, from their folders, and by order within; all rows without terms."""
        rows = _unpacked(self._of(f"term string, block int, docs array<{self.kind}>, tf array<int>, length array<int>, bucket int", terms), len(self.fields))
        return rows.withColumn("f", _f(self.fields, self.means, lambda i: F.col("tf")[i], lambda i: F.col("length")[i]))

    def blocks(self, terms: Iterable[str] | None = None) -> DataFrame:
        """How many postings a block has of a term, and the greatest f among them; the lists are not read."""
        return self._of("term string, block int, n long, peak double, bucket int", terms)

    def _of(self, schema: str, terms: Iterable[str] | None) -> DataFrame:
        root = f"{self.path}/postings"
        reader = self.spark.read.schema(schema).option("basePath", root)
        if terms is None:
            return reader.parquet(root)
        terms = sorted(set(terms))
        # Only the terms' folders are listed and read.
        folders = [f for b in sorted({crc32(t.encode()) % self.buckets for t in terms}) if store.exists(self.spark, f := f"{root}/bucket={b}")]
        return reader.parquet(*folders).where(F.col("term").isin(terms)) if folders else reader.parquet(root).where("false")

    def analyzed(self, text: str) -> list[str]:
        """The distinct terms of a query, by every analyzer that the index's fields have."""
        column = pa.array([text or ""])
        return list(dict.fromkeys(t for a in dict.fromkeys(f.analyzer for f in self.fields) for t in ANALYZERS[a](column)[1].to_pylist()))

    def search(self, terms: dict[str, float] | list[str], k: int | None = 10, k1: float = 1.2, most_listed: int = 1000, digits: int = 6) -> DataFrame:
        """(doc, score), best first, ties to the smaller doc: the k best documents with any of terms; with k None all, in no order.

        terms may have weights. Blocks are read first, narrow rows: their counts give df, and the greatest f of a term in a block
        bounds what the term can add there. Every block's best single term is a score that some document of it has at least, so
        the k-th best of these over blocks is one that the k-th best document reaches; blocks whose bounds together stay below
        it are not read. Rows that share a key may be in several blocks, so where there are any all blocks are read. Up to most_listed blocks are named in the scan of postings, more of them are joined to it; the rows are
        the same. No terms, or terms that the index lacks, give no rows.
        """
        weight = dict.fromkeys(terms, 1.0) if isinstance(terms, list) else dict(terms)
        blocks = self.blocks(weight)
        df = {r["term"]: r["df"] for r in blocks.groupBy("term").agg(F.sum("n").alias("df")).collect()}  # a row for each term of the query
        factor = {t: float(w * np.log(1 + (self.n - df[t] + 0.5) / (df[t] + 0.5)) * (k1 + 1)) for t, w in weight.items() if t in df}
        rows = self.postings(factor or [""])
        if k is not None and factor and self.copies == 1:
            bound = blocks.select("block", _saturated("peak", factor, k1).alias("most"))
            bound = bound.groupBy("block").agg(F.max("most").alias("sure"), F.sum("most").alias("bound"))
            floor = bound.orderBy(F.desc("sure")).limit(k).agg(F.when(F.count("*") == k, F.min("sure")).otherwise(0.0).alias("floor"))
            read = bound.crossJoin(F.broadcast(floor)).where(F.col("bound") + 10.0**-digits >= F.col("floor")).select("block")
            listed = [r["block"] for r in read.limit(most_listed + 1).collect()]
            rows = rows.where(F.col("block").isin(listed)) if len(listed) <= most_listed else rows.join(read, "block", "left_semi")
        scored = rows.groupBy("doc").agg(F.round(F.sum(_saturated("f", factor, k1)), digits).alias("score"))
        return scored.orderBy(F.desc("score"), "doc").limit(k) if k is not None else scored


def _saturated(f: str, factor: dict[str, float], k1: float) -> Column:
    """What a term adds to a score at f."""
    of = F.lit(0.0)
    for term, w in factor.items():
        of = F.when(F.col("term") == term, w).otherwise(of)
    return of * F.col(f) / (k1 + F.col(f))


def build_index(docs: DataFrame, key: str, fields: list[Field], path: str, buckets: int = 64, docs_per_block: int = 4096) -> SearchIndex:
    """Writes the index of docs at path, over what may be there.

    Each task counts the terms of its own documents, a block at a time, and puts a term's documents of a block in one row; these rows go to a
    table once. From it come the mean lengths, and, dealt by range, the postings. A block is at most docs_per_block documents that a
    task reads one after the other, of 8 MB of text at most. A null text has no terms and length 0; rows that repeat a key count as documents of
    the same name, whose scores add up; rows without a key are left out. No rows give an index of nothing.
    """
    spark = docs.sparkSession
    rows = docs.where(F.col(key).isNotNull()).select(F.col(key).alias("doc"), *(F.coalesce(F.col(f.name).cast("string"), F.lit("")).alias(f"f{i}") for i, f in enumerate(fields)))
    kind, width = rows.schema["doc"].dataType.simpleString(), len(fields)
    store.remove(spark, f"{path}/fields")
    rows.mapInArrow(_counts(fields, docs_per_block), f"term string, block int, docs array<{kind}>, tf array<int>, length array<int>").write.mode("overwrite").parquet(f"{path}/counts")
    counts = spark.read.parquet(f"{path}/counts")
    every = _unpacked(counts.where("term is null"), width)
    stats = every.agg(F.count("*").alias("n"), *(F.avg(F.col("length")[i]).alias(f"mean{i}") for i in range(width))).first()
    n, means = stats["n"], tuple(float(stats[f"mean{i}"] or 0.0) for i in range(width))
    copies = every.groupBy("doc").count().agg(F.max("count")).first()[0] or 1

    f = lambda p: _f(fields, means, lambda i: F.get("tf", p * width + i), lambda i: F.get("length", p * width + i))
    peak = F.array_max(F.transform(F.sequence(F.lit(0), F.size("docs") - 1), f))
    postings = counts.where("term is not null").select((F.crc32("term") % buckets).cast("int").alias("bucket"), "term", "block", "docs", "tf", "length")
    order = ["bucket", "term", "block"]
    dealt = postings.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt.select("*", F.size("docs").cast("long").alias("n"), peak.alias("peak")).write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
    store.remove(spark, f"{path}/counts")
    about = [(i, p.name, float(p.weight), float(p.b), p.analyzer, m, n, buckets, copies, kind) for i, (p, m) in enumerate(zip(fields, means, strict=True))]
    spark.createDataFrame(about, "place int, name string, weight double, b double, analyzer string, mean double, n long, buckets int, copies long, kind string").coalesce(1).write.mode("overwrite").parquet(f"{path}/fields")
    return SearchIndex(spark, path, tuple(fields), n, buckets, copies, kind, means)


def index_of(table: DataFrame, docs: DataFrame, key: str, fields: list[Field], name: str) -> SearchIndex:
    """The index of docs, which derive from the files of table: written when these files are first seen in the shared folder, opened after that."""
    spark = table.sparkSession
    kinds = crc32(repr(("packed", key, fields, docs.schema.simpleString())).encode())
    path = f"{store.shared_dir(spark)}/search-{name}-{kinds:08x}-{store.version(table)}"
    return SearchIndex.open(spark, path) if store.exists(spark, f"{path}/fields/_SUCCESS") else build_index(docs, key, fields, path)
