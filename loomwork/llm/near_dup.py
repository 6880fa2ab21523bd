"""Near duplicates by SuperMinHash signatures."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .store import written
from .textbytes import GOLD, U, binaries, mix, per_row, shingles, text_blocks, words

_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def superminhash(rows: np.ndarray, elements: np.ndarray, n_rows: int, m: int) -> np.ndarray:
    """The SuperMinHash signatures, (n_rows, m), of sets of 64-bit elements sorted by row; an empty set's is all ones.

    Round j draws, for each element, the next place of the element's own random permutation of the m slots
    (Fisher-Yates, seeded by the element) and a random fraction u; a slot keeps its least j + u. So the ranks of
    one element are correlated, each slot sees a different one. A row whose slots all hold less than j is done,
    as later rounds cannot lower them: rounds needed shrink with the size of the set.
    """
    least = np.full(n_rows * m, _FULL, np.uint64)
    step = 1 << 16
    for i in range(0, len(elements), step):  # in parts, so that the permutations take bounded memory
        x, row = elements[i : i + step], rows[i : i + step]
        perm = np.tile(np.arange(m, dtype=np.uint8 if m <= 256 else np.uint16), len(x))
        base, alive = np.arange(len(x)) * m, np.arange(len(x))
        for j in range(m):
            r = mix(x[alive] + U((GOLD * (j + 1)) & 0xFFFFFFFFFFFFFFFF))
            k = base[alive] + j + ((r >> U(32)) * U(m - j) >> U(32)).astype(np.int64)
            slot = perm[k]
            perm[k] = perm[base[alive] + j]
            np.minimum.at(least, row[alive] * m + slot, U(j << 32) | r & U(0xFFFFFFFF))
            seen = row[alive]
            first, last = int(seen[0]), int(seen[-1])
            open_rows = least[first * m : (last + 1) * m].reshape(-1, m).max(1) >= U((j + 1) << 32)
            alive = alive[open_rows[seen - first]]
            if not len(alive):
                break
    return least.reshape(n_rows, m)


def _set_keys(sets: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """128-bit digests of sets, whatever their order."""
    sums = [np.concatenate((np.zeros(1, np.uint64), np.add.accumulate(mix(sets ^ U(s)), dtype=np.uint64))) for s in (1, GOLD)]
    keys = np.stack([d[bounds[1:]] - d[bounds[:-1]] for d in sums], 1)
    return binaries(keys.ravel(), np.arange(len(bounds)) * 2)


def _sketch(k: int, bands: int, band_rows: int):
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = bands * band_rows
        for batch in batches:
            for first, offsets, data in text_blocks(batch["text"], 1 << 19):
                n = len(offsets) - 1
                _, _, rows, hashes = words(offsets, data)
                rows, sets = shingles(rows, hashes, n, k)
                bounds = per_row(rows, n)
                signature = superminhash(rows, sets, n, m)
                band = np.tile(np.arange(bands, dtype=np.uint64), (n, 1))
                for i in range(band_rows):
                    band = mix(band + signature.reshape(n, bands, band_rows)[:, :, i] * U(GOLD))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch["doc_id"].slice(first, n),
                        batch["text_key"].slice(first, n),
                        _set_keys(sets, bounds),
                        pa.array(np.diff(bounds)),
                        pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * bands, pa.int32()), pa.array(band.view(np.int64).ravel())),
                        binaries(mix(signature).astype(np.uint8).ravel(), np.arange(n + 1) * m),
                    ],
                    ["doc_id", "text_key", "set_key", "n_shingles", "bands", "signature"],
                )

    return sketch


def _plausible(m: int, least: float):
    def plausible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Keeps the pairs of which at least the share least of signature bytes agree."""
        for batch in batches:
            u, v = (np.frombuffer(b"".join(batch[c].to_pylist()), np.uint8).reshape(-1, m) for c in ("u_sign", "v_sign"))
            yield batch.select(["u", "v"]).filter(pa.array((u == v).mean(1) >= least if len(u) else [], pa.bool_()))

    return plausible


def _near(m: int, least: float, num: int, den: int):
    def near(table: pa.Table) -> pa.Table:
        """Of a block of a bucket, outsiders (left) against members of a part (right): those with a plausible partner of
        another component, with the fine part where they are to meet it. A member's own fine part is where it stays."""
        u, fine, size = table["u"].to_pylist(), table["fine"].to_numpy(), table["n"].to_numpy()
        sign = np.frombuffer(b"".join(table["sign"].to_pylist()), np.uint8).reshape(len(u), m)
        kind = np.unique(np.array(table["c"].to_pylist(), object), return_inverse=True)[1]
        right = table["right"].to_numpy(zero_copy_only=False)
        left, other = np.flatnonzero(~right), np.flatnonzero(right)
        theirs = np.ascontiguousarray(sign[other].T)
        found = [np.zeros((0, 3), np.int64)]
        for i in range(0, len(left), 256):
            own = left[i : i + 256]
            agree = np.zeros((len(own), len(other)), np.uint16)
            for j in range(m):
                agree += sign[own, j][:, None] == theirs[j][None]
            fits = (agree >= least * m) & (kind[own][:, None] != kind[other][None])
            fits &= den * np.minimum(size[own][:, None], size[other][None]) >= num * np.maximum(size[own][:, None], size[other][None])
            x, y = np.nonzero(fits)
            x, y = own[x], other[y]
            for who, side in ((x, 0), (y, 1)):
                found.append(np.unique(np.stack((who, fine[y], np.full(len(who), side)), 1), axis=0))
        rows = np.unique(np.concatenate(found), axis=0)
        at = pa.array(rows[:, 0])
        columns = [*(table[c].take(at).combine_chunks() for c in ("u", "c", "bucket")), pa.array(rows[:, 1].astype(np.int32)), pa.array(rows[:, 2] == 1)]
        return pa.table(columns, ["u", "c", "bucket", "j", "right"])

    return near


def _across(k: int, num: int, den: int):
    def across(table: pa.Table) -> pa.Table:
        """Links between members of different components in a block of a bucket, found on full sets: one for each two
        components that they join. Outsiders (left) meet the members of a part (right)."""
        sets, sizes = [], []
        for _, offsets, data in text_blocks(table["text"], 1 << 19):
            n = len(offsets) - 1
            _, _, rows, hashes = words(offsets, data)
            rows, found = shingles(rows, hashes, n, k)
            sets.append(found)
            sizes.append(np.bincount(rows, minlength=n))
        size = np.concatenate(sizes)
        row, (tokens, at, times) = np.repeat(np.arange(len(size)), size), np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        row, at = row[times[at] > 1], at[times[at] > 1]
        both = np.zeros((len(size), len(size)), np.float32)
        order = np.argsort(at, kind="stable")
        row, at = row[order], at[order]
        for i in range(0, len(tokens), 4096):
            part = slice(*np.searchsorted(at, [i, i + 4096]))
            used, column = np.unique(at[part], return_inverse=True)
            has = np.zeros((len(size), len(used)), np.float32)
            has[row[part], column] = 1
            both += has @ has.T
        u, c, right = table["u"].to_pylist(), table["c"].to_pylist(), table["right"].to_numpy(zero_copy_only=False)
        kind = np.unique(np.array(c, object), return_inverse=True)[1]
        linked = (den * both >= num * (size[:, None] + size[None] - both)) & (kind[:, None] != kind[None])
        linked &= ~right[:, None] & right[None]
        x, y = np.nonzero(linked)
        first = np.unique(kind[x].astype(np.int64) * len(size) + kind[y], return_index=True)[1]
        return pa.table({"u": pa.array([u[i] for i in x[first]], pa.binary()), "v": pa.array([u[i] for i in y[first]], pa.binary())})

    return across


def _confirm(k: int, num: int, den: int):
    def sets(column: pa.Array) -> list[np.ndarray]:
        out = []
        for _, offsets, data in text_blocks(column, 1 << 19):
            n = len(offsets) - 1
            _, _, rows, hashes = words(offsets, data)
            rows, found = shingles(rows, hashes, n, k)
            bounds = per_row(rows, n)
            out += [found[bounds[i] : bounds[i + 1]] for i in range(n)]
        return out

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Keeps the pairs whose full sets have den * intersection >= num * union."""
        for batch in batches:
            for i in range(0, len(batch), 500):
                part, keep = batch.slice(i, 500), []
                for a, b in zip(sets(part["u_text"]), sets(part["v_text"]), strict=True):
                    both = len(np.intersect1d(a, b, assume_unique=True))
                    keep.append(den * both >= num * (len(a) + len(b) - both))
                yield part.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return confirm


def near_duplicates(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, bands: int = 32, band_rows: int = 5, block: int = 512) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each row of docs (doc_id, text).

    Two texts are linked if den * |A n B| >= num * |A u B| for their sets of k-word shingles (words: runs of
    other than white space, A-Z lower-cased; fewer than k words: the whole sequence is one shingle).
    component_id is the least doc_id reachable by links, kept says whether it is the row's own.

    Method: SuperMinHash signatures of bands * band_rows values; texts with an equal band meet in a bucket. A
    pair just at 0.8 shares no bucket with a chance of 0.672**32, about 3 in a million. In each bucket every
    set is compared with the bucket's least one: pairs whose sizes rule a link out, or whose signatures agree by
    less than six standard deviations under the threshold, go first; the others are confirmed on the full sets. Where
    the links found leave a bucket in several components, the members outside its largest one are compared with all: by
    signatures in parts of 8 * block members, and those that have a plausible partner by products of their full sets'
    incidence matrices, in parts of about block; only links that join two components come out. So no pair in a
    bucket is lost. With M members and K outsiders that takes M + K * M / (8 * block) rows of a signature, and texts are
    copied to the parts, of M / block, where a partner is plausible. Sets are compared as 64-bit hashes.

    Rows with equal sets form one class before anything is compared, so that exact copies cost one row each.
    A null, empty or white text has no shingles, is linked with nothing and is its own component. Repeated rows
    and repeated doc_ids are rows of their own; a null doc_id is ignored by the minimum, and a component of
    null ids only has a null component_id and is kept. Columns besides doc_id and text are not read.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    base = base.withColumn("text_key", F.xxhash64("text"))
    sketched = written(
        base.mapInArrow(_sketch(k, bands, band_rows), "doc_id long, text_key long, set_key binary, n_shingles long, bands array<long>, signature binary"),
        "near-dup-sketch",
    )
    full = sketched.where("n_shingles > 0")
    classes = full.groupBy("set_key").agg(F.min("doc_id").alias("id"), F.min(F.struct("doc_id", "text_key")).alias("row"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.first("signature").alias("sign"))
    classes = written(classes, "near-dup-classes")
    placed = classes.select(F.col("set_key").alias("u"), F.explode("bands").alias("bucket"))
    shared = placed.groupBy("bucket").agg(F.min("u").alias("v"), F.count("*").alias("m")).where("m > 1").select("bucket", "v")
    # Sums are written before they are joined back, so that Spark can split the partition of a large bucket or component.
    shared = written(shared, "near-dup-shared")
    members = written(placed.join(shared, "bucket"), "near-dup-members")
    m, share = bands * band_rows, num / den
    least = share - 6 * (share * (1 - share) / m) ** 0.5

    def plausible(pairs: DataFrame) -> DataFrame:
        of = lambda x: classes.select(F.col("set_key").alias(x), F.col("n").alias(f"{x}_n"), F.col("sign").alias(f"{x}_sign"))
        sized = pairs.join(of("v"), "v").join(of("u"), "u").where(den * F.least("u_n", "v_n") >= num * F.greatest("u_n", "v_n"))
        return sized.select("u", "v", "u_sign", "v_sign").mapInArrow(_plausible(m, least), "u binary, v binary")

    def texts_of(wanted: DataFrame) -> DataFrame:
        """(u, text): one text of each wanted set, found by its doc_id and hash, so that a null or repeated doc_id brings no other."""
        rows = classes.select(F.col("set_key").alias("u"), F.col("row.doc_id").alias("of_doc"), F.col("row.text_key").alias("of_text")).join(wanted, "u", "left_semi")
        texts = base.join(rows, F.col("doc_id").eqNullSafe(F.col("of_doc")) & (F.col("text_key") == F.col("of_text"))).select("u", "text")
        return written(texts.groupBy("u").agg(F.first("text").alias("text")), "near-dup-texts")

    def confirmed(pairs: DataFrame) -> DataFrame:
        texts = texts_of(pairs.select("u").unionByName(pairs.select(F.col("v").alias("u"))).distinct())
        with_v = pairs.join(texts.select(F.col("u").alias("v"), F.col("text").alias("v_text")), "v")
        with_u = with_v.join(texts.select("u", F.col("text").alias("u_text")), "u")
        return written(with_u.select("u", "v", "u_text", "v_text").mapInArrow(_confirm(k, num, den), "u binary, v binary"), "near-dup-links")

    def apart(pairs: DataFrame, groups: DataFrame) -> DataFrame:
        """Those that are in different components."""
        of = lambda x: groups.select(F.col("node").alias(x), F.col("component").alias(f"{x}_in"))
        both = pairs.join(of("u"), "u", "left").join(of("v"), "v", "left")
        return both.where(~F.coalesce("u_in", "u").eqNullSafe(F.coalesce("v_in", "v"))).select("u", "v")

    def merged(groups: DataFrame, links: DataFrame) -> DataFrame:
        """groups after further links: only the components that these join are gone through again."""
        of = lambda x: groups.select(F.col("node").alias(x), F.col("component").alias(f"{x}_in"))
        between = links.join(of("u"), "u", "left").join(of("v"), "v", "left").select(F.coalesce("u_in", "u").alias("u"), F.coalesce("v_in", "v").alias("v")).distinct()
        joined = written(components(written(between, "near-dup-between")), "near-dup-joined")
        moved = groups.join(joined.select(F.col("node").alias("component"), F.col("component").alias("top")), "component", "left").select("node", F.coalesce("top", "component").alias("component"))
        return written(moved.unionByName(joined.join(groups.select("node"), "node", "left_anti")), "near-dup-groups")

    tried = written(plausible(members.where("u <> v").select("u", "v").distinct()), "near-dup-pairs")
    # One comparison of each set first: most of the others are then within a component.
    nearest = tried.groupBy("u").agg(F.min("v").alias("v"))
    links = confirmed(nearest)
    grouped = written(components(links), "near-dup-groups")
    more = confirmed(written(apart(tried.join(nearest, ["u", "v"], "left_anti"), grouped), "near-dup-more"))
    grouped = merged(grouped, more)
    labelled = members.select("bucket", "u").join(grouped.withColumnRenamed("node", "u"), "u", "left").select("bucket", "u", F.coalesce("component", "u").alias("c"))
    labelled = written(labelled, "near-dup-labelled")
    split = labelled.groupBy("bucket").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("m")).where("m > 2 and lo <> hi").select("bucket")
    split = written(split, "near-dup-split")
    rest = written(labelled.join(split, "bucket").join(classes.select(F.col("set_key").alias("u"), "n", "sign"), "u"), "near-dup-rest")
    parts = written(rest.groupBy("bucket").agg(F.ceil(F.count("*") / block).cast("int").alias("parts")), "near-dup-parts")
    # A bucket's largest component needs no comparison inside: only the others, the outsiders, meet all members.
    largest = rest.groupBy("bucket", "c").agg(F.count("*").alias("n")).groupBy("bucket").agg(F.max_by("c", F.struct("n", "c")).alias("largest"))
    dealt = rest.join(parts, "bucket").join(largest, "bucket")
    dealt = dealt.withColumn("fine", F.pmod(F.xxhash64("u"), F.col("parts")).cast("int")).withColumn("part", F.floor(F.col("fine") / 8).cast("int"))
    # Members stay in their part and outsiders go to all: first by signatures, eight fine parts at a time; then, by full
    # sets, to the fine parts where they have a plausible partner. So texts go only where they may be linked.
    columns = ["bucket", "u", "c", "n", "sign", "fine"]
    outside = dealt.where("c <> largest").select(*columns, F.lit(False).alias("right"), F.explode(F.sequence(F.lit(0), F.floor((F.col("parts") - 1) / 8).cast("int"))).alias("part"))
    met = dealt.select(*columns, F.lit(True).alias("right"), "part").unionByName(outside)
    met = met.repartition("bucket", "part")  # else all blocks of a bucket would stay in one task
    near = met.groupBy("bucket", "part").applyInArrow(_near(m, least, num, den), "u binary, c binary, bucket long, j int, right boolean")
    # A member's blocks are gathered, so that its text is joined once, and dealt with it afterwards.
    near = written(near.groupBy("u", "c", "bucket").agg(F.collect_set(F.struct("j", "right")).alias("places")), "near-dup-near")
    blocks = near.join(texts_of(near.select("u").distinct()), "u").select("bucket", "u", "c", "text", F.explode("places").alias("at")).select("bucket", "at.j", "u", "c", "text", "at.right")
    blocks = blocks.repartition("bucket", "j")
    across = written(blocks.groupBy("bucket", "j").applyInArrow(_across(k, num, den), "u binary, v binary").distinct(), "near-dup-across")
    grouped = merged(grouped, across)

    ids = classes.select("set_key", "id").join(grouped.withColumnRenamed("node", "set_key"), "set_key", "left").select("set_key", "id", F.coalesce("component", "set_key").alias("component"))
    ids = written(ids, "near-dup-ids")
    first = written(ids.groupBy("component").agg(F.min("id").alias("component_id")), "near-dup-first")
    found = ids.join(first, "component").select("set_key", "component_id")
    linked = full.select("doc_id", "n_shingles", "set_key").join(found, "set_key").select("doc_id", "n_shingles", "component_id")
    alone = sketched.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
