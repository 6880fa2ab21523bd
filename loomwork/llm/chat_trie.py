"""Conversations as a prefix tree: shared turns are written once, in depth-first order."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import written

#: The template's marks and the other control strings that a text must not spell out.
OPEN, MIDDLE, CLOSE = "<s>[INST]", "[/INST]", "</s>"
CONTROL = ["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]


def escape(text: Column) -> Column:
    """A backslash after the first character of each control string, and backslashes doubled: no control string is left."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in CONTROL:
        out = F.replace(out, F.lit(c), F.lit(c[0] + "\\" + c[1:]))
    return out


def unescape(text: str) -> str:
    """The inverse of escape: a backslash stands for the character after it."""
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def format_turn(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), escape(role), F.lit(MIDDLE), escape(text), F.lit(CLOSE))


def conversation_paths(rows: DataFrame) -> DataFrame:
    """(conv_id, turns): a conversation's turns in order, each with its node, the digest of all turns so far.

    rows: (conv_id, turn, role, text). Order: turn, then role and text; null turns first, null roles and texts empty. A row
    without a conv_id is a conversation of its own.
    """
    clean = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")))
    clean = clean.withColumn("alone", F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id()))
    own = F.md5(F.concat_ws("\n", F.octet_length("role").cast("string"), "role", "text"))
    gathered = clean.withColumn("own", own).groupBy("conv_id", "alone").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text", "own"))).alias("turns"))
    kind = gathered.schema["turns"].dataType.simpleString()
    return gathered.select("conv_id", "turns").mapInArrow(_chain, f"conv_id long, turns {kind}, nodes array<string>")


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes of each conversation: digests of the digest before and the turn's own, linear in its turns."""
    for batch in batches:
        nodes = []
        for turns in batch["turns"]:
            digest, path = "", []
            for own in turns.values.field("own").to_pylist():
                digest = hashlib.md5((digest + own).encode()).hexdigest()
                path.append(digest)
            nodes.append(path)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nodes, pa.list_(pa.string()))], [*batch.schema.names, "nodes"])


def running_starts(nodes: DataFrame, order: list[str], length: str, tasks: int) -> DataFrame:
    """nodes with start: the sum of length over all nodes before, in the order given.

    Rows are range-partitioned by order; each task sums its own; only one sum a task is put in order (tasks rows).
    """
    ranged = written(nodes.repartitionByRange(tasks, *order).sortWithinPartitions(*order).withColumn("task", F.spark_partition_id()), "trie-ranged")
    sums = ranged.groupBy("task").agg(F.sum(length).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = F.broadcast(sums.select("task", before.alias("before")))
    inside = F.coalesce(F.sum(length).over(Window.partitionBy("task").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return ranged.withColumn("inside", inside).join(offsets, "task").withColumn("start", (F.col("before") + F.col("inside")).cast("long")).drop("task", "before", "inside")


def _tokenise(ranks: str | None):
    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Token ids of each turn: mark, role and mark; text; mark. The text of an assistant is under the loss mask."""
        encode = encoder(ranks)
        for batch in batches:
            ids, lo, hi = [], [], []
            for formatted, role in zip(batch["formatted"].to_pylist(), batch["role"].to_pylist(), strict=True):
                at = formatted.index(MIDDLE) + len(MIDDLE)
                head, text, tail = (encode(x) for x in (formatted[:at], formatted[at : -len(CLOSE)], formatted[-len(CLOSE) :]))
                ids.append(head + text + tail)
                lo.append(len(head))
                hi.append(len(head) + len(text) if role == "assistant" else len(head))
            names = [n for n in batch.schema.names if n not in ("formatted", "role")]
            yield pa.RecordBatch.from_arrays([*(batch[n] for n in names), pa.array(ids, pa.list_(pa.int32())), pa.array(lo, pa.int64()), pa.array(hi, pa.int64()), pa.array([len(x) for x in ids], pa.int64())], [*names, "ids", "loss_start", "loss_end", "length"])

    return tokenise


def encoder(ranks: str | None):
    """Text to ids by a byte-level vocabulary (ranks: a file of base64 tokens and ranks), or UTF-8 bytes."""
    if ranks is None:
        return lambda text: list(text.encode())
    return _encoding(ranks).encode_ordinary


def decoder(ranks: str | None):
    if ranks is None:
        return lambda ids: bytes(ids).decode()
    return lambda ids, e=_encoding(ranks): e.decode_bytes(ids).decode()


def _encoding(ranks: str):
    import base64

    import tiktoken

    with open(ranks, "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    return tiktoken.Encoding("turns", pat_str=pattern, mergeable_ranks=table, special_tokens={})


def prefix_tree(rows: DataFrame, ranks: str | None = None, tasks: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(tree, paths) of conversations rows (conv_id, turn, role, text).

    tree has a row for each node, a turn after given earlier turns: node, parent (null at roots), depth, ids, start (its
    place in the depth-first sequence of all nodes), length, position (the position id of its first token: the
    tokens of its ancestors), loss_start and loss_end (the part of ids that is an assistant's text) and ancestors, the
    intervals (start, end) of the sequence that its tokens attend to before their own. Intervals that touch are one.
    paths has conv_id and nodes, its path. Each token that conversations share is in tree once.

    Nodes are known by chained 128-bit digests. Conversations are sorted by path, a global range sort; a node belongs to
    the first conversation that holds it, and (that conversation, depth) is depth-first order. So a first turn that a
    third of all conversations share makes no task longer: its tree is cut by range, and only one sum a task is
    put in order.

    Order in a conversation: turn, role, text. Null texts and roles are empty, null turns come first; a row without a
    conv_id is a conversation of its own; repeated rows are turns of their own. Only one conversation must fit in a task, as its digest
    and path need it whole. No rows give no rows. Columns besides the four are not read.
    """
    spark = rows.sparkSession
    tasks = tasks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    convs = written(conversation_paths(rows), "trie-conversations")
    paths = convs.select("conv_id", "nodes")
    distinct = paths.select("nodes").distinct().repartitionByRange(tasks, "nodes").sortWithinPartitions("nodes")
    ordered = written(distinct.withColumn("path", F.monotonically_increasing_id()), "trie-paths")
    owners = ordered.select("path", F.explode("nodes").alias("node")).groupBy("node").agg(F.min("path").alias("path"))
    turns = convs.select(F.posexplode(F.arrays_zip("turns", "nodes")).alias("depth", "t"), F.concat(F.array(F.lit(None).cast("string")), "nodes").alias("up"))
    turns = turns.select(F.col("t.nodes").alias("node"), F.get("up", F.col("depth")).alias("parent"), F.col("depth").cast("long").alias("depth"), F.col("t.turns.role").alias("role"), F.col("t.turns.text").alias("text"))
    nodes = turns.groupBy("node").agg(*(F.first(c).alias(c) for c in ("parent", "depth", "role", "text")))
    nodes = nodes.join(owners, "node").select("node", "parent", "depth", "path", "role", format_turn(F.col("role"), F.col("text")).alias("formatted"))
    nodes = nodes.mapInArrow(_tokenise(ranks), "node string, parent string, depth long, path long, ids array<int>, loss_start long, loss_end long, length long")
    nodes = written(nodes, "trie-tokens")  # the range partition reads them twice
    placed = written(running_starts(nodes, ["path", "depth"], "length", tasks), "trie-nodes")
    # Each distinct path with the places of its nodes: from these, what a node that it owns attends to.
    spots = ordered.select("path", F.explode("nodes").alias("node")).join(placed.select("node", "depth", "start", "length", F.col("path").alias("owner")), "node")
    lines = spots.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("depth", "node", "owner", "start", "length"))).alias("line"))
    seed = F.struct(F.lit(0).cast("long").alias("position"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"), F.array().cast("array<struct<node:string,position:bigint,ancestors:array<struct<start:bigint,end:bigint>>>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        mine = F.struct(x["start"].alias("start"), (x["start"] + x["length"]).alias("end"))
        last = F.try_element_at(acc["spans"], F.lit(-1))
        touching = F.coalesce(last["end"] == x["start"], F.lit(False))
        joined = F.when(touching, F.array_append(F.slice(acc["spans"], 1, F.greatest(F.size(acc["spans"]) - 1, F.lit(0))), F.struct(last["start"].alias("start"), mine["end"].alias("end")))).otherwise(F.array_append(acc["spans"], mine))
        found = F.struct(x["node"].alias("node"), acc["position"].alias("position"), acc["spans"].alias("ancestors"))
        return F.struct((acc["position"] + x["length"]).alias("position"), joined.alias("spans"), F.when(x["owner"] == F.col("path"), F.array_append(acc["out"], found)).otherwise(acc["out"]).alias("out"))

    about = lines.select(F.explode(F.aggregate("line", seed, step, lambda acc: acc["out"])).alias("x")).select("x.node", "x.position", "x.ancestors")
    tree = placed.drop("path").join(about, "node")
    return tree, paths


def _read_back(ranks: str | None):
    def read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """From token ids alone: role and text of a turn, and the text under its loss mask."""
        decode = decoder(ranks)
        for batch in batches:
            role, text, loss, chars = [], [], [], []
            for ids, lo, hi in zip(batch["ids"].to_pylist(), batch["loss_start"].to_pylist(), batch["loss_end"].to_pylist(), strict=True):
                whole = decode(ids)
                at = whole.index(MIDDLE)
                role.append(unescape(whole[len(OPEN) : at]))
                text.append(unescape(whole[at + len(MIDDLE) : -len(CLOSE)]))
                loss.append(unescape(decode(ids[lo:hi])))
                chars.append(len(whole))
            yield pa.RecordBatch.from_arrays([batch["node"], pa.array(role, pa.string()), pa.array(text, pa.string()), pa.array(loss, pa.string()), pa.array(chars, pa.int64())], ["node", "role", "text", "loss", "chars"])

    return read_back


def conversation_digests(tree: DataFrame, paths: DataFrame, ranks: str | None = None) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, leaf_start, n_tokens, n_intervals) of each
    conversation, read back through the layout.

    A conversation is what its last turn attends to: the turns inside its ancestor intervals and itself, in the order of
    the sequence, with a position id for each token; a turn that the intervals miss, or that is out of place, would
    change the digests. leaf_start: where the last turn stands; n_tokens: its last position id and one; n_intervals:
    its ancestor intervals. Conversations without an id are rows of their own, repeated ones too; no rows give no rows.
    """
    turns = tree.select("node", "ids", "loss_start", "loss_end").mapInArrow(_read_back(ranks), "node string, role string, text string, loss string, chars long")
    turns = turns.join(tree.select("node", "start", "length", "position", "ancestors"), "node")
    rows = paths.withColumn("conversation", F.monotonically_increasing_id())
    rows = written(rows, "trie-rows")
    spots = rows.select("conversation", "conv_id", F.element_at("nodes", -1).alias("leaf"), F.explode("nodes").alias("node"))
    fields = ["start", "length", "position", "role", "text", "loss", "chars"]
    # Only the last turn brings its intervals along.
    own = spots.join(turns, "node").withColumn("intervals", F.when(F.col("node") == F.col("leaf"), F.col("ancestors")))
    read = own.groupBy("conversation", "conv_id").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("turns"), F.first("intervals", ignorenulls=True).alias("intervals"), F.max(F.when(F.col("node") == F.col("leaf"), F.struct("start", "length", "position"))).alias("leaf"))
    inside = F.filter("turns", lambda t: (t["start"] == F.col("leaf.start")) | F.exists("intervals", lambda s: (s["start"] <= t["start"]) & (t["start"] + t["length"] <= s["end"])))
    read = read.withColumn("turns", inside)
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform("turns", lambda t: t["loss"]), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(whole, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.aggregate("turns", F.lit(0).cast("long"), lambda s, t: s + t["chars"]).alias("formatted_chars"),
        F.col("leaf.start").alias("leaf_start"),
        (F.col("leaf.position") + F.col("leaf.length")).alias("n_tokens"),
        F.size("intervals").cast("long").alias("n_intervals"),
    )
