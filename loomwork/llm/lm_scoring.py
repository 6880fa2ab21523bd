"""Scores of texts under a small causal self-attention model, and under add-one word counts."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import written
from .textbytes import GOLD, U, binaries, mix, powers, text_blocks, words

#: A cell is half a window: the tokens of a cell are predicted from the window that ends with them.
CELL = 8
#: The word hash that stands for the end of a text.
END_WORD = np.uint64(0x5EED_0F_E4D)
VOCABULARY, END, START, PAD = 50_257, 50_256, 50_257, 50_258
_KEY_BASE = 0x9C6E6877736C46E3


def subwords(ranks: str) -> list[bytes]:
    """The bytes of each id."""
    with open(ranks, "rb") as f:
        table = {int(b): base64.b64decode(a) for a, b in map(bytes.split, f)}
    return [table[i] for i in range(len(table))]


class WordIds:
    """Subword ids of words, each with a space before it, from which the word can be read back.

    Words met before, up to most, are looked up by their hashes.
    """

    def __init__(self, ranks: str, most: int = 400_000):
        import tiktoken

        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.table = {a: i for i, a in enumerate(subwords(ranks))}
        self.encode = tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=self.table, special_tokens={}).encode_ordinary
        self.feed, self.most = self.table[b"\n"], most
        self.hashes, self.places, self.lens, self.ids = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint16)

    def alone(self, word: bytes) -> list[int]:
        try:
            return self.encode(" " + word.decode("utf-8"))
        except UnicodeDecodeError:  # no text: its bytes, each by itself
            return [self.table[b" "], *(self.table[bytes([b])] for b in word)]

    def encoded(self, starts: np.ndarray, ends: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the words at starts:ends in turn, and how many each has.

        The words are encoded in one call, a line feed between them: words hold none, and it is a piece and a token of
        its own. Where other white space in a word upsets that, each word is encoded by itself.
        """
        raw = data.tobytes().lower()
        spans = [raw[s:e] for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
        try:
            ids = np.array(self.encode((b" " + b"\n ".join(spans) + b"\n").decode("utf-8")) if spans else [], np.uint16)
        except UnicodeDecodeError:
            ids = np.zeros(0, np.uint16)
        feeds = np.flatnonzero(ids == self.feed)
        if len(feeds) != len(spans):
            each = [self.alone(s) for s in spans]
            return np.array([i for ids in each for i in ids], np.uint16), np.array([len(x) for x in each], np.int64)
        return np.delete(ids, feeds), np.diff(feeds, prepend=-1) - 1

    def of(self, hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the words at starts:ends in turn, and the bounds of each word's ids."""
        at = np.searchsorted(self.hashes, hashes)
        at[at == len(self.hashes)] = 0
        old = self.hashes[at] == hashes if len(self.hashes) else np.zeros(len(hashes), bool)
        new = np.flatnonzero(~old)
        ids, n = self.encoded(starts[new], ends[new], data)
        places, lens = np.empty(len(hashes), np.int64), np.empty(len(hashes), np.int64)
        places[old], lens[old] = self.places[at[old]], self.lens[at[old]]
        places[new], lens[new] = len(self.ids) + np.cumsum(n) - n, n
        ids = np.concatenate((self.ids, ids))
        if len(self.hashes) < self.most:
            merged = np.concatenate((self.hashes, hashes[new]))
            order = np.argsort(merged, kind="stable")
            self.hashes, self.ids = merged[order], ids
            self.places, self.lens = (np.concatenate((a, b[new]))[order] for a, b in ((self.places, places), (self.lens, lens)))
        bounds = np.concatenate(([0], np.cumsum(lens)))
        return ids[np.repeat(places - bounds[:-1], lens) + np.arange(bounds[-1])], bounds


def word_keys(ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A hash of each run of ids that begins at starts; the runs follow each other."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lens = np.diff(starts, append=len(ids))
    up = powers(_KEY_BASE, int(lens.max()))[np.arange(len(ids)) - np.repeat(starts, lens)]
    up *= ids.astype(np.uint64) + U(1)
    return mix(np.add.reduceat(up, starts) ^ lens.astype(np.uint64) * U(GOLD))


@dataclass
class Block:
    """Distinct words of a block of texts, and where each stands."""

    n: int
    rows: np.ndarray
    distinct: np.ndarray
    inverse: np.ndarray
    ids: np.ndarray
    bounds: np.ndarray

    def tokens(self) -> tuple[np.ndarray, np.ndarray]:
        """(ids, bounds of each text): the subwords of all texts in turn, each text followed by END."""
        lens = np.diff(self.bounds)[self.inverse]
        total = int(lens.sum())
        at = np.repeat(self.bounds[:-1][self.inverse] - np.concatenate(([0], np.cumsum(lens)[:-1])).astype(np.int64), lens) + np.arange(total)
        row = np.repeat(self.rows, lens)
        count = np.bincount(row, minlength=self.n) + 1
        bounds = np.concatenate(([0], np.cumsum(count)))
        out = np.full(total + self.n, END, np.int64)
        out[np.arange(total) + row] = self.ids[at]
        return out, bounds


def distinct_words(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct, where, inverse): distinct hashes, a place of each, and the place in distinct of each hash.

    One plain sort, much faster than an indirect one: the low 22 bits give way to the place. Hashes alike in the other
    bits may come in turns, and then stand in distinct more than once; that does no harm here.
    """
    low = U((1 << 22) - 1)
    if len(hashes) > 1 << 22:
        distinct, where, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        return distinct, where, inverse
    place = (np.sort((hashes & ~low) | np.arange(len(hashes), dtype=np.uint64)) & low).astype(np.int64)
    ranked = hashes[place]
    new = np.ones(len(ranked), bool)
    np.not_equal(ranked[1:], ranked[:-1], out=new[1:])
    inverse = np.empty(len(ranked), np.int64)
    inverse[place] = np.cumsum(new) - 1
    return ranked[new], place[new], inverse


def blocks(column: pa.Array, word_ids: WordIds, limit: int = 1 << 23) -> Iterator[tuple[int, Block]]:
    for first, offsets, data in text_blocks(column, limit):
        starts, ends, rows, hashes = words(offsets, data)
        distinct, where, inverse = distinct_words(hashes)
        yield first, Block(len(offsets) - 1, rows, distinct, inverse, *word_ids.of(distinct, starts[where], ends[where], data))


class Tally:
    """Counts of 64-bit keys, merged whenever many have come."""

    def __init__(self, most: int = 2_000_000):
        self.keys, self.counts, self.size, self.most = [], [], 0, most

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.keys.append(keys)
        self.counts.append(counts)
        self.size += len(keys)
        if self.size > self.most:
            keys, counts = self.merged()
            self.keys, self.counts, self.size = [keys], [counts], len(keys)
            self.most = max(self.most, 2 * len(keys))

    def merged(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.keys:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        keys, counts = np.concatenate(self.keys), np.concatenate(self.counts)
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order]
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
        return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def _read(ranks: str):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The tokens of each text, 16 bits each; then the counts of words (subword: false) and subwords of a task's training
        texts."""
        word_ids, tally, subwords_ = WordIds(ranks), Tally(), np.zeros(VOCABULARY, np.int64)
        schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("tokens", pa.binary()), ("subword", pa.bool_()), ("key", pa.int64()), ("n", pa.int64())])
        none = lambda n: [pa.nulls(n, t) for t in schema.types]
        for batch in batches:
            held = batch["held_out"].to_numpy(zero_copy_only=False)
            tally.add(np.array([END_WORD]), np.array([int((~held).sum())]))
            subwords_[END] += int((~held).sum())
            for first, block in blocks(batch["text"], word_ids, 1 << 21):
                trains = ~held[first + block.rows]
                n = np.bincount(block.inverse[trains], minlength=len(block.distinct))
                tally.add(word_keys(block.ids, block.bounds[:-1])[n > 0], n[n > 0])
                subwords_ += np.bincount(block.ids, weights=np.repeat(n, np.diff(block.bounds)), minlength=VOCABULARY).astype(np.int64)
                tokens, bounds = block.tokens()
                own = [batch[c].slice(first, block.n) for c in ("doc_id", "held_out")]
                yield pa.RecordBatch.from_arrays([*own, binaries(tokens.astype(np.uint16), bounds), *none(block.n)[3:]], schema=schema)
        seen = np.flatnonzero(subwords_)
        keys, counts = tally.merged()
        keys, counts = keys[counts > 0], counts[counts > 0]
        for flag, k, c in ((True, seen.astype(np.uint64), subwords_[seen]), (False, keys, counts)):
            for i in range(0, len(k), 50_000):
                part = slice(i, i + 50_000)
                yield pa.RecordBatch.from_arrays([*none(len(k[part]))[:3], pa.array(np.full(len(k[part]), flag)), pa.array(k[part].view(np.int64)), pa.array(c[part])], schema=schema)

    return read


def starts_word(ranks: str) -> np.ndarray:
    """Which ids begin with a space, and so a word; END does, too."""
    table = subwords(ranks)
    return np.array([t[:1] == b" " for t in table] + [True] * (VOCABULARY - len(table)))


def _sequences(column: pa.Array, limit: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, tokens, bounds) of runs of rows of about limit tokens."""
    for first, offsets, data in text_blocks(column, 2 * limit):
        yield first, data.view(np.uint16).astype(np.int64), offsets // 2


@dataclass
class Groups:
    """Tokens in groups: P(token | before) = P(group | before) * P(token | group, before).

    of: each token's group; member: its place there. The last group holds all rare tokens, in rare_n groups of rare_width
    of its own: P(token | last group, before) = P(rare group | before) * P(token | rare group, before), with rare_of and
    rare_member. tail: log P(token | last group) by counts alone, from which training starts. Each token has its own
    vector as input; unit: which tokens' vectors start alike.
    """

    n: int
    width: int
    of: np.ndarray
    member: np.ndarray
    tail: np.ndarray
    log_share: np.ndarray
    log_member: np.ndarray
    unit: np.ndarray
    units: int
    rare_n: int
    rare_width: int
    rare_of: np.ndarray
    rare_member: np.ndarray
    log_rare_share: np.ndarray
    log_rare_member: np.ndarray


def groups(counts: np.ndarray, starts_word: np.ndarray, n: int = 32, width: int = 32) -> Groups:
    """The (n - 1) * width most frequent tokens, those that start a word apart from the others, in groups by frequency; the
    rest in the last group, which is cut by frequency into as many groups as each has places. Each count is one more
    than seen, so that every token has a chance."""
    c = counts + 1.0
    order = np.argsort(-c, kind="stable")
    order = np.concatenate(([END], order[order != END]))
    top = order[: (n - 1) * width]
    top = np.concatenate((top[starts_word[top]], top[~starts_word[top]]))
    of, member = np.full(len(c), n - 1, np.int64), np.zeros(len(c), np.int64)
    of[top], member[top] = np.arange(len(top)) // width, np.arange(len(top)) % width
    total = np.bincount(of, c, minlength=n)
    log_member = np.full((n - 1, width), -30.0)
    log_member[of[top], member[top]] = np.log(c[top] / total[of[top]])
    unit = np.empty(len(c) + 2, np.int64)
    unit[: len(c)] = len(top) + starts_word
    unit[top] = np.arange(len(top))
    unit[START], unit[PAD] = len(top) + 2, len(top) + 3
    rare = order[len(top) :]
    rare_width = max(1, int(np.ceil(np.sqrt(len(rare)))))
    rare_n = max(1, -(-len(rare) // rare_width))
    rare_of, rare_member = np.zeros(len(c), np.int64), np.zeros(len(c), np.int64)
    rare_of[rare], rare_member[rare] = np.arange(len(rare)) // rare_width, np.arange(len(rare)) % rare_width
    rare_total = np.bincount(rare_of[rare], c[rare], minlength=rare_n)
    log_rare_member = np.full((rare_n, rare_width), -30.0)
    log_rare_member[rare_of[rare], rare_member[rare]] = np.log(c[rare] / rare_total[rare_of[rare]])
    return Groups(
        n, width, of, member, np.log(c / total[n - 1]), np.log(total / total.sum()), log_member, unit, len(top) + 4,
        rare_n, rare_width, rare_of, rare_member, np.log(rare_total / rare_total.sum()), log_rare_member,
    )


def windows(tokens: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(inputs, targets, text) in cells of CELL places; a cell's window is the cell before it and itself.

    Each text is a cell of padding, then START and the tokens before each target; targets (-1: none) stand where their
    window sees all before them. So windows overlap by a cell, and each token is the target of one window. The window of
    a cell of padding reaches into the text before, but has no targets.
    """
    n = np.diff(bounds)
    cells = -(-n // CELL) + 1
    ends = np.concatenate(([0], np.cumsum(cells)))
    x, y = np.full(int(ends[-1]) * CELL, PAD, np.int64), np.full(int(ends[-1]) * CELL, -1, np.int64)
    at = np.arange(len(tokens)) + np.repeat((ends[:-1] + 1) * CELL - bounds[:-1], n)
    before = np.empty(len(tokens), np.int64)
    before[1:] = tokens[:-1]
    before[bounds[:-1]] = START
    x[at], y[at] = before, tokens
    return x.reshape(-1, CELL), y.reshape(-1, CELL), np.repeat(np.arange(len(n)), cells)


#: Two cells (the queries, rows) meet the cell before them and themselves (the keys) in one product: which keys lie ahead of a
#: query or before its window, and how far back the others are.
_BACK = np.arange(2 * CELL)[:, None] + CELL - np.arange(3 * CELL)[None]
_INSIDE = (_BACK >= 0) & (np.arange(3 * CELL)[None] >= np.arange(2 * CELL)[:, None] // CELL * CELL)
_MASK, _AGO = np.where(_INSIDE, 0, -1e4).astype(np.float32), np.clip(_BACK, 0, 2 * CELL - 1)
#: Logits are cut here, so that exp needs no maximum first.
_MOST = 60.0


def new_model(kinds: Groups, d: int = 16, seed: int = 1) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    f = lambda *s, by=0.1: rng.normal(0, by, s).astype(np.float32)
    return {
        "embed": f(kinds.units, d, by=0.3)[kinds.unit], "q": f(d, d, by=0.25), "k": f(d, d, by=0.25), "v": f(d, d, by=0.25), "r": f(d, d, by=0.25),
        "ago": np.zeros(2 * CELL, np.float32), "out": f(d, kinds.n), "bias": kinds.log_share.astype(np.float32),
        "out2": f(kinds.n - 1, d, kinds.width), "bias2": kinds.log_member.astype(np.float32),
        "out3": np.zeros((d, kinds.rare_n), np.float32), "bias3": kinds.log_rare_share.astype(np.float32),
        "out4": np.zeros((kinds.rare_n, d, kinds.rare_width), np.float32), "bias4": kinds.log_rare_member.astype(np.float32),
    }


def _tables(p: dict, rows: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each input token (of rows): (query, residual and a zero), key, (value and a one)."""
    embed = p["embed"] if rows is None else p["embed"][rows]
    column = np.ones((len(embed), 1), embed.dtype)
    q = embed @ (p["q"] / np.sqrt(len(p["q"])).astype(embed.dtype))
    return np.concatenate((q, embed @ p["r"], 0 * column), 1), embed @ p["k"], np.concatenate((embed @ p["v"], column), 1)


def _paired(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cells, those after the first in pairs: one more without targets where the last would stand alone."""
    if len(x) % 2:
        return x, y
    return np.concatenate((x, x[-1:])), np.concatenate((y, np.full_like(y[-1:], -1)))


def _windowed(a: np.ndarray) -> np.ndarray:
    """(2 * pairs + 1 cells, CELL, d) as (pairs, 3 * CELL, d) without a copy: each pair of cells after the one before it."""
    n, c, d = a.shape
    return np.lib.stride_tricks.as_strided(a, (n // 2, 3 * c, d), (2 * c * d * a.itemsize, d * a.itemsize, a.itemsize))


def _turned(a: np.ndarray) -> np.ndarray:
    return a.transpose(0, 2, 1)


def _attend(p: dict, tables: tuple, x: np.ndarray) -> tuple:
    """Masked attention of each cell but the first over itself and the one before, up to each place's own input, by pairs of
    cells: (queries, keys, values and a column of ones, weights, what the weights sum to, what is attended to and a column of
    ones, that and the residual)."""
    d = tables[1].shape[1]
    qr = tables[0].take(x[1:].reshape(-1, 2 * CELL), 0)
    q, k, v = qr[:, :, :d], _windowed(tables[1].take(x, 0)), _windowed(tables[2].take(x, 0))
    s = np.matmul(q, _turned(k))
    flat = s.reshape(len(s), -1)
    flat += (p["ago"][_AGO] + _MASK).ravel()
    if s.max(initial=0) > _MOST:  # mostly there is nothing to cut
        np.minimum(s, _MOST, out=s)
    np.exp(s, out=s)
    # The ones beside the values sum the weights in the same product.
    found = np.matmul(s, v)
    total = found[:, :, d:] + s.dtype.type(1e-30)
    found /= total
    return q, k, v, s, total, found, found + qr[:, :, d:]


def _sorted_targets(kinds: Groups, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple], list[tuple]]:
    """(places of targets, by group and rare group; their tokens; segments of groups; segments of rare groups), a segment
    being (group, start, end)."""
    flat = y.ravel()
    at = np.flatnonzero(flat >= 0)
    of = kinds.of[flat[at]].astype(np.uint16)
    order = np.argsort(of, kind="stable")
    bounds = np.searchsorted(of[order], np.arange(kinds.n + 1))
    rare = order[bounds[kinds.n - 1] :]
    rare_of = kinds.rare_of[flat[at[rare]]].astype(np.uint16)
    again = np.argsort(rare_of, kind="stable")
    order[bounds[kinds.n - 1] :] = rare[again]
    rare_of, start = rare_of[again], bounds[kinds.n - 1]
    edges = np.concatenate(([0], np.flatnonzero(np.diff(rare_of)) + 1, [len(rare_of)])) if len(rare_of) else np.zeros(0, np.int64)
    at = at[order]
    segments = [(g, bounds[g], bounds[g + 1]) for g in range(kinds.n - 1) if bounds[g] < bounds[g + 1]]
    return at, flat[at], segments, [(int(rare_of[i]), start + i, start + j) for i, j in zip(edges[:-1], edges[1:], strict=True)]


def _weights(out: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """Weights and biases of groups, (groups, d + 1, width)."""
    return np.concatenate((out, bias[:, None]), 1)


def _logits(a: np.ndarray, w: np.ndarray, segments: list[tuple]) -> np.ndarray:
    """The logits a @ w[group] of each segment (group, start, end) of rows, cut to _MOST on either side. a's last column is
    ones. Each segment is one product, all else is done for all rows at once."""
    z = np.empty((len(a), w.shape[2]), a.dtype)
    for g, lo, hi in segments:
        np.matmul(a[lo:hi], w[g], out=z[lo:hi])
    if z.max(initial=0) > _MOST or z.min(initial=0) < -_MOST:  # mostly there is nothing to cut
        np.clip(z, -_MOST, _MOST, out=z)
    return z


def _exps(a: np.ndarray, w: np.ndarray, segments: list[tuple], right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(exp of the logits of segments; the logits of right)."""
    z = _logits(a, w, segments)
    mine = z.reshape(-1).take(np.arange(0, z.size, z.shape[1]) + right)
    return np.exp(z, out=z), mine


def _activations(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Positive parts of the places at; their column of ones stays, for biases."""
    a = h.reshape(-1, h.shape[-1]).take(at, 0)
    return np.maximum(a, 0, out=a)


def _log_chance(a: np.ndarray, w: np.ndarray, segments: list[tuple], right: np.ndarray) -> np.ndarray:
    e, mine = _exps(a, w, segments, right)
    return mine - np.log(e @ np.ones(e.shape[1], e.dtype))


def _whole(n: int) -> list[tuple]:
    return [(0, 0, n)]


def token_logs(p: dict, kinds: Groups, tables: tuple, tokens: np.ndarray, bounds: np.ndarray, batch: int = 1024) -> np.ndarray:
    """The natural log of each token's probability given those before it in its window."""
    x, y, _ = windows(tokens, bounds)
    w, w2, w3 = _weights(p["out"][None], p["bias"][None]), _weights(p["out2"], p["bias2"]), _weights(p["out3"][None], p["bias3"][None])
    out = np.zeros(len(x) * CELL)
    for i in range(0, len(x) - 1, batch):
        j = min(i + batch, len(x) - 1)
        own_x, own_y = _paired(x[i : j + 1], y[i : j + 1])
        at, t, segments, rare = _sorted_targets(kinds, own_y[1:])
        a = _activations(_attend(p, tables, own_x)[-1], at)
        own = _log_chance(a, w, _whole(len(a)), kinds.of[t]).astype(np.float64)
        n = rare[0][1] if rare else len(a)
        own[:n] += _log_chance(a[:n], w2, segments, kinds.member[t[:n]])
        if rare:
            own[n:] += _log_chance(a[n:], w3, _whole(len(a) - n), kinds.rare_of[t[n:]])
            groups_, parts = _rare_segments(rare)
            own[n:] += _log_chance(a[n:], _weights(p["out4"][groups_], p["bias4"][groups_]), parts, kinds.rare_member[t[n:]])
        out[(i + 1) * CELL + at] = own
    return out[y.ravel() >= 0]


def _rare_segments(rare: list[tuple]) -> tuple[np.ndarray, list[tuple]]:
    """(rare groups, segments with their places among these, from 0)."""
    return np.array([g for g, _, _ in rare], np.int64), [(i, lo - rare[0][1], hi - rare[0][1]) for i, (_, lo, hi) in enumerate(rare)]


def score_tokens(p: dict, kinds: Groups, tables: tuple, tokens: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """log10 probability of each text."""
    return np.add.reduceat(token_logs(p, kinds, tables, tokens, bounds), bounds[:-1]) / np.log(10)


#: Parameters of which a batch changes a few rows: their gradients are (rows, values).
_BY_ROW = ("embed", "out4", "bias4")


def _total(e: np.ndarray) -> np.ndarray:
    """Sums of columns; a product is faster than sum(0)."""
    return np.ones(len(e), e.dtype) @ e


def _softmax(a: np.ndarray, w: np.ndarray, segments: list[tuple], right: np.ndarray, n: int, da: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the cross-entropy, a share of n: of the weights and of the biases of groups; that of a without its
    ones is added to da."""
    e = _logits(a, w, segments)
    np.exp(e, out=e)
    total = e @ np.ones(e.shape[1], e.dtype)
    e.reshape(-1)[np.arange(0, e.size, e.shape[1]) + right] -= total
    total *= n
    e /= total[:, None]
    g, change = np.zeros_like(w), np.empty_like(da)
    for i, lo, hi in segments:
        np.matmul(a[lo:hi].T, e[lo:hi], out=g[i])
        np.matmul(e[lo:hi], w[i, :-1].T, out=change[lo:hi])
    da += change
    return g[:, :-1], g[:, -1]


def _gradients(p: dict, kinds: Groups, x: np.ndarray, y: np.ndarray) -> dict:
    """Gradients of the mean cross-entropy over all cells but the first; those of _BY_ROW as (rows, values)."""
    x, y = _paired(x, y)
    seen = np.zeros(len(p["embed"]), bool)
    seen[x.ravel()] = True
    rows = np.flatnonzero(seen)
    place = np.empty(len(seen), np.uint16)
    place[rows] = np.arange(len(rows))
    u, d = place.take(x), len(p["q"])
    tables = _tables(p, rows)
    q, k, v, s, total, found, h = _attend(p, tables, u)
    at, t, segments, rare = _sorted_targets(kinds, y[1:])
    a, n = _activations(h, at), max(1, len(t))
    g, da = {k: np.zeros_like(p[k]) for k in ("out3", "bias3")}, np.zeros((len(at), d), h.dtype)
    out, bias = _softmax(a, _weights(p["out"][None], p["bias"][None]), _whole(len(a)), kinds.of[t], n, da)
    g["out"], g["bias"] = out[0], bias[0]
    lo = rare[0][1] if rare else len(a)
    g["out2"], g["bias2"] = _softmax(a[:lo], _weights(p["out2"], p["bias2"]), segments, kinds.member[t[:lo]], n, da[:lo])
    if rare:
        out, bias = _softmax(a[lo:], _weights(p["out3"][None], p["bias3"][None]), _whole(len(a) - lo), kinds.rare_of[t[lo:]], n, da[lo:])
        g["out3"], g["bias3"] = out[0], bias[0]
    own, parts = _rare_segments(rare)
    out, bias = _softmax(a[lo:], _weights(p["out4"][own], p["bias4"][own]), parts, kinds.rare_member[t[lo:]], n, da[lo:])
    g["out4"], g["bias4"] = (own, out), (own, bias)
    da *= a[:, :d] > 0
    # What each place gets: as a query and residual, and as a key and value of its own cell's window and the next one's.
    parts = {name: np.empty((*x.shape, d), a.dtype) for name in "qkv"} | {"r": np.zeros((*x.shape, d), a.dtype)}
    parts["r"].reshape(-1, d)[at + CELL] = da
    dh = parts["r"][1:].reshape(*h.shape[:2], d)
    # Weights are not divided by their sum, so what comes back to them and the values is.
    share = np.empty((*h.shape[:2], d + 1), a.dtype)
    np.divide(dh, total, out=share[:, :, :d])
    # The mean of ds under s: dh times what was attended to; against the ones beside the values, it is taken off in the product.
    share[:, :, d] = -np.einsum("ijk,ijk->ij", share[:, :, :d], found[:, :, :d])
    ds = np.matmul(share, _turned(v))
    ds *= s
    g["ago"] = np.bincount(_AGO.ravel(), _total(ds.reshape(len(ds), -1)), minlength=2 * CELL).astype(a.dtype)
    parts["q"][0] = 0
    np.matmul(ds, k, out=parts["q"][1:].reshape(q.shape))
    for name, both in (("k", np.matmul(_turned(ds), q)), ("v", np.matmul(_turned(s), share[:, :, :d]))):
        parts[name][0] = 0
        parts[name][1:].reshape(q.shape)[:] = both[:, CELL:]
        parts[name][:-1:2] += both[:, :CELL]
    # All places of a token have the same vector, so they are summed before its products.
    where, embed = u.ravel(), p["embed"][rows]
    order = np.argsort(where, kind="stable")
    starts = np.searchsorted(where[order], np.arange(len(rows)))
    change = np.zeros_like(embed)
    for name, part in parts.items():
        own = np.add.reduceat(part.reshape(-1, d).take(order, 0), starts)
        if name == "q":
            own /= np.sqrt(d).astype(a.dtype)
        g[name] = embed.T @ own
        change += own @ p[name].T
    g["embed"] = rows, change
    return g


def train_step(p: dict, kinds: Groups, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    """Gradients of the mean cross-entropy over the windows of cells."""
    g = _gradients(p, kinds, x, y)
    for name in _BY_ROW:
        rows, values = g[name]
        g[name] = np.zeros_like(p[name])
        g[name][rows] = values
    return g


class Adam:
    """Weights that learn: steps over batches of cells, of all parameters but those of _BY_ROW that a batch leaves out."""

    def __init__(self, p: dict, kinds: Groups, rate: float):
        self.kinds, self.rate, self.steps, self.seen = kinds, rate, 0, 0
        self.dense = [k for k in p if k not in _BY_ROW]
        # The parameters that change as a whole lie in one array, of which those in p are parts.
        whole = np.concatenate([p[k].ravel() for k in self.dense])
        bounds = np.cumsum([0, *(p[k].size for k in self.dense)])
        self.p = {k: w.copy() for k, w in p.items()} | {k: whole[a:b].reshape(p[k].shape) for k, a, b in zip(self.dense, bounds[:-1], bounds[1:], strict=True)}
        self.w = {"": whole} | {k: self.p[k].reshape(len(p[k]), -1) for k in _BY_ROW}
        self.m, self.v = {k: np.zeros_like(w) for k, w in self.w.items()}, {k: np.zeros_like(w) for k, w in self.w.items()}
        self.times = {k: np.zeros(len(p[k])) for k in _BY_ROW}

    def step(self, x: np.ndarray, y: np.ndarray) -> None:
        g = _gradients(self.p, self.kinds, x, y)
        self.steps, self.seen = self.steps + 1, self.seen + int((y[1:] >= 0).sum())
        by, root = np.float32(self.rate / (1 - 0.9**self.steps)), np.float32(1 / (1 - 0.99**self.steps))
        g[""] = slice(None), np.concatenate([g[k].ravel() for k in self.dense])
        for k, w in self.w.items():
            rows, change = g[k]
            change = change.reshape(-1, w.shape[1]) if k else change
            m, v = (self.m[k], self.v[k]) if not k else (self.m[k].take(rows, 0), self.v[k].take(rows, 0))
            m += 0.1 * (change - m)
            change *= change
            v += 0.01 * (change - v)
            size = v * root
            np.sqrt(size, out=size)
            size += 1e-8
            np.divide(m, size, out=size)
            size *= by
            w[rows] -= size
            if k:
                self.m[k][rows], self.v[k][rows] = m, v
                self.times[k][rows] += 1


#: Weights go from tasks to their averages in parts of so many rows of a parameter.
_ROWS = {"embed": 2048, "out4": 16, "bias4": 16}
_PARTS = "name string, part long, rows binary, weights binary, seen binary"


def _parts_of(model: Adam) -> Iterator[pa.RecordBatch]:
    """The rows of weights that a task has changed, and how often: batches for those of _BY_ROW, else tokens seen."""
    for name, w in model.p.items():
        seen = model.times[name] if name in _BY_ROW else np.full(len(w), float(model.seen))
        rows = np.flatnonzero(seen)
        for part in np.unique(rows // _ROWS.get(name, len(w))):
            own = rows[rows // _ROWS.get(name, len(w)) == part]
            values = [own.tobytes(), np.ascontiguousarray(w[own], np.float32).tobytes(), seen[own].tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([int(part)]), *(pa.array([x], pa.binary()) for x in values)], ["name", "part", "rows", "weights", "seen"])


def _train(p: dict, kinds: Groups, rate: float, passes: int, batch: int = 1024):
    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Adam over a task's texts, from the given weights."""
        model = Adam(p, kinds, rate)
        for arrow in batches:
            for _, tokens, bounds in _sequences(arrow["tokens"], 1 << 20):
                x, y, _ = windows(tokens, bounds)
                for _ in range(passes):
                    for i in range(0, len(x) - 1, batch):
                        model.step(x[i : i + batch + 1], y[i : i + batch + 1])
        if model.seen:
            yield from _parts_of(model)

    return train


def _average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Averages of the parts of weights that are alike in name and part, row by row."""
    sums: dict[tuple, list] = {}
    for batch in batches:
        for name, part, rows, weights, seen in zip(*(batch[c].to_pylist() for c in ("name", "part", "rows", "weights", "seen")), strict=True):
            rows, seen = np.frombuffer(rows, np.int64), np.frombuffer(seen)
            w = np.frombuffer(weights, np.float32).reshape(len(rows), -1) * seen[:, None]
            size = int(rows.max()) + 1
            own = sums.setdefault((name, part), [np.zeros((size, w.shape[1])), np.zeros(size)])
            if len(own[1]) < size:
                own[:] = [np.concatenate((x, np.zeros((size - len(x), *x.shape[1:])))) for x in own]
            own[0][rows] += w
            own[1][rows] += seen
    for (name, part), (w, seen) in sums.items():
        rows = np.flatnonzero(seen)
        values = [rows.tobytes(), (w[rows] / seen[rows, None]).astype(np.float32).tobytes(), seen[rows].tobytes()]
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([part]), *(pa.array([x], pa.binary()) for x in values)], ["name", "part", "rows", "weights", "seen"])


def fit(texts: DataFrame, counts: np.ndarray, ranks: str, rounds: int = 4, least_tokens: int = 8_000_000, most_passes: int = 8, rate: float = 0.03, d: int = 16) -> tuple[dict, Groups]:
    """The attention model, from all training texts (row, tokens).

    A round takes every rounds-th text by row, so that each is learned from once; with fewer than least_tokens tokens
    the tasks go over their texts several times, up to most_passes. In a round, tasks (the splits of texts' files) train side
    by side from common weights; then each row of weights is averaged over the tasks that changed it, by how often. Only
    the averages (7 MB at most) come to the driver.
    """
    kinds = groups(counts, starts_word(ranks))
    p = new_model(kinds, d)
    passes = min(most_passes, max(1, round(least_tokens / max(1, int(counts.sum())))))
    for r in range(rounds):
        own = texts.where(F.pmod("row", F.lit(rounds)) == r).select("tokens")
        trained = own.mapInArrow(_train(p, kinds, rate * (1 - r / rounds) ** 1.5, passes), _PARTS)
        for part in trained.repartition("name", "part").mapInArrow(_average, _PARTS).collect():
            rows, w = np.frombuffer(part["rows"], np.int64), p[part["name"]]
            w[rows] = np.frombuffer(part["weights"], np.float32).reshape(len(rows), *w.shape[1:])
    return p, kinds


def _score(shared, n: int, v: int):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each text: tokens, those of the head that are known and their base score, its other words, the model's score."""
        head, head_n, end_n, p, kinds, begins = shared.value
        tables, log_n = _tables(p), np.log10(n + v + 1)
        end_score = np.log10(end_n + 1) - log_n
        for batch in batches:
            for first, tokens, bounds in _sequences(batch["tokens"], 300_000):
                m, starts = len(bounds) - 1, np.flatnonzero(begins[tokens])
                word = tokens[starts] != END
                rows = np.searchsorted(bounds, starts[word], "right") - 1
                distinct, _, inverse = distinct_words(word_keys(tokens, starts)[word])
                at = np.minimum(np.searchsorted(head, distinct), max(0, len(head) - 1))
                inside = head[at] == distinct if len(head) else np.zeros(len(distinct), bool)
                value = np.where(inside, np.log10(head_n[at] + 1.0) - log_n, 0.0) if len(head) else np.zeros(len(distinct))
                base = np.bincount(rows, value[inverse], minlength=m) + end_score
                known = np.bincount(rows, inside[inverse], minlength=m).astype(np.int64) + int(end_n > 0)
                other = ~inside[inverse]
                tail = distinct[inverse[other]].view(np.int64)
                tail_bounds = np.searchsorted(rows[other], np.arange(m + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch["doc_id"].slice(first, m),
                        batch["held_out"].slice(first, m),
                        pa.array(np.bincount(rows, minlength=m).astype(np.int64) + 1),
                        pa.array(known),
                        pa.array(base),
                        pa.ListArray.from_arrays(pa.array(tail_bounds), pa.array(tail)),
                        pa.array(score_tokens(p, kinds, tables, tokens, bounds)),
                    ],
                    ["doc_id", "held_out", "n_tokens", "head_known", "head_score", "tail", "score"],
                )

    return score


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 7 == 2, F.lit(False))


def score_texts(docs: DataFrame, ranks: str, head: int = 200_000, **fit_with) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each row of docs (doc_id, text).

    Training texts are those whose crc32(doc_id) mod 7 is not 2. Words are runs of other than white space with A-Z
    lower-cased; the tokens of base_score are a text's words and one end. base_score: the sum over tokens of
    log10((c + 1) / (N + V + 1)), from counts over all training texts. score: the model's log10 probability of the
    text as the subwords (byte-level BPE) of its words and one end; the model is one layer of causal
    self-attention with learned weights for distances, which predicts a token's group and the token in it, and of rare
    tokens a group of theirs in between. All 50,257 ids have their own input vectors and logits; biases start
    from add-one counts over all training texts, and fit() learns from every one of them. Windows of 16 inputs overlap by
    half; each token is predicted once, from 8 to 16 tokens before it (fewer at a text's start).

    Counts of the head most frequent words (a bounded table) go to all tasks; other words are joined. A null text
    counts as empty: it is one end. Null doc_ids train; repeated rows count each; without training texts c, N
    and V are 0. No rows give no rows. Other columns are not read. Words are told apart by 64-bit hashes of their bytes,
    then of their ids; a word of bytes that are no UTF-8 has an id for each byte.
    """
    spark = docs.sparkSession
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), held_out(F.col("doc_id")).alias("held_out"))
    read = base.mapInArrow(_read(ranks), "doc_id long, held_out boolean, tokens binary, subword boolean, key long, n long")
    # Tokens are written once: training and scoring read them. A word and its tokens stand for each other, so that nothing
    # reads the texts again.
    read = written(read.withColumn("row", F.monotonically_increasing_id()), "lm-texts", compression="zstd")
    texts = read.where("tokens is not null")
    counts = written(read.where("key is not null").groupBy("subword", "key").agg(F.sum("n").alias("n")), "lm-counts")
    seen = np.zeros(VOCABULARY, np.int64)
    for row in counts.where("subword").collect():  # at most VOCABULARY rows
        seen[row["key"]] = row["n"]
    known = counts.where("not subword").select("key", "n")
    sums = known.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v"), F.coalesce(F.sum(F.when(F.col("key") == int(END_WORD), F.col("n"))), F.lit(0)).alias("end")).first()
    top = known.where(F.col("key") != int(END_WORD)).orderBy(F.desc("n"), "key").limit(head).toArrow()
    keys = top["key"].to_numpy().view(np.uint64)
    order = np.argsort(keys)
    p, kinds = fit(texts.where("not held_out"), seen, ranks, **fit_with)
    shared = spark.sparkContext.broadcast((keys[order], top["n"].to_numpy()[order], int(sums["end"]), p, kinds, starts_word(ranks)))
    scored = texts.select("doc_id", "held_out", "tokens").mapInArrow(_score(shared, int(sums["n"]), int(sums["v"])), "doc_id long, held_out boolean, n_tokens long, head_known long, head_score double, tail array<long>, score double")
    scored = written(scored.withColumn("row", F.monotonically_increasing_id()), "lm-scored")
    tail = scored.select("row", F.explode("tail").alias("key")).groupBy("row", "key").agg(F.count("*").alias("times"))
    found = tail.join(known, "key", "left").groupBy("row").agg(
        F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("tail_known"),
        F.sum(F.col("times") * (F.log10(F.coalesce("n", F.lit(0)) + 1.0) - F.log10(F.lit(float(sums["n"] + sums["v"] + 1))))).alias("tail_score"),
    )
    return scored.join(found, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("head_known") + F.coalesce("tail_known", F.lit(0))).alias("n_known"),
        F.lit(int(sums["n"])).cast("long").alias("train_tokens"),
        (F.col("head_score") + F.coalesce("tail_score", F.lit(0.0))).alias("base_score"),
        "score",
    )
