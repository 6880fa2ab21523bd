"""What has become of a page after all its visits: an ordered fold of results, cut where partitions end.

A page's history may be long, so no task is given it whole. Results are sorted by page and time over all partitions, and each
task folds what it has. Where a page goes on from an earlier partition its state is not known there; the task then folds from
every state that matters at once (FROM), which soon run together. The few rows that tasks send for such pages, one a
partition, are put together in order.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import store
from .policy import first_match

DEFAULT_INTERVAL, MOST_INTERVAL = 7, 90
COUNTERS = ["pages_new", "pages_changed", "pages_crawled", "pages_errors", "pages_excluded"]
NEW, CHANGED, CRAWLED, ERRORS, EXCLUDED = range(5)


class Result(NamedTuple):
    """What a kind of result does: the status and error it leaves; the counter it goes to; whether it counts up the page's errors,
    and after how many in a row the page is visited at the longest interval; whether it was a visit that read the page's text."""

    status: str
    error: str | None
    counter: int
    counts: bool = False
    slow_after: int = 0
    read: bool = False


#: Results of visits by kind.
RESULTS = {
    "auth": Result("ready", "excluded_auth", EXCLUDED),
    "http_5xx": Result("crawler", "http_5xx", ERRORS, counts=True),
    "raw_too_big": Result("ready", "too_big", EXCLUDED),
    "http_4xx": Result("ready", "http_4xx", ERRORS, counts=True, slow_after=2),
    "denied": Result("ready", "http_4xx", ERRORS, counts=True, slow_after=3),
    "failed": Result("ready", "extraction_failed", ERRORS),
    "no_content": Result("ready", "no_content", EXCLUDED),
    "low_content": Result("ready", "low_content", EXCLUDED, read=True),
    "too_big": Result("ready", "too_big", EXCLUDED, read=True),
    "duplicate": Result("ready", "duplicate_content", EXCLUDED, read=True),
    "ok": Result("parsing", None, CRAWLED, read=True),
    "ignored": Result("ready", "excluded_ignored", EXCLUDED),
}
IGNORED = "excluded_ignored"
_SLOW = max(r.slow_after for r in RESULTS.values())


def result_kind(http_status: Column, auth: Column, raw_size: Column, failed: Column, words: Column, chars: Column, duplicate: Column, most_raw: int = 50 << 20, most_chars: int = 100_000) -> Column:
    """The kind of a visit: the first of an ordered chain. A 4xx answer with text is read as a page. words and chars of the text found in it, null or 0 without one."""
    text = F.coalesce(chars, F.lit(0)) > 0
    return first_match(
        [
            (F.coalesce(auth, F.lit(False)), "auth"), (http_status >= 500, "http_5xx"), (raw_size > most_raw, "raw_too_big"), (http_status.isin(401, 403) & ~text, "denied"), (http_status.between(400, 499) & ~text, "http_4xx"),
            (F.coalesce(failed, F.lit(False)), "failed"), (~text, "no_content"), ((words <= 40) & (chars <= 250), "low_content"), (chars > most_chars, "too_big"), (F.coalesce(duplicate, F.lit(False)), "duplicate"),
        ],
        "ok",
    )


class State(NamedTuple):
    """errors and stable are since reset and stable_reset, or since the start; status None: as at the start."""

    seen: bool = False
    ignored: bool = False
    status: str | None = None
    error: str | None = None
    errors: int = 0
    reset: bool = False
    interval: int = DEFAULT_INTERVAL
    stable: int = 0
    stable_reset: bool = False
    counters: tuple[int, ...] = (0,) * len(COUNTERS)

    def then(self, kind: str, changed: bool) -> State:
        r = RESULTS[kind]
        if r.read and self.ignored:
            return self.still(1)
        if not r.read:
            errors = self.errors + 1 if r.counts else 0
            interval = MOST_INTERVAL if r.slow_after and errors >= r.slow_after else self.interval
            return self._replace(seen=True, ignored=r.error == IGNORED, status=r.status, error=r.error, errors=errors, reset=self.reset or not r.counts, interval=interval, counters=self._counted(r.counter))
        interval = max(1, self.interval // 2) if changed else min(MOST_INTERVAL, self.interval * 3 // 2)
        counter = r.counter if r.error else CHANGED if changed else CRAWLED
        return State(
            True, False, r.status if r.error or changed or not self.seen else "ready", r.error, 0, True, interval, 0 if changed else self.stable + 1, self.stable_reset or changed,
            self._counted(counter if r.error or self.seen else NEW),
        )

    def still(self, times: int) -> State:
        """After reading an ignored page so often: it stays as it is until a visit fails."""
        return self._replace(seen=True, status="ready", error=IGNORED, counters=self._counted(EXCLUDED, times))

    def _counted(self, counter: int, times: int = 1) -> tuple[int, ...]:
        return tuple(n + times * (i == counter) for i, n in enumerate(self.counters))

    def after(self, before: State, start: State) -> State:
        """This end of a fold that began at start, for a page that was at before, which start stands for."""
        return self._replace(
            status=self.status or before.status, error=self.error if self.status else before.error, errors=self.errors if self.reset else before.errors + self.errors - start.errors,
            stable=self.stable if self.stable_reset else before.stable + self.stable, counters=tuple(a + b for a, b in zip(self.counters, before.counters, strict=True)),
        )


#: Every state that tells pages apart: unseen; seen, ignored or not, errors as far as they matter, interval.
FROM = [State()] + [State(True, ignored, errors=e, interval=i) for ignored in (False, True) for e in range(_SLOW + 1) for i in range(1, MOST_INTERVAL + 1)]
_PLACE = {s: n for n, s in enumerate(FROM)}


def place_of(s: State) -> int:
    return _PLACE[State(True, s.ignored, errors=min(s.errors, _SLOW), interval=s.interval)] if s.seen else 0


class Fold:
    """States that have come of starts which are all ignored, or all not; as results treat them alike there, they stay so.

    Equal states are one from then on. What is read of ignored pages changes nothing but one counter, so it is only counted until
    something else happens.
    """

    def __init__(self, starts: list[State]):
        self.states, self.of, self.waiting = list(dict.fromkeys(starts)), list(range(len(starts))), 0

    def add(self, kind: str, changed: bool) -> None:
        if RESULTS[kind].read and self.states[0].ignored:
            self.waiting += 1
            return
        ends = [s.then(kind, changed) for s in self.ends()]
        self.states, self.waiting = list(dict.fromkeys(ends)), 0
        if len(self.states) < len(ends):
            at = {s: n for n, s in enumerate(self.states)}
            moved = [at[s] for s in ends]
            self.of = [moved[n] for n in self.of]

    def ends(self) -> list[State]:
        return [s.still(self.waiting) for s in self.states] if self.waiting else self.states


_STATE = pa.struct([
    ("seen", pa.bool_()), ("ignored", pa.bool_()), ("status", pa.string()), ("error", pa.string()), ("errors", pa.int64()), ("reset", pa.bool_()), ("interval", pa.int64()), ("stable", pa.int64()), ("stable_reset", pa.bool_()), ("counters", pa.list_(pa.int64())),
])
_STATE_SQL = "struct<seen:boolean,ignored:boolean,status:string,error:string,errors:bigint,reset:boolean,interval:bigint,stable:bigint,stable_reset:boolean,counters:array<bigint>>"


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each page of a sorted partition; its first page may have begun before."""
    part, page, folds, first, n, rows = TaskContext.get().partitionId(), None, [], True, 0, []

    def out() -> pa.RecordBatch:
        types = [kind, pa.int32(), pa.int64(), pa.list_(_STATE), pa.list_(pa.int32())]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], ["page", "part", "n_results", "ends", "of"])

    def ended() -> tuple:
        before = [sum(len(f.states) for f in folds[:i]) for i in range(len(folds))]
        of = [b + n for b, f in zip(before, folds, strict=True) for n in f.of]
        return page, part, n, [s._asdict() for f in folds for s in f.ends()], of if first else None

    for batch in batches:
        kind = batch.schema.field("page").type
        for p, k, c in zip(*(batch[name].to_pylist() for name in ("page", "kind", "changed")), strict=True):
            if not folds or p != page:
                if folds:
                    rows.append(ended())
                    first = False
                    if len(rows) >= 5000:
                        yield out()
                        rows = []
                starts = [[State()]] if folds else [[s for s in FROM if s.ignored == ignored] for ignored in (False, True)]
                page, n, folds = p, 0, [Fold(own) for own in starts]
            for fold in folds:
                fold.add(k, bool(c))
            n += 1
    if folds:
        rows.append(ended())
        yield out()


def _joined(key: tuple, table: pa.Table) -> pa.Table:
    """The end of a page's history from the runs of its partitions."""
    now, n = State(), 0
    for row in sorted(table.to_pylist(), key=lambda r: r["part"]):
        at = place_of(now)
        end = row["ends"][row["of"][at] if row["of"] else 0]
        now, n = State(**end | {"counters": tuple(end["counters"])}).after(now, FROM[at]), n + row["n_results"]
    return pa.table({"page": table["page"].slice(0, 1), "n_results": pa.array([n], pa.int64()), "state": pa.array([now._asdict()], _STATE)})


def page_states(results: DataFrame, page: str, order: list[str], kind: str, changed: str) -> DataFrame:
    """(page, status, status_error, error_count, check_interval, stable_count, n_results, and COUNTERS) of each page.

    results has a row for each visit: kind (of RESULTS) and whether the text had changed; visits of a page are taken by order,
    which should be total. Errors of a page count up in a row of failures; the interval to the next visit is halved
    after a change, half as long again without one, and the longest after repeated 4xx answers. A page set to be ignored stays so
    until a visit fails. A null changed is no change; rows without a page are left out; no rows give no rows.
    """
    rows = results.where(F.col(page).isNotNull()).select(F.col(page).alias("page"), *(F.col(c).alias(f"_o{i}") for i, c in enumerate(order)), F.col(kind).alias("kind"), F.col(changed).alias("changed"))
    by = ["page", *(f"_o{i}" for i in range(len(order)))]
    type_ = rows.schema["page"].dataType.simpleString()
    runs = rows.repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(_runs, f"page {type_}, part int, n_results bigint, ends array<{_STATE_SQL}>, of array<int>")
    runs = store.written(runs, "page-runs")
    # A page for each partition at most.
    open_ = F.broadcast(runs.where("of is not null").select("page").distinct())
    whole = runs.join(open_, "page", "left_anti").select("page", "n_results", F.col("ends")[0].alias("state"))
    parts = runs.join(open_, "page", "left_semi").groupBy("page").applyInArrow(_joined, f"page {type_}, n_results bigint, state {_STATE_SQL}")
    s = whole.unionByName(parts)
    return s.select(
        F.col("page").alias(page), F.col("state.status").alias("status"), F.col("state.error").alias("status_error"), F.col("state.errors").alias("error_count"), F.col("state.interval").alias("check_interval"),
        F.col("state.stable").alias("stable_count"), "n_results", *(F.col("state.counters")[i].alias(c) for i, c in enumerate(COUNTERS)),
    )
