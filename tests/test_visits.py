"""Page states against a plain fold, however partitions cut histories; cron schedules against trying every minute."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwork.operators import cron
from loomwork.operators import page_state as P
from loomwork.plans import visits

KINDS = list(P.RESULTS)


def plain(history):
    """The rules once more, for one page: [(kind, changed)] to a row of page_states."""
    status = error = None
    errors, interval, stable, seen, n = 0, 7, 0, False, dict.fromkeys(P.COUNTERS, 0)
    for kind, changed in history:
        read = kind in ("ok", "low_content", "too_big", "duplicate")
        if read and error == "excluded_ignored":
            status, seen = "ready", True
            n["pages_excluded"] += 1
            continue
        if kind in ("http_4xx", "http_5xx", "denied"):
            errors += 1
            if (kind == "http_4xx" and errors >= 2) or (kind == "denied" and errors >= 3):
                interval = 90
            n["pages_errors"] += 1
        else:
            errors = 0
        if read:
            stable, interval = (0, max(1, interval // 2)) if changed else (stable + 1, min(90, int(interval * 1.5)))
        if kind == "ok":
            n["pages_new" if not seen else "pages_changed" if changed else "pages_crawled"] += 1
        elif kind == "failed":
            n["pages_errors"] += 1
        elif kind not in ("http_4xx", "http_5xx", "denied"):
            n["pages_excluded"] += 1
        status = "crawler" if kind == "http_5xx" else "parsing" if kind == "ok" and (changed or not seen) else "ready"
        error = {"auth": "excluded_auth", "raw_too_big": "too_big", "denied": "http_4xx", "failed": "extraction_failed", "duplicate": "duplicate_content", "ok": None, "ignored": "excluded_ignored"}.get(kind, kind)
        seen = True
    return (status, error, errors, interval, stable, len(history), *n.values())


def folded(spark, rows, parts):
    df = spark.createDataFrame(rows, "page string, at long, kind string, changed boolean, state string").repartition(3)
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        return {r["page"]: tuple(r[1:]) for r in P.page_states(df, "page", ["at"], "kind", "changed").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("seed, parts", [(0, 1), (1, 3), (2, 16), (3, 16)])
def test_histories_may_be_cut_anywhere(spark, seed, parts):
    """One page has most rows and goes over many partitions; runs of errors, intervals and ignored pages go over cuts."""
    rng = np.random.default_rng(seed)
    weights = {0: None, 1: None, 2: [1, 8, 1, 8, 8, 1, 1, 1, 1, 1, 3, 1], 3: [1, 1, 1, 1, 1, 1, 1, 1, 1, 1, 90, 1]}[seed]
    p = np.array(weights or [1] * len(KINDS)) / sum(weights or [1] * len(KINDS))
    rows = [("hot" if rng.random() < 0.6 else f"p{rng.integers(0, 25)}", i, str(rng.choice(KINDS, p=p)), [True, False, None][rng.integers(0, 3)], "x") for i in range(1500)]
    want = {}
    for page, _, kind, changed, _ in rows:
        want.setdefault(page, []).append((kind, bool(changed)))
    assert folded(spark, rows, parts) == {page: plain(h) for page, h in want.items()}


def test_states_run_together():
    for ignored in (False, True):
        starts = [s for s in P.FROM if s.ignored == ignored]
        fold = P.Fold(starts)
        for kind in ["ok"] * 12:
            fold.add(kind, True)
        assert len(fold.of) == len(starts) and (fold.waiting == 12 if ignored else len(fold.states) <= 2)
        for kind in ["http_4xx"] * 3:
            fold.add(kind, False)
        want = [s for s in starts]
        for kind, changed in [("ok", True)] * 12 + [("http_4xx", False)] * 3:
            want = [s.then(kind, changed) for s in want]
        assert [fold.ends()[n] for n in fold.of] == want


def test_page_states_of_odd_rows(spark):
    rows = [(None, 1, "ok", True, "x"), ("a", 1, "denied", False, "x"), ("a", 2, "denied", False, "x"), ("a", 3, "denied", False, "x"), ("b", 1, "http_4xx", None, "x"), ("c", None, "ok", None, "x")]
    got = folded(spark, rows, 4)
    assert got["a"][:4] == ("ready", "http_4xx", 3, 90) and got["b"][:4] == ("ready", "http_4xx", 1, 7) and got["c"][:4] == ("parsing", None, 0, 10) and len(got) == 3
    assert folded(spark, [], 4) == {}


@pytest.mark.parametrize("row, kind", [
    ((200, None, 10, None, 100, 900, None), "ok"), ((200, True, 10, None, 100, 900, None), "auth"), ((503, None, None, None, None, None, None), "http_5xx"), ((200, None, 99 << 20, None, 100, 900, None), "raw_too_big"), ((404, None, 10, None, None, None, None), "http_4xx"),
    ((404, None, 10, None, 100, 900, None), "ok"), ((403, None, 10, None, 0, 0, None), "denied"), ((200, None, 10, True, 100, 900, None), "failed"), ((None, None, None, None, None, None, None), "no_content"), ((200, None, 10, None, 40, 250, None), "low_content"),
    ((200, None, 10, None, 41, 250, None), "ok"), ((200, None, 10, None, 5000, 100_001, None), "too_big"), ((200, None, 10, None, 5000, 100_000, True), "duplicate"),
])
def test_kinds_of_results(spark, row, kind):
    names = ["http_status", "auth", "raw_size", "failed", "words", "chars", "duplicate"]
    df = spark.createDataFrame([row], "http_status int, auth boolean, raw_size long, failed boolean, words int, chars int, duplicate boolean")
    assert df.select(P.result_kind(*map(F.col, names))).first()[0] == kind


FIELDS = [range(60), range(24), range(1, 32), range(1, 13), range(7)]


def numbers(field, i):
    """The numbers of a cron field, by reading it plainly."""
    names = {4: cron.WEEKDAYS, 3: ["", *cron.MONTHS]}.get(i, [])
    out, every = set(), list(FIELDS[i])
    for part in field.split(","):
        span, _, step = part.partition("/")
        read = lambda s: (names.index(s) if s in names else int(s)) % (7 if i == 4 else 100)
        if span == "*":
            own = every
        elif "-" in span:
            a, b = map(read, span.split("-"))
            own = [every[(every.index(a) + k) % len(every)] for k in range((b - a) % len(every) + 1)]
        else:
            own = [read(span)]
        out.update(own[:: int(step or 1)])
    return out


def fire(expression, after):
    sets = [numbers(f, i) for i, f in enumerate(expression.lower().split())]
    t = after.replace(second=0, microsecond=0) + dt.timedelta(minutes=1)
    for _ in range(366 * 41):
        if t.month in sets[3] and t.day in sets[2] and (t.weekday() + 1) % 7 in sets[4]:
            for h in range(t.hour, 24):
                for m in range(t.minute if h == t.hour else 0, 60):
                    if h in sets[1] and m in sets[0]:
                        return t.replace(hour=h, minute=m)
        t = t.replace(hour=0, minute=0) + dt.timedelta(days=1)
    return None


def test_next_fires_match_trying(spark):
    rng = np.random.default_rng(6)
    crons = ["* * * * *", "*/5 * * * *", "0 0 * * *", "59 23 31 12 *", "0 0 29 2 *", "0 0 29 2 3", "15,45 9-17 * * 1-5", "0 22-2 * * *", "7-52/15 */7 1,15 * *", "0 12 * jan-mar mon", "30 6 * * 7", "0 0 31 2 *", "10 10 28-2 * sat-mon", "5 4 * * sun,3", "0 0 30 4,6,9,11 *"]
    starts = [dt.datetime(2024, 2, 28, 23, 59, 30), dt.datetime(2023, 12, 31, 23, 59), dt.datetime(2097, 3, 1), dt.datetime(1999, 12, 31, 12), dt.datetime(1969, 7, 1, 0, 0, 1)] + [dt.datetime(2000, 1, 1) + dt.timedelta(seconds=int(s)) for s in rng.integers(0, 10**9, 12)]
    epoch = lambda t: int((t - dt.datetime(1970, 1, 1)).total_seconds())
    rows = [(c, epoch(t)) for c in crons for t in starts]
    df = spark.createDataFrame(rows, "cron string, at long")
    got = {(r["cron"], r["at"]): r["n"] for r in df.select("cron", "at", cron.next_fire(cron.masks(F.col("cron")), F.col("at")).alias("n")).collect()}
    want = {(c, epoch(t)): fire(c, t) for c in crons for t in starts}
    assert got == {k: None if v is None else epoch(v) for k, v in want.items()}


def test_valid_and_due(spark):
    valid = {"": True, None: True, "manual": True, " Manual ": True, "0 0 1 1 *": True, "invalid": False, "* * * *": False, "* * * * * *": False, "60 * * * *": False, "* 24 * * *": False, "* * 0 * *": False, "* * * 13 *": False, "* * * * 8": False, "*/0 * * * *": False, "5/2 * * * *": False, "a * * * *": False, "1-x * * * *": False, "1,,2 * * * *": False, "0  0\t* * mon": True}
    df = spark.createDataFrame([(c,) for c in valid], "cron string")
    assert {r["cron"]: r["v"] for r in df.select("cron", cron.is_valid(F.col("cron")).alias("v")).collect()} == valid
    at = lambda *a: int(dt.datetime(*a, tzinfo=dt.UTC).timestamp())
    now = at(2026, 6, 3, 10, 0)
    rows = [("15 9 * * *", at(2026, 6, 2, 8), True), ("15 9 * * *", at(2026, 6, 3, 9, 30), False), ("15 9 * * *", None, True), ("manual", None, False), ("bad", None, False), ("0 10 * * *", at(2027, 1, 1), False), ("0 10 * * *", at(2026, 6, 3, 9, 59), True)]
    due = spark.createDataFrame(rows, "cron string, baseline long, want boolean")
    assert due.where(cron.is_due(cron.masks(F.col("cron")), F.col("baseline"), F.lit(now)) != F.col("want")).count() == 0
    now_rows = spark.createDataFrame([("* * * * *", True), ("0 0 1 1 *", False), ("invalid", False), ("0 10 3 6 *", True)], "cron string, want boolean")
    assert now_rows.where(cron.matches(cron.masks(F.col("cron")), F.lit(now + 59)) != F.col("want")).count() == 0


def test_fires_by_schedule_and_day_equal_those_by_row(spark):
    crons = [*visits.CRONS, None, "", "0 0 30 2 *"]
    rows = [(i, crons[i % len(crons)], None if i % 50 == 7 else 1_700_000_000 + i * 7919 - (i % 5) * 10**8) for i in range(600)] + [(999, "* * * * *", -61)]
    df = spark.createDataFrame(rows, "id int, cron string, at long")
    got = cron.next_fires(df, "cron", "at", "n")
    assert got.columns == [*df.columns, "n"] and "aggregate" not in got._jdf.queryExecution().optimizedPlan().toString()  # no schedule is read for a row
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in df.select("*", cron.next_fire(cron.masks(F.col("cron")), F.col("at"))).collect()} and got.count() == 601
