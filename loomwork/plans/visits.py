"""What visits have made of pages, and when the next ones are due."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import cron, locks, page_state
from .registry import query


def _visits(table) -> DataFrame:
    """Events as visits of the page that user_id names: what was answered follows from the event's type and the last digit of its value."""
    d = (F.round(F.col("value") * 100).cast("long") % 10).alias("d")
    e = table("events").select("event_id", "ts", "user_id", "event_type", d)
    kind, d = F.col("event_type"), F.col("d")
    return e.select(
        F.col("user_id").alias("page"), "ts", "event_id",
        F.when((kind == "error") & (d < 3), 500).when((kind == "error") & (d < 6), 404).when((kind == "error") & (d < 8), 403).otherwise(200).alias("http_status"),
        ((kind == "error") & (d == 9)).alias("auth"),
        F.when((kind == "signup") & (d == 0), 60 << 20).otherwise(1000).alias("raw_size"),
        ((kind == "signup") & (d == 1)).alias("failed"),
        F.when((kind == "error") & (d > 0) | (kind == "signup") & (d == 2), 0).when((kind == "signup") & (d == 3), 10).otherwise(500).alias("words"),
        F.when((kind == "error") & (d > 3) | (kind == "signup") & (d == 2), 0).when((kind == "signup") & (d == 3), 60).when((kind == "signup") & (d == 4), 200_000).otherwise(3000).alias("chars"),
        ((kind == "click") & (d == 1)).alias("duplicate"),
        ((kind == "click") & (d == 2)).alias("ignored"),
        ((kind == "purchase") | (kind == "error") | (d == 7)).alias("changed"),
    )


def visit_results(table) -> DataFrame:
    v = _visits(table)
    kind = page_state.result_kind(*(F.col(c) for c in ("http_status", "auth", "raw_size", "failed", "words", "chars", "duplicate")))
    return v.select("page", "ts", "event_id", F.when(F.col("ignored"), "ignored").otherwise(kind).alias("kind"), "changed")


_VISITS = """e AS (SELECT event_id, ts, user_id AS page, event_type AS k, CAST(round(value * 100) AS BIGINT) % 10 AS d FROM events),
v AS (SELECT page, ts, event_id, CASE WHEN k = 'click' AND d = 2 THEN 'ignored' WHEN k = 'error' AND d = 9 THEN 'auth' WHEN k = 'error' AND d < 3 THEN 'http_5xx' WHEN k = 'signup' AND d = 0 THEN 'raw_too_big'
  WHEN k = 'error' AND d IN (6, 7) THEN 'denied' WHEN k = 'error' AND d IN (4, 5) THEN 'http_4xx' WHEN k = 'signup' AND d = 1 THEN 'failed' WHEN k = 'error' AND d = 8 OR k = 'signup' AND d = 2 THEN 'no_content'
  WHEN k = 'signup' AND d = 3 THEN 'low_content' WHEN k = 'signup' AND d = 4 THEN 'too_big' WHEN k = 'click' AND d = 1 THEN 'duplicate' ELSE 'ok' END AS kind, (k IN ('purchase', 'error') OR d = 7) AS changed FROM e)"""


@query(f"WITH {_VISITS} SELECT kind, changed, count(*) AS visits, count(DISTINCT page) AS pages FROM v GROUP BY 1, 2")
def visit_kinds(table):
    """How visits ended, by the ordered chain of conditions."""
    return visit_results(table).groupBy("kind", "changed").agg(F.count("*").alias("visits"), F.count_distinct("page").alias("pages"))


_FOLD = f"""WITH RECURSIVE {_VISITS}, o AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY ts, event_id) AS i, kind IN ('low_content', 'too_big', 'duplicate', 'ok') AS read, kind IN ('http_5xx', 'http_4xx', 'denied') AS counts FROM v),
r AS (SELECT page, CAST(0 AS BIGINT) AS i, CAST(NULL AS VARCHAR) AS status, CAST(NULL AS VARCHAR) AS error, 0 AS errors, 7 AS interval, 0 AS stable, 0 AS n_new, 0 AS n_changed, 0 AS n_crawled, 0 AS n_errors, 0 AS n_excluded FROM (SELECT DISTINCT page FROM v) UNION ALL
  SELECT page, o.i,
    CASE WHEN still THEN 'ready' WHEN kind = 'http_5xx' THEN 'crawler' WHEN kind = 'ok' AND (changed OR o.i = 1) THEN 'parsing' ELSE 'ready' END,
    CASE WHEN still THEN 'excluded_ignored' WHEN kind = 'auth' THEN 'excluded_auth' WHEN kind = 'http_5xx' THEN 'http_5xx' WHEN kind IN ('raw_too_big', 'too_big') THEN 'too_big' WHEN kind IN ('http_4xx', 'denied') THEN 'http_4xx' WHEN kind = 'failed' THEN 'extraction_failed' WHEN kind = 'no_content' THEN 'no_content' WHEN kind = 'low_content' THEN 'low_content' WHEN kind = 'duplicate' THEN 'duplicate_content' WHEN kind = 'ignored' THEN 'excluded_ignored' END,
    CASE WHEN still THEN errors WHEN counts THEN errors + 1 ELSE 0 END,
    CASE WHEN still THEN interval WHEN kind = 'http_4xx' AND errors + 1 >= 2 OR kind = 'denied' AND errors + 1 >= 3 THEN 90 WHEN NOT read THEN interval WHEN changed THEN greatest(1, interval // 2) ELSE least(90, interval * 3 // 2) END,
    CASE WHEN still OR NOT read THEN stable WHEN changed THEN 0 ELSE stable + 1 END,
    n_new + CAST(kind = 'ok' AND o.i = 1 AS INT), n_changed + CAST(NOT still AND kind = 'ok' AND changed AND o.i > 1 AS INT), n_crawled + CAST(NOT still AND kind = 'ok' AND NOT changed AND o.i > 1 AS INT), n_errors + CAST(counts OR kind = 'failed' AS INT),
    n_excluded + CAST(still OR kind IN ('auth', 'raw_too_big', 'no_content', 'low_content', 'too_big', 'duplicate', 'ignored') AS INT)
  FROM (SELECT r.page, r.i + 1 AS i, r.* EXCLUDE (page, i), o.* EXCLUDE (page, i), o.read AND coalesce(r.error = 'excluded_ignored', false) AS still FROM r JOIN o ON o.page = r.page AND o.i = r.i + 1) o)"""


@query(f"""{_FOLD} SELECT page, status, error AS status_error, CAST(errors AS BIGINT) AS error_count, CAST(interval AS BIGINT) AS check_interval, CAST(stable AS BIGINT) AS stable_count, i AS n_results,
CAST(n_new AS BIGINT) AS pages_new, CAST(n_changed AS BIGINT) AS pages_changed, CAST(n_crawled AS BIGINT) AS pages_crawled, CAST(n_errors AS BIGINT) AS pages_errors, CAST(n_excluded AS BIGINT) AS pages_excluded FROM r WHERE i > 0 QUALIFY row_number() OVER (PARTITION BY page ORDER BY i DESC) = 1""")
def page_states(table):
    """Status, error, error count, interval and counters of every page after all its visits."""
    return page_state.page_states(visit_results(table), "page", ["ts", "event_id"], "kind", "changed")


CRONS = ["*/5 * * * *", "15 9 * * *", "0 0 1 1 *", "30 8-18/2 * * 1-5", "0,20,40 22-2 * * *", "0 0 31 * *", "59 23 29 2 *", "0 12 13 * 5", "manual", "61 * * * *", "* * * *", " 0  6 * * SUN,mon ", "5 5 29 feb 1"]
#: The same schedules as conditions on a day d, an hour h and a minute m; week days from Sunday.
_CRON_SQL = {
    0: "m % 5 = 0", 1: "h = 9 AND m = 15", 2: "month(d) = 1 AND day(d) = 1 AND h = 0 AND m = 0", 3: "dayofweek(d) BETWEEN 1 AND 5 AND h IN (8, 10, 12, 14, 16, 18) AND m = 30", 4: "h IN (22, 23, 0, 1, 2) AND m IN (0, 20, 40)",
    5: "day(d) = 31 AND h = 0 AND m = 0", 6: "month(d) = 2 AND day(d) = 29 AND h = 23 AND m = 59", 7: "day(d) = 13 AND dayofweek(d) = 5 AND h = 12 AND m = 0", 11: "dayofweek(d) IN (0, 1) AND h = 6 AND m = 0", 12: "month(d) = 2 AND day(d) = 29 AND dayofweek(d) = 1 AND h = 5 AND m = 5",
}
_FIRES = f"""days AS (SELECT CAST(d AS DATE) AS d FROM generate_series(TIMESTAMP '2023-01-01', TIMESTAMP '2045-01-01', INTERVAL 1 DAY) g(d)), near AS (SELECT * FROM days WHERE d < DATE '2024-06-01'),
hm AS (SELECT h, m FROM range(24) a(h), range(60) b(m)),
fires AS ({" UNION ALL ".join(f"SELECT {n} AS cron_no, d + to_hours(h) + to_minutes(m) AS fire FROM {'days' if n in (6, 12) else 'near' if n in (0, 3, 4) else 'days'}, hm WHERE {c}" for n, c in _CRON_SQL.items())})"""


@query(f"""WITH {_FIRES} SELECT event_id, CAST(epoch(fire) AS BIGINT) AS next_fire FROM (SELECT event_id, ts, event_id % {len(CRONS)} AS cron_no FROM events) e ASOF LEFT JOIN fires f ON e.cron_no = f.cron_no AND e.ts < f.fire""")
def next_fires(table):
    """When a schedule fires next after each event; the schedules take turns."""
    cron_of = F.element_at(F.array(*map(F.lit, CRONS)), (F.col("event_id") % len(CRONS) + 1).cast("int"))
    e = table("events").select("event_id", F.col("ts").cast("timestamp").cast("long").alias("at"), cron_of.alias("cron"))
    return cron.next_fires(e, "cron", "at").select("event_id", "next_fire")


@query(f"""WITH {_FIRES}, s AS (SELECT user_id, user_id % {len(CRONS)} AS cron_no, max(ts) AS last_at FROM events GROUP BY 1), n AS (SELECT max(ts) AS now FROM events)
SELECT user_id, s.cron_no IN ({", ".join(map(str, [*_CRON_SQL, 8]))}) AS valid, coalesce(fire <= date_trunc('second', now), false) AS due FROM s ASOF LEFT JOIN fires f ON s.cron_no = f.cron_no AND s.last_at < f.fire, n""")
def due_sources(table):
    """Which users' schedules have fired since their last event, at the time of the last event of all."""
    last = table("events").groupBy("user_id").agg(F.max("ts").cast("timestamp").cast("long").alias("last_at"))
    now = F.broadcast(table("events").agg(F.max("ts").cast("timestamp").cast("long").alias("now")))
    cron_of = F.element_at(F.array(*map(F.lit, CRONS)), (F.col("user_id") % len(CRONS) + 1).cast("int"))
    s = last.crossJoin(now).withColumn("cron", cron_of)
    return s.select("user_id", cron.is_valid(F.col("cron")).alias("valid"), cron.is_due(cron.masks(F.col("cron")), F.col("last_at"), F.col("now")).alias("due"))


LOCK_MS, LOCK_AFTER = 21_600_000, 3


@query(f"""WITH RECURSIVE f AS (SELECT user_id, epoch_us(ts) // 1000 AS t FROM events WHERE event_type = 'error'), w AS (
  SELECT user_id, min(t) AS s FROM f GROUP BY 1 UNION ALL SELECT w.user_id, (SELECT min(t) FROM f WHERE f.user_id = w.user_id AND t >= w.s + {LOCK_MS}) FROM w WHERE s IS NOT NULL),
p AS (SELECT w.user_id, s, t, row_number() OVER (PARTITION BY w.user_id, s ORDER BY t) AS k FROM w JOIN f ON f.user_id = w.user_id AND t >= s AND t < s + {LOCK_MS})
SELECT user_id, s AS window_start, count(*) AS failures, min(t) FILTER (k = {LOCK_AFTER}) AS locked_at, CASE WHEN count(*) >= {LOCK_AFTER} THEN max(t) + {LOCK_MS} END AS locked_until FROM p GROUP BY 1, 2""")
def failure_windows(table):
    """Errors of each user in windows that begin with the first one, and the locks that three in a window set."""
    errors = table("events").where("event_type = 'error'").select("user_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("t"))
    return locks.failure_windows(errors, "user_id", "t", LOCK_MS, LOCK_AFTER)
