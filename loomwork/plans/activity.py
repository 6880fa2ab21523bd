"""Queries over events and conversations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import analytics as A
from .registry import query


@query("""SELECT date_trunc('day', ts + INTERVAL 3 HOUR)::TIMESTAMP AS day, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1""")
def daily_activity(table):
    """Events and users a local day."""
    e = table("events").withColumn("day", A.local_day(F.col("ts"), 3))
    return e.groupBy("day").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))


@query("""SELECT date_trunc('day', ts)::TIMESTAMP AS day, count(*) FILTER (event_type = 'purchase') AS purchases,
CAST(coalesce(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END), 0) AS BIGINT) AS errors, round(sum(CASE WHEN event_type = 'purchase' THEN value ELSE 0 END), 4) AS revenue
FROM events GROUP BY 1""")
def daily_conditional_counts(table):
    when = lambda kind, v: F.when(F.col("event_type") == kind, v)
    return table("events").groupBy(A.local_day(F.col("ts")).alias("day")).agg(
        F.count(when("purchase", 1)).alias("purchases"), F.sum(when("error", 1).otherwise(0)).alias("errors"), F.round(F.sum(when("purchase", F.col("value")).otherwise(0.0)), 4).alias("revenue")
    )


@query("""WITH d AS (SELECT date_trunc('day', ts)::TIMESTAMP AS day, count(*) AS n FROM events GROUP BY 1),
c AS (SELECT unnest(generate_series((SELECT min(day) FROM d), (SELECT max(day) FROM d), INTERVAL 1 DAY)) AS day)
SELECT c.day, coalesce(n, 0) AS n FROM c LEFT JOIN d USING (day)""")
def gap_filled_calendar(table):
    """Events of each day, with the days that have none."""
    d = table("events").groupBy(A.local_day(F.col("ts")).alias("day")).agg(F.count("*").alias("n"))
    return A.gap_filled(d, "day", ["n"])


@query("""SELECT event_type, user_id % 3 AS tier, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2""")
def usage_by_type(table):
    return table("events").groupBy("event_type", (F.col("user_id") % 3).alias("tier")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("""SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.9) AS p90, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY 1""")
def percentiles(table):
    return A.nearest_rank(table("events"), ["event_type"], "value", [50, 90, 95])


@query("""WITH i AS (SELECT event_type, epoch_ms(ts) AS s, epoch_ms(ts) + CAST(floor(value * 1000) AS BIGINT) AS e FROM events),
p AS (SELECT event_type, t, d, sum(d) AS n FROM (SELECT event_type, s AS t, 1 AS d FROM i UNION ALL SELECT event_type, e, -1 FROM i) GROUP BY ALL),
o AS (SELECT event_type, sum(n) OVER (PARTITION BY event_type ORDER BY t, d DESC ROWS UNBOUNDED PRECEDING) AS open FROM p)
SELECT event_type, CAST(max(open) AS BIGINT) AS peak FROM o GROUP BY 1""")
def peak_concurrency(table):
    """Events as intervals of value seconds."""
    e = table("events").select("event_type", A.millis("ts").alias("s"), (A.millis("ts") + F.floor(F.col("value") * 1000)).alias("e"))
    return A.peak_concurrency(e, ["event_type"], "s", "e")


@query("""SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_ms(ts) RANGE BETWEEN 59999 PRECEDING AND CURRENT ROW) AS n_recent FROM events""")
def sliding_count(table):
    return A.sliding_count(table("events"), ["user_id"], "ts", 60).select("event_id", "user_id", "n_recent")


@query("""WITH m AS (SELECT user_id, ts, CASE WHEN epoch_ms(ts) - epoch_ms(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) < 14400000 THEN 0 ELSE 1 END AS new FROM events),
k AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM m)
SELECT user_id, min(ts)::TIMESTAMP AS session_start, max(ts)::TIMESTAMP AS session_end, count(*) AS n_events FROM k GROUP BY user_id, k""")
def sessions(table):
    """Idle timeout of four hours."""
    return A.sessions(table("events").select("user_id", "ts"), ["user_id"], "ts", 14_400)


@query("""SELECT date_trunc('hour', ts)::TIMESTAMP AS hour, count(*) AS n, count(*) FILTER (event_type = 'error') AS errors, round(count(*) FILTER (event_type = 'error') / count(*), 6) AS error_rate,
count(*) FILTER (event_type = 'error') / count(*) > 0.3 AS firing FROM events GROUP BY 1""")
def hourly_alerts(table):
    e = table("events").groupBy(F.date_trunc("hour", "ts").alias("hour")).agg(F.count("*").alias("n"), F.count(F.when(F.col("event_type") == "error", 1)).alias("errors"))
    return e.select("hour", "n", "errors", F.round(F.col("errors") / F.col("n"), 6).alias("error_rate"), (F.col("errors") / F.col("n") > 0.3).alias("firing"))


@query("""SELECT user_id, event_type, count(*) - 1 AS observed_again, round(sum(value) - arg_min(value, (ts, event_id)), 4) AS saved, max(ts)::TIMESTAMP AS last_seen FROM events GROUP BY 1, 2""")
def upsert_counters(table):
    return A.upsert_counters(table("events"), ["user_id", "event_type"], ["ts", "event_id"], "value").withColumn("saved", F.round("saved", 4))


@query("""SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY 1""")
def last_writer_wins(table):
    return A.last_writer(table("events"), ["user_id"], ["ts", "event_id"], ["event_type", "value"])


@query("""SELECT user_id, CAST(json_extract(props, '$.k') AS INT) % 10 AS k, count(*) AS n FROM events GROUP BY 1, 2""")
def json_property_counts(table):
    return table("events").groupBy("user_id", (F.get_json_object("props", "$.k").cast("int") % 10).alias("k")).agg(F.count("*").alias("n"))


@query("""WITH e AS (SELECT user_id, event_type, ts FROM events), r AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_type) AS rn FROM e)
SELECT user_id, bool_and(event_type IN ('error', 'view')) AS limited, count(*) AS n FROM r WHERE rn <= 3 GROUP BY 1""")
def last_three_streak(table):
    """Were a user's last three events all of the limited kinds?"""
    order = Window.partitionBy("user_id").orderBy(F.desc("ts"), "event_type")
    r = table("events").withColumn("rn", F.row_number().over(order)).where("rn <= 3")
    return r.groupBy("user_id").agg(F.every(F.col("event_type").isin("error", "view")).alias("limited"), F.count("*").alias("n"))


@query("""SELECT event_type, count(*) FILTER (value <= 1) AS le_1, count(*) FILTER (value <= 10) AS le_10, count(*) FILTER (value <= 100) AS le_100, count(*) AS le_inf FROM events GROUP BY 1""")
def histogram_buckets(table):
    """Cumulative buckets."""
    at_most = lambda b: F.count(F.when(F.col("value") <= b, 1)).alias(f"le_{b}")
    return table("events").groupBy("event_type").agg(at_most(1), at_most(10), at_most(100), F.count("*").alias("le_inf"))


@query("""SELECT conv_id, count(*) AS n_messages, CAST(sum(length(text)) AS BIGINT) AS n_chars, arg_min(text, turn) FILTER (role = 'user') AS first_question, count(*) FILTER (role = 'assistant') AS answers FROM conversations GROUP BY 1""")
def conversation_summary(table):
    user = F.col("role") == "user"
    return table("conversations").groupBy("conv_id").agg(
        F.count("*").alias("n_messages"), F.sum(F.length("text")).alias("n_chars"), F.min_by(F.when(user, F.col("text")), F.when(user, F.col("turn"))).alias("first_question"), F.count(F.when(F.col("role") == "assistant", 1)).alias("answers")
    )


@query("""WITH s AS (SELECT conv_id, count(*) AS n, max(length(text)) AS longest FROM conversations GROUP BY 1 HAVING count(*) FILTER (role = 'assistant') > 0)
SELECT conv_id, n, longest FROM s ORDER BY n DESC, conv_id OFFSET 10 LIMIT 20""")
def history_page(table):
    """The second page of ten-and-twenty: conversations with an answer, longest first."""
    s = table("conversations").groupBy("conv_id").agg(F.count("*").alias("n"), F.max(F.length("text")).alias("longest"), F.count(F.when(F.col("role") == "assistant", 1)).alias("a"))
    return s.where("a > 0").drop("a").orderBy(F.desc("n"), "conv_id").offset(10).limit(20)


@query("""WITH u AS (SELECT conv_id, turn, role, length(text) AS n, first_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_question FROM conversations)
SELECT conv_id, turn, n, next_question FROM u WHERE role = 'assistant'""")
def next_user_turn(table):
    order = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(1, Window.unboundedFollowing)
    u = table("conversations").withColumn("next_question", F.first(F.when(F.col("role") == "user", F.col("text")), ignorenulls=True).over(order))
    return u.where("role = 'assistant'").select("conv_id", "turn", F.length("text").alias("n"), "next_question")


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations), k AS (
SELECT *, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY rn ROWS UNBOUNDED PRECEDING) AS used FROM r)
SELECT conv_id, turn, length(text) AS n FROM k WHERE rn = 1 OR used <= 1500""")
def history_trim(table):
    """Newest messages within a budget of characters; the newest always stays."""
    order = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    k = table("conversations").withColumn("rn", F.row_number().over(order)).withColumn("used", F.sum(F.length("text")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return k.where("rn = 1 or used <= 1500").select("conv_id", "turn", F.length("text").alias("n"))


@query(r"""SELECT conv_id, turn, sha256(trim(regexp_replace(lower(text), '[ \t\n\v\f\r]+', ' ', 'g'))) AS cache_key FROM conversations WHERE role = 'user'""")
def cache_keys(table):
    return table("conversations").where("role = 'user'").select("conv_id", "turn", F.sha2(T.cache_question(F.col("text")), 256).alias("cache_key"))


@query("""SELECT role, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars, max(length(text)) AS longest FROM conversations GROUP BY 1""")
def messages_by_role(table):
    return table("conversations").groupBy("role").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"), F.max(F.length("text")).alias("longest"))


@query("""SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) FILTER (role = 'system') AS system_prompt, count(*) FILTER (role <> 'system') AS n_messages FROM conversations GROUP BY 1""")
def system_prompts(table):
    system = F.when(F.col("role") == "system", F.struct("turn", "text"))
    c = table("conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(system)).alias("s"), F.count(F.when(F.col("role") != "system", 1)).alias("n_messages"))
    return c.select("conv_id", F.when(F.size("s") > 0, F.array_join(F.transform("s", lambda x: x["text"]), "\n\n")).alias("system_prompt"), "n_messages")
