"""Sessions, funnels, retention and time windows over events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import events as ops
from ..streaming import windows as sw


def _events(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def session_number(spark, sf_dir):
    e = _events(spark, sf_dir).withColumn("sec", F.unix_seconds(F.col("ts").cast("timestamp")))
    return ops.with_session_number(e, "sec", 1800, ["user_id"], ["sec", "event_id"]).select("event_id", "user_id", F.col("session").cast("long").alias("session"))


def retention(spark, sf_dir):
    t = F.col("event_type")
    out = ops.retention(_events(spark, sf_dir), ["user_id"], [(t == "signup") & (F.col("value") > 20), t == "purchase", (t == "error") & (F.col("value") > 60)])
    return out.select("user_id", *[F.get("retention", F.lit(i)).alias(f"r{i}") for i in range(3)])


def funnel(spark, sf_dir):
    t = F.col("event_type")
    return ops.window_funnel(_events(spark, sf_dir), ["user_id"], "ts", 86400, [t == "view", t == "click"])


def funnel_modes(spark, sf_dir):
    t = F.col("event_type")
    return ops.window_funnel(_events(spark, sf_dir), ["user_id"], "ts", 86400, [t == "view", t == "click", t == "purchase"], deduplicate=True, increase=True)


def tumbling(spark, sf_dir):
    out = sw.tumbling(_events(spark, sf_dir), "ts", "1 hour", ["event_type"], [F.count("*").alias("n"), F.max("value").alias("hi")])
    return out.withColumn("start", F.unix_seconds("start"))


def sliding(spark, sf_dir):
    out = sw.sliding(_events(spark, sf_dir), "ts", "2 hours", "1 hour", ["event_type"], [F.count("*").alias("n")])
    return out.withColumn("start", F.unix_seconds("start"))


def sessions(spark, sf_dir):
    out = sw.sessions(_events(spark, sf_dir), "ts", "30 minutes", ["user_id"], [F.count("*").alias("n")])
    return out.select("user_id", F.unix_micros("start").alias("start"), "n")


def histogram(spark, sf_dir):
    return ops.equi_height_histogram(_events(spark, sf_dir), "user_id", 10).select("low", "high", "rows", "repeats")


SESSIONS = "SELECT *, sum(o) OVER (PARTITION BY user_id ORDER BY {by} ROWS UNBOUNDED PRECEDING) + 1 AS s FROM (SELECT *, CASE WHEN {x} - lag({x}) OVER (PARTITION BY user_id ORDER BY {by}) {gap} THEN 1 ELSE 0 END AS o FROM events) t"

def mann_whitney(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr("o_orderstatus", "o_totalprice", "o_orderpriority < '3' AS urgent")
    return ops.mann_whitney_u(o, ["o_orderstatus"], "o_totalprice", "urgent").withColumn("z", F.round("z", 6))


MANN_WHITNEY = """WITH r AS (SELECT o_orderstatus, o_orderpriority < '3' AS g, rank() OVER w + (count(*) OVER (PARTITION BY o_orderstatus, o_totalprice) - 1) / 2.0 AS rank, count(*) OVER (PARTITION BY o_orderstatus, o_totalprice) AS t
  FROM orders WINDOW w AS (PARTITION BY o_orderstatus ORDER BY o_totalprice)),
s AS (SELECT o_orderstatus, count(*) FILTER (WHERE NOT g) AS n1, count(*) FILTER (WHERE g) AS n2, (sum(rank) FILTER (WHERE NOT g))::double AS ranks, sum(t * t - 1)::double AS ties FROM r GROUP BY 1),
u AS (SELECT *, ranks - n1 * (n1 + 1) / 2 AS u1, sqrt(n1 * n2 / 12.0::double * (n1 + n2 + 1 - ties / ((n1 + n2) * (n1 + n2 - 1)))) AS sd FROM s)
SELECT o_orderstatus, n1, n2, least(u1, n1 * n2 - u1) AS u, round((greatest(u1, n1 * n2 - u1) - n1 * n2 / 2.0::double - 0.5::double) / sd, 6) AS z FROM u"""

QUERIES = {
    "session_number": (session_number, f"SELECT event_id, user_id, s::bigint AS session FROM ({SESSIONS.format(x='floor(epoch(ts))', by='floor(epoch(ts)), event_id', gap='> 1800')}) u"),
    "retention": (retention, "SELECT user_id, r0, r0 AND coalesce(r1, false) AS r1, r0 AND coalesce(r2, false) AS r2 FROM (SELECT user_id, bool_or(event_type = 'signup' AND value > 20) AS r0, bool_or(event_type = 'purchase') AS r1, bool_or(event_type = 'error' AND value > 60) AS r2 FROM events GROUP BY user_id) t"),
    "window_funnel": (
        funnel,
        """SELECT u.user_id, CASE WHEN EXISTS (SELECT 1 FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'view' AND b.event_type = 'click' AND b.ts > a.ts AND b.ts - a.ts <= interval 1 day WHERE a.user_id = u.user_id) THEN 2
WHEN EXISTS (SELECT 1 FROM events a WHERE a.user_id = u.user_id AND a.event_type = 'view') THEN 1 ELSE 0 END AS level FROM (SELECT DISTINCT user_id FROM events) u""",
    ),
    "window_funnel_sql": (
        "SELECT user_id, window_funnel(86400, ts, 4, array(event_type = 'view', event_type = 'click')) AS level FROM events GROUP BY user_id",
        """SELECT u.user_id, CASE WHEN EXISTS (SELECT 1 FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'view' AND b.event_type = 'click' AND b.ts > a.ts AND b.ts - a.ts <= interval 1 day WHERE a.user_id = u.user_id) THEN 2
WHEN EXISTS (SELECT 1 FROM events a WHERE a.user_id = u.user_id AND a.event_type = 'view') THEN 1 ELSE 0 END AS level FROM (SELECT DISTINCT user_id FROM events) u""",
    ),
    "retention_sql": (
        "SELECT user_id, retention(array(event_type = 'signup', event_type = 'purchase')) AS r FROM events GROUP BY user_id",
        "SELECT user_id, [bool_or(event_type = 'signup'), bool_or(event_type = 'signup') AND bool_or(event_type = 'purchase')] AS r FROM events GROUP BY user_id",
    ),
    "mann_whitney_by_counts": (mann_whitney, MANN_WHITNEY),
    "window_funnel_modes": (funnel_modes, None),
    "window_tumbling": (tumbling, "SELECT epoch(date_trunc('hour', ts))::bigint AS start, event_type, count(*) AS n, max(value) AS hi FROM events GROUP BY 1, 2"),
    "window_sliding": (sliding, "SELECT start, event_type, count(*) AS n FROM (SELECT event_type, unnest([epoch(date_trunc('hour', ts))::bigint, epoch(date_trunc('hour', ts))::bigint - 3600]) AS start FROM events) t GROUP BY 1, 2"),
    "window_session": (sessions, f"SELECT user_id, epoch_us(min(ts)) AS start, count(*) AS n FROM ({SESSIONS.format(x='ts', by='ts, event_id', gap='>= interval 30 minute')}) u GROUP BY user_id, s"),
    "histogram_equi_height": (
        histogram,
        """SELECT min(v) AS low, max(v) AS high, max(upto)::bigint AS rows, arg_max(c, v) AS repeats FROM (
SELECT v, c, upto, ceil(upto * 10 / n)::int AS b FROM (SELECT v, c, sum(c) OVER (ORDER BY v) AS upto, (SELECT count(user_id) FROM events) AS n FROM (SELECT user_id AS v, count(*) AS c FROM events GROUP BY user_id) t) u) w GROUP BY b""",
    ),
}
