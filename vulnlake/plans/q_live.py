"""Streaming queries over the event table, run to completion on what is available (G*)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from vulnlake.plans.registry import query
from vulnlake.session import ensure_checkpoint_dir
from vulnlake.streaming import live


def _stream(t, table="events"):
    # a glob, because a stream source takes a plain path only for a folder and a table may be one file
    return live.read_stream(t.spark, f"{t.sf_dir}/{table}.parque[t]", getattr(t, table).schema)


def _work(t) -> str:
    return f"{ensure_checkpoint_dir(t.spark)}/live-{uuid.uuid4().hex}"


def _finish(t, stream, schema=None):
    root = _work(t)
    live.run_once(stream, f"{root}/out", f"{root}/ckpt")
    return t.spark.read.schema(stream.schema).parquet(f"{root}/out")


WM = "(SELECT max(ts) - INTERVAL 1 HOUR FROM events)"


@query("G01_live_board", """SELECT DISTINCT concat('agent', CAST(user_id AS VARCHAR)) AS source_agent, event_type AS finding_type, json_extract_string(props, '$.k') AS data_key FROM events""")
def board(t):
    s = _stream(t).select("ts", F.concat(F.lit("agent"), F.col("user_id").cast("string")).alias("source_agent"), F.col("event_type").alias("finding_type"),
                          F.get_json_object("props", "$.k").alias("data_key"))
    key = ["source_agent", "finding_type", "data_key"]
    return _finish(t, live.live_board(s, key)).select(*key)


@query("G02_progress_panel", f"""SELECT time_bucket(INTERVAL 5 SECOND, ts) AS start, event_type, COUNT(*) AS n FROM events GROUP BY 1, 2 HAVING start + INTERVAL 5 SECOND <= {WM}""")
def panel(t):
    return _finish(t, live.progress_panel(_stream(t)))


@query("G03_failure_bursts", f"""WITH w AS (SELECT user_id, time_bucket(INTERVAL 6 HOUR, ts) - i * INTERVAL 6 HOUR AS start FROM events, range(0, 8) r(i) WHERE event_type = 'error')
SELECT user_id, start, COUNT(*) AS failures FROM w GROUP BY 1, 2 HAVING COUNT(*) >= 4 AND start + INTERVAL 48 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events WHERE event_type = 'error')""")
def bursts(t):
    return _finish(t, live.failure_bursts(_stream(t), "user_id", F.col("event_type") == "error", limit=4, width="48 hours", slide="6 hours"))


@query("G04_run_sessions", f"""WITH p AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 10 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS brk FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
g AS (SELECT user_id, ts, SUM(brk) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM p)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 10 HOUR AS "end", COUNT(*) AS records FROM g GROUP BY user_id, s HAVING max(ts) + INTERVAL 10 HOUR <= {WM}""")
def sessions(t):
    return _finish(t, live.run_sessions(_stream(t), "user_id", idle="10 hours"))


@query("G05_live_stuck_detector", """
WITH w AS (SELECT sink_no, event_id, row_number() OVER (PARTITION BY sink_no ORDER BY ts, event_id) AS round,
 SUM(CASE WHEN result = 'failed' THEN 1 ELSE 0 END) OVER (PARTITION BY sink_no ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS f3 FROM fx_rounds)
SELECT sink_no, event_id, round FROM w WHERE round >= 4 AND f3 = 3""")
def stuck(t):
    root = _work(t)
    s = _stream(t).select(F.col("user_id").alias("sink_no"), "event_id", "ts", (~F.col("event_type").isin("purchase", "signup")).alias("failed"))
    emit = lambda df, n: df.write.mode("overwrite").parquet(f"{root}/out/batch={n}")
    live.run_batches(s, live.stuck_detector(f"{root}/state", "sink_no", ["ts", "event_id"], F.col("failed"), emit), f"{root}/ckpt")
    return t.spark.read.parquet(f"{root}/out").select("sink_no", "event_id", "round")


def _unmatched_sql(first, then, hours):
    wm = f"(SELECT least(max(CASE WHEN event_type = '{first}' THEN ts END), max(CASE WHEN event_type = '{then}' THEN ts END)) - INTERVAL 1 HOUR FROM events)"
    return f"""SELECT event_id, user_id FROM events e WHERE event_type = '{first}' AND NOT EXISTS (SELECT 1 FROM events l WHERE l.event_type = '{then}' AND l.user_id = e.user_id
 AND l.ts BETWEEN e.ts AND e.ts + INTERVAL {hours} HOUR) AND ts + INTERVAL {hours} HOUR < {wm}"""


def _unmatched(t, first, then, hours):
    s = _stream(t).select("event_id", "user_id", "ts", "event_type")
    out = live.missing_followup(s.where(F.col("event_type") == first), s.where(F.col("event_type") == then), "user_id", f"{hours} HOURS")
    return _finish(t, out).select("event_id", "user_id")


@query("G06_producer_timeouts", _unmatched_sql("signup", "purchase", 20))
def timeouts(t):
    return _unmatched(t, "signup", "purchase", 20)


@query("G07_enriched_stream", """SELECT e.event_type, r.auth_level, COUNT(*) AS n FROM events e LEFT JOIN fx_routes r ON r.route_id = concat('route_', CAST(e.user_id AS VARCHAR)) GROUP BY 1, 2""")
def enriched(t):
    s = _stream(t).withColumn("route_id", F.concat(F.lit("route_"), F.col("user_id").cast("string")))
    e = live.enrich(s, t.fx_routes.select("route_id", "auth_level"), "route_id")
    return _finish(t, e.select("event_type", "auth_level")).groupBy("event_type", "auth_level").agg(F.count("*").alias("n"))


@query("G08_unlogged_events", _unmatched_sql("error", "view", 12))
def unlogged(t):
    return _unmatched(t, "error", "view", 12)


@query("G09_late_rows", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, COUNT(*)::BIGINT AS n FROM events GROUP BY 1, 2")
def late_rows(t):
    """All events by hour, though they arrive in six files that each span the whole time, so that most rows come late."""
    root = _work(t)
    events = t.events.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type")
    events.repartition(6, F.xxhash64("event_id")).write.parquet(f"{root}/in")
    sums = lambda df: df.groupBy(F.date_trunc("hour", "ts").alias("start"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    stream = live.read_stream(t.spark, f"{root}/in", events.schema, files_per_trigger=1)
    live.run_batches(live.observed(stream), live.split_late(root, sums), f"{root}/ckpt")
    return live.completed(t.spark, root, sums, ["start", "event_type"])
