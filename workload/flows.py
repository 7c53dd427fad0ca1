"""Streaming forms, run over the events that are there and compared with batch SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablecraft.operators.filters import drop_nulls
from tablecraft.operators.projection import classify_change
from tablecraft.operators.quality import Check
from tablecraft.streaming import flows

from .base import query, table


def stream(spark, folder):
    schema = table(spark, folder, "events").schema
    return flows.read_stream(spark, folder, schema, "events.parquet")


@query(
    "stream_row_transforms",
    """SELECT event_id, value - 50 AS change, CASE WHEN value - 50 > 0.1 THEN 'gain' WHEN value - 50 < -0.1 THEN 'loss' ELSE 'flat' END AS direction
       FROM events WHERE event_type <> 'error'""",
)
def _(spark, folder):
    events = stream(spark, folder).select(
        "event_id", (F.col("value") - 50).alias("change"), F.nullif("event_type", F.lit("error")).alias("kind")
    )
    out = flows.stream_row_transforms(events, lambda df: drop_nulls(df, ["kind"]), lambda df: classify_change(df, "change"))
    return flows.run_available(out.select("event_id", "change", "direction"))


@query(
    "stream_dq",
    """SELECT date_trunc('day', ts) AS window_start, COUNT(*) AS rows, CAST(SUM(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS DOUBLE) / COUNT(*) AS null_rate_kind,
              MIN(value) AS min_value, MAX(value) AS max_value, CAST(SUM(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS DOUBLE) / COUNT(*) <= 0.2 AS passed
       FROM events GROUP BY 1""",
)
def _(spark, folder):
    events = stream(spark, folder).select("ts", "value", F.nullif("event_type", F.lit("error")).alias("kind"))
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    checks = [Check("null_rate", "kind", max_null_rate=0.2), Check("value_range", "value", min_value=0)]
    changes = flows.run_available(flows.stream_dq(timed, checks, "ts", "1 day"), "update")
    out = flows.latest_rows(changes, "window_start")
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "rows", "null_rate_kind", "min_value", "max_value", "passed")


@query(
    "stream_dq_unique",
    """SELECT date_trunc('day', ts) AS window_start, COUNT(*) AS rows, MAX(value) AS max_value,
              COUNT(*) - COUNT(DISTINCT user_id) AS duplicates_user_id,
              COUNT(*) - COUNT(DISTINCT NULLIF(event_type, 'error')) - MAX(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS duplicates_kind,
              COUNT(*) - COUNT(DISTINCT event_id) AS duplicates_event_id, COUNT(*) = COUNT(DISTINCT user_id) AND COUNT(*) <= 3 AS passed
       FROM events GROUP BY 1 HAVING date_trunc('day', MAX(ts)) + INTERVAL 1 DAY <= (SELECT MAX(ts) FROM events) - INTERVAL 1 HOUR""",
)
def _(spark, folder):
    """Of each window that the watermark has closed."""
    events = stream(spark, folder).select("ts", "event_id", "user_id", "value", F.nullif("event_type", F.lit("error")).alias("kind"))
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    checks = [Check("unique", "user_id"), Check("unique", "kind"), Check("unique", "event_id"), Check("value_range", "value"), Check("row_count", max_rows=3)]
    out = flows.run_available(flows.stream_dq(timed, checks, "ts", "1 day", "1 hour"))
    kept = ["rows", "max_value", "duplicates_user_id", "duplicates_kind", "duplicates_event_id", "passed"]
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), *kept)


@query(
    "stream_latest_state",
    """SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, arg_max(value, (ts, event_id)) FILTER (WHERE value > 100) AS high FROM events GROUP BY 1""",
)
def _(spark, folder):
    events = stream(spark, folder).withColumn("high", F.when(F.col("value") > 100, F.col("value")))
    changes = flows.run_available(flows.stream_latest_state(events, "user_id", ["ts", "event_id"], ["event_type", "high"]), "update")
    return flows.latest_rows(changes, "user_id").drop("_at")


SESSIONS = """marked AS (SELECT *, CASE WHEN ts - LAG(ts) OVER w < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS anew FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
sessions AS (SELECT *, SUM(anew) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM marked),
closed AS (
  SELECT user_id, MIN(ts) AS first, MAX(ts) AS last, arg_max(event_type, (ts, event_id)) AS event_type,
         arg_max(value, (ts, event_id)) FILTER (WHERE value > 100) AS high, MAX(struct_pack(ts := ts, event_id := event_id)) AS placed
  FROM sessions GROUP BY user_id, session HAVING MAX(ts) + INTERVAL 12 HOUR <= (SELECT MAX(ts) - INTERVAL 1 HOUR FROM events))"""


def closed_states(spark, folder):
    """Users fall silent after half a day."""
    events = stream(spark, folder).withColumn("high", F.when(F.col("value") > 100, F.col("value"))).withColumn("ts", F.col("ts").cast("timestamp"))
    return flows.run_available(flows.stream_closed_states(events, "user_id", ["ts", "event_id"], ["event_type", "high"], "ts", "12 hours", "1 hour"))


def without_zone(df):
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("first", "last")})


@query("stream_closed_states", f"WITH {SESSIONS} SELECT user_id, first, last, event_type, high FROM closed")
def _(spark, folder):
    return without_zone(closed_states(spark, folder).drop("_at"))


@query(
    "stream_latest_of_closed",
    f"""WITH {SESSIONS} SELECT user_id, MIN(first) AS first, MAX(last) AS last, arg_max(event_type, placed) AS event_type,
        arg_max(high, placed) FILTER (WHERE high IS NOT NULL) AS high FROM closed GROUP BY 1""",
)
def _(spark, folder):
    return without_zone(flows.latest_states(closed_states(spark, folder), "user_id", ["event_type", "high"]))
