"""Run logs: events as status events, conversations as sessions, orders as runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablecraft.plans import runlog

from .base import query, table


def status_events(spark, folder):
    return table(spark, folder, "events").select(
        "event_id", "ts", "user_id", F.col("event_type").alias("status"),
        F.when(F.col("event_type") == "error", F.col("props")).alias("error"),
        F.when(F.col("value") > 100, F.col("value")).alias("hash"),
    )


@query(
    "fold_status",
    """SELECT user_id, arg_max(event_type, (ts, event_id)) AS status, arg_max(props, (ts, event_id)) FILTER (WHERE event_type = 'error') AS error,
              arg_max(value, (ts, event_id)) FILTER (WHERE value > 100) AS hash FROM events GROUP BY 1""",
)
def _(spark, folder):
    return runlog.fold_status(status_events(spark, folder), "user_id", ["ts", "event_id"], "status", ["error", "hash"])


@query("meta_upsert", "SELECT event_type AS key, arg_max(props, (ts, event_id)) AS value FROM events GROUP BY 1")
def _(spark, folder):
    pairs = table(spark, folder, "events").select(F.col("event_type").alias("key"), F.col("props").alias("value"), "ts", "event_id")
    return runlog.meta_upsert(pairs, "key", "value", ["ts", "event_id"])


@query(
    "completed_nodes",
    "SELECT user_id FROM (SELECT user_id, arg_max(event_type, (ts, event_id)) AS s FROM events GROUP BY 1) WHERE s = 'purchase'",
)
def _(spark, folder):
    states = runlog.fold_status(status_events(spark, folder), "user_id", ["ts", "event_id"])
    return runlog.completed_nodes(states, "user_id", completed="purchase")


SESSIONS = """sessions AS (
  SELECT o_orderkey AS session_id, 'c' || o_custkey AS pipeline_path, o_orderdate AS created_at,
         CASE o_orderstatus WHEN 'F' THEN 'finalized' WHEN 'O' THEN 'running' ELSE 'abandoned' END AS status FROM orders)"""


def sessions(spark, folder):
    status = F.when(F.col("o_orderstatus") == "F", "finalized").when(F.col("o_orderstatus") == "O", "running").otherwise("abandoned")
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("session_id"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("pipeline_path"),
        F.col("o_orderdate").alias("created_at"), status.alias("status"),
    )


@query(
    "latest_per_key",
    f"""WITH {SESSIONS}, newest AS (SELECT pipeline_path, arg_max(status, (created_at, session_id)) AS status, MAX(created_at) AS at FROM sessions GROUP BY 1)
        SELECT 'c' || c_custkey AS pipeline_path, c_name,
               CASE n.status WHEN 'finalized' THEN 'completed' WHEN 'running' THEN 'running' ELSE 'never' END AS last_run_status, n.at AS last_run_at
        FROM customer LEFT JOIN newest n ON n.pipeline_path = 'c' || c_custkey""",
)
def _(spark, folder):
    keys = table(spark, folder, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("pipeline_path"), "c_name")
    return runlog.latest_per_key(keys, sessions(spark, folder), "pipeline_path", ["created_at", "session_id"])


@query(
    "active_conflicts",
    f"WITH {SESSIONS} SELECT pipeline_path, COUNT(*) AS n_open FROM sessions WHERE status IN ('active', 'running') GROUP BY 1 HAVING COUNT(*) > 1",
)
def _(spark, folder):
    return runlog.active_conflicts(sessions(spark, folder), "pipeline_path")


@query(
    "list_runs",
    f"""WITH {SESSIONS} SELECT * FROM sessions WHERE contains(lower(pipeline_path), 'c1') AND status = 'running'
        ORDER BY created_at DESC, session_id""",
)
def _(spark, folder):
    return runlog.list_runs(
        sessions(spark, folder), pipeline="C1", status="running", pipeline_col="pipeline_path", tie_breakers=["session_id"]
    )


@query(
    "run_history",
    f"""WITH {SESSIONS} SELECT 'session' AS kind, CAST(session_id AS VARCHAR) AS id, status, created_at FROM sessions
        UNION ALL SELECT 'run', CAST(event_id AS VARCHAR), event_type, ts FROM events ORDER BY created_at DESC""",
)
def _(spark, folder):
    runs = table(spark, folder, "events").select(
        F.col("event_id").alias("run_id"), F.col("event_type").alias("status"), F.col("ts").alias("created_at")
    )
    return runlog.run_history(runs, sessions(spark, folder))


@query(
    "run_durations",
    """SELECT user_id, MIN(ts) AS started_at, CASE WHEN arg_max(event_type, (ts, event_id)) <> 'error' THEN MAX(ts) END AS finished_at,
              CASE WHEN arg_max(event_type, (ts, event_id)) <> 'error' THEN (epoch_us(MAX(ts)) - epoch_us(MIN(ts))) / 1000000 END AS duration_s
       FROM events GROUP BY 1 ORDER BY started_at""",
)
def _(spark, folder):
    last = F.max_by("event_type", F.struct("ts", "event_id"))
    nodes = table(spark, folder, "events").groupBy("user_id").agg(
        F.min("ts").alias("started_at"), F.when(last != "error", F.max("ts")).alias("finished_at")
    )
    return runlog.run_durations(nodes)


@query(
    "register_run",
    """SELECT user_id, event_type, value, event_id FROM (
         SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1""",
)
def _(spark, folder):
    runs = table(spark, folder, "events").select("user_id", "event_type", "value", "event_id", "ts")
    return runlog.register_run(runs, "user_id", ["ts", "event_id"]).drop("ts")


@query(
    "status_changes",
    """SELECT conv_id, turn, role FROM (
         SELECT conv_id, turn, role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations)
       WHERE before IS DISTINCT FROM role""",
)
def _(spark, folder):
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role")
    return runlog.status_changes(turns, "conv_id", ["turn"], ["role"])
