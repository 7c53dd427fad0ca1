"""Questions to run logs: status events, sessions, runs and manifests."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import col, require, spread
from ..operators.windows import last_state

# How a session's status reads as the status of its last run.
RUN_STATUS = {"finalized": "completed", "active": "completed", "running": "running", "abandoned": "never"}
OPEN_STATUSES = ("active", "running")

# Folders a manifest leaves out.
SKIPPED_FOLDERS = (
    "runs", ".git", "__pycache__", ".venv", "venv", "node_modules",
    ".mypy_cache", ".ruff_cache", ".pytest_cache", "dist", "build",
)


def _order(order_by: Sequence[str]) -> Column:
    return F.struct(*[col(c) for c in order_by])


def fold_status(
    events: DataFrame,
    key: str,
    order_by: Sequence[str],
    status: str = "status",
    fields: Sequence[str] = (),
    clear_on_success: str | None = None,
) -> DataFrame:
    """The state after all events of a key: the last status, and of each other
    field the last value that is not NULL.

    One aggregate, combined before the shuffle. ``clear_on_success`` names an
    error field that is emptied where the last status is ``completed``.
    """
    require(events, [key, status, *order_by, *fields], "fold_status")
    when = _order(order_by)
    folded = events.groupBy(col(key)).agg(
        F.max_by(col(status), when).alias(status),
        *[F.max_by(col(f), F.when(col(f).isNotNull(), when)).alias(f) for f in fields],
    )
    if clear_on_success:
        folded = folded.withColumn(clear_on_success, F.when(col(status) != "completed", col(clear_on_success)))
    return folded


def meta_upsert(events: DataFrame, key: str, value: str, order_by: Sequence[str]) -> DataFrame:
    """The last value written for each key."""
    return events.groupBy(col(key)).agg(F.max_by(col(value), _order(order_by)).alias(value))


def completed_nodes(states: DataFrame, key: str, status: str = "status", completed: str = "completed") -> DataFrame:
    """Keys whose status is completed."""
    return states.filter(col(status) == completed).select(col(key))


def latest_per_key(
    keys: DataFrame,
    sessions: DataFrame,
    key: str,
    order_by: Sequence[str],
    status: str = "status",
    created_at: str = "created_at",
    mapping: Mapping[str, str] = RUN_STATUS,
) -> DataFrame:
    """The status and time of each key's newest session; ``never`` without one."""
    newest = sessions.groupBy(col(key)).agg(
        F.max_by(F.struct(col(status).alias("status"), col(created_at).alias("at")), _order(order_by)).alias("_s")
    )
    names = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    joined = keys.join(newest, on=[key], how="left")
    run_status = F.coalesce(F.try_element_at(names, F.col("_s.status")), F.lit("never"))
    return joined.select(
        *[col(c) for c in keys.columns],
        run_status.alias("last_run_status"),
        F.col("_s.at").alias("last_run_at"),
    )


def active_conflicts(
    sessions: DataFrame, key: str, status: str = "status", open_statuses: Sequence[str] = OPEN_STATUSES
) -> DataFrame:
    """Keys with more than one open session, and how many."""
    counted = sessions.filter(col(status).isin(*open_statuses)).groupBy(col(key)).agg(F.count(F.lit(1)).alias("n_open"))
    return counted.filter(F.col("n_open") > 1)


def list_runs(
    runs: DataFrame,
    workspace: str | None = None,
    pipeline: str | None = None,
    status: str | None = None,
    limit: int | None = None,
    workspace_col: str = "workspace",
    pipeline_col: str = "pipeline_file",
    status_col: str = "status",
    created_at: str = "created_at",
    tie_breakers: Sequence[str] = (),
) -> DataFrame:
    """Runs, newest first, of one workspace, with a text in the pipeline's name, in one status.

    All of them, or the newest ``limit``.
    """
    if workspace:
        runs = runs.filter(col(workspace_col) == workspace)
    if pipeline:
        runs = runs.filter(F.contains(F.lower(F.coalesce(col(pipeline_col), F.lit(""))), F.lit(pipeline.lower())))
    if status:
        runs = runs.filter(col(status_col) == status)
    ordered = runs.orderBy(col(created_at).desc_nulls_last(), *[col(c).asc_nulls_last() for c in tie_breakers])
    return ordered if limit is None else ordered.limit(limit)


def run_history(
    runs: DataFrame,
    sessions: DataFrame,
    run_id: str = "run_id",
    session_id: str = "session_id",
    status: str = "status",
    created_at: str = "created_at",
) -> DataFrame:
    """Runs and sessions as one list, newest first."""

    def entry(df: DataFrame, kind: str, key: str) -> DataFrame:
        return df.select(
            F.lit(kind).alias("kind"),
            col(key).cast("string").alias("id"),
            col(status).alias("status"),
            col(created_at).alias("created_at"),
        )

    both = entry(runs, "run", run_id).unionByName(entry(sessions, "session", session_id))
    return both.orderBy(F.col("created_at").desc_nulls_last(), "kind", "id")


def run_durations(
    nodes: DataFrame, started: str = "started_at", finished: str = "finished_at", out: str = "duration_s"
) -> DataFrame:
    """Seconds from start to finish, NULL while either is unknown; oldest start first."""
    unit = F.expr(f"timestampdiff(MICROSECOND, `{started}`, `{finished}`)")
    return nodes.withColumn(out, unit / 1_000_000).orderBy(col(started).asc_nulls_last(), spread(nodes))


def register_run(runs: DataFrame, key: str, order_by: Sequence[str]) -> DataFrame:
    """The last record written for each run id, replacing earlier ones as a whole."""
    rest = [c for c in runs.columns if c != key]
    newest = runs.groupBy(col(key)).agg(F.max_by(F.struct(*[col(c) for c in rest]), _order(order_by)).alias("_r"))
    return newest.select(col(key), *[F.col("_r").getField(c).alias(c) for c in rest]).select(
        *[col(c) for c in runs.columns]
    )


def status_changes(events: DataFrame, key: str, order_by: Sequence[str], state: Sequence[str]) -> DataFrame:
    """Events that changed the state of their key."""
    return last_state(events, key, order_by, state)


def manifest(files: DataFrame, path: str, content: str, skip: Sequence[str] = SKIPPED_FOLDERS) -> DataFrame:
    """Path, size and SHA-256 of each row's content, leaving out rows in skipped folders."""
    folders = F.slice(F.split(col(path), "/"), 1, F.size(F.split(col(path), "/")) - 1)
    kept = files.filter(~F.arrays_overlap(folders, F.array(*[F.lit(s) for s in skip]))) if skip else files
    return kept.select(
        col(path).alias("file"), F.octet_length(col(content)).cast("bigint").alias("n_bytes"), F.sha2(col(content).cast("binary"), 256).alias("sha256")
    )


def file_manifest(spark, root: str, pattern: str = "*", skip: Sequence[str] = SKIPPED_FOLDERS) -> DataFrame:
    """Path and SHA-256 of each file under a folder, leaving out skipped folders."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    )
    base = root.rstrip("/").split(":", 1)[-1].lstrip("/")
    relative = F.regexp_replace("path", "^[a-z0-9]*:?/*" + _escaped(base) + "/", "")
    return manifest(files.withColumn("file", relative), "file", "content", skip)


def _escaped(text: str) -> str:
    return "\\Q" + text + "\\E"


def manifest_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Files added, removed or changed between two manifests."""
    a = old.select("file", F.col("sha256").alias("_old"))
    b = new.select("file", F.col("sha256").alias("_new"))
    change = (
        F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").when(F.col("_old") != F.col("_new"), "changed")
    )
    return a.join(b, on="file", how="full_outer").select("file", change.alias("change")).filter(F.col("change").isNotNull())
