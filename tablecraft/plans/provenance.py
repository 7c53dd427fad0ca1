"""Row provenance: which source rows an output row comes from.

Frames carry a ``_row_id``. Edges are ``(node_id, output_row_id,
source_node_id, source_row_id)``; where the way back is lost the source is
``__opaque__`` with id -1.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import all_of, col
from ..operators.filters import union_all
from ..operators.windows import ROW_ID, probe_row_id
from ..session import settle
from . import doubling
from .lineage import counted

OPAQUE = "__opaque__"
#: Names of nodes that a filter lists at most.
FEW = 100


def stamp_row_id(df: DataFrame, order_by: Sequence[str], sample: int | None = None) -> DataFrame:
    """All rows of a source, or only its first ``sample``, numbered from 0."""
    return probe_row_id(df, order_by, sample)


def _edges(output: DataFrame, node_id: str, source_node_id: str, source_id: str) -> DataFrame:
    return output.select(
        F.lit(node_id).alias("node_id"),
        F.col(ROW_ID).cast("bigint").alias("output_row_id"),
        F.lit(source_node_id).alias("source_node_id"),
        col(source_id).cast("bigint").alias("source_row_id"),
    )


def trace_rowwise(output: DataFrame, node_id: str, source_node_id: str) -> DataFrame:
    """Edges of a step that kept ``_row_id``: each row comes from the row of its id."""
    return _edges(output, node_id, source_node_id, ROW_ID)


def trace_join(
    output: DataFrame, node_id: str, sources: Mapping[str, str]
) -> DataFrame:
    """Edges of a join: ``sources`` maps a source node to the column with its row id.

    A side that did not match has no id and gets no edge.
    """
    return union_all(
        *[_edges(output.filter(col(c).isNotNull()), node_id, source, c) for source, c in sources.items()]
    )


def trace_group(
    inputs: DataFrame, output: DataFrame, keys: Sequence[str], node_id: str, source_node_id: str
) -> DataFrame:
    """Edges of a grouping: each output row comes from all input rows of its keys."""
    ids = output.select(
        *[col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(ROW_ID).alias("_out")
    )
    members = inputs.select(*[col(k).alias(f"_m{i}") for i, k in enumerate(keys)], F.col(ROW_ID).alias("_in"))
    on = all_of(F.col(f"_m{i}").eqNullSafe(F.col(f"_k{i}")) for i in range(len(keys)))
    return members.join(ids, on).select(
        F.lit(node_id).alias("node_id"),
        F.col("_out").cast("bigint").alias("output_row_id"),
        F.lit(source_node_id).alias("source_node_id"),
        F.col("_in").cast("bigint").alias("source_row_id"),
    )


def trace_opaque(output: DataFrame, node_id: str) -> DataFrame:
    """Edges of a step that lost the row ids."""
    return output.select(
        F.lit(node_id).alias("node_id"),
        F.col(ROW_ID).cast("bigint").alias("output_row_id"),
        F.lit(OPAQUE).alias("source_node_id"),
        F.lit(-1).cast("bigint").alias("source_row_id"),
    )


def probe_status(
    outputs: Mapping[str, DataFrame], edges: DataFrame | None = None, skipped: Sequence[str] = (), failed: Sequence[str] = ()
) -> DataFrame:
    """Per node ``ok``, ``opaque``, ``skipped`` or ``failed``, and how many rows it has."""
    counted = union_all(
        *[
            df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(n).alias("node_id"), F.lit("ok").alias("status"), "row_count")
            for n, df in outputs.items()
        ]
    )
    if edges is not None:
        lost = edges.filter(F.col("source_node_id") == OPAQUE).select("node_id").distinct()
        flagged = counted.withColumn("_lost", F.lit(False)).unionByName(
            lost.select("node_id", F.lit(None).cast("string").alias("status"), F.lit(None).cast("bigint").alias("row_count"), F.lit(True).alias("_lost"))
        )
        counted = (
            flagged.groupBy("node_id")
            .agg(F.max("row_count").alias("row_count"), F.bool_or("_lost").alias("_lost"))
            .filter(F.col("row_count").isNotNull())
            .select("node_id", F.when(F.col("_lost"), "opaque").otherwise("ok").alias("status"), "row_count")
        )
    others = [(n, "skipped", 0) for n in skipped] + [(n, "failed", 0) for n in failed]
    if others:
        spark = counted.sparkSession
        counted = counted.unionByName(spark.createDataFrame(others, "node_id string, status string, row_count bigint"))
    return counted


def _edges_of(steps: DataFrame, walk: DataFrame) -> DataFrame:
    """The edges of the nodes that walks have reached, where these are few: others are not read."""
    names = [r.node_id for r in walk.select("node_id").distinct().limit(FEW + 1).collect()]
    return steps.filter(F.col("node_id").isin(names)) if len(names) <= FEW else steps


def _far(steps: DataFrame, walk: DataFrame, nodes: int) -> DataFrame | None:
    """Where walks end, however far off, by path doubling; each walk counts."""
    here = F.struct("node_id", F.col("row_id").cast("bigint").alias("row_id"), F.lit("on").alias("kind"))
    there = F.struct(F.col("_node").alias("node_id"), F.col("_row").alias("row_id"), "kind")
    links = steps.groupBy(here.alias("src"), there.alias("dst")).agg(F.count(F.lit(1)).alias("value"))
    begun = walk.select("start_node", "start_row", here.alias("node"), F.col("paths").alias("value"))
    try:
        further = doubling.far(begun, links, doubling.COUNTED, ["start_node", "start_row"], longest=nodes)
    except ValueError as error:
        raise ValueError("trace_rows: the nodes form a cycle") from error
    if further is None:
        return None
    return further.select("start_node", "start_row", "node.node_id", "node.row_id", F.col("value").alias("paths"), "node.kind").filter("kind != 'on'")


def trace_rows(
    edges: DataFrame, starts: DataFrame, sources: Mapping[str, DataFrame]
) -> DataFrame:
    """Walk from output rows back to their source rows, however far they lie.

    ``starts`` is ``(node_id, row_id)``, and all of them are walked at once.
    The result has one line per start and source row: the source's values as
    JSON, how many paths lead there, and ``opaque`` where the walk ended
    because the way back is lost. Nodes that nothing is known about give no line.
    A walk that takes more steps than there are nodes goes round in a circle,
    which is an error.
    """
    gone = F.col("source_node_id") == OPAQUE
    traced = edges.select("node_id").distinct()
    # Where the way back is lost, the walk ends at the row it has reached; else where nothing leads on.
    onward = traced.select(F.col("node_id").alias("source_node_id"), F.lit("on").alias("_on"))
    kind = F.when(gone, "lost").otherwise(F.coalesce("_on", F.lit("end")))
    steps = edges.join(onward, on="source_node_id", how="left").select(
        "node_id",
        F.col("output_row_id").alias("row_id"),
        F.when(gone, F.col("node_id")).otherwise(F.col("source_node_id")).alias("_node"),
        F.when(gone, F.col("output_row_id")).otherwise(F.col("source_row_id")).cast("bigint").alias("_row"),
        kind.alias("kind"),
    )
    steps = settle(steps, "edges")
    columns = ["start_node", "start_row", "node_id", "row_id"]
    first = starts.select(
        F.col("node_id").alias("start_node"), F.col("row_id").cast("bigint").alias("start_row"), "node_id", F.col("row_id").cast("bigint").alias("row_id")
    ).distinct()
    known = first.join(traced.withColumn("_on", F.lit("on")), on="node_id", how="left")
    walk = settle(known.select(*columns, F.lit(1).cast("bigint").alias("paths"), F.coalesce("_on", F.lit("end")).alias("kind")), "walk")
    ended = [walk.filter("kind != 'on'")]
    walk = walk.filter("kind = 'on'")
    nodes, rounds = traced.count(), 0
    while not walk.isEmpty():
        if rounds > nodes:
            raise ValueError("trace_rows: the nodes form a cycle")
        rounds += 1
        stepped = settle(
            _edges_of(steps, walk)
            .join(walk.drop("kind"), on=["node_id", "row_id"])
            .groupBy("start_node", "start_row", F.col("_node").alias("node_id"), F.col("_row").alias("row_id"), "kind")
            .agg(F.sum("paths").alias("paths")),
            "walk",
        )
        ended.append(stepped.filter("kind != 'on'").select(*walk.columns))
        walk = stepped.filter("kind = 'on'").select(*walk.columns)
        if rounds == doubling.ROUNDS and (further := _far(steps, walk, nodes)) is not None:
            ended.append(further.select(*walk.columns))
            break

    def valued_by(reached: DataFrame, name: str, df: DataFrame) -> DataFrame:
        """Rows of one source with their values; only rows that were reached become JSON."""
        ids = reached.filter(F.col("node_id") == name)
        values = F.struct(*[col(c) for c in df.columns if c != ROW_ID])
        rows = df.select(F.col(ROW_ID).cast("bigint").alias("row_id"), values.alias("_values"))
        as_json = F.to_json("_values", {"ignoreNullFields": "false"}).alias("row_values")
        return ids.join(rows, on="row_id").select(*reached.columns, as_json)

    done = settle(union_all(*ended).groupBy(*columns, "kind").agg(F.sum("paths").alias("paths")), "ended")
    reached = done.filter("kind = 'end'").drop("kind")
    lost = done.filter("kind = 'lost'").drop("kind").withColumn("row_values", F.lit("{}"))
    valued = [valued_by(reached, name, df).withColumn("opaque", F.lit(False)) for name, df in sources.items()]
    return union_all(*valued, lost.withColumn("opaque", F.lit(True))).select(*columns, "paths", "row_values", "opaque")


def trace_row(
    edges: DataFrame, node_id: str, row_id: int, sources: Mapping[str, DataFrame]
) -> DataFrame:
    """The source rows of one output row."""
    start = edges.sparkSession.createDataFrame([(node_id, row_id)], "node_id string, row_id bigint")
    return trace_rows(edges, start, sources)


def trace_by_source(traced: DataFrame) -> DataFrame:
    """The traced rows of each source table, each once, with ``n_rows`` of its table."""
    return counted(traced.select("node_id", "row_id", "row_values", "opaque"), ["node_id"], "n_rows")
