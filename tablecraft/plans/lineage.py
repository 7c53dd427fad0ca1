"""Column lineage: which source columns an output column comes from.

A lineage table is ``(node_id, output_column, source_node_id, source_column,
confidence)``. Schema tables are ``(node_id, input_no, source_node_id, column)``
for inputs and ``(node_id, column)`` for outputs, so that rules for thousands
of nodes run as joins.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import col
from ..session import settle
from . import doubling

LINEAGE = ("node_id", "output_column", "source_node_id", "source_column", "confidence")

# Confidence levels, the surest first.
CONFIDENCE = ("sql_exact", "tracked", "schema_diff")


def _by_name(outputs: DataFrame, known: DataFrame, confidence: str, expand: bool = False) -> DataFrame:
    """Rules shared by both kinds of lineage.

    An output with the name of a known column comes from the first input that
    has it; a new name may come from every known column of its node. Each
    output is matched to its node's columns in one equality join on the node.
    Without ``expand`` a new name gets one line per input instead, with ``*``
    for its columns, so that wide nodes do not give a line per pair of columns.
    """
    first = known.groupBy("node_id", "column").agg(F.min_by("source_node_id", "input_no").alias("source_node_id"))
    placed = settle(outputs.join(first, on=["node_id", "column"], how="left"), "placed")
    same = placed.filter(F.col("source_node_id").isNotNull()).select(
        "node_id",
        F.col("column").alias("output_column"),
        "source_node_id",
        F.col("column").alias("source_column"),
    )
    new = placed.filter(F.col("source_node_id").isNull()).select("node_id", F.col("column").alias("output_column"))
    source_column = F.col("column") if expand else F.lit("*")
    every = known.select("node_id", "source_node_id", source_column.alias("source_column"))
    every = every if expand else every.distinct()
    novel = new.join(every, on="node_id").select("node_id", "output_column", "source_node_id", "source_column")
    return same.unionByName(novel).withColumn("confidence", F.lit(confidence))


def lineage_schema_diff(inputs: DataFrame, outputs: DataFrame, expand: bool = False) -> DataFrame:
    """Lineage from column names alone.

    With ``expand`` a new column gets a line per known column of its node, else one per input.
    """
    return _by_name(outputs, inputs, "schema_diff", expand)


def lineage_tracked(accessed: DataFrame, inputs: DataFrame, outputs: DataFrame, expand: bool = False) -> DataFrame:
    """Lineage from the columns a function was seen to read.

    ``accessed`` has the shape of ``inputs``; a NULL column stands for bulk
    access, which reads all columns of that input. A node that was not seen to
    read anything falls back to names alone.
    """
    bulk = accessed.filter(F.col("column").isNull()).select("node_id", "source_node_id").distinct()
    columns = ("node_id", "input_no", "source_node_id", "column")
    single = accessed.filter(F.col("column").isNotNull()).select(*columns)
    whole = inputs.join(bulk, on=["node_id", "source_node_id"], how="left_semi").select(*columns)
    read = settle(single.unionByName(whole).distinct(), "read")
    watched = read.select("node_id").distinct()
    tracked = _by_name(outputs.join(watched, on="node_id", how="left_semi"), read, "tracked", expand)
    unwatched = outputs.join(watched, on="node_id", how="left_anti")
    return tracked.unionByName(lineage_schema_diff(inputs, unwatched, expand))


def lineage_upsert(lineage: DataFrame, fresh: DataFrame) -> DataFrame:
    """The lineage with all rows of the nodes in ``fresh`` replaced."""
    replaced = fresh.select("node_id").distinct()
    kept = lineage.join(replaced, on="node_id", how="left_anti").select(*LINEAGE)
    return kept.unionByName(fresh.select(*LINEAGE))


@dataclass(frozen=True)
class LineageTable:
    """Lineage kept as Parquet files, in ``buckets`` partitions by a hash of the node.

    All uses of a ``path`` must name the same ``buckets``. Rows of one node lie in one partition: replacing
    them rewrites that partition and no other, and reading them leaves all others out. Rows without a node
    belong to no one and are not kept.
    """

    path: str
    buckets: int = 256

    def _bucket(self, node: Column) -> Column:
        return F.pmod(F.xxhash64(node), F.lit(self.buckets)).cast("int")

    def _stored(self, spark: SparkSession) -> DataFrame:
        schema = ", ".join(f"{c} string" for c in LINEAGE)
        # A partition holds a row without a node, see replace().
        return spark.read.schema(f"{schema}, bucket int").parquet(self.path).filter(F.col("node_id").isNotNull())

    def _write(self, rows: DataFrame, mode: str) -> None:
        writer = rows.repartition("bucket").write.partitionBy("bucket").mode(mode)
        writer.option("partitionOverwriteMode", "dynamic").parquet(self.path)

    def create(self, spark: SparkSession) -> LineageTable:
        """The table without rows, where there is none yet."""
        empty = spark.createDataFrame([], ", ".join(f"{c} string" for c in (*LINEAGE,)) + ", bucket int")
        self._write(empty, "ignore")
        return self

    def replace(self, fresh: DataFrame, nodes: DataFrame | None = None) -> list[int]:
        """Put the rows of ``fresh`` in the place of all rows of their nodes.

        ``nodes`` (one column) names further nodes whose rows go, such as nodes that have no columns any
        more. Returns the partitions that were rewritten. New contents are written down before the first
        file is replaced, so a run that fails can be run again.
        """
        spark = fresh.sparkSession
        rows = fresh.select(*LINEAGE).filter(F.col("node_id").isNotNull()).distinct()
        fresh = settle(rows.withColumn("bucket", self._bucket(F.col("node_id"))), "fresh")
        replaced = fresh.select("node_id", "bucket")
        if nodes is not None:
            named = nodes.select(col(nodes.columns[0]).cast("string").alias("node_id")).filter(F.col("node_id").isNotNull())
            replaced = replaced.union(named.withColumn("bucket", self._bucket(F.col("node_id"))))
        replaced = settle(replaced.distinct(), "replaced")
        # At most as many numbers as there are partitions.
        touched = sorted(r.bucket for r in replaced.select("bucket").distinct().collect())
        if not touched:
            return []
        kept = self._stored(spark).filter(F.col("bucket").isin(touched))
        kept = kept.join(replaced.select("node_id"), on="node_id", how="left_anti").select(*LINEAGE, "bucket")
        # A partition left without rows would keep its old files; a row without a node takes their place.
        marks = spark.createDataFrame([(b,) for b in touched], "bucket int").select(*[F.lit(None).cast("string").alias(c) for c in LINEAGE], "bucket")
        self._write(settle(kept.unionByName(fresh).unionByName(marks), "lineage"), "overwrite")
        return touched

    def read(self, spark: SparkSession, node_id: str | None = None) -> DataFrame:
        """All rows, or those of one node, for which one partition is read."""
        rows = self._stored(spark)
        if node_id is not None:
            rows = rows.filter((F.col("bucket") == self._bucket(F.lit(node_id))) & (F.col("node_id") == node_id))
        return rows.select(*LINEAGE)


def lineage_query(lineage: DataFrame, node_id: str | None = None) -> DataFrame:
    """The rows of one node, or of all nodes, in order."""
    if node_id is not None:
        rows = lineage.filter(F.col("node_id") == node_id)
        return rows.orderBy("output_column", "source_node_id", "source_column")
    return lineage.orderBy("node_id", "output_column", "source_node_id", "source_column")


def counted(df: DataFrame, keys: Sequence[str], out: str) -> DataFrame:
    """The distinct rows of ``df``, each with the number of them that share its keys.

    The numbers come from an aggregate that combines before the shuffle, and join
    back: a key of any size is spread over tasks.
    """
    rows = df.distinct()
    sizes = rows.groupBy(*[col(k) for k in keys]).agg(F.count(F.lit(1)).alias(out))
    return rows.join(sizes, on=list(keys))


def lineage_edges(lineage: DataFrame) -> DataFrame:
    """Edges between tables: one row per column mapping, with ``n_mappings`` of its edge."""
    mappings = lineage.select("source_node_id", "node_id", "output_column", "source_column", "confidence")
    return counted(mappings, ["source_node_id", "node_id"], "n_mappings")


def _rank(confidence: Column) -> Column:
    return F.array_position(F.array(*[F.lit(c) for c in CONFIDENCE]), confidence)


def _far(steps: DataFrame, frontier: DataFrame) -> DataFrame | None:
    """What lies behind the columns of the frontier, however far, by path doubling."""
    here, there = F.struct("node_id", "column"), F.struct(F.col("_node").alias("node_id"), F.col("_column").alias("column"))
    links = steps.groupBy(here.alias("src"), there.alias("dst")).agg(F.min("_step").cast("long").alias("value"))
    starts = frontier.select(here.alias("node"), F.col("_sure").cast("long").alias("value"))
    further = doubling.far(starts, links, doubling.SUREST)
    return None if further is None else further.select("node.node_id", "node.column", F.col("value").alias("_sure"))


def lineage_closure(
    lineage: DataFrame, starts: DataFrame, direction: str = "upstream"
) -> DataFrame:
    """All columns that lie behind the start columns, or with ``downstream`` before them.

    ``starts`` is ``(node_id, column)``. A path is as sure as its least sure
    step, and a column as sure as the surest path to it. Every round keeps only
    columns that are new or were reached more surely than before. As a column can
    become surer twice at most, the rounds end, whatever cycles there are.
    """
    if direction not in ("upstream", "downstream"):
        raise ValueError("lineage_closure: direction must be 'upstream' or 'downstream'")
    here, there = ("node_id", "output_column"), ("source_node_id", "source_column")
    if direction == "downstream":
        here, there = there, here
    steps = settle(
        lineage.filter(F.col("source_column").isNotNull()).select(
            F.col(here[0]).alias("node_id"),
            F.col(here[1]).alias("column"),
            F.col(there[0]).alias("_node"),
            F.col(there[1]).alias("_column"),
            _rank(F.col("confidence")).alias("_step"),
        ),
        "steps",
    )
    frontier = settle(
        starts.select("node_id", "column").distinct().withColumn("_sure", F.lit(1).cast("long")), "closure"
    )
    best = frontier
    rounds = 0
    while True:
        rounds += 1
        reached = (
            steps.join(frontier, on=["node_id", "column"])
            .groupBy(F.col("_node").alias("node_id"), F.col("_column").alias("column"))
            .agg(F.min(F.greatest("_step", "_sure")).alias("_sure"))
        )
        known = best.groupBy("node_id", "column").agg(F.min("_sure").alias("_known"))
        better = (
            reached.join(known, on=["node_id", "column"], how="left")
            .filter(F.col("_known").isNull() | (F.col("_sure") < F.col("_known")))
            .drop("_known")
        )
        frontier = settle(better, "closure")
        if frontier.isEmpty():
            break
        best = best.unionByName(frontier)
        if rounds % doubling.ROUNDS == 0:
            best = settle(best.groupBy("node_id", "column").agg(F.min("_sure").alias("_sure")), "closure")
        if rounds == doubling.ROUNDS and (further := _far(steps, frontier)) is not None:
            best = best.unionByName(further)
            break
    surest = best.groupBy("node_id", "column").agg(F.min("_sure").alias("_sure"))
    names = F.array(*[F.lit(c) for c in CONFIDENCE])
    return surest.join(starts.select("node_id", "column"), on=["node_id", "column"], how="left_anti").select(
        "node_id", "column", F.element_at(names, F.col("_sure").cast("int")).alias("confidence")
    )
