"""Dependency graphs as edge tables ``(src, dst)``.

Loops here run over the depth of the graph, never over its nodes: every round
is a Spark job over a whole level, and its result is written to the shared
folder, so plans stay short and a lost executor does not replay earlier rounds.
Where a graph is deeper than a few edges, shortcuts over more and more of them
make the rounds few, see :mod:`.doubling`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import col
from ..session import settle
from . import doubling


def node_edges(nodes: DataFrame, inputs: DataFrame) -> DataFrame:
    """Edges between nodes from what they read and write.

    ``nodes`` is ``(node, output)``, ``inputs`` is ``(node, input)``; a node
    depends on the node whose output it reads.
    """
    producer = nodes.select(F.col("node").alias("src"), F.coalesce("output", "node").alias("_name"))
    reader = inputs.select(F.col("node").alias("dst"), F.col("input").alias("_name"))
    return reader.join(producer, on="_name").select("src", "dst").distinct()


def reachable(
    edges: DataFrame, starts: DataFrame, inclusive: bool = True, max_depth: int | None = None
) -> DataFrame:
    """All nodes reachable from the start nodes, with the least number of steps.

    ``starts`` has one column. Each round follows the edges of the nodes found
    in the round before and keeps the new ones, so cycles end. Without
    ``inclusive`` a start node is left out unless an edge leads back to it.
    """
    links = settle(edges.select("src", "dst").filter(F.col("src").isNotNull() & F.col("dst").isNotNull()), "edges")
    first = starts.select(col(starts.columns[0]).alias("node")).distinct()
    frontier = settle(first, "frontier")
    found = [frontier.withColumn("depth", F.lit(0))] if inclusive else []
    seen = frontier if inclusive else frontier.limit(0)
    depth = 0
    while max_depth is None or depth < max_depth:
        depth += 1
        step = (
            links.join(frontier, links["src"] == frontier["node"], "left_semi")
            .select(F.col("dst").alias("node"))
            .distinct()
            .join(seen, on="node", how="left_anti")
        )
        frontier = settle(step, "frontier")
        if frontier.isEmpty():
            break
        found.append(frontier.withColumn("depth", F.lit(depth)))
        seen = seen.unionByName(frontier)
        if depth % doubling.ROUNDS == 0:
            seen = settle(seen, "seen")
        if depth == doubling.ROUNDS:
            # Nodes that are known have their least depth: only edges to others lead on.
            open_links = links.join(seen.select(F.col("node").alias("dst")), on="dst", how="left_anti")
            further = doubling.far(
                frontier.withColumn("value", F.lit(0)), open_links.select("src", "dst").distinct().withColumn("value", F.lit(1)), doubling.SHORTEST
            )
            if further is not None:
                rest = further.filter("value > 0").select("node", (F.col("value") + depth).cast("int").alias("depth"))
                found.append(rest if max_depth is None else rest.filter(F.col("depth") <= max_depth))
                break
    if not found:
        return frontier.withColumn("depth", F.lit(0)).limit(0)
    result = found[0]
    for part in found[1:]:
        result = result.unionByName(part)
    return result


def downstream(edges: DataFrame, starts: DataFrame, inclusive: bool = False, max_depth: int | None = None) -> DataFrame:
    """Everything that depends on the start nodes."""
    return reachable(edges, starts, inclusive, max_depth)


def upstream(edges: DataFrame, starts: DataFrame, inclusive: bool = True, max_depth: int | None = None) -> DataFrame:
    """Everything the start nodes depend on."""
    turned = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return reachable(turned, starts, inclusive, max_depth)


def _peel(edges: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Take away nodes without incoming edges, round by round.

    Returns ``(node, level)`` for the nodes taken away, the level being the
    longest path from a root, and the ``(node)`` that are left, which lie on a
    cycle or behind one. A round counts the edges that leave the nodes taken in
    the round before and subtracts them from what their targets wait for.
    """
    links = settle(edges.select("src", "dst").distinct(), "edges")
    listed = nodes.select(col(nodes.columns[0]).alias("node")).distinct()
    incoming = links.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("waits"))
    state = settle(
        listed.join(incoming, on="node", how="left").withColumn("waits", F.coalesce("waits", F.lit(0).cast("long"))),
        "degrees",
    )
    taken: list[DataFrame] = []
    while True:
        roots, rest = state.filter("waits = 0").select("node"), state.filter("waits > 0")
        if roots.isEmpty():
            break
        taken.append(roots.withColumn("level", F.lit(len(taken))))
        freed = (
            links.join(roots.withColumnRenamed("node", "src"), on="src", how="left_semi")
            .groupBy(F.col("dst").alias("node"))
            .agg(F.count(F.lit(1)).alias("_freed"))
        )
        waits = (F.col("waits") - F.coalesce("_freed", F.lit(0))).alias("waits")
        state = settle(rest.join(freed, on="node", how="left").select("node", waits), "degrees")
        if len(taken) == doubling.ROUNDS and (far := _peel_far(links, taken, state)):
            taken.append(far[0])
            state = far[1]
            break
    if not taken:
        return state.limit(0).select("node", F.lit(0).alias("level")), state.select("node")
    levels = taken[0]
    for part in taken[1:]:
        levels = levels.unionByName(part)
    return levels, state.select("node")


def _peel_far(links: DataFrame, taken: list[DataFrame], state: DataFrame) -> tuple[DataFrame, DataFrame] | None:
    """Levels of the nodes in ``state``, and those of them on a cycle or behind one, by path doubling.

    A walk of as many edges as there are nodes left goes round, so what it leads to has no level. For the
    others the level is the longest walk from a node that follows one taken before.
    """
    left = settle(state.select("node"), "left")
    inner = links.join(left.select(F.col("node").alias("src")), on="src").join(left.select(F.col("node").alias("dst")), on="dst")
    inner = settle(inner.select("src", "dst"), "edges")
    looped = doubling.on_long_walks(inner, left.count())
    if looped is None:
        return None
    placed = taken[0]
    for part in taken[1:]:
        placed = placed.unionByName(part)
    looped = settle(looped, "looped")
    free = inner.join(looped.select(F.col("node").alias("dst")), on="dst", how="left_anti")
    level = F.max(F.col("level") + 1).cast("long").alias("value")
    into = placed.select(F.col("node").alias("src"), "level").join(links, on="src").groupBy(F.col("dst").alias("node")).agg(level)
    starts = into.join(left, on="node").join(looped, on="node", how="left_anti").unionByName(
        # A root that is still there is freed by the last round.
        state.filter("waits = 0").select("node", F.lit(len(taken)).cast("long").alias("value"))
    )
    starts = starts.groupBy("node").agg(F.max("value").alias("value"))
    levels = doubling.far(starts, free.select("src", "dst", F.lit(1).cast("long").alias("value")), doubling.LONGEST)
    return None if levels is None else (levels.select("node", F.col("value").cast("int").alias("level")), looped)


def all_nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()


def graph_levels(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """Depth of each node: the longest path from a node without inputs.

    Nodes on a cycle, or behind one, have no depth and are left out.
    """
    return _peel(edges, nodes if nodes is not None else all_nodes(edges))[0]


def find_cycles(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """Nodes that no order can place: those on a cycle and those behind one."""
    return _peel(edges, nodes if nodes is not None else all_nodes(edges))[1]


def dangling_and_duplicate(nodes: DataFrame, inputs: DataFrame) -> DataFrame:
    """Inputs nothing produces, and outputs that several nodes produce.

    ``nodes`` is ``(node, output)``, ``inputs`` is ``(node, input)``. The result
    is ``(problem, name, n_nodes)``.
    """
    outputs = nodes.filter(F.col("output").isNotNull())
    dangling = (
        inputs.withColumnRenamed("input", "name")
        .join(outputs.select(F.col("output").alias("name")).distinct(), on="name", how="left_anti")
        .groupBy("name")
        .agg(F.count_distinct("node").alias("n_nodes"))
        .select(F.lit("dangling").alias("problem"), "name", "n_nodes")
    )
    duplicate = (
        outputs.groupBy(F.col("output").alias("name"))
        .agg(F.count_distinct("node").alias("n_nodes"))
        .filter(F.col("n_nodes") > 1)
        .select(F.lit("duplicate").alias("problem"), "name", "n_nodes")
    )
    return dangling.unionByName(duplicate)


def stale_nodes(edges: DataFrame, stored: DataFrame, current: DataFrame) -> DataFrame:
    """Nodes whose code changed since they ran, and all nodes behind them.

    ``stored`` and ``current`` are ``(node, hash)``; a hash unknown on either
    side is not a change. ``depth`` 0 marks the changed nodes.
    """
    a = stored.select("node", F.col("hash").alias("_stored"))
    b = current.select("node", F.col("hash").alias("_current"))
    changed = a.join(b, on="node").filter(F.col("_stored") != F.col("_current")).select("node")
    return reachable(edges, changed, inclusive=True)


def normalise_path(path: Column, base: str = "/") -> Column:
    """An absolute path in lower case without ``.``, ``..`` and doubled slashes."""
    absolute = F.when(F.startswith(path, F.lit("/")), path).otherwise(F.concat(F.lit(base.rstrip("/") + "/"), path))
    # Slashes, each with or without a dot, before another slash or the end.
    plain = F.regexp_replace(absolute, r"(/\.?)+(?=/|$)", "")

    def step(done: Column, part: Column) -> Column:
        up = F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))
        return F.when(part == "", done).when(part == "..", up).otherwise(F.concat(done, F.array(part)))

    # Only a path that goes up is taken apart; that costs far more.
    folded = F.array_join(F.aggregate(F.split(plain, "/"), F.array().cast("array<string>"), step), "/")
    rooted = F.when(plain.rlike(r"/\.\.(/|$)"), F.concat(F.lit("/"), folded)).when(plain == "", "/").otherwise(plain)
    return F.lower(rooted)


def shared_paths(sinks: DataFrame, sources: DataFrame, base: str = "/") -> DataFrame:
    """Who writes and who reads each path that has both: one row per pipeline and role.

    Both sides are ``(pipeline, path, templated)``. Rows grow with the uses of a
    path, not with the pairs of its writers and readers.
    """

    def uses(df: DataFrame, role: str) -> DataFrame:
        path = normalise_path(F.col("path"), base).alias("shared_path")
        return df.select(path, F.lit(role).alias("role"), "pipeline", "templated")

    every = uses(sinks, "writer").unionByName(uses(sources, "reader"))
    both = every.groupBy("shared_path").agg(F.count_distinct("role").alias("_roles")).filter(F.col("_roles") == 2)
    return every.join(both.select("shared_path"), on="shared_path", how="left_semi")


def sink_source_edges(sinks: DataFrame, sources: DataFrame, pipelines: DataFrame, base: str = "/") -> DataFrame:
    """Pipelines that read what another one writes, for the named ``pipelines (pipeline)``.

    Both sides are ``(pipeline, path, templated)``. Every reader of a path is a
    consumer of it. A path with many writers and readers has very many pairs, so
    edges are given for those that start or end at a named pipeline; all uses of
    all paths are in ``shared_paths``. A pipeline has no edge to itself; an edge
    is ``resolved`` when neither path was a template.
    """
    named = pipelines.select("pipeline").distinct()

    def side(df: DataFrame, mark: str) -> DataFrame:
        path = normalise_path(F.col("path"), base).alias("_path")
        return df.select(path, F.col("pipeline").alias(f"{mark}_pipeline"), F.col("templated").alias(f"_{mark}"), col("path").alias(f"_{mark}_path"))

    writers, readers = side(sinks, "source"), side(sources, "target")
    from_named = writers.join(named, writers.source_pipeline == named.pipeline, "left_semi").join(readers, on="_path")
    others = writers.join(named, writers.source_pipeline == named.pipeline, "left_anti")
    to_named = others.join(readers.join(named, readers.target_pipeline == named.pipeline, "left_semi"), on="_path")
    return from_named.unionByName(to_named).filter(F.col("source_pipeline") != F.col("target_pipeline")).select(
        "source_pipeline",
        "target_pipeline",
        F.col("_source_path").alias("shared_path"),
        (~(F.col("_source") | F.col("_target"))).alias("resolved"),
    )
