"""Near duplicates among vectors, found on a neighbour graph.

NN-descent gives each vector its nearest others; pairs that may reach the threshold are checked in double
precision on the original vectors. A list all of whose entries are links is saturated: there may be more.
Its list is then enlarged to its whole component, whose members are compared in tiles; only the numbers
of links leave a tile, so a dense group of any size gives rows in proportion to its size and its tiles.
Lists full of their own group hide links to another dense group, so blocks of different components are
compared too, unless their centres are too far apart for their radii to allow a link. Recall is measured
against brute force for a bounded sample, per link and per vector, and the graph built anew with longer lists
while either is too low; a warning says so if one still is when lists hold all vectors.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import settle
from .common import picked, query, table
from .components import components
from .nndescent import Settings, _array, _flat, dot, lengths, neighbour_graph, unit_column, usable

THRESHOLD = 0.95
GRAPH = Settings(neighbours=16, sample=8, tables=12, leaf=256)
#: What half precision can take away from a similarity.
SLACK = 0.004
#: Members of a dense component that are compared at once.
TILE = 1_024
#: Centres of blocks that are compared at once.
CELL = 2_048
#: Vectors that recall is measured with at most, and what it must reach.
AUDITED, RECALL = 128, 0.97
#: Half of the audited vectors have a neighbour whose similarity is at most so much below the threshold.
NEAR = 0.05


def _double(column) -> np.ndarray:
    rows, values = _flat(column)
    return values.astype(np.float64).reshape(len(column), -1)


def _links(lists: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """Links ``(a, b)``, a < b, of the graph, checked on the original vectors."""
    entries = lists.select("node", F.explode(F.arrays_zip("ids", "sims")).alias("e")).filter(F.col("e.sims") >= threshold - SLACK)
    pairs = entries.select(F.least("node", "e.ids").alias("a"), F.greatest("node", "e.ids").alias("b")).distinct()
    one = nodes.select(F.col("node").alias("a"), F.col("vector").alias("va"), F.col("length").alias("la"))
    two = nodes.select(F.col("node").alias("b"), F.col("vector").alias("vb"), F.col("length").alias("lb"))
    cosine = dot(F.col("va"), F.col("vb")) / (F.col("la") * F.col("lb"))
    return pairs.join(one, "a").join(two, "b").filter(cosine >= threshold).select("a", "b")


def _blocks(members: DataFrame) -> DataFrame:
    """``members`` with the ``block`` of their component that a hash deals them to, and how many ``blocks`` it has."""
    sizes = members.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("blocks"))
    return members.join(sizes, "component").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))


def _tiled(blocks: DataFrame, threshold: float) -> DataFrame:
    """``(node, linked)``: rows linked to each member within its component, of which every two blocks meet."""
    dealt = blocks.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "component", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "node", "vector", "length", "copies"
    )

    def compare(rows: pa.Table) -> pa.Table:
        low, high, block = rows["low"][0].as_py(), rows["high"][0].as_py(), _array(rows["block"])
        node, length, copies = (_array(rows[c]) for c in ("node", "length", "copies"))
        unit = _double(rows["vector"]) / length[:, None]
        one, two = np.flatnonzero(block == low), np.flatnonzero(block == high)
        linked = (unit[one] @ unit[two].T) >= threshold
        if low == high:
            np.fill_diagonal(linked, False)
            counts = [(node[one], linked @ copies[two])]
        else:
            counts = [(node[one], linked @ copies[two]), (node[two], copies[one] @ linked)]
        return pa.table({"node": np.concatenate([c[0] for c in counts]), "linked": np.concatenate([c[1] for c in counts]).astype(np.int64)})

    return dealt.groupBy("component", "low", "high").applyInArrow(compare, "node long, linked long")


def _meetings(blocks: DataFrame, threshold: float) -> DataFrame:
    """``(c, b, c2, b2)``: blocks of different components between which a link is possible."""

    def bound(rows: pa.Table) -> pa.Table:
        unit = _double(rows["vector"]) / _array(rows["length"])[:, None]
        center = unit.sum(axis=0)
        size = np.sqrt(center @ center)
        center = center / size if size > 1e-9 else unit[0]
        angle = float(np.arccos(np.clip(unit @ center, -1.0, 1.0)).max())
        return pa.table([rows["component"][:1], rows["block"][:1], pa.array([center.tolist()]), pa.array([angle])], names=["c", "b", "center", "angle"])

    bounds = settle(
        blocks.select("component", "block", "vector", "length")
        .groupBy("component", "block")
        .applyInArrow(bound, "c long, b int, center array<double>, angle double"),
        "bounds",
    )
    cells = max(1, -(-bounds.count() // CELL))
    dealt = bounds.withColumn("cell", F.pmod(F.xxhash64("c", "b"), F.lit(cells)).cast("int")).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.lit(cells - 1)))
    )
    reach = float(np.arccos(np.clip(threshold, -1.0, 1.0))) + 1e-6

    def near(rows: pa.Table) -> pa.Table:
        cell, c, b, angle = (_array(rows[n]) for n in ("cell", "c", "b", "angle"))
        center = _double(rows["center"])
        one, two = np.flatnonzero(cell == rows["low"][0].as_py()), np.flatnonzero(cell == rows["high"][0].as_py())
        apart = np.arccos(np.clip(center[one] @ center[two].T, -1.0, 1.0))
        meets = apart <= angle[one][:, None] + angle[two][None] + reach
        # Within a cell each pair comes in both orders.
        meets &= (c[one][:, None] < c[two][None]) if rows["low"][0] == rows["high"][0] else (c[one][:, None] != c[two][None])
        i, j = np.nonzero(meets)
        return pa.table([pa.array(v) for v in (c[one[i]], b[one[i]], c[two[j]], b[two[j]])], names=["c", "b", "c2", "b2"])

    keyed = dealt.select(F.least("cell", "other").alias("low"), F.greatest("cell", "other").alias("high"), "cell", "c", "b", "center", "angle")
    return keyed.groupBy("low", "high").applyInArrow(near, "c long, b int, c2 long, b2 int")


def _across(blocks: DataFrame, threshold: float) -> DataFrame:
    """``(node, linked, partner)``: rows of other components linked to each member, and per two blocks with links
    one link in a row with a partner."""
    meetings = settle(_meetings(blocks, threshold), "meetings")
    key = F.struct("c", "b", "c2", "b2").alias("pair")
    sides = meetings.select(key, F.col("c").alias("component"), F.col("b").alias("block"), F.lit(False).alias("second")).union(
        meetings.select(key, F.col("c2").alias("component"), F.col("b2").alias("block"), F.lit(True).alias("second"))
    )
    met = sides.join(blocks.select("component", "block", "node", "vector", "length", "copies"), ["component", "block"])

    def compare(rows: pa.Table) -> pa.Table:
        node, copies, second = _array(rows["node"]), _array(rows["copies"]), _array(rows["second"]).astype(bool)
        unit = _double(rows["vector"]) / _array(rows["length"])[:, None]
        one, two = np.flatnonzero(~second), np.flatnonzero(second)
        linked = (unit[one] @ unit[two].T) >= threshold
        i, j = np.nonzero(linked)
        count = np.concatenate([linked @ copies[two], copies[one] @ linked, np.zeros(min(1, len(i)), np.int64)])
        owner = np.concatenate([node[one], node[two], node[one[i[:1]]]])
        partner = [None] * (len(one) + len(two)) + node[two[j[:1]]].tolist()
        return pa.table([pa.array(owner), pa.array(count.astype(np.int64)), pa.array(partner, pa.int64())], names=["node", "linked", "partner"])

    return met.select("pair.*", "second", "node", "vector", "length", "copies").groupBy("c", "b", "c2", "b2").applyInArrow(
        compare, "node long, linked long, partner long"
    )


def _counted(lists: DataFrame, nodes: DataFrame, threshold: float, size: int) -> DataFrame:
    """``(node, linked, component)`` of every node; ``linked`` counts rows with other vectors."""
    links = settle(_links(lists, nodes, threshold), "links")
    reached = settle(components(links), "components")
    full = lists.filter((F.size("ids") >= size) & (F.element_at("sims", -1) >= threshold - SLACK)).select("node")
    dense = reached.join(full, "node").select("component").distinct()
    members = settle(
        reached.join(dense, "component").join(nodes.select("node", "vector", "length", "copies"), "node"), "members"
    )
    blocks = settle(_blocks(members), "blocks")
    across = settle(_across(blocks, threshold), "across")
    bridges = across.filter(F.col("partner").isNotNull()).select(F.col("node").alias("a"), F.col("partner").alias("b"))
    if not bridges.isEmpty():
        reached = settle(components(links.union(bridges)), "components")
    tiled = _tiled(blocks, threshold).union(across.select("node", "linked")).groupBy("node").agg(F.sum("linked").alias("linked"))
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    listed = (
        both.join(nodes.select(F.col("node").alias("b"), "copies"), "b")
        .groupBy(F.col("a").alias("node"))
        .agg(F.sum("copies").alias("listed"))
    )
    return (
        nodes.select("node")
        .join(reached, "node", "left")
        .join(listed, "node", "left")
        .join(tiled, "node", "left")
        .select("node", F.coalesce("linked", "listed", F.lit(0)).alias("linked"), F.coalesce("component", "node").alias("component"))
    )


def _audit(counted: DataFrame, lists: DataFrame, nodes: DataFrame, threshold: float) -> float | None:
    """Share of the links of a sample of vectors that were counted, or the mean share per vector if that is
    less; None if no vector of the sample has a link. Half of the sample are vectors whose nearest neighbour
    on the graph is about as near as the threshold or nearer, the other half any. One pass over all vectors."""
    near = lists.filter(F.try_element_at("sims", F.lit(1)) >= threshold - NEAR).select("node")
    looked = nodes.select("node", "vector", "length")
    halves = [d.orderBy(F.xxhash64("node"), "node").limit(AUDITED // 2) for d in (looked.join(near, "node", "left_semi"), looked)]
    sample = list({r.node: r for half in halves for r in half.collect()}.values())
    if not sample:
        return None
    ids = np.array([r.node for r in sample])
    looks = np.array([r.vector for r in sample], np.float64) / np.array([[r.length] for r in sample])

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unit = _double(batch.column("vector")) / _array(batch.column("length"))[:, None]
            near = (looks @ unit.T >= threshold) & (ids[:, None] != _array(batch.column("node"))[None])
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(near @ _array(batch.column("copies")))], ["node", "linked"])

    rated = nodes.select("node", "vector", "length", "copies").mapInArrow(rate, "node long, linked long")
    truth = {r.node: r.n for r in rated.groupBy("node").agg(F.sum("linked").alias("n")).collect()}
    found = {r.node: r.linked for r in counted.filter(F.col("node").isin(ids.tolist())).collect()}
    shares = [(min(n, found.get(i, 0)), n) for i, n in truth.items() if n]
    if not shares:
        return None
    return min(sum(f for f, _ in shares) / sum(n for _, n in shares), sum(f / n for f, n in shares) / len(shares))


def _linked(rows: DataFrame, threshold: float, graph: Settings) -> DataFrame:
    """``(vec_id, n_links, component_id)`` of usable ``rows (vec_id, vector)`` of one length."""
    distinct = rows.groupBy("vector").agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("copies"))
    size = F.sqrt(dot(F.col("vector"), F.col("vector")))
    nodes = settle(distinct.withColumn("node", F.monotonically_increasing_id()).withColumn("length", size), "vectors")
    count = nodes.count()
    units = nodes.select("node", unit_column()("vector").alias("x"))
    while True:
        lists = neighbour_graph(units, count, graph)
        counted = settle(_counted(lists, nodes, threshold, graph.neighbours), "counted")
        reached = _audit(counted, lists, nodes, threshold)
        if reached is None or reached >= RECALL or graph.neighbours >= count:
            break
        graph = replace(graph, neighbours=2 * graph.neighbours, sample=2 * graph.sample, tables=2 * graph.tables)
    if reached is None and count > AUDITED:
        warnings.warn(f"recall is not measured: none of the audited among {count} vectors has a link", stacklevel=3)
    if reached is not None and reached < RECALL:
        warnings.warn(f"recall of {reached:.3f} among the audited vectors, below {RECALL}", stacklevel=3)
    smallest = counted.join(nodes.select("node", "first"), "node").groupBy("component").agg(F.min("first").alias("component_id"))
    known = counted.join(smallest, "component").join(nodes.select("node", "vector", "copies"), "node")
    return rows.join(known.select("vector", "copies", "linked", "component_id"), "vector").select(
        "vec_id", (F.col("linked") + F.col("copies") - 1).alias("n_links"), "component_id"
    )


def vector_components(
    vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", threshold: float = THRESHOLD, graph: Settings = GRAPH
) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)``: one row per row of ``vectors``.

    Vectors link if their cosine is ``threshold`` or more, in double precision. ``n_links`` counts the other
    rows linked directly, ``component_id`` is the smallest id reachable, and ``kept`` says whether that is
    the vector's own. Vectors that are null, zero, or hold null or non-finite components link with nothing
    and keep themselves. Vectors of different lengths have no cosine: those of each length are compared among
    themselves, length by length. Repeated rows are rows of their own: they link with each other, and each is
    kept if one is. A vector with a null id counts as a link of others; its own ``kept`` is false unless it has
    no component, whose id is then null too. An empty table gives an empty result; other columns are ignored.
    """
    rows = picked(vectors, vec_id=id_column, vector=vector_column)
    rows = settle(rows.withColumn("usable", usable(F.col("vector"))), "rows")
    out = rows.filter(~F.col("usable")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    sound = rows.filter("usable").drop("usable")
    for length in lengths(sound, "vector"):
        out = out.union(_linked(sound.filter(F.size("vector") == length), threshold, graph))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


@query("op2_nearvectors")
def op2_nearvectors(spark: SparkSession, folder: str) -> DataFrame:
    return vector_components(table(spark, folder, "embeddings"))
