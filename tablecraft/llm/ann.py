"""Approximate nearest neighbours: greedy search on a neighbour graph.

The graph is built by NN-descent over all vectors, in a space where nearness follows the inner product
among vectors of similar length. A query keeps a pool of the best nodes seen. Each round looks up the lists of
its best nodes not yet expanded, has the nodes in them rated in their buckets, in double precision on the
original vectors, and takes the better ones into the pool; it ends when the best ``beam`` of every query's pool
are expanded. Then recall is measured against brute force for a bounded sample of the queries, and the beam
doubled while it is too low; a warning says so if it still is when the beam spans all nodes.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import settle
from .common import picked, query, table
from .nndescent import (
    Settings,
    _array,
    _flat,
    _lists,
    _packed,
    best,
    buckets_for,
    dot,
    lengths,
    lifted_column,
    neighbour_graph,
    packed_column,
    usable,
)

TOP = 20
GRAPH = Settings(neighbours=40, sample=20, even=True, kind="f4")
#: Best nodes of a query that must be expanded, nodes expanded per round, and pool entries kept.
BEAM, STEP, POOL = 224, 96, 640
#: Queries that recall is measured with at most, and what it must reach.
AUDITED, RECALL = 64, 0.93
#: Nearest nodes that lead back to a node.
BACK = 10
#: Queries handled together.
GROUP = 256
#: Vectors of one scale in the graph differ in length by less than this factor.
CLASS = 4.0
#: Longest nodes of each scale at which every query starts too.
STARTS = 16
#: What rounding can change in an inner product of vectors of length 1.
ROUNDING = 1e-12

STATE = "part int, q long, x binary, ids array<long>, sims array<double>, done array<boolean>"


def _frontier(sims: np.ndarray, row: np.ndarray, done: np.ndarray, beam: int) -> np.ndarray:
    """Which pool entries are expanded next; pools are sorted, nearest first."""
    starts = np.searchsorted(row, row)
    open_ = ~done & (np.arange(len(row)) - starts < beam)
    before = np.concatenate([[0], np.cumsum(open_)])
    return open_ & (before[:-1] - before[starts] < STEP)


def search(
    lists: DataFrame, rated: DataFrame, queries: DataFrame, buckets: int, parts: int, starts: list[int], beam: int = BEAM, state: DataFrame | None = None
) -> DataFrame:
    """Pools ``(part, q, x, ids, sims, done)`` for ``queries (q, x, entry, size)``, nearest first.

    ``rated (bucket, node, x)`` has what nodes are rated by. ``entry`` is the node at which a query starts, of similarity
    ``size``, besides ``starts``. A ``state`` of an earlier search goes on from there.
    """
    fresh = state is None
    if state is None:
        state = queries.select(
            (F.col("q") % parts).cast("int").alias("part"),
            "q",
            "x",
            F.array("entry").alias("ids"),
            F.array("size").alias("sims"),
            F.array(F.lit(False)).alias("done"),
        )
    pool = max(POOL, 2 * beam)

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, ids = _flat(batch.column("ids"))
            chosen = _frontier(_flat(batch.column("sims"))[1], row, _flat(batch.column("done"))[1].astype(bool), beam)
            at = row[chosen]
            yield pa.RecordBatch.from_arrays(
                [batch.column("part").take(pa.array(at)), batch.column("q").take(pa.array(at)), pa.array(ids[chosen])], ["part", "q", "node"]
            )

    def request(own: pa.Table, found: pa.Table) -> pa.Table:
        found = found.sort_by("q")
        owner, nexts = _array(found["q"]), found["next"]
        row, ids = _flat(nexts)
        owner = owner[row]
        q, rows = _array(own["q"]), {k: [] for k in ("bucket", "part", "q", "x", "least", "ids")}
        own_row, own_ids = _flat(own["ids"])
        own_ends = np.searchsorted(own_row, np.arange(len(q) + 1))
        sims = _flat(own["sims"])[1]
        x, part = own["x"].to_pylist(), _array(own["part"])
        for i in range(len(q)):
            lo, hi = np.searchsorted(owner, [q[i], q[i] + 1])
            if lo == hi:
                continue
            known = own_ids[own_ends[i] : own_ends[i + 1]]
            new = np.setdiff1d(ids[lo:hi], known)
            least = float(sims[own_ends[i + 1] - 1]) if len(known) >= pool else -np.inf
            place = new % buckets
            order = np.argsort(place, kind="stable")
            new, place = new[order], place[order]
            ends = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1], [True]])) if len(new) else []
            for a, b in zip(ends[:-1], ends[1:]):
                for k, v in zip(rows, (place[a], part[i], q[i], x[i], least, new[a:b])):
                    rows[k].append(v)
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.float64(), pa.list_(pa.int64()))
        return pa.table([pa.array(v, k) for v, k in zip(rows.values(), kinds)], names=list(rows))

    def rate(requests: pa.Table, nodes: pa.Table) -> pa.Table:
        nodes = nodes.sort_by("node")
        known, x = _array(nodes["node"]), _packed(nodes["x"], "f8")
        row, ids = _flat(requests["ids"])
        ends = np.searchsorted(row, np.arange(len(requests) + 1))
        at, looks = np.searchsorted(known, ids), _packed(requests["x"], "f8")
        least = _array(requests["least"])
        sims = np.concatenate([x[at[ends[i] : ends[i + 1]]] @ looks[i] for i in range(len(looks))] or [np.empty(0)])
        kept = sims > least[row]
        made = _lists(row[kept], np.arange(len(requests)), [ids[kept], sims[kept]])
        return pa.table([requests["part"], requests["q"], *made], names=["part", "q", "ids", "sims"])

    def take(own: pa.Table, answers: pa.Table) -> pa.Table:
        own = own.sort_by("q")
        q = _array(own["q"])
        row, ids = _flat(own["ids"])
        sims, done = _flat(own["sims"])[1], _flat(own["done"])[1].astype(bool)
        done = done | _frontier(sims, row, done, beam)
        new_row, new_ids = _flat(answers["ids"])
        owners = np.concatenate([q[row], _array(answers["q"])[new_row]])
        columns = best(
            owners,
            np.concatenate([ids, new_ids]),
            np.concatenate([sims, _flat(answers["sims"])[1]]).astype(np.float64),
            pool,
            np.concatenate([done, np.zeros(len(new_ids), bool)]),
        )
        made = _lists(columns[0], q, columns[1:])
        return pa.table([own["part"], own["q"], own["x"], *made], names=["part", "q", "x", "ids", "sims", "done"])

    # A node that no list holds could not be reached: nodes also lead to those whose nearest they are.
    onward = lists.select("node", F.col("ids").alias("next")).union(
        lists.select(F.explode(F.slice("ids", 1, BACK)).alias("node"), F.array("node").alias("next"))
    )
    rated = rated.groupBy("bucket")
    while True:
        state = settle(state, "search")
        wanted = state.select("part", "q", "ids", "sims", "done").mapInArrow(asked, "part int, q long, node long")
        if wanted.isEmpty():
            return state
        found = wanted.join(onward, "node").select(F.col("part").alias("at"), "q", "next")
        if fresh and starts:
            found = found.union(state.select("part", "q", F.lit(starts).cast("array<long>")))
        fresh = False
        requests = state.groupBy("part").cogroup(found.groupBy("at")).applyInArrow(
            request, "bucket int, part int, q long, x binary, least double, ids array<long>"
        )
        answers = requests.groupBy("bucket").cogroup(rated).applyInArrow(rate, "part int, q long, ids array<long>, sims array<double>")
        state = state.groupBy("part").cogroup(answers.groupBy("part")).applyInArrow(take, STATE)


def brute_force(vectors: DataFrame, wanted: list[tuple[int, list[float]]], top: int) -> dict[int, list[int]]:
    """The ``top`` nodes of largest inner product for each of a few ``wanted (node, vector)``, from all rows
    of ``vectors (node, vector)``. Each batch returns its own best, so few rows reach the driver."""
    ids = np.array([w[0] for w in wanted], np.int64)
    looks = np.array([w[1] for w in wanted], np.float64)

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owners, nodes, scores = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0)]
        for batch in batches:
            known = _array(batch.column("node"))
            matrix = _flat(batch.column("vector"))[1].astype(np.float64).reshape(len(known), -1)
            values = looks @ matrix.T
            values[ids[:, None] == known[None]] = -np.inf
            at = np.argsort(-values, axis=1, kind="stable")[:, :top]
            owners.append(np.repeat(ids, at.shape[1]))
            nodes.append(known[at].ravel())
            scores.append(np.take_along_axis(values, at, 1).ravel())
            o, n, s = best(np.concatenate(owners), np.concatenate(nodes), np.concatenate(scores), top)
            owners, nodes, scores = [o], [n], [s]
        kept = np.isfinite(scores[-1])
        yield pa.RecordBatch.from_arrays([pa.array(v[-1][kept]) for v in (owners, nodes, scores)], ["q", "node", "score"])

    rows = vectors.select("node", "vector").mapInArrow(rate, "q long, node long, score double")
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "node"))
    found: dict[int, list[int]] = {}
    for r in rows.withColumn("place", place).filter(F.col("place") <= top).collect():  # len(wanted) * top rows
        found.setdefault(r.q, []).append(r.node)
    return found


def recall(state: DataFrame, truth: dict[int, list[int]], top: int) -> float:
    """Share of the true neighbours that are among the ``top`` of the pools, the query's own node apart."""
    rows = state.filter(F.col("q").isin(list(truth))).select("q", F.slice("ids", 1, top + 1).alias("ids")).collect()
    pools = {r.q: [i for i in r.ids if i != r.q][:top] for r in rows}
    return sum(len(set(t) & set(pools[q])) for q, t in truth.items()) / max(1, sum(map(len, truth.values())))


def nearest(
    vectors: DataFrame,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    every: int = 20,
    top: int = TOP,
    graph: Settings = GRAPH,
    beam: int = BEAM,
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each id divisible by ``every`` its ``top`` nearest rows.

    Nearness is the inner product, in double precision on the original vectors; ties go to the smaller id.
    Null ids and vectors that are null, zero, or hold null or non-finite components take no part. Vectors
    of different lengths have no inner product: those of each length are searched among themselves, length by
    length. Every row is a candidate, repeated ones as often as they occur, also those that share
    the query's id or its vector; only one row is the query's own. Rows that agree in id and vector ask once.
    Equal vectors are one node of the graph; of each the ``top + 1`` smallest ids are kept, as more
    cannot be among a query's nearest. A query with fewer candidates gets all of them; an empty table gives
    an empty result; other columns are ignored.
    """
    rows = picked(vectors, id=id_column, vector=vector_column).filter(F.col("id").isNotNull() & usable(F.col("vector")))
    out = rows.filter(F.lit(False)).select(F.col("id").alias("query_id"), F.lit(0).alias("rank"), F.col("id").alias("vec_id"), F.lit(0.0).alias("score"))
    for length in lengths(rows, "vector"):
        out = out.union(_nearest(rows.filter(F.size("vector") == length), every, top, graph, beam))
    return out


def _nearest(rows: DataFrame, every: int, top: int, graph: Settings, beam: int) -> DataFrame:
    """``nearest`` among usable ``rows (id, vector)`` of one length."""
    place = F.row_number().over(Window.partitionBy("vector").orderBy("id"))
    few = rows.withColumn("_place", place).filter(F.col("_place") <= top + 1)
    distinct = few.groupBy("vector").agg(F.sort_array(F.collect_list("id")).alias("members"))
    nodes = settle(
        distinct.withColumn("node", F.monotonically_increasing_id()).withColumn("length", F.sqrt(dot(F.col("vector"), F.col("vector")))),
        "vectors",
    )
    count, longest = nodes.agg(F.count(F.lit(1)), F.max("length")).first()
    asking = settle(
        rows.filter(F.pmod("id", F.lit(every)) == 0).distinct().join(nodes.select("vector", "node"), "vector").select(F.col("id").alias("query_id"), "node"),
        "asking",
    )
    # Vectors of like length share a scale, so that a few long ones do not take all others to one point.
    longest, tiny = longest or 1.0, F.lit(1e-300)
    steps = F.floor(F.log(F.lit(longest) / F.greatest("length", tiny)) / float(np.log(CLASS)))
    scaled = nodes.withColumn("scale", F.greatest(F.lit(longest) * F.pow(F.lit(1 / CLASS), steps), "length", tiny))
    units = scaled.select("node", lifted_column(graph.kind)("vector", "scale").alias("x"))
    place = F.row_number().over(Window.partitionBy("scale").orderBy(F.desc("length"), "node"))
    # At most STARTS per scale, and no more scales than the exponents of a number have.
    starts = [r.node for r in scaled.withColumn("place", place).filter(F.col("place") <= STARTS).select("node").collect()]
    lists = neighbour_graph(units, count, graph)
    buckets = buckets_for(count, graph)
    bucket = (F.col("node") % buckets).cast("int").alias("bucket")
    rated = settle(nodes.select(bucket, "node", packed_column()("vector").alias("x")), "rated")
    own = nodes.select("node", (F.col("length") * F.col("length")).alias("size"))
    queries = rated.join(asking.select("node").distinct(), "node").join(own, "node").select(
        F.col("node").alias("q"), "x", F.col("node").alias("entry"), "size"
    )
    parts = max(1, count // every // GROUP)
    sample = asking.select("node").distinct().orderBy(F.xxhash64("node"), "node").limit(AUDITED)
    wanted = [(r.node, r.vector) for r in sample.join(nodes, "node").select("node", "vector").collect()]  # at most AUDITED
    truth = brute_force(nodes, wanted, top) if wanted else {}
    state = None
    while True:
        state = search(lists, rated, queries, buckets, parts, starts, beam, state)
        reached = recall(state, truth, top)
        if reached >= RECALL or beam >= count:
            break
        beam *= 2
    if truth and reached < RECALL:
        warnings.warn(f"recall of {reached:.3f} among {len(truth)} audited queries, below {RECALL}", stacklevel=2)
    # The top, and what could belong to it but for rounding; the query's own node is one of the top + 1.
    pools = state.join(nodes.select(F.col("node").alias("q"), F.col("vector").alias("look"), F.col("length").alias("size")), "q")
    least = F.element_at("sims", F.least(F.lit(top + 1), F.size("sims"))) - F.lit(ROUNDING * longest) * F.col("size")
    entries = pools.withColumn("least", least).select("q", "look", "least", F.explode(F.arrays_zip("ids", "sims")).alias("e"))
    candidates = entries.filter(F.col("e.sims") >= F.col("least")).select("q", "look", F.col("e.ids").alias("node"))
    exact = candidates.join(nodes.select("node", "vector", "members"), "node").select(
        "q", F.col("node").alias("near"), "members", dot(F.col("vector"), F.col("look")).alias("score")
    )
    # Of the query's own node its own row is left out, once. Without its id there, more rows come before it than are asked for.
    at = F.array_position("members", F.col("query_id")).cast("int")
    others = F.concat(F.slice("members", F.lit(1), F.greatest(at - 1, F.lit(0))), F.slice("members", at + 1, F.size("members")))
    candidate = F.when((F.col("near") == F.col("node")) & (at > 0), others).otherwise(F.col("members"))
    pairs = asking.join(exact, asking.node == exact.q).select("query_id", "node", "score", F.explode(candidate).alias("vec_id"))
    # A query has at most top + 1 rows per node of its pool.
    order = Window.partitionBy("query_id", "node").orderBy(F.desc("score"), "vec_id")
    ranked = pairs.withColumn("rank", F.row_number().over(order))
    return ranked.filter(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


@query("op4_ann")
def op4_ann(spark: SparkSession, folder: str) -> DataFrame:
    return nearest(table(spark, folder, "embeddings"))
