"""A neighbour graph of vectors by NN-descent, in Spark joins.

Different vectors are nodes; each keeps a list of its nearest nodes known so far. The first lists come
from blocks of vectors that random hyperplanes sort next to each other. Then, round by round, the
neighbours of a node (and those it is a neighbour of) are joined with each other: whatever comes nearer
than the last of a list takes its place, until few lists change.

In a round every bucket with a center that a node is near to may improve the node's list, so proposals grow with
the buckets, up to the lists' lengths, for as long as lists change. ``even`` blocks, large ones with all pairs
compared, find most entries before the first round; what lists have already is never proposed.

Nodes are dealt to buckets of bounded size. A round shuffles links, and each vector once to each bucket
that needs it; similarities are computed per bucket, and only improvements leave it. Every round is written
to the shared folder. What one task holds is bounded by the bucket and the lists' lengths.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import settle

SEED = 20
#: Nodes per bucket at most. A round sends each vector to every bucket that needs it, so larger buckets mean
#: fewer copies; a task holds at most this many lists and the vectors in them, with their own lists, if those are of half precision, and
#: half as many in single precision.
BUCKET = 26_000
LIST = "node long, x binary, ids array<long>, sims array<float>, fresh array<boolean>, bucket int"


@dataclass(frozen=True)
class Settings:
    """``neighbours`` in a list, of which ``sample`` new and old ones each join per round; ``tables`` sorted
    orders cut in blocks of ``leaf`` start the lists; rounds end when fewer than ``still`` of all entries
    change. ``even`` blocks hold as many nodes as a bucket, however the rows are partitioned, instead of ``leaf``.
    ``kind`` is the numpy type of the vectors' components."""

    neighbours: int = 40
    sample: int = 20
    tables: int = 8
    leaf: int = 256
    even: bool = False
    still: float = 0.01
    seed: int = SEED
    kind: str = "f2"


def usable(vector: Column) -> Column:
    """Whether a vector takes part: all components finite, not all zero."""
    finite = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda v: v != 0), F.lit(False))


def dot(one: Column, two: Column) -> Column:
    """Inner product in double precision, on the vectors as they are."""
    return F.aggregate(F.zip_with(one, two, lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, v: s + v)


def lengths(vectors: DataFrame, column: str) -> list[int]:
    """The lengths that vectors have, the most common first. Vectors are compared with those of their own length."""
    sizes = vectors.groupBy(F.size(column).alias("n")).count()
    return [r.n for r in sizes.orderBy(F.desc("count"), F.desc("n")).collect()]  # as many as there are lengths


def _x(matrix: np.ndarray, kind: str = "f2") -> pa.Array:
    """Rows of a matrix as binary values, half precision unless ``kind`` says otherwise."""
    packed = np.ascontiguousarray(matrix.astype(kind))
    width = packed.shape[1] * packed.itemsize
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(packed), [None, pa.py_buffer(packed)]).cast(pa.binary())


def _packed(column, kind: str = "f2") -> np.ndarray:
    """A column ``x`` as a matrix of its own precision, read in place."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(column):
        return np.zeros((0, 1), kind)
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(kind).reshape(len(column), -1)


def _matrix(column, kind: str = "f2") -> np.ndarray:
    return _packed(column, kind).astype(np.float32)


def _flat(column) -> tuple[np.ndarray, np.ndarray]:
    """A list column as (row of each value, values)."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    counts = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(column)), counts), column.flatten().to_numpy(zero_copy_only=False)


def _lists(owners: np.ndarray, nodes: np.ndarray, values: list[np.ndarray]) -> list[pa.Array]:
    """List columns for ``nodes`` (sorted), from values sorted by owner."""
    ends = np.concatenate([np.searchsorted(owners, nodes), [len(owners)]]).astype(np.int32)
    return [pa.ListArray.from_arrays(pa.array(ends), pa.array(v)) for v in values]


def _array(column) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False) if isinstance(column, pa.Array) else column.to_numpy()


def _mixed(*parts: np.ndarray | int) -> np.ndarray:
    """A hash of the parts; the same in every task and run."""
    value = np.uint64(SEED)
    for part in parts:
        value = (value ^ np.asarray(part).astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        value = value ^ (value >> np.uint64(29))
    return value


def _rank(groups: np.ndarray, *order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sort by group, then by ``order``: (the permutation, the place within the group)."""
    by = np.lexsort((*order[::-1], groups))
    g = groups[by]
    starts = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])) if len(g) else np.empty(0, int)
    return by, np.arange(len(g)) - np.repeat(starts, np.diff(np.append(starts, len(g))))


def best(owners: np.ndarray, ids: np.ndarray, sims: np.ndarray, size: int, fresh: np.ndarray | None = None) -> list[np.ndarray]:
    """The ``size`` most similar different ids per owner, sorted; of two entries of an id the earlier counts."""
    by = np.lexsort((np.arange(len(ids)), ids, owners))
    first = np.ones(len(by), bool)
    first[1:] = (owners[by][1:] != owners[by][:-1]) | (ids[by][1:] != ids[by][:-1])
    by = by[first]
    order, place = _rank(owners[by], -sims[by], ids[by])
    kept = by[order][place < size]
    return [owners[kept], ids[kept], sims[kept], *([fresh[kept]] if fresh is not None else [])]


def _picked(owners: np.ndarray, ids: np.ndarray, fresh: np.ndarray, turn: int, size: int) -> np.ndarray:
    """Which entries join in this round: up to ``size`` fresh and ``size`` old ones per list, by hash."""
    by, place = _rank(owners * 2 + fresh, _mixed(owners, ids, turn))
    chosen = np.zeros(len(ids), bool)
    chosen[by[place < size]] = True
    return chosen


def _blocks(batches: Iterator[pa.RecordBatch], s: Settings, buckets: int) -> Iterator[pa.RecordBatch]:
    """Each row's nearest among the ``leaf`` rows that it is sorted into."""
    size, leaf = s.neighbours, s.leaf
    table, nodes, rows = None, np.empty(0, np.int64), None

    def near(nodes: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
        sims = x @ x.T
        np.fill_diagonal(sims, -np.inf)
        count = min(size, len(nodes) - 1)
        at = np.argpartition(-sims, count - 1, axis=1)[:, :count]
        owners = np.repeat(np.arange(len(nodes)), count)
        ids, values = nodes[at].ravel(), np.take_along_axis(sims, at, 1).ravel().astype(np.float32)
        columns = _lists(owners, np.arange(len(nodes)), [ids, values])
        return pa.RecordBatch.from_arrays([pa.array(nodes), *columns, pa.array((nodes % buckets).astype(np.int32))], ["node", "ids", "sims", "bucket"])

    for batch in batches:
        kinds, found, x = _array(batch.column("t")), _array(batch.column("node")), _matrix(batch.column("x"), s.kind)
        turns = np.flatnonzero(kinds[1:] != kinds[:-1]) + 1
        for lo, hi in zip([0, *turns.tolist()], [*turns.tolist(), len(kinds)]):
            if hi == lo:
                continue
            if kinds[lo] != table:
                if len(nodes) > 1:
                    yield near(nodes, rows)
                table, nodes, rows = kinds[lo], np.empty(0, np.int64), np.empty((0, x.shape[1]), np.float32)
            nodes, rows = np.concatenate([nodes, found[lo:hi]]), np.concatenate([rows, x[lo:hi]])
            while len(nodes) >= 2 * leaf:  # what is left over joins the last block
                yield near(nodes[:leaf], rows[:leaf])
                nodes, rows = nodes[leaf:], rows[leaf:]
    if len(nodes) > 1:
        yield near(nodes, rows)


def _closest(x: np.ndarray, size: int, rows: int = 512) -> list[np.ndarray]:
    """The ``size`` nearest other rows of each row of ``x``: rows, neighbours and similarities. ``rows`` are compared at a time."""
    found, size, groups = [], min(size, len(x) - 1), 4 * size
    for lo in range(0, len(x), rows):
        sims = x[lo : lo + rows] @ x.T
        own = np.arange(len(sims))
        sims[own, lo + own] = -np.inf
        least, wide = np.full(len(sims), -4.0, np.float32), len(x) // groups
        if wide > 1:  # as many groups of rows as asked for hold something as near as this
            tops = sims[:, : wide * groups].reshape(len(sims), wide, groups).max(axis=1)
            least = np.partition(tops, groups - size, axis=1)[:, groups - size]
        a, b = np.nonzero(sims >= least[:, None])
        if wide > 1 and len(a) > 4 * groups * len(sims):  # copies, all equally near
            b = np.argpartition(-sims, size - 1, axis=1)[:, :size].ravel()
            a = np.repeat(own, size)
        value = sims[a, b]
        by, place = _rank(a, -value, b)
        by = by[place < size]
        found.append((lo + a[by], b[by], value[by]))
    return [np.concatenate(f) for f in zip(*found)]


def _even(places: DataFrame, s: Settings, buckets: int) -> DataFrame:
    """Each node's nearest in as many blocks of equal size as there are buckets, for each order."""
    # Cells in order, within them the side; nodes in the same place by hash.
    hashed = F.pmod(F.xxhash64("node"), F.lit(1_000_000)) * F.lit(1e-12)
    placed = places.select("t", (F.col("code") + 1 / (1 + F.exp(-F.col("side"))) + hashed).alias("place"), "node", "x")
    cuts: dict[int, list[float]] = {}
    if buckets > 1:
        shares = F.percentile_approx("place", [k / buckets for k in range(1, buckets)], max(10_000, 20 * buckets))
        cuts = {r.t: r.cuts for r in placed.groupBy("t").agg(shares.alias("cuts")).collect()}  # a number per block

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t, place = _array(batch.column("t")), _array(batch.column("place"))
            block = np.zeros(len(t), np.int32)
            for k in np.unique(t):
                block[t == k] = np.searchsorted(cuts.get(int(k), []), place[t == k])
            yield pa.RecordBatch.from_arrays([batch.column("t"), pa.array(block), batch.column("node"), batch.column("x")], ["t", "block", "node", "x"])

    def near(block: pa.Table) -> pa.Table:
        block = block.sort_by("node")
        nodes, x = _array(block["node"]), _matrix(block["x"], s.kind)
        owners, ids, sims = _closest(x, s.neighbours) if len(nodes) > 1 else [np.empty(0, np.int64)] * 2 + [np.empty(0)]
        columns = _lists(owners, np.arange(len(nodes)), [nodes[ids], sims.astype(np.float32)])
        return pa.table([block["node"], *columns, pa.array((nodes % buckets).astype(np.int32))], names=["node", "ids", "sims", "bucket"])

    dealt = placed.mapInArrow(deal, "t int, block int, node long, x binary")
    return dealt.groupBy("t", "block").applyInArrow(near, "node long, ids array<long>, sims array<float>, bucket int")


def _start(nodes: DataFrame, count: int, s: Settings, buckets: int) -> DataFrame:
    """First lists: per table the nodes sorted by the sides of random hyperplanes that they lie on."""
    bits = max(1, int(np.log2(max(2, count / s.leaf))))
    tables = 1 if s.even and buckets == 1 else s.tables

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, node = _matrix(batch.column("x"), s.kind), batch.column("node")
            for t in range(tables):
                planes = np.random.default_rng([s.seed, t]).standard_normal((x.shape[1], bits + 1)).astype(np.float32)
                sides = x @ planes
                code = ((sides[:, :bits] > 0) << np.arange(bits)).sum(axis=1).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(x), t, np.int32)), pa.array(code), pa.array(sides[:, bits].astype(np.float64)), node, batch.column("x")],
                    ["t", "code", "side", "node", "x"],
                )

    places = nodes.select("node", "x").mapInArrow(coded, "t int, code long, side double, node long, x binary")
    if s.even:
        proposals = _even(places, s, buckets)
    else:
        order = ["t", "code", "side", "node"]
        blocks = places.repartitionByRange(*order).sortWithinPartitions(*order)
        proposals = blocks.select("t", "node", "x").mapInArrow(
            lambda batches: _blocks(batches, s, buckets), "node long, ids array<long>, sims array<float>, bucket int"
        )
    empty = nodes.select(
        "node", "x", *[F.array().cast(k).alias(c) for c, k in (("ids", "array<long>"), ("sims", "array<float>"), ("fresh", "array<boolean>"))],
        (F.col("node") % buckets).cast("int").alias("bucket"),
    )
    return _merged(empty, proposals, 0, s)


def _merged(lists: DataFrame, proposals: DataFrame, turn: int, s: Settings) -> DataFrame:
    """Lists with what the proposals improve; entries that joined in this round are no longer fresh."""

    def merge(own: pa.Table, new: pa.Table) -> pa.Table:
        own = own.sort_by("node")
        nodes = _array(own["node"])
        row, ids = _flat(own["ids"])
        sims, fresh = _flat(own["sims"])[1], _flat(own["fresh"])[1].astype(bool)
        fresh = fresh & ~_picked(nodes[row], ids, fresh, turn, s.sample)
        new_row, new_ids = _flat(new["ids"])
        owners = np.concatenate([nodes[row], _array(new["node"])[new_row]])
        columns = best(
            owners,
            np.concatenate([ids, new_ids]),
            np.concatenate([sims, _flat(new["sims"])[1]]).astype(np.float32),
            s.neighbours,
            np.concatenate([fresh, np.ones(len(new_ids), bool)]),
        )
        made = _lists(columns[0], nodes, columns[1:])
        return pa.table([own["node"], own["x"], *made, own["bucket"]], names=["node", "x", "ids", "sims", "fresh", "bucket"])

    return lists.groupBy("bucket").cogroup(proposals.groupBy("bucket")).applyInArrow(merge, LIST)


def _gathered(lists: DataFrame, turn: int, s: Settings, buckets: int) -> DataFrame:
    """``(bucket, center, fresh, old)``: the nodes that join around each center in this round."""

    def reverse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes = _array(batch.column("node"))
            row, ids = _flat(batch.column("ids"))
            fresh = _flat(batch.column("fresh"))[1].astype(bool)
            chosen = _picked(nodes[row], ids, fresh, turn, s.sample)
            center, member, fresh = ids[chosen], nodes[row][chosen], fresh[chosen]
            # A node that very many lists hold keeps a sample of them, as its own list would.
            by, place = _rank(center * 2 + fresh, _mixed(center, member, turn + 1))
            by = by[place < s.sample]
            yield pa.RecordBatch.from_arrays(
                [pa.array((center[by] % buckets).astype(np.int32)), pa.array(center[by]), pa.array(member[by]), pa.array(fresh[by])],
                ["bucket", "center", "member", "fresh"],
            )

    def gather(own: pa.Table, others: pa.Table) -> pa.Table:
        nodes = _array(own["node"])
        row, ids = _flat(own["ids"])
        fresh = _flat(own["fresh"])[1].astype(bool)
        chosen = _picked(nodes[row], ids, fresh, turn, s.sample)
        center, member, new = _array(others["center"]), _array(others["member"]), _array(others["fresh"]).astype(bool)
        by, place = _rank(center * 2 + new, _mixed(center, member, turn + 1))
        by = by[place < s.sample]
        center = np.concatenate([nodes[row][chosen], center[by]])
        member = np.concatenate([ids[chosen], member[by]])
        old = ~np.concatenate([fresh[chosen], new[by]])
        by = np.lexsort((old, member, center))  # an entry that is both counts as fresh
        center, member, old = center[by], member[by], old[by]
        first = np.ones(len(by), bool)
        first[1:] = (center[1:] != center[:-1]) | (member[1:] != member[:-1])
        center, member, old = center[first], member[first], old[first]
        nodes = np.unique(center[~old])
        parts = [_lists(center[m], nodes, [member[m]])[0] for m in (~old & np.isin(center, nodes), old & np.isin(center, nodes))]
        bucket = pa.array((nodes % buckets).astype(np.int32))
        return pa.table([bucket, pa.array(nodes), *parts], names=["bucket", "center", "fresh", "old"])

    back = lists.select("node", "ids", "fresh").mapInArrow(reverse, "bucket int, center long, member long, fresh boolean")
    return (
        lists.select("bucket", "node", "ids", "fresh")
        .groupBy("bucket")
        .cogroup(back.groupBy("bucket"))
        .applyInArrow(gather, "bucket int, center long, fresh array<long>, old array<long>")
    )


def _known(lists: pa.ChunkedArray, order: np.ndarray, member: np.ndarray, size: int) -> np.ndarray:
    """Per member, in order, the places that the entries of its list have among the members; -1 for the others."""
    row, ids = _flat(lists)
    at = np.minimum(np.searchsorted(member, ids), max(0, len(member) - 1))
    known, turned = np.full((len(member), size), -1, np.int32), np.argsort(order)
    known[turned[row], np.arange(len(row)) - np.searchsorted(row, row)] = np.where(member[at] == ids, at, -1)
    return known


def _joined(gathered: DataFrame, lists: DataFrame, s: Settings, buckets: int) -> DataFrame:
    """Proposals from joining the nodes around each center with each other: only entries that lists do not have."""
    members = gathered.select(F.col("bucket").alias("at"), F.explode(F.concat("fresh", "old")).alias("member")).distinct()
    last = F.when(F.size("sims") >= s.neighbours, F.element_at("sims", -1)).otherwise(F.lit(-4.0).cast("float"))
    vectors = members.join(lists.select(F.col("node").alias("member"), "x", last.alias("last"), "ids"), "member")

    def join(centers: pa.Table, vectors: pa.Table) -> pa.Table:
        order = np.argsort(_array(vectors["member"]))
        member, x, last = _array(vectors["member"])[order], _packed(vectors["x"], s.kind), _array(vectors["last"])[order]
        known = _known(vectors["ids"], order, member, s.neighbours)
        sides = []
        for name in ("fresh", "old"):
            row, ids = _flat(centers[name])
            sides.append((np.searchsorted(row, np.arange(len(centers) + 1)), np.searchsorted(member, ids)))
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        held, size = [np.empty(0, np.int64)] * 2 + [np.empty(0, np.float32)], 0
        for i in range(len(centers)):
            new, old = (at[ends[i] : ends[i + 1]] for ends, at in sides)
            every = np.concatenate([new, old])
            around = x[order[every]].astype(np.float32)
            sims = around[: len(new)] @ around.T
            a, b = np.nonzero((sims > np.minimum(last[new][:, None], last[every][None])) & (new[:, None] != every[None]))
            value = sims[a, b]
            a, b = new[a], every[b]
            for one, two in ((a, b), (b, a)):
                better = np.flatnonzero(value > last[one])
                better = better[(known[one[better]] != two[better][:, None]).all(axis=1)]  # what a list has is no improvement
                found.append((one[better], two[better], value[better]))
                size += len(better)
            if size > 2_000_000:
                held, found, size = best(*(np.concatenate([h, *f]) for h, f in zip(held, zip(*found))), s.neighbours), [], 0
        if found:
            held = best(*(np.concatenate([h, *f]) for h, f in zip(held, zip(*found))), s.neighbours)
        owners, ids, sims = held
        at = np.unique(owners)
        made = _lists(owners, at, [member[ids], sims.astype(np.float32)])
        return pa.table(
            [pa.array(member[at]), *made, pa.array((member[at] % buckets).astype(np.int32))], names=["node", "ids", "sims", "bucket"]
        )

    return (
        gathered.groupBy("bucket")
        .cogroup(vectors.groupBy("at"))
        .applyInArrow(join, "node long, ids array<long>, sims array<float>, bucket int")
    )


def buckets_for(count: int, s: Settings) -> int:
    return max(1, -(-count * np.dtype(s.kind).itemsize // (2 * BUCKET)))


def neighbour_graph(nodes: DataFrame, count: int, s: Settings) -> DataFrame:
    """Lists ``(node, x, ids, sims, fresh, bucket)`` for ``nodes (node, x)``, nearest first.

    ``x`` holds unit vectors of the settings' precision (``unit_column``, ``lifted_column``); similarities are their inner products.
    ``node`` must be unique and not negative. The number of rounds follows from the data, as each must
    change at least ``still`` of all entries for another one to follow. Where ``even`` blocks hold all nodes
    of the only bucket, the lists are exact and no round follows.
    """
    buckets = buckets_for(count, s)
    lists = settle(_start(nodes, count, s, buckets), "lists")
    if s.even and buckets == 1:
        return lists
    turn = 1
    while True:
        gathered = settle(_gathered(lists, turn, s, buckets), "gathered")
        proposals = _joined(gathered, lists, s, buckets)
        lists = settle(_merged(lists, proposals, turn, s), "lists")
        fresh = F.aggregate("fresh", F.lit(0).cast("long"), lambda n, f: n + f.cast("long"))
        changed = lists.agg(F.sum(fresh), F.sum(F.size("ids"))).first()  # two numbers
        turn += 1
        if not changed[0] or changed[0] < s.still * changed[1]:
            return lists


def _rows(vectors: pa.Array) -> np.ndarray:
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1)


def unit_column():
    """A function from a vector column to ``x``: vectors scaled to length 1, in half precision."""

    def run(vectors: pa.Array) -> pa.Array:
        if not len(vectors):
            return pa.array([], pa.binary())
        matrix = _rows(vectors)
        return _x(matrix / np.sqrt((matrix * matrix).sum(axis=1, keepdims=True)))

    return F.arrow_udf(run, T.BinaryType())


def lifted_column(kind: str):
    """A function from a vector column and one of scales, no vector longer than its scale, to ``x``.

    Vectors are divided by their scale and a component is added that makes them length 1: among vectors of
    one scale, nearness then follows the inner product with vectors that have 0 there.
    """

    def run(vectors: pa.Array, scales: pa.Array) -> pa.Array:
        if not len(vectors):
            return pa.array([], pa.binary())
        matrix = _rows(vectors) / _array(scales)[:, None]
        rest = np.sqrt(np.maximum(0.0, 1.0 - (matrix * matrix).sum(axis=1, keepdims=True)))
        return _x(np.concatenate([matrix, rest], axis=1), kind)

    return F.arrow_udf(run, T.BinaryType())


def packed_column():
    """A function from a vector column to its components as they are, in double precision, as binary values."""
    return F.arrow_udf(lambda vectors: _x(_rows(vectors), "f8") if len(vectors) else pa.array([], pa.binary()), T.BinaryType())
