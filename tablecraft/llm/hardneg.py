"""Hard negatives for embeddings, searched in R-trees packed by Sort-Tile-Recursive.

Rows are range-sorted by label and the first coordinate into shards of bounded size; within a shard they are
sorted and tiled coordinate by coordinate, so that each leaf holds neighbours, and every group of leaves,
up to the root, has the box that bounds its rows. For an anchor, a box bounds each coordinate's product
from both sides, and the sums bound the inner product with any row inside. A queue hands out the box of
the largest upper bound first. A box is dropped where its bounds lie outside all score windows, or where its
upper bound is strictly below the last result of every window it meets: an equal score may still win by
its id.

The anchors are the stated query set. They go in blocks to the shards: for positives only to the shards
that hold their label, for negatives to all. A task holds one shard and one block, and only the best rows
per anchor leave it.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import settle
from .common import picked, query, table

POSITIVES, NEGATIVES = 5, 10
#: A negative's score in hundredths of its positive's.
LOW, HIGH = 30, 90
SCALE = 256
#: Rows of a shard and anchors of a block, about; rows of a leaf and boxes of a node at most.
SHARD, BLOCK, LEAF, FAN = 16_384, 2_048, 256, 8
#: Squared norm up to which inner products of two rows fit 64 bits.
LARGEST = 2.0**62
_VECTOR = "array<long>"


class Tree:
    """Rows packed by Sort-Tile-Recursive; boxes of leaves, then of nodes, up to one root.

    Bounds are sums of products of whole numbers. They are exact below 2^53; above, they are widened by their
    rounding error, and scores are taken in 64-bit integers.
    """

    def __init__(self, labels: np.ndarray, ids: np.ndarray, uids: np.ndarray, x: np.ndarray, leaf: int = LEAF, fan: int = FAN) -> None:
        order = np.concatenate(list(self._tiles(labels, x, leaf))) if len(x) else np.empty(0, int)
        self.labels, self.ids, self.uids, self.x = labels[order], ids[order], uids[order], x[order]
        norms = (self.x.astype(float) ** 2).sum(axis=1)
        self.largest = float(norms.max(initial=0))
        self.floats = self.x.astype(float)
        starts = np.arange(0, max(len(x), 1), leaf)
        self.leaf = leaf
        low = [np.minimum.reduceat(self.floats, starts, axis=0)] if len(x) else [np.zeros((1, x.shape[1]))]
        high = [np.maximum.reduceat(self.floats, starts, axis=0)] if len(x) else [np.zeros((1, x.shape[1]))]
        while len(low[-1]) > 1:
            starts = np.arange(0, len(low[-1]), fan)
            low.append(np.minimum.reduceat(low[-1], starts, axis=0))
            high.append(np.maximum.reduceat(high[-1], starts, axis=0))
        self.low, self.high, self.fan = low, high, fan

    @staticmethod
    def _tiles(labels: np.ndarray, x: np.ndarray, leaf: int) -> Iterator[np.ndarray]:
        """Rows of each leaf in order: sorted by one coordinate, cut in slices, each sorted by the next."""
        spread = x.astype(float).std(axis=0) if x.shape[1] else np.empty(0)
        keys = [labels, *(x[:, c] for c in np.argsort(-spread, kind="stable"))]

        def cut(rows: np.ndarray, depth: int) -> Iterator[np.ndarray]:
            leaves = math.ceil(len(rows) / leaf)
            rows = rows[np.argsort(keys[depth][rows], kind="stable")]
            left = min(len(keys) - depth, max(1, math.ceil(math.log2(max(leaves, 1)))))
            if leaves <= 1 or left == 1:
                yield rows
                return
            size = math.ceil(leaves / math.ceil(leaves ** (1 / left))) * leaf
            for at in range(0, len(rows), size):
                yield from cut(rows[at : at + size], depth + 1)

        yield from cut(np.arange(len(x)), 0)

    def bounds(self, anchor: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Lower and upper bound of the inner product, for the boxes of each level."""
        up, down = np.maximum(anchor, 0), np.minimum(anchor, 0)
        # Zero within 2^53, where sums of whole numbers are exact.
        reach = math.sqrt(self.largest) * np.abs(anchor).sum()
        slack = 0.0 if reach < 2.0**52 else reach * 2.0**-40
        return [(up @ lo.T + down @ hi.T - slack, up @ hi.T + down @ lo.T + slack) for lo, hi in zip(self.low, self.high)]

    def scores(self, anchor: np.ndarray, at: int) -> np.ndarray:
        """Exact inner products of the anchor with the rows of a leaf."""
        rows = slice(at * self.leaf, (at + 1) * self.leaf)
        if self.largest * float((anchor.astype(float) ** 2).sum()) < 2.0**104:
            return (self.floats[rows] @ anchor.astype(float)).astype(np.int64)
        return self.x[rows] @ anchor

    def best(self, anchor: np.ndarray, windows: list[tuple[int, int]], size: int, wanted) -> list[list[tuple[int, int]]]:
        """Per window the ``size`` rows of the largest score in it, as (score, place); ties by id.

        ``windows`` are (lowest, highest) scores, both included. ``wanted`` tells of a slice of rows
        which of them count.
        """
        found: list[list[tuple[int, int, int]]] = [[] for _ in windows]
        low, high = (np.array(w, float) for w in zip(*windows))
        kth, least = np.full(len(windows), -np.inf), [w[0] for w in windows]
        bounds = self.bounds(anchor.astype(float))
        top = len(bounds) - 1
        queue = [(-bounds[top][1][0], top, 0)] if len(self.x) else []
        while queue:
            bound, level, box = heapq.heappop(queue)
            lower = bounds[level][0][box]
            meets = (lower <= high) & (-bound >= low) & (-bound >= kth)
            if not meets.any():
                if -bound < kth.min() or -bound < low.min():
                    break  # all that is left lies lower still
                continue
            if level:
                children = range(box * self.fan, min((box + 1) * self.fan, len(self.low[level - 1])))
                for child in children:
                    heapq.heappush(queue, (-bounds[level - 1][1][child], level - 1, child))
                continue
            rows = slice(box * self.leaf, (box + 1) * self.leaf)
            score, usable = self.scores(anchor, box), wanted(rows)
            for w in np.flatnonzero(meets):
                near = np.flatnonzero(usable & (score >= least[w]) & (score <= windows[w][1]))
                if not len(near):
                    continue
                ids, uids = self.ids[rows], self.uids[rows]
                chosen = near[np.lexsort((uids[near], ids[near], -score[near]))[:size]]
                found[w] += [(-int(score[i]), int(ids[i]), int(uids[i])) for i in chosen]
                found[w] = sorted(found[w])[:size]
                if len(found[w]) == size:
                    kth[w] = least[w] = -found[w][-1][0]
        return found


def prepared(vectors: DataFrame, id_column: str, vector_column: str, label_column: str, scale: float) -> DataFrame:
    """``(uid, id, label, x)``: the rows that take part, with components as whole numbers.

    ``uid`` tells rows apart that repeat. It is written down, so that it stays the same.
    """
    rows = picked(vectors, id=id_column, vector=vector_column, label=label_column)
    value = F.transform("vector", lambda v: F.floor(v.cast("double") * float(scale)))
    finite = F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    norm = F.aggregate("vector", F.lit(0.0), lambda s, v: s + F.pow(F.abs(v.cast("double") * float(scale)) + 1, F.lit(2.0)))
    taking_part = F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & finite & (norm <= LARGEST)
    return settle(
        rows.filter(F.coalesce(taking_part, F.lit(False))).select(
            F.monotonically_increasing_id().alias("uid"), "id", F.col("label").cast("long").alias("label"), value.cast(_VECTOR).alias("x")
        ),
        "vectors",
    )


def _matrix(column: pa.ChunkedArray, rows: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1) if rows else np.zeros((0, 0), np.int64)


def _search(rows: pa.Table, anchors: pa.Table, size: int, same: bool) -> Iterator[tuple]:
    """(anchor's uid, number of the window, score, id, uid) of one shard and one block of anchors."""
    if not rows.num_rows or not anchors.num_rows:
        return
    array = lambda t, c: t.column(c).to_numpy()
    tree = Tree(*(array(rows, c) for c in ("label", "id", "uid")), _matrix(rows.column("x"), rows.num_rows))
    x = _matrix(anchors.column("x"), anchors.num_rows)
    windows = anchors.column("windows").to_pylist()
    for a, (uid, label) in enumerate(zip(array(anchors, "uid"), array(anchors, "label"))):
        if same:
            def wanted(part: slice, uid=uid, label=label) -> np.ndarray:
                return (tree.labels[part] == label) & (tree.uids[part] != uid)
        else:
            def wanted(part: slice, label=label) -> np.ndarray:
                return tree.labels[part] != label
        for number, found in enumerate(tree.best(x[a], [(w["low"], w["high"]) for w in windows[a]], size, wanted)):
            for score, other, other_uid in found:
                yield int(uid), number, -score, other, other_uid


def _met(rows: DataFrame, anchors: DataFrame, blocks: int, size: int, same: bool) -> DataFrame:
    """Search each block of anchors in each shard that it is sent to; per anchor and window the best remain.

    A task gets one shard and one block. Of each shard at most ``size`` rows per window go on.
    """
    columns = ("anchor", "window", "score", "id", "uid")

    def task(left: pa.Table, right: pa.Table) -> pa.Table:
        found = list(_search(left, right, size, same))
        return pa.table([pa.array(c, pa.int64()) for c in (zip(*found) if found else [[]] * 5)], names=columns)

    dealt = rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    met = dealt.groupBy("shard", "block").cogroup(anchors.groupBy("shard", "block")).applyInArrow(
        task, ", ".join(f"{c} long" for c in columns)
    )
    place = F.row_number().over(Window.partitionBy("anchor", "window").orderBy(F.desc("score"), "id", "uid"))
    return met.withColumn("rank", place).filter(F.col("rank") <= size)


def hard_negatives(
    vectors: DataFrame,
    is_anchor: Column,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    label_column: str = "label",
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    low: int = LOW,
    high: int = HIGH,
    scale: float = SCALE,
    shard: int = SHARD,
    block: int = BLOCK,
) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``.

    ``is_anchor`` is a condition on ``id``. Components become ``floor(scale * x)``, scores are whole inner
    products. An anchor's positives are the ``positives`` best other rows of its label. Per positive come
    the ``negatives`` best rows of other labels whose score lies within ``low`` and ``high`` hundredths of
    the positive's; ``rank`` counts from 1. Ties go to the smaller id.

    Rows with a null id or label, a null vector, or a null or non-finite component take no part, nor does a row
    whose squared norm after scaling exceeds 2^62, as its scores might not fit a long. Vectors of different
    lengths have no inner product and do not meet. A repeated row is another row: each copy is found, and each copy of
    an anchor is an anchor. An anchor without positives, or a positive of a negative score, gives no rows. An
    empty table gives an empty result; other columns are ignored.
    """
    rows = prepared(vectors, id_column, vector_column, label_column, scale)
    parts = max(1, math.ceil(rows.count() / shard))
    # Equal rows are told apart by their uid, so a label or vector of any share is spread over shards.
    order = [F.size("x"), F.col("label"), F.try_element_at("x", F.lit(1)), F.col("uid")]
    ranged = rows.repartitionByRange(parts, *order).select("*", F.spark_partition_id().alias("part"), F.size("x").alias("length"))
    # A shard holds vectors of one length.
    placed = settle(ranged.select("uid", "id", "label", "x", F.struct("part", "length").alias("shard")), "shards")

    chosen = placed.filter(is_anchor).select("uid", "id", "label", "x", F.col("shard.length").alias("length"))
    blocks = max(1, math.ceil(chosen.count() / block))
    anchors = settle(chosen.withColumn("block", F.pmod(F.xxhash64("uid"), F.lit(blocks)).cast("int")), "anchors")

    everything = F.array(F.struct(F.lit(-(2**63)).cast("long").alias("low"), F.lit(2**63 - 1).cast("long").alias("high")))
    there = placed.select(F.struct("shard.part", "shard.length").alias("shard"), F.col("label").alias("_label")).distinct()
    sent = anchors.withColumn("windows", everything).join(
        there, (F.col("label") == F.col("_label")) & (F.col("length") == F.col("shard.length"))
    )
    found = settle(_met(placed, sent.drop("_label", "length"), blocks, positives, same=True).withColumnRenamed("anchor", "_anchor"), "positives")

    # The whole numbers between the shares of the positive's score; none if the score is negative.
    least = F.ceil(F.col("score") * F.lit(low).cast("decimal(3,0)") / 100).cast("long")
    most = F.floor(F.col("score") * F.lit(high).cast("decimal(3,0)") / 100).cast("long")
    goals = found.groupBy("_anchor").agg(
        F.sort_array(F.collect_list(F.struct("rank", least.alias("low"), most.alias("high"), F.col("id").alias("positive"), "score"))).alias("windows")
    )
    aimed = anchors.join(goals, F.col("uid") == F.col("_anchor"))
    # The stated query set against all shards, in blocks: a row per anchor and shard.
    last = placed.agg(F.coalesce(F.max("shard.part"), F.lit(0))).first()[0]
    everywhere = aimed.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(last)))).withColumn("shard", F.struct("part", "length"))
    negative = _met(placed, everywhere.select("uid", "label", "x", "block", "windows", "shard"), blocks, negatives, same=False)
    ends = aimed.select("uid", F.col("id").alias("anchor_id"), "windows")
    goal = F.element_at("windows", (F.col("n.window") + 1).cast("int"))
    return negative.alias("n").join(ends.alias("e"), F.col("n.anchor") == F.col("e.uid")).select(
        "anchor_id",
        goal["positive"].alias("positive_id"),
        F.col("n.rank").cast("int").alias("rank"),
        F.col("n.id").alias("negative_id"),
        goal["score"].alias("positive_score"),
        F.col("n.score").alias("negative_score"),
    )


@query("op12_hardneg")
def op12_hardneg(spark: SparkSession, folder: str) -> DataFrame:
    """Anchors are the ids that 100 divides; labels move on by one where 7 divides the id."""
    vectors = table(spark, folder, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(vectors.withColumn("label", label), F.col("id") % 100 == 0)
