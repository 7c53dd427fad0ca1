"""Long walks in few rounds, by path doubling.

Walking on edge by edge takes as many rounds as the longest walk has edges. Here shortcuts are squared round by
round: after k rounds a shortcut stands for walks of exactly 2^k edges, and what has been reached is extended by
them. So rounds number the logarithm of the walk's length. Every walk is a sum of different powers of two in one
way, so walks can be counted as well as compared.

Squaring pays on long, narrow graphs. On wide ones shortcuts may become many more than the edges; they
are counted before they are used, and :func:`far` gives up when they do. Callers walk the first ``ROUNDS``
edges one by one, which short graphs never exceed, and go on that way if shortcuts do not pay.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import col
from ..session import settle

#: Edges walked one by one before shortcuts are tried.
ROUNDS = 5
#: Shortcuts may be so many times as many as the edges, and as many as this on any graph.
GROWTH, AFFORDABLE = 4, 10_000_000


@dataclass(frozen=True)
class Walks:
    """How walks are valued: ``joined`` for one after the other, ``chosen`` among those with the same ends.

    ``better`` tells whether a value improves on a known one; without it all walks count, and none may go
    round in a circle.
    """

    joined: Callable[[Column, Column], Column]
    chosen: Callable[[Column], Column]
    better: Callable[[Column, Column], Column] | None = None


SHORTEST = Walks(lambda a, b: a + b, F.min, lambda new, old: new < old)
LONGEST = Walks(lambda a, b: a + b, F.max, lambda new, old: new > old)
#: A walk is as good as its worst edge, and small values are good.
SUREST = Walks(F.greatest, F.min, lambda new, old: new < old)
COUNTED = Walks(lambda a, b: a * b, F.sum)


def _extended(reached: DataFrame, links: DataFrame, walks: Walks, labels: Sequence[str]) -> DataFrame:
    """What shortcuts lead to from what has been reached."""
    onward = links.select(F.col("src").alias("node"), F.col("dst").alias("_to"), F.col("value").alias("_more"))
    keys = [*[col(c) for c in labels], F.col("_to").alias("node")]
    return reached.join(onward, on="node").groupBy(*keys).agg(walks.chosen(walks.joined(F.col("value"), F.col("_more"))).alias("value"))


def squared(links: DataFrame, walks: Walks) -> DataFrame:
    """Shortcuts over twice as many edges."""
    first = links.select("src", F.col("dst").alias("_mid"), F.col("value").alias("_first"))
    second = links.select(F.col("src").alias("_mid"), "dst", F.col("value").alias("_second"))
    both = first.join(second, on="_mid").groupBy("src", "dst")
    return both.agg(walks.chosen(walks.joined(F.col("_first"), F.col("_second"))).alias("value"))


def far(
    starts: DataFrame, links: DataFrame, walks: Walks, labels: Sequence[str] = (), longest: int | None = None
) -> DataFrame | None:
    """``(*labels, node, value)`` for all nodes that walks from ``starts`` reach, the starts included.

    ``starts`` is ``(*labels, node, value)``, ``links`` ``(src, dst, value)``, each pair once. The rounds end
    when one of them improves nothing: what shortcuts of 2^k edges do not improve, longer walks do not
    either. ``longest`` bounds the edges of a walk where all walks count; one that reaches it goes round in a
    circle, which is an error. Returns None when there are too many shortcuts.
    """
    columns = [*labels, "node", "value"]
    reached = settle(starts.select(*columns), "reached")
    links = settle(links.select("src", "dst", "value"), "shortcuts")
    bound, length = max(GROWTH * links.count(), AFFORDABLE), 1
    while True:
        gained = _extended(reached, links, walks, labels)
        if walks.better:
            known = reached.select(*[col(c) for c in labels], "node", F.col("value").alias("_known"))
            gained = gained.join(known, on=[*labels, "node"], how="left").filter(
                F.col("_known").isNull() | walks.better(F.col("value"), F.col("_known"))
            )
        gained = settle(gained.select(*columns), "gained")
        if gained.isEmpty():
            return reached
        if longest is not None and length > longest:
            raise ValueError("walks go round in a circle")
        whole = reached.unionByName(gained).groupBy(*[col(c) for c in labels], "node").agg(walks.chosen(F.col("value")).alias("value"))
        reached = settle(whole, "reached")
        links = settle(squared(links, walks), "shortcuts")
        length *= 2
        if links.count() > bound:
            return None


def on_long_walks(links: DataFrame, longer: int) -> DataFrame | None:
    """``(node)`` at the end of walks of at least ``longer`` edges; None when there are too many shortcuts.

    With more edges than there are nodes, these are the nodes on a circle or behind one.
    """
    links = settle(links.select("src", "dst", F.lit(1).alias("value")), "shortcuts")
    bound, length = max(GROWTH * links.count(), AFFORDABLE), 1
    while length < longer:
        links = settle(squared(links, SHORTEST), "shortcuts")
        length *= 2
        size = links.count()
        if size == 0:
            break
        if size > bound:
            return None
    return links.select(F.col("dst").alias("node")).distinct()
