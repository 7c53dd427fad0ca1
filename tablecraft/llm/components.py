"""Connected components of a link table, by alternating star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import settle


def _signature(links: DataFrame) -> tuple:
    """One row: tells two link tables apart, and reaches the driver as three numbers."""
    mixed = F.xxhash64("a", "b")
    return tuple(
        links.agg(F.count(F.lit(1)), F.bit_xor(mixed), F.sum(F.shiftright(mixed, 20))).first()
    )


def _nearest_root(links: DataFrame, larger_only: bool) -> DataFrame:
    """Link each neighbour of a node to the smallest node among that node and its neighbours.

    The smallest neighbour is a ``min`` that combines before the shuffle. A node with very many links is
    one side of a plain join, which Spark splits when it is skewed; the other side has one row for it.
    """
    lowest = links.groupBy(F.col("a").alias("_at")).agg(F.min("b").alias("_low"))
    reached = links.join(lowest, F.col("a") == F.col("_at")).withColumn("_low", F.least("a", "_low"))
    if larger_only:
        pairs = reached.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("_low").alias("b"))
    else:
        own = lowest.select(F.col("_at").alias("a"), F.col("_low").alias("b"))
        pairs = reached.select(F.col("b").alias("a"), F.col("_low").alias("b")).union(own)
    return pairs.filter(F.col("a") != F.col("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of ``links (a, b)``: the smallest node it reaches.

    Large-star and small-star steps in turn; each round is written to the shared folder, so that the plan
    stays short and a lost executor costs a re-read. It ends when a round changes nothing, which takes
    about the logarithm of the longest path. Nodes with no link to another node are left out, as are
    null nodes. Only a signature of the links reaches the driver.
    """
    links = links.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
    pairs = links.filter(F.col("a") != F.col("b"))
    pairs = settle(pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = _signature(pairs)
    while before[0]:
        both = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _nearest_root(both, larger_only=True)
        # Every link now points from the larger to the smaller node.
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        pairs = settle(_nearest_root(down, larger_only=False), "links")
        after = _signature(pairs)
        if after == before:
            break
        before = after
    roots = pairs.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
