"""Mixing sources to target weights along a curriculum. Built-in functions only.

Each source has a target number of words and a schedule of its weight over training time 0 to 1. The
schedule's integral, scaled to the target, is the source's cumulative demand. Documents of a source line
up in hash order, pass after pass; a document takes its stretch of that line, and the time at which the
demand reaches the middle of the stretch is its training position. Documents are range-sorted by it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.ordering import running_totals
from ..session import settle
from .common import WORD, picked, query, table

WEIGHTS = (5, 2, 1)
REPEATS = 3
#: Weight over time, as (time, weight) from time 0 to 1, linear in between; dealt to the sources in order,
#: repeating. Only the shape counts: each is scaled to its source's target.
CURRICULA = (
    ((0.0, 1.5), (1.0, 0.5)),
    ((0.0, 1.0), (1.0, 1.0)),
    ((0.0, 0.5), (0.5, 0.5), (1.0, 2.0)),
)


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """``(source, rank, source_size, target)`` from ``sizes (source, size)``.

    The targets share the words of all sources by weight; none exceeds ``repeats`` times its source, and
    what is above goes to the others by weight. Sorted by cap per weight, the sources at their cap come
    first; the common level of the rest is the largest that any such split gives. The windows run over
    one row per source.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    ordered = totals.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    shares = F.array(*[F.lit(float(w)) for w in weights])
    weighed = ordered.withColumn("weight", F.element_at(shares, (F.col("rank") - 1) % len(weights) + 1))
    earlier = Window.orderBy(F.col("source_size") / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(1))
    left = F.sum("source_size").over(everything) - repeats * F.coalesce(F.sum("source_size").over(earlier), F.lit(0))
    weight_left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(earlier), F.lit(0.0))
    level = F.max("level").over(everything)
    return (
        weighed.withColumn("level", left / weight_left)
        .withColumn("target", F.least(F.col("source_size") * float(repeats), level * F.col("weight")))
        .select("source", "rank", "source_size", "target")
    )


def _segments(curve: Sequence[tuple[float, float]]) -> Column:
    """Pieces of a schedule as structs; ``before`` is the share of its integral that lies before."""
    if [t for t, _ in curve] != sorted({t for t, _ in curve}) or (curve[0][0], curve[-1][0]) != (0.0, 1.0):
        raise ValueError("a curriculum needs ascending times from 0 to 1")
    areas = [(t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(curve, curve[1:])]
    if min(w for _, w in curve) < 0 or not sum(areas):
        raise ValueError("a curriculum needs weights of 0 or more, not all 0")
    pieces, before = [], 0.0
    for ((t0, w0), (t1, w1)), area in zip(zip(curve, curve[1:]), areas):
        values = (before, t0, t1, w0 / sum(areas), (w1 - w0) / (t1 - t0) / sum(areas))
        pieces.append(F.struct(*[F.lit(float(v)).alias(n) for v, n in zip(values, ("before", "t0", "t1", "w0", "slope"))]))
        before += area / sum(areas)
    return F.array(*pieces)


def _time_of(share: Column, pieces: Column) -> Column:
    """When a schedule's integral reaches ``share``: its inverse, linear or quadratic per piece."""
    piece = F.element_at(F.filter(pieces, lambda p: (p["before"] <= share) | (p["t0"] == 0)), -1)
    rest = F.greatest(share - piece["before"], F.lit(0.0))
    root = F.sqrt(F.greatest(piece["w0"] * piece["w0"] + 2 * piece["slope"] * rest, F.lit(0.0)))
    wait = F.when(rest > 0, F.try_divide(2 * rest, piece["w0"] + root)).otherwise(F.lit(0.0))
    return F.least(piece["t0"] + F.coalesce(wait, F.lit(0.0)), piece["t1"])


def measured(docs: DataFrame, text_column: str = "text") -> Column:
    """Number of words of a text; null counts as empty."""
    return F.coalesce(F.regexp_count(F.col(f"`{text_column}`"), F.lit(WORD)), F.lit(0)).cast("long")


def mix_plan(
    docs: DataFrame,
    id_column: str = "doc_id",
    source_column: str = "source",
    text_column: str = "text",
    weights: Sequence[float] = WEIGHTS,
    repeats: int = REPEATS,
    curricula: Sequence[Sequence[tuple[float, float]]] = CURRICULA,
) -> DataFrame:
    """``(doc_id, size, source, source_size, target, taken, passes)``: one row per row of ``docs``.

    ``passes`` is an array of (pass, words, position), at most ``repeats`` long; ``taken`` is the sum of
    its words. Only the document in which a source's target ends is taken in part, so the words taken of
    a source are its rounded target. Rows that agree in id, source and size count as one stretch and get
    equal parts of it. A null source is a source, sorted last; null and empty texts have size 0, take
    nothing and have no pass. The order is that of the ids' md5, so reruns agree. An empty table gives an
    empty result; other columns are ignored.
    """
    rows = picked(docs, doc_id=id_column, source=source_column, text=text_column)
    sizes = settle(rows.select("doc_id", "source", measured(rows).alias("size")), "sizes")
    targets = source_targets(sizes, weights, repeats)
    units = sizes.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("copies"))
    order = [F.md5(F.col("doc_id").cast("string")).asc_nulls_last(), F.col("doc_id").asc_nulls_last(), F.col("size").asc()]
    lined = running_totals(units, ["source"], order, {"upto": F.col("size") * F.col("copies")})

    # One small row per source; Spark broadcasts it where its measured size allows.
    joined = lined.alias("l").join(targets.alias("t"), F.col("l.source").eqNullSafe(F.col("t.source"))).select(
        "l.*", "t.rank", "t.source_size", "t.target"
    )
    long = F.col("size") * F.col("copies")
    goal = F.round("target").cast("long")
    curves = F.array(*[_segments(c) for c in curricula])
    curve = F.element_at(curves, ((F.col("rank") - 1) % len(curricula) + 1).cast("int"))

    def one_pass(number: Column) -> Column:
        start = number * F.col("source_size") + F.col("upto") - long
        words = F.greatest(F.least(long, goal - start), F.lit(0))
        share = F.least(F.try_divide(start + words / 2, F.col("target")), F.lit(1.0))
        return F.struct(
            (number + 1).alias("pass"),
            F.floor(words / F.col("copies")).cast("long").alias("words"),
            _time_of(share, curve).alias("position"),
        )

    passes = F.filter(F.transform(F.sequence(F.lit(0), F.lit(repeats - 1)), one_pass), lambda p: p["words"] > 0)
    taken = F.aggregate("passes", F.lit(0).cast("long"), lambda a, p: a + p["words"])
    plan = joined.withColumn("passes", passes).withColumn("taken", taken)
    return sizes.alias("s").join(
        plan.alias("p"),
        F.col("s.doc_id").eqNullSafe(F.col("p.doc_id"))
        & F.col("s.source").eqNullSafe(F.col("p.source"))
        & (F.col("s.size") == F.col("p.size")),
    ).select("s.doc_id", "s.size", "s.source", "source_size", "target", "taken", "passes")


def mix_documents(docs: DataFrame, id_column: str = "doc_id", source_column: str = "source", text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` in training order, each as often as the mix takes it, with the same columns.

    A document taken in part stays whole if at least half of it is taken, and is left out of that pass
    otherwise. Documents without words are not part of a mix and are left out.
    """
    names = docs.columns
    plan = mix_plan(docs, id_column, source_column, text_column)
    passes = F.transform(F.filter("passes", lambda p: 2 * p["words"] >= F.col("size")), lambda p: p["position"])
    kept = plan.select(
        F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("size").alias("_size"), passes.alias("_at")
    ).filter(F.size("_at") > 0).distinct()
    marked = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), measured(docs, text_column).alias("size"))
    joined = marked.join(
        kept,
        F.col(f"row.`{id_column}`").eqNullSafe(F.col("_id"))
        & F.col(f"row.`{source_column}`").eqNullSafe(F.col("_source"))
        & (F.col("size") == F.col("_size")),
    )
    each = joined.select("row", F.explode("_at").alias("_position"))
    ordered = each.repartitionByRange("_position", f"row.{id_column}").sortWithinPartitions("_position", f"row.{id_column}")
    return ordered.select("row.*")


@query(
    "op3_mixing",
    r"""
WITH sizes AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents
),
totals AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sizes GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS rank FROM totals),
weighed AS (SELECT *, CAST([5, 2, 1][(rank - 1) % 3 + 1] AS DOUBLE) AS weight FROM ranked),
levels AS (
  SELECT *, CAST(sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER e, 0) AS DOUBLE)
            / (sum(weight) OVER () - coalesce(sum(weight) OVER e, 0)) AS level
  FROM weighed WINDOW e AS (ORDER BY source_size / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
),
targets AS (SELECT source, rank, source_size, least(source_size * 3.0::DOUBLE, max(level) OVER () * weight) AS target FROM levels),
lined AS (
  SELECT s.*, t.rank, t.source_size, t.target, CAST(round(t.target) AS BIGINT) AS goal,
         CAST(sum(size) OVER (PARTITION BY s.source ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id, size
                              ROWS UNBOUNDED PRECEDING) - size AS BIGINT) AS before
  FROM sizes s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
),
parts AS (
  SELECT *, greatest(least(size, goal - before), 0) AS one,
         greatest(least(size, goal - before - source_size), 0) AS two,
         greatest(least(size, goal - before - 2 * source_size), 0) AS three
  FROM lined
),
shares AS (SELECT *, least((before + one / 2) / target, 1.0) AS share FROM parts)
SELECT doc_id, size, source_size, target, CAST(one + two + three AS BIGINT) AS taken,
       CASE WHEN one > 0 THEN round(CASE (rank - 1) % 3
         WHEN 0 THEN 2 * share / (1.5 + sqrt(greatest(2.25 - 2 * share, 0)))
         WHEN 1 THEN share
         ELSE CASE WHEN share < 0.25 / 0.875 THEN share * 0.875 / 0.5
              ELSE 0.5 + 2 * (share - 0.25 / 0.875) / (0.5 / 0.875 + sqrt((0.5 / 0.875) ^ 2 + 2 * (3 / 0.875) * (share - 0.25 / 0.875))) END
       END, 6) END AS position
FROM shares
""",
)
def op3_mixing(spark: SparkSession, folder: str) -> DataFrame:
    plan = mix_plan(table(spark, folder, "documents"))
    first = F.round(F.try_element_at("passes", F.lit(1))["position"], 6).alias("position")
    return plan.select("doc_id", "size", "source_size", "target", "taken", first).orderBy("position", "doc_id")
