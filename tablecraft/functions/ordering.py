"""Running totals and previous rows over groups of any size.

A window ``PARTITION BY key ORDER BY value`` sends each key to one task. One key
may hold a third of a table, and with no key at all it is the whole table. Here
the rows are range-partitioned by (key, value) instead, so that a large key is
spread over many partitions, called runs. Each run is then handled on its own,
and what a run takes over from the runs before it is one small row per run.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import settle
from .columns import all_of, col, quoted

RUN = "_run"
_STEP = "_step"
# monotonically_increasing_id holds the row's place in its partition in the low 33 bits.
_PLACES = 2**33


def ordered_runs(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """``df`` cut into ordered runs and written down, so run numbers are fixed."""
    spread = df.repartitionByRange(*[col(k).asc() for k in keys], *order)
    return settle(spread.withColumn(RUN, F.spark_partition_id()), "runs")


def _carried(summary: DataFrame, rows: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Attach ``values`` of ``summary`` to ``rows`` on keys and run.

    ``summary`` holds only keys that began in an earlier run. In sorted order a
    run can continue one such key at most, so there is at most one row per run
    and broadcasting it is bounded by the number of runs.
    """
    renamed = summary.select(
        F.col(RUN).alias("_c_run"),
        *[col(k).alias(f"_c_{i}") for i, k in enumerate(keys)],
        *[col(v) for v in values],
    )
    on = all_of(
        [rows[RUN] == renamed["_c_run"]]
        + [rows[quoted(k)].eqNullSafe(renamed[f"_c_{i}"]) for i, k in enumerate(keys)]
    )
    return rows.join(F.broadcast(renamed), on, "left").drop("_c_run", *[f"_c_{i}" for i in range(len(keys))])


def _earlier_runs(keys: Sequence[str]) -> Window:
    return Window.partitionBy(*([col(k) for k in keys] or [F.lit(0)])).orderBy(RUN)


def running_totals(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], totals: Mapping[str, Column]
) -> DataFrame:
    """Add, for each entry of ``totals``, the sum over the key up to this row.

    ``keys`` and ``order`` together must tell all rows apart. The weights must
    be non-negative.
    """
    weighted = df
    for name, weight in totals.items():
        weighted = weighted.withColumn(f"_w_{name}", weight)
    runs = ordered_runs(weighted, keys, order)

    per_run = runs.groupBy(*[col(k) for k in keys], RUN).agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.sum(f"`_w_{name}`").alias(f"_t_{name}") for name in totals],
    )
    earlier = _earlier_runs(keys).rowsBetween(Window.unboundedPreceding, -1)
    before = per_run.select(
        *[col(k) for k in keys],
        RUN,
        F.sum("_rows").over(earlier).alias("_earlier"),
        *[F.sum(f"`_t_{name}`").over(earlier).alias(f"_b_{name}") for name in totals],
    ).filter(F.col("_earlier") > 0)

    inside = (
        Window.partitionBy(*[col(k) for k in keys], RUN)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    for name in totals:
        runs = runs.withColumn(f"_l_{name}", F.sum(f"`_w_{name}`").over(inside))
    joined = _carried(before, runs, keys, [f"_b_{name}" for name in totals])
    return joined.select(
        *[col(c) for c in df.columns],
        *[
            (col(f"_l_{name}") + F.coalesce(col(f"_b_{name}"), F.lit(0))).alias(name)
            for name in totals
        ],
    )


def row_numbers(df: DataFrame, keys: Sequence[str], order: Sequence[Column], out: str) -> DataFrame:
    """``row_number()`` per key, starting at 1. ``order`` must break all ties."""
    if keys:
        return running_totals(df, keys, order, {out: F.lit(1).cast("long")})
    # Without keys a row's place in its sorted run is known while it is written,
    # so the rows are shuffled once and need no window.
    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order)
    place = F.monotonically_increasing_id().bitwiseAND(F.lit(_PLACES - 1).cast("long"))
    runs = settle(ordered.withColumn(RUN, F.spark_partition_id()).withColumn(_STEP, place), "runs")
    sizes = runs.groupBy(RUN).agg(F.count(F.lit(1)).alias("_rows"))
    earlier = _earlier_runs([]).rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select(RUN, F.sum("_rows").over(earlier).alias("_before")).filter(F.col("_before").isNotNull())
    # One row per run: bounded by the number of partitions.
    placed = runs.join(F.broadcast(before), on=RUN, how="left")
    number = F.col(_STEP) + 1 + F.coalesce("_before", F.lit(0))
    return placed.select(*[col(c) for c in df.columns], number.alias(out))


def previous_values(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], columns: Mapping[str, str]
) -> DataFrame:
    """Add, per ``new: source`` entry, the source value of the key's previous row."""
    runs = ordered_runs(df, keys, order)
    inside = Window.partitionBy(*[col(k) for k in keys], RUN).orderBy(*order)
    local = runs.withColumn(_STEP, F.row_number().over(inside))
    for new, source in columns.items():
        local = local.withColumn(f"_l_{new}", F.lag(col(source)).over(inside))

    last = local.groupBy(*[col(k) for k in keys], RUN).agg(
        F.max_by(F.struct(*[col(s).alias(f"_p_{n}") for n, s in columns.items()]), F.col(_STEP)).alias("_last")
    )
    before = (
        last.withColumn("_before", F.lag("_last").over(_earlier_runs(keys)))
        .filter(F.col("_before").isNotNull())
        .drop("_last")
    )
    joined = _carried(before, local, keys, ["_before"])
    return joined.select(
        *[col(c) for c in df.columns],
        *[
            F.when(F.col(_STEP) == 1, F.col("_before").getField(f"_p_{n}")).otherwise(col(f"_l_{n}")).alias(n)
            for n in columns
        ],
    )
