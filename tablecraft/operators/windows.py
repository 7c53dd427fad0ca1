"""Ranks, the best rows per group, row ids, and changes between rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import all_of, col, is_missing, require
from ..functions.ordering import previous_values, row_numbers, running_totals

# How tied values are ranked.
RANK_METHODS = ("dense", "min", "max", "first", "average")

ROW_ID = "_row_id"


# The default of spark.sql.optimizer.windowGroupLimitThreshold.
FEW = 1000


def _sorted(df: DataFrame, column: str, ascending: bool) -> list[Column]:
    """Sort keys that put missing values last in either direction."""
    value = col(column).asc_nulls_last() if ascending else col(column).desc_nulls_last()
    return [is_missing(df, column).asc(), value]


def _ties(names: Sequence[str]) -> list[Column]:
    return [col(c).asc_nulls_last() for c in names]


def top_movers(
    df: DataFrame,
    limit: int = 10,
    change: str = "change_24h_pct",
    price: str = "price_usd",
    cap: str = "market_cap_usd",
    keep: Sequence[str] = ("symbol", "name", "sector", "market_tier"),
    change_class: str = "change_class",
    tie_breakers: Sequence[str] = (),
    unit: float = 1e9,
) -> DataFrame:
    """The ``limit`` rows with the largest absolute change, with their rank.

    The rows are cut to ``limit`` before they are ranked. Ranks among the first
    rows do not depend on the rest, so the window sees ``limit`` rows only.
    """
    size = F.abs(col(change)).desc_nulls_last()
    first = df.orderBy(size, *_ties(tie_breakers)).limit(limit)
    return first.select(
        F.rank().over(Window.partitionBy(F.lit(0)).orderBy(size)).cast("bigint").alias("mover_rank"),
        *[col(c) for c in keep],
        F.round(col(price), 4).alias("price_usd"),
        F.round(col(change), 2).alias("change_24h_pct"),
        col(change_class),
        F.round(col(cap) / unit, 1).alias("market_cap_bn"),
    )


def _first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, out: str) -> DataFrame:
    """The first ``n`` rows per key, numbered in ``out``.

    The filter on ``row_number`` lets every task drop all but ``n`` rows per key
    before the shuffle, so a key that holds most rows sends only a few of them.
    Spark does so up to ``FEW`` rows; for more, rows are numbered in ordered
    runs, over which a large key is spread.
    """
    if n > FEW:
        return row_numbers(df, keys, order, out).filter(F.col(out) <= n)
    window = Window.partitionBy(*[col(k) for k in keys]).orderBy(*order)
    return df.withColumn(out, F.row_number().over(window)).filter(F.col(out) <= n)


def deduplicate_by_key(
    df: DataFrame, key: str | Sequence[str] = "id", newest_by: str = "updated_at", tie_breakers: Sequence[str] = ()
) -> DataFrame:
    """The newest row per key; rows without a key form one group."""
    keys = [key] if isinstance(key, str) else list(key)
    require(df, [*keys, newest_by], "deduplicate_by_key")
    order = [col(newest_by).desc_nulls_last(), *_ties(tie_breakers)]
    return _first_per_key(df, keys, order, 1, "_rn").drop("_rn")


def top_n_by_group(
    df: DataFrame, group: str = "category", sort: str = "revenue", n: int = 5, tie_breakers: Sequence[str] = ()
) -> DataFrame:
    """The ``n`` largest rows per group; their number stays in ``_rn``."""
    require(df, [group, sort], "top_n_by_group")
    return _first_per_key(df, [group], [col(sort).desc_nulls_last(), *_ties(tie_breakers)], n, "_rn")


def top_n(
    df: DataFrame,
    n: int = 10,
    sort_by: str = "",
    ascending: bool = False,
    partition_by: str | None = None,
    tie_breakers: Sequence[str] = (),
) -> DataFrame:
    """The first ``n`` rows by a column, over all or per group; missing values last.

    Without such a column ``tie_breakers`` give the order; rows have none of their
    own, so one of the two is needed. Rows without a group are left out.
    """
    if not sort_by or sort_by not in df.columns:
        if not tie_breakers:
            raise ValueError("top_n: 'sort_by' or 'tie_breakers' must say which rows are first")
        return df.orderBy(*_ties(tie_breakers)).limit(n)
    order = [*_sorted(df, sort_by, ascending), *_ties(tie_breakers)]
    if partition_by and partition_by in df.columns:
        grouped = df.filter(~is_missing(df, partition_by))
        return _first_per_key(grouped, [partition_by], order, n, "_rn").drop("_rn")
    return df.orderBy(*order).limit(n)


def add_rank(
    df: DataFrame,
    column: str,
    rank_column: str = "rank",
    ascending: bool = False,
    method: str = "dense",
    group_by: str | None = None,
    tie_breakers: Sequence[str] = (),
) -> DataFrame:
    """Rank all rows, or the rows of each group, by a column.

    A row without a value, or without a group, gets no rank; an absent column
    leaves the frame as it is. ``first`` numbers tied rows by ``tie_breakers``,
    which must tell them apart; the other methods need none.

    No group is ranked in one task. Rows are counted per distinct value, the
    distinct values get running totals in sorted order, and the ranks join back.
    """
    if method not in RANK_METHODS:
        raise ValueError(f"add_rank: unknown method '{method}'")
    if not column or column not in df.columns:
        return df
    keys = [group_by] if group_by and group_by in df.columns else []
    valued = ~is_missing(df, column)
    for key in keys:
        valued = valued & ~is_missing(df, key)
    direction = col(column).asc() if ascending else col(column).desc()

    if method == "first":
        if not tie_breakers:
            raise ValueError("add_rank: method 'first' needs tie_breakers, as rows have no order of their own")
        # Only what gives the order is put in order and written down; the numbers join back to the rows.
        named = list(dict.fromkeys([*keys, column, *tie_breakers]))
        narrow = df.filter(valued).select(*[col(c) for c in named])
        numbered = row_numbers(narrow, keys, [direction, *_ties(tie_breakers)], "_number")
        # Rows that the tie breakers do not tell apart share the first of their numbers.
        numbers = numbered.groupBy(*[col(c).alias(f"_o{i}") for i, c in enumerate(named)]).agg(F.min("_number").alias(rank_column))
        on = all_of([valued, *[col(c).eqNullSafe(F.col(f"_o{i}")) for i, c in enumerate(named)]])
        return df.drop(rank_column).join(numbers, on, "left").drop(*[f"_o{i}" for i in range(len(named))])

    cells = df.filter(valued).groupBy(*[col(k) for k in keys], col(column)).agg(F.count(F.lit(1)).alias("_n"))
    placed = running_totals(cells, keys, [direction], {"_upto": F.col("_n"), "_distinct": F.lit(1).cast("long")})
    lowest = F.col("_upto") - F.col("_n") + 1
    rank = {
        "dense": F.col("_distinct"),
        "min": lowest,
        "max": F.col("_upto"),
        "average": F.expr("(_upto - _n + 1 + _upto) div 2"),
    }[method]
    ranks = placed.select(
        *[col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
        col(column).alias("_v"),
        rank.cast("bigint").alias(rank_column),
    )
    on = [col(column) == F.col("_v")] + [col(k) == F.col(f"_k{i}") for i, k in enumerate(keys)]
    base = df.drop(rank_column)
    return base.join(ranks, on, "left").drop("_v", *[f"_k{i}" for i in range(len(keys))])


def probe_row_id(df: DataFrame, order_by: Sequence[str], sample: int | None = None) -> DataFrame:
    """Number rows from 0 in a stated order: all rows, or only the first ``sample``.

    ``order_by`` must tell all rows apart when all rows are numbered.
    """
    order = _ties(order_by)
    if sample is None:
        return row_numbers(df, [], order, ROW_ID).withColumn(ROW_ID, F.col(ROW_ID) - 1)
    few = df.orderBy(*order).limit(sample)
    number = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order))
    return few.withColumn(ROW_ID, (number - 1).cast("bigint"))


def last_state(df: DataFrame, key: str, order_by: Sequence[str], state: Sequence[str]) -> DataFrame:
    """Rows whose state differs from the previous row of their key, and first rows.

    ``order_by`` must tell the rows of a key apart. Only key, order and state are put in order and written
    down; the other columns are met again by key and order, for the rows that changed.
    """
    require(df, [key, *order_by, *state], "last_state")
    identity = list(dict.fromkeys([key, *order_by]))
    narrow = df.select(*[col(c) for c in dict.fromkeys([*identity, *state])])
    packed = F.struct(*[col(c) for c in state])
    marked = narrow.select(*[col(c) for c in identity], packed.alias("_state"), F.lit(True).alias("_any"))
    compared = previous_values(marked, [key], _ties(order_by), {"_before": "_state", "_had": "_any"})
    changed = compared.filter(F.col("_had").isNull() | ~F.col("_before").eqNullSafe(F.col("_state")))
    if set(df.columns) <= set(narrow.columns):
        fields = {c: F.col("_state").getField(c) for c in state}
        return changed.select(*[(fields[c].alias(c) if c in fields else col(c)) for c in df.columns])
    places = changed.select(*[col(c).alias(f"_o{i}") for i, c in enumerate(identity)])
    return df.join(places, all_of(col(c).eqNullSafe(F.col(f"_o{i}")) for i, c in enumerate(identity)), "left_semi")
