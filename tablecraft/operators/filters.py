"""Row filters, sorts, limits and set operations."""

from __future__ import annotations

import datetime
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import all_of, any_of, col, dtype_of, is_missing, require, spread


def drop_nulls(df: DataFrame, columns: Sequence[str] = (), how: str = "any") -> DataFrame:
    """Drop rows with a missing value in ``any`` or in ``all`` of the columns."""
    if how not in ("any", "all"):
        raise ValueError("drop_nulls: how must be 'any' or 'all'")
    names = list(columns) or df.columns
    require(df, names, "drop_nulls")
    missing = [is_missing(df, c) for c in names]
    return df.filter(~(any_of(missing) if how == "any" else all_of(missing)))


def filter_nulls(df: DataFrame, key: str) -> DataFrame:
    """Keep rows whose key is not NULL."""
    return df.filter(col(key).isNotNull())


def filter_by_date(df: DataFrame, column: str, start: str) -> DataFrame:
    """Keep rows on or after an ISO date, oldest first.

    Text is compared as text, which orders ISO dates rightly; a date or
    timestamp column is compared with a literal of its own type, so the filter
    reaches the scan.
    """
    require(df, [column], "filter_by_date")
    dtype = dtype_of(df, column)
    bound = F.lit(start) if isinstance(dtype, T.StringType) else F.lit(start).cast(dtype)
    return df.filter(col(column) >= bound).orderBy(col(column).asc_nulls_last(), spread(df))


def as_date(df: DataFrame, column: str) -> Column:
    """The column as a date; text that is no date is NULL."""
    if isinstance(dtype_of(df, column), T.DateType):
        return col(column)
    return col(column).try_cast("date")


def filter_recent(
    df: DataFrame, column: str = "order_date", days: int = 90, as_of: datetime.date | None = None
) -> DataFrame:
    """Keep rows of the last ``days`` days before ``as_of``; what is no date drops out."""
    require(df, [column], "filter_recent")
    today = F.lit(as_of) if as_of else F.current_date()
    dtype = dtype_of(df, column)
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        # Midnight of the first day: comparing the column itself can be pushed down.
        return df.filter(col(column) >= F.date_sub(today, days).cast(dtype))
    return df.filter(as_date(df, column) >= F.date_sub(today, days))


def filter_where(df: DataFrame, where: str) -> DataFrame:
    """Keep rows that satisfy a SQL condition; a condition that does not resolve is an error."""
    try:
        return df.filter(F.expr(where))
    except Exception as error:
        raise ValueError(f"invalid WHERE clause: {error}") from error


def filter_code_length(df: DataFrame, code: str, value: str, length: int = 3) -> DataFrame:
    """Keep rows with a code of the given length and a value, largest value first."""
    require(df, [code, value], "filter_code_length")
    kept = df.filter(col(value).isNotNull() & (F.length(col(code)) == length))
    return kept.orderBy(col(value).desc_nulls_last(), spread(kept))


def not_completed(nodes: DataFrame, completed: DataFrame, key: str) -> DataFrame:
    """Rows of ``nodes`` whose key is not among the completed ones."""
    return nodes.join(completed.select(col(key)), on=[key], how="left_anti")


def sort_desc(df: DataFrame, column: str) -> DataFrame:
    """Largest first, missing values last."""
    return df.orderBy(col(column).desc_nulls_last(), spread(df))


def sql_top_n(df: DataFrame, column: str, n: int = 100, tie_breakers: Sequence[str] = ()) -> DataFrame:
    """The ``n`` rows with the largest values; no full sort is needed."""
    return df.orderBy(col(column).desc_nulls_last(), *[col(c).asc_nulls_last() for c in tie_breakers]).limit(n)


def sample_first_n(df: DataFrame, order_by: Sequence[str], n: int = 50) -> DataFrame:
    """The first ``n`` rows in a stated order."""
    return df.orderBy(*[col(c).asc_nulls_last() for c in order_by]).limit(n)


def union_all(*frames: DataFrame) -> DataFrame:
    """All rows of all frames, columns matched by name."""
    first, *others = frames
    for frame in others:
        first = first.unionByName(frame)
    return first


def set_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Distinct rows of ``left`` that are not in ``right``."""
    return left.subtract(right.select(*[col(c) for c in left.columns]))


def registered_union(tables: dict[str, DataFrame], label: str = "node_id") -> DataFrame:
    """Rows of several named tables read as one, each labelled with its name."""
    return union_all(*[df.withColumn(label, F.lit(name)) for name, df in tables.items()])
