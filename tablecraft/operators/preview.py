"""Previews of a result and tables prepared for charts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import any_of, col, require, to_number
from .filters import filter_where
from .projection import nan_to_null


def preview(
    df: DataFrame, order_by: Sequence[str], limit: int = 1000, where: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """Rows to show, and a one-row table with their ``total_rows``.

    With a condition all rows that satisfy it are shown and counted; otherwise
    the first ``limit`` rows, or all rows for a limit of 0 or less.
    """
    result = filter_where(df, where) if where else df
    total = result.agg(F.count(F.lit(1)).alias("total_rows"))
    shown = nan_to_null(result)
    if not where and limit > 0:
        shown = shown.orderBy(*[col(c).asc_nulls_last() for c in order_by]).limit(limit)
    return shown, total


def chart_pivot(
    df: DataFrame,
    x: str,
    values: Sequence[str],
    group_by: str | None = None,
    groups: Sequence[str] = (),
    order_by: Sequence[str] = (),
) -> DataFrame:
    """One row per ``x`` and one series per group; the last row wins in a cell.

    ``groups`` names the series, in order; ``order_by`` says which row is last.
    Without a group the value columns are the series.
    """
    if not group_by:
        return df.select(col(x), *[col(v) for v in values])
    require(df, [x, group_by, *values, *order_by], "chart_pivot")
    if not groups or not order_by:
        raise ValueError("chart_pivot: a grouped chart needs 'groups' and 'order_by'")
    labelled = df.withColumn("_g", F.coalesce(col(group_by).cast("string"), F.lit("")))
    order = F.struct(*[col(c) for c in order_by])
    single = len(values) == 1
    cells = [
        F.max_by(col(v), F.when(F.col("_g") == g, order)).alias(g if single else f"{g} · {v}")
        for g in groups
        for v in values
    ]
    return labelled.groupBy(col(x)).agg(*cells)


def chart_series(
    df: DataFrame, x: str, values: Sequence[str], group_by: str, order_by: Sequence[str]
) -> DataFrame:
    """The cells of a grouped chart as rows ``(x, series, value)``, for every group there is.

    The last row by ``order_by`` wins in a cell. With several value columns a
    series is named after group and column.
    """
    require(df, [x, group_by, *values, *order_by], "chart_series")
    group = F.coalesce(col(group_by).cast("string"), F.lit(""))
    order = F.struct(*[col(c) for c in order_by])
    last = df.groupBy(col(x).alias("x"), group.alias("_g")).agg(
        *[F.max_by(col(v), order).cast("double").alias(f"_v{i}") for i, v in enumerate(values)]
    )
    single = len(values) == 1
    cells = [
        F.struct((F.col("_g") if single else F.concat(F.col("_g"), F.lit(f" · {v}"))).alias("series"), F.col(f"_v{i}").alias("value"))
        for i, v in enumerate(values)
    ]
    return last.select("x", F.inline(F.array(*cells)))


# Forms of dates besides yyyy-mm-dd: with slashes or dots, either order, and with a month's name.
DATE_FORMS = (
    r"^\d{4}[-/.]\d{1,2}[-/.]\d{1,2}([T ]|$)",
    r"^\d{1,2}[-/.]\d{1,2}[-/.]\d{4}([T ]|$)",
    r"(?i)^(\d{1,2}[ -])?(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*[ -]\d{1,4}(, ?\d{4}|[ -]\d{4})?$",
)


def infer_chart_columns(df: DataFrame) -> DataFrame:
    """Per column: does any value read as a number, and does any look like a date?"""
    parts = []
    for i, name in enumerate(df.columns):
        text = col(name).cast("string")
        dated = any_of(text.rlike(form) for form in (r"^\d{4}-\d{2}-\d{2}", *DATE_FORMS))
        parts.append(F.count(to_number(df, name)).alias(f"n{i}"))
        parts.append(F.count_if(dated).alias(f"d{i}"))
    measured = df.agg(*parts)
    rows = F.array(
        *[
            F.struct(
                F.lit(name).alias("column"),
                (F.col(f"n{i}") > 0).alias("is_numeric"),
                (F.col(f"d{i}") > 0).alias("is_date"),
            )
            for i, name in enumerate(df.columns)
        ]
    )
    return measured.select(F.inline(rows))


def pie_shares(df: DataFrame, name: str, value: str) -> DataFrame:
    """Each row as a slice: its name, its value and its share of the total."""
    slices = df.select(
        F.coalesce(col(name).cast("string"), F.lit("")).alias("name"),
        F.coalesce(to_number(df, value), F.lit(0.0)).alias("value"),
    )
    total = slices.agg(F.sum("value")).scalar()
    return slices.withColumn("share", F.col("value") / F.nullif(total, F.lit(0.0)))
