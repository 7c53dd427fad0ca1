"""Grouped summaries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.columns import FRACTIONAL, all_of, col, dtype_of, is_missing, present, require
from ..functions.ordering import RUN, ordered_runs
from .filters import as_date, union_all

# The aggregation names a specification may use.
AGGREGATES = ("sum", "mean", "count", "min", "max", "median", "std", "nunique")


def _aggregate(df: DataFrame, source: str, name: str) -> Column:
    value = present(df, source)
    if name == "sum":
        return F.coalesce(F.sum(value), F.lit(0))
    if name == "mean":
        return F.avg(value)
    if name == "count":
        return F.count(value)
    if name == "min":
        return F.min(value)
    if name == "max":
        return F.max(value)
    if name == "std":
        return F.stddev_samp(value)
    return F.count_distinct(value)


def _stacks(df: DataFrame, columns: Sequence[str]) -> list[tuple[T.DataType, list[str]]]:
    """Columns whose values fit one type without loss, with that type: whole numbers, fractions, decimals."""
    stacks: dict[str, tuple[T.DataType, list[str]]] = {}
    for column in dict.fromkeys(columns):
        dtype = dtype_of(df, column)
        if isinstance(dtype, FRACTIONAL):
            common = T.DoubleType()
        elif isinstance(dtype, T.IntegralType):
            common = T.LongType()
        else:  # decimals only with decimals of the same shape
            common = dtype
        stacks.setdefault(common.simpleString(), (common, []))[1].append(column)
    return list(stacks.values())


def exact_medians(df: DataFrame, keys: Sequence[str], medians: Mapping[str, str]) -> DataFrame:
    """The median of several columns per key, exact, without holding a group's values in one task.

    ``medians`` maps an output to its column. Columns of one kind (whole numbers, fractions) are stacked by number and
    take one pass together. Values are counted per key and put into ordered runs. How many values each
    run holds tells which one or two runs the middle lies in, so only those are
    looked at closely. Keys must not be NULL; a key without any value has no row.
    """
    result = None
    for common, columns in _stacks(df, list(medians.values())):
        entries = [F.struct(F.lit(i).alias("no"), present(df, c).cast(common).alias("v")) for i, c in enumerate(columns)]
        # Keys get names of their own: a column may be called as a helper is.
        renamed = [F.col(k) for k in (f"_k{i}" for i in range(len(keys)))]
        each = df.select(*[col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.explode(F.array(*entries)).alias("_e"))
        flat = each.select(*renamed, F.col("_e.no").alias("_no"), F.col("_e.v").alias("_v")).filter(F.col("_v").isNotNull())
        found = _middles(flat, [f"_k{i}" for i in range(len(keys))])
        outs = [F.max(F.when(F.col("_no") == columns.index(c), F.col("_m"))).alias(out) for out, c in medians.items() if c in columns]
        part = found.groupBy(*renamed).agg(*outs)
        part = part.select(*[F.col(f"_k{i}").alias(k) for i, k in enumerate(keys)], *[col(out) for out, c in medians.items() if c in columns])
        result = part if result is None else result.join(part, on=list(keys), how="full_outer")
    return result


def _middles(flat: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``(*keys, _no, _m)``: the middle of ``flat (*keys, _no, _v)`` per key and number of column."""
    keys = [*keys, "_no"]
    by = [F.col(k) for k in keys]
    cells = flat.groupBy(*by, "_v").agg(F.count(F.lit(1)).alias("_n"))
    runs = ordered_runs(cells, keys, [F.col("_v").asc()])

    whole = Window.partitionBy(*by)
    per_run = runs.groupBy(*by, RUN).agg(F.sum("_n").alias("_in_run"))
    placed = per_run.select(
        *by,
        RUN,
        (F.sum("_in_run").over(whole.orderBy(RUN)) - F.col("_in_run")).alias("_before"),
        "_in_run",
        F.sum("_in_run").over(whole).alias("_size"),
    )
    low, high = F.expr("(_size + 1) div 2"), F.expr("(_size + 2) div 2")
    wanted = placed.filter((F.col("_before") < high) & (F.col("_before") + F.col("_in_run") >= low)).drop("_in_run")

    inside = Window.partitionBy(*by, RUN).orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    near = runs.join(wanted, on=[*keys, RUN]).withColumn("_upto", F.col("_before") + F.sum("_n").over(inside))

    def holds(position: Column) -> Column:
        return (F.col("_upto") >= position) & (F.col("_upto") - F.col("_n") < position)

    # Halved as doubles: the sum of two large longs would not fit a long.
    middle = [F.max(F.when(holds(place), F.col("_v"))).cast("double") / 2 for place in (low, high)]
    return near.groupBy(*by).agg((middle[0] + middle[1]).alias("_m"))


def exact_median(df: DataFrame, keys: Sequence[str], column: str, out: str) -> DataFrame:
    """The median of one column per key, see :func:`exact_medians`."""
    return exact_medians(df, keys, {out: column})


def group_summary(df: DataFrame, group_by: Sequence[str], aggs: Mapping[str, Any]) -> DataFrame:
    """Named aggregates per group; rows with a missing key are left out.

    An entry is ``output: [source, function]``, or ``output: function`` when
    both columns have the same name. Entries for absent columns are skipped;
    if none is left the result is the group size as ``count``.
    """
    keys = list(group_by)
    if not keys:
        raise ValueError("group_summary: 'group_by' is required")
    require(df, keys, "group_summary")
    wanted: dict[str, tuple[str, str]] = {}
    for out, spec in aggs.items():
        if isinstance(spec, str):
            wanted[out] = (out, spec)
        elif isinstance(spec, (list, tuple)) and len(spec) == 2:
            wanted[out] = (spec[0], spec[1])
    wanted = {out: (source, name) for out, (source, name) in wanted.items() if source in df.columns}
    for source, name in wanted.values():
        if name not in AGGREGATES:
            raise ValueError(f"group_summary: unknown aggregation '{name}' for '{source}'")

    keyed = df.filter(all_of(~is_missing(df, k) for k in keys))
    groups = keyed.groupBy(*[col(k) for k in keys])
    if not wanted:
        return groups.agg(F.count(F.lit(1)).alias("count"))
    plain = {out: spec for out, spec in wanted.items() if spec[1] != "median"}
    medians = {out: spec[0] for out, spec in wanted.items() if spec[1] == "median"}
    if plain:
        result = groups.agg(*[_aggregate(df, source, name).alias(out) for out, (source, name) in plain.items()])
    else:
        result = keyed.select(*[col(k) for k in keys]).distinct()
    if medians:
        result = result.join(exact_medians(keyed, keys, medians), on=keys, how="left")
    return result.select(*[col(c) for c in [*keys, *wanted]])


def monthly_rollup(
    df: DataFrame, date_col: str = "order_date", value_col: str = "revenue", group_col: str | None = None
) -> DataFrame:
    """Count, sum, mean, least and largest value per month and optional group."""
    require(df, [date_col, value_col], "monthly_rollup")
    by = [F.date_format(as_date(df, date_col), "yyyy-MM").alias("year_month")]
    if group_col:
        by.append(col(group_col))
    value = col(value_col)
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("row_count"),
        F.sum(value).alias("total_value"),
        F.avg(value).alias("avg_value"),
        F.min(value).alias("min_value"),
        F.max(value).alias("max_value"),
    )


def monthly_summary(
    df: DataFrame,
    date_col: str = "date",
    category: str = "category",
    quantity: str = "quantity",
    revenue: str = "revenue",
    discount: str = "discount_pct",
) -> DataFrame:
    """Orders, units, revenue and mean discount per month and category."""
    return df.groupBy(F.date_format(as_date(df, date_col), "yyyy-MM").alias("month"), col(category)).agg(
        F.count(F.lit(1)).alias("order_count"),
        F.sum(col(quantity)).alias("units_sold"),
        F.round(F.sum(col(revenue)), 2).alias("total_revenue"),
        F.round(F.avg(col(discount)), 1).alias("avg_discount_pct"),
    )


def top_products(
    df: DataFrame,
    n: int = 10,
    product: str = "product",
    category: str = "category",
    quantity: str = "quantity",
    revenue: str = "revenue",
    net_price: str = "net_price",
    discount: str = "discount_pct",
) -> DataFrame:
    """The ``n`` products with the largest revenue; equal revenue by name."""
    sums = df.groupBy(col(product), col(category)).agg(
        F.sum(col(quantity)).alias("units_sold"),
        F.round(F.sum(col(revenue)), 2).alias("total_revenue"),
        F.round(F.avg(col(net_price)), 2).alias("avg_net_price"),
        F.round(F.avg(col(discount)), 1).alias("avg_discount_pct"),
    )
    return sums.orderBy(F.col("total_revenue").desc_nulls_last(), col(product), col(category)).limit(n)


def recent_sales_agg(
    df: DataFrame,
    product: str = "product",
    category: str = "category",
    quantity: str = "quantity",
    revenue: str = "revenue",
    by: Sequence[str] = (),
) -> DataFrame:
    """Units and revenue per product and category, and per further columns ``by``."""
    return df.groupBy(*[col(c) for c in [*by, product, category]]).agg(
        F.sum(col(quantity)).alias("units_sold"), F.round(F.sum(col(revenue)), 2).alias("total_revenue")
    )


def sector_summary(
    df: DataFrame,
    sector: str = "sector",
    tier: str = "market_tier",
    change: str = "change_24h_pct",
    cap: str = "market_cap_usd",
    volume: str = "volume_24h_usd",
    direction: str = "direction",
    unit: float = 1e9,
) -> DataFrame:
    """Per sector and tier: assets, mean change, cap, volume, and how many rose or fell; the largest cap first."""
    sums = df.groupBy(col(sector), col(tier)).agg(
        F.count(F.lit(1)).alias("asset_count"),
        F.round(F.avg(col(change)), 2).alias("avg_change_24h_pct"),
        F.round(F.sum(col(cap)) / unit, 1).alias("total_market_cap_bn"),
        F.round(F.sum(col(volume)) / unit, 2).alias("total_volume_24h_bn"),
        F.count_if(col(direction) == "gain").alias("gainers"),
        F.count_if(col(direction) == "loss").alias("losers"),
    )
    return sums.orderBy(F.col("total_market_cap_bn").desc_nulls_last(), col(sector), col(tier))


def dq_sector_summary(
    df: DataFrame,
    sector: str = "sector",
    change: str = "change_24h_pct",
    cap: str = "market_cap_usd",
    change_class: str = "change_class",
    unit: float = 1e9,
) -> DataFrame:
    """Per sector: assets, mean change, cap, and how many rose or fell strongly."""
    return df.groupBy(col(sector)).agg(
        F.count(F.lit(1)).alias("asset_count"),
        F.round(F.avg(col(change)), 2).alias("avg_change_24h_pct"),
        F.round(F.sum(col(cap)) / unit, 1).alias("total_market_cap_bn"),
        F.count_if(col(change_class) == "strong_gain").alias("strong_gainers"),
        F.count_if(col(change_class) == "strong_loss").alias("strong_losers"),
    )


def revenue_by_region(df: DataFrame, region: str = "region", revenue: str = "revenue", order: str = "order_id") -> DataFrame:
    """Revenue, orders and mean order value per region."""
    return group_summary(
        df,
        [region],
        {"total_revenue": [revenue, "sum"], "order_count": [order, "count"], "avg_order_value": [revenue, "mean"]},
    )


def tag_counts(*sources: DataFrame, tags: str = "tags") -> DataFrame:
    """How often each tag occurs in the tag lists of several sources, sorted by tag."""
    lists = union_all(*[s.select(col(tags).alias("_tags")) for s in sources])
    single = lists.select(F.explode("_tags").alias("tag"))
    return single.groupBy("tag").agg(F.count(F.lit(1)).alias("count")).orderBy("tag")


def row_and_column_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Rows and columns of each named table."""
    return union_all(
        *[
            df.agg(F.count(F.lit(1)).alias("row_count")).select(
                F.lit(name).alias("output"), "row_count", F.lit(len(df.columns)).cast("bigint").alias("column_count")
            )
            for name, df in tables.items()
        ]
    )
