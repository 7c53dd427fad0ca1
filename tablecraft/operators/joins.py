"""Joins: profit and loss of positions, sales per customer, null-safe outer joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import all_of, col, require, to_number
from ..functions.ordering import row_numbers
from ..session import settle


def compute_pnl(
    positions: DataFrame,
    prices: DataFrame,
    symbol_col: str = "symbol",
    price_col: str = "price_usd",
    quantity_col: str = "quantity",
    cost_basis_col: str = "cost_basis_usd",
    match_missing: bool = True,
) -> DataFrame:
    """Positions with the price columns of their symbol, and value, cost, profit.

    Symbols match without regard to case, and a missing symbol matches a
    missing one, each with each; with ``match_missing=False`` it matches
    nothing, and positions without a symbol stay one row each. A column of
    both sides gets the suffix ``_x`` or ``_y``.
    """
    require(positions, [symbol_col], "compute_pnl")
    require(prices, [symbol_col], "compute_pnl")
    shared = (set(positions.columns) & set(prices.columns)) - {symbol_col}
    left = positions.withColumnsRenamed({c: f"{c}_x" for c in shared}).withColumn("_left", F.upper(col(symbol_col)))
    right = (
        prices.withColumnsRenamed({c: f"{c}_y" for c in shared})
        .withColumn("_right", F.upper(col(symbol_col)))
        .drop(symbol_col)
    )
    same = F.col("_left").eqNullSafe(F.col("_right")) if match_missing else F.col("_left") == F.col("_right")
    merged = left.join(right, same, "left").drop("_left", "_right")
    quantity = to_number(merged, quantity_col)
    return merged.withColumns(
        {
            "current_value_usd": quantity * to_number(merged, price_col),
            "cost_usd": quantity * to_number(merged, cost_basis_col),
        }
    ).withColumns(
        {
            "pnl_usd": F.col("current_value_usd") - F.col("cost_usd"),
            "pnl_pct": (F.col("current_value_usd") - F.col("cost_usd")) / F.nullif(F.col("cost_usd"), F.lit(0.0)) * 100,
        }
    )


def customer_sales(
    customers: DataFrame,
    sales: DataFrame,
    on: str = "customer_id",
    customer_cols: Sequence[str] = ("customer_name", "segment"),
    product: str = "product",
    units: str = "units_sold",
    revenue: str = "total_revenue",
) -> DataFrame:
    """Customers with their sales per product; a customer without sales stays."""
    known = sales.filter(col(product).isNotNull()).select(*[col(c) for c in (on, product, units, revenue)])
    kept = customers.select(*[col(c) for c in (on, *customer_cols)])
    return kept.join(known, on=[on], how="left")


#: Rows of one key on one side from which the key is spread over several tasks.
HEAVY = 1_000_000
#: Keys of that kind are broadcast up to this number.
LISTED = 100_000


def full_outer_null_safe(
    left: DataFrame, right: DataFrame, keys: Sequence[str], heavy: int = HEAVY, one_to_one: bool = False
) -> DataFrame:
    """Full outer join in which a missing key matches a missing key.

    Other columns are named ``l_…`` and ``r_…``; ``_in_left`` and ``_in_right``
    tell which sides a row came from. A repeated key gives every pair of its rows; with ``one_to_one`` its
    copies are matched one by one, in the order of their values, and the surplus is one-sided.

    Spark cannot split a hot key in a full outer join. So keys are counted first, in one aggregate that
    combines before the shuffle. A key with ``heavy`` rows or more on a side is cut into salts of about so
    many: its longer side is spread over them, and its shorter side goes to each. Copies matched one by one
    differ in their number and need no salts. Beyond the count each side is read once.
    """
    require(left, keys, "full_outer_null_safe")
    require(right, keys, "full_outer_null_safe")
    match = list(keys)
    if one_to_one:
        left, right = (_numbered(df, keys) for df in (left, right))
        match.append(_COPY)
    # Names of their own on each side, as both may come from the same table.
    a, b = _side(left, match, "l"), _side(right, match, "r")
    counts = None if one_to_one else _heavy_keys(a, b, len(keys), heavy)
    on = all_of(F.col(f"_lk{i}").eqNullSafe(F.col(f"_rk{i}")) for i in range(len(match)))
    if counts is not None:
        a, b = _salted(a, counts, "l", heavy), _salted(b, counts, "r", heavy)
        on = on & (F.col("_lsalt") == F.col("_rsalt"))
    joined = a.join(b, on, "full_outer")
    if counts is not None:
        # A copy sent to all salts meets no row in some of them; it is one-sided only where its key is.
        joined = joined.filter(~(F.col("_in_l").isNull() & F.coalesce("_rcopied", F.lit(False))))
        joined = joined.filter(~(F.col("_in_r").isNull() & F.coalesce("_lcopied", F.lit(False))))
    return joined.select(
        *[F.when(F.col("_in_l"), F.col(f"_lk{i}")).otherwise(F.col(f"_rk{i}")).alias(k) for i, k in enumerate(keys)],
        *[col(f"l_{c}") for c in left.columns if c not in match],
        *[col(f"r_{c}") for c in right.columns if c not in match],
        F.coalesce("_in_l", F.lit(False)).alias("_in_left"),
        F.coalesce("_in_r", F.lit(False)).alias("_in_right"),
    )


_COPY = "_copy"


def _numbered(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of one key numbered by their values; equal rows are told apart once and for all."""
    named = settle(df.withColumn("_tie", F.monotonically_increasing_id()), "copies")
    values = [col(f.name) for f in df.schema.fields if f.name not in keys and not isinstance(f.dataType, (T.MapType, T.VariantType))]
    order = [v.asc_nulls_last() for v in values] + [F.col("_tie").asc()]
    return row_numbers(named, list(keys), order, _COPY).drop("_tie")


def _side(df: DataFrame, match: Sequence[str], side: str) -> DataFrame:
    return df.select(
        *[col(k).alias(f"_{side}k{i}") for i, k in enumerate(match)],
        *[col(c).alias(f"{side}_{c}") for c in df.columns if c not in match],
        F.lit(True).alias(f"_in_{side}"),
    )


def _heavy_keys(a: DataFrame, b: DataFrame, keys: int, heavy: int) -> DataFrame | None:
    """``(_k0, …, _l, _r)``: keys with many rows on a side and how many on each; None if there are none."""

    def ones(df: DataFrame, side: str) -> DataFrame:
        names = [F.col(f"_{side}k{i}").alias(f"_k{i}") for i in range(keys)]
        return df.select(*names, F.lit(int(side == "l")).alias("_l"), F.lit(int(side == "r")).alias("_r"))

    counted = ones(a, "l").unionByName(ones(b, "r")).groupBy(*[f"_k{i}" for i in range(keys)]).agg(F.sum("_l").alias("_l"), F.sum("_r").alias("_r"))
    found = settle(counted.filter(F.greatest("_l", "_r") >= heavy), "heavy")
    number = found.count()
    if not number:
        return None
    return F.broadcast(found) if number <= LISTED else found


def _salted(df: DataFrame, counts: DataFrame, side: str, heavy: int) -> DataFrame:
    """``df`` with a salt per row, 0 for keys that are not heavy. Salts are written down, so they stay."""
    known = counts.select(*[F.col(c).alias(f"_c{c}") for c in counts.columns])
    keys = [c for c in counts.columns if c.startswith("_k")]
    on = all_of(F.col(f"_{side}{k[1:]}").eqNullSafe(F.col(f"_c{k}")) for k in keys)
    mine, other = (F.col("_c_l"), F.col("_c_r")) if side == "l" else (F.col("_c_r"), F.col("_c_l"))
    salts = F.ceil(F.greatest("_c_l", "_c_r") / heavy).cast("int")
    # The left side is the longer one if both are equally long.
    shorter = mine < other if side == "l" else mine <= other
    copied = F.coalesce(shorter & (mine > 0) & (other > 0), F.lit(False))
    own = F.coalesce(F.pmod(F.monotonically_increasing_id(), salts).cast("int"), F.lit(0))
    marked = df.join(known, on, "left").select(*df.columns, copied.alias(f"_{side}copied"), own.alias("_own"), salts.alias("_salts"))
    places = F.when(F.col(f"_{side}copied"), F.sequence(F.lit(0), F.col("_salts") - 1)).otherwise(F.array("_own"))
    return settle(marked, "salts").withColumn(f"_{side}salt", F.explode(places)).drop("_own", "_salts")
