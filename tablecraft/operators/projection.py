"""Selecting, renaming, casting, deriving and classifying columns."""

from __future__ import annotations

import decimal
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import FRACTIONAL, all_of, col, dtype_of, present, require, spread, text_to_long, to_number

# The dtype names a caller may use for each kind of column.
INTEGER_NAMES = ("int", "integer", "int64", "bigint", "long")
FLOAT_NAMES = ("float", "float64", "number", "double")
TEXT_NAMES = ("str", "string", "object")
BOOLEAN_NAMES = ("bool", "boolean")

# A key that contains one of these words holds a secret.
SECRET_WORDS = ("password", "passwd", "pwd", "secret", "token", "key", "dsn", "credential", "api_key")
MASK = "***"

#: Entries of a lookup dict that become a literal map in the plan; a longer dict is joined as a frame.
LITERALS = 1_000


def rename_and_select(
    df: DataFrame, select: Sequence[str] = (), rename: Mapping[str, str] | None = None
) -> DataFrame:
    """Keep ``select`` in that order, then rename. Absent columns are skipped."""
    if select:
        df = df.select(*[col(c) for c in select if c in df.columns])
    return df.withColumnsRenamed(dict(rename or {}))


select_rename = rename_and_select


def reorder_columns(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """Put ``order`` first; the other columns follow as they were."""
    first = [c for c in order if c in df.columns]
    return df.select(*[col(c) for c in first + [c for c in df.columns if c not in first]])


def _spark_type(dtype: str) -> str:
    name = dtype.lower()
    if name in INTEGER_NAMES:
        return "bigint"
    if name in FLOAT_NAMES:
        return "double"
    if name in TEXT_NAMES:
        return "string"
    if name in BOOLEAN_NAMES:
        return "boolean"
    if "datetime" in name:
        return "timestamp"
    return dtype


def cast_columns(df: DataFrame, casts: Mapping[str, str]) -> DataFrame:
    """Cast columns; a value that does not convert is an error."""
    require(df, casts, "cast_columns")
    return df.withColumns({c: col(c).cast(_spark_type(t)) for c, t in casts.items()})


def _coerced(df: DataFrame, name: str, dtype: str) -> Column:
    target = _spark_type(dtype)
    source = dtype_of(df, name)
    if target == "timestamp":
        return F.try_to_timestamp(col(name)) if isinstance(source, T.StringType) else col(name).try_cast(target)
    if target == "bigint":
        if isinstance(source, T.IntegralType):
            return col(name).cast("bigint")
        if isinstance(source, T.StringType):
            # Whole numbers of any length first: a double cannot hold them all.
            return F.coalesce(text_to_long(col(name)), to_number(df, name).try_cast("bigint"))
        return to_number(df, name).try_cast("bigint")
    if target == "double":
        return to_number(df, name)
    return col(name).try_cast(target)


def coerce_types(df: DataFrame, casts: Mapping[str, str], on_fraction: str = "keep_column") -> DataFrame:
    """Cast columns; a value that does not parse becomes NULL.

    Where integers are asked for, a column that holds any fraction stays as it
    is (``keep_column``), which takes one aggregate over those columns to decide;
    ``truncate`` cuts fractions off instead.
    """
    if on_fraction not in ("truncate", "keep_column"):
        raise ValueError("coerce_types: on_fraction must be 'truncate' or 'keep_column'")
    casts = {c: t for c, t in casts.items() if c in df.columns}
    if on_fraction == "keep_column":
        whole = [
            c
            for c, t in casts.items()
            if _spark_type(t) == "bigint" and not isinstance(dtype_of(df, c), T.IntegralType)
        ]
        if whole:
            number = {c: to_number(df, c) for c in whole}
            found = df.agg(
                *[F.max(number[c] != F.floor(number[c])).alias(f"f{i}") for i, c in enumerate(whole)]
            ).first()
            casts = {c: t for c, t in casts.items() if c not in whole or not found[f"f{whole.index(c)}"]}
    return df.withColumns({c: _coerced(df, c, t) for c, t in casts.items()})


def map_values(df: DataFrame, column: str, mapping: Mapping[Any, Any] | DataFrame) -> DataFrame:
    """Replace values by lookup; a value without an entry stays.

    Keys are read as the column's type; one that does not fit it matches nothing.
    ``mapping`` is a dict, or for large lookups a frame whose first two columns
    are key and value. Dicts and repeated keys are read as in ``map_multi_key``.
    """
    require(df, [column], "map_values")
    if isinstance(mapping, DataFrame):
        return map_multi_key(df, [column], mapping, column)
    if not mapping:
        return df
    dtype = dtype_of(df, column)
    keyed = {_as_key(key, dtype): value for key, value in mapping.items()}
    keyed.pop(None, None)
    if not keyed:
        return df
    if len(keyed) > LITERALS:
        found = map_multi_key(df, [column], {(key,): value for key, value in keyed.items()}, "_found")
        return _replaced(found, column, F.col("_found"), mapping).drop("_found")
    entries = F.create_map(*[x for key, value in keyed.items() for x in (F.lit(key).cast(dtype), F.lit(value))])
    return _replaced(df, column, F.try_element_at(entries, col(column)), mapping)


def _replaced(df: DataFrame, column: str, found: Column, mapping: Mapping[Any, Any]) -> DataFrame:
    """``column`` as ``found``, or as it was; as text if the values are no values of its type."""
    fits = all(isinstance(v, str) for v in mapping.values()) == isinstance(dtype_of(df, column), T.StringType)
    kept = col(column) if fits else col(column).cast("string")
    return df.withColumn(column, F.coalesce(found if fits else found.cast("string"), kept))


def _as_key(key: Any, dtype: T.DataType) -> Any:
    """A lookup key as a value of the column's type; None when there is none."""
    if isinstance(dtype, T.StringType):
        return str(key).lower() if isinstance(key, bool) else str(key)
    if isinstance(dtype, T.BooleanType):
        return key if isinstance(key, bool) else {"true": True, "false": False}.get(str(key).lower())
    try:
        if isinstance(dtype, T.IntegralType):
            whole = int(key)
            bits = {"tinyint": 8, "smallint": 16, "int": 32}.get(dtype.simpleString(), 64)
            return whole if whole == float(key) and -(2 ** (bits - 1)) <= whole < 2 ** (bits - 1) else None
        if isinstance(dtype, T.DecimalType):
            number = decimal.Decimal(str(key))
            fits = number == round(number, dtype.scale) and abs(number) < 10 ** (dtype.precision - dtype.scale)
            return number if fits else None
        if isinstance(dtype, T.NumericType):
            return float(key)
    except (TypeError, ValueError, OverflowError, decimal.InvalidOperation):
        return None
    return key


def map_multi_key(
    df: DataFrame,
    keys: Sequence[str],
    lookup: Mapping[tuple, Any] | DataFrame,
    output: str,
    default: Any = None,
) -> DataFrame:
    """Look up ``output`` by several key columns.

    ``lookup`` is a dict from key tuples to values, or for large lookups a frame
    with the key columns in the order of ``keys`` and then the value. A dict of
    up to ``LITERALS`` entries becomes a literal map in the plan, a longer one a
    frame. Of a frame's repeated keys the largest value counts, so that no row
    of ``df`` is multiplied. A row without an entry gets ``default``, or keeps
    its old ``output`` when there is one and no default is given. The planner
    broadcasts a frame when its size allows.
    """
    require(df, keys, "map_multi_key")
    fallback = col(output) if default is None and output in df.columns else F.lit(default)
    if not isinstance(lookup, DataFrame) and len(lookup) > LITERALS:
        names = [f"_k{i}" for i in range(len(keys))]
        known = [(*key, value) for key, value in lookup.items() if None not in key]
        given = df.sparkSession.createDataFrame(known, [*names, "_value"])
        lookup = given.select(*[F.col(n).cast(dtype_of(df, k)).alias(n) for n, k in zip(names, keys)], "_value")
    if not isinstance(lookup, DataFrame):
        names = [f"k{i}" for i in range(len(keys))]

        def entry(parts: Sequence[Column]) -> Column:
            typed = zip(keys, names, parts)
            return F.struct(*[part.cast(dtype_of(df, k)).alias(n) for k, n, part in typed])

        pairs = [x for key, value in lookup.items() for x in (entry([F.lit(k) for k in key]), F.lit(value))]
        known = all_of(col(k).isNotNull() for k in keys)
        found = F.when(known, F.try_element_at(F.create_map(*pairs), entry([col(k) for k in keys])))
        return df.withColumn(output, F.coalesce(found, fallback) if pairs else fallback)
    parts = [f"_k{i}" for i in range(len(keys))]
    # The join takes over the partitioning of this aggregate where it is not a broadcast.
    named = lookup.toDF(*parts, "_mapped").groupBy(*parts).agg(F.max("_mapped").alias("_mapped"))
    joined = df.join(
        named.withColumn("_hit", F.lit(True)), [col(k) == F.col(f"_k{i}") for i, k in enumerate(keys)], "left"
    )
    return joined.withColumn(output, F.when(F.col("_hit"), F.col("_mapped")).otherwise(fallback)).drop(
        "_mapped", "_hit", *named.columns
    )


def derive_columns(df: DataFrame, expressions: Mapping[str, str]) -> DataFrame:
    """Add SQL expressions in order; a later one sees the earlier ones."""
    for name, text in expressions.items():
        try:
            df = df.withColumn(name, F.expr(text))
        except Exception as error:
            raise ValueError(f"derive_columns: failed to evaluate '{text}' for column '{name}': {error}") from error
    return df


def add_revenue(
    df: DataFrame, quantity_col: str = "quantity", price_col: str = "unit_price", discount_col: str = "discount_pct"
) -> DataFrame:
    """Add the price after a discount in percent, and quantity times that price."""
    require(df, [quantity_col, price_col, discount_col], "add_revenue")
    return df.withColumn("net_price", col(price_col) * (1 - col(discount_col) / 100)).withColumn(
        "revenue", col(quantity_col) * col("net_price")
    )


def classify_change(
    df: DataFrame,
    column: str = "change_24h_pct",
    strong_threshold: float = 5.0,
    moderate_threshold: float = 2.0,
    flat_threshold: float = 0.1,
) -> DataFrame:
    """Add ``direction``, ``magnitude`` and ``change_class`` for a change in percent.

    A missing or non-numeric value counts as a slight, flat change.
    """
    require(df, [column], "classify_change")
    change = to_number(df, column)
    size = F.abs(change)
    df = df.withColumns(
        {
            "direction": F.when(change > flat_threshold, "gain").when(change < -flat_threshold, "loss").otherwise("flat"),
            "magnitude": F.when(size < flat_threshold, "flat")
            .when(size >= strong_threshold, "strong")
            .when(size >= moderate_threshold, "moderate")
            .otherwise("slight"),
            "change_class": F.lit(None).cast("string"),
        }
    )
    return df.withColumn(
        "change_class",
        F.when(size < flat_threshold, "flat").otherwise(F.concat_ws("_", "magnitude", "direction")),
    )


def add_market_tier(
    df: DataFrame,
    market_cap_column: str = "market_cap_usd",
    large_cap: float = 50_000_000_000,
    mid_cap: float = 5_000_000_000,
    small_cap: float = 500_000_000,
) -> DataFrame:
    """Add ``market_tier``: large, mid, small, or micro for all else and for missing values."""
    require(df, [market_cap_column], "add_market_tier")
    cap = to_number(df, market_cap_column)
    tier = F.when(cap >= large_cap, "large").when(cap >= mid_cap, "mid").when(cap >= small_cap, "small")
    return df.withColumn("market_tier", tier.otherwise("micro"))


def pnl_class(df: DataFrame, column: str = "pnl_pct", strong: float = 20, mild: float = 5) -> DataFrame:
    """Add ``pnl_class``: bands of profit and loss in percent, ``flat`` between them."""
    require(df, [column], "pnl_class")
    pct = col(column)
    band = (
        F.when(pct >= strong, "strong_gain")
        .when(pct >= mild, "gain")
        .when(pct <= -strong, "strong_loss")
        .when(pct <= -mild, "loss")
    )
    return df.withColumn("pnl_class", band.otherwise("flat"))


def fill_defaults(df: DataFrame, defaults: Mapping[str, Any]) -> DataFrame:
    """Fill missing values per column; absent columns are skipped."""
    filled = {}
    for name, value in defaults.items():
        if name in df.columns:
            filled[name] = F.coalesce(present(df, name), F.lit(value).cast(dtype_of(df, name)))
    return df.withColumns(filled) if filled else df


def _secret_pattern() -> str:
    return "(?i)(" + "|".join(SECRET_WORDS) + ")"


def mask_secrets(df: DataFrame, key: str = "key", value: str = "value") -> DataFrame:
    """Replace text values whose key looks like the name of a secret."""
    require(df, [key, value], "mask_secrets")
    if not isinstance(dtype_of(df, value), T.StringType):
        return df
    hidden = col(key).rlike(_secret_pattern()) & col(value).isNotNull()
    return df.withColumn(value, F.when(hidden, MASK).otherwise(col(value)))


def mask_secret_columns(df: DataFrame) -> DataFrame:
    """Replace the values of text columns whose name looks like a secret."""
    named = [
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, T.StringType) and any(w in f.name.lower() for w in SECRET_WORDS)
    ]
    return df.withColumns({c: F.when(col(c).isNotNull(), MASK) for c in named}) if named else df


def cast_sort_movers(
    df: DataFrame,
    integer: Sequence[str] = ("rank",),
    long: Sequence[str] = ("market_cap_usd",),
    double: Sequence[str] = ("price_usd",),
    change: str = "change_24h_pct",
) -> DataFrame:
    """Type the columns, round the change, drop rows without one, largest change first."""
    require(df, [*integer, *long, *double, change], "cast_sort_movers")
    kept = df.filter(col(change).isNotNull())
    typed = {c: col(c).cast("int") for c in integer}
    typed |= {c: col(c).cast("bigint") for c in long}
    typed |= {c: col(c).cast("double") for c in double}
    typed[change] = F.round(col(change).cast("double"), 2)
    result = kept.withColumns(typed)
    return result.orderBy(F.abs(col(change)).desc_nulls_last(), spread(result))


def nan_to_null(df: DataFrame) -> DataFrame:
    """Turn NaN into NULL in every fractional column."""
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, FRACTIONAL)]
    return df.withColumns({c: present(df, c) for c in names}) if names else df
