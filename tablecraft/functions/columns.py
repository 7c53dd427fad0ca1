"""Column helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FRACTIONAL = (T.FloatType, T.DoubleType)

# Text that reads as a number, and as a whole number.
NUMBER_TEXT = r"(?i)^[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|inf(inity)?)$"
WHOLE_TEXT = r"^[+-]?\d+$"


def quoted(name: str) -> str:
    """``name`` as one SQL identifier, whatever characters it holds."""
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    return F.col(quoted(name))


def dtype_of(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def is_missing(df: DataFrame, name: str) -> Column:
    """True for NULL, and for NaN in a fractional column: both count as missing."""
    missing = col(name).isNull()
    if isinstance(dtype_of(df, name), FRACTIONAL):
        missing = missing | F.isnan(col(name))
    return missing


def present(df: DataFrame, name: str) -> Column:
    """The value, with NaN turned into NULL."""
    if isinstance(dtype_of(df, name), FRACTIONAL):
        return F.when(~F.isnan(col(name)), col(name))
    return col(name)


def text_to_double(text: Column) -> Column:
    """Text as a double, NULL when it is no number.

    The pattern comes first: a cast that fails costs an exception per row,
    which is some fifty times as slow as the pattern.
    """
    trimmed = F.trim(text)
    return F.when(trimmed.rlike(NUMBER_TEXT), trimmed.try_cast("double"))


def text_to_long(text: Column) -> Column:
    """Text as a whole number, NULL when it is none or too large."""
    trimmed = F.trim(text)
    return F.when(trimmed.rlike(WHOLE_TEXT), trimmed.try_cast("bigint"))


def to_number(df: DataFrame, name: str) -> Column:
    """The value as a double; what does not parse, and NaN, is NULL."""
    dtype = dtype_of(df, name)
    if isinstance(dtype, FRACTIONAL):
        return present(df, name).cast("double")
    if isinstance(dtype, (T.NumericType, T.BooleanType)):
        return col(name).cast("double")
    if isinstance(dtype, T.StringType):
        return text_to_double(col(name))
    return F.lit(None).cast("double")


def all_of(conditions: Iterable[Column]) -> Column:
    result = F.lit(True)
    for condition in conditions:
        result = result & condition
    return result


def any_of(conditions: Iterable[Column]) -> Column:
    result = F.lit(False)
    for condition in conditions:
        result = result | condition
    return result


def spread(df: DataFrame) -> Column:
    """A last sort key for full sorts.

    Rows that are equal in the sort column would all go to one partition; a
    hash of the row lets the range partitioning split them. It follows from the
    row alone, so a task that runs again sends each row where it went before.
    """
    hashable = [f.name for f in df.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    return F.xxhash64(*[col(c) for c in hashable])


def require(df: DataFrame, names: Iterable[str], operator: str) -> None:
    for name in names:
        if name not in df.columns:
            raise KeyError(f"{operator}: column '{name}' not found")
