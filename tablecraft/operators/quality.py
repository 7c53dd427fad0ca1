"""Data-quality checks on one table, and schema contracts over many."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import NUMBER_TEXT, WHOLE_TEXT, col, dtype_of, is_missing, present, to_number

REPORT = "`table` string, check_no int, type string, label string, `column` string, observed double, bound double, passed boolean, message string"


@dataclass(frozen=True)
class Check:
    """One check: ``row_count``, ``null_rate``, ``value_range`` or ``unique``."""

    type: str
    column: str | None = None
    name: str | None = None
    min_rows: int | None = None
    max_rows: int | None = None
    max_null_rate: float | None = None
    min_value: float | None = None
    max_value: float | None = None

    def __post_init__(self) -> None:
        if self.type not in ("row_count", "null_rate", "value_range", "unique"):
            raise ValueError(f"unknown check type '{self.type}'")
        if self.type != "row_count" and not self.column:
            raise ValueError(f"check type '{self.type}' requires 'column'")

    @property
    def label(self) -> str:
        return self.name or self.type


class CheckFailure(Exception):
    """Raised on request when a report holds failures; ``failures`` lists them."""

    def __init__(self, failures: list[str]) -> None:
        super().__init__("; ".join(failures))
        self.failures = failures


def _null_share(df: DataFrame, column: str) -> Column:
    return F.avg(is_missing(df, column).cast("int"))


def dq_row_count(df: DataFrame, min_rows: int | None = None, max_rows: int | None = None) -> DataFrame:
    return dq_report(df, [Check("row_count", min_rows=min_rows, max_rows=max_rows)])


def dq_null_rate(df: DataFrame, column: str, max_null_rate: float) -> DataFrame:
    return dq_report(df, [Check("null_rate", column, max_null_rate=max_null_rate)])


def dq_value_range(
    df: DataFrame, column: str, min_value: float | None = None, max_value: float | None = None
) -> DataFrame:
    return dq_report(df, [Check("value_range", column, min_value=min_value, max_value=max_value)])


def dq_unique(df: DataFrame, column: str) -> DataFrame:
    return dq_report(df, [Check("unique", column)])


def _measures(df: DataFrame, checks: Sequence[Check]) -> list[Column]:
    """Everything the checks need, as columns of one aggregate."""
    parts = [F.count(F.lit(1)).alias("_rows")]
    for i, check in enumerate(checks):
        if check.type == "null_rate" and check.column in df.columns:
            parts.append(_null_share(df, check.column).alias(f"_null{i}"))
        if check.type == "value_range" and check.column in df.columns:
            value = _comparable(df, check.column)
            odd = value.isNull() & ~is_missing(df, check.column)
            parts += [F.min(value).alias(f"_min{i}"), F.max(value).alias(f"_max{i}"), F.count_if(odd).alias(f"_odd{i}")]
        if check.type == "unique" and check.column in df.columns:
            parts.append(_duplicates(df, check.column).alias(f"_duplicates{i}"))
    return parts


def _comparable(df: DataFrame, column: str) -> Column:
    """The value to compare with bounds: text as the number it holds, NULL when it is no number."""
    dtype = dtype_of(df, column)
    if isinstance(dtype, (T.NumericType, T.BooleanType)):
        return present(df, column)
    return to_number(df, column)


def _entry(
    no: int, check: Check, observed: Column, bound: float | None, passed: Column, message: Column, table: str
) -> Column:
    """One line of the report; the message shows only when the check failed."""
    ok = F.coalesce(passed, F.lit(True))
    return F.struct(
        F.lit(table).alias("table"),
        F.lit(no).alias("check_no"),
        F.lit(check.type).alias("type"),
        F.lit(check.label).alias("label"),
        F.lit(check.column).cast("string").alias("column"),
        observed.cast("double").alias("observed"),
        F.lit(bound).cast("double").alias("bound"),
        ok.alias("passed"),
        F.when(~ok, message).alias("message"),
    )


def _number(value: Column) -> Column:
    return F.format_number(value, 0)


def _percent(value: Column) -> Column:
    return F.format_string("%.3f%%", value * 100)


def _lines(df: DataFrame, no: int, check: Check, table: str) -> list[Column]:
    """The report lines of one check, over the measured row."""
    nothing = F.lit(None).cast("double")
    where = f"{check.label}:{check.column}"
    if check.column and check.column not in df.columns:
        text = F.lit(f"[{check.label}] column '{check.column}' not found")
        return [_entry(no, check, nothing, None, F.lit(False), text, table)]

    if check.type == "row_count":
        rows = F.col("_rows")
        lines = []
        for bound, sign, holds in (
            (check.min_rows, "<", lambda b: rows >= b),
            (check.max_rows, ">", lambda b: rows <= b),
        ):
            if bound is not None:
                word = "min" if sign == "<" else "max"
                text = F.concat(F.lit(f"[{check.label}] row count "), _number(rows), F.lit(f" {sign} {word} {bound:,}"))
                lines.append(_entry(no, check, rows, bound, holds(bound), text, table))
        return lines or [_entry(no, check, rows, None, F.lit(True), F.lit(""), table)]

    if check.type == "null_rate":
        rate, bound = F.col(f"_null{no}"), check.max_null_rate
        if bound is None:
            return [_entry(no, check, rate, None, F.lit(True), F.lit(""), table)]
        text = F.concat(F.lit(f"[{where}] null rate "), _percent(rate), F.lit(f" > max {bound:.3%}"))
        return [_entry(no, check, rate, bound, rate <= bound, text, table)]

    if check.type == "value_range":
        lines = []
        for bound, raw, sign, word in (
            (check.min_value, F.col(f"_min{no}"), "<", "min"),
            (check.max_value, F.col(f"_max{no}"), ">", "max"),
        ):
            if bound is None:
                continue
            actual = raw.cast("double")
            holds = actual >= bound if word == "min" else actual <= bound
            # No value at all passes; a value that is not a number fails.
            odd = F.col(f"_odd{no}") > 0
            passed = F.when(odd, False).when(raw.isNull(), True).otherwise(holds)
            breach = F.concat(F.lit(f"[{where}] {word} value "), actual.cast("string"), F.lit(f" {sign} {float(bound)}"))
            text = F.when(odd, f"[{where}] could not compare values (non-numeric?)").otherwise(breach)
            lines.append(_entry(no, check, actual, bound, passed, text, table))
        return lines or [_entry(no, check, nothing, None, F.lit(True), F.lit(""), table)]

    duplicates = F.col(f"_duplicates{no}")
    text = F.concat(F.lit(f"[{where}] "), _number(duplicates), F.lit(" duplicate value(s) found"))
    return [_entry(no, check, duplicates, 0, duplicates == 0, text, table)]


def _duplicates(df: DataFrame, column: str) -> Column:
    """Rows beyond the first of each value, missing values being one value.

    Several of these in one aggregate take one pass: Spark gives each row to every column's distinct values
    once, drops repeats before and after the shuffle, and counts what is left.
    """
    missing = F.coalesce(F.max(is_missing(df, column).cast("int")), F.lit(0))
    return F.count(F.lit(1)) - F.count_distinct(present(df, column)) - missing


def dq_report(df: DataFrame, checks: Sequence[Check], table: str = "table") -> DataFrame:
    """One line per check and bound: what was observed, the bound, and the failure text.

    All of it comes from one pass over the columns that the checks need.
    """
    checks = list(checks)
    lines = [line for i, c in enumerate(checks) for line in _lines(df, i, c, table)]
    if not lines:
        return df.sparkSession.createDataFrame([], REPORT)
    return df.agg(*_measures(df, checks)).select(F.inline(F.array(*lines)))


def failures(report: DataFrame) -> list[str]:
    """The failure texts of a report, in the order of the checks. A report is small."""
    rows = report.filter(~F.col("passed")).select("check_no", "message").collect()
    return [r["message"] for r in sorted(rows, key=lambda r: r["check_no"])]


def raise_on_failure(report: DataFrame) -> DataFrame:
    """The report, or a :class:`CheckFailure` when a check failed."""
    found = failures(report)
    if found:
        raise CheckFailure(found)
    return report


def dq_observe(df: DataFrame, checks: Sequence[Check], name: str = "dq") -> tuple[DataFrame, Observation]:
    """The same frame, measuring its checks while some action reads it.

    Uniqueness cannot be measured on the way and is refused.
    """
    if any(c.type == "unique" for c in checks):
        raise ValueError("dq_observe: 'unique' needs a pass of its own")
    seen = Observation(name)
    return df.observe(seen, *_measures(df, list(checks))), seen


def dq_violations(df: DataFrame, checks: Sequence[Check]) -> DataFrame:
    """The rows that break a check, with the labels of those checks in ``_violations``.

    ``row_count`` is about no row in particular and is skipped. For ``unique``
    all copies of a value are rows that break it.
    """
    marks = []
    marked = df
    for i, check in enumerate(checks):
        if check.type == "row_count" or check.column not in df.columns:
            continue
        if check.type == "null_rate":
            broken = is_missing(df, check.column)
        elif check.type == "value_range":
            number = _comparable(df, check.column).cast("double")
            broken = F.lit(False)
            if check.min_value is not None:
                broken = broken | (number < check.min_value)
            if check.max_value is not None:
                broken = broken | (number > check.max_value)
            broken = broken | (number.isNull() & ~is_missing(df, check.column))
        else:
            repeated = (
                df.groupBy(present(df, check.column).alias(f"_dup{i}"))
                .agg(F.count(F.lit(1)).alias("_copies"))
                .filter(F.col("_copies") > 1)
                .select(f"_dup{i}", F.lit(True).alias(f"_is_dup{i}"))
            )
            marked = marked.join(repeated, present(df, check.column).eqNullSafe(F.col(f"_dup{i}")), "left")
            broken = F.coalesce(F.col(f"_is_dup{i}"), F.lit(False))
        marks.append(F.when(broken, F.lit(check.label)))
    if not marks:
        return df.withColumn("_violations", F.array().cast("array<string>")).limit(0)
    flagged = marked.withColumn("_violations", F.array_compact(F.array(*marks)))
    return flagged.filter(F.size("_violations") > 0).select(*[col(c) for c in df.columns], "_violations")


# --- contracts ---------------------------------------------------------------

# Which dtype words belong to one family of types.
FAMILIES = {
    "datetime": ("datetime", "timestamp", "date"),
    "int": ("int", "integer", "bigint", "smallint", "tinyint", "long", "short", "byte"),
    "float": ("float", "double", "decimal", "real", "number", "numeric"),
    "bool": ("bool", "boolean"),
    "str": ("str", "string", "object", "varchar", "char", "text"),
}


def type_family(dtype: Column) -> Column:
    """The family of a dtype name such as ``int64`` or ``decimal(10,2)``; else the name."""
    word = F.regexp_extract(F.lower(F.trim(dtype)), r"^u?([a-z]+)", 1)
    family = None
    for name, words in FAMILIES.items():
        condition = word.isin(*words)
        family = F.when(condition, name) if family is None else family.when(condition, name)
    return family.otherwise(F.lower(F.trim(dtype)))


def observed_schema(tables: Mapping[str, DataFrame]) -> DataFrame:
    """``(table_name, column, dtype)`` of several frames; reads no data."""
    spark = next(iter(tables.values())).sparkSession
    rows = [(name, c, t) for name, df in tables.items() for c, t in df.dtypes]
    return spark.createDataFrame(rows, "table_name string, column string, dtype string")


def contract_report(expected: DataFrame, observed: DataFrame, strict: bool = False) -> DataFrame:
    """Where the observed schemas of many tables differ from the expected ones.

    Both sides are ``(table_name, column, dtype)``, each column listed once per
    table. One row per missing column, extra column or differing type. Types
    agree when they are of one family, or with ``strict`` when they are equal.
    A table without expected columns has no contract and satisfies it.
    """
    e = expected.select("table_name", "column", F.col("dtype").alias("expected"))
    o = observed.select("table_name", "column", F.col("dtype").alias("actual"))
    contracted = o.join(e.select("table_name").distinct(), on="table_name", how="left_semi")
    both = e.join(contracted, on=["table_name", "column"], how="full_outer")
    same = F.col("expected") == F.col("actual")
    if not strict:
        same = type_family(F.col("expected")) == type_family(F.col("actual"))
    kind = (
        F.when(F.col("actual").isNull(), "missing").when(F.col("expected").isNull(), "extra").when(~same, "dtype")
    )
    message = (
        F.when(F.col("kind") == "missing", F.format_string("missing column '%s' (expected dtype '%s')", "column", "expected"))
        .when(F.col("kind") == "extra", F.format_string("extra column not in schema: '%s'", "column"))
        .otherwise(F.format_string("column '%s': expected dtype '%s', got '%s'", "column", "expected", "actual"))
    )
    return (
        both.withColumn("kind", kind)
        .filter(F.col("kind").isNotNull())
        .select("table_name", "column", "kind", "expected", "actual", message.alias("message"))
    )


def contract_messages(df: DataFrame, expected: Mapping[str, str]) -> list[str]:
    """Contract violations of one frame as text; looks at its schema only."""

    def family(dtype: str) -> str:
        word = dtype.lower().lstrip("u").split("(")[0].rstrip("0123456789[]ns")
        whole = dtype.lower().split("(")[0].split("[")[0].rstrip("0123456789")
        for name, words in FAMILIES.items():
            if word in words or whole in words or whole.removeprefix("u") in words:
                return name
        return dtype.lower()

    actual = dict(df.dtypes)
    found = []
    for column, dtype in expected.items():
        if column not in actual:
            found.append(f"missing column '{column}' (expected dtype '{dtype}')")
        elif family(dtype) != family(actual[column]):
            found.append(f"column '{column}': expected dtype '{dtype}', got '{actual[column]}'")
    extra = sorted(set(actual) - set(expected))
    if extra:
        found.append(f"extra columns not in schema: {extra}")
    return found


def _converted(df: DataFrame, column: str, dtype: str) -> Column:
    """The value in the contracted type, NULL when it does not convert."""
    value = present(df, column)
    target = T.DataType.fromDDL(dtype)
    if isinstance(dtype_of(df, column), T.StringType) and isinstance(target, T.NumericType):
        # Most text that does not convert is sorted out without a failing cast.
        pattern = WHOLE_TEXT if isinstance(target, T.IntegralType) else NUMBER_TEXT
        return F.when(F.trim(value).rlike(pattern), F.trim(value).try_cast(target))
    return value.try_cast(target)


def contract_conformance(df: DataFrame, expected: Mapping[str, str]) -> DataFrame:
    """Per contracted column, how many values there are and how many convert to its type."""
    parts = []
    for i, (name, dtype) in enumerate(expected.items()):
        if name in df.columns:
            value = present(df, name)
            parts += [F.count(value).alias(f"v{i}"), F.count(_converted(df, name, dtype)).alias(f"c{i}")]
        else:
            parts += [F.lit(0).cast("bigint").alias(f"v{i}"), F.lit(0).cast("bigint").alias(f"c{i}")]
    measured = df.agg(F.count(F.lit(1)).alias("_rows"), *parts)
    rows = F.array(
        *[
            F.struct(
                F.lit(name).alias("column"),
                F.lit(dtype).alias("dtype"),
                F.lit(name in df.columns).alias("found"),
                F.col(f"v{i}").alias("n_values"),
                F.col(f"c{i}").alias("n_conforming"),
                (F.col(f"c{i}") / F.nullif(F.col(f"v{i}"), F.lit(0))).alias("share"),
            )
            for i, (name, dtype) in enumerate(expected.items())
        ]
    )
    return measured.select(F.inline(rows))
