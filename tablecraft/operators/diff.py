"""Keyed comparison of two tables with tolerances, for checking a rewrite.

The primary is the table in use, the shadow its alternative.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import all_of, any_of, col, dtype_of, present, require
from ..functions.ordering import row_numbers
from ..session import settle
from .filters import union_all

_COPY = "_copy"

SUMMARY_COLUMNS = (
    "node_id", "status", "total_primary", "total_shadow", "matched", "primary_only",
    "shadow_only", "breach_count", "within_tolerance_count", "row_count_breached",
)


@dataclass(frozen=True)
class Tolerance:
    """Largest allowed difference, absolute, relative to the primary, or both.

    ``pct_rows_allowed`` is the share of matched rows that may be over it
    before the column counts as breached.
    """

    absolute: float | None = None
    relative: float | None = None
    pct_rows_allowed: float = 0.0


@dataclass(frozen=True)
class DiffSpec:
    """How to compare two tables."""

    key_columns: Sequence[str]
    tolerances: Mapping[str, Tolerance] = field(default_factory=dict)
    default_tolerance: Tolerance = Tolerance()
    compare_row_count: bool = True
    row_count_tolerance_pct: float = 0.0
    exact: bool = False
    compare_text: bool = False
    unique_keys: bool = False

    def __post_init__(self) -> None:
        if not self.key_columns:
            raise ValueError("a diff requires at least one key column")

    def tolerance(self, column: str) -> Tolerance:
        found = self.tolerances.get(column, self.default_tolerance)
        if self.exact and found.absolute is None and found.relative is None:
            return Tolerance(absolute=0.0, pct_rows_allowed=found.pct_rows_allowed)
        return found


class DiffBreach(Exception):
    """Raised on request when a diff is breached; holds its summary row."""

    def __init__(self, summary: Mapping[str, object]) -> None:
        super().__init__(
            f"{summary['breach_count']} breaching rows, {summary['primary_only']} primary-only rows, "
            f"{summary['shadow_only']} shadow-only rows"
        )
        self.summary = dict(summary)


def compared_columns(primary: DataFrame, shadow: DataFrame, spec: DiffSpec) -> list[str]:
    """Columns of both tables that are not keys, in the order of the primary."""
    return [c for c in primary.columns if c in shadow.columns and c not in spec.key_columns]


def numeric_columns(primary: DataFrame, shadow: DataFrame, spec: DiffSpec) -> list[str]:
    return [
        c
        for c in compared_columns(primary, shadow, spec)
        if isinstance(dtype_of(primary, c), T.NumericType) and isinstance(dtype_of(shadow, c), T.NumericType)
    ]


def _has_repeated_keys(df: DataFrame, keys: Sequence[str]) -> bool:
    counted = df.groupBy(*[col(k) for k in keys]).agg(F.count(F.lit(1)).alias("_n"))
    return not counted.filter(F.col("_n") > 1).isEmpty()


def _with_copy_numbers(df: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Number the rows of one key by their values.

    Rows that agree in all compared columns are interchangeable, but numbers
    must tell them apart. These are written down first: made up again for a
    lost task they could differ, and a row could be counted twice.
    """
    listed = settle(df.select(*[col(c) for c in [*keys, *values]]).withColumn("_tie", F.monotonically_increasing_id()), "copies")
    order = [col(c).asc_nulls_last() for c in values] + [F.col("_tie").asc()]
    return row_numbers(listed, keys, order, _COPY).drop("_tie")


def diff_tables(primary: DataFrame, shadow: DataFrame, spec: DiffSpec) -> DataFrame:
    """Both tables side by side, one row per key, with differences and a status.

    Per compared column there are ``p_…`` and ``s_…``, and for numbers the
    absolute and relative difference ``_abs_…`` and ``_rel_…``. ``_diff_status``
    is ``primary_only``, ``shadow_only``, ``breach`` or ``within_tolerance``.

    Keys are expected to be unique, which is checked on the key columns unless
    the specification vouches for it. Where a key is repeated, its copies are
    matched one to one in the order of their values and the surplus is
    one-sided; they are never multiplied with each other.
    """
    keys = list(spec.key_columns)
    require(primary, keys, "diff_tables")
    require(shadow, keys, "diff_tables")
    values = compared_columns(primary, shadow, spec)
    numbers = numeric_columns(primary, shadow, spec)

    p = primary.select(*[col(c) for c in [*keys, *values]])
    s = shadow.select(*[col(c) for c in [*keys, *values]])
    match = keys
    if not spec.unique_keys and (_has_repeated_keys(p, keys) or _has_repeated_keys(s, keys)):
        p, s = _with_copy_numbers(p, keys, values), _with_copy_numbers(s, keys, values)
        match = [*keys, _COPY]

    # Names of their own on each side, as both may come from the same table.
    p = p.select(
        *[col(k).alias(f"_pk{i}") for i, k in enumerate(match)],
        *[col(c).alias(f"p_{c}") for c in values],
        F.lit(True).alias("_in_p"),
    )
    s = s.select(
        *[col(k).alias(f"_sk{i}") for i, k in enumerate(match)],
        *[col(c).alias(f"s_{c}") for c in values],
        F.lit(True).alias("_in_s"),
    )
    joined = p.join(s, all_of(F.col(f"_pk{i}").eqNullSafe(F.col(f"_sk{i}")) for i in range(len(match))), "full_outer")
    table = joined.select(
        *[F.coalesce(f"_pk{i}", f"_sk{i}").alias(k) for i, k in enumerate(keys)],
        *[col(f"{side}_{c}") for c in values for side in "ps"],
        F.coalesce("_in_p", F.lit(False)).alias("_in_p"),
        F.coalesce("_in_s", F.lit(False)).alias("_in_s"),
    )

    for c in numbers:
        left, right = _common_numbers(table, c)
        gap = F.abs(F.coalesce(left, F.lit(0)) - F.coalesce(right, F.lit(0)))
        base = F.coalesce(left, F.lit(0))
        table = table.withColumns(
            {
                f"_abs_{c}": F.when(left.isNotNull() | right.isNotNull(), gap),
                f"_rel_{c}": F.when(base != 0, gap / F.abs(base)),
            }
        )

    broken = any_of(_over(c, spec.tolerance(c)) for c in numbers)
    if spec.compare_text:
        for c in values:
            if c not in numbers:
                broken = broken | ~col(f"p_{c}").eqNullSafe(col(f"s_{c}"))
    status = (
        F.when(~F.col("_in_p"), "shadow_only")
        .when(~F.col("_in_s"), "primary_only")
        .when(broken, "breach")
        .otherwise("within_tolerance")
    )
    columns = [col(k) for k in keys]
    for c in values:
        columns += [col(f"p_{c}"), col(f"s_{c}")]
        if c in numbers:
            columns += [col(f"_abs_{c}"), col(f"_rel_{c}")]
    return table.select(
        *columns,
        (F.col("_in_p") & F.col("_in_s")).cast("int").alias("_match_key"),
        status.alias("_diff_status"),
    )


#: Buckets of keys whose digests are compared first; those that differ are cut into as many again.
BUCKETS = 1024
_HASH, _BUCKET = "_key_hash", "_bucket"


@dataclass(frozen=True)
class ChangedDiff:
    """The diff of the buckets of keys that differ, and what is known of the others.

    ``equal_rows`` rows on each side lie in buckets that are alike; ``filled`` names the numeric columns that have a
    value in one of them.
    """

    diff: DataFrame
    equal_rows: int
    filled: tuple[str, ...]


def _digests(df: DataFrame, keys: Sequence[str], values: Sequence[str], numbers: Sequence[str], buckets: int, side: str) -> DataFrame:
    """Per bucket the number of rows, and sums of hashes of them; folded before the shuffle."""
    first = F.xxhash64(*[col(c) for c in [*keys, *values]])
    second = F.xxhash64(F.lit(1), *[col(c) for c in [*values, *keys]])
    small = F.lit(2**31).cast("long")
    return df.groupBy(F.pmod(_HASH, F.lit(buckets).cast("long")).alias(_BUCKET)).agg(
        F.count(F.lit(1)).alias(f"_{side}rows"),
        # Equal rows cancel out in the exclusive or, but not in the sums; these cannot overflow.
        F.bit_xor(first).alias(f"_{side}xor"),
        F.sum(F.pmod(first, small)).alias(f"_{side}one"),
        F.sum(F.pmod(second, small)).alias(f"_{side}two"),
        *[F.count(present(df, c)).alias(f"_{side}n{i}") for i, c in enumerate(numbers)],
    )


def _compared(p: DataFrame, s: DataFrame, keys: Sequence[str], values: Sequence[str], numbers: Sequence[str], buckets: int) -> DataFrame:
    """``(_bucket, _same, rows, n0, …)`` for the buckets of both tables."""
    a, b = _digests(p, keys, values, numbers, buckets, "p"), _digests(s, keys, values, numbers, buckets, "s")
    same = all_of(F.col(f"_p{c}") == F.col(f"_s{c}") for c in ("rows", "xor", "one", "two"))
    counts = [F.col("_prows").alias("rows"), *[F.col(f"_pn{i}").alias(f"n{i}") for i in range(len(numbers))]]
    return settle(a.join(b, on=_BUCKET, how="full_outer").select(_BUCKET, F.coalesce(same, F.lit(False)).alias("_same"), *counts), "digests")


def diff_changed(primary: DataFrame, shadow: DataFrame, spec: DiffSpec, buckets: int = BUCKETS) -> ChangedDiff:
    """:func:`diff_tables` for tables that are nearly alike: only buckets of keys that differ are joined.

    Keys are dealt to buckets by hash. Both sides are read once to compare the buckets' digests, which takes a
    row per bucket and task in the shuffle. Buckets that differ are cut finer and compared again; what is left goes to
    the join. Rows that differ in the type of a column count as different, and so do 0.0 and -0.0: the join
    then compares them. :func:`diff_summary` takes the result as it is and gives what it gives for a whole diff.
    """
    keys = list(spec.key_columns)
    require(primary, keys, "diff_changed")
    require(shadow, keys, "diff_changed")
    values, numbers = compared_columns(primary, shadow, spec), numeric_columns(primary, shadow, spec)
    hashed = F.xxhash64(*[col(k) for k in keys])
    p, s = (df.select(*[col(c) for c in [*keys, *values]]) for df in (primary, shadow))
    if any(isinstance(dtype_of(df, c), (T.MapType, T.VariantType)) for df in (p, s) for c in [*keys, *values]):
        return ChangedDiff(diff_tables(p, s, spec), 0, ())  # such values have no hash
    p, s = p.withColumn(_HASH, hashed), s.withColumn(_HASH, hashed)
    equal, filled = 0, set()
    for count in (buckets, buckets * buckets):
        compared = _compared(p, s, keys, values, numbers, count)
        alike = compared.filter("_same").agg(F.sum("rows"), *[F.sum(f"n{i}") for i in range(len(numbers))]).first()
        equal += alike[0] or 0
        filled |= {c for c, n in zip(numbers, alike[1:]) if n}
        differing = compared.filter("NOT _same").select(_BUCKET)
        # At most a number per bucket; Spark broadcasts them where their size allows.
        p, s = (
            df.withColumn(_BUCKET, F.pmod(_HASH, F.lit(count).cast("long"))).join(differing, on=_BUCKET, how="left_semi").drop(_BUCKET)
            for df in (p, s)
        )
    return ChangedDiff(diff_tables(p.drop(_HASH), s.drop(_HASH), spec), equal, tuple(c for c in numbers if c in filled))


def _common_numbers(table: DataFrame, column: str) -> tuple[Column, Column]:
    """Both values in one numeric type, NaN as missing: decimals and whole
    numbers keep their digits, and anything next to a fraction becomes a double."""
    sides = []
    types = [dtype_of(table, f"{side}_{column}") for side in "ps"]
    fractional = any(isinstance(t, (T.FloatType, T.DoubleType)) for t in types)
    for side in "ps":
        value = col(f"{side}_{column}")
        if fractional:
            value = value.cast("double")
            value = F.when(~F.isnan(value), value)
        elif all(isinstance(t, T.IntegralType) for t in types):
            # One digit more than a long, so that a difference cannot overflow.
            value = value.cast("decimal(20,0)")
        sides.append(value)
    return sides[0], sides[1]


def _over(column: str, tolerance: Tolerance) -> Column:
    over = F.lit(False)
    if tolerance.absolute is not None:
        over = over | F.coalesce(col(f"_abs_{column}") > tolerance.absolute, F.lit(False))
    if tolerance.relative is not None:
        over = over | F.coalesce(col(f"_rel_{column}") > tolerance.relative, F.lit(False))
    return over


def _diffed_numbers(diff: DataFrame) -> list[str]:
    """The compared numeric columns of a diff table, from its column names."""
    names = set(diff.columns)
    return [c[2:] for c in diff.columns if c.startswith("p_") and {f"_abs_{c[2:]}", f"s_{c[2:]}"} <= names]


def diff_summary(diff: DataFrame | ChangedDiff, spec: DiffSpec, node_id: str = "node") -> DataFrame:
    """One row of counts, largest differences and a status, from one aggregate.

    Takes the result of :func:`diff_tables`, or that of :func:`diff_changed`.

    ``pass``: no difference. ``warn``: differences, all within tolerance.
    ``breach``: one-sided rows, a breached column or a breached row count.
    """
    equal, filled = F.lit(0).cast("long"), ()
    if isinstance(diff, ChangedDiff):
        equal, filled, diff = F.lit(diff.equal_rows).cast("long"), diff.filled, diff.diff
    numbers = _diffed_numbers(diff)
    status, matched = F.col("_diff_status"), F.col("_match_key") == 1
    parts = [
        (F.count_if(status != "shadow_only") + equal).alias("total_primary"),
        (F.count_if(status != "primary_only") + equal).alias("total_shadow"),
        (F.count_if(matched) + equal).alias("matched"),
        F.count_if(status == "primary_only").alias("primary_only"),
        F.count_if(status == "shadow_only").alias("shadow_only"),
        F.count_if(status == "breach").alias("breach_count"),
        (F.count_if(status == "within_tolerance") + equal).alias("within_tolerance_count"),
    ]
    for i, c in enumerate(numbers):
        largest = F.max(F.when(matched, col(f"_abs_{c}"))).cast("double")
        parts.append((F.coalesce(largest, F.lit(0.0)) if c in filled else largest).alias(f"max_diff_{c}"))
        parts.append(F.count_if(matched & _over(c, spec.tolerance(c))).alias(f"_over{i}"))
    text = _text_difference(diff, numbers) if spec.compare_text else F.lit(False)
    parts.append(F.count_if(matched & text).alias("_text"))
    counts = diff.agg(*parts)

    column_breached = any_of(
        F.col(f"_over{i}") > spec.tolerance(c).pct_rows_allowed * F.col("matched") for i, c in enumerate(numbers)
    ) | (F.col("_text") > 0)
    gap = F.abs(F.col("total_primary") - F.col("total_shadow")) / F.nullif(F.col("total_primary"), F.lit(0))
    rows_breached = F.coalesce(gap > spec.row_count_tolerance_pct, F.lit(False)) & F.lit(spec.compare_row_count)
    one_sided = (F.col("primary_only") > 0) | (F.col("shadow_only") > 0)
    differs = any_of(F.coalesce(col(f"max_diff_{c}") > 0, F.lit(False)) for c in numbers)
    return (
        counts.withColumn("node_id", F.lit(node_id))
        .withColumn("row_count_breached", rows_breached)
        .withColumn(
            "status",
            F.when(column_breached | F.col("row_count_breached") | one_sided, "breach")
            .when(differs, "warn")
            .otherwise("pass"),
        )
        .select(*SUMMARY_COLUMNS, *[col(f"max_diff_{c}") for c in numbers])
    )


def _text_difference(diff: DataFrame, numbers: Sequence[str]) -> Column:
    others = [c[2:] for c in diff.columns if c.startswith("p_") and c[2:] not in numbers and f"s_{c[2:]}" in diff.columns]
    return any_of(~col(f"p_{c}").eqNullSafe(col(f"s_{c}")) for c in others)


def diff_sample(diff: DataFrame, order_by: Sequence[str], limit: int = 100) -> DataFrame:
    """The first ``limit`` rows that breach or are one-sided."""
    bad = diff.filter(F.col("_diff_status").isin("breach", "primary_only", "shadow_only"))
    return bad.orderBy(*[col(c).asc_nulls_last() for c in order_by]).limit(limit)


Step = Callable[[Mapping[str, DataFrame]], DataFrame]


def shadow_run(
    primary: Step,
    shadow: Step,
    inputs: Mapping[str, DataFrame],
    spec: DiffSpec,
    preprocess_sql: str | None = None,
    postprocess_sql: str | None = None,
) -> DataFrame:
    """Run two implementations on the same inputs and diff their results.

    ``preprocess_sql`` selects from ``{input}`` before the shadow runs and
    needs a single input; ``postprocess_sql`` selects from ``{output}`` after.
    """
    given = dict(inputs)
    if preprocess_sql:
        if len(given) != 1:
            raise ValueError("shadow_run: preprocess_sql needs a single input")
        ((name, frame),) = given.items()
        given = {name: frame.sparkSession.sql(preprocess_sql, input=frame)}
    result = shadow(given)
    if postprocess_sql:
        result = result.sparkSession.sql(postprocess_sql, output=result)
    return diff_tables(primary(inputs), result, spec)


def check_breach(summary: DataFrame, on_breach: str = "warn") -> DataFrame:
    """The summary; raises :class:`DiffBreach` for a breach unless it is only to warn."""
    if on_breach not in ("warn", "fail_node", "fail_pipeline"):
        raise ValueError("on_breach must be 'warn', 'fail_node' or 'fail_pipeline'")
    if on_breach != "warn":
        row = summary.first().asDict()
        if row["status"] == "breach":
            raise DiffBreach(row)
    return summary


def shadow_overview(summaries: Sequence[DataFrame], expected: DataFrame) -> DataFrame:
    """One row per expected ``node_id``; ``not_run`` where there is no summary."""
    known = union_all(
        *[s.select("node_id", "status", "total_primary", "total_shadow", "matched", "breach_count") for s in summaries]
    )
    counts = ("total_primary", "total_shadow", "matched", "breach_count")
    listed = expected.select(
        "node_id", F.lit("not_run").alias("status"), *[F.lit(None).cast("bigint").alias(c) for c in counts]
    )
    both = known.withColumn("_run", F.lit(True)).unionByName(listed.withColumn("_run", F.lit(False)))
    last = both.groupBy("node_id").agg(
        F.max_by(F.struct("status", *counts), "_run").alias("_s"), F.bool_or(~F.col("_run")).alias("_expected")
    )
    return last.filter("_expected").select("node_id", "_s.*")
