"""Checks, contracts and diffs: the cases stated in the rules."""

import pytest
from pyspark.sql import functions as F

from tablecraft.operators import diff, quality
from tablecraft.operators.diff import DiffSpec, Tolerance
from tablecraft.operators.quality import Check


def found(df, *checks):
    return quality.failures(quality.dq_report(df, checks))


def test_row_count(spark):
    two, three = spark.range(2), spark.range(3)
    assert found(two, Check("row_count", min_rows=1, max_rows=10)) == []
    assert found(two, Check("row_count", min_rows=5)) == ["[row_count] row count 2 < min 5"]
    assert found(three, Check("row_count", name="few", max_rows=1)) == ["[few] row count 3 > max 1"]


def test_null_rate(spark):
    df = spark.createDataFrame([(None,), (float("nan"),), (1.0,)], "val double")
    assert found(df, Check("null_rate", "val", max_null_rate=0.7)) == []
    assert found(df, Check("null_rate", "val", max_null_rate=0.1)) == ["[null_rate:val] null rate 66.667% > max 10.000%"]
    assert found(df, Check("null_rate", "zz", max_null_rate=0.1)) == ["[null_rate] column 'zz' not found"]
    assert found(df.limit(0), Check("null_rate", "val", max_null_rate=0.0)) == []


def test_value_range(spark):
    df = spark.createDataFrame([(-1.0, "a", "3"), (9.5, "b", "4"), (float("nan"), None, None)], "x double, s string, n string")
    assert found(df, Check("value_range", "x", min_value=-1, max_value=10)) == []
    assert found(df, Check("value_range", "x", min_value=0, max_value=5)) == [
        "[value_range:x] min value -1.0 < 0.0",
        "[value_range:x] max value 9.5 > 5.0",
    ]
    assert found(df, Check("value_range", "s", min_value=0)) == ["[value_range:s] could not compare values (non-numeric?)"]
    assert found(df, Check("value_range", "n", min_value=0, max_value=4)) == []
    text = df.sparkSession.createDataFrame([("9",), ("10",), (None,)], "t string")
    assert found(text, Check("value_range", "t", max_value=9.5)) == ["[value_range:t] max value 10.0 > 9.5"]
    assert [r.t for r in quality.dq_violations(text, [Check("value_range", "t", max_value=9.5)]).collect()] == ["10"]
    assert found(df.filter("false"), Check("value_range", "x", min_value=0)) == []


def test_unique_counts_missing_as_one_value(spark):
    df = spark.createDataFrame([(1,), (1,), (None,), (None,), (2,)], "id int")
    assert found(df, Check("unique", "id")) == ["[unique:id] 2 duplicate value(s) found"]
    assert found(spark.range(3), Check("unique", "id")) == []


def test_report_scans_once(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(100).selectExpr("id", "id * 2 AS v", "'x' AS unused").write.parquet(path)
    df = spark.read.parquet(path)
    checks = [Check("row_count", min_rows=1), Check("null_rate", "v", max_null_rate=0), Check("value_range", "id", min_value=0)]
    plan = quality.dq_report(df, checks)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "unused" not in plan
    with_unique = quality.dq_report(df, [*checks, Check("unique", "id")])
    assert with_unique._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1


def test_raise_and_bad_checks(spark):
    with pytest.raises(quality.CheckFailure, match="row count 2"):
        quality.raise_on_failure(quality.dq_report(spark.range(2), [Check("row_count", min_rows=3)]))
    with pytest.raises(ValueError):
        Check("null_rate")
    with pytest.raises(ValueError):
        Check("other")


def test_observe(spark):
    df = spark.createDataFrame([(1.0,), (None,)], "v double")
    watched, seen = quality.dq_observe(df, [Check("null_rate", "v"), Check("value_range", "v")])
    assert watched.count() == 2
    assert seen.get == {"_rows": 2, "_null0": 0.5, "_min1": 1.0, "_max1": 1.0, "_odd1": 0}
    with pytest.raises(ValueError):
        quality.dq_observe(df, [Check("unique", "v")])


def test_violations(spark):
    df = spark.createDataFrame([(1, 5.0), (1, 50.0), (2, None), (None, 1.0), (None, 2.0)], "k int, v double")
    checks = [Check("null_rate", "v"), Check("value_range", "v", max_value=10), Check("unique", "k")]
    got = {(r.k, r.v): r._violations for r in quality.dq_violations(df, checks).collect()}
    assert got == {
        (1, 5.0): ["unique"],
        (1, 50.0): ["value_range", "unique"],
        (2, None): ["null_rate"],
        (None, 1.0): ["unique"],
        (None, 2.0): ["unique"],
    }


def test_contract_messages(spark):
    df = spark.createDataFrame([(1, "a", 2.0)], "id long, name string, extra double")
    assert quality.contract_messages(df, {"id": "int64", "name": "object", "extra": "float64"}) == []
    assert quality.contract_messages(df, {"id": "float", "gone": "str"}) == [
        "column 'id': expected dtype 'float', got 'bigint'",
        "missing column 'gone' (expected dtype 'str')",
        "extra columns not in schema: ['extra', 'name']",
    ]


def test_contract_report_families(spark, rows):
    columns = "table_name string, column string, dtype string"
    expected = spark.createDataFrame(
        [("t", "a", "int64"), ("t", "b", "datetime64[ns]"), ("t", "c", "str"), ("t", "d", "uint8")], columns
    )
    observed = spark.createDataFrame(
        [("t", "a", "bigint"), ("t", "b", "timestamp"), ("t", "c", "double"), ("t", "e", "int"), ("free", "z", "int")], columns
    )
    out = quality.contract_report(expected, observed).select("table_name", "column", "kind")
    assert rows(out) == [("t", "c", "dtype"), ("t", "d", "missing"), ("t", "e", "extra")]
    strict = quality.contract_report(expected, observed, strict=True)
    assert strict.filter("kind = 'dtype'").count() == 3


def test_observed_schema_and_conformance(spark, rows):
    df = spark.createDataFrame([("1",), ("x",), (None,)], "a string")
    assert rows(quality.observed_schema({"t": df})) == [("t", "a", "string")]
    out = quality.contract_conformance(df, {"a": "int", "b": "int"})
    assert rows(out) == [("a", "int", True, 2, 1, 0.5), ("b", "int", False, 0, 0, None)]


# --- diffs ---------------------------------------------------------------------


def tables(spark, left, right, schema="k int, v double"):
    return spark.createDataFrame(left, schema), spark.createDataFrame(right, schema)


def statuses(p, s, spec):
    return {r.k: r._diff_status for r in diff.diff_tables(p, s, spec).collect()}


def summary(p, s, spec):
    return diff.diff_summary(diff.diff_tables(p, s, spec), spec).first().asDict()


def test_identical_tables_pass(spark):
    p, s = tables(spark, [(1, 1.0), (2, None)], [(1, 1.0), (2, None)])
    out = summary(p, s, DiffSpec(["k"], default_tolerance=Tolerance(absolute=0)))
    assert (out["status"], out["matched"], out["max_diff_v"]) == ("pass", 2, 0.0)


def test_one_sided_rows_and_null_keys(spark):
    p, s = tables(spark, [(1, 1.0), (None, 2.0)], [(2, 1.0), (None, 2.5)])
    spec = DiffSpec(["k"], default_tolerance=Tolerance(absolute=1))
    assert statuses(p, s, spec) == {1: "primary_only", 2: "shadow_only", None: "within_tolerance"}
    out = summary(p, s, spec)
    assert (out["status"], out["total_primary"], out["total_shadow"], out["primary_only"], out["shadow_only"]) == ("breach", 2, 2, 1, 1)


def test_bounds_are_not_breached_when_met(spark):
    p, s = tables(spark, [(1, 10.0), (2, 10.0), (3, 0.0)], [(1, 11.0), (2, 11.5), (3, 5.0)])
    assert statuses(p, s, DiffSpec(["k"], default_tolerance=Tolerance(absolute=1.0))) == {1: "within_tolerance", 2: "breach", 3: "breach"}
    # A relative difference to zero is undefined.
    assert statuses(p, s, DiffSpec(["k"], default_tolerance=Tolerance(relative=0.1))) == {1: "within_tolerance", 2: "breach", 3: "within_tolerance"}


def test_column_override_and_no_tolerance(spark):
    p, s = tables(spark, [(1, 1.0)], [(1, 100.0)])
    assert statuses(p, s, DiffSpec(["k"])) == {1: "within_tolerance"}
    assert summary(p, s, DiffSpec(["k"]))["status"] == "warn"
    assert statuses(p, s, DiffSpec(["k"], exact=True)) == {1: "breach"}
    spec = DiffSpec(["k"], {"v": Tolerance(absolute=1000)}, Tolerance(absolute=0))
    assert statuses(p, s, spec) == {1: "within_tolerance"}


def test_one_value_missing(spark):
    p, s = tables(spark, [(1, None), (2, None)], [(1, 3.0), (2, None)])
    out = {r.k: (r._abs_v, r._rel_v) for r in diff.diff_tables(p, s, DiffSpec(["k"])).collect()}
    assert out == {1: (3.0, None), 2: (None, None)}


def test_text_is_shown_and_compared_on_request(spark):
    p, s = tables(spark, [(1, "a")], [(1, "b")], "k int, t string")
    assert statuses(p, s, DiffSpec(["k"])) == {1: "within_tolerance"}
    spec = DiffSpec(["k"], compare_text=True)
    assert statuses(p, s, spec) == {1: "breach"} and summary(p, s, spec)["status"] == "breach"


def test_row_count_rule(spark):
    p, s = tables(spark, [(i, 1.0) for i in range(10)], [(i, 1.0) for i in range(9)])
    assert summary(p, s, DiffSpec(["k"]))["row_count_breached"] is True
    assert summary(p, s, DiffSpec(["k"], row_count_tolerance_pct=0.1))["row_count_breached"] is False
    assert summary(p, s, DiffSpec(["k"], compare_row_count=False))["row_count_breached"] is False
    empty = summary(p.limit(0), s, DiffSpec(["k"]))
    assert (empty["row_count_breached"], empty["status"], empty["total_primary"]) == (False, "breach", 0)


def test_pct_rows_allowed(spark):
    p, s = tables(spark, [(i, 1.0) for i in range(10)], [(i, 1.0 if i else 9.0) for i in range(10)])
    strict = DiffSpec(["k"], default_tolerance=Tolerance(absolute=1))
    loose = DiffSpec(["k"], default_tolerance=Tolerance(absolute=1, pct_rows_allowed=0.1))
    assert summary(p, s, strict)["status"] == "breach"
    assert (summary(p, s, loose)["status"], summary(p, s, loose)["breach_count"]) == ("warn", 1)


def test_repeated_keys_match_one_to_one(spark, rows):
    p, s = tables(spark, [(1, 1.0), (1, 1.0), (1, 5.0), (2, 1.0)], [(1, 1.0), (1, 6.0), (2, 1.0)])
    out = diff.diff_tables(p, s, DiffSpec(["k"], exact=True)).select("k", "p_v", "s_v", "_diff_status")
    assert rows(out) == sorted(
        [(1, 1.0, 1.0, "within_tolerance"), (1, 1.0, 6.0, "breach"), (1, 5.0, None, "primary_only"), (2, 1.0, 1.0, "within_tolerance")],
        key=repr,
    )


def test_a_hot_key_is_not_multiplied(spark):
    p = spark.range(3000).select(F.when(F.col("id") < 2000, 0).otherwise(F.col("id")).alias("k"), (F.col("id") % 7).alias("v"))
    out = diff.diff_tables(p, p.withColumn("v", F.col("v") + 0), DiffSpec(["k"], exact=True))
    assert out.count() == 3000 and out.filter("_diff_status <> 'within_tolerance'").isEmpty()


def test_mixed_number_types(spark):
    p = spark.createDataFrame([(1, 2**62)], "k int, v long")
    s = spark.createDataFrame([(1, -(2**62))], "k int, v long")
    assert int(diff.diff_tables(p, s, DiffSpec(["k"])).first()._abs_v) == 2**63
    decimal = s.select("k", F.lit("1.5").cast("decimal(5,2)").alias("v"))
    whole = p.select("k", F.lit(1).cast("long").alias("v"))
    assert float(diff.diff_tables(whole, decimal, DiffSpec(["k"])).first()._abs_v) == 0.5


def test_summary_is_one_aggregate(spark):
    p, s = tables(spark, [(1, 1.0)], [(1, 1.0)])
    spec = DiffSpec(["k"], unique_keys=True)
    plan = diff.diff_summary(diff.diff_tables(p, s, spec), spec)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1 and plan.count("Join FullOuter") == 1


def test_shadow_run_and_breach(spark):
    data = spark.createDataFrame([(1, 1.0), (2, 2.0)], "k int, v double")
    spec = DiffSpec(["k"], default_tolerance=Tolerance(absolute=0.5))
    out = diff.shadow_run(
        lambda i: i["t"], lambda i: i["t"], {"t": data}, spec,
        "SELECT * FROM {input} WHERE k = 1", "SELECT k, v + 1 AS v FROM {output}",
    )
    assert {r.k: r._diff_status for r in out.collect()} == {1: "breach", 2: "primary_only"}
    table = diff.diff_summary(out, spec)
    assert diff.check_breach(table) is table
    with pytest.raises(diff.DiffBreach, match="1 breaching rows, 1 primary-only rows") as caught:
        diff.check_breach(table, "fail_node")
    assert caught.value.summary["matched"] == 1
    with pytest.raises(ValueError, match="single input"):
        diff.shadow_run(lambda i: i["t"], lambda i: i["t"], {"t": data, "u": data}, spec, "SELECT 1")
    with pytest.raises(ValueError):
        DiffSpec([])


def test_sample(spark):
    p, s = tables(spark, [(i, 0.0) for i in range(20)], [(i, float(i)) for i in range(20)])
    out = diff.diff_tables(p, s, DiffSpec(["k"], default_tolerance=Tolerance(absolute=10)))
    assert [r.k for r in diff.diff_sample(out, ["k"], 3).collect()] == [11, 12, 13]


# --- diffs of tables that are nearly alike ------------------------------------------------


def alike(spark, n=60_000):
    df = spark.range(n).select(F.when(F.col("id") != 5, F.col("id")).alias("k"), (F.col("id") % 97 * 1.0).alias("v"), F.lit(None).cast("int").alias("none"), F.col("id").cast("string").alias("t"))
    changed = df.withColumn("v", F.when(F.col("k") == 41_000, F.col("v") + 3).otherwise(F.col("v")))
    return df, changed


def test_one_changed_key_leaves_all_other_buckets_out(spark):
    """Of 60,000 rows only those of one fine bucket meet in the join, and the summary is that of the whole."""
    spec = DiffSpec(["k"], default_tolerance=Tolerance(absolute=1.0))
    df, changed = alike(spark)
    part = diff.diff_changed(df, changed, spec)
    assert part.diff.count() <= 3 and part.equal_rows >= 59_997 and part.filled == ("v",)
    assert [(r.k, r._abs_v, r._diff_status) for r in part.diff.filter("_abs_v > 0").collect()] == [(41_000, 3.0, "breach")]
    assert diff.diff_summary(part, spec).collect() == diff.diff_summary(diff.diff_tables(df, changed, spec), spec).collect()


@pytest.mark.parametrize("kind", ["same", "missing key", "extra", "within", "copies", "swapped copies", "all", "empty"])
def test_summary_of_a_changed_diff_is_that_of_the_whole(spark, kind):
    spec = DiffSpec(["k"], default_tolerance=Tolerance(absolute=1.0), compare_text=True)
    left, _ = alike(spark, 400)
    right = {
        "same": lambda: left,
        "missing key": lambda: left.withColumn("v", F.when(F.col("k").isNull(), 1e6).otherwise(F.col("v"))),
        "extra": lambda: left.filter("k > 20").unionByName(left.filter("k = 30").withColumn("k", F.lit(9_999).cast("long"))),
        "within": lambda: left.withColumn("v", F.when(F.col("k") == 77, F.col("v") + 0.5).otherwise(F.col("v"))),
        "copies": lambda: left.unionByName(left.filter("k < 9")),
        "swapped copies": lambda: left.unionByName(left.filter("k = 3")).unionByName(left.filter("k = 3")),
        "all": lambda: left.withColumn("v", F.col("v") + 2),
        "empty": lambda: left.limit(0),
    }[kind]()
    if kind == "swapped copies":  # twice one row against twice another: equal in number, and in exclusive ors
        left = left.unionByName(left.filter("k = 3").withColumn("v", F.lit(-50.0))).unionByName(left.filter("k = 3").withColumn("v", F.lit(-50.0)))
    part = diff.diff_changed(left, right, spec, buckets=16)
    assert diff.diff_summary(part, spec).collect() == diff.diff_summary(diff.diff_tables(left, right, spec), spec).collect()
    assert part.equal_rows == 400 if kind == "same" else part.equal_rows < 400
