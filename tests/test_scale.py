"""What plans look like: pushdown, pruning, partial limits, and skewed keys."""

import contextlib

import pytest
from pyspark.sql import functions as F

from tablecraft.operators import cube, filters, joins, quality, windows
from tablecraft.operators.quality import Check
from tablecraft.plans import provenance, runlog

FOLDER = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def read(spark, name):
    return spark.read.parquet(f"{FOLDER}/{name}.parquet")


def test_filters_and_columns_reach_the_scan(spark):
    orders = read(spark, "orders").select("o_orderkey", "o_orderdate")
    plan = plan_of(filters.filter_by_date(orders, "o_orderdate", "1998-06-01"))
    assert "GreaterThanOrEqual(o_orderdate,1998-06-01" in plan and "o_totalprice" not in plan
    import datetime

    plan = plan_of(filters.filter_recent(orders, "o_orderdate", 30, datetime.date(1999, 1, 1)))
    assert "GreaterThanOrEqual(o_orderdate,1998-12-02" in plan
    plan = plan_of(runlog.list_runs(read(spark, "events"), status="error", status_col="event_type", created_at="ts"))
    assert "EqualTo(event_type,error)" in plan
    plan = plan_of(runlog.list_runs(read(spark, "events"), status="error", status_col="event_type", created_at="ts", limit=100))
    assert "EqualTo(event_type,error)" in plan and "TakeOrderedAndProject" in plan


def test_best_rows_are_cut_before_the_shuffle(spark):
    lines = read(spark, "lineitem")
    for df in (
        windows.top_n_by_group(lines, "l_returnflag", "l_extendedprice", 3),
        windows.deduplicate_by_key(lines, "l_orderkey", "l_shipdate"),
    ):
        plan = plan_of(df)
        assert plan.count("WindowGroupLimit") == 2
        below = plan[plan.index("Exchange") :]
        assert "WindowGroupLimit" in below
    assert "TakeOrderedAndProject" in plan_of(windows.top_n(lines, 5, "l_quantity"))


def test_folding_combines_before_the_shuffle(spark):
    folded = runlog.fold_status(read(spark, "events"), "user_id", ["ts", "event_id"], "event_type", ["value"])
    plan = plan_of(folded)
    assert "partial_max_by" in plan[plan.index("Exchange") :] and "Window" not in plan


def test_no_query_multiplies_rows_blindly(spark):
    """No cross product in the plan of any query that is built without running jobs first."""
    from workload import QUERIES

    for name in ("contract_report", "diff_tables", "compute_pnl", "customer_sales", "cube_query", "latest_per_key", "not_completed"):
        plan = plan_of(QUERIES[name](spark, FOLDER))
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name


@contextlib.contextmanager
def settings(spark, **values):
    names = {k.replace("__", "."): v for k, v in values.items()}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k in names:
            spark.conf.unset(k)


SKEW = {
    "spark__sql__autoBroadcastJoinThreshold": "-1",
    "spark__sql__adaptive__autoBroadcastJoinThreshold": "-1",
    "spark__sql__adaptive__skewJoin__skewedPartitionThresholdInBytes": "10KB",
    "spark__sql__adaptive__skewJoin__skewedPartitionFactor": "2",
    "spark__sql__adaptive__advisoryPartitionSizeInBytes": "10KB",
    "spark__sql__adaptive__coalescePartitions__enabled": "false",
}


@pytest.fixture
def hot(spark, tmp_path):
    """A third of all rows share one key."""
    path = str(tmp_path / "hot")
    key = F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 1000)
    spark.range(0, 60000, 1, 8).select("id", key.alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("pad")).write.parquet(path)
    return spark.read.parquet(path)


def joined_rows(df):
    """Run a frame and return its final plan and row count."""
    rows = df.collect()
    return plan_of(df), len(rows)


def test_hot_keys_are_split_in_joins(spark, hot):
    with settings(spark, **SKEW):
        prices = spark.range(1000).select(F.col("id").cast("string").alias("symbol"), (F.col("id") * 1.0).alias("price_usd"))
        positions = hot.select("id", "pad", F.col("k").cast("string").alias("symbol"), F.lit(1.0).alias("quantity"), F.lit(2.0).alias("cost_basis_usd"))
        plan, n = joined_rows(joins.compute_pnl(positions, prices))
        assert "skew=true" in plan and n == 60000

        small = spark.range(1001).select(F.col("id").alias("k"), (F.col("id") + 1).alias("w"))
        for left, right in ((hot, small), (small, hot)):
            out = joins.full_outer_null_safe(left, right, ["k"], heavy=1000)
            plan = plan_of(out)
            assert plan.count("FullOuter") == 1 and plan.count("FileScan parquet") == 2 and out.count() == 60001

        plan, n = joined_rows(windows.add_rank(hot, "k", method="min"))
        assert "skew=true" in plan and n == 60000

        plan, n = joined_rows(quality.dq_violations(hot, [Check("unique", "k")]))
        assert "skew=true" in plan and n == 60000

        numbered = hot.withColumn("_row_id", F.col("id"))
        groups = hot.select("k").distinct().withColumn("_row_id", F.col("k"))
        plan, n = joined_rows(provenance.trace_group(numbered, groups, ["k"], "g", "src"))
        assert "skew=true" in plan and n == 60000


def test_sorting_by_a_hot_value_spreads_rows(spark, hot):
    with settings(spark, spark__sql__adaptive__coalescePartitions__enabled="false"):
        sorted_ = filters.sort_desc(hot.withColumn("k", F.lit(1)), "k")
        spread = sorted_.groupBy(F.spark_partition_id()).count()
        assert "rangepartitioning" in plan_of(spread)
        sizes = [r["count"] for r in spread.collect()]
    assert len(sizes) == 4 and max(sizes) < 60000 / 4 * 1.5


def test_all_checks_of_a_table_take_one_scan(spark):
    checks = [Check("unique", c) for c in ("o_orderkey", "o_custkey", "o_totalprice")]
    checks += [Check("null_rate", "o_orderstatus", max_null_rate=0.1), Check("row_count", min_rows=1)]
    plan = plan_of(quality.dq_report(read(spark, "orders"), checks))
    assert plan.count("FileScan parquet") == 1 and "o_orderdate" not in plan and "Join" not in plan


def test_distinct_values_over_odd_columns(spark):
    data = [(1.0, "a", 1), (float("nan"), "a", 1), (None, None, 1), (1.0, "b", 1), (-0.0, None, 1), (0.0, "c", 1)]
    df = spark.createDataFrame(data, "x double, t string, one int")
    report = quality.dq_report(df, [Check("unique", "x"), Check("unique", "t"), Check("unique", "one"), Check("unique", "gone")])
    assert [(r.observed, r.passed) for r in report.orderBy("check_no").collect()] == [(3.0, False), (2.0, False), (5.0, False), (None, False)]
    empty = quality.dq_report(df.limit(0), [Check("unique", "x"), Check("unique", "t")])
    assert [(r.observed, r.passed) for r in empty.collect()] == [(0.0, True), (0.0, True)]


def test_levels_of_a_dimension_take_one_scan(spark):
    out = cube.cube_metadata({"orders": (read(spark, "orders"), ["o_orderpriority", "o_custkey", "o_orderkey"])})
    assert plan_of(out).count("FileScan parquet") == 1
    assert [(r.level, r.level_number) for r in out.collect()] == [("o_orderpriority", 0), ("o_custkey", 1), ("o_orderkey", 2)]


def test_hot_keys_of_a_full_outer_join_are_salted(spark):
    """A third of the rows under one key on both sides, among them missing keys; every pair and every rest once."""
    a = spark.range(600).select(F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 3 == 1, F.col("id")).alias("k"), (F.col("id") % 2).alias("v"))
    b = spark.range(90).select(F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 3 == 1, F.col("id") + 500).alias("k"), F.lit("x").alias("w"))
    lone = spark.range(300).select(F.lit(-1).cast("long").alias("k"), F.lit("y").alias("w"))
    for left, right in ((a, b.unionByName(lone)), (b.unionByName(lone).withColumnRenamed("w", "v"), a.withColumnRenamed("v", "w"))):
        plain = joins.full_outer_null_safe(left, right, ["k"])
        salted = joins.full_outer_null_safe(left, right, ["k"], heavy=25)
        assert plain.count() == salted.count() and plain.exceptAll(salted).isEmpty() and salted.exceptAll(plain).isEmpty()
    spread = {"spark__sql__adaptive__coalescePartitions__enabled": "false", "spark__sql__shuffle__partitions": "40"}
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        with settings(spark, **spread):
            salted = joins.full_outer_null_safe(a, b, ["k"], heavy=25)
            sizes = [r["count"] for r in salted.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    total = 201 * 30 + 200 * 30 + 199 + 30  # pairs of 7, pairs of missing keys, and keys on one side
    assert sum(sizes) == total and max(sizes) < 0.2 * sum(sizes)


def test_copies_are_matched_one_to_one_in_a_full_outer_join(spark):
    left = spark.createDataFrame([(1, "a"), (1, "b"), (1, "b"), (None, "c"), (2, "d")], "k int, v string")
    right = spark.createDataFrame([(1, "b"), (1, "a"), (None, "c"), (None, "d"), (3, "e")], "k int, v string")
    out = joins.full_outer_null_safe(left, right, ["k"], one_to_one=True)
    got = sorted(((r.k, r.l_v, r.r_v, r._in_left, r._in_right) for r in out.collect()), key=repr)
    assert got == sorted(
        [(1, "a", "a", True, True), (1, "b", "b", True, True), (1, "b", None, True, False), (None, "c", "c", True, True), (None, None, "d", False, True), (2, "d", None, True, False), (3, None, "e", False, True)],
        key=repr,
    )
    hot = spark.range(5000).select(F.lit(1).alias("k"), F.lit("same").alias("v"))
    matched = joins.full_outer_null_safe(hot, hot.limit(4000), ["k"], one_to_one=True)
    assert (matched.count(), matched.filter("_in_left AND _in_right").count()) == (5000, 4000)
