"""Ranks and running totals against pandas and against Spark's own windows."""

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tablecraft.functions import ordering
from tablecraft.functions.ordering import previous_values, row_numbers, running_totals
from tablecraft.operators import windows

DATA = [(i, "ab"[i % 2] if i % 7 else None, float(i * i % 5) if i % 6 else None) for i in range(60)]


@pytest.fixture
def table(spark):
    return spark.createDataFrame(DATA, "id int, g string, v double")


@pytest.mark.parametrize("method", windows.RANK_METHODS)
@pytest.mark.parametrize("ascending", [True, False])
@pytest.mark.parametrize("group", [None, "g"])
def test_add_rank_follows_pandas(table, method, ascending, group):
    pdf = pd.DataFrame(DATA, columns=["id", "g", "v"])
    values = pdf.groupby("g")["v"] if group else pdf["v"]
    expected = dict(zip(pdf["id"], values.rank(method=method, ascending=ascending)))
    out = windows.add_rank(table, "v", "r", ascending, method, group, ["id"])
    actual = {r.id: r.r for r in out.collect()}
    assert actual == {i: None if pd.isna(r) else int(r) for i, r in expected.items()}


def test_add_rank_rules(table):
    assert windows.add_rank(table, "gone") is table
    with pytest.raises(ValueError, match="method"):
        windows.add_rank(table, "v", method="mean")
    with pytest.raises(ValueError, match="tie_breakers"):
        windows.add_rank(table, "v", method="first")


@pytest.fixture
def skewed(spark):
    """One key holds most rows; values repeat."""
    key = F.when(F.col("id") % 10 < 7, F.lit("hot")).otherwise((F.col("id") % 13).cast("string"))
    return spark.range(0, 5000, 1, 8).select(
        "id", F.when(F.col("id") % 97 == 0, F.lit(None)).otherwise(key).alias("k"), (F.col("id") * 31 % 50).alias("v")
    )


def test_running_totals_of_a_hot_key(skewed):
    out = running_totals(skewed, ["k"], [F.col("v").desc(), F.col("id").asc()], {"n": F.lit(1).cast("long"), "s": F.col("v")})
    window = Window.partitionBy("k").orderBy(F.col("v").desc(), F.col("id").asc()).rowsBetween(Window.unboundedPreceding, 0)
    expected = skewed.withColumn("n", F.count(F.lit(1)).over(window)).withColumn("s", F.sum("v").over(window))
    assert out.exceptAll(expected).isEmpty() and expected.exceptAll(out).isEmpty()


def test_row_numbers_without_key(skewed):
    out = row_numbers(skewed, [], [F.col("v").asc(), F.col("id").asc()], "n")
    expected = skewed.withColumn("n", F.row_number().over(Window.orderBy("v", "id")).cast("long"))
    assert out.exceptAll(expected).isEmpty() and out.count() == expected.count()


def test_previous_values_of_a_hot_key(skewed):
    out = previous_values(skewed, ["k"], [F.col("id").asc()], {"before": "v"})
    expected = skewed.withColumn("before", F.lag("v").over(Window.partitionBy("k").orderBy("id")))
    assert out.exceptAll(expected).isEmpty() and expected.exceptAll(out).isEmpty()


def test_a_hot_key_spreads_over_runs(spark, skewed):
    """Even if all rows have one key, no run holds much more than its share."""
    from tablecraft.functions.ordering import RUN, ordered_runs

    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        runs = ordered_runs(skewed.withColumn("k", F.lit("one")), ["k"], [F.col("id").asc()])
        sizes = [r["count"] for r in runs.groupBy(RUN).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) == 4 and max(sizes) < 5000 / 4 * 1.5


def test_top_n_and_dedup(table, rows):
    best = windows.top_n(table, 2, "v", partition_by="g", tie_breakers=["id"])
    assert {r.g for r in best.collect()} == {"a", "b"} and best.count() == 4
    assert [r.id for r in windows.top_n(table, 3, tie_breakers=["id"]).collect()] == [0, 1, 2]
    assert [r.v for r in windows.top_n(table, 100, "v").collect()][-1] is None
    with pytest.raises(ValueError, match="top_n"):
        windows.top_n(table, 3)
    newest = windows.deduplicate_by_key(table, "g", "id")
    assert {r.g: r.id for r in newest.collect()} == {None: 56, "a": 58, "b": 59}
    assert newest.columns == ["id", "g", "v"]
    assert "_rn" in windows.top_n_by_group(table, "g", "v", 1).columns


def test_top_movers_ranks_ties(spark):
    df = spark.createDataFrame(
        [("A", -3.0), ("B", 3.0), ("C", 1.0), ("D", 9.0), ("E", None)], "symbol string, change_24h_pct double"
    ).selectExpr("*", "1.0D AS price_usd", "2e9D AS market_cap_usd", "'x' AS change_class")
    out = windows.top_movers(df, 4, keep=["symbol"], tie_breakers=["symbol"]).collect()
    assert [(r.mover_rank, r.symbol) for r in out] == [(1, "D"), (2, "A"), (2, "B"), (4, "C")]


def test_last_state_keeps_first_and_changed(spark, rows):
    data = [(1, 1, "a"), (1, 2, "a"), (1, 3, None), (1, 4, None), (1, 5, "a"), (2, 1, None), (2, 2, "z")]
    df = spark.createDataFrame(data, "k int, t int, s string")
    assert rows(windows.last_state(df, "k", ["t"], ["s"])) == sorted(
        [(1, 1, "a"), (1, 3, None), (1, 5, "a"), (2, 1, None), (2, 2, "z")], key=repr
    )


def test_many_rows_of_a_hot_group(spark):
    """Beyond the number that Spark cuts before the shuffle, a large group is spread over ordered runs."""
    hot = spark.range(12_000).select("id", F.when(F.col("id") % 10 < 9, "hot").otherwise("cold").alias("g"))
    best = windows.top_n(hot, 5_000, "id", partition_by="g")
    assert {r.g: r["count"] for r in best.groupBy("g").count().collect()} == {"hot": 5_000, "cold": 1_200}
    assert best.filter("g = 'hot'").agg(F.min("id")).first()[0] == hot.filter("g = 'hot'").orderBy(F.desc("id")).limit(5_000).agg(F.min("id")).first()[0]


@pytest.fixture
def written(monkeypatch):
    """The columns of each table that ordering writes down."""
    seen, write = [], ordering.settle

    def settle(df, label="step"):
        seen.append(df.columns)
        return write(df, label)

    monkeypatch.setattr(ordering, "settle", settle)
    return seen


def test_last_state_writes_only_what_gives_the_order(spark, written):
    wide = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, None).otherwise(F.col("id") % 7).alias("k"), "id", (F.col("id") % 50 < 25).alias("on"),
        F.repeat(F.lit("x"), 50).alias("pad"), (F.col("id") * 2).alias("other"),
    )
    out = windows.last_state(wide, "k", ["id"], ["on"])
    assert all({"pad", "other"}.isdisjoint(columns) for columns in written) and len(written) == 1
    before = F.lag("on").over(Window.partitionBy("k").orderBy("id"))
    expected = wide.withColumn("b", before).filter(F.col("b").isNull() | (F.col("b") != F.col("on"))).drop("b")
    assert out.columns == wide.columns and out.exceptAll(expected).isEmpty() and expected.exceptAll(out).isEmpty()


@pytest.mark.parametrize("group", [None, "g"])
def test_first_ranks_write_only_what_gives_the_order(spark, written, group):
    wide = spark.createDataFrame([(*r, "pad", i) for i, r in enumerate(DATA)], "id int, g string, v double, pad string, more int")
    out = windows.add_rank(wide, "v", "r", method="first", group_by=group, tie_breakers=["id"])
    assert all({"pad", "more"}.isdisjoint(columns) for columns in written) and len(written) == 1
    assert out.count() == 60 and out.columns == [*wide.columns, "r"]
    # Tie breakers that leave rows equal give them one number, and no row twice.
    tied = windows.add_rank(wide, "v", "r", method="first", group_by=group, tie_breakers=["pad"])
    assert tied.count() == 60 and tied.filter("r IS NOT NULL").select("v", "g", "r").distinct().count() <= 15
