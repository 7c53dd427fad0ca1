"""Column transforms, filters and aggregates against pandas and by hand."""

import datetime

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablecraft.operators import aggregates, filters, joins, projection
from tablecraft.registry import apply_transform, find_transform, pandas_rowwise


def test_rename_and_select_skips_absent_columns(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a int, b int, c int")
    assert projection.rename_and_select(df, ["c", "zz", "a"], {"a": "x", "zz": "y"}).columns == ["c", "x"]
    assert projection.rename_and_select(df, [], {"b": "q"}).columns == ["a", "q", "c"]


def test_cast_columns_is_strict(spark):
    df = spark.createDataFrame([("x",)], "a string")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        projection.cast_columns(df, {"a": "int"}).collect()


def test_coerce_types(spark, rows):
    df = spark.createDataFrame([("1", "2.5", "2024-01-02"), ("x", "nope", "soon"), (None, None, None)], "i string, f string, d string")
    out = projection.coerce_types(df, {"i": "int", "f": "float", "d": "datetime64[ns]", "zz": "int"})
    assert rows(out) == sorted(
        [(1, 2.5, datetime.datetime(2024, 1, 2)), (None, None, None), (None, None, None)], key=repr
    )


def test_coerce_types_keeps_a_column_with_fractions(spark):
    df = spark.createDataFrame([(1.5, "7"), (2.0, "8.0")], "a double, b string")
    kept = projection.coerce_types(df, {"a": "int", "b": "int"})
    assert [t for _, t in kept.dtypes] == ["double", "bigint"]
    cut = projection.coerce_types(df, {"a": "int"}, on_fraction="truncate")
    assert [r.a for r in cut.orderBy("a").collect()] == [1, 2]


def test_coerce_keeps_long_whole_numbers(spark):
    df = spark.createDataFrame([("9007199254740993",)], "a string")
    assert projection.coerce_types(df, {"a": "int"}).first().a == 9007199254740993


def test_map_values_keeps_what_is_not_listed(spark, rows):
    df = spark.createDataFrame([("a", 1), ("b", 2), (None, None)], "s string, n int")
    assert [r.s for r in projection.map_values(df, "s", {"a": "x"}).orderBy("n").collect()] == [None, "x", "b"]
    lookup = spark.createDataFrame([("a", "x")], "k string, v string")
    assert rows(projection.map_values(df, "s", lookup)) == rows(projection.map_values(df, "s", {"a": "x"}))
    assert [r.n for r in projection.map_values(df, "n", {1: "one"}).collect()] == ["one", "2", None]
    big = spark.createDataFrame([(3_000_000_000, "x"), (1, "1")], "b long, s string")
    assert [r.b for r in projection.map_values(big, "b", {1: 9, "y": 4}).collect()] == [3_000_000_000, 9]
    assert [r.s for r in projection.map_values(big, "s", {1: "one"}).collect()] == ["x", "one"]


def test_derive_columns_names_the_failing_column(spark):
    df = spark.createDataFrame([(1,)], "a int")
    assert projection.derive_columns(df, {"b": "a + 1", "c": "b * 2"}).first().c == 4
    with pytest.raises(ValueError, match="column 'z'"):
        projection.derive_columns(df, {"z": "missing + 1"})


def test_classify_change_bounds(spark):
    values = [("0.1",), ("0.09",), ("-0.1",), ("2.0",), ("-5.0",), ("4.99",), (None,), ("n/a",)]
    df = spark.createDataFrame(values, "change_24h_pct string")
    got = {r.change_24h_pct: (r.direction, r.magnitude, r.change_class) for r in projection.classify_change(df).collect()}
    assert got["0.1"] == ("flat", "slight", "slight_flat")
    assert got["0.09"] == ("flat", "flat", "flat")
    assert got["-0.1"] == ("flat", "slight", "slight_flat")
    assert got["2.0"] == ("gain", "moderate", "moderate_gain")
    assert got["-5.0"] == ("loss", "strong", "strong_loss")
    assert got["4.99"] == ("gain", "moderate", "moderate_gain")
    assert got[None] == got["n/a"] == ("flat", "slight", "slight_flat")
    with pytest.raises(KeyError):
        projection.classify_change(df, "gone")


def test_add_market_tier_bounds(spark):
    df = spark.createDataFrame([(5e10,), (5e9,), (5e8,), (1.0,), (None,), (float("nan"),)], "market_cap_usd double")
    got = [r.market_tier for r in projection.add_market_tier(df).collect()]
    assert got == ["large", "mid", "small", "micro", "micro", "micro"]


def test_fill_defaults_fills_nan_and_casts(spark, rows):
    df = spark.createDataFrame([(None, float("nan"), None), (1, 2.0, "a")], "i int, f double, s string")
    assert rows(projection.fill_defaults(df, {"i": 0, "f": 1, "s": "z", "gone": 3})) == [(0, 1.0, "z"), (1, 2.0, "a")]


def test_mask_secrets(spark):
    df = spark.createDataFrame([("Api_Key", "v"), ("host", "v"), ("PWD", None)], "key string, value string")
    assert {r.key: r.value for r in projection.mask_secrets(df).collect()} == {"Api_Key": "***", "host": "v", "PWD": None}
    wide = spark.createDataFrame([("s", "t", 1)], "db_password string, host string, token int")
    assert tuple(projection.mask_secret_columns(wide).first()) == ("***", "t", 1)


def test_drop_nulls_counts_nan(spark, rows):
    df = spark.createDataFrame([(1, 1.0), (None, 2.0), (3, float("nan")), (None, None)], "a int, b double")
    assert rows(filters.drop_nulls(df)) == [(1, 1.0)]
    assert filters.drop_nulls(df, how="all").count() == 3


def test_filter_where_error(spark):
    df = spark.createDataFrame([(1,)], "a int")
    with pytest.raises(ValueError, match="invalid WHERE"):
        filters.filter_where(df, "nope >")
    with pytest.raises(ValueError, match="invalid WHERE"):
        filters.filter_where(df, "nope > 1")


def test_filter_recent_drops_what_is_no_date(spark):
    df = spark.createDataFrame([("2024-01-05",), ("2023-01-01",), ("soon",), (None,)], "order_date string")
    assert [r.order_date for r in filters.filter_recent(df, days=10, as_of=datetime.date(2024, 1, 10)).collect()] == ["2024-01-05"]


def test_group_summary_follows_pandas(spark):
    pdf = pd.DataFrame({"g": ["a", "a", "b", None, "b", "c"], "v": [1.0, 3.0, None, 9.0, 4.0, None], "k": [1, 1, 2, 3, 2, 4]})
    spec = {f: ["v", f] for f in aggregates.AGGREGATES}
    named = {o: pd.NamedAgg(column=c, aggfunc=f) for o, (c, f) in spec.items()}
    expected = pdf.groupby("g").agg(**named).reset_index()
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None).values.tolist(), "g string, v double, k long")
    actual = aggregates.group_summary(df, ["g"], spec).toPandas().sort_values("g").reset_index(drop=True)
    pd.testing.assert_frame_equal(actual, expected, check_dtype=False)


def test_group_summary_rules(spark, rows):
    df = spark.createDataFrame([("a", 1), ("a", 2)], "g string, v long")
    assert rows(aggregates.group_summary(df, ["g"], {"x": ["gone", "sum"]})) == [("a", 2)]
    assert rows(aggregates.group_summary(df, ["g"], {"v": "sum", "bad": 3})) == [("a", 3)]
    with pytest.raises(ValueError, match="group_by"):
        aggregates.group_summary(df, [], {})
    with pytest.raises(ValueError, match="unknown aggregation"):
        aggregates.group_summary(df, ["g"], {"v": "mode"})


def test_exact_median(spark):
    data = [(i % 3, float(v)) for i, v in enumerate([5, 1, 1, 8, 3, 1, 2, 9, 7, 4, 4, 4, 6])]
    df = spark.createDataFrame(data, "g int, v double")
    expected = pd.DataFrame(data, columns=["g", "v"]).groupby("g")["v"].median().to_dict()
    assert {r.g: r.m for r in aggregates.exact_median(df, ["g"], "v", "m").collect()} == expected


def test_medians_of_many_columns_in_one_pass(spark, monkeypatch):
    """Columns of one kind cost one ordered pass together; large longs keep their digits; a column may be called like a helper."""
    passes, write = [], aggregates.ordered_runs
    monkeypatch.setattr(aggregates, "ordered_runs", lambda df, *more: passes.append(df.columns) or write(df, *more))
    top = 2**63 - 1
    data = [("a", top - 3, 1, 0.5, None), ("a", top - 1, 2, float("nan"), 1.0), ("a", top, 30, 2.5, None), ("b", -5, None, None, 7.0), ("b", 4, 4, 1.0, 8.0)]
    df = spark.createDataFrame(data, "g string, _no long, i int, x double, y double")
    out = aggregates.exact_medians(df, ["g"], {"big": "_no", "i": "i", "again": "i"})
    assert len(passes) == 1 and out.columns == ["g", "big", "i", "again"]
    one = aggregates.exact_medians(df, ["g"], {"i": "i"})._jdf.queryExecution().executedPlan().toString()
    three = out._jdf.queryExecution().executedPlan().toString()
    assert one.count("Exchange") == three.count("Exchange")
    assert sorted(tuple(r) for r in out.collect()) == [("a", float(top - 1), 2.0, 2.0), ("b", -0.5, 4.0, 4.0)]
    passes.clear()
    mixed = aggregates.group_summary(df, ["g"], {"i": "median", "x": "median", "y": "median", "n": ["i", "count"]})
    assert len(passes) == 2  # whole numbers, fractions
    assert sorted(tuple(r) for r in mixed.collect()) == [("a", 2.0, 1.5, 1.0, 3), ("b", 4.0, 1.0, 7.5, 1)]


def test_monthly_rollup_without_group(spark, rows):
    df = spark.createDataFrame([("2024-01-02", 2.0), ("2024-01-30", 4.0), ("bad", 1.0)], "order_date string, revenue double")
    assert rows(aggregates.monthly_rollup(df)) == sorted(
        [("2024-01", 2, 6.0, 3.0, 2.0, 4.0), (None, 1, 1.0, 1.0, 1.0, 1.0)], key=repr
    )


def test_compute_pnl(spark):
    positions = spark.createDataFrame([("btc", 2.0, 10.0, "p"), (None, 1.0, 0.0, "q"), ("xx", 1.0, 1.0, "r")], "symbol string, quantity double, cost_basis_usd double, note string")
    prices = spark.createDataFrame([("BTC", 15.0, "n"), (None, 3.0, "m")], "symbol string, price_usd double, note string")
    out = {r.note_x: r for r in joins.compute_pnl(positions, prices).collect()}
    assert (out["p"].current_value_usd, out["p"].cost_usd, out["p"].pnl_usd, out["p"].pnl_pct) == (30.0, 20.0, 10.0, 50.0)
    assert (out["q"].current_value_usd, out["q"].pnl_pct, out["q"].note_y) == (3.0, None, "m")
    assert out["r"].current_value_usd is None and out["r"].cost_usd == 1.0


def test_customer_sales_keeps_customers_without_sales(spark, rows):
    customers = spark.createDataFrame([(1, "A", "s"), (2, "B", "s")], "customer_id int, customer_name string, segment string")
    sales = spark.createDataFrame([(1, "x", 3, 9.0), (2, None, 1, 1.0)], "customer_id int, product string, units_sold int, total_revenue double")
    assert rows(joins.customer_sales(customers, sales)) == [(1, "A", "s", "x", 3, 9.0), (2, "B", "s", None, None, None)]


def test_full_outer_null_safe_self(spark):
    df = spark.createDataFrame([(1, "a"), (None, "b")], "k int, v string")
    out = joins.full_outer_null_safe(df, df.filter("v = 'b'"), ["k"])
    assert {(r.k, r.l_v, r.r_v, r._in_left, r._in_right) for r in out.collect()} == {(1, "a", None, True, False), (None, "b", "b", True, True)}


def test_registry_errors_name_the_node(spark):
    df = spark.createDataFrame([(3,)], "val int")
    with pytest.raises(ValueError, match="node 'n1'"):
        apply_transform("", {"t": df}, node="n1")
    with pytest.raises(ValueError, match="node 'n2'.*dotted"):
        apply_transform("undotted", {"t": df}, node="n2")
    with pytest.raises(ValueError, match="node 'n3'"):
        apply_transform("tablecraft.registry.nothing", {"t": df}, node="n3")
    assert find_transform("tablecraft.operators.filters.drop_nulls") is filters.drop_nulls
    with pytest.raises(KeyError, match="positions"):
        apply_transform("compute_pnl", {"t": df})


def test_two_steps_end_to_end(spark):
    df = spark.createDataFrame([(7,)], "val int")
    once = apply_transform("derive_columns", {"t": df}, {"expressions": {"doubled": "val * 2"}})
    assert spark.sql("SELECT doubled FROM {t}", t=once).first().doubled == 14


def test_pandas_rowwise(spark):
    df = spark.range(5).withColumn("v", F.col("id") * 2)
    out = pandas_rowwise(df, lambda p: p.assign(w=p["v"] + 1), "id long, v long, w long")
    assert out.filter("w <> v + 1").count() == 0 and out.count() == 5


def test_map_multi_key(spark, rows):
    df = spark.createDataFrame([("a", 1, "old"), ("a", 2, "old"), (None, 1, "old")], "k string, n long, out string")
    lookup = {("a", 1): "hit"}
    table = spark.createDataFrame([("a", 1, "hit")], "x string, y long, z string")
    for found in (lookup, table):
        kept = projection.map_multi_key(df, ["k", "n"], found, "out")
        assert rows(kept) == sorted([("a", 1, "hit"), ("a", 2, "old"), (None, 1, "old")], key=repr)
        given = projection.map_multi_key(df, ["k", "n"], found, "new", "none")
        assert rows(given.select("n", "new")) == [(1, "hit"), (1, "none"), (2, "none")]


def test_repeated_lookup_keys_multiply_no_row(spark, rows):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2)], "k string, n long")
    table = spark.createDataFrame([("a", 1, "x"), ("a", 1, "y"), ("a", 1, None), ("b", 2, None)], "k string, n long, v string")
    assert rows(projection.map_multi_key(df, ["k", "n"], table, "out")) == [("a", 1, "y")] * 2 + [("b", 2, None)]


def test_long_lookup_dicts_are_joined(spark, rows):
    df = spark.range(-1, 3_000, 500).withColumn("s", F.when(F.col("id") > 0, F.col("id").cast("string"))).withColumn("id", F.col("id").cast("int"))
    many = {i: f"v{i}" for i in range(2_000)}
    few = {i: many[i] for i in (499, 999, 1499, 1999)}
    texts, few_texts = {str(k): v for k, v in many.items()}, {str(k): v for k, v in few.items()}
    assert "Join" in plan_text(projection.map_values(df, "s", texts)) and "Join" not in plan_text(projection.map_values(df, "s", few_texts))
    assert rows(projection.map_values(df, "s", texts)) == rows(projection.map_values(df, "s", few_texts))
    assert rows(projection.map_values(df, "id", many)) == rows(projection.map_values(df, "id", few))
    assert projection.map_values(df, "id", many).columns == ["id", "s"]
    long, short = ({(k, str(k)): v for k, v in d.items()} for d in (many, few))
    assert rows(projection.map_multi_key(df, ["id", "s"], long, "out", "none")) == rows(projection.map_multi_key(df, ["id", "s"], short, "out", "none"))


def plan_text(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_missing_symbols_may_match_nothing(spark):
    held = spark.createDataFrame([(None, 1.0, 2.0)] * 30 + [("x", 2.0, 1.0)], "symbol string, quantity double, cost_basis_usd double")
    prices = spark.createDataFrame([(None, 3.0)] * 40 + [("X", 5.0)], "symbol string, price_usd double")
    assert joins.compute_pnl(held, prices).count() == 1_201
    once = joins.compute_pnl(held, prices, match_missing=False)
    assert once.count() == 31 and once.filter("symbol = 'x'").first().pnl_usd == 8.0
    assert once.filter("symbol IS NULL AND current_value_usd IS NULL").count() == 30
