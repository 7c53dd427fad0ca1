"""Totals of cube questions."""

import pytest
from pyspark.sql import functions as F

from tablecraft.operators import cube
from tests.test_scale import plan_of


@pytest.fixture
def sold(spark):
    data = [("n", "a", "x", 1, 7), ("n", "a", "y", 2, 7), ("n", None, "x", 4, 8), (None, "b", None, 8, 7), (None, None, "z", 16, 9), ("s", "b", "y", 32, 9)]
    return spark.createDataFrame(data, "r string, l string, c string, v long, buyer long")


def test_totals_and_missing_members_stay_apart(sold, rows):
    out = cube.cube_query(sold, {"t": F.sum("v")}, ["r", "l"], totals="rollup")
    assert out.columns == ["r", "l", "grouping_id", "t"]
    assert rows(out) == sorted(
        [
            ("n", "a", 0, 3), ("n", None, 0, 4), (None, "b", 0, 8), (None, None, 0, 16), ("s", "b", 0, 32),
            ("n", None, 1, 7), (None, None, 1, 24), ("s", None, 1, 32), (None, None, 3, 63),
        ],
        key=repr,
    )


def test_any_measure_has_totals(sold, rows):
    """A buyer of several members counts once in their total."""
    out = cube.cube_query(sold, {"buyers": F.count_distinct("buyer"), "mean": F.avg("v")}, ["r"], totals="cube")
    assert rows(out) == sorted([("n", 0, 2, 7 / 3), (None, 0, 2, 12.0), ("s", 0, 1, 32.0), (None, 1, 3, 10.5)], key=repr)


def test_totals_on_columns(sold, rows):
    out = cube.cube_query(sold, {"t": F.sum("v")}, ["r"], {"c": ["x", "y"]}, totals="rollup", column_total="All", calculated={"rest": "`All · t` - coalesce(`x · t`, 0)"})
    assert out.columns == ["r", "grouping_id", "x · t", "y · t", "All · t", "rest"]
    assert rows(out) == sorted([("n", 0, 5, 2, 7, 2), (None, 0, None, None, 24, 24), ("s", 0, None, 32, 32, 32), (None, 1, 5, 34, 63, 58)], key=repr)


def test_sets_of_levels(sold):
    assert cube.grouping_sets(["a", "b"], "cube") == [("a", "b"), ("a",), ("b",), ()]
    assert cube.grouping_sets(["a", "b", "c"], [["c"], [], ["b", "a", "c"]]) == [("a", "b", "c"), ("c",), ()]
    with pytest.raises(KeyError):
        cube.cube_query(sold, {"t": F.sum("v")}, ["r"], totals=[["q"]])
    with pytest.raises(ValueError):
        cube.cube_query(sold, {"t": F.sum("v")}, ["r"], totals="all")
    with pytest.raises(ValueError):
        cube.cube_query(sold, {"t": F.sum("v")}, ["r"], {"c": ["x"]}, column_total="x")


def test_all_totals_come_from_one_scan(spark):
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    measures = {"t": F.sum("o_totalprice"), "n": F.count(F.lit(1))}
    out = cube.cube_query(orders, measures, ["o_orderpriority", "o_custkey"], {"o_orderstatus": ["F", "O"]}, totals="cube", column_total="All")
    plan = plan_of(out)
    assert plan.count("FileScan parquet") == 1 and "Join" not in plan
    assert "partial_sum" in plan[plan.rindex("Exchange") :]
    empty = cube.cube_query(orders.limit(0), {"t": F.sum("o_totalprice")}, ["o_custkey"], totals="rollup", non_empty_rows=False)
    assert empty.count() == 0
