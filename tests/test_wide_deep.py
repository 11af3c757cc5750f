"""Pages at any offset and pivots of any width."""

import random

import pytest

from gridmill.operators import records, shape


def test_deep_pages_equal_shallow_ones(spark):
    rng = random.Random(11)
    data = [(i, rng.choice([None, 1.0, 2.5, float("nan"), -0.0, 7.0]), rng.choice("abc")) for i in range(500)]
    df = spark.createDataFrame(data, "n long, v double, s string").repartition(7)
    for sort, skip, limit in [([("v", "desc")], 0, 20), ([("v", "asc"), ("s", "desc")], 333, 40), ([("s", "asc")], 490, 40), ([("n", "desc")], 0, 600)]:
        want = df.orderBy(*records.sort_keys(sort, "n")).offset(skip).limit(limit).collect()
        assert [r["n"] for r in records.deep_page(df, sort, "n", skip, limit).collect()] == [r["n"] for r in want]
    assert records.deep_page(df, [("v", "asc")], "n", 500, 10).count() == 0
    assert records.deep_page(df.limit(0), [("v", "asc")], "n", 0, 10).count() == 0


def test_queries_change_over_at_depth(spark, monkeypatch):
    df = spark.range(300).selectExpr("id AS n", "id % 5 AS v")
    pages = lambda: (records.query_records(df, sort=[("v", "asc")], skip=120, limit=7, row_number="n", totals=True).collect(),
                     records.catalog_page(df, 13, 10, "v", "n").collect())
    want = pages()
    monkeypatch.setattr(records, "DEEP", 50)
    assert pages() == want


def test_long_pivots_hold_the_cells_of_wide_ones(spark):
    data = [("a", "x", 1.0, 1), ("a", "x", 3.0, 2), ("a", "y", None, 3), ("b", "y", 5.0, 4), (None, "x", 9.0, 5), ("b", None, 9.0, 6)]
    df = spark.createDataFrame(data, "i string, c string, v double, n long")
    for agg in ("mean", "sum", "count", "first", "last"):
        wide = {(r["i"], f"v_{c}"): r[f"v_{c}"] for r in shape.pivot(df, ["i"], "c", "v", agg, row_number="n").collect() for c in "xy"}
        long = {(r["i"], r["feature"]): r["value"] for r in shape.pivot_long(df, ["i"], "c", "v", agg, "n").collect()}
        assert set(long) == {("a", "v_x"), ("a", "v_y"), ("b", "v_y")}
        assert long == {k: wide[k] for k in long}


def test_too_many_names_are_refused_before_they_are_collected(spark):
    df = spark.range(200).selectExpr("CAST(id AS string) AS c", "id % 3 AS i", "id AS v")
    with pytest.raises(ValueError, match="long form"):
        shape.categories(df, "c", 199)
    assert len(shape.categories(df, "c", 200)) == 200
    assert shape.pivot_long(df, ["i"], "c", "v", "sum").count() == 200
