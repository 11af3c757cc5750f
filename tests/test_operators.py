"""Semantics checked by hand or against plain Python."""

import io
import random
from contextlib import redirect_stdout
from datetime import datetime, timedelta
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridmill.operators import aggregates, clean, infer, insights, mapping, ordered, predicates, profile, quantiles
from gridmill.operators import records, relations, shape, stats, validate
from gridmill.plans import chain, presets


def formatted(df):
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def gaps(spark):
    vals = [None, 1.0, None, None, 4.0, None, 6.0, None]
    return spark.createDataFrame(list(enumerate(vals)), "n long, v double")


# --- predicates --------------------------------------------------------------

PEOPLE = [(1, "Ann", 30, "a%b"), (2, "bob", None, "a_b"), (3, None, 25, "axb"), (4, "Anna", 41, None)]


@pytest.fixture(scope="module")
def people(spark):
    return spark.createDataFrame(PEOPLE, "id long, name string, age int, code string")


@pytest.mark.parametrize("spec,ids", [
    (("name", "eq", "Ann"), [1]), (("name", "ne", "Ann"), [2, 4]), (("age", "eq", "30"), [1]), (("age", "eq", "x"), []),
    (("age", "ne", "x"), [1, 3, 4]), (("age", "gt", "25"), [1, 4]), (("age", "gte", 25), [1, 3, 4]), (("age", "lt", 30), [3]),
    (("age", "lte", 30), [1, 3]), (("name", "contains", "NN"), [1, 4]), (("code", "contains", "%"), [1]),
    (("code", "contains", "_"), [2]), (("name", "starts_with", "an"), [1, 4]), (("name", "ends_with", "B"), [2]),
    (("age", "in", [30, "41", "z"]), [1, 4]), (("age", "not_in", [30]), [3, 4]), (("name", "is_null", None), [3]),
    (("name", "is_not_null", None), [1, 2, 4]), (("name", "gt", 1), [])])
def test_filters(people, spec, ids):
    column, operator, value = spec
    out = predicates.apply_filters(people, [{"column": column, "operator": operator, "value": value}])
    assert sorted(r["id"] for r in out.collect()) == ids


def kept(df, operator, value, column="x"):
    return sorted(r["id"] for r in predicates.apply_filters(df, [{"column": column, "operator": operator, "value": value}]).collect())


def test_long_lists_answer_like_short_ones(spark):
    df = spark.createDataFrame([(1, 45.0, True), (2, 46.5, False), (3, None, None)], "id int, x double, flag boolean")
    others = [f"no {i}" for i in range(10_001)]
    assert kept(df, "in", ["45"]) == kept(df, "in", ["45", *others]) == [1]
    assert kept(df, "not_in", ["45"]) == kept(df, "not_in", ["45", *others]) == [2]
    assert kept(df, "in", ["True", *others], "flag") == kept(df, "in", [True], "flag") == [1]


def test_whole_numbers_are_exact(spark):
    big = 2 ** 53
    df = spark.createDataFrame([(1, big), (2, big + 1), (3, big + 2), (4, None)], "id int, x bigint")
    assert kept(df, "eq", str(big + 1)) == kept(df, "in", [big + 1]) == [2] and kept(df, "ne", big + 1) == [1, 3]
    assert kept(df, "gt", big) == [2, 3] and kept(df, "lt", str(big + 2)) == [1, 2] and kept(df, "gte", big + 0.5) == [1, 2, 3]
    assert kept(df, "gt", "2.5") == [1, 2, 3] and kept(df, "lt", "inf") == [1, 2, 3] and kept(df, "eq", "inf") == []
    assert kept(df, "lte", 10 ** 30) == [1, 2, 3] and kept(df, "gt", 10 ** 30) == [] and kept(df, "gte", "-inf") == [1, 2, 3]
    doubles = df.withColumn("x", F.col("x").cast("double"))
    assert kept(doubles, "eq", big + 1) == [] and kept(doubles, "gte", big + 1) == [3] and kept(doubles, "lt", big + 1) == [1, 2]


def test_integer_bounds_reach_the_scan(tables):
    plan = formatted(predicates.apply_filters(tables.orders, [{"column": "o_orderkey", "operator": "gt", "value": 100}]))
    assert "GreaterThan(o_orderkey,100)" in plan


@pytest.mark.parametrize("spec", [
    {"column": "name", "operator": "like", "value": "x"}, {"column": "none", "operator": "eq", "value": "x"},
    {"column": "name", "operator": "eq"}, {"operator": "eq", "value": 1}])
def test_bad_filters_raise(people, spec):
    with pytest.raises(ValueError):
        predicates.validate_filters(people, [spec])


def test_numeric_filter_reaches_the_scan(tables):
    df = predicates.apply_filters(tables.orders, [{"column": "o_totalprice", "operator": "gt", "value": "1000"},
                                                  {"column": "o_orderstatus", "operator": "eq", "value": "F"}])
    plan = formatted(df)
    assert "GreaterThan(o_totalprice,1000.0)" in plan and "EqualTo(o_orderstatus,F)" in plan


# --- row order ---------------------------------------------------------------

def test_interpolation_example(gaps):
    out = ordered.interpolate(gaps, ["v"], "n", chunk=3).orderBy("n").collect()
    assert [r["v"] for r in out] == [None, 1, 2, 3, 4, 5, 6, 6]


def test_interpolation_counts_rows_not_positions(spark):
    df = spark.createDataFrame([(1, 0.0), (10, None), (11, None), (500, 3.0)], "n long, v double")
    out = ordered.interpolate(df, ["v"], "n", dense=False).orderBy("n").collect()
    assert [r["v"] for r in out] == [0, 1, 2, 3]


@pytest.mark.parametrize("chunk", [1, 2, 3, 100])
def test_fills_do_not_depend_on_the_cut(gaps, chunk):
    fwd = [r["v"] for r in ordered.fill_forward(gaps, ["v"], "n", chunk=chunk).orderBy("n").collect()]
    bwd = [r["v"] for r in ordered.fill_backward(gaps, ["v"], "n", chunk=chunk).orderBy("n").collect()]
    assert fwd == [None, 1, 1, 1, 4, 4, 6, 6] and bwd == [1, 1, 4, 4, 4, 6, 6, None]


def test_fill_keeps_null_keys_apart(spark):
    df = spark.createDataFrame([(0, None, 1.0), (1, "a", 2.0), (2, None, None), (3, "a", None)], "n long, k string, v double")
    out = ordered.fill_forward(df, ["v"], "n", ["k"], chunk=1).orderBy("n").collect()
    assert [r["v"] for r in out] == [1, 2, 1, 2]


@pytest.mark.parametrize("chunk", [1, 4, 50])
def test_streak_of_a_hot_key(spark, chunk):
    rng = random.Random(5)
    data = [(i, "hot" if rng.random() < 0.8 else f"k{i % 5}", rng.random() < 0.8) for i in range(300)]
    df = spark.createDataFrame(data, "n long, k string, failed boolean")
    got = {r["n"]: r["failure_count"] for r in
           ordered.failure_streak(df, "k", "n", F.col("failed"), chunk=chunk).collect()}
    run, want = {}, {}
    for n, k, failed in data:
        run[k] = run.get(k, 0) + 1 if failed else 0
        want[n] = run[k]
    assert got == want


def test_streak_continues_an_open_one(spark):
    df = spark.createDataFrame([(5, "a", True), (6, "a", True), (7, "b", True), (8, "a", False), (9, "a", True)],
                               "n long, k string, failed boolean")
    carry = spark.createDataFrame([("a", 4), ("c", 9)], "k string, open_streak long")
    out = ordered.failure_streak(df, "k", "n", F.col("failed"), chunk=1, carry=carry).orderBy("n").collect()
    assert [r["failure_count"] for r in out] == [5, 6, 1, 0, 1]


@pytest.mark.parametrize("span", [10, 25, 10_000])
def test_rate_window_against_brute_force(spark, span):
    rng = random.Random(7)
    data = [(i, "hot" if rng.random() < 0.7 else "cold", rng.randrange(0, 200_000_000)) for i in range(250)]
    data += [(900, "hot", 50_000_000), (901, "hot", 60_000_000), (902, "hot", 60_000_000)]
    df = spark.createDataFrame(data, "n long, k string, t long")
    got = {r["n"]: r["current_count"] for r in ordered.rate_window(df, "k", "t", 10, 3, span).collect()}
    want = {n: sum(1 for _, k2, t2 in data if k2 == k and t - 10_000_000 < t2 < t) for n, k, t in data}
    assert got == want


def test_positions(spark):
    df = spark.createDataFrame([(x,) for x in [50, 3, 999, 7, 8, 1]], "n long")
    want = [(1, 1), (3, 2), (7, 3), (8, 4), (50, 5), (999, 6)]
    assert sorted(map(tuple, ordered.dense_positions(df, "n", "p", chunk=5).collect())) == want
    assert sorted(map(tuple, ordered.assign_positions(df, ["n"], "p").collect())) == want


# --- statistics --------------------------------------------------------------

@pytest.mark.parametrize("kind", ["uniform", "hot value", "skewed", "few"])
def test_spread_percentiles_equal_numpy(spark, kind):
    rng = np.random.default_rng(3)
    v = {"uniform": rng.random(4000), "hot value": np.where(rng.random(4000) < 0.4, 7.0, rng.random(4000) * 10),
         "skewed": np.exp(rng.normal(0, 6, 4000)), "few": np.array([1.0, 2.0, 3.0, 4.0])}[kind]
    df = spark.createDataFrame(pd.DataFrame({"v": v}))
    probs = [0.0, 0.25, 0.5, 0.75, 0.99, 1.0]
    got = {r["p"]: r["value"] for r in quantiles.percentile_table(df, "v", probs).collect()}
    for p in probs:
        assert got[p] == pytest.approx(np.quantile(v, p), rel=1e-12)


def test_spread_percentiles_by_key(spark):
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame({"k": np.where(rng.random(3000) < 0.6, "hot", rng.choice(["a", "b"], 3000)), "v": rng.normal(0, 1, 3000)})
    pdf.loc[pdf.index % 11 == 0, "k"] = None
    df = spark.createDataFrame(pdf)
    got = {(r["k"], r["p"]): r["value"] for r in quantiles.percentile_table(df, "v", [0.1, 0.5], ["k"]).collect()}
    for key, group in pdf.groupby(pdf["k"].fillna("?")):
        for p in (0.1, 0.5):
            assert got[(None if key == "?" else key, p)] == pytest.approx(group["v"].quantile(p), rel=1e-12)


def test_correlation_of_a_constant_is_zero(spark):
    df = spark.createDataFrame([(1.0, 5.0, None), (2.0, 5.0, 3.0), (4.0, 5.0, 9.0)], "a double, b double, c double")
    out = {(r["column1"], r["column2"]): r for r in stats.correlations(df, ["a", "b", "c"]).collect()}
    assert out[("a", "b")]["correlation"] == 0.0 and out[("a", "b")]["direction"] == "none"
    assert out[("a", "c")]["correlation"] == pytest.approx(1.0) and out[("a", "c")]["sample_size"] == 2


def test_histogram(spark):
    df = spark.createDataFrame([(float(x),) for x in [0, 1, 1, 5, 10, 10]], "v double")
    counts = [r["count"] for r in profile.histogram(df, "v").orderBy("bin").collect()]
    assert counts == [1, 2, 0, 0, 0, 1, 0, 0, 0, 2]
    assert sum(r["count"] for r in profile.histogram(df, "v", clamp=False).collect()) == 4
    flat = spark.createDataFrame([(3.0,), (3.0,)], "v double")
    assert [r["count"] for r in profile.histogram(flat, "v", 3).orderBy("bin").collect()] == [2, 0, 0]


def test_mode_takes_the_smallest_of_ties(spark):
    df = spark.createDataFrame([("b",), ("a",), ("a",), ("b",), (None,)], "v string")
    assert rows(profile.categorical_stats(df, "v")) == [("v", 2, "a", 2)]


def test_outliers_keep_nulls_and_flat_columns(spark):
    df = spark.createDataFrame([(i, 1.0) for i in range(20)] + [(20, 100.0), (21, None)], "row_number long, v double")
    assert stats.remove_outliers(df, "v").count() == 21
    assert [r["row_number"] for r in stats.detect_outliers(df, "v", "zscore").collect()] == [20]
    flat = spark.createDataFrame([(1, 2.0), (2, 2.0)], "row_number long, v double")
    assert stats.remove_outliers(flat, "v", "zscore").count() == 2


# --- cleaning ----------------------------------------------------------------

def test_duplicates_keep(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, None), (5, None)], "row_number long, v string")
    keep = {k: sorted(r["row_number"] for r in clean.drop_duplicates(df, ["v"], k).collect()) for k in ("first", "last", "none")}
    assert keep == {"first": [1, 2, 4], "last": [2, 3, 5], "none": [2]}
    once = clean.drop_duplicates(df, ["v"])
    assert rows(clean.drop_duplicates(once, ["v"])) == rows(once)


def test_duplicate_groups_are_cut_before_the_shuffle(tables):
    plan = clean.drop_duplicates(tables.documents, ["text"], "first", "doc_id")._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Partial") > plan.index("Exchange")  # printed top down: the cut lies below the exchange


@pytest.mark.parametrize("strategy,want", [
    ("fill_mean", [2.0, 1.0, 3.0, 2.0]), ("fill_median", [2.0, 1.0, 3.0, 2.0]), ("fill_mode", [1.0, 1.0, 3.0, 1.0])])
def test_fills(spark, strategy, want):
    df = spark.createDataFrame([(1, None), (2, 1.0), (3, 3.0), (4, float("nan"))], "row_number long, v double")
    assert [r["v"] for r in clean.handle_missing(df, strategy, ["v"]).orderBy("row_number").collect()] == want


def test_missing_strategies_raise(people):
    with pytest.raises(ValueError):
        clean.handle_missing(people, "guess", ["age"])
    with pytest.raises(ValueError):
        clean.handle_missing(people, "fill_value", ["age"])
    with pytest.raises(ValueError):
        clean.handle_missing(people, "drop", ["nope"])


# --- shape -------------------------------------------------------------------

def test_names():
    names = ["First Name", "firstName", "  x--y ", "%%%", "A", "a", "order-ID 2"]
    assert shape.normal_names(names) == ["first_name", "first_name_1", "xy", "column_3", "a", "a_1", "order_id_2"]
    assert shape.normal_names(["first name", "x_y"], "camel") == ["firstName", "xY"]
    assert shape.normal_names(["abcdef", "abcxyz"], max_length=3) == ["abc", "abc_1"]
    assert shape.normal_names(["order-ID 2"], remove_special=False) == ["order_id_2"]


@pytest.mark.parametrize("case, names", [("camel", ["fullname", "fullName"]), ("pascal", ["Fullname", "FullName"])])
def test_names_that_differ_in_case_alone_can_be_written(spark, tmp_path, case, names):
    spark.conf.unset("spark.sql.caseSensitive")
    try:
        named = shape.normalize_names(spark.createDataFrame([("a", 1)], "`fullName!` string, full_name long"), case)
        named.write.parquet(f"{tmp_path}/out")
        assert spark.read.parquet(f"{tmp_path}/out").select(*names).collect() == [("a", 1)]
        spark.conf.unset("spark.sql.caseSensitive")
        shape.normalize_names(named.toDF("a b", "c d"), case)
        assert spark.conf.get("spark.sql.caseSensitive") == "false"
    finally:
        spark.conf.unset("spark.sql.caseSensitive")


def test_flatten_example(spark):
    docs = ['{"a": {"b": 1, "c": 2}, "d": 3}', '{"l": [{"x": 1}, [5]], "p": [1, "z"], "e": {}, "n": []}', "[7, {}]", "5", "bad"]
    df = spark.createDataFrame(list(enumerate(docs)), "i int, doc string")
    got = rows(shape.flatten_json(df, "doc", ["i"]))
    assert got == sorted([(0, "a_b", "1"), (0, "a_c", "2"), (0, "d", "3"), (1, "l_0_x", "1"), (1, "l_1_0", "5"),
                          (1, "p", '[1, "z"]'), (2, "0", "7"), (3, "value", "5")], key=repr)


def test_scaling_there_and_back(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (4.0, 5.0), (None, 5.0)], "a double, c double")
    for method in shape.SCALERS:
        params = shape.scaling_params(df, ["a", "c"], method)
        back = shape.inverse_scale(shape.scale_numeric(df, ["a", "c"], method), params, ["a", "c"], method)
        for got, want in zip(rows(back), rows(df)):
            assert got == pytest.approx(want) if None not in want else got == want


def test_label_codes_and_back(spark):
    df = spark.createDataFrame([(1, "b"), (2, None), (3, "a"), (4, "c"), (5, "b")], "i int, v string")
    assert rows(shape.encode_label(df, "v")) == [(1, 1), (2, None), (3, 0), (4, 2), (5, 1)]
    mapping = shape.dictionary(df, "v")
    assert rows(shape.decode(shape.encode_label(df, "v", mapping), "v", mapping)) == rows(df)
    assert rows(mapping) == [("a", 0), ("b", 1), ("c", 2)]


def test_categories_of_any_number(spark):
    assert shape.categories(spark.range(3000), "id") == list(range(3000))


def test_pivot_and_back(spark):
    df = spark.createDataFrame([("x", "p", 1.0), ("x", "q", 2.0), ("y", "p", 3.0)], "i string, c string, v double")
    wide = shape.pivot(df, ["i"], "c", "v", "sum")
    long = shape.unpivot(wide, ["i"]).filter("value IS NOT NULL")
    assert rows(long.select("i", F.expr("substring(variable, 3)"), "value")) == rows(df)


def test_conversion_modes(spark):
    df = spark.createDataFrame([("1",), ("x",)], "v string")
    assert rows(shape.convert_types(df, {"v": "int"}, "coerce")) == [(1,), (None,)]
    assert rows(shape.convert_types(df, {"v": "int"}, "ignore")) == [("1",), ("x",)]
    with pytest.raises(Exception, match="cannot convert"):
        shape.convert_types(df, {"v": "int"}, "raise").collect()
    big = spark.createDataFrame([("9007199254740993",), ("2.0",), ("2.7",)], "v string")
    assert rows(shape.convert_types(big, {"v": "int"}, "coerce")) == sorted([(9007199254740993,), (2,), (None,)], key=repr)


# --- inference, validation, mapping ------------------------------------------

def test_inference_ladder(spark):
    df = spark.createDataFrame([("t", "1", "2024-01-01", "a@b.co", "5", None)] * 9 + [("x", "z", "", "a@b.co", "6.5", None)],
                               "b string, i string, d string, e string, f string, n string")
    out = {r["column"]: (r["inferred_type"], round(r["confidence"], 2)) for r in infer.infer_types(df).collect()}
    assert out == {"b": ("boolean", 0.9), "i": ("boolean", 0.9), "d": ("date", 0.9), "e": ("email", 1.0), "f": ("float", 1.0),
                   "n": ("null", 1.0)}


def test_patterns_match_a_prefix(spark):
    df = spark.createDataFrame([(1, "AB-12xyz"), (2, "xAB"), (3, None)], "row_number long, v string")
    rules = {"pattern_checks": [{"column": "v", "pattern": "ab|cd", "flags": "i"}]}
    assert rows(validate.check_rows(df, rules).select("invalid_count", "total")) == [(1, 2)]
    assert rows(validate.invalid_samples(df, rules, 10).select("row_number", "value")) == [(2, "xAB")]


def test_empty_or_unknown_rules_raise(people):
    for rules in ({}, {"nonsense": []}, {"range_checks": [{"column": "age"}]}):
        with pytest.raises(ValueError):
            validate.check_all(people, rules).collect()


def test_suggestions_equal_brute_force(spark):
    names = ["qty", "customer_id", "OrderDate", "addr", "is_active", "Total Amount", "zzz"]
    targets = ["quantity", "customer", "order_date", "address", "active", "total_amt", "customer_identifier"]
    df = spark.createDataFrame([(n,) for n in names * 3], "name string")
    got = {}
    for r in mapping.suggest_mappings(df, "name", targets).orderBy("source", "rank").collect():
        got.setdefault(r["source"], []).append((r["target"], round(r["confidence"], 6)))
    assert got["qty"][0] == ("quantity", round(SequenceMatcher(None, "qty", "quantity").ratio() + 0.2, 6))
    assert got["is_active"][0] == ("active", round(SequenceMatcher(None, "is_active", "active").ratio() + 0.15, 6))
    assert got["OrderDate"][0] == ("order_date", round(SequenceMatcher(None, "orderdate", "order_date").ratio(), 6))
    assert "zzz" not in got and all(len(v) <= 5 for v in got.values())
    assert all(c >= 0.3 for v in got.values() for _, c in v)


def test_indexed_targets_equal_scoring_all():
    words = ["customer", "order", "qty", "quantity", "date", "dt", "id", "is", "name", "total", "amt", "amount", "x1", "city"]
    targets = [a + sep + b for a in words for b in words for sep in ("_", "", " ")] + ["", "q" * 90, "qty" * 30]
    goals = mapping.Goals(targets)

    def all_scored(name, top, least):
        low, out = name.lower(), []
        for place, target in enumerate(targets):
            other, ratio = target.lower(), SequenceMatcher(None, goals.key(name), goals.key(target)).ratio()
            if any((a in low and f in other) or (f in low and a in other) for a, f in mapping.ABBREVIATIONS):
                ratio += mapping.ABBREVIATION_BONUS
            elif any(low.replace(x, "") == other.replace(x, "") != "" for x in mapping.AFFIXES):
                ratio += mapping.AFFIX_BONUS
            out.append((min(1.0, ratio), place))
        return sorted((o for o in out if o[0] >= least), key=lambda o: (-o[0], o[1]))[:top]

    names = ["CustOrder", "is_total", "date dt", "", "___", "qty" * 25, "q" * 70, "zzz", "amount_x1", "identifier", "ytic", "name_id"]
    for top, least in ((5, 0.3), (1, 0.9), (3, 0.0), (len(targets), 0.0)):
        goals.scored = 0
        for name in names:
            assert goals.best(name, goals.key(name), top, least) == all_scored(name, top, least), (name, top, least)
        assert top > 5 or goals.scored < 0.1 * len(names) * len(targets)


def test_auto_mapping(spark):
    df = spark.createDataFrame([(0, "Order-Date"), (1, "customer_ids"), (2, "customer_idx"), (3, "???")], "p int, name string")
    out = mapping.auto_mapping(df, "name", ["orderdate", "customer_id"], "p")
    assert rows(out.select("source", "target", "how")) == [
        ("Order-Date", "orderdate", "exact"), ("customer_ids", "customer_id", "similar")]


def test_long_texts_are_counted_by_digest(spark):
    head = "h" * profile.SHORT_TEXT
    values = [head + "b" * 9_000, head + "a" * 9_000, head, head + "a" * 9_000, head + "b" * 9_000, head, "short", "", None, "\u00e9" * 40]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    top = [(r["rank"], r["value"], r["count"]) for r in profile.top_values(df, ["v"], 4).orderBy("rank").collect()]
    assert top == [(1, head, 2), (2, head + "a" * 9_000, 2), (3, head + "b" * 9_000, 2), (4, "", 1)]
    tied = df.filter("length(v) > 60")
    assert rows(profile.categorical_stats(tied, "v")) == [("v", 2, head + "a" * 9_000, 2)]
    assert rows(profile.distinct_counts(df, ["v", "i"])) == [("i", 10, 10), ("v", 6, 9)]
    assert rows(profile.categorical_stats(df.filter("v IS NULL"), "v")) == []


def test_codes_of_many_columns_come_from_one_sort(spark):
    df = spark.createDataFrame([(3, "b", 1.5, "b"), (1, None, 0.5, "a"), (2, "a", 1.5, None), (None, "c", None, "c"), (10, "b", -2.0, "b")],
                               "k long, s string, d double, t string")
    assert rows(shape.encode_labels(df, ["k", "s", "d", "t"])) == sorted(
        [(2, 1, 2, 1), (0, None, 1, 0), (1, 0, 2, None), (None, 2, None, 2), (3, 1, 0, 1)], key=repr)
    books = shape.dictionaries(df, ["k", "s", "d"])
    assert [r["value"] for r in books["k"].orderBy("code").collect()] == [1, 2, 3, 10]
    assert rows(books["d"]) == [(-2.0, 0), (0.5, 1), (1.5, 2)]
    assert rows(shape.encode_labels(df.limit(0), ["k", "s"])) == []
    assert shape.encode_labels(df, []).count() == 5


def test_mapping_strict(people):
    with pytest.raises(ValueError):
        mapping.validate_mapping(people, {"nope": "x"}, {"x": {"type": "string"}}, strict=True)
    with pytest.raises(ValueError):
        mapping.apply_mapping(people, {"nope": "x"})


# --- chains, relations, records ----------------------------------------------

def test_chain_reports_and_stops(spark, people):
    def broken(df):
        raise KeyError("boom")
    steps = chain.StepChain("t").add(clean.trim_whitespace).add(broken).add(broken)
    assert steps.problems() == ["duplicate step broken"] and chain.StepChain().problems() == ["no steps"]
    with pytest.raises(RuntimeError, match="boom"):
        steps.run(people)
    out, outcomes = steps.run(people, stop_on_error=False, count_rows=True)
    assert out.count() == 4
    assert [(r["step"], r["status"]) for r in chain.report(spark, outcomes).orderBy("position").collect()] == [
        ("trim_whitespace", "completed"), ("broken", "failed"), ("broken", "failed")]


def test_unknown_operation_raises(people):
    with pytest.raises(ValueError):
        presets.apply_operations(people, [{"operation": "explode"}])


def test_unknown_aggregate_raises(people):
    with pytest.raises(ValueError):
        aggregates.aggregate(people, {"columns": ["age"], "aggregation": "mode"})


def test_bulk_merge_keeps_missing_values(spark):
    rec = spark.createDataFrame([(1, 1, "a", 1.0), (2, 2, "b", 2.0)], "id long, row_number long, s string, v double")
    ops = spark.createDataFrame([(0, "update", 1, None, 9.0), (1, "delete", 2, None, None), (2, "update", 2, "z", 1.0),
                                 (3, "create", 7, "n", 0.0), (4, "update", 99, "q", 1.0)],
                                "idx long, op string, id long, s string, v double")
    merged, status = records.bulk_apply(rec, ops, ["s", "v"], merge=True)
    assert rows(merged) == [(1, 1, "a", 9.0), (7, 3, "n", 0.0)]
    assert [r["status"] for r in status.orderBy("idx").collect()] == ["updated", "deleted", "not found", "created", "not found"]
    replaced, _ = records.bulk_apply(rec, ops, ["s", "v"])
    assert rows(replaced)[0] == (1, 1, None, 9.0)


def test_quota_runs_across_slots(spark):
    data = [("o", i, 10, datetime(2024, 1, 1) + timedelta(hours=7 * i)) for i in range(10)]
    files = spark.createDataFrame(data, "organization_id string, file_id long, size long, created_at timestamp")
    limits = spark.createDataFrame([("o", 45)], "organization_id string, limit_bytes long")
    out = relations.quota_check(files, limits).orderBy("file_id").collect()
    assert [r["total_bytes"] for r in out] == [10 * (i + 1) for i in range(10)]
    assert [r["within_quota"] for r in out] == [True] * 4 + [False] * 6


def test_confidence_levels(spark):
    df = spark.createDataFrame([(0.75,), (0.5,), (0.49,)], "c double")
    assert [r[0] for r in df.select(insights.confidence_level(F.col("c"))).collect()] == ["high", "medium", "low"]


def wide_frame(spark, n):
    return spark.range(300).select("id", *[F.when(F.col("id") % (i + 3) != 0, (F.col("id") * (i + 7)) % 11).cast("double").alias(f"c{i}")
                                           for i in range(n)])


def plan_lines(df):
    return len(df._jdf.queryExecution().analyzed().toString().splitlines())


@pytest.mark.parametrize("build", [
    lambda df, cols: clean.handle_missing(df, "fill_mode", cols),
    lambda df, cols: presets.normalize(df, rename=False, encode=cols),
    lambda df, cols: presets.numeric_preprocessing(cols).run(df)[0]])
def test_plans_grow_linearly(spark, build):
    sizes = [plan_lines(build(wide_frame(spark, n), [f"c{i}" for i in range(n)])) for n in (2, 4, 6)]
    assert sizes[2] - sizes[1] <= 1.5 * (sizes[1] - sizes[0]) + 30


def test_correlations_of_many_columns(spark):
    import numpy as np
    names = [f"c{i}" for i in range(60)]
    df = wide_frame(spark, 60)
    data = df.toPandas()
    got = {(r["column1"], r["column2"]): (r["correlation"], r["sample_size"]) for r in stats.correlations(df, names).collect()}
    assert len(got) == 60 * 59 // 2
    for (a, b), (r, n) in list(got.items())[::97]:
        both = data[[a, b]].dropna()
        want = both.corr().iloc[0, 1]
        assert n == len(both) and abs(r - (0.0 if np.isnan(want) else want)) < 1e-9


# ---- order statistics by rounds ----

def test_ranks_of_awkward_values(spark):
    draw = random.Random(5)
    columns = {
        "a": [draw.choice([0.0, -0.0, 1.0, 1e308, -1e308, 1e-320, 5e-324, 3.5, None, float("nan")]) for _ in range(400)],
        "b": [draw.gauss(0, 1e6) for _ in range(400)],
        "c": [1e15 + draw.randint(0, 50) / 8 for _ in range(400)],
        "d": [None] * 400,
        "e": [7.25] * 400,
        "f": [float(i % 3) for i in range(400)],
        "g": [draw.choice([float("-inf"), 1.0, 2.0, 3.0]) for _ in range(400)],
    }
    df = spark.createDataFrame(list(zip(*columns.values())), ", ".join(f"{n} double" for n in columns))
    probs = [0.0, 0.01, 0.25, 0.5, 0.9, 1.0]
    ranks = quantiles.Ranks(df, {n: F.col(n) for n in columns})
    got = ranks.percentiles(probs)
    for n, values in columns.items():
        known = sorted(v for v in values if v is not None and v == v)
        for p in probs:
            if not known:
                assert got[n, p] is None
                continue
            spot = p * (len(known) - 1)
            low, high = known[int(spot)], known[min(int(spot) + (spot > int(spot)), len(known) - 1)]
            want = low if low == high else low + (high - low) * (spot - int(spot))
            assert got[n, p] == want or (got[n, p] != got[n, p] and want != want), (n, p)
    center = {n: got[n, 0.5] for n in columns}
    away = ranks.percentiles([0.5], center)
    for n in ("b", "c", "e", "f"):
        known = sorted(abs(v - center[n]) for v in columns[n])
        assert away[n, 0.5] == (known[199] + known[200]) / 2
    assert away["d", 0.5] is None


def test_plans_of_order_statistics_stay_short(spark, tables):
    from gridmill.operators import stats
    for method in ("iqr", "zscore", "modified_z"):
        plan = stats.detect_outliers(tables.orders, "o_totalprice", method, row_number="o_orderkey")._jdf.queryExecution().toString()
        assert plan.count("\n") < 200, method
