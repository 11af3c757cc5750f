"""Grouped aggregates, time buckets, statistics, outliers."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridmill.operators import aggregates as A, quantiles as Q, stats as S
from gridmill.registry.base import EVENTS_NULL, events_null, query, rounded

FLAGSHIP = {
    "columns": ["o_totalprice"], "aggregation": "sum", "grouping": "o_orderpriority",
    "filters": [{"column": "o_orderstatus", "operator": "eq", "value": "F"}],
}


@query("agg_group_sum", "AGG01 AGG03 AGG05", """
    SELECT o_orderpriority AS label, round(sum(o_totalprice), 2) AS o_totalprice FROM orders
    WHERE o_orderstatus = 'F' GROUP BY 1""")
def flagship(t):
    return rounded(A.aggregate(t.orders, FLAGSHIP), 2, "o_totalprice")


def _group(fn, sql_fn):
    @query(f"agg_group_{fn}", "AGG01 AGG03" if fn != "median" else "AGG04", f"""
        SELECT l_returnflag AS label, round(CAST({sql_fn}(l_extendedprice) AS DOUBLE), 4) AS l_extendedprice,
               round(CAST({sql_fn}(l_quantity) AS DOUBLE), 4) AS l_quantity
        FROM lineitem WHERE l_quantity > 5 GROUP BY 1""")
    def build(t):
        config = {"columns": ["l_extendedprice", "l_quantity"], "aggregation": fn, "grouping": "l_returnflag",
                  "filters": [{"column": "l_quantity", "operator": "gt", "value": 5}]}
        return rounded(A.aggregate(t.lineitem, config), 4, "l_extendedprice", "l_quantity")


for _fn, _sql in [("avg", "avg"), ("mean", "avg"), ("count", "count"), ("min", "min"), ("max", "max"), ("median", "median")]:
    _group(_fn, _sql)


@query("agg_global", "AGG02", """
    SELECT round(sum(l_extendedprice), 2) AS l_extendedprice, round(sum(l_quantity), 2) AS l_quantity FROM lineitem
    WHERE l_returnflag = 'A'""")
def _(t):
    config = {"columns": ["l_extendedprice", "l_quantity"], "aggregation": "sum",
              "filters": [{"column": "l_returnflag", "operator": "eq", "value": "A"}]}
    return rounded(A.aggregate(t.lineitem, config), 2, "l_extendedprice", "l_quantity")


@query("agg_multi", "AGG01", """
    SELECT p_brand AS label, round(avg(p_size), 6) AS p_size, round(avg(p_retailprice), 6) AS p_retailprice
    FROM part GROUP BY 1""")
def _(t):
    config = {"columns": ["p_size", "p_retailprice"], "aggregation": "avg", "grouping": "p_brand"}
    return rounded(A.aggregate(t.part, config), 6, "p_size", "p_retailprice")


@query("agg_many_groups", "AGG01 AGG03", """
    SELECT CAST(l_orderkey AS VARCHAR) AS label, round(sum(l_quantity), 4) AS l_quantity FROM lineitem GROUP BY 1""")
def _(t):
    return rounded(A.aggregate(t.lineitem, {"columns": ["l_quantity"], "aggregation": "sum", "grouping": "l_orderkey"}), 4, "l_quantity")


@query("agg_limited", "AGG05", """
    SELECT CAST(l_orderkey AS VARCHAR) AS label, round(sum(l_quantity), 4) AS l_quantity FROM lineitem GROUP BY 1 ORDER BY 1 LIMIT 20""")
def _(t):
    config = {"columns": ["l_quantity"], "aggregation": "sum", "grouping": "l_orderkey", "limit": 20}
    return rounded(A.aggregate(t.lineitem, config), 4, "l_quantity")


@query("agg_null_label", "AGG05", f"""
    SELECT coalesce(kind, 'null') AS label, round(coalesce(sum(v), 0), 2) AS v,
           (SELECT count(*) FROM events) AS total_records,
           (SELECT count(*) FROM ({EVENTS_NULL}) WHERE v > 10) AS filtered_records
    FROM ({EVENTS_NULL}) WHERE v > 10 GROUP BY 1""")
def _(t):
    config = {"columns": ["v"], "aggregation": "sum", "grouping": "kind",
              "filters": [{"column": "v", "operator": "gt", "value": 10}]}
    return rounded(A.with_totals(events_null(t), config), 2, "v")


LABELS = {"hour": "%Y-%m-%d %H:00", "day": "%Y-%m-%d", "week": "%Y-W%U", "month": "%Y-%m", "year": "%Y"}


def _time(interval, table, ts, column, fn, covers):
    @query(f"time_{interval}", covers, f"""
        SELECT strftime(b, '{LABELS[interval]}') AS label, round(v, 4) AS value
        FROM (SELECT date_trunc('{interval}', {ts}) AS b, {fn}({column}) AS v FROM {table} GROUP BY 1)""")
    def build(t):
        out = A.by_time(getattr(t, table), ts, interval, {"column": column, "aggregation": fn})
        return out.select("label", F.round("value", 4).alias("value"))


_time("hour", "events", "ts", "value", "sum", "AGG06 FN11 FN12")
_time("day", "events", "ts", "value", "avg", "AGG07 FN11 FN12")
_time("week", "orders", "o_orderdate", "o_totalprice", "sum", "AGG08 FN11 FN12")
_time("month", "orders", "o_orderdate", "o_totalprice", "max", "AGG09 FN11 FN12")
_time("year", "orders", "o_orderdate", "o_totalprice", "avg", "AGG10 FN11 FN12")


@query("time_count", "AGG11", """
    SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS label, CAST(count(*) AS DOUBLE) AS value FROM events GROUP BY 1""")
def _(t):
    return A.by_time(t.events, "ts", "day").select("label", "value")


@query("stat_card", "INS12", "SELECT 'o_totalprice' AS \"column\", 'max' AS aggregation, max(o_totalprice) AS value FROM orders")
def _(t):
    return A.global_metric(t.orders, "o_totalprice", "max")


@query("dashboard_cards", "INS13", """
    SELECT 'orders' AS widget, CAST(count(o_orderkey) AS DOUBLE) AS value FROM orders
    UNION ALL SELECT 'open value', round(sum(o_totalprice), 2) FROM orders WHERE o_orderstatus = 'O'
    UNION ALL SELECT 'largest', max(o_totalprice) FROM orders
    UNION ALL SELECT 'mean urgent', round(avg(o_totalprice), 2) FROM orders WHERE o_orderpriority = '1-URGENT'""")
def _(t):
    widgets = {
        "orders": {"column": "o_orderkey", "aggregation": "count"},
        "open value": {"column": "o_totalprice", "aggregation": "sum",
                       "filters": [{"column": "o_orderstatus", "operator": "eq", "value": "O"}]},
        "largest": {"column": "o_totalprice", "aggregation": "max"},
        "mean urgent": {"column": "o_totalprice", "aggregation": "avg",
                        "filters": [{"column": "o_orderpriority", "operator": "eq", "value": "1-URGENT"}]},
    }
    return rounded(A.shared_scan(t.orders, widgets), 2, "value")


@query("distinct_sorted", "AGG33", "SELECT DISTINCT p_brand FROM part ORDER BY 1")
def _(t):
    return A.distinct_sorted(t.part, "p_brand")


@query("usage_totals", "AGG34", """
    SELECT user_id, event_type, strftime(ts, '%Y-%m') AS month, round(sum(value), 2) AS usage FROM events GROUP BY ALL""")
def _(t):
    return rounded(A.usage_totals(t.events, "user_id", "event_type", "value", "ts"), 2, "usage")


@query("usage_reset", "AGG34", """
    SELECT user_id, event_type, month, CASE WHEN event_type = 'view' THEN 0 ELSE u END AS usage
    FROM (SELECT user_id, event_type, strftime(ts, '%Y-%m') AS month, round(sum(value), 2) AS u FROM events GROUP BY ALL)""")
def _(t):
    usage = A.usage_totals(t.events, "user_id", "event_type", "value", "ts")
    return rounded(A.reset_metric(usage, "view", metric_column="event_type"), 2, "usage")


# --- statistics --------------------------------------------------------------

@query("describe_col", "AGG12 FN15", """
    SELECT count(l_extendedprice) AS count, round(avg(l_extendedprice), 6) AS mean,
           round(median(l_extendedprice), 6) AS median, round(stddev_samp(l_extendedprice), 4) AS std,
           min(l_extendedprice) AS min, max(l_extendedprice) AS max,
           round(quantile_cont(l_extendedprice, 0.25), 6) AS q25, round(quantile_cont(l_extendedprice, 0.75), 6) AS q75,
           round(sum(l_extendedprice), 2) AS sum, round(var_samp(l_extendedprice), 2) AS variance
    FROM lineitem""")
def _(t):
    out = rounded(S.describe(t.lineitem, "l_extendedprice"), 6, "mean", "median", "q25", "q75")
    return rounded(rounded(out, 4, "std"), 2, "sum", "variance")


@query("describe_text", "AGG12 FN04", """
    WITH x AS (SELECT CASE WHEN event_id % 3 = 0 THEN 'n/a' WHEN event_id % 5 = 0 THEN '1e5'
                           ELSE CAST(event_id % 97 AS VARCHAR) END AS raw FROM events),
    y AS (SELECT CAST(raw AS DOUBLE) AS v FROM x WHERE regexp_matches(raw, '^-?[0-9]+\\.?[0-9]*$'))
    SELECT count(v) AS count, round(avg(v), 6) AS mean, median(v) AS median, round(stddev_samp(v), 6) AS std,
           max(v) AS max, sum(v) AS sum FROM y""")
def _(t):
    i = F.col("event_id")
    raw = t.events.select(F.when(i % 3 == 0, "n/a").when(i % 5 == 0, "1e5").otherwise((i % 97).cast("string")).alias("raw"))
    return rounded(S.describe(raw, "raw"), 6, "mean", "std").select("count", "mean", "median", "std", "max", "sum")


@query("percentiles_by_group", "AGG04 AGG12", """
    WITH q AS (SELECT l_returnflag, quantile_cont(l_extendedprice, [0.05, 0.25, 0.5, 0.75, 0.95]) AS a FROM lineitem GROUP BY 1)
    SELECT l_returnflag, p, round(v, 4) AS value
    FROM (SELECT l_returnflag, unnest([0.05, 0.25, 0.5, 0.75, 0.95]::DOUBLE[]) AS p, unnest(a) AS v FROM q)""")
def _(t):
    # the spread plan, which large tables take by themselves
    out = Q.percentile_table(t.lineitem, "l_extendedprice", [0.05, 0.25, 0.5, 0.75, 0.95], ["l_returnflag"])
    return rounded(out, 4, "value")


CORR = """round(corr({a}, {b}), 6) AS correlation, count(*) AS sample_size,
    CASE WHEN abs(corr({a}, {b})) < 0.3 THEN 'weak' WHEN abs(corr({a}, {b})) < 0.7 THEN 'moderate' ELSE 'strong' END AS strength,
    CASE WHEN corr({a}, {b}) > 0 THEN 'positive' WHEN corr({a}, {b}) < 0 THEN 'negative' ELSE 'none' END AS direction"""


def _corr_sql(table, pairs):
    return " UNION ALL ".join(
        f"SELECT '{a}' AS column1, '{b}' AS column2, {CORR.format(a=a, b=b)} FROM {table}" for a, b in pairs)


@query("corr_pair", "AGG13", _corr_sql("lineitem", [("l_quantity", "l_extendedprice")]))
def _(t):
    return rounded(S.correlation(t.lineitem, "l_quantity", "l_extendedprice"), 6, "correlation")


LINE_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("corr_matrix", "AGG14", _corr_sql("lineitem", [
    (a, b) for i, a in enumerate(LINE_NUMBERS) for b in LINE_NUMBERS[i + 1:]]))
def _(t):
    return rounded(S.correlations(t.lineitem, LINE_NUMBERS).drop("pair"), 6, "correlation")


CUBES = "(SELECT user_id, value, value * value * value AS cube, -value AS minus FROM events)"
CUBE_COLUMNS = ["user_id", "value", "cube", "minus"]


@query("corr_significant", "AGG14", f"""
    SELECT * FROM ({_corr_sql(CUBES, [(a, b) for i, a in enumerate(CUBE_COLUMNS) for b in CUBE_COLUMNS[i + 1:]])})
    WHERE abs(correlation) > 0.5""")
def _(t):
    v = F.col("value")
    df = t.events.select("user_id", "value", (v * v * v).alias("cube"), (-v).alias("minus"))
    return rounded(S.significant_correlations(df, CUBE_COLUMNS).drop("pair"), 6, "correlation")


@query("corr_constant", "AGG13", """
    SELECT 'user_id' AS column1, 'one' AS column2, CAST(0 AS DOUBLE) AS correlation, count(*) AS sample_size, 'weak' AS strength,
           'none' AS direction FROM events""")
def _(t):
    return S.correlation(t.events.withColumn("one", F.lit(1.0)), "user_id", "one")


# squares of the values have outliers under every method
SKEWED = "SELECT event_id, value, value * value * value AS x FROM events"


def _skewed(t):
    v = F.col("value")
    return t.events.select("event_id", "value", (v * v * v).alias("x"))


IQR = f"""
    WITH e AS ({SKEWED}), q AS (SELECT quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.75) AS q3 FROM e),
    s AS (SELECT (q1 + q3) / 2 AS center, 1.0 AS unit, q1 - 1.5 * (q3 - q1) AS lower, q3 + 1.5 * (q3 - q1) AS upper FROM q)"""
ZSCORE = f"""
    WITH e AS ({SKEWED}), m AS (SELECT avg(x) AS center, stddev_samp(x) AS unit FROM e),
    s AS (SELECT *, center - 3 * unit AS lower, center + 3 * unit AS upper FROM m)"""
MODZ = f"""
    WITH e AS ({SKEWED}), m AS (SELECT median(x) AS center FROM e),
    d AS (SELECT median(abs(x - center)) / CAST(0.6745 AS DOUBLE) AS unit FROM e, m),
    s AS (SELECT center, unit, center - 3.5 * unit AS lower, center + 3.5 * unit AS upper FROM m, d)"""


def _outliers(name, method, ctes, covers):
    @query(f"outliers_{name}", covers, f"""{ctes}
        SELECT event_id, round(x, 3) AS value FROM e, s WHERE x < lower OR x > upper
        ORDER BY abs(x - center) DESC, event_id LIMIT 100""")
    def rows(t):
        return rounded(S.detect_outliers(_skewed(t), "x", method, "event_id", listed=100).select("event_id", "value"), 3, "value")

    @query(f"outlier_summary_{name}", "AGG18 JOI05", f"""{ctes}
        SELECT '{method}' AS method, round(max(lower), 3) AS lower, round(max(upper), 3) AS upper, count(x) AS total,
               count(*) FILTER (x < lower OR x > upper) AS outlier_count,
               round(100.0 * count(*) FILTER (x < lower OR x > upper) / count(x), 6) AS outlier_pct FROM e, s""")
    def summary(t):
        return rounded(rounded(S.outlier_summary(_skewed(t), "x", method), 3, "lower", "upper"), 6, "outlier_pct")


_outliers("iqr", "iqr", IQR, "AGG15 SRT04 JOI05")
_outliers("zscore", "zscore", ZSCORE, "AGG16 SRT04 JOI05")
_outliers("modz", "modified_z", MODZ, "AGG17 SRT04 JOI05")


def _removed(name, ctes, covers):
    @query(f"remove_outliers_{name}", covers, f"{ctes} SELECT event_id, value FROM e, s WHERE NOT (x < lower OR x > upper)")
    def build(t):
        return S.remove_outliers(_skewed(t), "x", name).select("event_id", "value")


@query("removed_rows", "CLN15", f"{IQR} SELECT event_id, round(x, 3) AS value FROM e, s WHERE x < lower OR x > upper")
def _(t):
    return rounded(S.removed_rows(_skewed(t), "x", "event_id"), 3, "value")


_removed("iqr", IQR, "CLN13")
_removed("zscore", ZSCORE, "CLN14")


@query("removed_report", "CLN15", f"""{IQR}
    SELECT count(*) AS rows_before, count(*) FILTER (x < lower OR x > upper) AS removed,
           round(min(x) FILTER (x < lower OR x > upper), 3) AS min_removed,
           round(max(x) FILTER (x < lower OR x > upper), 3) AS max_removed FROM e, s""")
def _(t):
    return rounded(S.removed_report(_skewed(t), "x"), 3, "min_removed", "max_removed")
