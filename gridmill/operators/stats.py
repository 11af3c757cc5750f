"""Descriptive statistics, correlations and outliers."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from gridmill.functions.numbers import as_number
from gridmill.operators.quantiles import median_deviation, percentile_columns

# fixed values
WEAK, MODERATE = 0.3, 0.7
SIGNIFICANT = 0.5
MOMENTS = ["pair", "n", "sx", "sy", "sxx", "syy", "sxy"]
MOMENT_ROWS = 4096
IQR_FACTOR, Z_LIMIT, MODIFIED_Z_LIMIT, MAD_SCALE = 1.5, 3.0, 3.5, 0.6745


def with_scalar(df: DataFrame, one_row: DataFrame, name: str) -> DataFrame:
    """Attach the single row of ``one_row`` as a struct, by scalar subquery."""
    return df.withColumn(name, one_row.select(F.struct(*one_row.columns).alias("s")).scalar())


def one_row_join(left: DataFrame, right: DataFrame) -> DataFrame:
    """Put two one-row frames side by side."""
    tagged = with_scalar(left, right, "_right")
    return tagged.select(*left.columns, *[F.col("_right")[c].alias(c) for c in right.columns])


def describe(df: DataFrame, column: str) -> DataFrame:
    """count, mean, median, std, min, max, q25, q75, sum, variance of the numeric values."""
    x = as_number(df, column)
    moments = df.agg(
        F.count(x).alias("count"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("min"),
        F.max(x).alias("max"), F.sum(x).alias("sum"), F.var_samp(x).alias("variance"))
    quartiles = percentile_columns(df, {"q25": (x, 0.25), "median": (x, 0.5), "q75": (x, 0.75)})
    return one_row_join(moments, quartiles).select(
        "count", "mean", "median", "std", "min", "max", "q25", "q75", "sum", "variance")


def strength(r: Column) -> Column:
    return F.when(F.abs(r) < WEAK, "weak").when(F.abs(r) < MODERATE, "moderate").otherwise("strong")


def direction(r: Column) -> Column:
    return F.when(r > 0, "positive").when(r < 0, "negative").otherwise("none")


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """All column pairs: ``pair, column1, column2, correlation, sample_size, strength, direction``.

    Pairs use the rows that have both values; an undefined correlation is 0.  Every batch of rows gives the sums of all pairs as matrix products,
    after the column means (one row, from a first pass) are taken off; the sums are added per pair.  The plan has the same size for any
    number of columns, and a task holds one batch and a few matrices of columns by columns.
    """
    n = len(columns)
    numbers = [as_number(df, c) for c in columns]
    means = df.agg(F.array(*[F.coalesce(F.avg(x), F.lit(0.0)) for x in numbers]).alias("m"))
    rows = df.select(F.array(*numbers).alias("x")).withColumn("m", means.scalar())
    places = list(combinations(range(n), 2))
    first, second = np.array([a for a, _ in places], int), np.array([b for _, b in places], int)

    def sums(batches):
        total = None
        for batch in batches:
            for lo in range(0, batch.num_rows, MOMENT_ROWS):
                part = batch.slice(lo, MOMENT_ROWS)
                wide = [part.column(c).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, n) for c in ("x", "m")]
                here = ~np.isnan(wide[0])
                off = wide[0] - wide[1]
                off[np.abs(off) <= 1e-12 * np.abs(wide[1])] = 0.0  # a constant column stays one
                x, there = np.where(here, off, 0.0), here.astype(float)
                left, square = x.T @ there, (x * x).T @ there
                new = np.stack([(there.T @ there)[first, second], left[first, second], left[second, first],
                                square[first, second], square[second, first], (x.T @ x)[first, second]])
                total = new if total is None else total + new
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(places), dtype=np.int32)), *(pa.array(t) for t in total)], MOMENTS)

    found = rows.mapInArrow(sums, "pair int, " + ", ".join(f"{m} double" for m in MOMENTS[1:])).groupBy("pair").agg(
        *[F.sum(m).alias(m) for m in MOMENTS[1:]])
    names = df.sparkSession.createDataFrame([(i, columns[a], columns[b]) for i, (a, b) in enumerate(places)],
                                            "pair int, column1 string, column2 string")
    spread = lambda s, q: F.greatest(F.col(q) - F.col(s) * F.try_divide(F.col(s), F.col("n")), F.lit(0.0))
    together = F.col("sxy") - F.col("sx") * F.try_divide(F.col("sy"), F.col("n"))
    r = F.col("correlation")
    return (names.join(found, "pair", "left").select(
        "pair", "column1", "column2",
        F.greatest(F.least(F.coalesce(F.try_divide(together, F.sqrt(spread("sx", "sxx")) * F.sqrt(spread("sy", "syy"))), F.lit(0.0)),
                           F.lit(1.0)), F.lit(-1.0)).alias("correlation"),
        F.coalesce(F.col("n").cast("bigint"), F.lit(0)).alias("sample_size"))
            .withColumn("strength", strength(r)).withColumn("direction", direction(r)))


def correlation(df: DataFrame, column1: str, column2: str) -> DataFrame:
    return correlations(df, [column1, column2]).drop("pair")


def significant_correlations(df: DataFrame, columns: list[str], limit: int | None = None) -> DataFrame:
    """Pairs with |r| > 0.5 in column order; with a limit, the strongest of them."""
    found = correlations(df, columns).filter(F.abs("correlation") > SIGNIFICANT)
    if limit is not None:
        found = found.orderBy(F.abs("correlation").desc(), "pair").limit(limit)
    return found.orderBy("pair")


def iqr_bounds(df: DataFrame, x: Column, factor: float = IQR_FACTOR) -> DataFrame:
    q = percentile_columns(df, {"q1": (x, 0.25), "q3": (x, 0.75)})
    spread = (F.col("q3") - F.col("q1")) * factor
    return q.select("q1", "q3", (F.col("q1") - spread).alias("lower"), (F.col("q3") + spread).alias("upper"))


def score_outliers(df: DataFrame, column: str, method: str = "iqr", threshold: float | None = None) -> DataFrame:
    """Add ``_x``, ``_score`` (distance by which outliers rank), ``_is_outlier``, ``_lower`` and ``_upper``."""
    x = as_number(df, column)
    if method == "iqr":
        limits = iqr_bounds(df, x, IQR_FACTOR if threshold is None else threshold)
        limits = limits.select(((F.col("q1") + F.col("q3")) / 2).alias("center"), F.lit(1.0).alias("unit"),
                               "lower", "upper")
    elif method == "zscore":
        cut = Z_LIMIT if threshold is None else threshold
        s = df.agg(F.avg(x).alias("center"), F.stddev_samp(x).alias("unit"))
        limits = s.select("center", "unit", (F.col("center") - cut * F.col("unit")).alias("lower"),
                          (F.col("center") + cut * F.col("unit")).alias("upper"))
    elif method == "modified_z":
        cut = MODIFIED_Z_LIMIT if threshold is None else threshold
        both = median_deviation(df, x).select("center", (F.col("mad") / MAD_SCALE).alias("unit"))
        limits = both.select("center", "unit", (F.col("center") - cut * F.col("unit")).alias("lower"),
                             (F.col("center") + cut * F.col("unit")).alias("upper"))
    else:
        raise ValueError(f"unknown method {method!r}; use iqr, zscore or modified_z")
    out = with_scalar(df, limits, "_l").withColumn("_x", x)
    score = F.try_divide(F.abs(F.col("_x") - F.col("_l.center")), F.col("_l.unit"))
    beyond = (F.col("_x") < F.col("_l.lower")) | (F.col("_x") > F.col("_l.upper"))
    # without spread (unit 0) nothing can be scored
    return (out.withColumn("_score", score).withColumn("_lower", F.col("_l.lower"))
            .withColumn("_upper", F.col("_l.upper"))
            .withColumn("_is_outlier", F.coalesce(beyond & F.col("_score").isNotNull(), F.lit(False))).drop("_l"))


def detect_outliers(df: DataFrame, column: str, method: str = "iqr", row_number: str = "row_number",
                    threshold: float | None = None, listed: int | None = None) -> DataFrame:
    """Outlying rows, the most extreme first: ``row_number, value, score, lower, upper``; all, or the first ``listed``."""
    scored = score_outliers(df, column, method, threshold).filter("_is_outlier")
    rows = scored.select(row_number, F.col("_x").alias("value"), F.col("_score").alias("score"),
                         F.col("_lower").alias("lower"), F.col("_upper").alias("upper"))
    ranked = rows.orderBy(F.col("score").desc(), F.col(row_number))
    return ranked if listed is None else ranked.limit(listed)


def outlier_summary(df: DataFrame, column: str, method: str = "iqr", threshold: float | None = None) -> DataFrame:
    """Limits and the true number of outliers."""
    scored = score_outliers(df, column, method, threshold)
    return scored.agg(
        F.max("_lower").alias("lower"), F.max("_upper").alias("upper"), F.count("_x").alias("total"),
        F.count_if("_is_outlier").alias("outlier_count")).select(
        F.lit(method).alias("method"), "lower", "upper", "total", "outlier_count",
        F.coalesce(F.try_divide(F.col("outlier_count") * 100.0, F.col("total")), F.lit(0.0)).alias("outlier_pct"))


def iqr_outlier_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """Outlier counts of many columns: one percentile pass and one counting pass."""
    numbers = {c: as_number(df, c) for c in columns}
    wanted = {}
    for i, x in enumerate(numbers.values()):
        wanted[f"q1_{i}"], wanted[f"q3_{i}"] = (x, 0.25), (x, 0.75)
    tagged = with_scalar(df, percentile_columns(df, wanted), "_q")
    rows = []
    for i, (name, x) in enumerate(numbers.items()):
        q1, q3 = F.col(f"_q.q1_{i}"), F.col(f"_q.q3_{i}")
        spread = (q3 - q1) * IQR_FACTOR
        rows.append(F.struct(F.lit(i).alias("position"), F.lit(name).alias("column"),
                             F.count_if((x < q1 - spread) | (x > q3 + spread)).alias("outlier_count"),
                             F.count(x).alias("total_records"), F.lit("iqr").alias("method")))
    return tagged.agg(F.array(*rows).alias("r")).select(F.inline("r"))


def remove_outliers(df: DataFrame, column: str, method: str = "iqr", threshold: float | None = None) -> DataFrame:
    """Drop outlying rows; rows without a value stay."""
    if method not in ("iqr", "zscore"):
        raise ValueError(f"unknown method {method!r}; use iqr or zscore")
    return score_outliers(df, column, method, threshold).filter(~F.col("_is_outlier")).select(*df.columns)


def removed_report(df: DataFrame, column: str, method: str = "iqr", threshold: float | None = None) -> DataFrame:
    scored = score_outliers(df, column, method, threshold)
    gone = F.when(F.col("_is_outlier"), F.col("_x"))
    return scored.agg(F.count(F.lit(1)).alias("rows_before"), F.count(gone).alias("removed"),
                      F.min(gone).alias("min_removed"), F.max(gone).alias("max_removed"))


def removed_rows(df: DataFrame, column: str, row_number: str, method: str = "iqr", threshold: float | None = None,
                 limit: int | None = None) -> DataFrame:
    """``row_number, value`` of the rows that ``remove_outliers`` drops, in row order; all, or the first ``limit``."""
    gone = score_outliers(df, column, method, threshold).filter("_is_outlier").select(row_number, F.col("_x").alias("value"))
    ranked = gone.orderBy(row_number)
    return ranked if limit is None else ranked.limit(limit)
