"""Rule-based insights from aggregates: trends, correlations, anomalies, quality."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from gridmill.functions.dates import bucket
from gridmill.functions.numbers import as_number
from gridmill.operators.profile import columns_of_kind, quality_score
from gridmill.operators.stats import iqr_outlier_counts, significant_correlations

# fixed values
QUALITY_LIMIT = 80
HIGH, MEDIUM = 0.75, 0.5
CONFIDENCE = {"summary": 0.9, "anomaly": 0.8, "correlation_cap": 0.95}


def trend_series(df: DataFrame, date_column: str, columns: list[str], interval: str = "month") -> DataFrame:
    """Average of each metric per bucket, all metrics in one pass."""
    ts = F.col(date_column)
    return df.filter(ts.isNotNull()).groupBy(bucket(ts, interval).alias("bucket")).agg(
        *[F.avg(as_number(df, c)).alias(c) for c in columns])


def trends(df: DataFrame, date_column: str, columns: list[str], interval: str = "month") -> DataFrame:
    """``time_column, metric_column, data_points`` per metric."""
    series = trend_series(df, date_column, columns, interval)
    rows = [F.struct(F.lit(date_column).alias("time_column"), F.lit(c).alias("metric_column"),
                     F.count(F.lit(1)).alias("data_points")) for c in columns]
    return series.agg(F.array(*rows).alias("r")).select(F.inline("r"))


def trend_evidence(df: DataFrame, date_column: str, columns: list[str], interval: str = "month") -> DataFrame:
    """Start, end, change, average and volatility of each metric's bucket averages."""
    series = trend_series(df, date_column, columns, interval)
    rows = []
    for c in columns:
        there = F.when(F.col(c).isNotNull(), F.col("bucket"))
        rows.append(F.struct(
            F.lit(c).alias("metric_column"), F.min_by(c, there).alias("start_value"),
            F.max_by(c, there).alias("end_value"), F.avg(c).alias("average"),
            F.coalesce(F.stddev_samp(c), F.lit(0.0)).alias("volatility"), F.count(c).alias("data_points")))
    out = series.agg(F.array(*rows).alias("r")).select(F.inline("r"))
    change = F.col("end_value") - F.col("start_value")
    return out.select(
        "*", change.alias("change"),
        F.coalesce(F.try_divide(change * 100.0, F.abs("start_value")), F.lit(0.0)).alias("change_pct"),
        F.when(change > 0, "increasing").when(change < 0, "decreasing").otherwise("stable").alias("direction"))


def anomalies(df: DataFrame, columns: list[str]) -> DataFrame:
    return iqr_outlier_counts(df, columns).filter(F.col("outlier_count") > 0)


def confidence_level(c: Column) -> Column:
    return F.when(c >= HIGH, "high").when(c >= MEDIUM, "medium").otherwise("low")


def _insight(df: DataFrame, kind: str, title: Column, description: Column, confidence: Column, data: Column,
             action: Column) -> DataFrame:
    return df.select(F.lit(kind).alias("type"), title.alias("title"), description.alias("description"),
                     confidence.cast("double").alias("confidence"), data.alias("supporting_data"),
                     action.alias("suggested_action"))


def rule_insights(quality: DataFrame, correlated: DataFrame, found: DataFrame) -> DataFrame:
    """Insight rows from a quality score, significant correlations (in order) and anomaly counts."""
    score = F.col("quality_score")
    shown = F.format_string("%.2f", score)
    low = _insight(
        quality.filter(score < QUALITY_LIMIT), "summary", F.lit("Low quality score"),
        F.concat(F.lit("Quality score "), shown, F.lit(" of 100: check missing and inconsistent values.")),
        F.lit(CONFIDENCE["summary"]), F.create_map(F.lit("quality_score"), shown),
        F.lit("Review missing values and clean the data."))
    r = F.col("correlation")
    names = F.concat(F.col("column1"), F.lit(" and "), F.col("column2"))
    linked = _insight(
        correlated, "correlation", F.concat(names, F.lit(" move together")),
        F.concat(names, F.lit(" show a "), F.col("strength"), F.lit(" "), F.col("direction"),
                 F.lit(" correlation (r="), F.format_string("%.3f", r), F.lit(").")),
        F.least(F.abs(r), F.lit(CONFIDENCE["correlation_cap"])),
        F.create_map(F.lit("correlation"), F.format_string("%.3f", r), F.lit("column1"), F.col("column1"),
                     F.lit("column2"), F.col("column2")),
        F.concat(F.lit("Look into the relation of "), names, F.lit(".")))
    counted = found.agg(F.count(F.lit(1)).alias("n"), F.sum("outlier_count").alias("total")).filter("n > 0")
    n, total = F.col("n").cast("string"), F.col("total").cast("string")
    odd = _insight(
        counted, "anomaly", F.concat(n, F.lit(" columns hold outliers")),
        F.concat(F.lit("Found "), total, F.lit(" outliers in all: errors or notable values.")),
        F.lit(CONFIDENCE["anomaly"]), F.create_map(F.lit("columns"), n, F.lit("outliers"), total),
        F.lit("Check whether the outliers are errors or real extremes."))
    return reduce(DataFrame.unionByName, [low, linked, odd])


def generate_insights(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Quality, correlations and anomalies of a table as insight rows."""
    numeric = columns or columns_of_kind(df, "numeric")
    return rule_insights(quality_score(df), significant_correlations(df, numeric), anomalies(df, numeric))


def by_type(insights: DataFrame) -> DataFrame:
    """``type, total, mean_confidence`` of each insight type."""
    return insights.groupBy("type").agg(F.count(F.lit(1)).alias("total"),
                                        F.avg("confidence").alias("mean_confidence"))


def grouped_by_type(insights: DataFrame) -> DataFrame:
    """Insight rows with the total of their type."""
    return insights.join(by_type(insights).select("type", "total"), "type")


def list_insights(insights: DataFrame, kind: str | None = None, min_confidence: float | None = None,
                  sort_by: str = "confidence", descending: bool = True, tie_break: str = "title") -> DataFrame:
    if sort_by not in ("confidence", "created_at"):
        raise ValueError(f"cannot sort by {sort_by!r}")
    out = insights if kind is None else insights.filter(F.col("type") == kind)
    out = out if min_confidence is None else out.filter(F.col("confidence") >= min_confidence)
    return out.orderBy(F.col(sort_by).desc() if descending else F.col(sort_by).asc(), F.col(tie_break))
