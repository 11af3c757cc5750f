"""Grouped and global aggregates, time buckets and their shaping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gridmill.functions.dates import bucket, bucket_label
from gridmill.functions.numbers import as_number
from gridmill.operators.predicates import AGGREGATE_OPERATORS, apply_filters
from gridmill.operators.quantiles import percentile_table

FUNCTIONS = {
    "sum": F.sum, "avg": F.avg, "mean": F.avg, "count": F.count, "min": F.min, "max": F.max,
}
AGGREGATIONS = (*FUNCTIONS, "median")


def measure(df: DataFrame, name: str, aggregation: str) -> Column:
    """``count`` counts any value, the others read the column as a number."""
    if aggregation not in FUNCTIONS:
        raise ValueError(f"unknown aggregation {aggregation!r}; use one of {AGGREGATIONS}")
    return FUNCTIONS[aggregation](F.col(name) if aggregation == "count" else as_number(df, name))


def validate_config(config: dict) -> None:
    if not config.get("columns"):
        raise ValueError("config needs columns")
    if config.get("aggregation", "sum") not in AGGREGATIONS:
        raise ValueError(f"unknown aggregation {config['aggregation']!r}; use one of {AGGREGATIONS}")
    if config.get("limit") is not None and int(config["limit"]) < 1:
        raise ValueError("limit must be positive")
    for f in config.get("filters") or []:
        if f.get("operator") not in AGGREGATE_OPERATORS:
            raise ValueError(f"unknown operator {f.get('operator')!r}")


def aggregate(df: DataFrame, config: dict) -> DataFrame:
    """``{columns, aggregation, grouping?, filters?, limit?}`` to ``label, <column>...``.

    Null labels read "null", null measures 0; rows come in label order, all of them unless the config names a limit.  Without
    grouping there is one row and no label.
    """
    validate_config(config)
    columns, fn = config["columns"], config.get("aggregation", "sum")
    grouping = config.get("grouping")
    rows = apply_filters(df, config.get("filters"), AGGREGATE_OPERATORS)
    keys = [F.coalesce(F.col(grouping).cast("string"), F.lit("null")).alias("label")] if grouping else []
    if fn == "median":
        out = _medians(rows, columns, keys)
    else:
        out = rows.groupBy(*keys).agg(*[measure(rows, c, fn).alias(c) for c in columns])
    out = out.select(*[k for k in ("label",) if grouping],
                     *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in columns])
    if not grouping:
        return out
    return out.orderBy("label") if config.get("limit") is None else out.orderBy("label").limit(int(config["limit"]))


def _medians(rows: DataFrame, columns: list[str], keys: list[Column]) -> DataFrame:
    label = keys or [F.lit("").alias("label")]
    narrow = rows.select(*label, *[as_number(rows, c).alias(c) for c in columns])
    long = narrow.unpivot(["label"], columns, "_col", "_v")
    medians = percentile_table(long, "_v", [0.5], ["label", "_col"])
    picked = [F.max(F.when(F.col("_col") == c, F.col("value"))).alias(c) for c in columns]
    # groups without any readable value must stay, so labels come from the rows
    out = medians.groupBy("label").agg(*picked)
    return narrow.select("label").distinct().join(out, "label", "left") if keys else out.drop("label")


def with_totals(df: DataFrame, config: dict) -> DataFrame:
    """The aggregate plus ``total_records`` of the table and ``filtered_records`` under the filters."""
    rows = apply_filters(df, config.get("filters"), AGGREGATE_OPERATORS)
    return aggregate(df, config).withColumn(
        "total_records", df.agg(F.count(F.lit(1)).alias("n")).scalar()).withColumn(
        "filtered_records", rows.agg(F.count(F.lit(1)).alias("n")).scalar())


def by_time(df: DataFrame, date_column: str, interval: str, metric: dict | None = None) -> DataFrame:
    """``label, bucket, value`` per time bucket; without a metric rows are counted; null dates drop out."""
    ts = F.col(date_column)
    if metric is None:
        value = F.count(F.lit(1))
    else:
        value = measure(df, metric["column"], metric["aggregation"])
    out = df.filter(ts.isNotNull()).groupBy(bucket(ts, interval).alias("bucket")).agg(value.alias("value"))
    return out.select(bucket_label(F.col("bucket"), interval).alias("label"), "bucket",
                      F.coalesce(F.col("value").cast("double"), F.lit(0.0)).alias("value"))


def global_metric(df: DataFrame, column: str, aggregation: str, filters=None) -> DataFrame:
    """One number over a dataset, as shown on a stat card."""
    out = aggregate(df, {"columns": [column], "aggregation": aggregation, "filters": filters})
    return out.select(F.lit(column).alias("column"), F.lit(aggregation).alias("aggregation"),
                      F.col(column).alias("value"))


def distinct_sorted(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct().orderBy(column)


def usage_totals(events: DataFrame, tenant: str, metric: str, amount: str, at: str) -> DataFrame:
    """Usage per tenant, metric and month; a new month starts at zero by being a new key."""
    month = F.date_format(F.date_trunc("month", F.col(at)), "yyyy-MM").alias("month")
    return events.groupBy(tenant, metric, month).agg(F.sum(amount).alias("usage"))


def reset_metric(usage: DataFrame, metric: str, tenant=None, tenant_column: str = "organization_id",
                 metric_column: str = "metric") -> DataFrame:
    hit = F.col(metric_column) == metric
    if tenant is not None:
        hit = hit & (F.col(tenant_column) == tenant)
    return usage.withColumn("usage", F.when(hit, F.lit(0.0)).otherwise(F.col("usage")))


def shared_scan(df: DataFrame, widgets: dict[str, dict]) -> DataFrame:
    """Many stat cards over one table in one pass: ``widget, value``."""
    measures = []
    for name, w in widgets.items():
        keep = F.lit(True)
        if w.get("filters"):
            from gridmill.operators.predicates import compile_filters
            keep = compile_filters(df, w["filters"], AGGREGATE_OPERATORS)
        source = F.col(w["column"]) if w["aggregation"] == "count" else as_number(df, w["column"])
        if w["aggregation"] not in FUNCTIONS:
            raise ValueError(f"unknown aggregation {w['aggregation']!r}")
        value = FUNCTIONS[w["aggregation"]](F.when(keep, source))
        measures.append(F.struct(F.lit(name).alias("widget"),
                                 F.coalesce(value.cast("double"), F.lit(0.0)).alias("value")))
    return df.agg(F.array(*measures).alias("w")).select(F.inline("w"))
