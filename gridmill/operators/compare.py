"""Comparison of two datasets: their schemas and their numeric columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gridmill.functions.numbers import as_number
from gridmill.operators.profile import columns_of_kind, kind_of, long_stats
from gridmill.operators.quantiles import percentile_rows


def schema_frame(df: DataFrame) -> DataFrame:
    """The schema as rows, one per column."""
    rows = [(f.name, kind_of(f.dataType)) for f in df.schema]
    return df.sparkSession.createDataFrame(rows, "column string, type string")


def compare_schemas(left: DataFrame, right: DataFrame) -> DataFrame:
    a = schema_frame(left).select("column", F.col("type").alias("type1"))
    b = schema_frame(right).select("column", F.col("type").alias("type2"))
    both = a.join(b, "column", "full_outer")
    status = (F.when(F.col("type2").isNull(), "only_1").when(F.col("type1").isNull(), "only_2")
              .when(F.col("type1") != F.col("type2"), "type_diff").otherwise("common"))
    return both.select("column", "type1", "type2", status.alias("status"))


def common_columns(left: DataFrame, right: DataFrame) -> DataFrame:
    return schema_frame(left).select("column").intersect(schema_frame(right).select("column"))


def columns_only_in(left: DataFrame, right: DataFrame) -> DataFrame:
    return schema_frame(left).select("column").exceptAll(schema_frame(right).select("column"))


def numeric_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    narrow = df.select(*[as_number(df, c).alias(c) for c in columns])
    stats = long_stats(narrow, columns, lambda c: [
        F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).alias("min"), F.max(c).alias("max")])
    medians = percentile_rows(narrow, {c: F.col(c) for c in columns}, [0.5]).select("column", F.col("value").alias("median"))
    return stats.drop("position").join(medians, "column", "left")


def compare_datasets(left: DataFrame, right: DataFrame) -> DataFrame:
    """Statistics side by side for every numeric column both datasets have, with absolute differences."""
    common = [c for c in columns_of_kind(left, "numeric") if c in columns_of_kind(right, "numeric")]
    if not common:
        raise ValueError("the datasets share no numeric column")
    metrics = ["mean", "median", "std", "min", "max"]
    a = numeric_profile(left, common).select("column", *[F.col(m).alias(f"{m}_1") for m in metrics])
    b = numeric_profile(right, common).select("column", *[F.col(m).alias(f"{m}_2") for m in metrics])
    return a.join(b, "column").select(
        "*", F.abs(F.col("mean_1") - F.col("mean_2")).alias("mean_diff"),
        F.abs(F.col("median_1") - F.col("median_2")).alias("median_diff"))


def row_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of ``left`` missing from ``right``, duplicates counted."""
    return left.exceptAll(right)
