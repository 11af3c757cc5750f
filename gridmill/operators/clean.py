"""Duplicates, missing values, text and number cleaning."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from gridmill.functions.dates import java_pattern, parse_timestamp
from gridmill.functions.numbers import CURRENCY_MARKS, as_number, clean_number, is_numeric, missing, percent
from gridmill.functions.text import strip, to_case
from gridmill.operators.ordered import fill_backward, fill_forward, interpolate
from gridmill.operators.quantiles import percentile_columns
from gridmill.operators.stats import with_scalar


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]


def _check(df: DataFrame, columns: list[str]) -> list[str]:
    absent = [c for c in columns if c not in df.columns]
    if absent:
        raise ValueError(f"columns not found: {absent}")
    return columns


def drop_duplicates(df: DataFrame, subset: list[str] | None = None, keep: str = "first",
                    row_number: str = "row_number") -> DataFrame:
    """Keep the first or last row of each group of equal rows, or none of a repeated group.

    Each task forwards at most one row per group to the shuffle, so a group that
    holds a third of the table is as cheap as any other.
    """
    names = _check(df, subset or [c for c in df.columns if c != row_number])
    if keep in ("first", "last"):
        order = F.col(row_number).asc() if keep == "first" else F.col(row_number).desc()
        # sorting by a hash first compares long texts only when they are equal
        groups = Window.partitionBy(F.xxhash64(*names), *names).orderBy(order)
        return df.withColumn("_n", F.row_number().over(groups)).filter("_n = 1").drop("_n")
    if keep in ("none", False):
        rest = [c for c in df.columns if c not in names]
        # a group that is kept has one row, so any picked value is that row's value
        picked = df.groupBy(*names).agg(F.count(F.lit(1)).alias("_n"), *[F.any_value(c).alias(c) for c in rest])
        return picked.filter("_n = 1").select(*df.columns)
    raise ValueError(f"unknown keep {keep!r}; use first, last or none")


def duplicate_report(df: DataFrame, subset: list[str]) -> DataFrame:
    """Rows removed by keep-first, rows in repeated groups, repeated groups, and the removed share."""
    groups = df.groupBy(*_check(df, subset)).agg(F.count(F.lit(1)).alias("n"))
    return groups.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows_before"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("removed"),
        F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("duplicate_rows"),
        F.count_if(F.col("n") > 1).alias("duplicate_groups")).select(
        "*", percent(F.col("removed"), F.col("rows_before")).alias("removed_percentage"))


def _fill(df: DataFrame, stats: DataFrame, columns: list[str]) -> DataFrame:
    out = with_scalar(df, stats, "_fill")
    for c in columns:
        out = out.withColumn(c, F.when(missing(df, c), F.col("_fill")[c]).otherwise(F.col(c)))
    return out.drop("_fill")


def handle_missing(df: DataFrame, strategy: str, columns: list[str] | None = None, value=None,
                   row_number: str = "row_number", keys: list[str] | None = None) -> DataFrame:
    """drop, drop_all, fill_mean, fill_median, fill_mode, fill_value, fill_forward, fill_backward, interpolate."""
    names = _check(df, columns or [c for c in df.columns if c != row_number])
    numeric = [c for c in names if is_numeric(df.schema[c].dataType)]
    if strategy in ("drop", "drop_all"):
        gaps = [missing(df, c) for c in names]
        test = reduce((lambda a, b: a | b) if strategy == "drop" else (lambda a, b: a & b), gaps)
        return df.filter(~test)
    if strategy == "fill_mean":
        return _fill(df, df.agg(*[F.avg(as_number(df, c)).alias(c) for c in numeric]), numeric) if numeric else df
    if strategy == "fill_median":
        return _fill(df, percentile_columns(df, {c: (as_number(df, c), 0.5) for c in numeric}), numeric) \
            if numeric else df
    if strategy == "fill_mode":
        def mode(c: str) -> Column:
            counts = df.filter(~missing(df, c)).groupBy(c).agg(F.count(F.lit(1)).alias("_n"))
            return counts.agg(F.min_by(c, F.struct(-F.col("_n"), F.col(c))).alias(c)).scalar()
        # every mode is read from the input, one column at a time, so the plan grows with the columns and not with their product
        return df.withColumns({c: F.when(missing(df, c), mode(c)).otherwise(F.col(c)) for c in names})
    if strategy == "fill_value":
        if value is None:
            raise ValueError("fill_value needs a value")
        for c in names:
            given = value[c] if isinstance(value, dict) else value
            df = df.withColumn(c, F.when(missing(df, c), F.lit(given).try_cast(df.schema[c].dataType))
                               .otherwise(F.col(c)))
        return df
    if strategy == "fill_forward":
        return fill_forward(df, names, row_number, keys)
    if strategy == "fill_backward":
        return fill_backward(df, names, row_number, keys)
    if strategy == "interpolate":
        return interpolate(df, numeric, row_number, keys, dense=False) if numeric else df
    raise ValueError(f"unknown strategy {strategy!r}")


def trim_whitespace(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    names = _check(df, columns or string_columns(df))
    return df.withColumns({c: strip(F.col(c)) for c in names}) if names else df


def change_report(before: DataFrame, columns: list[str], function) -> DataFrame:
    """How many cells of each column a column function changes."""
    from gridmill.operators.profile import long_stats
    return long_stats(before, columns, lambda c: [
        F.count(c).alias("total"), F.count_if(F.col(c) != function(F.col(c))).alias("changed")]).drop("position")


def standardize_case(df: DataFrame, columns: list[str], case: str = "lower") -> DataFrame:
    return df.withColumns({c: to_case(F.col(c), case) for c in _check(df, columns)})


def normalize_dates(df: DataFrame, columns: list[str], target_format: str = "ISO8601",
                    parse_format: str | None = None) -> DataFrame:
    """Timestamps, or text in a strftime format; unreadable values become null."""
    formats = [java_pattern(parse_format)] if parse_format else None
    out = {}
    for c in _check(df, columns):
        ts = F.col(c)
        if isinstance(df.schema[c].dataType, T.StringType):
            ts = parse_timestamp(strip(ts), formats)
        else:
            ts = ts.cast("timestamp_ntz")
        out[c] = ts if target_format == "ISO8601" else F.date_format(ts, java_pattern(target_format))
    return df.withColumns(out)


def conversion_report(before: DataFrame, after: DataFrame, columns: list[str], row_number: str) -> DataFrame:
    """Values converted and lost per column, matching rows by their number."""
    b = before.select(row_number, *[F.col(c).alias(f"b_{c}") for c in columns])
    both = b.join(after.select(row_number, *columns), row_number)
    from gridmill.operators.profile import long_stats
    return long_stats(both, columns, lambda c: [
        F.count_if(F.col(f"b_{c}").isNotNull() & F.col(c).isNotNull()).alias("converted"),
        F.count_if(F.col(f"b_{c}").isNotNull() & F.col(c).isNull()).alias("failed")]).drop("position")


def clean_numeric(df: DataFrame, columns: list[str], remove_chars: str | list[str] | None = None) -> DataFrame:
    """Strip currency marks and read numbers; unreadable values become null; numeric columns stay."""
    marks = CURRENCY_MARKS if remove_chars is None else "".join(remove_chars)
    texts = [c for c in _check(df, columns) if not is_numeric(df.schema[c].dataType)]
    return df.withColumns({c: clean_number(F.col(c), marks) for c in texts}) if texts else df
