"""Data-quality rules.

``rules`` is ``{required_columns: [], data_types: {column: type}, unique_constraints: [[...]],
range_checks: [{column, min, max}], pattern_checks: [{column, pattern, flags}],
foreign_keys: [{column, values}], not_null: []}``.  Every check yields rows
``rule, column, severity, message, invalid_count, total, invalid_percentage``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from gridmill.functions.numbers import as_number, missing, percent
from gridmill.operators.infer import readable

ROW_RULES = ("data_types", "range_checks", "pattern_checks", "not_null")
TYPES = ("integer", "float", "boolean", "date", "datetime", "string")


def _result(spark, rows: list[tuple[str, str, str, str]]) -> DataFrame:
    frame = spark.createDataFrame(rows, "rule string, column string, severity string, message string")
    zero = F.lit(0).cast("bigint")
    return frame.select("*", zero.alias("invalid_count"), zero.alias("total"), F.lit(0.0).alias("invalid_percentage"))


def required_columns(df: DataFrame, required: list[str]) -> DataFrame:
    rows = [("required_columns", c, "info" if c in df.columns else "error",
             "present" if c in df.columns else "missing") for c in required]
    return _result(df.sparkSession, rows)


def prefix_match(c: Column, pattern: str, ignore_case: bool = False) -> Column:
    """The pattern must match at the start of the text; the rest is free."""
    return c.rlike(("(?i)" if ignore_case else "") + f"^(?:{pattern})")


def row_rules(df: DataFrame, rules: dict) -> list[tuple[str, str, Column, Column]]:
    """``(rule, column, counts, invalid)`` for every rule that one row decides."""
    out = []
    for name, kind in (rules.get("data_types") or {}).items():
        if name in df.columns and kind in TYPES:
            present = ~missing(df, name)
            out.append(("data_types", name, present, present & ~readable(df, name, kind)))
    for r in rules.get("range_checks") or []:
        x = as_number(df, r["column"], strict_text=False)
        tests = [x < float(r["min"])] if r.get("min") is not None else []
        tests += [x > float(r["max"])] if r.get("max") is not None else []
        if not tests:
            raise ValueError("a range check needs min or max")
        out.append(("range_checks", r["column"], x.isNotNull(), reduce(lambda a, b: a | b, tests)))
    for r in rules.get("pattern_checks") or []:
        present = ~missing(df, r["column"])
        text = F.col(r["column"]).cast("string")
        out.append(("pattern_checks", r["column"], present,
                    present & ~prefix_match(text, r["pattern"], "i" in r.get("flags", ""))))
    for name in rules.get("not_null") or []:
        out.append(("not_null", name, F.lit(True), missing(df, name)))
    return out


def _shaped(counted: DataFrame) -> DataFrame:
    bad = F.col("invalid_count") > 0
    return counted.select(
        "rule", "column", F.when(bad, "error").otherwise("info").alias("severity"),
        F.when(bad, F.concat(F.col("invalid_count").cast("string"), F.lit(" invalid"))).otherwise("all valid")
        .alias("message"), "invalid_count", "total",
        percent(F.col("invalid_count"), F.col("total")).alias("invalid_percentage"))


def check_rows(df: DataFrame, rules: dict) -> DataFrame:
    """All row rules of the set in one aggregate."""
    checks = [F.struct(F.lit(rule).alias("rule"), F.lit(name).alias("column"),
                       F.count_if(bad).alias("invalid_count"), F.count_if(counts).alias("total"))
              for rule, name, counts, bad in row_rules(df, rules)]
    return _shaped(df.agg(F.array(*checks).alias("c")).select(F.inline("c")))


def value_range(df: DataFrame, column: str) -> DataFrame:
    x = as_number(df, column, strict_text=False)
    return df.agg(F.min(x).alias("actual_min"), F.max(x).alias("actual_max"))


def duplicate_groups(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("count")).filter(F.col("count") > 1)


def check_unique(df: DataFrame, columns: list[str]) -> DataFrame:
    """``invalid_count`` is the number of rows in repeated groups."""
    groups = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))
    counted = groups.agg(F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("invalid_count"),
                         F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    return _shaped(counted.select(F.lit("unique_constraints").alias("rule"), F.lit(",".join(columns)).alias("column"),
                                  "invalid_count", "total"))


def duplicate_values(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows in repeated groups, number of repeated groups and the largest group."""
    groups = duplicate_groups(df, columns)
    return groups.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("duplicate_rows"),
                      F.count(F.lit(1)).alias("duplicate_values"), F.coalesce(F.max("count"), F.lit(0)).alias("largest"))


def top_duplicates(df: DataFrame, columns: list[str], limit: int) -> DataFrame:
    return duplicate_groups(df, columns).orderBy(F.col("count").desc(), *columns).limit(limit)


def orphans(df: DataFrame, column: str, reference: DataFrame, key: str | None = None) -> DataFrame:
    """Rows whose value is not in the reference; nulls are not checked."""
    keys = reference.select(F.col(key or reference.columns[0]).alias("_ref")).distinct()
    return df.filter(F.col(column).isNotNull()).join(keys, F.col(column) == F.col("_ref"), "left_anti")


def orphan_values(df: DataFrame, column: str, reference: DataFrame, key: str | None = None) -> DataFrame:
    """``value, count`` of missing keys.  Counting first makes a hot value one row of the join."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(
        F.count(F.lit(1)).alias("count"))
    return orphans(counts, "value", reference, key)


def check_foreign_key(df: DataFrame, column: str, reference: DataFrame, key: str | None = None) -> DataFrame:
    missing_values = orphan_values(df, column, reference, key)
    total = df.agg(F.count(column).alias("n")).scalar()
    counted = missing_values.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("invalid_count"))
    return _shaped(counted.select(F.lit("foreign_keys").alias("rule"), F.lit(column).alias("column"), "invalid_count",
                                  total.alias("total")))


def check_not_null(df: DataFrame, columns: list[str]) -> DataFrame:
    return check_rows(df, {"not_null": columns})


def check_all(df: DataFrame, rules: dict) -> DataFrame:
    """The whole rule set: one aggregate for row rules, one per uniqueness and reference rule."""
    unknown = set(rules) - {"required_columns", "unique_constraints", "foreign_keys", *ROW_RULES}
    if unknown:
        raise ValueError(f"unknown rules {sorted(unknown)}")
    parts = []
    if rules.get("required_columns"):
        parts.append(required_columns(df, rules["required_columns"]))
    unchecked = [("data_types", c, "warning", "column not found" if c not in df.columns else f"unknown type {t}")
                 for c, t in (rules.get("data_types") or {}).items() if c not in df.columns or t not in TYPES]
    if unchecked:
        parts.append(_result(df.sparkSession, unchecked))
    if row_rules(df, rules):
        parts.append(check_rows(df, rules))
    parts += [check_unique(df, c) for c in rules.get("unique_constraints") or []]
    parts += [check_foreign_key(df, r["column"], r["values"], r.get("key")) for r in rules.get("foreign_keys") or []]
    if not parts:
        raise ValueError("the rule set is empty")
    return reduce(DataFrame.unionByName, parts)


def summary(results: DataFrame) -> DataFrame:
    severity = F.col("severity")
    return results.agg(
        F.count(F.lit(1)).alias("checks"), F.count_if(severity == "error").alias("errors"),
        F.count_if(severity == "warning").alias("warnings"), F.count_if(severity == "info").alias("infos")).select(
        "*", (F.col("errors") == 0).alias("passed"))


def invalid_samples(df: DataFrame, rules: dict, limit: int, row_number: str = "row_number") -> DataFrame:
    """The first offending rows of every row rule: ``rule, column, rank, row_number, value``."""
    found = [F.when(bad, F.struct(F.lit(rule).alias("rule"), F.lit(name).alias("column"),
                                  F.col(name).cast("string").alias("value")))
             for rule, name, _, bad in row_rules(df, rules)]
    hits = df.select(row_number, F.explode(F.array_compact(F.array(*found))).alias("h")).select(row_number, "h.*")
    order = Window.partitionBy("rule", "column").orderBy(row_number)
    ranked = hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)
    return ranked.select("rule", "column", "rank", row_number, "value")


def quarantine(df: DataFrame, rules: dict) -> tuple[DataFrame, DataFrame]:
    """Rows that meet all row rules, and the others."""
    bad = reduce(lambda a, b: a | b, [F.coalesce(b, F.lit(False)) for _, _, _, b in row_rules(df, rules)])
    return df.filter(~bad), df.filter(bad)
