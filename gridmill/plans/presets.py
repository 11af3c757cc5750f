"""Ready-made chains and the registry of declarative cleaning operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gridmill.operators import clean, shape, stats
from gridmill.plans.chain import StepChain
from gridmill.session import written

# fixed values: operation names of the declarative form [{operation, params}]
OPERATIONS = {
    "remove_duplicates": clean.drop_duplicates,
    "handle_missing_values": clean.handle_missing,
    "trim_whitespace": clean.trim_whitespace,
    "standardize_case": clean.standardize_case,
    "remove_outliers": stats.remove_outliers,
    "normalize_dates": clean.normalize_dates,
    "clean_numeric": clean.clean_numeric,
    "normalize_column_names": shape.normalize_names,
    "convert_types": shape.convert_types,
    "scale_numeric": shape.scale_numeric,
}


def chain_of(operations: list[dict], name: str = "cleaning") -> StepChain:
    """A chain from ``[{operation, params}]``; an unknown operation raises."""
    chain = StepChain(name)
    for i, spec in enumerate(operations):
        if spec["operation"] not in OPERATIONS:
            raise ValueError(f"unknown operation {spec['operation']!r}; use one of {sorted(OPERATIONS)}")
        chain.add(OPERATIONS[spec["operation"]], f"{i}:{spec['operation']}", **(spec.get("params") or {}))
    return chain


def apply_operations(df: DataFrame, operations: list[dict]) -> DataFrame:
    return chain_of(operations).run(df)[0]


def _drop_empty(df: DataFrame, row_number: str) -> DataFrame:
    return clean.handle_missing(df, "drop_all", [c for c in df.columns if c != row_number], row_number=row_number)


def standard_cleaning(row_number: str = "row_number") -> StepChain:
    return (StepChain("standard cleaning")
            .add(clean.drop_duplicates, "remove duplicates", row_number=row_number)
            .add(clean.trim_whitespace, "trim whitespace")
            .add(_drop_empty, "drop empty rows", row_number=row_number))


def _remove_outliers(df: DataFrame, column: str, method: str, write: bool) -> DataFrame:
    out = stats.remove_outliers(df, column, method)
    return written(out, "step") if write else out


def numeric_preprocessing(columns: list[str], outliers: str = "iqr", scaling: str = "minmax") -> StepChain:
    """Outliers go column by column, each judged on the rows that are left; every such step reads its input twice, so it is written."""
    chain = StepChain("numeric preprocessing").add(clean.clean_numeric, "clean numbers", columns=columns)
    for i, c in enumerate(columns):
        chain.add(_remove_outliers, f"outliers {c}", column=c, method=outliers, write=i + 1 < len(columns))
    return chain.add(shape.scale_numeric, "scale", columns=columns, method=scaling)


def text_preprocessing(columns: list[str], lowercase: bool = True, trim: bool = True) -> StepChain:
    chain = StepChain("text preprocessing")
    if trim:
        chain.add(clean.trim_whitespace, "trim whitespace", columns=columns)
    if lowercase:
        chain.add(clean.standardize_case, "lower case", columns=columns, case="lower")
    return chain


def full_preprocessing(numeric: list[str] = (), text: list[str] = (), categorical: list[str] = (),
                       rename: bool = True, row_number: str = "row_number") -> StepChain:
    """Column names in the arguments are those after renaming."""
    chain = StepChain("full preprocessing").add(clean.drop_duplicates, "remove duplicates", row_number=row_number)
    if rename:
        chain.add(shape.normalize_names, "rename columns")
    chain.add(clean.trim_whitespace, "trim whitespace")
    if numeric:
        chain.add(clean.clean_numeric, "clean numbers", columns=list(numeric))
    if text:
        chain.add(clean.standardize_case, "lower case", columns=list(text), case="lower")
    if categorical:
        chain.add(shape.encode_labels, "encode", columns=list(categorical))
    return chain.add(_drop_empty, "drop empty rows", row_number=row_number)


def normalize(df: DataFrame, rename: bool = True, types: dict | None = None, scale: list[str] | None = None,
              scaling: str = "minmax", encode: list[str] | None = None, encoding: str = "label",
              errors: str = "coerce") -> DataFrame:
    """Rename, convert, scale and encode in one go; names are those after renaming."""
    out = shape.normalize_names(df) if rename else df
    out = shape.convert_types(out, types, errors) if types else out
    out = shape.scale_numeric(out, scale, scaling) if scale else out
    if encode and encoding in ("label", "ordinal"):
        return shape.encode_labels(out, encode)
    for c in encode or []:
        out = {"onehot": shape.encode_onehot}[encoding](out, c)
    return out


def normalize_report(df: DataFrame, rename: bool = True, types: dict | None = None, scale: list[str] | None = None,
                     scaling: str = "minmax", encode: list[str] | None = None, errors: str = "coerce") -> DataFrame:
    """What ``normalize`` does with the same arguments: ``step, column, detail, count``.

    Renamed columns with their new names; per converted column the values that were read and those that were not; per scaled column the
    shift and scale; per encoded column its codes.
    """
    spark, rows, parts = df.sparkSession, [], []
    named = shape.normalize_names(df) if rename else df
    rows += [("rename", old, new, None) for old, new in zip(df.columns, named.columns) if old != new]
    if types:
        counts = shape.conversion_counts(named, types)
        parts += [counts.select(F.lit(step).alias("step"), "column", F.col("target").alias("detail"), F.col(step).alias("count"))
                  for step in ("converted", "failed")]
        named = shape.convert_types(named, types, errors)
    if scale:
        params = shape.scaling_params(named, scale, scaling)
        pairs = [F.struct(F.lit(step).alias("step"), F.lit(c).alias("column"), F.col(f"{c}_{step}").cast("string").alias("detail"),
                          F.lit(None).cast("bigint").alias("count")) for c in scale for step in ("shift", "scale")]
        parts.append(params.select(F.inline(F.array(*pairs))))
    for c in encode or []:
        parts.append(named.filter(F.col(c).isNotNull()).agg(F.countDistinct(c).alias("count")).select(
            F.lit("encode").alias("step"), F.lit(c).alias("column"), F.lit("codes").alias("detail"), "count"))
    out = spark.createDataFrame(rows, "step string, column string, detail string, count bigint")
    for part in parts:
        out = out.unionByName(part)
    return out
