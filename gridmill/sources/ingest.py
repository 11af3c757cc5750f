"""From files to a stored record table in one plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from gridmill.operators import infer, profile, validate
from gridmill.operators.ordered import number_partitions
from gridmill.operators.shape import conversion_counts, convert_types, normalize_names
from gridmill.plans.presets import standard_cleaning
from gridmill.session import scratch_path
from gridmill.sources import files, sinks


@dataclass
class Ingested:
    records: DataFrame
    rejected_lines: DataFrame
    types: DataFrame
    checks: DataFrame | None


# semantic types that change the physical type of a stored column
_STORED = {"integer": "int", "float": "float", "boolean": "bool", "date": "datetime", "datetime": "datetime"}


def ingest_csv(spark: SparkSession, source: str, target: str, organization_id: str, dataset_id: str,
               delimiter: str = ",", encoding: str = "utf-8", rules: dict | None = None,
               typed: bool = True) -> Ingested:
    """Parse, infer, check, clean, rename, type and store.

    The parsed rows are written first, so that row numbers stay the same in every later read of them.  A column gets its inferred type
    only where all its values have it; otherwise it stays text, and no value is lost.
    """
    parsed, rejected = files.read_csv(spark, source, delimiter, encoding)
    path = scratch_path(spark, "parsed")
    parsed.write.parquet(path)
    raw = spark.read.schema(parsed.schema).parquet(path)
    files.require_shape(raw)
    types = infer.infer_types(raw)
    numbered = number_partitions(raw, "row_number")
    checks = validate.check_all(raw, rules) if rules else None
    cleaned, _ = standard_cleaning("row_number").run(numbered)
    if typed:
        # bounded metadata: one row per column
        found = {r["column"]: _STORED[r["inferred_type"]] for r in types.collect() if r["inferred_type"] in _STORED}
        if found:
            failed = {r["column"]: r["failed"] for r in conversion_counts(cleaned, found).collect()}
            found = {c: kind for c, kind in found.items() if failed[c] == 0}
        cleaned = convert_types(cleaned, found, "coerce")
    renamed = normalize_names(cleaned)
    sinks.replace_dataset(sinks.envelope(renamed, organization_id, dataset_id), target, [(organization_id, dataset_id)])
    return Ingested(sinks.read_records(spark, target, organization_id, dataset_id), rejected, types, checks)


def column_contract(spark: SparkSession, path: str, organization_id: str, dataset_id: str) -> DataFrame:
    """Profile contract of a stored dataset, without the envelope columns."""
    df = sinks.read_records(spark, path, organization_id, dataset_id)
    skip = {*sinks.PARTITIONS, "row_number", "is_valid", "validation_errors"}
    return profile.profile_contract(df, [c for c in df.columns if c not in skip])


