"""Record tables: envelope, append, replace, export.

A record table has two folders.  ``records`` holds one folder per tenant, dataset and version; every load writes a version of its own.  ``manifest`` has a row
for each load of a dataset, written as one file when its version is complete: readers take the versions since the last replacement, so a
load is seen as a whole or not at all, and a replacement by no rows leaves none.  One writer at a time loads a dataset.
"""

from __future__ import annotations

import json
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from gridmill.operators.records import ERROR_ARRAY

PARTITIONS = ("organization_id", "dataset_id")


def envelope(df: DataFrame, organization_id: str, dataset_id: str, row_number: str = "row_number") -> DataFrame:
    """Add tenant, dataset and validity columns; NaN becomes null.  Rows need their number already."""
    plain = [F.when(~F.isnan(f.name), F.col(f.name)).alias(f.name)
             if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name)
             for f in df.schema if f.name != row_number]
    return df.select(
        F.lit(organization_id).alias("organization_id"), F.lit(dataset_id).alias("dataset_id"),
        F.col(row_number).alias("row_number"), F.lit(True).alias("is_valid"),
        F.array().cast(ERROR_ARRAY).alias("validation_errors"), *plain)


MANIFEST = "organization_id string, dataset_id string, version string, seq long, kind string, fields string"


def _read(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """The files of a folder, none where it is not there yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def _stored(fields: list[T.StructField]) -> T.StructType:
    return T.StructType([*fields, *(T.StructField(n, T.StringType()) for n in (*PARTITIONS, "version"))])


def _load(df: DataFrame, path: str, kind: str, datasets: list[tuple[str, str]]) -> None:
    spark, version = df.sparkSession, uuid.uuid4().hex
    fields = [f for f in df.schema if f.name not in PARTITIONS]
    names = [f.name for f in fields]
    if "version" in names:
        raise ValueError("version is a column of the store")
    df.select(*names, *PARTITIONS, F.lit(version).alias("version")).write.mode("append").partitionBy(*PARTITIONS, "version").parquet(f"{path}/records")
    loaded = spark.read.schema(_stored(fields)).parquet(f"{path}/records").filter(F.col("version") == version).select(*PARTITIONS)
    named = spark.createDataFrame(datasets, ", ".join(f"{n} string" for n in PARTITIONS))
    last = _read(spark, f"{path}/manifest", MANIFEST).agg(F.max("seq")).first()[0]
    rows = loaded.union(named).distinct().select(
        *PARTITIONS, F.lit(version).alias("version"), F.lit(0 if last is None else last + 1).cast("long").alias("seq"), F.lit(kind).alias("kind"),
        F.lit(T.StructType(fields).json()).alias("fields"))
    rows.coalesce(1).write.mode("append").parquet(f"{path}/manifest")


def append_records(df: DataFrame, path: str) -> None:
    """Add the rows to their datasets, in one folder per tenant, dataset and load, so that queries read only theirs."""
    _load(df, path, "append", [])


def replace_dataset(df: DataFrame, path: str, datasets: list[tuple[str, str]] | None = None) -> None:
    """Put the rows in the place of all earlier ones of the datasets that occur in the frame and of those named as (tenant, dataset).

    A named dataset without rows is empty afterwards.
    """
    _load(df, path, "replace", list(datasets or []))


def live_versions(spark: SparkSession, path: str) -> DataFrame:
    """Manifest rows of the loads that readers see: each dataset's last replacement and what came after."""
    rows = _read(spark, f"{path}/manifest", MANIFEST)
    start = rows.filter("kind = 'replace'").groupBy(*PARTITIONS).agg(F.max("seq").alias("_from"))
    return rows.join(start, list(PARTITIONS), "left").filter(F.col("seq") >= F.coalesce("_from", F.lit(0))).drop("_from")


def read_records(spark: SparkSession, path: str, organization_id: str | None = None,
                 dataset_id: str | None = None) -> DataFrame:
    """The rows of the live versions, of all datasets or of those named; columns that a load lacks are null.

    The versions are settled when the frame is made: a replacement that comes later changes nothing in it.
    """
    wanted = F.lit(True)
    for name, value in zip(PARTITIONS, (organization_id, dataset_id)):
        wanted = wanted if value is None else wanted & (F.col(name) == value)
    live = live_versions(spark, path).filter(wanted)
    known = live.groupBy("fields").agg(F.min("seq").alias("seq")).orderBy("seq").collect()  # one row per distinct schema
    if not known:
        known = _read(spark, f"{path}/manifest", MANIFEST).orderBy("seq").limit(1).collect()
    if not known:
        raise FileNotFoundError(f"no record table at {path}")
    fields: dict[str, T.StructField] = {}
    for row in known:
        for field in T.StructType.fromJson(json.loads(row["fields"])):
            if fields.setdefault(field.name, field).dataType != field.dataType:
                raise ValueError(f"loads store {field.name} with different types; read their datasets one by one")
    rows = _read(spark, f"{path}/records", _stored(list(fields.values()))).filter(wanted)
    return rows.join(live.select(*PARTITIONS, "version"), [*PARTITIONS, "version"], "left_semi").select(*fields, *PARTITIONS)


def export_csv(df: DataFrame, path: str, delimiter: str = ",") -> None:
    """CSV with a header; quotes are doubled, blanks at the ends of texts stay, null is empty."""
    df.write.option("header", "true").option("sep", delimiter).option("nullValue", "").option(
        "emptyValue", "").option("escape", '"').option(
        "ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false").mode("overwrite").csv(path)
