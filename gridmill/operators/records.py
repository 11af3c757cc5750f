"""Row queries: page, lookup, counts, re-validation and bulk changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gridmill.functions.numbers import is_numeric, parse_number, percent
from gridmill.operators.ordered import dense_positions, sorted_bin
from gridmill.operators.predicates import apply_filters, search_any, search_document

DEEP = 100_000
ERROR_ARRAY = "array<struct<field:string,error:string>>"


def sort_keys(sort: list[tuple[str, str]], tie_break: str | None = None) -> list[Column]:
    """Nulls last in both directions; the tie-break makes pages repeatable."""
    keys = []
    for name, direction in sort:
        if direction not in ("asc", "desc"):
            raise ValueError(f"unknown direction {direction!r}")
        keys.append(F.col(name).desc_nulls_last() if direction == "desc" else F.col(name).asc_nulls_last())
    if tie_break and tie_break not in [n for n, _ in sort]:
        keys.append(F.col(tie_break).asc_nulls_last())
    return keys


def filter_records(df: DataFrame, filters=None, search: str | None = None, only_valid: bool | None = None,
                   whole_document: bool = False, valid_column: str = "is_valid") -> DataFrame:
    df = apply_filters(df, filters)
    if only_valid is not None:
        df = df.filter(F.col(valid_column) == only_valid)
    if search:
        df = df.filter(search_document(df, search) if whole_document else search_any(df, search))
    return df


def deep_page(rows: DataFrame, sort: list[tuple[str, str]], tie_break: str, skip: int, limit: int) -> DataFrame:
    """The page at any offset by rank search; ``tie_break`` is unique.

    Only the sort columns are cut into bins by range and written; the bins' counts tell which of them hold the offset, and only those are
    sorted.  The page's keys, at most ``limit``, then fetch its rows.
    """
    names = list(dict.fromkeys([*(n for n, _ in sort), tie_break]))
    order = sort_keys(sort, tie_break)
    keys = sorted_bin(rows.select(*names), order, skip, limit)
    same = F.struct(*names)
    wanted = keys.select(F.struct(*names).alias("_wanted"))
    return rows.join(wanted, same == F.col("_wanted"), "left_semi").orderBy(*order).limit(limit)


def query_records(df: DataFrame, filters=None, search=None, only_valid=None, sort=None, skip: int = 0,
                  limit: int = 100, row_number: str = "row_number", totals: bool = False) -> DataFrame:
    """One page.  ``totals`` adds ``total`` and ``has_more`` from a count of the same filtered plan.

    Spark gathers ``skip + limit`` rows in one task; pages deeper than ``DEEP`` rows are found by rank search instead.
    """
    rows = filter_records(df, filters, search, only_valid)
    sort = sort or [(row_number, "asc")]
    if skip > DEEP:
        page = deep_page(rows, sort, row_number, skip, limit)
    else:
        page = rows.orderBy(*sort_keys(sort, row_number)).offset(skip).limit(limit)
    if not totals:
        return page
    total = rows.agg(F.count(F.lit(1)).alias("n")).scalar()
    return page.withColumn("total", total).withColumn("has_more", F.col("total") > skip + limit)


def page_after(df: DataFrame, row_number: str, after: int, limit: int = 100) -> DataFrame:
    """Next page by key: the scan skips everything before it, however deep the page is."""
    return df.filter(F.col(row_number) > after).orderBy(row_number).limit(limit)


def get_record(df: DataFrame, value, column: str = "id") -> DataFrame:
    return df.filter(F.col(column) == F.lit(value)).limit(1)


def preview(df: DataFrame, limit: int = 100, row_number: str = "row_number") -> DataFrame:
    return df.orderBy(F.col(row_number)).limit(limit)


def sample_valid(df: DataFrame, limit: int = 10, row_number: str = "row_number") -> DataFrame:
    return preview(df.filter(F.col("is_valid")), limit, row_number)


def record_stats(df: DataFrame, valid_column: str = "is_valid") -> DataFrame:
    """total, valid, invalid and the valid rate in percent (100 for an empty set)."""
    out = df.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col(valid_column)).alias("valid"))
    rate = F.when(F.col("total") == 0, 100.0).otherwise(percent(F.col("valid"), F.col("total")))
    return out.select("total", "valid", (F.col("total") - F.col("valid")).alias("invalid"),
                      F.round(rate, 2).alias("validation_rate"))


def catalog_page(df: DataFrame, page: int, page_size: int, created: str, tie_break: str) -> DataFrame:
    """Newest first with total rows and page count."""
    total = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    skip = (page - 1) * page_size
    if skip > DEEP:
        rows = deep_page(df, [(created, "desc")], tie_break, skip, page_size)
    else:
        rows = df.orderBy(F.col(created).desc(), F.col(tie_break)).offset(skip).limit(page_size)
    return rows.withColumn("total", total).withColumn(
        "total_pages", F.ceil(F.col("total") / F.lit(page_size)).cast("bigint"))


def validation_errors(df: DataFrame, schema: dict[str, dict]) -> Column:
    """Per-row ``[{field, error}]``: a required value is missing or blank, or a number cannot be read."""
    checks = []
    for name, spec in schema.items():
        c = F.col(name)
        text = c.cast("string")
        blank = c.isNull() | (text == "")
        if spec.get("required"):
            checks.append(F.when(blank, F.struct(F.lit(name).alias("field"), F.lit("required").alias("error"))))
        kind = spec.get("type")
        if kind in ("integer", "float") and not is_numeric(df.schema[name].dataType):
            number = parse_number(text)
            bad = ~blank & (number.isNull() if kind == "float" else number.isNull() | (number != F.floor(number)))
            checks.append(F.when(bad, F.struct(F.lit(name).alias("field"), F.lit(f"not {kind}").alias("error"))))
    return F.array_compact(F.array(*checks)) if checks else F.array().cast(ERROR_ARRAY)


def revalidate(df: DataFrame, schema: dict[str, dict]) -> DataFrame:
    out = df.withColumn("validation_errors", validation_errors(df, schema))
    return out.withColumn("is_valid", F.size("validation_errors") == 0)


def error_flags(df: DataFrame) -> DataFrame:
    count = F.coalesce(F.size("validation_errors"), F.lit(0))
    return df.withColumn("error_count", F.when(F.col("validation_errors").isNull(), 0).otherwise(count)).withColumn(
        "has_errors", ~F.col("is_valid") & F.col("validation_errors").isNotNull())


def document_keys(document: Column) -> Column:
    """Sorted key names of a JSON object."""
    return F.array_sort(F.json_object_keys(document))


def bulk_apply(records: DataFrame, ops: DataFrame, data: list[str], merge: bool = False) -> tuple[DataFrame, DataFrame]:
    """Apply ``(idx, op, id, *data)`` in idx order to ``(id, row_number, *data)``.

    Returns the new records and one status row per operation.  A created row
    takes the next free row number; an update replaces the data columns (with
    ``merge`` only the given ones); a change to an id that is missing or was
    deleted earlier in the batch fails.  A hot id costs one row per task,
    because operations are folded per id before any shuffle.
    """
    changes = ops.filter(F.col("op").isin("update", "delete"))
    first_delete = changes.filter(F.col("op") == "delete").groupBy("id").agg(F.min("idx").alias("_gone"))
    known = records.select("id", F.lit(True).alias("_known"))
    judged = (
        ops.join(known, "id", "left").join(first_delete, "id", "left")
        .withColumn("status", F.when(F.col("op") == "create", "created")
                    .when(~F.col("op").isin("update", "delete"), "unknown operation")
                    .when(F.col("_known").isNull() | (F.col("idx") > F.col("_gone")), "not found")
                    .otherwise(F.when(F.col("op") == "delete", "deleted").otherwise("updated")))
    )
    status = judged.select("idx", "op", "id", "status")

    done = judged.filter(F.col("status").isin("updated", "deleted"))
    latest = done.groupBy("id").agg(
        F.max_by(F.struct(*data), F.when(F.col("op") == "update", F.col("idx"))).alias("_new"),
        F.max(F.col("op") == "delete").alias("_deleted"))
    replaced = [
        F.when(F.col("_new").isNull(), F.col(c))
        .otherwise(F.coalesce(F.col("_new")[c], F.col(c)) if merge else F.col("_new")[c]).alias(c)
        for c in data
    ]
    kept = records.join(latest, "id", "left").filter(F.coalesce(F.col("_deleted"), F.lit(False)) == F.lit(False))
    kept = kept.select("id", "row_number", *replaced)

    last = records.agg(F.coalesce(F.max("row_number"), F.lit(0)).alias("n")).scalar()
    created = dense_positions(ops.filter(F.col("op") == "create"), "idx", "_n")
    created = created.select("id", (last + F.col("_n")).alias("row_number"), *data)
    return kept.unionByName(created), status


def bulk_summary(status: DataFrame) -> DataFrame:
    ok = F.col("status").isin("created", "updated", "deleted")
    return status.agg(F.count(F.lit(1)).alias("total"), F.count_if(ok).alias("successful"),
                      F.count_if(~ok).alias("failed"))
