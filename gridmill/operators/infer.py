"""Semantic type inference and suggested SQL types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from gridmill.functions.dates import has_time, parse_timestamp
from gridmill.functions.numbers import FALSE_WORDS, NUMBER_LITERAL, TRUE_WORDS, missing
from gridmill.functions.text import strip
from gridmill.operators.profile import long_stats

# fixed values: recognised text shapes
EMAIL = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"
URL = (r"^https?://(?:www\.)?[-a-zA-Z0-9@:%._\+~#=]{1,256}\.[a-zA-Z0-9()]{1,6}\b"
       r"(?:[-a-zA-Z0-9()@:%_\+.~#?&/=]*)$")
UUID = r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
PHONE = r"^[\+]?[(]?[0-9]{1,4}[)]?[-\s\.]?[(]?[0-9]{1,4}[)]?[-\s\.]?[0-9]{1,9}$"
SHAPES = [("email", EMAIL), ("url", URL), ("uuid", UUID), ("phone", PHONE)]
# fixed values: shares of matching values that decide a type
VALUE_SHARE, SHAPE_SHARE, CONVERSION_SHARE = 0.9, 0.8, 0.95
SAMPLE_VALUES = 5
# fixed values: semantic type -> SQL type
SQL_TYPES = {
    "integer": "INTEGER", "float": "DOUBLE PRECISION", "boolean": "BOOLEAN", "date": "DATE",
    "datetime": "TIMESTAMP", "string": "TEXT", "email": "VARCHAR(255)", "url": "TEXT", "uuid": "UUID",
    "phone": "VARCHAR(20)", "null": "TEXT",
}
PHYSICAL_SQL_TYPES = {"tinyint": "SMALLINT", "smallint": "SMALLINT", "int": "INTEGER", "bigint": "BIGINT",
                      "float": "REAL", "double": "DOUBLE PRECISION"}


def _share(test: Column, present: Column) -> Column:
    return F.avg(F.when(present, F.coalesce(test, F.lit(False)).cast("double")))


def _readings(df: DataFrame, names: list[str]) -> DataFrame:
    """Per column its text, number and time reading, each parsed once.

    Flat columns, not structs: Catalyst would inline a struct's fields and parse per aggregate.
    """
    values, parsed = [], []
    for i, name in enumerate(names):
        dtype, null = df.schema[name].dataType, F.lit(None)
        value = F.when(~missing(df, name), F.col(name))
        values += [value.alias(f"value{i}"), value.cast("string").alias(f"text{i}")]
        text, number, stamp = F.col(f"text{i}"), null.cast("double"), null.cast("timestamp_ntz")
        if isinstance(dtype, T.StringType):
            values.append(strip(value).alias(f"body{i}"))
            number, stamp = F.when(text.rlike(NUMBER_LITERAL), text.try_cast("double")), parse_timestamp(f"body{i}")
        elif isinstance(dtype, T.NumericType):
            number = F.col(f"value{i}").cast("double")
        elif isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            stamp = F.col(f"value{i}").cast("timestamp_ntz")
        parsed += [number.alias(f"number{i}"), stamp.alias(f"stamp{i}")]
    return df.select(*values).select("*", *parsed)


def _metrics(i: int, dtype: T.DataType) -> list[Column]:
    """What the decision needs about one column, as aggregates over its readings."""
    text, number, stamp = F.col(f"text{i}"), F.col(f"number{i}"), F.col(f"stamp{i}")
    present = text.isNotNull()
    timed = isinstance(dtype, (T.TimestampType, T.TimestampNTZType))
    shares = {"datetime": stamp.isNotNull(), "number": number.isNotNull()}
    if isinstance(dtype, (T.StringType, T.BooleanType)):
        shares["boolean"] = F.lower(text).isin(TRUE_WORDS + FALSE_WORDS)
    elif isinstance(dtype, T.NumericType):
        # 0/1 columns read as booleans, any other number is a number
        shares["boolean"] = number.isin(0.0, 1.0)
    if isinstance(dtype, T.StringType):
        shares.update({n: F.col(f"body{i}").rlike(p) for n, p in SHAPES})
    every = ["boolean", "datetime", "number", *[n for n, _ in SHAPES]]
    return [
        F.count(F.lit(1)).alias("total"), F.count(text).alias("non_null"),
        F.coalesce(F.max(F.length(text)), F.lit(0)).alias("max_length"),
        *[(F.coalesce(_share(shares[n], present), F.lit(0.0)) if n in shares else F.lit(0.0)).alias(f"share_{n}")
          for n in every],
        F.coalesce(F.bool_and(number == F.floor(number)), F.lit(False)).alias("all_whole"),
        (F.lit(True) if timed else F.coalesce(F.bool_or(has_time(stamp)), F.lit(False))).alias("any_time"),
        F.lit(dtype.simpleString()).alias("physical_type"),
    ]


def infer_types(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``column, inferred_type, confidence, nullable, null_count`` from one pass over all columns.

    Typed columns keep their physical reading; text runs down the ladder
    boolean, date, number, shapes, string.
    """
    names = columns or df.columns
    rows = df
    facts = long_stats(_readings(rows, names), names, lambda c: _metrics(names.index(c), df.schema[c].dataType))
    dated = F.when(F.col("any_time"), "datetime").otherwise("date")
    number = F.when(F.col("all_whole"), "integer").otherwise("float")
    kind = F.when(F.col("non_null") == 0, "null")
    sure = F.when(F.col("non_null") == 0, 1.0)
    for share, limit, label in [("boolean", VALUE_SHARE, F.lit("boolean")), ("datetime", VALUE_SHARE, dated),
                                ("number", VALUE_SHARE, number), *[(n, SHAPE_SHARE, F.lit(n)) for n, _ in SHAPES]]:
        hit = F.col(f"share_{share}") >= limit
        kind, sure = kind.when(hit, label), sure.when(hit, F.col(f"share_{share}"))
    return facts.select(
        "position", "column", kind.otherwise("string").alias("inferred_type"),
        sure.otherwise(1.0).alias("confidence"), (F.col("non_null") < F.col("total")).alias("nullable"),
        (F.col("total") - F.col("non_null")).alias("null_count"), "max_length", "physical_type")


def sample_values(df: DataFrame, columns: list[str], row_number: str, n: int = SAMPLE_VALUES) -> DataFrame:
    """The first non-null values of each column in row order."""
    from pyspark.sql import Window
    texts = df.select(row_number, *[F.col(c).cast("string").alias(f"{c}") for c in columns if c != row_number])
    long = texts.unpivot([row_number], [c for c in columns if c != row_number], "column", "value")
    order = Window.partitionBy("column").orderBy(row_number)
    ranked = long.filter(F.col("value").isNotNull()).withColumn("rank", F.row_number().over(order))
    return ranked.filter(F.col("rank") <= n).select("column", "rank", "value")


def suggest_sql_types(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``column, inferred_type, sql_type``; text gets room to grow, long text becomes TEXT."""
    length = F.col("max_length")
    room = F.greatest(F.floor(length * 1.2), length + 50, F.lit(50))
    text = F.when(room > 1000, "TEXT").otherwise(F.concat(F.lit("VARCHAR("), room.cast("string"), F.lit(")")))
    by_type = F.create_map(*[F.lit(x) for pair in SQL_TYPES.items() for x in pair])
    physical = F.create_map(*[F.lit(x) for pair in PHYSICAL_SQL_TYPES.items() for x in pair])
    kind = F.col("inferred_type")
    sql = F.when(kind == "string", text).otherwise(
        F.coalesce(F.try_element_at(physical, F.col("physical_type")), F.try_element_at(by_type, kind), F.lit("TEXT")))
    return infer_types(df, columns).select("position", "column", "inferred_type", sql.alias("sql_type"))


def preview_types(df: DataFrame, row_number: str, rows: int = 10) -> DataFrame:
    """Type guess from the first non-null of the first rows."""
    head = df.orderBy(row_number).limit(rows)

    def guess(c):
        dtype, value = df.schema[c].dataType, F.min_by(c, F.when(F.col(c).isNotNull(), F.col(row_number)))
        if isinstance(dtype, T.NumericType):
            label = F.when(value == F.floor(value), "integer").otherwise("float")
        elif isinstance(dtype, T.BooleanType):
            label = F.lit("boolean")
        elif isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            label = F.lit("date")
        elif isinstance(dtype, T.StringType):
            label = F.when(value.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}"), "date").otherwise("string")
        else:
            label = F.lit("object")
        return [F.when(value.isNull(), "unknown").otherwise(label).alias("type")]

    return long_stats(head, df.columns, guess).drop("position")


def readable(df: DataFrame, name: str, target: str) -> Column:
    """Whether a non-null value has a reading in the target type."""
    c, dtype = F.col(name), df.schema[name].dataType
    text = isinstance(dtype, T.StringType)
    if target in ("integer", "float"):
        return c.rlike(NUMBER_LITERAL) if text else F.lit(isinstance(dtype, (T.NumericType, T.BooleanType)))
    if target == "boolean":
        return F.lower(c.cast("string")).isin(TRUE_WORDS + FALSE_WORDS)
    if target in ("date", "datetime"):
        return parse_timestamp(strip(c)).isNotNull() if text else c.try_cast("timestamp_ntz").isNotNull()
    if target == "string":
        return F.lit(True)
    raise ValueError(f"unknown type {target!r}")


def check_conversion(df: DataFrame, column: str, target: str) -> DataFrame:
    """Share of values that would convert; fine from 95 % on."""
    ok = readable(df, column, target)
    present = ~missing(df, column)
    out = df.agg(F.count_if(present).alias("total"), F.count_if(present & ok).alias("successful_count"))
    rate = F.coalesce(F.try_divide(F.col("successful_count"), F.col("total")), F.lit(1.0))
    return out.select(
        F.lit(column).alias("column"), F.lit(target).alias("target_type"), "total", "successful_count",
        (F.col("total") - F.col("successful_count")).alias("failed_count"), rate.alias("conversion_rate"),
        (rate >= CONVERSION_SHARE).alias("can_convert"))


def failed_values(df: DataFrame, column: str, target: str, limit: int | None = None) -> DataFrame:
    """``value, count`` of the values that would not convert, the most frequent first; all, or the first ``limit``."""
    ok = F.coalesce(readable(df, column, target), F.lit(False))
    found = df.filter(~missing(df, column) & ~ok).groupBy(F.col(column).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("count"))
    ranked = found.orderBy(F.col("count").desc(), "value")
    return ranked if limit is None else ranked.limit(limit)
