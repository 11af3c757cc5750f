"""Column and table profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from gridmill.functions.numbers import as_number, is_numeric, missing, percent
from gridmill.operators.quantiles import percentile_rows
from gridmill.operators.stats import with_scalar
from gridmill.session import written

# fixed values
BINS = 10
# a text column is categorical up to this many values or this share of distinct values
CATEGORICAL_VALUES, CATEGORICAL_SHARE = 50, 0.05
# columns per aggregate: keeps generated code small on wide tables
BATCH = 50
# longer texts are counted by their SHA-256 (64 characters, so that it equals no short text)
SHORT_TEXT = 48

_TIME = (T.TimestampType, T.TimestampNTZType, T.DateType)


def kind_of(dtype: T.DataType) -> str:
    if is_numeric(dtype):
        return "numeric"
    if isinstance(dtype, _TIME):
        return "datetime"
    return "categorical" if isinstance(dtype, T.BooleanType) else "text"


def columns_of_kind(df: DataFrame, kind: str) -> list[str]:
    return [f.name for f in df.schema if kind_of(f.dataType) == kind]


def long_stats(df: DataFrame, columns: list[str], metrics) -> DataFrame:
    """One row per column from ``metrics(name) -> [Column]``, a few wide aggregates in all."""
    parts = []
    for start in range(0, len(columns), BATCH):
        rows = [F.struct(F.lit(start + i).alias("position"), F.lit(c).alias("column"), *metrics(c))
                for i, c in enumerate(columns[start:start + BATCH])]
        parts.append(df.agg(F.array(*rows).alias("r")).select(F.inline("r")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _cells(df: DataFrame, columns: list[str]) -> DataFrame:
    """``column, value`` with one row per cell that is not null, as text."""
    texts = df.select(*[F.col(c).cast("string").alias(c) for c in columns])
    long = texts.unpivot([], columns, "column", "value") if len(columns) > 1 else texts.select(
        F.lit(columns[0]).alias("column"), F.col(columns[0]).alias("value"))
    return long.filter(F.col("value").isNotNull())


def _long(value: str) -> Column:
    return F.octet_length(value) > SHORT_TEXT


def _key(value: str) -> Column:
    return F.when(_long(value), F.sha2(value, 256)).otherwise(F.col(value))


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """``column, key, lead, n`` over all columns: one shuffle serves distinct counts, modes and top values.

    The key is the text itself or, for a long text, its digest: no row of the shuffle exceeds some hundred bytes, however long the
    texts are.  ``lead`` is the start of the text, which orders most ties without it.
    """
    lead = F.substring("value", 1, SHORT_TEXT).alias("lead")
    return _cells(df, columns).groupBy("column", _key("value").alias("key"), lead).agg(F.count(F.lit(1)).alias("n"))


def distinct_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """``column, unique_count, rows``: exact distinct values and the rows that are not null."""
    counts = _cells(df, columns).groupBy("column", _key("value").alias("key")).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("column").agg(F.count(F.lit(1)).alias("unique_count"), F.sum("n").alias("rows"))


def _may_be_long(df: DataFrame, columns: list[str]) -> list[str]:
    return [c for c in columns if not is_numeric(df.schema[c].dataType)
            and not isinstance(df.schema[c].dataType, (*_TIME, T.BooleanType))]


def leading_values(df: DataFrame, columns: list[str], counts: DataFrame, limit: int) -> DataFrame:
    """``column, rank, value, n`` of the most frequent values; ties by the smallest value.

    Keys are ranked by count and lead, keys that tie in both all stay.  Only when a digest is among them are the texts read again, and only
    those whose digest is wanted go on; the wanted keys are a written table, whose size decides how Spark joins it.
    """
    order = Window.partitionBy("column").orderBy(F.col("n").desc(), F.col("lead"))
    ahead = counts.withColumn("_r", F.rank().over(order)).filter(F.col("_r") <= limit).drop("_r")
    named = ahead.withColumn("value", F.col("key"))
    texts = _may_be_long(df, columns)
    if texts:
        ahead = written(ahead, "leading-values")
        named = ahead.withColumn("value", F.col("key"))
        # a digest is longer than any short text
        wanted = ahead.filter(F.octet_length("key") > SHORT_TEXT)
        if not wanted.isEmpty():
            found = _cells(df, texts).filter(_long("value")).select("column", _key("value").alias("key"), "value")
            found = found.join(wanted, ["column", "key"]).groupBy("column", "key").agg(
                F.min("value").alias("value"), F.first("n").alias("n"))
            named = named.filter(F.octet_length("key") <= SHORT_TEXT).select("column", "key", "value", "n").unionByName(found)
    final = Window.partitionBy("column").orderBy(F.col("n").desc(), F.col("value"))
    return named.withColumn("rank", F.row_number().over(final)).filter(F.col("rank") <= limit).select("column", "rank", "value", "n")


def histogram(df: DataFrame, column: str, bins: int = BINS, clamp: bool = True) -> DataFrame:
    """Equal-width bins with edges and counts; empty bins count 0.

    ``clamp`` puts the maximum into the last bin; without it the maximum falls outside.
    """
    x = as_number(df, column)
    span = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi"))
    tagged = with_scalar(df.select(x.alias("_x")).filter(F.col("_x").isNotNull()), span, "_s")
    flat = F.col("_s.lo") == F.col("_s.hi")
    bin_no = F.when(flat, F.lit(1)).otherwise(
        F.width_bucket("_x", F.col("_s.lo"), F.when(flat, F.col("_s.hi") + 1).otherwise(F.col("_s.hi")), F.lit(bins)))
    bin_no = F.least(bin_no, F.lit(bins)) if clamp else bin_no
    counts = tagged.groupBy(bin_no.cast("bigint").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    grid = with_scalar(df.sparkSession.range(1, bins + 1).select(F.col("id").alias("bin")), span, "_s")
    step = (F.col("_s.hi") - F.col("_s.lo")) / bins
    grid = grid.select("bin", (F.col("_s.lo") + step * (F.col("bin") - 1)).alias("low"),
                       (F.col("_s.lo") + step * F.col("bin")).alias("high"))
    out = grid.join(counts, "bin", "left").select(
        "bin", F.round("low", 2).alias("low"), F.round("high", 2).alias("high"),
        F.coalesce("n", F.lit(0)).alias("count"))
    return out.withColumn("label", F.concat_ws("-", F.format_string("%.2f", "low"), F.format_string("%.2f", "high")))


def frequency_table(df: DataFrame, column: str, limit: int | None = None) -> DataFrame:
    """Values by frequency with their share of all non-null rows; all, or the first ``limit``."""
    rows = df.filter(F.col(column).isNotNull())
    counts = rows.groupBy(F.col(column).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("count"))
    # the total is a scalar: a window over all groups would put them into one task
    total = rows.agg(F.count(F.lit(1)).alias("n")).scalar()
    top = counts.orderBy(F.col("count").desc(), F.col("value"))
    top = top if limit is None else top.limit(limit)
    return top.withColumn("percentage", percent(F.col("count"), total))


def mode_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """``column, unique_values, mode, mode_count``; ties go to the smallest value."""
    counts = value_counts(df, columns)
    distinct = counts.groupBy("column").agg(F.count(F.lit(1)).alias("unique_values"))
    modes = leading_values(df, columns, counts, 1)
    return distinct.join(modes, "column").select("column", "unique_values", F.col("value").alias("mode"), F.col("n").alias("mode_count"))


def categorical_stats(df: DataFrame, column: str) -> DataFrame:
    return mode_rows(df, [column])


def missing_stats(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Null or blank cells per column."""
    names = columns or df.columns

    def metrics(c):
        return [F.count(F.lit(1)).alias("total"), F.count_if(missing(df, c, blank=True)).alias("missing_count")]

    return long_stats(df, names, metrics).select(
        "column", "total", "missing_count", percent(F.col("missing_count"), F.col("total")).alias("missing_percentage"))


def null_analysis(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    names = columns or df.columns

    def metrics(c):
        null = missing(df, c)
        blank = F.coalesce(missing(df, c, blank=True) & ~null, F.lit(False))
        return [F.count(F.lit(1)).alias("total"), F.count_if(null).alias("null_count"),
                F.count_if(blank).alias("empty_count")]

    rest = F.col("total") - F.col("null_count") - F.col("empty_count")
    return long_stats(df, names, metrics).select(
        "column", "total", "null_count", "empty_count", rest.alias("non_null_count"),
        percent(rest, F.col("total"), 100.0).alias("completeness"))


def missing_report(before: DataFrame, after: DataFrame, columns: list[str]) -> DataFrame:
    """Missing cells per column before and after a cleaning step."""
    def count(df):
        return long_stats(df, columns, lambda c: [F.count_if(missing(df, c)).alias("n")])
    b, a = count(before).withColumnRenamed("n", "missing_before"), count(after).withColumnRenamed("n", "missing_after")
    return b.join(a.drop("position"), "column").select("column", "missing_before", "missing_after")


def profile_contract(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``position, column, category`` with text split into categorical and text by its distinct values."""
    names = columns or df.columns
    texts = [c for c in names if kind_of(df.schema[c].dataType) == "text"]
    spark = df.sparkSession
    fixed = [(i, c, kind_of(df.schema[c].dataType)) for i, c in enumerate(names)]
    base = spark.createDataFrame(fixed, "position int, column string, kind string")
    if not texts:
        return base.select("position", "column", F.col("kind").alias("category"),
                           F.lit(None).cast("bigint").alias("unique_values"))
    # the same shuffle as that of the modes
    counts = value_counts(df, texts).groupBy("column").agg(
        F.count(F.lit(1)).alias("unique_values"), F.sum("n").alias("rows"))
    few = (F.col("unique_values") <= CATEGORICAL_VALUES) | (
        F.col("unique_values") <= F.col("rows") * CATEGORICAL_SHARE)
    return base.join(counts, "column", "left").select(
        "position", "column", F.when((F.col("kind") == "text") & few, "categorical").otherwise(F.col("kind"))
        .alias("category"), "unique_values")


def dataset_summary(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row per column: category, missing cells, numeric statistics or mode, and the quality score.

    All numeric and missing statistics come from one aggregate, all value
    counts from one shuffle, all medians from one percentile plan.
    """
    names = columns or df.columns
    numeric = {c for c in names if kind_of(df.schema[c].dataType) == "numeric"}

    def metrics(c):
        x = as_number(df, c) if c in numeric else F.lit(None).cast("double")
        return [F.count(F.lit(1)).alias("total"), F.count_if(missing(df, c, blank=True)).alias("missing_count"),
                F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max")]

    stats = long_stats(df, names, metrics)
    others = [c for c in names if c not in numeric]
    out = stats.join(profile_contract(df, names).select("column", "category"), "column", "left")
    if numeric:
        cols = [c for c in names if c in numeric]
        narrow = df.select(*[as_number(df, c).alias(c) for c in cols])
        medians = percentile_rows(narrow, {c: F.col(c) for c in cols}, [0.5]).select("column", F.col("value").alias("median"))
        out = out.join(medians, "column", "left")
    else:
        out = out.withColumn("median", F.lit(None).cast("double"))
    if others:
        out = out.join(mode_rows(df, others), "column", "left")
    else:
        out = out.select("*", F.lit(None).cast("bigint").alias("unique_values"),
                         F.lit(None).cast("string").alias("mode"), F.lit(None).cast("bigint").alias("mode_count"))
    share = F.coalesce(F.try_divide(F.sum("missing_count") * 100.0, F.sum("total")), F.lit(0.0))
    quality = stats.agg((100.0 - share).alias("q")).scalar()
    return out.select(
        "position", "column", "category", "total", "missing_count",
        percent(F.col("missing_count"), F.col("total")).alias("missing_percentage"), "mean", "median", "std", "min",
        "max", "unique_values", "mode", "mode_count", quality.alias("quality_score"))


def quality_score(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """100 x (1 - missing cells / cells)."""
    cells = missing_stats(df, columns)
    share = F.coalesce(F.try_divide(F.sum("missing_count") * 100.0, F.sum("total")), F.lit(0.0))
    return cells.agg((100.0 - share).alias("quality_score"))


def numeric_column_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """Ingest statistics of numeric columns with p25, p75, p90, p95 and the exact distinct count."""
    narrow = df.select(*[as_number(df, c, strict_text=False).alias(c) for c in columns])
    stats = long_stats(narrow, columns, lambda c: [
        F.count(F.lit(1)).alias("total_count"), F.count(c).alias("non_null_count"), F.min(c).alias("min"),
        F.max(c).alias("max"), F.avg(c).alias("mean"), F.coalesce(F.stddev_samp(c), F.lit(0.0)).alias("std"),
        F.sum(c).alias("sum")])
    long = narrow.unpivot([], columns, "column", "_v") if len(columns) > 1 else narrow.select(
        F.lit(columns[0]).alias("column"), F.col(columns[0]).alias("_v"))
    names = {0.25: "percentile_25", 0.5: "median", 0.75: "percentile_75", 0.9: "percentile_90", 0.95: "percentile_95"}
    table = percentile_rows(narrow, {c: F.col(c) for c in columns}, list(names))
    wide = table.groupBy("column").agg(*[F.max(F.when(F.col("p") == p, F.col("value"))).alias(n)
                                         for p, n in names.items()])
    # one hash aggregate on (column, value) replaces one expansion per distinct count
    distinct = long.filter(F.col("_v").isNotNull()).groupBy("column", "_v").agg(F.count(F.lit(1)).alias("n"))
    distinct = distinct.groupBy("column").agg(F.count(F.lit(1)).alias("unique_count"))
    out = stats.join(wide, "column", "left").join(distinct, "column", "left")
    return out.select(
        "column", "total_count", (F.col("total_count") - F.col("non_null_count")).alias("null_count"), "min", "max",
        "mean", "median", "std", "sum", "percentile_25", "percentile_75", "percentile_90", "percentile_95",
        F.coalesce("unique_count", F.lit(0)).alias("unique_count"))


def text_column_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    texts = df.select(*[F.col(c).cast("string").alias(c) for c in columns])
    stats = long_stats(texts, columns, lambda c: [
        F.count(c).alias("non_null_count"), F.max(F.length(c)).alias("max_length"), F.min(F.length(c)).alias("min_length"),
        F.avg(F.length(c)).alias("avg_length")])
    distinct = distinct_counts(df, columns)
    return stats.join(distinct, "column", "left").select(
        "column", "non_null_count", "max_length", "min_length", "avg_length",
        F.coalesce("unique_count", F.lit(0)).alias("unique_count"),
        F.try_divide(F.col("unique_count"), F.col("non_null_count")).alias("cardinality_ratio"))


def top_values(df: DataFrame, columns: list[str], limit: int) -> DataFrame:
    """``column, rank, value, count``; the rank limit is applied before the shuffle."""
    return leading_values(df, columns, value_counts(df, columns), limit).withColumnRenamed("n", "count")


def datetime_column_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    stamps = df.select(*[F.col(c).cast("timestamp_ntz").alias(c) for c in columns])
    stats = long_stats(stamps, columns, lambda c: [
        F.count(c).alias("non_null_count"), F.min(c).alias("min_date"), F.max(c).alias("max_date")])
    distinct = distinct_counts(stamps, columns)
    # whole days of the difference, not calendar days crossed
    days = F.floor((F.unix_micros(F.col("max_date").cast("timestamp"))
                    - F.unix_micros(F.col("min_date").cast("timestamp"))) / 86_400_000_000)
    return stats.join(distinct, "column", "left").select(
        "column", "non_null_count", "min_date", "max_date", days.alias("date_range_days"),
        F.coalesce("unique_count", F.lit(0)).alias("unique_count"))


def schema_of(df: DataFrame, mark_all_required: bool = False, exact: bool = True) -> DataFrame:
    """``column, type, nullable, required, unique_count`` as found in the data."""
    names = {"numeric": "float", "datetime": "datetime", "categorical": "boolean", "text": "string"}

    def type_name(c):
        dtype = df.schema[c].dataType
        return "integer" if isinstance(dtype, T.IntegralType) else names[kind_of(dtype)]

    def metrics(c):
        out = [F.lit(type_name(c)).alias("type"), (F.count_if(missing(df, c)) > 0).alias("nullable")]
        if not exact:
            out.append(F.approx_count_distinct(F.col(c).cast("string")).alias("unique_count"))
        return out

    out = long_stats(df, df.columns, metrics)
    if exact:
        distinct = distinct_counts(df, df.columns).drop("rows")
        out = out.join(distinct, "column", "left").withColumn("unique_count", F.coalesce("unique_count", F.lit(0)))
    required = F.lit(True) if mark_all_required else ~F.col("nullable")
    return out.select("position", "column", "type", "nullable", required.alias("required"), "unique_count")


def column_profile(df: DataFrame, column: str) -> dict[str, DataFrame]:
    """The parts of a full profile of one column, each a frame over the same narrow projection."""
    from gridmill.operators.stats import describe, detect_outliers, outlier_summary
    narrow = df.select(column)
    parts = {"nulls": null_analysis(narrow, [column])}
    if kind_of(df.schema[column].dataType) == "numeric":
        parts.update(stats=describe(narrow, column), histogram=histogram(narrow, column),
                     outliers=outlier_summary(narrow, column))
        if "row_number" in df.columns:
            parts["outlier_rows"] = detect_outliers(df.select("row_number", column), column)
    else:
        parts.update(stats=categorical_stats(narrow, column), frequency=frequency_table(narrow, column))
    return parts
