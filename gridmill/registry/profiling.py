"""Profiles, type inference, comparison and validation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from gridmill.operators import compare as C, infer as I, profile as P, validate as V
from gridmill.registry.base import EVENTS_NULL, events_null, query, rounded


def _union(parts: list[str]) -> str:
    return " UNION ALL ".join(parts)


@query("histogram", "AGG19 FN16", """
    WITH s AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders),
    b AS (SELECT least(1 + CAST(floor((o_totalprice - lo) / (hi - lo) * 10) AS BIGINT), 10) AS bin, count(*) AS n
          FROM orders, s GROUP BY 1)
    SELECT i AS bin, round(lo + (hi - lo) / 10 * (i - 1), 2) AS low, round(lo + (hi - lo) / 10 * i, 2) AS high,
           coalesce(n, 0) AS count FROM s, range(1, 11) AS r(i) LEFT JOIN b ON b.bin = i""")
def _(t):
    return P.histogram(t.orders, "o_totalprice").drop("label")


@query("freq_table", "AGG20 WIN01", """
    SELECT p_name AS value, count(*) AS count, round(count(*) * 100.0 / (SELECT count(p_name) FROM part), 6) AS percentage
    FROM part GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50""")
def _(t):
    return rounded(P.frequency_table(t.part, "p_name", 50), 6, "percentage")


def _mode_sql(table, columns):
    return _union([f"""
        SELECT '{c}' AS "column", (SELECT count(DISTINCT {c}) FROM {table}) AS unique_values, value AS mode, n AS mode_count
        FROM (SELECT CAST({c} AS VARCHAR) AS value, count(*) AS n FROM {table} WHERE {c} IS NOT NULL GROUP BY 1
              ORDER BY 2 DESC, 1 LIMIT 1)""" for c in columns])


@query("cat_stats", "AGG21", _mode_sql("part", ["p_brand"]))
def _(t):
    return P.categorical_stats(t.part, "p_brand")


EVENT_COLUMNS = ["event_id", "user_id", "v", "kind"]
_BLANK = {"kind": "OR kind = ''"}


@query("missing_stats", "AGG22", _union([f"""
    SELECT '{c}' AS "column", count(*) AS total, count(*) FILTER ({c} IS NULL {_BLANK.get(c, '')}) AS missing_count,
           round(100.0 * count(*) FILTER ({c} IS NULL {_BLANK.get(c, '')}) / count(*), 6) AS missing_percentage
    FROM ({EVENTS_NULL})""" for c in EVENT_COLUMNS]))
def _(t):
    return rounded(P.missing_stats(events_null(t), EVENT_COLUMNS), 6, "missing_percentage")


@query("null_analysis", "AGG23", _union([f"""
    SELECT '{c}' AS "column", count(*) AS total, count(*) - count({c}) AS null_count,
           count(*) FILTER (CAST({c} AS VARCHAR) = '') AS empty_count,
           count({c}) - count(*) FILTER (CAST({c} AS VARCHAR) = '') AS non_null_count,
           round(100.0 * (count({c}) - count(*) FILTER (CAST({c} AS VARCHAR) = '')) / count(*), 6) AS completeness
    FROM ({EVENTS_NULL})""" for c in EVENT_COLUMNS]))
def _(t):
    return rounded(P.null_analysis(events_null(t), EVENT_COLUMNS), 6, "completeness")


def _summary_sql(name, table, numeric, text):
    cells = " + ".join(f"count(*) FILTER ({c} IS NULL{' OR ' + c + chr(61) + chr(39) * 2 if c in text else ''})"
                       for c in numeric + text)
    quality = f"(SELECT round(100.0 - ({cells}) * 100.0 / ({len(numeric + text)} * count(*)), 6) FROM {table})"
    rows = [f"""
        SELECT '{c}' AS "column", 'numeric' AS category, count(*) AS total, count(*) - count({c}) AS missing_count,
               round(avg({c}), 6) AS mean, round(median({c}), 6) AS median, round(stddev_samp({c}), 6) AS std,
               CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max, CAST(NULL AS BIGINT) AS unique_values,
               CAST(NULL AS VARCHAR) AS mode, CAST(NULL AS BIGINT) AS mode_count, {quality} AS quality_score FROM {table}"""
            for c in numeric]
    rows += [f"""
        SELECT '{c}', CASE WHEN count(DISTINCT {c}) <= 50 OR count(DISTINCT {c}) <= 0.05 * count({c})
                           THEN 'categorical' ELSE 'text' END,
               count(*), count(*) FILTER ({c} IS NULL OR {c} = ''), NULL, NULL, NULL, NULL, NULL, count(DISTINCT {c}),
               (SELECT {c} FROM {table} WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
               (SELECT count(*) FROM {table} WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY 1 DESC LIMIT 1),
               {quality} FROM {table}""" for c in text]
    return _union(rows)


@query("dataset_summary", "AGG24", _summary_sql(
    "dataset_summary", "customer", ["c_custkey", "c_nationkey", "c_acctbal"], ["c_name", "c_mktsegment"]))
def _(t):
    out = P.dataset_summary(t.customer).drop("position", "missing_percentage")
    return rounded(out, 6, "mean", "median", "std", "quality_score")


@query("dataset_summary_gaps", "AGG24", _summary_sql("g", f"({EVENTS_NULL})", ["user_id", "v"], ["kind"]))
def _(t):
    out = P.dataset_summary(events_null(t), ["user_id", "v", "kind"]).drop("position", "missing_percentage")
    return rounded(out, 6, "mean", "median", "std", "quality_score")


@query("column_profile", "AGG25", f"""
    WITH e AS (SELECT v FROM ({EVENTS_NULL})), q AS (SELECT quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3 FROM e),
    s AS (SELECT min(v) AS lo, max(v) AS hi FROM e)
    SELECT 'nulls' AS part, 'null_count' AS metric, CAST(count(*) - count(v) AS DOUBLE) AS value FROM e
    UNION ALL SELECT 'stats', 'mean', round(avg(v), 4) FROM e
    UNION ALL SELECT 'stats', 'median', round(median(v), 4) FROM e
    UNION ALL SELECT 'outliers', 'outlier_count',
        CAST(count(*) FILTER (v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1)) AS DOUBLE) FROM e, q
    UNION ALL SELECT 'histogram', 'bin ' || i, CAST(count(v) AS DOUBLE)
        FROM range(1, 11) r(i) LEFT JOIN (SELECT v, least(1 + floor((v - lo) / (hi - lo) * 10), 10) AS b FROM e, s) x
        ON x.b = i GROUP BY i""")
def _(t):
    parts = P.column_profile(events_null(t), "v")

    def metric(part, name):
        return parts[part].select(F.lit(part).alias("part"), F.lit(name).alias("metric"),
                                  F.round(F.col(name).cast("double"), 4).alias("value"))
    rows = [metric("nulls", "null_count"), metric("stats", "mean"), metric("stats", "median"),
            metric("outliers", "outlier_count"),
            parts["histogram"].select(F.lit("histogram").alias("part"), F.concat(F.lit("bin "), F.col("bin").cast("string"))
                                      .alias("metric"), F.col("count").cast("double").alias("value"))]
    return reduce(DataFrame.unionByName, rows)


@query("column_profile_text", "AGG25", """
    SELECT 'frequency' AS part, p_type AS metric, count(*) AS value FROM part GROUP BY 2
    UNION ALL SELECT 'stats', 'unique_values', count(DISTINCT p_type) FROM part
    UNION ALL SELECT 'nulls', 'non_null_count', count(p_type) FROM part""")
def _(t):
    parts = P.column_profile(t.part, "p_type")
    rows = [parts["frequency"].select(F.lit("frequency").alias("part"), F.col("value").alias("metric"),
                                      F.col("count").alias("value")),
            parts["stats"].select(F.lit("stats").alias("part"), F.lit("unique_values").alias("metric"),
                                  F.col("unique_values").alias("value")),
            parts["nulls"].select(F.lit("nulls").alias("part"), F.lit("non_null_count").alias("metric"),
                                  F.col("non_null_count").alias("value"))]
    return reduce(DataFrame.unionByName, rows)


NUMBER_COLUMNS = ["l_quantity", "l_extendedprice", "l_discount", "l_linenumber"]


@query("col_stats_num", "AGG27", _union([f"""
    SELECT '{c}' AS "column", count(*) AS total_count, count(*) - count({c}) AS null_count, CAST(min({c}) AS DOUBLE) AS min,
           CAST(max({c}) AS DOUBLE) AS max, round(avg({c}), 8) AS mean, round(median({c}), 6) AS median,
           round(stddev_samp({c}), 6) AS std, round(CAST(sum({c}) AS DOUBLE), 2) AS sum,
           round(quantile_cont({c}, 0.25), 6) AS percentile_25, round(quantile_cont({c}, 0.75), 6) AS percentile_75,
           round(quantile_cont({c}, 0.9), 6) AS percentile_90, round(quantile_cont({c}, 0.95), 6) AS percentile_95,
           count(DISTINCT {c}) AS unique_count FROM lineitem""" for c in NUMBER_COLUMNS]))
def _(t):
    out = P.numeric_column_stats(t.lineitem, NUMBER_COLUMNS)
    out = rounded(out, 6, "median", "std", *[f"percentile_{p}" for p in (25, 75, 90, 95)])
    return rounded(rounded(out, 2, "sum"), 8, "mean")


TEXTS = ["text", "lang", "source"]


@query("col_stats_str", "AGG28 FN06", _union([f"""
    SELECT '{c}' AS "column", count({c}) AS non_null_count, CAST(max(length({c})) AS INTEGER) AS max_length,
           CAST(min(length({c})) AS INTEGER) AS min_length, round(avg(length({c})), 6) AS avg_length,
           count(DISTINCT {c}) AS unique_count, round(count(DISTINCT {c}) / count({c}), 6) AS cardinality_ratio
    FROM documents""" for c in TEXTS]))
def _(t):
    return rounded(P.text_column_stats(t.documents, TEXTS), 6, "avg_length", "cardinality_ratio")


@query("top_values", "AGG28 SRT05", _union([f"""
    SELECT * FROM (SELECT '{c}' AS "column", CAST(row_number() OVER (ORDER BY count(*) DESC, {c}) AS INTEGER) AS rank,
                          {c} AS value, count(*) AS count FROM part GROUP BY {c}) WHERE rank <= 10"""
    for c in ["p_name", "p_brand", "p_type"]]))
def _(t):
    return P.top_values(t.part, ["p_name", "p_brand", "p_type"], 10)


@query("col_stats_date", "AGG29 FN14", _union([f"""
    SELECT '{c}' AS "column", count({c}) AS non_null_count, strftime(min({c}), '%Y-%m-%d %H:%M:%S') AS min_date,
           strftime(max({c}), '%Y-%m-%d %H:%M:%S') AS max_date,
           CAST(floor((epoch_us(max({c})) - epoch_us(min({c}))) / 86400000000) AS BIGINT) AS date_range_days,
           count(DISTINCT {c}) AS unique_count FROM {t}""" for c, t in [("o_orderdate", "orders")]] + [f"""
    SELECT 'ts', count(ts), strftime(min(ts), '%Y-%m-%d %H:%M:%S'), strftime(max(ts), '%Y-%m-%d %H:%M:%S'),
           CAST(floor((epoch_us(max(ts)) - epoch_us(min(ts))) / 86400000000) AS BIGINT), count(DISTINCT ts) FROM events"""]))
def _(t):
    out = P.datetime_column_stats(t.orders, ["o_orderdate"]).unionByName(P.datetime_column_stats(t.events, ["ts"]))
    return out.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("min_date", "max_date")})


@query("schema_of", "AGG32", _union([f"""
    SELECT '{c}' AS "column", '{k}' AS type, count(*) > count({c}) AS nullable, count(*) = count({c}) AS required,
           count(DISTINCT {c}) AS unique_count FROM ({EVENTS_NULL})"""
    for c, k in [("event_id", "integer"), ("ts", "datetime"), ("user_id", "integer"), ("event_type", "string"),
                 ("v", "float"), ("kind", "string")]]))
def _(t):
    return P.schema_of(events_null(t)).drop("position")


# --- inference ---------------------------------------------------------------

TYPED = """
    SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'yes' ELSE 'F' END AS flag,
           CASE WHEN event_id % 20 = 19 THEN 'n/a' ELSE CAST(event_id AS VARCHAR) END AS whole,
           '  ' || CAST(user_id AS VARCHAR) || '.5' AS part,
           strftime(ts, '%Y-%m-%d') AS day, strftime(ts, '%Y-%m-%d %H:%M:%S') AS moment,
           'user' || user_id || '@example.com' AS email, 'https://example.com/u/' || user_id AS url,
           '00000000-0000-4000-8000-' || lpad(CAST(event_id AS VARCHAR), 12, '0') AS uuid,
           '(555) 123-' || lpad(CAST(user_id AS VARCHAR), 4, '0') AS phone,
           event_type, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS v, CAST(NULL AS VARCHAR) AS nothing
    FROM events"""


def _typed(t):
    i, u = F.col("event_id"), F.col("user_id").cast("string")
    return t.events.select(
        i, F.when(i % 2 == 0, "yes").otherwise("F").alias("flag"),
        F.when(i % 20 == 19, "n/a").otherwise(i.cast("string")).alias("whole"),
        F.concat(F.lit("  "), u, F.lit(".5")).alias("part"), F.date_format("ts", "yyyy-MM-dd").alias("day"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("moment"),
        F.concat(F.lit("user"), u, F.lit("@example.com")).alias("email"),
        F.concat(F.lit("https://example.com/u/"), u).alias("url"),
        F.concat(F.lit("00000000-0000-4000-8000-"), F.lpad(i.cast("string"), 12, "0")).alias("uuid"),
        F.concat(F.lit("(555) 123-"), F.lpad(u, 4, "0")).alias("phone"),
        "event_type", F.when(i % 7 != 0, F.col("value")).alias("v"), F.lit(None).cast("string").alias("nothing"))


_EXPECTED = [("event_id", "integer", "BIGINT"), ("flag", "boolean", "BOOLEAN"), ("whole", "integer", "INTEGER"),
             ("part", "float", "DOUBLE PRECISION"), ("day", "date", "DATE"), ("moment", "datetime", "TIMESTAMP"),
             ("email", "email", "VARCHAR(255)"), ("url", "url", "TEXT"), ("uuid", "uuid", "UUID"),
             ("phone", "phone", "VARCHAR(20)"), ("event_type", "string", None), ("v", "float", "DOUBLE PRECISION"),
             ("nothing", "null", "TEXT")]


@query("infer_types", "INF01 INF02 INF03 INF06 FN03 FN13", f"WITH x AS ({TYPED}) " + _union([f"""
    SELECT '{c}' AS "column", '{k}' AS inferred_type,
           {"round(count(*) FILTER (whole <> 'n/a') / count(*), 6)" if c == "whole" else "CAST(1 AS DOUBLE)"} AS confidence,
           count({c}) < count(*) AS nullable, count(*) - count({c}) AS null_count FROM x""" for c, k, _ in _EXPECTED]))
def _(t):
    out = I.infer_types(_typed(t)).select("column", "inferred_type", "confidence", "nullable", "null_count")
    return rounded(out, 6, "confidence")


@query("sql_types", "INF04", f"WITH x AS ({TYPED}) " + _union([f"""
    SELECT '{c}' AS "column", '{k}' AS inferred_type, {("'" + s + "'") if s else
        "'VARCHAR(' || greatest(floor(max(length(event_type)) * 1.2), max(length(event_type)) + 50, 50)::BIGINT || ')'"} AS sql_type
    {"" if s else "FROM x"}""" for c, k, s in _EXPECTED]))
def _(t):
    return I.suggest_sql_types(_typed(t)).select("column", "inferred_type", "sql_type")


@query("infer_urls", "INF03 FN04", """
    WITH s AS (SELECT avg(CASE WHEN regexp_matches(trim(url),
        '^https?://(?:www\\.)?[-a-zA-Z0-9@:%._\\+~#=]{1,256}\\.[a-zA-Z0-9()]{1,6}\\b(?:[-a-zA-Z0-9()@:%_\\+.~#?&/=]*)$')
        THEN 1.0 ELSE 0.0 END) AS share FROM pages)
    SELECT 'url' AS "column", CASE WHEN share >= 0.8 THEN 'url' ELSE 'string' END AS inferred_type,
           CASE WHEN share >= 0.8 THEN round(share, 6) ELSE 1 END AS confidence FROM s""")
def _(t):
    return rounded(I.infer_types(t.pages, ["url"]).select("column", "inferred_type", "confidence"), 6, "confidence")


@query("preview_types", "INF05", _union([f"SELECT '{c}' AS \"column\", '{k}' AS type" for c, k in [
    ("event_id", "integer"), ("flag", "string"), ("whole", "string"), ("part", "string"), ("day", "date"),
    ("moment", "date"), ("email", "string"), ("url", "string"), ("uuid", "string"), ("phone", "string"),
    ("event_type", "string"), ("nothing", "unknown")]]))
def _(t):
    return I.preview_types(_typed(t).drop("v"), "event_id")


@query("sample_values", "INF01", _union([f"""
    SELECT * FROM (SELECT '{c}' AS "column", CAST(row_number() OVER (ORDER BY event_id) AS INTEGER) AS rank,
                          CAST({c} AS VARCHAR) AS value FROM ({EVENTS_NULL}) WHERE {c} IS NOT NULL) WHERE rank <= 5"""
    for c in ["user_id", "kind"]]))
def _(t):
    return I.sample_values(events_null(t), ["user_id", "kind"], "event_id")


@query("analyze", "AGG30", """
    SELECT 'c_custkey' AS "column", 'integer' AS inferred_type, 'BIGINT' AS sql_type, count(DISTINCT c_custkey) AS unique_count,
           count(*) AS row_count, 5 AS column_count FROM customer
    UNION ALL SELECT 'c_name', 'string', 'VARCHAR(' || greatest(floor(max(length(c_name)) * 1.2), max(length(c_name)) + 50, 50)::BIGINT || ')',
           count(DISTINCT c_name), count(*), 5 FROM customer
    UNION ALL SELECT 'c_nationkey', 'integer', 'INTEGER', count(DISTINCT c_nationkey), count(*), 5 FROM customer
    UNION ALL SELECT 'c_acctbal', 'float', 'DOUBLE PRECISION', count(DISTINCT c_acctbal), count(*), 5 FROM customer
    UNION ALL SELECT 'c_mktsegment', 'string', 'VARCHAR(' || greatest(floor(max(length(c_mktsegment)) * 1.2), max(length(c_mktsegment)) + 50, 50)::BIGINT || ')',
           count(DISTINCT c_mktsegment), count(*), 5 FROM customer""")
def _(t):
    df = t.customer
    rows = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    distinct = P.schema_of(df).select("column", "unique_count")
    return I.suggest_sql_types(df).drop("position").join(distinct, "column").select(
        "*", rows.alias("row_count"), F.lit(len(df.columns)).alias("column_count"))


@query("conv_failures", "VAL09", f"WITH x AS ({TYPED}) " + """
    SELECT 'whole' AS "column", 'n/a' AS value, count(*) AS count FROM x WHERE whole = 'n/a' HAVING count(*) > 0
    UNION ALL SELECT 'event_type', event_type, count(*) FROM x GROUP BY 2""")
def _(t):
    df = _typed(t)
    parts = [I.failed_values(df, c, kind).select(F.lit(c).alias("column"), "value", "count")
             for c, kind in (("whole", "integer"), ("event_type", "datetime"), ("flag", "boolean"))]
    return reduce(DataFrame.unionByName, parts)


@query("conv_check", "VAL09 FN09", f"WITH x AS ({TYPED}) " + """
    SELECT 'whole' AS "column", 'integer' AS target_type, count(whole) AS total, count(*) FILTER (whole <> 'n/a') AS successful_count,
           count(*) FILTER (whole = 'n/a') AS failed_count, round(count(*) FILTER (whole <> 'n/a') / count(whole), 6) AS conversion_rate,
           count(*) FILTER (whole <> 'n/a') / count(whole) >= 0.95 AS can_convert FROM x
    UNION ALL SELECT 'event_type', 'datetime', count(*), 0, count(*), 0, FALSE FROM x
    UNION ALL SELECT 'flag', 'boolean', count(*), count(*), 0, 1, TRUE FROM x
    UNION ALL SELECT 'day', 'date', count(*), count(*), 0, 1, TRUE FROM x""")
def _(t):
    df = _typed(t)
    parts = [I.check_conversion(df, c, k) for c, k in
             [("whole", "integer"), ("event_type", "datetime"), ("flag", "boolean"), ("day", "date")]]
    return rounded(reduce(DataFrame.unionByName, parts), 6, "conversion_rate")


# --- comparison --------------------------------------------------------------

def _pair(t):
    a = t.customer.select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"),
                          F.col("c_acctbal").alias("balance"), F.col("c_nationkey").alias("nation"),
                          F.col("c_mktsegment").alias("segment"))
    b = t.supplier.select(F.col("s_suppkey").cast("string").alias("key"), F.col("s_name").alias("name"),
                          F.col("s_acctbal").alias("balance"), F.col("s_nationkey").alias("nation"))
    return a, b


def _stats_sql(col, name, n):
    return f"""avg({col}) AS mean_{n}, median({col}) AS median_{n}, stddev_samp({col}) AS std_{n},
               CAST(min({col}) AS DOUBLE) AS min_{n}, CAST(max({col}) AS DOUBLE) AS max_{n}"""


@query("compare_datasets", "AGG26", "SELECT \"column\"," + ",".join(
    f"round({m}_{n}, 4) AS {m}_{n}" for m in ("mean", "median", "std", "min", "max") for n in (1, 2)) + """,
    round(abs(mean_1 - mean_2), 4) AS mean_diff, round(abs(median_1 - median_2), 4) AS median_diff FROM (""" + _union([
        f"""SELECT '{name}' AS "column", * FROM (SELECT {_stats_sql(c, name, 1)} FROM customer),
            (SELECT {_stats_sql(s, name, 2)} FROM supplier)"""
        for name, c, s in [("balance", "c_acctbal", "s_acctbal"), ("nation", "c_nationkey", "s_nationkey")]]) + ")")
def _(t):
    out = C.compare_datasets(*_pair(t))
    return rounded(out, 4, *[c for c in out.columns if c != "column"])


@query("row_difference", "SET03", """
    SELECT o_custkey FROM orders EXCEPT ALL SELECT c_custkey FROM customer""")
def _(t):
    return C.row_difference(t.orders.select("o_custkey"), t.customer.select(F.col("c_custkey").alias("o_custkey")))


def _props_schema(t):
    """Field names found in the data: the columns two tables share, read from JSON rows."""
    a, b = _pair(t)
    keys = [F.explode(F.json_object_keys(F.to_json(F.struct(*df.columns)))).alias("column") for df in (a, b)]
    return a.select(keys[0]), b.select(keys[1])


@query("schema_intersect", "SET02 JOI08 FN18", """
    SELECT 'key' AS "column" UNION ALL SELECT 'name' UNION ALL SELECT 'balance' UNION ALL SELECT 'nation'""")
def _(t):
    a, b = _props_schema(t)
    return a.intersect(b)


@query("compare_schemas", "JOI08 SET02 SET03", """
    SELECT 'key' AS "column", 'numeric' AS type1, 'text' AS type2, 'type_diff' AS status, (SELECT count(c_custkey) FROM customer) AS values1
    UNION ALL SELECT 'name', 'text', 'text', 'common', (SELECT count(c_name) FROM customer)
    UNION ALL SELECT 'balance', 'numeric', 'numeric', 'common', (SELECT count(c_acctbal) FROM customer)
    UNION ALL SELECT 'nation', 'numeric', 'numeric', 'common', (SELECT count(c_nationkey) FROM customer)
    UNION ALL SELECT 'segment', 'text', NULL, 'only_1', (SELECT count(c_mktsegment) FROM customer)""")
def _(t):
    a, b = _pair(t)
    counted = P.null_analysis(a).select("column", F.col("non_null_count").alias("values1"))
    return C.compare_schemas(a, b).join(counted, "column", "left")


# --- validation --------------------------------------------------------------

MESSAGE = "CASE WHEN bad > 0 THEN 'error' ELSE 'info' END AS severity, bad AS invalid_count, total, round(100.0 * bad / total, 6) AS invalid_percentage"


def _checks(rows: list[tuple[str, str, str, str, str]]) -> str:
    return _union([f"""SELECT '{rule}' AS rule, '{col}' AS "column", {MESSAGE} FROM (SELECT count(*) FILTER ({bad}) AS bad,
        count({total}) AS total FROM {source})""" for rule, col, bad, total, source in rows])


def _shown(df):
    return rounded(df.drop("message"), 6, "invalid_percentage")


@query("val_types", "VAL02", _checks([
    ("data_types", "whole", "whole = 'n/a'", "whole", f"({TYPED})"),
    ("data_types", "part", "FALSE", "part", f"({TYPED})"),
    ("data_types", "flag", "FALSE", "flag", f"({TYPED})"),
    ("data_types", "event_type", "TRUE", "event_type", f"({TYPED})"),
    ("data_types", "moment", "FALSE", "moment", f"({TYPED})"),
    ("data_types", "email", "FALSE", "email", f"({TYPED})")]))
def _(t):
    types = {"whole": "integer", "part": "float", "flag": "boolean", "event_type": "date", "moment": "datetime",
             "email": "string"}
    return _shown(V.check_rows(_typed(t), {"data_types": types}))


@query("val_unique", "VAL03", _union([f"""
    SELECT 'unique_constraints' AS rule, '{c}' AS "column", {MESSAGE} FROM (
        SELECT CAST(coalesce(sum(n) FILTER (n > 1), 0) AS BIGINT) AS bad, CAST(sum(n) AS BIGINT) AS total
        FROM (SELECT count(*) AS n FROM {table} GROUP BY {c}))""" for c, table in [
    ("l_orderkey,l_linenumber", "lineitem"), ("l_orderkey", "lineitem"), ("o_orderkey", "orders")]]))
def _(t):
    parts = [V.check_unique(t.lineitem, ["l_orderkey", "l_linenumber"]), V.check_unique(t.lineitem, ["l_orderkey"]),
             V.check_unique(t.orders, ["o_orderkey"])]
    return _shown(reduce(DataFrame.unionByName, parts))


@query("val_unique_top", "VAL03 SRT05", """
    SELECT l_orderkey, l_linenumber, count(*) AS count FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1
    ORDER BY 3 DESC, 1, 2 LIMIT 10""")
def _(t):
    return V.top_duplicates(t.lineitem, ["l_orderkey", "l_linenumber"], 10)


@query("val_unique_values", "VAL03", """
    SELECT CAST(sum(n) AS BIGINT) AS duplicate_rows, count(*) AS duplicate_values, max(n) AS largest
    FROM (SELECT count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1)""")
def _(t):
    return V.duplicate_values(t.documents, ["text"])


@query("val_range", "VAL04", _checks([
    ("range_checks", "l_quantity", "l_quantity < 2 OR l_quantity > 48", "l_quantity", "lineitem"),
    ("range_checks", "l_discount", "l_discount > CAST(0.08 AS DOUBLE)", "l_discount", "lineitem"),
    ("range_checks", "l_tax", "l_tax < 0", "l_tax", "lineitem")]))
def _(t):
    checks = [{"column": "l_quantity", "min": 2, "max": 48}, {"column": "l_discount", "max": 0.08},
              {"column": "l_tax", "min": 0}]
    return _shown(V.check_rows(t.lineitem, {"range_checks": checks}))


@query("val_range_actual", "VAL04", "SELECT min(l_quantity) AS actual_min, max(l_quantity) AS actual_max FROM lineitem")
def _(t):
    return V.value_range(t.lineitem, "l_quantity")


@query("val_pattern", "VAL05 UDF02", _checks([
    ("pattern_checks", "url", "NOT regexp_matches(url, '^(?:https?://(m|www)\\.)')", "url", "pages"),
    ("pattern_checks", "html", "NOT regexp_matches(html, '^(?:<!doctype html>)', 'i')", "html", "pages")]))
def _(t):
    checks = [{"column": "url", "pattern": r"https?://(m|www)\."},
              {"column": "html", "pattern": "<!doctype html>", "flags": "i"}]
    return _shown(V.check_rows(t.pages, {"pattern_checks": checks}))


@query("val_fk", "VAL06 JOI01", f"""
    SELECT 'foreign_keys' AS rule, 'doc_id' AS "column", {MESSAGE} FROM (
        SELECT count(*) FILTER (doc_id NOT IN (SELECT doc_id FROM labels)) AS bad, count(doc_id) AS total FROM documents)""")
def _(t):
    return _shown(V.check_foreign_key(t.documents, "doc_id", t.labels, "doc_id"))


@query("fk_orphans", "VAL06 JOI01", """
    SELECT o_custkey AS value, count(*) AS count FROM orders
    WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) GROUP BY 1""")
def _(t):
    return V.orphan_values(t.orders, "o_custkey", t.customer.filter("c_acctbal > 0"), "c_custkey")


@query("fk_valid_rows", "JOI01", "SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def _(t):
    from gridmill.operators.relations import seen
    return seen(t.documents, t.labels, ["doc_id"]).select("doc_id", "lang")


@query("val_notnull", "VAL07", _checks([
    ("not_null", "v", "v IS NULL", "*", f"({EVENTS_NULL})"), ("not_null", "kind", "kind IS NULL", "*", f"({EVENTS_NULL})"),
    ("not_null", "user_id", "user_id IS NULL", "*", f"({EVENTS_NULL})")]))
def _(t):
    return _shown(V.check_not_null(events_null(t), ["v", "kind", "user_id"]))


def _rule_set(t):
    return {
        "required_columns": ["o_orderkey", "o_comment"],
        "data_types": {"o_orderkey": "integer", "o_orderstatus": "float"},
        "unique_constraints": [["o_orderkey"], ["o_custkey", "o_orderdate"]],
        "range_checks": [{"column": "o_totalprice", "min": 1000, "max": 400000}],
        "pattern_checks": [{"column": "o_orderpriority", "pattern": "[1-4]-"}],
        "foreign_keys": [{"column": "o_custkey", "values": t.customer, "key": "c_custkey"}],
        "not_null": ["o_orderdate"],
    }


RULES_SQL = f"""
    SELECT 'required_columns' AS rule, 'o_orderkey' AS "column", 'info' AS severity, CAST(0 AS BIGINT) AS invalid_count,
           CAST(0 AS BIGINT) AS total, CAST(0 AS DOUBLE) AS invalid_percentage
    UNION ALL SELECT 'required_columns', 'o_comment', 'error', 0, 0, 0
    UNION ALL {_checks([
        ("data_types", "o_orderkey", "FALSE", "o_orderkey", "orders"),
        ("data_types", "o_orderstatus", "TRUE", "o_orderstatus", "orders"),
        ("range_checks", "o_totalprice", "o_totalprice < 1000 OR o_totalprice > 400000", "o_totalprice", "orders"),
        ("pattern_checks", "o_orderpriority", "NOT regexp_matches(o_orderpriority, '^[1-4]-')", "o_orderpriority", "orders"),
        ("not_null", "o_orderdate", "o_orderdate IS NULL", "*", "orders"),
        ("foreign_keys", "o_custkey", "o_custkey NOT IN (SELECT c_custkey FROM customer)", "o_custkey", "orders")])}
    UNION ALL {_union([f'''
        SELECT 'unique_constraints' AS rule, '{c}' AS "column", {MESSAGE} FROM (
            SELECT CAST(coalesce(sum(n) FILTER (n > 1), 0) AS BIGINT) AS bad, CAST(sum(n) AS BIGINT) AS total
            FROM (SELECT count(*) AS n FROM orders GROUP BY {c}))''' for c in ("o_orderkey", "o_custkey,o_orderdate")])}"""


@query("val_rules", "VAL01 VAL08", RULES_SQL)
def _(t):
    return _shown(V.check_all(t.orders, _rule_set(t)))


@query("val_summary", "VAL08", f"""
    SELECT count(*) AS checks, count(*) FILTER (severity = 'error') AS errors, CAST(0 AS BIGINT) AS warnings,
           count(*) FILTER (severity = 'info') AS infos, count(*) FILTER (severity = 'error') = 0 AS passed FROM ({RULES_SQL})""")
def _(t):
    return V.summary(V.check_all(t.orders, _rule_set(t)))


@query("val_samples", "VAL02 VAL04 VAL05", """
    WITH bad AS (
        SELECT 'range_checks' AS rule, 'o_totalprice' AS "column", o_orderkey, CAST(o_totalprice AS VARCHAR) AS value FROM orders
        WHERE o_totalprice < 10000
        UNION ALL SELECT 'pattern_checks', 'o_orderpriority', o_orderkey, o_orderpriority FROM orders
        WHERE NOT regexp_matches(o_orderpriority, '^[1-4]-'))
    SELECT rule, "column", CAST(rank AS INTEGER) AS rank, o_orderkey
    FROM (SELECT *, row_number() OVER (PARTITION BY rule, "column" ORDER BY o_orderkey) AS rank FROM bad) WHERE rank <= 10""")
def _(t):
    rules = {"range_checks": [{"column": "o_totalprice", "min": 10000}],
             "pattern_checks": [{"column": "o_orderpriority", "pattern": "[1-4]-"}]}
    return V.invalid_samples(t.orders, rules, 10, "o_orderkey").drop("value")


@query("val_quarantine", "VAL08", """
    SELECT o_orderkey, CASE WHEN o_totalprice < 10000 OR o_orderpriority NOT LIKE '_-%' THEN 'bad' ELSE 'good' END AS state FROM orders""")
def _(t):
    rules = {"range_checks": [{"column": "o_totalprice", "min": 10000}],
             "pattern_checks": [{"column": "o_orderpriority", "pattern": ".-"}]}
    good, bad = V.quarantine(t.orders, rules)
    return good.select("o_orderkey", F.lit("good").alias("state")).unionByName(
        bad.select("o_orderkey", F.lit("bad").alias("state")))
