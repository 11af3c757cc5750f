"""Duplicates, missing values, text and number cleaning, row order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from gridmill.functions import dates as D, text as X
from gridmill.operators import clean as K, ordered as O, profile as P
from gridmill.registry.base import EVENTS_NULL, events_null, query, rounded


def _keep(name, covers, order):
    @query(f"dedup_{name}", covers, f"""
        SELECT doc_id, lang, source, n_chars FROM (
            SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id {order}) AS rn FROM documents) WHERE rn = 1""")
    def build(t):
        return K.drop_duplicates(t.documents, ["text"], name, "doc_id").select("doc_id", "lang", "source", "n_chars")


_keep("first", "WIN02", "ASC")
_keep("last", "WIN03", "DESC")


@query("dedup_none", "WIN04", """
    SELECT doc_id, lang, source, n_chars FROM (
        SELECT *, count(*) OVER (PARTITION BY text) AS n FROM documents) WHERE n = 1""")
def _(t):
    return K.drop_duplicates(t.documents, ["text"], "none", "doc_id").select("doc_id", "lang", "source", "n_chars")


@query("dedup_events", "WIN02", """
    SELECT event_id, user_id, event_type FROM (
        SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS rn FROM events) WHERE rn = 1""")
def _(t):
    return K.drop_duplicates(t.events, ["user_id", "event_type"], "first", "event_id").select(
        "event_id", "user_id", "event_type")


@query("dup_report", "WIN05", """
    SELECT CAST(sum(n) AS BIGINT) AS rows_before, CAST(sum(n - 1) AS BIGINT) AS removed,
           CAST(coalesce(sum(n) FILTER (n > 1), 0) AS BIGINT) AS duplicate_rows,
           count(*) FILTER (n > 1) AS duplicate_groups, round(100.0 * sum(n - 1) / sum(n), 6) AS removed_percentage
    FROM (SELECT count(*) AS n FROM documents GROUP BY text)""")
def _(t):
    return rounded(K.duplicate_report(t.documents, ["text"]), 6, "removed_percentage")


# --- missing values ----------------------------------------------------------

def _fill(name, strategy, covers, expression, columns=("v",), select="v", **args):
    @query(name, covers, f"SELECT event_id, {expression} AS {select} FROM ({EVENTS_NULL}) e")
    def build(t):
        out = K.handle_missing(events_null(t), strategy, list(columns), row_number="event_id", **args)
        return out.select("event_id", F.round(select, 6).alias(select) if select == "v" else select)


_fill("fill_mean", "fill_mean", "CLN03", f"round(coalesce(v, (SELECT avg(v) FROM ({EVENTS_NULL}))), 6)")
_fill("fill_median", "fill_median", "CLN04", f"round(coalesce(v, (SELECT median(v) FROM ({EVENTS_NULL}))), 6)")
_fill("fill_value", "fill_value", "CLN06", "coalesce(v, -1)", value=-1.0)
_fill("fill_mode", "fill_mode", "CLN05", f"""coalesce(kind, (
    SELECT kind FROM ({EVENTS_NULL}) WHERE kind IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1))""",
      columns=("kind",), select="kind")
_fill("fill_ffill", "fill_forward", "WIN06",
      "last_value(v IGNORE NULLS) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
_fill("fill_bfill", "fill_backward", "WIN07",
      "first_value(v IGNORE NULLS) OVER (ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)")


@query("fill_ffill_keyed", "WIN06", f"""
    SELECT event_id, last_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS v FROM ({EVENTS_NULL})""")
def _(t):
    out = O.fill_forward(events_null(t), ["v"], "event_id", ["user_id"], chunk=1000)
    return out.select("event_id", "v")


@query("interpolate", "WIN08", f"""
    WITH e AS ({EVENTS_NULL}), w AS (
        SELECT event_id, v,
            last_value(v IGNORE NULLS) OVER b AS pv, first_value(v IGNORE NULLS) OVER f AS nv,
            last_value(CASE WHEN v IS NOT NULL THEN event_id END IGNORE NULLS) OVER b AS pp,
            first_value(CASE WHEN v IS NOT NULL THEN event_id END IGNORE NULLS) OVER f AS np
        FROM e WINDOW b AS (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                      f AS (ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
    SELECT event_id, round(CASE WHEN v IS NOT NULL THEN v WHEN nv IS NULL THEN pv
                                ELSE pv + (nv - pv) * (event_id - pp) / (np - pp) END, 6) AS v FROM w""")
def _(t):
    out = K.handle_missing(events_null(t), "interpolate", ["v"], row_number="event_id")
    return out.select("event_id", F.round("v", 6).alias("v"))


@query("drop_any", "CLN01", f"SELECT event_id, v, kind FROM ({EVENTS_NULL}) WHERE v IS NOT NULL AND kind IS NOT NULL")
def _(t):
    return K.handle_missing(events_null(t), "drop", ["v", "kind"]).select("event_id", "v", "kind")


@query("drop_all", "CLN02", f"SELECT event_id, v, kind FROM ({EVENTS_NULL}) WHERE v IS NOT NULL OR kind IS NOT NULL")
def _(t):
    return K.handle_missing(events_null(t), "drop_all", ["v", "kind"]).select("event_id", "v", "kind")


@query("missing_report", "CLN07", f"""
    SELECT 'v' AS "column", count(*) - count(v) AS missing_before, CAST(0 AS BIGINT) AS missing_after FROM ({EVENTS_NULL})
    UNION ALL SELECT 'kind', count(*) - count(kind), count(*) - count(kind) FROM ({EVENTS_NULL})""")
def _(t):
    before = events_null(t)
    return P.missing_report(before, K.handle_missing(before, "fill_mean", ["v", "kind"]), ["v", "kind"])


# --- text and numbers --------------------------------------------------------

PADDED = "SELECT c_custkey, '  ' || chr(9) || c_name || chr(9) || '  ' AS name, ' ' || c_mktsegment AS segment FROM customer"


def _padded(t):
    return t.customer.select("c_custkey", F.concat(F.lit("  \t"), F.col("c_name"), F.lit("\t  ")).alias("name"),
                             F.concat(F.lit(" "), F.col("c_mktsegment")).alias("segment"))


@query("trim", "CLN08 FN01", "SELECT c_custkey, c_name AS name, c_mktsegment AS segment FROM customer")
def _(t):
    return K.trim_whitespace(_padded(t))


@query("trim_report", "CLN08", """
    SELECT 'name' AS "column", count(*) AS total, count(*) AS changed FROM customer
    UNION ALL SELECT 'segment', count(*), count(*) FROM customer""")
def _(t):
    return K.change_report(_padded(t), ["name", "segment"], X.strip)


def _case(case, covers, sql):
    @query(f"case_{case}", covers, f"SELECT p_partkey, {sql} AS p_name, {sql.replace('p_name', 'p_type')} AS p_type FROM part")
    def build(t):
        return K.standardize_case(t.part.select("p_partkey", "p_name", "p_type"), ["p_name", "p_type"], case)


_case("lower", "CLN09 FN01", "lower(p_name)")
_case("upper", "CLN10 FN01", "upper(p_name)")
_case("capitalize", "CLN12 FN01", "upper(substr(p_name, 1, 1)) || lower(substr(p_name, 2))")


@query("case_title", "CLN11 FN01", """
    SELECT p_partkey, array_to_string(list_transform(regexp_extract_all(p_name || '-' || p_brand, '[A-Za-z]+|[^A-Za-z]+'),
        lambda w: upper(substr(w, 1, 1)) || lower(substr(w, 2))), '') AS name FROM part""")
def _(t):
    return K.standardize_case(t.part.select("p_partkey", F.concat_ws("-", "p_name", "p_brand").alias("name")), ["name"],
                              "title")


@query("case_title_text", "CLN11", """
    SELECT doc_id, array_to_string(list_transform(regexp_extract_all(text, '\\p{L}+|[^\\p{L}]+'),
        lambda w: replace(upper(substr(w, 1, 1)), 'ẞ', 'Ss') || lower(substr(w, 2))), '') AS text FROM documents""")
def _(t):
    return K.standardize_case(t.documents.select("doc_id", "text"), ["text"], "title")


MONEY = """
    SELECT o_orderkey, CASE WHEN o_orderkey % 13 = 0 THEN 'n/a' WHEN o_orderkey % 17 = 0 THEN '12.5d'
        ELSE '$ ' || CAST(floor(o_totalprice / 1000) AS BIGINT) || ',' ||
             lpad(CAST(CAST(floor(o_totalprice) AS BIGINT) % 1000 AS VARCHAR), 3, '0') || '.25' END AS money
    FROM orders"""


def _money(t):
    p, k = F.floor("o_totalprice"), F.col("o_orderkey")
    text = F.concat(F.lit("$ "), F.floor(F.col("o_totalprice") / 1000).cast("string"), F.lit(","),
                    F.lpad((p % 1000).cast("string"), 3, "0"), F.lit(".25"))
    return t.orders.select("o_orderkey", F.when(k % 13 == 0, "n/a").when(k % 17 == 0, "12.5d").otherwise(text).alias("money"))


@query("clean_numeric", "CLN17 FN02 FN09", f"""
    SELECT o_orderkey, TRY_CAST(CASE WHEN money NOT LIKE '%d' THEN replace(replace(replace(money, '$', ''), ',', ''), ' ', '') END
        AS DOUBLE) AS money FROM ({MONEY})""")
def _(t):
    return K.clean_numeric(_money(t), ["money"])


DATES = """
    SELECT o_orderkey, CASE WHEN o_orderkey % 17 = 0 THEN 'bad' WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%Y-%m-%d')
        ELSE strftime(o_orderdate, '%m/%d/%Y') END AS day, o_orderkey % 17 = 0 AS broken, o_orderdate FROM orders"""


def _dates(t):
    k = F.col("o_orderkey")
    return t.orders.select("o_orderkey", F.when(k % 17 == 0, "bad").when(k % 2 == 0, F.date_format("o_orderdate", "yyyy-MM-dd"))
                           .otherwise(F.date_format("o_orderdate", "MM/dd/yyyy")).alias("day"))


# One text per format of day and time, and the microseconds after midnight that it means.
DATE_TEXTS = {
    "yyyy-MM-dd'T10:00:00Z'": 36_000_000_000, "yyyy-MM-dd'T10:00:00.123Z'": 36_000_123_000, "yyyy-MM-dd'T10:00:00+02:00'": 28_800_000_000,
    "yyyy-MM-dd'T10:00:00.123'": 36_000_123_000, "yyyy-MM-dd'T10:00:00.5'": 36_000_500_000, "M/d/yyyy": 0, "yyyy-M-d": 0,
    "MM/dd/yyyy' 10:00'": 36_000_000_000, "yyyyMMdd": 0, "MMMM d, yyyy": 0, "d MMM yyyy": 0,
}


@query("date_texts", "FN10 CLN16 INF02", f"""
    SELECT o_orderkey, epoch_us(CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP)) + {list(DATE_TEXTS.values())}[(o_orderkey % {len(DATE_TEXTS)} + 1)::INT] AS at
    FROM orders""")
def _(t):
    texts = F.array(*[F.date_format("o_orderdate", pattern) for pattern in DATE_TEXTS])
    text = F.element_at(texts, (F.col("o_orderkey") % len(DATE_TEXTS) + 1).cast("int"))
    return t.orders.select("o_orderkey", F.unix_micros(D.parse_timestamp(text).cast("timestamp")).alias("at"))


@query("normalize_dates", "CLN16 FN10", f"""
    SELECT o_orderkey, CASE WHEN NOT broken THEN strftime(o_orderdate, '%d.%m.%Y') END AS day FROM ({DATES})""")
def _(t):
    return K.normalize_dates(_dates(t), ["day"], "%d.%m.%Y")


@query("normalize_dates_format", "CLN16 FN10", f"""
    SELECT o_orderkey, CASE WHEN NOT broken AND o_orderkey % 2 = 1 THEN strftime(o_orderdate, '%Y-%m-%d %H:%M') END AS day FROM ({DATES})""")
def _(t):
    out = K.normalize_dates(_dates(t), ["day"], parse_format="%m/%d/%Y")
    return out.select("o_orderkey", F.date_format("day", "yyyy-MM-dd HH:mm").alias("day"))


@query("dates_report", "CLN16", f"""
    SELECT 'day' AS "column", count(*) FILTER (NOT broken) AS converted, count(*) FILTER (broken) AS failed FROM ({DATES})""")
def _(t):
    before = _dates(t)
    return K.conversion_report(before, K.normalize_dates(before, ["day"]), ["day"], "o_orderkey")


@query("text_truncate", "FN06", """
    SELECT doc_id, CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '...' ELSE text END AS short FROM documents""")
def _(t):
    return t.documents.select("doc_id", X.truncate(F.col("text"), 200, "...").alias("short"))


@query("matching_keys", "FN03 FN07", """
    SELECT p_partkey, trim(regexp_replace(regexp_replace(lower(p_name || '__' || p_brand), '[^a-z0-9_]', '', 'g'), '_+', '_', 'g'), '_') AS key
    FROM part""")
def _(t):
    return t.part.select("p_partkey", X.matching_key(F.concat_ws("__", "p_name", "p_brand")).alias("key"))


# --- row order ---------------------------------------------------------------

@query("row_numbers", "WIN13 SNK01", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS row_number FROM orders")
def _(t):
    return O.assign_positions(t.orders.select("o_orderkey", "o_orderdate"), ["o_orderdate", "o_orderkey"]).select(
        "o_orderkey", "row_number")


@query("dense_positions", "WIN13", f"""
    SELECT event_id, row_number() OVER (ORDER BY event_id) AS row_number FROM ({EVENTS_NULL}) WHERE v IS NOT NULL""")
def _(t):
    return O.dense_positions(events_null(t).filter("v IS NOT NULL"), "event_id", chunk=1000).select("event_id", "row_number")


@query("preview_outliers", "WIN12", """
    WITH s AS (SELECT event_type, avg(value) AS m, stddev_pop(value) AS sd, count(value) AS n FROM events GROUP BY 1)
    SELECT event_id, n >= 3 AND abs(value - m) > 3 * sd AS is_outlier FROM events JOIN s USING (event_type)""")
def _(t):
    return O.preview_outliers(t.events, "value", ["event_type"]).select("event_id", "is_outlier")


@query("preview_outliers_all", "WIN12", """
    WITH s AS (SELECT avg(value) AS m, stddev_pop(value) AS sd FROM events)
    SELECT event_id, abs(value - m) > 3 * sd AS is_outlier FROM events, s""")
def _(t):
    return O.preview_outliers(t.events, "value").select("event_id", "is_outlier")


@query("share_of_total", "WIN01", """
    SELECT source AS value, count(*) AS count, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS percentage
    FROM documents GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50""")
def _(t):
    return rounded(P.frequency_table(t.documents, "source", 50), 6, "percentage")


@query("cleaning_ops", "CLN18", f"""
    WITH d AS (SELECT event_id, user_id, event_type, v, kind FROM (
        SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS rn FROM ({EVENTS_NULL})) WHERE rn = 1)
    SELECT event_id, user_id, upper(event_type) AS event_type, coalesce(v, 0) AS v FROM d WHERE kind IS NOT NULL""")
def _(t):
    from gridmill.plans.presets import apply_operations
    ops = [
        {"operation": "remove_duplicates", "params": {"subset": ["user_id", "event_type"], "row_number": "event_id"}},
        {"operation": "handle_missing_values", "params": {"strategy": "drop", "columns": ["kind"]}},
        {"operation": "handle_missing_values", "params": {"strategy": "fill_value", "columns": ["v"], "value": 0.0}},
        {"operation": "standardize_case", "params": {"columns": ["event_type"], "case": "upper"}},
    ]
    return apply_operations(events_null(t), ops).select("event_id", "user_id", "event_type", "v")
