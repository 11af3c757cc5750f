"""Filters, searches, record queries, sorting."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridmill.operators import predicates as P, records as R
from gridmill.registry.base import DELIVERY, EVENTS_NULL, delivery_log, events_null, query

ORDER_COLUMNS = ["o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]


def _one(name, covers, table, columns, spec, where):
    @query(name, covers, f"SELECT {', '.join(columns)} FROM {table} WHERE {where}")
    def build(t):
        df = getattr(t, table)
        return P.apply_filters(df, [spec]).select(*columns)


_one("fil_eq", "FIL01", "orders", ORDER_COLUMNS, {"column": "o_orderstatus", "operator": "eq", "value": "F"},
     "o_orderstatus = 'F'")
_one("fil_eq_number", "FIL01", "part", ["p_partkey", "p_size"], {"column": "p_size", "operator": "eq", "value": "11"},
     "CAST(p_size AS VARCHAR) = '11'")
_one("fil_ne", "FIL02", "orders", ORDER_COLUMNS, {"column": "o_orderstatus", "operator": "ne", "value": "F"},
     "o_orderstatus <> 'F'")
_one("fil_gt", "FIL03", "orders", ORDER_COLUMNS, {"column": "o_totalprice", "operator": "gt", "value": 250000},
     "o_totalprice > 250000")
_one("fil_gte", "FIL04", "lineitem", ["l_orderkey", "l_partkey", "l_quantity"],
     {"column": "l_quantity", "operator": "gte", "value": "45"}, "l_quantity >= 45")
_one("fil_lt", "FIL05", "lineitem", ["l_orderkey", "l_partkey", "l_discount"],
     {"column": "l_discount", "operator": "lt", "value": 0.03}, "l_discount < CAST(0.03 AS DOUBLE)")
_one("fil_lte", "FIL06", "customer", ["c_custkey", "c_acctbal"],
     {"column": "c_acctbal", "operator": "lte", "value": 0}, "c_acctbal <= 0")
_one("fil_contains", "FIL07 FN05", "customer", ["c_custkey", "c_mktsegment"],
     {"column": "c_mktsegment", "operator": "contains", "value": "chin"}, "c_mktsegment ILIKE '%chin%'")
_one("fil_literal_wildcard", "FIL07", "pages", ["page_id", "url"],
     {"column": "html", "operator": "contains", "value": "%%%"}, "contains(html, '%%%')")
_one("fil_starts_with", "FIL08 FN05", "part", ["p_partkey", "p_name"],
     {"column": "p_name", "operator": "starts_with", "value": "RED"}, "p_name ILIKE 'red%'")
_one("fil_ends_with", "FIL09 FN05", "part", ["p_partkey", "p_name"],
     {"column": "p_name", "operator": "ends_with", "value": "Widget"}, "p_name ILIKE '%widget'")
_one("fil_in", "FIL10", "orders", ORDER_COLUMNS,
     {"column": "o_orderpriority", "operator": "in", "value": ["1-URGENT", "5-LOW"]},
     "o_orderpriority IN ('1-URGENT', '5-LOW')")
_one("fil_not_in", "FIL11", "orders", ORDER_COLUMNS,
     {"column": "o_orderpriority", "operator": "not_in", "value": ["1-URGENT", "5-LOW"]},
     "o_orderpriority NOT IN ('1-URGENT', '5-LOW')")


@query("fil_is_null", "FIL12", f"SELECT event_id FROM ({EVENTS_NULL}) WHERE v IS NULL")
def _(t):
    return P.apply_filters(events_null(t), [{"column": "v", "operator": "is_null"}]).select("event_id")


@query("fil_is_not_null", "FIL13", f"SELECT event_id, v, kind FROM ({EVENTS_NULL}) WHERE v IS NOT NULL AND kind IS NOT NULL")
def _(t):
    specs = [{"column": "v", "operator": "is_not_null"}, {"column": "kind", "operator": "is_not_null"}]
    return P.apply_filters(events_null(t), specs).select("event_id", "v", "kind")


@query("fil_and", "FIL14 FIL15", """
    SELECT l_orderkey, l_linenumber, l_quantity, l_returnflag FROM lineitem
    WHERE l_returnflag = 'R' AND l_quantity >= 10 AND l_discount < CAST(0.05 AS DOUBLE)
      AND l_linestatus IN ('O', 'F') AND l_linenumber <> 3""")
def _(t):
    specs = [
        {"column": "l_returnflag", "operator": "eq", "value": "R"},
        {"column": "l_quantity", "operator": "gte", "value": 10},
        {"column": "l_discount", "operator": "lt", "value": 0.05},
        {"column": "l_linestatus", "operator": "in", "value": ["O", "F"]},
        {"column": "l_linenumber", "operator": "ne", "value": 3},
    ]
    P.validate_filters(t.lineitem, specs, P.AGGREGATE_OPERATORS)
    return P.apply_filters(t.lineitem, specs, P.AGGREGATE_OPERATORS).select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_returnflag")


@query("search_all", "FIL17", """
    SELECT c_custkey, c_name, c_mktsegment FROM customer
    WHERE CAST(c_custkey AS VARCHAR) ILIKE '%77%' OR c_name ILIKE '%77%' OR c_mktsegment ILIKE '%77%'""")
def _(t):
    df = t.customer.select("c_custkey", "c_name", "c_mktsegment")
    return R.filter_records(df, search="77")


@query("search_document", "FIL17 FN17", """
    SELECT c_custkey, c_name, c_mktsegment FROM customer
    WHERE CAST(to_json({'c_custkey': c_custkey, 'c_name': c_name, 'c_mktsegment': c_mktsegment}) AS VARCHAR)
          ILIKE '%segment":"build%'""")
def _(t):
    df = t.customer.select("c_custkey", "c_name", "c_mktsegment")
    return R.filter_records(df, search='segment":"build', whole_document=True)


@query("search_or", "FIL18", "SELECT p_partkey, p_name, p_brand FROM part WHERE p_name ILIKE '%ring%' OR p_brand ILIKE '%ring%'")
def _(t):
    return P.catalog_rows(t.part, search="ring", search_columns=["p_name", "p_brand"]).select(
        "p_partkey", "p_name", "p_brand")


@query("catalog_range", "FIL19", """
    SELECT o_orderkey, o_orderstatus, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders
    WHERE o_orderstatus = 'O' AND o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate <= TIMESTAMP '1997-06-30'""")
def _(t):
    rows = P.catalog_rows(t.orders, {"o_orderstatus": "O"}, "o_orderdate", "1996-01-01", "1997-06-30")
    return rows.select("o_orderkey", "o_orderstatus", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))


@query("tenant_rows", "FIL20", "SELECT c_custkey, c_name FROM customer WHERE c_nationkey = 7")
def _(t):
    return P.tenant_rows(t.customer, 7, "c_nationkey").select("c_custkey", "c_name")


@query("soft_delete", "FIL21", """
    SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'deleted' ELSE 'live' END AS state FROM customer""")
def _(t):
    marked = P.mark_deleted(t.customer, F.col("c_acctbal") < 0, at=F.to_timestamp(F.lit("2024-01-01")))
    live = P.live_rows(marked).select("c_custkey", F.lit("live").alias("state"))
    gone = marked.filter(F.col("deleted_at").isNotNull()).select("c_custkey", F.lit("deleted").alias("state"))
    return live.unionByName(gone)


@query("status_success", "FIL22", f"SELECT event_id FROM ({DELIVERY}) WHERE response_status BETWEEN 200 AND 299")
def _(t):
    return P.delivery_status(delivery_log(t), "success").select("event_id")


@query("status_error", "FIL22", f"SELECT event_id FROM ({DELIVERY}) WHERE response_status < 200 OR response_status >= 300")
def _(t):
    return P.delivery_status(delivery_log(t), "error").select("event_id")


# --- records -----------------------------------------------------------------

@query("record_page", "REC01 SRT01 SRT03 SRT06", """
    WITH f AS (SELECT event_id, event_type, value FROM events WHERE value > 20 AND event_type <> 'error')
    SELECT event_id, event_type, value, (SELECT count(*) FROM f) AS total, (SELECT count(*) FROM f) > 150 AS has_more
    FROM f ORDER BY event_type ASC, value DESC, event_id LIMIT 50 OFFSET 100""")
def _(t):
    return R.query_records(
        t.events.select("event_id", "event_type", "value"),
        [{"column": "value", "operator": "gt", "value": 20}, {"column": "event_type", "operator": "ne", "value": "error"}],
        sort=[("event_type", "asc"), ("value", "desc")], skip=100, limit=50, row_number="event_id", totals=True)


@query("record_page_deep", "REC01 SRT03", f"""
    SELECT event_id, v, kind FROM ({EVENTS_NULL}) ORDER BY v DESC NULLS LAST, event_id LIMIT 300 OFFSET (SELECT count(*) // 2 FROM events)""")
def _(t):
    rows = events_null(t).select("event_id", "v", "kind")
    return R.deep_page(rows, [("v", "desc")], "event_id", rows.count() // 2, 300)


@query("record_page_desc", "REC01 SRT01", f"""
    SELECT event_id, v FROM ({EVENTS_NULL}) ORDER BY v DESC NULLS LAST, event_id LIMIT 100""")
def _(t):
    return R.query_records(events_null(t).select("event_id", "v"), sort=[("v", "desc")], row_number="event_id")


@query("record_nulls_last", "SRT01", f"""
    SELECT event_id, kind FROM ({EVENTS_NULL}) ORDER BY kind ASC NULLS LAST, event_id LIMIT 300 OFFSET 600""")
def _(t):
    return R.query_records(events_null(t).select("event_id", "kind"), sort=[("kind", "asc")], skip=600, limit=300,
                           row_number="event_id")


@query("record_default_order", "SRT02 SRT03", "SELECT event_id, value FROM events ORDER BY event_id LIMIT 100 OFFSET 200")
def _(t):
    return R.query_records(t.events.select("event_id", "value"), skip=200, row_number="event_id")


@query("record_after", "SRT03", "SELECT event_id, value FROM events WHERE event_id > 299 ORDER BY event_id LIMIT 100")
def _(t):
    return R.page_after(t.events.select("event_id", "value"), "event_id", 299)


@query("record_total", "REC01", "SELECT count(*) AS total FROM events WHERE value > 20 AND event_type ILIKE '%c%'")
def _(t):
    rows = R.filter_records(t.events, [{"column": "value", "operator": "gt", "value": 20},
                                       {"column": "event_type", "operator": "contains", "value": "c"}])
    return rows.agg(F.count(F.lit(1)).alias("total"))


@query("get_record", "REC02", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey = 321")
def _(t):
    return R.get_record(t.orders, 321, "o_orderkey").select("o_orderkey", "o_custkey", "o_totalprice")


CHECKED = """
    SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'abc' WHEN event_id % 7 = 0 THEN '' ELSE '12.5' END AS amount,
           CASE WHEN event_id % 9 = 0 THEN '2.5' WHEN event_id % 8 = 0 THEN NULL ELSE CAST(user_id AS VARCHAR) END AS who
    FROM events"""
FLAGGED = f"""
    SELECT event_id, amount = '' AS e1, amount = 'abc' AS e2, who IS NULL AS e3, coalesce(who = '2.5', FALSE) AS e4
    FROM ({CHECKED})"""
CHECK_SCHEMA = {"amount": {"type": "float", "required": True}, "who": {"type": "integer", "required": True}}


def _checked(t):
    i = F.col("event_id")
    rows = t.events.select(
        "event_id", F.when(i % 5 == 0, "abc").when(i % 7 == 0, "").otherwise("12.5").alias("amount"),
        F.when(i % 9 == 0, "2.5").when(i % 8 != 0, F.col("user_id").cast("string")).alias("who"))
    return R.revalidate(rows, CHECK_SCHEMA)


@query("revalidate_rows", "REC03 VAL02", f"""
    SELECT event_id, NOT (e1 OR e2 OR e3 OR e4) AS is_valid,
           concat_ws(';', CASE WHEN e1 THEN 'amount:required' END, CASE WHEN e2 THEN 'amount:not float' END,
                     CASE WHEN e3 THEN 'who:required' END, CASE WHEN e4 THEN 'who:not integer' END) AS errors
    FROM ({FLAGGED})""")
def _(t):
    text = F.transform("validation_errors", lambda e: F.concat_ws(":", e["field"], e["error"]))
    return _checked(t).select("event_id", "is_valid", F.array_join(text, ";").alias("errors"))


@query("error_flags", "REC09", f"""
    SELECT event_id, (e1 OR e2 OR e3 OR e4) AS has_errors,
           CAST(e1 AS INT) + CAST(e2 AS INT) + CAST(e3 AS INT) + CAST(e4 AS INT) AS error_count FROM ({FLAGGED})""")
def _(t):
    return R.error_flags(_checked(t)).select("event_id", "has_errors", "error_count")


@query("record_stats", "REC05", f"""
    SELECT count(*) AS total, count(*) FILTER (NOT (e1 OR e2 OR e3 OR e4)) AS valid,
           count(*) FILTER (e1 OR e2 OR e3 OR e4) AS invalid,
           round(100.0 * count(*) FILTER (NOT (e1 OR e2 OR e3 OR e4)) / count(*), 2) AS validation_rate
    FROM ({FLAGGED})""")
def _(t):
    return R.record_stats(_checked(t))


@query("only_valid", "FIL16", f"SELECT event_id FROM ({FLAGGED}) WHERE NOT (e1 OR e2 OR e3 OR e4)")
def _(t):
    return R.filter_records(_checked(t), only_valid=True).select("event_id")


@query("sample_valid", "REC07", f"""
    SELECT event_id FROM ({FLAGGED}) WHERE NOT (e1 OR e2 OR e3 OR e4) ORDER BY event_id LIMIT 10""")
def _(t):
    return R.sample_valid(_checked(t), 10, "event_id").select("event_id")


@query("preview", "REC06 SRT02", "SELECT event_id, user_id, value FROM events ORDER BY event_id LIMIT 100")
def _(t):
    return R.preview(t.events.select("event_id", "user_id", "value"), 100, "event_id")


@query("catalog_page", "REC08 SRT06", """
    SELECT o_orderkey, o_orderstatus, (SELECT count(*) FROM orders) AS total,
           CAST(ceil((SELECT count(*) FROM orders) / 20.0) AS BIGINT) AS total_pages
    FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 20 OFFSET 40""")
def _(t):
    page = R.catalog_page(t.orders, 3, 20, "o_orderdate", "o_orderkey")
    return page.select("o_orderkey", "o_orderstatus", "total", "total_pages")


@query("document_keys", "REC10", "SELECT event_id, array_to_string(list_sort(json_keys(props)), ',') AS keys FROM events")
def _(t):
    return t.events.select("event_id", F.array_join(R.document_keys(F.col("props")), ",").alias("keys"))


@query("json_field", "PRJ01 FN17", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def _(t):
    from gridmill.sources.payloads import payload_fields
    return payload_fields(t.events.select("event_id", "props"), {"k": "bigint"}, "props")


OPS = """
    SELECT event_id AS idx,
           CASE WHEN event_id % 50 = 49 THEN 'merge' WHEN event_id % 3 = 0 THEN 'create'
                WHEN event_id % 3 = 1 THEN 'update' ELSE 'delete' END AS op,
           CASE WHEN event_id % 3 = 0 THEN 100000000 + event_id
                WHEN event_id % 7 = 0 THEN 200000000 + event_id ELSE event_id - event_id % 5 END AS id,
           value * 2 AS value, event_type
    FROM events"""
BULK = f"""
    WITH ops AS ({OPS}), rec AS (SELECT event_id AS id, event_id + 1 AS row_number, value, event_type FROM events),
    gone AS (SELECT id, min(idx) AS at FROM ops WHERE op = 'delete' GROUP BY id),
    judged AS (
        SELECT o.*, CASE WHEN op = 'create' THEN 'created' WHEN op = 'merge' THEN 'unknown operation'
                         WHEN rec.id IS NULL OR idx > gone.at THEN 'not found'
                         WHEN op = 'delete' THEN 'deleted' ELSE 'updated' END AS status
        FROM ops o LEFT JOIN rec ON o.id = rec.id LEFT JOIN gone ON o.id = gone.id),
    last AS (SELECT id, arg_max(value, idx) AS value, arg_max(event_type, idx) AS event_type
             FROM judged WHERE status = 'updated' GROUP BY id)"""


def _bulk(t):
    i, e = F.col("event_id"), t.events
    op = F.when(i % 50 == 49, "merge").when(i % 3 == 0, "create").when(i % 3 == 1, "update").otherwise("delete")
    key = F.when(i % 3 == 0, i + 100000000).when(i % 7 == 0, i + 200000000).otherwise(i - i % 5)
    ops = e.select(i.alias("idx"), op.alias("op"), key.alias("id"), (F.col("value") * 2).alias("value"), "event_type")
    rec = e.select(i.alias("id"), (i + 1).alias("row_number"), "value", "event_type")
    return R.bulk_apply(rec, ops, ["value", "event_type"])


@query("bulk_status", "REC04", f"{BULK} SELECT idx, op, id, status FROM judged")
def _(t):
    return _bulk(t)[1]


@query("bulk_summary", "REC04", f"""{BULK}
    SELECT count(*) AS total, count(*) FILTER (status IN ('created', 'updated', 'deleted')) AS successful,
           count(*) FILTER (status IN ('not found', 'unknown operation')) AS failed FROM judged""")
def _(t):
    return R.bulk_summary(_bulk(t)[1])


@query("bulk_records", "REC04 WIN13", f"""{BULK}
    SELECT rec.id, rec.row_number, coalesce(last.value, rec.value) AS value,
           coalesce(last.event_type, rec.event_type) AS event_type
    FROM rec LEFT JOIN last ON rec.id = last.id
    WHERE rec.id NOT IN (SELECT id FROM judged WHERE status = 'deleted')
    UNION ALL
    SELECT id, (SELECT max(row_number) FROM rec) + row_number() OVER (ORDER BY idx), value, event_type
    FROM ops WHERE op = 'create'""")
def _(t):
    return _bulk(t)[0]
