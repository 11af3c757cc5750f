"""Joins, delivery logs, usage, quotas, tenants."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridmill.functions import delivery as D, filemeta as FM, signing as G
from gridmill.operators import ordered as O, relations as R
from gridmill.registry.base import DELIVERY, delivery_log, query, rounded


@query("usage_vs_limit", "JOI02", """
    WITH u AS (SELECT c.c_nationkey AS org, CAST(count(DISTINCT c_custkey) AS DOUBLE) AS users, CAST(count(o_orderkey) AS DOUBLE) AS datasets,
                      round(coalesce(sum(o_totalprice), 0) / 1e6, 4) AS storage, CAST(max(c_custkey) AS DOUBLE) AS calls
               FROM customer c LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1)
    SELECT CAST(org AS VARCHAR) AS organization_id, unnest(['users', 'datasets', 'storage_gb', 'api_calls']) AS metric,
           unnest([users, datasets, storage, calls]) AS current,
           unnest([CAST(10 + n_regionkey AS DOUBLE), 100.0 * (1 + n_regionkey), 50.0, 1000.0]) AS "limit"
    FROM u JOIN nation ON n_nationkey = org""")
def _(t):
    usage = t.customer.join(t.orders, F.col("o_custkey") == F.col("c_custkey"), "left").groupBy("c_nationkey").agg(
        F.countDistinct("c_custkey").alias("usage_users"), F.count("o_orderkey").alias("usage_datasets"),
        F.round(F.coalesce(F.sum("o_totalprice"), F.lit(0.0)) / 1e6, 4).alias("usage_storage_gb"),
        F.max("c_custkey").alias("usage_api_calls"))
    subs = usage.withColumns({"organization_id": F.col("c_nationkey").cast("string"),
                              "plan_id": F.col("c_nationkey").cast("string")})
    plans = t.nation.select(F.col("n_nationkey").alias("id"), (F.col("n_regionkey") + 10).alias("max_users"),
                            ((F.col("n_regionkey") + 1) * 100).alias("max_datasets"), F.lit(50).alias("max_storage_gb"),
                            F.lit(1000).alias("max_api_calls"))
    return R.usage_against_limits(subs, plans)


CONFIG = "SELECT DISTINCT user_id AS webhook_id, user_id % 4 <> 0 AS is_active, 3 AS max_attempts FROM events"


def _config(t):
    return t.events.select(F.col("user_id").alias("webhook_id"), (F.col("user_id") % 4 != 0).alias("is_active"),
                           F.lit(3).alias("max_attempts")).distinct()


@query("retry_candidates", "JOI03", f"""
    SELECT event_id, webhook_id, attempt FROM ({DELIVERY}) JOIN ({CONFIG}) USING (webhook_id)
    WHERE is_active AND attempt < max_attempts AND (response_status IS NULL OR response_status NOT BETWEEN 200 AND 299)
      AND created_at >= TIMESTAMP '2024-01-30' - INTERVAL 480 HOURS""")
def _(t):
    out = R.retry_candidates(delivery_log(t), _config(t), F.lit("2024-01-30").cast("timestamp_ntz"), 480)
    return out.select("event_id", "webhook_id", "attempt")


@query("latest_failed", "WIN09 FN20 FN21", f"""
    WITH f AS (SELECT *, row_number() OVER (PARTITION BY webhook_id, event_type ORDER BY created_at DESC, event_id DESC) AS rn
               FROM ({DELIVERY}) WHERE response_status IS NULL OR response_status NOT BETWEEN 200 AND 299)
    SELECT event_id, webhook_id, event_type, attempt, coalesce(response_status <> 404, TRUE) AS retry,
           CAST(least(60 * pow(2, attempt - 1), 3600) AS BIGINT) AS delay_seconds
    FROM f JOIN ({CONFIG}) USING (webhook_id) WHERE rn = 1 AND is_active AND attempt < max_attempts""")
def _(t):
    return R.latest_failed(delivery_log(t), _config(t)).select(
        "event_id", "webhook_id", "event_type", "attempt", "retry", "delay_seconds")


@query("delivery_status", "FN20", f"""
    SELECT event_id, CASE response_status WHEN 200 THEN 'success' WHEN 404 THEN 'client_error' WHEN 500 THEN 'server_error' ELSE 'network_error' END AS category,
           coalesce(response_status = 500, TRUE) AS retry FROM ({DELIVERY})""")
def _(t):
    s = F.col("response_status")
    return delivery_log(t).select("event_id", D.status_category(s).alias("category"), D.should_retry(s).alias("retry"))


@query("retry_delays", "FN21", """
    SELECT event_id, CAST(least(60 * pow(2, event_id % 10), 3600) AS BIGINT) AS exponential,
           least(60 * (event_id % 10 + 1), 3600) AS linear, CAST(60 AS BIGINT) AS constant FROM events""")
def _(t):
    attempt = F.col("event_id") % 10 + 1
    return t.events.select("event_id", *[D.retry_delay(attempt, s).alias(s) for s in ("exponential", "linear", "constant")])


@query("body_limit", "FN06", """
    SELECT page_id, CASE WHEN length(html) > 10000 THEN substr(html, 1, 10000) || '... (truncated)' ELSE html END AS body FROM pages""")
def _(t):
    return t.pages.select("page_id", D.short_body(F.col("html")).alias("body"))


@query("subscribed_events", "FN23", """
    SELECT event_id, list_contains(CASE WHEN user_id % 2 = 0 THEN ['view', 'error'] ELSE ['click', 'purchase'] END, event_type) AS subscribed FROM events""")
def _(t):
    wanted = F.when(F.col("user_id") % 2 == 0, F.array(F.lit("view"), F.lit("error"))).otherwise(
        F.array(F.lit("click"), F.lit("purchase")))
    return t.events.select("event_id", D.subscribed(wanted, F.col("event_type")).alias("subscribed"))


STREAK = """
    SELECT event_id, CAST(sum(f) OVER (PARTITION BY user_id, g ORDER BY event_id) AS BIGINT) AS failure_count
    FROM (SELECT *, sum(1 - f) OVER (PARTITION BY user_id ORDER BY event_id) AS g
          FROM (SELECT event_id, user_id, CASE WHEN event_type IN ({kinds}) THEN 1 ELSE 0 END AS f FROM events))"""
FAILURES = ["error", "signup", "purchase", "click"]
STREAK_SQL = STREAK.format(kinds=", ".join(f"'{k}'" for k in FAILURES))


@query("failure_streak", "WIN10", f"SELECT event_id, failure_count, failure_count < 10 AS is_healthy, failure_count >= 20 AS auto_disable FROM ({STREAK_SQL})")
def _(t):
    failed = F.col("event_type").isin(FAILURES)
    return O.failure_streak(t.events, "user_id", "event_id", failed, chunk=2000).select(
        "event_id", "failure_count", "is_healthy", "auto_disable")


@query("rate_window", "WIN11", """
    WITH c AS (SELECT event_id, user_id, epoch_us(ts) AS t FROM events),
    w AS (SELECT event_id, t, count(*) OVER (PARTITION BY user_id ORDER BY t RANGE BETWEEN 43199999999 PRECEDING AND 1 PRECEDING) AS n FROM c)
    SELECT event_id, n AS current_count, n < 3 AS is_allowed, CAST(greatest(0, 3 - n - 1) AS BIGINT) AS remaining,
           CAST(floor((t + 43200000000) / 1000000) AS BIGINT) AS reset_time FROM w""")
def _(t):
    timed = t.events.withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")))
    return O.rate_window(timed, "user_id", "t", 43200, 3, chunk=2000).select(
        "event_id", "current_count", "is_allowed", "remaining", "reset_time")


@query("lookups", "JOI04", """
    SELECT o_orderkey, c_name AS customer, c_mktsegment AS segment, n_name AS nation
    FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey""")
def _(t):
    out = R.lookup(t.orders, t.customer, "o_custkey", "c_custkey",
                   {"c_name": "customer", "c_mktsegment": "segment", "c_nationkey": "nk"})
    return R.lookup(out, t.nation, "nk", "n_nationkey", {"n_name": "nation"}).select(
        "o_orderkey", "customer", "segment", "nation")


LINKS = "SELECT DISTINCT l_suppkey AS s_suppkey, l_partkey AS p_partkey FROM lineitem"


def _links(t):
    return t.lineitem.select(F.col("l_suppkey").alias("s_suppkey"), F.col("l_partkey").alias("p_partkey")).distinct()


@query("bridge", "JOI06", f"""
    SELECT s_name, p_name, p_partkey, count(*) OVER (PARTITION BY s_suppkey) AS item_count
    FROM supplier JOIN ({LINKS}) USING (s_suppkey) JOIN part USING (p_partkey)""")
def _(t):
    return R.bridge(t.supplier, _links(t), t.part, "s_suppkey", "p_partkey").select(
        "s_name", "p_name", "p_partkey", "item_count")


@query("bridge_pages", "JOI06", f"""
    SELECT s_suppkey, p_partkey // 100 AS page, array_to_string(list_sort(list(p_brand)), ',') AS brands
    FROM ({LINKS}) JOIN part USING (p_partkey) GROUP BY 1, 2""")
def _(t):
    out = R.bridge_pages(_links(t), t.part, "s_suppkey", "p_partkey", ["p_brand"], page_size=100)
    return out.select("s_suppkey", "page", F.array_join(F.transform("items", lambda x: x["p_brand"]), ",").alias("brands"))


@query("seen_hashes", "JOI07 FN19", """
    SELECT doc_id, sha256(text) IN (SELECT sha256(text) FROM documents WHERE source = (SELECT min(source) FROM documents)) AS seen FROM documents""")
def _(t):
    docs = t.documents.select("doc_id", "source", G.digest(F.col("text")).alias("hash"))
    first = docs.agg(F.min("source").alias("s")).scalar()
    known = docs.filter(F.col("source") == first)
    old = R.seen(docs, known, ["hash"]).select("doc_id", F.lit(True).alias("seen"))
    return old.unionByName(R.seen(docs, known, ["hash"], new=True).select("doc_id", F.lit(False).alias("seen")))


@query("activity_feed", "SET01", """
    SELECT kind, id, amount, strftime(moment, '%Y-%m-%d %H:%M:%S') AS moment FROM (
        SELECT 'order' AS kind, o_orderkey AS id, o_totalprice AS amount, o_orderdate AS moment FROM orders
        UNION ALL SELECT 'event', event_id, NULL, ts - INTERVAL 900 DAYS FROM events) f
    ORDER BY f.moment DESC, id LIMIT 200""")
def _(t):
    orders = t.orders.select(F.lit("order").alias("kind"), F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("amount"),
                             F.col("o_orderdate").alias("moment"))
    events = t.events.select(F.lit("event").alias("kind"), F.col("event_id").alias("id"),
                             (F.col("ts") - F.expr("INTERVAL 900 DAYS")).alias("moment"))
    return R.activity_feed([orders, events], "moment", "id", 200).withColumn("moment", F.date_format("moment", "yyyy-MM-dd HH:mm:ss"))


@query("quota_check", "SRC12", """
    SELECT file_id, total_bytes, total_bytes <= 3000000 AS within_quota FROM (
        SELECT o_orderkey AS file_id, CAST(sum(CAST(floor(o_totalprice) AS BIGINT)) OVER (
            PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS BIGINT) AS total_bytes FROM orders)""")
def _(t):
    files = t.orders.select(F.col("o_custkey").alias("organization_id"), F.col("o_orderkey").alias("file_id"),
                            F.floor("o_totalprice").alias("size"), F.col("o_orderdate").alias("created_at"))
    limits = files.select("organization_id").distinct().withColumn("limit_bytes", F.lit(3000000))
    return R.quota_check(files, limits, chunk=2000).select("file_id", "total_bytes", "within_quota")


@query("tenant_stats", "AGG35", """
    WITH u AS (SELECT c_nationkey AS k, count(*) AS total_users, count(*) FILTER (c_acctbal > 0) AS active_users FROM customer GROUP BY 1),
    d AS (SELECT s_nationkey AS k, count(*) AS total_datasets, round(sum(s_acctbal * 1e6) / 1073741824, 6) AS total_storage_gb FROM supplier GROUP BY 1),
    e AS (SELECT c_nationkey AS k, count(*) AS total_queries, count(*) FILTER (date_trunc('month', o_orderdate) = DATE '1997-03-01') AS queries_this_month
          FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1)
    SELECT n_nationkey AS organization_id, coalesce(total_users, 0) AS total_users, coalesce(active_users, 0) AS active_users,
           coalesce(total_datasets, 0) AS total_datasets, coalesce(total_storage_gb, 0) AS total_storage_gb,
           coalesce(total_queries, 0) AS total_queries, coalesce(queries_this_month, 0) AS queries_this_month
    FROM nation LEFT JOIN u ON u.k = n_nationkey LEFT JOIN d ON d.k = n_nationkey LEFT JOIN e ON e.k = n_nationkey""")
def _(t):
    org = "organization_id"
    users = t.customer.select(F.col("c_nationkey").alias(org), (F.col("c_acctbal") > 0).alias("is_active"))
    data = t.supplier.select(F.col("s_nationkey").alias(org), (F.col("s_acctbal") * 1e6).alias("size"))
    events = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("c_nationkey").alias(org), F.col("o_orderdate").alias("created_at"))
    tenants = t.nation.select(F.col("n_nationkey").alias(org))
    out = R.tenant_stats(tenants, users, data, data, events, F.lit("1997-03-01").cast("timestamp_ntz"))
    return rounded(out, 6, "total_storage_gb")


# --- digests, signatures, file names -----------------------------------------

@query("digests", "FN19", "SELECT doc_id, sha256(text) AS hash FROM documents")
def _(t):
    return t.documents.select("doc_id", G.digest(F.col("text")).alias("hash"))


def _pad(secret: str, mask: int) -> str:
    """The padded HMAC key as a blob literal."""
    return "'" + "".join(f"\\x{b ^ mask:02X}" for b in secret.encode().ljust(64, b"\0")) + "'::BLOB"


@query("hmac_sign", "SRC08 FN19", f"""
    SELECT event_id, sha256({_pad('secret', 0x5C)} || unhex(sha256({_pad('secret', 0x36)} || encode(props)))) AS signature FROM events""")
def _(t):
    return t.events.select("event_id", G.sign(F.col("props"), "secret").alias("signature"))


@query("hmac_check", "SRC08 FN19", "SELECT event_id, event_id % 10 <> 0 AS valid FROM events")
def _(t):
    signed = t.events.select("event_id", "props", G.sign(F.col("props"), "secret").alias("signature"))
    tampered = F.when(F.col("event_id") % 10 == 0, F.concat("props", F.lit(" "))).otherwise(F.col("props"))
    return signed.select("event_id", G.verified(tampered, F.col("signature"), "secret").alias("valid"))


def _masked(mask):
    return f"""list_aggregate([chr(xor(CASE WHEN i <= length(k) THEN ascii(substr(k, i, 1)) ELSE 0 END, {mask})::INT) FOR i IN range(1, 65)], 'string_agg', '')"""


@query("hmac_per_row", "SRC08 FN19", f"""
    WITH s AS (SELECT event_id, props, 'key-' || user_id AS k FROM events)
    SELECT event_id, sha256(encode({_masked(92)}) || unhex(sha256(encode({_masked(54)} || props)))) AS signature FROM s""")
def _(t):
    secret = F.concat(F.lit("key-"), F.col("user_id").cast("string"))
    return t.events.select("event_id", G.sign_each("props", secret).alias("signature"))


NAMED = """SELECT page_id, length(html) * 20000 AS size, 'upload_' || page_id || CASE page_id % 6 WHEN 0 THEN '.csv' WHEN 1 THEN '.XLSX'
           WHEN 2 THEN '.json' WHEN 3 THEN '.png' WHEN 4 THEN '' ELSE '.txt' END AS name FROM pages"""


def _named(t):
    k = F.col("page_id") % 6
    ext = F.when(k == 0, ".csv").when(k == 1, ".XLSX").when(k == 2, ".json").when(k == 3, ".png").when(k == 4, "").otherwise(".txt")
    return t.pages.select("page_id", (F.length("html").cast("long") * 20000).alias("size"),
                          F.concat(F.lit("upload_"), F.col("page_id").cast("string"), ext).alias("name"))


@query("file_names", "SRC10 FN22", f"""
    SELECT page_id, lower(regexp_extract(name, '\\.([^./]*)$', 1)) AS extension,
           CASE lower(regexp_extract(name, '\\.([^./]*)$', 1)) WHEN 'csv' THEN 'csv' WHEN 'txt' THEN 'csv' WHEN 'xlsx' THEN 'excel'
                WHEN 'json' THEN 'json' ELSE 'other' END AS category,
           round(size / CAST(1024 AS DOUBLE), 2) AS size_kb, round(size / CAST(1048576 AS DOUBLE), 2) AS size_mb FROM ({NAMED})""")
def _(t):
    from gridmill.sources.files import with_metadata
    return with_metadata(_named(t)).select("page_id", "extension", "category", "size_kb", "size_mb")


@query("file_admission", "SRC11", f"""
    SELECT page_id, CASE WHEN name NOT LIKE '%.csv' AND name NOT LIKE '%.XLSX' AND name NOT LIKE '%.png' THEN 'type not allowed'
                         WHEN size > 104857600 THEN 'too large' END AS reason FROM ({NAMED})""")
def _(t):
    reason = FM.admission_reason(F.col("name"), F.col("size"), FM.ALLOWED_TYPES + ["image/*"])
    return _named(t).select("page_id", reason.alias("reason"))
