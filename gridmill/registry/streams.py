"""Streaming jobs over the event file, run to the end of the input and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridmill.registry.base import query
from gridmill.registry.files import PAYLOAD_ROWS
from gridmill.registry.relations import FAILURES, STREAK_SQL
from gridmill.session import scratch_path, written
from gridmill.streaming import jobs as J, keyed as K


def _events(t, table="events"):
    # a path with a pattern may be one file or a folder of files
    return J.read_stream(t.spark, f"{t.folder}/{table}[.]parquet", getattr(t, table).schema)


def _paths(t, label):
    root = scratch_path(t.spark, label)
    return f"{root}/out", f"{root}/checkpoint"


@query("stream_landing", "STR01 SRC07", PAYLOAD_ROWS)
def _(t):
    from gridmill.registry.files import _payloads
    from gridmill.sources.payloads import payload_fields

    class Streamed:
        events = _events(t)
    out, checkpoint = _paths(t, "landing")
    J.run_available(J.land_payloads(_payloads(Streamed), "payload", ["event_id"], f"{out}/rows", f"{out}/rejects", checkpoint))
    return payload_fields(t.spark.read.parquet(f"{out}/rows").drop("batch"), {"k": "bigint"})


@query("stream_tumbling", "STR02 STR03 AGG06", """
    SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:00') AS label, event_type, count(*) AS n, round(sum(value), 2) AS total
    FROM events GROUP BY 1, 2""")
def _(t):
    out, checkpoint = _paths(t, "tumbling")
    metrics = {"n": F.count(F.lit(1)), "total": F.sum("value")}
    windows = J.tumbling(_events(t), "ts", "1 hour", "2 hours", metrics, ["event_type"])
    J.run_available(J.write_updates(windows, out, checkpoint))
    done = J.latest_updates(t.spark, out, ["window_start", "event_type"])
    return done.select(F.date_format("window_start", "yyyy-MM-dd HH:00").alias("label"), "event_type", "n",
                       F.round("total", 2).alias("total"))


@query("stream_monthly", "STR02 AGG09", """
    SELECT strftime(date_trunc('month', o_orderdate), '%Y-%m') AS label, round(sum(o_totalprice), 2) AS value FROM orders GROUP BY 1""")
def _(t):
    from gridmill.operators.aggregates import by_time
    out, checkpoint = _paths(t, "monthly")
    months = by_time(_events(t, "orders"), "o_orderdate", "month", {"column": "o_totalprice", "aggregation": "sum"})
    J.run_available(J.write_updates(months, out, checkpoint))
    return J.latest_updates(t.spark, out, ["label"]).select("label", F.round("value", 2).alias("value"))


@query("stream_dedup", "STR06", "SELECT DISTINCT user_id, event_type FROM events")
def _(t):
    out, checkpoint = _paths(t, "dedup")
    J.run_available(J.append(J.dedup(_events(t), ["user_id", "event_type"], "ts", "60 days"), out, checkpoint))
    return t.spark.read.parquet(out).select("user_id", "event_type")


@query("stream_rate", "STR04", """
    WITH c AS (SELECT event_id, user_id, epoch_us(ts) AS t FROM events)
    SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY t RANGE BETWEEN 43199999999 PRECEDING AND 1 PRECEDING) AS current_count FROM c""")
def _(t):
    out, checkpoint = _paths(t, "rate")
    timed = _events(t).select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    J.run_available(J.rates(timed, "user_id", "t", 43200, 3, out, checkpoint))
    return t.spark.read.parquet(f"{out}/rows").select("event_id", "current_count")


@query("stream_streak", "STR05", f"SELECT event_id, failure_count, failure_count >= 20 AS auto_disable FROM ({STREAK_SQL})")
def _(t):
    out, checkpoint = _paths(t, "streak")
    failed = F.col("event_type").isin(FAILURES)
    J.run_available(J.streaks(_events(t).select("event_id", "user_id", "event_type"), "user_id", "event_id", failed, out, checkpoint))
    return t.spark.read.parquet(f"{out}/rows").select("event_id", "failure_count", "auto_disable")


@query("stream_enrich", "STR07 JOI03", """
    SELECT o_orderkey, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 0""")
def _(t):
    out, checkpoint = _paths(t, "enrich")
    table = t.customer.filter("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    joined = J.enrich(_events(t, "orders"), table, "o_custkey", "inner").select("o_orderkey", "c_mktsegment")
    J.run_available(J.append(joined, out, checkpoint))
    return t.spark.read.parquet(out)


@query("stream_check", "STR07 JOI01", "SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def _(t):
    out, checkpoint = _paths(t, "check")
    known = J.enrich(_events(t, "documents").select("doc_id"), t.labels.select("doc_id").distinct(), "doc_id", "left_semi")
    J.run_available(J.append(known, out, checkpoint))
    return t.spark.read.parquet(out)


# The events as a log of eight files: five days a file, every seventh event one file late, every fiftieth three.
LOG_FILES, DELAY = 8, "2 days"
LOG = """
    a AS (SELECT event_id, user_id, event_type, epoch_us(ts) AS t,
                 least(date_diff('day', DATE '2024-01-01', ts::DATE) // 5
                       + CASE WHEN event_id % 50 = 0 THEN 3 WHEN event_id % 7 = 0 THEN 1 ELSE 0 END, 7) AS b FROM events),
    h AS (SELECT b, max(max(t)) OVER (ORDER BY b) AS high FROM a GROUP BY b),
    told AS (SELECT a.*, coalesce(t <= ((SELECT max(high) FROM h WHERE h.b <= a.b - 2) // 1000 - 172800000) * 1000, FALSE) AS late FROM a),
    kept AS (SELECT * FROM told WHERE NOT late),
    passed AS (SELECT (max(t) // 1000 - 172800000) * 1000 AS m FROM a)"""


def _log(t):
    """The events as files in the order of arrival, one file a batch."""
    path = scratch_path(t.spark, "log")
    delay = F.when(F.col("event_id") % 50 == 0, 3).when(F.col("event_id") % 7 == 0, 1).otherwise(0)
    home = F.floor(F.datediff("ts", F.lit("2024-01-01")) / 5)
    # parted by tasks in one pass; then only a batch's own rows go through the task that writes its file
    staged = written(t.events.withColumn("_b", F.least(home + delay, F.lit(LOG_FILES - 1)).cast("int")), "parted", "_b")
    for n in range(LOG_FILES):
        staged.filter(F.col("_b") == n).drop("_b").coalesce(1).write.mode("append").parquet(path)
    return J.read_stream(t.spark, path, t.events.schema, files_per_batch=1)


@query("stream_rate_unordered", "STR04 STR03", f"""
    WITH {LOG},
    c AS (SELECT *, count(*) OVER (PARTITION BY user_id ORDER BY t RANGE BETWEEN 43199999999 PRECEDING AND 1 PRECEDING) AS n FROM kept)
    SELECT event_id, n AS current_count, n < 3 AS is_allowed, CAST(greatest(0, 3 - n - 1) AS BIGINT) AS remaining FROM c, passed WHERE t <= m""")
def _(t):
    out, checkpoint = _paths(t, "rate")
    J.run_available(K.keyed_rates(_log(t), "user_id", "ts", 43_200, 3, DELAY, ["event_id"], out, checkpoint))
    return t.spark.read.parquet(out).drop("user_id")


@query("stream_streak_unordered", "STR05 STR03", f"""
    WITH {LOG},
    f AS (SELECT *, event_type IN ({", ".join(f"'{k}'" for k in FAILURES)}) AS failed FROM kept),
    g AS (SELECT *, count(*) FILTER (NOT failed) OVER (PARTITION BY user_id ORDER BY t, event_id) AS g FROM f),
    s AS (SELECT *, count(*) FILTER (failed) OVER (PARTITION BY user_id, g ORDER BY t, event_id) AS n FROM g)
    SELECT event_id, n AS failure_count, n >= 20 AS auto_disable FROM s, passed WHERE t <= m""")
def _(t):
    out, checkpoint = _paths(t, "streak")
    failed = F.col("event_type").isin(FAILURES)
    J.run_available(K.keyed_streaks(_log(t), "user_id", "ts", "event_id", failed, DELAY, out, checkpoint))
    return t.spark.read.parquet(out).drop("user_id")


@query("stream_late_rows", "STR03", f"WITH {LOG} SELECT event_id, b AS batch, late FROM told")
def _(t):
    out, checkpoint = _paths(t, "late")
    J.run_available(K.late_rows(_log(t), "ts", 172_800, out, checkpoint))
    parts = [t.spark.read.parquet(f"{out}/{name}").select("event_id", F.col("batch").cast("bigint").alias("batch"), F.lit(late).alias("late"))
             for name, late in (("on_time", False), ("late", True))]
    return parts[0].union(parts[1])
