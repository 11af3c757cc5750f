"""Trends, anomalies, insight rows, chart choice and series."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridmill.operators import charts as C, insights as N, profile as P, stats as S
from gridmill.registry.base import EVENTS_NULL, events_null, query, rounded

METRICS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("trend_month", "INS01", "SELECT 'l_shipdate' AS time_column, unnest(['l_quantity', 'l_extendedprice', 'l_discount', 'l_tax']) AS metric_column, n AS data_points "
       "FROM (SELECT count(DISTINCT date_trunc('month', l_shipdate)) AS n FROM lineitem)")
def _(t):
    return N.trends(t.lineitem, "l_shipdate", METRICS)


@query("trend_series", "INS01 AGG09", """
    SELECT strftime(date_trunc('month', l_shipdate), '%Y-%m') AS month, round(avg(l_quantity), 6) AS l_quantity,
           round(avg(l_discount), 6) AS l_discount FROM lineitem GROUP BY 1""")
def _(t):
    out = N.trend_series(t.lineitem, "l_shipdate", ["l_quantity", "l_discount"])
    return rounded(out.select(F.date_format("bucket", "yyyy-MM").alias("month"), "l_quantity", "l_discount"), 6,
                   "l_quantity", "l_discount")


def _evidence(c):
    return f"""
        SELECT '{c}' AS metric_column, round(s, 4) AS start_value, round(e, 4) AS end_value, round(m, 4) AS average,
               round(sd, 4) AS volatility, n AS data_points, round(e - s, 4) AS change,
               round((e - s) * 100.0 / abs(s), 3) AS change_pct,
               CASE WHEN e > s THEN 'increasing' WHEN e < s THEN 'decreasing' ELSE 'stable' END AS direction
        FROM (SELECT arg_min(v, b) AS s, arg_max(v, b) AS e, avg(v) AS m, stddev_samp(v) AS sd, count(v) AS n
              FROM (SELECT date_trunc('month', o_orderdate) AS b, avg({c}) AS v FROM orders GROUP BY 1))"""


@query("trend_evidence", "INS02", _evidence("o_totalprice") + " UNION ALL " + _evidence("o_custkey"))
def _(t):
    out = N.trend_evidence(t.orders, "o_orderdate", ["o_totalprice", "o_custkey"])
    return rounded(rounded(out, 4, "start_value", "end_value", "average", "volatility", "change"), 3, "change_pct")


CUBED = "SELECT event_id, user_id, value, value * value * value AS x, -value AS y FROM events"


def _cubed(t):
    v = F.col("value")
    return t.events.select("event_id", "user_id", "value", (v * v * v).alias("x"), (-v).alias("y"))


def _iqr(i, c):
    return f"""
        SELECT {i} AS position, '{c}' AS "column", count(*) FILTER ({c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) AS outlier_count,
               count({c}) AS total_records, 'iqr' AS method
        FROM e, (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM e)"""


ANOMALY_COLUMNS = ["event_id", "user_id", "value", "x", "y"]
ANOMALIES = f"WITH e AS ({CUBED}) SELECT * FROM ({' UNION ALL '.join(_iqr(i, c) for i, c in enumerate(ANOMALY_COLUMNS))}) WHERE outlier_count > 0"


@query("anomaly_scan", "INS03", ANOMALIES)
def _(t):
    return N.anomalies(_cubed(t), ANOMALY_COLUMNS)


@query("insights_rule", "INS04 INS05", f"""
    WITH e AS ({CUBED}), a AS (SELECT count(*) AS n, sum(outlier_count)::BIGINT AS total FROM ({ANOMALIES}))
    SELECT 'correlation' AS type, 'value and x move together' AS title, round(least(abs(corr(value, x)), 0.95), 6) AS confidence,
           printf('%.3f', corr(value, x)) AS evidence FROM e
    UNION ALL SELECT 'correlation', 'value and y move together', round(least(abs(corr(value, y)), 0.95), 6), printf('%.3f', corr(value, y)) FROM e
    UNION ALL SELECT 'correlation', 'x and y move together', round(least(abs(corr(x, y)), 0.95), 6), printf('%.3f', corr(x, y)) FROM e
    UNION ALL SELECT 'anomaly', n || ' columns hold outliers', 0.8, CAST(total AS VARCHAR) FROM a WHERE n > 0""")
def _(t):
    out = N.generate_insights(_cubed(t), ANOMALY_COLUMNS)
    evidence = F.coalesce(F.try_element_at("supporting_data", F.lit("correlation")),
                          F.try_element_at("supporting_data", F.lit("outliers")))
    return rounded(out.select("type", "title", "confidence", evidence.alias("evidence")), 6, "confidence")


GAPS = "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN v END AS v, CASE WHEN event_id % 3 = 0 THEN kind END AS kind FROM (" + EVENTS_NULL + ")"


def _gaps(t):
    i = F.col("event_id")
    return events_null(t).select("event_id", F.when(i % 2 == 0, F.col("v")).alias("v"),
                                 F.when(i % 3 == 0, F.col("kind")).alias("kind"))


QUALITY = f"""SELECT 100.0 - (count(*) FILTER (v IS NULL) + count(*) FILTER (kind IS NULL OR kind = '')) * 100.0 / (3 * count(*)) AS q
              FROM ({GAPS})"""


@query("quality_score", "AGG24 INS04", f"SELECT round(q, 6) AS quality_score FROM ({QUALITY})")
def _(t):
    return rounded(P.quality_score(_gaps(t)), 6, "quality_score")


@query("insight_quality", "INS04", f"""
    SELECT 'summary' AS type, 'Low quality score' AS title, CAST(0.9 AS DOUBLE) AS confidence, printf('%.2f', q) AS score
    FROM ({QUALITY}) WHERE q < 80""")
def _(t):
    gaps = _gaps(t)
    out = N.rule_insights(P.quality_score(gaps), S.significant_correlations(gaps, ["event_id", "v"]),
                          N.anomalies(gaps, ["event_id"]))
    return out.filter("type = 'summary'").select(
        "type", "title", "confidence", F.element_at("supporting_data", "quality_score").alias("score"))


FOUND = """SELECT p_type AS type, p_name || ' ' || p_partkey AS title, p_size / CAST(50 AS DOUBLE) AS confidence FROM part"""


def _found(t):
    return t.part.select(F.col("p_type").alias("type"), F.concat_ws(" ", "p_name", F.col("p_partkey").cast("string")).alias("title"),
                         (F.col("p_size") / F.lit(50.0)).alias("confidence"))


@query("insight_list", "FIL23 INS06", f"""
    SELECT title, confidence, CASE WHEN confidence >= 0.75 THEN 'high' WHEN confidence >= 0.5 THEN 'medium' ELSE 'low' END AS level
    FROM ({FOUND}) WHERE type = 'ECONOMY' AND confidence >= 0.3 ORDER BY confidence DESC, title""")
def _(t):
    out = N.list_insights(_found(t), "ECONOMY", 0.3)
    return out.select("title", "confidence", N.confidence_level(F.col("confidence")).alias("level"))


@query("insights_by_type", "INS14", f"""
    SELECT type, count(*) AS total, round(avg(confidence), 6) AS mean_confidence FROM ({FOUND}) GROUP BY 1""")
def _(t):
    return rounded(N.by_type(_found(t)), 6, "mean_confidence")


@query("insights_grouped", "INS14", f"SELECT type, title, count(*) OVER (PARTITION BY type) AS total FROM ({FOUND})")
def _(t):
    return N.grouped_by_type(_found(t)).select("type", "title", "total")


# --- charts ------------------------------------------------------------------

@query("chart_rules", "INS07", """
    WITH n AS (SELECT count(DISTINCT o_orderstatus) AS s FROM orders)
    SELECT * FROM (VALUES ('line', 'o_orderkey along o_orderdate', 'o_orderdate', 'o_orderkey', 'avg', 0.9::DOUBLE, 1),
        ('line', 'o_custkey along o_orderdate', 'o_orderdate', 'o_custkey', 'avg', 0.9, 1),
        ('bar', 'o_orderkey per o_orderstatus', 'o_orderstatus', 'o_orderkey', 'sum', 0.85, 2),
        ('bar', 'o_custkey per o_orderstatus', 'o_orderstatus', 'o_custkey', 'sum', 0.85, 2),
        ('bar', 'o_orderkey per o_orderpriority', 'o_orderpriority', 'o_orderkey', 'sum', 0.85, 2),
        ('bar', 'o_custkey per o_orderpriority', 'o_orderpriority', 'o_custkey', 'sum', 0.85, 2),
        ('scatter', 'o_orderkey against o_custkey', 'o_orderkey', 'o_custkey', NULL, 0.8, 3),
        ('bar', 'How often each o_orderkey', 'o_orderkey', 'count', 'count', 0.75, 4),
        ('pie', 'Shares of o_orderstatus', 'o_orderstatus', NULL, NULL, 0.7, 5),
        ('area', 'Running o_orderkey along o_orderdate', 'o_orderdate', 'o_orderkey', 'sum', 0.75, 6))
        AS v(chart_type, title, x_axis, y_axis, aggregation, confidence, priority), n
    WHERE NOT (chart_type = 'pie' AND NOT s BETWEEN 3 AND 10)""".replace("SELECT * FROM (VALUES", "SELECT v.* FROM (VALUES"))
def _(t):
    return C.suggest_charts(P.profile_contract(t.orders), 10).drop("position")


@query("chart_types", "INS08", """
    WITH c AS (SELECT 'p_partkey' AS c, 'numeric' AS k UNION ALL SELECT 'p_size', 'numeric' UNION ALL SELECT 'p_retailprice', 'numeric'
               UNION ALL SELECT 'p_brand', 'categorical' UNION ALL SELECT 'p_type', 'categorical'
               UNION ALL SELECT 'p_name', CASE WHEN (SELECT count(DISTINCT p_name) <= 50 OR count(DISTINCT p_name) <= 0.05 * count(*) FROM part)
                   THEN 'categorical' ELSE 'text' END)
    SELECT c AS "column", CASE k WHEN 'numeric' THEN 'scatter' ELSE 'bar' END AS with_number,
           CASE k WHEN 'categorical' THEN 'pie' ELSE 'bar' END AS alone,
           CASE k WHEN 'categorical' THEN 'doughnut,bar' ELSE '' END AS alternatives FROM c""".replace(
               "CASE k WHEN 'numeric' THEN 'scatter' ELSE 'bar' END AS with_number",
               "CASE k WHEN 'numeric' THEN 'scatter' ELSE 'bar' END AS with_number"))
def _(t):
    kinds = P.profile_contract(t.part)
    alone = C.chart_for_types(F.col("category"), F.lit(None).cast("string"))
    paired = C.chart_for_types(F.col("category"), F.lit("numeric"))
    return kinds.select("column", paired["suggested_type"].alias("with_number"), alone["suggested_type"].alias("alone"),
                        F.array_join(alone["alternatives"], ",").alias("alternatives"))


def _intent_sql(words):
    return " OR ".join(f"contains(q, '{w}')" for w in words)


QUESTIONS = """
    SELECT conv_id, turn, lower(CASE conv_id % 8 WHEN 0 THEN 'Trend over time? ' WHEN 1 THEN 'Compare versus: ' WHEN 2 THEN 'Is it related? '
        WHEN 3 THEN 'The spread and top share: ' WHEN 4 THEN 'Breakdown of ' WHEN 5 THEN 'Highest rank of ' ELSE '' END || text) AS q
    FROM conversations"""


def _questions(t):
    k = F.col("conv_id") % 8
    head = (F.when(k == 0, "Trend over time? ").when(k == 1, "Compare versus: ").when(k == 2, "Is it related? ")
            .when(k == 3, "The spread and top share: ").when(k == 4, "Breakdown of ").when(k == 5, "Highest rank of ").otherwise(""))
    return t.conversations.select("conv_id", "turn", F.concat(head, F.col("text")).alias("question"))


@query("intent", "INS09", f"""
    SELECT conv_id, turn, concat_ws(',', {', '.join(f"CASE WHEN {_intent_sql(w)} THEN '{i}' END" for i, w in C.INTENT_WORDS.items())}) AS intents,
           CASE {' '.join(f"WHEN {_intent_sql(w)} THEN '{i}'" for i, w in C.INTENT_WORDS.items())} ELSE 'general' END AS primary_intent,
           CASE {' '.join(f"WHEN {_intent_sql(w)} THEN '{','.join(C.INTENT_CHARTS[i])}'" for i, w in C.INTENT_WORDS.items())}
                ELSE 'bar,line' END AS charts,
           CAST(CASE WHEN {_intent_sql([x for w in C.INTENT_WORDS.values() for x in w])} THEN 0.8 ELSE 0.5 END AS DOUBLE) AS confidence
    FROM ({QUESTIONS})""")
def _(t):
    out = C.classify_intent(_questions(t), "question")
    return out.select("conv_id", "turn", F.array_join("all_intents", ",").alias("intents"), "primary_intent",
                      F.array_join("recommended_charts", ",").alias("charts"), "confidence")


@query("chart_fallback", "INS10", f"""
    WITH i AS (SELECT conv_id, turn, CASE {' '.join(f"WHEN {_intent_sql(w)} THEN '{k}'" for k, w in C.FALLBACK_WORDS.items())}
                      ELSE 'general' END AS intent FROM ({QUESTIONS}))
    SELECT conv_id, turn, intent, CASE intent WHEN 'trend' THEN 'line' WHEN 'relationship' THEN 'scatter' WHEN 'composition' THEN 'pie' ELSE 'bar' END AS chart_type,
           CASE intent WHEN 'trend' THEN 'o_orderdate' WHEN 'relationship' THEN 'o_orderkey' ELSE 'o_orderstatus' END AS x_axis,
           CASE intent WHEN 'relationship' THEN 'o_totalprice' ELSE 'o_orderkey' END AS y_axis, CAST(0.6 AS DOUBLE) AS confidence FROM i""")
def _(t):
    columns = {"o_orderkey": "numeric", "o_totalprice": "numeric", "o_orderstatus": "categorical", "o_orderdate": "datetime"}
    return C.fallback_chart(_questions(t), "question", columns).drop("question")


SERIES = {"columns": ["l_quantity", "l_extendedprice"], "aggregation": "avg", "grouping": "l_returnflag"}


@query("series_cartesian", "INS11", """
    SELECT l_returnflag AS label, unnest(['l_quantity', 'l_extendedprice']) AS series,
           unnest([round(avg(l_quantity), 4), round(avg(l_extendedprice), 4)]) AS value FROM lineitem GROUP BY 1""")
def _(t):
    return rounded(C.cartesian_series(t.lineitem, SERIES), 4, "value")


@query("series_pie", "INS11", "SELECT l_returnflag AS label, round(avg(l_quantity), 4) AS value FROM lineitem GROUP BY 1")
def _(t):
    return rounded(C.pie_series(t.lineitem, SERIES), 4, "value")


@query("series_scatter", "INS11", """
    SELECT unnest(['l_quantity', 'l_extendedprice']) AS series, x, unnest([a, b]) AS y
    FROM (SELECT row_number() OVER (ORDER BY l_returnflag) - 1 AS x, round(avg(l_quantity), 4) AS a,
                 round(avg(l_extendedprice), 4) AS b FROM lineitem GROUP BY l_returnflag)""")
def _(t):
    return rounded(C.scatter_series(t.lineitem, SERIES), 4, "y")


@query("series_heatmap", "INS11", """
    SELECT l_returnflag AS x, l_linestatus AS y, round(sum(l_quantity), 2) AS value FROM lineitem GROUP BY 1, 2""")
def _(t):
    return rounded(C.heatmap_series(t.lineitem, "l_returnflag", "l_linestatus", "l_quantity"), 2, "value")
