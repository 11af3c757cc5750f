"""Names, types, scaling, encoding, reshaping, mapping and step chains."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from gridmill.operators import mapping as M, shape as S
from gridmill.plans import presets as Z
from gridmill.plans.chain import StepChain, by_partition, report
from gridmill.registry.base import EVENTS_NULL, events_null, query, rounded
from gridmill.registry.cleaning import MONEY, PADDED, _money, _padded


def _messy(t):
    return t.customer.select(F.col("c_custkey").alias("Customer Key"), F.col("c_name").alias("fullName!"),
                             F.col("c_nationkey").alias("  nation--key "), F.col("c_acctbal").alias("full_name"))


def _names(case, renamed):
    cols = ", ".join(f'{c} AS "{n}"' for c, n in zip(["c_custkey", "c_name", "c_nationkey", "c_acctbal"], renamed))

    @query(f"rename_{case}", "NRM01 FN03", f"SELECT {cols} FROM customer")
    def build(t):
        return S.normalize_names(_messy(t), case)


_names("snake", ["customer_key", "full_name", "nationkey", "full_name_1"])
_names("camel", ["customerKey", "fullname", "Nationkey", "fullName"])
_names("pascal", ["CustomerKey", "Fullname", "Nationkey", "FullName"])
_names("lower", ["customer_key", "fullname", "_nationkey_", "full_name"])
_names("upper", ["CUSTOMER_KEY", "FULLNAME", "_NATIONKEY_", "FULL_NAME"])

WORDS = """
    SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'Yes' WHEN 1 THEN 'no' WHEN 2 THEN 'T' WHEN 3 THEN 'f' WHEN 4 THEN '1'
                     ELSE 'maybe' END AS word,
           CASE WHEN event_id % 4 = 0 THEN '2.7' WHEN event_id % 4 = 1 THEN '3.0' WHEN event_id % 4 = 2 THEN 'x'
                ELSE CAST(user_id AS VARCHAR) END AS num,
           event_id % 4 AS r, user_id FROM events"""


def _words(t):
    i = F.col("event_id")
    word = F.when(i % 6 == 0, "Yes").when(i % 6 == 1, "no").when(i % 6 == 2, "T").when(i % 6 == 3, "f").when(
        i % 6 == 4, "1").otherwise("maybe")
    num = F.when(i % 4 == 0, "2.7").when(i % 4 == 1, "3.0").when(i % 4 == 2, "x").otherwise(F.col("user_id").cast("string"))
    return t.events.select("event_id", word.alias("word"), num.alias("num"))


@query("bool_parse", "NRM03", f"""
    SELECT event_id, CASE WHEN lower(word) IN ('yes', 't', '1') THEN TRUE WHEN lower(word) IN ('no', 'f') THEN FALSE END AS word
    FROM ({WORDS})""")
def _(t):
    return S.convert_types(_words(t).select("event_id", "word"), {"word": "bool"}, "coerce")


@query("convert_types", "NRM02 FN09", f"""
    SELECT event_id, CASE r WHEN 1 THEN 3 WHEN 3 THEN user_id END AS i,
           CASE r WHEN 0 THEN CAST(2.7 AS DOUBLE) WHEN 1 THEN 3 WHEN 3 THEN user_id END AS f,
           CAST(event_id AS VARCHAR) AS s FROM ({WORDS})""")
def _(t):
    df = _words(t).select("event_id", F.col("num").alias("i"), F.col("num").alias("f"), F.col("event_id").alias("s"))
    return S.convert_types(df, {"i": "int", "f": "float", "s": "str"}, "coerce")


@query("convert_ignore", "NRM02", f"SELECT event_id, word, num, CAST(event_id AS VARCHAR) AS s FROM ({WORDS})")
def _(t):
    df = _words(t).withColumn("s", F.col("event_id"))
    return S.convert_types(df, {"num": "int", "word": "bool", "s": "category"}, "ignore")


@query("convert_counts", "NRM02", f"""
    SELECT 'num' AS "column", 'int' AS target, count(*) FILTER (r IN (1, 3)) AS converted, count(*) FILTER (r IN (0, 2)) AS failed FROM ({WORDS})
    UNION ALL SELECT 'word', 'bool', count(*) FILTER (word <> 'maybe'), count(*) FILTER (word = 'maybe') FROM ({WORDS})""")
def _(t):
    return S.conversion_counts(_words(t), {"num": "int", "word": "bool"})


# --- scaling -----------------------------------------------------------------

SCALE_SQL = {
    "minmax": "({c} - (SELECT min({c}) FROM lineitem)) / ((SELECT max({c}) - min({c}) FROM lineitem))",
    "standard": "({c} - (SELECT avg({c}) FROM lineitem)) / (SELECT stddev_pop({c}) FROM lineitem)",
    "robust": """({c} - (SELECT median({c}) FROM lineitem)) /
                 (SELECT quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) FROM lineitem)""",
    "maxabs": "{c} / (SELECT max(abs({c})) FROM lineitem)",
}
SCALED = ["l_quantity", "l_extendedprice"]


def _scale(method, covers):
    cols = ", ".join(f"round({SCALE_SQL[method].format(c=c)}, 6) AS {c}" for c in SCALED)

    @query(f"scale_{method}", covers, f"SELECT l_orderkey, l_partkey, {cols} FROM lineitem")
    def build(t):
        df = t.lineitem.select("l_orderkey", "l_partkey", *SCALED)
        return rounded(S.scale_numeric(df, SCALED, method), 6, *SCALED)


_scale("minmax", "NRM04")
_scale("standard", "NRM05")
_scale("robust", "NRM06")
_scale("maxabs", "NRM07")


@query("scale_range", "NRM04", """
    SELECT event_id, round((value - (SELECT min(value) FROM events)) / (SELECT max(value) - min(value) FROM events) * 2 - 1, 6) AS value,
           CAST(-1 AS DOUBLE) AS one FROM events""")
def _(t):
    df = t.events.select("event_id", "value", F.lit(5.0).alias("one"))
    return rounded(S.scale_numeric(df, ["value", "one"], "minmax", (-1.0, 1.0)), 6, "value", "one")


@query("scale_params", "NRM08", """
    SELECT min(l_quantity) AS l_quantity_shift, max(l_quantity) - min(l_quantity) AS l_quantity_scale,
           round(min(l_extendedprice), 6) AS l_extendedprice_shift,
           round(max(l_extendedprice) - min(l_extendedprice), 6) AS l_extendedprice_scale FROM lineitem""")
def _(t):
    return rounded(S.scaling_params(t.lineitem, SCALED), 6, "l_extendedprice_shift", "l_extendedprice_scale")


@query("scale_inverse", "NRM08", "SELECT l_orderkey, l_partkey, l_quantity, l_extendedprice FROM lineitem")
def _(t):
    df = t.lineitem.select("l_orderkey", "l_partkey", *SCALED)
    back = S.inverse_scale(S.scale_numeric(df, SCALED, "standard"), S.scaling_params(df, SCALED, "standard"), SCALED, "standard")
    return rounded(back, 4, *SCALED)


# --- encoding ----------------------------------------------------------------

PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query("encode_onehot", "NRM09", "SELECT o_orderkey, " + ", ".join(
    f"""CAST(o_orderpriority = '{p}' AS INTEGER) AS "o_orderpriority_{p}\"""" for p in PRIORITIES[1:]) + " FROM orders")
def _(t):
    return S.encode_onehot(t.orders.select("o_orderkey", "o_orderpriority"), "o_orderpriority", drop_first=True)


@query("encode_onehot_long", "NRM09", """
    SELECT event_id, 'kind_' || kind AS feature, 1 AS value FROM (""" + EVENTS_NULL + ") WHERE kind IS NOT NULL")
def _(t):
    return S.onehot_long(events_null(t), "kind", "event_id")


CODES = f"""SELECT kind AS value, row_number() OVER (ORDER BY kind) - 1 AS code
            FROM (SELECT DISTINCT kind FROM ({EVENTS_NULL}) WHERE kind IS NOT NULL)"""


@query("encode_label", "NRM10", f"SELECT event_id, code AS kind FROM ({EVENTS_NULL}) LEFT JOIN ({CODES}) ON kind = value")
def _(t):
    return S.encode_label(events_null(t).select("event_id", "kind"), "kind")


@query("encode_ordinal", "NRM11", """
    SELECT o_orderkey, CAST(list_position(['5-LOW', '4-NOT SPECIFIED', '3-MEDIUM', '2-HIGH', '1-URGENT'], o_orderpriority) - 1 AS BIGINT)
        AS o_orderpriority FROM orders""")
def _(t):
    return S.encode_ordinal(t.orders.select("o_orderkey", "o_orderpriority"), "o_orderpriority", PRIORITIES[::-1])


@query("encode_dictionary", "NRM12", CODES)
def _(t):
    return S.dictionary(events_null(t), "kind")


@query("encode_decode", "NRM12", f"SELECT event_id, kind FROM ({EVENTS_NULL})")
def _(t):
    df = events_null(t).select("event_id", "kind")
    mapping = S.dictionary(df, "kind")
    return S.decode(S.encode_label(df, "kind", mapping), "kind", mapping)


# --- reshaping ---------------------------------------------------------------

STATUSES = ["F", "O", "P"]


def _pivot(fn, sql_fn, fill=None):
    cols = ", ".join(f"""round({'coalesce(' if fill is not None else ''}{sql_fn}(o_totalprice) FILTER (o_orderstatus = '{s}')
        {f', {fill})' if fill is not None else ''}, 4) AS "o_totalprice_{s}\"""" for s in STATUSES)

    @query(f"pivot_{fn}", "AGG31 NRM14 UDF03", f"SELECT o_orderpriority, {cols} FROM orders GROUP BY 1")
    def build(t):
        out = S.pivot(t.orders, ["o_orderpriority"], "o_orderstatus", "o_totalprice", fn, fill)
        return rounded(out, 4, *out.columns[1:])


@query("pivot_long", "AGG31 NRM14", """
    SELECT l_returnflag, 'l_quantity_' || l_partkey AS feature, CAST(sum(l_quantity) AS DOUBLE) AS value FROM lineitem
    WHERE l_returnflag IS NOT NULL AND l_partkey IS NOT NULL GROUP BY l_returnflag, l_partkey""")
def _(t):
    out = S.pivot_long(t.lineitem, ["l_returnflag"], "l_partkey", "l_quantity", "sum")
    return out.withColumn("value", F.col("value").cast("double"))


_pivot("mean", "avg")
_pivot("sum", "sum", 0.0)
_pivot("min", "min")
_pivot("max", "max")


@query("pivot_count", "AGG31", "SELECT user_id, " + ", ".join(
    f"""count(value) FILTER (event_type = '{k}') AS "value_{k}\"""" for k in ["click", "error", "purchase", "signup", "view"])
    + " FROM events GROUP BY 1")
def _(t):
    return S.pivot(t.events, ["user_id"], "event_type", "value", "count", 0)


KINDS = ["click", "error", "purchase", "signup", "view"]


@query("pivot_first", "AGG31", "SELECT user_id, " + ", ".join(
    f"""arg_min(value, event_id) FILTER (event_type = '{k}') AS "value_{k}\"""" for k in KINDS) + """
    FROM events GROUP BY 1""")
def _(t):
    return S.pivot(t.events, ["user_id"], "event_type", "value", "first", row_number="event_id")


@query("pivot_last", "AGG31", "SELECT user_id, " + ", ".join(
    f"""arg_max(value, event_id) FILTER (event_type = '{k}') AS "value_{k}\"""" for k in KINDS) + """
    FROM events GROUP BY 1""")
def _(t):
    return S.pivot(t.events, ["user_id"], "event_type", "value", "last", row_number="event_id", pivot_values=KINDS)


@query("unpivot", "NRM15", """
    SELECT l_orderkey, l_partkey, unnest(['l_quantity', 'l_discount', 'l_tax']) AS variable,
           unnest([l_quantity, l_discount, l_tax]) AS value FROM lineitem""")
def _(t):
    return S.unpivot(t.lineitem.select("l_orderkey", "l_partkey", "l_quantity", "l_discount", "l_tax"),
                     ["l_orderkey", "l_partkey"])


@query("unpivot_mixed", "NRM15", f"""
    SELECT event_id, unnest(['kind', 'user_id']) AS variable, unnest([kind, CAST(user_id AS VARCHAR)]) AS value FROM ({EVENTS_NULL})""")
def _(t):
    return S.unpivot(events_null(t), ["event_id"], ["kind", "user_id"])


@query("flatten_struct", "NRM13", """
    SELECT o_orderkey AS key, o_custkey AS info_cust, o_orderstatus AS info_state_code, o_orderpriority AS info_state_priority FROM orders""")
def _(t):
    state = F.struct(F.col("o_orderstatus").alias("code"), F.col("o_orderpriority").alias("priority"))
    return S.flatten_structs(t.orders.select(
        F.col("o_orderkey").alias("key"), F.struct(F.col("o_custkey").alias("cust"), state.alias("state")).alias("info")))


@query("flatten_json", "NRM13 FN18", """
    SELECT event_id, unnest(['a_k', 'items_0_u', 'items_1_u_t', 'tags', 'n']) AS key,
           unnest([json_extract_string(props, '$.k'), CAST(user_id AS VARCHAR), event_type,
                   '["' || event_type || '", 1]', NULL]) AS value FROM events""")
def _(t):
    e = F.col("event_type")
    document = F.concat(
        F.lit('{"a": '), F.col("props"), F.lit(', "items": [{"u": '), F.col("user_id").cast("string"),
        F.lit('}, {"u": {"t": "'), e, F.lit('"}}], "tags": ["'), e, F.lit('", 1], "empty": {}, "none": [], "n": null}'))
    return S.flatten_json(t.events.select("event_id", document.alias("document")), "document", ["event_id"])


@query("normalize_table", "NRM16", """
    SELECT c_custkey AS customer_key, CAST(c_nationkey AS VARCHAR) AS nation,
           round(c_acctbal / (SELECT max(abs(c_acctbal)) FROM customer), 6) AS balance,
           CAST(dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS BIGINT) AS segment FROM customer""")
def _(t):
    df = t.customer.select(F.col("c_custkey").alias("Customer Key"), F.col("c_nationkey").alias("Nation"),
                           F.col("c_acctbal").alias("Balance"), F.col("c_mktsegment").alias("segment"))
    out = Z.normalize(df, types={"nation": "str"}, scale=["balance"], scaling="maxabs", encode=["segment"])
    return rounded(out, 6, "balance")


@query("normalize_report", "NRM16", """
    SELECT * FROM (VALUES ('rename', 'Customer Key', 'customer_key'), ('rename', 'Nation', 'nation'), ('rename', 'Balance', 'balance')) AS v(step, "column", detail),
        (SELECT NULL::BIGINT AS count)
    UNION ALL SELECT 'converted', 'segment', 'int', 0 UNION ALL SELECT 'failed', 'segment', 'int', count(*) FROM customer
    UNION ALL SELECT 'converted', 'nation', 'str', count(*) FROM customer UNION ALL SELECT 'failed', 'nation', 'str', 0
    UNION ALL SELECT 'encode', 'name', 'codes', count(DISTINCT c_name) FROM customer""")
def _(t):
    df = t.customer.select(F.col("c_custkey").alias("Customer Key"), F.col("c_nationkey").alias("Nation"), F.col("c_acctbal").alias("Balance"),
                           F.col("c_mktsegment").alias("segment"), F.col("c_name").alias("name"))
    return Z.normalize_report(df, types={"nation": "str", "segment": "int"}, scale=["balance"], scaling="maxabs", encode=["name"]).filter(
        "step NOT IN ('shift', 'scale')")


# --- mapping -----------------------------------------------------------------

TARGET = {
    "id": {"type": "integer", "required": True}, "full_name": {"type": "string", "required": True},
    "balance": {"type": "float"}, "active": {"type": "boolean", "required": True},
    "note": {"type": "string", "required": True}, "joined": {"type": "date", "required": True},
    "score": {"type": "integer", "required": True}, "extra": {"type": "string"},
}
MAPPING = {"c_custkey": "id", "c_name": "full_name", "c_acctbal": "balance"}


@query("map_apply", "MAP01", "SELECT c_custkey AS id, c_name AS full_name, c_acctbal AS balance FROM customer")
def _(t):
    return M.apply_mapping(t.customer, MAPPING, drop_unmapped=True)


@query("map_apply_keep", "MAP01", "SELECT c_custkey AS id, c_name AS full_name, c_acctbal AS balance, c_nationkey, c_mktsegment FROM customer")
def _(t):
    return M.apply_mapping(t.customer, MAPPING)


@query("map_conform", "MAP04 MAP05", """
    SELECT c_custkey AS id, c_name AS full_name, c_acctbal AS balance, FALSE AS active, '' AS note,
           CAST(NULL AS TIMESTAMP) AS joined, CAST(0 AS BIGINT) AS score FROM customer""")
def _(t):
    return M.conform(t.customer, MAPPING, TARGET)


@query("map_convert", "MAP05", f"""
    SELECT event_id AS id, CASE WHEN lower(word) IN ('yes', 't', '1') THEN TRUE WHEN lower(word) IN ('no', 'f') THEN FALSE END AS active,
           CASE r WHEN 0 THEN CAST(2.7 AS DOUBLE) WHEN 1 THEN 3 WHEN 3 THEN user_id END AS balance FROM ({WORDS})""")
def _(t):
    return M.conform(_words(t), {"event_id": "id", "word": "active", "num": "balance"}, TARGET, fill_missing=False)


@query("map_validate", "MAP02 MAP03", """
    SELECT * FROM (VALUES ('error', 'missing_source', 'c_phone'), ('error', 'unknown_target', 'phone'),
        ('error', 'missing_required', 'active'), ('error', 'missing_required', 'note'), ('error', 'missing_required', 'joined'),
        ('error', 'missing_required', 'score'), ('warning', 'type_mismatch', 'c_name'), ('warning', 'many_to_one', 'full_name'))
        AS v(severity, kind, "column"), (SELECT count(*) AS rows_affected FROM customer)""")
def _(t):
    mapping = {"c_custkey": "id", "c_mktsegment": "full_name", "c_name": "balance", "c_nationkey": "full_name", "c_phone": "phone"}
    rows = t.customer.agg(F.count(F.lit(1)).alias("n")).scalar()
    return M.validate_mapping(t.customer, mapping, TARGET).drop("message").withColumn("rows_affected", rows)


FIELD_NAMES = ["red_widget", "widget_blue", "SmallRing", "large bolt", "green_part", "qty", "name"]


DOCUMENT_NAMES = ["web_page", "news", "forum_name", "code"]


def _matching_key(name: str) -> str:
    return f"trim(regexp_replace(regexp_replace(lower({name}), '[^a-z0-9_]', '', 'g'), '_+', '_', 'g'), '_')"


def likeness_sql(names: str, targets: list[str]) -> str:
    """``WITH`` list whose ``scored`` holds every name of ``names`` against every target: the blocks that match are found by recursion, the
    longest first, then what lies left and right of it."""
    def has(side, word):
        return f"contains(lower({side}), '{word}')"

    words = " OR ".join(f"({has('source', a)} AND {has('target', f)}) OR ({has('source', f)} AND {has('target', a)})" for a, f in M.ABBREVIATIONS)
    bare = " OR ".join(f"(replace(lower(source), '{x}', '') = replace(lower(target), '{x}', '') AND replace(lower(source), '{x}', '') <> '')"
                       for x in M.AFFIXES)
    goals = ", ".join(f"({i}, '{t}')" for i, t in enumerate(targets))
    return f"""
    WITH RECURSIVE goals AS (SELECT * FROM (VALUES {goals}) AS v(place, target)),
    pairs AS (SELECT *, {_matching_key('source')} AS a, {_matching_key('target')} AS b,
                     row_number() OVER (ORDER BY source, place) AS pair FROM ({names}) CROSS JOIN goals),
    cells AS (SELECT pair, a, b, i, unnest(range(1, length(b) + 1)) AS j
              FROM (SELECT pair, a, b, unnest(range(1, length(a) + 1)) AS i FROM pairs)),
    runs AS (SELECT pair, i, j, len(list_filter(range(1, least(length(a) - i, length(b) - j) + 2),
                    lambda k: substr(a, i, k) = substr(b, j, k))) AS l FROM cells WHERE substr(a, i, 1) = substr(b, j, 1)),
    blocks AS (
        SELECT pair, 1 AS i0, CAST(length(a) + 1 AS BIGINT) AS i1, 1 AS j0, CAST(length(b) + 1 AS BIGINT) AS j1, 0 AS size FROM pairs
        UNION ALL
        SELECT pair, part.i0, part.i1, part.j0, part.j1, part.size FROM (
            SELECT pair, unnest([{{'i0': i0, 'i1': -m.i, 'j0': j0, 'j1': -m.j, 'size': m.l}},
                                 {{'i0': m.l - m.i, 'i1': i1, 'j0': m.l - m.j, 'j1': j1, 'size': 0}}]) AS part
            FROM (SELECT pair, i0, i1, j0, j1, max({{'l': least(l, i1 - i, j1 - j), 'i': -i, 'j': -j}}) AS m
                  FROM blocks JOIN runs USING (pair) WHERE i >= i0 AND i < i1 AND j >= j0 AND j < j1 GROUP BY ALL))),
    scored AS (
        SELECT source, target, place, least(1.0::DOUBLE,
            CASE WHEN length(a) + length(b) = 0 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE * matched / (length(a) + length(b)) END
            + CASE WHEN {words} THEN {M.ABBREVIATION_BONUS}::DOUBLE WHEN {bare} THEN {M.AFFIX_BONUS}::DOUBLE ELSE 0 END) AS confidence
        FROM pairs JOIN (SELECT pair, sum(size) AS matched FROM blocks GROUP BY pair) USING (pair))"""


def suggestions_sql(names: str, targets: list[str], top_n: int = M.TOP, least: float = M.MIN_CONFIDENCE) -> str:
    return likeness_sql(names, targets) + f"""
    SELECT source, rank, target, confidence FROM (
        SELECT *, CAST(row_number() OVER (PARTITION BY source ORDER BY confidence DESC, place) AS INTEGER) AS rank
        FROM scored WHERE confidence >= {least}) WHERE rank <= {top_n}"""


def auto_sql(names: str, targets: list[str]) -> str:
    return likeness_sql(names, targets) + f""",
    exact AS (SELECT source, arg_min(target, place) AS target FROM pairs WHERE a = b GROUP BY source),
    close AS (
        SELECT source, target, confidence FROM scored WHERE source NOT IN (SELECT source FROM exact) AND confidence >= {M.MIN_CONFIDENCE}
        QUALIFY row_number() OVER (PARTITION BY source ORDER BY confidence DESC, place) = 1)
    SELECT source, target, 1.0::DOUBLE AS confidence, 'exact' AS how FROM exact
    UNION ALL
    SELECT source, target, confidence, 'similar' FROM (
        SELECT * FROM close WHERE confidence > {M.AUTO_CONFIDENCE} AND target NOT IN (SELECT target FROM exact)
        QUALIFY row_number() OVER (PARTITION BY target ORDER BY source) = 1)"""


PART_NAMES = "SELECT DISTINCT p_name AS source FROM part WHERE p_name IS NOT NULL"


@query("map_fuzzy", "MAP06 FN08", suggestions_sql(PART_NAMES, FIELD_NAMES))
def _(t):
    return M.suggest_mappings(t.part, "p_name", FIELD_NAMES)


@query("map_fuzzy_documents", "MAP06 FN08", suggestions_sql(
    "SELECT DISTINCT source FROM documents WHERE source IS NOT NULL", DOCUMENT_NAMES, 2, 0.1))
def _(t):
    return M.suggest_mappings(t.documents, "source", DOCUMENT_NAMES, 2, 0.1)


@query("map_auto", "MAP07 FN07", auto_sql(PART_NAMES, FIELD_NAMES))
def _(t):
    return M.auto_mapping(t.part, "p_name", FIELD_NAMES)


@query("map_auto_exact", "MAP07 FN07", """
    SELECT DISTINCT p_name AS source, p_name AS target, CAST(1 AS DOUBLE) AS confidence, 'exact' AS how FROM part
    WHERE regexp_replace(lower(p_name), '[^a-z0-9_]', '', 'g') IN ('redwidget', 'smallring')""")
def _(t):
    return M.auto_mapping(t.part, "p_name", ["red widget", "small ring"]).filter("how = 'exact'")


# --- step chains -------------------------------------------------------------

TWICE = f"SELECT c_custkey, name, segment FROM ({PADDED}) UNION ALL SELECT c_custkey + 1000000, name, segment FROM ({PADDED})"


def _twice(t):
    df = _padded(t)
    return df.unionByName(df.withColumn("c_custkey", F.col("c_custkey") + 1000000))


@query("steps_standard", "PIP03", "SELECT c_custkey, c_name AS name, c_mktsegment AS segment FROM customer")
def _(t):
    return Z.standard_cleaning("c_custkey").run(_twice(t))[0]


@query("steps_report", "PIP01 PIP02", """
    SELECT 0 AS position, 'remove duplicates' AS step, 'completed' AS status, count(*) AS rows FROM customer
    UNION ALL SELECT 1, 'trim whitespace', 'completed', count(*) FROM customer
    UNION ALL SELECT 2, 'drop empty rows', 'completed', count(*) FROM customer""")
def _(t):
    result, outcomes = Z.standard_cleaning("c_custkey").run(_twice(t), count_rows=True)
    result.write.format("noop").mode("overwrite").save()
    return report(t.spark, outcomes).select("position", "step", "status", "rows")


NUMERIC_STEPS = f"""
    WITH m AS (SELECT o_orderkey, TRY_CAST(CASE WHEN money NOT LIKE '%d' THEN replace(replace(replace(money, '$', ''), ',', ''), ' ', '') END
        AS DOUBLE) AS money FROM ({MONEY})),
    q AS (SELECT quantile_cont(money, 0.25) AS q1, quantile_cont(money, 0.75) AS q3 FROM m),
    k AS (SELECT o_orderkey, money FROM m, q WHERE money IS NULL OR money BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1))
    SELECT o_orderkey, round((money - (SELECT min(money) FROM k)) / (SELECT max(money) - min(money) FROM k), 6) AS money FROM k"""


@query("steps_numeric", "PIP04", NUMERIC_STEPS)
def _(t):
    return rounded(Z.numeric_preprocessing(["money"]).run(_money(t))[0], 6, "money")


@query("steps_text", "PIP05", "SELECT c_custkey, lower(c_name) AS name, lower(c_mktsegment) AS segment FROM customer")
def _(t):
    return Z.text_preprocessing(["name", "segment"]).run(_padded(t))[0]


@query("steps_full", "PIP06", """
    SELECT c_custkey, lower(c_name) AS name, CAST(dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS BIGINT) AS segment FROM customer""")
def _(t):
    chain = Z.full_preprocessing(text=["name"], categorical=["segment"], row_number="c_custkey")
    return chain.run(_twice(t))[0]


@query("steps_custom", "UDF01 PIP01", """
    SELECT event_id, user_id, value, value * 2 AS doubled FROM events WHERE value > 10""")
def _(t):
    def keep(df, above):
        return df.filter(F.col("value") > above), {"above": above}

    def double(pdf):
        return pdf.assign(doubled=pdf["value"] * 2)

    chain = StepChain("custom").add(keep, "keep large", above=10).add(
        by_partition(double, "event_id long, user_id long, value double, doubled double"), "double")
    return chain.run(t.events.select("event_id", "user_id", "value"))[0]


@query("steps_continue", "PIP01 PIP02", "SELECT event_id, upper(event_type) AS event_type FROM events")
def _(t):
    from gridmill.operators import clean
    chain = (StepChain("tolerant").add(clean.trim_whitespace, columns=["absent"])
             .add(clean.standardize_case, columns=["event_type"], case="upper"))
    return chain.run(t.events.select("event_id", "event_type"), stop_on_error=False)[0]
