"""Files written from the tables into the shared scratch folder and read back, payloads, sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridmill.operators import infer
from gridmill.registry.base import query
from gridmill.session import scratch_path
from gridmill.sources import files as S, ingest as G, payloads as P, sinks as K

CUSTOMER = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]


def _write_csv(df, spark, label, sep=",", encoding="utf-8"):
    path = scratch_path(spark, label)
    df.write.option("header", "true").option("sep", sep).option("encoding", encoding).csv(path)
    return path


@query("csv_scan", "SRC01 SNK03", "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, CAST(c_nationkey AS VARCHAR) AS c_nationkey FROM customer")
def _(t):
    path = scratch_path(t.spark, "export")
    K.export_csv(t.customer.select("c_custkey", "c_name", "c_nationkey"), path, ";")
    return S.read_csv(t.spark, path, ";")[0]


@query("csv_round_trip", "SRC01 SNK03", """
    SELECT 'd' || doc_id AS key, nullif(text, '') AS body, source AS label FROM documents
    UNION ALL SELECT 'p' || page_id, nullif(html, ''), url FROM pages""")
def _(t):
    path = scratch_path(t.spark, "texts")
    d = t.documents.select(F.concat(F.lit("d"), "doc_id").alias("key"), F.col("text").alias("body"), F.col("source").alias("label"))
    K.export_csv(d.unionAll(t.pages.select(F.concat(F.lit("p"), "page_id"), "html", "url")), path)
    return S.read_csv(t.spark, path)[0]


@query("csv_header_orders", "SRC01 SRC04", """
    SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, CASE WHEN c_custkey % 2 = 1 THEN c_mktsegment END AS c_mktsegment FROM customer""")
def _(t):
    root = scratch_path(t.spark, "orders")
    even = F.col("c_custkey") % 2 == 0
    K.export_csv(t.customer.filter(even).select("c_custkey", "c_name"), f"{root}/a")
    K.export_csv(t.customer.filter(~even).select("c_mktsegment", "c_name", "c_custkey"), f"{root}/b")
    return S.read_csv(t.spark, f"{root}/*")[0].select("c_custkey", "c_name", "c_mktsegment")


@query("csv_trailing_delimiter", "SRC01", "SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, p_brand FROM part")
def _(t):
    path = scratch_path(t.spark, "trailing")
    line = F.concat(F.col("p_partkey").cast("string"), F.lit(";"), F.col("p_brand"), F.lit(";")).alias("value")
    t.part.select(line).write.text(path)
    return S.parse_lines(t.spark, path, ["p_partkey", "p_brand"], ";")[0]


RAGGED = """CASE event_id % 10 WHEN 0 THEN event_id || ',' || event_type || ',1,extra' WHEN 1 THEN CAST(event_id AS VARCHAR)
            ELSE event_id || ',"' || event_type || ',x",1' END"""


def _ragged(t):
    i, e = F.col("event_id"), F.col("event_type")
    n = i.cast("string")
    line = (F.when(i % 10 == 0, F.concat(n, F.lit(","), e, F.lit(",1,extra"))).when(i % 10 == 1, n)
            .otherwise(F.concat(n, F.lit(',"'), e, F.lit(',x",1'))))
    path = scratch_path(t.spark, "ragged")
    t.events.select(line.alias("value")).write.text(path)
    return path


@query("csv_good_lines", "SRC01", """
    SELECT CAST(event_id AS VARCHAR) AS _c0, CASE WHEN event_id % 10 <> 1 THEN event_type || ',x' END AS _c1,
           CASE WHEN event_id % 10 <> 1 THEN '1' END AS _c2 FROM events WHERE event_id % 10 <> 0""")
def _(t):
    return S.parse_lines(t.spark, _ragged(t), ["_c0", "_c1", "_c2"])[0]


@query("csv_bad_lines", "SRC01", f"SELECT {RAGGED} AS line FROM events WHERE event_id % 10 = 0")
def _(t):
    return S.parse_lines(t.spark, _ragged(t), ["_c0", "_c1", "_c2"])[1]


DELIMITED = {"BUILDING": ",", "FURNITURE": ",", "MACHINERY": ";", "AUTOMOBILE": "\t", "HOUSEHOLD": "|"}


@query("file_delimiters", "SRC02", """
    SELECT DISTINCT c_mktsegment AS folder, CASE c_mktsegment WHEN 'BUILDING' THEN ',' WHEN 'FURNITURE' THEN ',' WHEN 'MACHINERY' THEN ';'
        WHEN 'AUTOMOBILE' THEN chr(9) ELSE '|' END AS delimiter FROM customer""")
def _(t):
    root = scratch_path(t.spark, "delimited")
    for segment, sep in DELIMITED.items():
        rows = t.customer.filter(F.col("c_mktsegment") == segment)
        rows.write.option("header", "true").option("sep", sep).csv(f"{root}/segment={segment}")
    found = S.infer_delimiters(t.spark, root, "*.csv")
    folder = F.regexp_extract("path", "segment=([A-Z]+)", 1)
    return found.select(folder.alias("folder"), "delimiter").distinct()


@query("file_encodings", "SRC03", """
    SELECT DISTINCT lang AS folder, CASE WHEN lang = (SELECT min(lang) FROM documents) THEN 'latin-1' ELSE 'utf-8' END AS encoding
    FROM documents""")
def _(t):
    root = scratch_path(t.spark, "encoded")
    first = t.documents.agg(F.min("lang").alias("m")).scalar()
    latin = F.col("lang") == first
    # an e-acute makes every file non-ASCII; other letters outside Latin-1 are dropped before encoding
    body = F.regexp_replace(F.concat(F.lit("é "), F.col("text")), "[^\\x20-\\x7e\\xa0-\\xff]", " ")
    rows = t.documents.select("lang", body.alias("body"), latin.alias("latin"))
    rows.filter(~F.col("latin")).select("lang", "body").write.partitionBy("lang").csv(f"{root}/a")
    rows.filter(F.col("latin")).select("lang", "body").write.partitionBy("lang").option("encoding", "ISO-8859-1").csv(f"{root}/b")
    found = S.detect_encodings(t.spark, root, "*.csv")
    return found.select(F.regexp_extract("path", "lang=([a-z]+)", 1).alias("folder"), "encoding").distinct()


@query("read_json", "SRC04", "SELECT event_id, event_type, value FROM events")
def _(t):
    path = scratch_path(t.spark, "json") + ".json"
    t.events.select("event_id", "event_type", "value").write.json(path)
    return S.read_table(t.spark, path).select("event_id", "event_type", "value")


@query("read_by_extension", "SRC04 SRC05", "SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, p_brand FROM part")
def _(t):
    path = scratch_path(t.spark, "table") + ".csv"
    t.part.select("p_partkey", "p_brand").write.option("header", "true").csv(path)
    return S.require_shape(S.read_table(t.spark, path), 1, 2)


@query("head_check", "SRC06", "SELECT count(*) AS head_rows, 2 AS columns FROM (SELECT * FROM part LIMIT 5)")
def _(t):
    path = scratch_path(t.spark, "head") + ".parquet"
    t.part.select("p_partkey", "p_brand").write.parquet(path)
    head = S.head_check(t.spark, path)
    return head.agg(F.count(F.lit(1)).alias("head_rows")).withColumn("columns", F.lit(len(head.columns)))


def _by_segment(t, label):
    """One file per market segment, the second copy of each in another folder."""
    root = scratch_path(t.spark, label)
    rows = t.customer.select("c_custkey", "c_mktsegment").repartitionByRange(5, "c_mktsegment").sortWithinPartitions("c_custkey")
    for copy in ("a", "b"):
        rows.write.partitionBy("c_mktsegment").option("header", "true").csv(f"{root}/{copy}")
    return root


@query("file_dedup", "SRC09 JOI07", """
    SELECT c_mktsegment AS segment, unnest(['a', 'b']) AS copy, unnest([FALSE, TRUE]) AS is_duplicate
    FROM (SELECT DISTINCT c_mktsegment FROM customer)""")
def _(t):
    root = _by_segment(t, "copies")
    marked = S.first_copies(S.file_hashes(t.spark, root, "*.csv"), order=["path"])
    return marked.select(F.regexp_extract("path", "c_mktsegment=([A-Z]+)", 1).alias("segment"),
                         F.regexp_extract("path", "/([ab])/c_mktsegment", 1).alias("copy"), "is_duplicate")


@query("file_known", "SRC09 JOI07", """
    SELECT c_mktsegment AS segment, FALSE AS is_new FROM (SELECT DISTINCT c_mktsegment FROM customer)""")
def _(t):
    from gridmill.operators.relations import seen
    root = _by_segment(t, "known")
    old, new = S.file_hashes(t.spark, f"{root}/a", "*.csv"), S.file_hashes(t.spark, f"{root}/b", "*.csv")
    known = seen(new, old, ["file_hash"]).select("path", F.lit(False).alias("is_new"))
    fresh = seen(new, old, ["file_hash"], new=True).select("path", F.lit(True).alias("is_new"))
    return known.unionByName(fresh).select(F.regexp_extract("path", "c_mktsegment=([A-Z]+)", 1).alias("segment"), "is_new")


@query("file_profile", "SRC10 SRC11 SRC13", """
    SELECT c_mktsegment AS segment, 'csv' AS extension, 'text/csv' AS mime_type, 'csv' AS category, TRUE AS accepted, TRUE AS sized
    FROM (SELECT DISTINCT c_mktsegment FROM customer)""")
def _(t):
    root = _by_segment(t, "listed")
    listed = S.list_files(t.spark, f"{root}/a", prefix="part-", glob="*.csv")
    return S.admit(S.with_metadata(listed)).select(
        F.regexp_extract("path", "c_mktsegment=([A-Z]+)", 1).alias("segment"), "extension", "mime_type", "category",
        "accepted", (F.col("size_kb") > 0).alias("sized"))


# --- payloads ----------------------------------------------------------------

PAYLOAD = """CASE event_id % 8 WHEN 0 THEN props WHEN 1 THEN '[' || props || ', ' || props || ']' WHEN 2 THEN '{"name": "n", "data": ' || props || '}'
             WHEN 3 THEN '{"data": [' || props || ']}' WHEN 4 THEN '[]' WHEN 5 THEN '5' WHEN 6 THEN 'no json {' ELSE '{}' END"""


def _payloads(t):
    i, p = F.col("event_id"), F.col("props")
    options = [p, F.concat(F.lit("["), p, F.lit(", "), p, F.lit("]")), F.concat(F.lit('{"name": "n", "data": '), p, F.lit("}")),
               F.concat(F.lit('{"data": ['), p, F.lit("]}")), F.lit("[]"), F.lit("5"), F.lit("no json {"), F.lit("{}")]
    payload = F.element_at(F.array(*options), (i % 8 + 1).cast("int"))
    return t.events.select("event_id", payload.alias("payload"))


PAYLOAD_ROWS = """
    SELECT event_id, unnest(CASE WHEN event_id % 8 = 1 THEN [0, 1] ELSE [0] END) AS item, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k
    FROM events WHERE event_id % 8 < 4"""


@query("payload_rows", "SRC07 FN18 PRJ01", PAYLOAD_ROWS)
def _(t):
    rows, _ = P.payload_rows(_payloads(t), "payload", ["event_id"])
    return P.payload_fields(rows, {"k": "bigint"})


@query("payload_rejects", "SRC07", """
    SELECT event_id, CASE event_id % 8 WHEN 4 THEN 'empty' WHEN 5 THEN 'no object or array' WHEN 6 THEN 'not json' ELSE 'empty' END AS reason
    FROM events WHERE event_id % 8 > 3""")
def _(t):
    return P.payload_rows(_payloads(t), "payload", ["event_id"])[1]


# --- sinks -------------------------------------------------------------------

def _records(t, org, dataset, df):
    return K.envelope(df.withColumn("row_number", F.col("c_custkey") + 1), org, dataset)


@query("record_sink", "SNK01", """
    SELECT 'org' AS organization_id, 'd1' AS dataset_id, c_custkey + 1 AS row_number, c_custkey, c_acctbal, TRUE AS is_valid FROM customer
    UNION ALL SELECT 'org', 'd2', c_custkey + 1, c_custkey, c_acctbal, TRUE FROM customer WHERE c_acctbal > 0""")
def _(t):
    path = scratch_path(t.spark, "records")
    df = t.customer.select("c_custkey", "c_acctbal")
    K.append_records(_records(t, "org", "d1", df), path)
    K.append_records(_records(t, "org", "d2", df.filter("c_acctbal > 0")), path)
    return K.read_records(t.spark, path, "org").select(
        "organization_id", "dataset_id", "row_number", "c_custkey", "c_acctbal", "is_valid")


@query("record_replace", "SNK02", """
    SELECT 'd1' AS dataset_id, c_custkey FROM customer WHERE c_acctbal > 0 UNION ALL SELECT 'd2', c_custkey FROM customer""")
def _(t):
    path = scratch_path(t.spark, "replaced")
    df = t.customer.select("c_custkey", "c_acctbal")
    K.append_records(_records(t, "org", "d1", df), path)
    K.append_records(_records(t, "org", "d2", df), path)
    K.replace_dataset(_records(t, "org", "d1", df.filter("c_acctbal > 0")), path)
    return K.read_records(t.spark, path, "org").select("dataset_id", "c_custkey")


@query("record_empty_reload", "SNK02", """
    SELECT 'd2' AS dataset_id, c_custkey FROM customer UNION ALL SELECT 'd3', c_custkey FROM customer WHERE c_acctbal <= 0""")
def _(t):
    path = scratch_path(t.spark, "reloaded")
    df = t.customer.select("c_custkey", "c_acctbal")
    for dataset in ("d1", "d2", "d3"):
        K.append_records(_records(t, "org", dataset, df), path)
    K.replace_dataset(_records(t, "org", "d1", df.filter("c_custkey < 0")), path, [("org", "d1")])
    K.replace_dataset(_records(t, "org", "d3", df.filter("c_custkey < 0")), path, [("org", "d3")])
    K.append_records(_records(t, "org", "d3", df.filter("c_acctbal <= 0")), path)
    return K.read_records(t.spark, path, "org").select("dataset_id", "c_custkey")


@query("ingest_records", "PIP07 SNK01 SNK02 NRM01", """
    SELECT c_custkey AS customer_key, c_name AS name, c_nationkey AS nation, c_acctbal AS balance, 'org' AS organization_id, TRUE AS is_valid
    FROM customer""")
def _(t):
    source = t.customer.select(
        F.col("c_custkey").alias("Customer Key"), F.concat(F.lit("  "), F.col("c_name"), F.lit(" ")).alias("Name"),
        F.col("c_nationkey").alias("Nation"), F.col("c_acctbal").alias("Balance"))
    path = _write_csv(source.unionByName(source), t.spark, "upload")
    done = G.ingest_csv(t.spark, path, scratch_path(t.spark, "ingested"), "org", "d1")
    return done.records.select("customer_key", "name", F.col("nation").cast("int").alias("nation"), "balance",
                               "organization_id", "is_valid")


@query("ingest_types", "PIP07 INF01", """
    SELECT 'c_custkey' AS "column", 'integer' AS inferred_type UNION ALL SELECT 'c_name', 'string' UNION ALL SELECT 'c_nationkey', 'integer'
    UNION ALL SELECT 'c_acctbal', 'float' UNION ALL SELECT 'c_mktsegment', 'string'""")
def _(t):
    path = _write_csv(t.customer, t.spark, "typed")
    return infer.infer_types(S.read_csv(t.spark, path)[0]).select("column", "inferred_type")
