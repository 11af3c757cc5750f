"""Registered queries of this subpackage, with SQL where it can express them."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, functions as F

from gridmill.llm import align, bigru, crf, licences, mixing, pieces, pq, repair, repetition, runindex, simhash, warc, winnow
from gridmill.llm.common import held_out, short_batches

PIECE_MODEL = os.environ.get("PIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")

BYTE_MODEL = os.environ.get("BYTE_MODEL", "/opt/tokenizers/byte_bpe_50k.json")

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql:
            SQL[name] = sql
        return function
    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    short_batches(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


MIX_SQL = r"""
WITH docs AS (
    SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
sized AS (SELECT source, sum(size)::BIGINT AS source_size FROM docs GROUP BY source),
weighed AS (
    SELECT *, [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w FROM sized),
filled AS (
    SELECT *, source_size * 2.0::DOUBLE / w AS ratio,
           (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(source_size) OVER f, 0) * 2.0::DOUBLE)
           / (sum(w) OVER () - coalesce(sum(w) OVER f, 0)) AS level
    FROM weighed
    WINDOW f AS (ORDER BY source_size * 2.0::DOUBLE / w, w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
leveled AS (SELECT *, max(CASE WHEN level <= ratio THEN level END) OVER () AS reached FROM filled),
targets AS (
    SELECT source, source_size, CASE WHEN reached < ratio THEN w * reached ELSE source_size * 2.0::DOUBLE END AS target,
           md5('mix:' || coalesce('s' || source, 'n')) AS m FROM leveled),
rated AS (
    SELECT source, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate,
           ((strpos('0123456789abcdef', m[1]) - 1) * 4096 + (strpos('0123456789abcdef', m[2]) - 1) * 256
            + (strpos('0123456789abcdef', m[3]) - 1) * 16 + (strpos('0123456789abcdef', m[4]) - 1))::DOUBLE / 65536 AS u
    FROM targets),
placed AS (
    SELECT d.doc_id, d.size, r.source_size, r.target, r.rate, r.u, row_number() OVER (
               PARTITION BY d.source
               ORDER BY d.size - d.size % (1::BIGINT << greatest(length(bin(d.size)) - 3, 0)), md5(d.doc_id::VARCHAR), d.doc_id) AS i
    FROM docs d JOIN rated r ON d.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, size, source_size, target, (floor(u + rate * i) - floor(u + rate * (i - 1)))::BIGINT * size AS taken FROM placed
"""


@query("op4_source_mixing", MIX_SQL)
def source_mixing(spark, folder):
    rows = mixing.mix(table(spark, folder, "documents"))
    return rows.selectExpr("id AS doc_id", "size", "source_size", "target", "taken")


@query("op5_repetition_rules")
def repetition_rules(spark, folder):
    return repetition.repetition_rules(table(spark, folder, "documents")).withColumnRenamed("id", "doc_id")


@query("op9_simhash_groups")
def simhash_groups(spark, folder):
    rows = simhash.simhash_groups(table(spark, folder, "documents"))
    return rows.selectExpr("id AS doc_id", "lower(lpad(hex(fp), 16, '0')) AS fingerprint", "component AS component_id")


@query("op7_warc_round_trip")
def warc_round_trip(spark, folder):
    return warc.archive_round_trip(spark, table(spark, folder, "pages"))


@query("op6_near_vectors")
def near_vectors(spark, folder):
    rows = pq.near_vectors(table(spark, folder, "embeddings"))
    return rows.selectExpr("id AS vec_id", "n_links", "component AS component_id", "kept")


@query("op10_byte_language")
def byte_language(spark, folder):
    docs = table(spark, folder, "documents")
    network = bigru.fit_languages(docs, ~held_out(F.col("doc_id")))
    rows = bigru.predict_languages(docs, network)
    return rows.select(F.col("id").alias("doc_id"), held_out(F.col("id")).alias("held_out"), "lang_pred", "score")


@query("op8_toxic_spans")
def toxic_spans(spark, folder):
    docs = table(spark, folder, "documents")
    tagger = crf.fit_tagger(docs, table(spark, folder, "labels"), ~held_out(F.col("doc_id")))
    rows = crf.tag_toxic(docs, tagger)
    return rows.select(F.col("id").alias("doc_id"), held_out(F.col("id")).alias("held_out"), "score", "predicted", F.size("spans").alias("n_spans"))


def _licence_sql() -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    bags = [(name, licences.template_bigrams(text)) for name, text in licences.TEMPLATES.items()]
    listed = ", ".join(f"({quoted(name)}, {quoted(x)}, {n})" for name, bag in bags for x, n in bag)
    return rf"""
WITH bigrams(licence, bigram, times) AS (VALUES {listed}),
templates AS (SELECT licence, sum(times)::INT AS template_size FROM bigrams GROUP BY licence),
clean AS (SELECT doc_id, regexp_replace(lower(text), '[^a-z0-9\n]+', ' ', 'g') AS t FROM documents WHERE length(text) > 0),
units AS (
    SELECT doc_id, generate_subscripts(u, 1) AS unit, unnest(u) AS line
    FROM (SELECT doc_id, list_concat([replace(t, chr(10), ' ')], string_split(t, chr(10))) AS u FROM clean)),
words AS (SELECT doc_id, unit, regexp_extract_all(line, '[a-z0-9]+') AS w FROM units),
singles AS (
    SELECT doc_id, unit, len(w) - 1 AS n, unnest([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]) AS bigram
    FROM words WHERE len(w) BETWEEN 2 AND 400),
counted AS (SELECT doc_id, unit, n, bigram, count(*) AS here FROM singles GROUP BY ALL),
hits AS (
    SELECT doc_id, unit, licence, 2 * sum(least(here, times)) / any_value(n + template_size) AS dice
    FROM counted JOIN bigrams USING (bigram) JOIN templates USING (licence) GROUP BY doc_id, unit, licence),
best AS (
    SELECT doc_id, count(DISTINCT unit) AS n_units, max(dice) AS dice FROM hits WHERE dice >= 0.8 GROUP BY doc_id),
named AS (
    SELECT b.doc_id, any_value(b.n_units) AS n_units, any_value(b.dice) AS dice, min(h.licence) AS licence
    FROM best b JOIN hits h ON h.doc_id = b.doc_id AND h.dice = b.dice GROUP BY b.doc_id)
SELECT d.doc_id, coalesce(n_units, 0) AS n_units, licence, dice FROM documents d LEFT JOIN named n ON d.doc_id = n.doc_id
"""


@query("op1_licence_scan", _licence_sql())
def licence_scan(spark, folder):
    return licences.licence_scan(table(spark, folder, "documents")).withColumnRenamed("id", "doc_id")


@query("op1_licence_passages")
def licence_passages(spark, folder):
    return licences.licence_passage_scan(table(spark, folder, "documents")).withColumnRenamed("id", "doc_id")


@query("op2_run_index_dedup")
def run_index_dedup(spark, folder):
    rows = runindex.remove_repeats(table(spark, folder, "documents"))
    return rows.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept_bytes", 256).alias("kept_sha256"))


@query("op3_piece_ids")
def piece_ids(spark, folder):
    docs = table(spark, folder, "documents").withColumn("text_hash", F.xxhash64(F.replace(F.col("text"), F.lit(pieces.MARK), F.lit(" "))))
    rows = pieces.decode(pieces.encode(docs, PIECE_MODEL, keep=("text_hash",)), PIECE_MODEL)
    same = F.xxhash64("decoded") == F.col("text_hash")
    return rows.select(F.col("id").alias("doc_id"), F.size("ids").alias("n_pieces"), F.xxhash64("ids").alias("ids_hash"), same.alias("round_trip"))


WINNOW_SQL = r"""
WITH docs AS (
    SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM documents),
items AS (
    SELECT item_id::VARCHAR AS item, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM benchmark),
placed AS (SELECT item, w, least(len(w), 10) AS span, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS pos FROM items WHERE len(w) > 0),
windows AS (SELECT DISTINCT item, span, array_to_string(list_slice(w, pos, pos + span - 1), ' ') AS t FROM placed),
spans AS (SELECT DISTINCT span FROM windows),
starts AS (SELECT r, w, span, unnest(range(1, len(w) - span + 2)) AS pos FROM docs JOIN spans ON len(w) >= span),
here AS (SELECT r, span, pos, array_to_string(list_slice(w, pos, pos + span - 1), ' ') AS t FROM starts),
found AS (SELECT r, span, pos, item FROM here JOIN windows USING (span, t)),
hit AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(pos, pos + span)) AS p FROM found) GROUP BY r),
listed AS (
    SELECT r, count(item) AS n, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT r, item FROM found) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(hit.n, 0)::BIGINT AS n_hit, coalesce(listed.n, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit ON docs.r = hit.r LEFT JOIN listed ON docs.r = listed.r
"""


@query("op12_winnowed_overlap", WINNOW_SQL)
def winnowed_overlap(spark, folder):
    rows = winnow.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return rows.select(F.col("id").alias("doc_id"), "n_words", "n_hit", "n_items", "items_sha256", (F.col("n_hit") > 0).alias("contaminated"))


REPAIR_SQL = r"""
WITH RECURSIVE crc AS (
    SELECT list(c ORDER BY i) AS t FROM (
        SELECT i, list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
        FROM (SELECT unnest(range(256)) AS i))),
given AS (
    SELECT conv_id AS conv, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
           coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k
    FROM conversations),
summed AS (
    SELECT given.*, xor(list_reduce(list_concat([4294967295], list_transform(string_split(k, ''), lambda x: ascii(x)::BIGINT)),
               lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS kind
    FROM given, crc),
spoilt AS (
    SELECT conv, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
           CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
           unnest(CASE WHEN kind = 3 THEN [1, 2] ELSE [1] END) AS copy
    FROM summed WHERE kind != 0),
marked AS (
    SELECT conv, turn, role, text, role[1:1] AS initial,
           md5(coalesce('c' || conv::VARCHAR, 'n') || ':' || length(role) || ':' || role || ':' || text) AS same
    FROM spoilt),
placed AS (
    SELECT *, row_number() OVER w AS i, lag(initial) OVER w AS before
    FROM marked WINDOW w AS (PARTITION BY conv ORDER BY turn NULLS FIRST, role, same)),
counting AS (SELECT *, row_number() OVER (PARTITION BY conv, same ORDER BY i) AS nth FROM placed),
faulty AS (
    SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN nth > 1 THEN 'duplicate'
                   WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 'truncated' ELSE '' END AS fault
    FROM counting),
counted AS (
    SELECT conv, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
           count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
           count(*) FILTER (before || initial NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n,
           list({'x': initial, 'gone': fault IN ('blank', 'duplicate'), 'cut': CASE WHEN fault = 'truncated' THEN 1 ELSE 0 END, 'role': role, 'text': text}
                ORDER BY i) AS rows
    FROM faulty GROUP BY conv),
parsed AS (
    SELECT conv, 0 AS i, '0000000000' AS b, NULL::VARCHAR AS s, '0000000002I' AS u, '0000000004II' AS a FROM counted
    UNION ALL
    SELECT conv, i, b, s, u, least(a, printf('%010d', u[1:10]::INT + 2) || u[11:] || 'I')
    FROM (
        SELECT conv, i, b, s, a, least(u, printf('%010d', b[1:10]::INT + 2) || b[11:] || 'I', printf('%010d', s[1:10]::INT + 2) || s[11:] || 'I',
                                       printf('%010d', a[1:10]::INT + 2) || a[11:] || 'I') AS u
        FROM (
            SELECT conv, i, printf('%010d', b[1:10]::INT + 3) || b[11:] || 'D' AS b,
                   least(printf('%010d', s[1:10]::INT + 3) || s[11:] || 'D',
                         CASE WHEN NOT gone AND x = 's' THEN printf('%010d', b[1:10]::INT + cut) || b[11:] || 'K' END) AS s,
                   least(printf('%010d', u[1:10]::INT + 3) || u[11:] || 'D',
                         CASE WHEN NOT gone AND x = 'u' THEN least(printf('%010d', b[1:10]::INT + cut) || b[11:] || 'K',
                             printf('%010d', s[1:10]::INT + cut) || s[11:] || 'K', printf('%010d', a[1:10]::INT + cut) || a[11:] || 'K') END,
                         CASE WHEN NOT gone THEN least(printf('%010d', b[1:10]::INT + 2 + cut) || b[11:] || 'R',
                             printf('%010d', s[1:10]::INT + 2 + cut) || s[11:] || 'R', printf('%010d', a[1:10]::INT + 2 + cut) || a[11:] || 'R') END) AS u,
                   least(printf('%010d', a[1:10]::INT + 3) || a[11:] || 'D',
                         CASE WHEN NOT gone AND x = 'a' THEN printf('%010d', u[1:10]::INT + cut) || u[11:] || 'K' END,
                         CASE WHEN NOT gone THEN printf('%010d', u[1:10]::INT + 2 + cut) || u[11:] || 'R' END) AS a
            FROM (
                SELECT p.conv, p.i + 1 AS i, b, s, u, a, rows[p.i + 1].x AS x, rows[p.i + 1].gone AS gone, rows[p.i + 1].cut AS cut
                FROM parsed p JOIN counted c ON p.conv IS NOT DISTINCT FROM c.conv WHERE p.i < c.n)))),
chosen AS (
    SELECT c.*, least(b, a)[1:10]::BIGINT AS cost, least(b, a)[11:] AS audit
    FROM parsed p JOIN counted c ON p.conv IS NOT DISTINCT FROM c.conv WHERE p.i = c.n),
edited AS (
    SELECT conv, 0 AS k, 0 AS i, '' AS state, []::VARCHAR[] AS out FROM chosen
    UNION ALL
    SELECT conv, k, i, CASE WHEN e = 'D' THEN state ELSE role[1:1] END, CASE WHEN e = 'D' THEN out ELSE list_append(out, role || ':' || text) END
    FROM (
        SELECT q.conv, k + 1 AS k, CASE WHEN e = 'I' THEN i ELSE i + 1 END AS i, e, state, out,
               CASE WHEN e = 'K' THEN rows[i + 1].role WHEN state = 'u' THEN 'assistant' ELSE 'user' END AS role,
               CASE WHEN e = 'I' THEN '' ELSE rows[i + 1].text END AS text
        FROM (SELECT d.*, c.rows, c.audit[d.k + 1:d.k + 1] AS e FROM edited d JOIN chosen c ON d.conv IS NOT DISTINCT FROM c.conv WHERE d.k < length(c.audit)) q)),
done AS (SELECT d.conv, sha256(array_to_string(out, chr(10))) AS h FROM edited d JOIN chosen c ON d.conv IS NOT DISTINCT FROM c.conv WHERE k = length(audit))
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
       coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost,
       coalesce(audit, '') AS audit, coalesce(h, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN chosen c ON o.conv_id IS NOT DISTINCT FROM c.conv LEFT JOIN done ON o.conv_id IS NOT DISTINCT FROM done.conv
"""


@query("op13_conversation_repair", REPAIR_SQL)
def conversation_repair(spark, folder):
    rows = table(spark, folder, "conversations")
    fixed = repair.repair(repair.damaged(rows), rows.select(F.col("conv_id").alias("conv")))
    return fixed.withColumnRenamed("id", "conv_id")


@query("op11_token_alignment")
def token_alignment(spark, folder):
    found, _ = align.align(table(spark, folder, "documents"), BYTE_MODEL, PIECE_MODEL)
    return found.withColumnRenamed("id", "doc_id")
