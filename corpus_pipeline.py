"""The corpus pipeline: language, near duplicates, repeated passages, mixing, pieces.

Every stage takes the documents that the stage before kept and calls one operator of ``gridmill.llm`` on all of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gridmill.llm import bigru, mixing, pieces, runindex, simhash
from gridmill.llm.common import held_out, short_batches, staged
from gridmill.llm.queries import PIECE_MODEL


def _packed(docs: DataFrame) -> DataFrame:
    """The columns that operators read, and the other ones in a struct beside them, so that no name can clash with an operator's."""
    short_batches(docs.sparkSession)
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", "source", F.struct(F.lit(1).alias("_"), *rest).alias("_row"))


def _unpacked(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.select(*(F.col(c) if c in ("doc_id", "text") else F.col(f"_row.`{c}`").alias(c) for c in columns))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the operator rejects: those without a letter, null texts among them.

    Without a labelled document nothing is learned and every text is unknown; then only those without a letter go.
    """
    network = bigru.fit_languages(docs, ~held_out(F.col("doc_id")))
    found = bigru.predict_languages(_packed(docs), network, keep=("text", "_row")).withColumnRenamed("id", "doc_id")
    known = F.col("lang_pred") != bigru.UNKNOWN if network.languages else F.col("text").rlike(r"\p{L}")
    return _unpacked(found.where(known), docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the smallest id of each group of near duplicates.

    Null, empty and blank texts are one group.  Null ids count as larger than all others.  Of rows with equal id and text one stays, any of
    them where they differ in other columns.  Extra columns stay whatever their names; no rows in, no rows out.
    """
    return simhash.one_of_each(docs, words=3, radius=2)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut out every 50-byte string that an earlier document has; documents of which nothing is left go, null texts stay null."""
    packed = _packed(docs).withColumn("_null", F.col("text").isNull())
    cut = runindex.remove_repeats(packed, length=50, keep=("_row", "_null")).withColumnRenamed("id", "doc_id")
    cut = cut.where((F.col("n_removed") == 0) | (F.col("kept_text") != "")).withColumn("text", F.when(~F.col("_null"), F.col("kept_text")))
    return _unpacked(cut.withColumn("_row", F.col("_row").withField("n_chars", F.length("text").cast("long"))), docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Emit each document as often as the mix of sources takes it.

    A source without words gives nothing; in other sources a document without words (null text among them) is mixed like any other.  A null
    source is a source of its own, repeated rows are mixed each on its own.  Extra columns stay whatever their names; no rows in, no rows out.
    """
    mixed = mixing.mix(_packed(docs), carry=("text", "_row")).withColumnRenamed("id", "doc_id").where("copies > 0")
    return _unpacked(mixed.withColumn("_nth", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))), docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document: doc_id, lang, source, n_pieces, ids.

    An empty text has no ids, a null text null; repeated rows repeat.  Other columns are not returned.
    """
    rows = pieces.encode(_packed(docs), PIECE_MODEL, keep=("_row",))
    return rows.select(F.col("id").alias("doc_id"), F.col("_row.lang").alias("lang"), F.col("_row.source").alias("source"),
                       F.size("ids").alias("n_pieces"), "ids")


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("mixture", mixture),
          ("tokens", tokens)]

ORACLE_SQL = None  # the network, the fingerprints and the piece lattice have no SQL form


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder; what a stage returns is written and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
