"""JSON payload tables to rows, with rejects."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def payload_rows(df: DataFrame, payload: str, keep: list[str]) -> tuple[DataFrame, DataFrame]:
    """``keep..., item, record`` for every row in a payload, and ``keep..., reason`` for rejects.

    The ``data`` field counts if the payload has one, else the payload itself;
    an object is one row, an array one row per element.
    """
    # steps of their own: Catalyst keeps a column that is read twice and computes it once;
    # back to text through the variant, so that a quoted text never looks like an object
    staged = df.withColumn("_doc", F.try_parse_json(F.col(payload))).withColumn(
        "_inner", F.to_json(F.try_variant_get(F.col("_doc"), "$.data", "variant")))
    own = F.col("_inner").isNotNull() & (F.col("_inner") != "null")
    tagged = staged.select(*keep, F.col("_doc").isNotNull().alias("_valid"),
                           F.when(own, F.col("_inner")).otherwise(F.to_json(F.col("_doc"))).alias("_data"))
    d = F.col("_data")
    items = F.when(d.startswith("{"), F.array(d)).when(d.startswith("["), F.from_json(d, "array<string>"))
    judged = tagged.withColumn("_items", items).withColumn(
        "reason", F.when(~F.col("_valid"), "not json").when(F.col("_items").isNull(), "no object or array")
        .when((F.size("_items") == 0) | (d == "{}"), "empty")
        .when(F.exists("_items", lambda x: x.isNull() | ~F.trim(x).startswith("{")), "element is no object"))
    good = judged.filter(F.col("reason").isNull())
    rows = good.select(*keep, F.posexplode("_items").alias("item", "record"))
    return rows, judged.filter(F.col("reason").isNotNull()).select(*keep, "reason")


def payload_fields(rows: DataFrame, fields: dict[str, str], record: str = "record") -> DataFrame:
    """Typed columns from a JSON record: ``{column: type}``; a value of another type reads as null."""
    others = [c for c in rows.columns if c != record]
    return rows.select(*others, *[F.get_json_object(record, f"$.{n}").try_cast(t).alias(n) for n, t in fields.items()])
