"""Mix sources to target weights by systematic sampling, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from gridmill.llm.common import WORD, kept_as

ROWS_PER_GROUP = 200_000


def source_targets(sizes: DataFrame, weights=(3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """Target size per source: shares by weight, filled up to ``cap`` times the source's size.

    ``sizes`` has ``source`` and ``source_size``, one row per source (null is a source).  Sources take the weights in turn by code
    point, null last.  A source whose share is above its cap stops there and the excess goes to the others by weight: with the
    sources ordered by cap per weight, the level is (total - caps before) / (weights from here on) at the first source that
    does not reach its cap.  The windows run over one row per source.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(by_name) - 1) % len(weights) + 1)
    everything = Window.partitionBy()
    filling = Window.orderBy("_ratio", "_weight", F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    size = F.col("source_size")
    ranked = sizes.withColumn("_weight", weight).withColumn("_ratio", size * F.lit(float(cap)) / F.col("_weight"))
    level = (F.sum("source_size").over(everything) * F.lit(float(share))
             - F.coalesce(F.sum("source_size").over(filling), F.lit(0)) * F.lit(float(cap))) / (
        F.sum("_weight").over(everything) - F.coalesce(F.sum("_weight").over(filling), F.lit(0)))
    leveled = ranked.withColumn("_level", level)
    reached = F.max(F.when(F.col("_level") <= F.col("_ratio"), F.col("_level"))).over(everything)
    target = F.when(reached < F.col("_ratio"), F.col("_weight") * reached).otherwise(size * F.lit(float(cap)))
    return leveled.select("source", "source_size", target.alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=(3, 1, 2),
        share: float = 1.5, cap: float = 2.0, seed: str = "mix", carry: tuple[str, ...] = ()) -> DataFrame:
    """How many copies of each document the mix takes.

    Every document of a source expects target / source_size copies.  Documents stand in a fixed order (size class, then a digest of the
    id), which spreads the picks over all lengths; the expected copies are summed along it from one random offset per source, and a
    document is taken once for each integer that its sum crosses.

    The prefix sum has two levels, so that no source is one group: rows are numbered inside (source, size class, digest prefix)
    groups of a bounded size, and those groups' counts are summed per source.  The prefix follows the order, so its length, which
    grows with the row count, changes no result.

    Returns one row per row of ``docs``: id, source, size, source_size, target, copies, taken, and the columns in ``carry`` (``_kept`` is added to names that clash).  Null texts
    have size 0, a null source is a source of its own, a source without words has target 0 and gives no copies.  Rows that share
    an id are ordered by their text, so equal rows can stand in either place.  No rows in, no rows out.
    """
    text = F.col(text_col)
    size = F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.select(
        F.col(id_col).alias("id"), F.col(source_col).alias("source"), size.alias("size"), F.xxhash64(text_col).alias("_text"),
        F.struct(*carry).alias("_carry") if carry else F.lit(None).cast("int").alias("_carry"))
    rows = rows.withColumns({
        "_source": F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")),
        "_class": F.col("size") - F.col("size") % F.expr("shiftleft(1L, cast(greatest(length(bin(size)) - 3, 0) as int))"),
        "_digest": F.coalesce(F.md5(F.col("id").cast("string").cast("binary")), F.lit("~"))})
    total, digits = docs.count(), 1
    while total > ROWS_PER_GROUP * 16 ** digits:
        digits += 1
    rows = rows.withColumn("_prefix", F.substring("_digest", 1, digits))
    group = ["_source", "_class", "_prefix"]
    counts = rows.groupBy(*group).agg(
        F.count(F.lit(1)).alias("_n"), F.sum("size").alias("_words"), F.first("source").alias("source"))
    before = Window.partitionBy("_source").orderBy("_class", "_prefix").rowsBetween(Window.unboundedPreceding, -1)
    placed = counts.select(*group, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    sizes = counts.groupBy("_source").agg(F.first("source").alias("source"), F.sum("_words").alias("source_size"))
    targets = source_targets(sizes.select("source", "source_size"), weights, share, cap).select(
        F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")).alias("_source"), "source_size", "target")
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), "_source").cast("binary")), 1, 4), 16, 10).cast("double") / 65536
    plan = placed.join(targets, "_source").withColumns({
        "_offset": offset, "_rate": F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)})
    place = F.row_number().over(Window.partitionBy(*group).orderBy("_digest", "id", "_text")) + F.col("_before")
    crossed = F.floor(F.col("_offset") + F.col("_rate") * place) - F.floor(F.col("_offset") + F.col("_rate") * (place - 1))
    out = rows.join(plan, group).withColumn("copies", crossed)
    columns = ["id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken")]
    names = ["id", "source", "size", "source_size", "target", "copies", "taken"]
    return out.select(*columns, *([F.col(f"_carry.{c}").alias(kept_as(c, names)) for c in carry]))
