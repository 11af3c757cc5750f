"""Exact percentiles (linear interpolation) that spread over the cluster."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from gridmill.session import written

BINS_PER_OCTAVE = 64
FINE_BINS = 4096


def percentile_table(df: DataFrame, value: str, probs: list[float], keys: list[str] | None = None) -> DataFrame:
    """``keys..., p, value`` for each probability; null values and NaN are ignored.

    Values are counted and written first, so equal ones are one row from there on and no row is read again.  Then a rank is narrowed down in three steps, each a count per bin and a
    running sum over the bins of one group:

    1. bins by magnitude, a fixed number per doubling;
    2. equal-width bins between the least and the largest value of the bin that holds the rank;
    3. the values of that narrow bin.

    The bins only decide where a value is looked for, not what the answer is.  No buffer holds the values of a group.
    """
    keys = keys or []
    group = [*keys, "_all"]  # a key that is always present lets keyed and global percentiles share one plan
    rows = df.select(*keys, F.lit(0).alias("_all"), F.col(value).cast("double").alias("_v")).filter(F.col("_v").isNotNull() & ~F.isnan("_v"))
    size = F.abs("_v")
    # clamped where the logarithm has no value (0) or is infinite; it never falls as the value grows
    octave = F.floor(F.log2(F.greatest(F.least(size, F.lit(1.7e308)), F.lit(1e-300))) * BINS_PER_OCTAVE) + 1_000_000
    counted = written(rows.groupBy(*group, "_v").agg(F.count(F.lit(1)).alias("_c")), "counted").withColumn(
        "_b", F.when(F.col("_v") > 0, octave).when(F.col("_v") < 0, -octave).otherwise(F.lit(0)).cast("bigint"))

    spot = F.col("_w.p") * (F.col("_n") - 1)
    wanted = F.explode(F.array(*[F.struct(F.lit(float(p)).alias("p")) for p in dict.fromkeys(probs)]))
    coarse = counted.groupBy(*group, "_b").agg(F.sum("_c").alias("_c"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    hits = (_running(coarse, group, "_b").withColumn("_n", F.sum("_c").over(Window.partitionBy(*group)))
            .select("*", wanted.alias("_w")).withColumn("_spot", spot)
            .withColumn("_rank", F.explode(F.array_distinct(F.array(F.floor("_spot"), F.ceil("_spot")))))
            .filter((F.col("_rank") >= F.col("_start")) & (F.col("_rank") < F.col("_end")))
            .select(*group, "_b", "_lo", "_hi", F.col("_w.p").alias("p"), "_spot", (F.col("_rank") - F.col("_start")).alias("_rank")))

    bins = hits.select(*group, "_b", "_lo", "_hi").distinct()
    fine = _match(counted, bins, [*group, "_b"]).withColumn("_f", _fine_bin())
    ladder = _running(fine.groupBy(*group, "_b", "_f").agg(F.sum("_c").alias("_c")), [*group, "_b"], "_f")
    hits = _within(hits, ladder, [*group, "_b"])

    slices = hits.select(*group, "_b", "_lo", "_hi", F.col("_f").alias("_g")).distinct()
    inside = _match(counted, slices, [*group, "_b"]).filter(_fine_bin() == F.col("_g")).select(*group, "_b", F.col("_g").alias("_f"), "_v", "_c")
    found = _within(hits, _running(inside, [*group, "_b", "_f"], "_v"), [*group, "_b", "_f"])
    low, high = F.min("_v"), F.max("_v")
    share = F.max("_spot") - F.floor(F.max("_spot"))
    return found.groupBy(*group, "p").agg((low + (high - low) * share).alias("value")).drop("_all")


def _fine_bin() -> Column:
    share = F.try_divide(F.col("_v") - F.col("_lo"), F.col("_hi") - F.col("_lo"))
    return F.least(F.floor(F.coalesce(share, F.lit(0.0)) * FINE_BINS), F.lit(FINE_BINS - 1))


def _running(counts: DataFrame, group: list[str], order: str) -> DataFrame:
    """Ranks that each row covers in its group: from ``_start``, before ``_end``."""
    upto = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return counts.withColumn("_end", F.sum("_c").over(upto)).withColumn("_start", F.col("_end") - F.col("_c"))


def _within(hits: DataFrame, ladder: DataFrame, group: list[str]) -> DataFrame:
    """The row of the ladder that covers each hit's rank, which becomes a rank inside that row."""
    found = _match(hits, ladder.drop("_c"), group).filter((F.col("_rank") >= F.col("_start")) & (F.col("_rank") < F.col("_end")))
    return found.withColumn("_rank", F.col("_rank") - F.col("_start")).drop("_start", "_end")


def _match(left: DataFrame, right: DataFrame, names: list[str]) -> DataFrame:
    """Join on keys that may be null; a struct of them is never null itself."""
    right = right.select(F.struct(*names).alias("_right"), *[c for c in right.columns if c not in names])
    return left.join(right, F.struct(*names) == F.col("_right")).drop("_right")


def percentiles_by_column(df: DataFrame, columns: dict[str, Column], probs: list[float]) -> dict[tuple[str, float], float | None]:
    """The percentiles of some numeric expressions, by name and probability; None where there is no value.  Nulls and NaN are ignored.

    The values are written once; see ``Ranks``.
    """
    return Ranks(df, columns).percentiles(probs)


class Ranks:
    """Order statistics of a few named columns.  Their values are written once, without a shuffle.

    Each round is one aggregate over the written values, whose counts per bin come to the driver: first bins by magnitude, then ``FINE_BINS`` bins of
    equal width (and one for each bound) inside each bin that holds a wanted rank, until all values of such a bin are equal.  The least and the largest value of a bin
    are its bounds, so a round narrows the range by a factor of ``FINE_BINS`` at least; the number of bins does not depend on the rows.
    """

    def __init__(self, df: DataFrame, columns: dict[str, Column]):
        self.names = list(columns)
        narrow = df.select(*[c.cast("double").alias(f"x{i}") for i, c in enumerate(columns.values())])
        self.values = written(narrow, "values")

    def percentiles(self, probs: list[float], away_from: dict[str, float] | None = None) -> dict[tuple[str, float], float | None]:
        """Percentiles of the values, or of their distances from a centre per column (columns without one are left out)."""
        chosen = [(i, n) for i, n in enumerate(self.names) if away_from is None or away_from.get(n) is not None]
        wanted = list(dict.fromkeys(float(p) for p in probs))
        out: dict[tuple[str, float], float | None] = {(n, p): None for n in self.names for p in wanted}
        if not chosen:
            return out
        x = {i: F.col(f"x{i}") if away_from is None else F.abs(F.col(f"x{i}") - F.lit(float(away_from[n]))) for i, n in chosen}
        long = self.values.select(F.inline(F.array(*[F.struct(F.lit(i).alias("c"), v.alias("v")) for i, v in x.items()])))
        long = long.filter(F.col("v").isNotNull() & ~F.isnan("v"))
        size = F.abs("v")
        # clamped where the logarithm has no value (0) or is infinite; it never falls as the value grows
        octave = F.floor(F.log2(F.greatest(F.least(size, F.lit(1.7e308)), F.lit(1e-300))) * BINS_PER_OCTAVE) + 1_000_000
        bins = _counted(long.withColumn("b", F.when(F.col("v") > 0, octave).when(F.col("v") < 0, -octave).otherwise(F.lit(0)).cast("bigint")), ["c"])
        sizes = {i: sum(r["n"] for r in bins.get((i,), [])) for i, _ in chosen}
        # (column, rank) -> bounds, and the rank among the values between them
        open_ = {(i, rank): _rung(bins[i,], rank) for i, n in sizes.items() if n
                 for rank in {f(p * (n - 1)) for p in wanted for f in (math.floor, math.ceil)}}
        found: dict[tuple, float] = {}
        while open_:
            found |= {k: low for k, (low, high, _) in open_.items() if low == high}
            open_ = {k: x for k, x in open_.items() if x[0] != x[1]}
            if not open_:
                break
            ranges = sorted({(i, low, high) for (i, _), (low, high, _) in open_.items()})
            table = long.sparkSession.createDataFrame([(t, *r) for t, r in enumerate(ranges)], "t int, c int, low double, high double")
            inside = long.join(F.broadcast(table), "c").filter(F.col("v").between(F.col("low"), F.col("high")))  # a few rows a column
            # halved before they are subtracted: the distance of two doubles may have no value
            share = (F.col("v") / 2 - F.col("low") / 2) / (F.col("high") / 2 - F.col("low") / 2)
            fine = F.when(F.col("v") == F.col("high"), FINE_BINS).when(F.col("v") == F.col("low"), -1).otherwise(F.least(F.floor(share * FINE_BINS), F.lit(FINE_BINS - 1)))
            bins = _counted(inside.withColumn("b", fine.cast("bigint")), ["t"])
            number = {r: t for t, r in enumerate(ranges)}
            open_ = {(i, rank): _rung(bins[(number[i, low, high],)], left) for (i, rank), (low, high, left) in open_.items()}
        for i, name in chosen:
            for p in wanted if sizes[i] else ():
                spot = p * (sizes[i] - 1)
                low, high = found[i, math.floor(spot)], found[i, math.ceil(spot)]
                out[name, p] = low if low == high else low + (high - low) * (spot - math.floor(spot))
        return out


def _counted(rows: DataFrame, group: list[str]) -> dict[tuple, list]:
    """Per group its bins ``b`` in order, with their number of values and least and largest value; bins are few."""
    out: dict[tuple, list] = {}
    found = rows.groupBy(*group, "b").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).collect()
    for r in sorted(found, key=lambda r: r["b"]):
        out.setdefault(tuple(r[g] for g in group), []).append(r)
    return out


def _rung(ladder: list, rank: int) -> tuple[float, float, int]:
    """Bounds of the bin that holds a rank, and the rank inside it."""
    for r in ladder:
        if rank < r["n"]:
            return r["low"], r["high"], rank
        rank -= r["n"]
    raise ValueError("rank beyond the values")


def percentile_columns(df: DataFrame, wanted: dict[str, tuple[Column, float]]) -> DataFrame:
    """One row with each alias holding the percentile of a numeric expression."""
    by_expr: dict[str, Column] = {}
    for expr, _ in wanted.values():
        by_expr.setdefault(str(expr), expr)
    found = percentiles_by_column(df, by_expr, sorted({p for _, p in wanted.values()}))
    return one_row(df, {alias: found[str(expr), float(p)] for alias, (expr, p) in wanted.items()})


def percentile_rows(df: DataFrame, columns: dict[str, Column], probs: list[float]) -> DataFrame:
    """``column, p, value`` for named expressions: a table of a few rows."""
    found = percentiles_by_column(df, columns, probs)
    return df.sparkSession.createDataFrame([(n, p, v) for (n, p), v in found.items() if v is not None], "column string, p double, value double")


def median_deviation(df: DataFrame, x: Column) -> DataFrame:
    """One row: ``center``, the median, and ``mad``, the median distance from it, both from the same written values."""
    ranks = Ranks(df, {"x": x})
    center = ranks.percentiles([0.5])["x", 0.5]
    return one_row(df, {"center": center, "mad": ranks.percentiles([0.5], {"x": center})["x", 0.5]})


def one_row(df: DataFrame, values: dict[str, float | None]) -> DataFrame:
    """Numbers as a table, which plans take for literals."""
    return df.sparkSession.createDataFrame([tuple(values.values())], ", ".join(f"`{n}` double" for n in values))
