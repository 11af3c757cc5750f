"""Operators that follow row order, split so that no task sees a whole key or table.

The order column is a unique integer position.  Gaps are fine, but the numbers
should roughly fill their range, as the table of runs has one row per ``chunk``
positions; ``assign_positions`` makes such a column from any order.  Rows are cut
into runs of ``chunk`` positions, which bounds the rows of every window.  What a
run needs from earlier runs (a last value, an open streak, a row count) is one
row per run, carried across runs by a window over that small table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from gridmill.session import cut_lineage

CHUNK = 1_000_000
_RUN = "_run"


def _run(position: str, chunk: int) -> Column:
    return F.call_function("div", F.col(position).cast("bigint"), F.lit(chunk).cast("bigint"))


def _group(keys: list[str]) -> Column:
    """Key and run as one never-null value: null keys compare equal, and the
    join back reuses the partitioning of the window."""
    return F.struct(*keys, _RUN) if keys else F.col(_RUN)


def _attach(df: DataFrame, side: DataFrame, keys: list[str]) -> DataFrame:
    """Left join on keys that may be null, keeping one copy of them."""
    side = side.select(F.struct(*keys).alias("_right"), *[c for c in side.columns if c not in keys])
    return df.join(side, F.struct(*keys) == F.col("_right"), "left").drop("_right")


def assign_positions(df: DataFrame, order_by: list, name: str = "row_number") -> DataFrame:
    """Positions 1..n in the given order, for any sortable columns.

    The sorted rows are written to the checkpoint folder once, so that a
    recomputed task cannot move rows between partitions; then a table with one
    row per partition supplies the offsets.
    """
    return number_partitions(cut_lineage(df.orderBy(*order_by)), name)


def number_partitions(df: DataFrame, name: str = "row_number") -> DataFrame:
    """Positions 1..n in partition order; the partitions must be the same on every evaluation."""
    mark = F.monotonically_increasing_id()
    tagged = df.withColumn("_mark", mark)
    part = F.shiftright(F.col("_mark"), 33)
    counts = tagged.select(part.alias("_part")).groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inner = F.col("_mark") - F.shiftleft(F.col("_part"), 33)
    # one row per partition, so the offsets can always be broadcast
    return (tagged.withColumn("_part", part).join(F.broadcast(offsets), "_part")
            .withColumn(name, F.col("_offset") + inner + 1).drop("_part", "_offset", "_mark"))


def dense_positions(df: DataFrame, position: str, name: str = "row_number", chunk: int = CHUNK) -> DataFrame:
    """Positions 1..n from a unique integer column with gaps, without a global sort."""
    tagged = df.withColumn(_RUN, _run(position, chunk))
    counts = tagged.groupBy(_RUN).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy(_RUN).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(_RUN, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    within = F.row_number().over(Window.partitionBy(_RUN).orderBy(position))
    return (tagged.withColumn("_in", within).join(offsets, _RUN)
            .withColumn(name, F.col("_offset") + F.col("_in")).drop(_RUN, "_in", "_offset"))


def sorted_runs(df: DataFrame, keys: list[str], order_by: list, chunk: int = CHUNK) -> DataFrame:
    """Add ``_g``, a struct of the keys and a run of at most ``chunk`` neighbouring rows in the order of keys and columns.

    Rows are sorted by range over keys *and* order, so a key with most of the rows lies in many partitions; they are written to the
    checkpoint folder once, so that a recomputed task cannot move rows between runs.
    """
    placed = cut_lineage(df.orderBy(*keys, *order_by)).withColumn("_mark", F.monotonically_increasing_id())
    return placed.withColumn("_g", F.struct(*keys, _run("_mark", chunk).alias(_RUN))).drop("_mark")


def sorted_bin(df: DataFrame, order_by: list, skip: int, limit: int) -> DataFrame:
    """Rows ``skip + 1`` to ``skip + limit`` in the given order; only the bins that hold them are sorted.

    Bins are the partitions of a cut by range, written to the checkpoint folder; their number is Spark's shuffle partitions.
    """
    bins = cut_lineage(df.repartitionByRange(*order_by)).withColumn("_bin", F.shiftright(F.monotonically_increasing_id(), 33))
    upto = 0
    first = before = None
    # one row per partition
    for at, n in sorted(tuple(r) for r in bins.groupBy("_bin").count().collect()):
        if first is None and upto + n > skip:
            first, before = at, upto
        upto += n
        if upto >= skip + limit:
            break
    if first is None:
        return df.limit(0)
    held = bins.filter(F.col("_bin").between(first, at)).drop("_bin")
    return held.orderBy(*order_by).offset(skip - before).limit(limit)


def _carried(df: DataFrame, values: dict[str, Column], position: str, keys: list[str], forward: bool,
             chunk: int) -> DataFrame:
    """Add ``alias`` = nearest non-null of each value at or before (after) the row."""
    tagged = df.withColumn(_RUN, _run(position, chunk))
    for alias, value in values.items():
        tagged = tagged.withColumn(f"_v_{alias}", value)
    tagged = tagged.withColumn("_g", _group(keys))
    pick = F.max_by if forward else F.min_by
    edges = tagged.groupBy("_g").agg(F.first(_RUN).alias(_RUN), *[F.first(k).alias(k) for k in keys], *[
        pick(F.col(f"_v_{a}"), F.when(F.col(f"_v_{a}").isNotNull(), F.col(position))).alias(f"_e_{a}") for a in values
    ])
    # Backward is forward in descending order: a frame that grows from the start is
    # linear, while Spark evaluates one that ends at the last row anew for every row.
    toward = F.asc if forward else F.desc
    runs = Window.partitionBy(*keys).orderBy(toward(_RUN)).rowsBetween(Window.unboundedPreceding, -1)
    rows = Window.partitionBy("_g").orderBy(toward(position)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edges = edges.select("_g", *[F.last(f"_e_{a}", ignorenulls=True).over(runs).alias(f"_c_{a}") for a in values])
    for a in values:
        tagged = tagged.withColumn(f"_l_{a}", F.last(f"_v_{a}", ignorenulls=True).over(rows))
    out = tagged.join(edges, "_g", "left")
    for a in values:
        out = out.withColumn(a, F.coalesce(f"_l_{a}", f"_c_{a}"))
    return out.drop(_RUN, "_g", *[f"_{p}_{a}" for a in values for p in "vlc"])


def fill_forward(df: DataFrame, columns: list[str], position: str, keys: list[str] | None = None,
                 chunk: int = CHUNK) -> DataFrame:
    return _carried(df, {c: F.col(c) for c in columns}, position, keys or [], True, chunk).select(*df.columns)


def fill_backward(df: DataFrame, columns: list[str], position: str, keys: list[str] | None = None,
                  chunk: int = CHUNK) -> DataFrame:
    return _carried(df, {c: F.col(c) for c in columns}, position, keys or [], False, chunk).select(*df.columns)


def interpolate(df: DataFrame, columns: list[str], position: str, keys: list[str] | None = None,
                chunk: int = CHUNK, dense: bool = True) -> DataFrame:
    """Linear by row position; leading gaps stay null, trailing gaps take the last value.

    With ``dense=False`` positions may have gaps and rows count as equally spaced.
    """
    keys, at = keys or [], position
    if not dense:
        df, at = dense_positions(df, position, "_at", chunk), "_at"
    known = {c: F.when(F.col(c).isNotNull(), F.struct(F.col(at).alias("p"), F.col(c).cast("double").alias("v")))
             for c in columns}
    out = _carried(df, {f"_prev_{c}": v for c, v in known.items()}, at, keys, True, chunk)
    out = _carried(out, {f"_next_{c}": v for c, v in known.items()}, at, keys, False, chunk)
    for c in columns:
        prev, nxt = F.col(f"_prev_{c}"), F.col(f"_next_{c}")
        step = (nxt["v"] - prev["v"]) * F.try_divide(F.col(at) - prev["p"], nxt["p"] - prev["p"])
        out = out.withColumn(c, F.when(F.col(c).isNotNull(), F.col(c).cast("double"))
                             .when(nxt.isNull(), prev["v"]).otherwise(prev["v"] + step))
    return out.select(*[c for c in df.columns if c != "_at"])


def failure_streak(df: DataFrame, key: str, position: str, failed: Column, healthy_below: int = 10,
                   disable_at: int = 20, chunk: int = CHUNK, carry: DataFrame | None = None) -> DataFrame:
    """Consecutive failures up to each row of a key, reset by a success.

    ``carry`` (key, open_streak) continues streaks from earlier data.
    """
    flagged = df.withColumn("_f", failed.cast("int")).withColumn(_RUN, _run(position, chunk))
    flagged = flagged.withColumn("_g", _group([key]))
    rows = Window.partitionBy("_g").orderBy(position).rowsBetween(Window.unboundedPreceding, 0)
    local = flagged.withColumn("_t", F.sum("_f").over(rows)).withColumn(
        "_base", F.last(F.when(F.col("_f") == 0, F.col("_t")), ignorenulls=True).over(rows))
    # per run: failures after its last success, or all of them when it has none
    runs = local.groupBy("_g").agg(
        F.first(key).alias("_key"), F.first(_RUN).alias(_RUN), F.min("_f").alias("_least"),
        F.max_by(F.col("_t") - F.coalesce("_base", F.lit(0)), position).alias("_tail"))
    order = Window.partitionBy("_key").orderBy(_RUN)
    upto, before = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(-1, -1)
    runs = runs.withColumn("_s", F.sum("_tail").over(upto))
    runs = runs.withColumn("_b", F.last(F.when(F.col("_least") == 0, F.col("_s") - F.col("_tail")),
                                        ignorenulls=True).over(upto))
    runs = runs.withColumn("_in", F.last(F.col("_s") - F.coalesce("_b", F.lit(0))).over(before))
    # no success in any earlier run: an open streak from earlier data still counts
    runs = runs.withColumn("_fresh", F.last("_b").over(before).isNull())
    out = local.join(runs.select("_g", "_in", "_fresh"), "_g", "left")
    open_streak = F.lit(0)
    if carry is not None:
        out = _attach(out, carry.select(key, F.col("open_streak").alias("_open")), [key])
        open_streak = F.when(F.col("_fresh"), F.coalesce("_open", F.lit(0))).otherwise(0)
    carried = F.coalesce("_in", F.lit(0)) + open_streak
    streak = F.when(F.col("_base").isNotNull(), F.col("_t") - F.col("_base")).otherwise(F.col("_t") + carried)
    return out.withColumn("failure_count", streak.cast("bigint")).select(
        *df.columns, "failure_count",
        (F.col("failure_count") < healthy_below).alias("is_healthy"),
        (F.col("failure_count") >= disable_at).alias("auto_disable"))


def rate_window(df: DataFrame, key: str, micros: str, window_seconds: int, limit: int, chunk: int = CHUNK) -> DataFrame:
    """Requests of the same key in the open window before each row, and whether the row is allowed.

    Each row enters at its time and leaves one window later, so the count is a running sum that costs the same for any number of rows
    in the window.  The moves of a key are cut into runs of at most ``chunk`` rows, however many of them share a day or a moment; what
    a run needs from earlier ones is their sum, less the moves at the run's own first moment.  Rows without a time have no window: 0.
    """
    width = window_seconds * 1_000_000
    t = F.col(micros)
    # at equal times leaving (even) comes before entering (odd)
    moves = [F.struct(at.alias("_at"), F.lit(step).alias("_step"), F.lit(kept).alias("_row"))
             for at, step, kept in ((t * 2 + 1, 1, True), ((t + width) * 2, -1, False))]
    # without a time: a row that is counted nowhere
    untimed = F.struct(F.lit(None).cast("bigint").alias("_at"), F.lit(0).alias("_step"), F.lit(True).alias("_row"))
    spread = df.withColumn("_m", F.explode(F.when(t.isNull(), F.array(untimed)).otherwise(F.array(*moves))))
    spread = spread.select(F.col(key).alias("_key"), "_m.*", *[F.when(F.col("_m._row"), F.col(c)).alias(c) for c in df.columns])
    runs = sorted_runs(spread, ["_key"], ["_at"], chunk)
    totals = runs.groupBy("_g", "_at").agg(F.sum("_step").alias("_step")).groupBy("_g").agg(
        F.sum("_step").alias("_sum"), F.max("_at").alias("_last"), F.max_by("_step", "_at").alias("_tie"))
    order = Window.partitionBy("_g._key").orderBy(f"_g.{_RUN}")
    ties = Window.partitionBy("_g._key", "_last").orderBy(f"_g.{_RUN}").rowsBetween(Window.unboundedPreceding, 0)
    totals = totals.withColumn("_tie", F.sum("_tie").over(ties)).select(
        "_g", F.coalesce(F.sum("_sum").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
        F.lag("_last").over(order).alias("_last"), F.lag("_tie").over(order).alias("_tie"))
    earlier = Window.partitionBy("_g").orderBy("_at").rangeBetween(Window.unboundedPreceding, -1)
    inside = runs.withColumn("_in", F.coalesce(F.sum("_step").over(earlier), F.lit(0))).filter("_row").join(totals, "_g")
    tied = F.when(F.col("_at") == F.col("_last"), F.col("_tie")).otherwise(0)
    count = F.when(F.col("_at").isNull(), 0).otherwise(F.col("_before") + F.col("_in") - tied).cast("bigint")
    counted = inside.withColumn("current_count", count)
    return counted.select(
        *df.columns, "current_count", (F.col("current_count") < limit).alias("is_allowed"),
        F.greatest(F.lit(0), limit - F.col("current_count") - 1).cast("bigint").alias("remaining"),
        F.floor((F.col(micros) + width) / 1_000_000).alias("reset_time"))


def preview_outliers(df: DataFrame, column: str, keys: list[str] | None = None) -> DataFrame:
    """Flag values more than three population deviations from the mean of their group (of 3 or more)."""
    c = F.col(column)
    stats = [F.avg(c).alias("_m"), F.stddev_pop(c).alias("_sd"), F.count(c).alias("_n")]
    if keys:
        out = _attach(df, df.groupBy(*keys).agg(*stats), keys)
    else:
        one = df.agg(*stats).select(F.struct("_m", "_sd", "_n").alias("s")).scalar()
        out = df.withColumn("_stats", one).select("*", "_stats.*").drop("_stats")
    flag = (F.col("_n") >= 3) & (F.abs(c - F.col("_m")) > 3 * F.col("_sd"))
    return out.withColumn("is_outlier", F.coalesce(flag, F.lit(False))).drop("_m", "_sd", "_n")
