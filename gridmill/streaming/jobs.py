"""Streaming jobs.  Each has a batch operator with the same results on ordered input.

Keyed state that needs row order (streaks, rate windows) is kept as a table:
every micro-batch runs the batch operator, which splits hot keys, together with
the state left by the batch before.  State is written per batch id under the
shared folder, so a repeated batch overwrites its own output and no other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from gridmill.operators.ordered import failure_streak, rate_window
from gridmill.sources.payloads import payload_rows


def read_stream(spark: SparkSession, path: str, schema, kind: str = "parquet", glob: str | None = None,
                files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.format(kind).load(path)


def run_available(query: StreamingQuery) -> None:
    """Wait for an availableNow query and raise its error, if any."""
    query.awaitTermination()
    if query.exception():
        raise query.exception()


def land_payloads(stream: DataFrame, payload: str, keep: list[str], rows_path: str, rejects_path: str,
                  checkpoint: str) -> StreamingQuery:
    """Append payload rows and rejects to two tables."""
    def write(batch: DataFrame, batch_id: int) -> None:
        rows, rejects = payload_rows(batch, payload, keep)
        rows.write.mode("overwrite").parquet(f"{rows_path}/batch={batch_id}")
        rejects.write.mode("overwrite").parquet(f"{rejects_path}/batch={batch_id}")

    return (stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def tumbling(stream: DataFrame, ts: str, width: str, late: str, metrics: dict[str, Column],
             keys: list[str] | None = None) -> DataFrame:
    """``window_start, keys..., metrics...`` per tumbling window; rows later than the watermark drop out."""
    marked = stream.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    grouped = marked.groupBy(F.window("_ts", width).alias("_w"), *(keys or []))
    out = grouped.agg(*[c.alias(n) for n, c in metrics.items()])
    return out.select(F.col("_w.start").cast("timestamp_ntz").alias("window_start"), *(keys or []), *metrics)


def write_updates(aggregated: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write the changed groups of every batch; ``latest_updates`` reads the current state."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return (aggregated.writeStream.outputMode("update").foreachBatch(write)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def latest_updates(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    df = spark.read.parquet(path)
    rest = [c for c in df.columns if c not in (*keys, "batch")]
    newest = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_r"))
    return newest.select(*keys, *[F.col("_r")[c].alias(c) for c in rest])


def dedup(stream: DataFrame, keys: list[str], ts: str, late: str) -> DataFrame:
    """First row of each key within the watermark."""
    marked = stream.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    return marked.dropDuplicatesWithinWatermark(keys).drop("_ts")


def enrich(stream: DataFrame, table: DataFrame, on: str, how: str = "left") -> DataFrame:
    """Stream-static join: ``left`` looks up, ``left_semi`` checks, ``inner`` filters."""
    return stream.join(table, on, how)


def append(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    return (stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
            .outputMode("append").trigger(availableNow=True).start())


def _state(spark: SparkSession, path: str, batch_id: int) -> DataFrame | None:
    return spark.read.parquet(f"{path}/batch={batch_id - 1}") if batch_id > 0 else None


def streaks(stream: DataFrame, key: str, position: str, failed: Column, path: str, checkpoint: str) -> StreamingQuery:
    """Failure streak after each row; the state is one open streak per key."""
    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        old = _state(spark, f"{path}/state", batch_id)
        out = failure_streak(batch, key, position, failed, carry=old)
        out.write.mode("overwrite").parquet(f"{path}/rows/batch={batch_id}")
        done = spark.read.parquet(f"{path}/rows/batch={batch_id}")
        new = done.groupBy(key).agg(F.max_by("failure_count", position).alias("open_streak"))
        if old is not None:
            new = new.unionByName(old.join(new.select(key), key, "left_anti"))
        new.write.mode("overwrite").parquet(f"{path}/state/batch={batch_id}")

    return (stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def rates(stream: DataFrame, key: str, micros: str, window_seconds: int, limit: int, path: str,
          checkpoint: str) -> StreamingQuery:
    """Requests in the window before each row; the state is the rows of the last window."""
    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        old = _state(spark, f"{path}/state", batch_id)
        both = batch.withColumn("_new", F.lit(True))
        if old is not None:
            both = both.unionByName(old.withColumn("_new", F.lit(False)))
        counted = rate_window(both, key, micros, window_seconds, limit).filter("_new").drop("_new")
        counted.write.mode("overwrite").parquet(f"{path}/rows/batch={batch_id}")
        newest = both.agg((F.max(micros) - window_seconds * 1_000_000).alias("m")).scalar()
        both.filter(F.col(micros) > newest).drop("_new").write.mode("overwrite").parquet(
            f"{path}/state/batch={batch_id}")

    return (stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def progress(query: StreamingQuery) -> list[dict]:
    """Rows per finished batch, with the share of input done so far."""
    batches = [{"batch": p.batchId, "rows": p.numInputRows} for p in query.recentProgress]
    total = sum(b["rows"] for b in batches)
    done = 0
    for b in batches:
        done += b["rows"]
        b["percent"] = 100.0 * done / total if total else 100.0
    return batches
