"""Keyed state for rows that come out of order: rate counters, failure streaks, and the rows that came too late.

A row waits in the state until the watermark has passed it; then every earlier row of its key has come, and its result is final.  State
lives in RocksDB, so a batch reads and writes only what it touches or whose timers fire.  Keys share states: each of ``GROUPS`` groups of keys holds its
rows as Arrow tables, so that a batch makes a few calls a group, not a few calls a key, and all keys of a group are counted at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
GROUPS = 2_048        # groups of keys; a checkpoint stands for the number that it was made with
PACKED_ROWS = 50_000  # rows of one value in the state


@contextmanager
def _keyed_store(spark: SparkSession):
    """A query keeps the store that is set when it starts."""
    old = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, old)


class _Tables:
    """A table as list state: Arrow streams of a bounded number of rows."""

    def __init__(self, handle, name: str, schema: pa.Schema):
        self.schema = schema
        self.state = handle.getListState(name, T.StructType([T.StructField("rows", T.BinaryType())]))

    def _packed(self, table: pa.Table) -> list[tuple]:
        out = []
        for batch in table.combine_chunks().to_batches(max_chunksize=PACKED_ROWS):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, self.schema) as writer:
                writer.write_batch(batch)
            out.append((sink.getvalue().to_pybytes(),))
        return out

    def get(self) -> pa.Table:
        parts = [pa.ipc.open_stream(bytes(r[0])).read_all() for r in self.state.get()] if self.state.exists() else []
        return pa.concat_tables(parts) if parts else self.schema.empty_table()

    def append(self, table: pa.Table) -> None:
        self.state.appendList(self._packed(table))

    def put(self, table: pa.Table) -> None:
        if table.num_rows:
            self.state.put(self._packed(table))
        else:
            self.state.clear()


def _codes(*keys: pa.ChunkedArray) -> list[np.ndarray]:
    """Numbers for the keys of several columns, equal where the keys are; null is a key."""
    both = pa.chunked_array([c for k in keys for c in k.chunks], keys[0].type).combine_chunks()
    code = both.dictionary_encode("encode").indices.to_numpy(zero_copy_only=False).astype(np.int64)
    return np.split(code, np.cumsum([len(k) for k in keys])[:-1])


def _longs(table: pa.Table, name: str) -> np.ndarray:
    return table[name].to_numpy().astype(np.int64)


class _Waiting(StatefulProcessor):
    """Rows of a group of keys wait until the watermark has passed their time; ``settled`` then takes them.

    The first two columns of a row are its key and its time in microseconds.  Numbers, texts and booleans are kept.
    """

    def __init__(self, schema: T.StructType, names: list[str]):
        self.schema, self.names = schema, names

    def init(self, handle) -> None:
        self.handle = handle
        self.arrow = pa.schema([pa.field(f"c{i}", f.type) for i, f in enumerate(to_arrow_schema(self.schema))])
        self.waiting = _Tables(handle, "waiting", self.arrow)
        self.armed = handle.getValueState("armed", T.StructType([T.StructField("at", T.LongType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for part in rows:
            if len(part):
                # by place, after the group: Spark renames columns that begin with an underscore
                width = len(self.arrow)
                null = np.frombuffer("".join(part.iloc[:, width + 1]).encode(), "S1").reshape(len(part), width) == b"1"
                new = pa.Table.from_arrays([pa.array(part.iloc[:, i + 1].to_numpy(), f.type, mask=null[:, i]) for i, f in enumerate(self.arrow)], schema=self.arrow)
                self.waiting.append(new)
                first = min([_longs(new, "c1").min()] + ([] if first is None else [first]))
        if first is not None:
            self._wake(int(first))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        self.armed.clear()
        rows = self.waiting.get()
        over = _longs(rows, "c1") <= passed
        done, rest = rows.filter(pa.array(over)), rows.filter(pa.array(~over))
        if done.num_rows:
            self.waiting.put(rest)
        if rest.num_rows:
            self._wake(int(_longs(rest, "c1").min()))
        out, result = self.settled(done, passed, not rest.num_rows)
        if out.num_rows:
            yield out.append_column("n", pa.array(result, pa.int64())).rename_columns(self.names).combine_chunks().to_pandas(types_mapper=pd.ArrowDtype)

    def _wake(self, micros: int) -> None:
        """One timer a group, the earliest that was asked for."""
        at = -(-micros // 1000)
        armed = self.armed.get()[0] if self.armed.exists() else None
        if armed is not None and armed <= at:
            return
        if armed is not None:
            self.handle.deleteTimer(armed)
        self.handle.registerTimer(at)
        self.armed.update((at,))

    def settled(self, rows: pa.Table, passed: int, idle: bool) -> tuple[pa.Table, np.ndarray]:
        raise NotImplementedError

    def close(self) -> None:
        pass


class _Rates(_Waiting):
    """Counts the key's rows in the open window before each row; times older than a window before the watermark go."""

    def __init__(self, schema, names, width: int):
        super().__init__(schema, names)
        self.width = width

    def init(self, handle) -> None:
        super().init(handle)
        self.seen = _Tables(handle, "seen", pa.schema([self.arrow.field(0), self.arrow.field(1)]))

    def settled(self, rows, passed, idle):
        seen = self.seen.get()
        both = pa.concat_tables([seen, rows.select(["c0", "c1"])])
        t = _longs(both, "c1")
        code, own = _codes(both["c0"])[0], slice(seen.num_rows, None)
        moments, rank = np.unique(t, return_inverse=True)
        # a time of a key as one number: its rank among all times, in the key's range of numbers
        span = len(moments) + 1
        place = np.sort(code * span + rank)
        since = code[own] * span + np.searchsorted(moments, t[own] - self.width, side="right")
        before = np.searchsorted(place, code[own] * span + rank[own]) - np.searchsorted(place, since)
        open_ = t > passed - self.width
        if rows.num_rows or not open_.all():
            self.seen.put(both.filter(pa.array(open_)))
        if idle and open_.any():
            self._wake(int(t.max()) + self.width)
        return rows, before


class _Streaks(_Waiting):
    """Counts the failures in a row up to each row, ties of time by the other columns in turn; the last column of a row tells whether it failed."""

    def init(self, handle) -> None:
        super().init(handle)
        self.open = _Tables(handle, "open", pa.schema([self.arrow.field(0), pa.field("n", pa.int64())]))

    def settled(self, rows, passed, idle):
        if not rows.num_rows:
            return rows, np.zeros(0, np.int64)
        old = self.open.get()
        old_code, code = _codes(old["c0"], rows["c0"])
        streak = np.zeros(max(old_code.max(initial=-1), code.max()) + 1, np.int64)
        streak[old_code] = _longs(old, "n")
        order = pc.sort_indices(rows.append_column("_code", pa.array(code)), [("_code", "ascending"), *((c, "ascending") for c in rows.column_names[1:])],
                                null_placement="at_start").to_numpy()
        rows, code = rows.take(pa.array(order)), code[order]
        failed = rows.column(rows.num_columns - 1).fill_null(False).to_numpy()
        at = np.arange(len(code))
        head = np.append(True, code[1:] != code[:-1])
        begin = np.maximum.accumulate(np.where(head, at, 0))
        well = np.maximum.accumulate(np.where(failed, -1, at))  # the last row that did not fail
        n = np.where(well >= begin, at - well, at - begin + 1 + streak[code])
        tail = np.append(head[1:], True)
        last = pa.table([rows["c0"].filter(pa.array(tail)), pa.array(n[tail])], schema=self.open.schema)
        kept = pa.concat_tables([old.filter(pa.array(~np.isin(old_code, code))), last])
        self.open.put(kept.filter(pc.greater(kept["n"], 0)))
        return rows, n


def _keyed(stream: DataFrame, key: str, ts: str, late: str, columns: dict[str, Column], processor, result: str, options: tuple = ()) -> DataFrame:
    moment = F.col(ts).cast("timestamp")
    rows = stream.where(F.col(ts).isNotNull()).select(F.col(key), F.unix_micros(moment).alias("_t"), *(c.alias(n) for n, c in columns.items()), moment.alias("_ts"))
    fields = [f for f in rows.schema if f.name != "_ts"]
    null, values = [], []
    for i, f in enumerate(fields):
        c = F.col(f"`{f.name}`")
        gone = c.isNull() | F.isnan(c) if i and isinstance(f.dataType, T.FractionalType) and not isinstance(f.dataType, T.DecimalType) else c.isNull()
        null.append(F.when(gone, "1").otherwise("0"))
        # pandas has no nulls beside whole numbers
        filler = F.lit(0).cast(f.dataType) if isinstance(f.dataType, T.IntegralType) else F.lit(False) if isinstance(f.dataType, T.BooleanType) else None
        values.append((c if filler is None else F.coalesce(c, filler)).alias(f.name))
    group = F.pmod(F.hash(F.col(f"`{key}`")), F.lit(GROUPS)).alias("_group")
    rows = rows.select(group, *values, F.concat(*null).alias("_null"), "_ts").withWatermark("_ts", late)
    output = T.StructType([*fields, T.StructField(result, T.LongType())])
    with _keyed_store(stream.sparkSession):
        return rows.groupBy("_group").transformWithStateInPandas(
            processor(T.StructType(fields), output.names, *options), output, "append", "EventTime")


def _append(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    with _keyed_store(rows.sparkSession):
        return (rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
                .outputMode("append").trigger(availableNow=True).start())


def keyed_rates(stream: DataFrame, key: str, ts: str, window_seconds: int, limit: int, late: str, keep: list[str], path: str, checkpoint: str) -> StreamingQuery:
    """Write ``key, keep..., current_count, is_allowed, remaining`` of every row that the watermark has passed, with the results of ``rate_window``.

    Files and rows may come in any order within ``late``; rows without a time are left out, later ones are what ``late_rows`` stores.
    """
    counted = _keyed(stream, key, ts, late, {c: F.col(c) for c in keep}, _Rates, "current_count", (window_seconds * 1_000_000,))
    return _append(counted.select(
        key, *keep, "current_count", (F.col("current_count") < limit).alias("is_allowed"),
        F.greatest(F.lit(0), limit - F.col("current_count") - 1).cast("bigint").alias("remaining")), path, checkpoint)


def keyed_streaks(stream: DataFrame, key: str, ts: str, position: str, failed: Column, late: str, path: str, checkpoint: str,
                  disable_at: int = 20) -> StreamingQuery:
    """Write ``key, position, failure_count, auto_disable`` of every row that the watermark has passed, in the order of time and position."""
    counted = _keyed(stream, key, ts, late, {position: F.col(position), "_failed": failed}, _Streaks, "failure_count")
    return _append(counted.select(key, position, "failure_count", (F.col("failure_count") >= disable_at).alias("auto_disable")), path, checkpoint)


def late_rows(stream: DataFrame, ts: str, late_seconds: int, path: str, checkpoint: str) -> StreamingQuery:
    """Part every batch into ``path/on_time`` and ``path/late``, with the counts and the greatest time so far in ``path/marks``.

    Run beside a stateful query over the same files and files per batch, it stores what that query drops: rows that are not newer than the watermark of the batch
    before, which comes from the batches before that one.  A repeated batch overwrites its own folders.  Rows without a time are on time.
    """
    def part(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        mark = lambda n: spark.read.schema("high long, on_time long, late long").parquet(f"{path}/marks/batch={n}").first()
        passed = mark(batch_id - 2)["high"] if batch_id > 1 else None
        before = mark(batch_id - 1)["high"] if batch_id > 0 else None
        micros = F.unix_micros(F.col(ts).cast("timestamp"))
        behind = F.lit(False) if passed is None else F.coalesce(micros <= (passed // 1000 - late_seconds * 1000) * 1000, F.lit(False))
        batch = batch.withColumn("_late", behind)
        batch.where("NOT _late").drop("_late").write.mode("overwrite").parquet(f"{path}/on_time/batch={batch_id}")
        batch.where("_late").drop("_late").write.mode("overwrite").parquet(f"{path}/late/batch={batch_id}")
        high = F.max(micros) if before is None else F.greatest(F.max(micros), F.lit(before).cast("bigint"))
        batch.agg(high.alias("high"), F.count_if(~F.col("_late")).alias("on_time"), F.count_if("_late").alias("late")).write.mode(
            "overwrite").parquet(f"{path}/marks/batch={batch_id}")

    return stream.writeStream.foreachBatch(part).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def dropped(query: StreamingQuery) -> int:
    """Rows that the stateful operators of a finished query have dropped as too late."""
    return sum(s.numRowsDroppedByWatermark for p in query.recentProgress for s in p.stateOperators)
