"""What the operators share: staged tables, byte views of Arrow text columns, word spans and the training split."""

from __future__ import annotations

import ctypes
import functools
import inspect
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from gridmill.session import scratch_path

# A word is a run of characters other than space, tab, newline, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"


TEXT_ROWS = 2_000


def short_batches(spark) -> None:
    """Let Arrow batches hold fewer rows than Spark's default, for tables whose rows are whole texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(TEXT_ROWS))


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write the frame to the shared folder and continue from the files: computed once, safe against lost executors."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def kept_as(name: str, results: list[str]) -> str:
    """The name of a kept column beside an operator's results: with a suffix where it would be one of theirs."""
    return f"{name}_kept" if name in results else name


def _give_back() -> None:
    _powers.clear()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def frugal(run: Callable) -> Callable:
    """A task's function that returns its free memory to the system when done: Python workers live on, and keep what earlier tasks took."""
    if inspect.isgeneratorfunction(run):
        @functools.wraps(run)
        def stream(*args):
            try:
                yield from run(*args)
            finally:
                _give_back()
        return stream

    def call(*args):
        try:
            return run(*args)
        finally:
            _give_back()

    # Spark asks for functions with as many named arguments as they are called with.
    return (lambda table: call(table)) if len(inspect.signature(run).parameters) == 1 else (lambda left, right: call(left, right))


def text_slices(batches, column: str, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into runs of rows with about ``limit`` bytes of text; a longer text is a run of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        run = np.cumsum(sizes) // limit
        cuts = [0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), batch.num_rows]
        for lo, hi in zip(cuts, cuts[1:]):
            yield batch.slice(lo, hi - lo)


def byte_view(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts back to back, and the bounds of each text; null reads as empty."""
    whole = pc.fill_null(column.cast(pa.large_binary()), b"")
    bounds = np.frombuffer(whole.buffers()[1], np.int64, len(whole) + 1, whole.offset * 8)
    raw = whole.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data[bounds[0]:bounds[-1]], bounds - bounds[0]


def is_space(data: np.ndarray) -> np.ndarray:
    return (data == 32) | ((data >= 9) & (data <= 13))


def word_spans(data: np.ndarray, bounds: np.ndarray, space: np.ndarray | None = None):
    """Start, end and text number of every word."""
    inside = ~(is_space(data) if space is None else space)
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edges = bounds[(bounds > 0) & (bounds < len(data))]
    first[edges] = inside[edges]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    last[edges - 1] = inside[edges - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(bounds, starts, side="right") - 1


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (wrapping arithmetic)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; grown on demand and kept until the task ends."""
    have = _powers.get(base, np.ones(1, np.uint64))
    while len(have) < n:
        have = _powers[base] = np.concatenate((have, have * np.uint64(pow(base, len(have), 1 << 64))))
    return have[:n]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit polynomial hash of each byte span, the same wherever the bytes stand."""
    n = len(data)
    sums = np.zeros(n + 1, np.uint64)
    terms = sums[1:]
    terms[:] = data
    terms += np.uint64(1)
    terms *= powers(BASE, n)
    np.cumsum(terms, out=terms)
    value = (sums[ends] - sums[starts]) * powers(INVERSE, n + 1)[starts]
    return mixed(value ^ (ends - starts).astype(np.uint64))


def held_out(id_column: Column, folds: int = 5) -> Column:
    """Whether a row is kept from training: crc32 of the id as text is divisible by ``folds`` (a null id is)."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % folds, F.lit(0)) == 0
