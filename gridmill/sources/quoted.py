"""Records of delimited files with quoted line breaks, read by many tasks.

A byte range may start inside a quoted field, which its own bytes cannot tell.  So every line is followed under both hypotheses,
outside and inside quotes; a scan over the ranges of each file then finds the state at every range's start, and with it the
record every line belongs to.  Only lines of records that span lines are shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from gridmill.session import written

# encodings in which the byte of a line feed is always a line feed, by the names Spark decodes
SPLITTABLE = {"utf-8": None, "utf8": None, "us-ascii": None, "ascii": None, "latin-1": "ISO-8859-1", "iso-8859-1": "ISO-8859-1"}
MARK = "\ufeff"
_TAGS = "path string, start long, seq long, value string, r0 long, e0 boolean, r1 long, e1 boolean"


def _open_after(line: Column, delimiter: str, inside: bool) -> Column:
    """Whether a quoted field is open at the end of a line that starts outside (or inside) quotes.

    Quotes inside quoted fields are doubled; a quote inside a plain field is a letter; after a closing quote the field goes on to the delimiter.
    """
    sep = re.escape(delimiter)
    body = '[^"]*+(?:""[^"]*+)*+'
    closed = f'(?:"{body}"[^{sep}]*+|[^"{sep}][^{sep}]*+|){sep}'
    opening = f'(?:{closed})*+"{body}'
    return line.rlike(f'^{body}(?:"[^{sep}]*+{sep}{opening})?+\\z' if inside else f"^{opening}\\z")


def _follow(open0: np.ndarray, open1: np.ndarray, state: int) -> np.ndarray:
    """The state after every line, from the state before the first: a line sets it, turns it or leaves it."""
    turned = np.cumsum(open0 & ~open1)
    last_set = np.maximum.accumulate(np.where(open0 == open1, np.arange(len(open0)), -1))
    since = np.where(last_set < 0, turned, turned - turned[last_set])
    return np.where(last_set < 0, bool(state), open0[last_set]) ^ (since % 2 == 1)


def _tag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number the lines of each byte range and name, under both hypotheses, the line their record starts with (-1: before the range)."""
    current, seq = None, 0
    state, record = [False, True], [-1, -1]
    for batch in batches:
        path, start = batch.column("path"), batch.column("start").to_numpy()
        open0, open1 = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("open0", "open1"))
        codes = path.dictionary_encode().indices.to_numpy()
        borders = np.flatnonzero((np.diff(codes) != 0) | (np.diff(start) != 0)) + 1
        for low, high in zip([0, *borders], [*borders, batch.num_rows]):
            if high == low:
                continue
            here = (path[int(low)].as_py(), int(start[low]))
            if here != current:
                current, seq, state, record = here, 0, [False, True], [-1, -1]
            numbers = np.arange(seq, seq + high - low)
            tags = []
            for h in (0, 1):
                after = _follow(open0[low:high], open1[low:high], state[h])
                outside = ~np.concatenate([[state[h]], after[:-1]])
                first = np.maximum.accumulate(np.where(outside, numbers, record[h]))
                state[h], record[h] = bool(after[-1]), int(first[-1])
                tags += [pa.array(first), pa.array(after)]
            seq += int(high - low)
            cut = batch.slice(int(low), int(high - low))
            yield pa.RecordBatch.from_arrays(
                [cut.column("path"), cut.column("start"), pa.array(numbers), cut.column("value"), *tags],
                names=["path", "start", "seq", "value", "r0", "e0", "r1", "e1"])


def _lines(spark: SparkSession, paths: list[str], delimiter: str, encoding: str) -> DataFrame:
    """All lines with their tags, written once, because later reads might cut the files elsewhere."""
    start = F.col("_metadata.file_block_start")
    raw = spark.read.option("lineSep", "\n").text(paths).select(F.col("_metadata.file_path").alias("path"), start.alias("start"), "value")
    charset = SPLITTABLE[encoding.lower()]
    text = F.decode(F.col("value").cast("binary"), charset) if charset else F.make_valid_utf8("value")
    raw = raw.withColumn("value", text)
    bare = F.when((F.col("start") == 0) & F.col("value").startswith(MARK), F.substring("value", 2, 2**31 - 1)).otherwise(F.col("value"))
    raw = raw.select("*", _open_after(bare, delimiter, False).alias("open0"), _open_after(bare, delimiter, True).alias("open1"))
    tagged = written(raw.mapInArrow(_tag, _TAGS), "lines")
    first = (F.col("start") == 0) & (F.col("seq") == 0) & F.col("value").startswith(MARK)
    return tagged.withColumn("value", F.when(first, F.substring("value", 2, 2**31 - 1)).otherwise(F.col("value")))


def _ranges(lines: DataFrame) -> DataFrame:
    """One row per byte range: the state at its start, the record that is open there, and the file's first line with a letter."""
    blank = F.col("value").isin("", "\r")
    last = F.max_by(F.struct("r0", "e0", "r1", "e1"), "seq")
    ranges = lines.groupBy("path", "start").agg(last.alias("last"), F.min(F.when(~blank, F.col("seq"))).alias("letter")).select(
        "path", "start", "last.*", "letter")
    by_file = Window.partitionBy("path")
    upto = by_file.orderBy("start").rowsBetween(Window.unboundedPreceding, 0)
    before = by_file.orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("turned", F.sum((F.col("e0") & ~F.col("e1")).cast("int")).over(upto))
    set_to = F.when(F.col("e0") == F.col("e1"), F.col("e0").cast("int") + F.col("turned"))
    ranges = ranges.withColumn("set_to", F.last(set_to, ignorenulls=True).over(upto))
    after = (F.coalesce("set_to", F.lit(0)) + F.col("turned")) % 2 == 1
    ranges = ranges.withColumn("inside", F.coalesce(F.lag(after).over(by_file.orderBy("start")), F.lit(False)))
    record = F.when(F.col("inside"), F.col("r1")).otherwise(F.col("r0"))
    begun = F.when(record >= 0, F.struct(F.col("start"), record.alias("seq")))
    head = F.min(F.when(F.col("letter").isNotNull(), F.struct("start", F.col("letter").alias("seq")))).over(by_file)
    return ranges.select("path", "start", "inside", F.last(begun, ignorenulls=True).over(before).alias("open"), head.alias("head"))


def read_records(spark: SparkSession, paths: list[str], delimiter: str = ",", encoding: str = "utf-8") -> DataFrame:
    """``path, is_first, record``: the text of every record, line breaks in quotes included; ``is_first`` marks each file's first.

    Empty lines between records are left out; a carriage return before the line feed that ends a record is not part of it.  Files
    whose lines end with a lone carriage return are one record.  A quote that is never closed takes the rest of its file.
    """
    lines = _lines(spark, paths, delimiter, encoding)
    # one row per byte range: its files tell the planner whether it is small enough to be broadcast
    tagged = lines.join(written(_ranges(lines), "ranges"), ["path", "start"])
    record = F.when(F.col("inside"), F.col("r1")).otherwise(F.col("r0"))
    ends_open = F.when(F.col("inside"), F.col("e1")).otherwise(F.col("e0"))
    here = F.when(record >= 0, F.struct("start", record.alias("seq"))).otherwise(F.col("open"))
    tagged = tagged.withColumns({"at": here, "whole": (record == F.col("seq")) & ~ends_open})
    single = tagged.filter("whole").select("path", (F.col("at") == F.col("head")).alias("is_first"), F.col("value").alias("record"))
    parts = tagged.filter("NOT whole").groupBy("path", "at").agg(
        F.first("head").alias("head"), F.sort_array(F.collect_list(F.struct("start", "seq", "value"))).alias("parts"))
    joined = parts.select("path", (F.col("at") == F.col("head")).alias("is_first"), F.array_join("parts.value", "\n").alias("record"))
    both = single.unionAll(joined)
    text = F.col("record")
    text = F.when(text.endswith("\r"), F.expr("left(record, length(record) - 1)")).otherwise(text)
    return both.withColumn("record", text).filter("record <> ''")
