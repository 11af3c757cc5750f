"""Files as tables: listing, metadata, admission, duplicates, delimiter, encoding and readers."""

from __future__ import annotations

import csv
import io
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from gridmill.functions import filemeta as fm
from gridmill.session import written
from gridmill.sources.quoted import MARK, SPLITTABLE, read_records

# fixed values: delimiters a file may use, in order of preference
DELIMITERS = [",", ";", "\t", "|"]
BAD = "_bad"


def list_files(spark: SparkSession, path: str, prefix: str | None = None, glob: str | None = None,
               limit: int | None = None) -> DataFrame:
    """``path, name, size, modified`` of the files under a folder; contents are not read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    files = reader.load(path).select("path", fm.base_name(F.col("path")).alias("name"), F.col("length").alias("size"),
                                     F.col("modificationTime").alias("modified"))
    if prefix:
        files = files.filter(F.col("name").startswith(prefix))
    return files.orderBy("path").limit(limit) if limit else files


def with_metadata(files: DataFrame) -> DataFrame:
    n, size = F.col("name"), F.col("size")
    return files.select("*", fm.extension(n).alias("extension"), fm.mime_type(n).alias("mime_type"),
                        fm.category(n).alias("category"), fm.kilobytes(size).alias("size_kb"),
                        fm.megabytes(size).alias("size_mb"))


def admit(files: DataFrame, **rule) -> DataFrame:
    reason = fm.admission_reason(F.col("name"), F.col("size"), **rule)
    return files.withColumn("reason", reason).withColumn("accepted", F.col("reason").isNull())


def file_hashes(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """``path, size, modified, file_hash`` (SHA-256 of the content)."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"),
                                    F.sha2("content", 256).alias("file_hash"))


def first_copies(files: DataFrame, keys: list[str] | None = None, order: list[str] | None = None) -> DataFrame:
    """Mark the first file of every hash (per tenant); ``is_duplicate`` for the others."""
    by = [*(keys or []), "file_hash"]
    rank = F.struct(*(order or ["modified", "path"]))
    firsts = files.groupBy(*by).agg(F.min(rank).alias("_first"))
    return files.join(firsts, by).withColumn("is_duplicate", rank != F.col("_first")).drop("_first")


def _lines(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    reader = spark.read.option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.text(path).select("value", F.col("_metadata.file_path").alias("path"))


def infer_delimiters(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """``path, delimiter`` per file: one that occurs equally often in every line, else the most frequent.

    Files are split as usual; each task forwards one row per file.
    """
    lines = _lines(spark, path, glob).filter(F.length("value") > 0)

    def occurrences(d: str) -> Column:
        return F.length("value") - F.length(F.replace(F.col("value"), F.lit(d), F.lit("")))

    counts = lines.groupBy("path").agg(*[
        F.struct(F.sum(occurrences(d)).alias("total"), F.min(occurrences(d)).alias("low"),
                 F.max(occurrences(d)).alias("high")).alias(f"d{i}") for i, d in enumerate(DELIMITERS)])
    best = F.array_max(F.array(*[
        F.struct(((F.col(f"d{i}.low") == F.col(f"d{i}.high")) & (F.col(f"d{i}.low") > 0)).alias("steady"),
                 F.col(f"d{i}.total").alias("total"), F.lit(-i).alias("preference"), F.lit(d).alias("delimiter"))
        for i, d in enumerate(DELIMITERS)]))
    return counts.select("path", F.when(best["total"] > 0, best["delimiter"]).alias("delimiter"))


def detect_encodings(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """``path, encoding`` per file from the bytes of all its lines: utf-16, utf-8, cp1252 or latin-1."""
    lines = _lines(spark, path, glob)
    hexed = F.hex(F.col("value").cast("binary"))
    facts = lines.groupBy("path").agg(
        F.bool_or(hexed.rlike("^(..)*00")).alias("zero"), F.bool_and(F.is_valid_utf8("value")).alias("utf8"),
        F.bool_or(hexed.rlike("^(..)*[89]")).alias("c1"))
    return facts.select("path", F.when(F.col("zero"), "utf-16").when(F.col("utf8"), "utf-8")
                        .when(F.col("c1"), "cp1252").otherwise("latin-1").alias("encoding"))


def _field_count(record: Column, delimiter: str) -> Column:
    """Fields of a CSV record: quoted ones, with doubled quotes inside, or plain ones, each after a delimiter."""
    sep = re.escape(delimiter)
    return F.regexp_count(F.concat(F.lit(delimiter), record), F.lit(f'{sep}(?:"[^"]*+(?:""[^"]*+)*+"[^{sep}]*+|[^{sep}]*+)'))


def _parted(raw: DataFrame, names: list[str], delimiter: str) -> tuple[DataFrame, DataFrame]:
    """Well-formed records, and the text of those with too many fields."""
    # Spark refuses plans that read nothing but the corrupt-record column, hence the first field
    first = F.coalesce(F.length(raw.columns[0]), F.lit(0)) >= 0
    # an empty field after a trailing delimiter is none
    fields = _field_count(F.col(BAD), delimiter) - F.col(BAD).endswith(delimiter).cast("int")
    broken = F.col(BAD).isNotNull() & (fields > len(names)) & first
    return raw.filter(~broken).drop(BAD).toDF(*names), raw.filter(broken).select(F.col(BAD).alias("line"))


# with pruning the parser sees only the wanted fields and cannot tell that a line has too many
_PARSER = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD, "columnPruning": "false", "escape": '"'}


def _parse(spark: SparkSession, paths: list[str], names: list[str], options: dict) -> tuple[DataFrame, DataFrame]:
    schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, BAD]])
    return _parted(spark.read.options(**options, **_PARSER).schema(schema).csv(paths), names, options["sep"])


def _parse_records(records: DataFrame, names: list[str], delimiter: str) -> tuple[DataFrame, DataFrame]:
    schema = ", ".join(f"{n} string" for n in [*(f"_f{i}" for i in range(len(names))), BAD])
    fields = F.from_csv("record", schema, {**_PARSER, "sep": delimiter, "multiLine": "true"})
    # through a generator, so that filters on fields do not parse a second time
    return _parted(records.select(F.inline(F.array(fields))), names, delimiter)


def _names(header: str, delimiter: str) -> tuple[str, ...]:
    """Field names of a header; an empty one after a trailing delimiter is none, other empty ones are numbered."""
    names = next(csv.reader(io.StringIO(header.removeprefix(MARK), newline=""), delimiter=delimiter), [])
    names = names[:-1] if len(names) > 1 and names[-1] == "" else names
    return tuple(n or f"_c{i}" for i, n in enumerate(names))


def _concat(parts: list[tuple[DataFrame, DataFrame]]) -> tuple[DataFrame, DataFrame]:
    return reduce(lambda a, b: (a[0].unionByName(b[0], allowMissingColumns=True), a[1].unionByName(b[1])), parts)


def headers(spark: SparkSession, path: str, delimiter: str = ",", encoding: str = "utf-8") -> dict[tuple[str, ...], list[str]]:
    """The files under a path by their header, read from the first line of each file's first split."""
    lines = spark.read.option("encoding", encoding).text(path).select(
        "value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("place"))
    first = lines.filter("start = 0").groupBy("path").agg(F.min_by("value", "place").alias("line"))
    found: dict[tuple[str, ...], list[str]] = {}
    for file, line in sorted(tuple(r) for r in first.collect()):  # one row per file
        found.setdefault(_names(line, delimiter), []).append(file)
    return found


def read_csv(spark: SparkSession, path: str, delimiter: str = ",", encoding: str = "utf-8", multiline: bool = True,
             split: bool = True) -> tuple[DataFrame, DataFrame]:
    """String columns of the well-formed records, and ``line`` of the records with too many fields.

    Quotes inside quoted fields are doubled.  Every file's own header names its fields, so files may order or lack columns; short
    records are padded with nulls.  Big files are read by many tasks, whether or not fields hold line breaks, and their lines are
    written once to the shared folder; ``split=False`` reads each file in one task instead, as do encodings of several bytes a
    letter other than UTF-8.  ``multiline=False`` splits without writing, for texts without line breaks in fields.
    """
    if multiline and split and encoding.lower() in SPLITTABLE:
        records = read_records(spark, [path], delimiter, encoding)
        files = written(records.filter("is_first").select("path", F.col("record").alias("header")), "headers")
        lines = [r[0] for r in files.select("header").distinct().collect()]  # one row per distinct header
        if lines:
            rows = records.filter("NOT is_first")
            if len(lines) > 1:
                rows = rows.join(files, "path")
            by_names: dict[tuple[str, ...], list[str]] = {}
            for line in sorted(lines):
                by_names.setdefault(_names(line, delimiter), []).append(line)
            return _concat([_parse_records(rows.filter(F.col("header").isin(same)) if len(lines) > 1 else rows, list(names), delimiter)
                            for names, same in by_names.items()])
    options = {"header": "true", "sep": delimiter, "encoding": encoding, "multiLine": str(multiline).lower()}
    parts = [_parse(spark, files, list(names), options) for names, files in headers(spark, path, delimiter, encoding).items()]
    if not parts:
        return _parse(spark, [path], spark.read.options(**options).csv(path).columns or ["_c0"], options)
    return _concat(parts)


def parse_lines(spark: SparkSession, path: str, names: list[str], delimiter: str = ",", encoding: str = "utf-8",
                multiline: bool = True, split: bool = True) -> tuple[DataFrame, DataFrame]:
    """The same for files without a header, whose names are given."""
    if multiline and split and encoding.lower() in SPLITTABLE:
        return _parse_records(read_records(spark, [path], delimiter, encoding), names, delimiter)
    return _parse(spark, [path], names, {"header": "false", "sep": delimiter, "encoding": encoding, "multiLine": str(multiline).lower()})


READERS = {
    "csv": lambda spark, path, **o: read_csv(spark, path, **o)[0],
    "txt": lambda spark, path, **o: read_csv(spark, path, **o)[0],
    "json": lambda spark, path, **o: spark.read.options(**o).json(path),
    "parquet": lambda spark, path, **o: spark.read.options(**o).parquet(path),
}


def read_table(spark: SparkSession, path: str, kind: str | None = None, **options) -> DataFrame:
    """Pick the reader by extension or by an explicit kind."""
    ext = kind or path.rstrip("/").rsplit(".", 1)[-1].lower()
    if ext not in READERS:
        raise ValueError(f"unsupported file type {ext!r}; use one of {sorted(READERS)}")
    return READERS[ext](spark, path, **options)


def require_shape(df: DataFrame, min_rows: int = 1, min_columns: int = 1) -> DataFrame:
    """Raise unless the table has the columns and rows; reads no more rows than needed."""
    if len(df.columns) < min_columns:
        raise ValueError(f"{len(df.columns)} columns, at least {min_columns} needed")
    if df.limit(min_rows).count() < min_rows:
        raise ValueError(f"fewer than {min_rows} rows")
    return df


def head_check(spark: SparkSession, path: str, kind: str | None = None, rows: int = 5, **options) -> DataFrame:
    """The first rows of a file, to see whether it can be read at all."""
    return read_table(spark, path, kind, **options).limit(rows)


def newest_files(files: DataFrame, keys: list[str]) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.col("modified").desc(), F.col("path"))
    return files.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")
