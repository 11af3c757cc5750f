"""WARC archives: write pages as one gzip member per record, read them back by byte ranges."""

from __future__ import annotations

import base64
import uuid
import zlib

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from gridmill.llm.common import staged
from gridmill.session import scratch_path

# Fixed values of the WARC 1.1 and gzip formats.
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
GZIP_MAGIC = b"\x1f\x8b\x08"
MARK = b"WARC/1."

RECORD_URN = "urn:x-page:"
SPLIT_BYTES = 4 << 20
MOST_TASKS = 100_000
BATCH_BYTES = 4 << 20


def mark_revisits(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """Columns id, url, payload (binary), digest (base32 SHA-1) and refers_to.

    Of rows with equal payloads of ``min_bytes`` or more the smallest id is the response (repeated rows of that id too, and rows without
    an id where none has one); the others refer to it.  A null payload is an empty one.
    """
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"),
                        F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).alias("payload")).withColumn("_sha1", F.sha1("payload"))
    first = staged(rows.groupBy("_sha1").agg(F.min("id").alias("_first")), "payloads")
    again = (F.length("payload") >= min_bytes) & ~F.col("id").eqNullSafe(F.col("_first"))
    return rows.join(first, "_sha1").select("id", "url", "payload", "_sha1", F.when(again, F.col("_first")).alias("refers_to"))


def _member(record_type: str, headers: list[tuple[str, str]], block: bytes, level: int) -> bytes:
    lines = [VERSION, f"WARC-Type: {record_type}", *(f"{k}: {v}" for k, v in headers), f"Content-Length: {len(block)}", "", ""]
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(lines).encode() + block + b"\r\n\r\n") + packer.flush()


def _page_member(page, url, payload: bytes, sha1: str, refers_to, date: str, level: int) -> bytes:
    headers = [("WARC-Record-ID", f"<{RECORD_URN}{'' if page is None else page}>"), ("WARC-Date", date)]
    if url is not None:
        headers.append(("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A")))
    headers.append(("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(sha1)).decode()))
    headers.append(("Content-Type", "application/http; msgtype=response"))
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if refers_to is None:
        return _member("response", headers, block + payload, level)
    headers += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", f"<{RECORD_URN}{refers_to}>")]
    return _member("revisit", headers, block, level)


def write_archives(marked: DataFrame, folder: str, date: str = "2024-01-01T00:00:00Z", level: int = 3, roll_bytes: int = 1 << 30) -> DataFrame:
    """Write the rows of ``mark_revisits`` as ``.warc.gz`` files under a folder that all executors share.

    Every task writes files of its own, named anew at every attempt; returns the manifest (path, bytes, records) of those that were
    finished, written once.  Files of failed attempts stay unlisted.  The folder is any URI that ``pyarrow.fs`` opens.
    """
    def run(batches):
        fs, root = pa.fs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        sink, path, size, records = None, "", 0, 0
        prefix = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}"
        number = 0

        def entry():
            return pa.RecordBatch.from_pydict({"path": [f"{folder}/{path}"], "bytes": [size], "records": [records]})

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("id", "url", "payload", "_sha1", "refers_to"))):
                if sink is None:
                    path, size, records = f"{prefix}-{number:03d}.warc.gz", 0, 0
                    sink, number = fs.open_output_stream(f"{root}/{path}", compression=None), number + 1
                member = _page_member(*row, date, level)
                sink.write(member)
                size, records = size + len(member), records + 1
                if size >= roll_bytes:
                    sink.close()
                    yield entry()
                    sink = None
        if sink is not None:
            sink.close()
            yield entry()

    return staged(marked.mapInArrow(run, "path string, bytes long, records long"), "manifest")


class _Window:
    """Bytes of a file from a position on, read as they are needed."""

    def __init__(self, source, start: int, size: int, step: int = 1 << 20):
        self.source, self.start, self.size, self.step, self.data = source, start, size, step, b""

    def upto(self, end: int) -> bool:
        """Have the bytes before ``end``, as far as the file goes; whether anything was read."""
        have, end = self.start + len(self.data), min(end, self.size)
        if end <= have:
            return False
        self.data += self.source.read_at(max(end - have, min(self.step, self.size - have)), have)
        return True

    def drop(self, before: int) -> None:
        before = min(before, self.start + len(self.data))
        if before - self.start >= self.step or before == self.start + len(self.data):
            self.data, self.start = self.data[before - self.start:], before


def _inflate(window: _Window, at: int) -> tuple[bytes, int] | None:
    """The whole member at a position and where it ends; None if no WARC record starts there."""
    unpack, position, parts = zlib.decompressobj(31), at, []
    try:
        while not unpack.eof:
            if position >= window.start + len(window.data) and not window.upto(position + window.step):
                return None
            piece = window.data[position - window.start:position - window.start + (4096 if not parts else window.step)]
            out = unpack.decompress(piece)
            position += len(piece)
            if out and not parts and not out.startswith(MARK[:len(out)]):
                return None
            parts += [out] if out else []
    except zlib.error:
        return None
    whole = b"".join(parts)
    return (whole, position - len(unpack.unused_data)) if whole.startswith(MARK) else None


def parse_record(member: bytes) -> dict | None:
    """Headers and payload of an uncompressed record; None where its parts do not agree with the stated lengths."""
    head, found, rest = member.partition(b"\r\n\r\n")
    if not found:
        return None
    headers = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        headers[name.strip().lower()] = value.strip()
    length = headers.get("content-length", "")
    if not length.isdigit() or len(rest) != int(length) + 4 or rest[-4:] != b"\r\n\r\n":
        return None
    http, _, payload = rest[:-4].partition(b"\r\n\r\n")
    stated = [v for k, _, v in (line.partition(b":") for line in http.split(b"\r\n")[1:]) if k.strip().lower() == b"content-length"]
    revisit = headers.get("warc-type") == "revisit"
    return {"record_type": headers.get("warc-type"), "record_id": headers.get("warc-record-id", "").strip("<>"),
            "url": headers.get("warc-target-uri"), "digest": headers.get("warc-payload-digest", "").removeprefix("sha1:") or None,
            "refers_to": headers["warc-refers-to"].strip("<>") if "warc-refers-to" in headers else None,
            "payload": None if revisit else payload, "payload_bytes": int(stated[0]) if revisit and stated else len(payload)}


def records_in(source, size: int, start: int, end: int):
    """Records that start in [start, end) of a file: scan for gzip magic, keep what decodes to a whole record, go on at its end."""
    window, at = _Window(source, start, size), start
    while at < min(end, size):
        window.upto(min(at + window.step, end + len(GZIP_MAGIC) - 1))
        place = window.data.find(GZIP_MAGIC, at - window.start)
        if place < 0:
            at = max(at + 1, window.start + len(window.data) - len(GZIP_MAGIC) + 1)
            window.drop(at)
            continue
        at = window.start + place
        if at >= end:
            return
        member = _inflate(window, at)
        record = parse_record(member[0]) if member else None
        at = member[1] if record else at + 1
        if record:
            yield record
        window.drop(at)


def read_archives(files: DataFrame, payload: bool = True, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Records of the files in a table with ``path`` and ``bytes``, split into byte ranges read in parallel.

    A record belongs to the range in which its gzip member starts, however far it goes.  A place with gzip magic counts only if it inflates
    with its checksum to a record whose headers, lengths and end agree.  Returns record_type, record_id, url, digest (computed
    from the payload, of revisits as stated), digest_ok, refers_to, payload_bytes (of revisits as in their HTTP header) and, if asked
    for, payload (null for revisits).  Files without records and empty files give no rows.
    """
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(split_bytes).cast("long")))
    ranges = files.where("bytes > 0").select("path", "bytes", starts.alias("start"))
    # a named number of partitions, since a few small rows stand for much work
    n = ranges.count()
    ranges = ranges.repartition(max(1, min(n, MOST_TASKS)))
    names = ["record_type", "record_id", "url", "digest", "digest_ok", "refers_to", "payload_bytes", *(["payload"] if payload else [])]
    kinds = ["string"] * 4 + ["boolean", "string", "long", "binary"]
    arrow = {"string": pa.string(), "boolean": pa.bool_(), "long": pa.int64(), "binary": pa.binary()}
    schema = pa.schema([(n, arrow[k]) for n, k in zip(names, kinds)])

    def run(batches):
        from hashlib import sha1

        for batch in batches:
            for path, size, start in zip(*(batch.column(c).to_pylist() for c in ("path", "bytes", "start"))):
                fs, place = pa.fs.FileSystem.from_uri(path)
                held, weight = [], 0
                with fs.open_input_file(place) as source:
                    for record in records_in(source, size, start, min(size, start + split_bytes)):
                        record["digest_ok"] = None
                        if record["payload"] is not None:
                            computed = base64.b32encode(sha1(record["payload"]).digest()).decode()
                            record["digest_ok"] = record["digest"] == computed if record["digest"] else None
                            record["digest"] = computed
                        held.append(record)
                        weight += 500 + len(record["payload"] or b"") * payload
                        if weight >= BATCH_BYTES:
                            yield pa.RecordBatch.from_pylist(held, schema=schema)
                            held, weight = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema=schema)

    return ranges.mapInArrow(run, ", ".join(f"{n} {k}" for n, k in zip(names, kinds)))


def page_id(urn: str, kind: str):
    """The id in a record's name, null where the page had none."""
    return F.nullif(F.substring_index(urn, ":", -1), F.lit("")).cast(kind)


def archive_round_trip(spark: SparkSession, pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
                       min_bytes: int = 0, folder: str | None = None) -> DataFrame:
    """Write pages to archives in the shared folder and read them back: page id, payload_bytes, payload_digest, record_type, refers_to.

    One row per row of ``pages``; an empty table writes no file and gives no rows.
    """
    kind = pages.schema[id_col].dataType.simpleString()
    files = write_archives(mark_revisits(pages, id_col, url_col, payload_col, min_bytes), folder or scratch_path(spark, "warc"))
    rows = read_archives(files, payload=False)
    return rows.select(page_id("record_id", kind).alias(id_col), "payload_bytes", F.col("digest").alias("payload_digest"), "record_type",
                       page_id("refers_to", kind).alias("refers_to"))
