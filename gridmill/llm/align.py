"""Alignment of two tokenizers over a corpus, with inverted pair bitmaps.

Every text is cut by both tokenizers; tokens whose bytes end together are linked.  Documents are numbered inside blocks.  For each pair of linked
ids a block keeps one posting: the bitmap of its documents, and bitmaps of the binary digits of how often beyond once each of them holds
the pair (multiplicity planes).  Bitmaps are compressed: sorted 16-bit numbers while few, bits from then on.  Counting bits gives the corpus's
document and link counts; the postings then carry the counts back to the documents.
"""

from __future__ import annotations

import gc
import hashlib
import json
import os
import re
from contextlib import contextmanager
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from gridmill.llm.common import short_batches, staged
from gridmill.session import scratch_path

MARK = "▁"
BLOCK_DOCS = 1 << 15    # documents of a block: as many bits has a bitmap
BLOCK_BYTES = 1 << 24   # text of a block; a longer text is a block of its own
BITMAP_BYTES = BLOCK_DOCS // 8
SLICE_BYTES = 1 << 20   # text that is put together at once
KNOWN_UNITS = 1 << 17   # units that a task remembers, and their bytes
KNOWN_BYTES = 1 << 23
NEXT = 1 << 16          # above all ids of either side: a pair is a * NEXT + b
# A single space between two of these is where a token of either side begins, in any context.
SOLID = "[!-~À-ÖØ-öø-ÿ]"
CUT = re.compile(f"(?<={SOLID}) (?={SOLID})")
SOLIDS = frozenset(c for c in map(chr, range(256)) if re.match(SOLID, c))
JOINED_UNITS = 256      # units that A encodes as one text


def byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write bytes with: printable bytes are themselves, the others follow from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(rest)}


class Sides:
    """Both tokenizers with the bytes of their tokens."""

    def __init__(self, byte_model: str, piece_model: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(byte_model)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_model)
        letters = byte_letters()
        vocabulary = json.loads(self.a.to_str())["model"]["vocab"]
        a = [b""] * max(self.a.get_vocab_size(), max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            a[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        size = self.b.get_piece_size()
        b = [b"" if self.b.is_control(i) or self.b.is_unknown(i) else bytes([int(self.b.id_to_piece(i)[1:-1], 16)]) if self.b.is_byte(i)
             else self.b.id_to_piece(i).replace(MARK, " ").encode() for i in range(size)]
        self.texts = a, b
        self.sizes = [len(t) for t in a], [len(t) for t in b]
        self.numbers = [str(i) for i in range(max(len(a), len(b)))]
        # Texts are cut at spaces only if no token of either side runs over such a place.
        self.cuts = not any(re.search(f"{SOLID} ", t.decode("utf-8", "replace")) for side in self.texts for t in side)

    def units(self, text: str) -> list[str]:
        """Parts of a text that both sides cut alone as they do inside it, each without the space before it."""
        return CUT.split(text) if self.cuts else [text]

    def ids_a(self, units: list[str]) -> list[list[int]]:
        """Tokens of A for each unit, with a space before it.  Units that may stand beside others, as in a text before it was cut, are encoded many at once;
        the sizes of the tokens tell them apart."""
        solid = [i for i, u in enumerate(units) if self.cuts and u and u[0] in SOLIDS and u[-1] in SOLIDS]
        parts = [solid[lo:lo + JOINED_UNITS] for lo in range(0, len(solid), JOINED_UNITS)]
        out: list[list[int] | None] = [None] * len(units)
        encode, sizes = self.a.encode_batch_fast, self.sizes[0]
        for part, e in zip(parts, encode([" " + " ".join([units[i] for i in part]) for part in parts], add_special_tokens=False)):
            ids = e.ids
            ends = np.cumsum([len(units[i].encode()) + 1 for i in part])
            upto = np.cumsum([sizes[x] for x in ids])
            at = np.searchsorted(upto, ends)
            if len(upto) and upto[-1] == ends[-1] and (upto[at] == ends).all():
                lo = 0
                for i, hi in zip(part, (at + 1).tolist()):
                    out[i], lo = ids[lo:hi], hi
        alone = [i for i, x in enumerate(out) if x is None]
        for i, e in zip(alone, encode([" " + units[i] for i in alone], add_special_tokens=False)):
            out[i] = e.ids
        return out

    def align(self, units: list[str]) -> list[tuple]:
        """For each unit, with a space before it: tokens of A and of B, groups, their text, the linked pairs; None if bytes are lost."""
        ids_a = self.ids_a(units)
        ids_b = self.b.encode(units, num_threads=1)
        (texts_a, texts_b), (sizes_a, sizes_b), number, join = self.texts, self.sizes, self.numbers, b"".join
        out = []
        for unit, a, b in zip(units, ids_a, ids_b):
            whole = (" " + unit).encode()
            if join([texts_a[i] for i in a]) != whole or join([texts_b[i] for i in b]) != whole:
                out.append(None)
                continue
            text, pairs, p, q, i, j, end_a, end_b = [], [], 0, 0, 0, 0, sizes_a[a[0]], sizes_b[b[0]]
            while True:
                if end_a < end_b:
                    i += 1
                    end_a += sizes_a[a[i]]
                elif end_b < end_a:
                    j += 1
                    end_b += sizes_b[b[j]]
                else:
                    i, j = i + 1, j + 1
                    left = number[a[p]] if i - p == 1 else ",".join([number[x] for x in a[p:i]])
                    right = number[b[q]] if j - q == 1 else ",".join([number[x] for x in b[q:j]])
                    text.append(f"{left}|{right}")
                    pairs.append(a[i - 1] * NEXT + b[j - 1])
                    p, q = i, j
                    if i == len(a):
                        break
                    end_a += sizes_a[a[i]]
                    end_b += sizes_b[b[j]]
            out.append((len(a), len(b), len(pairs), ";".join(text), pairs))
        return out


@lru_cache(maxsize=2)
def sides(byte_model: str, piece_model: str) -> Sides:
    return Sides(byte_model, piece_model)


@contextmanager
def uncollected():
    """Without the search for cycles: a task remembers hundreds of thousands of small objects, none of them in a cycle, and each search visits them."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


class Memory:
    """Alignments of the units met lately: two generations of a bounded number and size; what is met again moves to the new one."""

    def __init__(self, both: Sides):
        self.both, self.old, self.new, self.bytes = both, {}, {}, 0

    def of(self, units: list[str]) -> list[tuple]:
        missing = []
        for unit in set(units):
            if unit not in self.new:
                if unit in self.old:
                    self.new[unit] = self.old[unit]
                    self.bytes += len(unit)
                else:
                    missing.append(unit)
        if missing:
            self.new.update(zip(missing, self.both.align(missing)))
            self.bytes += sum(map(len, missing))
        out = [self.new[u] for u in units]
        if len(self.new) > KNOWN_UNITS or self.bytes > KNOWN_BYTES:
            self.old, self.new, self.bytes = self.new if self.bytes <= 2 * KNOWN_BYTES else {}, {}, 0
        return out


def containers(slots: np.ndarray, starts: np.ndarray) -> pa.Array:
    """Compressed bitmaps of runs of sorted document numbers: 16-bit numbers, or ``BITMAP_BYTES`` bytes of bits where that is not longer."""
    ends = np.append(starts[1:], len(slots))
    size = (ends - starts) * 2
    if not (size >= BITMAP_BYTES).any():
        offsets = np.append(starts, len(slots)).astype(np.int32) * np.int32(2)
        return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(slots.astype("<u2"))])
    raw = slots.astype("<u2")
    out = []
    for lo, hi in zip(starts.tolist(), ends.tolist()):
        if (hi - lo) * 2 < BITMAP_BYTES:
            out.append(raw[lo:hi].tobytes())
        else:
            bits = np.zeros(BLOCK_DOCS, bool)
            bits[slots[lo:hi]] = True
            out.append(np.packbits(bits, bitorder="little").tobytes())
    return pa.array(out, pa.binary())


def members(bitmaps: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Document numbers of all bitmaps back to back, and how many each has."""
    parts = [np.flatnonzero(np.unpackbits(np.frombuffer(x, np.uint8), bitorder="little")) if len(x) == BITMAP_BYTES
             else np.frombuffer(x, "<u2") for x in bitmaps]
    return np.concatenate([np.zeros(0, np.int64), *parts]).astype(np.int64), np.array([len(x) for x in parts], np.int64)


def merged(keys: list[np.ndarray], times: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """OR of sorted (pair, document) lists; times of equal entries are added."""
    key, n = np.concatenate(keys), np.concatenate(times)
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    return key[first], np.add.reduceat(n, first) if len(first) else n


def postings(key: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, pa.Array, pa.Array]:
    """Of sorted entries pair * BLOCK_DOCS + document: the pairs, their documents, and their multiplicity planes (digits of times - 1)."""
    pair, slot = key // BLOCK_DOCS, key % BLOCK_DOCS
    first = np.flatnonzero(np.append(True, pair[1:] != pair[:-1])) if len(key) else np.zeros(0, np.int64)
    number = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(key))))
    more = times - 1
    depth = int(more.max()).bit_length() if len(more) else 0
    rows = [np.flatnonzero((more >> k) & 1) for k in range(depth)]
    # A pair has planes up to its own highest digit; lower ones may be empty.
    top = np.zeros(len(first), np.int64)
    for k, at in enumerate(rows):
        top[number[at]] = k + 1
    offsets = np.concatenate(([0], np.cumsum(top)))
    at = np.concatenate([offsets[number[x]] + k for k, x in enumerate(rows)]) if depth else np.zeros(0, np.int64)
    entry = np.concatenate(rows) if depth else np.zeros(0, np.int64)
    order = np.argsort(at, kind="stable")
    starts = np.searchsorted(at[order], np.arange(offsets[-1]))
    planes = containers(slot[entry[order]], starts)
    return pair[first], containers(slot, first), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), planes)


def _indexed(rows: DataFrame, byte_model: str, piece_model: str) -> DataFrame:
    """Documents and postings of every block, told apart by ``part``; written once, so that the numbers of documents stand."""
    long, text = T.LongType(), T.StringType()
    kept = T.StructField("kept", rows.schema["kept"].dataType)
    doc = [("slot", long), ("n_a", long), ("n_b", long), ("n_groups", long), ("n_links", long), ("groups_sha256", text)]
    schema = T.StructType([T.StructField("part", text), T.StructField("block", long), kept, *(T.StructField(n, t) for n, t in doc), T.StructField("pair", long),
                           T.StructField("docs", T.BinaryType()), T.StructField("planes", T.ArrayType(T.BinaryType()))])

    def run(batches):
        with uncollected():
            yield from indexed(batches)

    def indexed(batches):
        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        memory = Memory(sides(byte_model, piece_model))
        block, slot, size, keys, times = TaskContext.get().partitionId() << 32, 0, 0, [], []

        def batch_of(n: int, **columns):
            return pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) if f.name in columns else pa.nulls(n, f.type) for f in arrow], schema=arrow)

        def closed():
            if keys:
                pair, docs, planes = postings(*merged(keys, times))
                for lo in range(0, len(pair), 50_000):
                    part = slice(lo, lo + 50_000)
                    n = len(pair[part])
                    yield batch_of(n, part=pa.array(["posting"] * n), block=pa.array(np.full(n, block)), pair=pa.array(pair[part]),
                                   docs=docs[part], planes=planes[part])

        for batch in batches:
            texts = batch.column("text").to_pylist()
            lo = 0
            while lo < len(texts):
                hi, here = lo, 0
                while hi < len(texts) and (hi == lo or here + len(texts[hi] or "") <= SLICE_BYTES):
                    here += len(texts[hi] or "")
                    hi += 1
                if slot and (slot + hi - lo > BLOCK_DOCS or size + here > BLOCK_BYTES):
                    yield from closed()
                    block, slot, size, keys, times = block + 1, 0, 0, [], []
                units, found = [], []
                bounds = [0]
                for text in texts[lo:hi]:
                    units += memory.both.units(text) if text else []
                    bounds.append(len(units))
                found = memory.of(units)
                columns = {n: [] for n in ("n_a", "n_b", "n_groups", "groups_sha256")}
                pairs, owners = [], []
                for i, (x, y) in enumerate(zip(bounds, bounds[1:])):
                    mine = found[x:y]
                    mine = [] if None in mine else mine
                    columns["n_a"].append(sum(u[0] for u in mine))
                    columns["n_b"].append(sum(u[1] for u in mine))
                    columns["n_groups"].append(sum(u[2] for u in mine))
                    columns["groups_sha256"].append(hashlib.sha256(";".join([u[3] for u in mine]).encode()).hexdigest() if mine else "")
                    pairs += [u[4] for u in mine]
                    owners.append(columns["n_groups"][-1])
                n = hi - lo
                yield batch_of(n, part=pa.array(["doc"] * n), block=pa.array(np.full(n, block)), kept=batch.column("kept").slice(lo, n),
                               slot=pa.array(np.arange(slot, slot + n)), n_links=pa.array(owners, pa.int64()),
                               **{k: pa.array(v, pa.string() if k == "groups_sha256" else pa.int64()) for k, v in columns.items()})
                key = np.fromiter(chain.from_iterable(pairs), np.int64) * BLOCK_DOCS + np.repeat(np.arange(slot, slot + n), owners)
                key, count = merged([key], [np.ones(len(key), np.int64)])
                if len(key):
                    keys.append(key)
                    times.append(count)
                slot, size, lo = slot + n, size + here, hi
        yield from closed()

    path = scratch_path(rows.sparkSession, "alignment")
    rows.mapInArrow(run, schema).write.partitionBy("part").parquet(path)
    return rows.sparkSession.read.schema(schema).parquet(path)


def _scores(schema: T.StructType):
    """Adds up, for every document of a block, what its postings carry."""
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(table: pa.Table) -> pa.Table:
        best, total = np.zeros(BLOCK_DOCS, np.int64), np.zeros(BLOCK_DOCS, np.int64)
        for batch in table.to_batches(max_chunksize=20_000):
            count, top = (batch.column(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in ("n_links", "best"))
            planes = batch.column("planes")
            depth = np.diff(planes.offsets.to_numpy())
            nth = np.arange(depth.sum()) - np.repeat(np.cumsum(depth) - depth, depth)
            owner = np.concatenate((np.arange(batch.num_rows), np.repeat(np.arange(batch.num_rows), depth)))
            weight = np.concatenate((np.ones(batch.num_rows, np.int64), np.int64(1) << nth))
            slots, sizes = members(batch.column("docs").to_pylist() + planes.flatten().to_pylist())
            owner, weight = np.repeat(owner, sizes), np.repeat(weight, sizes)
            np.add.at(total, slots, weight * count[owner])
            np.add.at(best, slots, weight * top[owner])
        at = np.flatnonzero(total)
        block = np.full(len(at), table.column("block")[0].as_py(), np.int64)
        return pa.Table.from_arrays([pa.array(block), pa.array(at), pa.array(best[at]), pa.array(total[at])], schema=arrow)

    return run


def popcount(bitmap):
    """How many documents a compressed bitmap holds."""
    return F.when(F.octet_length(bitmap) == BITMAP_BYTES, F.bitmap_count(bitmap)).otherwise(F.octet_length(bitmap) / 2).cast("long")


def align(docs: DataFrame, byte_model: str, piece_model: str, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Two tables: documents, and the linked pairs of the corpus.

    Documents: id, n_a, n_b (tokens), n_groups (runs of bytes between offsets where tokens of both sides end), n_links (token pairs that end together), n_best (links whose
    count is the highest of their B id, ties included), count_sum (of the counts over links), groups_sha256.  Pairs: a, b, n_docs, n_links, best.  Both sides read a
    space and the text; special tokens are plain text.  Null and empty texts, and texts whose tokens do not give back their bytes, have
    zeros and an empty digest.  One row per row of ``docs``; equal texts and ids count each.  Without documents both tables are empty.

    A text is cut at single spaces inside it, so that words are aligned once per task; a run without one is aligned as a whole.
    """
    spark = docs.sparkSession
    short_batches(spark)
    rows = docs.select(F.struct(F.col(id_col).alias("id")).alias("kept"), F.col(text_col).alias("text"))
    index = _indexed(rows, byte_model, piece_model)
    texts = index.where("part = 'doc'").select("block", "slot", "kept.id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    post = index.where("part = 'posting'").select("block", "pair", "docs", "planes")
    times = F.aggregate(F.transform("planes", lambda x, k: popcount(x) * F.pow(F.lit(2), k).cast("long")), popcount(F.col("docs")), lambda s, x: s + x)
    counts = post.groupBy("pair").agg(F.sum(popcount(F.col("docs"))).alias("n_docs"), F.sum(times).alias("n_links"))
    counts = staged(counts.withColumn("b", F.col("pair") % NEXT), "pairs")
    highest = counts.groupBy("b").agg(F.max("n_links").alias("_most"))
    pairs = staged(counts.join(highest, "b").withColumn("best", (F.col("n_links") == F.col("_most")).cast("long")).drop("_most"), "scored")
    schema = T.StructType([T.StructField(n, T.LongType()) for n in ("block", "slot", "n_best", "count_sum")])
    carried = post.join(pairs.select("pair", "n_links", "best"), "pair").select("block", "docs", "planes", "n_links", "best")
    scores = carried.groupBy("block").applyInArrow(_scores(schema), schema)
    none = F.lit(0).cast("long")
    found = texts.join(scores, ["block", "slot"], "left").select(
        "id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", none).alias("n_best"), F.coalesce("count_sum", none).alias("count_sum"), "groups_sha256")
    return found, pairs.select(F.floor(F.col("pair") / NEXT).cast("int").alias("a"), F.col("b").cast("int").alias("b"), "n_docs", "n_links", (F.col("best") == 1).alias("best"))
