"""Suffix-array dedup with a run-length index: long byte strings that also start in an earlier document are removed.

1. Texts are packed into chunks of bounded size, written once.  Whole texts that a smaller id has too are gone at once.
2. Every string of ``length`` bytes has an anchor: the k-gram in it with the least hash.  Equal strings have equal anchors, so only anchors
   found in two documents matter.  Chunks send the hashes of their anchors to buckets and get back those that are shared.
3. Around shared anchors, a chunk sends the bytes of all strings with that anchor (a context) to the anchor's bucket.  A bucket
   indexes its contexts in a run-compressed Burrows-Wheeler transform with sampled run ends, streams the matching statistics
   of every context through it, and locates all occurrences of each string of full length from the samples.
4. Strings with an occurrence in a smaller document mark their bytes; the marks go back to the chunks, which cut them out.
"""

from __future__ import annotations

from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T

from gridmill.llm.common import BASE, INVERSE, byte_view, frugal, kept_as, mixed, powers, span_hashes, staged, text_slices

CHUNK_BYTES = 16 << 20   # text that a chunk holds; a longer text is a chunk of its own
SLICE_BYTES = 1 << 20    # text whose anchors are found at once
BUCKET_BYTES = 8 << 20   # text per bucket of anchors
INDEX_BYTES = 1 << 19    # bytes of contexts indexed at once; the contexts of one anchor stay together
ANCHOR = 16              # bytes of an anchor
HASH_BITS = 48           # an anchor's hash as it is sent; equal hashes of unequal anchors only add candidates
HOT = 4_096              # an anchor with more occurrences is split by the bytes beside it
GROUP_BYTES = 3 << 20    # an anchor whose contexts may hold more bytes is not indexed: its strings are sent as hashes, each on its own
STRINGS = 1 << 20        # strings of such anchors hashed at once
PARTS = 4                # parts of the starts of an anchor's strings, to tell which contexts can match
NO_ID = np.iinfo(np.int64).max  # a null id counts as larger than every other


# ---- anchors ----

def gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """A hash of the k bytes from every place on, from the 8-byte words in them."""
    n = len(data) - k + 1
    if k < 8:
        return span_hashes(data, np.arange(n), np.arange(n) + k)
    words = np.ndarray(len(data) - 7, "<u8", np.ascontiguousarray(data), strides=(1,)).astype(np.uint64)
    out = words[k - 8:k - 8 + n] * np.uint64(BASE)
    for at in range(0, k - 8, 8):
        out ^= out >> np.uint64(29)
        out += words[at:at + n]
        out *= np.uint64(0xBF58476D1CE4E5B9)
    return mixed(out)


def anchors(data: np.ndarray, bounds: np.ndarray, length: int, k: int):
    """Anchor places of all texts: place, hash, first and last start of the strings that it stands for."""
    width = length - k + 1
    inside = np.maximum(np.diff(bounds) - length + 1, 0)
    if not inside.any():
        return tuple(np.zeros(0, t) for t in (np.int64, np.uint64, np.int64, np.int64))
    grams = gram_hashes(data, k)
    bits = np.uint64(max(1, int(len(grams)).bit_length()))
    # the place below the hash: the least is the leftmost of equal ones
    best = (grams >> bits << bits) | np.arange(len(grams), dtype=np.uint64)
    have = 1
    while have < width:  # least of each window, by doubling
        step = min(have, width - have)
        best = np.minimum(best[:-step], best[step:])
        have += step
    starts = np.repeat(bounds[:-1] - (np.cumsum(inside) - inside), inside) + np.arange(inside.sum())
    place = (best[starts] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    new = np.append(True, (place[1:] != place[:-1]) | (np.diff(starts) != 1))
    head = np.flatnonzero(new)
    last = np.append(head[1:], len(starts)) - 1
    return place[head], grams[place[head]], starts[head], starts[last]


# ---- the run-length index ----

FIRST, FURTHER = 8, 5  # bytes compared in the first round of sorting, and in each further one


def suffix_order(symbols: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of all suffixes, each up to the end of its context, ties by place; and bytes that a row is known to share with the one above."""
    n = len(symbols)
    words = np.ndarray(n, ">u8", np.concatenate((symbols, np.zeros(8, np.uint8))), strides=(1,)).astype(np.uint64)

    def block(at: np.ndarray, depth: int) -> np.ndarray:
        left = ends[at] - at - depth  # symbols of the context that remain
        cut = (np.clip(8 - left, 0, 7) * 8).astype(np.uint64)
        return np.where(left > 0, words[np.minimum(at + depth, n - 1)] >> cut << cut, np.uint64(0))

    key = block(np.arange(n), 0)
    order = np.argsort(key)
    key = key[order]
    shared = np.zeros(n, np.int32)
    tied = np.append(False, key[1:] == key[:-1])
    if n >= 1 << 23:  # a group's number is packed above 41 bits
        raise OverflowError(f"{n} symbols in one index")
    depth = FIRST
    while tied.any():
        shared[tied] = depth
        rows = np.flatnonzero(tied | np.append(tied[1:], False))
        at = order[rows]
        group = np.cumsum(~tied[rows]).astype(np.uint64)
        ended = ends[at] - at <= depth
        # rows of a group by their next bytes; contexts that have ended come first, by place
        key = (group << np.uint64(41)) | np.where(ended, at.astype(np.uint64), block(at, depth) >> np.uint64(24) | np.uint64(1 << 40))
        by = np.argsort(key)
        order[rows], key, ended = at[by], key[by], ended[by]
        tied = np.zeros(n, bool)
        tied[rows] = np.append(False, (key[1:] == key[:-1]) & ~ended[1:])
        depth += FURTHER
    return order, shared


@dataclass
class RunIndex:
    """Run-compressed transform of contexts (symbols 1..255, each context closed by 0).

    Runs are kept by symbol and first row, with the symbol's count before them and the text places of their first and last rows.
    ``above``/``below`` give, from these samples alone, the place in the row before or after that of a given place.
    """
    n: int
    less: np.ndarray
    run_of: np.ndarray  # per row, its run
    key: np.ndarray
    symbol: np.ndarray
    start: np.ndarray
    size: np.ndarray
    before: np.ndarray
    first: np.ndarray
    last: np.ndarray
    above: tuple[np.ndarray, np.ndarray]
    below: tuple[np.ndarray, np.ndarray]
    group: tuple[np.ndarray, np.ndarray]  # per row, bounds of the rows that share length - 1 symbols

    @classmethod
    def build(cls, symbols: np.ndarray, ends: np.ndarray, length: int) -> RunIndex:
        n = len(symbols)
        order, shared = suffix_order(symbols, ends)
        previous = np.where(order > 0, symbols[order - 1], 0)
        depth = length - 1
        rows = np.flatnonzero(shared > depth - (FIRST if depth < FIRST else FURTHER))
        rows = rows[rows > 0]
        for j in range(max(0, depth - FIRST), depth):
            a, b = order[rows] + j, order[rows - 1] + j
            fits = (a < ends[order[rows]]) & (b < ends[order[rows - 1]])
            rows = rows[fits & (symbols[np.minimum(a, n - 1)] == symbols[np.minimum(b, n - 1)])]
        same = np.zeros(n, bool)
        same[rows] = True
        heads = np.flatnonzero(~same)
        number = np.cumsum(~same) - 1
        group = heads[number], np.append(heads[1:], n)[number]
        # the closing symbols are distinct ones in truth, so each is a run of its own
        start = np.flatnonzero(np.append(True, (previous[1:] != previous[:-1]) | (previous[1:] == 0)))
        size = np.diff(np.append(start, n))
        symbol = previous[start].astype(np.int64)
        first, last = order[start], order[start + size - 1]
        up, down = np.argsort(first), np.argsort(last)
        above = first[up], np.append(-1, last[:-1])[up]
        below = last[down], np.append(first[1:], -1)[down]
        by = np.argsort(symbol * (n + 1) + start)
        rank = np.empty(len(by), np.int32)
        rank[by] = np.arange(len(by), dtype=np.int32)
        total = np.cumsum(size[by]) - size[by]
        new = np.append(True, symbol[by][1:] != symbol[by][:-1])
        counts = np.bincount(symbols, minlength=256)
        return cls(n, np.cumsum(counts) - counts, np.repeat(rank, size), (symbol * (n + 1) + start)[by], symbol[by], start[by], size[by],
                   total - total[np.flatnonzero(new)][np.cumsum(new) - 1], first[by], last[by], above, below, group)

    def rank(self, symbol: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How often a symbol precedes the rows before ``row``; and the last run of it that starts before (-1: none)."""
        run = np.searchsorted(self.key, symbol * (self.n + 1) + row) - 1
        none = (run < 0) | (self.key[run] < symbol * (self.n + 1))
        count = self.before[run] + np.minimum(row - self.start[run], self.size[run])
        return np.where(none, 0, count), np.where(none, -1, run)

    def step(self, symbol, lo, hi, row, place):
        """Extend matches to the left: rows [lo, hi), and one of them with its text place."""
        run = self.run_of[lo]
        moved = self.less[symbol] + self.before[run] - self.start[run]
        out = moved + lo, moved + hi, moved + row, place - 1
        # only matches whose rows are not all in one run of the symbol need a search
        at = np.flatnonzero((self.symbol[run] != symbol) | (hi > self.start[run] + self.size[run]))
        if len(at):
            for whole, part in zip(out, self.search(symbol[at], lo[at], hi[at], row[at], place[at])):
                whole[at] = part
        return out

    def search(self, symbol, lo, hi, row, place):
        """``step`` for matches whose rows are in several runs."""
        base = self.less[symbol]
        new_lo, _ = self.rank(symbol, lo)
        new_hi, run = self.rank(symbol, hi)
        own = self.run_of[row]
        stays = self.symbol[own] == symbol
        end = self.start[run] + self.size[run] - 1
        at_end = end < hi  # else the run goes on below, so it starts among the rows
        jump = np.where(at_end, end, self.start[run])
        sample = np.where(at_end, self.last[run], self.first[run])
        jumped = self.before[run] + jump - self.start[run]
        row = base + np.where(stays, self.before[own] + row - self.start[own], jumped)
        place = np.where(stays, place, sample) - 1
        return base + new_lo, base + new_hi, row, place

    def neighbours(self, which: tuple[np.ndarray, np.ndarray], place: np.ndarray) -> np.ndarray:
        """The place one row up or down: that of the nearest sampled place before it, moved along."""
        sampled, other = which
        at = np.searchsorted(sampled, place, side="right") - 1
        return other[at] + place - sampled[at]


def earliest(symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray, owner: np.ndarray, length: int):
    """For every string of ``length`` symbols in contexts that are closed by 0: context, offset, and the least owner among its occurrences.

    ``ends`` is the place of the closing 0.  Matching statistics of all contexts are streamed in lockstep from their right ends: each
    step extends the match by one symbol, after dropping its last symbol where it has full length.
    """
    close = np.repeat(ends, ends + 1 - starts)
    index = RunIndex.build(symbols, close, length)
    context_of = np.repeat(np.arange(len(starts)), ends + 1 - starts)
    sizes = ends - starts
    order = np.argsort(-sizes, kind="stable")
    longest = -sizes[order]
    top = int(sizes.max(initial=0))
    lo, hi = np.zeros(len(order), np.int64), np.full(len(order), index.n, np.int64)
    row, place = np.zeros(len(order), np.int64), np.full(len(order), index.first[np.argmin(index.start)], np.int64)
    found = []
    for t in range(top):
        live = np.searchsorted(longest, -t, side="left")
        who = order[:live]
        lo, hi, row, place = lo[:live], hi[:live], row[:live], place[:live]
        if t >= length:
            lo, hi = index.group[0][lo], index.group[1][lo]
        symbol = symbols[ends[who] - 1 - t].astype(np.int64)
        lo, hi, row, place = index.step(symbol, lo, hi, row, place)
        if t + 1 >= length:
            found.append((who, sizes[who] - 1 - t, lo, hi, row, place))
    if not found:
        return tuple(np.zeros(0, np.int64) for _ in range(3))
    who, offset, lo, hi, row, place = (np.concatenate(x) for x in zip(*found))
    _, one, back = np.unique(lo, return_index=True, return_inverse=True)
    least = owner[context_of[place[one]]]
    for which, count in ((index.above, row[one] - lo[one]), (index.below, hi[one] - 1 - row[one])):
        at, here = np.flatnonzero(count > 0), place[one]
        moved = 0
        while len(at):  # locate all occurrences of the distinct strings, one row further each time
            here[at] = index.neighbours(which, here[at])
            least[at] = np.minimum(least[at], owner[context_of[here[at]]])
            moved += 1
            at = at[count[at] > moved]
    return who, offset, least[back]



# ---- packed arrays ----

def pack(array: np.ndarray) -> bytes:
    """Compress an array; its bytes are regrouped by significance first."""
    return zstandard.ZstdCompressor(1).compress(np.ascontiguousarray(np.ascontiguousarray(array).view(np.uint8).reshape(len(array), array.itemsize).T).tobytes())


def unpack(packed: bytes, kind) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


@dataclass
class Chunk:
    name: str
    ids: np.ndarray
    bounds: np.ndarray
    data: np.ndarray
    copies: np.ndarray  # whether a text is a copy of one with a smaller id

    @classmethod
    def of(cls, row: dict, beside: pa.Table) -> Chunk:
        data = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["blob"]), np.uint8)
        ids = unpack(row["ids"], np.int64)
        copies = np.zeros(len(ids), bool)
        copies[[no for some in beside["copies"].to_pylist() for no in some or ()]] = True
        return cls(row["chunk"], ids, unpack(row["bounds"], np.int64), data, copies)

    def anchors(self, length: int, k: int):
        """``anchors`` of all texts but copies, a slice of them at a time."""
        parts, lo = [], 0
        while lo < len(self.ids):
            hi = max(lo + 1, int(np.searchsorted(self.bounds, self.bounds[lo] + SLICE_BYTES, side="right")) - 1)
            at = self.bounds[lo]
            place, gram, first, last = anchors(self.data[at:self.bounds[hi]], self.bounds[lo:hi + 1] - at, length, k)
            own = ~self.copies[np.searchsorted(self.bounds, place + at, side="right") - 1]
            # anchors have low hashes, so they are hashed once more to fill the buckets evenly
            key = mixed(gram[own] ^ np.uint64(BASE)) >> np.uint64(64 - HASH_BITS)
            parts.append((place[own] + at, key, first[own] + at, last[own] + at))
            lo = hi
        if not parts:
            return anchors(self.data, self.bounds, length, k)
        return tuple(np.concatenate(x) for x in zip(*parts))


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets are ranges of hashes."""
    return ((hashes >> np.uint64(HASH_BITS - 32)) * np.uint64(buckets)) >> np.uint64(32)


# ---- the steps ----

def pack_chunks(docs: DataFrame, id_col: str, text_col: str, keep: tuple[str, ...]) -> DataFrame:
    """Texts in chunks of a bounded size; ``rest`` holds the other columns that are kept."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.struct(F.lit(1).alias("_"), *keep).alias("kept"))

    def run(batches):
        number = 0
        for batch in text_slices(batches, "text", CHUNK_BYTES):
            data, bounds = byte_view(batch.column("text"))
            kept = batch.select(["kept"])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, kept.schema) as writer:
                writer.write_batch(kept)
            ids = batch.column("id").fill_null(NO_ID).to_numpy(zero_copy_only=False)
            raw = data.tobytes()
            digests = b"".join(blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(bounds.tolist(), bounds[1:].tolist()))
            squeeze = zstandard.ZstdCompressor(1).compress
            yield pa.RecordBatch.from_pydict({
                "chunk": [f"{TaskContext.get().partitionId()}-{number}"], "bytes": [len(data)], "ids": [pack(ids)], "bounds": [pack(bounds)],
                "digests": [digests], "blob": [squeeze(raw)], "rest": [squeeze(sink.getvalue().to_pybytes())]})
            number += 1

    return staged(rows.mapInArrow(frugal(run), "chunk string, bytes long, ids binary, bounds binary, digests binary, blob binary, rest binary"), "chunks")


def later_copies(chunks: DataFrame, length: int) -> DataFrame:
    """Per chunk, the numbers of the texts of ``length`` bytes or more that a smaller id holds as a whole."""
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                size = np.diff(unpack(row["bounds"], np.int64))
                no = np.flatnonzero(size >= length)
                digests = pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(size), [None, pa.py_buffer(row["digests"])])
                yield pa.RecordBatch.from_arrays(
                    [digests.take(pa.array(no)).cast(pa.binary()), pa.array(unpack(row["ids"], np.int64)[no]), pa.array([row["chunk"]] * len(no), pa.string()),
                     pa.array(no.astype(np.int32))], ["digest", "id", "chunk", "no"])

    texts = chunks.select("chunk", "ids", "bounds", "digests").mapInArrow(frugal(run), "digest binary, id long, chunk string, no int")
    first = staged(texts.groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "copies")
    return staged(texts.join(first, "digest").where("id > first").groupBy("chunk").agg(F.collect_list("no").alias("copies")), "copies")


def anchor_counts(chunk: Chunk, length: int, k: int):
    """Distinct anchor hashes of a chunk in order, how often each stands there, and whether in texts of different ids."""
    place, hashes, _, _ = chunk.anchors(length, k)
    ids = chunk.ids[np.searchsorted(chunk.bounds, place, side="right") - 1]
    order = np.lexsort((ids, hashes))
    hashes, ids = hashes[order], ids[order]
    head = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1])) if len(hashes) else np.zeros(0, np.int64)
    tail = np.append(head[1:], len(hashes)) - 1 if len(head) else head
    return hashes[head], tail - head + 1, ids[head] != ids[tail]


def beside_chunks(chunks: DataFrame, other: DataFrame, run, schema) -> DataFrame:
    """Call ``run(chunk row, rows of the other table)`` for every chunk.  The chunks are shuffled alike each time, so Spark does it once."""
    def call(left: pa.Table, right: pa.Table) -> pa.Table:
        return run(left.to_pylist()[0], right)

    return chunks.groupBy("chunk").cogroup(other.groupBy("chunk")).applyInArrow(frugal(call), schema)


def send_anchors(chunks: DataFrame, copies: DataFrame, buckets: int, length: int, k: int) -> DataFrame:
    def run(row: dict, beside: pa.Table) -> pa.Table:
        hashes, times, several = anchor_counts(Chunk.of(row, beside), length, k)
        cuts = np.searchsorted(bucket_of(hashes, buckets), np.arange(buckets + 1, dtype=np.uint64))
        out = []
        for b in np.flatnonzero(np.diff(cuts)).tolist():
            part = slice(cuts[b], cuts[b + 1])
            out.append({"bucket": b, "chunk": row["chunk"], "hashes": pack(np.diff(hashes[part], prepend=np.uint64(0))),
                        "times": pack((times[part] * 2 + several[part]).astype(np.uint32)), "n": int(cuts[b + 1] - cuts[b])})
        return pa.Table.from_pylist(out, schema=pa.schema([
            ("bucket", pa.int32()), ("chunk", pa.string()), ("hashes", pa.binary()), ("times", pa.binary()), ("n", pa.int32())]))

    return beside_chunks(chunks, copies, run, "bucket int, chunk string, hashes binary, times binary, n int")


def shared_anchors(sent: DataFrame, hot: int, most: int) -> DataFrame:
    """Per chunk and bucket, for the hashes that were sent: bit 0 if two ids hold the anchor, bit 1 if it is a hot one, bit 2 if it stands
    in more than ``most`` places."""
    def run(table: pa.Table) -> pa.Table:
        hashes = np.concatenate([np.cumsum(unpack(x, np.uint64), dtype=np.uint64) for x in table["hashes"].to_pylist()])
        times = np.concatenate([unpack(x, np.uint32) for x in table["times"].to_pylist()]).astype(np.int64)
        _, place, holders = np.unique(hashes, return_inverse=True, return_counts=True)
        total = np.bincount(place, times >> 1)
        marked = (holders > 1) | (np.bincount(place, times & 1) > 0)
        flags = (marked + 2 * (total > hot) + 4 * (total > most)).astype(np.uint8)[place]
        parts = np.split(flags, np.cumsum(table["n"].to_numpy())[:-1])
        return pa.table({"chunk": table["chunk"], "bucket": table["bucket"], "flags": pa.array([pack(x) for x in parts], pa.binary())})

    return sent.groupBy("bucket").applyInArrow(frugal(run), "chunk string, bucket int, flags binary")


CONTEXTS = pa.schema([("bucket", pa.int32()), ("chunk", pa.string()), ("keys", pa.binary()), ("ids", pa.binary()), ("docs", pa.binary()),
                      ("starts", pa.binary()), ("sizes", pa.binary()), ("offsets", pa.binary()), ("bytes", pa.binary()), ("n", pa.int32()), ("marks", pa.binary()),
                      ("strings", pa.int32())])


def sliced_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """``span_hashes``, a slice of the data at a time."""
    out = np.zeros(len(starts), np.uint64)
    order = np.argsort(starts, kind="stable")
    cuts = [0, *(np.flatnonzero(np.diff(starts[order] // SLICE_BYTES)) + 1).tolist(), len(order)]
    for lo, hi in zip(cuts, cuts[1:]):
        at = order[lo:hi]
        if len(at):
            base = starts[at[0]]
            out[at] = span_hashes(data[base:ends[at].max()], starts[at] - base, ends[at] - base)
    return out


def gathered(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The bytes of spans, back to back."""
    at = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
    return data[at]


def equal_contexts(keys, texts, ids):
    """Sort places by (key, text, id); per place in that order the number of its context and whether its id is the least one there."""
    order = np.lexsort((ids, texts, keys))
    k, t, i = keys[order], texts[order], ids[order]
    new = np.append(True, (k[1:] != k[:-1]) | (t[1:] != t[:-1])) if len(order) else np.zeros(0, bool)
    number = np.cumsum(new) - 1
    return order, new, number, i == i[np.flatnonzero(new)][number] if len(order) else new


def contexts_of(chunk: Chunk, returned: list[dict], buckets: int, length: int, k: int) -> list[dict]:
    """What a chunk sends: its contexts of shared anchors, by bucket; and marks for those that a smaller id holds in the same chunk."""
    place, hashes, first, last = chunk.anchors(length, k)
    flags = [np.zeros(0, np.uint8), *(unpack(r["flags"], np.uint8) for r in sorted(returned, key=lambda r: r["bucket"]))]
    distinct, back = np.unique(hashes, return_inverse=True)
    flag = np.concatenate(flags)[back] if len(distinct) else np.zeros(0, np.uint8)
    chosen = (flag & 1) > 0
    spread = chosen & ((flag & 4) > 0)
    out = strings_of(chunk, first[spread], last[spread], buckets, length)
    chosen &= ~spread
    place, hashes, first, last, hot = place[chosen], hashes[chosen], first[chosen], last[chosen], flag[chosen] > 1
    # A string with a hot anchor holds all of the ``side`` bytes left of it, or right of it: its starts are parted by which.
    side = (length - k) // 2
    left, right = hot & (first <= place - side), hot & (last > place - side)
    parts = [(hashes[~hot], first[~hot], last[~hot], place[~hot])]
    for which, lo, hi, beside in ((left, first, np.minimum(last, place - side), place - side), (right, np.maximum(first, place - side + 1), last, place + k)):
        at = np.flatnonzero(which)
        near = sliced_hashes(chunk.data, beside[at], beside[at] + side)
        parts.append((mixed(hashes[at] ^ near ^ np.uint64(which is right)) >> np.uint64(64 - HASH_BITS), lo[at], hi[at], place[at]))
    keys, first, last, place = (np.concatenate(x) for x in zip(*parts))
    sizes = last - first + length
    docs = np.searchsorted(chunk.bounds, first, side="right") - 1
    texts = sliced_hashes(chunk.data, first, first + sizes)
    order, _, _, least = equal_contexts(keys, texts, chunk.ids[docs])
    later = order[~least]
    starts = first - chunk.bounds[docs]
    marks = (docs[later], starts[later], starts[later] + sizes[later])
    order = order[least]
    cuts = np.searchsorted(bucket_of(keys[order], buckets), np.arange(buckets + 1, dtype=np.uint64))
    for b in np.flatnonzero(np.diff(cuts)).tolist():
        at = order[cuts[b]:cuts[b + 1]]
        text = gathered(chunk.data, first[at], sizes[at])
        out.append({"bucket": b, "chunk": chunk.name, "keys": pack(keys[at]), "ids": pack(chunk.ids[docs[at]]), "docs": pack(docs[at].astype(np.int32)),
                    "starts": pack(starts[at]), "sizes": pack(sizes[at].astype(np.int32)), "offsets": pack((place[at] - first[at]).astype(np.int32)),
                    "bytes": zstandard.ZstdCompressor(1).compress(text.tobytes()), "n": len(at), "marks": None})
    if len(later):
        out.append({"bucket": int(keys[later[0]] % np.uint64(buckets)), "chunk": chunk.name, "n": 0, "marks": pack_marks(*marks)})
    return out


def strings_of(chunk: Chunk, first: np.ndarray, last: np.ndarray, buckets: int, length: int) -> list[dict]:
    """What a chunk sends for anchors with too many contexts: the hash of every string, by bucket, equal ones for the least id alone; and
    marks for those that a smaller id holds among the strings that are hashed at once."""
    out, lo = [], 0
    number = last - first + 1
    upto = np.cumsum(number)
    while lo < len(first):
        hi = max(lo + 1, int(np.searchsorted(upto, upto[lo] - number[lo] + STRINGS, side="right")))
        n = number[lo:hi]
        starts = np.repeat(first[lo:hi] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        docs = np.searchsorted(chunk.bounds, starts, side="right") - 1
        hashes = sliced_hashes(chunk.data, starts, starts + length)
        order, _, _, least = equal_contexts(hashes, hashes, chunk.ids[docs])
        later, order = order[~least], order[least]
        cuts = np.searchsorted(bucket_of(hashes[order] >> np.uint64(64 - HASH_BITS), buckets), np.arange(buckets + 1, dtype=np.uint64))
        for b in np.flatnonzero(np.diff(cuts)).tolist():
            at = order[cuts[b]:cuts[b + 1]]
            out.append({"bucket": b, "chunk": chunk.name, "keys": pack(hashes[at]), "ids": pack(chunk.ids[docs[at]]), "docs": pack(docs[at].astype(np.int32)),
                        "starts": pack(starts[at] - chunk.bounds[docs[at]]), "n": 0, "marks": None, "strings": len(at)})
        if len(later):
            at, begin, end = joined_spans(docs[later], starts[later], starts[later] + length)
            out.append({"bucket": int(hashes[later[0]] % np.uint64(buckets)), "chunk": chunk.name, "n": 0,
                        "marks": pack_marks(at, begin - chunk.bounds[at], end - chunk.bounds[at])})
        lo = hi
    return out


def pack_marks(docs, starts, ends) -> bytes:
    return pack(np.concatenate((docs, starts, ends)).astype(np.int64))


def unpack_marks(packed: bytes) -> np.ndarray:
    return unpack(packed, np.int64).reshape(3, -1)


def send_contexts(chunks: DataFrame, copies: DataFrame, flags: DataFrame, buckets: int, length: int, k: int) -> DataFrame:
    def run(row: dict, beside: pa.Table) -> pa.Table:
        returned = beside.filter(beside["flags"].is_valid()).to_pylist()
        return pa.Table.from_pylist(contexts_of(Chunk.of(row, beside), returned, buckets, length, k), schema=CONTEXTS)

    kinds = {pa.int32(): "int", pa.string(): "string", pa.binary(): "binary"}
    other = flags.unionByName(copies, allowMissingColumns=True)
    return beside_chunks(chunks, other, run, ", ".join(f"{f.name} {kinds[f.type]}" for f in CONTEXTS))


def match_contexts(sent: DataFrame, length: int, k: int) -> DataFrame:
    """Marks per chunk: strings that a smaller id holds, found by the index of the bucket's contexts.

    Equal contexts are indexed once, for the least id; other ids that hold them are marked whole.  A context has nothing to match and is left
    out of the index if no other context of its anchor has the same bytes beside the anchor (``may_match``).  Strings that were sent as hashes are compared
    as such.
    """
    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        done = [(r["chunk"], unpack_marks(r["marks"])) for r in rows if r["marks"] is not None]
        strings = [r for r in rows if r["strings"]]
        if strings:
            done += marks_of_strings(strings, length)
        rows = [r for r in rows if r["n"]]
        if rows:
            done += marks_in(rows, length, k)
        per_chunk: dict[str, list[np.ndarray]] = {}
        for chunk, marks in done:
            per_chunk.setdefault(chunk, []).append(marks)
        return pa.table({"chunk": pa.array(list(per_chunk), pa.string()),
                         "marks": pa.array([pack_marks(*np.concatenate(m, axis=1)) for m in per_chunk.values()], pa.binary())})

    return sent.groupBy("bucket").applyInArrow(frugal(run), "chunk string, marks binary")


def may_match(data: np.ndarray, keys: np.ndarray, begin: np.ndarray, sizes: np.ndarray, offsets: np.ndarray, length: int, k: int) -> np.ndarray:
    """Whether a context can share a string with another one of its key.  Equal strings hold their anchor at the same place.  Their starts are
    parted by how far left of the anchor they are: what all strings of a part hold has to be the same in both contexts.
    """
    out = np.zeros(len(keys), bool)
    room = length - k  # bytes of a string beside its anchor
    cuts = np.unique(np.linspace(0, room + 1, PARTS + 1).astype(np.int64))
    for least, most in zip(cuts.tolist(), (cuts[1:] - 1).tolist()):
        reach = k + room - most  # from the anchor on
        at = np.flatnonzero((offsets >= least) & (offsets + reach <= sizes))
        place = begin[at] + offsets[at]
        held = mixed(keys[at] ^ sliced_hashes(data, place - least, place + reach))
        _, back, times = np.unique(held, return_inverse=True, return_counts=True)
        out[at[times[back] > 1]] = True
    return out


def marks_in(rows: list[dict], length: int, k: int) -> list[tuple[str, np.ndarray]]:
    column = lambda name, kind: np.concatenate([unpack(r[name], kind) for r in rows])
    keys, ids, docs = column("keys", np.uint64), column("ids", np.int64), column("docs", np.int32).astype(np.int64)
    starts, sizes, offsets = column("starts", np.int64), column("sizes", np.int32).astype(np.int64), column("offsets", np.int32).astype(np.int64)
    chunk = np.repeat(np.arange(len(rows)), [r["n"] for r in rows])
    data = np.frombuffer(b"".join(zstandard.ZstdDecompressor().decompress(r["bytes"]) for r in rows), np.uint8)
    begin = np.cumsum(sizes) - sizes
    order, new, number, least = equal_contexts(keys, sliced_hashes(data, begin, begin + sizes), ids)
    later = order[~least]
    found = [(later, starts[later], starts[later] + sizes[later])]

    one = order[new]                       # a place of each distinct context, by key
    kept = np.flatnonzero(may_match(data, keys[one], begin[one], sizes[one], offsets[one], length, k))  # numbers of the contexts that are indexed
    holders, holder_of = order[least], number[least]
    begin_of = np.searchsorted(holder_of, np.arange(len(one) + 1))
    lo = 0
    while lo < len(kept):
        grown = np.cumsum(sizes[one[kept[lo:]]] + 1)
        hi = lo + max(1, int(np.searchsorted(grown, INDEX_BYTES)))
        while hi < len(kept) and keys[one[kept[hi]]] == keys[one[kept[hi - 1]]]:
            hi += 1
        part = one[kept[lo:hi]]
        size = sizes[part]
        symbols = np.zeros(int((size + 1).sum()), np.uint8)
        at = np.cumsum(size + 1) - size - 1
        inside = np.repeat(at - (np.cumsum(size) - size), size) + np.arange(size.sum())
        symbols[inside] = gathered(data, begin[part], size) + 1  # UTF-8 has no byte 255
        who, offset, first = earliest(symbols, at, at + size, ids[part], length)
        dup = first < ids[part][who]
        who, offset = who[dup], offset[dup]
        by = np.lexsort((offset, who))
        who, offset = who[by], offset[by]
        if len(who):
            head = np.flatnonzero(np.append(True, (who[1:] != who[:-1]) | (np.diff(offset) != 1)))
            tail = np.append(head[1:], len(who)) - 1
            context = kept[lo:hi][who[head]]
            times = begin_of[context + 1] - begin_of[context]
            at = np.repeat(begin_of[context] - (np.cumsum(times) - times), times) + np.arange(times.sum())
            place = holders[at]
            found.append((place, starts[place] + np.repeat(offset[head], times), starts[place] + np.repeat(offset[tail] + length, times)))
        lo = hi
    place, first, last = (np.concatenate(x) for x in zip(*found))
    return marks_by_row(rows, chunk[place], docs[place], first, last)


def marks_of_strings(rows: list[dict], length: int) -> list[tuple[str, np.ndarray]]:
    column = lambda name, kind: np.concatenate([unpack(r[name], kind) for r in rows])
    hashes, docs, starts = column("keys", np.uint64), column("docs", np.int32).astype(np.int64), column("starts", np.int64)
    order, _, _, least = equal_contexts(hashes, hashes, column("ids", np.int64))
    later = order[~least]
    row = np.repeat(np.arange(len(rows)), [r["strings"] for r in rows])
    return marks_by_row(rows, row[later], docs[later], starts[later], starts[later] + length)


def marks_by_row(rows: list[dict], row: np.ndarray, docs: np.ndarray, first: np.ndarray, last: np.ndarray) -> list[tuple[str, np.ndarray]]:
    by = np.argsort(row, kind="stable")
    row, docs, first, last = row[by], docs[by], first[by], last[by]
    cuts = np.searchsorted(row, np.arange(len(rows) + 1))
    return [(r["chunk"], np.stack((docs[a:b], first[a:b], last[a:b]))) for r, a, b in zip(rows, cuts, cuts[1:]) if b > a]


def joined_spans(docs: np.ndarray, first: np.ndarray, last: np.ndarray):
    """Marks of the same text that meet or overlap as one."""
    order = np.lexsort((first, docs))
    docs, first, last = docs[order], first[order], last[order]
    reach = np.maximum.accumulate(last)  # places of a later text are larger
    new = np.append(True, (first[1:] > reach[:-1]) | (docs[1:] != docs[:-1])) if len(docs) else np.zeros(0, bool)
    head = np.flatnonzero(new)
    return docs[head], first[head], reach[np.append(head[1:], len(docs)) - 1] if len(head) else last


def cut_marks(chunks: DataFrame, copies: DataFrame, marks: DataFrame, keep: list[T.StructField]) -> DataFrame:
    """Cut the marked bytes and the copies out of the texts; in ``kept_text``, characters that lose a byte lose all."""
    counts = ["id", "n_bytes", "n_removed", "n_spans"]
    results = [*counts, "kept_bytes", "kept_text"]
    names = [kept_as(f.name, results) for f in keep]

    def run(row: dict, beside: pa.Table) -> pa.Table:
        chunk = Chunk.of(row, beside)
        n, size = len(chunk.ids), np.diff(chunk.bounds)
        gone = np.flatnonzero(chunk.copies)
        parts = [np.stack((gone, gone * 0, size[gone])), *(unpack_marks(x) for x in beside["marks"].to_pylist() if x is not None)]
        docs, first, last = np.concatenate(parts, axis=1)
        docs, first, last = joined_spans(docs, first + chunk.bounds[docs], last + chunk.bounds[docs])
        removed = np.bincount(docs, last - first, n).astype(np.int64)
        steps = np.zeros(len(chunk.data) + 1, np.int8)
        steps[first] += 1
        np.subtract.at(steps, last, 1)
        left_over = chunk.data[np.cumsum(steps[:-1], dtype=np.int8) == 0].tobytes()
        at = np.concatenate(([0], np.cumsum(size - removed))).tolist()
        texts = [left_over[a:b] for a, b in zip(at, at[1:])]
        kept = pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(row["rest"])).read_all()["kept"].combine_chunks()
        out = [pa.array(chunk.ids, mask=chunk.ids == NO_ID), pa.array(size), pa.array(removed), pa.array(np.bincount(docs, minlength=n)),
               pa.array(texts, pa.binary()), pa.array([x.decode("utf-8", "ignore") for x in texts], pa.string())]
        return pa.table(out + [kept.field(f.name) for f in keep], names=results + names)

    schema = T.StructType([*(T.StructField(c, T.LongType()) for c in counts), T.StructField("kept_bytes", T.BinaryType()),
                           T.StructField("kept_text", T.StringType()), *(T.StructField(n, f.dataType) for n, f in zip(names, keep))])
    return beside_chunks(chunks, marks.unionByName(copies, allowMissingColumns=True), run, schema)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 50, keep: tuple[str, ...] = (),
                   anchor: int = ANCHOR, hot: int = HOT, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """Remove every byte of a text that lies in a string of ``length`` bytes that also starts in a text with a smaller id.

    Texts are their UTF-8 bytes, matches never cross texts, and all strings are judged on the input.  One row per row of ``docs``: id,
    n_bytes, n_removed, n_spans (maximal removed runs), kept_bytes, kept_text, and the columns in ``keep`` (``_kept`` is added to names that clash).  Null texts are empty, and texts
    shorter than ``length`` stay.  Rows that share an id don't remove from each other; a null id counts as larger than all others.
    No rows in, no rows out.  ``anchor`` has to be smaller than ``length``.  No index holds more than ``group_bytes`` for one anchor.
    """
    chunks = pack_chunks(docs, id_col, text_col, keep)
    total = chunks.agg(F.sum("bytes")).first()[0] or 0
    buckets = max(1, -(-total // BUCKET_BYTES))
    anchor = min(anchor, length)
    copies = later_copies(chunks, length)
    most = group_bytes // (2 * length - anchor + 1)  # contexts with their closing symbols
    flags = shared_anchors(send_anchors(chunks, copies, buckets, length, anchor), hot, most)
    marks = match_contexts(send_contexts(chunks, copies, flags, buckets, length, anchor), length, anchor)
    return cut_marks(chunks, copies, marks, [docs.schema[c] for c in keep])
