"""SentencePiece encoding and decoding of BPE models with byte fallback, by suffix-array matching.

The distinct words of a batch are concatenated and their suffixes sorted.  Every piece is found by binary search as one range of suffixes; its
occurrences are the edges of a lattice.  Edges are sorted by where they end and relaxed from left to right: a prefix's encoding ends with the one
piece that is compatible with the last piece of the encoding before it, which is the merge order's own result.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from gridmill.llm.common import byte_view, frugal, kept_as, span_hashes, text_slices
from gridmill.llm.runindex import gathered, suffix_order

BATCH_BYTES = 1 << 20  # text whose distinct words are encoded together
INDEX_BYTES = 1 << 17  # words that are indexed at once
WINDOW_BYTES = 1 << 18  # a longer word is indexed in parts, its lattice goes on across them
LONG_WORD = 256        # longer words are cut where no piece can span
KNOWN_WORDS = 1 << 18  # words whose encoding a task remembers
DECODE_IDS = 1 << 17   # ids decoded together
MARK = "▁"  # the model's sign for a space
SPACE = 32       # stands for it in the index
NONE, START = -2, -1


def merge(parts: list[str], score: dict[str, float]) -> tuple[list[str], tuple[str, str] | None]:
    """Merge the neighbours of the highest score, the leftmost first, while there are any; and the last two that were merged."""
    parts, split = list(parts), None
    while len(parts) > 1:
        k = max(range(len(parts) - 1), key=lambda k: (score.get(parts[k] + parts[k + 1], -np.inf), -k))
        if parts[k] + parts[k + 1] not in score:
            break
        split = parts[k], parts[k + 1]
        parts[k:k + 2] = [parts[k] + parts[k + 1]]
    return parts, split


@dataclass
class Pieces:
    """The pieces of a model as arrays over ids; ``usable`` are those that texts are matched with."""
    size: int
    texts: list[bytes]        # with spaces for the marks; empty for control pieces
    usable: np.ndarray
    rank: np.ndarray          # order of merging, -1 for single characters
    left: np.ndarray
    right: np.ndarray
    pairs: np.ndarray         # left * size + right of all pairs that merge, sorted
    merged_rank: np.ndarray
    byte_ids: np.ndarray      # id of each byte's fallback piece
    most: int                 # marks of the longest piece of marks
    runs: list[list[int]]     # ids of a run of n marks, for n up to that

    @classmethod
    def load(cls, path: str) -> Pieces:
        """Read a model file; it has to be a BPE model whose marks only begin pieces, with pieces for all bytes."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        names = [model.id_to_piece(i) for i in range(size)]
        plain = [i for i in range(size) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        byte_ids = np.full(256, -1, np.int32)
        for i in range(size):
            if model.is_byte(i):
                byte_ids[int(names[i][1:-1], 16)] = i
        of_run = {names[i]: i for i in plain if set(names[i]) == {MARK}}
        most = max(map(len, of_run), default=0)
        run = lambda n: [of_run[x] for x in merge([MARK] * n, dict.fromkeys(of_run, 0.0))[0]]
        runs = [run(n) for n in range(most + 1)] if MARK in of_run else []
        rest = [i for i in plain if set(names[i]) != {MARK} or len(names[i]) == 1]
        score = {names[i]: model.get_score(i) for i in rest}
        merged = sorted((i for i in rest if len(names[i]) > 1), key=lambda i: -model.get_score(i))
        if any(MARK in names[i][1:] for i in rest) or len({score[names[i]] for i in merged}) < len(merged) or (byte_ids < 0).any() \
                or not runs or any(run(n) != runs[most] * (n // most) + runs[n % most] for n in range(most, 3 * most)):
            raise ValueError("not a BPE model with leading marks, distinct scores and byte pieces")
        ids = {names[i]: i for i in rest}
        rank = np.full(size + 1, -1, np.int64)
        rank[merged] = np.arange(len(merged))
        left, right = np.full(size + 1, -1, np.int64), np.full(size + 1, -1, np.int64)
        usable = np.zeros(size, bool)
        usable[[i for i in rest if len(names[i]) == 1]] = True
        pairs = []
        for i in merged:
            name = names[i]
            pairs += [(ids[name[:k]] * size + ids[name[k:]], rank[i]) for k in range(1, len(name)) if name[:k] in ids and name[k:] in ids]
            parts, split = merge(list(name), score)
            if len(parts) == 1:
                usable[i] = True
                left[i], right[i] = ids[split[0]], ids[split[1]]
        pairs.sort()
        texts = [b""] * size
        for i in plain:
            texts[i] = names[i].replace(MARK, " ").encode()
        for value, i in enumerate(byte_ids.tolist()):
            texts[i] = bytes([value])
        return cls(size, texts, usable, rank, left, right, np.array([p for p, _ in pairs], np.int64), np.array([r for _, r in pairs], np.int64),
                   byte_ids, most, runs)

    def compatible(self, before: np.ndarray, after: np.ndarray) -> np.ndarray:
        """Whether two pieces side by side stay apart when their joined text is encoded.

        Their merges are undone from the last one back.  At each moment the outermost parts at the border are known; the pieces join if
        those parts have a merge that comes before the next one on either side (of equal ones, the left one is first).
        """
        x, y = before.copy(), after.copy()
        out = np.ones(len(x), bool)
        limit = np.full(len(x), np.iinfo(np.int64).max)
        live = np.flatnonzero((x >= 0) & (x < self.size) & (y < self.size))
        while len(live):
            a, b = x[live], y[live]
            key = a * self.size + b
            at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
            joins = (self.pairs[at] == key) & (self.merged_rank[at] < limit[live])
            out[live[joins]] = False
            ra, rb = self.rank[a], self.rank[b]
            go = ~joins & ((ra >= 0) | (rb >= 0))
            live, a, b, ra, rb = live[go], a[go], b[go], ra[go], rb[go]
            first = ra > rb
            limit[live] = np.where(first, ra, rb + 1)
            x[live], y[live] = np.where(first, self.right[a], a), np.where(first, b, self.left[b])
        return out


@lru_cache(maxsize=4)
def load(path: str) -> Pieces:
    return Pieces.load(path)


class Lattice:
    """Encodes batches of distinct words; remembers which pairs of pieces are compatible."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.ids = np.flatnonzero(pieces.usable)
        texts = [pieces.texts[i] for i in self.ids]
        self.sizes = np.array([len(t) for t in texts], np.int64)
        self.single = pieces.rank[self.ids] < 0
        self.depth = -(-int(self.sizes.max()) // 8) * 8
        self.words = np.frombuffer(b"".join(t.ljust(self.depth, b"\0") for t in texts), ">u8").reshape(len(texts), -1).astype(np.uint64)
        self.known, self.answer = np.zeros(0, np.int64), np.zeros(0, bool)
        self.joined = np.zeros((256, 256), bool)  # bytes that stand side by side in a piece
        for t in texts:
            pair = np.frombuffer(t, np.uint8)
            self.joined[pair[:-1], pair[1:]] = True
        # Words met lately: hash, number of the last batch that had it, and where its ids lie in the pool.
        self.batch = 0
        self.words_known = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.int32)

    def occurrences(self, symbols: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start place and piece (its number among the usable ones) of every occurrence of every piece."""
        n = len(symbols)
        ends = np.minimum(ends, np.arange(n) + self.depth)  # no piece is longer
        order, _ = suffix_order(symbols, ends)
        padded = np.concatenate((symbols, np.zeros(8, np.uint8)))
        words = np.zeros(n, np.uint64)
        for j in range(8):
            words = (words << np.uint64(8)) | padded[j:n + j].astype(np.uint64)

        def block(row: np.ndarray, depth: int) -> np.ndarray:
            at = order[row]
            cut = (np.clip(8 - (ends[at] - at - depth), 0, 8) * 8).astype(np.uint64)
            value = words[np.minimum(at + depth, n - 1)]
            return np.where(cut >= 64, np.uint64(0), (value >> np.minimum(cut, np.uint64(63))) << np.minimum(cut, np.uint64(63)))

        lo, hi = np.zeros(len(self.ids), np.int64), np.full(len(self.ids), n, np.int64)
        for depth in range(0, self.depth, 8):
            part = np.flatnonzero((self.sizes > depth) & (lo < hi))
            if not len(part):
                break
            low = self.words[part, depth // 8]
            free = (np.clip(8 - (self.sizes[part] - depth), 0, 7) * 8).astype(np.uint64)
            high = low | ((np.uint64(1) << free) - np.uint64(1))
            for target, above in ((low, False), (high, True)):
                a, b = lo[part].copy(), hi[part].copy()
                while (a < b).any():
                    middle = (a + b) // 2
                    value = block(np.minimum(middle, n - 1), depth)
                    right = (value <= target if above else value < target) & (a < b)
                    a, b = np.where(right, middle + 1, a), np.where(right, b, np.where(a < b, middle, b))
                if above:
                    hi[part] = a
                else:
                    floor = a
            lo[part] = floor
        count = np.maximum(hi - lo, 0)
        rows = np.repeat(lo - (np.cumsum(count) - count), count) + np.arange(count.sum())
        return order[rows], np.repeat(np.arange(len(self.ids)), count)

    def fits(self, before: np.ndarray, after: np.ndarray) -> np.ndarray:
        size = self.pieces.size + 2
        key, back = np.unique((before + 2) * size + after, return_inverse=True)
        at = np.minimum(np.searchsorted(self.known, key), max(len(self.known) - 1, 0))
        new = self.known[at] != key if len(self.known) else np.ones(len(key), bool)
        if new.any():
            fresh = key[new]
            found = self.pieces.compatible(fresh // size - 2, fresh % size)
            known, answer = np.concatenate((self.known, fresh)), np.concatenate((self.answer, found))
            order = np.argsort(known, kind="stable")
            self.known, self.answer = known[order], answer[order]
            at = np.searchsorted(self.known, key)
        return self.answer[at][back]

    def encode(self, symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of all words, back to back, and how many each word has; ``pieces.size`` + byte stands for a byte of a character without a piece."""
        unk = self.pieces.size
        if not len(starts):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        whole, starts, ends = (starts, *self.cut(symbols, starts, ends))
        base, stops = np.repeat(starts, ends - starts), np.repeat(ends, ends - starts)
        # A boundary is kept by the place before it, so that the end of a word and the start of the next are two.
        last, length = np.full(len(symbols) + 1, NONE, np.int64), np.ones(len(symbols) + 1, np.int64)
        for low in range(0, len(symbols), WINDOW_BYTES):
            high = min(low + WINDOW_BYTES, len(symbols))
            far = min(high + self.depth, len(symbols))
            begin, which = self.occurrences(symbols[low:far], np.minimum(stops[low:far], far) - low)
            own = begin < high - low
            begin, which = begin[own] + low, which[own]
            size, piece = self.sizes[which], self.ids[which].astype(np.int64)
            lead = np.flatnonzero((symbols[low:far] & 0xC0) != 0x80) + low
            covered = np.zeros(far - low, bool)
            covered[begin[self.single[which]] - low] = True
            lone = lead[(lead < high) & ~covered[lead - low]]
            width = np.append(lead[1:], len(symbols))[np.searchsorted(lead, lone)] - lone
            begin, size, piece = np.concatenate((begin, lone)), np.concatenate((size, width)), np.concatenate((piece, np.full(len(lone), unk)))
            stop = begin + size - base[begin]
            order = np.argsort(stop, kind="stable")
            begin, size, piece, stop = begin[order], size[order], piece[order], stop[order]
            cuts = [0, *(np.flatnonzero(np.diff(stop)) + 1).tolist(), len(stop)]
            first = begin == base[begin]
            for lo, hi in zip(cuts, cuts[1:]):
                before = np.where(first[lo:hi], START, last[begin[lo:hi] - 1])
                ok = before != NONE
                ok[ok] = self.fits(before[ok], piece[lo:hi][ok])
                at = begin[lo:hi][ok] + size[lo:hi][ok] - 1
                last[at], length[at] = piece[lo:hi][ok], size[lo:hi][ok]
        place, word = ends - 1, np.arange(len(starts))
        chain = []
        while len(place):
            chain.append((word, place, last[place]))
            place = place - length[place]
            on = place >= starts[word]
            place, word = place[on], word[on]
        word, place, token = (np.concatenate(x) for x in zip(*chain))
        order = np.argsort(place, kind="stable")
        word, place, token = word[order], place[order], token[order]
        wide = np.where(token == unk, length[place], 1)
        out, word = np.repeat(token, wide), np.repeat(word, wide)
        raw = np.flatnonzero(out == unk)
        nth = np.arange(len(out)) - np.repeat(np.cumsum(wide) - wide, wide)
        out[raw] = unk + symbols[(np.repeat(place - length[place] + 1, wide) + nth)[raw]].astype(np.int64)
        return out, np.add.reduceat(np.bincount(word, minlength=len(starts)), np.searchsorted(starts, whole))

    def cut(self, symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bounds of the words' parts: long words are cut between characters whose bytes stand side by side in no piece, so that no merge runs over a cut."""
        places = [starts]
        for lo, hi in zip(*(x[ends - starts > LONG_WORD].tolist() for x in (starts, ends))):
            at = np.arange(lo + 1, hi)
            places.append(at[((symbols[lo + 1:hi] & 0xC0) != 0x80) & ~self.joined[symbols[lo:hi - 1], symbols[lo + 1:hi]]])
        parts = np.sort(np.concatenate(places))
        return parts, np.append(parts[1:], len(symbols))

    def encoded(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of the words in these spans, each with a space before it: a pool of ids, and where each word's ids lie in it."""
        pieces = self.pieces
        hashes, one, back = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
        known, used, head, count = self.words_known
        at = np.minimum(np.searchsorted(known, hashes), max(len(known) - 1, 0))
        new = known[at] != hashes if len(known) else np.ones(len(hashes), bool)
        self.batch += 1
        used[at[~new]] = self.batch
        fresh = one[new]
        size = ends[fresh] - starts[fresh]
        parts = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        cuts = [0, *(np.flatnonzero(np.diff(np.cumsum(size + 1) // INDEX_BYTES)) + 1).tolist(), len(fresh)]
        for lo, hi in zip(cuts, cuts[1:]):
            part = size[lo:hi]
            place = np.cumsum(part + 1) - part - 1
            symbols = np.full(int((part + 1).sum()), SPACE, np.uint8)
            symbols[np.repeat(place + 1 - (np.cumsum(part) - part), part) + np.arange(part.sum())] = gathered(data, starts[fresh[lo:hi]], part)
            parts.append(self.encode(symbols, place, place + part + 1))
        tokens, counts = (np.concatenate(x) for x in zip(*parts))
        tokens = np.concatenate((np.arange(pieces.size), pieces.byte_ids))[tokens].astype(np.int32)
        known = np.concatenate((known, hashes[new]))
        used = np.concatenate((used, np.full(len(fresh), self.batch)))
        head = np.concatenate((head, len(self.pool) + np.cumsum(counts) - counts))
        count = np.concatenate((count, counts))
        order = np.argsort(known, kind="stable")
        known, used, head, count = known[order], used[order], head[order], count[order]
        pool = np.concatenate((self.pool, tokens))
        at = np.searchsorted(known, hashes)
        found = head[at][back], count[at][back]
        if len(known) > KNOWN_WORDS or len(pool) > 4 * KNOWN_WORDS:  # the latest half stays
            keep = used >= max(np.partition(used, len(used) // 2)[len(used) // 2], self.batch)
            keep &= np.cumsum(np.where(keep, count, 0)) <= 2 * KNOWN_WORDS
            kept = count[keep]
            self.pool = gathered(pool, head[keep], kept)
            self.words_known = known[keep], used[keep], np.cumsum(kept) - kept, kept
        else:
            self.pool, self.words_known = pool, (known, used, head, count)
        return pool, *found


def encode_texts(lattice: Lattice, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts back to back, and the bounds of each; marks in the data are written as spaces."""
    pieces, texts = lattice.pieces, len(bounds) - 1
    inside = data != SPACE
    edge = np.zeros(len(data) + 1, bool)
    edge[bounds] = True
    starts = np.flatnonzero(inside & (~np.append(False, inside[:-1]) | edge[:-1]))
    ends = np.flatnonzero(inside & (~np.append(inside[1:], False) | edge[1:])) + 1
    owner = np.searchsorted(bounds, starts, side="right") - 1
    tokens, head, counts = lattice.encoded(data, starts, ends)
    bare = tokens[head] == pieces.runs[1][0] if len(head) else np.zeros(0, bool)  # the space has not merged with the word
    # Spaces before each word, and after the last one of a text; a text begins with one more.
    new = np.append(True, owner[1:] != owner[:-1]) if len(owner) else np.zeros(0, bool)
    gap = starts - np.where(new, bounds[owner] - 1, np.append(0, ends[:-1])) if len(owner) else starts
    gap = gap - 1 + bare
    stop = bounds[:-1] - 1
    stop[owner] = ends  # the last word of a text stays
    tail = np.where(np.diff(bounds) > 0, bounds[1:] - stop, 0)
    # Parts in order: the words of each text, then its tail.
    part_owner = np.concatenate((owner, np.arange(texts)))
    order = np.argsort(part_owner, kind="stable")
    run = np.concatenate((gap, tail))[order]
    source = np.concatenate((head + bare, np.zeros(texts, np.int64)))[order]
    n_word = np.concatenate((counts - bare, np.zeros(texts, np.int64)))[order]
    most = pieces.most
    n_run = run // most + np.array([len(x) for x in pieces.runs])[run % most]
    total = n_run + n_word
    offset = np.cumsum(total) - total
    out = np.empty(int(total.sum()), np.int32)
    out[np.repeat(offset + n_run - (np.cumsum(n_word) - n_word), n_word) + np.arange(n_word.sum())] = \
        tokens[np.repeat(source - (np.cumsum(n_word) - n_word), n_word) + np.arange(n_word.sum())]
    spaced = np.flatnonzero(n_run)
    full = run[spaced] // most
    out[np.repeat(offset[spaced] - (np.cumsum(full) - full), full) + np.arange(full.sum())] = pieces.runs[most][0]
    for n in np.unique(run[spaced] % most).tolist():
        rest = spaced[run[spaced] % most == n]
        for k, piece in enumerate(reversed(pieces.runs[n]), 1):
            out[offset[rest] + n_run[rest] - k] = piece
    return out, np.concatenate(([0], np.cumsum(np.bincount(part_owner[order], total, texts)))).astype(np.int64)


def decode_ids(pieces: Pieces, ids: np.ndarray, bounds: np.ndarray) -> list[str]:
    """Texts of id lists: pieces joined, marks to spaces, one space at the front dropped; control ids and ids out of range give nothing."""
    texts = pieces.texts
    size = np.array([len(t) for t in texts] + [0], np.int64)
    start = np.cumsum(size) - size
    pool = np.frombuffer(b"".join(texts), np.uint8)
    ids = np.where((ids >= 0) & (ids < pieces.size), ids, pieces.size)
    raw = gathered(pool, start[ids], size[ids]).tobytes()
    at = np.concatenate(([0], np.cumsum(size[ids])))[bounds].tolist()
    return [raw[a + (raw[a:a + 1] == b" "):b].decode("utf-8", "replace") for a, b in zip(at, at[1:])]


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Encode every whole text: id, ids (array of int), and the columns in ``keep`` (``_kept`` is added to names that clash); one row per row of ``docs``, nothing is shuffled.

    The ids are those of the model's own encoder.  An empty text has no ids, a null text null.  The mark itself reads as a space.
    """
    shared = docs.sparkSession.sparkContext.broadcast(load(model))  # the pieces of the model
    rows = docs.select(F.struct(F.col(id_col), *keep).alias("kept"), F.col(text_col).alias("text"))

    def run(batches):
        lattice = Lattice(shared.value)
        for batch in text_slices(batches, "text", BATCH_BYTES):
            text = batch.column("text")
            ids, bounds = encode_texts(lattice, *byte_view(pc.replace_substring(text, MARK, " ")))
            empty = text.is_null()
            lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids))
            lists = pc.if_else(empty, pa.scalar(None, lists.type), lists) if empty.true_count else lists
            yield pa.RecordBatch.from_arrays([batch.column("kept"), lists], ["kept", "ids"])

    out = rows.mapInArrow(frugal(run), T.StructType([rows.schema["kept"], T.StructField("ids", T.ArrayType(T.IntegerType()))]))
    return out.select(F.col(f"kept.{id_col}").alias("id"), "ids", *(F.col(f"kept.{c}").alias(kept_as(c, ["id", "ids"])) for c in keep))


def decode(rows: DataFrame, model: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """Add the text of each id list; a null list gives null, a null id in a list gives nothing."""
    shared = rows.sparkSession.sparkContext.broadcast(load(model))
    packed = rows.select(F.struct(*rows.columns).alias("row"), F.col(ids_col).cast("array<int>").alias("list"))

    def run(batches):
        for batch in batches:
            lists = batch.column("list")
            flat = lists.flatten().fill_null(-1).to_numpy(zero_copy_only=False)
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            bounds = np.concatenate(([0], np.cumsum(sizes)))
            cuts = [0, *(np.flatnonzero(np.diff(bounds[1:] // DECODE_IDS)) + 1).tolist(), len(sizes)]
            texts = []
            for lo, hi in zip(cuts, cuts[1:]):
                texts += decode_ids(shared.value, flat[bounds[lo]:bounds[hi]], bounds[lo:hi + 1] - bounds[lo])
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, pa.string(), mask=np.asarray(lists.is_null()))], ["row", "text"])

    out = packed.mapInArrow(frugal(run), T.StructType([packed.schema["row"], T.StructField("text", T.StringType())]))
    return out.select("row.*", F.col("text").alias(out_col))
