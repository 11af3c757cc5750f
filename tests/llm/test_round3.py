"""Token alignment, winnowed contamination and conversation repair against brute force, and on awkward tables."""

import hashlib
import random
import re
import zlib
from collections import Counter
from itertools import accumulate

import numpy as np
import pytest
from edge import SCHEMA, SHARED, frame, words
from pyspark.sql import functions as F

from gridmill.llm import align, pieces, repair, winnow
from gridmill.llm.queries import BYTE_MODEL, PIECE_MODEL, QUERIES, SQL

EMPTY = hashlib.sha256(b"").hexdigest()


# ---- winnowed contamination ----

def words_by_hand(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def overlap_by_hand(docs, items, window=10):
    known = {}
    for item, text in items:
        w = words_by_hand(text)
        n = min(len(w), window)
        for i in range(len(w) - n + 1 if w else 0):
            known.setdefault(tuple(w[i:i + n]), set()).add(item)
    spans = {len(x) for x in known}
    out = []
    for i, text in docs:
        w = words_by_hand(text)
        hit, found = set(), set()
        for n in spans:
            for at in range(len(w) - n + 1):
                if (x := tuple(w[at:at + n])) in known:
                    hit |= set(range(at, at + n))
                    found |= known[x]
        found = sorted(str(x) for x in found if x is not None)
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(found).encode()).hexdigest()))
    return Counter(out)


def overlap(spark, docs, items, **options):
    rows = winnow.contamination(docs, spark.createDataFrame(items, "item_id long, text string, id string, key string"), **options).collect()
    for r in rows:
        assert r["n_hit"] == sum(s["stop"] - s["first"] for s in r["spans"])
        assert all(a["stop"] < b["first"] for a, b in zip(r["spans"], r["spans"][1:]))
    return Counter((r["id"], r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"]) for r in rows)


def test_overlap_by_brute_force(spark):
    draw = random.Random(4)
    small = ["a", "b", "c", "É", "é"]
    text = lambda n: " ".join(draw.choice(small) for _ in range(n))
    items = [(i, text(draw.choice([1, 2, 3, 7, 9, 10, 11, 14, 30])) if i % 5 else words(i, 40)) for i in range(1, 30)]
    items += [(7, words(7, 12)), (3, None), (3, ""), (3, " . "), (None, words(77, 15)), (40, SHARED), (41, SHARED)]
    docs = [(i, text(draw.randint(0, 60))) for i in range(60)]
    docs += [(100 + i, words(200 + i, 30) + ", " + (words(5 * i, 40) if i % 2 else words(77, 15)).upper() + "!\n" + words(300 + i, 9)) for i in range(6)]
    docs += [(200, words(5, 40)[:60]), (201, "a\x00b\x7fc-d"), (201, "a\x00b\x7fc-d"), (None, words(77, 15))]
    rows = [(i, t, "k", "d") for i, t in items]
    plain = [x for x in items if len(words_by_hand(x[1])) > 9]
    for chosen in (items, plain):
        kept = [(i, t, "k", "d") for i, t in chosen]
        assert overlap(spark, spark.createDataFrame(docs, "doc_id long, text string"), kept) == overlap_by_hand(docs, chosen)
    assert len(rows) == len(items)


def test_overlap_of_awkward_tables(spark):
    items = [(1, SHARED, "x", "y"), (1, SHARED, "x", "y"), (2, words(12, 20), "x", "y")]
    docs = [(r["doc_id"], r["text"]) for r in frame(spark).collect()]
    assert overlap(spark, frame(spark), items) == overlap_by_hand(docs, [x[:2] for x in items])
    out = winnow.contamination(frame(spark), spark.createDataFrame(items, "item_id long, text string, id string, key string"), keep=("id", "score"))
    assert out.columns[-2:] == ["id_kept", "score"] and out.count() == len(docs)
    assert overlap(spark, frame(spark), []) == Counter((i, len(words_by_hand(t)), 0, 0, EMPTY) for i, t in docs)
    assert not overlap(spark, spark.createDataFrame([], SCHEMA), items)


def test_a_shared_window_always_shares_a_fingerprint(spark):
    draw = random.Random(6)
    texts = [[draw.choice("abc") for _ in range(40)] for _ in range(40)]
    for span in (1, 2, 5, 10):
        rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "key int, w array<string>")
        prints = {}
        for r in winnow.fingerprints(rows, ["key"], span).collect():
            prints.setdefault(r["key"], {})[r["at"]] = (r["print"], len(r["t"].split()) - span + 1)
        seen = {}
        for key, t in enumerate(texts):
            at = {p + j: x for p, (x, n) in prints[key].items() for j in range(n)}
            assert sorted(at) == list(range(len(t) - span + 1))
            for p, x in at.items():
                assert seen.setdefault(tuple(t[p:p + span]), x) == x


# ---- conversation repair ----

def damage_by_hand(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def repair_by_hand(rows):
    """All prefixes of the automaton, row by row: an ordering independent of spans."""
    def same(r):
        return hashlib.md5(f"{'n' if r[0] is None else 'c' + str(r[0])}:{len(r[2])}:{r[2]}:{r[3]}".encode()).hexdigest()

    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), same(r)))
    turns = {r[1] for r in rows if r[1] is not None}
    counts, seen, kinds = Counter(), set(), []
    for r in rows:
        solid = re.sub(r"[\x20\x09-\x0D]", "", r[3])
        fault = "blank" if not solid else "duplicate" if r[2:] in seen else "truncated" if solid[-1] not in ".!?" else None
        seen.add(r[2:])
        counts[fault] += 1
        kinds.append(fault)
    counts["illegal"] = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    steps = {("B", "s"): "S", ("B", "u"): "U", ("S", "u"): "U", ("U", "a"): "A", ("A", "u"): "U"}
    cells = {"B": (0, "", ())}

    def insertions(cells):
        for _ in range(2):
            for p, (cost, audit, lines) in list(cells.items()):
                for role in ("user", "assistant"):
                    if q := steps.get((p, role[0])):
                        cells[q] = min(cells.get(q, (10 ** 9, "", ())), (cost + 2, audit + "I", (*lines, f"{role}:")))

    insertions(cells)
    for (_, _, role, text), fault in zip(rows, kinds):
        new = {}
        for p, (cost, audit, lines) in cells.items():
            ways = [(p, 3, "D", ())]
            if fault not in ("blank", "duplicate"):
                cut = fault == "truncated"
                ways += [(steps.get((p, role[:1])), cut, "K", (f"{role}:{text}",))]
                ways += [(steps.get((p, r[0])), 2 + cut, "R", (f"{r}:{text}",)) for r in ("user", "assistant")]
            for q, more, letter, line in ways:
                if q:
                    new[q] = min(new.get(q, (10 ** 9, "", ())), (cost + more, audit + letter, lines + line))
        cells = new
        insertions(cells)
    cost, audit, lines = min(cells[q] for q in "BA" if q in cells)
    return (max(turns) - min(turns) + 1 - len(turns) if turns else 0, counts["blank"], counts["duplicate"], counts["truncated"], counts["illegal"], cost, audit,
            hashlib.sha256("\n".join(lines).encode()).hexdigest())


def talks():
    draw = random.Random(9)
    texts = ["Yes.", "No!", "Why?", "well", " ", "", None, "é.\n", "So. it is"]
    rows = [(conv, turn + 3 * (turn > 6), draw.choice(["user", "assistant", "system", "tool", "", None, "user", "assistant"]), f"{draw.choice(texts) or ''}" if turn % 4 else draw.choice(texts))
            for conv in range(40) for turn in range(draw.randint(1, 14))]
    rows += [(41, t, "user" if t % 2 == 0 else "assistant", f"Turn {t}.") for t in range(10)]
    rows += [(None, 1, "user", "Hi."), (None, None, "system", "Be kind."), (None, None, "system", "Be kind."), (50, 2, "user", "a."), (50, 2, "user", "a."), (50, 2, "assistant", "b")]
    rows += [(60, None, "user", "x."), (61, None, None, None)]
    return rows


CONVERSATION = "conv_id long, turn long, role string, text string, conv string, same string, n long, audit string"


def test_repair_by_brute_force(spark, monkeypatch):
    rows = talks()
    table = spark.createDataFrame([(*r, "c", "s", 1, "K") for r in rows], CONVERSATION)
    hurt = damage_by_hand(rows)
    want = {}
    for conv in {r[0] for r in rows}:
        mine = [r for r in hurt if r[0] == conv]
        want[conv] = repair_by_hand(mine) if mine else (0, 0, 0, 0, 0, 0, "", EMPTY)
    spoilt = repair.damaged(table)
    assert Counter(map(tuple, spoilt.collect())) == Counter(hurt)
    for rows_a_segment in (repair.SEGMENT_ROWS, 2):
        monkeypatch.setattr(repair, "SEGMENT_ROWS", rows_a_segment)
        got = repair.repair(spoilt, table.selectExpr("conv_id AS conv")).collect()
        assert len(got) == len(want) and {r["id"]: tuple(r)[1:] for r in got} == want


def test_repaired_rows_are_legal(spark):
    table = spark.createDataFrame(talks(), "conv long, turn long, role string, text string")
    found = repair.reports(table)
    fixed = {}
    for r in repair.repaired(table, found).collect():
        fixed.setdefault(r["conv"], []).append(r)
    for conv, mine in fixed.items():
        mine.sort(key=lambda r: r["nth"])
        assert [r["nth"] for r in mine] == list(range(1, len(mine) + 1))
        assert re.fullmatch("s?(ua)+", "".join(r["role"][:1] for r in mine))
    empty = spark.createDataFrame([], "conv long, turn long, role string, text string")
    assert repair.repair(empty, empty).count() == 0 and repair.repaired(empty, repair.reports(empty)).count() == 0


def test_any_split_gives_the_same_cell():
    draw = random.Random(2)
    for _ in range(300):
        kinds = "".join(draw.choice("suaoSUAOd") for _ in range(draw.randint(2, 9)))
        n = len(kinds)
        table = {(i, i + 1): repair.row_cell(kinds[i]) for i in range(n)}
        for size in range(2, n + 1):
            for i in range(n - size + 1):
                cells = [repair.combined(table[i, k], table[k, i + size]) for k in range(i + 1, i + size)]
                assert all(c == cells[0] for c in cells)
                table[i, i + size] = cells[0]
        assert table[0, n] == repair.span_cell(kinds)


def test_a_long_conversation_is_shared_by_tasks(spark):
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", f"Turn {t}." if t % 97 else "cut") for t in range(40_000)] + [(2, 0, "user", "Hi.")]
    table = spark.createDataFrame(rows, "conv long, turn long, role string, text string").repartition(8)
    got = {r["conv"]: r for r in repair.reports(table).collect()}
    want = repair_by_hand(rows[:-1])
    assert tuple(got[1])[1:] == want[:-1] and len(got[1]["audit"]) >= 40_000


# ---- token alignment ----

@pytest.fixture(scope="module")
def models():
    import sentencepiece
    from tokenizers import Tokenizer
    a = Tokenizer.from_file(BYTE_MODEL)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL)


def tokens_by_hand(models, text):
    letters = align.byte_letters()
    a = models[0].encode(" " + text, add_special_tokens=False)
    side_a = list(zip(a.ids, (bytes(letters[c] for c in t) for t in a.tokens)))
    ids = models[1].encode(text)
    side_b = [(i, bytes([int(models[1].id_to_piece(i)[1:-1], 16)]) if models[1].is_byte(i) else models[1].id_to_piece(i).replace("▁", " ").encode()) for i in ids]
    whole = (" " + text).encode()
    if not text or b"".join(t for _, t in side_a) != whole or b"".join(t for _, t in side_b) != whole:
        return [], []
    return side_a, side_b


def alignment_by_hand(models, docs):
    per, counts, holders = [], Counter(), Counter()
    for i, text in docs:
        a, b = tokens_by_hand(models, text or "")
        ends = [list(accumulate(len(t) for _, t in side)) for side in (a, b)]
        both = sorted(set(ends[0]) & set(ends[1]))
        links, groups, p, q = [], [], 0, 0
        for end in both:
            m, n = ends[0].index(end, p) + 1, ends[1].index(end, q) + 1
            groups.append(",".join(str(x) for x, _ in a[p:m]) + "|" + ",".join(str(x) for x, _ in b[q:n]))
            links.append((a[m - 1][0], b[n - 1][0]))
            p, q = m, n
        counts.update(links)
        holders.update(set(links))
        per.append((i, len(a), len(b), len(both), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""))
    top = Counter()
    for (_, b), n in counts.items():
        top[b] = max(top[b], n)
    rows = Counter((i, a, b, g, len(x), sum(counts[k] == top[k[1]] for k in x), sum(counts[k] for k in x), h) for i, a, b, g, x, h in per)
    return rows, {k: (holders[k], n, n == top[k[1]]) for k, n in counts.items()}


@pytest.mark.parametrize("size", [align.SLICE_BYTES, 300])
def test_alignment_by_brute_force(spark, models, monkeypatch, size):
    draw = random.Random(3)
    docs = [(i, " ".join(draw.choice(["the", "of", "Über", "naïve", "don't", "x=1", "日本", "  ", "\n", "<s>", "<|endoftext|>", "😀", "l'été", "1234", "▁" if i % 7 == 0 else "a"])
                         for _ in range(draw.randint(0, 50)))) for i in range(60)]
    docs += [(70, " lead"), (71, "trail "), (72, "a  b   c"), (73, " x y z"), (74, "a\x00b c"), (75, "ａｂｃ ﬁ"), (76, "'s it 's"), (77, "é e")]
    docs += [(r["doc_id"], r["text"]) for r in frame(spark).collect()]
    rows, pairs = alignment_by_hand(models, docs)
    monkeypatch.setattr(align, "SLICE_BYTES", size)
    monkeypatch.setattr(align, "BLOCK_BYTES", 4 * size)
    table = spark.createDataFrame([(i, t, 1, "p", b"") for i, t in docs], "doc_id long, text string, slot int, part string, docs binary").coalesce(2)
    found, linked = align.align(table, BYTE_MODEL, PIECE_MODEL)
    assert Counter(map(tuple, found.collect())) == rows
    assert {(r["a"], r["b"]): (r["n_docs"], r["n_links"], r["best"]) for r in linked.collect()} == pairs
    assert align.sides(BYTE_MODEL, PIECE_MODEL).cuts


def test_units_are_encoded_many_at_once():
    both, given = align.Sides(BYTE_MODEL, PIECE_MODEL), []

    class Counted:
        def __init__(self, model):
            self.model = model

        def encode_batch_fast(self, texts, **options):
            given.extend(texts)
            return self.model.encode_batch_fast(texts, **options)

    draw = random.Random(5)
    odd = ["a", "x\n", " lead", "tail ", "日本", "<|endoftext|>", "don't", "s'", "a  b", "é", "▁", "\U0001f600!"]
    units = [u for u in odd + ["".join(draw.choice("ab's\té.1ß日") for _ in range(draw.randrange(1, 9))) for _ in range(600)] for u in both.units(u)]
    want = [e.ids for e in both.a.encode_batch_fast([" " + u for u in units], add_special_tokens=False)]
    both.a = Counted(both.a)
    assert both.ids_a(units) == want and both.ids_a([]) == []
    solid = sum(u[0] in align.SOLIDS and u[-1] in align.SOLIDS for u in units)
    assert solid > align.JOINED_UNITS and len(given) == len(units) - solid + -(-solid // align.JOINED_UNITS)


def test_alignment_of_an_empty_table(spark):
    found, linked = align.align(spark.createDataFrame([], SCHEMA), BYTE_MODEL, PIECE_MODEL)
    assert found.count() == 0 and linked.count() == 0


def test_bitmaps_keep_their_members():
    draw = np.random.default_rng(1)
    slots = [np.sort(draw.choice(align.BLOCK_DOCS, n, replace=False)) for n in (1, 5, 2047, 2048, 2049, 30_000)] + [np.zeros(0, np.int64)]
    starts = np.cumsum([0, *map(len, slots[:-1])])
    out = align.containers(np.concatenate(slots), starts).to_pylist()
    assert [len(x) for x in out] == [2, 10, 4094, 4096, 4096, 4096, 0]
    got, sizes = align.members(out)
    assert sizes.tolist() == [len(s) for s in slots] and (got == np.concatenate(slots)).all()
    times = draw.integers(1, 40, 500)
    key = np.sort(draw.choice(20 * align.BLOCK_DOCS, 500, replace=False))
    pair, docs, planes = align.postings(key, times)
    back = {}
    for p, x, more in zip(pair.tolist(), docs.to_pylist(), planes.to_pylist()):
        for s in align.members([x])[0].tolist():
            back[p * align.BLOCK_DOCS + s] = 1
        for k, plane in enumerate(more):
            for s in align.members([plane])[0].tolist():
                back[p * align.BLOCK_DOCS + s] += 1 << k
    assert back == dict(zip(key.tolist(), times.tolist()))


def test_queries_are_registered():
    assert {"op11_token_alignment", "op12_winnowed_overlap", "op13_conversation_repair"} <= set(QUERIES)
    assert {"op12_winnowed_overlap", "op13_conversation_repair"} <= set(SQL)


# ---- pieces of long words, remembered words, corpora without labels ----

def test_long_words_and_remembered_words_match_the_library(spark, models, monkeypatch):
    draw = random.Random(12)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    texts = ["".join(draw.choice(letters) for _ in range(40_000)), "a" * 3_000, "the" * 2_000, "日本語" * 900 + " é" * 5, "x" + "😀" * 400,
             "".join(draw.choice("theandingo") for _ in range(6_000))] + [words(i, 50) for i in range(200)] * 2
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    monkeypatch.setattr(pieces, "BATCH_BYTES", 20_000)
    for window, known in ((1 << 18, 1 << 18), (1_000, 500)):
        monkeypatch.setattr(pieces, "WINDOW_BYTES", window)
        monkeypatch.setattr(pieces, "KNOWN_WORDS", known)
        got = {r["id"]: r["ids"] for r in pieces.encode(table, PIECE_MODEL).collect()}
        assert all(got[i] == models[1].encode(t) for i, t in enumerate(texts))


def test_a_word_of_many_megabytes(spark):
    lattice = pieces.Lattice(pieces.load(PIECE_MODEL))
    word = np.random.default_rng(3).integers(48, 58, 9 << 20).astype(np.uint8)
    ids, bounds = pieces.encode_texts(lattice, word, np.array([0, len(word)]))
    assert bounds.tolist() == [0, len(word) + 1] and len(set(ids.tolist())) == 11


def test_documents_without_labels_stay(spark):
    import corpus_pipeline
    docs = frame(spark).withColumn("lang", F.lit(None).cast("string"))
    kept = corpus_pipeline.language(spark, docs, "")
    want = [t for t in (r["text"] for r in docs.collect()) if t and any(c.isalpha() for c in t)]
    assert kept.columns == docs.columns and Counter(r["text"] for r in kept.collect()) == Counter(want)
