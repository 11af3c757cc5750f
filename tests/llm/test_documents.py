"""Operators on documents against brute force, and on awkward tables."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from edge import LONG, SHARED, TEXTS, frame, words
from pyspark.sql import functions as F

from gridmill.llm import bigru, crf, licences, mixing, pieces, repetition, runindex, simhash
from gridmill.llm.queries import PIECE_MODEL, table

FOLDER = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, FOLDER, "documents")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] or "" for r in docs.collect()}


def bag(rows, *names):
    return Counter(tuple(r[n] for n in names) for r in rows)


# ---- licences ----

def test_licences_by_brute_force(spark):
    lines = ["Released under the MIT License.", "released, UNDER the mit license", "Released under the very new MIT License.",
             "under the MIT License.", "All rights reserved.", licences.TEMPLATES["ISC"], "nothing here", "x " * 300]
    rows = licences.licence_scan(frame(spark, [*enumerate(lines), (100, "\n".join(lines))])).collect()

    def bigrams(text):
        w = re.findall("[a-z0-9]+", text.lower())
        return Counter(zip(w, w[1:]))

    def dice(a, b):
        n = sum(a.values()) + sum(b.values())
        return 2 * sum((a & b).values()) / n if n else 0

    best = {}
    for i, text in [*enumerate(lines), (100, "\n".join(lines))]:
        units = [text.replace("\n", " "), *text.split("\n")]
        hits = [(-dice(bigrams(u), bigrams(t)), name, k) for k, u in enumerate(units) for name, t in licences.TEMPLATES.items()
                if dice(bigrams(u), bigrams(t)) >= 0.8]
        best[i] = (len({k for _, _, k in hits}), min(hits)[1] if hits else None)
    assert {r["id"]: (r["n_units"], r["licence"]) for r in rows} == best
    assert best[0] == (2, "MIT-notice") and best[100][0] >= 4


def test_size_bounds_admit_every_match():
    for n in range(1, 60):
        low, high = licences.size_bounds(n, 0.8)
        for m in range(1, 120):
            assert (2 * min(n, m) / (n + m) >= 0.8 - 1e-12) <= (low <= m <= high)


def test_passages_by_brute_force(spark):
    isc = licences.TEMPLATES["ISC"].split()
    wrapped = "\n".join(" ".join(isc[i:i + 9]) for i in range(0, len(isc), 9))
    draw = random.Random(8)
    near = " ".join(w for w in isc if draw.random() < 0.95)
    lines = [wrapped + "\n" + "some other text of the work\n" * 20, "Copyright 2024 Example Corp. All rights reserved.", "All\nrights\nreserved",
             "Copyright 2020 Foo Inc. Licensed under the Apache License, Version 2.0. See LICENSE for details.", "of the and this software " * 40,
             "more " + near + " and\n" + near, "all rights " * 30 + "reserved. " + "all rights reserved " * 5, "nothing here", "word", " .. ", "", None]
    templates = {k: licences.TEMPLATES[k] for k in ("ISC", "Apache-2.0-notice", "GPL-3.0-notice", "proprietary-notice")}
    templates["twice"] = "this software and this software of the other software"
    words = lambda text: re.findall("[a-z0-9]+", text.lower())
    want = {}
    for i, text in enumerate(lines):
        w = words(text or "")
        for name, t in templates.items():
            v = words(t)
            bag_of = Counter(zip(v, v[1:]))
            best = (0.8 - 1e-12,)
            for a in range(len(w)):
                seen, both = Counter(), 0
                for b in range(a + 1, min(len(w), a + 2 * len(v))):
                    seen[w[b - 1], w[b]] += 1
                    both += seen[w[b - 1], w[b]] <= bag_of[w[b - 1], w[b]]
                    best = max(best, (2 * both / (b - a + len(v) - 1), -a, a - b))
            if len(best) > 1:
                want[i, name] = best[0], -best[1], 1 - best[2]
    docs = frame(spark, [*enumerate(lines), (0, lines[0])])
    got = licences.licence_passages(docs, templates=templates).collect()
    assert len(got) == len(want) and {(r["id"], r["licence"]): (r["dice"], r["first"], r["n_words"]) for r in got} == want
    assert {(0, "ISC"), (1, "proprietary-notice"), (2, "proprietary-notice"), (3, "Apache-2.0-notice")} <= want.keys()
    rows = licences.licence_passage_scan(docs).collect()
    assert len(rows) == len(lines) + 1 and {r["id"]: r["licence"] for r in rows}[0] == "ISC"


def test_passages_hold_every_matching_unit(docs):
    units = {(r["id"], r["licence"]): r["dice"] for r in licences.licence_matches(docs).orderBy("dice").collect()}
    passages = {(r["id"], r["licence"]): r["dice"] for r in licences.licence_passages(docs).collect()}
    assert units and all(passages[k] >= d for k, d in units.items())


# ---- repeated strings ----

def brute_force_removal(rows, length):
    first = {}
    key = lambda i: (i is None, i)
    for i, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - length + 1):
            s = b[k:k + length]
            first[s] = min(first.get(s, key(i)), key(i))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, int)
        for k in range(len(b) - length + 1):
            if first[b[k:k + length]] < key(i):
                gone[k] += 1
                gone[k + length] -= 1
        gone = np.cumsum(gone)[:len(b)] > 0
        spans = int((gone & ~np.append(False, gone[:-1])[:len(gone)]).sum())
        out.append((i, len(b), int(gone.sum()), spans, bytes(np.frombuffer(b, np.uint8)[~gone])))
    return Counter(out)


@pytest.mark.parametrize("anchor,hot", [(16, 4096), (8, 1), (50, 2)])
def test_removal_by_brute_force(spark, anchor, hot):
    rows = runindex.remove_repeats(frame(spark).repartition(4), anchor=anchor, hot=hot, keep=("id", "kept", "chunk")).collect()
    got = Counter((r[0], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept_bytes"])) for r in rows)
    assert got == brute_force_removal(TEXTS, 50) and {r["chunk"] for r in rows} == {"c"}


def edges(n):
    """Texts with one passage in the middle and their own words around it."""
    return [(i, words(1000 + i, 12) + " " + SHARED + " " + words(5000 + i, 12)) for i in range(n)]


@pytest.mark.parametrize("group_bytes", [0, 2_000])
def test_removal_with_strings_as_hashes(spark, group_bytes):
    made = [*TEXTS, *((i and i + 100, t) for i, t in edges(80))]
    rows = runindex.remove_repeats(frame(spark, made).repartition(4), hot=8, group_bytes=group_bytes).collect()
    got = Counter((r["id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept_bytes"])) for r in rows)
    assert got == brute_force_removal(made, 50)


def test_contexts_of_a_common_anchor_are_spread():
    texts = [t.encode() for _, t in edges(400)]
    chunk = runindex.Chunk("0-0", np.arange(400), np.cumsum([0, *map(len, texts)]), np.frombuffer(b"".join(texts), np.uint8), np.zeros(400, bool))
    hashes, times, several = runindex.anchor_counts(chunk, 50, 16)
    flags = (several + 2 * (times > 8) + 4 * (times > 100)).astype(np.uint8)
    assert times.max() == 400
    sent = runindex.contexts_of(chunk, [{"bucket": 0, "flags": runindex.pack(flags)}], 16, 50, 16)
    keys = [runindex.unpack(r["keys"], np.uint64) for r in sent if r["n"]]
    assert not keys or np.unique(np.concatenate(keys), return_counts=True)[1].max() <= 100
    strings = np.bincount([r["bucket"] for r in sent if r.get("strings")], [r["strings"] for r in sent if r.get("strings")], 16)
    assert strings.sum() > 400 and strings.max() < 2 * strings.mean()


def sent_contexts(texts, length, k):
    """All contexts of the texts, each text a chunk of its own, in one bucket."""
    out = []
    for i, t in enumerate(texts):
        chunk = runindex.Chunk(str(i), np.array([i]), np.array([0, len(t)]), np.frombuffer(t, np.uint8), np.zeros(1, bool))
        flags = np.ones(len(runindex.anchor_counts(chunk, length, k)[0]), np.uint8)
        out += runindex.contexts_of(chunk, [{"bucket": 0, "flags": runindex.pack(flags)}], 1, length, k)
    return [r for r in out if r["n"]]


def test_contexts_that_share_an_anchor_alone_are_not_indexed(monkeypatch):
    indexed = []
    earliest = runindex.earliest
    monkeypatch.setattr(runindex, "earliest", lambda symbols, starts, *rest: indexed.append(len(starts)) or earliest(symbols, starts, *rest))
    shared = words(1, 3)[:24]
    apart = [(words(100 + i, 12) + " " + shared + " " + words(200 + i, 12)).encode() for i in range(6)]
    assert runindex.marks_in(sent_contexts(apart, 50, 16), 50, 16) == [] and not indexed
    assert runindex.marks_in(sent_contexts([*apart, b"x" + apart[0][20:] + b"y"], 50, 16), 50, 16) and sum(indexed) > 0


@pytest.mark.parametrize("length,k", [(9, 4), (10, 4), (7, 6), (6, 6), (12, 5)])
def test_no_match_is_left_out_of_the_index(length, k):
    draw = random.Random(length * k)
    for _ in range(40):
        texts = [bytes(draw.choice(b"abc") for _ in range(draw.randint(length, 40))) for _ in range(12)]
        gone = [set() for _ in texts]
        for chunk, marks in runindex.marks_in(sent_contexts(texts, length, k), length, k):
            for _, first, last in marks.T.tolist():
                gone[int(chunk)].update(range(first, last))
        # repeats inside a text are no matter of ids, so all that is wanted comes from earlier texts
        want = [{j for s in range(len(t) - length + 1) if any(t[s:s + length] in u for u in texts[:i]) for j in range(s, s + length)} for i, t in enumerate(texts)]
        assert gone == want


def test_removal_of_short_strings(spark):
    draw = random.Random(3)
    made = [(i, "".join(draw.choice("ab") for _ in range(draw.randint(0, 60)))) for i in range(60)]
    rows = runindex.remove_repeats(frame(spark, made).repartition(3), length=12, anchor=5, hot=3).collect()
    got = Counter((r["id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept_bytes"])) for r in rows)
    assert got == brute_force_removal(made, 12)


def test_removal_on_documents(docs, texts):
    rows = runindex.remove_repeats(docs).collect()
    got = Counter((r["id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept_bytes"])) for r in rows)
    assert got == brute_force_removal(list(texts.items()), 50)
    assert sum(r["n_removed"] for r in rows) > 0


@pytest.mark.parametrize("seed", range(3))
def test_run_index_finds_the_earliest_holder(seed):
    rng = np.random.default_rng(seed)
    for _ in range(60):
        length = int(rng.integers(2, 12))
        base = rng.integers(1, 4, 400).astype(np.uint8)
        contexts = []
        for _ in range(int(rng.integers(1, 30))):
            at = int(rng.integers(0, 350))
            c = base[at:at + int(rng.integers(length, length + 30))].copy()
            if rng.random() < 0.5:
                c[rng.integers(0, len(c))] = rng.integers(1, 4)
            contexts.append(c)
        owner = rng.integers(0, 1000, len(contexts))
        sizes = np.array([len(c) for c in contexts])
        starts = np.cumsum(sizes + 1) - sizes - 1
        symbols = np.concatenate([np.append(c, 0).astype(np.uint8) for c in contexts])
        found = runindex.earliest(symbols, starts, starts + sizes, owner, length)
        holders = {}
        for j, c in enumerate(contexts):
            for k in range(len(c) - length + 1):
                holders.setdefault(bytes(c[k:k + length]), []).append(owner[j])
        want = {(j, k): min(holders[bytes(c[k:k + length])]) for j, c in enumerate(contexts) for k in range(len(c) - length + 1)}
        assert {(j, k): o for j, k, o in zip(*(x.tolist() for x in found))} == want


# ---- pieces ----

def test_pieces_match_the_library(spark):
    sentencepiece = pytest.importorskip("sentencepiece")
    model = sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL)
    draw = random.Random(1)
    odd = ["  a  b", " x", "a\nb\tc", "▁a b", "\xa0x ﬁ", "<s>a</s> <0x41>", "a\x00b", "x ", " ", "x" + " " * 47 + "y" + " " * 31, "\U000e0001x",
           "    日", "aaaaaaaaaaaaaaaa"]
    odd += ["".join(draw.choice("abcdeéñß日本 .,\n\t▁😀the") for _ in range(draw.randrange(60))) for _ in range(300)]
    rows = [*((i, t) for i, t in enumerate(odd)), (1000, None), (1001, ""), (1002, LONG), (1002, LONG), (None, "null id")]
    encoded = pieces.encode(frame(spark, rows), PIECE_MODEL, keep=("text", "id", "copies"))
    for r in pieces.decode(encoded, PIECE_MODEL).collect():
        if r["text"] is None:
            assert r["ids"] is None and r["decoded"] is None
        else:
            assert r["ids"] == model.encode(r["text"]) and r["decoded"] == r["text"].replace("▁", " ")


def test_piece_neighbours_agree_with_merging():
    book = pieces.load(PIECE_MODEL)
    score = {t: -r for t, r in zip(book.texts, book.rank.tolist()) if r >= 0}
    draw = random.Random(2)
    ids = [i for i in np.flatnonzero(book.usable).tolist() if 1 < len(book.texts[i]) and b" " not in book.texts[i]]
    pairs = [(draw.choice(ids), draw.choice(ids)) for _ in range(400)]
    said = book.compatible(np.array([a for a, _ in pairs]), np.array([b for _, b in pairs]))
    named = {t.decode(): s for t, s in score.items()}
    for (a, b), apart in zip(pairs, said.tolist()):
        x, y = book.texts[a].decode(), book.texts[b].decode()
        assert apart == (pieces.merge(list(x + y), named)[0] == [x, y])


# ---- mixing ----

def test_targets_by_hand(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 1000), (None, 100)], "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(sizes).collect()}
    # 150 % of 2110 is 3165; weights 3, 1, 2, 3: a and the null source stop at their caps, and so does c
    assert got["a"] == 20.0 and got[None] == 200.0 and abs(sum(got.values()) - 3165) < 1e-6
    assert got["c"] <= 2000.0 and abs(got["c"] - min(2000.0, 2 * got["b"])) < 1e-6


def test_mix_takes_each_expected_copy(spark, docs, monkeypatch):
    fields = ("id", "size", "source_size", "target", "copies", "taken")
    rows = mixing.mix(docs).collect()
    monkeypatch.setattr(mixing, "ROWS_PER_GROUP", 4)  # longer digests part the groups, the mix stays
    assert bag(rows, *fields) == bag(mixing.mix(docs).collect(), *fields)
    by_source = {}
    for r in rows:
        by_source.setdefault(r["source"], []).append(r)
        assert 0 <= r["taken"] <= 2 * r["size"] and r["taken"] == r["copies"] * r["size"]
    for part in by_source.values():
        rate = part[0]["target"] / part[0]["source_size"]
        assert abs(sum(r["copies"] for r in part) - rate * len(part)) <= 1
        assert sum(r["size"] for r in part) == part[0]["source_size"]


# ---- repetition ----

def test_repetition_counts_by_brute_force(spark, texts):
    rows = [*texts.items(), *TEXTS]
    got = repetition.repetition_rules(frame(spark, rows))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "dup_chars_5", "dup_chars_7", "dup_chars_10"]

    def expect(text):
        t = text or ""
        w = WORD.findall(t)
        lines = [x for x in t.split("\n") if WORD.search(x)]
        times, repeated = Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4)), set()
        for i in range(len(w) - 4):
            if times[tuple(w[i:i + 5])] > 1:
                repeated.update(range(i, i + 5))
        dup = []
        for n in (5, 7, 10):
            seen, inside = set(), set()
            for i in range(len(w) - n + 1):
                if tuple(w[i:i + n]) in seen:
                    inside.update(range(i, i + n))
                seen.add(tuple(w[i:i + n]))
            dup.append(sum(len(w[i]) for i in inside))
        failed = len(w) < 10 or 100 * len(repeated) > 20 * len(w)
        return (len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(repeated), *dup), failed

    out = got.collect()
    assert bag(out, "id", *names) == Counter((i, *expect(t)[0]) for i, t in rows)
    assert bag(out, "id", "base_failed") == Counter((i, expect(t)[1]) for i, t in rows)
    assert not any(r["kept"] and r["base_failed"] for r in out) and sum(r["kept"] for r in out) > len(texts) / 2


# ---- SimHash ----

def brute_force_print(text):
    b = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())
    w = re.findall(rb"[^\x20\x09-\x0D]+", b)
    shingles = [b" ".join(w[i:i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def brute_force_groups(prints, radius):
    """Smallest id per group, over (id, fingerprint) rows."""
    values = sorted({p for _, p in prints})
    up = {v: v for v in values}

    def root(v):
        while up[v] != v:
            v = up[v]
        return v

    for i, a in enumerate(values):
        for b in values[:i]:
            if (a ^ b).bit_count() <= radius:
                up[root(a)] = root(b)
    least = {}
    for i, p in prints:
        if i is not None:
            least[root(p)] = min(least.get(root(p), i), i)
    return Counter((i, p, least.get(root(p))) for i, p in prints)


@pytest.mark.parametrize("n", [50_002, 50_003, 100_003, 200_000])
def test_fingerprints_of_long_texts(n):
    draw = random.Random(n)
    ahead = (n - 2) // 2 + 1  # one shingle more than half of them, all at the end: each decides
    for text in ("b " * (n - ahead - 2) + "a " * (ahead + 2), " ".join(str(draw.randrange(2_000)) for _ in range(n))):
        assert len(text.split()) == n and simhash.fingerprint(text.encode()) == brute_force_print(text)


def test_simhash_groups_by_brute_force(spark, texts):
    rows = [*((i + 100, t) for i, t in texts.items()), *TEXTS]
    got = simhash.simhash_groups(frame(spark, rows)).collect()
    prints = [(i, brute_force_print(t)) for i, t in rows]
    assert Counter((r["id"], r["fp"] % 2 ** 64, r["component"]) for r in got) == brute_force_groups(prints, 2)
    kept = simhash.one_of_each(frame(spark, rows))
    assert kept.columns == frame(spark).columns and kept.count() == len({r["root"] for r in got})


def test_forest_links_everything_within_the_radius():
    rng = np.random.default_rng(4)
    centre = rng.integers(0, 2 ** 63, 8).astype(np.uint64)
    near = [c ^ (np.uint64(1) << np.uint64(rng.integers(64))) ^ (np.uint64(1) << np.uint64(rng.integers(64))) for c in centre for _ in range(40)]
    values = np.unique(np.concatenate((centre, near)))
    group = np.sort(rng.integers(0, 3, len(values)))
    forest = simhash.Forest(values, group)
    roots = np.array([forest.roots[g] for g in group.tolist()])
    found = {(int(a), int(b)) for q, n in forest.search(values, roots, 2) for a, b in zip(q, n)}
    assert found == {(i, j) for i in range(len(values)) for j in range(len(values))
                     if group[i] == group[j] and (int(values[i]) ^ int(values[j])).bit_count() <= 2}


@pytest.mark.parametrize("radius,tree,most", [(2, 256, 20_000), (2, 8, 12), (2, 1_000_000, 12), (0, 4, 3), (3, 16, 10)])
def test_shards_link_everything_within_the_radius(spark, radius, tree, most):
    rng = np.random.default_rng(radius)
    flip = lambda v, bits: v ^ sum(1 << int(b) for b in rng.choice(64, bits, replace=False))
    centre = [int(x) for x in rng.integers(0, 2 ** 64, 12, dtype=np.uint64)]
    # close to one another, apart by one more than the radius, and a crowd that shares 44 bits
    values = {flip(c, k) for c in centre for k in (0, 1, 1, 2, 2, radius, radius + 1)} | {0, 2 ** 64 - 1}
    values |= {centre[0] ^ int(x) for x in rng.integers(0, 2 ** 20, 150)}
    values = sorted(values)
    labels = list(range(len(values)))

    def root(i):
        while labels[i] != i:
            i = labels[i]
        return i

    for i, a in enumerate(values):
        for j in range(i):
            if (a ^ values[j]).bit_count() <= radius:
                labels[root(i)] = root(j)
    wanted = {frozenset(values[j] for j in range(len(values)) if root(j) == r) for r in set(map(root, range(len(values))))}
    signed = lambda v: v - 2 ** 64 if v >= 2 ** 63 else v
    frame = spark.createDataFrame([(signed(v),) for v in values], "fp long")
    links = simhash.fingerprint_links(frame, radius, tree, most).collect()
    groups = {v: {v} for v in values}
    for link in links:
        a, b = link["a"] % 2 ** 64, link["b"] % 2 ** 64
        if groups[a] is not groups[b]:
            groups[a] |= groups[b]
            for v in groups[b]:
                groups[v] = groups[a]
    assert {frozenset(g) for g in groups.values()} == wanted


# ---- learned models ----

def test_gradients_of_the_network():
    rng = np.random.default_rng(0)
    network = bigru.Network.untrained(["a", "b", "c"], rng, hidden=3)
    network.weights = [w.astype(np.float64) for w in network.weights]
    symbols, targets = rng.integers(97, 103, (7, 5)), rng.integers(0, 3, 5)
    loss, grads = network.gradients(symbols, targets)
    for weight, grad in zip(network.weights, grads):
        for _ in range(6):
            at = tuple(rng.integers(0, n) for n in weight.shape)
            if weight.shape[0] == bigru.PAD + 1:
                at = (int(rng.choice(symbols.ravel())), *at[1:])
            weight[at] += 1e-3
            up = network.gradients(symbols, targets)[0]
            weight[at] -= 2e-3
            down = network.gradients(symbols, targets)[0]
            weight[at] += 1e-3
            assert abs((up - down) / 2e-3 - grad[at]) < 2e-3


def test_language_of_held_out_documents(spark):
    from gridmill.llm.queries import byte_language
    folder = "/root/testdata/sf0.01"
    truth = {r["doc_id"]: r["lang"] for r in table(spark, folder, "documents").select("doc_id", "lang").collect()}
    rows = [r for r in byte_language(spark, folder).collect() if r["held_out"]]
    assert len(rows) > 100 and sum(truth[r["doc_id"]] == r["lang_pred"] for r in rows) >= 0.97 * len(rows)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_marginals_by_enumeration():
    rng = np.random.default_rng(1)
    score, steps = rng.normal(size=6), rng.normal(size=(2, 2))
    chain = np.array([0, 0, 0, 0, 1, 1])
    model = crf.Chain(np.zeros(1), 0.0, steps)
    left, right = model.messages(score, chain)
    got = 1 / (1 + np.exp(-(score + left + right)))
    total, ones = 0.0, np.zeros(6)
    for code in range(64):
        y = [(code >> k) & 1 for k in range(6)]
        weight = np.exp(sum(s for s, v in zip(score, y) if v) + sum(steps[y[k], y[k + 1]] for k in range(5) if chain[k] == chain[k + 1]))
        total += weight
        ones += weight * np.array(y)
    assert np.allclose(got, ones / total)


def test_toxic_spans_and_scores(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(120)] + [(None, 1), (500, None), (7, 1)], "doc_id long, toxic int")
    draw = random.Random(6)
    plain = ["lorem", "ipsum", "dolor", "sit", "amet", "elit", "sed", "do"]
    made = []
    for i in range(120):
        w = [draw.choice(plain) for _ in range(40)]
        if i % 2:
            w[5], w[20] = "blockhead", "blockheads"
        made.append((i, " ".join(w)))
    tagger = crf.fit_tagger(frame(spark, made), labels, labels["doc_id"] < 100)
    rows = crf.tag_toxic(frame(spark, [*made, *((i and i + 1000, t) for i, t in TEXTS)]), tagger).collect()
    for r in (r for r in rows if r["id"] is not None and 100 <= r["id"] < 120):
        assert r["predicted"] == r["id"] % 2 and (r["score"] >= 0.5) == bool(r["predicted"])
        text = made[r["id"]][1]
        assert [text[s["start"]:s["end"]] for s in r["spans"]] == (["blockhead", "blockheads"] if r["predicted"] else [])
    assert all(0 <= r["score"] <= 1 and r["predicted"] == 0 for r in rows if r["id"] is None or r["id"] >= 1000)


def test_training_reads_whole_texts(spark, monkeypatch):
    labels = spark.createDataFrame([(i, i % 2) for i in range(12)], "doc_id long, toxic int")
    made = [(i, "lorem ipsum " * 1_000 * (i + 1) + "blockhead" * (i % 2)) for i in range(12)]
    seen = []
    monkeypatch.setattr(crf.Tagger, "fit", lambda texts, toxic: seen.append(sorted(zip(texts, toxic))))
    crf.fit_tagger(frame(spark, made), labels, F.lit(True), mean_bytes=200_000)
    assert seen[0] == sorted((t.encode(), i % 2) for i, t in made)
    crf.fit_tagger(frame(spark, made), labels, F.lit(True), per_class={0: 6, 1: 6}, mean_bytes=20_000)
    whole = {t.encode() for _, t in made}
    for label in (0, 1):
        assert 0 < sum(len(t) for t, y in seen[1] if y == label) <= 120_000 and all(t in whole for t, _ in seen[1])


def test_models_without_training_rows(spark):
    docs = frame(spark)
    nothing = bigru.fit_languages(docs, docs["doc_id"] < 0)
    rows = bigru.predict_languages(docs, nothing, keep=("kept", "score")).collect()
    assert len(rows) == len(TEXTS) and {r["lang_pred"] for r in rows} == {"und"}
    tagger = crf.fit_tagger(docs, spark.createDataFrame([], "doc_id long, toxic int"), F.col("doc_id") > 0)
    assert {r["predicted"] for r in crf.tag_toxic(docs, tagger).collect()} == {0}


def test_languages_of_awkward_rows(spark):
    docs = frame(spark)
    network = bigru.fit_languages(docs, docs["doc_id"].isNotNull())
    rows = bigru.predict_languages(docs, network, keep=("text",)).collect()
    assert len(rows) == len(TEXTS)
    for r in rows:
        assert (r["lang_pred"] == "und") == (r["text"] is None or not any(c.isalpha() for c in r["text"]))


# ---- empty tables and awkward columns ----

def test_empty_tables(spark):
    docs = frame(spark, []).where("false")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    outputs = [
        licences.licence_scan(docs), runindex.remove_repeats(docs), pieces.encode(docs, PIECE_MODEL), mixing.mix(docs),
        repetition.repetition_rules(docs), simhash.simhash_groups(docs), simhash.one_of_each(docs),
        crf.tag_toxic(docs, crf.fit_tagger(docs, labels, labels["doc_id"] > 0)),
        bigru.predict_languages(docs, bigru.fit_languages(docs, docs["doc_id"] > 0))]
    assert [df.count() for df in outputs] == [0] * len(outputs)


def test_rows_stay_with_awkward_columns(spark):
    docs = frame(spark)
    for df in (licences.licence_scan(docs), mixing.mix(docs), mixing.mix(docs, carry=("kept", "score", "chunk"))):
        assert df.count() == len(TEXTS)
    mixed = mixing.mix(docs).collect()
    assert {r["size"] for r in mixed if r["id"] in (2, 3, 6)} == {0} and max(r["size"] for r in mixed) == 30_000


def test_kept_digest_of_the_query(spark, texts):
    from gridmill.llm.queries import run_index_dedup
    want = {i: hashlib.sha256(kept).hexdigest() for (i, _, _, _, kept) in brute_force_removal(list(texts.items()), 50)}
    assert {r["doc_id"]: r["kept_sha256"] for r in run_index_dedup(spark, FOLDER).collect()} == want
