"""Toxic spans by a linear-chain conditional random field over words; marginals are pooled to document scores."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from gridmill.llm.common import BASE, INVERSE, byte_view, mixed, powers, text_slices

TABLE_BITS = 20
PREFIXES, SUFFIXES = (4, 5, 6, 7, 8, 9), (4,)   # bytes of a word that are features beside the whole word
SEQUENCE = 64                # words of a chain at most; a chain stays inside one line
DOCS_PER_CLASS = {1: 400, 0: 2000}  # training bound, and the bytes that a class may hold for each of its documents, on average
SAMPLE_BYTES = 20_000
# A feature marks toxic words if it stands in so many toxic training documents, and that much more often than in clean ones.
SUPPORT, SUPPORT_SHARE, LIFT = 3, 0.01, 5.0
EPOCHS, CHAINS, RATE, DECAY = 4, 2048, 0.2, 1e-3


@dataclass
class Words:
    """Words of a slice of texts: letter runs, with their byte spans, their text, their chain and the rows of their features."""
    starts: np.ndarray
    ends: np.ndarray
    owner: np.ndarray
    chain: np.ndarray
    features: np.ndarray


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z and the upper-case Latin-1 letters in lower case; lengths stay."""
    out = data.copy()
    out[(data >= 65) & (data <= 90)] += 32
    wide = np.flatnonzero((data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97) & (data[:-1] == 0xC3)) + 1
    out[wide] += 32
    return out


def words_in(data: np.ndarray, bounds: np.ndarray) -> Words:
    low = lowered(data)
    letter = ((low >= 97) & (low <= 122)) | (low >= 0x80)
    edge = np.zeros(len(data) + 1, bool)
    edge[bounds] = True
    before, after = np.append(False, letter[:-1]), np.append(letter[1:], False)
    starts = np.flatnonzero(letter & (~before | edge[:-1]))
    ends = np.flatnonzero(letter & (~after | edge[1:])) + 1
    owner = np.searchsorted(bounds, starts, side="right") - 1
    line = np.concatenate(([0], np.cumsum(data == 10)))[starts] + owner  # grows at each line break and each text
    new = np.append(True, line[1:] != line[:-1]) if len(line) else np.zeros(0, bool)
    head = np.flatnonzero(new)
    nth = np.arange(len(line)) - head[np.cumsum(new) - 1] if len(line) else line
    chain = np.cumsum(new | (nth % SEQUENCE == 0)) - 1
    n = len(data)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((low.astype(np.uint64) + np.uint64(1)) * powers(BASE, n))))
    unit = powers(INVERSE, n + 1)
    size = ends - starts
    shift = np.uint64(64 - TABLE_BITS)

    def rows(lo, hi, kind: int):
        return (mixed((sums[hi] - sums[lo]) * unit[lo] + np.uint64(kind * 0x51ED27)) >> shift).astype(np.int32)

    spans = [(starts, ends, 1)] + [(starts, np.minimum(starts + k, ends), 2) for k in PREFIXES]
    spans += [(np.maximum(ends - k, starts), ends, 3) for k in SUFFIXES]
    features = np.stack([rows(*s) for s in spans])
    for row, k in zip(features[1:], (*PREFIXES, *SUFFIXES)):
        row[size < k] = 0  # row 0 stands for a part that is not there
    return Words(starts, ends, owner, chain, features)


@dataclass
class Chain:
    """Weights of the two labels: a log-odds weight per feature row, a bias, and the 2 x 2 transition weights."""
    table: np.ndarray
    bias: float
    steps: np.ndarray

    def emission(self, words: Words) -> np.ndarray:
        return self.table[words.features].sum(axis=0) + self.bias

    def messages(self, score: np.ndarray, chain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log-odds that come to each word from the left and from the right of its chain, all chains in lockstep."""
        return _pass(score, chain, self.steps), _pass(score[::-1], chain.max(initial=0) - chain[::-1], self.steps.T)[::-1]

    def marginals(self, words: Words) -> np.ndarray:
        score = self.emission(words)
        left, right = self.messages(score, words.chain)
        return 1 / (1 + np.exp(-np.clip(score + left + right, -40, 40)))


def _pass(score: np.ndarray, chain: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """message[t] = log of (sum over the label before, into label 1) minus the same into label 0."""
    out = np.zeros(len(score))
    if not len(score):
        return out
    heads = np.flatnonzero(np.append(True, chain[1:] != chain[:-1]))
    sizes = np.diff(np.append(heads, len(score)))
    order = np.argsort(-sizes, kind="stable")
    heads, sizes = heads[order], sizes[order]
    for t in range(1, int(sizes[0])):
        at = heads[:np.searchsorted(-sizes, -t, side="left")] + t
        odds = score[at - 1] + out[at - 1]
        out[at] = np.logaddexp(odds + steps[1, 1], steps[0, 1]) - np.logaddexp(odds + steps[1, 0], steps[0, 0])
    return out


def marked_words(words: Words, toxic: np.ndarray) -> np.ndarray:
    """Token labels from document labels: in toxic documents, the words with a feature that marks them.

    A feature marks if it stands in enough toxic documents and LIFT times as often there as in clean ones.
    """
    rows = 1 << TABLE_BITS
    in_bad, in_clean = np.zeros(rows, np.int64), np.zeros(rows, np.int64)
    for kind in words.features:  # documents that hold each feature, one kind of features at a time
        seen = np.unique(words.owner * np.int64(rows) + kind)
        bad = toxic[seen // rows] == 1
        in_bad += np.bincount(seen[bad] % rows, minlength=rows)
        in_clean += np.bincount(seen[~bad] % rows, minlength=rows)
    n_bad, n_clean = max(1, int((toxic == 1).sum())), max(1, int((toxic == 0).sum()))
    lift = (in_bad / n_bad) / ((in_clean + 0.5) / (n_clean + 1))
    marks = (in_bad >= max(SUPPORT, SUPPORT_SHARE * n_bad)) & (lift >= LIFT)
    marks[0] = False
    return (toxic[words.owner] == 1) & marks[words.features].any(axis=0)


def fit_chain(words: Words, labels: np.ndarray, seed: int = 5) -> Chain:
    """Maximise the likelihood of the token labels by Adagrad over random groups of chains."""
    rng = np.random.default_rng(seed)
    model = Chain(np.zeros(1 << TABLE_BITS), -2.0, np.zeros((2, 2)))
    squares = [np.ones(1 << TABLE_BITS), 1e-6, np.full((2, 2), 1e-6)]
    chains = int(words.chain[-1]) + 1 if len(words.chain) else 0
    heads = np.searchsorted(words.chain, np.arange(chains + 1))
    for _ in range(EPOCHS if labels.any() else 0):
        for pick in np.array_split(rng.permutation(chains), chains // CHAINS + 1):
            sizes = heads[pick + 1] - heads[pick]
            at = np.repeat(heads[pick] - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) + np.arange(sizes.sum())
            if not len(at):
                continue
            chain, features, gold = np.repeat(np.arange(len(pick)), sizes), words.features[:, at], labels[at].astype(np.int64)
            score = model.table[features].sum(axis=0) + model.bias
            left, right = model.messages(score, chain)
            chance = 1 / (1 + np.exp(-np.clip(score + left + right, -40, 40)))
            error = chance - gold
            rows, place = np.unique(features.ravel(), return_inverse=True)
            grad = np.bincount(place, np.tile(error, len(features))) + DECAY * model.table[rows]
            grad[rows == 0] = 0
            squares[0][rows] += grad ** 2
            model.table[rows] -= RATE * grad / np.sqrt(squares[0][rows])
            push = error.mean()
            squares[1] += push ** 2
            model.bias -= RATE * push / np.sqrt(squares[1])
            pair = np.flatnonzero(chain[1:] == chain[:-1])
            if len(pair):
                odds = (score + left)[pair], (score + right)[pair + 1]
                joint = np.stack([[odds[0] * a + odds[1] * b + model.steps[a, b] for b in (0, 1)] for a in (0, 1)])
                joint = np.exp(joint - joint.max(axis=(0, 1)))
                joint /= joint.sum(axis=(0, 1))
                real = np.array([[((gold[pair] == a) & (gold[pair + 1] == b)).mean() for b in (0, 1)] for a in (0, 1)])
                push = joint.mean(axis=2) - real
                squares[2] += push ** 2
                model.steps -= RATE * push / np.sqrt(squares[2])
    return model


def pooled(chance: np.ndarray, owner: np.ndarray, texts: int, floor: float = 0.2) -> np.ndarray:
    """Per text: how surely a word is toxic (minus the log of the chance that none is), and the length.

    Marginals up to ``floor`` are background and left out, so that long clean texts don't add them up.
    """
    counted = np.where(chance > floor, np.minimum(chance, 1 - 1e-6), 0)
    sure = -np.bincount(owner, np.log1p(-counted), texts)
    return np.stack([np.log1p(sure), np.log(np.bincount(owner, minlength=texts) + 20)], axis=1)


def fit_logistic(x: np.ndarray, y: np.ndarray, rounds: int = 30, ridge: float = 1e-2) -> np.ndarray:
    """Newton steps for a calibrated document score; the last weight is the intercept."""
    x = np.concatenate((x, np.ones((len(x), 1))), axis=1)
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        curve = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w -= np.linalg.solve(curve, x.T @ (p - y) + ridge * w)
    return w


@dataclass
class Tagger:
    chain: Chain
    document: np.ndarray

    @classmethod
    def fit(cls, texts: list[bytes], toxic: list[int]) -> Tagger:
        """Without rows of both classes the tagger finds nothing and gives every document score 0."""
        y = np.array(toxic, np.int64)
        words = words_in(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]))
        if not len(words.starts) or len(set(toxic)) < 2:
            return cls(Chain(np.zeros(1 << TABLE_BITS), -40.0, np.zeros((2, 2))), np.array([0.0, 0, -40]))
        chain = fit_chain(words, marked_words(words, y))
        return cls(chain, fit_logistic(pooled(chain.marginals(words), words.owner, len(y)), y))

    def scores(self, chance: np.ndarray, owner: np.ndarray, texts: int) -> np.ndarray:
        x = pooled(chance, owner, texts) @ self.document[:-1] + self.document[-1]
        return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit_tagger(docs: DataFrame, labels: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text",
               label_col: str = "toxic", per_class: dict[int, int] | None = None, mean_bytes: int = SAMPLE_BYTES) -> Tagger:
    """Train on the driver from a bounded sample: whole texts of the ``per_class`` labelled, usable ids of least hash.

    Taken in that order, a document that brings its class above ``per_class`` times ``mean_bytes`` is left out as a whole.  Rows with a null id, text or label are left out; an id with both labels counts as toxic.
    """
    bound = DOCS_PER_CLASS if per_class is None else per_class
    marks = labels.where(usable & F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("id")).agg(
        F.max(label_col).cast("int").alias("toxic")).withColumn("_order", F.xxhash64("id"))
    texts = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    sample = []
    for label, n in sorted(bound.items()):
        chosen = marks.where(F.col("toxic") == label).orderBy("_order", "id").limit(n)
        found = texts.join(F.broadcast(chosen), "id")  # at most n ids are sent
        sizes = found.groupBy("_order", "id").agg(F.sum(F.octet_length("text")).alias("size")).orderBy("_order", "id").collect()
        fitting, left = [], n * mean_bytes
        for r in sizes:
            if r["size"] <= left:
                fitting.append(r["id"])
                left -= r["size"]
        if fitting:
            ids = docs.sparkSession.createDataFrame([(i,) for i in fitting], marks.select("id").schema)
            sample += texts.join(F.broadcast(ids), "id").select("id", F.lit(label).alias("toxic"), "text").collect()
    rows = sorted({(r["id"], r["toxic"], r["text"]) for r in sample})
    return Tagger.fit([t.encode() for _, _, t in rows], [y for _, y, _ in rows])


def spans_of(words: Words, chance: np.ndarray, data: np.ndarray, bounds: np.ndarray, bound: float = 0.5) -> list[list[dict]]:
    """Runs of neighbouring words of a chain with a marginal of ``bound`` or more, as character offsets into their text."""
    lead = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    bad = chance >= bound
    out: list[list[dict]] = [[] for _ in range(len(bounds) - 1)]
    at = np.flatnonzero(bad)
    if len(at):
        first = np.append(True, (np.diff(at) > 1) | (np.diff(words.chain[at]) != 0))
        heads = np.flatnonzero(first)
        tops = np.maximum.reduceat(chance[at], heads)
        tails = np.append(heads[1:], len(at)) - 1
        owner = words.owner[at[heads]]
        base = lead[bounds[owner]]
        begin, end = lead[words.starts[at[heads]]] - base, lead[words.ends[at[tails]]] - base
        for o, b, e, p in zip(owner.tolist(), begin.tolist(), end.tolist(), tops.tolist()):
            out[o].append({"start": b, "end": e, "marginal": p})
    return out


def tag_toxic(docs: DataFrame, tagger: Tagger, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Score every whole text: id, score, predicted, expected_words and spans (start, end, marginal) of the offending words.

    One row per row of ``docs``, nothing is shuffled.  Null texts and texts without letters have no spans and the score that the
    document model gives to no words.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tagger)  # 2**TABLE_BITS weights
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("marginal", pa.float64())]))

    def run(batches):
        model = shared.value
        for batch in text_slices(batches, "text"):
            data, bounds = byte_view(batch.column("text"))
            words = words_in(data, bounds)
            chance = model.chain.marginals(words)
            score = model.scores(chance, words.owner, len(bounds) - 1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(score), pa.array((score >= 0.5).astype(np.int32)),
                 pa.array(np.bincount(words.owner, chance, len(bounds) - 1).astype(float)), pa.array(spans_of(words, chance, data, bounds), span)],
                ["id", "score", "predicted", "expected_words", "spans"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, score double, predicted int, expected_words double, "
                                "spans array<struct<start:bigint,end:bigint,marginal:double>>")
