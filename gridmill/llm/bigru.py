"""Language identification: a bidirectional gated recurrent network over bytes that labels every position."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from gridmill.llm.common import byte_view, frugal, kept_as, text_slices

WINDOW = 64            # bytes that a pass reads together; texts are cut into such windows from end to end
HIDDEN = 8             # state size of each direction
PAD = 256              # symbol after the end of a text
DOCS_PER_LANGUAGE = 300  # training bound: one snippet of each of so many documents a language
SNIPPET = 480          # characters of a snippet
LANGUAGES = 64         # training bound: the languages with the most documents are learned
PLACES = 1 << 40       # of the hash that orders the sample
STEPS, BATCH, RATE = 300, 192, 0.02
UNKNOWN = "und"


def windows_of(data: np.ndarray, bounds: np.ndarray, width: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all windows as columns, and the text of each window."""
    sizes = np.diff(bounds)
    per_text = -(-sizes // width)
    owner = np.repeat(np.arange(len(sizes)), per_text)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(per_text) - per_text, per_text)
    starts = bounds[owner] + nth * width
    at = starts + np.arange(width)[:, None]
    beyond = at >= bounds[owner + 1]
    symbols = data[np.minimum(at, max(len(data) - 1, 0))].astype(np.int32) if len(owner) else np.zeros((width, 0), np.int32)
    symbols[beyond] = PAD
    return symbols, owner


def is_letter_byte(symbols: np.ndarray) -> np.ndarray:
    low = symbols | 32
    return ((low >= 97) & (low <= 122) & (symbols < 128)) | ((symbols >= 128) & (symbols < PAD))


def _gate(x: np.ndarray) -> np.ndarray:
    x *= 0.5
    np.tanh(x, out=x)
    x += 1
    x *= 0.5
    return x


def states(table: np.ndarray, inner: np.ndarray, symbols: np.ndarray, trace: list | None = None) -> np.ndarray:
    """States (time, hidden, window) of one direction; ``table`` holds a symbol's inputs to the three gates, ``inner`` the recurrent weights."""
    h = np.zeros((inner.shape[1], symbols.shape[1]), np.float32)
    size = len(h)
    out = np.empty((len(symbols), *h.shape), np.float32)
    for t, row in enumerate(symbols):
        x = table[row].T
        gates = inner[:2 * size] @ h
        gates += x[:2 * size]
        _gate(gates)
        r, z = gates[:size], gates[size:]
        n = inner[2 * size:] @ (r * h)
        n += x[2 * size:]
        np.tanh(n, out=n)
        if trace is not None:
            trace.append((h, r, z, n))
        h = h - n
        h *= z
        h += n
        out[t] = h
    return out


def through_time(inner: np.ndarray, symbols: np.ndarray, trace: list, grad_out: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the table and the recurrent weights, from the gradients of the states, backwards in time."""
    size = inner.shape[1]
    grad_inner = np.zeros_like(inner)
    grads = np.empty((len(symbols), 3 * size, symbols.shape[1]), np.float32)
    carried = np.zeros((size, symbols.shape[1]), np.float32)
    for t in range(len(symbols) - 1, -1, -1):
        h, r, z, n = trace[t]
        total = grad_out[t] + carried
        at_n = total * (1 - z) * (1 - n * n)
        gated = inner[2 * size:].T @ at_n
        at_r, at_z = gated * h * r * (1 - r), total * (h - n) * z * (1 - z)
        grads[t] = np.concatenate((at_r, at_z, at_n))
        grad_inner += np.concatenate((at_r @ h.T, at_z @ h.T, at_n @ (r * h).T))
        carried = total * z + gated * r + inner[:2 * size].T @ grads[t, :2 * size]
    flat, cells = symbols.ravel(), grads.transpose(1, 0, 2).reshape(3 * size, -1)
    return np.stack([np.bincount(flat, c, PAD + 1) for c in cells], axis=1).astype(np.float32), grad_inner


@dataclass
class Network:
    languages: list[str]
    weights: list[np.ndarray]  # table and recurrent weights of both directions, output weights, output bias

    @classmethod
    def untrained(cls, languages: list[str], rng: np.random.Generator, hidden: int = HIDDEN) -> Network:
        draw = lambda *shape: (rng.normal(size=shape) * 0.3).astype(np.float32)
        return cls(languages, [draw(PAD + 1, 3 * hidden), draw(3 * hidden, hidden), draw(PAD + 1, 3 * hidden), draw(3 * hidden, hidden),
                               draw(len(languages), 2 * hidden), np.zeros(len(languages), np.float32)])

    def positions(self, symbols: np.ndarray, traces=(None, None)) -> tuple[np.ndarray, np.ndarray]:
        """States of both directions, and the probability of every language at every position: (time, language, window)."""
        ft, fu, bt, bu, weight, bias = self.weights
        both = np.concatenate((states(ft, fu, symbols, traces[0]), states(bt, bu, symbols[::-1], traces[1])[::-1]), axis=1)
        logits = np.matmul(weight, both)
        logits += bias[:, None]
        logits -= logits.max(axis=1, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(axis=1, keepdims=True)
        return both, logits

    def gradients(self, symbols: np.ndarray, targets: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean loss over letter positions, and its gradient by every weight."""
        traces = ([], [])
        both, chance = self.positions(symbols, traces)
        counted = is_letter_byte(symbols)[:, None, :].astype(np.float32)
        total = max(1.0, float(counted.sum()))
        hit = chance[:, targets, np.arange(len(targets))]
        loss = -float((np.log(np.maximum(hit, 1e-9)) * counted[:, 0]).sum()) / total
        error = chance.copy()
        error[:, targets, np.arange(len(targets))] -= 1
        error *= counted / total
        _, _, _, _, weight, _ = self.weights
        grad_weight = np.matmul(error, both.transpose(0, 2, 1)).sum(axis=0)
        back = np.matmul(weight.T, error)
        size = self.weights[1].shape[1]
        forward = through_time(self.weights[1], symbols, traces[0], back[:, :size])
        reverse = through_time(self.weights[3], symbols[::-1], traces[1], back[::-1, size:])
        return loss, [*forward, *reverse, grad_weight, error.sum(axis=(0, 2))]

    @classmethod
    def fit(cls, texts: list[bytes], labels: list[str], steps: int = STEPS, seed: int = 11) -> Network:
        """Adam over random batches of windows, languages drawn equally often."""
        rng = np.random.default_rng(seed)
        languages = sorted(set(labels))
        network = cls.untrained(languages, rng)
        bounds = np.cumsum([0, *map(len, texts)])
        symbols, owner = windows_of(np.frombuffer(b"".join(texts), np.uint8), bounds)
        target = np.array([languages.index(x) for x in labels], np.int64)[owner]
        pools = [np.flatnonzero(target == k) for k in range(len(languages))]
        pools = [(k, p) for k, p in enumerate(pools) if len(p)]
        moments = [(np.zeros_like(w), np.zeros_like(w)) for w in network.weights]
        for step in range(1, steps + 1 if pools else 1):
            pick = np.concatenate([rng.choice(p, max(1, BATCH // len(pools))) for _, p in pools])
            _, grads = network.gradients(np.ascontiguousarray(symbols[:, pick]), target[pick])
            rate = RATE * min(1.0, 2 * (1 - step / (steps + 1))) * np.sqrt(1 - 0.999 ** step) / (1 - 0.9 ** step)
            for weight, grad, (mean, square) in zip(network.weights, grads, moments):
                mean += 0.1 * (grad - mean)
                square += 0.001 * (grad * grad - square)
                weight -= (rate * mean / (np.sqrt(square) + 1e-8)).astype(np.float32)
        return network

    def pooled(self, data: np.ndarray, bounds: np.ndarray, block: int = 4096) -> np.ndarray:
        """Mean probabilities over the letter positions of every text: (text, language); zero where there are none."""
        texts = len(bounds) - 1
        sums, counts = np.zeros((texts, len(self.languages))), np.zeros(texts)
        symbols, owner = windows_of(data, bounds)
        for lo in range(0, len(owner), block):
            part = np.ascontiguousarray(symbols[:, lo:lo + block])
            _, chance = self.positions(part)
            counted = is_letter_byte(part)
            chance *= counted[:, None, :]
            for k, c in enumerate(chance.sum(axis=0)):
                sums[:, k] += np.bincount(owner[lo:lo + block], c, texts)
            counts += np.bincount(owner[lo:lo + block], counted.sum(axis=0), texts)
        return sums / np.maximum(counts, 1)[:, None]


def fit_languages(docs: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                  per_language: int = DOCS_PER_LANGUAGE, snippet: int = SNIPPET, languages: int = LANGUAGES) -> Network:
    """Train on the driver from a bounded sample of rows that are ``usable`` and have a text and a language.

    The sample is one snippet, at a place set by the id's hash, from ``per_language`` documents (least hash of the id) of each of the
    ``languages`` most frequent languages: less than 20,000 snippets of 480 characters.
    """
    order = F.pmod(F.xxhash64(id_col, text_col), F.lit(PLACES))
    start = F.pmod(order, F.greatest(F.length(text_col) - snippet, F.lit(1))) + 1
    rows = docs.where(usable & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(lang_col).alias("lang"), order.alias("_order"),
        F.substring(F.col(text_col), start.cast("int"), F.lit(snippet)).alias("snippet"))
    common = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(languages).collect()
    if not common:
        return Network([], [])
    # Of a frequent language only hashes low enough for some times the documents wanted go on to be ranked.
    low = F.lit(False)
    for r in common:
        low = low | ((F.col("lang") == r["lang"]) & (F.col("_order") < min(PLACES, PLACES * 8 * per_language // r["count"] + 1)))
    first = Window.partitionBy("lang").orderBy("_order", "snippet")
    taken = rows.where(low).withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= per_language).drop("_n")
    sample = sorted(tuple(r) for r in taken.select("lang", "_order", "snippet").collect())
    return Network.fit([s.encode() for _, _, s in sample], [lang for lang, _, _ in sample])


def predict_languages(docs: DataFrame, network: Network, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Label every position of every whole text and pool: id, lang_pred, score, and the columns in ``keep`` (``_kept`` is added to names that clash).

    One row per row of ``docs``, nothing is shuffled.  Null texts, texts without a letter and every text of an untrained network are ``und``
    with score 0.  Equal pools go to the first language by name.
    """
    shared = docs.sparkSession.sparkContext.broadcast(network)  # a few thousand weights
    rows = docs.select(F.struct(F.col(id_col), *keep).alias("kept"), F.col(text_col).alias("text"))

    def run(batches):
        model = shared.value
        names = np.array([*model.languages, UNKNOWN])
        for batch in text_slices(batches, "text"):
            text = batch.column("text")
            lettered = pc.fill_null(pc.match_substring_regex(text, r"\p{L}"), False).to_numpy(zero_copy_only=False)
            best, score = np.full(len(text), len(names) - 1), np.zeros(len(text))
            if model.languages:
                pool = model.pooled(*byte_view(text))
                best = np.where(lettered, pool.argmax(axis=1), best)
                score = np.where(lettered, np.minimum(pool.max(axis=1), 1.0), 0.0)
            yield pa.RecordBatch.from_arrays([batch.column("kept"), pa.array(names[best].tolist(), pa.string()), pa.array(score)],
                                             ["kept", "lang_pred", "score"])

    out = rows.mapInArrow(frugal(run), T.StructType([rows.schema["kept"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))
    results = ["id", "lang_pred", "score"]
    return out.select(F.col(f"kept.{id_col}").alias("id"), *results[1:], *(F.col(f"kept.{c}").alias(kept_as(c, results)) for c in keep))
