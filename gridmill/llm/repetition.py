"""Quality rules on repetition: characters inside duplicated n-grams and lines, from rolling hashes in numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gridmill.llm.common import BASE, byte_view, is_space, mixed, powers, span_hashes, text_slices, word_spans

# n-gram length -> largest share of the word characters that may stand in n-grams seen before in the text.
NGRAM_SHARE = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
LINE_SHARE = 0.30
SYMBOLS = b"#*$%&|<>"

COUNTS = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "dup_line_chars", "n_repeat_words"]


def _repeats(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each key: whether it occurs again anywhere, and whether it occurred before."""
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    shared, later = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    later[order[1:]] = same
    shared[order[1:]] |= same
    shared[order[:-1]] |= same
    return shared, later


def _covered(n: int, starts: np.ndarray, width: int) -> np.ndarray:
    """Which of n places lie in a window of the given width."""
    steps = np.bincount(starts, minlength=n + 1)[:n + 1] - np.bincount(starts + width, minlength=n + 1)[:n + 1]
    return np.cumsum(steps[:n]) > 0


def measure(data: np.ndarray, bounds: np.ndarray, window: int = 5, lengths=tuple(NGRAM_SHARE)) -> dict[str, np.ndarray]:
    """Counts per text of a slice of texts; ``dup_chars_n`` are the characters in n-grams that occurred before in the text."""
    docs = len(bounds) - 1
    space = is_space(data)
    lead = (data & 0xC0) != 0x80
    per_text = lambda flags: np.diff(np.concatenate(([0], np.cumsum(flags)))[bounds])
    starts, ends, owner = word_spans(data, bounds, space)
    chars = np.concatenate(([0], np.cumsum(lead & ~space)))
    word_chars = chars[ends] - chars[starts]
    salt = mixed(np.arange(docs, dtype=np.uint64) + np.uint64(1))
    total = lambda which, weight=None: np.bincount(which, weight, docs).astype(np.int64)
    out = {"n_words": total(owner), "word_chars": total(owner, word_chars), "n_symbols": per_text(np.isin(data, list(SYMBOLS)))}

    breaks = np.flatnonzero(data == 10)
    line_starts = np.unique(np.concatenate((bounds[:-1], breaks + 1)))
    line_starts = line_starts[line_starts < len(data)]
    line_ends = np.minimum(np.append(line_starts[1:], len(data)), len(data))
    line_ends = line_ends - (data[line_ends - 1] == 10) if len(line_starts) else line_ends
    line_owner = np.searchsorted(bounds, line_starts, side="right") - 1
    line_chars = chars[line_ends] - chars[line_starts]
    real = line_chars > 0
    line_starts, line_ends, line_owner, line_chars = (x[real] for x in (line_starts, line_ends, line_owner, line_chars))
    _, later = _repeats(span_hashes(data, line_starts, line_ends) ^ salt[line_owner])
    out |= {"n_lines": total(line_owner), "n_dup_lines": total(line_owner[later]),
            "dup_line_chars": total(line_owner[later], line_chars[later])}

    words, n = span_hashes(data, starts, ends), len(starts)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(words * powers(BASE, n))))
    unit = powers(pow(BASE, -1, 1 << 64), n + 1)
    first_word = np.concatenate(([0], np.cumsum(out["n_words"])))

    def keys(at: np.ndarray, width: int) -> np.ndarray:
        return mixed((sums[at + width] - sums[at]) * unit[at]) ^ salt[owner[at]]

    def fitting(at: np.ndarray, width: int) -> np.ndarray:
        return at[at + width <= first_word[owner[at] + 1]]

    at = fitting(np.arange(n), window)
    shared, _ = _repeats(keys(at, window))
    out["n_repeat_words"] = total(owner[_covered(n, at[shared], window)])
    at = at[shared] if min(lengths) >= window else np.arange(n)
    for width in sorted(lengths):  # an n-gram occurs twice only if the shorter one at its start does
        at = fitting(at, width)
        shared, later = _repeats(keys(at, width))
        inside = _covered(n, at[later], width)
        out[f"dup_chars_{width}"] = total(owner[inside], word_chars[inside])
        at = at[shared]
    return out


def repetition_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 5,
                      lengths=tuple(NGRAM_SHARE)) -> DataFrame:
    """The counts of ``measure`` for every whole text; one row per row of ``docs``, nothing is shuffled.

    n-grams and lines are compared inside one text only.  Null and empty texts have all counts 0.
    """
    names = [*COUNTS, *(f"dup_chars_{n}" for n in lengths)]
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches):
        for batch in text_slices(batches, "text"):
            found = measure(*byte_view(batch.column("text")), window, lengths)
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(found[c], pa.int64()) for c in names)], ["id", *names])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, " + ", ".join(f"{c} long" for c in names))


def repetition_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 10,
                     repeat_percent: int = 20, ngram_share: dict[int, float] | None = None, line_share: float = LINE_SHARE) -> DataFrame:
    """Counts and verdict per document.

    ``base_failed``: fewer than ``min_words`` words, or more than ``repeat_percent`` % of them in repeated five-word windows.  ``kept`` is
    false for those; the others are kept unless the share of word characters inside n-grams seen before passes its bound for a
    length, or that inside lines seen before passes ``line_share``.  Null and empty texts fail the base rule.
    """
    bound = dict(NGRAM_SHARE if ngram_share is None else ngram_share)
    rows = repetition_counts(docs, id_col, text_col, lengths=tuple(bound))
    chars = F.col("word_chars")
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words"))
    kept = ~failed & (F.col("dup_line_chars") <= line_share * chars)
    for n, share in bound.items():
        kept = kept & (F.col(f"dup_chars_{n}") <= share * chars)
    return rows.select("*", failed.alias("base_failed"), kept.alias("kept"))
