"""A small table with every awkward case, and its empty twin."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, score double, kept boolean, copies int, _row int, chunk string"


def words(seed: int, n: int) -> str:
    draw = random.Random(seed)
    return " ".join("".join(draw.choice(["th", "er", "on", "an", "ing", "é", "st"]) for _ in range(draw.randint(1, 4))) for _ in range(n))


SHARED = words(99, 30)
LONG = words(5, 30_000)
TEXTS = [
    (1, words(1, 60) + "\n" + SHARED), (2, None), (3, ""), (4, LONG), (5, words(1, 60) + "\n" + SHARED), (5, words(1, 60) + "\n" + SHARED),
    (6, " \n\t "), (7, "1234 ### 99"), (8, SHARED + " " + words(8, 40)), (9, "日本語のテキスト😀 " + SHARED), (None, words(1, 60) + "\n" + SHARED),
    (None, None), (10, "a"), (10, "b c d e"), (11, words(11, 12)), (12, "Released under the MIT License.\n" + words(12, 20)),
]


def frame(spark, rows=None):
    rows = TEXTS if rows is None else rows
    return spark.createDataFrame(
        [(i, t, None if n % 4 == 3 else ("fr" if n % 2 else "en"), None if n % 5 == 4 else f"s{n % 2}", None if t is None else len(t),
          "clash", 0.5, True, 7, 1, "c") for n, (i, t) in enumerate(rows)], SCHEMA)
