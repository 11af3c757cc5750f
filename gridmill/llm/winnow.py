"""Benchmark decontamination by winnowing, with DataFrame functions only.

Every run of ``window`` words that a text shares with an item has the same smallest k-gram hash in both.  Those fingerprints are joined, and each
hit is extended to the windows around it, which are compared as whole texts.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, functions as F

from gridmill.llm.common import kept_as, staged

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"  # what stands between words, once A-Z are lower case
WINDOW = 10


def words_of(text: Column) -> Column:
    """The words of a text, A-Z in lower case; other letters stay as they are."""
    plain = F.octet_length(text) == F.char_length(text)
    low = F.when(plain, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))
    return F.filter(F.split(low, SEPARATORS), lambda w: w != "")


def worded(rows: DataFrame, text_col: str, *columns: Column) -> DataFrame:
    """The columns and ``w``, the words of a text, for texts that have any."""
    return rows.select(*columns, words_of(F.coalesce(F.col(text_col), F.lit(""))).alias("w")).where(F.size("w") > 0)


def fingerprints(rows: DataFrame, keys: list[str], span: int) -> DataFrame:
    """Winnowed fingerprints of the words ``w``: the keys, span, print, at (the first window that has it) and t, the words of all windows in a row that have it.

    Hashes of k words are taken at every place, k being half of the span; of the hashes inside each window of ``span`` words the smallest is
    kept.  Windows in a row with the same smallest hash give one row.
    """
    k = (span + 1) // 2
    width = span - k + 1
    long = rows.where(F.size("w") >= span).select(*keys, "w", F.transform("w", lambda w: F.xxhash64(w)).alias("h"))
    grams = F.transform(F.sequence(F.lit(0), F.size("h") - k), lambda i: F.xxhash64(*(F.get("h", i + j) for j in range(k))))
    least = lambda i: F.least(*(F.get("g", i + j) for j in range(width))) if width > 1 else F.get("g", i)
    smallest = F.transform(F.sequence(F.lit(0), F.size("g") - width), least)
    starts = F.filter(F.sequence(F.lit(0), F.size("m") - 1), lambda i: (i == 0) | (F.get("m", i) != F.get("m", i - 1)))
    windows = lambda at, i: F.coalesce(F.get("s", i + 1), F.size("m")) - at
    runs = F.transform("s", lambda at, i: F.struct(
        F.get("m", at).alias("print"), at.alias("at"), F.array_join(F.slice("w", at + 1, windows(at, i) + (span - 1)), " ").alias("t")))
    out = long.select(*keys, "w", grams.alias("g")).select(*keys, "w", smallest.alias("m")).select(*keys, "w", "m", starts.alias("s"))
    return out.select(*keys, F.lit(span).alias("span"), F.explode(runs).alias("r")).select(*keys, "span", "r.print", "r.at", "r.t")


def windows_at(rows: DataFrame, keys: list[str], places: Column, span: Column) -> DataFrame:
    """The texts of the windows of ``span`` words that start at the given places of ``w``: keys, span, at, t."""
    texts = F.transform(places, lambda at: F.struct(at.alias("at"), F.array_join(F.slice("w", at + 1, span), " ").alias("t")))
    return rows.select(*keys, span.alias("_n"), F.explode(texts).alias("x")).select(*keys, F.col("_n").alias("span"), "x.at", "x.t")


def item_windows(items: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """Distinct windows of every item: item (its id as text), span, t.  An item of fewer words is one window."""
    rows = worded(items, text_col, F.col(id_col).cast("string").alias("item"))
    span = F.least(F.size("w"), F.lit(window))
    return windows_at(rows, ["item"], F.sequence(F.lit(0), F.size("w") - span), span).select("item", "span", "t").distinct()


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id",
                  item_text: str = "text", window: int = WINDOW, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of ``docs``: id, n_words, n_hit, spans (runs of hit words, as first word and the one after the last), n_items, items_sha256, and the
    columns in ``keep`` (``_kept`` is added to names that clash).

    A word is hit if it lies in an occurrence of a window of ``window`` consecutive words of an item; an item of fewer words is one window.  Null and empty
    texts have no words; null, empty and repeated items add nothing.  Words of items without an id are hit, but those items are not counted.  The items
    of a document are hashed as its sorted ids with commas between them.  Rows with equal texts are compared once; without
    documents there are no rows, without items no hits.

    Texts are known by a 128-bit digest of their bytes.  Fingerprints of documents, each with the words of its windows, meet the distinct fingerprints of the
    items: no pairs arise, no text is read again, and nothing of the documents is shuffled but hits while Spark can broadcast
    the fingerprints.  Which items a document holds is looked up once per distinct set of items.
    """
    windows = staged(item_windows(items, item_id, item_text, window), "windows")
    spans = sorted(r["span"] for r in windows.select("span").distinct().collect())  # at most ``window`` values
    texts = docs.select(F.col(text_col).alias("text"), F.md5(F.col(text_col).cast("binary")).alias("key"))
    of_docs = worded(texts, "text", F.col("key"))
    of_items = windows.select(F.split("t", " ").alias("w")).where(F.size("w") > 0)
    hits = None
    for span in spans:
        known = fingerprints(of_items.where(F.size("w") == span), [], span).select("span", "print").distinct()
        found = fingerprints(of_docs, ["key"], span).join(known, ["span", "print"], "left_semi").select("key", "span", "at", "t")
        hits = found if hits is None else hits.union(found)
    rows = docs.select(F.col(id_col).alias("id"), F.md5(F.col(text_col).cast("binary")).alias("key"),
                       F.size(words_of(F.coalesce(F.col(text_col), F.lit("")))).cast("long").alias("n_words"),
                       F.struct(F.lit(1).alias("_"), *keep).alias("_row"))
    names = ["id", "n_words", "n_hit", "spans", "n_items", "items_sha256"]
    kept = [F.col(f"_row.{c}").alias(kept_as(c, names)) for c in keep]
    nothing = F.sha2(F.lit("").cast("binary"), 256)
    runs_type = "array<struct<first:int,stop:int>>"
    if hits is None:
        return rows.select("id", "n_words", F.lit(0).cast("long").alias("n_hit"), F.array().cast(runs_type).alias("spans"),
                           F.lit(0).cast("long").alias("n_items"), nothing.alias("items_sha256"), *kept)
    hits = staged(hits.distinct(), "hits")
    # A hit is extended to the windows around it; each is compared with the windows of the items as a whole.
    around = hits.select("key", "span", F.col("at").alias("from"), F.split("t", " ").alias("w"))
    around = windows_at(around, ["key", "from"], F.sequence(F.lit(0), F.size("w") - F.col("span")), F.col("span")).select(
        "key", "span", (F.col("from") + F.col("at")).alias("at"), "t")
    sets = windows.groupBy("span", "t").agg(F.concat_ws(
        ":", F.count("item"), F.bit_xor(F.xxhash64("item")), F.bit_xor(F.xxhash64("item", F.lit(1)))).alias("set"))
    sets = staged(sets, "sets")
    occurring = around.join(sets, ["span", "t"])
    per_text = occurring.groupBy("key").agg(
        F.collect_set(F.struct("at", "span")).alias("windows"),
        F.array_sort(F.collect_set("set")).alias("sets"))
    hit = F.array_sort(F.array_distinct(F.flatten(F.transform("windows", lambda x: F.sequence(x["at"], x["at"] + x["span"] - 1)))))
    last = lambda i: F.coalesce(F.get("p", i + 1) != F.get("p", i) + 1, F.lit(True))
    places = F.sequence(F.lit(0), F.size("p") - 1)
    per_text = per_text.select("key", "sets", hit.alias("p")).select(
        "key", "sets", "p", F.filter(places, lambda i: (i == 0) | last(i - 1)).alias("from"), F.filter(places, last).alias("to")).select(
        "key", "sets", F.size("p").cast("long").alias("n_hit"),
        F.zip_with("from", "to", lambda a, b: F.struct(F.get("p", a).alias("first"), (F.get("p", b) + 1).alias("stop"))).alias("spans"))
    per_text = staged(per_text.withColumn("combo", F.md5(F.array_join("sets", ","))), "texts")
    combos = per_text.groupBy("combo").agg(F.any_value("sets").alias("sets")).select("combo", F.explode("sets").alias("set"))
    example = sets.groupBy("set").agg(F.min(F.struct("span", "t")).alias("x")).select("set", "x.span", "x.t")
    members = example.join(windows, ["span", "t"]).select("set", "item")
    listed = combos.join(members, "set").select("combo", "item").distinct().groupBy("combo").agg(
        F.count("item").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(F.collect_list("item")), ",").cast("binary"), 256).alias("items_sha256"))
    results = per_text.join(listed, "combo").select("key", "n_hit", "spans", "n_items", "items_sha256")
    out = rows.join(results, "key", "left")
    return out.select(
        "id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("spans", F.array().cast(runs_type)).alias("spans"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items_sha256", nothing).alias("items_sha256"), *kept)
