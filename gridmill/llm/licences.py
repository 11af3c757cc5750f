"""Licence scans with DataFrame functions only: Dice coefficient over word bigrams, candidate templates pruned by size."""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

# Licence notices and texts as they are published.
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
           "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, "
           "merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is "
           "furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be "
           "included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY "
           "KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE "
           "AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, "
           "WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR "
           "OTHER DEALINGS IN THE SOFTWARE.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the "
                  "License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by "
                  "applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
                  "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language "
                  "governing permissions and limitations under the License.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
               "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This "
               "program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
               "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "CC-BY-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided "
           "that the above copyright notice and this permission notice appear in all copies.",
    "proprietary-notice": "All rights reserved.",
}
BOUND = 0.8
SEPARATORS = "[^a-z0-9]+"


def template_bigrams(text: str) -> list[tuple[str, int]]:
    """The word bigrams of a text, each with how often it stands there."""
    words = re.sub(SEPARATORS, " ", text.lower()).split()
    return sorted(Counter(f"{a} {b}" for a, b in zip(words, words[1:])).items())


def size_bounds(n: int, bound: float) -> tuple[int, int]:
    """Bigram counts between which a text can reach the bound with a template of ``n``: at best the smaller bag lies in the larger."""
    return math.ceil(n * bound / (2 - bound) - 1e-9), math.floor(n * (2 - bound) / bound + 1e-9)


def known_bigrams(spark: SparkSession, templates: dict[str, str] | None, bound: float) -> tuple[DataFrame, list[tuple]]:
    """The templates' bigrams as hashes, one row each, and the same rows as tuples with the bigram's words."""
    bags = {name: template_bigrams(text) for name, text in (TEMPLATES if templates is None else templates).items()}
    sizes = {name: sum(n for _, n in bag) for name, bag in bags.items()}
    rows = [(name, sizes[name], *size_bounds(sizes[name], bound), x, n) for name, bag in sorted(bags.items()) for x, n in bag]
    known = spark.createDataFrame(rows, "licence string, template_size int, least int, most int, bigram string, times int").withColumn(
        "bigram", F.xxhash64(F.split_part("bigram", F.lit(" "), F.lit(1)), F.split_part("bigram", F.lit(" "), F.lit(2))))
    return known, rows


def licence_matches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None,
                    bound: float = BOUND) -> DataFrame:
    """Units of documents that match a template: id, _text (hash of the text), unit (0: the whole text, else the line number), licence, dice.

    Texts are lower-cased and cut into words of a-z and 0-9.  Bigrams count as often as they stand in a unit.  A unit is compared only with
    templates whose size admits the bound.  Template bigrams are sent to all tasks (a parameter of the operator, not data); the
    bigrams that a unit shares with a template are counted after a shuffle.  Null and empty texts match nothing; repeated rows
    match once.
    """
    known, rows = known_bigrams(docs.sparkSession, templates, bound)
    smallest, largest = min((r[2] for r in rows), default=1), max((r[3] for r in rows), default=0)
    text = F.regexp_replace(F.lower(F.col(text_col)), "[^a-z0-9\n]+", " ")
    units = docs.where(F.length(text_col) > 0).select(
        F.col(id_col).alias("id"), F.xxhash64(text_col).alias("_text"), text.alias("t")).select(
        "id", "_text", F.posexplode(F.concat(F.array(F.regexp_replace("t", "[ \n]+", " ")), F.split("t", "\n"))).alias("unit", "line"))
    # Spaces are counted before anything is cut; a bigram is the 64-bit hash of its two words.
    sized = units.select("id", "_text", "unit", F.trim("line").alias("line")).withColumn(
        "n", F.length("line") - F.length(F.replace("line", F.lit(" ")))).where(F.col("n").between(smallest, largest))
    words = sized.select("id", "_text", "unit", "n", F.split("line", " ").alias("w"))
    hashes = F.zip_with(F.slice("w", F.lit(1), F.col("n")), F.slice("w", F.lit(2), F.col("n")), lambda a, b: F.xxhash64(a, b))
    single = words.select("id", "_text", "unit", "n", F.posexplode(hashes).alias("place", "bigram"))
    shared = single.join(F.broadcast(known), "bigram").where("n BETWEEN least AND most")
    unit = ["id", "_text", "unit", "n", "licence", "template_size"]
    places = shared.groupBy(*unit, "bigram", "times", "place").agg(F.lit(1).alias("_"))  # one place of repeated rows
    counted = places.groupBy(*unit, "bigram", "times").agg(F.count(F.lit(1)).alias("here")).groupBy(*unit).agg(
        F.sum(F.least("here", "times")).alias("both"))
    return counted.withColumn("dice", 2 * F.col("both") / (F.col("n") + F.col("template_size"))).where(F.col("dice") >= bound).select(
        "id", "_text", "unit", "licence", "dice")


def licence_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None,
                 bound: float = BOUND) -> DataFrame:
    """One row per row of ``docs``: id, n_units that match a template, the best licence (ties: first by name) and its dice.

    Documents without a match, null and empty texts have n_units 0 and null for the others.
    """
    matches = licence_matches(docs, id_col, text_col, templates, bound)
    best = matches.groupBy("id", "_text").agg(
        F.countDistinct("unit").alias("n_units"),
        F.min(F.struct((-F.col("dice")).alias("d"), F.col("licence"))).alias("_best"))
    best = best.select("id", "_text", "n_units", F.col("_best.licence").alias("licence"), (-F.col("_best.d")).alias("dice"))
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("_text"))
    on = rows["id"].eqNullSafe(best["id"]) & (rows["_text"] == best["_text"])
    return rows.join(best, on, "left").select(rows["id"], F.coalesce("n_units", F.lit(0)).alias("n_units"), "licence", "dice")


def licence_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None,
                     bound: float = BOUND) -> DataFrame:
    """The best passage of a document for each template: id, _text (hash of the text), licence, dice, first (its first word, from 0), n_words.

    A passage is any run of consecutive words of the whole text, wherever its lines break; every whole text and line is one.  The best
    passage starts and ends with a bigram of the template, and one that reaches the bound holds at least ``least`` of them within
    ``most`` bigrams: only such starts are counted.  Of equally good passages the leftmost, then the shortest is named.  Null and empty
    texts match nothing; repeated rows match once.
    """
    known, rows = known_bigrams(docs.sparkSession, templates, bound)
    words = docs.where(F.length(text_col) > 0).select(
        F.col(id_col).alias("id"), F.xxhash64(text_col).alias("_text"),
        F.split(F.trim(F.regexp_replace(F.lower(F.col(text_col)), SEPARATORS, " ")), " ").alias("w"))
    n = F.size("w") - 1
    hashes = F.zip_with(F.slice("w", F.lit(1), n), F.slice("w", F.lit(2), n), lambda a, b: F.xxhash64(a, b))
    single = words.select("id", "_text", F.posexplode(hashes).alias("place", "bigram"))
    doc = ["id", "_text", "licence", "template_size", "least", "most"]
    hits = single.join(F.broadcast(known), "bigram").repartition("id", "_text", "licence").groupBy(*doc, "bigram", "times", "place").agg(
        F.lit(1).alias("_"))  # one place of repeated rows
    # A bigram counts in a passage unless its ``times`` earlier ones stand there too: ``before`` is the first of those.
    same = Window.partitionBy(*doc, "bigram", "times").orderBy("place")
    before = F.coalesce(*(F.when(F.col("times") == k, F.lag("place", k).over(same)) for k in sorted({r[5] for r in rows})), F.lit(-1))
    runs = hits.withColumn("before", before).groupBy(*doc).agg(F.array_sort(F.collect_list(F.struct("place", "before"))).alias("h")).where(
        F.size("h") >= F.col("least"))
    place = lambda i: F.element_at("h", i)["place"]

    def best_from(start):
        def longer(best, hit):
            both = best["both"] + F.when(hit["before"] < place(start), 1).otherwise(0)
            size = hit["place"] - place(start) + 1
            dice = 2 * both / (size + F.col("template_size"))
            better = dice > best["dice"]
            return F.struct(both.alias("both"), F.when(better, dice).otherwise(best["dice"]).alias("dice"),
                            F.when(better, size).otherwise(best["size"]).alias("size"))

        none = F.struct(F.lit(0).alias("both"), F.lit(0.0).alias("dice"), F.lit(0).alias("size"))
        return F.aggregate(F.slice("h", start, F.col("most")), none, longer, lambda best: F.struct(
            best["dice"].alias("dice"), (-place(start)).alias("first"), (-best["size"]).alias("size")))

    starts = F.filter(F.sequence(F.lit(1), F.size("h") - F.col("least") + 1), lambda i: place(i + F.col("least") - 1) - place(i) < F.col("most"))
    best = runs.select(*doc, "h", starts.alias("starts")).where(F.size("starts") > 0).select(
        "id", "_text", "licence", F.array_max(F.transform("starts", best_from)).alias("b"))
    return best.where(F.col("b.dice") >= bound).select(
        "id", "_text", "licence", "b.dice", (-F.col("b.first")).alias("first"), (1 - F.col("b.size")).alias("n_words"))


def licence_passage_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None,
                         bound: float = BOUND) -> DataFrame:
    """One row per row of ``docs``: id, n_licences that a passage matches, the best licence (ties: first by name) and its dice.

    Documents without a match, null and empty texts have n_licences 0 and null for the others.
    """
    best = licence_passages(docs, id_col, text_col, templates, bound).groupBy("id", "_text").agg(
        F.count(F.lit(1)).alias("n_licences"), F.min(F.struct((-F.col("dice")).alias("d"), F.col("licence"))).alias("_best"))
    best = best.select("id", "_text", "n_licences", F.col("_best.licence").alias("licence"), (-F.col("_best.d")).alias("dice"))
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("_text"))
    on = rows["id"].eqNullSafe(best["id"]) & (rows["_text"] == best["_text"])
    return rows.join(best, on, "left").select(rows["id"], F.coalesce("n_licences", F.lit(0)).alias("n_licences"), "licence", "dice")
