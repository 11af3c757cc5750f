"""Connected components of a table of links."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from gridmill.llm.common import staged


def join_roots(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Merge the trees of linked places; ``labels`` points from each place to a smaller one of its tree, roots to themselves."""
    while True:
        while not np.array_equal(up := labels[labels], labels):
            labels = up
        ra, rb = labels[a], labels[b]
        open_ = ra != rb
        if not open_.any():
            return labels
        a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
        np.minimum.at(labels, np.maximum(ra, rb), np.minimum(ra, rb))


def components(links: DataFrame) -> DataFrame:
    """Columns ``a``, ``b`` (bigint) to ``node``, ``root``: the smallest node reachable, for every node with a link to another.

    Alternating star contraction: every node's larger neighbours, then its smaller ones, are linked to the smallest neighbour, until
    the links are stars around the smallest nodes.  Minima are aggregated before they are joined back, and are written first, so
    that a node with very many links can be split by the join.  Every round is written to the shared folder.
    """
    links = staged(links.where(F.col("a") != F.col("b")).select(
        F.greatest("a", "b").alias("x"), F.least("a", "b").alias("y")).distinct(), "links")

    def state(df: DataFrame):
        return tuple(df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("x", "y"))).first())

    before = state(links)
    while True:
        both = links.select(F.col("x").alias("u"), F.col("y").alias("v")).union(links.select("y", "x"))
        least = staged(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "star")
        large = staged(both.join(least, "u").where("v > u").select(F.col("v").alias("x"), F.col("m").alias("y")).distinct(), "large")
        least = staged(large.groupBy("x").agg(F.min("y").alias("m")), "star")
        inner = large.join(least, "x").where("y != m").select(F.col("y").alias("x"), F.col("m").alias("y"))
        links = staged(inner.union(least.select("x", "m")).distinct(), "links")
        now = state(links)
        if now == before:
            return links.select(F.col("x").alias("node"), F.col("y").alias("root"))
        before = now
