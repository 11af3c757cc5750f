"""SimHash near-duplicates: fingerprints of word shingles, searched in shards of BK-trees."""

from __future__ import annotations

import math
from functools import reduce
from itertools import islice, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from gridmill.llm.common import frugal, staged, text_slices
from gridmill.llm.graph import components, join_roots

TREE = 256            # fingerprints of a shard tree, on average
MOST = 20_000         # larger shards are cut again
SHARD_ROWS = 400_000  # fingerprints indexed at once in a task
FRONTIER = 2_000_000  # (query, node) pairs compared at once


def fingerprint(text: bytes | None, words: int = 3, seed: int = 42) -> int:
    """Majority bits of the XXH64 of all word shingles of a lower-cased text, as an unsigned number."""
    tokens = (text or b"").lower().split()  # bytes: only A-Z and the six ASCII white spaces count
    if not tokens:
        return 0
    if len(tokens) < words:
        shingles = iter([b" ".join(tokens)])
        n = 1
    else:
        shingles = map(b" ".join, zip(*(tokens[i:] for i in range(words))))
        n = len(tokens) - words + 1
    counts = np.zeros(64, np.int64)
    for _ in range(0, n, 50_000):
        digests = b"".join(map(xxhash.xxh64_digest, islice(shingles, 50_000), repeat(seed)))
        counts += np.unpackbits(np.frombuffer(digests, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, seed: int = 42) -> DataFrame:
    """One row per row of ``docs``: id, text_hash and fp (the 64 bits as a signed long).  Null, empty and blank texts have fingerprint 0."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_hash"))

    def run(batches):
        for batch in text_slices(batches, "text"):
            texts = batch.column("text").cast(pa.large_binary()).to_pylist()
            found = np.array([fingerprint(t, words, seed) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("text_hash"), pa.array(found)], ["id", "text_hash", "fp"])

    return rows.mapInArrow(frugal(run), f"id {rows.schema['id'].dataType.simpleString()}, text_hash long, fp long")


class Forest:
    """BK-trees, one per group: children hang on an edge that carries their Hamming distance to the parent.

    All trees grow level by level at once: the values below a node are sorted by their distance to it, the first of each distance becomes
    its child on that edge and takes the others below it.
    """

    def __init__(self, values: np.ndarray, groups: np.ndarray):
        self.values = values
        parent = np.full(len(values), -1, np.int64)
        edge = np.zeros(len(values), np.int64)
        rest = np.arange(len(values))
        above, apart = groups, np.zeros(len(values), np.int64)
        top = True
        while len(rest):
            key = above * 65 + apart
            order = np.argsort(key, kind="stable")
            rest, above, apart, key = rest[order], above[order], apart[order], key[order]
            first = np.append(True, key[1:] != key[:-1])
            node = rest[first][np.cumsum(first) - 1]
            if top:
                self.roots = dict(zip(above[first].tolist(), rest[first].tolist()))
            else:
                parent[rest[first]], edge[rest[first]] = above[first], apart[first]
            rest, above, top = rest[~first], node[~first], False
            apart = np.bitwise_count(values[rest] ^ values[above]).astype(np.int64)
        children = np.flatnonzero(parent >= 0)
        key = parent[children] * 65 + edge[children]
        order = np.argsort(key, kind="stable")
        self.children, self.keys = children[order], key[order]

    def search(self, queries: np.ndarray, roots: np.ndarray, radius: int):
        """Yield (query number, node) arrays of values within the radius of the query, from its group's root down."""
        stack = [(np.arange(len(queries)), roots)]
        while stack:
            q, node = stack.pop()
            if len(q) > FRONTIER:
                half = len(q) // 2
                stack += [(q[:half], node[:half]), (q[half:], node[half:])]
                continue
            apart = np.bitwise_count(queries[q] ^ self.values[node]).astype(np.int64)
            hit = apart <= radius
            if hit.any():
                yield q[hit], node[hit]
            lo = np.searchsorted(self.keys, node * 65 + np.maximum(apart - radius, 0))
            hi = np.searchsorted(self.keys, node * 65 + np.minimum(apart + radius, 64), side="right")
            n = hi - lo
            if n.sum():
                at = np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
                stack.append((np.repeat(q, n), self.children[at]))


def shard_links(keys: np.ndarray, values: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links (value, smaller place's value) among values of equal keys within the radius; both sorted by key."""
    change = np.append(True, keys[1:] != keys[:-1])
    group = np.cumsum(change) - 1
    shared = np.bincount(group)[group] > 1
    values, group = values[shared], group[shared]
    if not len(values):
        return values, values
    forest = Forest(values, group)
    roots = np.array([forest.roots[g] for g in group.tolist()], np.int64)
    labels = np.arange(len(values))
    for q, node in forest.search(values, roots, radius):
        labels = join_roots(labels, q, node)
    while not np.array_equal(up := labels[labels], labels):
        labels = up
    tied = labels != np.arange(len(values))
    return values[tied], values[labels[tied]]


def _bits(c: Column, lo: int, hi: int) -> Column:
    """Bits lo to hi (without hi), counted from the lowest, as a number."""
    return c if hi - lo >= 64 else F.shiftrightunsigned(c, lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1))


def _without(c: Column, lo: int, hi: int) -> Column:
    """What is left of a number when bits lo to hi are taken out and those above move down."""
    low = c.bitwiseAND(F.lit((1 << lo) - 1))
    return low if hi >= 64 else F.shiftleft(F.shiftrightunsigned(c, hi), lo).bitwiseOR(low)


def routed(rows: DataFrame, width: int, radius: int, used: int) -> tuple[DataFrame, int]:
    """Rows ``fp, path, rest`` by the shard trees that they belong to: ``fp, key, path, rest``, and the bits left in ``rest``.

    The ``width`` bits of ``rest`` are cut into radius + 1 blocks: two values within the radius agree on a whole block, so that they meet
    where rows go by block.  ``key`` looks at ``used`` bits of the block and names the tree; ``path`` looks at all of them, and ``rest``
    has the other blocks, for shards that have to be cut once more.
    """
    parts = radius + 1
    bounds = [width * i // parts for i in range(parts + 1)]
    ways = [F.struct(
        F.xxhash64("path", F.lit(i), _bits(F.col("rest"), lo, min(hi, lo + used))).alias("key"),
        F.xxhash64("path", F.lit(i), _bits(F.col("rest"), lo, hi)).alias("path"),
        _without(F.col("rest"), lo, hi).alias("rest")) for i, (lo, hi) in enumerate(zip(bounds, bounds[1:]))]
    return rows.select("fp", F.inline(F.array(*ways))), width - width // parts


def fingerprint_links(distinct: DataFrame, radius: int, tree: int = TREE, most: int = MOST) -> DataFrame:
    """Links ``a``, ``b`` that connect all fingerprints (column ``fp``, distinct) within the radius of each other, not all pairs.

    A shard is the fingerprints that agree on some bits of one block, as many bits as give shards of about ``tree`` fingerprints; its BK-tree
    finds those within the radius.  Shards of more than ``most`` are cut again by blocks of the bits that are left, at most twice: then
    radius 2 leaves 20 bits, which bound a shard.
    """
    rows, width = distinct.select("fp", F.lit(0).cast("long").alias("path"), F.col("fp").alias("rest")), 64
    rows, width = routed(rows, width, radius, max(0, math.ceil(math.log2(max(1, distinct.count()) / tree))))
    links = []
    for _ in range(2):
        large = staged(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select("key"), "large")
        if width < 1 or large.isEmpty():
            break
        links.append(tree_links(rows.join(large, "key", "left_anti"), radius))
        rows, width = routed(rows.join(large, "key", "left_semi"), width, radius, 64)
    return reduce(DataFrame.unionByName, [*links, tree_links(rows, radius)])


def tree_links(rows: DataFrame, radius: int) -> DataFrame:
    """Links among the fingerprints of every ``key``, whose rows meet in one task."""
    sharded = rows.select("fp", "key").repartition("key").sortWithinPartitions("key")

    def run(batches):
        held: list[pa.RecordBatch] = []

        def links(rows: pa.Table):
            a, b = shard_links(rows["key"].to_numpy(), rows["fp"].to_numpy().view(np.uint64), radius)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        count = 0
        for batch in batches:
            held.append(batch)
            count += batch.num_rows
            if count >= SHARD_ROWS:
                rows = pa.Table.from_batches(held)
                keys = rows["key"].to_numpy()
                whole = int(np.searchsorted(keys, keys[-1]))  # the last key may go on in the next batch
                if whole:
                    yield links(rows.slice(0, whole))
                    held = rows.slice(whole).to_batches()
                    count -= whole
        if count:
            yield links(pa.Table.from_batches(held))

    return sharded.mapInArrow(frugal(run), "a long, b long")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, radius: int = 2,
                   seed: int = 42) -> DataFrame:
    """Group documents whose fingerprints link, directly or through others, at ``radius`` differing bits or fewer.

    Equal fingerprints are one node.  Nodes are routed to shard trees by bits of each of their blocks, so that any two within the radius
    meet in one shard and no tree needs to be sent to all tasks; a shard's BK-tree follows only edges within the radius and
    returns links that span its groups.

    Returns one row per row of ``docs``: id, text_hash, fp (signed long), component (smallest id of the group) and root (a fingerprint that
    names the group).  Null and blank texts share
    fingerprint 0.  Rows with a null id get the component of their group, null if no row of it has an id; repeated rows repeat.
    """
    rows = staged(fingerprints(docs, id_col, text_col, words, seed), "fingerprints")
    nodes = staged(rows.groupBy("fp").agg(F.min("id").alias("first")), "nodes")
    roots = components(fingerprint_links(nodes, radius))
    placed = staged(nodes.join(roots, nodes["fp"] == roots["node"], "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root")), "placed")
    least = placed.groupBy("root").agg(F.min("first").alias("component"))
    named = staged(placed.join(least, "root").select("fp", "root", "component"), "named")
    return rows.join(named, "fp").select("id", "text_hash", "fp", "component", "root")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, radius: int = 2) -> DataFrame:
    """The rows of ``docs``, with all columns, that stand for their group: the smallest id (then text) of each; ids before null ids."""
    groups = simhash_groups(docs, id_col, text_col, words, radius)
    key = F.struct(F.col("id").isNull().alias("n"), "id", "text_hash")
    first = groups.groupBy("root").agg(F.min(key).alias("k")).select(F.col("k.id").alias("_first_id"), F.col("k.text_hash").alias("_first_text"))
    # keys without nulls, so that the join and the removal of repeated rows share one shuffle
    keyed = lambda df, i, text: df.withColumns({
        "_key_id": F.coalesce(F.col(i), F.lit(0)), "_key_null": F.col(i).isNull(), "_key_text": text})
    keys = ["_key_id", "_key_null", "_key_text"]
    winners = keyed(first, "_first_id", F.col("_first_text")).select(*keys)
    kept = keyed(docs, id_col, F.xxhash64(text_col)).join(winners, keys, "left_semi").dropDuplicates(keys)
    return kept.select(*(F.col(f"`{c}`") for c in docs.columns))
