"""Near-duplicate vectors by product quantisation: inverted lists, residual codes, table lookups, exact rerank."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gridmill.llm.common import staged
from gridmill.llm.graph import components, join_roots

SAMPLE_ROWS = 8_192     # vectors that the quantisers are fitted on; every vector is indexed
LIST_ROWS = 256         # vectors of a class that a list should hold, on average
MAX_LISTS = 4_096
TILE_ROWS = 2_048       # queries and list members compared in one task at once
QUERY_ROWS = 256        # queries whose tables are looked up together
SUBSPACES, CODES = 8, 256
SLACK = 1e-6            # rounding allowed for in the bounds


def kmeans(points: np.ndarray, k: int, rounds: int, seed: int = 7) -> np.ndarray:
    """Lloyd's centroids; empty ones keep their place."""
    start = np.random.default_rng(seed).permutation(len(points))[:k]
    centres = points[np.sort(start)].copy()
    for _ in range(rounds):
        near = nearest(points, centres)
        n = np.bincount(near, minlength=len(centres))
        sums = np.stack([np.bincount(near, points[:, j], len(centres)) for j in range(points.shape[1])], axis=1)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


def squared(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum((points ** 2).sum(1)[:, None] - 2 * points @ centres.T + (centres ** 2).sum(1), 0)


def nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.concatenate([squared(p, centres).argmin(1) for p in np.array_split(points, len(points) // 4096 + 1)])


@dataclass
class Quantiser:
    """Coarse centroids, and for every subspace the codebook of residuals."""
    coarse: np.ndarray
    books: list[np.ndarray]

    @classmethod
    def fit(cls, unit: np.ndarray, lists: int) -> Quantiser:
        coarse = kmeans(unit, min(lists, len(unit)), 8)
        rest = unit - coarse[nearest(unit, coarse)]
        return cls(coarse, [kmeans(np.ascontiguousarray(part), min(CODES, len(unit)), 6)
                            for part in np.array_split(rest, min(SUBSPACES, unit.shape[1]), axis=1)])

    def parts(self, rest: np.ndarray) -> list[np.ndarray]:
        return np.array_split(rest, len(self.books), axis=1)

    def encode(self, unit: np.ndarray, lists: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the residuals, and how far each vector lies from its code."""
        rest = unit - self.coarse[lists]
        codes = np.stack([nearest(p, b) for p, b in zip(self.parts(rest), self.books)], axis=1).astype(np.uint8)
        off = sum(((p - b[c]) ** 2).sum(1) for p, b, c in zip(self.parts(rest), self.books, codes.T))
        return codes, np.sqrt(off)

    def close(self, rest: np.ndarray, codes: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, member) pairs whose asymmetric squared distance is within the member's limit.

        One table per query and subspace, looked up by the members' codes; the later half only for pairs that the first leaves open.
        """
        looked = [(squared(p, b), c) for p, b, c in zip(self.parts(rest), self.books, codes.T)]
        first = (len(looked) + 1) // 2
        far = sum(table[:, c] for table, c in looked[:first])
        q, m = np.nonzero(far <= limit)
        far = far[q, m]
        for table, c in looked[first:]:
            far += table[q, c[m]]
            open_ = far <= limit[m]
            q, m, far = q[open_], m[open_], far[open_]
        return q, m

    def probes(self, far: np.ndarray, own: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
        """(vector, other list) pairs that suffice for one of any two vectors within the radius to meet the other in its list.

        ``far`` holds squared distances to the centroids.  Vectors of two lists lie on either side of the plane half-way between the two
        centroids, and together no farther from it than from each other: one of them has the plane within half the radius, and only that
        one has to be sent across.
        """
        beyond = far - far[np.arange(len(own)), own][:, None]
        size = np.sqrt((self.coarse ** 2).sum(1))
        row, cell = np.nonzero(beyond <= radius * (size[own][:, None] + size) + SLACK)  # no gap exceeds the sum of the sizes
        keep = cell != own[row]
        for lo in range(0, len(row), 1 << 16):
            part = slice(lo, lo + (1 << 16))
            gap = np.sqrt(((self.coarse[own[row[part]]] - self.coarse[cell[part]]) ** 2).sum(1))
            keep[part] &= beyond[row[part], cell[part]] <= radius * gap + SLACK
        return row[keep], cell[keep]


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    wide = vectors.astype(np.float64)
    wide /= np.abs(wide).max(1, keepdims=True)
    return wide / np.sqrt((wide ** 2).sum(1, keepdims=True))


def as_matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten()
    return flat.to_numpy(zero_copy_only=False).reshape(len(column), -1)


@dataclass
class Side:
    """Queries or members of a tile; members have codes, and the lists they are sent to (places and numbers)."""
    ids: np.ndarray
    unit: np.ndarray
    weight: np.ndarray
    home: np.ndarray
    codes: np.ndarray | None = None
    off: np.ndarray | None = None
    sent: tuple[np.ndarray, np.ndarray] | None = None

    @classmethod
    def of(cls, table: pa.Table, member: bool) -> Side:
        side = cls(table["node"].to_numpy(), unit_rows(as_matrix(table["vector"].combine_chunks())), table["weight"].to_numpy(), table["home"].to_numpy())
        if member:
            side.codes = np.frombuffer(b"".join(table["codes"].to_pylist()), np.uint8).reshape(len(table), -1)
            side.off = table["off"].to_numpy()
            lists = table["probes"].combine_chunks()
            side.sent = (np.repeat(np.arange(len(table)), lists.value_lengths().to_numpy()), lists.flatten().to_numpy())
        return side


def tile_links(queries: Side | None, members: Side, quantiser: Quantiser, centre: int, bound: float, inside: bool):
    """Links of a tile, those among its members too when ``inside``: for each node the vectors it links (copies counted), and
    for every linked node a node that spans its group.

    Each link counts for both of its ends.  Two vectors that are sent to each other's lists meet twice; the list with the smaller number counts.
    """
    limit = (math.sqrt(max(0.0, 2 - 2 * bound)) + members.off + SLACK) ** 2
    lists, (place, other) = len(quantiser.coarse), members.sent
    counted = (place * lists + other)[other < centre]
    sides = ([queries] if queries else []) + ([members] if inside else [])
    ids = np.unique(np.concatenate([members.ids] + [s.ids for s in sides]))
    roots, total, linked = np.arange(len(ids)), np.zeros(len(ids), np.int64), np.zeros(len(ids), bool)
    at_m = np.searchsorted(ids, members.ids)
    for side in sides:
        at_q = np.searchsorted(ids, side.ids)
        for lo in range(0, len(side.ids), QUERY_ROWS):
            skip = lo if side is members else 0  # pairs of members are compared once
            q, m = quantiser.close(side.unit[lo:lo + QUERY_ROWS] - quantiser.coarse[centre], members.codes[skip:], limit[skip:])
            q, m = q + lo, m + skip
            keep = side.ids[q] != members.ids[m]
            keep &= q < m if side is members else ~np.isin(m * lists + side.home[q], counted)
            q, m = q[keep], m[keep]
            keep = np.empty(len(q), bool)
            for low in range(0, len(q), 1 << 17):  # exact cosine of the candidates, in double precision
                part = slice(low, low + (1 << 17))
                keep[part] = np.einsum("ij,ij->i", side.unit[q[part]], members.unit[m[part]]) >= bound
            q, m = q[keep], m[keep]
            total += np.bincount(at_q[q], members.weight[m], len(ids)).astype(np.int64)
            total += np.bincount(at_m[m], side.weight[q], len(ids)).astype(np.int64)
            linked[at_q[q]] = linked[at_m[m]] = True
            roots = join_roots(roots, at_q[q], at_m[m])
    return ids[linked], total[linked], ids[roots[linked]]


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
                 bound: float = 0.98, list_rows: int = LIST_ROWS) -> DataFrame:
    """Links between vectors of one label with cosine ``bound`` or more: id, n_links, component (smallest id reachable), kept.

    Equal vectors of a label are one node with a weight.  A node stands in the inverted list of its nearest centroid, with the residual's
    subspace codes and their exact error; as a query it goes to every list whose border lies within half the radius.  Of two vectors
    within the radius at least one goes to the other's list, so no link is missed; one that is met twice counts once, for both ends.
    There the table distances, less the members' errors, bound the true distances from below; what is left is compared
    exactly.  Lists are cut into tiles of members and queries, so a label, list or group of near copies of any size is spread over
    tasks; a tile returns counts and spanning links, never all pairs.

    One row per row of ``vectors``.  Vectors that are null, empty or zero, or hold null or non-finite components, and those with a null label,
    have n_links 0 and are their own component.  Vectors of unequal length never link.  A null id has a null component and
    is not kept; rows that share an id are one node where their vectors are equal, and else are linked by it.
    """
    spark = vectors.sparkSession
    raw = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.coalesce(F.col("id").isNotNull() & F.col("label").isNotNull() & finite & F.exists("vector", lambda x: x != 0), F.lit(False))
    rows = staged(raw.withColumn("usable", usable).withColumn("_hash", F.xxhash64("label", "vector")), "vectors")
    alone = rows.where("NOT usable").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"))
    good = rows.where("usable")
    nodes = staged(good.groupBy("_hash", "label", "vector").agg(F.min("id").alias("node"), F.count(F.lit(1)).alias("weight"))
                   .withColumn("dim", F.size("vector")), "nodes")
    found = None
    for dim, n in sorted(tuple(r) for r in nodes.groupBy("dim").count().collect()):
        part = _links(spark, nodes.where(F.col("dim") == dim), n, bound, list_rows)
        found = part if found is None else found.union(part)
    if found is None:
        return alone.withColumn("kept", F.col("id").isNotNull())
    found = staged(found, "tiles")
    roots = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    others = found.groupBy("node").agg(F.sum("links").alias("links"))
    named = staged(nodes.join(others, "node", "left").join(roots, "node", "left").select(
        "_hash", "label", "vector", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
        F.coalesce("root", "node").alias("component")), "named")
    placed = good.join(named, ["_hash", "label", "vector"]).select("id", "n_links", "component")
    return placed.union(alone).withColumn("kept", F.coalesce(F.col("id") == F.col("component"), F.lit(False)))


def _links(spark, nodes: DataFrame, n: int, bound: float, list_rows: int) -> DataFrame:
    """Columns node, links, root of all tiles for nodes of one vector length."""
    sample = nodes.select("vector", F.xxhash64("node").alias("_o"), "node").orderBy("_o", "node").limit(SAMPLE_ROWS).select("vector").collect()
    unit = unit_rows(np.array([r[0] for r in sample], np.float64))
    labels = nodes.select("label").distinct().count()
    lists = max(1, min(MAX_LISTS, n // (max(1, labels) * list_rows), len(unit)))
    shared = spark.sparkContext.broadcast(Quantiser.fit(unit, lists))  # at most MAX_LISTS centroids and the codebooks
    radius = math.sqrt(max(0.0, 2 - 2 * bound))
    kind = nodes.schema["label"].dataType.simpleString()
    values = nodes.schema["vector"].dataType.simpleString()
    id_kind = nodes.schema["node"].dataType.simpleString()

    def route(batches):
        quantiser = shared.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                unit = unit_rows(as_matrix(part.column("vector")))
                far = squared(unit, quantiser.coarse)
                own = far.argmin(1)
                codes, off = quantiser.encode(unit, own)
                row, cell = quantiser.probes(far, own, radius)
                here = np.arange(len(own))
                at = pa.array(np.concatenate((here, row)))
                member = np.concatenate((np.ones(len(own), bool), np.zeros(len(row), bool)))
                packed = pa.array([c.tobytes() for c in codes] + [None] * len(row), pa.binary())
                cuts = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=len(own)))))
                sent = pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(cell.astype(np.int32)))
                yield pa.RecordBatch.from_arrays(
                    [part.column("label").take(at), pa.array(np.concatenate((own, cell)).astype(np.int32)), pa.array(member),
                     part.column("node").take(at), part.column("weight").take(at), part.column("vector").take(at), packed,
                     pa.array(np.concatenate((off, np.zeros(len(row))))), pa.array(np.concatenate((own, own[row])).astype(np.int32)),
                     pa.concat_arrays([sent, pa.nulls(len(row), sent.type)])],
                    columns)

    columns = ["label", "cell", "member", "node", "weight", "vector", "codes", "off", "home", "probes"]
    routed = staged(nodes.select("label", "node", "weight", "vector").mapInArrow(
        route, f"label {kind}, cell int, member boolean, node {id_kind}, weight long, vector {values}, codes binary, off double, "
               "home int, probes array<int>"), "routed")
    tiles = lambda n: F.ceil(n / F.lit(TILE_ROWS)).cast("int")
    n_members, n_queries = F.count(F.when(F.col("member"), 1)), F.count(F.when(~F.col("member"), 1))
    # Members of a list in several tiles are queries of its other tiles.
    own_queries = F.when(n_members > TILE_ROWS, n_members).otherwise(0)
    sizes = staged(routed.groupBy("label", "cell").agg(
        tiles(n_members).alias("members"), tiles(n_queries + own_queries).alias("queries")), "sizes")
    slot = lambda n: F.pmod(F.xxhash64("node"), F.greatest(n, F.lit(1))).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1))
    spread = routed.join(sizes, ["label", "cell"])
    as_member = spread.where("member").select(*columns, slot(F.col("members")).alias("i"), every(F.col("queries")).alias("j"))
    # Members and queries are dealt by different hashes, else the queries from a tile of members would share a tile.
    query_slot = F.pmod(F.xxhash64("node", F.lit("query")), F.greatest("queries", F.lit(1))).cast("int")
    as_query = spread.where("NOT member").select(*columns, query_slot.alias("j"), every(F.col("members")).alias("i"))
    within = spread.where("member AND members > 1").withColumn("own", slot(F.col("members"))).where("own > 0")
    within = within.withColumn("member", F.lit(False)).select(*columns, query_slot.alias("j"), every(F.col("own")).alias("i"))

    def compare(table: pa.Table) -> pa.Table:
        member = table["member"].to_numpy()
        m, q = table.filter(pa.array(member)), table.filter(pa.array(~member))
        inside = table["j"][0].as_py() == 0
        if not len(m) or not (len(q) or inside):
            return schema.empty_table()
        node, links, root = tile_links(Side.of(q, False) if len(q) else None, Side.of(m, True), shared.value, table["cell"][0].as_py(), bound, inside)
        return pa.table({"node": node, "links": links, "root": root}).cast(schema)

    id_type = {"bigint": pa.int64(), "int": pa.int32()}[id_kind]
    schema = pa.schema([("node", id_type), ("links", pa.int64()), ("root", id_type)])
    both = as_member.unionByName(as_query).unionByName(within)
    return both.groupBy("label", "cell", "i", "j").applyInArrow(compare, f"node {id_kind}, links long, root {id_kind}")
