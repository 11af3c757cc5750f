"""Vectors and archives against brute force, and on awkward tables."""

import base64
import hashlib
import io
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from gridmill.llm import graph, pq, warc
from gridmill.llm.queries import table
from gridmill.session import scratch_path


def brute_force_links(rows, bound):
    unit = {}
    for k, (i, v, label) in enumerate(rows):
        good = i is not None and label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)
        unit[k] = np.array(v, float) / np.linalg.norm(np.array(v, float)) if good else None
    links, up = [0] * len(rows), {i: i for i, _, _ in rows}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in range(len(rows)):
        for b in range(a):
            if unit[a] is not None and unit[b] is not None and rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]) \
                    and unit[a] @ unit[b] >= bound:
                links[a] += 1
                links[b] += 1
                x, y = root(rows[a][0]), root(rows[b][0])
                up[max(x, y)] = min(x, y)
    return sorted(((i, n, root(i) if i is not None else None) for (i, _, _), n in zip(rows, links)), key=str)


def test_links_by_brute_force(spark):
    rng = np.random.default_rng(0)
    rows = []
    for c in range(30):
        centre = rng.normal(size=16)
        for k in range(rng.integers(1, 9)):
            v = (centre + rng.normal(size=16) * rng.choice([0.02, 0.1, 0.2])) * rng.choice([1.0, 3.0])
            rows.append((len(rows), [float(x) for x in np.float32(v)], int(c % 3)))
    rows += [(len(rows) + k, rows[0][1], rows[0][2]) for k in range(5)]  # equal vectors
    n = len(rows)
    rows += [(n, None, 1), (n + 1, [0.0] * 16, 1), (n + 2, [], 1), (n + 3, [float("nan")] * 16, 1), (n + 4, [float("inf")] + [1.0] * 15, 1),
             (n + 5, rows[0][1], None), (n + 6, [None] * 16, 1), (n + 7, rows[0][1][:8], rows[0][2]), (None, rows[0][1], rows[0][2])]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "vec_id long, embedding array<float>, label int, node string, weight int")
    got = pq.near_vectors(df, list_rows=8).collect()
    assert sorted(((r["id"], r["n_links"], r["component"]) for r in got), key=str) == brute_force_links(rows, 0.98)
    assert all(r["kept"] == (r["id"] is not None and r["id"] == r["component"]) for r in got)


def test_tiles_part_a_large_list(spark, monkeypatch):
    monkeypatch.setattr(pq, "TILE_ROWS", 7)
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in np.float32(np.ones(8) + rng.normal(size=8) * 0.12)], 1) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = pq.near_vectors(df).collect()
    assert sorted(((r["id"], r["n_links"], r["component"]) for r in got), key=str) == brute_force_links(rows, 0.98)


def test_links_across_the_tiles_of_many_lists(spark, monkeypatch):
    monkeypatch.setattr(pq, "TILE_ROWS", 7)
    rng = np.random.default_rng(5)
    base = rng.normal(size=(12, 6))
    rows = [(i % 230, [float(x) for x in np.float32(base[i % 12] + rng.normal(size=6) * 0.25)], i % 2) for i in range(260)]  # 30 ids stand twice
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    unit = pq.unit_rows(np.array([v for _, v, _ in rows], np.float32))
    ids, labels = np.array([i for i, _, _ in rows]), np.array([x for _, _, x in rows])
    near = (unit @ unit.T >= 0.98) & (labels[:, None] == labels) & (ids[:, None] != ids)
    links = {i: int(near[ids == i].sum()) for i in range(230)}  # an id's rows share their links
    component = {i: c for i, _, c in brute_force_links(rows, 0.98)}
    for list_rows in (200, 13):
        got = pq.near_vectors(df, list_rows=list_rows).collect()
        assert sorted((r["id"], r["n_links"], r["component"]) for r in got) == sorted((i, links[i], component[i]) for i, _, _ in rows)


def test_lists_are_probed_in_proportion(spark, monkeypatch):
    routed, staged = [], pq.staged

    def watched(df, label):
        out = staged(df, label)
        if label == "routed":
            routed.append(out.count())
        return out

    monkeypatch.setattr(pq, "staged", watched)
    rng = np.random.default_rng(3)
    points = rng.normal(size=(1000, 64))
    points = np.float32(np.concatenate((points, points + rng.normal(size=points.shape) * 0.14, points + rng.normal(size=points.shape) * 0.14)))
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(points)], "vec_id long, embedding array<float>, label int")
    got = {r["id"]: r["n_links"] for r in pq.near_vectors(df, list_rows=75).collect()}  # 40 lists
    unit = pq.unit_rows(points)
    assert got == dict(enumerate(((unit @ unit.T >= 0.98).sum(1) - 1).tolist())) and sum(got.values()) > 1000
    assert routed[0] <= 6 * len(points)  # 10 and more for every vector when all lists within the radius are probed


def test_embeddings_of_the_tables(spark):
    rows = [tuple(r) for r in table(spark, "/root/testdata/sf0.001", "embeddings").select("vec_id", "embedding", "label").collect()]
    got = pq.near_vectors(table(spark, "/root/testdata/sf0.001", "embeddings")).collect()
    assert sorted(((r["id"], r["n_links"], r["component"]) for r in got), key=str) == brute_force_links(rows, 0.98)


def test_no_vectors(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert pq.near_vectors(empty).count() == 0
    assert [tuple(r) for r in pq.near_vectors(spark.createDataFrame([(1, None, None)], empty.schema)).collect()] == [(1, 0, 1, True)]


def test_components_of_chains_and_stars(spark):
    draw = random.Random(0)
    chain = [(i, i + 1) for i in range(200)]
    star = [(1000, 1000 + i) for i in range(1, 80)]
    links = chain + [(b, a) for a, b in star] + [(5, 5), (300, 301), (300, 301)]
    draw.shuffle(links)
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(201)}, **{1000 + i: 1000 for i in range(80)}, 300: 300, 301: 300} or got == {
        **{i: 0 for i in range(1, 201)}, **{1000 + i: 1000 for i in range(1, 80)}, 301: 300}


# ---- archives ----

def page_rows():
    draw = random.Random(1)
    body = "".join(draw.choice("<p>abcé </p>") for _ in range(3000))
    return [(5, "http://a/", body), (2, "http://b/", body), (9, None, None), (3, "http://c/\nX-Evil: 1", ""), (7, "http://d/", "日本\r\n\r\nWARC/1.1"),
            (2, "http://b/", body), (None, "http://e/", "only here"), (11, "http://f/", "x" * 400_000), (12, "http://g/", "\x1f\x8b\x08 magic")]


def pages_frame(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, payload string")


def test_round_trip(spark):
    rows = page_rows()
    got = warc.archive_round_trip(spark, pages_frame(spark, rows).repartition(3)).collect()
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    want = []
    for i, _, h in rows:
        raw = (h or "").encode()
        again = first.get(h or "") is not None and first[h or ""] != i
        want.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if again else "response",
                     first[h or ""] if again else None))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_every_split_size_finds_every_record_once(spark):
    marked = warc.mark_revisits(pages_frame(spark, page_rows()))
    files = warc.write_archives(marked.coalesce(1), scratch_path(spark, "splits"))
    whole = sorted(map(str, warc.read_archives(files).collect()))
    assert len(whole) == len(page_rows())
    for size in (64, 1000, 5000):
        assert sorted(map(str, warc.read_archives(files, split_bytes=size).collect())) == whole


def test_false_magic_is_no_record():
    class Source(io.BytesIO):
        def read_at(self, n, at):
            self.seek(at)
            return self.read(n)

    member = warc._member("response", [("WARC-Record-ID", "<urn:x-page:1>")], b"HTTP/1.1 200 OK\r\n\r\nhello", 6)
    other = zlib.compressobj(6, zlib.DEFLATED, 31)
    other = other.compress(b"some other gzip member") + other.flush()
    broken = member[:-8] + b"\0" * 8
    data = b"junk\x1f\x8b\x08junk" + other + broken + member + b"\x1f\x8b" + member[:30]
    found = list(warc.records_in(Source(data), len(data), 0, len(data)))
    assert [(r["record_id"], r["payload"]) for r in found] == [("urn:x-page:1", b"hello")]


def test_small_payloads_may_stay_responses(spark):
    rows = [(1, "u", "same"), (2, "u", "same"), (3, "u", "longer text"), (4, "u", "longer text")]
    got = {r["page_id"]: r["record_type"] for r in warc.archive_round_trip(spark, pages_frame(spark, rows), min_bytes=5).collect()}
    assert got == {1: "response", 2: "response", 3: "response", 4: "revisit"}
    assert warc.archive_round_trip(spark, pages_frame(spark, []).where(F.lit(False))).count() == 0
