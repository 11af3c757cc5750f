"""Rate windows and quotas of keys that hold most rows, in runs of few rows."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from gridmill.operators import ordered, relations


@pytest.mark.parametrize("chunk", [3, 40])
def test_moments_longer_than_runs(spark, chunk):
    rng = random.Random(3)
    data = [(i, rng.choice(["hot", "hot", None]), rng.choice([0, 5, 10, 12, 15, 20]) * 1_000_000) for i in range(200)] + [(900, "hot", None), (901, "x", None)]
    df = spark.createDataFrame(data, "n long, k string, t long")
    got = {r["n"]: r["current_count"] for r in ordered.rate_window(df, "k", "t", 10, 3, chunk).collect()}
    assert got == {n: 0 if t is None else sum(1 for _, k2, t2 in data if k2 == k and t2 is not None and t - 10_000_000 < t2 < t)
                   for n, k, t in data}


def test_runs_of_a_hot_key_are_bounded(spark):
    df = spark.range(20_000).select(F.when(F.col("id") % 3 > 0, "hot").otherwise(F.col("id").cast("string")).alias("k"), (F.col("id") % 7).alias("t"))
    sizes = ordered.sorted_runs(df, ["k"], ["t"], 500).groupBy("_g").count()
    assert sizes.agg(F.max("count")).first()[0] <= 500 and sizes.agg(F.sum("count")).first()[0] == 20_000


def test_quota_of_one_tenant_on_one_day(spark):
    rng = random.Random(5)
    data = [(rng.choice(["a", "a", "a", "b"]), i, rng.choice([None, 1, 10]), datetime(2024, 1, 1) + timedelta(seconds=rng.randrange(60))) for i in range(300)]
    files = spark.createDataFrame(data, "organization_id string, file_id long, size long, created_at timestamp")
    limits = spark.createDataFrame([("a", 500), ("b", 100)], "organization_id string, limit_bytes long")
    got = {r["file_id"]: r["total_bytes"] for r in relations.quota_check(files, limits, 7).collect()}
    assert got == {i: sum(s or 0 for o2, j, s, at2 in data if o2 == o and (at2, j) <= (at, i)) for o, i, _, at in data}
    assert relations.quota_check(files.limit(0), limits).count() == 0
