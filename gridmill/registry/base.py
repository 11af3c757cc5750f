"""How a named query is declared: a build function over (spark, sf_dir), its SQL twin and the operators it covers."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    covers: tuple[str, ...]


ALL: dict[str, Query] = {}


class Tables:
    """``t.orders`` reads one table of the data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def query(name: str, covers: str, sql: str | None = None):
    """Register ``function(tables)`` under a name."""
    def register(function):
        if name in ALL:
            raise ValueError(f"query {name} exists")
        ALL[name] = Query(name, lambda spark, folder: function(Tables(spark, folder)), sql, tuple(covers.split()))
        return function
    return register


def rounded(df: DataFrame, digits: int, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


# Derived inputs, the same expression for both engines.
EVENTS_NULL = """
    SELECT event_id, ts, user_id, event_type,
           CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS v,
           CASE WHEN event_id % 11 = 0 THEN '' WHEN event_id % 13 = 0 THEN NULL ELSE event_type END AS kind
    FROM events"""


def events_null(t: Tables) -> DataFrame:
    i = F.col("event_id")
    return t.events.select(
        "event_id", "ts", "user_id", "event_type", F.when(i % 7 != 0, F.col("value")).alias("v"),
        F.when(i % 11 == 0, "").when(i % 13 != 0, F.col("event_type")).alias("kind"))


DELIVERY = """
    SELECT event_id, ts AS created_at, user_id AS webhook_id, event_type, value,
           CASE event_type WHEN 'view' THEN 200 WHEN 'click' THEN 200 WHEN 'signup' THEN 404
                           WHEN 'error' THEN 500 END AS response_status,
           1 + event_id % 3 AS attempt
    FROM events"""


def delivery_log(t: Tables) -> DataFrame:
    kind = F.col("event_type")
    status = F.when(kind.isin("view", "click"), 200).when(kind == "signup", 404).when(kind == "error", 500)
    return t.events.select("event_id", F.col("ts").alias("created_at"), F.col("user_id").alias("webhook_id"),
                           "event_type", "value", status.alias("response_status"),
                           (F.col("event_id") % 3 + 1).alias("attempt"))
