"""Joins between catalog, usage and event tables.

Join sides carry no broadcast hint: Catalyst and AQE broadcast a side when its
size is known to be small and split skewed partitions otherwise.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from gridmill.functions.delivery import retry_delay, should_retry, succeeded
from gridmill.functions.filemeta import gigabytes
from gridmill.operators.ordered import CHUNK, sorted_runs

METRICS = ("users", "datasets", "storage_gb", "api_calls")


def usage_against_limits(subscriptions: DataFrame, plans: DataFrame, metrics=METRICS) -> DataFrame:
    """``organization_id, metric, current, limit`` for every subscription with a plan."""
    p = plans.select(F.col("id").cast("string").alias("_plan"), *[f"max_{m}" for m in metrics])
    both = subscriptions.join(p, F.col("plan_id") == F.col("_plan"))
    rows = [F.struct(F.lit(m).alias("metric"), F.col(f"usage_{m}").cast("double").alias("current"),
                     F.col(f"max_{m}").cast("double").alias("limit")) for m in metrics]
    return both.select("organization_id", F.inline(F.array(*rows)))


def retry_candidates(log: DataFrame, config: DataFrame, now: Column | None = None, hours: int = 24) -> DataFrame:
    """Failed deliveries of active endpoints from the last hours, with attempts left.

    ``log(webhook_id, event_type, response_status, attempt, created_at)``,
    ``config(webhook_id, is_active, max_attempts)``.
    """
    recent = log
    if now is not None:
        recent = log.filter(F.col("created_at") >= now - F.expr(f"interval {hours} hours"))
    failed = recent.filter(~succeeded(F.col("response_status")))
    active = config.filter(F.col("is_active"))
    return failed.join(active, "webhook_id").filter(F.col("attempt") < F.col("max_attempts"))


def latest_failed(log: DataFrame, config: DataFrame, now: Column | None = None, hours: int = 24,
                  tie_break: str = "event_id") -> DataFrame:
    """The newest failed delivery of each endpoint and event type, if it may be retried, with its delay.

    One row per group and task reaches the shuffle.
    """
    recent = log
    if now is not None:
        recent = log.filter(F.col("created_at") >= now - F.expr(f"interval {hours} hours"))
    failed = recent.filter(~succeeded(F.col("response_status")))
    newest = Window.partitionBy("webhook_id", "event_type").orderBy(F.col("created_at").desc(), F.col(tie_break).desc())
    last = failed.withColumn("_n", F.row_number().over(newest)).filter("_n = 1").drop("_n")
    active = config.filter(F.col("is_active"))
    due = last.join(active, "webhook_id").filter(F.col("attempt") < F.col("max_attempts"))
    return due.withColumn("retry", should_retry(F.col("response_status"))).withColumn(
        "delay_seconds", retry_delay(F.col("attempt")))


def lookup(df: DataFrame, table: DataFrame, key: str, table_key: str, take: dict[str, str]) -> DataFrame:
    """Left lookup of ``{table column: new name}``; the table's key must be unique."""
    side = table.select(F.col(table_key).alias("_key"), *[F.col(c).alias(n) for c, n in take.items()])
    return df.join(side, F.col(key) == F.col("_key"), "left").drop("_key")


def bridge(left: DataFrame, links: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Many-to-many relation as rows, with the number of linked items of each left row.

    Counts are folded per key before the shuffle, so a key with most of the links costs no more than others.
    """
    counts = links.join(right.select(right_key), right_key, "left_semi").groupBy(left_key).agg(
        F.count(F.lit(1)).alias("item_count"))
    rows = left.join(links, left_key).join(right, right_key)
    return rows.join(counts, left_key)


def bridge_pages(links: DataFrame, right: DataFrame, left_key: str, right_key: str, take: list[str],
                 page_size: int = 1000) -> DataFrame:
    """``left_key, page, items``: linked rows nested in pages of at most ``page_size`` right keys."""
    page = F.call_function("div", F.col(right_key), F.lit(page_size)).alias("page")
    linked = links.select(left_key, right_key).distinct().join(right.select(right_key, *take), right_key)
    return linked.groupBy(left_key, page).agg(F.array_sort(F.collect_list(F.struct(*take))).alias("items"))


def seen(df: DataFrame, known: DataFrame, keys: list[str], new: bool = False) -> DataFrame:
    """Rows whose keys are known, or with ``new`` those whose keys are not."""
    return df.join(known.select(*keys).distinct(), keys, "left_anti" if new else "left_semi")


def activity_feed(feeds: list[DataFrame], at: str, tie_break: str, limit: int) -> DataFrame:
    """Newest rows of several feeds; each feed is cut to the limit before the union."""
    newest = [F.col(at).desc(), F.col(tie_break)]
    cut = [f.orderBy(*newest).limit(limit) for f in feeds]
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), cut)
    return both.orderBy(*newest).limit(limit)


def quota_check(files: DataFrame, limits: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Admit files in time order while the tenant's total stays within its limit.

    ``files(organization_id, file_id, size, created_at)``, ``limits(organization_id, limit_bytes)``.  A tenant's files are cut into runs
    of at most ``chunk`` rows, whatever their days; the sums of its runs are added up separately.  Unknown sizes count nothing.
    """
    runs = sorted_runs(files, ["organization_id"], ["created_at", "file_id"], chunk)
    sums = runs.groupBy("_g").agg(F.sum("size").alias("_sum"))
    before = Window.partitionBy("_g.organization_id").orderBy("_g._run").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("_g", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy("_g").orderBy("created_at", "file_id").rowsBetween(Window.unboundedPreceding, 0)
    running = runs.withColumn("_in", F.coalesce(F.sum("size").over(within), F.lit(0))).join(sums, "_g")
    out = running.withColumn("total_bytes", F.col("_before") + F.col("_in")).drop("_before", "_in", "_g")
    return out.join(limits, "organization_id").withColumn("within_quota", F.col("total_bytes") <= F.col("limit_bytes"))


def tenant_stats(tenants: DataFrame, users: DataFrame, datasets: DataFrame, files: DataFrame, events: DataFrame,
                 month: Column, key: str = "organization_id") -> DataFrame:
    """users, active users, datasets, storage and events of each tenant; every table is reduced before joining."""
    u = users.groupBy(key).agg(F.count(F.lit(1)).alias("total_users"),
                               F.count_if(F.col("is_active")).alias("active_users"))
    d = datasets.groupBy(key).agg(F.count(F.lit(1)).alias("total_datasets"))
    s = files.groupBy(key).agg(gigabytes(F.sum("size")).alias("total_storage_gb"))
    e = events.groupBy(key).agg(
        F.count(F.lit(1)).alias("total_queries"),
        F.count_if(F.date_trunc("month", F.col("created_at")) == month).alias("queries_this_month"))
    out = reduce(lambda a, b: a.join(b, key, "left"), [u, d, s, e], tenants.select(key))
    return out.fillna(0)
