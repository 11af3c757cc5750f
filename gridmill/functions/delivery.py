"""Delivery-log functions: status classes, retry rule and retry delay."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from gridmill.functions.text import truncate

# fixed values
BODY_LIMIT = 10_000
INITIAL_DELAY, MAX_DELAY = 60, 3600


def succeeded(status: Column) -> Column:
    return F.coalesce(status.between(200, 299), F.lit(False))


def status_category(status: Column) -> Column:
    return (
        F.when(status.between(200, 299), "success")
        .when(status.between(400, 499), "client_error")
        .when(status.between(500, 599), "server_error")
        .otherwise("network_error")
    )


def should_retry(status: Column) -> Column:
    return ~status_category(status).isin("success", "client_error")


def retry_delay(attempt: Column, strategy: str = "exponential", initial: int = INITIAL_DELAY,
                maximum: int = MAX_DELAY) -> Column:
    """Seconds to wait before the next attempt, never above ``maximum``."""
    if strategy == "exponential":
        delay = F.lit(float(initial)) * F.pow(F.lit(2.0), attempt - 1)
    elif strategy == "linear":
        delay = attempt * float(initial)
    else:
        delay = F.lit(float(initial))
    return F.least(delay, F.lit(float(maximum))).cast("bigint")


def short_body(body: Column) -> Column:
    return truncate(body, BODY_LIMIT)


def subscribed(events: Column, event_type: Column) -> Column:
    return F.array_contains(events, event_type)
