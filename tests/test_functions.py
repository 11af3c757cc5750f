import hashlib
import hmac
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from gridmill.functions import dates, delivery, numbers, signing, text


def values(spark, items, function, kind="string"):
    df = spark.createDataFrame([(x,) for x in items], f"x {kind}")
    return [r[0] for r in df.select(function(F.col("x"))).collect()]


def test_title_follows_python(spark):
    items = ["don't stop-now x_y", "ÉCOLE été", "a1b", "", None, "ßtrasse groß", "  two  words"]
    assert values(spark, items, text.title) == [None if x is None else x.title() for x in items]


def test_capitalize_follows_python(spark):
    items = ["hELLO wORLD", "ßa", "", None, "1A"]
    assert values(spark, items, text.capitalize) == [None if x is None else x.capitalize() for x in items]


def test_strip_removes_unicode_whitespace(spark):
    items = ["  a b\t", " x ", "\n", None]
    assert values(spark, items, text.strip) == ["a b", "x", "", None]


def test_like_literal_keeps_wildcards(spark):
    got = values(spark, ["100%", "100x", "a_b", "axb"], lambda c: c.ilike(f"%{text.like_literal('0%')}"))
    assert got == [True, False, False, False]


@pytest.mark.parametrize("raw,number", [
    ("1", 1.0), ("-2.5", -2.5), (" 3 ", 3.0), ("1e3", 1000.0), (".5", 0.5), ("1d", None), ("12f", None), ("x", None),
    ("", None), ("NaN", None), (None, None), ("1,000", None)])
def test_parse_number(spark, raw, number):
    assert values(spark, [raw], numbers.parse_number) == [number]


def test_clean_number(spark):
    assert values(spark, ["$1,234.50", "€ 7", "12 %", "n/a", None], numbers.clean_number) == [1234.5, 7.0, 12.0, None, None]


def test_booleans(spark):
    assert values(spark, ["Yes", "N", "1", "0", "maybe", None], numbers.parse_boolean) == [True, False, True, False, None, None]


def test_dates_take_the_first_format(spark):
    items = ["2024-02-03", "02/03/2024", "2024-02-03T04:05:06", "Feb 3, 2024", "2024-02-30", "2024-02-03x", "", None]
    d = datetime(2024, 2, 3)
    assert values(spark, items, dates.parse_timestamp) == [d, d, datetime(2024, 2, 3, 4, 5, 6), d, None, None, None, None]


def test_java_pattern():
    assert dates.java_pattern("%d.%m.%YT%H") == "dd.MM.yyyy'T'HH"
    with pytest.raises(ValueError):
        dates.java_pattern("%Q")


def test_week_label_is_sunday_based(spark):
    days = [datetime(2024, 1, 1), datetime(2023, 1, 1), datetime(2023, 12, 31), datetime(2022, 6, 15), datetime(2026, 1, 4)]
    got = values(spark, days, lambda c: dates.bucket_label(c, "week"), "timestamp_ntz")
    assert got == [d.strftime("%Y-W%U") for d in days]


def test_status_and_retry(spark):
    status = [200, 404, 503, None, 302]
    assert values(spark, status, delivery.status_category, "int") == [
        "success", "client_error", "server_error", "network_error", "network_error"]
    assert values(spark, status, delivery.should_retry, "int") == [False, False, True, True, True]


def test_retry_delay(spark):
    assert values(spark, [1, 2, 5, 10], delivery.retry_delay, "int") == [60, 120, 960, 3600]
    assert values(spark, [1, 3, 100], lambda c: delivery.retry_delay(c, "linear"), "int") == [60, 180, 3600]
    assert values(spark, [1, 9], lambda c: delivery.retry_delay(c, "constant"), "int") == [60, 60]


@pytest.mark.parametrize("secret", ["s", "x" * 64, "long secret " * 20])
def test_hmac_equals_the_standard_library(spark, secret):
    items = ["", "payload", "ünïcode {}"]
    want = [hmac.new(secret.encode(), x.encode(), hashlib.sha256).hexdigest() for x in items]
    assert values(spark, items, lambda c: signing.sign(c, secret)) == want
    assert values(spark, items, lambda c: signing.sign_each(c, F.lit(secret))) == want
    assert values(spark, items, lambda c: signing.verified(c, F.lit(want[1]), secret)) == [False, True, False]


def test_own_secrets_of_any_bytes_are_masked_at_once(spark):
    keys = [bytes(range(256))[i:i + n] for i in range(0, 256, 5) for n in (1, 33, 64, 65)] + [b"", b"6" * 64, b"\\" * 64, b"\0" * 3]
    rows = spark.createDataFrame([(bytearray(k), "ü") for k in keys], "k binary, p string")
    signed = rows.select("k", signing.sign_each("p", "k").alias("s"))
    assert [r["s"] for r in signed.collect()] == [hmac.new(k, "ü".encode(), hashlib.sha256).hexdigest() for k in keys]
    # no step per byte of the key: those took 64 interpreted calls a pad and row
    assert "lambda" not in signed._jdf.queryExecution().optimizedPlan().toString()
