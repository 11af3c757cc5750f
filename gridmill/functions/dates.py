"""Date parsing by an ordered format list, time buckets and their labels."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

# fixed values: formats tried in turn, first match wins
DATE_FORMATS = [
    "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss.SSSSSS",
    "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd", "yyyy/M/d", "M/d/yyyy", "M/d/yyyy H:mm", "M/d/yyyy H:mm:ss",
    "d-M-yyyy", "yyyyMMdd", "MMM d, yyyy", "d MMM yyyy", "MMMM d, yyyy", "d MMMM yyyy",
]
# ISO dates and times with short parts, any fraction of a second and a zone: read by the engine's own cast
ISO = r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}([T ][0-9]{1,2}:[0-9]{1,2}(:[0-9]{1,2}([.][0-9]{1,9})?)?(Z|[+-][0-9]{2}:[0-9]{2})?)?$"
# fixed values: strftime directive -> Java pattern letter
STRFTIME = {
    "%Y": "yyyy", "%y": "yy", "%m": "MM", "%d": "dd", "%H": "HH", "%I": "hh", "%M": "mm", "%S": "ss",
    "%f": "SSSSSS", "%p": "a", "%b": "MMM", "%B": "MMMM", "%a": "EEE", "%A": "EEEE", "%j": "DDD", "%%": "%",
}
INTERVALS = ("hour", "day", "week", "month", "year")


def java_pattern(strftime: str) -> str:
    """Translate a strftime pattern; other letters become quoted literals."""
    out, i = [], 0
    while i < len(strftime):
        pair = strftime[i:i + 2]
        if pair[0] == "%":
            if pair not in STRFTIME:
                raise ValueError(f"unsupported date directive {pair!r}")
            out.append(STRFTIME[pair])
            i += 2
            continue
        out.append(f"'{pair[0]}'" if pair[0].isalpha() else pair[0])
        i += 1
    return "".join(out)


def shape_of(pattern: str) -> str:
    """A regular expression for the texts that can fit a Java date pattern at all."""
    out = []
    for part in re.finditer(r"'(?P<quoted>[^']*)'|(?P<run>(?P<letter>[A-Za-z])(?P=letter)*)|(?P<other>.)", pattern):
        run = part["run"]
        if run is None:
            out.append(re.escape(part["quoted"] if part["quoted"] is not None else part["other"]))
        elif run[0] in "Ea" or (run[0] == "M" and len(run) > 2):
            out.append(r"[\p{L}.]+")
        else:
            out.append(r"[0-9]{1,2}" if len(run) == 1 else f"[0-9]{{{len(run)}}}")
    return "^" + "".join(out) + "$"


def _first_fit(text: str, formats: list[str], iso: bool) -> str:
    """SQL for the first format that reads the text, ISO texts first where asked for."""
    def quote(x: str) -> str:
        return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"

    tries = ", ".join(
        f"CASE WHEN {text} RLIKE {quote(shape_of(f))} THEN CAST(try_to_timestamp({text}, {quote(f)}) AS TIMESTAMP_NTZ) END"
        for f in formats)
    any_shape = "|".join(f"(?:{shape_of(f)})" for f in formats)
    listed = f"CASE WHEN {text} RLIKE {quote(any_shape)} THEN coalesce({tries}, NULL) END"
    if not iso:
        return listed
    return f"CASE WHEN {text} RLIKE {quote(ISO)} THEN CAST(TRY_CAST({text} AS TIMESTAMP) AS TIMESTAMP_NTZ) ELSE {listed} END"


def parse_timestamp(c: Column | str, formats: list[str] | None = None) -> Column:
    """First format that fits, as timestamp without zone; null when none does.

    Without given formats, ISO texts of any precision are read too; times with a zone are moved to the session's.

    A failing parse raises inside the JVM, which is slow, so a format only sees
    texts of its shape, and most texts are told apart by one look at all shapes.
    Pass the name of a column that holds the finished text where there is one;
    an expression is bound by a lambda, so that it is evaluated once.
    """
    iso, formats = not formats, formats or DATE_FORMATS
    if isinstance(c, str):
        return F.expr(_first_fit(f"`{c}`", formats, iso))
    return F.get(F.transform(F.array(c), lambda text: _reading(text, formats, iso)), F.lit(0))


def _reading(text: Column, formats: list[str], iso: bool) -> Column:
    any_shape = "|".join(f"(?:{shape_of(f)})" for f in formats)
    listed = F.when(text.rlike(any_shape), F.coalesce(*[
        F.when(text.rlike(shape_of(f)), F.try_to_timestamp(text, F.lit(f)).cast("timestamp_ntz")) for f in formats]))
    return F.when(text.rlike(ISO), text.try_cast("timestamp").cast("timestamp_ntz")).otherwise(listed) if iso else listed


def has_time(c: Column) -> Column:
    return (F.hour(c) + F.minute(c) + F.second(c)) != 0


def bucket(c: Column, interval: str) -> Column:
    if interval not in INTERVALS:
        raise ValueError(f"unknown interval {interval!r}; use one of {INTERVALS}")
    return F.date_trunc(interval, c)


def sunday_week(c: Column) -> Column:
    """Week of the year counted from the first Sunday, two digits (strftime %U)."""
    return F.lpad(F.floor((F.dayofyear(c) + 7 - F.dayofweek(c)) / 7).cast("string"), 2, "0")


def bucket_label(c: Column, interval: str) -> Column:
    if interval == "week":
        return F.concat(F.date_format(c, "yyyy"), F.lit("-W"), sunday_week(c))
    pattern = {"hour": "yyyy-MM-dd HH:00", "day": "yyyy-MM-dd", "month": "yyyy-MM", "year": "yyyy"}[interval]
    return F.date_format(c, pattern)
