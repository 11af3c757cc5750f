"""Text functions with the semantics of Python's string methods."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

TRUNCATION_MARK = "... (truncated)"


def strip(c: Column) -> Column:
    """Remove all Unicode whitespace at both ends (``trim`` removes blanks only)."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def title(c: Column) -> Column:
    """Upper-case each letter that follows a non-letter, lower-case the others."""
    words = F.split(c, r"(?<=[^\p{L}])(?=\p{L})")
    return F.array_join(F.transform(words, capitalize), "")


def capitalize(c: Column) -> Column:
    # a letter may have a longer capital form: sharp s starts a word as "Ss", not "SS"
    first = F.upper(F.substring(c, 1, 1))
    return F.concat(F.substring(first, 1, 1), F.lower(first.substr(F.lit(2), F.length(first))),
                    F.lower(c.substr(F.lit(2), F.length(c))))


CASES = {"lower": F.lower, "upper": F.upper, "title": title, "capitalize": capitalize}


def to_case(c: Column, case: str) -> Column:
    if case not in CASES:
        raise ValueError(f"unknown case {case!r}; use one of {sorted(CASES)}")
    return CASES[case](c)


def like_literal(value: str) -> str:
    """Escape the LIKE wildcards so that a user's text is matched as it stands."""
    return value.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


def truncate(c: Column, length: int, mark: str = TRUNCATION_MARK) -> Column:
    return F.when(F.length(c) > length, F.concat(F.substring(c, 1, length), F.lit(mark))).otherwise(c)


def matching_key(c: Column) -> Column:
    """Lower case, only [a-z0-9_], single inner underscores: the form in which names are compared."""
    kept = F.regexp_replace(F.lower(c), "[^a-z0-9_]", "")
    return F.regexp_replace(F.regexp_replace(kept, "_+", "_"), "^_|_$", "")
