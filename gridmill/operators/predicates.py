"""Filter specs ``[{column, operator, value}]`` to Column predicates, AND-ed."""

from __future__ import annotations

import math
from decimal import Decimal, InvalidOperation
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from gridmill.functions.numbers import column_type, is_numeric
from gridmill.functions.text import like_literal

# fixed values: the operators of the record path and of the aggregate path
RECORD_OPERATORS = (
    "eq", "ne", "gt", "gte", "lt", "lte", "contains", "starts_with", "ends_with",
    "in", "not_in", "is_null", "is_not_null",
)
AGGREGATE_OPERATORS = ("eq", "ne", "gt", "lt", "gte", "lte", "contains", "in")

_TIME = (T.TimestampType, T.TimestampNTZType, T.DateType)
_BITS = {T.ByteType: 8, T.ShortType: 16, T.IntegerType: 32, T.LongType: 64}
_MIRROR = {"gt": "__gt__", "gte": "__ge__", "lt": "__lt__", "lte": "__le__"}


def _number(value) -> Decimal | None:
    """The exact number a value stands for, infinities included; None for anything else."""
    try:
        number = Decimal(int(value)) if isinstance(value, bool) else Decimal(str(value).strip())
    except InvalidOperation:
        return None
    return None if number.is_nan() else number


def _known(name: str, outcome: bool) -> Column:
    """The same answer for every row that has a value; nulls stay unknown."""
    return F.when(F.col(name).isNotNull(), F.lit(outcome))


def _literal(dtype: T.DataType, value) -> Column | None:
    """The value as a literal of the column's own type, so the comparison reaches the scan; None where the type cannot hold it."""
    if is_numeric(dtype):
        number = _number(value)
        if number is None:
            return None
        if isinstance(dtype, T.IntegralType):
            top = 1 << (_BITS[type(dtype)] - 1)
            if not number.is_finite() or number != number.to_integral_value() or not -top <= number < top:
                return None
            return F.lit(int(number)).cast(dtype)
        if isinstance(dtype, T.DecimalType):
            return F.lit(number) if number.is_finite() and _fits_decimal(number) else None
        return F.lit(float(number)) if Decimal(float(number)) == number or not _whole(value) else None
    if isinstance(dtype, T.BooleanType):
        return {"true": F.lit(True), "false": F.lit(False)}.get(str(value).lower())
    if isinstance(dtype, _TIME):
        return F.lit(str(value)).try_cast(dtype)
    return F.lit(str(value))


def _whole(value) -> bool:
    """Whole numbers have to be met exactly; decimal fractions are read as the nearest double, as a column's texts were."""
    number = _number(value)
    return number.is_finite() and number == number.to_integral_value()


def _fits_decimal(number: Decimal) -> bool:
    _, digits, exponent = number.as_tuple()
    return max(len(digits) + max(exponent, 0), -exponent) <= 38


def _equals(df: DataFrame, name: str, value) -> Column:
    literal = _literal(column_type(df, name), value)
    # text that the column's type cannot hold never equals it; nulls stay unknown
    return F.col(name) == literal if literal is not None else _known(name, False)


def _ordered(df: DataFrame, name: str, op: str, value) -> Column:
    """gt, gte, lt, lte.  Bounds of integer columns become integers, so that the bare column is compared."""
    dtype = column_type(df, name)
    if isinstance(dtype, _TIME):
        return getattr(F.col(name), _MIRROR[op])(F.lit(str(value)).try_cast(dtype))
    number = _number(value)
    if number is None:
        raise ValueError(f"operator {op!r} needs a number, not {value!r}")
    if isinstance(dtype, T.IntegralType):
        top = 1 << (_BITS[type(dtype)] - 1)
        if number >= top or number < -top:
            return _known(name, (number > 0) == (op in ("lt", "lte")))
        down = op in ("gt", "lte")  # col > 2.5 is col > 2, col >= 2.5 is col >= 3
        return getattr(F.col(name), _MIRROR[op])(F.lit(math.floor(number) if down else math.ceil(number)))
    if isinstance(dtype, T.DecimalType) and number.is_finite() and _fits_decimal(number):
        return getattr(F.col(name), _MIRROR[op])(F.lit(number))
    left = F.col(name) if is_numeric(dtype) else F.col(name).try_cast("double")
    bound = float(number)
    if _whole(value) and Decimal(bound) != number:  # no double is the bound: the nearest one lies on one side of it
        op = {"gt": "gt", "gte": "gt", "lt": "lte", "lte": "lte"}[op] if bound < number else {"gt": "gte", "gte": "gte", "lt": "lt", "lte": "lt"}[op]
    return getattr(left, _MIRROR[op])(F.lit(bound))


def _values(df: DataFrame, name: str, value) -> Column:
    if not isinstance(value, (list, tuple, set)):
        raise ValueError("'in' and 'not_in' take a list of values")
    literals = [x for x in (_literal(column_type(df, name), v) for v in value) if x is not None]
    return F.col(name).isin(*literals) if literals else _known(name, False)


def compile_filter(df: DataFrame, spec: dict, allowed=RECORD_OPERATORS) -> Column:
    """One spec to one predicate; an unknown column or operator raises."""
    name, op, value = spec["column"], spec["operator"], spec.get("value")
    if op not in allowed:
        raise ValueError(f"unknown operator {op!r}; use one of {allowed}")
    column_type(df, name)
    text = F.col(name).cast("string")
    pattern = like_literal(str(value))
    if spec.get("raw"):
        pattern = str(value)
    if op == "eq":
        return _equals(df, name, value)
    if op == "ne":
        return ~_equals(df, name, value)
    if op in ("gt", "gte", "lt", "lte"):
        return _ordered(df, name, op, value)
    if op == "contains":
        return text.ilike(f"%{pattern}%")
    if op == "starts_with":
        return text.ilike(f"{pattern}%")
    if op == "ends_with":
        return text.ilike(f"%{pattern}")
    if op == "in":
        return _values(df, name, value)
    if op == "not_in":
        return ~_values(df, name, value)
    return F.col(name).isNull() if op == "is_null" else F.col(name).isNotNull()


def compile_filters(df: DataFrame, specs: list[dict], allowed=RECORD_OPERATORS) -> Column:
    parts = [compile_filter(df, s, allowed) for s in specs]
    return reduce(lambda a, b: a & b, parts) if parts else F.lit(True)


def apply_filters(df: DataFrame, specs: list[dict] | None, allowed=RECORD_OPERATORS) -> DataFrame:
    """AND of all specs as one predicate, whatever the length of a value list."""
    return df.filter(compile_filters(df, specs, allowed)) if specs else df


def validate_filters(df: DataFrame, specs: list[dict], allowed=RECORD_OPERATORS) -> None:
    """Raise on the first spec that cannot be built."""
    for s in specs:
        missing = {"column", "operator"} - set(s)
        if missing:
            raise ValueError(f"filter {s} lacks {sorted(missing)}")
        if s["operator"] not in allowed:
            raise ValueError(f"unknown operator {s['operator']!r}; use one of {allowed}")
        column_type(df, s["column"])
        if s["operator"] not in ("is_null", "is_not_null") and s.get("value") is None:
            raise ValueError(f"operator {s['operator']!r} needs a value")


def search_any(df: DataFrame, text: str, columns: list[str] | None = None) -> Column:
    """Case-insensitive containment in any of the columns."""
    pattern = f"%{like_literal(text)}%"
    tests = [F.coalesce(F.col(c).cast("string").ilike(pattern), F.lit(False)) for c in (columns or df.columns)]
    return reduce(lambda a, b: a | b, tests)


def search_document(df: DataFrame, text: str) -> Column:
    """Containment in the row's JSON text, so key names match too."""
    return F.to_json(F.struct(*df.columns)).ilike(f"%{like_literal(text)}%")


def tenant_rows(df: DataFrame, tenant, column: str = "organization_id", bypass: bool = False) -> DataFrame:
    return df if bypass else df.filter(F.col(column) == F.lit(tenant))


def live_rows(df: DataFrame, column: str = "deleted_at") -> DataFrame:
    return df.filter(F.col(column).isNull())


def mark_deleted(df: DataFrame, condition: Column, column: str = "deleted_at", at: Column | None = None) -> DataFrame:
    stamp = F.current_timestamp() if at is None else at
    old = F.col(column) if column in df.columns else F.lit(None)
    return df.withColumn(column, F.when(condition & old.isNull(), stamp).otherwise(old))


def delivery_status(df: DataFrame, outcome: str, column: str = "response_status") -> DataFrame:
    """``success`` is 2xx, ``error`` is any other known status; unknown status is neither."""
    c = F.col(column)
    tests = {"success": c.between(200, 299), "error": (c < 200) | (c >= 300)}
    if outcome not in tests:
        raise ValueError(f"unknown outcome {outcome!r}")
    return df.filter(tests[outcome])


def catalog_rows(df: DataFrame, equals: dict | None = None, time_column: str | None = None,
                 since=None, until=None, search: str | None = None, search_columns=()) -> DataFrame:
    """Equality, inclusive time range and OR-search over a catalog table."""
    specs = [{"column": k, "operator": "eq", "value": v} for k, v in (equals or {}).items()]
    if since is not None:
        specs.append({"column": time_column, "operator": "gte", "value": since})
    if until is not None:
        specs.append({"column": time_column, "operator": "lte", "value": until})
    df = apply_filters(df, specs)
    return df.filter(search_any(df, search, list(search_columns))) if search else df
