"""Reading numbers and booleans from text without failing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

# fixed values: plain decimal text that queries treat as a number
PLAIN_NUMBER = r"^-?[0-9]+\.?[0-9]*$"
# fixed values: any numeric literal; keeps Java's trailing d/f suffix out
NUMBER_LITERAL = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"
# fixed values: the boolean vocabulary
TRUE_WORDS = ["true", "t", "yes", "y", "1"]
FALSE_WORDS = ["false", "f", "no", "n", "0"]
# fixed values: characters dropped from formatted numbers
CURRENCY_MARKS = "$€£¥₹, %"


def is_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.NumericType)


def column_type(df: DataFrame, name: str) -> T.DataType:
    if name not in df.columns:
        raise ValueError(f"column {name!r} not found; have {df.columns}")
    return df.schema[name].dataType


def parse_number(c: Column) -> Column:
    """Text to double; anything that is no numeric literal becomes null."""
    return F.when(c.rlike(NUMBER_LITERAL), c.try_cast("double"))


def as_number(df: DataFrame, name: str, strict_text: bool = True) -> Column:
    """A double view of a column: NaN and unreadable text are null."""
    dtype, c = column_type(df, name), F.col(name)
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(c), c.cast("double"))
    if is_numeric(dtype) or isinstance(dtype, T.BooleanType):
        return c.cast("double")
    if isinstance(dtype, T.StringType):
        return F.when(c.rlike(PLAIN_NUMBER), c.try_cast("double")) if strict_text else parse_number(c)
    raise ValueError(f"column {name!r} of type {dtype.simpleString()} has no numeric reading")


def parse_boolean(c: Column) -> Column:
    word = F.lower(c.cast("string"))
    return F.when(word.isin(TRUE_WORDS), F.lit(True)).when(word.isin(FALSE_WORDS), F.lit(False))


def clean_number(c: Column, marks: str = CURRENCY_MARKS) -> Column:
    return parse_number(F.translate(c, marks, ""))


def percent(part: Column, whole: Column, empty: float = 0.0) -> Column:
    return F.coalesce(F.try_divide(part * 100.0, whole), F.lit(empty))


def missing(df: DataFrame, name: str, blank: bool = False) -> Column:
    """Null or NaN; with ``blank`` the empty string too."""
    c, dtype = F.col(name), column_type(df, name)
    test = c.isNull()
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        test = test | F.isnan(c)
    if blank and isinstance(dtype, T.StringType):
        test = test | (c == "")
    return test
