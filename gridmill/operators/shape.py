"""Column names, types, scaling, encoding and reshaping."""

from __future__ import annotations

import json
import re
from functools import reduce
from itertools import chain, count

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from gridmill.functions.dates import parse_timestamp
from gridmill.functions.numbers import as_number, parse_boolean, parse_number
from gridmill.operators.aggregates import FUNCTIONS
from gridmill.operators.ordered import assign_positions
from gridmill.operators.quantiles import percentile_columns
from gridmill.operators.stats import with_scalar

SEPARATORS = r"\s_-"
# case -> how a name is cut into tokens, what becomes of the first token and of the others, and what joins them
_TOKEN = f"[^{SEPARATORS}]+"
_HUMP = rf"(?:(?![a-z0-9][A-Z])[^{SEPARATORS}])*[^{SEPARATORS}]"
NAME_CASES = {
    "snake": (_HUMP, str.lower, str.lower, "_"),
    "camel": (_TOKEN, str.lower, str.capitalize, ""),
    "pascal": (_TOKEN, str.capitalize, str.capitalize, ""),
    "lower": ("[^ ]*", str.lower, str.lower, "_"),
    "upper": ("[^ ]*", str.upper, str.upper, "_"),
}


def _in_case(name: str, case: str) -> str:
    pattern, first, rest, joint = NAME_CASES[case]
    if pattern == "[^ ]*":
        tokens = name.split(" ")
    else:
        tokens = re.findall(pattern, name)
        if case == "camel" and re.match(f"[{SEPARATORS}]", name):
            first = rest  # nothing stands before the separator
    return joint.join([first(t) for t in tokens[:1]] + [rest(t) for t in tokens[1:]])


def normal_names(names: list[str], case: str = "snake", remove_special: bool = True,
                 max_length: int | None = None) -> list[str]:
    """Names in one case; an empty name gets its position, a name that is taken the next free number."""
    if case not in NAME_CASES:
        raise ValueError(f"unknown case {case!r}; use one of {sorted(NAME_CASES)}")
    special = r"[^\w\s]|[^\x00-\x7f]" if remove_special else r"(?!)"
    bases = [_in_case(" ".join(re.split(r"\s+", re.sub(special, lambda m: m[0] if m[0].isspace() else "", n))), case)[:max_length] or f"column_{i}"
             for i, n in enumerate(names)]
    given: dict[str, None] = {}
    numbers = {base: count(1) for base in bases}
    for base in bases:
        given[next(n for n in chain([base], (f"{base}_{k}" for k in numbers[base])) if n not in given)] = None
    return list(given)


def normalize_names(df: DataFrame, case: str = "snake", remove_special: bool = True,
                    max_length: int | None = None) -> DataFrame:
    """``normal_names`` as column names.  Spark can't write or read names that differ in case alone unless its session tells cases apart
    (``spark.sql.caseSensitive``); where such names come out, that is set."""
    names = normal_names(df.columns, case, remove_special, max_length)
    if len({n.lower() for n in names}) < len(names):
        df.sparkSession.conf.set("spark.sql.caseSensitive", "true")
    return df.toDF(*names)


_TYPES = {"int": "bigint", "integer": "bigint", "float": "double", "str": "string", "string": "string",
          "bool": "boolean", "boolean": "boolean", "datetime": "timestamp_ntz", "category": "string"}


def convert(c: Column, source: T.DataType, target: str) -> Column:
    """Null where the value cannot be read as the target type."""
    if target not in _TYPES:
        raise ValueError(f"unsupported type {target!r}; use one of {sorted(_TYPES)}")
    kind, text = _TYPES[target], isinstance(source, T.StringType)
    if kind == "bigint":
        number = parse_number(c) if text else c.try_cast("double")
        # through double, so that '2.0' is 2 while '2.7' has no integer reading
        whole = F.when(number == F.floor(number), number.try_cast("bigint"))
        return F.coalesce(c.try_cast("bigint"), whole) if text else whole if isinstance(source, T.FractionalType) \
            else c.try_cast("bigint")
    if kind == "double":
        return parse_number(c) if text else c.try_cast("double")
    if kind == "boolean":
        return c if isinstance(source, T.BooleanType) else parse_boolean(c)
    if kind == "timestamp_ntz":
        return parse_timestamp(c) if text else c.try_cast("timestamp_ntz")
    return c.cast("string")


def convert_types(df: DataFrame, type_map: dict[str, str], errors: str = "raise") -> DataFrame:
    """``coerce`` nulls bad values, ``raise`` fails the job on one, ``ignore`` keeps a column that has one."""
    if errors not in ("raise", "coerce", "ignore"):
        raise ValueError(f"unknown errors mode {errors!r}")
    new = {n: convert(F.col(n), df.schema[n].dataType, t) for n, t in type_map.items()}
    bad = {n: F.col(n).isNotNull() & c.isNull() for n, c in new.items()}
    if errors == "raise":
        new = {n: F.when(bad[n], F.raise_error(F.format_string(f"cannot convert {n} value %s to {type_map[n]}",
                                                               F.col(n).cast("string")))).otherwise(c)
               for n, c in new.items()}
    elif errors == "ignore":
        # the schema depends on the data here, so this mode counts first
        failed = df.agg(*[F.count_if(b).alias(n) for n, b in bad.items()]).first()
        new = {n: c for n, c in new.items() if failed[n] == 0}
    return df.withColumns(new) if new else df


def conversion_counts(df: DataFrame, type_map: dict[str, str]) -> DataFrame:
    from gridmill.operators.profile import long_stats
    new = {n: convert(F.col(n), df.schema[n].dataType, t) for n, t in type_map.items()}
    return long_stats(df, list(type_map), lambda c: [
        F.lit(type_map[c]).alias("target"), F.count(new[c]).alias("converted"),
        F.count_if(F.col(c).isNotNull() & new[c].isNull()).alias("failed")]).drop("position")


# --- scaling -----------------------------------------------------------------

SCALERS = ("minmax", "standard", "zscore", "robust", "maxabs")


def scaling_params(df: DataFrame, columns: list[str], method: str = "minmax") -> DataFrame:
    """One row with ``<column>_shift`` and ``<column>_scale``: scaled = (x - shift) / scale."""
    xs = {c: as_number(df, c) for c in columns}
    if method == "minmax":
        raw = df.agg(*[f(x).alias(f"{c}_{n}") for c, x in xs.items() for n, f in (("a", F.min), ("b", F.max))])
        shift, scale = (lambda c: F.col(f"{c}_a")), (lambda c: F.col(f"{c}_b") - F.col(f"{c}_a"))
    elif method in ("standard", "zscore"):
        raw = df.agg(*[f(x).alias(f"{c}_{n}") for c, x in xs.items() for n, f in (("a", F.avg), ("b", F.stddev_pop))])
        shift, scale = (lambda c: F.col(f"{c}_a")), (lambda c: F.col(f"{c}_b"))
    elif method == "robust":
        raw = percentile_columns(df, {f"{c}_{n}": (x, p) for c, x in xs.items()
                                      for n, p in (("a", 0.5), ("l", 0.25), ("h", 0.75))})
        shift, scale = (lambda c: F.col(f"{c}_a")), (lambda c: F.col(f"{c}_h") - F.col(f"{c}_l"))
    elif method == "maxabs":
        raw = df.agg(*[F.max(F.abs(x)).alias(f"{c}_b") for c, x in xs.items()])
        shift, scale = (lambda c: F.lit(0.0)), (lambda c: F.col(f"{c}_b"))
    else:
        raise ValueError(f"unknown method {method!r}; use one of {SCALERS}")
    return raw.select(*[e.alias(f"{c}_{n}") for c in columns for n, e in (("shift", shift(c)), ("scale", scale(c)))])


def scale_numeric(df: DataFrame, columns: list[str], method: str = "minmax",
                  feature_range: tuple[float, float] = (0.0, 1.0)) -> DataFrame:
    """Columns without spread: minmax gives the range minimum, standard 0, robust and maxabs stay as they are."""
    low, high = feature_range
    out = with_scalar(df, scaling_params(df, columns, method), "_p")
    for c in columns:
        x, shift, scale = as_number(df, c), F.col("_p")[f"{c}_shift"], F.col("_p")[f"{c}_scale"]
        scaled = F.try_divide(x - shift, scale)
        if method == "minmax":
            scaled = F.when(scale == 0, F.when(x.isNotNull(), F.lit(0.0))).otherwise(scaled) * (high - low) + low
        elif method in ("standard", "zscore"):
            scaled = F.when(scale == 0, x - shift).otherwise(scaled)
        else:
            scaled = F.when(scale == 0, x).otherwise(scaled)
        out = out.withColumn(c, scaled)
    return out.drop("_p")


def inverse_scale(df: DataFrame, params: DataFrame, columns: list[str], method: str = "minmax",
                  feature_range: tuple[float, float] = (0.0, 1.0)) -> DataFrame:
    low, high = feature_range
    out = with_scalar(df, params, "_p")
    for c in columns:
        x, shift, scale = F.col(c), F.col("_p")[f"{c}_shift"], F.col("_p")[f"{c}_scale"]
        unit = (x - low) / (high - low) if method == "minmax" else x
        # columns without spread were only shifted (or left alone)
        plain = {"minmax": shift, "standard": x + shift, "zscore": x + shift}.get(method, x)
        out = out.withColumn(c, F.when(scale == 0, plain).otherwise(unit * scale + shift))
    return out.drop("_p")


# --- encoding ----------------------------------------------------------------

def categories(df: DataFrame, column: str, most: int = 10_000) -> list:
    """Sorted distinct values, the names of new columns; no more than ``most`` and one reach the driver.

    Names make up the plan, so a column with more raises; ``onehot_long`` and ``pivot_long`` have no such bound.
    """
    found = df.select(column).filter(F.col(column).isNotNull()).distinct().limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"{column} has more than {most} values: name those wanted, or use the long form")
    return sorted(r[0] for r in found)


def encode_onehot(df: DataFrame, column: str, drop_first: bool = False, values: list | None = None) -> DataFrame:
    """``<column>_<value>`` 0/1 columns in place of the column; null is 0 everywhere."""
    values = categories(df, column) if values is None else sorted(values)
    flags = [F.when(F.col(column) == v, 1).otherwise(0).alias(f"{column}_{v}") for v in values[int(drop_first):]]
    return df.select(*[c for c in df.columns if c != column], *flags)


def onehot_long(df: DataFrame, column: str, row_number: str) -> DataFrame:
    """Sparse one-hot of any width: ``row_number, feature, value`` with the ones only."""
    return df.filter(F.col(column).isNotNull()).select(
        row_number, F.concat_ws("_", F.lit(column), F.col(column).cast("string")).alias("feature"),
        F.lit(1).alias("value"))


def dictionary(df: DataFrame, column: str, order: list | None = None) -> DataFrame:
    """``value, code`` with codes 0.. in sorted (or given) order."""
    spark = df.sparkSession
    if order is not None:
        return spark.createDataFrame([(v, i) for i, v in enumerate(order)], T.StructType([
            T.StructField("value", df.schema[column].dataType), T.StructField("code", T.LongType())]))
    return dictionaries(df, [column])[column]


def dictionaries(df: DataFrame, columns: list[str]) -> dict[str, DataFrame]:
    """``value, code`` for each column, from one sort of all distinct values of all columns.

    The sorted values are written once, by one job that runs when this is called.  Values lie in one field per type, the other fields are
    null, so that every column is sorted by its own type.
    """
    types = list(dict.fromkeys(df.schema[c].dataType for c in columns))
    fields = [f"v{i}" for i in range(len(types))]
    cells = [F.struct(F.lit(at).alias("place"), *[
        (F.col(c) if df.schema[c].dataType == kind else F.lit(None).cast(kind)).alias(f) for f, kind in zip(fields, types)])
        for at, c in enumerate(columns)]
    if not cells:
        return {}
    distinct = df.select(F.inline(F.array(*cells))).filter(
        reduce(lambda a, b: a | b, [F.col(f).isNotNull() for f in fields]))
    placed = assign_positions(distinct.distinct(), ["place", *fields], "_n")
    first = placed.groupBy("place").agg(F.min("_n").alias("_first"))
    coded = placed.join(F.broadcast(first), "place")  # one row per column
    return {c: coded.filter(F.col("place") == at).select(
        F.col(fields[types.index(df.schema[c].dataType)]).alias("value"), (F.col("_n") - F.col("_first")).alias("code"))
        for at, c in enumerate(columns)}


def encode_label(df: DataFrame, column: str, mapping: DataFrame | None = None) -> DataFrame:
    """Replace values by their codes; null stays null, values outside the mapping become null."""
    mapping = dictionary(df, column) if mapping is None else mapping
    joined = df.join(mapping.select(F.col("value").alias("_value"), F.col("code").alias("_code")),
                     F.col(column) == F.col("_value"), "left")
    return joined.withColumn(column, F.col("_code")).drop("_value", "_code")


def encode_labels(df: DataFrame, columns: list[str]) -> DataFrame:
    """Label codes for many columns; every dictionary comes from the input, all from one sort."""
    out = df
    for c, mapping in dictionaries(df, columns).items():
        out = encode_label(out, c, mapping)
    return out


def encode_ordinal(df: DataFrame, column: str, order: list | None = None) -> DataFrame:
    return encode_label(df, column, dictionary(df, column, order))


def decode(df: DataFrame, column: str, mapping: DataFrame) -> DataFrame:
    joined = df.join(mapping.select(F.col("value").alias("_value"), F.col("code").alias("_code")),
                     F.col(column) == F.col("_code"), "left")
    return joined.withColumn(column, F.col("_value")).drop("_value", "_code")


# --- reshaping ---------------------------------------------------------------

def _cell(values: str, aggfunc: str, row_number: str | None) -> Column:
    x = F.col(values)
    if aggfunc in ("first", "last"):
        if row_number is None:
            raise ValueError("first and last need the row number column")
        by = F.when(x.isNotNull(), F.col(row_number))
        return F.min_by(x, by) if aggfunc == "first" else F.max_by(x, by)
    if aggfunc not in FUNCTIONS:
        raise ValueError(f"unknown aggregate {aggfunc!r}")
    return FUNCTIONS[aggfunc](x)


def pivot(df: DataFrame, index: list[str], columns: str, values: str, aggfunc: str = "mean", fill_value=None,
          pivot_values: list | None = None, row_number: str | None = None) -> DataFrame:
    """One row per index, one column per value of ``columns``; null keys are dropped.

    ``first``/``last`` follow ``row_number``.
    """
    names = categories(df, columns) if pivot_values is None else pivot_values
    agg = _cell(values, aggfunc, row_number)
    rows = df.dropna(subset=[*index, columns])
    out = rows.groupBy(*index).pivot(columns, names).agg(agg)
    out = out.toDF(*index, *[f"{values}_{n}" for n in names])
    return out if fill_value is None else out.fillna(fill_value, subset=out.columns[len(index):])


def pivot_long(df: DataFrame, index: list[str], columns: str, values: str, aggfunc: str = "mean",
               row_number: str | None = None) -> DataFrame:
    """The cells of a pivot of any width: ``index..., feature, value``, one row per index and name that occur together.

    Neither the names nor the cells reach the driver, and no row holds more than one cell.  ``feature`` is the name ``pivot`` gives the column.
    """
    cells = df.dropna(subset=[*index, columns]).groupBy(*index, columns).agg(_cell(values, aggfunc, row_number).alias("value"))
    return cells.select(*index, F.concat_ws("_", F.lit(values), F.col(columns).cast("string")).alias("feature"), "value")


def unpivot(df: DataFrame, id_vars: list[str], value_vars: list[str] | None = None, var_name: str = "variable",
            value_name: str = "value") -> DataFrame:
    """Melt; nulls stay; columns of different types are read as text."""
    names = value_vars or [c for c in df.columns if c not in id_vars]
    types = {df.schema[c].dataType.simpleString() for c in names}
    if len(types) > 1:
        df = df.select(*id_vars, *[F.col(c).cast("string").alias(c) for c in names])
    return df.unpivot(id_vars, names, var_name, value_name)


def flatten_structs(df: DataFrame, separator: str = "_") -> DataFrame:
    """Expand nested structs to ``a_b`` columns."""
    def walk(path: str, name: str, dtype: T.DataType):
        if isinstance(dtype, T.StructType):
            for f in dtype.fields:
                yield from walk(f"{path}.`{f.name}`", f"{name}{separator}{f.name}", f.dataType)
        else:
            yield F.col(path).alias(name)
    return df.select(*[c for f in df.schema for c in walk(f"`{f.name}`", f.name, f.dataType)])


def _parts(node, of_object: bool):
    """The members of a container that is opened; None for a leaf, and for an object's list with a plain value in it."""
    if isinstance(node, dict):
        return node.items()
    if isinstance(node, list) and not (of_object and any(not isinstance(x, (dict, list)) for x in node)):
        return enumerate(node)
    return None


def _paths(document, sep: str):
    """Key paths and leaves, in document order."""
    waiting = [((), document, False)]
    while waiting:
        path, node, of_object = waiting.pop()
        parts = _parts(node, of_object)
        if parts is None:
            yield sep.join(path) or "value", node
        else:
            waiting += reversed([((*path, str(k)), child, isinstance(node, dict)) for k, child in parts])


def _text(leaf) -> str | None:
    return leaf if leaf is None or isinstance(leaf, str) else json.dumps(leaf)


def flatten_json(df: DataFrame, document: str, keep: list[str], separator: str = "_") -> DataFrame:
    """``keep..., key, value`` for every leaf of a JSON text of any shape; text that is no JSON gives no row."""
    @F.pandas_udf("map<string,string>")
    def leaves(texts: pd.Series) -> pd.Series:
        def one(text):
            try:
                return {k: _text(v) for k, v in _paths(json.loads(text), separator)}
            except (TypeError, ValueError):
                return None
        return texts.map(one)

    return df.select(*keep, F.explode(leaves(F.col(document))))
