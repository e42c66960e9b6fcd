"""Values in records: numbers JSON cannot hold, nested keys, guards."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, DoubleType, FloatType, MapType, StringType, StructType

from sextant.functions.text import strip

#: How numbers are spelt that JSON has no number for.
NAN, INFINITE, MINUS_INFINITE = "NaN", "Infinity", "-Infinity"
DIGEST = "^[0-9a-f]{64}$"


def spelt(c: Column, kind: DataType) -> Column:
    """Text for every floating-point number, so that those that are not finite
    survive JSON; at any depth of structs, arrays and maps."""
    if isinstance(kind, (DoubleType, FloatType)):
        return F.when(F.isnan(c), NAN).when(c == float("inf"), INFINITE).when(c == float("-inf"), MINUS_INFINITE).otherwise(c.cast("string"))
    if isinstance(kind, StructType):
        return F.when(c.isNotNull(), F.struct(*(spelt(c[f.name], f.dataType).alias(f.name) for f in kind.fields)))
    if isinstance(kind, ArrayType):
        return F.transform(c, lambda x: spelt(x, kind.elementType))
    if isinstance(kind, MapType):
        return F.transform_values(c, lambda _, x: spelt(x, kind.valueType))
    return c


def _paths(value: object, path: str, out: dict[str, str]) -> None:
    if isinstance(value, dict):
        for k, x in value.items():
            _paths(x, f"{path}/{k}" if path else k, out)
    elif isinstance(value, list):
        out[f"{path}/list_len"] = str(len(value))
        for i, x in enumerate(value):
            _paths(x, f"{path}/{i}", out)
    else:
        out[path] = json.dumps(value)


@F.pandas_udf(MapType(StringType(), StringType()))
def flatten_json(texts: pd.Series) -> pd.Series:
    """Leaves of a JSON object of any depth by path (joined by ``/``), and the
    length of each list; no entries for what is not an object."""

    def leaves(text: str | None) -> dict[str, str]:
        try:
            value = json.loads(text or "")
        except ValueError:
            return {}
        out: dict[str, str] = {}
        if isinstance(value, dict):
            _paths(value, "", out)
        return out

    return texts.map(leaves)


def as_list(c: Column, kind: DataType) -> Column:
    """Scalars become arrays of one, nulls empty arrays."""
    if isinstance(kind, ArrayType):
        return F.coalesce(c, F.array().cast(kind))
    return F.when(c.isNull(), F.array().cast(ArrayType(kind))).otherwise(F.array(c))


def optional_text(c: Column) -> Column:
    """Stripped; null if nothing is left."""
    return F.nullif(strip(c), F.lit(""))


def is_digest(c: Column) -> Column:
    return F.coalesce(F.rlike(c, F.lit(DIGEST)), F.lit(False))


def has_keys(document: Column, keys: tuple[str, ...]) -> Column:
    """Whether a JSON object has exactly these keys."""
    return F.coalesce(F.array_sort(F.json_object_keys(document)) == F.array(*map(F.lit, sorted(keys))), F.lit(False))


def repeated(c: Column) -> Column:
    """How many elements of an array were there before."""
    return F.size(c) - F.size(F.array_distinct(c))
