"""Canonical JSON and base-62 numbers as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, MapType, NumericType, StringType, StructType

#: Fixed value: digits, then upper-case, then lower-case letters.
DIGITS_62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def _text(value: Column) -> Column:
    """A JSON string: what ``to_json`` makes of a list of one, without the brackets."""
    return F.regexp_replace(F.to_json(F.array(value)), r"^\[|\]$", "")


def _json(value: Column, kind: DataType) -> Column:
    if isinstance(kind, StructType):
        fields = [F.concat(F.lit(f"{_quoted(f.name)}:"), _json(value[f.name], f.dataType)) for f in sorted(kind.fields, key=lambda f: f.name.encode())]
        some = F.concat(F.lit("{"), F.concat_ws(",", *fields), F.lit("}"))
    elif isinstance(kind, MapType):
        pairs = F.array_sort(F.transform(F.map_entries(value), lambda e: F.struct(e["key"].cast("string").alias("k"), _json(e["value"], kind.valueType).alias("v"))))
        some = F.concat(F.lit("{"), F.array_join(F.transform(pairs, lambda e: F.concat(_text(e["k"]), F.lit(":"), e["v"])), ","), F.lit("}"))
    elif isinstance(kind, ArrayType):
        some = F.concat(F.lit("["), F.array_join(F.transform(value, lambda x: _json(x, kind.elementType)), ","), F.lit("]"))
    elif isinstance(kind, (NumericType, BooleanType)):
        some = F.regexp_replace(F.to_json(F.array(value)), r"^\[|\]$", "")
    elif isinstance(kind, StringType):
        some = _text(value)
    else:
        some = _text(value.cast("string"))
    return F.coalesce(F.when(value.isNotNull(), some), F.lit("null"))


def _quoted(name: str) -> str:
    import json

    return json.dumps(name, ensure_ascii=False)


def canonical_json(df: DataFrame, column: str) -> Column:
    """The column as JSON without spaces, keys of structs and maps sorted by bytes at every level, nulls written out; other types as strings."""
    return _json(F.col(column), df.schema[column].dataType)


def base62(number: Column, width: int) -> Column:
    """A whole number from 0 on in ``width`` base-62 digits; higher digits are dropped.

    Quotients are taken of exact multiples, since a division of decimals is rounded to six places.
    """
    number, most = number.cast("decimal(38,0)"), 10**38

    def digit(k: int) -> Column:
        if 62**k >= most:
            return F.lit(DIGITS_62[0])
        unit = F.lit(str(62**k)).cast("decimal(38,0)")
        left = number % F.lit(str(62 ** (k + 1))).cast("decimal(38,0)") if 62 ** (k + 1) < most else number
        return F.substring(F.lit(DIGITS_62), ((left - left % unit) / unit).cast("int") + 1, F.lit(1))

    return F.when(number.isNotNull(), F.concat(*[digit(k) for k in range(width - 1, -1, -1)]))
