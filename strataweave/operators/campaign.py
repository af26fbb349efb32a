"""Campaign verification: digests, reconciliation, canonical encodings."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import digests


def session_digest(rows: DataFrame, key: str, order: list[str], fragment: Column) -> DataFrame:
    """(key, digest): SHA-256 over the session's rows in order, each NUL-terminated."""
    return digests(rows, [key], order, fragment).select(key, "digest")


def reconcile(expected: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """(key, state): matched, mismatched, missing or unexpected, by digest."""
    e, f = expected.select(key, F.col("digest").alias("e")), found.select(key, F.col("digest").alias("f"))
    state = F.when(F.col("f").isNull(), "missing").when(F.col("e").isNull(), "unexpected").when(F.col("e") == F.col("f"), "matched").otherwise("mismatched")
    return e.join(f, key, "full_outer").select(key, state.alias("state"))


def report(states: DataFrame) -> DataFrame:
    """One row: counts of each state, clean and complete."""
    n = lambda s: F.count_if(F.col("state") == s).alias(s)
    counts = states.agg(n("matched"), n("mismatched"), n("missing"), n("unexpected"))
    return counts.withColumn("clean", F.expr("mismatched = 0 AND unexpected = 0")).withColumn("complete", F.expr("missing = 0"))


def zipped(source: DataFrame, copy: DataFrame, group: str, order: str, value: str) -> DataFrame:
    """Positional pairs of two message lists that differ: (group, ordinal, source, copy)."""
    from pyspark.sql import Window

    w = Window.partitionBy(group).orderBy(order)
    a = source.select(group, F.row_number().over(w).alias("ordinal"), F.col(value).alias("source"))
    b = copy.select(group, F.row_number().over(w).alias("ordinal"), F.col(value).alias("copy"))
    return a.join(b, [group, "ordinal"], "full_outer").filter(~F.col("source").eqNullSafe(F.col("copy")))


def js_number(x: float) -> str:
    """A double as ECMAScript prints it in JSON: shortest digits, exponents beyond 1e21 and below 1e-6, null if not finite."""
    if not math.isfinite(x):
        return "null"
    if x == 0:
        return "0"
    sign, (mantissa, _, power) = "-" if x < 0 else "", f"{abs(x)!r}".partition("e")
    whole, _, part = mantissa.partition(".")
    part = "" if part == "0" else part
    digits, point = (whole + part).lstrip("0"), len(whole) + int(power or 0)
    point -= len(whole + part) - len((whole + part).lstrip("0"))
    digits = digits.rstrip("0")
    k = len(digits)
    if k <= point <= 21:
        text = digits + "0" * (point - k)
    elif 0 < point <= 21:
        text = f"{digits[:point]}.{digits[point:]}"
    elif -6 < point <= 0:
        text = "0." + "0" * -point + digits
    else:
        e = point - 1
        text = (digits if k == 1 else f"{digits[0]}.{digits[1:]}") + f"e{'+' if e > 0 else '-'}{abs(e)}"
    return sign + text


def js_number_col(value: Column) -> Column:
    """Arrow-batched form of :func:`js_number`; Spark has no such formatting."""
    def run(s: pd.Series) -> pd.Series:
        return s.map(js_number)

    return F.pandas_udf(run, "string")(value.cast("double"))


def base62(n: int, width: int) -> str:
    alphabet = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
    out = ""
    for _ in range(width):
        n, r = divmod(n, 62)
        out = alphabet[r] + out
    return out


def variant_id(prefix: str, digest: bytes) -> str:
    """12 hex digits of a SHA-256, then its other bytes modulo 62^14 in base 62."""
    return f"{prefix}_{digest[:6].hex()}{base62(int.from_bytes(digest[6:], 'big') % 62**14, 14)}"
