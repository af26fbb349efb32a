"""Small helpers that several operators of this subpackage share."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import discard, settle, settled, shared_dir, shared_path  # noqa: F401

#: One or more of the six ASCII white-space characters; what lies between is a word.
SPACE = r"[\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def input_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of what ``df`` reads."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def stable(df: DataFrame, name: str) -> DataFrame:
    """``df`` where each reading gives the same rows in the same order, else a written copy of it.

    A scan of files with deterministic built-in steps is stable, also when a task runs again on
    another executor; rows behind a shuffle or a Python function are not.
    """
    run = df._jdf.queryExecution()
    steps = set(re.findall(r"(?m)^[\s:+\-*()\d]*([A-Za-z]+)", run.sparkPlan().toString()))
    moving = steps - {"Project", "Filter", "ColumnarToRow", "FileScan", "LocalTableScan"}
    return settle(df, name) if moving or not run.analyzed().deterministic() else df


def words(text: str | Column) -> Column:
    """Words of a text in order; none for null or blank texts."""
    text = F.col(text) if isinstance(text, str) else text
    inner = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, SPACE))


def lower_ascii(text: str | Column) -> Column:
    """Lower-cases A-Z alone."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, upper, upper.lower())


#: Lower-cases A-Z alone in UTF-8 bytes (for bytes.translate).
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))



def bounded_batches(spark: SparkSession, rows: int = 2000, size: str = "16m") -> None:
    """Keeps Arrow batches small: texts may be long, and a batch is held in memory as a whole."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)
