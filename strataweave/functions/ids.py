"""Deterministic identities: SHA-256 over parts, each followed by one NUL byte."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sha256_hex(*parts: str) -> str:
    return hashlib.sha256(b"".join(p.encode() + b"\0" for p in parts)).hexdigest()


def deterministic_id(prefix: str, *parts: str) -> str:
    return f"{prefix}:{sha256_hex(*parts)[:12]}"


def sha_col(*parts: Column | str) -> Column:
    """Column form of :func:`sha256_hex`; plain strings are literals."""
    nul = F.char(F.lit(0))
    bits: list[Column] = []
    for p in parts:
        bits += [F.lit(p) if isinstance(p, str) else p.cast("string"), nul]
    return F.sha2(F.concat(*bits), 256)


def id_col(prefix: str, *parts: Column | str) -> Column:
    return F.concat(F.lit(f"{prefix}:"), F.substring(sha_col(*parts), 1, 12))


def ordered_digest(order: list[str], fragment: Column) -> Column:
    """Aggregate: SHA-256 over the group's fragments in order, each NUL-terminated."""
    listed = F.sort_array(F.collect_list(F.struct(*order, fragment.alias("_fragment"))))
    joined = F.array_join(F.transform(listed, lambda x: F.concat(x["_fragment"], F.char(F.lit(0)))), "")
    return F.sha2(joined, 256)


def digests(rows: DataFrame, keys: list[str], order: list[str], fragment: Column) -> DataFrame:
    """(keys, digest, n): SHA-256 over each group's fragments in order, each NUL-terminated.

    Rows stream through in sorted order, so no group is held; without keys, all rows are one
    sequence, which a chained digest makes the work of one task.
    """
    picked = rows.select(*keys, *order, fragment.cast("string").alias("_fragment"))
    dealt = picked.repartition(*keys) if keys else picked.repartition(1)
    dealt = dealt.sortWithinPartitions(*keys, *order, "_fragment").select(*keys, "_fragment")

    def run(batches):
        import pyarrow as pa

        now, sha, n, schema = None, None, 0, None

        def answer():
            cells = [pa.array([v], t) for v, t in zip(now, schema)]
            return pa.RecordBatch.from_arrays([*cells, pa.array([sha.hexdigest()]), pa.array([n], pa.int64())], names=[*keys, "digest", "n"])

        for batch in batches:
            schema = [batch.schema.field(i).type for i in range(len(keys))]
            columns = [batch.column(i).to_pylist() for i in range(len(keys) + 1)]
            for *key, text in zip(*columns):
                if key != now:
                    if now is not None:
                        yield answer()
                    now, sha, n = key, hashlib.sha256(), 0
                sha.update((text or "").encode() + b"\0")
                n += 1
        if now is not None:
            yield answer()

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields if f.name in keys] + ["digest string", "n long"])
    return dealt.mapInArrow(run, schema)


RANGE_TAG = "range-1"


def range_digest(rows: DataFrame, key: str, fragment: Column) -> DataFrame:
    """(digest, n): one digest of all rows as a tree over ranges of the key's hash, the same under any partitioning.

    A leaf is the chain of the fragments (by key, then fragment) of keys whose SHA-256 starts with the same four digits; leaves meet by two
    digits and those in the root, each time in order. A task holds a leaf's chain, never its rows, and the upper levels have 256 children
    at most. The tag keeps such digests apart from plain chains.
    """
    nul = F.char(F.lit(0))
    marked = rows.select(F.col(key).cast("string").alias("_key"), fragment.cast("string").alias("_text")).withColumn("r", F.substring(F.sha2("_key", 256), 1, 4))
    tagged = lambda keys, df: df.unionByName(df.select(*keys).distinct().withColumns({"_key": F.lit(None).cast("string"), "_text": F.lit(RANGE_TAG)}))
    leaf = digests(tagged(["r"], marked.select("r", "_key", "_text")), ["r"], ["_key"], F.col("_text"))

    def up(df: DataFrame, to: Column) -> DataFrame:
        pair = F.concat("r", nul, "digest", nul)
        listed = F.sort_array(F.collect_list(F.struct("r", pair.alias("x"))))
        joined = F.concat(F.lit(RANGE_TAG), nul, F.array_join(F.transform(listed, lambda x: x["x"]), ""))
        return df.groupBy(to.alias("to")).agg(F.sha2(joined, 256).alias("digest"), F.sum("n").alias("n")).withColumnRenamed("to", "r")

    leaf = leaf.withColumn("n", F.col("n") - 1)
    return up(up(leaf, F.substring("r", 1, 2)), F.lit("")).select("digest", "n")
