"""Checks of facts, bundles, contracts and receipts: anti-joins that list what is wrong."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import digests

#: The kinds of entities that each relation type may join.
ENDPOINTS = {
    "contains": ("file", "module heading link code_mention symbol import rationale"),
    "defines": ("file module definition", "definition"),
    "calls": ("file definition", "definition"),
    "implements": ("definition", "definition"),
    "inherits": ("definition", "definition"),
    "references": ("file rationale", "file definition"),
    "imports": ("file", "import"),
}


def endpoints_fit(rel_type: Column, from_kind: Column, to_kind: Column) -> Column:
    """May a relation of this type join these kinds?"""
    fit = F.lit(False)
    for name, (left, right) in ENDPOINTS.items():
        fit = fit | ((rel_type == name) & from_kind.isin(*left.split()) & to_kind.isin(*right.split()))
    return fit


def fact_faults(facts: DataFrame, files: DataFrame) -> DataFrame:
    """(fact_id, fault) of facts whose file is unknown, whose bytes aren't the text that they quote, or whose ends don't fit.

    ``facts``: fact_id, file, byte_start, byte_end, quoted, rel_type, from_kind, to_kind; ``files``: file, text.
    """
    raw = F.col("text").cast("binary")
    there = F.substring(raw, F.col("byte_start") + 1, F.col("byte_end") - F.col("byte_start"))
    inside = (F.col("byte_start") >= 0) & (F.col("byte_end") >= F.col("byte_start")) & (F.col("byte_end") <= F.octet_length(raw))
    fault = (
        F.when(F.col("text").isNull(), "unknown file")
        .when(~inside, "outside of the file")
        .when(there != F.col("quoted").cast("binary"), "other text")
        .when(~endpoints_fit(F.col("rel_type"), F.col("from_kind"), F.col("to_kind")), "unfit ends")
    )
    return facts.join(files.select("file", "text"), "file", "left").select("fact_id", fault.alias("fault")).filter("fault IS NOT NULL")


def accepted(facts: DataFrame, files: DataFrame) -> DataFrame:
    """All facts or, if one is at fault, none."""
    faults = fact_faults(facts, files).agg(F.count(F.lit(1)).alias("faults"))
    return facts.join(F.broadcast(faults), F.col("faults") == 0).drop("faults")


def bundle_faults(items: DataFrame, evidence: DataFrame, links: DataFrame) -> DataFrame:
    """(kind, id, fault): repeated and blank items, evidence of no item, links of an item to itself or to nothing.

    ``items``: id, body; ``evidence``: id, item; ``links``: id, from_item, to_item.
    """
    ids = items.select("id").distinct()
    missing = lambda df, c: df.join(ids.select(F.col("id").alias(c)), c, "left_anti")
    found = {
        ("item", "repeated"): items.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"),
        ("item", "blank"): items.filter(F.trim(F.coalesce("body", F.lit(""))) == "").select("id").distinct(),
        ("evidence", "no item"): missing(evidence, "item"),
        ("link", "to itself"): links.filter("from_item = to_item"),
        ("link", "no item"): missing(links, "from_item").select("id").union(missing(links, "to_item").select("id")).distinct(),
    }
    rows = [df.select(F.lit(kind).alias("kind"), F.col("id").cast("string").alias("id"), F.lit(fault).alias("fault")) for (kind, fault), df in found.items()]
    return reduce(DataFrame.unionAll, rows)


def contract(expected: DataFrame, found: DataFrame) -> DataFrame:
    """(table, column, state): missing, extra or of another type, for (table, column, type) on both sides."""
    e, f = expected.withColumnRenamed("type", "e"), found.withColumnRenamed("type", "f")
    state = F.when(F.col("f").isNull(), "missing").when(F.col("e").isNull(), "extra").when(F.col("e") != F.col("f"), "changed")
    return e.join(f, ["table", "column"], "full_outer").select("table", "column", state.alias("state")).filter("state IS NOT NULL")


def sealed(manifest: DataFrame, producer: str) -> DataFrame:
    """One row (seal, n): the digest of a producer's manifest (path, sha256), in path order."""
    head = manifest.sparkSession.createDataFrame([("", producer)], "path string, sha256 string")
    whole = digests(head.unionAll(manifest.select("path", "sha256")), [], ["path"], F.concat_ws(":", "path", "sha256"))
    return whole.select(F.col("digest").alias("seal"), (F.col("n") - 1).alias("n"))


def manifest_states(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """(path, state) of a captured manifest against files as they are: same, changed, missing or new."""
    m, f = manifest.select("path", F.col("sha256").alias("m")), files.select("path", F.col("sha256").alias("f"))
    state = F.when(F.col("f").isNull(), "missing").when(F.col("m").isNull(), "new").when(F.col("m") == F.col("f"), "same").otherwise("changed")
    return m.join(f, "path", "full_outer").select("path", state.alias("state"))


def adoption(tables: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """(name, n_rows, n_keys, healthy) of adopted tables with their keys: healthy where the key is there and unique."""
    rows = []
    for name, (df, key) in tables.items():
        sound = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in key])
        facts = df.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct(F.struct(*key)).alias("n_keys"), F.count_if(~sound).alias("lost"))
        rows.append(facts.select(F.lit(name).alias("name"), "n_rows", "n_keys", ((F.col("lost") == 0) & (F.col("n_keys") == F.col("n_rows"))).alias("healthy")))
    return reduce(DataFrame.unionAll, rows)
