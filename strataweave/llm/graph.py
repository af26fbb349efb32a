"""Links within groups that may be large, and the components of links.

``block_links`` finds links between the members of each group so that they connect exactly
what all links of the group would connect, without listing all pairs. A group of more than
``block`` members is dealt to blocks; its heaviest member, the hub, joins each block. Within a
block every pair is tested. Members that a block doesn't connect with the hub (strays) are then
tested against every other block. What is connected with the hub needs no further test, so a
large group of copies costs rows in proportion to its size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle

EDGE = "stray boolean, g long, a long, b long"


def _forest(linked: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Component labels and a spanning forest of a symmetric boolean matrix."""
    n = len(linked)
    label = np.full(n, -1)
    edges = []
    for start in range(n):
        if label[start] >= 0:
            continue
        label[start] = start
        front = [start]
        while front:
            x = front.pop()
            for y in np.flatnonzero(linked[x] & (label < 0)):
                label[y] = start
                edges.append((x, int(y)))
                front.append(int(y))
    return label, edges


def _groups(batches) -> Iterator[tuple]:
    """(g, blk, node, role, payload list) of consecutive rows with one (g, blk)."""
    key, nodes, roles, loads = None, [], [], []
    for batch in batches:
        cols = [batch.column(i).to_pylist() for i in range(5)]
        for g, blk, node, role, load in zip(*cols):
            if (g, blk) != key:
                if len(nodes) > 1:
                    yield key[0], nodes, roles, loads
                key, nodes, roles, loads = (g, blk), [], [], []
            nodes.append(node)
            roles.append(role)
            loads.append(load)
    if len(nodes) > 1:
        yield key[0], nodes, roles, loads


def _tested(matrix: Callable[[list[bytes]], np.ndarray]):
    """role 0: a member, 1: the hub beside a block, 2: a stray beside a block that isn't its own."""

    def run(batches):
        import pyarrow as pa

        names = ["stray", "g", "a", "b"]
        kinds = [pa.bool_(), pa.int64(), pa.int64(), pa.int64()]
        out: list[tuple] = []

        def flush():
            cols = list(zip(*out)) or [[]] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)

        for g, nodes, roles, loads in _groups(batches):
            roles = np.array(roles)
            linked = matrix(loads)
            if (roles == 2).any():
                guest = roles == 2
                linked &= guest[:, None] | guest[None, :]
                out += [(False, g, nodes[x], nodes[y]) for x, y in _forest(linked)[1]]
            else:
                label, edges = _forest(linked)
                out += [(False, g, nodes[x], nodes[y]) for x, y in edges if nodes[x] != nodes[y]]
                if (hub := np.flatnonzero(roles == 1)).size:
                    home = label[hub[0]]
                    out += [(True, g, nodes[x], None) for x in np.flatnonzero((label != home) & (roles == 0))]
            if len(out) > 20_000:
                yield flush()
                out = []
        if out:
            yield flush()

    return run


def block_links(members: DataFrame, payloads: DataFrame, matrix, block: int, name: str) -> DataFrame:
    """Edges (a, b) that connect each group's members as all its links would.

    ``members``: g, node, weight (a settled table); ``payloads``: node, payload (settled).
    ``matrix(payloads)`` tells for all pairs of a list of payloads which are linked.
    """
    sizes = members.groupBy("g").agg(
        F.count(F.lit(1)).alias("n"), F.max_by("node", F.struct("weight", -F.col("node"))).alias("hub")
    )
    sizes = settle(sizes.filter("n > 1"), f"{name}-sizes")
    own = members.select("g", "node").join(sizes, "g")
    own = own.withColumn("k", F.ceil(F.col("n") / block).cast("int"))
    own = own.withColumn("blk", F.pmod(F.xxhash64("node"), F.col("k")).cast("int"))
    own = settle(own.select("g", "node", "k", "blk", "hub"), f"{name}-own")
    plain = own.select("g", "blk", "node", F.when((F.col("k") > 1) & (F.col("node") == F.col("hub")), -1).otherwise(0).alias("role"))
    large = sizes.filter(F.col("n") > block)
    has_large = bool(large.take(1))
    rows = plain.filter("role = 0")
    if has_large:
        hubs = large.select("g", F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / block).cast("int") - 1)).alias("blk"), F.col("hub").alias("node"))
        rows = rows.unionByName(hubs.withColumn("role", F.lit(1)))

    def tested(dealt: DataFrame) -> DataFrame:
        full = dealt.join(payloads, "node").select("g", "blk", "node", "role", "payload")
        return full.repartition("g", "blk").sortWithinPartitions("g", "blk", "role", "node").mapInArrow(_tested(matrix), EDGE)

    first = settle(tested(rows), f"{name}-first")
    edges = first.filter("NOT stray").select("a", "b")
    strays = first.filter("stray").select("g", F.col("a").alias("node"))
    if has_large and strays.take(1):
        ways = own.filter("k > 1").select("g", "node", "k", "blk").join(strays, ["g", "node"])
        away = ways.select("g", "node", "blk", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("at")).filter("at <> blk")
        there = own.filter("k > 1").join(strays.select("g").distinct(), "g", "left_semi").select("g", "blk", "node", F.lit(0).alias("role"))
        both = there.unionByName(away.select("g", F.col("at").alias("blk"), "node", F.lit(2).alias("role")))
        edges = edges.unionByName(tested(both).filter("NOT stray").select("a", "b"))
    return edges.filter("a <> b").distinct()


def components(edges: DataFrame, name: str) -> DataFrame:
    """(node, label): the smallest node that ``edges`` (a, b) reach from each node they name."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = settle(both, f"{name}-edges")
    label = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")).select(F.col("a").alias("node"), "label")
    label = settle(label, f"{name}-label")
    while True:
        near = both.join(label.select(F.col("node").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("near"))
        step = label.join(near, label.node == near.a).select("node", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        step = settle(step, f"{name}-step")
        jump = step.select(F.col("node").alias("label"), F.col("label").alias("far"))
        found = step.join(jump, "label").select("node", "was", F.least("label", "far").alias("label"))
        found = settle(found, f"{name}-label")
        label = found.select("node", "label")
        if not found.filter("was <> label").take(1):
            return label
