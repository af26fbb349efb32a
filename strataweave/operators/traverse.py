"""Level-synchronous traversals: one join a level, never a row-by-row walk.

Every loop cuts its lineage with a written table, so levels don't pile up in the plan and a lost
executor only costs the level at hand.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import settle


def cut(df: DataFrame) -> DataFrame:
    """A written table in the folder that the executors share."""
    return settle(df, "level")


def reachable(edges: DataFrame, start: str, hops: int, directed: bool = False) -> DataFrame:
    """(entity_id, depth) of everything within ``hops`` of ``start``, itself at 0.

    A level joins the edges with its front alone; the graph is neither copied nor cached.
    """
    ways = [("from_id", "to_id")] if directed else [("from_id", "to_id"), ("to_id", "from_id")]
    seen = edges.sparkSession.createDataFrame([(start, 0)], "entity_id string, depth int")
    front = seen
    for depth in range(1, hops + 1):
        steps = [edges.join(front.select(F.col("entity_id").alias(a)), a, "left_semi").select(F.col(b).alias("entity_id")) for a, b in ways]
        step = reduce(DataFrame.unionAll, steps).distinct()
        front = cut(step.join(seen, "entity_id", "left_anti").withColumn("depth", F.lit(depth)))
        if not front.take(1):
            break
        seen = cut(seen.unionAll(front))
    return seen


def shortest_path(edges: DataFrame, start: str, goal: str, hops: int = 4) -> DataFrame:
    """(step, entity_id) along one shortest undirected path; no rows if none within ``hops``.

    Ties: a node is reached from the earliest found parent, over an outgoing relation before an
    incoming one, then by relation id.
    """
    spark = edges.sparkSession
    a, b, r = F.col("from_id"), F.col("to_id"), F.col("rel_id")
    near = edges.select(a.alias("a"), b.alias("b"), F.lit(0).alias("way"), r.alias("r"))
    near = near.unionAll(edges.select(b.alias("a"), a.alias("b"), F.lit(1).alias("way"), r.alias("r"))).cache()
    # ``ord`` lists the steps taken; at one level, lists compare as the order of discovery does.
    seen = spark.createDataFrame([(start, [start], [])], "id string, path array<string>, ord array<string>")
    front, hit = seen, start == goal
    for _ in range(0 if hit else hops):
        via = near.join(front.select(F.col("id").alias("a"), "path", "ord"), "a")
        new = via.join(seen.select(F.col("id").alias("b")), "b", "left_anti")
        step = F.concat("ord", F.array(F.concat(F.col("way").cast("string"), "r")))
        first = Window.partitionBy("b").orderBy("ord")
        best = new.withColumn("ord", step).withColumn("_n", F.row_number().over(first)).filter("_n = 1")
        front = cut(best.select(F.col("b").alias("id"), F.concat("path", F.array("b")).alias("path"), "ord"))
        if front.filter(F.col("id") == goal).take(1):
            hit = True
            seen = front
            break
        if not front.take(1):
            break
        seen = cut(seen.unionAll(front))
    near.unpersist()
    found = seen.filter(F.col("id") == goal) if hit else seen.filter(F.lit(False))
    return found.select(F.posexplode("path").alias("step", "entity_id"))


def connected(pairs: DataFrame) -> DataFrame:
    """(node, label): the smallest node of each connected component of (a, b)."""
    both = cut(pairs.select("a", "b").unionAll(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    label = cut(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "node"))
    while True:
        near = both.join(label.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("label").alias("near"))
        step = label.join(near, label.node == near.a).select("node", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        step = cut(step)
        jump = step.select(F.col("node").alias("label"), F.col("label").alias("far"))
        moved = cut(step.join(jump, "label", "left").select("node", "was", F.least("label", F.coalesce("far", "label")).alias("label")))
        label = moved.select("node", "label")
        if not moved.filter("was <> label").take(1):
            return label


def cycle_members(links: DataFrame) -> DataFrame:
    """(id) of everything on a cycle of single links (id, to); self-links are cycles, null or missing targets end a chain.

    Each round doubles the step: what some id leads to in 2, 4, 8... steps. That set shrinks to the cycles and
    then stays; it is done when it no longer shrinks, after about the logarithm of the longest chain. Of several links of an id the smallest counts.
    """
    step = cut(links.filter("id IS NOT NULL AND to IS NOT NULL").groupBy("id").agg(F.min("to").alias("to")))
    image = step.select("to").distinct().count()
    while True:
        after = step.select(F.col("id").alias("to"), F.col("to").alias("far"))
        step = cut(step.join(after, "to").select("id", F.col("far").alias("to")))
        now = step.select("to").distinct().count()
        if now == image:
            return step.select(F.col("to").alias("id")).distinct()
        image = now


def dag_heads(events: DataFrame) -> DataFrame:
    """Events that no other event names as a parent. ``events``: id, parents."""
    parents = events.select(F.explode("parents").alias("id")).distinct()
    return events.join(parents, "id", "left_anti").select("id")


def topological_levels(events: DataFrame) -> DataFrame:
    """(id, level) of the events whose ancestors are all present; others are missing or cyclic."""
    links = cut(events.select("id", F.explode("parents").alias("parent")).distinct())
    waiting = cut(events.select("id"))
    done = waiting.filter(F.lit(False)).withColumn("level", F.lit(0))
    level = 0
    while True:
        blocked = links.join(done.select(F.col("id").alias("parent")), "parent", "left_anti").select("id").distinct()
        ready = cut(waiting.join(blocked, "id", "left_anti").withColumn("level", F.lit(level)))
        if not ready.take(1):
            return done
        done = cut(done.unionAll(ready))
        waiting = cut(waiting.join(ready, "id", "left_anti"))
        level += 1


def chain_depths(links: DataFrame) -> DataFrame:
    """(id, head, depth) of supersession chains by pointer jumping; ``links``: id, previous (null: head)."""
    rows = cut(links.select("id", F.coalesce("previous", "id").alias("head"), F.when(F.col("previous").isNull(), 0).otherwise(1).alias("depth")))
    while True:
        up = rows.select(F.col("id").alias("head"), F.col("head").alias("far"), F.col("depth").alias("more"))
        next_rows = rows.join(up, "head", "left").select("id", F.coalesce("far", "head").alias("new"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), "head")
        next_rows = cut(next_rows)
        moved = next_rows.filter("new <> head").take(1)
        rows = next_rows.select("id", F.col("new").alias("head"), "depth")
        if not moved:
            return rows
