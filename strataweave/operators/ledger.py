"""Append-only ledgers and their projections, in batch form; ``streaming`` has the same over streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def idempotent(events: DataFrame, key: str, body: str) -> DataFrame:
    """One row for each key; raises when a key comes with two bodies."""
    kinds = events.groupBy(key).agg(F.count_distinct(body).alias("_n"), F.min(body).alias(body))
    sound = F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit("changed body of "), F.col(key).cast("string")))).otherwise(F.col(body))
    return kinds.select(key, sound.alias(body))


def paired(events: DataFrame, owner: str, order: str, begin, end) -> DataFrame:
    """(owner, begin, end): each beginning with the next end of its owner, if that comes before another beginning."""
    w = Window.partitionBy(owner).orderBy(order)
    only = events.filter(begin | end).select(owner, F.col(order).alias("begin"), begin.alias("_b"), end.alias("_e"))
    w = Window.partitionBy(owner).orderBy("begin")
    nxt = only.withColumn("_next", F.lead("begin").over(w)).withColumn("_is_end", F.lead("_e").over(w))
    return nxt.filter("_b").select(owner, "begin", F.when(F.col("_is_end"), F.col("_next")).alias("end"))


def liveness(beats: DataFrame, observer: str, ts: str, limit_s: int) -> DataFrame:
    """(observer, beats, gaps, last): a gap is over ``limit_s`` seconds without a beat."""
    w = Window.partitionBy(observer).orderBy(ts)
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    gap = micros - F.lag(micros).over(w)
    return beats.withColumn("_gap", gap > limit_s * 1_000_000).groupBy(observer).agg(
        F.count(F.lit(1)).alias("beats"), F.sum(F.coalesce(F.col("_gap").cast("int"), F.lit(0))).alias("gaps"), F.max(ts).alias("last")
    )


def settled(operations: DataFrame, settlements: DataFrame, executions: DataFrame) -> DataFrame:
    """Operations with what settled or executed them, if anything."""
    joined = operations.join(settlements, "id", "left").join(executions, "id", "left")
    return joined.withColumn("state", F.coalesce("settled", "executed", F.lit("pending")))


def budget_totals(attempts: DataFrame, status: str, reserved: str) -> DataFrame:
    return attempts.groupBy(status).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(reserved), F.lit(0)).alias("reserved")).orderBy(status)


def delta_page(rows: DataFrame, known: DataFrame, key: str, size: str, limit: int, most: int) -> DataFrame:
    """What a peer lacks, in key order, up to ``limit`` rows and ``most`` bytes."""
    lacking = rows.join(known.select(key), key, "left_anti").orderBy(key).limit(limit)
    used = F.sum(size).over(Window.orderBy(key).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return lacking.withColumn("used", used).filter(F.col("used") <= most)


def served_then_read(served: DataFrame, reads: DataFrame, key: str, minutes: int) -> DataFrame:
    """Reads that a serving of the same key preceded by ``minutes`` at most."""
    s, r = served.select(key, F.col("ts").alias("s_ts")), reads
    near = (F.col("s_ts") <= F.col("ts")) & (F.col("s_ts") >= F.col("ts") - F.expr(f"INTERVAL {minutes} MINUTES"))
    return r.join(s, (r[key] == s[key]) & near, "left_semi")


def lease_states(claims: DataFrame, now: str, ttl_s: int) -> DataFrame:
    """(task, holder, generation, live) from claims (task, holder, generation, ts): the highest generation holds it."""
    top = claims.groupBy("task").agg(F.max_by("holder", F.struct("generation", "ts")).alias("holder"), F.max("generation").alias("generation"), F.max("ts").alias("ts"))
    return top.select("task", "holder", "generation", (F.col("ts") >= F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {ttl_s} SECONDS")).alias("live"))
