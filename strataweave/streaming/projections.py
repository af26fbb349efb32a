"""Streams over the event ledger: idempotent append, invocation pairing, change watching.

Each stream reads files, keeps its state keyed by owner or event, and runs with
``availableNow`` to the end of what is there, or continuously with another trigger.
Checkpoints and results live in the folder that the cluster shares.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..session import settle, shared_path


def source(spark: SparkSession, path: str) -> DataFrame:
    """A file stream with the schema that the files have; event times as instants."""
    table = spark.read.parquet(path)
    stream = spark.readStream.schema(table.schema)
    folder, _, name = path.rstrip("/").rpartition("/")
    if any(f.endswith(f"/{name}") for f in table.inputFiles()):  # one file: a stream reads its folder
        rows = stream.option("pathGlobFilter", name).parquet(folder)
    else:
        rows = stream.parquet(path)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def _finish(writer) -> None:
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()


def idempotent_ledger(events: DataFrame, key: str, ts: str, late: str) -> DataFrame:
    """The first row of each key; state older than the watermark is dropped."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def run_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = source(spark, f"{sf_dir}/events.parquet")
    twice = events.select("*", F.explode(F.when(F.col("event_id") % 2 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")).drop("copy")
    out = shared_path(spark, "ledger")
    kept = idempotent_ledger(twice, "event_id", "ts", "60 days")
    _finish(kept.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-state"))
    return spark.read.parquet(out)


def pair_invocations(begin: str, end: str) -> Callable:
    """Stateful pairing for one owner: an end settles the open beginning once."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (open_at, begun, settled) = state.get if state.exists else (None, 0, 0)
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        for ts, kind in zip(rows["us"], rows["event_type"]):
            if kind == begin:
                open_at, begun = int(ts), begun + 1
            elif kind == end and open_at is not None:
                open_at, settled = None, settled + 1
        state.update((open_at, begun, settled))
        yield pd.DataFrame({"user_id": [key[0]], "begun": [begun], "settled": [settled]})

    return run


def run_invocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, begun, settled) after the whole stream."""
    events = source(spark, f"{sf_dir}/events.parquet").withColumn("us", F.unix_micros("ts"))
    out = shared_path(spark, "invocations")
    paired = events.groupBy("user_id").applyInPandasWithState(
        pair_invocations("signup", "purchase"), "user_id long, begun long, settled long", "open_at long, begun long, settled long", "update", GroupStateTimeout.NoTimeout
    )

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("append").parquet(out)

    _finish(paired.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{out}-state"))
    rows = spark.read.parquet(out)
    newest = rows.groupBy("user_id").agg(F.max_by(F.struct("begun", "settled"), "batch").alias("s"))
    return newest.select("user_id", "s.begun", "s.settled")


def watch(spark: SparkSession, path: str, schema: str, handle: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True):
    """Calls ``handle`` with the new or changed text files of a folder; each version is handled once."""
    files = spark.readStream.schema(schema).text(path, wholetext=True)
    writer = files.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime="2 seconds")
    return writer.start()


def ready_events(events: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Out-of-order causal events (id, parents) split into those all of whose ancestors are there, and the staged rest.

    An event waits for a parent that is missing and for one that waits itself.
    """
    links = settle(events.select("id", F.explode("parents").alias("p")).distinct(), "causal-links")
    have = known.select(F.col("id").alias("p")).union(events.select("id")).distinct()
    waits = settle(links.join(have, "p", "left_anti").select("id").distinct(), "causal-waits")
    while True:
        held = links.join(waits.select(F.col("id").alias("p")), "p", "left_semi").select("id").distinct()
        more = settle(held.join(waits, "id", "left_anti"), "causal-more")
        if not more.take(1):
            break
        waits = settle(waits.union(more), "causal-waits")
    return events.join(waits, "id", "left_anti"), events.join(waits, "id", "left_semi")
