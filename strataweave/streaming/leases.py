"""Task leases as a state machine over a stream, with timers for what nobody touches any more.

A pending task can be claimed; its holder can renew the lease by heartbeats; a lease that ran out can be
reclaimed by anyone. Each claim and reclaim raises the generation, so that a stale holder's late results can be told
from newer ones. Everything else is refused. A lease that runs out is told once, as ``expired`` at the moment it did: when the
next action of its task comes, or by a timer as soon as the watermark passes.

Actions (task, us, seq, action, worker, ts) of a batch are taken in order of ``us``, then ``seq``, so a task's actions of
one batch are held together; batches must come in order of time, within the watermark's delay, and later than the epoch. Null tasks or actions are refused without a state.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..session import shared_path

VERDICT = "task string, us long, action string, worker string, accepted boolean, generation long"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def decided(action: str | None, worker: str | None, us: int, holder: str | None, until: int) -> bool:
    """Whether an action is accepted; no holder means that the task is pending."""
    if worker is None:
        return False
    if action == "claim":
        return holder is None
    if action == "heartbeat":
        return holder == worker
    return action == "reclaim" and holder is not None and us >= until


class LeaseMachine(StatefulProcessor):
    def __init__(self, ttl_us: int):
        self.ttl_us = ttl_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.lease = handle.getValueState("lease", "holder string, generation long, until long, told boolean")

    def _rows(self, out: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(out, columns=[x.split()[0] for x in VERDICT.split(", ")])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        holder, generation, until, told = self.lease.get() if self.lease.exists() else (None, 0, 0, True)
        before, out = until, []
        for r in pd.concat(list(rows)).sort_values(["us", "seq"]).itertuples():
            us = int(r.us)
            if not told and us >= until:
                out.append((key[0], until, "expired", holder, True, generation))
                told = True
            worker = None if pd.isna(r.worker) else r.worker
            accepted = decided(r.action, worker, us, holder, until)
            if accepted:
                generation += r.action != "heartbeat"
                holder, until, told = worker, us + self.ttl_us, False
            out.append((key[0], us, r.action, worker, accepted, generation))
        self.lease.update((holder, generation, until, told))
        if until != before:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
        if not told:
            self.handle.registerTimer(-(-until // 1000))
        yield self._rows(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        holder, generation, until, told = self.lease.get()
        if told or -(-until // 1000) > expiredTimerInfo.getExpiryTimeInMs():
            yield self._rows([])
            return
        self.lease.update((holder, generation, until, True))
        yield self._rows([(key[0], until, "expired", holder, True, generation)])

    def close(self) -> None:
        pass


def leases(actions: DataFrame, ttl_us: int, late: str) -> DataFrame:
    """Verdicts on a stream of actions."""
    return actions.withWatermark("ts", late).groupBy("task").transformWithStateInPandas(LeaseMachine(ttl_us), VERDICT, "Append", "EventTime")


def run_leases(spark: SparkSession, batches: list[DataFrame], ttl_us: int, late: str) -> DataFrame:
    """Verdicts on batches of actions, one after another: each is written for the stream, which goes on from its checkpoint."""
    root, before = shared_path(spark, "leases"), spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        for batch in batches:
            batch.write.mode("append").parquet(f"{root}/in")
            stream = spark.readStream.schema(batch.schema).parquet(f"{root}/in")
            writer = leases(stream, ttl_us, late).writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state")
            writer.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)
    return spark.read.schema(VERDICT).parquet(f"{root}/out")
