"""A worker's outbox: captures of a stream, assessed and published exactly once, whatever is repeated or interrupted.

Each step of a batch is a table of its own, named after the batch: ``captured/<batch>``, ``assessed/<batch>``,
``published/<batch>``. A step is written beside its place and renamed into it, so it is there whole or not at all, and a step
that is there is never done again. A batch that a restarted query repeats goes on behind its last finished step;
``drain`` does the same for batches that nothing repeats. What was captured before, in an earlier batch or
twice in one, is captured once, by its id.

A publication's number is that of its batch, and a batch is published only when all before it are: readers see a
prefix of the batches. Status is derived from what is there.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

STEPS = ("captured", "assessed", "published")


class Outbox:
    """``assess`` turns captures into assessments; both have the column ``id``."""

    def __init__(self, spark: SparkSession, root: str, assess: Callable[[DataFrame], DataFrame]):
        self.spark, self.root, self.assess = spark, root.rstrip("/"), assess
        #: For tests: called as (step, batch) when a step is about to be put in place.
        self.before: Callable[[str, int], None] = lambda step, batch: None

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def batches(self, step: str) -> list[int]:
        p, fs = self._fs(f"{self.root}/{step}")
        return sorted(int(s.getPath().getName()) for s in fs.listStatus(p) if s.getPath().getName().isdigit()) if fs.exists(p) else []

    def _put(self, step: str, batch: int, rows: DataFrame) -> None:
        beside = f"{self.root}/{step}/.{batch}-{uuid.uuid4().hex}"
        rows.write.parquet(beside)
        self.before(step, batch)
        source, fs = self._fs(beside)
        place, _ = self._fs(f"{self.root}/{step}/{batch}")
        if fs.exists(place) or not fs.rename(source, place):  # another worker was first with the same batch
            fs.delete(source, True)

    def read(self, step: str, batches: list[int] | None = None) -> DataFrame | None:
        """Rows of a step with their ``batch``; None where there are none yet."""
        there = self.batches(step)
        numbers = there if batches is None else [b for b in batches if b in there]
        out = None
        for part in [self.spark.read.parquet(f"{self.root}/{step}/{b}").withColumn("batch", F.lit(b).cast("long")) for b in numbers]:
            out = part if out is None else out.unionByName(part)
        return out

    def capture(self, rows: DataFrame, batch: int) -> None:
        """Takes a batch in; of rows with one id in a batch the first by all columns stays."""
        if batch in self.batches("captured"):
            return
        first = rows.filter("id IS NOT NULL").groupBy("id").agg(F.min(F.struct(*[c for c in rows.columns if c != "id"])).alias("r")).select("id", "r.*")
        known = self.read("captured", [b for b in self.batches("captured") if b < batch])
        self._put("captured", batch, first if known is None else first.join(known.select("id"), "id", "left_anti"))

    def drain(self) -> None:
        """Assesses and publishes what is pending, in order of batches."""
        captured, published = self.batches("captured"), set(self.batches("published"))
        for batch in captured:
            if batch not in self.batches("assessed"):
                self._put("assessed", batch, self.assess(self.spark.read.parquet(f"{self.root}/captured/{batch}")))
            if batch not in published:
                self._put("published", batch, self.spark.read.parquet(f"{self.root}/assessed/{batch}"))

    def handle(self, rows: DataFrame, batch: int) -> None:
        """For ``foreachBatch``."""
        self.capture(rows, batch)
        self.drain()

    def status(self) -> DataFrame:
        """(id, batch, status) of every capture."""
        captured = self.read("captured")
        if captured is None:
            return self.spark.createDataFrame([], "id string, batch long, status string")
        assessed, published = (self.spark.createDataFrame([(b,) for b in self.batches(s)], "batch long") for s in STEPS[1:])
        rows = captured.select("id", "batch").join(F.broadcast(assessed.withColumn("a", F.lit(True))), "batch", "left").join(F.broadcast(published.withColumn("p", F.lit(True))), "batch", "left")
        return rows.select("id", "batch", F.when(F.col("p"), "published").when(F.col("a"), "assessed").otherwise("captured").alias("status"))


def run_outbox(box: Outbox, folder: str, schema: StructType, files_a_batch: int = 1, pick: Callable[[DataFrame], DataFrame] = lambda df: df) -> None:
    """Streams Parquet files through the outbox to the end of what is there; can be called again after a failure."""
    stream = pick(box.spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(folder))
    query = stream.writeStream.foreachBatch(box.handle).option("checkpointLocation", f"{box.root}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
