"""Line dedup over levelled sorted runs of line hashes.

A line's key is the line without ASCII white space at both ends, A-Z lower-cased. A key of at least
``LEAST_CHARS`` code points that ``LEAST_DOCS`` documents or more hold loses all its lines except those
of the largest doc_id that holds it.

Keys are known by two 64-bit hashes. Documents come in batches. A run is a table sorted and bucketed
by key, one row a key: in how many documents a batch holds it and the largest of them. A new batch is
merge-anti-joined with each run: keys that a run already has in enough documents, none of them smaller
than the batch's, need no more entries, so a very frequent line stops to grow the runs. What is left
is the batch's own run on level 0. Whenever a level holds ``FANOUT`` runs they are compacted into one run of
the next level, so that runs stay few and a key is rewritten once a level. Buckets of runs and
batches match, so the merge joins move nothing.

Only built-in expressions run. A key is aggregated for each document before it meets its other documents, and
in each task before it moves, so that one line in a third of all documents is no hot spot; lines
find their verdicts by a broadcast of a counted size, or beyond it by a join that adaptive
execution can split.

Null or empty texts are one empty line and lose nothing. Rows with a null doc_id lose no line and
count for nothing. Rows that share a doc_id are one document to the counts and keep their own lines;
repeated rows give repeated results. Further columns pass through, whatever their names. An empty
table gives no rows.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lower_ascii, read, settle, shared_path
from .decontaminate import sized

LEAST_CHARS, LEAST_DOCS = 40, 5
#: Batches that a table is dealt into, and runs on a level before they are compacted.
BATCHES, FANOUT = 6, 3
#: Lines of a batch for each bucket of its run.
BUCKET_LINES = 1 << 19
KEY = ["k1", "k2"]


def line_key(line: Column) -> Column:
    """The line stripped and lower-cased; pure ASCII lines go by the engine's faster function."""
    bare = F.btrim(line, F.lit(" \t\n\x0b\x0c\r"))
    return F.when(F.octet_length(bare) == F.length(bare), F.lower(bare)).otherwise(lower_ascii(bare))


def keyed_lines(docs: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """(doc_id, text_id, pos, k1, k2) of each line long enough; ``text_id`` is xxhash64 of the text."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id IS NOT NULL AND text IS NOT NULL")
    lines = rows.select("doc_id", F.xxhash64("text").alias("text_id"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    bare = F.btrim("line", F.lit(" \t\n\x0b\x0c\r"))
    keys = lines.filter(F.length(bare) >= least_chars).withColumn("key", line_key(F.col("line")))
    return keys.select("doc_id", "text_id", "pos", F.xxhash64("key").alias("k1"), F.xxhash64(F.lit(1), "key").alias("k2"))


class LineRuns:
    """The levels: ``add`` takes a batch in, ``found`` tells the keys that enough documents hold."""

    def __init__(self, spark: SparkSession, expected: int, least_docs: int = LEAST_DOCS, fanout: int = FANOUT):
        """``expected``: about how many lines a batch has, which sizes the buckets and nothing else."""
        self.spark, self.least_docs, self.fanout = spark, least_docs, fanout
        self.buckets = max(2, -(-expected // BUCKET_LINES))
        self.levels: list[list[str]] = [[]]
        self.batches: set[str] = set()
        self._paths: dict[str, str] = {}

    def _write(self, keys: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        self._paths[name] = shared_path(self.spark, "line-run")
        keys.write.bucketBy(self.buckets, *KEY).sortBy(*KEY).option("path", self._paths[name]).saveAsTable(name)
        return name

    def _drop(self, names: list[str]) -> None:
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for name in names:
            self.spark.sql(f"DROP TABLE {name}")
            path = jvm.org.apache.hadoop.fs.Path(self._paths.pop(name))
            path.getFileSystem(conf).delete(path, True)

    def runs(self) -> list[str]:
        return [name for level in self.levels for name in level]

    def merged(self, names: list[str]) -> DataFrame:
        """One row a key. Runs are read as plain files: Spark 4.1 takes a union of bucketed tables for dealt out by key, but doesn't keep their buckets together."""
        every = reduce(DataFrame.unionAll, [self.spark.read.schema(self.spark.table(name).schema).parquet(self._paths[name]) for name in names])
        return every.groupBy(*KEY).agg(F.sum("n").alias("n"), F.max("last").alias("last")).repartition(self.buckets, *KEY)

    def add(self, lines: DataFrame, batch: str) -> None:
        """``lines``: doc_id, k1, k2. A batch of a name that was added before is ignored; a document belongs to one batch."""
        if batch in self.batches:
            return
        held = lines.groupBy(*KEY, "doc_id").agg(F.lit(1).alias("one"))
        keys = held.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("last")).repartition(self.buckets, *KEY)
        for name in self.runs():
            enough = self.spark.table(name).filter(F.col("n") >= self.least_docs).select(F.col("k1").alias("r1"), F.col("k2").alias("r2"), F.col("last").alias("seen"))
            keys = keys.join(enough.hint("merge"), (F.col("k1") == F.col("r1")) & (F.col("k2") == F.col("r2")) & (F.col("last") <= F.col("seen")), "left_anti")
        self.levels[0].append(self._write(keys))
        self.batches.add(batch)
        level = 0
        while len(self.levels[level]) >= self.fanout:
            full = self.levels[level]
            if level + 1 == len(self.levels):
                self.levels.append([])
            self.levels[level + 1].append(self._write(self.merged(full)))
            self.levels[level] = []
            self._drop(full)
            level += 1

    def found(self) -> DataFrame:
        """(k1, k2, n, last) of the keys in enough documents. ``n`` may leave out what came after enough was known."""
        return self.merged(self.runs()).filter(F.col("n") >= self.least_docs)

    def close(self) -> None:
        self._drop(self.runs())
        self.levels = [[]]


def repeated_lines(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """(doc_id, text_id, gone): the places of the lines that go, numbered from 0."""
    spark = docs.sparkSession
    dealt = keyed_lines(docs, least_chars).withColumn("batch", F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int"))
    path, schema = shared_path(spark, "line-keys"), dealt.schema
    dealt.hint("rebalance", "batch").write.partitionBy("batch").parquet(path)
    lines = spark.read.schema(schema).parquet(path)
    runs = LineRuns(spark, lines.count() // batches, least_docs, fanout)
    for batch in range(batches):
        runs.add(lines.filter(F.col("batch") == batch), str(batch))
    found = settle(runs.found().select(*KEY, "last"), "line-found")
    runs.close()
    gone = lines.join(sized(found, found.count()), KEY).filter("doc_id < last")
    return gone.groupBy("doc_id", "text_id").agg(F.collect_set("pos").alias("gone"))


def without_repeated_lines(docs: DataFrame, **limits: int) -> DataFrame:
    """Every row of ``docs`` as ``doc``, with ``kept`` (the lines that stay), ``n_lines`` and ``n_dropped``."""
    gone = settle(repeated_lines(docs, **limits), "line-gone").withColumnsRenamed({"doc_id": "d", "text_id": "t"})
    rows = docs.select(F.struct(*docs.columns).alias("doc"))
    text = F.coalesce(F.col("doc.text"), F.lit(""))
    joined = rows.join(gone, (F.col("doc.doc_id").cast("long") == F.col("d")) & (F.xxhash64("doc.text") == F.col("t")), "left")
    lines = F.split(text, "\n")
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    kept = F.when(F.col("gone").isNull(), text).otherwise(F.array_join(F.transform(stay, lambda i: F.get(F.col("lines"), i)), "\n"))
    return joined.withColumn("lines", lines).select(
        "doc", kept.alias("kept"), F.size("lines").cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped")
    )


def op13_line_dedup(spark, sf_dir: str) -> DataFrame:
    done = without_repeated_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc.doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))
