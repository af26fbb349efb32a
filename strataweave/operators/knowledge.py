"""Session knowledge: candidates, typed decisions, lifecycle, reconciliation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def eligible_lines(messages: DataFrame, least: int = 24, most: int = 1200) -> DataFrame:
    """(conv_id, turn, role, line_no, line): lines of a fitting size in UTF-8 bytes."""
    lines = messages.select("conv_id", "turn", "role", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return lines.filter(F.octet_length("line").between(least, most))


def candidate_page(lines: DataFrame, skip: int, limit: int) -> DataFrame:
    """Lines in conversation order from ``skip`` on, ``limit`` at most for each conversation, with what is left."""
    order = Window.partitionBy("conv_id").orderBy("turn", "line_no")
    numbered = lines.withColumn("n", F.row_number().over(order) - 1).withColumn("total", F.count(F.lit(1)).over(Window.partitionBy("conv_id")))
    return numbered.filter((F.col("n") >= skip) & (F.col("n") < skip + limit)).withColumn("has_more", F.col("total") > skip + limit)


def context_lines(lines: DataFrame, reach: int = 2) -> DataFrame:
    """Each line with those around it, joined by line feeds."""
    around = Window.partitionBy("conv_id").orderBy("turn", "line_no").rowsBetween(-reach, reach)
    return lines.withColumn("context", F.array_join(F.collect_list("line").over(around), "\n"))


def disposition(admit: Column, novelty: Column, duplicate: Column, contradiction: Column, supersession: Column) -> Column:
    """Outcome of a candidate from typed answers in [0, 1]; abstention comes first."""
    strong = lambda c: c >= 0.95
    return (
        F.when(admit.isNull() | novelty.isNull(), "abstained")
        .when(admit <= 0.1, "rejected")
        .when(admit < 0.9, "abstained")
        .when(strong(supersession), "supersession")
        .when(strong(contradiction), "contradiction")
        .when(strong(duplicate), "duplicate")
        .when((duplicate <= 0.1) & (contradiction <= 0.1) & (novelty >= 0.9), "admitted")
        .otherwise("abstained")
    )


def materialized(probability: Column, structural: Column, accept: float = 0.9, reject: float = 0.1) -> Column:
    """Evidence class of a decided relation: abstain in between; structure upgrades to extracted."""
    return F.when(probability.isNull(), "abstain").when(probability >= accept, F.when(structural, "extracted").otherwise("inferred")).when(probability <= reject, "rejected").otherwise("abstain")


def choice_floor(label: Column, confidence: Column, floor: float = 0.8) -> Column:
    return F.when(confidence >= floor, label).otherwise("unknown")


def latest_status(receipts: DataFrame) -> DataFrame:
    """(item, status): superseded if any receipt says so, else what the newest receipt says."""
    newest = F.max_by("status", F.struct("seq", "status"))
    gone = F.max((F.col("status") == "superseded").cast("int")) == 1
    return receipts.groupBy("item").agg(F.when(gone, "superseded").otherwise(newest).alias("status"))


def first_write_wins(rows: DataFrame, key: str, order: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy(order)
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def unanimous(answers: DataFrame) -> DataFrame:
    """(a, b, action): the action that all receipts of a pair agree on, else abstain."""
    kinds = answers.groupBy("a", "b").agg(F.count_distinct("action").alias("n"), F.min("action").alias("only"))
    return kinds.select("a", "b", F.when(F.col("n") == 1, F.col("only")).otherwise("abstain").alias("action"))


def kept_for_continuation(messages: DataFrame) -> DataFrame:
    """All but assistant text judged irrelevant with confidence and without tools."""
    return messages.filter(~((F.col("role") == "assistant") & (F.col("irrelevant") >= 0.95) & ~F.col("has_tool")))


def packed(rows: DataFrame, group: str, order: str, size: str, opens: Callable[[int, int], bool]) -> DataFrame:
    """(group, order, chunk): an ordered fold of each group that opens a new chunk where ``opens(used, size)`` says so.

    Rows stream through in order; what a task holds is the running size of one chunk.
    """
    picked = rows.select(group, F.col(order).cast("long").alias(order), F.col(size).cast("long").alias("_size"))
    dealt = picked.repartition(group).sortWithinPartitions(group, order)

    def run(batches):
        import pyarrow as pa

        now, used, chunk = object(), 0, 0
        for batch in batches:
            chunks = []
            for key, n in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if key != now:
                    now, used, chunk = key, 0, 0
                elif opens(used, n):
                    used, chunk = 0, chunk + 1
                used += n
                chunks.append(chunk)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(chunks, pa.int32())], names=[group, order, "chunk"])

    return dealt.mapInArrow(run, f"`{group}` {picked.schema[group].dataType.simpleString()}, `{order}` long, chunk int")


def greedy_chunks(rows: DataFrame, group: str, order: str, size: str, cap: int) -> DataFrame:
    """Consecutive rows of a group packed greedily up to ``cap``; a row that alone exceeds it is a chunk of its own."""
    return packed(rows, group, order, size, lambda used, n: used > 0 and used + n > cap)


def rotation(entries: DataFrame, ledger: str, order: str, size: str, most: int) -> DataFrame:
    """The file (0, 1, ...) that each entry of a ledger is appended to; a file that holds ``most`` bytes is closed."""
    return packed(entries, ledger, order, size, lambda used, n: used >= most)


def merged_intervals(rows: DataFrame, group: str, start: str, end: str) -> DataFrame:
    """Gaps and islands: (group, start, end) of touching intervals joined."""
    w = Window.partitionBy(group).orderBy(start, end)
    before = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = rows.withColumn("_new", F.when(before.isNull() | (F.col(start) > before), 1).otherwise(0)).withColumn("_island", F.sum("_new").over(w))
    return marked.groupBy(group, "_island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_island")


def evenly_spaced(rows: DataFrame, group: str, order: str, n: int) -> DataFrame:
    """``n`` rows of each group spread over its order, first and last included."""
    by = Window.partitionBy(group)
    numbered = rows.withColumn("_i", F.row_number().over(by.orderBy(order)) - 1).withColumn("_m", F.count(F.lit(1)).over(by))
    places = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.bround(k * (F.col("_m") - 1) / max(1, n - 1)).cast("long"))
    return numbered.filter((F.col("_m") <= n) | F.array_contains(places, F.col("_i").cast("long"))).drop("_i", "_m")


def round_robin(rows: DataFrame, stratum: str, order: str, n: int) -> DataFrame:
    """The first ``n`` rows taking one of each stratum in turn."""
    turn = F.row_number().over(Window.partitionBy(stratum).orderBy(order))
    return rows.withColumn("turn", turn).orderBy("turn", stratum).limit(n)
