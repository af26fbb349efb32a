"""Ordered folds with budgets: greedy selections that go on behind what doesn't fit, chunks, and trimmed lists with their totals.

Whether an item fits depends on all that were taken before it, so a running sum can't tell. Rows are dealt out by
their keys and sorted; a task streams through them and holds the state of one key. Without keys all rows are
one sequence and the work of one task, whose state is still a few numbers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def folded(rows: DataFrame, keys: list[str], order: list, inputs: list[str], outputs: str, start: Callable[[], object], step: Callable) -> DataFrame:
    """``rows`` with the columns ``outputs`` (a schema): ``step(state, *inputs)`` gives them and changes the state, anew for each key."""
    added = rows.sparkSession.createDataFrame([], outputs).schema
    schema = StructType(rows.schema.fields + added.fields)
    names, places = rows.columns, [rows.columns.index(c) for c in [*keys, *inputs]]
    width = len(keys)
    dealt = rows.repartition(*keys) if keys else rows.repartition(1)
    dealt = dealt.sortWithinPartitions(*keys, *order)

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds = [f.type for f in to_arrow_schema(added)]
        now, state = object(), None
        for batch in batches:
            out: list[list] = [[] for _ in kinds]
            for row in zip(*(batch.column(i).to_pylist() for i in places)) if places else [()] * batch.num_rows:
                if row[:width] != now:
                    now, state = row[:width], start()
                for column, value in zip(out, step(state, *row[width:])):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, k) for c, k in zip(out, kinds))], names=[*names, *added.names])

    return dealt.mapInArrow(run, schema)


def fitting(rows: DataFrame, keys: list[str], order: list, size: str, budget: int, most: int | None = None) -> DataFrame:
    """``rows`` with ``fits`` and ``used``: an item is taken if it fits into what is left of the budget, else skipped; ``most`` items at most.

    A null size is none. ``used`` is what was used up to and with the row.
    """
    sized = rows.withColumn("_size", F.coalesce(F.col(size).cast("long"), F.lit(0).cast("long")))

    def step(state: list[int], n: int) -> tuple[bool, int]:
        fits = state[0] + n <= budget and (most is None or state[1] < most)
        if fits:
            state[0] += n
            state[1] += 1
        return fits, state[0]

    return folded(sized, keys, order, ["_size"], "fits boolean, used long", lambda: [0, 0], step).drop("_size")


def chunked(rows: DataFrame, keys: list[str], order: list, size: str, budget: int, most: int) -> DataFrame:
    """``rows`` with ``chunk``: a new one begins where an item would exceed the budget or ``most`` items; an oversize item is alone."""
    sized = rows.withColumn("_size", F.coalesce(F.col(size).cast("long"), F.lit(0).cast("long")))

    def step(state: list[int], n: int) -> tuple[int]:
        if state[1] and (state[0] + n > budget or state[1] == most):
            state[0], state[1], state[2] = 0, 0, state[2] + 1
        state[0] += n
        state[1] += 1
        return (state[2],)

    return folded(sized, keys, order, ["_size"], "chunk int", lambda: [0, 0, 0], step).drop("_size")


def interleaved(rows: DataFrame, provider: str, position: list, size: str, budget: int, limit: int) -> DataFrame:
    """Round-robin over providers by the place within each, skipping what doesn't fit, ``limit`` rows at most; with ``used``.

    At most ``limit`` places of each provider can be reached by ``limit`` rows only if all fit, so every row
    is in the sequence.
    """
    place = rows.withColumn("place", F.row_number().over(Window.partitionBy(provider).orderBy(*position)) - 1)
    return fitting(place, [], ["place", provider], size, budget, limit).filter("fits").drop("fits")


def trimmed(rows: DataFrame, group: list[str], lists: str, order: list, size: str, budget: int) -> DataFrame:
    """Rows of several named lists within a budget for each group: the last row of the longest list goes until the rest fits.

    Gives the rows that stay with ``shown`` and ``total`` of their list, and ``next_after``: the number of the list's last row
    shown, from which a rebuilt cursor goes on; null where nothing was omitted. Of equally long lists the one with the greater name loses first.
    """
    numbered = rows.withColumn("number", F.row_number().over(Window.partitionBy(*group, lists).orderBy(*order)))
    per = Window.partitionBy(*group, lists)
    numbered = numbered.withColumn("total", F.count(F.lit(1)).over(per))
    # The longest list loses its last row again and again: rows go by falling number, of equal ones by falling name.
    whole = Window.partitionBy(*group).orderBy("number", lists).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    kept = numbered.withColumn("_used", F.sum(F.coalesce(F.col(size).cast("long"), F.lit(0).cast("long"))).over(whole)).filter(F.col("_used") <= budget).drop("_used")
    shown = F.count(F.lit(1)).over(per)
    kept = kept.withColumn("shown", shown)
    return kept.withColumn("next_after", F.when(F.col("shown") < F.col("total"), F.col("shown")))
