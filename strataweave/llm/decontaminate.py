"""Benchmark decontamination: size-partitioned MinHash containment search.

A document is contaminated by an item when it holds at least ``THRESHOLD`` of the item's
distinct 5-word shingles (lower-cased words). An item of fewer words is one shingle of as many
words as it has, and documents are searched for that width too, so it is found inside long texts.

Whole-document sketches can't find a 20-shingle item in a 20,000-shingle text: the Jaccard
similarity there is 0.001. So only the short side, the items, is sketched. Items are
partitioned by size into powers of two; a partition with sizes up to ``u`` keeps the
``floor(u * (1 - threshold)) + 1`` smallest hashes of each item. An item may miss at most
``floor(size * (1 - threshold))`` of its shingles, so each true match hits its sketch at
least once: the search loses nothing. Documents' shingles are streamed past the sketches
(a hash join, no shuffle of texts), hits are counted for each document and item, and
candidates are verified by containment on full shingle sets, with a second hash beside the first
(128 bits in all).

Only built-in expressions run. Sketches and candidates are broadcast while their counted
rows stay under ``BROADCAST_ROWS``. Beyond that the same joins shuffle; a Bloom filter of the
sketches, built by the engine, then drops other shingles before they move, where it is enabled
(spark.sql.optimizer.runtime.bloomFilter.enabled, on by default).

Null or blank texts have no shingles: such items match nothing, such documents hold nothing.
Rows that share a doc_id count as one document, rows that share an item_id as one item (the
union of their shingles). Other columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import read, settle, words

WIDTH = 5
#: Least containment in hundredths.
THRESHOLD = 80
BROADCAST_ROWS = 1_000_000


def shingles(w: Column, widths: list[int], width: int = WIDTH, salt: int = 0) -> Column:
    """Hashes of an array of words' shingles, repeats included; below ``width`` words, of the whole sequence.

    ``widths``: narrower windows to add, those that short items need.
    """
    if not widths:
        many = F.transform(
            F.slice(w, width, F.greatest(F.size(w) - (width - 1), F.lit(0))),
            lambda last, i: F.xxhash64(F.lit(salt), *[F.get(w, i + k) for k in range(width - 1)], last),
        )
        one = F.when(F.size(w) > 0, F.array(F.xxhash64(F.lit(salt), F.concat_ws(" ", w)))).otherwise(F.array().cast("array<long>"))
        return F.when(F.size(w) >= width, many).otherwise(one)

    def narrow(k: int) -> Column:
        windows = F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - (k - 1), F.lit(1))), lambda i: F.xxhash64(F.lit(salt), F.concat_ws(" ", F.slice(w, i, F.lit(k)))))
        return F.when(F.size(w) > k, windows).otherwise(F.array().cast("array<long>"))

    short = [narrow(k) for k in widths]
    return F.concat(shingles(w, [], width, salt), *short)


def exploded(rows: DataFrame, key: str, widths: list[int], check: bool = False) -> DataFrame:
    """(key, shingle and maybe check) of every text, repeats included; ``check`` is a second hash."""
    listed = rows.select(key, words(F.lower("text")).alias("w"))
    if not check:
        return listed.select(key, F.explode(shingles(F.col("w"), widths)).alias("shingle"))
    both = F.arrays_zip(shingles(F.col("w"), widths).alias("shingle"), shingles(F.col("w"), widths, salt=1).alias("check"))
    return listed.select(key, F.explode(both).alias("s")).select(key, "s.shingle", "s.check")


def widths_of(items: DataFrame, width: int = WIDTH) -> list[int]:
    """The numbers of words below ``width`` that items have: a handful at most."""
    n = F.size(words("text"))
    return sorted(r.n for r in items.select(n.alias("n")).filter(F.col("n").between(1, width - 1)).distinct().collect())


def sized(df: DataFrame, rows: int, most: int = BROADCAST_ROWS) -> DataFrame:
    return F.broadcast(df) if rows <= most else df


def sketches(items: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """``items``: item_id, shingle, n. Keeps the smallest hashes that the item's size partition asks for."""
    top = F.pow(F.lit(2.0), F.ceil(F.log2(F.col("n").cast("double")))).cast("long")
    keep = F.floor(top * (100 - threshold) / 100) + 1
    need = F.greatest(F.least(F.col("n"), F.col("keep")) - F.floor(F.col("n") * (100 - threshold) / 100), F.lit(1))
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("item_id").orderBy("shingle"))
    return items.withColumn("keep", keep).withColumn("rank", rank).filter("rank <= keep").select("item_id", "shingle", need.alias("need"))


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Pairs (doc_id, item_id) with n_item_shingles, n_shared and containment."""
    widths = widths_of(benchmark)
    sets = exploded(benchmark.select("item_id", "text"), "item_id", [], check=True).distinct()
    size = sets.groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))
    items = settle(sets.join(size, "item_id"), "bench-items")
    n_items = items.count()
    texts = docs.select("doc_id", "text")

    near = (
        exploded(texts, "doc_id", widths)
        .join(sized(sketches(items, threshold), n_items), "shingle")
        .groupBy("doc_id", "item_id", "need", "shingle")
        .agg(F.lit(1).alias("one"))
        .groupBy("doc_id", "item_id", "need")
        .agg(F.count(F.lit(1)).alias("hits"))
        .filter("hits >= need")
        .select("doc_id", "item_id")
    )
    near = settle(near, "bench-near")
    n_near = near.count()

    ids = near.select("doc_id").distinct().withColumnRenamed("doc_id", "near_id")
    suspects = texts.join(sized(ids, n_near), F.col("doc_id").eqNullSafe(F.col("near_id")), "left_semi")
    pairs = near.select(F.col("doc_id").alias("d"), F.col("item_id").alias("i"))
    same = [F.col("doc_id").eqNullSafe(F.col("d")), F.col("item_id").eqNullSafe(F.col("i"))]
    shared = (
        exploded(suspects, "doc_id", widths, check=True)
        .join(sized(items, n_items), ["shingle", "check"])
        .join(sized(pairs, n_near), same, "left_semi")
        .groupBy("doc_id", "item_id", "n", "shingle", "check")
        .agg(F.lit(1).alias("one"))
        .groupBy("doc_id", "item_id", "n")
        .agg(F.count(F.lit(1)).alias("n_shared"))
    )
    return shared.filter(100 * F.col("n_shared") >= threshold * F.col("n")).select(
        "doc_id",
        "item_id",
        F.col("n").alias("n_item_shingles"),
        "n_shared",
        (F.col("n_shared") / F.col("n")).alias("containment"),
    )


def op10_decontaminate(spark, sf_dir: str) -> DataFrame:
    return contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
