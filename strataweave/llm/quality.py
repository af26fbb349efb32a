"""Quality rules: a hashed n-gram log-likelihood ratio between trusted and raw text.

Two multinomials over ``buckets`` hashed n-grams are counted, one from every document (raw)
and one from trusted documents, those that the labels call good. A document's score is the
sum over its n-grams of the log ratio of their probabilities, divided by their number; a
document is kept if that mean reaches ``threshold`` and the base rules pass.

All columns are built-in expressions; the only shuffle is that of the bucket counts, which
are summed within each task first and are ``buckets`` rows a task at most. The trusted side
is a sample of ``trusted_rows`` labelled documents at most (the bound of the broadcast).

Null or blank texts have no words, count 0 everywhere and fail the base rules. A document
whose labels disagree isn't trusted. Repeated rows are scored one by one. Without labels no
ratio can be known: all weights are 0 and only the base rules decide.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import words

BUCKETS = 1 << 14
#: Labelled rows that the trusted multinomial is counted from, at most.
TRUSTED_ROWS = 20_000
#: Pseudo-count of each bucket in the raw multinomial; the trusted one is smoothed towards the raw
#: one with the weight of ``PRIOR`` n-grams, so that few trusted documents tell little.
SMOOTH, PRIOR = 1.0, 2048
#: Log ratios are kept as whole numbers of this fraction, so that sums don't depend on order.
UNIT = 1 << 16
#: Least mean log ratio of a kept document.
THRESHOLD = -0.3
TOKEN = r"[\p{L}\p{N}]+|[^\p{L}\p{N}\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"


def grams(text: Column, buckets: int) -> tuple[Column, Column]:
    """Expressions for a text's ``hashes`` (CRC-32 of each token) and, from that column, its n-grams' buckets."""
    tokens = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0))
    h = F.col("hashes")
    pairs = F.when(
        F.size(h) > 1,
        F.transform(F.slice(h, 2, F.greatest(F.size(h) - 1, F.lit(0))), lambda b, i: ((F.get(h, i) * 31 + b) % buckets).cast("int")),
    ).otherwise(F.array().cast("array<int>"))
    hashes = F.transform(tokens, lambda x: F.crc32(x.cast("binary")))
    return hashes, F.concat(F.transform(h, lambda x: (x % buckets).cast("int")), pairs)


def trusted(labels: DataFrame, rows: int = TRUSTED_ROWS) -> DataFrame:
    """Ids that all their labels call good, ``rows`` at most; the choice follows a hash of the id."""
    good = labels.groupBy("doc_id").agg(F.min("quality").alias("least")).filter("least = 1 AND doc_id IS NOT NULL")
    return good.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


def weights(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, rows: int = TRUSTED_ROWS) -> DataFrame:
    """One row: ``t``, the log ratio of every bucket in whole ``UNIT`` parts, and the totals."""
    hashes, buckets_of = grams(F.col("text"), buckets)
    good = trusted(labels, rows).withColumn("good", F.lit(1))
    counts = (
        docs.select("doc_id", "text")
        .join(F.broadcast(good), "doc_id", "left")
        .select("good", hashes.alias("hashes"))
        .select("good", F.explode(buckets_of).alias("bucket"))
        .groupBy("bucket")
        .agg(F.count(F.lit(1)).alias("raw"), F.count("good").alias("good"))
    )
    zero = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"), F.lit(0).alias("raw"), F.lit(0).alias("good"))
    every = counts.unionByName(zero).groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("good").alias("good"))
    whole = every.agg(
        F.sort_array(F.collect_list(F.struct("bucket", "raw", "good"))).alias("c"), F.sum("raw").alias("all_raw"), F.sum("good").alias("all_good")
    )
    raw = lambda c: (c["raw"] + SMOOTH) / (F.col("all_raw") + SMOOTH * buckets)
    good = lambda c: (c["good"] + PRIOR * raw(c)) / (F.col("all_good") + PRIOR)
    ratio = F.transform("c", lambda c: F.round((F.log(good(c)) - F.log(raw(c))) * UNIT).cast("long"))
    zeros = F.transform("c", lambda c: F.lit(0).cast("long"))
    return whole.select(F.when(F.col("all_good") > 0, ratio).otherwise(zeros).alias("t"), "all_raw", "all_good")


def repeated_words(w: Column) -> list[tuple[str, Column]]:
    """Steps that end in ``n_repeat_words``: words in 3-word windows found twice or more in the text.

    The windows' hashes are sorted with their places; neighbours with equal hashes are repeats.
    """
    h, s, p = F.col("h3"), F.col("s3"), F.col("p3")
    three = F.when(
        F.size(w) >= 3,
        F.transform(
            F.slice(w, 3, F.greatest(F.size(w) - 2, F.lit(0))),
            lambda c, i: F.xxhash64(F.get(w, i), F.get(w, i + 1), c),
        ),
    ).otherwise(F.array().cast("array<long>"))
    several = F.size(F.array_distinct(h)) < F.size(h)
    placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    order = F.when(several, F.transform(placed, lambda x: x["i"])).otherwise(F.array().cast("array<int>"))
    same = lambda a, b: F.coalesce(F.get(h, a) == F.get(h, b), F.lit(False))
    places = F.when(
        F.size(s) > 0,
        F.sort_array(
            F.filter(
                s,
                lambda a, k: same(a, F.get(s, k + 1)) | (k > 0) & same(a, F.get(s, F.greatest(k - 1, F.lit(0)))),
            )
        ),
    ).otherwise(s)
    covered = F.when(
        F.size(p) > 0,
        F.aggregate(
            F.transform(p, lambda a, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - a, F.lit(3)))),
            F.lit(0).cast("long"),
            lambda acc, x: acc + x,
        ),
    ).otherwise(F.lit(0).cast("long"))
    return [("h3", three), ("s3", order), ("p3", places), ("n_repeat_words", covered)]


def base_rules(docs: DataFrame) -> DataFrame:
    """``doc`` (the row as it came), ``doc_id`` and the counts of the base rules; no column of ``docs`` can clash."""
    df = docs.select(F.struct(*docs.columns).alias("doc"))
    text = F.coalesce(F.col("doc.text"), F.lit(""))
    w, lines = F.col("w"), F.col("lines")
    df = df.withColumns({"w": words(text), "lines": F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))})
    df = df.withColumns(
        {
            "doc_id": F.col("doc.doc_id"),
            "n_words": F.size(w).cast("long"),
            "word_chars": F.length(F.array_join(w, "")).cast("long"),
            "n_symbols": (F.length(text) - F.length(F.regexp_replace(text, SYMBOLS, ""))).cast("long"),
            "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        }
    )
    for name, step in repeated_words(w):
        df = df.withColumn(name, step)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return df.withColumn("base_failed", failed).drop("w", "lines", "h3", "s3", "p3")


def quality(
    docs: DataFrame,
    labels: DataFrame,
    buckets: int = BUCKETS,
    threshold: float = THRESHOLD,
    rows: int = TRUSTED_ROWS,
) -> DataFrame:
    """Every row of ``docs`` as ``doc``, its doc_id and counts, ``ratio_sum``, ``n_grams`` and ``kept``."""
    by_bucket = weights(docs, labels, buckets, rows).select("t").scalar()
    hashes, buckets_of = grams(F.col("doc.text"), buckets)
    g = F.col("g")
    scored = base_rules(docs).withColumn("hashes", hashes).withColumn("g", buckets_of).withColumn("t", by_bucket)
    scored = scored.withColumns(
        {
            "n_grams": F.size(g).cast("long"),
            "ratio_sum": F.aggregate(g, F.lit(0).cast("long"), lambda a, b: a + F.get(F.col("t"), b)),
        }
    ).drop("hashes", "g", "t")
    reached = F.col("ratio_sum") >= F.lit(round(threshold * UNIT)).cast("long") * F.col("n_grams")
    # The row number keeps the optimizer from pushing a filter on ``kept``, and with it copies of
    # every step above, below the steps that it is built from.
    return scored.withColumn("kept", (F.monotonically_increasing_id() >= 0) & ~F.col("base_failed") & reached)


def op4_quality(spark, sf_dir: str) -> DataFrame:
    from .common import read

    docs, labels = read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "labels")
    return quality(docs, labels).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_grams", "ratio_sum"
    )
