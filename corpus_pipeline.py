"""The corpus pipeline: quality rules, near-duplicates, repeated passages, leaks, tokens.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of ``documents``, in their order, and pass further columns through, whatever their names.
SQL can't express the stages from the second on over whole tables, so there is no oracle;
tests/llm compares ``run`` with a brute-force version.

Of texts of any length none is cut short. An empty table gives an empty one at every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataweave.llm import bpe, decontaminate, near, quality, substring
from strataweave.llm.common import discard, read, settle, settled

ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail a base rule or score below the threshold go.

    Null and blank texts fail. Rows are judged one by one: repeated rows stay or go together, a null
    doc_id only means that no label is known.
    """
    return quality.quality(docs, read(spark, sf_dir, "labels")).filter("kept").select("doc.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-duplicates (a similarity of 0.8), the document with the smallest id stays.

    Rows that share a doc_id are one document, as they are to the operator: one row stays, the one
    with the longest text, of equally long ones the first by its text. Rows with a null doc_id all
    stay; null and blank texts are like nothing and stay.
    """
    kept = settle(near.near_duplicates(docs, threshold=80).filter("kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias("id")).distinct(), "pipeline-near")
    rows = docs.select(F.struct(*docs.columns).alias("doc"))
    stay = rows.join(kept, F.col("doc.doc_id") == F.col("id"), "left_semi")
    order = Window.partitionBy("doc.doc_id").orderBy(F.length("doc.text").desc_nulls_last(), "doc.text")
    one = stay.withColumn("number", F.row_number().over(order)).filter("number = 1").select("doc")
    return one.unionByName(rows.filter("doc.doc_id IS NULL")).select("doc.*")


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of passages that a smaller document has too are cut; documents left empty go.

    Null texts stay null, ``n_chars`` follows the text. Rows with a null doc_id lose no word and take
    none; rows that share a doc_id don't take words from one another.
    """
    left = substring.without_repeats(docs)
    return left.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else left


def leak_removal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go.

    Rows that share a doc_id go together; null and blank texts hold nothing. Rows with a null doc_id
    are one document to the search and go together where it holds an item.
    """
    found = decontaminate.contaminated(docs, read(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("leak")).distinct()
    found = settle(found, "pipeline-leaks")
    leaks = decontaminate.sized(found, found.count())
    rows = docs.select(F.struct(*docs.columns).alias("doc"))
    return rows.join(leaks, F.col("doc.doc_id").eqNullSafe(F.col("leak")), "left_anti").select("doc.*")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, with digests of the ids and of the text decoded from them.

    A null text is an empty one; every row gets its own result.
    """
    return bpe.encode(docs, more=("ids",))


STAGES = [
    ("quality", quality_rules),
    ("near_duplicates", near_dedup),
    ("substring", substring_dedup),
    ("decontamination", leak_removal),
    ("bpe", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. A stage's scratch tables and its input go once its result is written."""
    docs, since = read(spark, sf_dir, "documents"), settled()
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), f"pipeline-{name}")
        discard(spark, since)
    return STAGES[-1][1](spark, docs, sf_dir)
