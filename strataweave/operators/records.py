"""Native session records: parts, pointers, settlement, recovery, corpora.

A record has ``record_id``, ``type`` (user, assistant, system, shell), ``completed`` and ``parts``: an
array of (kind, text, call_id, status, outputs).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PART = "array<struct<kind:string,text:string,call_id:string,status:string,outputs:array<string>>>"
#: States of a tool part that isn't done.
OPEN = ("streaming", "pending", "running")


def normalised(records: DataFrame) -> DataFrame:
    """Records without system ones, parts without reasoning; what is left without a part goes."""
    kept = records.filter("type <> 'system'").withColumn("parts", F.filter("parts", lambda p: p["kind"].isin("text", "tool")))
    return kept.filter(F.size("parts") > 0)


def text_pointers(records: DataFrame) -> DataFrame:
    """(record_id, pointer, text) of every text: a user's, an assistant's parts, the outputs of tools, a shell's output."""
    plain = records.filter("type IN ('user', 'shell')")
    pointer = F.when(F.col("type") == "user", "/text").otherwise("/output/output")
    whole = plain.select("record_id", pointer.alias("pointer"), F.get("parts", 0)["text"].alias("text"))
    parts = records.filter("type = 'assistant'").select("record_id", F.posexplode("parts").alias("i", "p"))
    texts = parts.filter("p.kind = 'text'").select("record_id", F.concat(F.lit("/content/"), "i", F.lit("/text")).alias("pointer"), "p.text")
    tools = parts.filter("p.kind = 'tool'").select("record_id", "i", F.posexplode("p.outputs").alias("j", "text"))
    outputs = tools.select("record_id", F.concat(F.lit("/content/"), "i", F.lit("/state/content/"), "j", F.lit("/text")).alias("pointer"), "text")
    return whole.unionByName(texts).unionByName(outputs).filter("text IS NOT NULL")


def is_settled() -> Column:
    """An assistant's record is settled when it is completed and no part is open; a shell's when completed; others always."""
    open_part = F.exists("parts", lambda p: F.coalesce(p["status"].isin(*OPEN), F.lit(False)))
    return F.when(F.col("type") == "assistant", F.col("completed") & ~open_part).when(F.col("type") == "shell", F.col("completed")).otherwise(True)


def repeated_calls(records: DataFrame) -> DataFrame:
    """(call_id, n) of tool calls that several parts claim."""
    calls = records.select(F.explode("parts").alias("p")).filter("p.kind = 'tool' AND p.call_id IS NOT NULL").select("p.call_id")
    return calls.groupBy("call_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def recovered(records: DataFrame) -> DataFrame:
    """Records of an interrupted draft: open tool parts are marked, and how many were."""
    is_open = lambda p: (p["kind"] == "tool") & F.coalesce(p["status"].isin(*OPEN), F.lit(False))
    marked = F.transform("parts", lambda p: p.withField("status", F.when(is_open(p), "interrupted").otherwise(p["status"])))
    return records.withColumn("n_interrupted", F.size(F.filter("parts", is_open))).withColumn("parts", marked)


def research_corpus(messages: DataFrame, least: int) -> DataFrame:
    """(session, ordinal, role, text, lineage) of sessions with ``least`` user messages or more.

    ``messages``: session, turn, role, text. The lineage is the digest of the session's first user text,
    so that sessions that were forked from one another share it.
    """
    users = messages.filter("role = 'user' AND text IS NOT NULL").groupBy("session").agg(F.count(F.lit(1)).alias("n"), F.min_by("text", "turn").alias("first"))
    wide = users.filter(F.col("n") >= least).select("session", F.md5("first").alias("lineage"))
    return messages.join(wide, "session").select("session", F.col("turn").alias("ordinal"), "role", "text", "lineage")
