"""Compaction of sessions: plans whose long bodies are stored once by digest, exact rebuilding, verification and repair.

A plan lists every record of a session with its fate. Users, systems and tools are protected; an assistant's record may
be omitted where a decision says so; of the rest, a body longer than ``inline`` characters moves out and is named by its
SHA-256. All bodies that a plan doesn't carry inline, omitted ones too, are in the content-addressed store, each once, so
a plan rebuilds to the very bytes it was made from. A plan's id is a digest of its records in order; a session whose plan would exceed
the budget is refused as a whole and keeps everything.

Records are (session, turn, role, text); repeated rows of a (session, turn) are one, the smallest. A null text is empty.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import digests, sha_col
from ..session import settle

#: Roles whose records are never omitted.
PROTECTED = ("user", "system", "tool")
TOOL_KEY = ["source", "session", "repo", "message", "call_id"]


@dataclass
class Plan:
    """``manifest``: session, turn, role, source, fate (inline, external, omitted), inline, n_bytes; ``store``: hash, body; ``plans``: session, plan_id, used, refused."""

    manifest: DataFrame
    store: DataFrame
    plans: DataFrame


def source_of(role: Column, text: Column) -> Column:
    return F.sha2(text, 256)


def line_of(m: str = "") -> Column:
    """What a record takes in the continuation: a heading with its source and its body or where that is."""
    head = F.concat(F.lit("## "), "role", F.lit(" ["), F.col("turn").cast("string"), F.lit("; "), "source", F.lit("]\n"))
    where = F.concat(F.lit("body "), "source", F.lit(", "), F.col("n_bytes").cast("string"), F.lit(" bytes\n"))
    return F.when(F.col("fate") == "omitted", "").when(F.col("fate") == "external", F.concat(head, where)).otherwise(F.concat(head, F.coalesce("inline", F.lit("")), F.lit("\n")))


def identified(manifest: DataFrame) -> DataFrame:
    """(session, plan_id): digests of plans as they are."""
    row = sha_col(F.col("turn"), F.coalesce("role", F.lit("")), F.col("source"), F.col("fate"), F.coalesce("inline", F.lit("")), F.col("n_bytes"))
    return digests(manifest, ["session"], ["turn"], row).select("session", F.concat(F.lit("plan:"), "digest").alias("plan_id"))


def planned(records: DataFrame, omissions: DataFrame, inline: int, budget: int) -> Plan:
    """Plans for all sessions. ``omissions``: (session, turn) that may be omitted."""
    one = records.groupBy("session", "turn").agg(F.min(F.struct(F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))).alias("r"))
    may = omissions.select("session", "turn", F.lit(True).alias("may")).distinct()
    rows = one.join(may, ["session", "turn"], "left").select("session", "turn", "r.role", "r.text", "may")
    fate = F.when(F.col("may") & ~F.col("role").isin(*PROTECTED), "omitted").when(F.length("text") > inline, "external").otherwise("inline")
    rows = rows.withColumns({"fate": fate, "source": source_of(F.col("role"), F.col("text")), "n_bytes": F.octet_length("text").cast("long")})
    rows = settle(rows, "plan-rows")
    manifest = rows.select("session", "turn", "role", "source", "fate", F.when(F.col("fate") == "inline", F.col("text")).alias("inline"), "n_bytes")
    store = rows.filter("fate <> 'inline'").groupBy(F.col("source").alias("hash")).agg(F.min("text").alias("body"))
    used = manifest.groupBy("session").agg(F.sum(F.length(line_of())).alias("used"))
    plans = used.join(identified(manifest), "session").withColumn("refused", F.col("used") > budget)
    plans = settle(plans, "plan-plans")
    kept = manifest.join(plans.filter("NOT refused").select("session"), "session", "left_semi")
    return Plan(settle(kept, "plan-manifest"), settle(store, "plan-store"), plans)


def rebuilt(manifest: DataFrame, store: DataFrame) -> DataFrame:
    """(session, turn, role, text): the records of plans, from what is inline and from the store; text is null where a body is missing."""
    joined = manifest.join(store.select(F.col("hash").alias("source"), "body"), "source", "left")
    return joined.select("session", "turn", "role", F.when(F.col("fate") == "inline", F.col("inline")).otherwise(F.col("body")).alias("text"))


def faults(plan: Plan) -> DataFrame:
    """(session, turn, fault): bodies that aren't there or aren't what their digests say, and plans (turn null) that aren't what their ids say."""
    back = rebuilt(plan.manifest, plan.store).join(plan.manifest.select("session", "turn", "source"), ["session", "turn"])
    told = F.when(F.col("text").isNull(), "body missing").when(source_of(F.col("role"), F.col("text")) != F.col("source"), "body changed")
    bodies = back.select("session", "turn", told.alias("fault")).filter("fault IS NOT NULL")
    now = identified(plan.manifest).withColumnRenamed("plan_id", "now")
    issued = plan.plans.filter("NOT refused").select("session", "plan_id")
    plans = issued.join(now, "session", "full").filter("NOT (plan_id <=> now)").select("session", F.lit(None).cast(plan.manifest.schema["turn"].dataType).alias("turn"), F.lit("plan changed").alias("fault"))
    return bodies.unionByName(plans)


def differences(plan: Plan, records: DataFrame) -> DataFrame:
    """(side, session, turn): records that a plan rebuilds but that aren't there, and the other way round; none for a sound plan."""
    one = records.groupBy("session", "turn").agg(F.min(F.struct(F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))).alias("r"))
    own = one.join(plan.manifest.select("session").distinct(), "session", "left_semi").select("session", "turn", "r.role", F.col("r.text").alias("text"))
    back = settle(rebuilt(plan.manifest, plan.store), "plan-rebuilt")
    only = lambda a, b, side: a.exceptAll(b).select(F.lit(side).alias("side"), "session", "turn")
    return only(back, own, "plan").unionByName(only(own, back, "records"))


def repaired(sources: DataFrame, store: DataFrame, full: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Tool sources whose bounded bodies are replaced by complete ones where these are known.

    ``sources``: the five columns of ``TOOL_KEY``, hash; ``store``: hash, body, complete; ``full``: the key and a complete body. Gives the
    sources, the store with what was added, and the keys that changed. Sources with a complete body stay as they are,
    so repeating it changes nothing; of several full bodies the smallest counts.
    """
    best = full.groupBy(*TOOL_KEY).agg(F.min("body").alias("full"))
    known = sources.join(store.select("hash", "complete"), "hash", "left").join(best, TOOL_KEY, "left")
    upgrade = ~F.coalesce("complete", F.lit(False)) & F.col("full").isNotNull()
    marked = settle(known.withColumns({"upgrade": upgrade, "new": F.sha2("full", 256)}), "tool-sources")
    after = marked.select(*TOOL_KEY, F.when(F.col("upgrade"), F.col("new")).otherwise(F.col("hash")).alias("hash"))
    added = marked.filter("upgrade").select(F.col("new").alias("hash"), F.col("full").alias("body"), F.lit(True).alias("complete")).dropDuplicates(["hash"])
    merged = store.join(added.select("hash"), "hash", "left_anti").unionByName(added)
    return after, merged, marked.filter("upgrade").select(*TOOL_KEY)
