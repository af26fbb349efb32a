"""The research ledger: candidates out of findings, reviewed by decisions that are checked as a whole.

A finding (cwd, session, kind, claim, citations) of a kind that asks for work becomes a candidate, named by the digest of its canonical
JSON; equal findings are one. A decision may say where a candidate belongs, what was intended and done, and what to do; what
it leaves null keeps its default. The working folder of a finding is a hint and never ownership: that needs a repository, a
component and evidence whose quotes stand in their sources. A ledger with any fault is refused.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.canonical import canonical_json
from ..session import settle
from .traverse import cycle_members

#: Kinds of findings that become candidates, what a decision may say, and what holds without one.
KINDS = ("feature", "unfinished", "friction")
ALLOWED = {
    "intent": ("requested", "accepted", "rejected", "ambiguous"),
    "implementation": ("present", "partial", "unknown", "retired"),
    "deployment": ("unknown",),
    "action": ("fix", "verify", "investigate", "none"),
    "disposition": ("selected", "duplicate", "implemented", "retired", "deferred", "needs-review", "needs-verification"),
}
DEFAULTS = {"intent": "ambiguous", "implementation": "unknown", "deployment": "unknown", "action": "investigate", "disposition": "needs-review"}
DECISION = "id string, repository string, component string, intent string, implementation string, deployment string, action string, disposition string, duplicate_of string, rationale string, evidence array<struct<ref:string,quote:string>>"


def candidates(findings: DataFrame) -> DataFrame:
    """(id, cwd, session, kind, claim, citations), one row for each finding that asks for work."""
    own = findings.filter(F.col("kind").isin(*KINDS)).withColumn("identity", F.struct("session", "kind", "claim", "citations"))
    named = own.withColumn("id", F.sha2(canonical_json(own, "identity"), 256))
    return named.groupBy("id").agg(F.min("cwd").alias("cwd"), F.first("identity").alias("f")).select("id", "cwd", "f.session", "f.kind", "f.claim", "f.citations")


def reviewed(found: DataFrame, decisions: DataFrame) -> DataFrame:
    """Candidates with what their decisions say, defaults elsewhere; of several decisions the smallest rationale's."""
    one = decisions.groupBy("id").agg(F.min(F.struct("rationale", *[c for c in decisions.columns if c not in ("id", "rationale")])).alias("d"))
    joined = found.select("id", "cwd").join(one, "id", "left")
    said = [F.coalesce(F.col(f"d.{c}"), F.lit(v)).alias(c) for c, v in DEFAULTS.items()]
    rest = [F.col(f"d.{c}").alias(c) for c in ("repository", "component", "duplicate_of", "rationale", "evidence")]
    return joined.select("id", "cwd", *said, *rest, F.col("d").isNotNull().alias("decided"))


def ledger_faults(found: DataFrame, decisions: DataFrame, sources: DataFrame) -> DataFrame:
    """(id, fault): why a ledger must be refused. ``sources``: ref, text."""
    ledger = settle(reviewed(found, decisions), "research-ledger")
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    told: list[tuple[Column, str]] = [(~F.col(c).isin(*values), f"invalid {c}") for c, values in ALLOWED.items()]
    told.append((blank(F.col("rationale")), "review requires rationale"))
    owned = F.col("repository").isNotNull()
    told.append((owned & (blank(F.col("repository")) | blank(F.col("component")) | (F.coalesce(F.size("evidence"), F.lit(0)) == 0)), "ownership requires target and evidence"))
    selected = F.col("disposition") == "selected"
    told.append((selected & blank(F.col("repository")), "selected requires ownership"))
    told.append((selected & (~F.col("intent").isin("requested", "accepted") | (F.col("action") == "none")), "selected requires accepted intent and an action"))
    told.append(((F.col("action") == "fix") & (F.col("implementation").isin("present", "retired") | (F.col("intent") == "rejected")), "fix contradicts reviewed status"))
    duplicate = F.col("disposition") == "duplicate"
    told.append((~duplicate & F.col("duplicate_of").isNotNull(), "target requires duplicate disposition"))
    told.append((duplicate & (F.col("duplicate_of").isNull() | (F.col("duplicate_of") == F.col("id"))), "invalid duplicate target"))
    rows = ledger.filter("decided").select("id", F.explode(F.array_compact(F.array(*[F.when(F.coalesce(x, F.lit(False)), w) for x, w in told]))).alias("fault"))

    unknown = decisions.select("id").distinct().join(found.select("id"), "id", "left_anti").select("id", F.lit("unknown candidate").alias("fault"))
    links = ledger.filter("disposition = 'duplicate' AND duplicate_of IS NOT NULL AND duplicate_of <> id").select("id", F.col("duplicate_of").alias("to"))
    lost = links.join(found.select(F.col("id").alias("to")), "to", "left_anti").select("id", F.lit("invalid duplicate target").alias("fault"))
    turns = cycle_members(links).select("id", F.lit("cyclic duplicates").alias("fault"))
    cited = ledger.filter(F.col("decided") & owned).select("id", F.explode("evidence").alias("e")).select("id", "e.ref", "e.quote")
    met = cited.join(sources.groupBy("ref").agg(F.min("text").alias("text")), "ref", "left")
    false = met.filter(blank(F.col("quote")) | ~F.coalesce(F.contains("text", "quote"), F.lit(False))).select("id", F.lit("invalid ownership evidence").alias("fault"))
    return reduce(DataFrame.unionByName, [rows, unknown, lost, turns, false]).distinct()


def selection(found: DataFrame, decisions: DataFrame, sources: DataFrame) -> DataFrame:
    """(id, repository, component, action) of what was selected; nothing of a ledger with a fault."""
    faults = settle(ledger_faults(found, decisions, sources), "research-faults")
    if faults.take(1):
        return reviewed(found, decisions).filter(F.lit(False)).select("id", "repository", "component", "action")
    return reviewed(found, decisions).filter("disposition = 'selected'").select("id", "repository", "component", "action")
