"""Compaction plans, tool repair, cycles of links, range digests."""

import hashlib
import random

from pyspark.sql import functions as F

from strataweave.functions.ids import range_digest
from strataweave.operators import compaction as C
from strataweave.operators.traverse import cycle_members

ROWS = [("s", 0, "user", "ask é" * 30), ("s", 1, "assistant", "x" * 50), ("s", 2, "tool", "x" * 50), ("s", 3, "assistant", None), ("s", 3, "assistant", None), ("s", 4, "system", ""), ("big", 0, "user", "y" * 900), ("t", 0, None, "short")]


def made(spark, budget=600):
    rows = spark.createDataFrame(ROWS, "session string, turn int, role string, text string")
    omissions = spark.createDataFrame([("s", 0), ("s", 1), ("s", 2)], "session string, turn int")
    return rows, C.planned(rows, omissions, 40, budget)


def test_plans(spark):
    rows, plan = made(spark)
    fates = {(r.session, r.turn): r.fate for r in plan.manifest.collect()}
    # Users and tools stay whatever was decided; equal bodies are stored once.
    assert fates == {("s", 0): "external", ("s", 1): "omitted", ("s", 2): "external", ("s", 3): "inline", ("s", 4): "inline", ("t", 0): "inline", ("big", 0): "external"}
    assert plan.store.count() == 3 and C.faults(plan).count() == 0 and C.differences(plan, rows).count() == 0
    back = {(r.session, r.turn): r.text for r in C.rebuilt(plan.manifest, plan.store).collect()}
    assert back == {(s, t): x or "" for s, t, _, x in ROWS}
    _, small = made(spark, 200)
    assert {r.session: r.refused for r in small.plans.collect()} == {"s": True, "big": False, "t": False}
    assert {r.session for r in small.manifest.collect()} == {"big", "t"}
    _, again = made(spark)
    assert plan.plans.exceptAll(again.plans).count() == 0


def test_tampered_plans(spark):
    rows, plan = made(spark)
    told = lambda p: {(r.session, r.turn, r.fault) for r in C.faults(p).collect()}
    x = hashlib.sha256(b"x" * 50).hexdigest()
    lost = C.Plan(plan.manifest, plan.store.filter(F.col("hash") != x), plan.plans)
    assert told(lost) == {("s", 1, "body missing"), ("s", 2, "body missing")}
    changed = C.Plan(plan.manifest, plan.store.withColumn("body", F.when(F.col("hash") == x, "z").otherwise(F.col("body"))), plan.plans)
    assert told(changed) == {("s", 1, "body changed"), ("s", 2, "body changed")}
    assert {(r.side, r.turn) for r in C.differences(changed, rows).collect()} == {("plan", 1), ("plan", 2), ("records", 1), ("records", 2)}
    forged = C.Plan(plan.manifest.withColumn("fate", F.when(F.col("turn") == 2, "omitted").otherwise(F.col("fate"))), plan.store, plan.plans)
    assert told(forged) == {("s", None, "plan changed")}
    cut = C.Plan(plan.manifest.filter("session <> 't'"), plan.store, plan.plans)
    assert told(cut) == {("t", None, "plan changed")}


def test_tool_repair(spark):
    key = lambda c: ("native", "s", "repo", "m", c)
    schema = "source string, session string, repo string, message string, call_id string, "
    sources = spark.createDataFrame([(*key("1"), "h1"), (*key("2"), "h2"), (*key("3"), "h3"), (*key("4"), "gone")], schema + "hash string")
    store = spark.createDataFrame([("h1", "cut", False), ("h2", "whole", True), ("h3", "cut too", False)], "hash string, body string, complete boolean")
    full = spark.createDataFrame([(*key("1"), "cut off"), (*key("1"), "cut off"), (*key("2"), "other"), (*key("4"), "found")], schema + "body string")
    after, merged, changed = C.repaired(sources, store, full)
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert {r.call_id: r.hash for r in after.collect()} == {"1": digest("cut off"), "2": "h2", "3": "h3", "4": digest("found")}
    assert {r.call_id for r in changed.collect()} == {"1", "4"} and merged.count() == 5
    again, same, none = C.repaired(after, merged, full)
    assert none.count() == 0 and same.exceptAll(merged).count() == 0 and again.exceptAll(after).count() == 0


def test_cycles(spark):
    rng = random.Random(6)
    for n in (1, 2, 40, 300):
        to = {i: rng.choice([None, *range(n + 2)]) if rng.random() < 0.3 else (i + 1) % n for i in range(n)}
        want = set()
        for i in to:
            seen, at = [], i
            while at is not None and at not in seen:
                seen.append(at)
                at = to.get(at)
            if at is not None:
                want |= set(seen[seen.index(at) :])
        links = spark.createDataFrame(list(to.items()), "id long, to long")
        assert {r.id for r in cycle_members(links).collect()} == want
    assert cycle_members(spark.createDataFrame([], "id long, to long")).count() == 0


def test_range_digest_under_any_partitioning(spark):
    rows = spark.createDataFrame([(f"k{i % 90}", f"text {i}") for i in range(200)] + [(None, "no key")], "k string, f string")
    got = [range_digest(rows.repartition(n), "k", F.col("f")).first() for n in (1, 7)]
    assert got[0] == got[1]
    assert range_digest(rows.filter("f <> 'text 3'"), "k", F.col("f")).first().digest != got[0].digest
