"""The research ledger: every fault by itself, and a sound ledger's selection."""

import pytest
from pyspark.sql import functions as F

from strataweave.operators import research as R

FINDING = "cwd string, session string, kind string, claim string, citations array<struct<ref:string,quote:string>>"
GOOD = {"repository": "repo", "component": "core", "intent": "accepted", "action": "fix", "disposition": "selected", "rationale": "asked for", "evidence": [("s1", "please")]}


@pytest.fixture(scope="module")
def found(spark):
    rows = [("/w", "a", "feature", f"claim {i}", [("s1", "please")]) for i in range(8)] + [("/z", "a", "feature", "claim 0", [("s1", "please")]), ("/w", "a", "praise", "fine", [])]
    return R.candidates(spark.createDataFrame(rows, FINDING)).cache()


def decisions(spark, rows):
    names = [x.split()[0] for x in R.DECISION.replace("array<struct<ref:string,quote:string>>", "array").split(", ")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], R.DECISION)


def test_faults(spark, found):
    ids = [r.id for r in found.orderBy("claim").collect()]
    assert len(ids) == 8 and found.filter("claim = 'claim 0'").first().cwd == "/w"
    sources = spark.createDataFrame([("s1", "would you please do it")], "ref string, text string")
    cases = [
        ({"intent": "maybe"}, {"invalid intent", "selected requires accepted intent and an action"}),
        ({"rationale": "  "}, {"review requires rationale"}),
        ({"component": None}, {"ownership requires target and evidence"}),
        ({"repository": None}, {"selected requires ownership"}),
        ({"action": "none"}, {"selected requires accepted intent and an action"}),
        ({"implementation": "present"}, {"fix contradicts reviewed status"}),
        ({"evidence": [("s1", "never said")]}, {"invalid ownership evidence"}),
        ({"duplicate_of": "x"}, {"target requires duplicate disposition"}),
    ]
    rows = [GOOD | {"id": i} | change for i, (change, _) in zip(ids, cases)]
    got = {}
    for r in R.ledger_faults(found, decisions(spark, rows + [GOOD | {"id": "nobody"}]), sources).collect():
        got.setdefault(r.id, set()).add(r.fault)
    assert got == {i: told for i, (_, told) in zip(ids, cases)} | {"nobody": {"unknown candidate"}}

    copy = {"disposition": "duplicate", "rationale": "same"}
    links = [(0, ids[1]), (1, ids[2]), (2, ids[0]), (3, ids[0]), (4, ids[4]), (5, "gone"), (6, None)]
    rows = [copy | {"id": ids[i], "duplicate_of": to} for i, to in links]
    got = {(ids.index(r.id), r.fault) for r in R.ledger_faults(found, decisions(spark, rows), sources).collect()}
    assert got == {(0, "cyclic duplicates"), (1, "cyclic duplicates"), (2, "cyclic duplicates"), (4, "invalid duplicate target"), (5, "invalid duplicate target"), (6, "invalid duplicate target")}

    sound = decisions(spark, [GOOD | {"id": ids[0]}, copy | {"id": ids[1], "duplicate_of": ids[0]}])
    assert R.ledger_faults(found, sound, sources).count() == 0
    assert [(r.id, r.component) for r in R.selection(found, sound, sources).collect()] == [(ids[0], "core")]
    assert R.selection(found, decisions(spark, rows), sources).count() == 0
    assert R.reviewed(found, sound).filter(F.col("disposition") == "needs-review").count() == 6
