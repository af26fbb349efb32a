"""Replica exchange, ordered folds with budgets."""

import random

import pytest
from pyspark.sql import functions as F

from strataweave.operators import budget, replica

EVENT = "parents array<string>, body string"


def events(spark, bodies):
    df = spark.createDataFrame([(p, b) for p, b in bodies], EVENT)
    return df.select(replica.event_id(F.col("parents"), F.col("body")).alias("id"), "parents", "body")


def ids(df):
    rows = [r.id for r in df.select("id").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_diverging_replicas_converge(spark, monkeypatch):
    monkeypatch.setattr(replica, "PAGE_EVENTS", 2)
    both = [(["x"], f"shared {i}") for i in range(40)] + [(None, "")]
    mine, theirs = events(spark, both + [([], f"mine {i}") for i in range(30)]), events(spark, both + [(["a", "b"], f"theirs {i}") for i in range(9)])
    done = replica.exchange(mine, theirs)
    assert ids(done.mine) == ids(done.theirs) == ids(mine) | ids(theirs) and done.rounds == 1
    assert done.refused.count() == 0 and replica.differing(done.mine, done.theirs).count() == 0
    # Equal replicas list nothing.
    assert replica.lacking(mine, mine, replica.differing(mine, mine)).count() == 0


@pytest.mark.parametrize(
    "fault, change",
    [
        ("event id isn't its digest", lambda e: F.transform(e, lambda x, i: F.when(i == 0, x.withField("body", F.lit("forged"))).otherwise(x))),
        ("event id isn't its digest", lambda e: F.transform(e, lambda x, i: F.when(i == 0, x.withField("body", F.lit(None).cast("string"))).otherwise(x))),
        ("page digest differs", lambda e: F.slice(e, 1, 1)),
        ("event twice in a page", lambda e: F.concat(e, F.slice(e, 1, 1))),
        ("empty page", lambda e: F.slice(e, 1, 0)),
    ],
)
def test_a_broken_page_changes_nothing(spark, fault, change):
    mine, theirs = events(spark, [([], f"mine {i}") for i in range(600)]), events(spark, [([], "theirs")])
    broken = lambda pages, to: pages.withColumn("events", change(F.col("events"))) if to == "theirs" else pages
    # Only pages of several events: one alone is the same page after some of these changes.
    first = replica.paged(mine).filter("size(events) > 1").cache()
    grown, faults = replica.accepted(theirs, broken(first, "theirs"))
    assert ids(grown) == ids(theirs)
    assert {r.fault for r in faults.collect()} == {fault} and faults.count() == first.count()


def test_page_bounds_and_replays(spark, monkeypatch):
    mine = events(spark, [([], "x" * (7 * i)) for i in range(50)])
    pages = replica.paged(mine)
    grown, _ = replica.accepted(mine.limit(0), pages.unionByName(pages))
    assert ids(grown) == ids(mine)
    monkeypatch.setattr(replica, "EVENT_BYTES", 200)
    _, faults = replica.accepted(mine.limit(0), pages)
    assert {r.fault for r in faults.collect()} == {"event too large"}


def test_fitting_goes_on_behind_what_does_not_fit(spark):
    rng = random.Random(2)
    rows = [(rng.choice("ab"), i, rng.choice([None, 1, 3, 8, 50])) for i in range(60)]
    got = {r.i: (r.fits, r.used) for r in budget.fitting(spark.createDataFrame(rows, "k string, i int, n int").repartition(3), ["k"], ["i"], "n", 40, 9).collect()}
    want, used = {}, {"a": [0, 0], "b": [0, 0]}
    for k, i, n in rows:
        fits = used[k][0] + (n or 0) <= 40 and used[k][1] < 9
        if fits:
            used[k] = [used[k][0] + (n or 0), used[k][1] + 1]
        want[i] = (fits, used[k][0])
    assert got == want


def test_interleaving_and_chunks(spark):
    rows = [("a", 1, 5), ("a", 2, 90), ("a", 3, 4), ("b", 1, 6), ("b", 2, 7), ("c", 9, 100)]
    df = spark.createDataFrame(rows, "p string, i int, n int")
    assert [(r.p, r.i, r.used) for r in budget.interleaved(df, "p", ["i"], "n", 20, 10).orderBy("used").collect()] == [("a", 1, 5), ("b", 1, 11), ("b", 2, 18)]
    assert budget.interleaved(df, "p", ["i"], "n", 200, 2).count() == 2
    got = {(r.p, r.i): r.chunk for r in budget.chunked(df, ["p"], ["i"], "n", 10, 2).collect()}
    assert got == {("a", 1): 0, ("a", 2): 1, ("a", 3): 2, ("b", 1): 0, ("b", 2): 1, ("c", 9): 0}
    assert budget.chunked(df.limit(0), ["p"], ["i"], "n", 10, 2).count() == 0


def test_trimmed_lists(spark):
    rng = random.Random(5)
    rows = [(g, name, i, rng.randint(1, 9)) for g in range(3) for name in "xyz" for i in range(rng.randint(0, 7))]
    got = {}
    for r in budget.trimmed(spark.createDataFrame(rows, "g int, list string, i int, n int"), ["g"], "list", ["i"], "n", 30).collect():
        got.setdefault((r.g, r["list"]), []).append((r.i, r.shown, r.total, r.next_after))
    for g in range(3):
        lists = {name: [n for gg, x, _, n in rows if (gg, x) == (g, name)] for name in "xyz"}
        total = {k: len(v) for k, v in lists.items()}
        while sum(map(sum, lists.values())) > 30:
            longest = max(lists, key=lambda k: (len(lists[k]), k))
            lists[longest].pop()
        for name in "xyz":
            n = len(lists[name])
            assert sorted(got.get((g, name), [])) == [(i, n, total[name], n if n < total[name] else None) for i in range(n)]
