"""Streams: leases, causal staging, folder watching; and the command line."""

import datetime
import json
import random

from strataweave import __main__ as cli
from strataweave.reader import GraphReader
from strataweave.streaming import leases, projections


def plain(rows, ttl, watermark):
    """The machine by its rules, one task."""
    holder, generation, until, told, out = None, 0, 0, True, []
    for us, action, worker in rows:
        if not told and us >= until:
            out.append((until, "expired", holder, True, generation))
            told = True
        good = (action == "claim" and holder is None) or (action == "heartbeat" and holder == worker) or (action == "reclaim" and holder is not None and us >= until)
        if good:
            generation += action != "heartbeat"
            holder, until, told = worker, us + ttl, False
        out.append((us, action, worker, good, generation))
    if not told and -(-until // 1000) <= watermark:
        out.append((until, "expired", holder, True, generation))
    return out


def test_leases(spark):
    """Claims, heartbeats, reclaims and expiries over several batches; the last leases by timers alone."""
    rng = random.Random(3)
    schema = "task string, us long, seq long, action string, worker string, ts timestamp"
    rows = [(rng.choice("tuv"), 1_000_000 * (i + 1), i, rng.choice(["claim", "heartbeat", "heartbeat", "reclaim", "nonsense"]), rng.choice("ab")) for i in range(90)]
    rows += [("late", 91_000_000, 91, "claim", "a"), ("quiet", 40_000_000, 92, "claim", "b"), ("end", 120_000_000, 93, "claim", "b")]
    rows.sort(key=lambda r: r[1])
    batches = []
    for k in range(0, len(rows), 31):
        part = [(*r, datetime.datetime.fromtimestamp(r[1] / 1e6, datetime.UTC)) for r in rows[k : k + 31]]
        batches.append(spark.createDataFrame(part, schema).repartition(2))
    got = {}
    for r in leases.run_leases(spark, batches, 7_000_000, "5 seconds").collect():
        got.setdefault(r.task, []).append(tuple(r)[1:])
    want = {t: plain([(r[1], r[3], r[4]) for r in rows if r[0] == t], 7_000_000, 115_000) for t in {r[0] for r in rows}}
    key = lambda x: (x[0], x[1] != "expired")
    assert {t: sorted(x, key=key) for t, x in got.items()} == {t: sorted(x, key=key) for t, x in want.items()}
    assert any(x[1] == "expired" for x in got["quiet"]) and all(x[1] != "expired" for x in got["end"])


def test_staging(spark):
    schema = "id string, parents array<string>"
    events = spark.createDataFrame([("b", ["a"]), ("d", ["c"]), ("e", ["b"])], schema)
    ready, staged = projections.ready_events(events, spark.createDataFrame([("a", [])], schema))
    assert {r.id for r in ready.collect()} == {"b", "e"} and {r.id for r in staged.collect()} == {"d"}


def test_watch(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.md").write_text("# A\n\ntext")
    seen = []
    handle = lambda batch, n: seen.extend(r.value for r in batch.collect())
    for _ in range(2):
        projections.watch(spark, f"{tmp_path}/src", "value string", handle, f"{tmp_path}/state").awaitTermination()
    assert seen == ["# A\n\ntext"]


def test_command_line(spark):
    nodes = spark.createDataFrame([("a", "symbol", "Alpha", "m::alpha", "x.rs", "alpha", "m::alpha")], "entity_id string, kind string, name string, qualified_name string, file string, name_fold string, qn_fold string")
    edges = spark.createDataFrame([("r", "calls", "a", "a", "extracted")], "rel_id string, rel_type string, from_id string, to_id string, class string")
    reader = GraphReader(nodes, edges, {"build_id": "b"})
    ask = lambda *x: json.loads(cli.run(reader, cli.parser().parse_args(["root", "repo", *x])))
    assert ask("search", "alp")[0]["entity_id"] == "a" and ask("resolve", "Alpha")[0]["status"] == "entity"
    assert ask("explain", "a")[0]["outgoing"] == 1 and ask("status")["edges"] == 1
    assert ask("neighbors", "a")["cursor"] is None
