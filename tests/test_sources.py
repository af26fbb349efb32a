"""Sources, syntax facts, index files and the pinned reader."""

import sqlite3

import pytest
from pyspark.sql import functions as F

from strataweave.operators import lifecycle, syntax
from strataweave.reader import GraphReader
from strataweave.sources import sinks, snapshot, sqlite_source


def test_capture(spark, tmp_path):
    root = tmp_path / "repo"
    for path, body in {"a/x.md": b"# X", "a/y.bin": b"\xff\xfe", "b/z.py": b"def z(): pass", "target/t.md": b"no", "b/skip.md": b"s"}.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_bytes(body)
    rows = {r.path: r for r in snapshot.capture(spark, f"file://{root}", ["a", "b"], ["b/skip.md"]).collect()}
    assert sorted(rows) == ["a/x.md", "a/y.bin", "b/z.py"] and rows["a/x.md"].text == "# X" and rows["a/y.bin"].text is None
    ids = [snapshot.snapshot_id(snapshot.capture(spark, f"file://{root}", s), "r", ",".join(s)).first()[0] for s in (["a"], ["a"], ["b"])]
    assert ids[0] == ids[1] != ids[2]
    assert snapshot.listing(spark, f"file://{root}").agg(F.sum("bytes")).first()[0] == 21
    for bad in ("/x", "a/../b", "!a", "a\\b", ""):
        with pytest.raises(ValueError):
            snapshot.validate_scope(bad)
    assert snapshot.ignored(["a.log", "k/a.log", "keep.log", "out/x", "src/out.rs"], ["*.log", "!keep.log", "out/"]) == {"a.log", "k/a.log", "out/x"}


def test_jsonl(spark):
    lines = spark.createDataFrame([('{"id": "a"}',), ("",), ('{"id": "b"}',)], "value string")
    assert snapshot.jsonl_records(lines, "id string").count() == 2
    with pytest.raises(ValueError, match="duplicate record id a"):
        snapshot.jsonl_records(lines.union(lines), "id string")


def test_sqlite(spark, tmp_path):
    for k in range(2):
        with sqlite3.connect(tmp_path / f"s{k}.db") as db:
            db.execute("CREATE TABLE session_message (id TEXT PRIMARY KEY, seq INTEGER UNIQUE, cost REAL DEFAULT 1.5)")
            db.execute("CREATE TABLE part (message TEXT REFERENCES session_message(id), n INTEGER NOT NULL)")
            db.execute("CREATE INDEX part_n ON part (n, message)")
            db.execute("CREATE TRIGGER gone AFTER DELETE ON part BEGIN SELECT 1; END")
            db.executemany("INSERT INTO session_message VALUES (?,?,?)", [(f"m{k}-{i}", i, None if i % 5 == 0 else i / 4) for i in range(100)])
        db.close()
    sqlite_source.register(spark)
    read = lambda path: spark.read.format("sqlite").schema("id string, seq int, cost double").option("table", "session_message").option("splitBytes", 4096).load(str(path))
    df = read(tmp_path)
    assert df.count() == 200 and df.rdd.getNumPartitions() > 4
    assert read(tmp_path / "s0.db").agg({"seq": "sum"}).first()[0] == 4950
    got = df.filter("seq > 90 AND seq <= 95 AND id <> 'm0-91' AND cost IS NOT NULL AND seq IN (91, 92, 95, 7)")
    assert sorted(r.id for r in got.collect()) == ["m0-92", "m1-91", "m1-92"]
    assert df.filter("cost IS NULL AND seq >= 50").count() == 20
    found = {(r.kind, r.name, r.parent, r.detail) for r in spark.read.format("sqlite").option("table", sqlite_source.CATALOG).load(str(tmp_path / "s1.db")).collect()}
    assert {("table", "part", None, None), ("column", "cost", "table:session_message", "REAL DEFAULT 1.5"), ("primary", "id", "table:session_message", "1")} <= found
    assert {("index", "part_n", "table:part", "n,message"), ("foreign", "message", "table:part", "session_message(id)"), ("column", "n", "table:part", "INTEGER NOT NULL")} <= found
    assert any(x[0] == "trigger" and x[1] == "gone" for x in found) and sum(x[0] == "unique" for x in found) == 2
    with pytest.raises(Exception, match="not a name"):
        spark.read.format("sqlite").schema("id string").option("table", "x; DROP").load(str(tmp_path)).collect()


def test_exported_sessions(spark, tmp_path):
    rows = [(f"s{i % 7}", i, "user" if i % 2 else "assistant", None if i == 3 else f"é {i}") for i in range(40)]
    made = sqlite_source.export_sessions(spark.createDataFrame(rows, "session string, turn long, role string, text string"), f"file://{tmp_path}/db", 3)
    assert sum(r.n for r in made.collect()) == 40
    sqlite_source.register(spark)
    back = spark.read.format("sqlite").schema("session string, turn long, role string, text string").option("table", "session_message").load(f"{tmp_path}/db")
    assert sorted(map(tuple, back.collect()), key=str) == sorted(rows, key=str)
    counts = spark.read.format("sqlite").schema("id string, n long").option("table", "session").load(f"{tmp_path}/db")
    assert {r.id: r.n for r in counts.collect()} == {f"s{k}": sum(i % 7 == k for i in range(40)) for k in range(7)}


PY = "import os\n\nclass A(Base):\n    def go(self):\n        self.run()\n        helper()\n\n    def run(self):\n        pass\n\n\ndef helper():\n    return os.getcwd()\n"


def test_syntax(spark):
    files = spark.createDataFrame([("a.py", PY), ("bad.py", "def ("), ("x.txt", None)], "path string, text string")
    found = syntax.facts(files).cache()
    cover = {r.path: r.name for r in found.filter("fact = 'coverage'").collect()}
    assert cover == {"a.py": "parsed", "bad.py": "parse_error", "x.txt": "unsupported"}
    assert found.filter("path = 'bad.py' AND fact <> 'coverage'").count() == 0
    names = {(r.path, r.name, r.parent) for r in found.filter("fact = 'declaration'").collect()}
    assert {("a.py", "A", None), ("a.py", "A.go", "A"), ("a.py", "helper", None)} <= names
    assert {r.name for r in found.filter("fact IN ('inherits', 'implements')").collect()} == {"Base"}
    calls = {(r.path, r.callee) for r in syntax.resolved_calls(found).collect()}
    assert {("a.py", "a.py::helper"), ("a.py", "a.py::A.run")} <= calls
    notes = spark.createDataFrame([("a.py", 11, "NOTE"), ("a.py", 6, "TODO"), ("z.py", 1, "FIXME")], "path string, line int, note string")
    assert {(r.path, r.line): r.target for r in syntax.annotated(found, notes).collect()} == {("a.py", 11): "helper", ("a.py", 6): "A.go", ("z.py", 1): "z.py"}


def test_lifecycle(spark):
    rows = [(1, 1, 1, "admit", None), (1, 2, 2, "admit", None), (1, 3, 3, "supersede", 1), (1, 2, 4, "contradict", 3), (1, 1, 5, "admit", None), (2, 1, 1, "reject", None)]
    got = lifecycle.lifecycle(spark.createDataFrame(rows, "scope long, item long, seq long, action string, target long"))
    assert {(r.scope, r.item): r.status for r in got.collect()} == {(1, 1): "superseded", (1, 2): "disputed", (1, 3): "disputed", (2, 1): "rejected"}
    kept, shown = lifecycle.trim({"a": ["xx"] * 4, "b": ["y"]}, len, 5)
    assert len(kept["a"]) == 2 and shown == {"a": {"shown": 2, "total": 4}, "b": {"shown": 1, "total": 1}}
    with pytest.raises(ValueError):
        lifecycle.open_cursor(lifecycle.cursor("a", "r1", None), "b")


def test_reader(spark, tmp_path):
    nodes = spark.createDataFrame(
        [(x, "symbol", x, f"m::{x}", f"src/{x}.rs" if x < "d" else f"doc/{x}.md", x, f"m::{x}") for x in "abcdef"],
        "entity_id string, kind string, name string, qualified_name string, file string, name_fold string, qn_fold string",
    )
    links = [(f"r{i}", "calls", "a", t, "extracted") for i, t in enumerate("bcdef")]
    edges = spark.createDataFrame(links, "rel_id string, rel_type string, from_id string, to_id string, class string")
    store = sinks.BuildStore(spark, f"file://{tmp_path}/s")
    store.publish("r", "b1", nodes, edges, None, "x")
    reader = GraphReader.pin(spark, f"file://{tmp_path}/s", "r")
    store.publish("r", "b2", nodes.limit(1), edges.limit(0), "b1", "y")
    assert reader.status()["build_id"] == "b1" and reader.status()["edges"] == 5
    out, _, more = reader.neighbors("a", limit=2)
    assert out.count() == 2 and more
    out, _, more = reader.neighbors("a", cursor=more, limit=3)
    assert [r.rel_id for r in out.collect()] == ["r2", "r3", "r4"] and more is None
    assert reader.scoped(["src"]).edges.count() == 2
    assert reader.path("b", "c").count() == 3
    assert GraphReader.pin(spark, f"file://{tmp_path}/s", "r").diff(reader).groupBy("kind").count().count() == 2
    hunks = spark.createDataFrame([("src/b.rs", 5, 6)], "file string, h_start int, h_end int")
    spans = spark.createDataFrame([("src/b.rs", "b", 1, 9), ("src/b.rs", "c", 5, 5)], "file string, id string, start int, end int")
    assert [(r.entity_id, r.callers) for r in reader.review(hunks, spans).collect()] == [("c", 1)]
    assert "# Report of b1" in reader.report() and "<table>" in reader.export("html") and "n0 -->|calls| n1" in reader.export("mermaid")
    assert {r.entity_id for r in reader.context("where is b::", depth=1).collect()} >= set()
