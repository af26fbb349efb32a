"""Compiler indexes: exact spans in three encodings against a plain decoder, anchors, implementations, pins and faults."""

import hashlib
import random

import pytest

from strataweave.operators import compiler_index as C

GLOBAL = "scip-x pip pkg 1 "


def digest(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def occurrence(symbol, spot, roles=0, diagnostics=0):
    return {"symbol": symbol, "roles": roles, "range": spot, "diagnostics": diagnostics}


def document(path, encoding, occurrences, symbols=(), text=""):
    return {"path": path, "encoding": encoding, "occurrences": occurrences, "symbols": list(symbols), "text": text}


def normalised(spark, documents, sources, unspecified=None, pins=None, content=None):
    parts = [("r", str(i), C.encoded(d)) for i, d in enumerate(documents)] + [("r", f"x{i}", c) for i, c in enumerate(content or [])]
    made = spark.createDataFrame([(r, p, bytearray(c)) for r, p, c in parts], "receipt_id string, part string, content binary")
    part_pins = spark.createDataFrame([(r, p, digest(c)) for r, p, c in parts], "receipt_id string, part string, sha256 string")
    rows = pins if pins is not None else [("r", p, digest(t or ""), len((t or "").encode())) for p, t in sources]
    source_pins = spark.createDataFrame(rows, "receipt_id string, path string, sha256 string, bytes long")
    receipts = spark.createDataFrame([("r", "repo", "indexer", unspecified)], "receipt_id string, repo string, producer string, unspecified int")
    return C.normalised(made, spark.createDataFrame(sources, "path string, text string"), receipts, part_pins, source_pins)


def units(text, encoding):
    return len(text.encode()) if encoding == 1 else len(text.encode("utf-16-le")) // 2 if encoding == 2 else len(text)


@pytest.mark.parametrize("piece", [1024, 3])
def test_spans_in_three_encodings(spark, monkeypatch, piece):
    monkeypatch.setattr(C, "PIECE", piece)
    rng = random.Random(piece)
    sources, documents, want = [], [], {}
    for i in range(9):
        lines = ["".join(rng.choice("abé漢😀𝔘 \t") for _ in range(rng.randint(0, 14))) for _ in range(rng.randint(1, 6))]
        ends = [rng.choice(["\n", "\r\n"]) for _ in lines[:-1]] + [""]
        text, path, encoding = "".join(x + e for x, e in zip(lines, ends)), f"d/{i}", i % 3 + 1
        starts = [len("".join(x + e for x, e in zip(lines[:k], ends)).encode()) for k in range(len(lines))]
        found = []
        for k in range(8):
            a = rng.randrange(len(lines))
            z = rng.choice([a, rng.randrange(a, len(lines))])
            ca = rng.randint(0, len(lines[a]))
            cz = rng.randint(ca if a == z else 0, len(lines[z]))
            spot = [a, units(lines[a][:ca], encoding), *([] if a == z and k % 2 else [z]), units(lines[z][:cz], encoding)]
            found.append(occurrence(f"{GLOBAL}s{k}#", spot, k % 2))
            b0, b1 = starts[a] + len(lines[a][:ca].encode()), starts[z] + len(lines[z][:cz].encode())
            want[path, f"{GLOBAL}s{k}#"] = (a + 1, ca + 1, z + 1, cz + 1, b0, b1, text.encode()[b0:b1].decode())
        sources.append((path, text))
        documents.append(document(path, encoding, found))
    done = normalised(spark, documents, sources)
    assert done.faults.collect() == []
    got = {(r.path, r.symbol): (r.start_line, r.start_col, r.end_line, r.end_col, r.byte_start, r.byte_end, r.name) for r in done.occurrences.collect()}
    assert got == want


def test_states_facts_and_coverage(spark):
    a, b, c = (f"{GLOBAL}{x}#" for x in "abc")
    relation = {"symbol": a, "relations": [{"symbol": b, "implementation": True}, {"symbol": c, "implementation": True}, {"symbol": b, "implementation": False}]}
    documents = [
        document("one.rs", 1, [occurrence(a, [0, 0, 1], 1), occurrence(b, [1, 0, 1], 1), occurrence(a, [2, 0, 1]), occurrence(a, [2, 0, 1]), occurrence("local 1", [3, 0, 1], 1), occurrence("", [0, 0, 1], 0, 2)], [relation]),
        document("two.rs", 3, [occurrence(b, [0, 0, 1], 1), occurrence(b, [1, 0, 1]), occurrence(c, [1, 0, 1]), occurrence("local 1", [2, 0, 1]), occurrence(a, [3, 0, 1])]),
        document("far.rs", 9, [occurrence(a, [99, 0, 1])]),
    ]
    text = "x\ny\nz\nw\n"
    done = normalised(spark, documents, [("one.rs", text), ("two.rs", text), ("left.rs", None)])
    assert done.faults.collect() == []
    rows = done.occurrences.collect()
    states = sorted((r.path, r.symbol[-2:], r.start_line, r.state) for r in rows if r.kind == "symbol")
    # An equal occurrence counts once; a local symbol stays within its file.
    assert states == [("one.rs", "a#", 3, "resolved"), ("two.rs", " 1", 3, "unresolved"), ("two.rs", "a#", 4, "resolved"), ("two.rs", "b#", 2, "ambiguous"), ("two.rs", "c#", 2, "unresolved")]
    kinds = sorted((r.rel_type, r.path) for r in done.facts.collect())
    assert kinds == [("defines", "one.rs")] * 3 + [("defines", "two.rs")] + [("references", "one.rs"), ("references", "two.rs")]
    files = {r.path: (r.status, r.encoding, r.n_occurrences) for r in done.files.collect()}
    assert files == {"one.rs": ("indexed", "utf8", 6), "two.rs": ("indexed", "utf32", 5), "far.rs": ("outside_source_scope", None, 1), "left.rs": ("omitted_by_indexer", None, 0)}
    t = done.totals.first()
    assert (t.definitions, t.references, t.unresolved_references, t.ambiguous_references, t.symbol_less) == (4, 2, 2, 1, 1)
    assert (t.implementations, t.unresolved_implementations, t.unsupported_relationships, t.diagnostics) == (0, 2, 1, 2)
    ids = {(r.path, r.symbol, r.start_line): r.occurrence_id for r in rows}
    again = normalised(spark, documents[::-1], [("two.rs", text), ("one.rs", text), ("left.rs", None)])
    assert {(r.path, r.symbol, r.start_line): r.occurrence_id for r in again.occurrences.collect()} == ids


def test_implementations(spark):
    a, b = f"{GLOBAL}`a b`().", f"{GLOBAL}m/b#"
    relation = {"symbol": a, "relations": [{"symbol": b, "implementation": True}] * 2}
    done = normalised(spark, [document("one.rs", 0, [occurrence(a, [0, 0, 1], 1), occurrence(b, [1, 0, 1], 1)], [relation])], [("one.rs", "x\ny")], unspecified=2)
    found = done.facts.filter("rel_type = 'implements'").collect()
    ids = {r.symbol: r.occurrence_id for r in done.occurrences.collect()}
    assert [(r.from_id, r.to_id, r.byte_start) for r in found] == [(ids[a], ids[b], 0)]


FAULTS = [
    ("position outside its document", {"occurrences": [occurrence(f"{GLOBAL}a#", [0, 1, 2], 1)], "encoding": 2}),
    ("position outside its document", {"occurrences": [occurrence(f"{GLOBAL}a#", [0, 1, 4], 1)], "encoding": 1}),
    ("position outside its document", {"occurrences": [occurrence(f"{GLOBAL}a#", [0, 0, 9], 1)]}),
    ("position outside its document", {"occurrences": [occurrence(f"{GLOBAL}a#", [5, 0, 1], 1)]}),
    ("position outside its document", {"occurrences": [occurrence(f"{GLOBAL}a#", [0, 2, 1], 1)]}),
    ("position outside its document", {"occurrences": [occurrence(f"{GLOBAL}a#", [0, -1, 1], 1)]}),
    ("position outside its document", {"occurrences": [occurrence(f"{GLOBAL}a#", [0, 1], 1)]}),
    ("invalid symbol", {"occurrences": [occurrence("nonsense", [0, 0, 1], 1)]}),
    ("unknown position encoding", {"encoding": 0}),
    ("embedded text differs", {"text": "other"}),
    ("path isn't relative", {"path": "../one.rs"}),
    (None, {}),
]


def test_faults_certify_nothing(spark):
    """A receipt for each fault; only the sound one has results."""
    good = document("good.rs", 3, [occurrence(f"{GLOBAL}g#", [0, 0, 1], 1)])
    bad = document("one.rs", 3, [occurrence(f"{GLOBAL}a#", [0, 0, 1], 1)])
    parts = [(str(i), name, C.encoded(d)) for i, (_, change) in enumerate(FAULTS) for name, d in (("p", good), ("q", bad | change))]
    sources = [("good.rs", "x"), ("one.rs", "😀é")]
    done = C.normalised(
        spark.createDataFrame([(r, p, bytearray(c)) for r, p, c in parts], "receipt_id string, part string, content binary"),
        spark.createDataFrame(sources, "path string, text string"),
        spark.createDataFrame([(str(i), "repo", "indexer", None) for i in range(len(FAULTS))], "receipt_id string, repo string, producer string, unspecified int"),
        spark.createDataFrame([(r, p, digest(c)) for r, p, c in parts], "receipt_id string, part string, sha256 string"),
        spark.createDataFrame([(str(i), p, digest(t), len(t.encode())) for i in range(len(FAULTS)) for p, t in sources], "receipt_id string, path string, sha256 string, bytes long"),
    )
    assert {(r.receipt_id, r.fault) for r in done.faults.collect()} == {(str(i), f) for i, (f, _) in enumerate(FAULTS) if f}
    sound = str(len(FAULTS) - 1)
    assert {r.receipt_id for r in done.occurrences.collect()} == {r.receipt_id for r in done.totals.collect()} == {sound}
    assert done.facts.count() == 2


def test_pins(spark):
    rows = [("r", "a", digest("x"), 1), ("r", "b", digest("other"), 1), ("r", "gone", digest("x"), 1)]
    done = normalised(spark, [document("a", 3, []), document("a", 3, [])], [("a", "x"), ("b", "y"), ("new", "z")], pins=rows, content=[b"\x12\x7f", b"\xff"])
    got = sorted((r.path, r.fault) for r in done.faults.collect())
    assert got == [("a", "path occurs twice"), ("b", "source changed"), ("gone", "source missing"), ("new", "source not pinned"), ("x0", "part can't be decoded"), ("x1", "part can't be decoded")]
