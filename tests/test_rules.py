"""Operators beside the graph: diffs, causal staging, folds, retrieval, serving, publication, context."""

import base64
import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from strataweave.functions import ids
from strataweave.operators import extract, knowledge, lifecycle, policies, retrieval, serving, validation
from strataweave.reader import GraphReader
from strataweave.sources import sinks, snapshot
from strataweave.streaming import projections


def test_digests_stream_in_order(spark):
    rows = [(k, i, f"t{i}") for k in "ab" for i in range(7)]
    df = spark.createDataFrame(rows, "k string, i int, t string").repartition(5)
    want = hashlib.sha256(b"".join(f"t{i}\0".encode() for i in range(7))).hexdigest()
    got = ids.digests(df, ["k"], ["i"], F.col("t")).collect()
    assert {(r.k, r.digest, r.n) for r in got} == {("a", want, 7), ("b", want, 7)}
    one = ids.digests(df.filter("k = 'a'"), [], ["i"], F.col("t")).collect()
    assert [(r.digest, r.n) for r in one] == [(want, 7)]
    assert ids.digests(df.limit(0), [], ["i"], F.col("t")).count() == 0


def test_added_files_go_by_their_new_path(spark):
    diff = "--- a/x.rs\n+++ b/x.rs\n@@ -1,2 +1 @@\n--- /dev/null\n+++ b/new/y.rs\n@@ -0,0 +1,3 @@\n--- a/z.rs\n+++ /dev/null\n@@ -4 +0,0 @@"
    lines = [("one", i, x) for i, x in enumerate(diff.split("\n"))]
    rows = snapshot.parse_diff(spark.createDataFrame(lines, "diff string, pos int, line string"), ["diff"]).collect()
    assert [(r.file, r.h_start, r.h_end) for r in rows] == [("x.rs", 1, 2), ("new/y.rs", 0, 0), ("z.rs", 4, 4)]


def test_a_child_of_a_staged_event_waits_too(spark):
    events = spark.createDataFrame([("a", []), ("b", ["a"]), ("c", ["gone"]), ("d", ["c", "a"]), ("e", ["d"]), ("f", ["old"])], "id string, parents array<string>")
    ready, staged = projections.ready_events(events, spark.createDataFrame([("old",)], "id string"))
    assert {r.id for r in ready.collect()} == {"a", "b", "f"} and {r.id for r in staged.collect()} == {"c", "d", "e"}


def test_folds_against_loops(spark):
    rng = random.Random(5)
    rows = [(g, i, rng.randint(1, 9)) for g in range(5) for i in range(rng.randint(1, 40))]
    df = spark.createDataFrame(rows, "g long, i long, s long").repartition(4)
    want, full = {}, {}
    for g in range(5):
        used = chunk = size = file = 0
        for _, i, s in sorted(r for r in rows if r[0] == g):
            if used and used + s > 12:
                used, chunk = 0, chunk + 1
            if size >= 12:
                size, file = 0, file + 1
            used, size = used + s, size + s
            want[g, i], full[g, i] = chunk, file
    assert {(r.g, r.i): r.chunk for r in knowledge.greedy_chunks(df, "g", "i", "s", 12).collect()} == want
    assert {(r.g, r.i): r.chunk for r in knowledge.rotation(df, "g", "i", "s", 12).collect()} == full
    acts = ["admit", "withhold", "reject", "supersede", "contradict"]
    receipts = [(g, rng.randrange(6), i, rng.choice(acts), rng.randrange(6)) for g in range(4) for i in range(60)]
    state: dict = {}
    for g, item, _, action, target in sorted(receipts, key=lambda r: (r[0], r[2])):
        plain = {"admit": "admitted", "withhold": "withheld", "reject": "rejected"}.get(action)
        if plain and state.get((g, item)) != "superseded":
            state[g, item] = plain
        elif action == "supersede":
            state[g, item], state[g, target] = "admitted", "superseded"
        elif action == "contradict":
            for x in (item, target):
                if state.get((g, x)) != "superseded":
                    state[g, x] = "disputed"
    got = lifecycle.lifecycle(spark.createDataFrame(receipts, "scope long, item long, seq long, action string, target long").repartition(3))
    assert {(r.scope, r.item): r.status for r in got.collect()} == state


def test_quotes_are_found_whole(spark):
    texts = spark.createDataFrame([(1, "the quick brown fox jumps over"), (2, "xthe quick brown fox jumpsy"), (3, "the quick  brown fox jumps"), (4, None)], "id int, text string")
    quotes = spark.createDataFrame([("a", "he quick brown fox jum"), ("b", "fox"), ("c", "quick brown fox jumps away"), ("d", " quick brown fox jumps ")], "q string, quote string")
    got = {(r.q, r.id) for r in retrieval.holding(texts, "text", quotes, "quote").collect()}
    assert got == {("a", 1), ("a", 2), ("b", 1), ("b", 2), ("b", 3), ("d", 1)}


def test_related_counts_every_word(spark):
    rng = random.Random(2)
    rows = [(i, i % 2, [rng.choice("abcdefgh") for _ in range(5)]) for i in range(30)]
    df = spark.createDataFrame(rows, "id int, g int, w array<string>")
    got = retrieval.related(df.filter("id % 10 = 0"), df, "id", "g", "w", 3).collect()
    for a, g, words in rows[::10]:
        near = sorted((-len(set(words) & set(w)), i) for i, h, w in rows if h == g and i != a and set(words) & set(w))[:3]
        assert [(r.b, r.shared) for r in sorted(got, key=lambda r: r["rank"]) if r.a == a] == [(i, -n) for n, i in near]


def test_report_sections_and_pruning():
    report = "# Head\n" + "".join(f"\n## S{i}\n" + "x" * 50 for i in range(6))
    assert serving.fitted_sections(report, 10_000) == (report, None)
    cut, shown = serving.fitted_sections(report, 200)
    assert len(cut) <= 200 and shown == {"shown": cut.count("## S") + 1, "total": 7} and "sections omitted" in cut
    assert serving.fitted_sections(report, 1)[1] == {"shown": 1, "total": 7}
    size = lambda n, e: 10 * len(n) + 5 * len(e)
    links = [("a", "b"), ("b", "c"), ("a", "d")]
    assert serving.pruned(list("abcd"), links, size, 100) == (list("abcd"), links)
    assert serving.pruned(list("abcd"), links, size, 30) == (["a", "b"], [("a", "b")])
    assert serving.pruned(list("abcd"), links, size, 0) == ([], [])
    with pytest.raises(ValueError, match="metadata"):
        serving.pruned(["a"], [], lambda n, e: 9, 5)


def test_knowledge_generations(spark):
    versions = spark.createDataFrame([], "scope string, generation int, body string")
    pointer = versions.select("scope", "generation")
    versions, pointer = serving.publish(versions, pointer, "s", "one", 0)
    versions, pointer = serving.publish(versions, pointer, "s", "two", 1)
    assert [tuple(r) for r in serving.current(versions, pointer).collect()] == [("s", 2, "two")]
    with pytest.raises(ValueError, match="generation 2 is published"):
        serving.publish(versions, pointer, "s", "again", 1)


def test_inventory_stops_at_its_budgets(spark):
    files = spark.createDataFrame([(f"f{i:03}", 10) for i in range(40)], "path string, bytes long")
    assert tuple(snapshot.inventory(files).first()) == (40, 400, True, None)
    assert tuple(snapshot.inventory(files, most_files=7).first()) == (7, 70, False, "files")
    assert tuple(snapshot.inventory(files, most_bytes=95).first()) == (9, 90, False, "bytes")


def test_receipts_by_generation(spark, tmp_path):
    (tmp_path / "journal-1").mkdir()
    for name, n in (("ses_a.json", 1), ("ses_a.2.json", 2), ("ses_b.json", 3), ("ses_b.1.json", 4), ("notes.txt", 5)):
        (tmp_path / "journal-1" / name).write_text('{"n": %d,\n "digest": "d%d"}' % (n, n))
    rows = snapshot.receipts(spark, f"file://{tmp_path}", "n long, digest string").collect()
    assert {(r.id, r.generation, r.newest, r.digest) for r in rows} == {("ses_a", 1, False, "d1"), ("ses_a", 2, True, "d2"), ("ses_b", 1, True, "d3")}


def test_cursors_belong_to_a_build_entity_and_types(spark, small):
    reader = GraphReader(*small, {"build_id": "b1"})
    _, _, more = reader.neighbors("n2", limit=1)
    assert more is not None and reader.neighbors("n2", cursor=more)[2] is None
    for other in (lambda: reader.neighbors("n0", cursor=more), lambda: reader.neighbors("n2", ["calls"], more), lambda: GraphReader(*small, {"build_id": "b2"}).neighbors("n2", cursor=more)):
        with pytest.raises(ValueError, match="another scope"):
            other()


def test_facts_are_all_or_nothing(spark):
    files = spark.createDataFrame([("f", "fn né() {}")], "file string, text string")
    schema = "fact_id int, file string, byte_start int, byte_end int, quoted string, rel_type string, from_kind string, to_kind string"
    good = [(1, "f", 3, 6, "né", "calls", "definition", "definition")]
    assert validation.accepted(spark.createDataFrame(good, schema), files).count() == 1
    bad = [*good, (2, "f", 3, 5, "né", "calls", "definition", "definition")]
    assert validation.accepted(spark.createDataFrame(bad, schema), files).count() == 0


def test_item_text_takes_leading_lines():
    text = "x\n/// doc\n#[attr]\nfn go() {}\nrest"
    at = text.index("go")
    assert extract.item_text(text, at, text.index("\nrest")) == "/// doc\n#[attr]\nfn go() {}"
    assert len(extract.item_text("é" * 900, 0, 900).encode()) == 1024 and extract.item_text(" \n ", 0, 2) is None


def test_impact_stops_at_pins_and_blocks(spark):
    bridges = spark.createDataFrame([("a", "b", None, False), ("b", "c", 2, False), ("b", "d", 1, False), ("c", "e", None, True), ("a", "zz", None, False)], "from_id string, to_id string, pin int, blocked boolean")
    versions = spark.createDataFrame([(x, 2) for x in "abcde"], "id string, version int")
    reached, stopped = policies.impact(bridges, versions, "a", 5)
    assert {(r.entity_id, r.depth) for r in reached.collect()} == {("a", 0), ("b", 1), ("c", 2)}
    assert {(r.to_id, r.why) for r in stopped.collect()} == {("d", "version mismatch"), ("e", "blocked"), ("zz", "unknown")}


@pytest.fixture(scope="module")
def small(spark):
    names = ["parser", "lexer", "token stream", "writer", "parse tree"]
    nodes = spark.createDataFrame([(f"n{i}", "symbol", n, f"m::{n}", f"src/a{i % 2}/{i}.rs", n, f"m::{n}") for i, n in enumerate(names)], "entity_id string, kind string, name string, qualified_name string, file string, name_fold string, qn_fold string")
    edges = spark.createDataFrame([("r0", "calls", "n0", "n1", "extracted"), ("r1", "calls", "n1", "n2", "extracted"), ("r2", "calls", "n3", "n2", "inferred")], "rel_id string, rel_type string, from_id string, to_id string, class string")
    return nodes, edges


def test_context_drops_stop_words_fuses_and_fits(spark, small):
    reader = GraphReader(*small)
    found = reader.context("what is the parser of it", depth=1).collect()
    assert [(r.entity_id, r.depth) for r in found] == [("n0", 0), ("n1", 1)]
    order = spark.createDataFrame([("n3", 0)], "id string, rank int")
    assert {r.entity_id for r in reader.context("parser", depth=1, semantic=order).collect()} == {"n0", "n3", "n1", "n2"}
    assert [r.entity_id for r in reader.context("parser", depth=2, budget=24).collect()] == ["n0"]


def test_reader_communities_are_leiden(small):
    got = {r.entity_id: r.community for r in GraphReader(*small).communities().collect()}
    assert len(got) == 5 and got["n0"] == got["n1"] and list(got.values()).count(got["n4"]) == 1


def test_publication_is_whole_or_not_at_all(spark, small, tmp_path):
    nodes, edges = small
    store = sinks.BuildStore(spark, f"file://{tmp_path}/s")
    with pytest.raises(sinks.PublishError, match="leaves the build"):
        store.publish("r", "b0", nodes.filter("entity_id <> 'n2'"), edges, None, "d")
    with pytest.raises(sinks.PublishError, match="share an id"):
        store.publish("r", "b0", nodes.unionAll(nodes), edges, None, "d")
    assert store.publish("r", "b1", nodes, edges, None, "d1") == 1
    assert store.publish("r", "b2", nodes, edges.limit(1), "b1", "d2") == 2
    with pytest.raises(sinks.PublishError, match="superseded"):
        store.publish("r", "b1", nodes, edges, "b2", "d1")
    # A writer that died after its claim: others are refused at first, and take over in time.
    store._claim("r", 3)
    with pytest.raises(sinks.PublishError, match="being published"):
        store.publish("r", "b3", nodes, edges, "b2", "d3")
    assert store.active("r")[1]["build_id"] == "b2"
    store.CLAIM_MS = 0
    assert store.publish("r", "b3", nodes, edges, "b2", "d3") == 3 and store.read("r", 2)[1].count() == 1


def test_trimmed_pages_lose_no_relation(spark):
    """Pages within a budget of tokens, whatever it is, give every relation once; cursors that were changed don't open."""
    edges = spark.createDataFrame([(f"o{i:02}", "calls", "a", f"b{i}", "extracted") for i in range(9)] + [(f"i{i:02}", "calls", f"c{i}", "a", "extracted") for i in range(4)], "rel_id string, rel_type string, from_id string, to_id string, class string")
    nodes = spark.createDataFrame([("a", "symbol", "A", "m::a", "x.rs", "a", "m::a")], "entity_id string, kind string, name string, qualified_name string, file string, name_fold string, qn_fold string")
    reader = GraphReader(nodes, edges, {"build_id": "b"})
    for tokens in (1, 70, 200):
        seen, more, pages = [], None, 0
        while True:
            out, into, more = reader.neighbors("a", cursor=more, limit=5, tokens=tokens)
            seen += [r.rel_id for r in out.collect() + into.collect()]
            pages += 1
            if more is None:
                break
        assert sorted(seen) == sorted(r.rel_id for r in edges.collect()), tokens
        assert tokens > 1 or pages == 13
    more = reader.neighbors("a", limit=2)[2]
    forged = json.loads(base64.urlsafe_b64decode(more))
    forged[2] = "o00"
    for text in (base64.urlsafe_b64encode(json.dumps(forged).encode()).decode(), "nonsense", more[:-8]):
        with pytest.raises(ValueError):
            reader.neighbors("a", cursor=text)
