"""Conformance of the engine's own operators on small hand-made graphs and ledgers."""

import hashlib
import json
import random

import pytest

from strataweave.functions import ids
from strataweave.operators import campaign, extract, graph_reads, knowledge, ledger, leiden, retrieval, traverse
from strataweave.sources import sinks


@pytest.fixture(scope="module")
def graph(spark):
    nodes = spark.createDataFrame(
        [(x, "symbol", x.title(), f"m::{x}", f"src/{x}.rs", x, f"m::{x}") for x in "abcdez"],
        "entity_id string, kind string, name string, qualified_name string, file string, name_fold string, qn_fold string",
    )
    edges = spark.createDataFrame(
        [("r1", "calls", "a", "b", "extracted"), ("r2", "references", "a", "b", "inferred"), ("r3", "calls", "b", "c", "extracted"), ("r4", "calls", "d", "c", "ambiguous"), ("r5", "calls", "e", "e", "extracted")],
        "rel_id string, rel_type string, from_id string, to_id string, class string",
    )
    return nodes, edges


def test_ids(spark):
    want = hashlib.sha256(b"a\0b\0").hexdigest()
    assert ids.sha256_hex("a", "b") == want and ids.deterministic_id("x", "a", "b") == f"x:{want[:12]}"
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("a", "b")], "p string, q string")
    assert df.select(ids.id_col("x", F.col("p"), F.col("q"))).first()[0] == f"x:{want[:12]}"


def test_reads(graph):
    nodes, edges = graph
    assert [r.rel_id for r in graph_reads.neighbors(edges, "a").collect()] == ["r1", "r2"]
    assert graph_reads.of_types(edges, []).count() == 0 and graph_reads.of_types(edges, None).count() == 5
    first = graph_reads.page(edges, "rel_id", None, 2).collect()
    assert [r.rel_id for r in first] == ["r1", "r2"] and not first[0].complete
    assert graph_reads.page(edges, "rel_id", "r3", 2).first().complete
    loop = graph_reads.degree_counts(edges, "e").first()
    assert (loop.outgoing, loop.incoming) == (1, 1)
    assert {r.entity_id: r.degree for r in graph_reads.degrees(edges).collect()} == {"a": 1, "b": 2, "c": 2, "d": 1, "e": 1}
    assert graph_reads.resolve(nodes, "A").first().status == "entity" and graph_reads.resolve(nodes, "no").first().status == "unknown"
    assert {r["class"]: r.n for r in graph_reads.class_histogram(edges).collect()} == {"extracted": 3, "inferred": 1, "ambiguous": 1, "unknown": 0}
    assert graph_reads.search(nodes, "_", 5).count() == 0


def test_diff_is_symmetric(graph):
    nodes, _ = graph
    a, b = nodes.filter("entity_id <> 'z'"), nodes.filter("entity_id <> 'a'")
    there, back = graph_reads.diff(a, b, "entity_id").collect(), graph_reads.diff(b, a, "entity_id").collect()
    flip = {"added": "removed", "removed": "added"}
    assert sorted((r.entity_id, r.change) for r in there) == sorted((r.entity_id, flip[r.change]) for r in back) == [("a", "removed"), ("z", "added")]


def test_paths(graph):
    _, edges = graph
    path = traverse.shortest_path(edges, "a", "d", 4).orderBy("step").collect()
    assert [r.entity_id for r in path] == ["a", "b", "c", "d"]
    assert traverse.shortest_path(edges, "a", "d", 2).count() == 0
    assert [r.entity_id for r in traverse.shortest_path(edges, "a", "a", 2).collect()] == ["a"]
    assert {r.entity_id: r.depth for r in traverse.reachable(edges, "a", 2).collect()} == {"a": 0, "b": 1, "c": 2}
    assert {r.entity_id for r in traverse.reachable(edges, "d", 3, directed=True).collect()} == {"d", "c"}


def test_components_and_dags(spark):
    pairs = spark.createDataFrame([(5, 4), (4, 3), (3, 9), (20, 21), (7, 7)], "a int, b int")
    assert {r.node: r.label for r in traverse.connected(pairs).collect()} == {5: 3, 4: 3, 3: 3, 9: 3, 20: 20, 21: 20, 7: 7}
    events = spark.createDataFrame([("a", []), ("b", ["a"]), ("c", ["a"]), ("d", ["b", "c"]), ("x", ["gone"]), ("p", ["q"]), ("q", ["p"])], "id string, parents array<string>")
    assert {r.id for r in traverse.dag_heads(events).collect()} == {"d", "x"}
    assert {r.id: r.level for r in traverse.topological_levels(events).collect()} == {"a": 0, "b": 1, "c": 1, "d": 2}
    chain = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("d", "c"), ("s", None)], "id string, previous string")
    assert {r.id: (r.head, r.depth) for r in traverse.chain_depths(chain).collect()} == {"a": ("a", 0), "b": ("a", 1), "c": ("a", 2), "d": ("a", 3), "s": ("s", 0)}


def cliques():
    five = [(i, j) for i in range(5) for j in range(i)]
    return five + [(a + 5, b + 5) for a, b in five] + [(4, 5)]


def labels_of(df):
    return {(r.g, r.node): r.community for r in df.collect()}


def modularity(edges, label, gamma=1.0):
    """By the definition, for edges (a, b, w) and label[node]."""
    total = 2 * sum(w for *_, w in edges)
    inside = sum(2 * w for a, b, w in edges if label[a] == label[b])
    mass = {}
    for a, b, w in edges:
        for x in (a, b):
            mass[label[x]] = mass.get(label[x], 0) + w
    return inside / total - gamma * sum((m / total) ** 2 for m in mass.values())


@pytest.fixture(params=[leiden.LOCAL_EDGES, 0], ids=["tasks", "joins"])
def local_edges(request, monkeypatch):
    monkeypatch.setattr(leiden, "LOCAL_EDGES", request.param)
    return request.param


def test_leiden_bridged_cliques(spark, local_edges):
    """Two cliques and a lone vertex, in two graphs at once, in either order, for two resolutions."""
    rows = [(g, a, b) for g in ("x", "y") for a, b in cliques()]
    alone = spark.createDataFrame([("x", 10), ("x", 3)], "g string, node int")
    want = {(g, i): i // 5 for g in ("x", "y") for i in range(10)} | {("x", 10): 2}
    got = leiden.communities(spark.createDataFrame(rows, "g string, a int, b int"), vertices=alone)
    assert labels_of(got) == want and got.filter("quality < 0.4").count() == 0
    turned = spark.createDataFrame([(g, b, a) for g, a, b in reversed(rows)], "g string, a int, b int").repartition(3)
    assert labels_of(leiden.communities(turned, 2.0, alone)) == want


def some_graph(seed, n):
    rng = random.Random(seed)
    return [(i, j) for i in range(n) for j in range(i) if rng.random() < 3 / n]


def test_leiden_of_one_graph_beside_others(spark, monkeypatch):
    """A graph's labels and quality are its own, by either way and with both ways in one call."""
    graphs = {f"g{k}": some_graph(k, 12 + 6 * k) for k in range(3)}
    frame = lambda names: spark.createDataFrame([(g, *e) for g in names for e in graphs[g]], "g string, a int, b int")
    rows = lambda df, g: {(r.node, r.community, r.quality) for r in df.filter(f"g = '{g}'").collect()}
    alone = rows(leiden.communities(frame(["g1"])), "g1")
    monkeypatch.setattr(leiden, "LOCAL_EDGES", 2 * len(graphs["g1"]))
    mixed = leiden.communities(frame(graphs)).cache()
    assert rows(mixed, "g1") == alone
    monkeypatch.setattr(leiden, "LOCAL_EDGES", 0)
    beside = leiden.communities(frame(["g1", "g2"]))
    assert rows(beside, "g2") == rows(mixed, "g2")


def test_leiden_against_brute_force(spark, local_edges):
    """Planted groups: a quality that no other partition into their unions or parts exceeds, communities connected."""
    rng = random.Random(4)
    home = {i: i % 4 for i in range(32)}
    edges = [(i, j, float(rng.randint(1, 3))) for i in range(32) for j in range(i) if rng.random() < (0.7 if home[i] == home[j] else 0.06)]
    edges += [(0, 0, 2.0), (5, 6, 1.0)]
    got = leiden.communities(spark.createDataFrame([("g", *e) for e in edges], "g string, a int, b int, w double")).collect()
    label = {r.node: r.community for r in got}
    assert abs(got[0].quality - modularity(edges, label)) < 1e-9
    assert got[0].quality >= modularity(edges, home) - 1e-9
    for v in label:  # no vertex gains by moving alone
        for c in set(label.values()) | {-1}:
            assert modularity(edges, label | {v: c}) <= got[0].quality + 1e-9
    for c in set(label.values()):
        inside = {v for v in label if label[v] == c}
        reached = front = {min(inside)}
        while front:
            front = {y for a, b, _ in edges for x, y in ((a, b), (b, a)) if x in front and y in inside} - reached
            reached = reached | front
        assert reached == inside


def test_leiden_empty(spark, local_edges):
    assert leiden.communities(spark.createDataFrame([], "g string, a int, b int")).count() == 0


def test_rank_fusion(spark):
    one = spark.createDataFrame([(0, f"n{i}", i) for i in range(5)], "list int, id string, rank int")
    assert [r.id for r in retrieval.fuse(one).collect()] == [f"n{i}" for i in range(5)]
    both = one.unionAll(spark.createDataFrame([(1, "n4", 0)], "list int, id string, rank int"))
    assert retrieval.fuse(both).first().id == "n4"
    assert retrieval.greedy_budget([("a", 5), ("b", 9), ("c", 4)], 10) == ["a", "c"]


def test_extraction(spark):
    text = "# Top é\nsee [one](a.md) and `code`\n## Sub\n"
    files = spark.createDataFrame([("d/x.md", text), ("s.py", "import os\n\nclass Ä:\n    def go(self):\n        pass\n"), ("n.txt", None)], "path string, text string")
    rows = extract.extract(files).collect()
    for r in rows:
        if r.kind not in ("file", "symbol"):
            source = {x.path: x.text for x in files.collect()}[r.file].encode()
            assert source[r.span.byte_start : r.span.byte_end].decode() == r.name
    assert [(r.kind, r.name) for r in rows if r.file == "d/x.md"][1:] == [("heading", "Top é"), ("heading", "Sub"), ("link", "a.md"), ("code_mention", "code")]
    assert {(r.kind, r.name) for r in rows if r.file == "s.py"} >= {("definition", "Ä"), ("definition", "go"), ("import", "os")}


def test_resolution_needs_uniqueness(spark):
    defs = spark.createDataFrame([(1, "f", "x"), (2, "g", "x"), (3, "g", "y"), (4, "h", "z"), (5, "h", "z")], "def_id int, file string, name string")
    sites = spark.createDataFrame([(10, "f", "x"), (11, "k", "x"), (12, "k", "y"), (13, "h", "z")], "site_id int, file string, name string")
    assert {r.site_id: (r.def_id, r.how) for r in extract.unique_matches(sites, defs).collect()} == {10: (1, "file"), 12: (3, "global")}


def test_js_numbers():
    pairs = [(1.0, "1"), (0.1, "0.1"), (1e21, "1e+21"), (1e20, "100000000000000000000"), (1e-6, "0.000001"), (1e-7, "1e-7"), (1.5e-9, "1.5e-9"), (-0.0, "0"), (123456.789, "123456.789"), (-2.5, "-2.5"), (float("nan"), "null"), (float("-inf"), "null"), (1.7976931348623157e308, "1.7976931348623157e+308"), (5e-324, "5e-324")]
    for x, text in pairs:
        assert campaign.js_number(x) == text


def test_idempotent_ledger(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "k int, body string")
    assert ledger.idempotent(rows, "k", "body").count() == 2
    with pytest.raises(Exception, match="changed body of 1"):
        ledger.idempotent(rows.unionAll(spark.createDataFrame([(1, "z")], rows.schema)), "k", "body").collect()


def test_reconciliation(spark):
    make = lambda rows: spark.createDataFrame(rows, "k string, digest string")
    states = campaign.reconcile(make([("a", "1"), ("b", "1"), ("c", "1")]), make([("a", "1"), ("b", "2"), ("d", "1")]), "k")
    assert {r.k: r.state for r in states.collect()} == {"a": "matched", "b": "mismatched", "c": "missing", "d": "unexpected"}
    done = campaign.report(states).first()
    assert not done.clean and not done.complete


def test_greedy_chunks_and_islands(spark):
    rows = spark.createDataFrame([("g", i, s) for i, s in enumerate([4, 4, 4, 9, 1, 1])], "g string, i int, s int")
    assert [r.chunk for r in knowledge.greedy_chunks(rows, "g", "i", "s", 8).orderBy("i").collect()] == [0, 0, 1, 2, 3, 3]
    spans = spark.createDataFrame([("g", 1, 3), ("g", 2, 5), ("g", 5, 6), ("g", 9, 9)], "g string, a int, z int")
    assert sorted((r.a, r.z) for r in knowledge.merged_intervals(spans, "g", "a", "z").collect()) == [(1, 6), (9, 9)]


def test_publication(spark, graph, tmp_path):
    nodes, edges = graph
    store = sinks.BuildStore(spark, f"file://{tmp_path}/store")
    assert store.active("r") is None
    assert store.publish("r", "b1", nodes, edges, None, "d1") == 1
    assert store.publish("r", "b1", nodes, edges, None, "d1") == 1  # an exact retry
    with pytest.raises(sinks.PublishError):
        store.publish("r", "b1", nodes, edges, None, "other")
    with pytest.raises(sinks.PublishError):
        store.publish("r", "b2", nodes, edges, None, "d2")  # not its predecessor
    assert store.publish("r", "b2", nodes, edges.limit(1), "b1", "d2") == 2
    assert store.read("r")[1].count() == 1
    with pytest.raises(sinks.PublishError):
        store.publish("r", "b3", nodes.filter("entity_id <> 'a'"), edges, "b2", "d3")  # dangling


def test_exports(graph):
    nodes, edges = graph
    doc = sinks.node_link(nodes, edges, "b")
    assert [n["entity_id"] for n in doc["nodes"]] == sorted("abcdez") and json.dumps(doc)
    assert "n0 -->|calls| n1" in sinks.mermaid(nodes, edges)
    with pytest.raises(ValueError, match="more than 2 nodes"):
        sinks.capped(nodes, 2, "nodes")


def test_quote_check_needs_the_whole_quote(spark, tmp_path):
    from strataweave.plans import catalog

    opening = "the same opening words of two passages that then go apart, " * 2
    docs = [(0, f"x {opening}first end y"), (1, f"{opening}second end"), (2, None)]
    items = [(7, f"{opening}first end"), (8, f"{opening}third end")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = catalog.queries()["x17_quote_check"](spark, str(tmp_path)).collect()
    assert {r.item_id: r.sources for r in rows} == {7: 1, 8: 0}


def test_queries_have_matching_sql():
    import __spark_entry__ as entry

    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 100


def test_the_entry_imports_without_a_session():
    import subprocess
    import sys
    from pathlib import Path

    code = "import __spark_entry__ as e; assert len(e.queries()) > 100 and e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(__file__).resolve().parents[1], timeout=120)
