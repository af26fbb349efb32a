"""What only larger tables show: exact arithmetic, ids that coincide, hot names."""

from pyspark.sql import functions as F

from strataweave.functions.canonical import DIGITS_62, base62
from strataweave.functions.text import rfc3339
from strataweave.operators import graph_reads


def test_base62_takes_no_rounded_quotients(spark):
    def plain(n, width):
        out = ""
        for _ in range(width):
            n, k = divmod(n, 62)
            out = DIGITS_62[k] + out
        return out

    values = [0, 61, 62, 62**10 - 1, 157123 * 123456789, 62**20 - 1, 10**38 - 1]
    rows = spark.createDataFrame([(str(v),) for v in values] + [(None,)], "n string").select("n", *(base62(F.col("n"), w).alias(f"w{w}") for w in (10, 24)))
    for r in rows.collect():
        assert (r.w10, r.w24) == ((None, None) if r.n is None else (plain(int(r.n), 10), plain(int(r.n), 24)))


def test_rfc3339_beyond_the_year_9999(spark):
    """Years need no sign and may have more than four digits, and times just before midnight keep their day."""
    day = 86_400_000
    want = {0: "1970-01-01T00:00:00.000Z", -1: "1969-12-31T23:59:59.999Z", 253402300799999: "9999-12-31T23:59:59.999Z", 253402300800000: "10000-01-01T00:00:00.000Z", 500000000000000: "17814-05-16T00:53:20.000Z", -60000000000000: "0068-09-03T13:20:00.000Z"}
    want |= {100_000_000 * day - 1: "275760-09-12T23:59:59.999Z"}
    rows = spark.createDataFrame([(m,) for m in want] + [(None,)], "m long").select("m", rfc3339(F.col("m")).alias("shown"))
    assert {r.m: r.shown for r in rows.collect()} == want | {None: None}


def test_diff_goes_by_the_id_alone(spark):
    """Two relations whose cut ids coincide, of one type or of two, are no change where the id is on both sides; what is only on one side counts as often as it occurs."""
    old = spark.createDataFrame([("r1", "calls"), ("r2", "calls"), ("gone", "calls")], "rel_id string, rel_type string")
    new = spark.createDataFrame([("r1", "calls"), ("r1", "calls"), ("r2", "references"), ("new", "calls"), ("new", "references"), ("new", "calls")], "rel_id string, rel_type string")
    got = sorted(map(tuple, graph_reads.diff(old, new, "rel_id", "rel_type").collect()))
    assert got == [("gone", "calls", "removed"), ("new", "calls", "added"), ("new", "calls", "added"), ("new", "references", "added")]


def test_import_theta_on_few_names(spark, tmp_path):
    """The pairs of a name are not made: names of one brand, of two and of many, rows without name or brand."""
    from strataweave.plans.catalog import queries

    rows = [(i, f"n{i % 3}" if i % 11 else None, f"b{i * i % 5}" if i % 13 else None) for i in range(400)] + [(1000 + i, "own", "one") for i in range(5)] + [(2000 + i, "two", f"b{i % 2}") for i in range(4)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string").write.parquet(f"{tmp_path}/part.parquet")
    want = {}
    for a, n, x in rows:
        others = [b for b, m, y in rows if n is not None and m == n and x is not None and y is not None and x != y]
        if others:
            want[a] = min(others)
    found = queries()["j11_import_theta"](spark, str(tmp_path))
    assert {r.a: r.b for r in found.collect()} == want
    # Before, parts met all others of their name: no join may have parts on both sides.
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "NOT (ab" not in plan


def test_raw_strings_end_at_their_own_mark(spark):
    """A quote or bracket within a raw string is text, and one that never ends is an error; neither is looked for again from each later token."""
    from strataweave.operators import declarations as D

    assert [k for k, _, _ in D.tokens_of("rust", 'r#"a " { "# x br##"q"# "## r"" r#type')] == ["string", "ident", "string", "string", "ident"]
    assert [k for k, _, _ in D.tokens_of("rust", 'x r#"open" r#"open"')][-1] == "error"
    text = 'fn a() { let x = r#"one " { é"#; b(x) }\n' * 2 + "\n\nfn c() {}"
    found = D.syntax(spark.createDataFrame([("lib.rs", text), ("m.rs", "mod m { fn f() { r##\" }"), ("n.rs", ") fn x() {}")], "path string, text string"))
    assert {r.path: (r.status, r.declarations) for r in found.coverage.collect()} == {"lib.rs": ("parsed", 3), "m.rs": ("parse_error", 0), "n.rs": ("parse_error", 0)}
    raw, lines = text.encode(), text.split("\n")
    places = [*found.declarations.collect(), *found.sites.collect()]
    assert sorted((r.name, r.line) for r in places) == [("a", 1), ("a", 2), ("b", 1), ("b", 2), ("c", 5)]
    assert all(raw[r.byte_start : r.byte_end].decode() == r.name and lines[r.line - 1][r.col - 1 :].startswith(r.name) for r in places)


def test_records_stream_past_blocks_of_asked_rows(spark, monkeypatch):
    """Several blocks and several tables a batch give what all pairs give, and pairs are neither shuffled nor made distinct."""
    import random

    from strataweave.operators import retrieval

    monkeypatch.setattr(retrieval, "ASKED_WORDS", 40)
    monkeypatch.setattr(retrieval, "COUNTS", 60)
    rng = random.Random(4)
    rows = [(i, rng.choice(["x", "y", None]), [rng.choice("abcdefghij") for _ in range(rng.randrange(6))]) for i in range(300)] + [(400, "x", None), (None, "x", ["a"])]
    df = spark.createDataFrame(rows, "id long, g string, w array<string>")
    want = {}
    for a, g, v in rows:
        for b, h, w in rows:
            n = len(set(v or ()) & set(w or ()))
            if n and g is not None and g == h and a is not None and b is not None and a != b and a % 10 == 0:
                want[a, b] = n
    pairs = retrieval.reconcile_pairs(df.filter("id % 10 = 0"), df, "id", "g", "w")
    got = [tuple(r) for r in pairs.collect()]
    assert sorted(got) == sorted({(min(p), max(p), n) for p, n in want.items()})
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "SortMergeJoin" not in plan
    every = retrieval.related(df.filter("id % 10 = 0"), df, "id", "g", "w", 3).collect()
    assert sorted((r.a, r["rank"], r.b, r.shared) for r in every) == sorted((a, k + 1, b, -n) for a in {a for a, _ in want} for k, (n, b) in enumerate(sorted((-n, b) for (x, b), n in want.items() if x == a)[:3]))


def test_cosines_by_blocks(spark, monkeypatch):
    """Blocks of a few vectors give each pair of a group once; null labels take no part, zero vectors have no direction, null vectors no cosine."""
    import math
    import random

    from strataweave.operators import retrieval

    monkeypatch.setattr(retrieval, "VECTORS", 7)
    rng = random.Random(5)
    rows = [(i, rng.choice([1, 1, 2, None]), [rng.uniform(-1, 1) for _ in range(5)]) for i in range(90)] + [(200, 1, [0.0] * 5), (201, 2, None)]
    found = retrieval.cosine_pairs(spark.createDataFrame(rows, "id long, g int, v array<double>"), "id", "g", "v")
    got = found.collect()
    want = {}
    for a, g, x in rows:
        for b, h, y in rows:
            if g is not None and g == h and a < b:
                size = math.sqrt(sum(t * t for t in x)) * math.sqrt(sum(t * t for t in y)) if x and y else None
                want[a, b] = None if size is None else math.nan if size == 0 else sum(s * t for s, t in zip(x, y)) / size
    assert sorted((r.a, r.b) for r in got) == sorted(want)
    for r in got:
        w = want[r.a, r.b]
        assert r.cosine is None if w is None else math.isnan(r.cosine) if math.isnan(w) else abs(r.cosine - w) <= 5.1e-7 and round(r.cosine, 6) == r.cosine
    assert "FlatMapGroupsInArrow" in found._jdf.queryExecution().executedPlan().toString()


def test_communities_and_bridges_with_any_ids(spark):
    """Own ids, other texts and lookalikes stay apart; both directions, repeats and self-loops count as with all distinct pairs."""
    import random

    from strataweave.operators import analytics

    rng = random.Random(6)
    ids = [f"ent:{rng.randrange(16**12):012x}" for _ in range(12)] + ["ent:000000000000", "ent:ffffffffffff", "ENT:0000000000aa", "ent:0000000000AA", "ent:0000000000aa", "", "x", "-1"]
    home = {x: f"c{i % 4}" for i, x in enumerate(ids[:-1])}
    edges = [(rng.choice(ids), rng.choice(ids)) for _ in range(90)] + [("x", "x"), ("x", ""), ("", "x"), (None, "x")]
    e = spark.createDataFrame(edges, "from_id string, to_id string")
    label = spark.createDataFrame(list(home.items()), "entity_id string, community string")
    pairs = {p for a, b in edges if a is not None for p in ((a, b), (b, a))}
    met = analytics.community_edges(e, label)
    for r in met.collect():
        assert r.internal == sum(a < b and home.get(a) == home.get(b) == r.community for a, b in pairs)
        assert r.boundary == sum(home.get(a) == r.community and b in home and home[b] != r.community for a, b in pairs)
    nodes = label.selectExpr("entity_id", "'symbol' AS kind", "entity_id AS name")
    near = {a: [b for x, b in pairs if x == a and b in home] for a in home}
    want = sorted(((-len({home[b] for b in bs}), -len(bs), a) for a, bs in near.items() if len({home[b] for b in bs}) >= 3))[:5]
    bridges = analytics.bridge_nodes(nodes, e, label)
    assert [(-r.spans, -r.degree, r.entity_id) for r in bridges.collect()] == want
    # Pairs go to their labels once, not in both directions, and no row is doubled to count two columns.
    assert "Expand" not in bridges._jdf.queryExecution().executedPlan().toString() and "Union" not in met._jdf.queryExecution().executedPlan().toString()
