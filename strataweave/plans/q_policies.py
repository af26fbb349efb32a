"""Queries of visibility, coverage, knowledge views, budgets and work lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.ids import id_col
from ..functions.text import is_doc
from ..operators import extract as X
from ..operators import lifecycle as C
from ..operators import policies as P
from ..session import table
from ..sources import snapshot as S
from ..sources import tpch_graph as G
from .q_graph import HUNKS, SPANS
from .registry import GRAPH, ent, query


def count():
    return F.count(F.lit(1))


@query("e4_text_symbols", "SELECT 'docs/'||doc_id||'.txt' AS file, 'symbol' AS kind, doc_id||'.txt' AS name, 'docs/'||doc_id||'.txt::text' AS qualified_name FROM documents")
def e4(spark, d):
    docs = table(spark, d, "documents").select(F.concat(F.lit("docs/"), "doc_id", F.lit(".txt")).alias("path"), "text")
    return X.extract(docs).filter("kind = 'symbol'").select("file", "kind", "name", "qualified_name")


@query("e14_embedding_input", f"WITH {GRAPH} SELECT n.entity_id, CASE WHEN kind='definition' THEN sha256(qualified_name||chr(10)||name) END AS input FROM nodes n")
def e14(spark, d):
    return G.nodes(spark, d).select("entity_id", F.sha2(X.embedding_input(F.col("kind"), F.col("qualified_name"), F.col("name")), 256).alias("input"))


@query("p8_eligibility", "SELECT doc_id, lang AS repo FROM documents WHERE NOT (doc_id % 5 IN (0,1)) AND lang IN ('en','fr')")
def p8(spark, d):
    status = F.when(F.col("doc_id") % 5 == 0, "superseded").when(F.col("doc_id") % 5 == 1, "withheld").otherwise("admitted")
    docs = table(spark, d, "documents").select("doc_id", F.col("lang").alias("repo"), status.alias("status"))
    return P.eligible(docs, ["en", "fr"]).select("doc_id", "repo")


@query("p9_grants", "SELECT doc_id AS id FROM documents d WHERE source='src1' OR (source='src2' AND doc_id%3<>0) OR EXISTS (SELECT 1 FROM labels l WHERE l.doc_id=d.doc_id AND l.quality=1 AND d.source NOT IN ('src1','src2'))")
def p9(spark, d):
    """A user's own items, the admitted ones of an owner who grants all, and those that labels select."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("owner"), F.when(F.col("doc_id") % 3 == 0, "withheld").otherwise("admitted").alias("status"))
    every = spark.createDataFrame([("src2", "src1", None)], "owner string, reader string, item long")
    picked = table(spark, d, "labels").filter("quality = 1").join(docs, F.col("doc_id") == F.col("id")).filter("owner NOT IN ('src1', 'src2')")
    return P.granted(docs, "src1", every.unionAll(picked.select("owner", F.lit("src1"), "id"))).select("id")


@query("p11_test_paths", "WITH p AS (SELECT p_partkey, CASE p_partkey%8 WHEN 0 THEN 'src/tests/a.rs' WHEN 1 THEN 'src/a_test.go' WHEN 2 THEN 'src/test_a.py' WHEN 3 THEN 'src/a.spec.ts' WHEN 4 THEN 'src/latest/a.rs' WHEN 5 THEN 'src/contest_a.py' WHEN 6 THEN 'test/a.c' ELSE 'src/attest.rs' END AS path FROM part) SELECT path, p_partkey%8 IN (0,1,2,3,6) AS is_test, count(*) AS n FROM p GROUP BY 1,2")
def p11(spark, d):
    names = F.array(*map(F.lit, ["src/tests/a.rs", "src/a_test.go", "src/test_a.py", "src/a.spec.ts", "src/latest/a.rs", "src/contest_a.py", "test/a.c", "src/attest.rs"]))
    paths = table(spark, d, "part").select(F.element_at(names, (F.col("p_partkey") % 8 + 1).cast("int")).alias("path"))
    return paths.groupBy("path", P.is_test_path(F.col("path")).alias("is_test")).agg(count().alias("n"))


PRODUCERS = "pr AS (SELECT l_suppkey, l_partkey, list(CASE WHEN l_returnflag='R' THEN 'decision:model' WHEN l_linestatus='O' THEN 'extractor:rust' ELSE 'catalog:pg' END) AS p FROM lineitem GROUP BY 1,2)"


@query("a9_coverage_counts", f"WITH {PRODUCERS} SELECT 'implements' AS rel_type, count(*) AS n, count(*) FILTER (WHERE len(list_filter(p, lambda x: x<>'extractor:rust'))=0) AS structural, count(*) FILTER (WHERE list_contains(p,'decision:model')) AS decided, count(*) FILTER (WHERE len(list_filter(p, lambda x: x<>'catalog:pg'))=0) AS catalog FROM pr")
def a9(spark, d):
    who = F.when(F.col("l_returnflag") == "R", "decision:model").when(F.col("l_linestatus") == "O", "extractor:rust").otherwise("catalog:pg")
    edges = table(spark, d, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.collect_list(who).alias("producers"))
    return P.coverage_counts(edges.withColumn("rel_type", F.lit("implements")))


@query("a10_coverage_report", f"WITH {GRAPH}, f AS (SELECT DISTINCT file AS path FROM nodes) SELECT count(*) AS files, count(*) FILTER (WHERE contains(path,'Brand#1')) AS parse_errors, count(*) FILTER (WHERE NOT ends_with(path,'.md')) AS heuristic, (list(path ORDER BY path) FILTER (WHERE NOT ends_with(path,'.md')))[1:100] AS first, greatest(count(*) FILTER (WHERE NOT ends_with(path,'.md'))-100,0) AS omitted FROM f")
def a10(spark, d):
    paths = G.nodes(spark, d).select(F.col("file").alias("path")).distinct()
    return P.coverage_report(paths.select("path", F.col("path").contains("Brand#1").alias("parse_errors"), (~is_doc(F.col("path"))).alias("heuristic")))


@query("a11_selected_omitted", "SELECT p_brand AS reason, least(count(*),20) AS selected, greatest(count(*)-20,0) AS omitted FROM part GROUP BY 1")
def a11(spark, d):
    return P.selected_omitted(table(spark, d, "part").select(F.col("p_brand").alias("reason")), 20)


@query("a15_retained_builds", "WITH m AS (SELECT o_orderpriority AS build, o_custkey AS e FROM orders GROUP BY 1,2), u AS (SELECT e, count(*) AS n FROM m GROUP BY 1), b AS (SELECT DISTINCT o_orderpriority AS build FROM orders UNION ALL SELECT 'empty') SELECT b.build, count(m.e) AS members, count(*) FILTER (WHERE n>1) AS shared, b.build='1-URGENT' AS is_active FROM b LEFT JOIN m ON m.build=b.build LEFT JOIN u USING (e) GROUP BY 1")
def a15(spark, d):
    members = table(spark, d, "orders").select(F.col("o_orderpriority").alias("build"), F.col("o_custkey").alias("entity_id")).distinct()
    builds = members.select("build").distinct().unionAll(spark.createDataFrame([("empty",)], "build string"))
    return P.retained_builds(members, builds, spark.createDataFrame([("1-URGENT",)], "build string"))


def copies(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    first = docs.groupBy("h").agg(F.min("doc_id").alias("a"))
    return docs, docs.join(first, "h").filter("a < doc_id").select("a", F.col("doc_id").alias("b"))


COPIES = "c AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY md5(text)) AS a FROM documents)"


@query("g25_clusters", f"WITH {COPIES}, k AS (SELECT a, doc_id FROM c WHERE doc_id<>a AND doc_id%5<>0) SELECT a AS node, a AS label FROM k UNION SELECT doc_id, a FROM k")
def g25(spark, d):
    _, pairs = copies(spark, d)
    return P.clusters(pairs, pairs.filter("b % 5 = 0").select(F.col("b").alias("a"), F.col("a").alias("b")))


@query("r10_current_view", f"WITH {COPIES}, s AS (SELECT * FROM c WHERE doc_id%9<>0), t AS (SELECT DISTINCT doc_id FROM labels WHERE toxic=1) SELECT min(s.doc_id) AS id, a AS canonical, bool_or(t.doc_id IS NOT NULL) AS disputed FROM s LEFT JOIN t USING (doc_id) GROUP BY a")
def r10(spark, d):
    docs, pairs = copies(spark, d)
    items = docs.select(F.col("doc_id").alias("id"))
    return P.current_view(items, items.filter("id % 9 = 0"), pairs, table(spark, d, "labels").filter("toxic = 1").select(F.col("doc_id").alias("id")))


@query("r6_embedding_backfill", "WITH p AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id)-1 AS n FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)) SELECT doc_id, (n // 32)::INT AS batch FROM p")
def r6(spark, d):
    return P.pending_batches(table(spark, d, "documents"), table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id")), "doc_id", 32)


@query("u5_idempotent_merge", "SELECT event_id, event_type AS body FROM events")
def u5(spark, d):
    e = table(spark, d, "events").select("event_id", F.col("event_type").alias("body"))
    return P.merged_events(e.filter("event_id % 3 = 0"), e.filter("event_id % 2 = 0"), e)


@query("d7_response_validation", "SELECT event_id, CASE WHEN event_type NOT IN ('view','click','purchase') THEN 'unknown label' WHEN value IS NULL OR value<0 OR value>100 THEN 'out of range' ELSE 'valid' END AS verdict FROM events")
def d7(spark, d):
    verdict = P.response_verdict(F.col("event_type"), ["view", "click", "purchase"], F.col("value"), 0, 100)
    return table(spark, d, "events").select("event_id", verdict.alias("verdict"))


@query(
    "d7_answer_batches",
    """WITH a AS (SELECT event_id//10 AS batch, event_id%10 AS question, ['noul','choice','score'][event_id%3+1] AS kind, value/100 AS v, event_id, event_type FROM events),
    f AS (SELECT batch, CASE WHEN event_id%97=3 THEN 'missing answer' WHEN event_id%101=4 THEN 'another model' WHEN event_id%103=5 THEN 'another kind' WHEN kind='noul' AND (v IS NULL OR v>1) THEN 'out of range'
    WHEN kind='choice' AND event_id%89=6 THEN 'probabilities don''t sum to 1' WHEN kind='choice' AND event_type='error' THEN 'option wasn''t asked' WHEN kind='score' AND event_id%83=7 THEN 'out of range' END AS fault FROM a)
    SELECT batch, min(fault) AS fault FROM f WHERE fault IS NOT NULL GROUP BY 1""",
)
def d7b(spark, d):
    """Ten events are a batch of questions; answers that are missing, of another model or kind, out of range or beside what was asked refuse it whole."""
    e = table(spark, d, "events").select("event_id", "event_type", F.expr("event_id div 10").alias("batch"), (F.col("event_id") % 10).alias("question"), (F.col("value") / 100).alias("v"))
    kind = F.element_at(F.array(F.lit("noul"), F.lit("choice"), F.lit("score")), (F.col("event_id") % 3 + 1).cast("int"))
    options = F.array(*map(F.lit, ("view", "click", "purchase", "signup", "rest")))
    asked = e.select("batch", "question", kind.alias("kind"), F.when(kind == "choice", options).alias("options"))
    share = F.when(F.col("event_id") % 89 == 6, 0.6).otherwise(0.75)
    answered = F.when(F.col("event_id") % 103 == 5, "essay").otherwise(kind)
    answers = e.filter("event_id % 97 <> 3").select(
        "batch", "question", answered.alias("kind"), F.col("v").alias("probability"), F.col("event_type").alias("choice"), F.lit(0.9).alias("confidence"),
        F.create_map(F.col("event_type"), share, F.lit("rest"), F.lit(0.25)).alias("probabilities"), F.when(F.col("event_id") % 83 == 7, float("inf")).otherwise(F.col("v")).alias("score"),
        F.when(F.col("event_id") % 101 == 4, "other").otherwise("pinned").alias("model"),
    )
    return P.answer_faults(asked, answers, "pinned")


@query("x19_answer_thresholds", "SELECT event_id, CASE WHEN value>=90 THEN 'accept' WHEN value<=10 THEN 'refuse' ELSE 'ask again' END AS verdict FROM events")
def x19(spark, d):
    return table(spark, d, "events").select("event_id", P.answer_verdict(F.col("value"), 90, 10).alias("verdict"))


def sessions(spark, d):
    return table(spark, d, "conversations").withColumnRenamed("conv_id", "session")


@query("d17_compaction_plan", "SELECT conv_id AS session, turn, CASE WHEN turn=min(turn) OVER (PARTITION BY conv_id) OR role='system' THEN 'kept' WHEN length(text)>400 THEN 'moved' ELSE 'inline' END AS fate FROM conversations")
def d17(spark, d):
    return P.compaction_plan(sessions(spark, d), 400).select("session", "turn", "fate")


@query("x18_timeline", "WITH n AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, role||':'||length(text) AS b FROM conversations) SELECT conv_id AS session, string_agg(b, ' ' ORDER BY i) FILTER (WHERE i<=4) AS brief, count(*) FILTER (WHERE i>4) AS omitted FROM n GROUP BY 1")
def x18(spark, d):
    return P.timeline(sessions(spark, d), 4)


@query("d20_ledger_validation", "SELECT l.doc_id AS id, CASE WHEN d.doc_id IS NULL THEN 'no source' WHEN quality IS NULL OR quality NOT IN (0,1) THEN 'bad value' ELSE 'sound' END AS state FROM labels l LEFT JOIN (SELECT DISTINCT doc_id FROM documents WHERE n_chars>1000) d ON d.doc_id=l.doc_id")
def d20(spark, d):
    found = table(spark, d, "labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("value"))
    return P.ledger_states(found, table(spark, d, "documents").filter("n_chars > 1000").select(F.col("doc_id").alias("id")), [0, 1])


@query("x6_current_handles", "SELECT DISTINCT o_custkey AS id, o_orderkey AS generation FROM orders o WHERE o_orderkey=(SELECT max(o_orderkey) FROM orders x WHERE x.o_custkey=o.o_custkey)")
def x6(spark, d):
    handles = table(spark, d, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("generation"))
    return P.live_handles(handles, handles.groupBy("id").agg(F.max("generation").alias("generation")))


@query("x9_operation_page", "SELECT event_id, event_type AS name FROM events WHERE contains(lower(event_type),'p') ORDER BY event_id LIMIT 10 OFFSET 20")
def x9(spark, d):
    return P.operation_page(table(spark, d, "events").select("event_id", F.col("event_type").alias("name")), "P", "event_id", 20, 10)


@query("x12_freshness", "SELECT CASE WHEN doc_id%10=3 THEN 'gone' WHEN doc_id%10=4 THEN 'new' WHEN doc_id%6=0 THEN 'stale' ELSE 'fresh' END AS state, count(*) AS n FROM documents GROUP BY 1")
def x12(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.col("doc_id").cast("string").alias("path"), F.sha2("text", 256).alias("sha256"))
    then = docs.filter("doc_id % 10 <> 4").withColumn("sha256", F.when(F.col("doc_id") % 6 == 0, "x").otherwise(F.col("sha256")))
    return P.freshness(docs.filter("doc_id % 10 <> 3"), then)


@query("x16_catalog_graph", "SELECT DISTINCT 'catalog' AS from_key, 'table:'||table_name AS to_key, 'defines' AS rel_type FROM information_schema.columns WHERE table_name IN ('region','nation','labels') UNION ALL SELECT 'table:'||table_name, 'column:'||table_name||'.'||column_name, 'contains' FROM information_schema.columns WHERE table_name IN ('region','nation','labels')")
def x16(spark, d):
    rows = S.catalog_records({t: table(spark, d, t) for t in ("region", "nation", "labels")})
    return P.catalog_graph(spark.createDataFrame(rows, "key string, kind string, name string, parent string"))


@query("x22_status", f"WITH {GRAPH} SELECT 'star' AS repo, 'build-2' AS build_id, (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM edges) AS edges, (SELECT count(*) FROM edges) > 0 AS publishable")
def x22(spark, d):
    return P.published_status(G.nodes(spark, d), G.edges(spark, d), {"repo": G.REPO, "build_id": G.BUILD})


@query("x23_publishable", f"WITH {GRAPH} SELECT 'no relations' AS build_id, (SELECT count(*) FROM nodes WHERE kind='module') AS nodes, 0::BIGINT AS edges, false AS publishable")
def x23(spark, d):
    """A build without relations is not publishable."""
    return P.published_status(G.nodes(spark, d, ("region", "nation")), G.edges(spark, d, ("contains",)).filter("rel_type = 'calls'"), {"build_id": "no relations"})


@query("x26_identity_pins", "WITH p AS (SELECT DISTINCT conv_id AS id FROM conversations), n AS (SELECT conv_id AS id, count(DISTINCT md5(text)) AS n, min(sha256(text)) AS s FROM conversations WHERE turn IN (0,1) GROUP BY 1), f AS (SELECT conv_id AS id, sha256(text) AS f FROM conversations WHERE turn=0 AND conv_id%4<>0) SELECT n.id, CASE WHEN n.n>1 THEN 'pinned twice' WHEN f.f IS NULL THEN 'missing' WHEN f.f=n.s THEN 'pinned' ELSE 'other bytes' END AS state FROM n LEFT JOIN f ON f.id=n.id")
def x26(spark, d):
    c = table(spark, d, "conversations").select("turn", F.col("conv_id").alias("id"), F.sha2("text", 256).alias("sha256"))
    return P.pinned_ids(c.filter("turn IN (0, 1)"), c.filter("turn = 0 AND id % 4 <> 0"))


@query("x28_evidence_packet", "WITH s AS (SELECT DISTINCT user_id AS owner, event_type||' '||props AS what FROM events), n AS (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY what) AS rn, count(*) OVER (PARTITION BY owner) AS total FROM s) SELECT owner, what, greatest(total-4,0) AS omitted FROM n WHERE rn<=4")
def x28(spark, d):
    return P.evidence_packet(table(spark, d, "events").select(F.col("user_id").alias("owner"), F.concat_ws(" ", "event_type", "props").alias("what")), 4)


@query("x29_work_list", "SELECT o_orderkey AS id FROM orders o WHERE o_orderstatus<>'F' AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag='R') AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment='BUILDING') ORDER BY 1 LIMIT 64")
def x29(spark, d):
    items = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderstatus") != "F").alias("present"), F.col("o_custkey").alias("scope"))
    released = table(spark, d, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("id"))
    return P.work_list(items, released, table(spark, d, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("scope")), 64)


@query("x31_catalog_recheck", "SELECT p_partkey, CASE WHEN p_partkey%19=0 THEN 'extracted' WHEN p_partkey%23=0 THEN 'staged' ELSE 'changed' END AS state FROM part WHERE p_partkey%17=0 OR p_partkey%19=0 OR p_partkey%23=0")
def x31(spark, d):
    p = table(spark, d, "part")
    staged = p.filter("p_partkey % 19 <> 0").withColumn("p_name", F.when(F.col("p_partkey") % 17 == 0, F.concat("p_name", F.lit("!"))).otherwise(F.col("p_name")))
    return P.rechecked(staged, p.filter("p_partkey % 19 = 0 OR p_partkey % 23 <> 0"), "p_partkey")


BRIDGES = "br AS (SELECT 's'||l_suppkey AS a, 'p'||l_partkey AS b, CASE WHEN l_linenumber%3=0 THEN l_linenumber%4 END AS pin, l_returnflag='R' AND l_linenumber=2 AS blk FROM lineitem UNION ALL SELECT 'p'||p_partkey, 's'||(p_partkey%97), NULL, false FROM part WHERE p_size>45), vr AS (SELECT 'p'||p_partkey AS id, p_size%4 AS v FROM part UNION ALL SELECT 's'||s_suppkey, 0 FROM supplier WHERE s_suppkey<>13)"
WHY = "CASE WHEN blk THEN 'blocked' WHEN v IS NULL THEN 'unknown' WHEN pin IS NOT NULL AND pin<>v THEN 'version mismatch' END"


def bridges(spark, d):
    text = lambda mark, c: F.concat(F.lit(mark), c.cast("string"))
    lines, part = table(spark, d, "lineitem"), table(spark, d, "part")
    across = lines.select(
        text("s", F.col("l_suppkey")).alias("from_id"), text("p", F.col("l_partkey")).alias("to_id"),
        F.when(F.col("l_linenumber") % 3 == 0, F.col("l_linenumber") % 4).alias("pin"), ((F.col("l_returnflag") == "R") & (F.col("l_linenumber") == 2)).alias("blocked"),
    )
    back = part.filter("p_size > 45").select(text("p", F.col("p_partkey")), text("s", F.col("p_partkey") % 97), F.lit(None).cast("int"), F.lit(False))
    versions = part.select(text("p", F.col("p_partkey")).alias("id"), (F.col("p_size") % 4).alias("version"))
    return across.unionAll(back), versions.unionAll(table(spark, d, "supplier").filter("s_suppkey <> 13").select(text("s", F.col("s_suppkey")), F.lit(0)))


@query("g21_workspace_impact", f"WITH RECURSIVE {BRIDGES}, j AS (SELECT DISTINCT a, b, {WHY} AS why FROM br LEFT JOIN vr ON id=b), w(id, depth) AS (SELECT 's4', 0 UNION SELECT b, depth+1 FROM w JOIN j ON a=id AND why IS NULL WHERE depth<4) SELECT id AS entity_id, min(depth)::INT AS depth FROM w GROUP BY 1")
def g21(spark, d):
    return P.impact(*bridges(spark, d), "s4", 4)[0]


@query("g21_stopped_bridges", f"WITH RECURSIVE {BRIDGES}, j AS (SELECT a, b, {WHY} AS why FROM br LEFT JOIN vr ON id=b), e AS (SELECT DISTINCT a, b FROM j WHERE why IS NULL), w(id, depth) AS (SELECT 's4', 0 UNION SELECT b, depth+1 FROM w JOIN e ON a=id WHERE depth<2) SELECT a AS from_id, b AS to_id, why FROM j WHERE why IS NOT NULL AND a IN (SELECT id FROM w)")
def g21s(spark, d):
    return P.impact(*bridges(spark, d), "s4", 2)[1]


@query(
    "g8_context",
    f"""WITH RECURSIVE {GRAPH}, sc AS (SELECT entity_id, (CASE WHEN contains(name_fold,'asia') THEN 2 ELSE 0 END + CASE WHEN contains(qn_fold,'asia') THEN 1 ELSE 0 END + CASE WHEN contains(name_fold,'nation_2') THEN 2 ELSE 0 END + CASE WHEN contains(qn_fold,'nation_2') THEN 1 ELSE 0 END) AS score FROM nodes),
    seed AS (SELECT * FROM sc WHERE score>0 ORDER BY score DESC, entity_id LIMIT 3), near AS (SELECT DISTINCT a,b FROM (SELECT from_id a,to_id b FROM edges UNION ALL SELECT to_id,from_id FROM edges)), w(id,depth) AS (SELECT entity_id, 0 FROM seed UNION SELECT b, depth+1 FROM w JOIN near ON a=id WHERE depth<2), m AS (SELECT id, min(depth) AS depth FROM w GROUP BY 1)
    SELECT id AS entity_id, depth::INT AS depth, coalesce(score,0)::INT AS score FROM m LEFT JOIN seed ON entity_id=id ORDER BY depth, score DESC, id LIMIT 200""",
)
def g8(spark, d):
    return C.context(G.nodes(spark, d), G.edges(spark, d), ["asia", "nation_2"], 2, 3, 200)


@query(
    "g22_review",
    f"""WITH {HUNKS}, {SPANS}, hit AS (SELECT DISTINCT h.file, h_start, h_end, id, s, e FROM hunks h JOIN spans p ON h.file=p.file AND s<=h_end AND e>=h_start),
    ch AS (SELECT DISTINCT id FROM hit a WHERE NOT EXISTS (SELECT 1 FROM hit b WHERE b.file=a.file AND b.h_start=a.h_start AND b.h_end=a.h_end AND b.id<>a.id AND b.s>=a.s AND b.e<=a.e AND (b.s>a.s OR b.e<a.e))),
    cl AS (SELECT l_partkey AS id, count(DISTINCT l_orderkey) FILTER (WHERE o_orderpriority<>'5-LOW') AS callers, count(DISTINCT l_orderkey) FILTER (WHERE o_orderpriority='5-LOW') AS tests FROM lineitem JOIN orders ON o_orderkey=l_orderkey GROUP BY 1)
    SELECT {ent("definition", "'part::'||ch.id")} AS entity_id, coalesce(callers,0) AS callers, coalesce(tests,0) AS tests FROM ch LEFT JOIN cl USING (id)""",
)
def g22(spark, d):
    """Parts that hunks touch, with the orders that reference them; orders of low priority stand for tests."""
    from ..reader import GraphReader

    lines = table(spark, d, "lineitem").filter("l_linenumber = 1")
    hunks = lines.selectExpr("cast(l_partkey div 50 AS string) AS file", "l_orderkey % 900 AS h_start", "cast(l_orderkey % 900 + l_quantity AS bigint) AS h_end").distinct()
    ids = id_col("ent", G.REPO, G.SNAPSHOT, "definition", F.concat(F.lit("part::"), F.col("p_partkey").cast("string")), "1", "1")
    spans = table(spark, d, "part").select(F.expr("cast(p_partkey div 50 AS string) AS file"), ids.alias("id"), F.expr("p_partkey * 37 % 900 AS start"), F.expr("p_partkey * 37 % 900 + p_size * 4 AS end"))
    nodes = G.nodes(spark, d, ("orders",)).withColumn("file", F.replace("file", F.lit("crm/5-LOW/"), F.lit("crm/tests/")))
    return GraphReader(nodes, G.edges(spark, d, ("references",))).review(hunks, spans)
