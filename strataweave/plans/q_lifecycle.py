"""Queries of sources, evidence, decisions and lifecycles."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.ids import digests
from ..operators import extract as X
from ..operators import knowledge as K
from ..operators import lifecycle as C
from ..operators import retrieval as V
from ..operators.traverse import cycle_members
from ..session import TABLES, shared_path, table
from ..sources import snapshot as S
from ..sources import sqlite_source
from ..sources import tpch_graph as G
from ..sources.sinks import append_new
from .registry import GRAPH, query

def count():
    return F.count(F.lit(1))


def files(spark, d):
    return table(spark, d, "documents").select(F.concat(F.lit("docs/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.sha2("text", 256).alias("sha256"), F.octet_length("text").alias("bytes"))


FILES = "f AS (SELECT 'docs/'||lang||'/'||doc_id||'.txt' AS path, sha256(text) AS sha256, strlen(text) AS bytes FROM documents)"


@query("s2_exact_file_set", f"WITH {FILES} SELECT path, sha256, bytes::INT AS bytes FROM f WHERE path IN ('docs/fr/0.txt','docs/en/1.txt')")
def s2(spark, d):
    rows = files(spark, d)
    names = [r.path for r in rows.filter(F.col("path").isin("docs/fr/0.txt", "docs/en/1.txt")).select("path").collect()]
    return S.exact_set(rows, names) if names else rows.limit(0)


@query("s3_scoped_walk", f"WITH {FILES} SELECT split_part(path,'/',2) AS area, count(*) AS n FROM f WHERE (starts_with(path,'docs/en/') OR starts_with(path,'docs/de/')) AND path<>'docs/en/1.txt' GROUP BY 1")
def s3(spark, d):
    rows = files(spark, d).filter(S.kept(F.col("path"), ["docs/en", "docs/de"], ["docs/en/1.txt"]))
    return rows.groupBy(F.split("path", "/")[1].alias("area")).agg(count().alias("n"))


@query("s5_fingerprint", f"WITH {FILES} SELECT sha256(string_agg(path||'|'||bytes||'|'||sha256||chr(0), '' ORDER BY path)) AS fingerprint FROM f")
def s5(spark, d):
    return S.fingerprint(files(spark, d).withColumnRenamed("sha256", "modified"))


@query("s7_unsupported_report", "SELECT page_id, url FROM pages WHERE contains(url,'.') AND lower(split_part(url,'.',-1)) IN ('pdf','png','jpg','jpeg','gif','webp','docx','xlsx','pptx','zip','mp3','mp4') ORDER BY url")
def s7(spark, d):
    return table(spark, d, "pages").filter(X.unsupported(F.col("url"))).select("page_id", "url").orderBy("url")


@query("s9_jsonl_records", "SELECT event_id AS id, (json_extract_string(props,'$.k'))::INT AS k FROM events")
def s9(spark, d):
    lines = table(spark, d, "events").select(F.to_json(F.struct(F.col("event_id").alias("id"), F.get_json_object("props", "$.k").cast("int").alias("k"))).alias("value"))
    return S.jsonl_records(lines, "id long, k int")


@query("s13_session_db", "SELECT conv_id||'' AS session, turn, length(text) AS n FROM conversations WHERE role='user' AND turn>=2")
def s13(spark, d):
    """Conversations as session databases, written and read in parallel; role and turn are told to the databases."""
    folder = shared_path(spark, "sessions")
    c = table(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("session"), "turn", "role", "text")
    sqlite_source.export_sessions(c, folder, 8).collect()
    sqlite_source.register(spark)
    rows = spark.read.format("sqlite").schema("session string, turn long, role string, text string").option("table", "session_message").load(folder)
    return rows.filter("role = 'user' AND turn >= 2").select("session", "turn", F.length("text").cast("long").alias("n"))


@query("s11_catalog_records", "SELECT 'column:'||table_name||'.'||column_name AS key, 'column' AS kind, column_name AS name, 'table:'||table_name AS parent FROM information_schema.columns WHERE table_name IN ('region','nation','labels') UNION ALL SELECT DISTINCT 'table:'||table_name, 'table', table_name, NULL FROM information_schema.columns WHERE table_name IN ('region','nation','labels')")
def s11(spark, d):
    return spark.createDataFrame(S.catalog_records({t: table(spark, d, t) for t in ("region", "nation", "labels")}), "key string, kind string, name string, parent string")


@query("s12_receipt_files", "SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN o_orderkey::INT WHEN 3 THEN NULL END::INT AS generation FROM orders WHERE o_orderkey > 9")
def s12(spark, d):
    """Names of receipt files in all their forms: first, second, numbered, a zero in front, generation 1 spelt out, another kind."""
    k = F.col("o_orderkey").cast("string")
    name = F.concat(F.lit("ses_"), k, F.element_at(F.array(F.lit(".json"), F.lit(".2.json"), F.concat(F.lit("."), k, F.lit(".json")), F.lit(".02.json"), F.lit(".1.json"), F.lit(".txt")), (F.col("o_orderkey") % 6 + 1).cast("int")))
    return table(spark, d, "orders").filter("o_orderkey > 9").select("o_orderkey", S.receipt_generation(name).alias("generation"))


@query("s16_git_diff", "SELECT CASE WHEN p_size % 5=0 THEN 'new/' ELSE 'src/' END||p_partkey||'.rs' AS file, p_size AS h_start, (p_size + greatest(p_partkey % 7 - 1, 0))::INT AS h_end FROM part UNION ALL SELECT CASE WHEN p_size % 5=0 THEN 'new/' ELSE 'src/' END||p_partkey||'.rs', p_size+100, p_size+100 FROM part WHERE p_partkey % 3=0")
def s16(spark, d):
    """A diff for each part: added files, hunks with and without a count."""
    s, k = F.col("p_size").cast("string"), F.col("p_partkey").cast("string")
    added = F.col("p_size") % 5 == 0
    name = F.concat(F.when(added, "new/").otherwise("src/"), k, F.lit(".rs"))
    old = F.when(added, F.lit("--- /dev/null")).otherwise(F.concat(F.lit("--- a/"), name))
    lines = [old, F.concat(F.lit("+++ b/"), name), F.concat(F.lit("@@ -"), s, F.lit(","), (F.col("p_partkey") % 7).cast("string"), F.lit(" +1 @@ fn")), F.lit("-gone")]
    more = F.when(F.col("p_partkey") % 3 == 0, F.array(F.concat(F.lit("@@ -"), (F.col("p_size") + 100).cast("string"), F.lit(" +2 @@")), F.lit("+come"))).otherwise(F.array().cast("array<string>"))
    rows = table(spark, d, "part").select("p_partkey", F.posexplode(F.concat(F.array(*lines), more)).alias("i", "line"))
    return S.parse_diff(rows.select("p_partkey", F.col("i").alias("pos"), "line"), ["p_partkey"])


@query("s15_ledger_tail", "SELECT event_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 300 MINUTE")
def s15(spark, d):
    return S.ledger_tail(table(spark, d, "events").select("event_id", "ts"), "ts", 300).select("event_id")


@query("k2_append_new", "SELECT count(*) AS n FROM (SELECT DISTINCT l_partkey FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size<25))")
def k2(spark, d):
    have = table(spark, d, "part").filter("p_size < 25").select(F.col("p_partkey").alias("l_partkey"))
    return append_new(have, table(spark, d, "lineitem").select("l_partkey"), ["l_partkey"]).agg(count().alias("n"))


@query("k3_first_write_wins", "SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders GROUP BY 1")
def k3(spark, d):
    return K.first_write_wins(table(spark, d, "orders").select("o_custkey", "o_orderkey"), "o_custkey", "o_orderkey")


@query("k11_induced_subgraph", f"WITH {GRAPH}, s AS (SELECT entity_id FROM nodes WHERE kind='module') SELECT rel_id FROM edges WHERE from_id IN (SELECT * FROM s) AND to_id IN (SELECT * FROM s)")
def k11(spark, d):
    from ..operators.graph_reads import visible_edges

    return visible_edges(G.edges(spark, d, ("contains",)), G.nodes(spark, d, ("region", "nation"))).select("rel_id")


EVIDENCE = "ev AS (SELECT l_orderkey AS rel_id, 'ev'||l_linenumber||'-'||l_partkey AS evidence_id FROM lineitem)"


def evidence(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("rel_id"), F.concat(F.lit("ev"), "l_linenumber", F.lit("-"), "l_partkey").alias("evidence_id"))


@query("k12_sealed_evidence", f"WITH {EVIDENCE} SELECT rel_id, list_sort(list(DISTINCT evidence_id)) AS evidence, count(DISTINCT evidence_id)::INT AS n FROM ev GROUP BY 1")
def k12(spark, d):
    return C.sealed_evidence(evidence(spark, d))


@query("x1_truncated_evidence", f"WITH {EVIDENCE}, s AS (SELECT rel_id, list_sort(list(DISTINCT evidence_id)) AS e FROM ev GROUP BY 1) SELECT rel_id, e[1:3] AS evidence, greatest(len(e)-3,0)::INT AS omitted FROM s")
def x1(spark, d):
    first, left = C.truncated(F.col("evidence"), 3)
    return C.sealed_evidence(evidence(spark, d)).select("rel_id", first.alias("evidence"), left.alias("omitted"))


@query("j15_evidence_closure", "SELECT l_orderkey AS rel_id, count(*) FILTER (WHERE l_partkey % 4 <> 0 AND l_suppkey % 3 <> 0) AS cited, count(*) FILTER (WHERE NOT (l_partkey % 4 <> 0 AND l_suppkey % 3 <> 0)) AS missing FROM lineitem GROUP BY 1")
def j15(spark, d):
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("evidence_id"))
    edges = lines.groupBy(F.col("l_orderkey").alias("rel_id")).agg(F.collect_list("evidence_id").alias("evidence_ids"))
    known = lines.filter("l_partkey % 4 <> 0").select("evidence_id", F.col("l_suppkey").alias("file")).distinct()
    sources = table(spark, d, "supplier").filter("s_suppkey % 3 <> 0").select(F.col("s_suppkey").alias("file"))
    return C.closure(edges, known, sources)


@query("j13_cache_lookup", "SELECT cached, count(*) AS n FROM (SELECT o_orderkey % 3 = 0 AND o_orderkey % 2 = 0 AS cached FROM orders) GROUP BY 1")
def j13(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"))
    cache = o.filter("k % 3 = 0").select("k", F.lit("yes").alias("answer"), (F.col("k") % 2 != 0).alias("failed"))
    return C.with_cache(o, cache, "k").groupBy("cached").agg(count().alias("n"))


@query("d4_uncached_count", "SELECT count(*) AS n FROM orders WHERE NOT (o_orderkey % 3 = 0 AND o_orderkey % 2 = 0)")
def d4(spark, d):
    return j13(spark, d).filter("NOT cached").select("n")


@query("j14_contradicted_claims", "SELECT l_suppkey AS from_id, l_partkey AS to_id, 'implements' AS rel_type, count(*) FILTER (WHERE l_returnflag='R') AS against FROM lineitem GROUP BY 1,2 HAVING count(*) FILTER (WHERE l_returnflag='R')>0 AND count(*) FILTER (WHERE l_returnflag<>'R')>0")
def j14(spark, d):
    lines = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("from_id"), F.col("l_partkey").alias("to_id"), F.lit("implements").alias("rel_type"), (F.col("l_returnflag") != "R").alias("accepted"))
    return C.contradicted(lines)


@query("d6_parallel_suffix", "SELECT CASE WHEN n=1 THEN k ELSE k||'#'||n END AS rel_key FROM (SELECT 'uses|'||l_suppkey||'|'||(l_partkey%50) AS k, row_number() OVER (PARTITION BY l_suppkey, l_partkey%50 ORDER BY l_orderkey, l_linenumber, l_partkey) AS n FROM lineitem)")
def d6(spark, d):
    rows = table(spark, d, "lineitem").select(F.lit("uses").alias("rel_type"), F.col("l_suppkey").alias("from_id"), (F.col("l_partkey") % 50).alias("to_id"), F.struct("l_orderkey", "l_linenumber", "l_partkey").alias("seq"))
    return C.parallel_suffix(rows).select("rel_key")


@query("j20_path_prefix", f"WITH {GRAPH}, a AS (SELECT DISTINCT file AS a FROM nodes WHERE kind='module'), b AS (SELECT DISTINCT regexp_replace(file,'/[^/]*$','') AS b FROM nodes) SELECT a, b FROM a, b WHERE a=b OR starts_with(a, b||'/') OR starts_with(b, a||'/')")
def j20(spark, d):
    n = G.nodes(spark, d)
    a = n.filter("kind = 'module'").select(F.col("file").alias("a")).distinct()
    return C.path_related(a, n.select(F.regexp_replace("file", "/[^/]*$", "").alias("b")).distinct(), "a", "b")


@query("j24_origin_groups", "WITH u AS (SELECT 'docs' AS provider, source AS origin, doc_id AS id FROM documents UNION ALL SELECT 'labels', d.source, l.doc_id FROM labels l JOIN documents d USING (doc_id)) SELECT a.provider, a.id, min(b.provider) AS same_as FROM u a LEFT JOIN u b ON a.origin=b.origin AND a.id=b.id AND a.provider<>b.provider GROUP BY 1,2")
def j24(spark, d):
    docs = table(spark, d, "documents").select(F.lit("docs").alias("provider"), F.col("source").alias("origin"), F.col("doc_id").alias("id"))
    labels = table(spark, d, "labels").select(F.col("doc_id").alias("id")).join(docs.select("id", "origin"), "id").select(F.lit("labels").alias("provider"), "origin", "id")
    return C.same_origin(docs.unionAll(labels))


@query("j26_composite_pointer", "SELECT c.conv_id, c.role, c.turn FROM conversations c JOIN (SELECT conv_id, role, max(turn) AS turn FROM conversations GROUP BY 1,2) p USING (conv_id, role, turn)")
def j26(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "role", "turn")
    return c.join(c.groupBy("conv_id", "role").agg(F.max("turn").alias("turn")), ["conv_id", "role", "turn"])


@query("p13_probability_check", "SELECT count(*) FILTER (WHERE value BETWEEN 0 AND 1) AS valid, count(*) FILTER (WHERE NOT (value BETWEEN 0 AND 1)) AS invalid FROM events")
def p13(spark, d):
    ok = C.valid_response(F.lit("score"), F.col("value"), F.lit(None).cast("string"), [])
    return table(spark, d, "events").agg(F.count_if(ok).alias("valid"), F.count_if(~ok).alias("invalid"))


@query("a16_table_counts", " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t}" for t in TABLES))
def a16(spark, d):
    from functools import reduce

    return reduce(lambda a, b: a.unionAll(b), [table(spark, d, t).agg(count().alias("n")).select(F.lit(t).alias("name"), "n") for t in TABLES])


@query("a17_distinct_digests", "SELECT source, count(DISTINCT md5(text)) AS digests FROM documents GROUP BY 1")
def a17(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(F.size(F.collect_set(F.md5("text"))).cast("long").alias("digests"))


@query("a21_message_map_digest", "SELECT conv_id, sha256(string_agg(turn||chr(1)||md5(text)||chr(10)||chr(0), '' ORDER BY turn)) AS digest FROM conversations GROUP BY 1")
def a21(spark, d):
    line = F.concat("turn", F.char(F.lit(1)), F.md5("text"), F.lit("\n"))
    return digests(table(spark, d, "conversations"), ["conv_id"], ["turn"], line).select("conv_id", "digest")


@query("r8_semantic_floor", "WITH q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id=0), s AS (SELECT vec_id, round(list_dot_product(embedding::DOUBLE[], q) / (sqrt(list_dot_product(q,q)) * sqrt(list_dot_product(embedding::DOUBLE[],embedding::DOUBLE[]))),6) AS cosine FROM embeddings, q) SELECT * FROM s WHERE cosine>=0.3 ORDER BY cosine DESC, vec_id")
def r8(spark, d):
    e = table(spark, d, "embeddings")
    q = list(e.filter("vec_id = 0").first().embedding)
    c = V.dot(F.col("embedding"), F.array(*[F.lit(float(x)) for x in q]))
    own = sum(x * x for x in q) ** 0.5
    scored = e.select("vec_id", F.round(c / (V.norm(F.col("embedding")) * F.lit(own)), 6).alias("cosine"))
    return scored.filter("cosine >= 0.3").orderBy(F.desc("cosine"), "vec_id")


@query("r12_provider_evidence", "SELECT conv_id, list(turn ORDER BY turn)[1:3] AS first, list_reverse(list(turn ORDER BY turn))[1:2] AS latest, greatest(count(*)-3,0)::INT AS omitted FROM conversations GROUP BY 1")
def r12(spark, d):
    t = F.array_sort(F.collect_list("turn"))
    g = table(spark, d, "conversations").groupBy("conv_id").agg(t.alias("t"))
    first, left = C.truncated(F.col("t"), 3)
    return g.select("conv_id", first.alias("first"), F.slice(F.reverse("t"), 1, 2).alias("latest"), left.alias("omitted"))


@query("d2_question_text", "SELECT o_orderkey, 'Does `order-'||o_orderkey||'` reference `'||o_custkey||'`?' AS question FROM orders")
def d2(spark, d):
    o = table(spark, d, "orders")
    return o.select("o_orderkey", C.question(F.concat(F.lit("order-"), "o_orderkey"), F.lit("reference"), F.col("o_custkey").cast("string")).alias("question"))


@query("d3_reuse_key", "SELECT o_orderkey, 'reuse:'||sha256('v1'||chr(0)||o_custkey||chr(0)||o_orderpriority||chr(0)) AS reuse_key FROM orders")
def d3(spark, d):
    from ..functions.ids import sha_col

    o = table(spark, d, "orders")
    return o.select("o_orderkey", F.concat(F.lit("reuse:"), sha_col("v1", F.col("o_custkey"), F.col("o_orderpriority"))).alias("reuse_key"))


@query(
    "d11_lifecycle",
    """WITH e AS (SELECT user_id AS scope, event_id % 11 AS item, event_id AS seq, ['admit','admit','contradict','supersede','withhold'][event_id % 5 + 1] AS action, (event_id*3) % 11 AS target FROM events),
    x AS (SELECT scope, item AS x, seq, 0 AS sub, CASE action WHEN 'withhold' THEN 'withheld' WHEN 'contradict' THEN 'disputed' ELSE 'admitted' END AS s, action='supersede' AS hard FROM e
    UNION ALL SELECT scope, target, seq, 1, CASE action WHEN 'supersede' THEN 'superseded' ELSE 'disputed' END, action='supersede' FROM e WHERE action IN ('supersede','contradict'))
    SELECT scope, x AS item, CASE WHEN arg_max(s, row(seq,sub)) FILTER (WHERE hard)='superseded' THEN 'superseded' ELSE arg_max(s, row(seq,sub)) END AS status FROM x GROUP BY 1,2""",
)
def d11(spark, d):
    actions = F.expr("element_at(array('admit','admit','contradict','supersede','withhold'), cast(event_id % 5 + 1 AS int))")
    e = table(spark, d, "events").select(F.col("user_id").alias("scope"), (F.col("event_id") % 11).alias("item"), F.col("event_id").alias("seq"), actions.alias("action"), ((F.col("event_id") * 3) % 11).alias("target"))
    return C.lifecycle(e)


@query("d13_bundle_checks", "SELECT count(*) FILTER (WHERE d.doc_id IS NULL) AS dangling, count(*) - count(DISTINCT l.doc_id) AS repeated FROM labels l LEFT JOIN documents d USING (doc_id)")
def d13(spark, d):
    l, docs = table(spark, d, "labels"), table(spark, d, "documents").select("doc_id", F.lit(1).alias("_d"))
    return l.join(docs, "doc_id", "left").agg(F.count_if(F.col("_d").isNull()).alias("dangling"), (count() - F.countDistinct("doc_id")).alias("repeated"))


@query("d14_pair_actions", "WITH p AS (SELECT (doc_id*7 % 101)/100.0::DOUBLE AS s, (doc_id*13 % 101)/100.0::DOUBLE AS r, doc_id % 2=0 AS o FROM documents) SELECT CASE WHEN s>=0.9 THEN 'merge' WHEN r>=0.9 AND o THEN 'replace' WHEN r>=0.9 THEN 'conflict' ELSE 'keep' END AS action, count(*) AS n FROM p GROUP BY 1")
def d14(spark, d):
    part = lambda k: ((F.col("doc_id") * k % 101) / F.lit(100.0)).cast("double")
    return table(spark, d, "documents").groupBy(C.pair_action(part(7), part(13), F.col("doc_id") % 2 == 0).alias("action")).agg(count().alias("n"))


@query("d19_hold_reasons", "SELECT concat_ws(',', CASE WHEN o_totalprice>100000 THEN 'large' END, CASE WHEN o_orderstatus='O' THEN 'open' END, CASE WHEN o_custkey%10=0 THEN 'watched' END) AS reasons, count(*) AS n FROM orders GROUP BY 1")
def d19(spark, d):
    why = C.hold_reasons({"large": F.col("o_totalprice") > 100000, "open": F.col("o_orderstatus") == "O", "watched": F.col("o_custkey") % 10 == 0})
    return table(spark, d, "orders").groupBy(F.array_join(why, ",").alias("reasons")).agg(count().alias("n"))


@query("x8_reconstruct_check", "SELECT conv_id, turn, md5(text) AS rebuilt, true AS same FROM conversations")
def x8(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", "text")
    lines = c.select("conv_id", "turn", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    back = lines.groupBy("conv_id", "turn").agg(F.array_join(F.sort_array(F.collect_list(F.struct("i", "line")))["line"], "\n").alias("back"))
    return c.join(back, ["conv_id", "turn"]).select("conv_id", "turn", F.md5("back").alias("rebuilt"), (F.col("back") == F.col("text")).alias("same"))


@query("a3_max_version", "SELECT coalesce(max(p_size),0) AS version FROM part")
def a3(spark, d):
    return table(spark, d, "part").agg(F.coalesce(F.max("p_size"), F.lit(0)).alias("version"))


@query("a22_catalog_digest", "SELECT sha256('v1'||chr(0)||string_agg(p_partkey||':'||p_name||chr(0), '' ORDER BY p_partkey)) AS digest FROM part")
def a22(spark, d):
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("k"), F.concat_ws(":", "p_partkey", "p_name").alias("f"))
    head = spark.createDataFrame([(-1, "v1")], "k long, f string")
    return digests(head.unionAll(rows), [], ["k"], F.col("f")).select("digest")


@query("a23_view_digest", "SELECT event_type, sha256(string_agg(event_id||chr(0), '' ORDER BY event_id)) AS digest FROM events GROUP BY 1")
def a23(spark, d):
    return digests(table(spark, d, "events"), ["event_type"], ["event_id"], F.col("event_id").cast("string")).select("event_type", "digest")


@query("a25_budget_totals", "SELECT count(*) AS attempts, coalesce(sum(l_linenumber),0)::BIGINT AS reserved FROM lineitem WHERE l_returnflag='R'")
def a25(spark, d):
    return table(spark, d, "lineitem").filter("l_returnflag = 'R'").agg(count().alias("attempts"), F.coalesce(F.sum("l_linenumber"), F.lit(0)).alias("reserved"))


@query("g26_duplicate_cycles", "WITH RECURSIVE l AS (SELECT n_nationkey AS id, (n_nationkey*3+1) % 25 AS dup FROM nation), w(s0, pos, n) AS (SELECT id, dup, 1 FROM l UNION SELECT s0, dup, n+1 FROM w JOIN l ON id=pos WHERE n<26 AND pos<>s0) SELECT DISTINCT s0::BIGINT AS id FROM w WHERE pos=s0")
def g26(spark, d):
    """Ids on a cycle of duplicate-of links: everything that reaches itself."""
    links = table(spark, d, "nation").selectExpr("cast(n_nationkey AS bigint) AS id", "cast((n_nationkey * 3 + 1) % 25 AS bigint) AS dup")
    return cycle_members(links.withColumnRenamed("dup", "to"))


@query("x7_pending_captures", "SELECT count(*) AS pending FROM (SELECT DISTINCT md5(text) AS h FROM conversations WHERE turn > 0 AND md5(text) NOT IN (SELECT md5(text) FROM conversations WHERE turn=0))")
def x7(spark, d):
    c = table(spark, d, "conversations").select("turn", F.md5("text").alias("h"))
    return append_new(c.filter("turn = 0"), c.filter("turn > 0"), ["h"]).agg(count().alias("pending"))


@query("x14_draft_recovery", "SELECT conv_id, turn, len(string_split(text, chr(10)))::INT AS parts, len(list_filter(string_split(text, chr(10)), lambda p: NOT ends_with(p, '.')))::INT AS interrupted FROM conversations")
def x14(spark, d):
    parts = F.transform(F.split("text", "\n"), lambda p: F.struct(p.alias("text"), F.when(p.endswith("."), "done").otherwise("interrupted").alias("status")))
    c = table(spark, d, "conversations").select("conv_id", "turn", parts.alias("p"))
    return c.select("conv_id", "turn", F.size("p").alias("parts"), F.size(F.filter("p", lambda x: x["status"] == "interrupted")).alias("interrupted"))


@query(
    "s11_pg_catalog",
    """WITH k AS (SELECT c.* FROM customer c JOIN nation ON c_nationkey=n_nationkey WHERE n_regionkey=1 AND c_custkey%7<>0), rel(kk) AS (SELECT c_custkey FROM k)
    SELECT 'relation:'||c_custkey AS key, CASE WHEN c_custkey%2=0 THEN 'view' ELSE 'table' END AS kind, c_name AS name, NULL AS parent, NULL AS target FROM k
    UNION ALL SELECT 'column:'||o_custkey||':'||o_orderkey, 'column', o_orderpriority, 'relation:'||o_custkey, NULL FROM orders JOIN rel ON o_custkey=kk WHERE o_orderkey%10<>0
    UNION ALL SELECT 'constraint:'||o_orderkey, 'constraint', o_clerk, 'relation:'||o_custkey, CASE WHEN o_orderkey%3=0 THEN 'relation:'||(o_custkey+1) END FROM (SELECT *, o_orderstatus||'_'||o_orderkey AS o_clerk FROM orders) JOIN rel ON o_custkey=kk WHERE o_orderkey%5=0
    UNION ALL SELECT 'index:'||(1000000000+o_orderkey), 'index', 'ix_'||o_orderkey, 'relation:'||o_custkey, NULL FROM orders JOIN rel ON o_custkey=kk WHERE o_orderkey%8=0 UNION ALL SELECT 'routine:'||s_suppkey, 'routine', s_name, NULL, NULL FROM supplier JOIN nation ON s_nationkey=n_nationkey WHERE n_regionkey=1""",
)
def s11pg(spark, d):
    """A system catalog of relations, columns with defaults, constraints, indexes and routines, in the shape of its public frames; the star-schema tables stand for their rows."""
    c, o, s = (table(spark, d, t) for t in ("customer", "orders", "supplier"))
    region = table(spark, d, "nation").select("n_nationkey", F.col("n_regionkey").alias("relnamespace"))
    relkind = F.when(F.col("c_custkey") % 7 == 0, "t").when(F.col("c_custkey") % 2 == 0, "v").otherwise("r")
    classes = c.join(F.broadcast(region), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").cast("long").alias("oid"), F.col("c_name").alias("relname"), "relnamespace", relkind.alias("relkind"))
    indexes = o.filter("o_orderkey % 8 = 0").select((F.col("o_orderkey") + 1_000_000_000).cast("long").alias("oid"), F.concat(F.lit("ix_"), "o_orderkey").alias("relname"), F.lit(1).cast("long").alias("relnamespace"), F.lit("i").alias("relkind"))
    pg = {
        "namespace": table(spark, d, "region").select(F.col("r_regionkey").alias("oid"), F.concat(F.lit("schema_"), "r_regionkey").alias("nspname")),
        "class": classes.unionByName(indexes.withColumn("relnamespace", F.col("relnamespace").cast(classes.schema["relnamespace"].dataType))),
        "attribute": o.select(F.col("o_custkey").alias("attrelid"), F.col("o_orderkey").alias("attnum"), F.col("o_orderpriority").alias("attname"), F.col("o_orderstatus").alias("atttypid"), (F.col("o_orderkey") % 2 == 0).alias("attnotnull"), (F.col("o_orderkey") % 10 == 0).alias("attisdropped")),
        "attrdef": o.filter("o_orderkey % 4 = 1").select(F.col("o_custkey").alias("adrelid"), F.col("o_orderkey").alias("adnum"), F.col("o_orderstatus").alias("adbin")),
        "constraint": o.filter("o_orderkey % 5 = 0").select(F.col("o_orderkey").alias("oid"), F.concat_ws("_", "o_orderstatus", "o_orderkey").alias("conname"), F.col("o_custkey").alias("conrelid"), F.when(F.col("o_orderkey") % 3 == 0, "f").otherwise("c").alias("contype"), (F.col("o_custkey") + 1).alias("confrelid")),
        "index": o.filter("o_orderkey % 8 = 0").select((F.col("o_orderkey") + 1_000_000_000).cast("long").alias("indexrelid"), F.col("o_custkey").alias("indrelid"), F.lit(True).alias("indisunique"), F.lit(False).alias("indisprimary")),
        "proc": s.join(F.broadcast(region), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("oid"), F.col("s_name").alias("proname"), F.col("relnamespace").alias("pronamespace"), F.lit("f").alias("prokind")),
    }
    return S.pg_catalog_records(pg, "schema_1").drop("details")


@query("j23_catalog_joins", "SELECT n_name, r_name, count(c_custkey) AS customers, count(s) AS suppliers FROM region JOIN nation ON r_regionkey=n_regionkey LEFT JOIN customer ON c_nationkey=n_nationkey LEFT JOIN (SELECT s_nationkey AS k, min(s_suppkey) AS s FROM supplier GROUP BY 1) ON k=n_nationkey GROUP BY 1,2")
def j23(spark, d):
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    c = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(count().alias("customers"))
    s = table(spark, d, "supplier").select(F.col("s_nationkey").alias("n_nationkey"), F.lit(1).alias("has")).distinct()
    joined = n.join(r, n.n_regionkey == r.r_regionkey).join(c, "n_nationkey", "left").join(s, "n_nationkey", "left")
    rows = F.greatest(F.coalesce("customers", F.lit(0)), F.lit(1))
    return joined.select("n_name", "r_name", F.coalesce("customers", F.lit(0)).alias("customers"), F.when(F.col("has").isNotNull(), rows).otherwise(0).alias("suppliers"))
