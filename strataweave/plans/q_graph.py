"""Queries over the derived graph: reads, pages, paths, diffs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.ids import id_col
from ..functions.text import area
from ..operators import graph_reads as R
from ..operators import traverse as T
from ..session import table
from ..sources import tpch_graph as G
from .registry import GRAPH, edges_sql, ent, query, rel

EURO = ent("module", "'region::EUROPE'")
CUSTOMER = G.entity_id("symbol", "customer::7")
CUSTOMER_SQL = ent("symbol", "'customer::7'")
PART = G.entity_id("definition", "part::11")
PART_SQL = ent("definition", "'part::11'")
SUPPLIER = G.entity_id("symbol", "supplier::3")
SUPPLIER_SQL = ent("symbol", "'supplier::3'")
SMALL = ("contains", "calls")
SMALL_SQL = "rel_type IN ('contains','calls')"


@query("p3_entity_lookup", f"WITH {GRAPH} SELECT entity_id, kind, name, qualified_name, file FROM nodes WHERE entity_id = {PART_SQL}")
def p3(spark, d):
    n = G.nodes(spark, d, ("part",))
    return n.filter(F.col("entity_id") == PART).select("entity_id", "kind", "name", "qualified_name", "file")


SEARCH_SQL = (
    "SELECT entity_id, kind, name, qualified_name, file FROM nodes WHERE contains(name_fold, '{0}') OR contains(qn_fold, '{0}') "
    "ORDER BY (name_fold='{0}') DESC, starts_with(name_fold,'{0}') DESC, qualified_name, entity_id LIMIT {1}"
)


@query("r1_lexical_rank", f"WITH {GRAPH} " + SEARCH_SQL.format("er", 25))
def r1(spark, d):
    return R.search(G.nodes(spark, d), "er", 25)


@query("p5_substring_search", f"WITH {GRAPH} SELECT entity_id, qualified_name FROM nodes WHERE contains(name_fold, 'customer#00000') OR contains(qn_fold, 'customer#00000')")
def p5(spark, d):
    n = "customer#00000"
    return G.nodes(spark, d).filter(F.col("name_fold").contains(n) | F.col("qn_fold").contains(n)).select("entity_id", "qualified_name")


@query("p4_literal_wildcards", f"WITH {GRAPH} SELECT count(*) AS n FROM nodes WHERE contains(name_fold, '_') OR contains(name_fold, '%')")
def p4(spark, d):
    return G.nodes(spark, d).filter(F.col("name_fold").contains("_") | F.col("name_fold").contains("%")).agg(F.count(F.lit(1)).alias("n"))


@query("p6_type_filter", f"WITH {GRAPH} SELECT rel_type, count(*) AS n FROM edges WHERE rel_type IN ('calls','implements') GROUP BY 1")
def p6(spark, d):
    e = R.of_types(G.edges(spark, d), ["calls", "implements"])
    return e.unionAll(R.of_types(G.edges(spark, d), [])).groupBy("rel_type").agg(F.count(F.lit(1)).alias("n"))


@query(
    "p7_scope_filter",
    f"""WITH {GRAPH}, v AS (SELECT entity_id FROM nodes WHERE (starts_with(file,'geo/') OR starts_with(file,'crm/')) AND NOT starts_with(file,'crm/BUILDING/')),
    hid AS (SELECT {rel("calls", ent("symbol", "'customer::'||o_custkey"), ent("definition", "'order::'||o_orderkey"))} AS rel_id FROM orders WHERE o_orderstatus='P')
    SELECT rel_type, count(*) AS n FROM edges WHERE from_id IN (SELECT entity_id FROM v) AND to_id IN (SELECT entity_id FROM v) AND rel_id NOT IN (SELECT rel_id FROM hid) GROUP BY 1""",
)
def p7(spark, d):
    """Customers of one segment are excluded, and so are the notes that tell of orders in one state."""
    allow, exclude = ["geo", "crm", "notes"], ["crm/BUILDING", "notes/P.md"]
    seen = R.visible(G.nodes(spark, d), allow, exclude)
    o = table(spark, d, "orders")
    ends = [G.entity_col(k, F.concat(F.lit(f"{n}::"), F.col(c).cast("string"))) for k, n, c in (("symbol", "customer", "o_custkey"), ("definition", "order", "o_orderkey"))]
    evidence = o.select(id_col("rel", G.BUILD, "calls", *ends).alias("rel_id"), F.concat(F.lit("notes/"), "o_orderstatus", F.lit(".md")).alias("file"))
    return R.visible_edges(G.edges(spark, d), seen, evidence, allow, exclude).groupBy("rel_type").agg(F.count(F.lit(1)).alias("n"))


@query("p12_area", f"WITH {GRAPH} SELECT CASE WHEN len(string_split(file,'/'))>2 THEN split_part(file,'/',1)||'/'||split_part(file,'/',2) ELSE split_part(file,'/',1) END AS area, count(*) AS n FROM nodes GROUP BY 1")
def p12(spark, d):
    return G.nodes(spark, d).groupBy(area(F.col("file")).alias("area")).agg(F.count(F.lit(1)).alias("n"))


#: Customers as repositories, their orders as builds; a pointer names the newest build, of every fifth repository one of its neighbour's.
HEADERS = "headers AS (SELECT 'repo-'||o_custkey AS repo, 'build-'||o_orderkey AS build_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS generation, 'build-'||lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS predecessor FROM orders)"
POINTER = "pointer AS (SELECT 'repo-'||(CASE WHEN o_custkey%5=0 THEN o_custkey+1 ELSE o_custkey END) AS repo, 'build-'||max(o_orderkey) AS build_id FROM orders GROUP BY o_custkey)"


def headers(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    build = lambda c: F.concat(F.lit("build-"), c.cast("string"))
    o = table(spark, d, "orders")
    return o.select(F.concat(F.lit("repo-"), "o_custkey").alias("repo"), build(F.col("o_orderkey")).alias("build_id"), F.row_number().over(w).alias("generation"), build(F.lag("o_orderkey").over(w)).alias("predecessor"))


def pointer(spark, d):
    newest = table(spark, d, "orders").groupBy("o_custkey").agg(F.max("o_orderkey").alias("k"))
    home = F.when(F.col("o_custkey") % 5 == 0, F.col("o_custkey") + 1).otherwise(F.col("o_custkey"))
    return newest.select(F.concat(F.lit("repo-"), home).alias("repo"), F.concat(F.lit("build-"), "k").alias("build_id"))


@query("p1_active_header", f"WITH {HEADERS}, {POINTER} SELECT repo, build_id, generation, predecessor FROM pointer JOIN headers USING (repo, build_id)")
def p1(spark, d):
    return R.active_headers(pointer(spark, d), headers(spark, d))


@query("p2_published_header", f"WITH {HEADERS} SELECT * FROM headers WHERE repo='repo-7' AND build_id=(SELECT max(build_id) FROM headers WHERE repo='repo-7')")
def p2(spark, d):
    h = headers(spark, d).filter("repo = 'repo-7'")
    return h.join(h.agg(F.max("build_id").alias("build_id")), "build_id").select("repo", "build_id", "generation", "predecessor")


@query(
    "j4_lateral_builds",
    f"WITH {HEADERS}, {POINTER}, r AS (SELECT 'repo-'||c_custkey AS repo FROM customer), a AS (SELECT repo, min(build_id) AS active FROM pointer GROUP BY 1) SELECT r.repo, a.active, b.build_id, b.generation FROM r LEFT JOIN a USING (repo) LEFT JOIN (SELECT * FROM headers QUALIFY row_number() OVER (PARTITION BY repo ORDER BY generation DESC) <= 3) b ON b.repo=r.repo",
)
def j4(spark, d):
    """Every customer's repository with its pointer and its three newest builds."""
    repos = table(spark, d, "customer").select(F.concat(F.lit("repo-"), "c_custkey").alias("repo"))
    return R.newest_builds(repos, pointer(spark, d), headers(spark, d), 3)


@query("j1_member_entities", "SELECT n_name, count(*) AS customers, sum(CASE WHEN o.k IS NULL THEN 1 ELSE 0 END)::BIGINT AS idle FROM customer JOIN nation ON c_nationkey=n_nationkey LEFT JOIN (SELECT DISTINCT o_custkey k FROM orders) o ON o.k=c_custkey GROUP BY 1")
def j1(spark, d):
    c, n = table(spark, d, "customer"), table(spark, d, "nation")
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("k")).distinct()
    joined = c.join(F.broadcast(n), c.c_nationkey == n.n_nationkey).join(o, c.c_custkey == o.k, "left")
    return joined.groupBy("n_name").agg(F.count(F.lit(1)).alias("customers"), F.sum(F.col("k").isNull().cast("int")).alias("idle"))


@query(
    "j8_endpoint_files",
    f"WITH {GRAPH} SELECT a.file AS from_file, b.file AS to_file, count(*) AS n FROM edges JOIN nodes a ON from_id=a.entity_id JOIN nodes b ON to_id=b.entity_id WHERE rel_type='contains' GROUP BY 1,2",
)
def j8(spark, d):
    e, n = G.edges(spark, d, ("contains",)), G.nodes(spark, d, ("region", "nation", "customer", "supplier"))
    a = n.select(F.col("entity_id").alias("from_id"), F.col("file").alias("from_file"))
    b = n.select(F.col("entity_id").alias("to_id"), F.col("file").alias("to_file"))
    return e.join(a, "from_id").join(b, "to_id").groupBy("from_file", "to_file").agg(F.count(F.lit(1)).alias("n"))


@query("a1_degree_filter", f"WITH {GRAPH} SELECT count(*) FILTER (WHERE from_id={SUPPLIER_SQL}) AS outgoing, count(*) FILTER (WHERE to_id={SUPPLIER_SQL}) AS incoming FROM edges")
def a1(spark, d):
    return R.degree_counts(G.edges(spark, d, ("contains", "implements")), SUPPLIER)


UNDIRECTED = "SELECT DISTINCT a, b FROM (SELECT from_id a, to_id b FROM edges UNION ALL SELECT to_id, from_id FROM edges)"


@query("a4_distinct_degree", f"WITH {GRAPH} SELECT degree, count(*) AS n FROM (SELECT a, count(*) AS degree FROM ({UNDIRECTED}) GROUP BY 1) GROUP BY 1")
def a4(spark, d):
    return R.degrees(G.edges(spark, d)).groupBy("degree").agg(F.count(F.lit(1)).alias("n"))


@query(
    "a7_edge_class",
    """WITH e AS (SELECT l_orderkey, l_partkey, list(CASE l_returnflag WHEN 'R' THEN 'ambiguous' WHEN 'A' THEN 'inferred' ELSE 'extracted' END) c, bool_or(l_linestatus='F' AND l_quantity>49) no FROM lineitem GROUP BY 1,2)
    SELECT CASE WHEN no OR list_contains(c,'ambiguous') THEN 'ambiguous' WHEN list_contains(c,'inferred') THEN 'inferred' ELSE 'extracted' END AS class, count(*) AS n FROM e GROUP BY 1""",
)
def a7(spark, d):
    lines = table(spark, d, "lineitem")
    label = F.when(F.col("l_returnflag") == "R", "ambiguous").when(F.col("l_returnflag") == "A", "inferred").otherwise("extracted")
    item = F.struct(label.alias("class"), (~((F.col("l_linestatus") == "F") & (F.col("l_quantity") > 49))).alias("supports"))
    pairs = lines.groupBy("l_orderkey", "l_partkey").agg(F.collect_list(item).alias("e"))
    return pairs.groupBy(R.edge_class(F.col("e")).alias("class")).agg(F.count(F.lit(1)).alias("n"))


@query("a8_class_histogram", f"WITH {GRAPH} SELECT v.class AS class, count(e.class) AS n FROM (VALUES ('extracted'),('inferred'),('ambiguous'),('unknown')) v(class) LEFT JOIN edges e ON e.class=v.class GROUP BY 1")
def a8(spark, d):
    return R.class_histogram(G.edges(spark, d))


@query("g1_neighbors_out", f"WITH {GRAPH} SELECT rel_id, rel_type, from_id, to_id, class FROM edges WHERE from_id={CUSTOMER_SQL}")
def g1o(spark, d):
    return R.neighbors(G.edges(spark, d, SMALL), CUSTOMER)


@query("g1_neighbors_in", f"WITH {GRAPH} SELECT rel_id, rel_type, from_id, to_id, class FROM edges WHERE to_id={PART_SQL} AND rel_type IN ('references')")
def g1i(spark, d):
    return R.neighbors(G.edges(spark, d, ("references",)), PART, outgoing=False, types=["references"])


@query("g2_neighbor_page", f"WITH {GRAPH}, p AS (SELECT rel_id, rel_type, from_id, to_id, class FROM edges WHERE to_id={PART_SQL} AND rel_id > 'rel:4' ORDER BY rel_id LIMIT 6) SELECT *, (SELECT count(*) FROM p) <= 5 AS complete FROM p ORDER BY rel_id LIMIT 5")
def g2(spark, d):
    return R.page(R.neighbors(G.edges(spark, d, ("references", "implements")), PART, outgoing=False), "rel_id", "rel:4", 5)


@query("g4_adjacent", f"WITH {GRAPH} SELECT rel_id, rel_type, from_id, to_id, class, CASE WHEN from_id={SUPPLIER_SQL} THEN to_id ELSE from_id END AS neighbor FROM edges WHERE from_id={SUPPLIER_SQL} OR to_id={SUPPLIER_SQL} ORDER BY neighbor, rel_id LIMIT 40")
def g4(spark, d):
    return R.adjacent(G.edges(spark, d, ("contains", "implements")), SUPPLIER, 40)


BFS = (
    f"WITH RECURSIVE {GRAPH}, near AS (SELECT DISTINCT a,b FROM (SELECT from_id a,to_id b FROM edges UNION ALL SELECT to_id,from_id FROM edges)), "
    "walk(id, depth) AS (SELECT {start}, 0 UNION SELECT b, depth+1 FROM walk JOIN near ON a=id WHERE depth < {hops}) "
)


@query("g6_reachable", BFS.format(start=CUSTOMER_SQL, hops=3) + "SELECT id AS entity_id, min(depth)::INT AS depth FROM walk GROUP BY 1")
def g6(spark, d):
    return T.reachable(G.edges(spark, d), CUSTOMER, 3)


START, GOAL = (G.entity_id("module", f"nation::{n}") for n in ("NATION_0", "NATION_10"))
NATION = lambda n: ent("module", f"'nation::{n}'")


@query(
    "g5_bounded_path",
    f"WITH RECURSIVE {GRAPH}, near AS (SELECT DISTINCT a,b FROM (SELECT from_id a,to_id b FROM edges WHERE rel_type='contains' UNION ALL SELECT to_id,from_id FROM edges WHERE rel_type='contains')), "
    f"walk(id, path) AS (SELECT {NATION('NATION_0')}, [{NATION('NATION_0')}] UNION ALL SELECT b, list_append(path,b) FROM walk JOIN near ON a=id WHERE len(path)<=4 AND NOT list_contains(path,b) AND id<>{NATION('NATION_10')}), "
    f"best AS (SELECT path FROM walk WHERE id={NATION('NATION_10')} ORDER BY len(path), path LIMIT 1) SELECT (i-1)::INT AS step, e AS entity_id FROM (SELECT unnest(path) AS e, generate_subscripts(path,1) AS i FROM best)",
)
def g5(spark, d):
    return T.shortest_path(G.edges(spark, d, ("contains",)), START, GOAL, 4)


def _supplier(key: int) -> str:
    return ent("symbol", f"'supplier::{key}'")


@query(
    "g7_path_ties",
    f"""WITH {GRAPH}, e AS (SELECT * FROM edges WHERE rel_type='implements'), u AS (SELECT to_id AS m, ['0'||rel_id] AS o FROM e WHERE from_id={_supplier(1)} UNION ALL SELECT from_id, ['1'||rel_id] FROM e WHERE to_id={_supplier(1)}),
    v AS (SELECT m, list_append(o, '0'||rel_id) AS o FROM u JOIN e ON e.from_id=m AND e.to_id={_supplier(2)} UNION ALL SELECT m, list_append(o, '1'||rel_id) FROM u JOIN e ON e.to_id=m AND e.from_id={_supplier(2)}), b AS (SELECT m FROM v ORDER BY o LIMIT 1)
    SELECT 0 AS step, {_supplier(1)} AS entity_id FROM b UNION ALL SELECT 1, m FROM b UNION ALL SELECT 2, {_supplier(2)} FROM b""",
)
def g7(spark, d):
    """Of the many parts that two suppliers share, the path goes by the one found first: outgoing relations before incoming ones, then by relation id."""
    start, goal = (G.entity_id("symbol", f"supplier::{k}") for k in (1, 2))
    return T.shortest_path(G.edges(spark, d, ("implements",)), start, goal, 2)


@query("g18_explain", f"WITH {GRAPH} SELECT n.entity_id, n.kind, n.name, (SELECT count(*) FROM edges WHERE from_id=n.entity_id) AS outgoing, (SELECT count(*) FROM edges WHERE to_id=n.entity_id) AS incoming FROM nodes n WHERE n.entity_id={PART_SQL}")
def g18(spark, d):
    node = G.nodes(spark, d, ("part",)).filter(F.col("entity_id") == PART).select("entity_id", "kind", "name")
    return node.crossJoin(F.broadcast(R.degree_counts(G.edges(spark, d, ("references", "implements")), PART)))


@query("g19_resolve", f"WITH {GRAPH}, m AS (SELECT count(*) AS matches, min(entity_id) AS e FROM nodes WHERE entity_id='NATION_3' OR name='NATION_3') SELECT CASE matches WHEN 0 THEN 'unknown' WHEN 1 THEN 'entity' ELSE 'ambiguous' END AS status, matches, CASE WHEN matches=1 THEN e END AS entity_id FROM m")
def g19(spark, d):
    return R.resolve(G.nodes(spark, d), "NATION_3")


@query(
    "g20_diff_edges",
    f"WITH new AS ({edges_sql(2)}), old AS ({edges_sql(1)}) SELECT rel_type, change, count(*) AS n FROM (SELECT rel_type, 'added' AS change FROM new WHERE rel_id NOT IN (SELECT rel_id FROM old) UNION ALL SELECT rel_type, 'removed' FROM old WHERE rel_id NOT IN (SELECT rel_id FROM new)) GROUP BY 1,2",
)
def g20(spark, d):
    new, old = G.edges(spark, d), G.edges(spark, d, build=1)
    return R.diff(old, new, "rel_id", "rel_type").groupBy("rel_type", "change").agg(F.count(F.lit(1)).alias("n"))


@query("l1_entity_list", f"WITH {GRAPH} SELECT entity_id, qualified_name FROM nodes ORDER BY qualified_name, entity_id LIMIT 50")
def l1(spark, d):
    return G.nodes(spark, d).orderBy("qualified_name", "entity_id").limit(50).select("entity_id", "qualified_name")


@query("l2_relation_list", f"WITH {GRAPH} SELECT rel_id, rel_type FROM edges ORDER BY rel_id LIMIT 50")
def l2(spark, d):
    return G.edges(spark, d).orderBy("rel_id").limit(50).select("rel_id", "rel_type")


@query("l3_keyset_page", "SELECT c_custkey, c_name, (SELECT count(*) FROM customer WHERE c_custkey>100) <= 20 AS complete FROM customer WHERE c_custkey > 100 ORDER BY c_custkey LIMIT 20")
def l3(spark, d):
    return R.page(table(spark, d, "customer").select("c_custkey", "c_name"), "c_custkey", 100, 20)


@query("l4_offset_page", "SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 10 OFFSET 30")
def l4(spark, d):
    return table(spark, d, "customer").select("c_custkey", "c_name").orderBy("c_custkey").offset(30).limit(10)


@query("l5_cap_sentinel", "SELECT count(*) AS seen, count(*) > 100 AS over FROM (SELECT 1 FROM customer LIMIT 101)")
def l5(spark, d):
    return table(spark, d, "customer").limit(101).agg(F.count(F.lit(1)).alias("seen")).withColumn("over", F.col("seen") > 100)


HUNKS = "hunks AS (SELECT (l_partkey // 50)::VARCHAR AS file, (l_orderkey % 900)::BIGINT AS h_start, (l_orderkey % 900 + l_quantity)::BIGINT AS h_end FROM lineitem WHERE l_linenumber=1)"
SPANS = "spans AS (SELECT (p_partkey // 50)::VARCHAR AS file, p_partkey AS id, (p_partkey*37 % 900)::BIGINT AS s, (p_partkey*37 % 900 + p_size*4)::BIGINT AS e FROM part)"


@query(
    "j16_interval_overlap",
    f"""WITH {HUNKS}, {SPANS}, hit AS (SELECT DISTINCT h.file, h_start, h_end, id, s, e FROM hunks h JOIN spans p ON h.file=p.file AND s<=h_end AND e>=h_start)
    SELECT file, h_start, h_end, id, s AS start, e AS "end" FROM hit a WHERE NOT EXISTS (SELECT 1 FROM hit b WHERE b.file=a.file AND b.h_start=a.h_start AND b.h_end=a.h_end AND b.id<>a.id AND b.s>=a.s AND b.e<=a.e AND (b.s>a.s OR b.e<a.e))""",
)
def j16(spark, d):
    lines = table(spark, d, "lineitem").filter("l_linenumber = 1")
    hunks = lines.selectExpr("cast(l_partkey div 50 AS string) AS file", "l_orderkey % 900 AS h_start", "cast(l_orderkey % 900 + l_quantity AS bigint) AS h_end").distinct()
    spans = table(spark, d, "part").selectExpr("cast(p_partkey div 50 AS string) AS file", "p_partkey AS id", "p_partkey * 37 % 900 AS start", "p_partkey * 37 % 900 + p_size * 4 AS end")
    return R.interval_overlaps(hunks, spans)


@query(
    "j17_changed_callers",
    f"WITH {GRAPH} SELECT to_id AS entity_id, count(DISTINCT from_id) AS callers, count(*) FILTER (WHERE class='ambiguous') AS doubtful FROM edges WHERE rel_type='references' AND to_id IN (SELECT {ent('definition', chr(39) + 'part::' + chr(39) + '||p_partkey')} FROM part WHERE p_size=7) GROUP BY 1",
)
def j17(spark, d):
    changed = table(spark, d, "part").filter("p_size = 7").select(G.entity_col("definition", F.concat(F.lit("part::"), F.col("p_partkey").cast("string"))).alias("to_id"))
    hit = G.edges(spark, d, ("references",)).join(changed, "to_id", "left_semi")
    return hit.groupBy(F.col("to_id").alias("entity_id")).agg(F.countDistinct("from_id").alias("callers"), F.count_if(F.col("class") == "ambiguous").alias("doubtful"))


@query(
    "r13_search_hints",
    f"WITH {GRAPH}, hit AS ({SEARCH_SQL.format('a', 5)}) SELECT h.entity_id, h.name, count(e.rel_id) AS callers FROM hit h LEFT JOIN edges e ON e.to_id=h.entity_id GROUP BY 1,2",
)
def r13(spark, d):
    hit = R.search(G.nodes(spark, d), "a", 5)
    e = G.edges(spark, d).join(F.broadcast(hit.select(F.col("entity_id").alias("to_id"))), "to_id", "left_semi")
    callers = e.groupBy(F.col("to_id").alias("entity_id")).agg(F.count(F.lit(1)).alias("n"))
    return hit.join(callers, "entity_id", "left").select("entity_id", "name", F.coalesce("n", F.lit(0)).alias("callers"))


@query("g23_dag_heads", "SELECT max(event_id) AS id FROM events GROUP BY user_id")
def g23(spark, d):
    from pyspark.sql import Window

    e = table(spark, d, "events").select("event_id", "user_id")
    before = F.lag("event_id").over(Window.partitionBy("user_id").orderBy("event_id"))
    events = e.select(F.col("event_id").alias("id"), F.array_compact(F.array(before)).alias("parents"))
    return T.dag_heads(events)


@query("g23_topological_levels", "SELECT level::INT AS level, count(*) AS n FROM (SELECT row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS level FROM conversations) GROUP BY 1")
def g23t(spark, d):
    from pyspark.sql import Window

    c = table(spark, d, "conversations").select("conv_id", "turn", F.concat_ws("/", "conv_id", "turn").alias("id"))
    before = F.lag("id").over(Window.partitionBy("conv_id").orderBy("turn"))
    return T.topological_levels(c.select("id", F.array_compact(F.array(before)).alias("parents"))).groupBy("level").agg(F.count(F.lit(1)).alias("n"))


@query(
    "g24_supersession_chain",
    "SELECT o_orderkey AS id, first_value(o_orderkey) OVER w AS head, (row_number() OVER w - 1)::INT AS depth FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)",
)
def g24(spark, d):
    from pyspark.sql import Window

    o = table(spark, d, "orders")
    links = o.select(F.col("o_orderkey").alias("id"), F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("previous"))
    return T.chain_depths(links)


@query("u2_set_difference", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def u2(spark, d):
    return table(spark, d, "documents").select("doc_id").subtract(table(spark, d, "labels").select("doc_id"))


@query("u3_set_intersection", "SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels WHERE quality=0")
def u3(spark, d):
    return table(spark, d, "documents").select("doc_id").intersect(table(spark, d, "labels").filter("quality = 0").select("doc_id"))


@query("u4_union_distinct", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def u4(spark, d):
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("k")).union(table(spark, d, "supplier").select("s_nationkey")).distinct()


@query("u1_union_all", "SELECT kind, count(*) AS n FROM (SELECT 'node' AS kind FROM nation UNION ALL SELECT 'edge' FROM region) GROUP BY 1")
def u1(spark, d):
    a = table(spark, d, "nation").select(F.lit("node").alias("kind"))
    return a.unionByName(table(spark, d, "region").select(F.lit("edge").alias("kind"))).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
