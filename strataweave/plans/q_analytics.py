"""Queries of whole-graph analytics; communities are the files' areas unless said otherwise."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import area
from ..operators import analytics as A
from ..operators import leiden as L
from ..session import settle, table
from ..sources import tpch_graph as G
from .registry import GRAPH, query

AREA = "CASE WHEN len(string_split(file,'/'))>2 THEN split_part(file,'/',1)||'/'||split_part(file,'/',2) ELSE split_part(file,'/',1) END"
LABEL = f"lab AS (SELECT entity_id, {AREA} AS community FROM nodes)"
PAIRS = "prs AS (SELECT DISTINCT a,b FROM (SELECT from_id a,to_id b FROM edges UNION ALL SELECT to_id,from_id FROM edges)), deg AS (SELECT a AS entity_id, count(*) AS degree FROM prs GROUP BY 1)"
CTE = f"WITH {GRAPH}, {LABEL}, {PAIRS}"
COUNTS = (
    "cnt AS (SELECT s.community, s.size, coalesce(x.internal,0) AS internal, coalesce(x.boundary,0) AS boundary FROM (SELECT community, count(*) AS size FROM lab GROUP BY 1) s LEFT JOIN "
    "(SELECT la.community, count(*) FILTER (WHERE la.community=lb.community AND a<b) AS internal, count(*) FILTER (WHERE la.community<>lb.community) AS boundary FROM prs JOIN lab la ON la.entity_id=a JOIN lab lb ON lb.entity_id=b GROUP BY 1) x USING (community))"
)
SYMBOL = "kind IN ('definition','symbol')"


def graph(spark, d):
    n = G.nodes(spark, d)
    return n, G.edges(spark, d), n.select("entity_id", area(F.col("file")).alias("community"))


@query("a5_community_cohesion", f"{CTE}, {COUNTS} SELECT *, CASE WHEN size<2 THEN 1.0::DOUBLE ELSE round(internal/(size*(size-1)/2), 3)::DOUBLE END AS cohesion FROM cnt")
def a5(spark, d):
    _, e, lab = graph(spark, d)
    return A.community_edges(e, lab)


@query(
    "a6_modularity",
    f"{CTE}, ends AS (SELECT unnest([la.community, lb.community]) AS community, (la.community=lb.community)::INT AS inside FROM edges JOIN lab la ON la.entity_id=from_id JOIN lab lb ON lb.entity_id=to_id), per AS (SELECT community, count(*) AS s, sum(inside) AS i FROM ends GROUP BY 1), t AS (SELECT sum(s) AS total FROM per) SELECT round(sum(i/total - pow(s/total,2)),6) AS quality FROM per, t",
)
def a6(spark, d):
    _, e, lab = graph(spark, d)
    return A.modularity(e, lab)


@query("a13_dominant_area", f"WITH {GRAPH}, c AS (SELECT kind AS community, {AREA} AS area, count(*) AS n FROM nodes GROUP BY 1,2) SELECT community, area FROM c QUALIFY row_number() OVER (PARTITION BY community ORDER BY n DESC, area)=1")
def a13(spark, d):
    n = G.nodes(spark, d)
    return A.dominant_area(n, n.select("entity_id", F.col("kind").alias("community")))


@query("a14_collapsed_weights", f"{CTE} SELECT least(la.community,lb.community) AS low, greatest(la.community,lb.community) AS high, count(*) AS weight FROM edges JOIN lab la ON la.entity_id=from_id JOIN lab lb ON lb.entity_id=to_id WHERE la.community<>lb.community GROUP BY 1,2")
def a14(spark, d):
    _, e, lab = graph(spark, d)
    return A.collapsed(e, lab)


@query(
    "g13_god_nodes",
    f"{CTE}, inf AS (SELECT unnest([from_id,to_id]) AS entity_id FROM edges WHERE class='inferred'), ic AS (SELECT entity_id, count(*) AS k FROM inf GROUP BY 1) SELECT n.entity_id, name, kind, file, coalesce(degree,0) AS degree, coalesce(k,0) AS inferred_edges FROM nodes n LEFT JOIN deg USING (entity_id) LEFT JOIN ic USING (entity_id) WHERE {SYMBOL} ORDER BY degree DESC, n.entity_id LIMIT 20",
)
def g13(spark, d):
    n, e, _ = graph(spark, d)
    return A.god_nodes(n, e, 20)


@query("g14_ranked_members", f"{CTE} SELECT community, (row_number() OVER w)::INT AS rank, n.entity_id, coalesce(degree,0) AS degree FROM nodes n JOIN lab USING (entity_id) LEFT JOIN deg USING (entity_id) WINDOW w AS (PARTITION BY community ORDER BY ({SYMBOL}) DESC, coalesce(degree,0) DESC, n.entity_id) QUALIFY rank<=5")
def g14(spark, d):
    return A.ranked_members(*graph(spark, d))


@query(
    "g15_surprises",
    f"""{CTE}, p AS (SELECT n.*, community, coalesce(degree,0) AS degree, regexp_matches(file, '\\.(md|markdown|mdx|txt|rst|adoc)$') AS doc FROM nodes n JOIN lab USING (entity_id) LEFT JOIN deg USING (entity_id)),
    j AS (SELECT rel_id, rel_type, class, a.doc<>b.doc AS x1, a.community<>b.community AS x2, least(a.degree,b.degree)<=2 AND greatest(a.degree,b.degree)>=5 AS x3, a.community AS ca, b.community AS cb,
    CASE class WHEN 'ambiguous' THEN 3 WHEN 'inferred' THEN 2 WHEN 'extracted' THEN 1 ELSE 0 END AS base FROM edges JOIN p a ON a.entity_id=from_id JOIN p b ON b.entity_id=to_id WHERE rel_type NOT IN ('contains','defines','imports') AND from_id<>to_id)
    SELECT rel_id, rel_type, class, (base + CASE WHEN x1 THEN 2 ELSE 0 END + CASE WHEN x2 THEN 3 ELSE 0 END + CASE WHEN x3 THEN 1 ELSE 0 END)::INT AS score,
    concat_ws('; ', CASE class WHEN 'ambiguous' THEN 'ambiguous evidence' WHEN 'inferred' THEN 'inferred evidence' END, CASE WHEN x1 THEN 'documentation and code' END, CASE WHEN x2 THEN ca||' to '||cb END, CASE WHEN x2 THEN 'between communities' END, CASE WHEN x3 THEN 'periphery and hub' END) AS why
    FROM j WHERE x1 OR x2 OR x3 ORDER BY score DESC, rel_id LIMIT 50""",
)
def g15(spark, d):
    return A.surprises(*graph(spark, d))


@query("g16_bridge_nodes", f"{CTE} SELECT n.entity_id, count(DISTINCT community) AS spans, count(DISTINCT b) AS degree, any_value(name) AS name FROM prs JOIN lab ON lab.entity_id=b JOIN nodes n ON n.entity_id=a WHERE {SYMBOL} GROUP BY 1 HAVING count(DISTINCT community)>=3 ORDER BY spans DESC, degree DESC, 1 LIMIT 5")
def g16b(spark, d):
    return A.bridge_nodes(*graph(spark, d))


@query("g16_weak_boundaries", f"{CTE}, {COUNTS}, s AS (SELECT *, internal/greatest(internal+boundary,1) AS sh FROM cnt WHERE size>=5) SELECT community, internal, boundary, round(sh,6) AS share FROM s WHERE sh<0.5 ORDER BY share, community LIMIT 5")
def g16w(spark, d):
    _, e, lab = graph(spark, d)
    return A.weak_boundaries(e, lab)


@query(
    "g16_unused_symbols",
    f"WITH {GRAPH}, u AS (SELECT DISTINCT unnest([from_id,to_id]) AS id FROM edges WHERE rel_type NOT IN ('contains','defines','imports')) SELECT file, name, entity_id FROM nodes WHERE {SYMBOL} AND entity_id NOT IN (SELECT id FROM u) AND file IN (SELECT file FROM nodes WHERE entity_id IN (SELECT id FROM u)) ORDER BY 1,2,3 LIMIT 5",
)
def g16u(spark, d):
    n, e, _ = graph(spark, d)
    return A.unused_symbols(n, e)


@query("g16_ambiguous_edges", f"WITH {GRAPH} SELECT rel_id, from_id, to_id FROM edges WHERE class='ambiguous' ORDER BY 1 LIMIT 5")
def g16a(spark, d):
    return A.ambiguous_edges(G.edges(spark, d, ("references", "implements")))


@query(
    "g16_verify_inferred",
    f"{CTE}, inf AS (SELECT unnest([from_id,to_id]) AS entity_id FROM edges WHERE class='inferred'), ic AS (SELECT entity_id, count(*) AS k FROM inf GROUP BY 1), g AS (SELECT n.entity_id, coalesce(degree,0) AS degree, coalesce(k,0) AS inferred_edges FROM nodes n LEFT JOIN deg USING (entity_id) LEFT JOIN ic USING (entity_id) WHERE {SYMBOL} ORDER BY degree DESC, 1 LIMIT 50) SELECT * FROM g WHERE inferred_edges>=2 ORDER BY degree DESC, entity_id LIMIT 5",
)
def g16v(spark, d):
    n, e, _ = graph(spark, d)
    return A.to_verify(n, e)


def nation_graphs(spark, d):
    """Customers and the priority classes of their orders, one graph for each nation."""
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    pairs = o.join(c, o.o_custkey == c.c_custkey).select(F.col("c_nationkey").alias("g"), F.concat(F.lit("c"), "c_custkey").alias("a"), F.concat(F.lit("p"), F.col("o_orderpriority")).alias("b"))
    return pairs.distinct()


@query("g11_leiden")
def g11(spark, d):
    return L.communities(nation_graphs(spark, d))


@query(
    "g11_leiden_guarantees",
    """WITH e AS (SELECT DISTINCT c_nationkey AS g, 'c'||c_custkey AS a, 'p'||o_orderpriority AS b FROM orders JOIN customer ON o_custkey=c_custkey), n AS (SELECT g, a AS node FROM e UNION SELECT g, b FROM e),
    t AS (SELECT g, 2*count(*) AS total FROM e GROUP BY 1), h AS (SELECT g, a, min(b) AS c FROM e GROUP BY 1,2), l AS (SELECT g, a AS node, c FROM h UNION SELECT g, b, b FROM e),
    m AS (SELECT x.g, x.c, count(*) AS mass, 2*count(*) FILTER (WHERE x.side='a' AND x.c=x.o) AS inside FROM (SELECT e.g, la.c, lb.c AS o, 'a' AS side FROM e JOIN l la ON la.g=e.g AND la.node=e.a JOIN l lb ON lb.g=e.g AND lb.node=e.b UNION ALL SELECT e.g, lb.c, la.c, 'b' FROM e JOIN l la ON la.g=e.g AND la.node=e.a JOIN l lb ON lb.g=e.g AND lb.node=e.b) x GROUP BY 1,2),
    s AS (SELECT g, round(sum(inside/total - pow(mass/total,2)),9) AS stars FROM m JOIN t USING (g) GROUP BY 1)
    SELECT g, (SELECT count(*) FROM n WHERE n.g=s.g) AS n_nodes, stars, TRUE AS as_good_as_stars, TRUE AS connected, TRUE AS settled FROM s""",
)
def g11g(spark, d):
    """What holds of the communities: they are connected, no vertex gains by moving to a neighbour's, and the quality is at least that of stars.

    The stars put a customer to the first priority class that it has.
    """
    pairs = settle(nation_graphs(spark, d), "leiden-pairs")
    found = settle(L.communities(pairs), "leiden-labels")
    near = settle(L._adjacency(pairs), "leiden-near")
    stars = pairs.groupBy("g", F.col("a").alias("v")).agg(F.min("b").alias("c")).unionByName(pairs.select("g", F.col("b").alias("v"), F.col("b").alias("c")).distinct())
    stars = L.quality(near, stars, 1.0).select("g", F.round("quality", 9).alias("stars"))
    own = found.groupBy("g").agg(F.count(F.lit(1)).alias("n_nodes"), F.max("quality").alias("quality"))
    good = (F.col("quality") >= F.col("stars") - 1e-9).alias("as_good_as_stars")
    return own.join(stars, "g").join(L.guarantees(near, found), "g").select("g", "n_nodes", "stars", good, "connected", "settled")


@query(
    "g11_cliques",
    """WITH c AS (SELECT c_custkey AS k, c_custkey//5 AS q FROM customer), e AS (SELECT a.q%7 AS g, a.q, a.k AS a, b.k AS b FROM c a JOIN c b ON a.q=b.q AND a.k<b.k),
    n AS (SELECT DISTINCT g, q, unnest([a,b]) AS node FROM e), s AS (SELECT g, q, count(*) AS n, min(node) AS least FROM n GROUP BY 1,2), r AS (SELECT g, q, (row_number() OVER (PARTITION BY g ORDER BY n DESC, least) - 1)::INT AS community FROM s),
    m AS (SELECT g, q, 2*count(*) AS mass FROM e GROUP BY 1,2), t AS (SELECT g, sum(mass) AS total FROM m GROUP BY 1), ql AS (SELECT g, round(sum(mass/total - pow(mass/total,2)),6) AS quality FROM m JOIN t USING (g) GROUP BY 1)
    SELECT n.g, node, community, quality FROM n JOIN r USING (g,q) JOIN ql ON ql.g=n.g""",
)
def g11c(spark, d):
    """Complete groups of five customers, without edges between groups: each is a community."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.expr("c_custkey div 5").alias("q"))
    a, b = c.select("q", F.col("k").alias("a")), c.select("q", F.col("k").alias("b"))
    edges = a.join(b, "q").filter("a < b").select((F.col("q") % 7).alias("g"), "a", "b")
    return L.communities(edges).withColumn("quality", F.round("quality", 6))


_VOTE = "l{0} AS (SELECT a AS node, label FROM (SELECT e.a, l.label, row_number() OVER (PARTITION BY e.a ORDER BY count(*) DESC, l.label) AS k FROM e JOIN l{1} l ON l.node=e.b GROUP BY e.a, l.label) WHERE k=1)"


@query("g11_label_propagation", "WITH p AS (SELECT DISTINCT 'c'||o_custkey AS a, 'p'||o_orderpriority AS b FROM orders), e AS (SELECT a, b FROM p UNION SELECT b, a FROM p), l0 AS (SELECT DISTINCT a AS node, a AS label FROM e), " + ", ".join(_VOTE.format(k + 1, k) for k in range(3)) + " SELECT node, label FROM l3")
def g11p(spark, d):
    o = table(spark, d, "orders").select(F.concat(F.lit("c"), "o_custkey").alias("a"), F.concat(F.lit("p"), F.col("o_orderpriority")).alias("b"))
    return L.label_propagation(o.distinct(), 3)


@query("g17_community_read", f"{CTE} SELECT entity_id, (SELECT greatest(count(*)-10,0) FROM lab WHERE community='crm/BUILDING') AS omitted_members FROM lab WHERE community='crm/BUILDING' ORDER BY entity_id LIMIT 10")
def g17(spark, d):
    n = G.nodes(spark, d, ("customer",))
    own = n.filter(area(F.col("file")) == "crm/BUILDING").select("entity_id")
    more = own.agg(F.greatest(F.count(F.lit(1)) - 10, F.lit(0)).alias("omitted_members"))
    return own.orderBy("entity_id").limit(10).crossJoin(F.broadcast(more))


@query("k9_wiki_pages", f"WITH {GRAPH}, m AS (SELECT {AREA} AS community, qualified_name, row_number() OVER (PARTITION BY {AREA} ORDER BY qualified_name) AS rn, count(*) OVER (PARTITION BY {AREA}) AS n FROM nodes) SELECT community, '# '||community||chr(10)||string_agg('- '||qualified_name, chr(10) ORDER BY qualified_name) AS page FROM m WHERE rn<=20 AND n>1 GROUP BY 1")
def k9(spark, d):
    from ..sources.sinks import wiki_pages

    n = G.nodes(spark, d)
    return wiki_pages(n.withColumn("community", area(F.col("file"))), 20)


@query("k7_graphml_rows", f"""WITH {GRAPH} SELECT '<edge id="'||rel_id||'" source="'||from_id||'" target="'||to_id||'"><data key="type">'||rel_type||'</data></edge>' AS line FROM edges""")
def k7(spark, d):
    from ..sources.sinks import graphml_edges

    return graphml_edges(G.edges(spark, d))


@query("k8_cypher_rows", f"WITH {GRAPH} SELECT 'CREATE (:'||kind||' {{id: '''||entity_id||''', name: '''||replace(replace(name,'\\','\\\\'),'''','\\''')||'''}})' AS line FROM nodes")
def k8(spark, d):
    from ..sources.sinks import cypher_nodes

    return cypher_nodes(G.nodes(spark, d))


@query("k13_publication_digest", f"WITH {GRAPH} SELECT sha256(string_agg(rel_id||chr(9)||class||chr(0), '' ORDER BY rel_id)) AS digest FROM edges")
def k13(spark, d):
    from ..functions.ids import digests

    return digests(G.edges(spark, d), [], ["rel_id"], F.concat("rel_id", F.lit("\t"), "class")).select("digest")
