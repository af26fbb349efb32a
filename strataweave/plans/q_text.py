"""Queries of text extraction and retrieval."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.ids import digests, sha_col
from ..functions.text import STOP_WORDS, terms
from ..operators import extract as X
from ..operators import retrieval as V
from ..session import table
from ..sources.snapshot import inventory
from .registry import _sha, query

STOPS = "[" + ",".join(f"'{w}'" for w in STOP_WORDS) + "]"


def TERMS(col: str) -> str:
    return f"list_distinct(list_filter(string_split_regex(lower(coalesce({col},'')), '[^\\p{{L}}\\p{{N}}_]+'), lambda w: length(w) >= 3 AND NOT list_contains({STOPS}, w)))"


INVENTORY = "f AS (SELECT 'docs/'||doc_id||'.txt' AS path, strlen(text)::BIGINT AS bytes FROM documents)"


@query("s4_inventory", f"WITH {INVENTORY}, o AS (SELECT *, sum(bytes) OVER (ORDER BY path) AS used, row_number() OVER (ORDER BY path) AS i FROM f), k AS (SELECT * FROM o WHERE used<=16777216 AND i<=128) SELECT count(*) AS files, coalesce(sum(bytes),0)::BIGINT AS bytes, (SELECT count(*) FROM f)=count(*) AS complete, CASE WHEN (SELECT count(*) FROM f)=count(*) THEN NULL WHEN count(*)=128 THEN 'files' ELSE 'bytes' END AS stopped_by FROM k")
def s4(spark, d):
    files = table(spark, d, "documents").select(F.concat(F.lit("docs/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.octet_length("text").cast("long").alias("bytes"))
    return inventory(files)


@query("s1_snapshot_id", "SELECT 'snap:'||substr(sha256(string_agg('docs/'||doc_id||'.txt:'||sha256(text)||chr(0), '' ORDER BY 'docs/'||doc_id||'.txt')),1,12) AS snapshot_id, count(*) AS files FROM documents")
def s1(spark, d):
    files = table(spark, d, "documents").select(F.concat(F.lit("docs/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.sha2("text", 256).alias("sha"))
    whole = digests(files, [], ["path"], F.concat("path", F.lit(":"), "sha"))
    return whole.select(F.concat(F.lit("snap:"), F.substring("digest", 1, 12)).alias("snapshot_id"), F.col("n").alias("files"))


@query("s6_supported_files", "SELECT contains(url,'.') AND lower(split_part(url,'.',-1)) IN ('rs','ts','tsx','js','jsx','mts','cts','nix','py','md','markdown','mdx','txt','rst','adoc','json') AS ok, count(*) AS n FROM pages GROUP BY 1")
def s6(spark, d):
    return table(spark, d, "pages").groupBy(X.supported(F.col("url")).alias("ok")).agg(F.count(F.lit(1)).alias("n"))


@query("fn_html_headings", "SELECT page_id, unnest(regexp_extract_all(html, '<h([1-6])>([^<]*)</h[1-6]>', 2)) AS heading FROM pages")
def e2(spark, d):
    return table(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit("<h([1-6])>([^<]*)</h[1-6]>"), F.lit(2))).alias("heading"))


@query("fn_html_links", "SELECT href, count(*) AS n FROM (SELECT unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)) AS href FROM pages) GROUP BY 1")
def e3(spark, d):
    return table(spark, d, "pages").select(F.explode(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))).alias("href")).groupBy("href").agg(F.count(F.lit(1)).alias("n"))


@query("e3_markdown", "SELECT doc_id, ['Document '||doc_id, 'Source of '||source] AS headings, ['docs/'||doc_id||'.md'] AS links, [lang, source] AS code FROM documents")
def e3m(spark, d):
    """Markdown with two headings, a link and two code spans for each document, read back by the patterns."""
    i, tick = F.col("doc_id").cast("string"), F.lit("`")
    t = F.concat(F.lit("# Document "), i, F.lit("\nsee [the text](docs/"), i, F.lit(".md) in "), tick, "lang", tick, F.lit(" and "), tick, "source", tick, F.lit("\n## Source of "), "source", F.lit("\nno #heading\n"))
    return table(spark, d, "documents").select("doc_id", X.headings(t).alias("headings"), X.links(t).alias("links"), X.inline_code(t).alias("code"))


@query("e18_fixed_slices", 'SELECT doc_id, s AS start, least(s+400, length(text))::INT AS "end", md5(substr(text, s+1, 400)) AS part FROM (SELECT doc_id, text, unnest(range(0, length(text), 400))::INT AS s FROM documents)')
def e18(spark, d):
    return X.slices(table(spark, d, "documents"), "doc_id", "text", 400).withColumn("part", F.md5("part"))


@query("e17_text_pointers", "SELECT conv_id, '/'||conv_id||'/'||turn||'/content/'||(i-1)||'/text' AS pointer, l AS line FROM (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)),1) AS i FROM conversations WHERE role='assistant')")
def e17(spark, d):
    c = table(spark, d, "conversations").filter("role = 'assistant'").select("conv_id", "turn", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    return c.select("conv_id", F.concat(F.lit("/"), "conv_id", F.lit("/"), "turn", F.lit("/content/"), "i", F.lit("/text")).alias("pointer"), "line")


@query("g10_query_terms", f"SELECT item_id, list_sort({TERMS('text')}) AS terms FROM benchmark")
def g10(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.array_sort(terms(F.col("text"))).alias("terms"))


@query("r9_term_counts", f"SELECT w, count(*) AS n FROM (SELECT unnest({TERMS('text')}) AS w FROM documents) GROUP BY 1")
def r9(spark, d):
    return table(spark, d, "documents").select(F.explode(terms(F.col("text"))).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))


COSINE = "(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / (sqrt(list_dot_product(a.embedding::DOUBLE[],a.embedding::DOUBLE[])) * sqrt(list_dot_product(b.embedding::DOUBLE[],b.embedding::DOUBLE[]))))"


@query("r2_exact_knn", f"SELECT a.vec_id, round({COSINE},6) AS cosine FROM embeddings a, (SELECT * FROM embeddings WHERE vec_id=0) b ORDER BY cosine DESC, a.vec_id LIMIT 20")
def r2(spark, d):
    e = table(spark, d, "embeddings")
    return V.nearest(e, "vec_id", "embedding", list(e.filter("vec_id = 0").first().embedding), 20)


@query("r3_cosine_of_set", f"SELECT a.vec_id AS a, b.vec_id AS b, round({COSINE},6) AS cosine FROM embeddings a JOIN embeddings b ON a.label=b.label AND a.vec_id<b.vec_id")
def r3(spark, d):
    return V.cosine_pairs(table(spark, d, "embeddings"), "vec_id", "label", "embedding")


@query("r5_unit_vectors", "SELECT vec_id, round(list_sum(list_transform(embedding[1:16], lambda x: x::DOUBLE*x::DOUBLE)),6) AS raw, 1.0::DOUBLE AS unit FROM embeddings")
def r5(spark, d):
    e = table(spark, d, "embeddings")
    u = V.unit(F.col("embedding"), 16)
    cut = F.slice("embedding", 1, 16)
    return e.select("vec_id", F.round(V.dot(cut, cut), 6).alias("raw"), F.round(V.dot(u, u), 6).alias("unit"))


@query(
    "r4_rank_fusion",
    f"""WITH v AS (SELECT a.vec_id AS id, row_number() OVER (ORDER BY round({COSINE},6) DESC, a.vec_id)-1 AS rank FROM embeddings a, (SELECT * FROM embeddings WHERE vec_id=0) b QUALIFY rank<50),
    l AS (SELECT vec_id AS id, row_number() OVER (ORDER BY abs(label-3), vec_id)-1 AS rank FROM embeddings QUALIFY rank<50),
    u AS (SELECT 0 AS list, id, rank FROM l UNION ALL SELECT 1, id, rank FROM v) SELECT id, round(sum(1.0::DOUBLE/(61+rank)),9) AS score FROM u GROUP BY 1""",
)
def r4(spark, d):
    e = table(spark, d, "embeddings")
    v = V.nearest(e, "vec_id", "embedding", list(e.filter("vec_id = 0").first().embedding), 50)
    # Both lists are already cut to 50 rows, so a global order is cheap.
    v = v.select(F.lit(1).alias("list"), F.col("vec_id").alias("id"), (F.row_number().over(Window.orderBy(F.desc("cosine"), "vec_id")) - 1).alias("rank"))
    near = F.abs(F.col("label") - 3)
    lex = e.select("vec_id", near.alias("o")).orderBy("o", "vec_id").limit(50)
    lex = lex.select(F.lit(0).alias("list"), F.col("vec_id").alias("id"), (F.row_number().over(Window.orderBy("o", "vec_id")) - 1).alias("rank"))
    return V.fuse(lex.unionAll(v))


@query(
    "r7_overlap_rank",
    f"WITH q AS (SELECT {TERMS('text')} AS q FROM documents WHERE doc_id=1) SELECT doc_id, len(list_intersect({TERMS('d.text')}, q)) AS shared FROM documents d, q WHERE len(list_intersect({TERMS('d.text')}, q)) > 0 ORDER BY shared DESC, doc_id LIMIT 20",
)
def r7(spark, d):
    docs = table(spark, d, "documents")
    q = docs.filter("doc_id = 1").select(terms(F.col("text")).alias("t")).first().t
    return V.overlap_rank(docs, "doc_id", terms(F.col("text")), q, 20).select("doc_id", F.col("shared").cast("long").alias("shared"))


PAIRS = f"e AS (SELECT DISTINCT doc_id, lang, unnest({TERMS('text')}) AS w FROM documents), p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM e x JOIN e y ON x.lang=y.lang AND x.w=y.w AND x.doc_id<>y.doc_id WHERE x.doc_id % 100 = 0 GROUP BY 1,2)"


def term_rows(spark, d):
    """(asked rows, all rows): every row whose id is divisible by 100 is looked up among all."""
    docs = table(spark, d, "documents").select("doc_id", "lang", terms(F.col("text")).alias("t"))
    return docs.filter("doc_id % 100 = 0"), docs


@query("j19_related_records", f"WITH {PAIRS} SELECT a, b, shared, row_number() OVER (PARTITION BY a ORDER BY shared DESC, b)::INT AS rank FROM p QUALIFY rank<=4")
def j19(spark, d):
    return V.related(*term_rows(spark, d), "doc_id", "lang", "t", 4)


@query("j18_reconcile_pairs", f"WITH {PAIRS} SELECT DISTINCT least(a,b) AS a, greatest(a,b) AS b, shared FROM p")
def j18(spark, d):
    return V.reconcile_pairs(*term_rows(spark, d), "doc_id", "lang", "t")


@query("j5_pending_texts", "SELECT doc_id FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 3 = 0)")
def j5(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    return docs.join(docs.filter("doc_id % 3 = 0").select("h"), "h", "left_anti").select("doc_id")


@query("j9_name_resolution", "WITH d AS (SELECT p_brand AS file, p_name AS name, p_partkey AS id FROM part), n AS (SELECT file,name,min(id) AS i FROM d GROUP BY 1,2 HAVING count(*)=1), g AS (SELECT name, min(id) AS i FROM d GROUP BY 1 HAVING count(*)=1), s AS (SELECT p_partkey AS site_id, 'Brand#1'||(p_partkey % 9) AS file, p_name AS name FROM part) SELECT site_id, coalesce(n.i,g.i) AS def_id, CASE WHEN n.i IS NOT NULL THEN 'file' ELSE 'global' END AS how FROM s LEFT JOIN n USING (file,name) LEFT JOIN g USING (name) WHERE coalesce(n.i,g.i) IS NOT NULL")
def j9(spark, d):
    p = table(spark, d, "part")
    defs = p.selectExpr("p_brand AS file", "p_name AS name", "p_partkey AS def_id")
    sites = p.selectExpr("p_partkey AS site_id", "concat('Brand#1', p_partkey % 9) AS file", "p_name AS name")
    return X.unique_matches(sites, defs)


@query(
    "d1_candidates",
    """WITH p AS (SELECT 0 AS ord, 'explicit' AS reason, 'references' AS rel_type, o_orderkey AS from_id, o_custkey AS to_id FROM orders WHERE o_orderpriority='1-URGENT' UNION ALL SELECT 1, 'co-occurrence', 'references', o_orderkey, o_custkey FROM orders),
    n AS (SELECT * FROM p WHERE NOT (from_id % 7 = 0) QUALIFY row_number() OVER (PARTITION BY rel_type, from_id, to_id ORDER BY ord, reason)=1)
    SELECT reason, selected, count(*) AS n FROM (SELECT reason, row_number() OVER (PARTITION BY reason ORDER BY rel_type, from_id, to_id) <= 40 AS selected FROM n) GROUP BY 1,2""",
)
def d1(spark, d):
    orders = table(spark, d, "orders")
    pairs = lambda df: df.selectExpr("'references' AS rel_type", "o_orderkey AS from_id", "o_custkey AS to_id")
    o = pairs(orders)
    first = pairs(orders.filter("o_orderpriority = '1-URGENT'")).selectExpr("0 AS ord", "'explicit' AS reason", "*")
    second = o.selectExpr("1 AS ord", "'co-occurrence' AS reason", "*")
    return X.candidates(o.filter("from_id % 7 = 0"), first.unionAll(second), 40).groupBy("reason", "selected").agg(F.count(F.lit(1)).alias("n"))


@query("fn_text_identity", f"SELECT doc_id, {_sha(chr(39) + 'text-v1' + chr(39), 'text')} AS text_sha FROM documents")
def e15(spark, d):
    return table(spark, d, "documents").select("doc_id", sha_col("text-v1", F.col("text")).alias("text_sha"))


@query("w7_adjacent_pairs", "SELECT a, b FROM (SELECT p_brand, p_partkey AS a, lead(p_partkey) OVER w AS b, row_number() OVER w AS rn FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_partkey)) WHERE b IS NOT NULL AND rn <= 25")
def w7(spark, d):
    w = Window.partitionBy("p_brand").orderBy("p_partkey")
    p = table(spark, d, "part").select(F.col("p_partkey").alias("a"), F.lead("p_partkey").over(w).alias("b"), F.row_number().over(w).alias("rn"))
    return p.filter("b IS NOT NULL AND rn <= 25").select("a", "b")


@query("j10_citations", "WITH c AS (SELECT event_id, regexp_extract(props, '([0-9]+)', 1)::INT AS k FROM events), n AS (SELECT n_nationkey AS k, n_name FROM nation) SELECT n_name, count(*) AS cited FROM c JOIN n USING (k) GROUP BY 1")
def j10(spark, d):
    e = table(spark, d, "events").select(F.regexp_extract("props", "([0-9]+)", 1).try_cast("int").alias("k"))
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), "n_name")
    return e.join(F.broadcast(n), "k").groupBy("n_name").agg(F.count(F.lit(1)).alias("cited"))


@query("j11_import_theta", "SELECT a.p_partkey AS a, min(b.p_partkey) AS b FROM part a JOIN part b ON a.p_name=b.p_name AND a.p_brand<>b.p_brand GROUP BY 1")
def j11(spark, d):
    """The smallest part of the same name and another brand: each name keeps two brands with their smallest parts, of which one is another brand for any part."""
    p = table(spark, d, "part").selectExpr("p_partkey AS a", "p_name", "p_brand AS brand")
    least = p.filter("p_name IS NOT NULL AND brand IS NOT NULL AND a IS NOT NULL").groupBy("p_name", "brand").agg(F.min("a").alias("b"))
    first = F.min(F.struct("b", "brand")).alias("first")
    firsts = least.groupBy("p_name").agg(first)
    seconds = least.join(firsts, "p_name").filter("brand <> first.brand").groupBy("p_name").agg(F.min("b").alias("second"))
    ends = firsts.join(seconds, "p_name")
    other = F.when(F.col("brand") == F.col("first.brand"), F.col("second")).otherwise(F.col("first.b"))
    return p.filter("brand IS NOT NULL").join(ends, "p_name").groupBy("a").agg(F.min(other).alias("b"))
