"""Queries of validation, records, served sources, usage, knowledge versions and resolution."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import doc_number, module_name, rfc3339, token_estimate
from ..operators import extract as X
from ..operators import knowledge as K
from ..operators import records as N
from ..operators import retrieval as V
from ..operators import serving as W
from ..operators import validation as Q
from ..session import TABLES, table
from ..sources import snapshot as S
from .q_text import COSINE
from .registry import query


def count():
    return F.count(F.lit(1))


#: One source file for each part: a comment, a definition that names itself and others, an import.
CODE = "code AS (SELECT p_partkey AS k, 'src/'||p_brand||'/p'||p_partkey||'.rs' AS path, '// part '||p_partkey||chr(10)||'pub fn part_'||p_partkey||'() { part_'||(p_partkey//2)||'(); }'||chr(10)||CASE WHEN p_size % 3=0 THEN 'fn twice() { part_'||p_partkey||'(); }'||chr(10) ELSE '' END||'use crate::part_'||(p_partkey//3)||';'||chr(10) AS text FROM part)"


def code(spark, d):
    k = F.col("p_partkey").cast("string")
    half, third = F.expr("cast(p_partkey div 2 AS string)"), F.expr("cast(p_partkey div 3 AS string)")
    again = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("fn twice() { part_"), k, F.lit("(); }\n"))).otherwise("")
    text = F.concat(F.lit("// part "), k, F.lit("\npub fn part_"), k, F.lit("() { part_"), half, F.lit("(); }\n"), again, F.lit("use crate::part_"), third, F.lit(";\n"))
    return table(spark, d, "part").select(F.concat(F.lit("src/"), "p_brand", F.lit("/p"), k, F.lit(".rs")).alias("path"), text.alias("text"))


@query("e1_entities", f"WITH {CODE}, e AS (SELECT path, unnest(['file','definition','import']) AS kind FROM code UNION ALL SELECT path, 'definition' FROM code WHERE contains(text,'twice')) SELECT path AS file, kind, count(*) AS n FROM e GROUP BY 1,2")
def e1(spark, d):
    return X.extract(code(spark, d)).groupBy("file", "kind").agg(count().alias("n"))


@query("e2_definitions", f"WITH {CODE} SELECT path AS file, 'part_'||k AS name, path||'::part_'||k AS qualified_name, 2 AS line, strlen('// part '||k||chr(10)||'pub fn ')::INT AS byte_start FROM code")
def e2(spark, d):
    e = X.extract(code(spark, d)).filter("kind = 'definition' AND name <> 'twice'")
    return e.select("file", "name", "qualified_name", F.col("span.start_line").alias("line"), F.col("span.byte_start").alias("byte_start"))


@query("e2_local_references", f"WITH {CODE}, m AS (SELECT path AS file, 'part_'||k AS name, len(regexp_extract_all(text, '\\bpart_'||k||'\\b')) AS mentions FROM code) SELECT file, name, mentions FROM m WHERE mentions>1")
def e2r(spark, d):
    files = code(spark, d)
    return X.local_references(X.extract(files), files)


@query("j11_import_targets", f"WITH {CODE} SELECT c.path AS import_id, 'part_'||t.k AS name, t.path AS def_id FROM code c JOIN code t ON t.k=c.k//3 WHERE c.path<>t.path")
def j11i(spark, d):
    e = X.extract(code(spark, d))
    imports = e.filter("kind = 'import'").select(F.col("file").alias("import_id"), "file", F.col("name").alias("target"))
    defs = e.filter("kind = 'definition'").select(F.col("file").alias("def_id"), "file", "name")
    met = X.import_targets(imports, defs)
    return met.join(imports, "import_id").select("import_id", F.regexp_extract("target", "([A-Za-z0-9_]+)$", 1).alias("name"), "def_id")


@query("j12_adjacent_definitions", "WITH o AS (SELECT p_brand, p_partkey AS a, lead(p_partkey) OVER w AS b, row_number() OVER w AS n FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey)) SELECT p_brand AS file, a, b FROM o WHERE n<=25 AND b IS NOT NULL")
def j12(spark, d):
    return X.adjacent_definitions(table(spark, d, "part").select(F.col("p_brand").alias("file"), F.col("p_partkey").alias("def_id"), F.col("p_retailprice").alias("start")))


@query("j10_unique_citations", "WITH d AS (SELECT p_partkey AS id, CASE WHEN p_partkey%2=0 THEN 'ADR-' ELSE 'RFC-' END||(p_partkey % 1500) AS cite FROM part), u AS (SELECT cite, min(id) AS to_id FROM d GROUP BY 1 HAVING count(*)=1), c AS (SELECT o_orderkey AS from_id, unnest(['ADR-'||(o_custkey*2), 'RFC-'||(o_custkey*2+1)]) AS cite FROM orders) SELECT DISTINCT from_id, to_id, cite FROM c JOIN u USING (cite) WHERE from_id<>to_id")
def j10u(spark, d):
    p = table(spark, d, "part")
    mark = F.when(F.col("p_partkey") % 2 == 0, "ADR-").otherwise("RFC-")
    documents = p.select(F.col("p_partkey").alias("id"), F.concat(mark, (F.col("p_partkey") % 1500).cast("string")).alias("cite"))
    even = (F.col("o_custkey") * 2).cast("string")
    text = F.concat(F.lit("as adr 00"), even, F.lit(" says, and rfc"), (F.col("o_custkey") * 2 + 1).cast("string"), F.lit("; see ADR-"), even, F.lit(" (not XADR-1)"))
    return X.citations(table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), text.alias("text")), documents)


@query("e13_relative_imports", "WITH f AS (SELECT p_partkey AS k, 'n'||(p_partkey%5)||'/m'||(p_partkey%7)||'/f'||p_partkey||'.nix' AS path FROM part), i AS (SELECT k, CASE WHEN k%4=3 THEN NULL ELSE 'n'||(CASE WHEN k%4=0 THEN k%5 ELSE (k+5)%5 END)||'/m'||((CASE WHEN k%4=2 THEN k ELSE k+35 END)%7)||'/f'||(CASE WHEN k%4=2 THEN k ELSE k+35 END)||'.nix' END AS target FROM f) SELECT i.k AS import_id, f.path AS file FROM i JOIN f ON f.path=i.target")
def e13(spark, d):
    """A sibling folder's file, one below the same folder with dots in between, itself, and paths that leave the root."""
    k, other = F.col("p_partkey"), F.col("p_partkey") + 35
    name = lambda c: F.concat(F.lit("f"), c.cast("string"), F.lit(".nix"))
    path = F.concat(F.lit("n"), (k % 5).cast("string"), F.lit("/m"), (k % 7).cast("string"), F.lit("/"), name(k))
    target = F.when(k % 4 == 0, F.concat(F.lit("../m"), (other % 7).cast("string"), F.lit("/"), name(other)))
    target = target.when(k % 4 == 1, F.concat(F.lit("./x/.././"), name(other))).when(k % 4 == 2, F.concat(F.lit("./"), name(k))).otherwise(F.concat(F.lit("../../../m1/"), name(k)))
    rows = table(spark, d, "part").select(k.alias("import_id"), path.alias("file"), target.alias("target"))
    return X.resolved_imports(rows, rows.select(F.col("file").alias("path")))


@query("e15_fact_faults", "SELECT p_partkey AS fact_id, CASE p_partkey%6 WHEN 1 THEN 'unknown file' WHEN 2 THEN 'outside of the file' WHEN 3 THEN 'other text' WHEN 4 THEN 'unfit ends' END AS fault FROM part WHERE p_partkey%6 IN (1,2,3,4)")
def e15(spark, d):
    k, n = F.col("p_partkey"), F.length("p_name")
    files = table(spark, d, "part").select(F.concat(F.lit("f"), k.cast("string")).alias("file"), F.concat(F.lit("fn "), "p_name", F.lit(" {}")).alias("text"))
    case = k % 6
    facts = table(spark, d, "part").select(
        k.alias("fact_id"),
        F.concat(F.when(case == 1, "no").otherwise("f"), k.cast("string")).alias("file"),
        F.lit(3).alias("byte_start"),
        F.when(case == 2, n + 99).otherwise(n + 3).alias("byte_end"),
        F.when(case == 3, F.upper("p_name")).otherwise(F.col("p_name")).alias("quoted"),
        F.lit("calls").alias("rel_type"),
        F.lit("definition").alias("from_kind"),
        F.when(case == 4, "heading").otherwise("definition").alias("to_kind"),
    )
    return Q.fact_faults(facts, files)


BUNDLE = "it AS (SELECT o_orderkey % 4000 AS id, CASE WHEN o_orderkey%50=0 THEN ' ' ELSE 'x' END AS body FROM orders), ev AS (SELECT l_orderkey*10+l_linenumber AS id, l_partkey*3 AS item FROM lineitem), ln AS (SELECT o_orderkey AS id, o_custkey AS a, o_custkey % 700 AS b FROM orders)"


@query("d13_bundle_faults", f"WITH {BUNDLE} SELECT 'item' AS kind, id::VARCHAR AS id, 'repeated' AS fault FROM it GROUP BY id HAVING count(*)>1 UNION ALL SELECT DISTINCT 'item', id::VARCHAR, 'blank' FROM it WHERE trim(body)='' UNION ALL SELECT 'evidence', id::VARCHAR, 'no item' FROM ev WHERE item NOT IN (SELECT id FROM it) UNION ALL SELECT 'link', id::VARCHAR, 'to itself' FROM ln WHERE a=b UNION ALL SELECT DISTINCT 'link', id::VARCHAR, 'no item' FROM ln WHERE a NOT IN (SELECT id FROM it) OR b NOT IN (SELECT id FROM it)")
def d13b(spark, d):
    o, lines = table(spark, d, "orders"), table(spark, d, "lineitem")
    items = o.select((F.col("o_orderkey") % 4000).alias("id"), F.when(F.col("o_orderkey") % 50 == 0, " ").otherwise("x").alias("body"))
    evidence = lines.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), (F.col("l_partkey") * 3).alias("item"))
    links = o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("from_item"), (F.col("o_custkey") % 700).alias("to_item"))
    return Q.bundle_faults(items, evidence, links)


@query("k16_contract", "SELECT table_name AS \"table\", column_name AS \"column\", CASE WHEN column_name='r_name' THEN 'changed' WHEN column_name='n_name' THEN 'extra' END AS state FROM information_schema.columns WHERE table_name IN ('region','nation') AND column_name IN ('r_name','n_name') UNION ALL SELECT 'nation','n_gone','missing'")
def k16(spark, d):
    found = [(t, f.name, f.dataType.simpleString()) for t in ("region", "nation") for f in table(spark, d, t).schema.fields]
    expected = [(t, c, "int" if c == "r_name" else k) for t, c, k in found if c != "n_name"] + [("nation", "n_gone", "int")]
    schema = "`table` string, `column` string, type string"
    return Q.contract(spark.createDataFrame(expected, schema), spark.createDataFrame(found, schema))


MANIFEST = "f AS (SELECT 'docs/'||doc_id||'.txt' AS path, sha256(text) AS s FROM documents), m AS (SELECT 'docs/'||doc_id||'.txt' AS path, CASE WHEN doc_id%11=0 THEN 'other' ELSE sha256(text) END AS s FROM documents WHERE doc_id%13<>0 UNION ALL SELECT 'docs/gone.txt','x')"


def manifest(spark, d):
    docs = table(spark, d, "documents")
    files = docs.select("doc_id", F.concat(F.lit("docs/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.sha2("text", 256).alias("sha256"))
    then = files.filter("doc_id % 13 <> 0").select("path", F.when(F.col("doc_id") % 11 == 0, "other").otherwise(F.col("sha256")).alias("sha256"))
    return files, then.unionAll(spark.createDataFrame([("docs/gone.txt", "x")], "path string, sha256 string"))


@query("x13_manifest_states", f"WITH {MANIFEST} SELECT path, CASE WHEN f.s IS NULL THEN 'missing' WHEN m.s IS NULL THEN 'new' WHEN f.s=m.s THEN 'same' ELSE 'changed' END AS state FROM m FULL JOIN f USING (path)")
def x13(spark, d):
    files, then = manifest(spark, d)
    return Q.manifest_states(then, files)


@query("x13_receipt_seal", f"WITH {MANIFEST} SELECT sha256(':indexer-1'||chr(0)||string_agg(path||':'||s||chr(0), '' ORDER BY path)) AS seal, count(*) AS n FROM m")
def x13s(spark, d):
    return Q.sealed(manifest(spark, d)[1], "indexer-1")


KEYS = {"region": ["r_regionkey"], "customer": ["c_custkey"], "orders": ["o_orderkey"], "lineitem": ["l_orderkey", "l_linenumber"], "conversations": ["conv_id", "turn"], "labels": ["doc_id"]}


@query("x15_adoption", " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n_rows, count(DISTINCT ({', '.join(k)})) AS n_keys, count(DISTINCT ({', '.join(k)}))=count(*) AS healthy FROM {t}" for t, k in KEYS.items()))
def x15(spark, d):
    return Q.adoption({t: (table(spark, d, t), k) for t, k in KEYS.items()})


#: Records of conversations: each line of an assistant's message is a part; every third a tool's, every fifth reasoning.
RECORDS = (
    "rec AS (SELECT conv_id||'/'||turn AS record_id, CASE WHEN role='system' AND conv_id%2=0 THEN 'shell' ELSE role END AS type, turn%5<>4 AS completed, list_transform(string_split(text, chr(10)), lambda x, i: "
    "{'kind': CASE WHEN i%5=0 THEN 'reasoning' WHEN i%3=0 THEN 'tool' ELSE 'text' END, 'text': x, 'call_id': 'c'||conv_id||'-'||(i//6), 'status': CASE WHEN (conv_id+i)%4=0 THEN 'running' ELSE 'done' END, 'outputs': string_split(x,' ')[1:2]}) AS parts FROM conversations)"
)


def records(spark, d):
    c = table(spark, d, "conversations")
    kind = F.when((F.col("role") == "system") & (F.col("conv_id") % 2 == 0), "shell").otherwise(F.col("role"))

    def part(x, i):
        n = i + 1
        return F.struct(
            F.when(n % 5 == 0, "reasoning").when(n % 3 == 0, "tool").otherwise("text").alias("kind"),
            x.alias("text"),
            F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-"), F.floor(n / 6).cast("string")).alias("call_id"),
            F.when((F.col("conv_id") + n) % 4 == 0, "running").otherwise("done").alias("status"),
            F.slice(F.split(x, " "), 1, 2).alias("outputs"),
        )

    return c.select(F.concat_ws("/", "conv_id", "turn").alias("record_id"), kind.alias("type"), (F.col("turn") % 5 != 4).alias("completed"), F.transform(F.split("text", "\n"), part).alias("parts"))


@query("e16_normalised_records", f"WITH {RECORDS}, k AS (SELECT record_id, type, list_filter(parts, lambda p: p.kind IN ('text','tool')) AS kept FROM rec WHERE type<>'system') SELECT record_id, type, len(kept)::INT AS n FROM k WHERE len(kept)>0")
def e16(spark, d):
    return N.normalised(records(spark, d)).select("record_id", "type", F.size("parts").alias("n"))


@query(
    "e17_record_pointers",
    f"WITH {RECORDS}, p AS (SELECT record_id, unnest(parts) AS p, unnest(range(len(parts))) AS i FROM rec WHERE type='assistant') SELECT record_id, CASE type WHEN 'user' THEN '/text' ELSE '/output/output' END AS pointer, parts[1].text AS text FROM rec WHERE type IN ('user','shell') "
    "UNION ALL SELECT record_id, '/content/'||i||'/text', p.text FROM p WHERE p.kind='text' UNION ALL SELECT record_id, '/content/'||i||'/state/content/'||j||'/text', t FROM (SELECT record_id, i, unnest(p.outputs) AS t, unnest(range(len(p.outputs))) AS j FROM p WHERE p.kind='tool')",
)
def e17r(spark, d):
    return N.text_pointers(records(spark, d))


@query("x24_settlement", f"WITH {RECORDS} SELECT record_id, CASE type WHEN 'assistant' THEN completed AND len(list_filter(parts, lambda p: p.status='running'))=0 WHEN 'shell' THEN completed ELSE true END AS settled FROM rec")
def x24s(spark, d):
    return records(spark, d).select("record_id", N.is_settled().alias("settled"))


@query("x24_repeated_calls", f"WITH {RECORDS}, p AS (SELECT unnest(parts) AS p FROM rec) SELECT p.call_id AS call_id, count(*) AS n FROM p WHERE p.kind='tool' GROUP BY 1 HAVING count(*)>1")
def x24c(spark, d):
    return N.repeated_calls(records(spark, d))


@query("x14_recovered_drafts", f"WITH {RECORDS} SELECT record_id, len(list_filter(parts, lambda p: p.kind='tool' AND p.status='running'))::INT AS n_interrupted, array_to_string(list_transform(parts, lambda p: CASE WHEN p.kind='tool' AND p.status='running' THEN 'interrupted' ELSE p.status END), ' ') AS states FROM rec")
def x14r(spark, d):
    return N.recovered(records(spark, d)).select("record_id", "n_interrupted", F.array_join(F.transform("parts", lambda p: p["status"]), " ").alias("states"))


@query("s14_research_corpus", "WITH u AS (SELECT conv_id, count(*) AS n, arg_min(text, turn) AS f FROM conversations WHERE role='user' GROUP BY 1 HAVING count(*)>=2) SELECT c.conv_id AS session, turn AS ordinal, role, md5(text) AS text, md5(f) AS lineage FROM conversations c JOIN u USING (conv_id)")
def s14(spark, d):
    c = table(spark, d, "conversations").withColumnRenamed("conv_id", "session")
    return N.research_corpus(c, 2).withColumn("text", F.md5("text"))


@query("a27_model_usage", "SELECT role AS model, count(*) AS calls, sum(length(text))::BIGINT AS tokens_input, sum(length(text)//4)::BIGINT AS tokens_output, round(sum(length(text))*0.5::DOUBLE/1000000, 9) AS cost FROM conversations GROUP BY 1")
def a27(spark, d):
    n = F.length("text")
    rows = table(spark, d, "conversations").select(F.col("role").alias("model"), n.alias("tokens_input"), F.floor(n / 4).alias("tokens_output"))
    sums = rows.groupBy("model").agg(count().alias("calls"), F.sum("tokens_input").alias("tokens_input"), F.sum("tokens_output").alias("tokens_output"))
    return sums.withColumn("cost", F.round(F.col("tokens_input") * F.lit(0.5) / F.lit(1000000), 9))


USAGE = "u AS (SELECT event_type AS tool, user_id AS ledger, event_id, strlen(props)::BIGINT+20 AS bytes, range((json_extract_string(props,'$.k'))::BIGINT) AS hits, range(event_id % 3) AS files FROM events)"


def usage(spark, d):
    k = F.get_json_object("props", "$.k").cast("int")
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    e = table(spark, d, "events")
    return e.select(F.col("event_type").alias("tool"), F.col("user_id").alias("ledger"), "event_id", (F.octet_length("props") + 20).cast("long").alias("bytes"), upto(k).alias("hits"), upto((F.col("event_id") % 3).cast("int")).alias("files"))


@query("a24_usage_counts", f"WITH {USAGE} SELECT tool, count(*) AS n, sum(len(hits))::BIGINT AS hits, sum(len(files))::BIGINT AS files FROM u GROUP BY 1")
def a24(spark, d):
    return W.usage_counts(usage(spark, d))


@query("k15_ledger_rotation", f"WITH RECURSIVE {USAGE}, o AS (SELECT ledger, event_id, bytes, row_number() OVER (PARTITION BY ledger ORDER BY event_id) AS i FROM u), f(ledger, event_id, i, used, file) AS (SELECT ledger, event_id, i, bytes, 0 FROM o WHERE i=1 UNION ALL SELECT o.ledger, o.event_id, o.i, CASE WHEN f.used>=120 THEN o.bytes ELSE f.used+o.bytes END, f.file + CASE WHEN f.used>=120 THEN 1 ELSE 0 END FROM f JOIN o ON o.ledger=f.ledger AND o.i=f.i+1) SELECT ledger, event_id, file::INT AS chunk FROM f")
def k15(spark, d):
    return K.rotation(usage(spark, d), "ledger", "event_id", "bytes", 120)


@query("a12_outcomes", "SELECT CASE WHEN o_orderstatus='P' THEN 'failed' WHEN o_custkey%3=0 THEN 'reused' ELSE 'decided' END AS outcome, count(*) AS n FROM orders GROUP BY 1")
def a12(spark, d):
    outcome = F.when(F.col("o_orderstatus") == "P", "failed").when(F.col("o_custkey") % 3 == 0, "reused").otherwise("decided")
    return table(spark, d, "orders").groupBy(outcome.alias("outcome")).agg(count().alias("n"))


@query("a28_table_existence", "SELECT 16::BIGINT AS wanted, count(DISTINCT table_name) AS found FROM information_schema.tables WHERE table_name IN (" + ",".join(f"'{t}'" for t in TABLES) + ")")
def a28(spark, d):
    """The tables that lie in the folder, among all that are wanted and two that aren't there."""
    listed = S.listing(spark, d).select(F.regexp_extract("uri", r"([^/]+)\.parquet", 1).alias("name"))
    return W.missing_tables([*TABLES, "no_such", "none"], listed)


@query("x2_file_version", "SELECT sha256(text) AS sha256, strlen(text)::BIGINT AS bytes FROM documents WHERE doc_id=7")
def x2(spark, d):
    docs = table(spark, d, "documents")
    versions = docs.select(F.lit("snap-1").alias("snapshot"), F.concat(F.lit("docs/"), "doc_id", F.lit(".txt")).alias("path"), F.sha2("text", 256).alias("sha256"), F.octet_length("text").cast("long").alias("bytes"))
    return W.file_version(versions, "snap-1", "docs/7.txt")


@query(
    "x20_served_sources",
    "WITH t AS (SELECT doc_id, 'docs/'||doc_id AS path, (doc_id % 3 + 1)::INT AS s, string_split(text, chr(10)) AS l FROM documents) SELECT path, s AS start, s+1 AS \"end\", CASE WHEN doc_id%7=0 THEN 'unknown' WHEN doc_id%5=0 THEN 'stale' ELSE 'fresh' END AS state, "
    "md5(CASE WHEN doc_id%7=0 OR doc_id%5=0 OR s>len(l) THEN NULL WHEN s=len(l) THEN s||chr(9)||l[s] ELSE s||chr(9)||l[s]||chr(10)||(s+1)||chr(9)||l[s+1] END) AS shown FROM t",
)
def x20(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.concat(F.lit("docs/"), "doc_id").alias("path"), "text")
    then = F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    versions = docs.filter("doc_id % 7 <> 0").select(F.lit("snap-1").alias("snapshot"), "path", F.sha2(then, 256).alias("sha256"))
    start = (F.col("doc_id") % 3 + 1).cast("int")
    targets = docs.select(F.lit("snap-1").alias("snapshot"), "path", start.alias("start"), (start + 1).alias("end"))
    return W.served(targets.unionAll(targets), docs, versions).select("path", "start", "end", "state", F.md5("shown").alias("shown"))


@query("x3_stored_packet", "SELECT 'build-'||n_nationkey AS build_id, '{\"nodes\":'||n_regionkey||'}' AS body FROM nation WHERE n_nationkey=9")
def x3(spark, d):
    body = F.concat(F.lit('{"nodes":'), F.col("n_regionkey").cast("string"), F.lit("}"))
    return W.stored_packet(table(spark, d, "nation").select(F.concat(F.lit("build-"), F.col("n_nationkey").cast("string")).alias("build_id"), body.alias("body")), "build-9")


@query("x4_current_knowledge", "WITH v AS (SELECT conv_id AS scope, turn+1 AS generation, md5(text) AS body FROM conversations), p AS (SELECT scope, max(generation) AS g FROM v WHERE scope%4<>0 GROUP BY 1) SELECT v.scope, v.generation, body FROM v JOIN p ON p.scope=v.scope AND p.g=v.generation")
def x4(spark, d):
    v = table(spark, d, "conversations").select(F.col("conv_id").alias("scope"), (F.col("turn") + 1).alias("generation"), F.md5("text").alias("body"))
    return W.current(v, v.filter("scope % 4 <> 0").groupBy("scope").agg(F.max("generation").alias("generation")))


@query("k14_next_generation", "SELECT count(*) AS versions, sum(generation)::BIGINT AS pointers FROM (SELECT n_nationkey, CASE WHEN n_nationkey=3 THEN 2 ELSE 1 END AS generation FROM nation UNION ALL SELECT 3, NULL)")
def k14(spark, d):
    v = table(spark, d, "nation").select(F.col("n_nationkey").alias("scope"), F.lit(1).alias("generation"), F.col("n_name").alias("body"))
    versions, pointer = W.publish(v, v.select("scope", "generation"), 3, "second", 1)
    return versions.agg(count().alias("versions")).crossJoin(F.broadcast(pointer.agg(F.sum("generation").alias("pointers"))))


@query("x11_operator_states", "SELECT user_id AS item, CASE WHEN bool_or(event_type='purchase') THEN 'resolved' ELSE 'open' END AS state, arg_max(props, event_id) FILTER (WHERE event_type='click') AS note FROM events GROUP BY 1")
def x11(spark, d):
    action = F.when(F.col("event_type") == "purchase", "resolve").when(F.col("event_type") == "click", "annotate").otherwise("seen")
    return W.operator_states(table(spark, d, "events").select(F.col("user_id").alias("item"), F.col("event_id").alias("seq"), action.alias("action"), F.col("props").alias("note")))


@query("x10_evidence_by_hash", "SELECT doc_id, sha256(text) AS hash FROM documents WHERE sha256(text) IN (SELECT sha256(text) FROM documents WHERE doc_id % 50 = 0)")
def x10(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("hash"))
    return docs.join(docs.filter("doc_id % 50 = 0").select("hash"), "hash", "left_semi").select("doc_id", "hash")


@query("j2_vectors_in_build", f"WITH b AS (SELECT * FROM embeddings WHERE vec_id=0) SELECT 'e'||a.vec_id AS entity_id, round({COSINE},6) AS cosine FROM embeddings a, b WHERE a.vec_id%2=0 AND a.label<>4 ORDER BY cosine DESC, entity_id LIMIT 15")
def j2(spark, d):
    e = table(spark, d, "embeddings")
    name = F.concat(F.lit("e"), F.col("vec_id").cast("string"))
    members = e.filter("vec_id % 2 = 0").select(name.alias("entity_id"))
    entities = e.select(name.alias("entity_id"), F.col("vec_id").alias("text_sha256"))
    vectors = e.select(F.when(F.col("label") == 4, "other").otherwise("m").alias("model"), F.col("vec_id").alias("text_sha256"), F.col("embedding").alias("vec"))
    return V.nearest_in_build(members, entities, vectors, "m", list(e.filter("vec_id = 0").first().embedding), 15)


PATHS = "p AS (SELECT p_partkey AS k, CASE p_partkey%5 WHEN 0 THEN 'docs/adr/000'||p_partkey||'-name.md' WHEN 1 THEN 'rfcs/RFC-'||p_partkey||'.md' WHEN 2 THEN 'src/adr/none.rs' WHEN 3 THEN '.hidden' ELSE 'notes/7.tar.gz' END AS path FROM part)"


@query("fn_path_parts", f"WITH {PATHS} SELECT k, CASE k%5 WHEN 0 THEN '000'||k||'-name' WHEN 1 THEN 'RFC-'||k WHEN 2 THEN 'none' WHEN 3 THEN '.hidden' ELSE '7.tar' END AS module, CASE k%5 WHEN 0 THEN 'ADR-'||k WHEN 1 THEN 'RFC-'||k END AS number FROM p")
def fn_paths(spark, d):
    k = F.col("p_partkey").cast("string")
    names = F.array(F.concat(F.lit("docs/adr/000"), k, F.lit("-name.md")), F.concat(F.lit("rfcs/RFC-"), k, F.lit(".md")), F.lit("src/adr/none.rs"), F.lit(".hidden"), F.lit("notes/7.tar.gz"))
    path = F.element_at(names, (F.col("p_partkey") % 5 + 1).cast("int"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("k"), module_name(path).alias("module"), doc_number(path).alias("number"))


@query("fn_rfc3339", "SELECT event_id, strftime(epoch_ms((event_id*86399999 - 50000000000)::BIGINT), '%Y-%m-%dT%H:%M:%S.')||lpad(((((event_id*86399999 - 50000000000) % 1000)+1000) % 1000)::VARCHAR, 3, '0')||'Z' AS shown FROM events")
def fn_rfc3339(spark, d):
    return table(spark, d, "events").select("event_id", rfc3339(F.col("event_id") * 86399999 - 50000000000).alias("shown"))


@query("fn_token_estimate", "SELECT doc_id, ceil(length(text)/4)::BIGINT AS tokens FROM documents")
def fn_tokens(spark, d):
    return table(spark, d, "documents").select("doc_id", token_estimate(F.col("text")).alias("tokens"))


@query(
    "fn_canonical_json",
    """SELECT doc_id, '{"chars":'||n_chars||',"lang":'||to_json(lang)||',"meta":{"a":['||to_json(source)||','||to_json(lang)||'],"z":null}}' AS canonical FROM documents""",
)
def fn_json(spark, d):
    from ..functions.canonical import canonical_json

    docs = table(spark, d, "documents")
    meta = F.struct(F.lit(None).cast("int").alias("z"), F.array("source", "lang").alias("a"))
    rows = docs.select("doc_id", F.struct(meta.alias("meta"), "lang", F.col("n_chars").alias("chars")).alias("value"))
    return rows.select("doc_id", canonical_json(rows, "value").alias("canonical"))


@query("fn_base62", "WITH p AS (SELECT o_orderkey, o_orderkey::HUGEINT*123456789 AS n FROM orders) SELECT o_orderkey, " + "||".join(f"substr('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz', ((n//{62**k}) % 62)::INT+1, 1)" for k in range(9, -1, -1)) + " AS code FROM p")
def fn_base62(spark, d):
    from ..functions.canonical import base62

    return table(spark, d, "orders").select("o_orderkey", base62(F.col("o_orderkey").cast("decimal(38,0)") * 123456789, 10).alias("code"))
