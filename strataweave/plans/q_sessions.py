"""Queries over conversations: candidates, decisions, digests, campaign checks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import campaign as C
from ..operators import knowledge as K
from ..operators import retrieval as V
from ..session import table
from .registry import query

LINES = "ln AS (SELECT conv_id, turn, role, (i-1)::INT AS line_no, line FROM (SELECT conv_id, turn, role, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)),1) AS i FROM conversations) WHERE strlen(line) BETWEEN 24 AND 1200)"


def conv(spark, d):
    return table(spark, d, "conversations")


@query("p10_eligible_lines", f"WITH {LINES} SELECT role, count(*) AS n FROM ln GROUP BY 1")
def p10(spark, d):
    return K.eligible_lines(conv(spark, d)).groupBy("role").agg(F.count(F.lit(1)).alias("n"))


@query("d9_candidate_page", f"WITH {LINES}, n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, line_no)-1 AS n, count(*) OVER (PARTITION BY conv_id) AS total FROM ln) SELECT conv_id, turn, line_no, n::INT AS n, total, total > 6 AS has_more FROM n WHERE n>=2 AND n<6")
def d9(spark, d):
    return K.candidate_page(K.eligible_lines(conv(spark, d)), 2, 4).select("conv_id", "turn", "line_no", "n", "total", "has_more")


@query("w4_context_lines", f"WITH {LINES} SELECT conv_id, turn, line_no, md5(string_agg(line, chr(10)) OVER (PARTITION BY conv_id ORDER BY turn, line_no ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)) AS context FROM ln")
def w4(spark, d):
    return K.context_lines(K.eligible_lines(conv(spark, d))).select("conv_id", "turn", "line_no", F.md5("context").alias("context"))


@query("w5_latest_user_message", "SELECT conv_id, max(turn) AS turn, arg_max(md5(text), turn) AS text FROM conversations WHERE role='user' GROUP BY 1")
def w5(spark, d):
    return conv(spark, d).filter("role = 'user'").groupBy("conv_id").agg(F.max("turn").alias("turn"), F.max_by(F.md5("text"), "turn").alias("text"))


@query("j25_first_user_text", "SELECT conv_id, turn, md5(text) AS text FROM conversations WHERE role='user' QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn)=1")
def j25(spark, d):
    return K.first_write_wins(conv(spark, d).filter("role = 'user'"), "conv_id", "turn").select("conv_id", "turn", F.md5("text").alias("text"))


ANSWERS = "a AS (SELECT conv_id, turn, ((conv_id*7+turn*3) % 101)/100.0::DOUBLE AS admit, ((conv_id*5+turn) % 101)/100.0::DOUBLE AS nov, ((conv_id*3+turn*11) % 101)/100.0::DOUBLE AS dup, ((conv_id+turn*13) % 101)/100.0::DOUBLE AS con, ((conv_id*11+turn*17) % 101)/100.0::DOUBLE AS sup FROM conversations)"


def answers(spark, d):
    part = lambda e: (F.expr(f"({e}) % 101") / F.lit(100.0)).cast("double")
    return conv(spark, d).select(
        "conv_id", "turn", part("conv_id*7+turn*3").alias("admit"), part("conv_id*5+turn").alias("nov"), part("conv_id*3+turn*11").alias("dup"), part("conv_id+turn*13").alias("con"), part("conv_id*11+turn*17").alias("sup")
    )


@query(
    "d10_dispositions",
    f"WITH {ANSWERS} SELECT CASE WHEN admit<=0.1 THEN 'rejected' WHEN admit<0.9 THEN 'abstained' WHEN sup>=0.95 THEN 'supersession' WHEN con>=0.95 THEN 'contradiction' WHEN dup>=0.95 THEN 'duplicate' WHEN dup<=0.1 AND con<=0.1 AND nov>=0.9 THEN 'admitted' ELSE 'abstained' END AS outcome, count(*) AS n FROM a GROUP BY 1",
)
def d10(spark, d):
    outcome = K.disposition(*(F.col(c) for c in ("admit", "nov", "dup", "con", "sup")))
    return answers(spark, d).groupBy(outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


@query("d5_materialized", f"WITH {ANSWERS} SELECT CASE WHEN admit>=0.9 THEN CASE WHEN turn=0 THEN 'extracted' ELSE 'inferred' END WHEN admit<=0.1 THEN 'rejected' ELSE 'abstain' END AS class, count(*) AS n FROM a GROUP BY 1")
def d5(spark, d):
    return answers(spark, d).groupBy(K.materialized(F.col("admit"), F.col("turn") == 0).alias("class")).agg(F.count(F.lit(1)).alias("n"))


@query("x30_choice_floor", f"WITH {ANSWERS} SELECT CASE WHEN nov>=0.8 THEN (conv_id%3)::VARCHAR ELSE 'unknown' END AS choice, count(*) AS n FROM a GROUP BY 1")
def x30(spark, d):
    return answers(spark, d).groupBy(K.choice_floor((F.col("conv_id") % 3).cast("string"), F.col("nov")).alias("choice")).agg(F.count(F.lit(1)).alias("n"))


@query("d12_latest_status", "WITH r AS (SELECT conv_id AS item, turn AS seq, CASE (conv_id*3+turn) % 7 WHEN 0 THEN 'superseded' WHEN 1 THEN 'withheld' ELSE 'admitted' END AS status FROM conversations) SELECT item, CASE WHEN bool_or(status='superseded') THEN 'superseded' ELSE arg_max(status, seq) END AS status FROM r GROUP BY 1")
def d12(spark, d):
    s = F.expr("CASE (conv_id*3+turn) % 7 WHEN 0 THEN 'superseded' WHEN 1 THEN 'withheld' ELSE 'admitted' END")
    return K.latest_status(conv(spark, d).select(F.col("conv_id").alias("item"), F.col("turn").alias("seq"), s.alias("status")))


@query("d15_unanimous_pairs", "WITH r AS (SELECT conv_id % 40 AS a, turn % 3 AS b, CASE WHEN conv_id % 5=0 THEN 'merge' ELSE 'keep' END AS action FROM conversations) SELECT a, b, CASE WHEN count(DISTINCT action)=1 THEN min(action) ELSE 'abstain' END AS action FROM r GROUP BY 1,2")
def d15(spark, d):
    r = conv(spark, d).selectExpr("conv_id % 40 AS a", "turn % 3 AS b", "CASE WHEN conv_id % 5 = 0 THEN 'merge' ELSE 'keep' END AS action")
    return K.unanimous(r)


@query("d16_continuation", f"WITH {ANSWERS} SELECT conv_id, count(*) AS kept FROM conversations c JOIN a USING (conv_id, turn) WHERE NOT (role='assistant' AND admit>=0.95 AND NOT contains(text,'th')) GROUP BY 1")
def d16(spark, d):
    m = conv(spark, d).join(answers(spark, d).select("conv_id", "turn", F.col("admit").alias("irrelevant")), ["conv_id", "turn"])
    return K.kept_for_continuation(m.withColumn("has_tool", F.col("text").contains("th"))).groupBy("conv_id").agg(F.count(F.lit(1)).alias("kept"))


@query("w7_greedy_chunks", "WITH RECURSIVE o AS (SELECT conv_id, turn, length(text) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations), f(conv_id, turn, i, used, chunk) AS (SELECT conv_id, turn, i, n, 0 FROM o WHERE i=1 UNION ALL SELECT o.conv_id, o.turn, o.i, CASE WHEN f.used>0 AND f.used+o.n>1500 THEN o.n ELSE f.used+o.n END, f.chunk + CASE WHEN f.used>0 AND f.used+o.n>1500 THEN 1 ELSE 0 END FROM f JOIN o ON o.conv_id=f.conv_id AND o.i=f.i+1) SELECT conv_id, turn, chunk::INT AS chunk FROM f")
def w7(spark, d):
    return K.greedy_chunks(conv(spark, d).withColumn("n", F.length("text")), "conv_id", "turn", "n", 1500)


@query(
    "w8_interval_merge",
    "WITH s AS (SELECT l_suppkey AS g, l_shipdate AS a, l_shipdate + INTERVAL 3 DAY AS z FROM lineitem), m AS (SELECT *, CASE WHEN a <= max(z) OVER (PARTITION BY g ORDER BY a, z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM s), i AS (SELECT *, sum(new) OVER (PARTITION BY g ORDER BY a, z) AS k FROM m), r AS (SELECT g, k, min(a) a, max(z) z FROM i GROUP BY 1,2) SELECT g, count(*) AS islands, sum(date_diff('day', a, z))::BIGINT AS days FROM r GROUP BY 1",
)
def w8(spark, d):
    s = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("g"), F.col("l_shipdate").alias("a"), (F.col("l_shipdate") + F.expr("INTERVAL 3 DAYS")).alias("z"))
    return K.merged_intervals(s, "g", "a", "z").groupBy("g").agg(F.count(F.lit(1)).alias("islands"), F.sum(F.datediff("z", "a")).alias("days"))


@query("w9_evenly_spaced", "WITH n AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey)-1 AS i, count(*) OVER (PARTITION BY o_custkey) AS m FROM orders) SELECT o_custkey, o_orderkey FROM n WHERE m<=3 OR i IN (0, round_even((m-1)/2, 0), m-1)")
def w9(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey")
    return K.evenly_spaced(o, "o_custkey", "o_orderkey", 3)


@query("w10_round_robin", "SELECT lang, doc_id, turn::INT AS turn FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS turn FROM documents) ORDER BY turn, lang LIMIT 30")
def w10(spark, d):
    return K.round_robin(table(spark, d, "documents").select("lang", "doc_id"), "lang", "doc_id", 30)


FRAG = "turn||chr(9)||role||chr(9)||text||chr(0)"


@query("a20_session_digest", f"SELECT conv_id, sha256(string_agg({FRAG}, '' ORDER BY turn)) AS digest FROM conversations GROUP BY 1")
def a20(spark, d):
    return C.session_digest(conv(spark, d), "conv_id", ["turn"], F.concat_ws("\t", "turn", "role", "text"))


CAMPAIGN = f"e AS (SELECT conv_id, sha256(string_agg({FRAG}, '' ORDER BY turn)) AS dg FROM conversations WHERE conv_id % 10 <> 0 GROUP BY 1), f AS (SELECT conv_id, sha256(string_agg(CASE WHEN conv_id % 9=0 THEN upper({FRAG}) ELSE {FRAG} END, '' ORDER BY turn)) AS dg FROM conversations WHERE conv_id % 8 <> 0 GROUP BY 1)"
STATES = f"WITH {CAMPAIGN}, st AS (SELECT conv_id, CASE WHEN f.dg IS NULL THEN 'missing' WHEN e.dg IS NULL THEN 'unexpected' WHEN e.dg=f.dg THEN 'matched' ELSE 'mismatched' END AS state FROM e FULL JOIN f USING (conv_id))"


def campaign_states(spark, d):
    c = conv(spark, d)
    line = F.concat_ws("\t", "turn", "role", "text")
    e = C.session_digest(c.filter("conv_id % 10 <> 0"), "conv_id", ["turn"], line)
    f = C.session_digest(c.filter("conv_id % 8 <> 0"), "conv_id", ["turn"], F.when(F.col("conv_id") % 9 == 0, F.upper(line)).otherwise(line))
    return C.reconcile(e, f, "conv_id")


@query("j21_reconciliation", STATES + " SELECT * FROM st")
def j21(spark, d):
    return campaign_states(spark, d)


@query("d18_campaign_report", STATES + ", c AS (SELECT count(*) FILTER (WHERE state='matched') AS matched, count(*) FILTER (WHERE state='mismatched') AS mismatched, count(*) FILTER (WHERE state='missing') AS missing, count(*) FILTER (WHERE state='unexpected') AS unexpected FROM st) SELECT *, mismatched=0 AND unexpected=0 AS clean, missing=0 AS complete FROM c")
def d18(spark, d):
    return C.report(campaign_states(spark, d))


@query("j22_positional_zip", "WITH a AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS o, md5(text) AS s FROM conversations), b AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS o, md5(text) AS s FROM conversations WHERE NOT (conv_id % 20=0 AND turn=1)) SELECT conv_id, o::INT AS ordinal, a.s AS source, b.s AS copy FROM a FULL JOIN b USING (conv_id, o) WHERE a.s IS DISTINCT FROM b.s")
def j22(spark, d):
    c = conv(spark, d).withColumn("h", F.md5("text"))
    return C.zipped(c, c.filter("NOT (conv_id % 20 = 0 AND turn = 1)"), "conv_id", "turn", "h")


@query("a18_role_metrics", "SELECT role, count(*) AS n, sum(length(text))::BIGINT AS chars, count(DISTINCT conv_id) AS sessions FROM conversations GROUP BY 1")
def a18(spark, d):
    return conv(spark, d).groupBy("role").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"), F.countDistinct("conv_id").alias("sessions"))


@query("a19_role_sets", "SELECT conv_id, list_sort(list(DISTINCT role)) AS roles FROM conversations GROUP BY 1")
def a19(spark, d):
    return conv(spark, d).groupBy("conv_id").agg(F.array_sort(F.collect_set("role")).alias("roles"))


@query("x17_quote_check", "SELECT item_id, count(doc_id) AS sources FROM benchmark b LEFT JOIN documents d ON contains(d.text, b.text) GROUP BY 1")
def x17(spark, d):
    q = table(spark, d, "benchmark").select("item_id", F.col("text").alias("q"))
    docs = table(spark, d, "documents").select("doc_id", "text")
    hits = V.holding(docs, "text", q, "q").groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))
    return q.join(hits, "item_id", "left").select("item_id", F.coalesce("n", F.lit(0)).alias("sources"))


@query("x24_settled_records", "SELECT CASE WHEN role='assistant' AND NOT contains(text,'.') THEN false ELSE true END AS settled, count(*) AS n FROM conversations GROUP BY 1")
def x24(spark, d):
    parts = F.transform(F.split("text", r"\n"), lambda t: F.struct(t.alias("text"), F.when(t.contains("."), "done").otherwise("running").alias("status")))
    c = conv(spark, d).withColumn("parts", parts)
    done = (F.col("role") != "assistant") | F.exists("parts", lambda p: p["status"] == "done")
    return c.groupBy(done.alias("settled")).agg(F.count(F.lit(1)).alias("n"))


@query("j27_tool_sources", "SELECT a.conv_id, a.turn, b.turn AS source_turn FROM conversations a LEFT JOIN conversations b ON a.conv_id=b.conv_id AND a.turn=b.turn+1 AND b.role='user' WHERE a.role='assistant'")
def j27(spark, d):
    a = conv(spark, d).filter("role = 'assistant'").select("conv_id", "turn")
    b = conv(spark, d).filter("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("turn").alias("source_turn"))
    return a.join(b, ["conv_id", "turn"], "left")


@query("fn_js_numbers", "SELECT event_id, regexp_replace(value::VARCHAR, '\\.0$', '') AS shown FROM events")
def a28(spark, d):
    return table(spark, d, "events").select("event_id", C.js_number_col(F.col("value")).alias("shown"))


@query("w3_lead_lag", "SELECT conv_id, turn, lag(role) OVER w AS before, lead(role) OVER w AS after FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def w3(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn")
    return conv(spark, d).select("conv_id", "turn", F.lag("role").over(w).alias("before"), F.lead("role").over(w).alias("after"))
