"""Queries of compaction plans, cycles of duplicates and range digests."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.ids import range_digest
from ..operators import compaction as C
from ..operators import research as C2
from ..operators.traverse import cycle_members
from ..session import settle, table
from ..sources import tpch_graph as G
from .registry import GRAPH, query

INLINE, BUDGET = 300, 4000


def records(spark, d):
    return table(spark, d, "conversations").select(F.col("conv_id").alias("session"), "turn", "role", "text")


def plan(spark, d):
    """Assistant records of every third turn may be omitted."""
    rows = records(spark, d)
    return C.planned(rows, rows.filter("turn % 3 = 1").select("session", "turn"), INLINE, BUDGET)


ROWS = f"""r AS (SELECT conv_id AS session, turn, min(row(coalesce(role,''), coalesce(text,''))) AS r FROM conversations GROUP BY 1,2), s AS (SELECT session, turn, r[1] AS role, r[2] AS text FROM r),
f AS (SELECT *, sha256(text) AS source, CASE WHEN turn%3=1 AND role NOT IN ('user','system','tool') THEN 'omitted' WHEN length(text)>{INLINE} THEN 'external' ELSE 'inline' END AS fate, strlen(text) AS n FROM s),
u AS (SELECT session, sum(CASE fate WHEN 'omitted' THEN 0 WHEN 'external' THEN length('## '||role||' ['||turn||'; '||source||']')+1+length('body '||source||', '||n||' bytes')+1 ELSE length('## '||role||' ['||turn||'; '||source||']')+1+length(text)+1 END)::BIGINT AS used FROM f GROUP BY 1)"""


@query(
    "d17_compaction",
    f"""WITH {ROWS}, d AS (SELECT session, sha256(string_agg(sha256(turn||chr(0)||role||chr(0)||source||chr(0)||fate||chr(0)||(CASE WHEN fate='inline' THEN text ELSE '' END)||chr(0)||n||chr(0))||chr(0), '' ORDER BY turn)) AS d,
    count(*) FILTER (WHERE fate='external') AS external, count(*) FILTER (WHERE fate='omitted') AS omitted FROM f GROUP BY 1) SELECT session, 'plan:'||d AS plan_id, used, used>{BUDGET} AS refused, CASE WHEN used<={BUDGET} THEN external ELSE 0 END AS external, CASE WHEN used<={BUDGET} THEN omitted ELSE 0 END AS omitted FROM d JOIN u USING (session)""",
)
def d17(spark, d):
    """Plans of all sessions with their ids, what they take, and what moved out."""
    made = plan(spark, d)
    fates = made.manifest.groupBy("session").agg(F.count(F.when(F.col("fate") == "external", 1)).alias("external"), F.count(F.when(F.col("fate") == "omitted", 1)).alias("omitted"))
    return made.plans.join(fates, "session", "left").select("session", "plan_id", "used", "refused", F.coalesce("external", F.lit(0)).alias("external"), F.coalesce("omitted", F.lit(0)).alias("omitted"))


@query(
    "x8_plan_faults",
    f"""WITH {ROWS}, k AS (SELECT f.* FROM f JOIN u USING (session) WHERE used<={BUDGET} AND fate<>'inline') SELECT session, turn, CASE WHEN source<'4' THEN 'body missing' ELSE 'body changed' END AS fault FROM k WHERE source<'8'""",
)
def x8f(spark, d):
    """A quarter of the stored bodies is lost and a quarter changed; the faults name each record that they are of, and nothing else differs."""
    made = plan(spark, d)
    store = made.store.filter("hash >= '4'").withColumn("body", F.when(F.col("hash") < "8", F.concat("body", F.lit("!"))).otherwise(F.col("body")))
    broken = C.Plan(made.manifest, store, made.plans)
    sound = C.differences(made, records(spark, d)).select("session", "turn", F.lit("a sound plan differs").alias("fault"))
    return C.faults(broken).unionByName(sound)


@query(
    "x8_tool_repair",
    """WITH t AS (SELECT conv_id, turn, text FROM conversations WHERE text IS NOT NULL), x AS (SELECT conv_id, turn, min(text) AS text FROM t GROUP BY 1,2)
    SELECT conv_id||'' AS session, turn||'' AS call_id, CASE WHEN length(text)>60 AND conv_id%4<>0 OR length(text)<=60 THEN sha256(text) ELSE sha256(substr(text,1,60)) END AS hash, length(text)>60 AND conv_id%4<>0 AS repaired FROM x""",
)
def x8r(spark, d):
    """Tool bodies that were cut at 60 characters get their whole texts back where these are still known."""
    t = table(spark, d, "conversations").filter("text IS NOT NULL").groupBy("conv_id", "turn").agg(F.min("text").alias("text"))
    session, call = F.col("conv_id").cast("string").alias("session"), F.col("turn").cast("string").alias("call_id")
    key = [F.lit("native").alias("source"), session, F.lit("repo").alias("repo"), F.lit("m").alias("message"), call]
    bounded = F.substring("text", 1, 60)
    sources = t.select(*key, F.sha2(bounded, 256).alias("hash"))
    store = t.groupBy(F.sha2(bounded, 256).alias("hash")).agg(F.min(bounded).alias("body"), F.max(F.length("text") <= 60).alias("complete"))
    after, _, changed = C.repaired(sources, store, t.filter("conv_id % 4 <> 0").select(*key, F.col("text").alias("body")))
    return after.join(changed.withColumn("repaired", F.lit(True)), C.TOOL_KEY, "left").select("session", "call_id", "hash", F.coalesce("repaired", F.lit(False)).alias("repaired"))


@query(
    "g26_order_cycles",
    "WITH o AS (SELECT o_orderkey AS id, o_custkey%3 AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders) SELECT id FROM o WHERE k=0 OR k=1 AND n>=2 AND i>=2",
)
def g26(spark, d):
    """Orders linked to the customer's next; a third of the customers' last orders lead back to the first, a third to the second."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    whole = Window.partitionBy("o_custkey").orderBy("o_orderkey").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    o = table(spark, d, "orders").select("o_custkey", F.col("o_orderkey").alias("id"), F.lead("o_orderkey").over(w).alias("next"), F.first("o_orderkey").over(whole).alias("first"), F.nth_value("o_orderkey", 2).over(whole).alias("second"))
    back = F.when(F.col("o_custkey") % 3 == 0, F.col("first")).when(F.col("o_custkey") % 3 == 1, F.col("second"))
    return cycle_members(o.select("id", F.coalesce("next", back).alias("to")))


def _tree(rows: str, key: str, fragment: str) -> str:
    return (
        f"leaf AS (SELECT substr(sha256({key}),1,4) AS r, sha256('range-1'||chr(0)||string_agg({fragment}||chr(0), '' ORDER BY {key}, {fragment})) AS d FROM {rows} GROUP BY 1), "
        "mid AS (SELECT substr(r,1,2) AS r, sha256('range-1'||chr(0)||string_agg(r||chr(0)||d||chr(0), '' ORDER BY r)) AS d FROM leaf GROUP BY 1) "
        f"SELECT sha256('range-1'||chr(0)||string_agg(r||chr(0)||d||chr(0), '' ORDER BY r)) AS digest, (SELECT count(*) FROM {rows}) AS n FROM mid"
    )


@query("k13_range_digest", f"WITH {GRAPH}, " + _tree("edges", "rel_id", "rel_type||'|'||from_id||'|'||to_id||'|'||class"))
def k13(spark, d):
    """A publication's digest over ranges of its edges, which no single task has to pass through."""
    e = G.edges(spark, d)
    return range_digest(e, "rel_id", F.concat_ws("|", "rel_type", "from_id", "to_id", "class"))


@query("a22_range_digest", "WITH p AS (SELECT p_partkey::VARCHAR AS k, p_partkey||':'||p_name AS f FROM part), " + _tree("p", "k", "f"))
def a22(spark, d):
    rows = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("k"), F.concat_ws(":", "p_partkey", "p_name").alias("f"))
    return range_digest(rows, "k", F.col("f"))


@query(
    "d20_research_ledger",
    """WITH f AS (SELECT conv_id, turn, sha256('{"citations":[{"quote":'||to_json(substr(text,1,20))||',"ref":"m'||conv_id||'-'||turn||'"}],"claim":"claim '||turn||'","kind":"'||(['feature','unfinished','friction','praise'])[turn%4+1]||'","session":"c'||conv_id||'"}') AS id, turn%4 AS k FROM (SELECT DISTINCT conv_id, turn, min(text) AS text FROM conversations WHERE text IS NOT NULL GROUP BY 1,2)),
    g AS (SELECT * FROM f WHERE k<3), n AS (SELECT *, lead(id) OVER (PARTITION BY conv_id ORDER BY turn) AS next, first_value(id) OVER (PARTITION BY conv_id ORDER BY turn) AS first, count(*) OVER (PARTITION BY conv_id) AS size FROM g)
    SELECT id, 'fix contradicts reviewed status' AS fault FROM n WHERE conv_id%5=0 AND turn=0 UNION ALL SELECT id, 'invalid ownership evidence' FROM n WHERE conv_id%5=1 AND turn=0 UNION ALL SELECT id, 'cyclic duplicates' FROM n WHERE conv_id%5=2 AND size>1 UNION ALL SELECT id, 'invalid duplicate target' FROM n WHERE conv_id%5=2 AND size=1""",
)
def d20(spark, d):
    """Messages as findings; a fifth of the conversations is decided against its status, one with a false quote, one as a ring of duplicates, one soundly."""
    m = table(spark, d, "conversations").filter("text IS NOT NULL").groupBy("conv_id", "turn").agg(F.min("text").alias("text"))
    kind = F.element_at(F.array(*map(F.lit, ("feature", "unfinished", "friction", "praise"))), (F.col("turn") % 4 + 1).cast("int"))
    ref = F.concat(F.lit("m"), "conv_id", F.lit("-"), "turn")
    cited = F.array(F.struct(ref.alias("ref"), F.substring("text", 1, 20).alias("quote")))
    rows = m.select("conv_id", "turn", ref.alias("ref"), "text", F.lit("/w").alias("cwd"), F.concat(F.lit("c"), "conv_id").alias("session"), kind.alias("kind"), F.concat(F.lit("claim "), "turn").alias("claim"), cited.alias("citations"))
    found = settle(C2.candidates(rows), "research-candidates")
    at = found.withColumns({"conv_id": F.substring("session", 2, 20).cast("long"), "turn": F.substring("claim", 7, 20).cast("long")})
    w, whole = Window.partitionBy("conv_id").orderBy("turn"), Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ring = F.coalesce(F.lead("id").over(w), F.first("id").over(whole))
    at, part, first = at.withColumn("ring", ring), F.col("conv_id") % 5, F.col("turn") == 0
    owner = lambda quote: F.array(F.struct(F.concat(F.lit("m"), "conv_id", F.lit("-"), "turn").alias("ref"), quote.alias("quote")))
    said = at.filter((part == 2) | (first & part.isin(0, 1, 3))).select(
        "id", F.when(part != 2, "repo").alias("repository"), F.when(part != 2, "core").alias("component"), F.when(part != 2, "accepted").alias("intent"), F.when(part == 0, "present").alias("implementation"),
        F.lit(None).cast("string").alias("deployment"), F.when(part != 2, "fix").alias("action"), F.when(part == 2, "duplicate").otherwise("selected").alias("disposition"), F.when(part == 2, F.col("ring")).alias("duplicate_of"),
        F.lit("reviewed").alias("rationale"), F.when(part == 1, owner(F.lit("never said"))).when(part != 2, owner(F.col("citations")[0]["quote"])).alias("evidence"),
    )
    return C2.ledger_faults(found, said, rows.select("ref", "text"))
