"""Queries of the replica exchange and of selections within budgets."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.text import terms, token_estimate
from ..operators import budget as B
from ..operators import replica as R
from ..operators import retrieval as V
from ..session import settle, table
from .q_text import TERMS
from .registry import query


def replicas(spark, d):
    """Two replicas of the event table: an event's parent is the user's event before it; one lacks every third event, the other every fifth."""
    e = table(spark, d, "events")
    before = F.lag("event_id").over(Window.partitionBy("user_id").orderBy("event_id"))
    parents = F.when(before.isNull(), F.array().cast("array<string>")).otherwise(F.array(before.cast("string")))
    body = F.concat_ws("|", F.col("event_id").cast("string"), "event_type", "props")
    rows = e.select("event_id", "event_type", parents.alias("parents"), body.alias("body")).withColumn("id", R.event_id(F.col("parents"), F.col("body")))
    rows = settle(rows, "replica-all")
    side = lambda n: rows.filter(F.col("event_id") % n != 0).select("id", "parents", "body")
    return side(3), side(5), rows


EVENTS = """e AS (SELECT event_id, event_type, coalesce(lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id)::VARCHAR, '') AS parents, event_id||'|'||event_type||'|'||props AS body FROM events),
i AS (SELECT event_id, event_type, 'evt:'||sha256(parents||chr(0)||body||chr(0)) AS id FROM e)"""


@query("k14_exchange", f"WITH {EVENTS} SELECT id, event_type, TRUE AS mine, TRUE AS theirs FROM i WHERE event_id%3<>0 OR event_id%5<>0")
def exchange(spark, d):
    """After the exchange both replicas hold what either had."""
    mine, theirs, rows = replicas(spark, d)
    done = R.exchange(mine, theirs)
    there = lambda df, name: df.select("id", F.lit(True).alias(name))
    both = there(done.mine, "mine").join(there(done.theirs, "theirs"), "id", "full")
    return both.join(rows.select("id", "event_type"), "id").select("id", "event_type", F.coalesce("mine", F.lit(False)).alias("mine"), F.coalesce("theirs", F.lit(False)).alias("theirs"))


@query(
    "k14_broken_pages",
    f"""WITH {EVENTS}, x AS (SELECT *, substr(sha256(id),1,1)<'8' AS broken FROM i) SELECT event_type, count(*) FILTER (WHERE event_id%5<>0) + count(*) FILTER (WHERE event_id%5=0 AND event_id%3<>0 AND NOT broken) AS theirs,
    count(*) FILTER (WHERE event_id%3<>0 OR event_id%5<>0) AS mine FROM x GROUP BY 1""",
)
def broken(spark, d):
    """Pages of half of the ranges are changed on the way to the other side, by one event each: nothing of them is taken."""
    mine, theirs, rows = replicas(spark, d)
    forged = F.transform("events", lambda e, i: F.when(i == 0, e.withField("body", F.concat(e["body"], F.lit("!")))).otherwise(e))
    on_the_way = lambda pages, to: pages.withColumn("events", F.when((F.col("range") < "80") & F.lit(to == "theirs"), forged).otherwise(F.col("events")))
    done = R.exchange(mine, theirs, on_the_way)
    kinds = rows.select("id", "event_type")
    count = lambda df, name: df.join(kinds, "id").groupBy("event_type").agg(F.count(F.lit(1)).alias(name))
    return count(done.mine, "mine").join(count(done.theirs, "theirs"), "event_type")


@query(
    "r11_interleave",
    """WITH RECURSIVE l AS (SELECT lang, doc_id, length(text) AS n, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS p FROM documents), o AS (SELECT *, row_number() OVER (ORDER BY p, lang) AS i FROM l),
    f(i, used, taken, fits) AS (SELECT 0, 0, 0, FALSE UNION ALL SELECT o.i, CASE WHEN used+n<=30000 AND taken<50 THEN used+n ELSE used END, CASE WHEN used+n<=30000 AND taken<50 THEN taken+1 ELSE taken END, used+n<=30000 AND taken<50 FROM f JOIN o ON o.i=f.i+1)
    SELECT lang, doc_id, used::BIGINT AS used FROM f JOIN o USING (i) WHERE fits""",
)
def r11(spark, d):
    """Documents of all languages by turns, skipping those that don't fit into what is left of the budget."""
    docs = table(spark, d, "documents").select("lang", "doc_id", F.length("text").alias("n"))
    return B.interleaved(docs, "lang", ["doc_id"], "n", 30000, 50).select("lang", "doc_id", "used")


@query(
    "r7_context_budget",
    f"""WITH RECURSIVE q AS (SELECT {TERMS('text')} AS q FROM documents WHERE doc_id=1), v AS (SELECT embedding AS q FROM embeddings WHERE vec_id=1),
    x AS (SELECT doc_id AS id, row_number() OVER (ORDER BY len(list_intersect({TERMS('d.text')}, q)) DESC, doc_id) - 1 AS k FROM documents d, q WHERE len(list_intersect({TERMS('d.text')}, q)) > 0),
    y AS (SELECT vec_id AS id, row_number() OVER (ORDER BY round(list_cosine_similarity(embedding::DOUBLE[], v.q::DOUBLE[]), 6) DESC, vec_id) - 1 AS k FROM embeddings, v WHERE round(list_cosine_similarity(embedding::DOUBLE[], v.q::DOUBLE[]), 6) >= 0.3 AND vec_id IN (SELECT doc_id FROM documents)),
    s AS (SELECT id, sum(1.0::DOUBLE/(61+k)) AS score FROM (SELECT * FROM x UNION ALL SELECT * FROM y) GROUP BY 1),
    o AS (SELECT id, round(score,9) AS score, length(text) AS n, row_number() OVER (ORDER BY round(score,9) DESC, id) AS i FROM s JOIN documents ON doc_id=id),
    f(i, used, taken, fits) AS (SELECT 0, 0, 0, FALSE UNION ALL SELECT o.i, CASE WHEN used+n<=8000 AND taken<20 THEN used+n ELSE used END, CASE WHEN used+n<=8000 AND taken<20 THEN taken+1 ELSE taken END, used+n<=8000 AND taken<20 FROM f JOIN o ON o.i=f.i+1)
    SELECT id, score, used::BIGINT AS used FROM f JOIN o USING (i) WHERE fits""",
)
def r7b(spark, d):
    """Documents by overlap of words fused with the order of their vectors, within a budget of characters, 20 at most."""
    docs, e = table(spark, d, "documents"), table(spark, d, "embeddings")
    words = docs.filter("doc_id = 1").select(terms(F.col("text")).alias("t")).first().t
    near = list(e.filter("vec_id = 1").first().embedding)
    shared = docs.select(F.col("doc_id").alias("id"), F.size(F.array_intersect(terms(F.col("text")), F.array(*map(F.lit, words)))).alias("o")).filter("o > 0")
    own = sum(x * x for x in near) ** 0.5
    cosine = F.round(V.dot(F.col("embedding"), F.array(*[F.lit(float(x)) for x in near])) / (V.norm(F.col("embedding")) * F.lit(own)), 6)
    close = e.select(F.col("vec_id").alias("id"), cosine.alias("o")).filter("o >= 0.3").join(docs.select(F.col("doc_id").alias("id")).distinct(), "id", "left_semi")
    return V.context_within(shared, close, docs.select(F.col("doc_id").alias("id"), F.length("text").alias("n")), 8000, 20).select("id", "score", "used")


@query(
    "l6_trimmed_lists",
    """WITH r AS (SELECT conv_id, role, turn, ceil(length(coalesce(text,''))/4)::BIGINT AS n, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS number, count(*) OVER (PARTITION BY conv_id, role) AS total FROM conversations),
    k AS (SELECT * FROM (SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY number, role ROWS UNBOUNDED PRECEDING) AS used FROM r) WHERE used<=300), s AS (SELECT *, count(*) OVER (PARTITION BY conv_id, role) AS shown FROM k)
    SELECT conv_id, role, turn, shown, total, CASE WHEN shown<total THEN shown END AS next_after FROM s""",
)
def l6(spark, d):
    """A conversation's messages as a list for each role, the longest trimmed until all fit into 300 tokens."""
    rows = table(spark, d, "conversations").select("conv_id", "role", "turn", token_estimate(F.col("text")).alias("n"))
    return B.trimmed(rows, ["conv_id"], "role", ["turn"], "n", 300).select("conv_id", "role", "turn", "shown", "total", "next_after")
