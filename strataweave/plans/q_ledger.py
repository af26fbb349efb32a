"""Queries over the event ledger, and its streams run to the end of what is there."""

from __future__ import annotations

from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from ..operators import ledger as L
from ..session import shared_path, table
from ..streaming import leases as S
from ..streaming import outbox
from ..streaming import projections as P
from .registry import query


def events(spark, d):
    return table(spark, d, "events")


@query("st_idempotent_ledger", "SELECT event_id, event_type AS body FROM events")
def st1(spark, d):
    e = events(spark, d).select("event_id", F.col("event_type").alias("body"))
    return L.idempotent(e.unionAll(e.filter("event_id % 2 = 0")), "event_id", "body")


@query("st_invocation_pairs", "WITH o AS (SELECT user_id, ts, event_type, lead(ts) OVER w AS nts, lead(event_type) OVER w AS nt FROM events WHERE event_type IN ('signup','purchase') WINDOW w AS (PARTITION BY user_id ORDER BY ts)) SELECT user_id, count(*) AS begun, count(CASE WHEN nt='purchase' THEN 1 END) AS settled FROM o WHERE event_type='signup' GROUP BY 1")
def st2(spark, d):
    pairs = L.paired(events(spark, d), "user_id", "ts", F.col("event_type") == "signup", F.col("event_type") == "purchase")
    return pairs.groupBy("user_id").agg(F.count(F.lit(1)).alias("begun"), F.count("end").alias("settled"))


@query("st_liveness", "WITH g AS (SELECT event_type, ts, date_diff('microsecond', lag(ts) OVER (PARTITION BY event_type ORDER BY ts), ts) > 5400000000 AS gap FROM events) SELECT event_type, count(*) AS beats, sum(CASE WHEN gap THEN 1 ELSE 0 END)::BIGINT AS gaps, max(ts) AS last FROM g GROUP BY 1")
def st3(spark, d):
    return L.liveness(events(spark, d), "event_type", "ts", 5400)


@query("j6_operation_states", "SELECT CASE WHEN event_id % 3=0 THEN 'settled' WHEN event_id % 5=0 THEN 'executed' ELSE 'pending' END AS state, count(*) AS n FROM events GROUP BY 1")
def j6(spark, d):
    ops = events(spark, d).select(F.col("event_id").alias("id"))
    s = ops.filter("id % 3 = 0").withColumn("settled", F.lit("settled"))
    x = ops.filter("id % 5 = 0").withColumn("executed", F.lit("executed"))
    return L.settled(ops, s, x).groupBy("state").agg(F.count(F.lit(1)).alias("n"))


@query("j7_nested_exists", "SELECT event_type, count(*) AS n FROM events WHERE (json_extract_string(props,'$.k'))::INT IN (3,5) GROUP BY 1")
def j7(spark, d):
    e = events(spark, d).withColumn("objects", F.array(F.struct(F.get_json_object("props", "$.k").cast("int").alias("k"))))
    return e.filter(F.exists("objects", lambda x: x["k"].isin(3, 5))).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("a2_ledger_totals", "SELECT coalesce(max(event_id),0) AS seq, sum(CASE WHEN event_type<>'error' THEN 1 ELSE 0 END)::BIGINT AS healthy, count(DISTINCT user_id) AS users FROM events")
def a2(spark, d):
    return events(spark, d).agg(
        F.coalesce(F.max("event_id"), F.lit(0)).alias("seq"), F.sum((F.col("event_type") != "error").cast("int")).alias("healthy"), F.countDistinct("user_id").alias("users")
    )


@query("a26_budget_by_status", "SELECT event_type, count(*) AS n, coalesce(sum((json_extract_string(props,'$.k'))::BIGINT),0)::BIGINT AS reserved FROM events GROUP BY 1")
def a26(spark, d):
    return L.budget_totals(events(spark, d).withColumn("k", F.get_json_object("props", "$.k").cast("long")), "event_type", "k")


@query("x25_delta_page", "WITH l AS (SELECT event_id, length(props)::BIGINT AS n FROM events WHERE event_id % 4 <> 0 ORDER BY 1 LIMIT 200), u AS (SELECT *, sum(n) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS used FROM l) SELECT event_id, used::BIGINT AS used FROM u WHERE used <= 1200")
def x25(spark, d):
    e = events(spark, d).select("event_id", F.length("props").cast("long").alias("n"))
    return L.delta_page(e, e.filter("event_id % 4 = 0"), "event_id", "n", 200, 1200).select("event_id", "used")


@query("x21_served_then_read", "SELECT count(*) AS n FROM events r WHERE event_type='purchase' AND EXISTS (SELECT 1 FROM events s WHERE s.event_type='view' AND s.user_id=r.user_id AND s.ts<=r.ts AND s.ts>=r.ts - INTERVAL 30 MINUTE)")
def x21(spark, d):
    e = events(spark, d)
    return L.served_then_read(e.filter("event_type = 'view'"), e.filter("event_type = 'purchase'"), "user_id", 30).agg(F.count(F.lit(1)).alias("n"))


@query("d21_leases", "WITH t AS (SELECT max(ts) AS m FROM events) SELECT user_id AS task, arg_max(event_type, (row(event_id, ts))) AS holder, max(event_id) AS generation, max(ts) >= TIMESTAMP '2024-01-20' - INTERVAL 86400 SECOND AS live FROM events GROUP BY 1")
def d21(spark, d):
    c = events(spark, d).select(F.col("user_id").alias("task"), F.col("event_type").alias("holder"), F.col("event_id").alias("generation"), "ts")
    return L.lease_states(c, "2024-01-20", 86400)


@query("st_stream_counts", "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def st4(spark, d):
    """The ledger stream, twice the even events, into a deduplicated table; then its projection."""
    ledger = P.run_ledger(spark, d)
    return ledger.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("users"))


@query("st_stream_sessions", "WITH o AS (SELECT user_id, event_type, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nt FROM events WHERE event_type IN ('signup','purchase')), p AS (SELECT user_id, count(*) FILTER (WHERE event_type='signup') AS begun, count(*) FILTER (WHERE event_type='signup' AND nt='purchase') AS settled FROM o GROUP BY 1) SELECT u.user_id, coalesce(begun,0) AS begun, coalesce(settled,0) AS settled FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN p USING (user_id)")
def st5(spark, d):
    return P.run_invocations(spark, d)


@query("st_windows", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1,2")
def st6(spark, d):
    return events(spark, d).groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


@query("st_outbox", "SELECT event_type, count(*) AS n, count(*) AS published, sum(length(props))::BIGINT AS score FROM events GROUP BY 1")
def st7(spark, d):
    """Every event twice through a worker that breaks off once and is started again: each is assessed and published once."""
    e = events(spark, d).select(F.col("event_id").cast("string").alias("id"), "event_type", "props")
    root = shared_path(spark, "outbox")
    e.unionByName(e).withColumn("part", F.pmod(F.xxhash64("id"), F.lit(4))).repartition(4, "part").drop("part").write.parquet(f"{root}/in")
    assess = lambda df: df.select("id", "event_type", F.length("props").cast("long").alias("score"))
    broken, worker = outbox.Outbox(spark, root, assess), outbox.Outbox(spark, root, assess)

    def stop(step: str, batch: int) -> None:
        if (step, batch) == ("assessed", 1):
            raise RuntimeError("the worker stops here")

    broken.before = stop
    try:
        outbox.run_outbox(broken, f"{root}/in", e.schema)
    except StreamingQueryException as fault:
        if "the worker stops here" not in str(fault):
            raise
    outbox.run_outbox(worker, f"{root}/in", e.schema)
    done = worker.status().join(worker.read("published").drop("batch"), "id", "left")
    return done.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("status") == "published", 1)).alias("published"), F.sum("score").alias("score"))


@query(
    "d21_lease_machine",
    """WITH RECURSIVE e AS (SELECT 't'||(user_id%40) AS task, epoch_us(ts) AS us, event_id AS seq, CASE event_type WHEN 'signup' THEN 'claim' WHEN 'purchase' THEN 'reclaim' WHEN 'error' THEN 'reclaim' ELSE 'heartbeat' END AS action, 'w'||user_id AS worker FROM events),
    o AS (SELECT *, row_number() OVER (PARTITION BY task ORDER BY us, seq) AS i FROM e),
    f(task, i, us, action, worker, lapsed, was, had, accepted, holder, generation, until, told) AS (
    SELECT task, 0::BIGINT, NULL::BIGINT, NULL::VARCHAR, NULL::VARCHAR, NULL::BIGINT, NULL::VARCHAR, NULL::BIGINT, NULL::BOOLEAN, NULL::VARCHAR, 0::BIGINT, 0::BIGINT, TRUE FROM (SELECT DISTINCT task FROM o)
    UNION ALL SELECT o.task, o.i, o.us, o.action, o.worker, CASE WHEN NOT told AND o.us>=until THEN until END, holder, generation, ok, CASE WHEN ok THEN o.worker ELSE holder END, generation + (CASE WHEN ok AND o.action<>'heartbeat' THEN 1 ELSE 0 END),
    CASE WHEN ok THEN o.us+86400000000 ELSE until END, CASE WHEN ok THEN FALSE ELSE told OR o.us>=until END
    FROM (SELECT f.*, o.us AS ous, CASE o.action WHEN 'claim' THEN holder IS NULL WHEN 'heartbeat' THEN coalesce(holder=o.worker, FALSE) ELSE holder IS NOT NULL AND o.us>=until END AS ok FROM f JOIN o ON o.task=f.task AND o.i=f.i+1) f JOIN o ON o.task=f.task AND o.i=f.i+1),
    z AS (SELECT task, arg_max(holder, i) AS holder, max(generation) AS generation, arg_max(until, i) AS until, arg_max(told, i) AS told FROM f GROUP BY 1)
    SELECT task, us, action, worker, accepted, generation FROM f WHERE i>0 UNION ALL SELECT task, lapsed, 'expired', was, TRUE, had FROM f WHERE lapsed IS NOT NULL
    UNION ALL SELECT task, until, 'expired', holder, TRUE, generation FROM z, (SELECT max(epoch_us(ts)) AS m FROM events) WHERE NOT told AND ceil(until/1000.0) <= m//1000 - 3600000""",
)
def d21m(spark, d):
    """The lease machine over the event table, in three batches by time: who was let in, refused, or let a lease run out."""
    action = F.when(F.col("event_type") == "signup", "claim").when(F.col("event_type").isin("purchase", "error"), "reclaim").otherwise("heartbeat")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    e = events(spark, d).select(
        F.concat(F.lit("t"), (F.col("user_id") % 40).cast("string")).alias("task"), us.alias("us"), F.col("event_id").alias("seq"), action.alias("action"),
        F.concat(F.lit("w"), F.col("user_id").cast("string")).alias("worker"), F.col("ts").cast("timestamp").alias("ts"),
    )
    ends = e.agg(F.min("us").alias("a"), F.max("us").alias("z")).first()
    step = (ends.z - ends.a) // 3 + 1
    thirds = [e.filter(F.col("us").between(ends.a + k * step, ends.a + (k + 1) * step - 1)) for k in range(3)]
    return S.run_leases(spark, thirds, 86_400_000_000, "1 hour")
