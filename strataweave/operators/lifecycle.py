"""Decisions, evidence and lifecycles as relational rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import sha256_hex


def sealed_evidence(evidence: DataFrame, most: int = 1000) -> DataFrame:
    """(rel_id, evidence, n): sorted distinct evidence of each relation; raises beyond ``most``."""
    packed = evidence.groupBy("rel_id").agg(F.array_sort(F.collect_set("evidence_id")).alias("evidence"))
    n = F.size("evidence")
    return packed.withColumn("n", F.when(n > most, F.raise_error(F.lit("too much evidence"))).otherwise(n))


def truncated(evidence: Column, limit: int) -> tuple[Column, Column]:
    """The first ``limit`` of a sorted array and how many were left out."""
    return F.slice(evidence, 1, limit), F.greatest(F.size(evidence) - limit, F.lit(0))


def closure(edges: DataFrame, evidence: DataFrame, files: DataFrame) -> DataFrame:
    """(rel_id, cited, missing): evidence ids of each edge that lead to a known file, and those that don't."""
    each = edges.select("rel_id", F.explode("evidence_ids").alias("evidence_id"))
    known = each.join(evidence, "evidence_id", "left").join(files.withColumn("_f", F.lit(1)), "file", "left")
    return known.groupBy("rel_id").agg(F.count("_f").alias("cited"), F.count_if(F.col("_f").isNull()).alias("missing"))


def with_cache(candidates: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    """Candidates with their cached answer; failed answers don't count."""
    good = cache.filter("NOT failed").select(key, F.col("answer"))
    return candidates.join(good, key, "left").withColumn("cached", F.col("answer").isNotNull())


def contradicted(claims: DataFrame) -> DataFrame:
    """(from_id, to_id, rel_type, against): triples that an accepted and a rejected claim share."""
    key = ["from_id", "to_id", "rel_type"]
    sides = claims.groupBy(*key).agg(F.count_if("accepted").alias("for"), F.count_if(~F.col("accepted")).alias("against"))
    return sides.filter("`for` > 0 AND against > 0").select(*key, "against")


def parallel_suffix(relations: DataFrame) -> DataFrame:
    """``rel_key``: the triple, with ``#n`` from the second parallel relation on."""
    w = Window.partitionBy("rel_type", "from_id", "to_id").orderBy("seq")
    n = F.row_number().over(w)
    base = F.concat_ws("|", "rel_type", "from_id", "to_id")
    return relations.withColumn("rel_key", F.when(n == 1, base).otherwise(F.concat(base, F.lit("#"), n.cast("string"))))


def path_related(a: DataFrame, b: DataFrame, left: str, right: str) -> DataFrame:
    """Pairs of paths where one is the other or lies below it.

    Every path is exploded into its ancestors, so both directions are equi-joins.
    """

    def ancestors(c: str) -> Column:
        parts = F.split(F.col(c), "/")
        return F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))).alias("_p")

    below = a.select(left, ancestors(left)).join(b.select(right, F.col(right).alias("_p")), "_p")
    above = b.select(right, ancestors(right)).join(a.select(left, F.col(left).alias("_p")), "_p")
    return below.select(left, right).union(above.select(left, right)).distinct()


def same_origin(rows: DataFrame) -> DataFrame:
    """(provider, id, same_as): rows of federated providers with the first other provider of the same origin and id."""
    other = rows.select("origin", "id", F.col("provider").alias("other")).distinct()
    met = rows.join(other, ["origin", "id"], "left")
    return met.groupBy("provider", "id").agg(F.min(F.when(F.col("other") != F.col("provider"), F.col("other"))).alias("same_as"))


def question(left: Column, relation: Column, right: Column) -> Column:
    """The question that a relation is decided by."""
    return F.concat(F.lit("Does `"), left, F.lit("` "), relation, F.lit(" `"), right, F.lit("`?"))


def pair_action(same: Column, replaces: Column, older: Column) -> Column:
    return F.when(same >= 0.9, "merge").when((replaces >= 0.9) & older, "replace").when(replaces >= 0.9, "conflict").otherwise("keep")


def hold_reasons(conditions: dict[str, Column]) -> Column:
    """Names of the conditions that hold, in order."""
    return F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in conditions.items())))


def valid_response(kind: Column, value: Column, label: Column, allowed: list[str]) -> Column:
    finite = value.isNotNull() & ~F.isnan(value) & value.between(0, 1)
    return finite & F.when(kind == "choice", label.isin(*allowed)).otherwise(True)


def lifecycle(receipts: DataFrame) -> DataFrame:
    """(scope, item, status) after folding receipts (scope, item, seq, action, target) in order.

    admit, withhold and reject set the item; supersede also supersedes its target; contradict
    disputes both sides. Each scope is one ordered fold, which streams: a task holds the status of
    one scope's items, not its receipts.
    """
    plain = {"admit": "admitted", "withhold": "withheld", "reject": "rejected"}
    dealt = receipts.select("scope", "item", "seq", "action", "target").repartition("scope").sortWithinPartitions("scope", "seq")

    def run(batches):
        import pyarrow as pa

        now, status = None, {}

        def answer():
            return pa.RecordBatch.from_arrays([pa.array([now] * len(status), pa.int64()), pa.array(list(status), pa.int64()), pa.array(list(status.values()))], names=["scope", "item", "status"])

        for batch in batches:
            for scope, item, _, action, target in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if scope != now:
                    if status:
                        yield answer()
                    now, status = scope, {}
                if action in plain:
                    if status.get(item) != "superseded":
                        status[item] = plain[action]
                elif action == "supersede":
                    status[item] = "admitted"
                    status[target] = "superseded"
                elif action == "contradict":
                    for side in (item, target):
                        if status.get(side) != "superseded":
                            status[side] = "disputed"
        if status:
            yield answer()

    return dealt.mapInArrow(run, "scope long, item long, status string")


def trim(lists: dict[str, list], size, budget: int) -> tuple[dict[str, list], dict[str, dict[str, int]]]:
    """Pops from the longest list until everything fits; a driver-side fold over a bounded answer."""
    kept = {k: list(v) for k, v in lists.items()}
    while any(kept.values()) and sum(size(x) for v in kept.values() for x in v) > budget:
        kept[max(kept, key=lambda k: (len(kept[k]), k))].pop()
    return kept, {k: {"shown": len(kept[k]), "total": len(v)} for k, v in lists.items()}


CONTRACT = "neighbours-2"


def cursor(scope: str, out: str | None, into: str | None) -> str:
    """An opaque page cursor with two positions, only good for its scope and sealed by a fingerprint of all it says."""
    import base64
    import json

    return base64.urlsafe_b64encode(json.dumps([CONTRACT, scope, out, into, sha256_hex(CONTRACT, scope, json.dumps([out, into]))[:16]]).encode()).decode()


def open_cursor(text: str, scope: str) -> tuple[str | None, str | None]:
    import base64
    import json

    try:
        contract, own, out, into, seal = json.loads(base64.urlsafe_b64decode(text.encode()))
    except ValueError as e:
        raise ValueError("not a cursor") from e
    if contract != CONTRACT or seal != sha256_hex(CONTRACT, str(own), json.dumps([out, into]))[:16]:
        raise ValueError("not a cursor of this contract")
    if own != scope:
        raise ValueError("the cursor belongs to another scope")
    return out, into


def trimmed_position(before: str | None, after: str | None, shown: list[str], total: int) -> str | None:
    """Where the next page goes on after the first rows of a page were kept: behind the last one shown; where nothing is left, where the page itself began."""
    if len(shown) == total:
        return after
    return shown[-1] if shown else before


def context(nodes: DataFrame, edges: DataFrame, terms: list[str], depth: int, seeds: int, limit: int, semantic: DataFrame | None = None) -> DataFrame:
    """(entity_id, depth, score): lexical seeds and what lies around them, nearest and best first, ``limit`` at most.

    A name that has a term counts 2, a qualified name 1. ``semantic`` (id, rank from 0), an order by
    meaning, is fused with the lexical order by reciprocal ranks; the fused order then picks the seeds.
    Each level joins the edges with its front alone and stops once ``limit`` nodes are reached.
    """
    from .retrieval import fuse
    from .traverse import cut

    if not (1 <= depth <= 6 and 1 <= limit <= 200):
        raise ValueError("1 to 6 levels, 1 to 200 nodes")
    score = F.lit(0)
    for t in terms:
        score = score + F.when(F.col("name_fold").contains(t), 2).otherwise(0) + F.when(F.col("qn_fold").contains(t), 1).otherwise(0)
    hit = nodes.select("entity_id", score.alias("score")).filter("score > 0").orderBy(F.desc("score"), "entity_id").limit(seeds)
    if semantic is not None:
        rank = F.row_number().over(Window.orderBy(F.desc("score"), "entity_id")) - 1  # ``seeds`` rows at most
        lists = hit.select(F.lit(0).alias("list"), F.col("entity_id").alias("id"), rank.alias("rank")).unionAll(semantic.select(F.lit(1), "id", "rank"))
        fused = fuse(lists).limit(seeds).select(F.col("id").alias("entity_id"))
        hit = fused.join(hit, "entity_id", "left").select("entity_id", F.coalesce("score", F.lit(0)).alias("score"))
    seen = front = cut(hit.select("entity_id", F.lit(0).alias("depth"), "score"))
    for d in range(1, depth + 1):
        steps = [edges.join(front.select(F.col("entity_id").alias(a)), a, "left_semi").select(F.col(b).alias("entity_id")) for a, b in (("from_id", "to_id"), ("to_id", "from_id"))]
        step = steps[0].unionAll(steps[1]).distinct()
        front = cut(step.join(seen, "entity_id", "left_anti").select("entity_id", F.lit(d).alias("depth"), F.lit(0).alias("score")))
        seen = cut(seen.unionAll(front))
        if seen.limit(limit).count() == limit:
            break
    return seen.orderBy("depth", F.desc("score"), "entity_id").limit(limit)
