"""Who may see what, what counts as covered, and what is to be done next: rules over plain columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import settle

#: States of knowledge that no answer shows.
HIDDEN = ("superseded", "withheld")
TEST_PATH = r"(^|/)(tests?|__tests__|spec)/|(_test|_spec|\.test|\.spec)\.[a-z]+$|(^|/)test_[^/]*$"


def eligible(items: DataFrame, repos: list[str]) -> DataFrame:
    """Items (status, repo) that are neither superseded nor withheld, in one of the repositories."""
    return items.filter(~F.col("status").isin(*HIDDEN) & F.col("repo").isin(*repos))


def granted(items: DataFrame, user: str, grants: DataFrame) -> DataFrame:
    """Items (id, owner, status) that a user may read: own ones, admitted ones of owners who grant all, and selected ones.

    ``grants``: owner, reader, item (null: all admitted).
    """
    own = grants.filter(F.col("reader") == user)
    every = own.filter("item IS NULL").select("owner", F.lit(True).alias("_all")).distinct()
    picked = own.filter("item IS NOT NULL").select("owner", F.col("item").alias("id"), F.lit(True).alias("_one")).distinct()
    seen = items.join(F.broadcast(every), "owner", "left").join(picked, ["owner", "id"], "left")
    open_to = F.coalesce("_all", F.lit(False)) & (F.col("status") == "admitted") | F.coalesce("_one", F.lit(False))
    return seen.filter((F.col("owner") == user) | open_to).drop("_all", "_one")


def is_test_path(path: Column) -> Column:
    return path.rlike(TEST_PATH)


def coverage_counts(edges: DataFrame) -> DataFrame:
    """(rel_type, n, structural, decided, catalog) by where an edge's evidence comes from (``producers``, an array).

    Structural: extractors alone; decided: some decision; catalog: a database's catalog alone.
    """
    every = lambda kind: F.forall("producers", lambda p: p.startswith(f"{kind}:"))
    some = F.exists("producers", lambda p: p.startswith("decision:"))
    n = lambda c, name: F.count_if((F.size("producers") > 0) & c).alias(name)
    return edges.groupBy("rel_type").agg(F.count(F.lit(1)).alias("n"), n(every("extractor"), "structural"), n(some, "decided"), n(every("catalog"), "catalog"))


def coverage_report(files: DataFrame, most: int = 100) -> DataFrame:
    """One row: files in all, with parse errors, scanned heuristically, the first of those by path and how many more."""
    counts = files.agg(F.count(F.lit(1)).alias("files"), F.count_if("parse_errors").alias("parse_errors"), F.count_if("heuristic").alias("heuristic"))
    first = files.filter("heuristic").select("path").orderBy("path").limit(most).agg(F.array_sort(F.collect_list("path")).alias("first"))
    return counts.crossJoin(F.broadcast(first)).withColumn("omitted", F.greatest(F.col("heuristic") - most, F.lit(0)))


def selected_omitted(candidates: DataFrame, cap: int) -> DataFrame:
    """(reason, selected, omitted) of candidates, ``cap`` selected for each reason at most."""
    n = F.count(F.lit(1))
    return candidates.groupBy("reason").agg(F.least(n, F.lit(cap)).alias("selected"), F.greatest(n - cap, F.lit(0)).alias("omitted"))


def retained_builds(members: DataFrame, builds: DataFrame, active: DataFrame) -> DataFrame:
    """(build, members, shared, is_active) of each retained build; ``shared`` members are in other builds too."""
    uses = members.groupBy("entity_id").agg(F.count_distinct("build").alias("_n"))
    own = members.join(uses, "entity_id").groupBy("build").agg(F.count(F.lit(1)).alias("members"), F.count_if(F.col("_n") > 1).alias("shared"))
    found = builds.select("build").join(own, "build", "left").join(active.select("build", F.lit(True).alias("_a")).distinct(), "build", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return found.select("build", zero("members"), zero("shared"), F.coalesce("_a", F.lit(False)).alias("is_active"))


def clusters(pairs: DataFrame, disputed: DataFrame) -> DataFrame:
    """(node, label): agreed duplicates (a, b) with the smallest of their cluster; disputed pairs, either way round, don't count."""
    from .traverse import connected

    ends = lambda df: df.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return connected(ends(pairs).join(ends(disputed).distinct(), ["a", "b"], "left_anti"))


def current_view(items: DataFrame, replaced: DataFrame, pairs: DataFrame, disputes: DataFrame) -> DataFrame:
    """(id, canonical, disputed) of what is shown: one item for each cluster of duplicates, without replaced ones.

    A cluster is disputed if one of its items is.
    """
    label = clusters(pairs, pairs.limit(0))
    shown = items.select("id").join(replaced.select("id"), "id", "left_anti").join(label.withColumnRenamed("node", "id"), "id", "left")
    flagged = shown.withColumn("canonical", F.coalesce("label", "id")).join(disputes.select("id", F.lit(True).alias("_d")).distinct(), "id", "left")
    return flagged.groupBy("canonical").agg(F.min("id").alias("id"), F.max(F.coalesce("_d", F.lit(False))).alias("disputed")).select("id", "canonical", "disputed")


def pending_batches(texts: DataFrame, done: DataFrame, key: str, size: int) -> DataFrame:
    """(key, batch): texts without an embedding, ``size`` a batch in key order.

    Rows are numbered within ranges of the key, which are then shifted by the ranges before.
    """
    pending = texts.select(key).distinct().join(done.select(key), key, "left_anti")
    dealt = settle(pending.repartitionByRange(F.col(key)).withColumn("_part", F.spark_partition_id()), "pending")
    sizes = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inner = dealt.withColumn("_k", F.row_number().over(Window.partitionBy("_part").orderBy(key)) - 1)
    return inner.join(F.broadcast(before), "_part").select(key, F.floor((F.col("_k") + F.col("_before")) / size).cast("int").alias("batch"))


def merged_events(*sets: DataFrame) -> DataFrame:
    """The union of event sets by event_id: the same in any order and however often; a changed body is an error."""
    from .ledger import idempotent

    return idempotent(reduce(DataFrame.unionByName, [s.select("event_id", "body") for s in sets]), "event_id", "body")


def response_verdict(label: Column, allowed: list[str], value: Column, low: float, high: float) -> Column:
    """Why a model's answer is refused, or ``valid``."""
    number = value.isNull() | F.isnan(value) | ~value.between(low, high)
    return F.when(label.isNull() | ~label.isin(*allowed), "unknown label").when(number, "out of range").otherwise("valid")


def answer_verdict(value: Column, accept: float, refuse: float) -> Column:
    return F.when(value >= accept, "accept").when(value <= refuse, "refuse").otherwise("ask again")


def compaction_plan(messages: DataFrame, long: int) -> DataFrame:
    """Messages with their ``fate``: the first and system ones are protected, long texts move out, the rest stays inline."""
    first = F.col("turn") == F.min("turn").over(Window.partitionBy("session"))
    fate = F.when(first | (F.col("role") == "system"), "kept").when(F.length("text") > long, "moved").otherwise("inline")
    return messages.withColumn("fate", fate)


def ledger_states(findings: DataFrame, sources: DataFrame, allowed: list[int]) -> DataFrame:
    """(id, state) of a research ledger's findings (id, value) against their sources (id)."""
    there = sources.select("id", F.lit(1).alias("_s")).distinct()
    state = F.when(F.col("_s").isNull(), "no source").when(F.col("value").isNull() | ~F.col("value").isin(*allowed), "bad value").otherwise("sound")
    return findings.join(there, "id", "left").select("id", state.alias("state"))


def live_handles(handles: DataFrame, current: DataFrame) -> DataFrame:
    """Handles (id, generation) that still lead somewhere: an old generation doesn't come back to life."""
    return handles.join(current.select("id", "generation"), ["id", "generation"], "left_semi").distinct()


def operation_page(operations: DataFrame, text: str, key: str, skip: int, limit: int) -> DataFrame:
    """A page of operations whose name has the text, by key."""
    return operations.filter(F.lower("name").contains(text.lower())).orderBy(key).offset(skip).limit(limit)


def freshness(now: DataFrame, indexed: DataFrame) -> DataFrame:
    """(state, n) of indexed files (path, sha256) against what is there: fresh, stale, gone or new."""
    a, b = indexed.select("path", F.col("sha256").alias("was")), now.select("path", F.col("sha256").alias("is"))
    state = F.when(F.col("is").isNull(), "gone").when(F.col("was").isNull(), "new").when(F.col("is") == F.col("was"), "fresh").otherwise("stale")
    return a.join(b, "path", "full_outer").groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("n"))


def timeline(messages: DataFrame, most: int) -> DataFrame:
    """(session, brief, omitted): roles and sizes of a session's first ``most`` messages in order, and how many more there are."""
    order = Window.partitionBy("session").orderBy("turn")
    numbered = messages.select("session", "turn", F.concat_ws(":", "role", F.length("text")).alias("b"), F.row_number().over(order).alias("n"))
    shown = F.sort_array(F.collect_list(F.when(F.col("n") <= most, F.struct("n", "b"))))
    return numbered.groupBy("session").agg(F.array_join(shown["b"], " ").alias("brief"), F.count_if(F.col("n") > most).alias("omitted"))


def evidence_packet(owned: DataFrame, most: int) -> DataFrame:
    """(owner, what, omitted): each owner's first ``most`` distinct pieces of evidence in order, and how many more there are."""
    each = owned.select("owner", "what").distinct()
    numbered = each.withColumn("n", F.row_number().over(Window.partitionBy("owner").orderBy("what")))
    total = each.groupBy("owner").agg(F.greatest(F.count(F.lit(1)) - most, F.lit(0)).alias("omitted"))
    return numbered.filter(F.col("n") <= most).join(total, "owner").select("owner", "what", "omitted")


def work_list(items: DataFrame, released: DataFrame, related: DataFrame, limit: int) -> DataFrame:
    """Present items (id, present, scope) that aren't released and whose scope is related, by id, a page of them."""
    return items.filter("present").join(released.select("id"), "id", "left_anti").join(related.select("scope"), "scope", "left_semi").select("id").orderBy("id").limit(limit)


def rechecked(staged: DataFrame, again: DataFrame, key: str) -> DataFrame:
    """(key, state): staged rows against a second extraction: changed, only staged or only extracted; equal rows aren't listed."""
    pack = lambda df, name: df.select(key, F.sha2(F.to_json(F.struct(*sorted(c for c in df.columns if c != key))), 256).alias(name))
    both = pack(staged, "s").join(pack(again, "a"), key, "full_outer").filter(~F.col("s").eqNullSafe(F.col("a")))
    return both.select(key, F.when(F.col("a").isNull(), "staged").when(F.col("s").isNull(), "extracted").otherwise("changed").alias("state"))


def catalog_graph(records: DataFrame) -> DataFrame:
    """(from_key, to_key, rel_type) of catalog records (key, parent): the root defines objects, parents contain children."""
    rel = F.when(F.col("parent").isNull(), "defines").otherwise("contains")
    return records.select(F.coalesce("parent", F.lit("catalog")).alias("from_key"), F.col("key").alias("to_key"), rel.alias("rel_type"))


def impact(bridges: DataFrame, versions: DataFrame, start: str, hops: int) -> tuple[DataFrame, DataFrame]:
    """(entity_id, depth) that a change reaches over bridges, and the bridges at its edge that it may not cross, with why.

    ``bridges``: from_id, to_id, pin (a version or null), blocked; ``versions``: id, version. A pin to another
    version than the target's stops the change there, as a block does.
    """
    from .traverse import reachable

    now = versions.select(F.col("id").alias("to_id"), "version")
    why = F.when(F.col("blocked"), "blocked").when(F.col("version").isNull(), "unknown").when(F.col("pin").isNotNull() & (F.col("pin") != F.col("version")), "version mismatch")
    judged = settle(bridges.join(now, "to_id", "left").select("from_id", "to_id", why.alias("why")), "bridges")
    reached = reachable(judged.filter("why IS NULL"), start, hops, directed=True)
    stopped = judged.filter("why IS NOT NULL").join(reached.select(F.col("entity_id").alias("from_id")), "from_id", "left_semi")
    return reached, stopped


def published_status(nodes: DataFrame, edges: DataFrame, header: dict) -> DataFrame:
    """One row: the build, its counts, and whether it has relations, without which no build becomes active."""
    n, e = nodes.agg(F.count(F.lit(1)).alias("nodes")), edges.agg(F.count(F.lit(1)).alias("edges"))
    return n.crossJoin(F.broadcast(e)).select(*(F.lit(v).alias(k) for k, v in header.items()), "nodes", "edges", (F.col("edges") > 0).alias("publishable"))


def pinned_ids(pins: DataFrame, side: DataFrame) -> DataFrame:
    """(id, state) of identity pins (id, sha256) against a side input (id, sha256): pinned, other bytes or missing; each id once."""
    p = pins.groupBy("id").agg(F.min("sha256").alias("p"), F.count_distinct("sha256").alias("n"))
    state = F.when(F.col("n") > 1, "pinned twice").when(F.col("f").isNull(), "missing").when(F.col("p") == F.col("f"), "pinned").otherwise("other bytes")
    return p.join(side.select("id", F.col("sha256").alias("f")), "id", "left").select("id", state.alias("state"))


ANSWERS = "batch, question, kind (noul, choice, score), probability, choice, confidence, probabilities (map), score, model"


def answer_faults(asked: DataFrame, answers: DataFrame, model: str) -> DataFrame:
    """(batch, fault): why a batch of answers is refused as a whole, the first fault by name; sound batches have no row.

    ``asked``: batch, question, kind, options (array; null: any). ``answers``: the columns of ``ANSWERS``. Every question is
    answered once and nothing else is; kinds agree; the model is the one asked for; numbers are finite and from
    0 to 1 (a score only finite); a choice's probabilities sum to 1 within 0.05, and its options are among those asked.
    """
    outside = lambda x: x.isNull() | F.isnan(x) | ~x.between(0.0, 1.0)
    endless = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    twice = answers.groupBy("batch", "question").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("batch", F.lit("answered twice").alias("fault"))
    a = answers.withColumnsRenamed({"kind": "answered"}).withColumn("here", F.lit(True))
    both = asked.withColumn("wanted", F.lit(True)).join(a, ["batch", "question"], "full")
    p = F.coalesce("probabilities", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<double>")))
    keys, values = F.map_keys(p), F.map_values(p)
    total = F.aggregate(values, F.lit(0.0), lambda s, x: s + x)
    choice = (
        F.when(outside(F.col("confidence")) | F.exists(values, outside), "out of range")
        .when(F.abs(total - 1.0) > 0.05, "probabilities don't sum to 1")
        .when(F.col("options").isNotNull() & ~(F.coalesce(F.array_contains("options", F.col("choice")), F.lit(False)) & (F.size(F.array_except(keys, F.col("options"))) == 0)), "option wasn't asked")
    )
    told = (
        F.when(F.col("here").isNull(), "missing answer")
        .when(F.col("wanted").isNull(), "answer to no question")
        .when(~(F.col("model").eqNullSafe(model)), "another model")
        .when(~(F.col("kind").eqNullSafe(F.col("answered"))), "another kind")
        .when((F.col("kind") == "noul") & outside(F.col("probability")), "out of range")
        .when(F.col("kind") == "choice", choice)
        .when((F.col("kind") == "score") & (outside(F.col("confidence")) | endless(F.col("score"))), "out of range")
    )
    found = both.select("batch", told.alias("fault")).filter("fault IS NOT NULL").unionByName(twice)
    return found.groupBy("batch").agg(F.min("fault").alias("fault"))
