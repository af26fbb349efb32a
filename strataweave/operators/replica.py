"""Anti-entropy between replicas of event sets: digests of key ranges, descended where they differ; pages taken whole or refused.

An event is (id, parents, body); its id is a digest of its parents and its body. Events fall into ranges by the first
hexadecimal digits of a hash of the id, two digits wide and then four. A range's digest is the number of its events and two exclusive-ors
of 64-bit hashes: it is mergeable, so it is aggregated before it moves, whatever the partitions. Two replicas compare
the wide ranges, the narrow ones of those that differ, and ids within narrow ones that differ; what is equal is
never listed. What the other side lacks goes in pages of bounded count and bytes.

A receiver checks a page as a whole: its digest, its bounds, every event's own id and size, and that no event
contradicts one that is there. One fault refuses all of the page. Accepted events are a set union, so pages may come
twice and in any order. Null parents are none; a null body is a fault.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import sha_col
from ..session import settle
from .budget import chunked

#: Digits of ranges, wide to narrow.
WIDTHS = (2, 4)
PAGE_EVENTS, PAGE_BYTES, EVENT_BYTES = 200, 1 << 20, 1 << 18


def event_id(parents: Column, body: Column) -> Column:
    return F.concat(F.lit("evt:"), sha_col(F.array_join(F.array_sort(F.coalesce(parents, F.array().cast("array<string>"))), ","), body))


def key_range(width: int) -> Column:
    return F.substring(F.sha2("id", 256), 1, width)


def range_digests(events: DataFrame, width: int) -> DataFrame:
    """(range, n, d1, d2)."""
    parents = F.array_join(F.coalesce("parents", F.array().cast("array<string>")), ",")
    return events.groupBy(key_range(width).alias("range")).agg(
        F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("id", parents, "body")).alias("d1"), F.bit_xor(F.xxhash64(F.lit(1), "id", parents, "body")).alias("d2")
    )


def differing(mine: DataFrame, theirs: DataFrame) -> DataFrame:
    """(range): the narrow ranges in which two replicas differ."""
    found = None
    for width in WIDTHS:
        sides = []
        for events in (mine, theirs):
            part = events if found is None else events.join(found.withColumnRenamed("range", "wide"), key_range(WIDTHS[0]) == F.col("wide"), "left_semi")
            sides.append(range_digests(part, width))
        a, b = sides[0].withColumnsRenamed({"n": "na", "d1": "a1", "d2": "a2"}), sides[1]
        found = settle(a.join(b, "range", "full").filter("NOT (na <=> n AND a1 <=> d1 AND a2 <=> d2)").select("range"), "replica-ranges")
    return found


def lacking(sender: DataFrame, receiver: DataFrame, ranges: DataFrame) -> DataFrame:
    """The sender's events in these ranges that the receiver hasn't, by id."""
    within = lambda events: events.join(ranges, key_range(WIDTHS[-1]) == F.col("range"), "left_semi")
    return within(sender).join(within(receiver).select("id"), "id", "left_anti")


def paged(events: DataFrame) -> DataFrame:
    """(page_id, range, page, digest, events): pages within each wide range, in order of ids."""
    sized = events.select(key_range(WIDTHS[0]).alias("range"), "id", "parents", "body", (F.octet_length("id") + F.octet_length(F.coalesce("body", F.lit("")))).alias("bytes"))
    parts = chunked(sized, ["range"], ["id"], "bytes", PAGE_BYTES, PAGE_EVENTS)
    pages = parts.groupBy("range", F.col("chunk").alias("page")).agg(F.sort_array(F.collect_list(F.struct("id", "parents", "body"))).alias("events"))
    digest = page_digest(F.col("events"))
    return pages.select(F.concat(F.lit("page:"), F.substring(digest, 1, 16)).alias("page_id"), "range", "page", digest.alias("digest"), "events")


def page_digest(events: Column) -> Column:
    nul = F.char(F.lit(0))
    each = F.transform(events, lambda e: F.concat(e["id"], nul, F.array_join(F.coalesce(e["parents"], F.array().cast("array<string>")), ","), nul, F.coalesce(e["body"], nul), nul))
    return F.sha2(F.array_join(each, ""), 256)


def page_faults(pages: DataFrame, replica: DataFrame) -> DataFrame:
    """(page_id, range, page, fault) of pages that must be refused."""
    e = F.col("events")
    size = lambda x: F.octet_length("id") if x is None else F.octet_length(x["id"]) + F.octet_length(F.coalesce(x["body"], F.lit("")))
    own = (
        F.when(F.coalesce(F.size(e), F.lit(0)) == 0, "empty page")
        .when(F.size(e) > PAGE_EVENTS, "too many events")
        .when((F.size(e) > 1) & (F.aggregate(F.transform(e, size), F.lit(0), lambda a, b: a + b) > PAGE_BYTES), "page too large")
        .when(F.exists(e, lambda x: F.coalesce(size(x) > EVENT_BYTES, F.lit(True))), "event too large")
        .when(F.exists(e, lambda x: ~F.coalesce(x["id"] == event_id(x["parents"], x["body"]), F.lit(False))), "event id isn't its digest")
        .when(F.size(F.array_distinct(F.transform(e, lambda x: x["id"]))) < F.size(e), "event twice in a page")
        .when(F.col("digest") != page_digest(e), "page digest differs")
    )
    bad = pages.select("page_id", "range", "page", own.alias("fault")).filter("fault IS NOT NULL")
    listed = pages.select("page_id", "range", "page", F.explode("events").alias("x")).select("page_id", "range", "page", F.col("x.id").alias("id"), F.col("x.body").alias("body"))
    there = replica.select("id", F.col("body").alias("known"))
    clash = listed.join(there, "id").filter("NOT (body <=> known)").select("page_id", "range", "page", F.lit("identity collision").alias("fault"))
    return bad.unionByName(clash).groupBy("page_id", "range", "page").agg(F.min("fault").alias("fault"))


def accepted(replica: DataFrame, pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(the replica with the events of sound pages, the faults of refused ones)."""
    faults = settle(page_faults(pages, replica), "replica-faults")
    sound = pages.join(faults.select("range", "page"), ["range", "page"], "left_anti")
    new = sound.select(F.explode("events").alias("x")).select("x.id", "x.parents", "x.body").dropDuplicates(["id"])
    grown = replica.select("id", "parents", "body").unionByName(new.join(replica.select("id"), "id", "left_anti"))
    return settle(grown, "replica-events"), faults


@dataclass
class Exchange:
    """Both replicas afterwards, the refused pages (to: mine or theirs), and how many rounds brought something."""

    mine: DataFrame
    theirs: DataFrame
    refused: DataFrame
    rounds: int


def exchange(mine: DataFrame, theirs: DataFrame, on_the_way: Callable[[DataFrame, str], DataFrame] | None = None) -> Exchange:
    """Rounds of comparing and paging both ways until replicas are equal or a round brings nothing.

    ``on_the_way(pages, to)`` stands for what may happen to pages between peers.
    """
    way = on_the_way or (lambda pages, to: pages)
    refused, rounds = None, 0
    while True:
        ranges = differing(mine, theirs)
        counts = mine.count(), theirs.count()
        there = settle(paged(lacking(mine, theirs, ranges)), "replica-pages")
        back = settle(paged(lacking(theirs, mine, ranges)), "replica-pages")
        theirs, no = accepted(theirs, settle(way(there, "theirs"), "replica-received"))
        mine, nor = accepted(mine, settle(way(back, "mine"), "replica-received"))
        refused = no.withColumn("to", F.lit("theirs")).unionByName(nor.withColumn("to", F.lit("mine")))
        if (mine.count(), theirs.count()) == counts:
            return Exchange(mine, theirs, refused, rounds)
        rounds += 1
