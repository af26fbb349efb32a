"""Substring dedup through prefix-partitioned suffix trees.

A window is ``WINDOW`` consecutive words of one document. Each word is removed that a window
covers whose words also start, as a window, in a document with a smaller doc_id.

Suffixes are sampled: a window's anchor is its smallest ``GRAM``-word gram by hash, the first
among equals, so equal windows have equal anchors in the same place. Consecutive windows with
one anchor form a segment; what a segment holds to the right of the anchor is a suffix, and
the anchor's gram is the prefix that deals suffixes to groups. Only hashes move at first:
prefixes of one document alone are dropped, and equal segments (by two independent 64-bit hashes,
of copies of texts or passages) become one class of which all but the smallest document repeat as
a whole. Where a prefix has several classes, one segment of each class goes, as words, to the
prefix's subtree. Subtrees are built level by level, many prefixes at once: a node at depth d
is a class of suffixes that agree on d words. The words to the left of the anchor are refined
in the same way, and a node ``WINDOW - o`` deep whose suffixes agree on ``o`` words to the left
is a repeat of ``WINDOW`` words; its smallest doc_id keeps it.

Prefixes have variable lengths. One with more than ``GROUP`` classes is lengthened in two ways: to
the right, for windows that reach at least half as far again beyond the anchor as they must, and to
the left, for the others, which reach as far back. Every window stays within one of the two, and a
segment goes to those that it is long enough for. This is repeated, for the prefixes that are still
too large, until a prefix is a whole window: then all that its group needs is its smallest document,
aggregated before it is shuffled.

Null and blank texts have no words and lose none. Rows with a null doc_id lose no word and
take none. Rows that share a doc_id don't take words from one another, repeated rows give
repeated results. Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import bounded_batches, read, settle
from .hashing import WordHash, mixed, windows

WINDOW, GRAM = 50, 8
#: Segments of one prefix that one task handles, and of a batch of prefixes.
GROUP, BATCH = 512, 32_768
#: Words handled at a time; longer texts are cut into overlapping parts.
PART = 1 << 20


def segments(hashes: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """(gram hash, anchor, first window, last window) of each segment of a text, by word index."""
    n = len(hashes) - window + 1
    if n <= 0:
        return (np.empty(0, np.uint64), *[np.empty(0, np.int64)] * 3)
    if n > PART:
        cut = [segments(hashes[a : a + PART + window - 1], window, gram) for a in range(0, n, PART)]
        return tuple(np.concatenate([c[i] + (0 if i == 0 else k * PART) for k, c in enumerate(cut)]) for i in range(4))
    grams = windows(hashes, gram)
    span = window - gram + 1
    low = (grams & np.uint64(0xFFFFFFFFFF000000)) | np.arange(len(grams), dtype=np.uint64)
    width = 1
    while 2 * width <= span:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if width < span:
        low = np.minimum(low[: len(low) - (span - width)], low[span - width :])
    anchor = (low & np.uint64(0xFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
    last = np.r_[first[1:], n] - 1
    return grams[anchor[first]], anchor[first], first, last


def run_hashes(hashes: np.ndarray, begin: np.ndarray, end: np.ndarray, factor: int) -> np.ndarray:
    """A 64-bit hash of hashes[begin:end] for each pair, whatever its place."""
    powers = np.full(len(hashes) + 1, factor, np.uint64)
    powers[0] = 1
    back = np.full(len(hashes) + 1, pow(factor, -1, 1 << 64), np.uint64)
    back[0] = 1
    powers, back = np.cumprod(powers), np.cumprod(back)
    total = np.r_[np.uint64(0), np.cumsum(mixed(hashes ^ np.uint64(factor)) * powers[:-1])]
    return mixed((total[end] - total[begin]) * back[begin] + (end - begin).astype(np.uint64))


def _segments(window: int, gram: int):
    """(doc_id, text_id, text) -> every segment with its prefix's and its content's hashes."""

    def run(batches):
        import pyarrow as pa

        hashes = WordHash(), WordHash(1)
        names = ["key", "s1", "s2", "doc_id", "text_id", "first", "n"]
        for batch in batches:
            cols: list[list] = [[] for _ in names]
            for d, t, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                words = (text or b"").split()
                h = hashes[0].array(words)
                key, _, first, last = segments(h, window, gram)
                if len(key):
                    end = last + window
                    marks = [run_hashes(x, first, end, 0x9E3779B97F4A7C15) for x in (h, hashes[1].array(words))]
                    for c, x in zip(cols, (key, *marks, np.full(len(key), d), np.full(len(key), t), first, end - first)):
                        c.append(x.astype(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c) if c else np.empty(0, np.int64)) for c in cols], names=names)

    return run


def _cut(window: int, gram: int):
    """(doc_id, places, text) -> the segments that start at the places' ``first``, as words."""

    def run(batches):
        import pyarrow as pa

        names = ["key", "s1", "s2", "doc_id", "back", "words"]
        kinds = [pa.int64()] * 5 + [pa.binary()]
        hashes = WordHash()
        for batch in batches:
            out = []
            for d, places, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                words = (text or b"").split()
                key, anchor, first, last = segments(hashes.array(words), window, gram)
                for place in places:
                    i = int(np.searchsorted(first, place["first"]))
                    a, z = int(first[i]), int(last[i]) + window
                    out.append((int(key[i].astype(np.int64)), place["s1"], place["s2"], d, int(anchor[i]) - a, b" ".join(words[a:z])))
            cols = list(zip(*out)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)

    return run


def _refined(label: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Numbers the classes of equal (label, word)."""
    return np.unique(label * (int(words.max()) + 2) + words + 1, return_inverse=True)[1]


def subtrees(key, doc, back, texts, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(segment, window start within it) of each window that also starts in a smaller document.

    ``key``: the prefix; ``back``: words left of the anchor; ``texts``: lists of words.
    """
    n = len(key)
    size = np.array([len(t) for t in texts])
    ids: dict[bytes, int] = {}
    flat = np.fromiter((ids.setdefault(w, len(ids)) for t in texts for w in t), np.int64, int(size.sum()))
    home = np.cumsum(size) - size + back
    ahead = size - back
    left, right = int(back.max()), min(window, int(ahead.max()))
    at = np.unique(key, return_inverse=True)[1].astype(np.int64)
    deep = [at]
    for d in range(right):
        inside = d < ahead
        at = _refined(at, np.where(inside, flat[np.where(inside, home + d, 0)], -1))
        deep.append(at)
    behind = np.zeros(n, np.int64)
    who, where = [], []
    for o in range(left + 1):
        if o:
            inside = o <= back
            behind = _refined(behind, np.where(inside, flat[np.where(inside, home - o, 0)], -1))
        need = window - o
        own = np.flatnonzero((back >= o) & (ahead >= need)) if 0 <= need <= right else np.empty(0, int)
        if len(own) < 2:
            continue
        node = deep[need][own] * (int(behind.max()) + 1) + behind[own]
        order = np.lexsort((doc[own], node))
        node, own = node[order], own[order]
        start = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
        least = np.repeat(doc[own][start], np.diff(np.r_[start, len(node)]))
        repeats = own[doc[own] > least]
        who.append(repeats)
        where.append(back[repeats] - o)
    return (np.concatenate(who), np.concatenate(where)) if who else (np.empty(0, int), np.empty(0, int))


def _trees(window: int):
    def run(batches):
        import pyarrow as pa

        names = ["key", "s1", "s2", "a", "z"]

        def spans(rows):
            key, s1, s2, doc, back = (np.array([r[i] for r in rows], np.int64) for i in range(5))
            who, where = subtrees(key, doc, back, [r[5].split() for r in rows], window)
            order = np.lexsort((where, who))
            who, where = who[order], where[order]
            new = np.r_[True, (who[1:] != who[:-1]) | (where[1:] != where[:-1] + 1)] if len(who) else np.empty(0, bool)
            start = np.flatnonzero(new)
            stop = np.r_[start[1:], len(who)] - 1
            cols = [key[who[start]], s1[who[start]], s2[who[start]], where[start], where[stop] + window] if len(who) else [[]] * 5
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=names)

        rows: list[tuple] = []
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(6))):
                if len(rows) >= BATCH and row[0] != rows[-1][0]:
                    yield spans(rows)
                    rows = []
                rows.append(row)
        if rows:
            yield spans(rows)

    return run


def _lengthened(window: int):
    """Each segment under the longer prefixes that it has: ``right`` words from the anchor on and ``left`` before it.

    A prefix of (right, left) words is shared by windows that reach ``right`` words from the anchor
    or more and ``left`` back or more. The middle of that range splits it in two.
    """

    def run(batches):
        import pyarrow as pa
        from xxhash import xxh64_intdigest

        names = ["key", "s1", "s2", "doc_id", "back", "words", "right", "left", "check"]
        kinds = [pa.int64()] * 5 + [pa.binary()] + [pa.int32()] * 2 + [pa.int64()]
        signed = lambda x: x - (1 << 64) if x >> 63 else x
        for batch in batches:
            out = []
            for _, s1, s2, d, back, text, right, left in zip(*(batch.column(i).to_pylist() for i in range(8))):
                words = text.split()
                middle = (right + window - left + 1) // 2
                for r, k in ((middle, left), (right, window - middle + 1)):
                    if back >= k and len(words) - back >= r:
                        prefix = b" ".join(words[back - k : back + r])
                        key, check = (signed(xxh64_intdigest(prefix, seed + 128 * r + k)) for seed in (0, 1 << 20))
                        out.append((key, s1, s2, d, back, text, r, k, check))
            cols = list(zip(*out)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)

    return run


def _kept(batches):
    import pyarrow as pa

    for batch in batches:
        sizes, gone, kept, digests = [], [], [], []
        for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            words = (text or b"").split()
            sizes.append(len(words))
            if spans:
                stay = np.zeros(len(words) + 1, np.int32)
                cut = np.array([(s["a"], s["z"]) for s in spans])
                np.add.at(stay, cut[:, 0], 1)
                np.add.at(stay, cut[:, 1], -1)
                words = [words[i] for i in np.flatnonzero(np.cumsum(stay)[:-1] == 0)]
            gone.append(sizes[-1] - len(words))
            kept.append(b" ".join(words))
            digests.append(hashlib.sha256(kept[-1]).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()), pa.array(digests, pa.string()), pa.array(kept, pa.binary())],
            names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"],
        )


def repeated(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(doc_id, text_id, spans): the words to remove; ``text_id`` is xxhash64 of the text."""
    rows = docs.filter("doc_id IS NOT NULL AND text IS NOT NULL").select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_id"), F.col("text").cast("binary").alias("text")
    )
    mark = ["key", "s1", "s2"]
    schema = "key long, s1 long, s2 long, doc_id long, text_id long, first long, n long"
    found = settle(rows.mapInArrow(_segments(window, gram), schema), "sub-segments")
    # Equal segments are one class: all but those of its smallest document repeat as a whole.
    classes = found.groupBy(*mark).agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
    prefix = classes.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.min("least").alias("x"), F.max("most").alias("y"))
    prefix = settle(prefix.filter("x < y"), "sub-prefixes")
    classes = settle(classes.join(prefix.select("key", "m"), "key"), "sub-classes")
    met = found.join(classes, mark).filter("doc_id > least OR m > 1")
    met = settle(met, "sub-met")
    spans = met.filter("doc_id > least").select("doc_id", "text_id", F.col("first").alias("a"), (F.col("first") + F.col("n")).alias("z"))

    # Different segments of one prefix may share windows: one of each class goes to the prefix's subtree.
    home = met.filter("doc_id = least AND m > 1").select(*mark, "doc_id", "text_id", "first", "n")
    chosen = home.groupBy(*mark, "doc_id").agg(F.min("text_id").alias("text_id"))
    places = home.join(chosen, [*mark, "doc_id", "text_id"]).groupBy(*mark, "doc_id", "text_id").agg(F.min("first").alias("first"))
    wanted = places.groupBy("doc_id", "text_id").agg(F.collect_list(F.struct("first", "s1", "s2")).alias("places"))
    texts = rows.join(settle(wanted, "sub-wanted"), ["doc_id", "text_id"]).select("doc_id", "places", "text")
    dealt = settle(texts.mapInArrow(_cut(window, gram), "key long, s1 long, s2 long, doc_id long, back long, words binary"), "sub-words")
    schema = "key long, s1 long, s2 long, doc_id long, back long, words binary, right int, left int, check long"
    groups, windows_alone = [], []
    rest = dealt.select("*", F.lit(gram).alias("right"), F.lit(0).alias("left"))
    many = settle(prefix.filter(F.col("m") > GROUP).select("key"), "sub-many")
    while many.take(1):
        groups.append(rest.join(many, "key", "left_anti"))
        longer = settle(rest.join(many, "key", "left_semi").mapInArrow(_lengthened(window), schema), "sub-longer")
        windows_alone.append(longer.filter(F.col("right") + F.col("left") == window))
        rest = longer.filter(F.col("right") + F.col("left") < window).drop("check")
        many = settle(rest.groupBy("key").agg(F.count(F.lit(1)).alias("m")).filter(F.col("m") > GROUP).select("key"), "sub-many")
    groups.append(rest)
    columns = ["key", "s1", "s2", "doc_id", "back", "words"]
    few = reduce(DataFrame.unionAll, [g.select(*columns) for g in groups])
    shared = few.repartition("key").sortWithinPartitions("key").mapInArrow(_trees(window), "key long, s1 long, s2 long, a long, z long").select("s1", "s2", "a", "z")
    if windows_alone:
        alone = reduce(DataFrame.unionAll, windows_alone)
        least = alone.groupBy("key", "check").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).filter("least < most")
        again = alone.join(settle(least, "sub-least"), ["key", "check"]).filter("doc_id > least")
        start = F.col("back") - F.col("left")
        shared = shared.unionAll(again.select("s1", "s2", start.alias("a"), (start + window).alias("z")))
    shared = settle(shared, "sub-shared")
    parts = home.join(shared, ["s1", "s2"]).select("doc_id", "text_id", (F.col("first") + F.col("a")).alias("a"), (F.col("first") + F.col("z")).alias("z"))
    return spans.unionByName(parts).groupBy("doc_id", "text_id").agg(F.collect_list(F.struct("a", "z")).alias("spans"))


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and kept (the words that stay, as UTF-8) of every row."""
    bounded_batches(docs.sparkSession)
    gone = settle(repeated(docs, window), "sub-gone").withColumnsRenamed({"doc_id": "d", "text_id": "t"})
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_id"), F.col("text").cast("binary").alias("text"))
    joined = rows.join(gone, (F.col("doc_id") == F.col("d")) & (F.col("text_id") == F.col("t")), "left")
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept binary"
    return joined.select("doc_id", "text", "spans").mapInArrow(_kept, schema)


def _cut_out(batches):
    """(doc, text, spans) -> (doc, what stays of the text, with its own white space inside each run of words)."""
    import re

    import pyarrow as pa

    word = re.compile(rb"[^\x20\x09-\x0D]+")
    for batch in batches:
        texts = []
        for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            if spans:
                places = [m.span() for m in word.finditer(text)]
                gone = np.zeros(len(places) + 1, np.int32)
                for s in spans:
                    gone[s["a"]] += 1
                    gone[s["z"]] -= 1
                stays = np.flatnonzero(np.cumsum(gone)[:-1] == 0)
                cuts = np.flatnonzero(np.diff(stays) > 1)
                runs = [(int(r[0]), int(r[-1])) for r in np.split(stays, cuts + 1) if len(r)]
                text = b"\n".join(text[places[a][0] : places[z][1]] for a, z in runs)
            texts.append(text)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.binary())], names=["doc", "text"])


def without_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` with the repeated words cut out of ``text``; documents of which nothing stays go.

    Other columns pass through, whatever their names.
    """
    bounded_batches(docs.sparkSession)
    gone = settle(repeated(docs, window), "sub-gone").withColumnsRenamed({"doc_id": "d", "text_id": "t"})
    rest = [c for c in docs.columns if c != "text"]
    rows = docs.select(F.struct(*rest).alias("doc"), F.col("text"))
    joined = rows.join(gone, (F.col("doc.doc_id") == F.col("d")) & (F.xxhash64("text") == F.col("t")), "left")
    joined = joined.select("doc", F.col("text").cast("binary").alias("text"), "spans")
    schema = StructType([joined.schema["doc"], joined.schema["text"]])
    left = joined.mapInArrow(_cut_out, schema).withColumn("text", F.col("text").cast("string")).filter("text IS NULL OR text <> ''")
    return left.select(*(F.col("text") if c == "text" else F.col("doc")[c].alias(c) for c in docs.columns))


def op1_substring(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(read(spark, sf_dir, "documents")).drop("kept")
