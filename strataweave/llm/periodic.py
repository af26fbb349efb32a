"""Periodic runs of words by tandem repeats, after Gusfield and Stoye.

A run is a stretch of consecutive words with smallest period q, at least ``EXPONENT`` periods and
``LEAST`` words long, that no neighbouring word extends keeping the period.

A run that long holds each of its windows of ``LEAST * (EXPONENT - 2) / EXPONENT + 1`` words twice, a period
apart, so only stretches of a text are searched whose windows of that width all occur twice, some of them
within a third of the stretch's length (found by hashes, which lose none). Many texts' stretches are laid end to end, a symbol of its own behind each, and
get one suffix tree, kept as suffix array, intervals and the equality classes of its prefix-doubling
rounds. On it:

1. The Lempel-Ziv blocks are cut. Around the start of each block, extensions to both sides give squares
   of each period in reach: a leftmost-covering set.
2. Each square whose root is primitive starts a walk: dropping its first word and appending it again is
   a suffix link and one step down the tree; as long as the place itself goes on, the walk follows it,
   and then goes on wherever else in the tree the next rotation occurs. Marked nodes end a walk. What is
   marked in the end is the vocabulary of all primitive squares.
3. The leaves below each marked node are the occurrences. Those of one period in consecutive places
   merge into a run.

Nothing is shuffled: each text is handled where it is read. A task holds one Arrow batch of texts and one
tree of ``PART`` words, or of one longer stretch; memory is linear in the longest text.

Null or blank texts have no words and no runs. Rows are judged one by one: repeated rows and rows with
a null doc_id get results of their own. Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, read
from .hashing import WordHash, mixed, windows

#: Words and periods of the shortest run.
LEAST, EXPONENT = 24, 3
#: Words of a tree, unless one stretch alone is longer.
PART = 1 << 19

NONE = np.empty(0, np.int64)


def ranges(first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, first[owner] + 0, 1, ... n[owner] - 1), one after another."""
    n = np.maximum(n, 0)
    owner = np.repeat(np.arange(len(n)), n)
    return owner, first[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)


class SuffixTree:
    """The suffix tree of ``s``, whose last symbol occurs nowhere else: suffix array, LCP intervals, prefix classes."""

    def __init__(self, s: np.ndarray):
        n = self.n = len(s)
        rank = np.unique(s, return_inverse=True)[1].astype(np.int64)
        self.symbols, self.classes, width = rank, [], 1
        while True:
            self.classes.append(np.r_[rank, -1].astype(np.int32))
            if rank.max(initial=0) >= n - 1:
                break
            ahead = np.zeros(n, np.int64)
            ahead[: n - width] = rank[width:] + 1
            rank = np.unique(rank * (n + 1) + ahead, return_inverse=True)[1].astype(np.int64)
            width *= 2
        self.rank = rank
        self.leaves = np.empty(n, np.int64)
        self.leaves[rank] = np.arange(n)
        self.lcp = np.zeros(n, np.int64)
        self.lcp[1:] = self.ahead(self.leaves[:-1], self.leaves[1:])
        self.least = [self.lcp.astype(np.int32)]
        while 2 << (len(self.least) - 1) <= n:
            low, w = self.least[-1], 1 << (len(self.least) - 1)
            self.least.append(np.minimum(low[:-w], low[w:]))

    def ahead(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How far the suffixes at i and at j, i != j, agree."""
        i, j, got = i.copy(), j.copy(), np.zeros(len(i), np.int64)
        for k in range(len(self.classes) - 1, -1, -1):
            step = (self.classes[k][i] == self.classes[k][j]).astype(np.int64) << k
            got += step
            i += step
            j += step
        return got

    def behind(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many symbols agree going left from i and from j, these included; none left of the first symbol."""
        i, j, got = i.copy(), j.copy(), np.zeros(len(i), np.int64)
        for k in range(len(self.classes) - 1, -1, -1):
            a, b = i - (1 << k) + 1, j - (1 << k) + 1
            inside = (a >= 0) & (b >= 0)
            step = (inside & (self.classes[k][np.where(inside, a, 0)] == self.classes[k][np.where(inside, b, 0)])).astype(np.int64) << k
            got += step
            i -= step
            j -= step
        return got

    def node(self, i: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last leaf below the locus of the ``depth`` symbols at i."""
        first, last = self.rank[i].copy(), self.rank[i].copy()
        for k in range(len(self.least) - 1, -1, -1):
            low, w = self.least[k], 1 << k
            at = first - w + 1
            ok = at > 0
            first -= (ok & (low[np.where(ok, at, 0)] >= depth)).astype(np.int64) << k
            ok = last + w < self.n
            last += (ok & (low[np.where(ok, last + 1, 0)] >= depth)).astype(np.int64) << k
        return first, last

    def child(self, i: np.ndarray, depth: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """A place of the ``depth`` symbols at i followed by ``symbol``; -1: none."""
        low, last = self.node(i, depth)
        high = last + 1
        while len(low) and (low < high).any():
            middle = np.minimum((low + high) // 2, last)
            less = (low < high) & (self.symbols[self.leaves[middle] + depth] < symbol)
            high = np.where(less | (low >= high), high, middle)
            low = np.where(less, middle + 1, low)
        place = self.leaves[np.minimum(low, last)]
        return np.where((low <= last) & (self.symbols[place + depth] == symbol), place, -1)

    def blocks(self) -> np.ndarray:
        """Starts of the Lempel-Ziv blocks: each is the longest that also starts further left, or one new symbol."""
        n, rank = self.n, self.rank.tolist()
        before, after, shared = list(range(-1, n - 1)), list(range(1, n + 1)), self.lcp.tolist() + [0]
        longest = [0] * n
        for i in range(n - 1, -1, -1):
            # Of the leaves still listed, those next to leaf x are the closest that start further left.
            x = rank[i]
            p, q = before[x], after[x]
            a, b = shared[x], shared[q]
            longest[i] = a if a > b else b
            if a < b:
                shared[q] = a
            if p >= 0:
                after[p] = q
            if q < n:
                before[q] = p
        starts, i = [], 0
        while i < n:
            starts.append(i)
            i += longest[i] or 1
        return np.array(starts, np.int64)


def covering(tree: SuffixTree, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, period) of a leftmost-covering set of squares of periods up to ``most``."""
    start = tree.blocks()
    size = np.diff(np.r_[start, tree.n])
    ahead = np.r_[size[1:], 0]
    found = []
    # Squares that start in a block and reach into the next one: their halves differ by k around the border.
    owner, k = ranges(np.ones(len(start), np.int64), np.where(ahead > 0, np.minimum(size, most), 0))
    border = start[owner] + size[owner]
    found.append((border, border - k, k, border - k))
    # Squares that start further left: around the block's own start.
    owner, k = ranges(np.ones(len(start), np.int64), np.minimum(np.minimum(size + ahead, tree.n - 1 - start), most))
    border = start[owner]
    found.append((border, border + k, k, border))
    starts, periods = [], []
    for x, y, k, left in found:
        right, back = tree.ahead(x, y), tree.behind(x - 1, y - 1)
        square = (right > 0) & (right + back >= k)
        starts.append(np.maximum(left - back, left - k + 1)[square])
        periods.append(k[square])
    return np.concatenate(starts), np.concatenate(periods)


def primitive(tree: SuffixTree, start: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Which squares have a root that is no power of a shorter one."""
    most = int(period.max(initial=1))
    factor = np.zeros(most + 1, np.int64)
    for p in range(2, most + 1):
        if factor[p] == 0:
            own = factor[p::p]
            own[own == 0] = p
    ok, rest = np.ones(len(start), bool), period.copy()
    while (rest > 1).any():
        r = np.where(rest > 1, factor[rest], 1)
        shorter = period // r
        try_ = np.flatnonzero(ok & (r > 1))
        ok[try_] = tree.ahead(start[try_], start[try_] + shorter[try_]) < period[try_] - shorter[try_]
        rest = np.where(rest > 1, rest // r, 1)
    return ok


def vocabulary(tree: SuffixTree, start: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a place, period) of every distinct primitive square, from a covering set by walks along suffix links."""
    span = np.int64(tree.n + 1)
    marked, place = NONE, NONE
    while len(start):
        # The place itself goes on for some rotations; all of them are on the walk.
        onward = np.minimum(tree.ahead(start, start + period) - period, period - 1)
        owner, at = ranges(start, onward + 1)
        first, _ = tree.node(at, 2 * period[owner])
        key, where = np.unique(period[owner] * span + first, return_index=True)
        new = ~np.isin(key, marked, assume_unique=True)
        marked, place = np.r_[marked, key[new]], np.r_[place, at[where[new]]]
        # Then the next rotation: the suffix link of the last one, one step down by its own first symbol.
        goes_on = onward < period - 1
        end, q = (start + onward)[goes_on], period[goes_on]
        after = tree.child(end + 1, 2 * q - 1, tree.symbols[end])
        start, period = after[after >= 0], q[after >= 0]
        first, _ = tree.node(start, 2 * period)
        key, where = np.unique(period * span + first, return_index=True)
        where = where[~np.isin(key, marked, assume_unique=True)]
        start, period = start[where], period[where]
    return place, marked // span


def runs(s: np.ndarray, most: int, least: int = LEAST, exponent: int = EXPONENT) -> np.ndarray:
    """Rows (start, length, period) of the runs of ``s``, whose last symbol occurs nowhere else, by start and period."""
    tree = SuffixTree(s)
    start, period = covering(tree, most)
    ok = primitive(tree, start, period)
    place, period = vocabulary(tree, start[ok], period[ok])
    first, last = tree.node(place, 2 * period)
    owner, leaf = ranges(first, last - first + 1)
    located = np.sort(period[owner] * np.int64(tree.n + 1) + tree.leaves[leaf])
    if not len(located):
        return np.empty((0, 3), np.int64)
    new = np.flatnonzero(np.r_[True, np.diff(located) != 1])
    q, a = np.divmod(located[new], tree.n + 1)
    length = np.diff(np.r_[new, len(located)]) - 1 + 2 * q
    out = np.stack([a, length, q], 1)[length >= np.maximum(least, exponent * q)]
    return out[np.lexsort((out[:, 2], out[:, 0]))]


def stretches(hashes: np.ndarray, doc: np.ndarray, least: int, exponent: int) -> tuple[np.ndarray, np.ndarray]:
    """(first, end) of the stretches, each in one text, that may hold a run."""
    width = least * (exponent - 2) // exponent + 1
    if len(hashes) < max(width, least):
        return NONE, NONE
    grams = windows(hashes, width) + mixed(doc[: len(hashes) - width + 1].astype(np.uint64) + np.uint64(1))
    inside = doc[: len(grams)] == doc[width - 1 :]
    order = np.argsort(grams, kind="stable")
    same = np.flatnonzero(grams[order[1:]] == grams[order[:-1]])
    low, high = order[same], order[same + 1]
    # How far the next window with the same words is.
    apart = np.full(len(grams), len(grams), np.int64)
    np.minimum.at(apart, low, high - low)
    np.minimum.at(apart, high, high - low)
    twice = inside & (apart < len(grams))
    edge = np.flatnonzero(np.diff(np.r_[False, twice, False].astype(np.int8)))
    # Two texts' stretches may touch.
    first, end = edge[::2], edge[1::2]
    cut = np.flatnonzero((doc[1 : len(grams)] != doc[: len(grams) - 1]) & twice[1:] & twice[:-1]) + 1
    first, end = np.sort(np.r_[first, cut]), np.sort(np.r_[end, cut])
    if not len(first):
        return NONE, NONE
    near = np.minimum.reduceat(apart, np.stack([first, end], 1).ravel()[: 2 * len(first) - (end[-1] == len(apart))])[::2]
    end = end + width - 1
    may = (end - first >= least) & (exponent * near <= end - first)
    return first[may], end[may]


def text_runs(texts: list[list[bytes]], hashes: WordHash, least: int = LEAST, exponent: int = EXPONENT) -> list[list[tuple[int, int, int]]]:
    """Each text's runs (start, length, period), by start and period."""
    size = np.array([len(w) for w in texts], np.int64)
    base = np.cumsum(size) - size
    doc = np.repeat(np.arange(len(texts)), size)
    flat = np.concatenate([hashes.array(w) for w in texts]) if texts else NONE.astype(np.uint64)
    first, end = stretches(flat, doc, least, exponent)
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    at = 0
    while at < len(first):
        to, words = at, 0
        while to < len(first) and (to == at or words + end[to] - first[to] < PART):
            words += int(end[to] - first[to]) + 1
            to += 1
        ids: dict[bytes, int] = {}
        parts, offset = [], []
        for k in range(at, to):
            d = int(doc[first[k]])
            own = texts[d][first[k] - base[d] : end[k] - base[d]]
            offset.append(len(parts))
            parts += [ids.setdefault(w, len(ids)) for w in own] + [-1 - k]
        most = int((end[at:to] - first[at:to]).max()) // exponent
        for a, length, q in runs(np.array(parts, np.int64), most, least, exponent).tolist():
            k = int(np.searchsorted(offset, a, side="right")) - 1
            d = int(doc[first[at + k]])
            found[d].append((a - offset[k] + int(first[at + k] - base[d]), length, q))
        at = to
    return [sorted(f, key=lambda r: (r[0], r[2])) for f in found]


def without_runs(words: list[bytes], found: list[tuple[int, int, int]]) -> list[bytes]:
    """The words outside each run and within its first period."""
    if not found:
        return words
    gone = np.zeros(len(words) + 1, np.int64)
    for start, length, q in found:
        gone[start + q] += 1
        gone[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(gone)[:-1] == 0)]


def periodic_runs(docs: DataFrame, change: Callable | None = None, least: int = LEAST, exponent: int = EXPONENT) -> DataFrame:
    """doc_id, n_words, runs (start, length, period) and kept (the words that stay, as UTF-8) of every row.

    ``change(doc_id, words)`` may give other words than the text's own.
    """
    bounded_batches(docs.sparkSession, size="8m")

    def run(batches):
        import pyarrow as pa

        hashes = WordHash()
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for batch in batches:
            texts = [(t or b"").split() for t in batch.column(1).to_pylist()]
            if change:
                texts = [change(d, w) for d, w in zip(batch.column(0).to_pylist(), texts)]
            found = text_runs(texts, hashes, least, exponent)
            rows = [[dict(zip(("start", "length", "period"), r)) for r in f] for f in found]
            kept = [b" ".join(without_runs(w, f)) for w, f in zip(texts, found)]
            sizes = pa.array([len(w) for w in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), sizes, pa.array(rows, kind), pa.array(kept, pa.binary())], names=["doc_id", "n_words", "runs", "kept"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, kept binary")


def digests(found: DataFrame) -> DataFrame:
    """The rows of ``periodic_runs`` as counts, the run of the greatest exponent and digests."""
    none = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    # Runs come by start and period, so that the first of equally great exponents stays.
    best = F.aggregate("runs", none, lambda b, r: F.when(b.isNull() | (r["length"] * b["period"] > b["length"] * r["period"]), r).otherwise(b))
    listed = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))), "\n")
    ended = F.when(F.size("runs") > 0, F.concat(listed, F.lit("\n"))).otherwise("")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(ended.cast("binary"), 256).alias("runs_sha256"), F.sha2("kept", 256).alias("collapsed_sha256"),
    )


def repeated_tail(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words of the query: of a tenth of the documents, by a hash of the id, a tail of several periods."""
    if doc_id is None or not words:
        return words
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def op11_periodic_runs(spark, sf_dir: str) -> DataFrame:
    return digests(periodic_runs(read(spark, sf_dir, "documents"), repeated_tail))
