"""Language-model scores by logistic context mixing over hashed contexts.

A text is a sequence of words and one end. Each token is coded in binary decisions:

* is the next phrase (words up to one whose hash ends it) the one that most often followed
  the phrase before in training; if so, its words need no more bits;
* else the token is told in one of two ways, whose chances add up:
  as a word of the vocabulary, by the bits of its path through a binary tree. The upper eight
  levels tell its group, by a hash. Five predictors see each of their nodes: all training tokens,
  those in the state's language part, in the state, after the hashed word before, and after it in the state. A
  state is what the text has shown so far: the last letter outside ASCII (hashed) and how
  the word before ended. Below, where the tree tells words of a group apart, the first three see a node;
  or spelt, by the bits of its bytes and of a final space, from predictors with the hashed last
  one to four bytes as contexts, counted over the vocabulary. A novel word has only this way.

Predictions are stretched and mixed with weights that the predictors' confidence gates. For the
groups, learners go once through all training tokens, gathered by context and group, each through a piece of
the hashed words, adjust weights after each bit of a batch, and are averaged. Below, passes
over all (word, state) pairs of training fit the weights. For the spelling,
learners go once through all words that occur once in training, adjust weights and an adaptive
probability map after each small batch, and are averaged; learners grow in number with those
words, each goes through the buckets dealt to it. A word's own counts are left out while learning
from it, and a training text's own occurrence from its groups and phrases. Each decision's two chances sum to one, so the bits of a text add up to its code
length: ``score`` is the log10 probability, and ``bits_per_byte`` relates it to the text's bytes.
All weights are frozen before scoring begins.

Learning takes all documents with crc32(doc_id) mod 5 other than 1. Chunks of documents send
their distinct (state, word) pairs with counts to the words' buckets and get a cost for each
back, so words, not tokens, are shuffled, and no word is hot. A task goes through a bucket's rows
one by one and holds the bucket's part of the vocabulary, not its rows. Only tables of bounded
size reach the driver: bucket totals, hashed byte contexts and the groups' bits by hashed word before. A chunk is named by a digest of its
documents, so costs can't meet other words than those asked for; an input that isn't a plain scan
of files is written before it is read twice.

Null text is an empty one (the end alone). A null doc_id is neither learned from nor held out.
Repeated rows are learned from and scored one by one. Other columns are ignored. Without
training documents every token is novel. An empty table gives no rows.
"""

from __future__ import annotations

import math
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import _chunks, _pack_docs
from .common import LOWER, bounded_batches, input_bytes, read, settle, stable
from .hashing import MULTIPLIER, mixed

FOLDS, HELD = 5, 1
CHUNK_BYTES = 8 << 20
#: Words a batch of a spelling learner, and words that call for one more learner.
BATCH, LEARNER = 512, 50_000
#: Pairs of chunks whose costs are found together, and words in one row of the vocabulary.
ASKED, WORDS = 1 << 17, 1 << 16
LANGS, STYLES = 7, 4
STATES = LANGS * STYLES
#: log2 of the hashed contexts: the last one, two, three (with the token's context) and four bytes.
CONTEXTS = (12, 14, 15, 14)
#: Pairs that are held at once while the word mixer learns; a pass goes over all.
LEARN = 1 << 16
#: The largest count in one entry of the vocabulary.
MOST = 1 << 30
#: What is added to 32-bit counters (adding other kinds of numbers in place is ten times slower).
ONE = np.int32(1)
#: Weight of the wider predictor's chance within the narrower one.
KAPPA = 1.5
#: Mixed predictions of a spelling's bit stay within this (stretched), 1e-4 from certainty.
LIMIT = float(np.log((1 - 1e-4) / 1e-4))
WIDEST = float(np.log((1 - 1e-6) / 1e-6))
#: One word in ``1 << PHRASE`` ends a phrase; predictions of phrases have ``GATES`` degrees of trust.
PHRASE, GATES = 4, 8
#: Groups of buckets, log2 of the hashed words before, pieces of their tables, cells that move the weights at once.
GROUPS, BEFORE, PIECES, CELLS = 256, 10, 16, 4096
END = b""


def is_train(doc_id) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % FOLDS != HELD


class _Index(dict):
    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


_ASCII = bytes(range(128))
_MANNER = np.array([1 if chr(b).isalnum() or b > 127 or b == ord(",") else 0 if chr(b) in ".!?" else 2 for b in range(256)])


def _tongue(word: bytes) -> int:
    """The bucket of the word's last letter outside ASCII, cases folded for Latin-1; -1 without one."""
    rest = word.translate(None, _ASCII)
    if len(rest) < 2 or rest[-2] in (0xC2, 0x80, 0x81):  # signs and punctuation
        return -1
    return (rest[-2] * 7 + (rest[-1] | 0x20 if rest[-2] == 0xC3 else rest[-1])) * 40503 % 65521 % (LANGS - 1)


def word_classes(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For each word: ``_tongue``, and how it ends (0 sentence or none, 1 plain, 2 sign, 3 all capitals)."""
    lang = np.full(len(words), -1)
    other = np.flatnonzero(~np.fromiter(map(bytes.isascii, words), bool, len(words)))
    lang[other] = [_tongue(words[i]) for i in other]
    style = _MANNER[np.frombuffer(b"".join([w[-1:] or b"." for w in words]), np.uint8)]
    upper = np.fromiter(map(bytes.isupper, words), bool, len(words)) & (np.fromiter(map(len, words), np.int64, len(words)) > 1)
    style[(style == 1) & upper] = 3
    return lang, style


def tokens(texts: list[bytes]):
    """(distinct words, token word numbers, token states, token counts of each text)."""
    index = _Index({END: 0})
    parts, sizes = [], []
    for text in texts:
        words = text.split()
        words.append(END)
        parts.append(np.fromiter(map(index.__getitem__, words), np.int32, len(words)))
        sizes.append(len(words))
    tok, size = np.concatenate(parts), np.array(sizes)
    words = list(index)
    lang, style = word_classes(words)
    begin = np.repeat(np.cumsum(size) - size, size)
    place = np.arange(len(tok))
    last = np.maximum.accumulate(np.where(lang[tok] >= 0, place, -1))
    before = np.r_[-1, last[:-1]]
    known = before >= begin
    tongue = np.where(known, lang[tok[np.where(known, before, 0)]], LANGS - 1)
    manner = np.where(place > begin, style[tok[place - 1]], 0)
    return words, tok, tongue * STYLES + manner, size


def phrases(h: np.ndarray, tok: np.ndarray, size: np.ndarray):
    """(hash of the phrase before or 0, hash, first token, text number) of each phrase.

    A phrase ends where a text does, and after each word whose hash says so: one in
    ``1 << PHRASE`` of all words, the same ones in every text. ``h``: hashes of the words.
    """
    ends = ((h & np.uint64((1 << PHRASE) - 1)) == 0)[tok]
    ends[np.cumsum(size) - 1] = True
    first = np.r_[0, np.flatnonzero(ends)[:-1] + 1]
    length = np.diff(np.r_[first, len(tok)])
    offset = np.arange(len(tok)) - np.repeat(first, length)
    powers = np.full(int(length.max()) + 1, MULTIPLIER, np.uint64)
    with np.errstate(over="ignore"):
        powers = np.cumprod(powers)
        code = mixed(np.add.reduceat(h[tok] * powers[offset], first)) | np.uint64(1)
    text = np.repeat(np.arange(len(size)), size)[first]
    before = np.where(np.r_[False, text[1:] == text[:-1]], np.r_[np.uint64(0), code[:-1]], np.uint64(0))
    return before, code, first, text


def dealt(h: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each hash. A bucket has whole groups, or beyond ``GROUPS`` buckets a group has whole buckets."""
    group, rest = grouped(h), (h >> np.uint64(40) & np.uint64(0xFFFF)).astype(np.int64)
    start = group * buckets // GROUPS
    return start + (rest * ((group + 1) * buckets // GROUPS - start) >> 16)


def grouped(h: np.ndarray) -> np.ndarray:
    """The group of each hash."""
    return (h >> np.uint64(56)).astype(np.int64)


def _cells(h: np.ndarray, tok: np.ndarray, state: np.ndarray) -> np.ndarray:
    """The hashed word before, the state and the group of each token as one number."""
    hashed = ((h >> np.uint64(20)) & np.uint64((1 << BEFORE) - 1)).astype(np.int32)
    before = hashed[np.r_[0, tok[:-1]]]  # a text begins after an end
    return (before * STATES + state.astype(np.int32)) * GROUPS + grouped(h).astype(np.int32)[tok]


def _links(before, code, train, buckets):
    """Distinct (phrase before, phrase) in bucket order with training counts, and each phrase's place."""
    own = np.flatnonzero(before)
    pair = np.stack([before[own], code[own]], axis=1)
    order = np.lexsort((pair[:, 1], pair[:, 0], dealt(pair[:, 0], buckets)))
    pair, seen = pair[order], train[own][order]
    new = np.r_[True, (pair[1:] != pair[:-1]).any(axis=1)] if len(pair) else np.empty(0, bool)
    number = np.cumsum(new) - 1
    place = np.full(len(before), -1)
    place[own[order]] = number
    count = np.bincount(number, weights=seen, minlength=int(new.sum())).astype(np.int64)
    return pair[new], count, place


class Phrases:
    """What follows what: distinct (before, code) with training counts above 0, sorted by both."""

    def __init__(self, before: np.ndarray, code: np.ndarray, count: np.ndarray):
        self.code, self.count = code, count
        first = np.r_[True, before[1:] != before[:-1]] if len(before) else np.empty(0, bool)
        start = np.flatnonzero(first)
        self.before = before[start]
        self.end = np.r_[start[1:], len(before)] if len(start) else start
        self.start = start
        group = np.cumsum(first) - 1
        order = np.lexsort((code, -count, group))
        top, after = order[start], order[np.minimum(start + 1, max(0, len(order) - 1))] if len(start) else start
        self.top, self.best = code[top], count[top]
        self.total = np.add.reduceat(count, start) if len(start) else start
        self.second = np.where(self.end - start > 1, count[after], 0) if len(start) else start
        # Pairs in one sorted key, to find a pair's count.
        key = before * MULTIPLIER + code
        self.order = np.argsort(key, kind="stable")
        self.key = key[self.order]

    def _found(self, sorted_keys, wanted):
        at = np.minimum(np.searchsorted(sorted_keys, wanted), max(0, len(sorted_keys) - 1))
        return at, sorted_keys[at] == wanted

    def ask(self, before: np.ndarray, code: np.ndarray):
        """What a held-out and a training text see at each (before, code).

        0: nothing is predicted; else 1 + 2 * gate + (the prediction is right). A training text's
        own occurrence is left out of its counts.
        """
        if not len(self.before):
            return np.zeros(len(before), np.int64), np.zeros(len(before), np.int64)
        g, known = self._found(self.before, before)
        at, there = self._found(self.key, before * MULTIPLIER + code)
        count = np.where(there, self.count[self.order[at]], 0)
        n, best, second = (np.where(known, x[g], 0) for x in (self.total, self.best, self.second))
        is_top = known & (self.top[g] == code)

        def coded(n, best, hit):
            gate = np.digitize(n, (2, 3, 5)) * 2 + (4 * best >= 3 * n)
            return np.where(n > 0, 1 + 2 * gate + hit, 0)

        stays = is_top & (count - 1 >= np.maximum(second, 1))
        left = np.where(is_top, np.maximum(count - 1, second), best)
        return coded(n, best, is_top), np.where(count > 0, coded(n - 1, left, stays), 0)


def _pairs(texts: list[bytes], train: np.ndarray, buckets: int, lower: bool):
    """The chunk's (word, state) pairs in bucket order, and each token's place among them."""
    from xxhash import xxh64_intdigest

    words, tok, state, size = tokens([t.translate(LOWER) for t in texts] if lower else texts)
    h = np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words))
    code = tok.astype(np.int64) * STATES + state
    mark = np.zeros(len(words) * STATES, bool)
    mark[code] = True
    found = np.flatnonzero(mark)
    number = np.empty(len(mark), np.int32)
    number[found] = np.arange(len(found))
    inverse = number[code]
    del mark, number, code
    count = np.bincount(inverse, weights=np.repeat(train, size).astype(float), minlength=len(found)).astype(np.int64)
    word = found // STATES
    bucket = dealt(h, buckets)[word]
    order = np.argsort(bucket, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    before, phrase, first, text = phrases(h, tok, size)
    links = (*_links(before, phrase, train[text], buckets), first, text)
    return words, word[order], (found % STATES)[order], count[order], bucket[order], rank[inverse], size, links, _cells(h, tok, state)


def _zipped(raw: bytes) -> bytes:
    import pyarrow as pa

    return struct.pack("<q", len(raw)) + pa.Codec("zstd", 3).compress(raw, asbytes=True)


def _unzipped(blob: bytes) -> bytes:
    import pyarrow as pa

    return pa.Codec("zstd", 3).decompress(blob[8:], struct.unpack("<q", blob[:8])[0], asbytes=True)


def _pack_pairs(buckets: int, lower: bool):
    def run(batches):
        import pyarrow as pa

        _forget()
        kinds = [pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
        names = ["bucket", "chunk", "words", "pairs", "links"]
        seen_cells = np.zeros((PIECES, (STATES * GROUPS << BEFORE) // PIECES), np.int32)
        for chunk, ids, texts in _chunks(batches, CHUNK_BYTES):
            learned = np.array([is_train(i) for i in ids])
            words, word, state, count, bucket, _, size, links, cells = _pairs(texts, learned, buckets, lower)
            np.add.at(seen_cells.ravel(), cells[np.repeat(learned, size)].astype(np.int64), ONE)
            pair, seen = links[:2]
            edges = np.searchsorted(dealt(pair[:, 0], buckets), np.arange(buckets + 1))
            bounds = np.searchsorted(bucket, np.arange(buckets + 1))
            rows = []
            for b in range(buckets):
                (a, z), (c, d) = bounds[b : b + 2], edges[b : b + 2]
                if a == z and c == d:
                    continue
                new = np.diff(word[a:z], prepend=-1) > 0  # words of a bucket lie in order
                own, local = word[a:z][new], np.cumsum(new) - 1
                table = np.concatenate([local, state[a:z], count[a:z]]).astype(np.int32).tobytes()
                link = pair[c:d, 0].tobytes() + (pair[c:d, 1] >> np.uint64(32)).astype(np.uint32).tobytes() + seen[c:d].astype(np.int32).tobytes()
                rows.append((b, chunk, *((_zipped(b"\n".join(words[i] for i in own)), _zipped(table)) if a < z else (None, None)), link))
            cols = list(zip(*rows))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)
            pa.default_memory_pool().release_unused()
        # Cells of a task go in pieces, by their distances from one another.
        for piece, part in enumerate(seen_cells):
            if len(filled := np.flatnonzero(part)):
                table = np.stack([np.diff(filled, prepend=0), part[filled]]).astype("<i4")
                blob = _zipped(np.ascontiguousarray(table.view(np.uint8).reshape(-1, 4).T).tobytes())
                yield pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip((-1 - piece, 0, None, blob, None), kinds)], names=names)

    return run


def _link(blob: bytes):
    k = len(blob) // 16
    if not k:
        return np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, np.int64)
    columns = np.frombuffer(blob, np.uint64, k), np.frombuffer(blob, np.uint32, k, 8 * k), np.frombuffer(blob, np.int32, k, 12 * k)
    return columns[0], columns[1].astype(np.uint64), columns[2].astype(np.int64)


class _Sum:
    """Sums counts of equal keys (one or two columns); holds the distinct keys and as many rows again."""

    def __init__(self, columns: int):
        self.rows = [np.empty((0, columns), np.uint64)], [np.empty(0, np.int64)]
        self.distinct = self.size = 0

    def add(self, *columns_and_count) -> None:
        *columns, count = columns_and_count
        self.rows[0].append(np.stack([c.astype(np.uint64) for c in columns], axis=1))
        self.rows[1].append(count.astype(np.int64))
        self.size += len(count)
        if self.size > max(LEARN, 2 * self.distinct):
            self.done()

    def done(self) -> tuple[np.ndarray, ...]:
        """The columns, sorted, and their counts."""
        keys, counts = np.concatenate(self.rows[0]), np.concatenate(self.rows[1])
        order = np.lexsort(keys.T[::-1])
        keys = keys[order]
        start = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1)]) if len(keys) else np.empty(0, int)
        keys, counts = keys[start], np.add.reduceat(counts[order], start) if len(start) else counts
        self.rows, self.distinct, self.size = ([keys], [counts]), len(keys), len(keys)
        return *keys.T, counts


class _Bucket:
    """One bucket's part of the vocabulary as its rows come in: words, and counts by word and state."""

    def __init__(self):
        self.index, self.pairs, self.links = _Index(), _Sum(1), _Sum(2)

    def places(self, words: bytes | None) -> np.ndarray:
        found = _unzipped(words).split(b"\n") if words is not None else []
        return np.fromiter(map(self.index.__getitem__, found), np.int64, len(found))

    def add(self, words: bytes | None, pairs: bytes | None, links: bytes | None) -> None:
        if pairs is not None:
            at = self.places(words)
            local, state, count = np.frombuffer(_unzipped(pairs), np.int32).reshape(3, -1)
            self.pairs.add((at[local] * STATES + state)[count > 0], count[count > 0])
        if links:
            before, code, count = _link(links)
            self.links.add(before[count > 0], code[count > 0], count[count > 0])


def _by_bucket(batches, columns: int) -> Iterator[tuple]:
    """(bucket, rows so far of it, is it the last of them) in pieces, for batches in bucket order."""
    bucket, rows = None, []
    for batch in batches:
        for b, *row in zip(*(batch.column(i).to_pylist() for i in range(columns))):
            if b != bucket and bucket is not None:
                yield bucket, rows, True
                rows = []
            elif len(rows) >= 256:
                yield bucket, rows, False
                rows = []
            bucket = b
            rows.append(row)
    if bucket is not None:
        yield bucket, rows, True


def _byte_slots(words: list[bytes], states: np.ndarray):
    """(contexts of each order, next byte, bytes a word) for the words, each with a final space."""
    raw = np.frombuffer(b"".join(b"    " + w + b" " for w in words), np.uint8).astype(np.uint32)
    sizes = np.array([len(w) + 1 for w in words])
    begin = np.cumsum(sizes + 4) - sizes
    at = np.repeat(begin - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
    one, two, three, four = (raw[at - k] for k in (1, 2, 3, 4))
    state = np.repeat(states.astype(np.uint32), sizes)
    start = at == np.repeat(begin, sizes)
    shown = (state // STYLES) * np.uint32(5) + np.where(start, state % STYLES, STYLES).astype(np.uint32)
    hashed = lambda x, bits: (x ^ (x >> np.uint32(15))) * np.uint32(0x9E3779B1) >> np.uint32(32 - bits)
    with np.errstate(over="ignore"):
        x = shown * np.uint32(0x85EBCA77) + one * np.uint32(0xC2B2AE3D)
        y = x + two * np.uint32(0x27D4EB2F)
        z = y + three * np.uint32(0x165667B1)
        far = ((one * np.uint32(31) + two) * np.uint32(0x01000193) + three) * np.uint32(0x01000193) + four + np.uint32(9)
        contexts = [hashed(v, b) for v, b in zip((x, y, z, far * np.uint32(0x2545F491)), CONTEXTS)]
    return contexts, raw[at], sizes


FACTS = "kind int, a int, b long, n long, words binary, pairs binary"


def _statistics(batches):
    """Facts of each bucket, by kind: 0 tokens by state, 1 words that occur once by state, 2 distinct words,
    3 counters of byte contexts, 4 words with their counts, 5 predictions of phrases, 6 linked phrases;
    of each piece: 7 counts by word before, state and group, 8 their sums by state and group."""
    import pyarrow as pa

    _forget()
    slots = [np.zeros(1 << (b + 8), np.int32) for b in CONTEXTS]
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
    names = [x.split()[0] for x in FACTS.split(", ")]

    def facts(bucket: int, found: _Bucket):
        out: list[tuple] = []
        before, code, count = found.links.done()
        if len(count):
            _, own = Phrases(before, code, count).ask(before, code)
            out += [(5, code, 0, int(n), None, None) for code, n in enumerate(np.bincount(own, weights=count)) if code and n]
        for at in range(0, len(count), 1 << 20):
            part = slice(at, at + (1 << 20))
            raw = before[part].tobytes() + code[part].astype(np.uint32).tobytes() + np.minimum(count[part], 1 << 30).astype(np.int32).tobytes()
            out.append((6, bucket, at, len(count[part]), None, _zipped(raw)))
        key, count = found.pairs.done()
        word, state = (key // STATES).astype(np.int64), (key % STATES).astype(np.int64)
        words = list(found.index)
        each = np.bincount(word, weights=count, minlength=len(words)).astype(np.int64)
        out += [(0, bucket, s, int(n), None, None) for s, n in enumerate(np.bincount(state, weights=count)) if n]
        out += [(1, 0, s, int(n), None, None) for s, n in enumerate(np.bincount(state[each[word] == 1])) if n]
        out.append((2, bucket, 0, int((each > 0).sum()), None, None))
        own = np.flatnonzero(each)
        place = np.zeros(len(words), np.int64)
        place[own] = np.arange(len(own))
        for at in range(0, len(own), WORDS):
            mine = own[at : at + WORDS]
            a, z = np.searchsorted(word, [mine[0], mine[-1] + 1])
            # A count that 32 bits don't hold is told in parts, which _Bucket sums.
            times = np.maximum(1, -(-count[a:z] // MOST))
            part = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            told = np.minimum(np.repeat(count[a:z], times) - part * MOST, MOST)
            table = np.concatenate([np.repeat(place[word[a:z]] - at, times), np.repeat(state[a:z], times), told]).astype(np.int32)
            out.append((4, bucket, at, int((each[mine] == 1).sum()), _zipped(b"\n".join(words[i] for i in mine)), _zipped(table.tobytes())))
            for low in range(a, z, 100_000):
                part = slice(low, min(z, low + 100_000))
                contexts, byte, _ = _byte_slots([words[i] for i in word[part]], state[part])
                for slot, context in zip(slots, contexts):
                    np.add.at(slot, context.astype(np.int64) * 256 + byte, ONE)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

    found, cells = _Bucket(), None
    for bucket, rows, last in _by_bucket(batches, 4):
        if bucket < 0:
            cells = np.zeros((STATES * GROUPS << BEFORE) // PIECES, np.int64) if cells is None else cells
            for _, pairs, _ in rows:
                raw = np.frombuffer(_unzipped(pairs), np.uint8).reshape(4, -1)
                step, n = np.ascontiguousarray(raw.T).view("<i4").reshape(2, -1)
                cells[np.cumsum(step)] += n
            if last:
                wide = cells.reshape(-1, STATES, GROUPS).sum(axis=0)
                state, group = np.nonzero(wide)
                out = [(8, int(a), int(b), int(wide[a, b]), None, None) for a, b in zip(state, group)]
                out.append((7, -1 - bucket, 0, int(cells.sum()), None, _zipped(cells.tobytes())))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)
                cells = None
            continue
        for row in rows:
            found.add(*row)
        if last:
            yield facts(bucket, found)
            found = _Bucket()
    for order, slot in enumerate(slots):
        filled = np.flatnonzero(slot)
        for at in range(0, len(filled), 50_000):
            part = filled[at : at + 50_000]
            cells = [np.full(len(part), 3), np.full(len(part), order), part, slot[part]]
            nothing = pa.nulls(len(part), pa.binary())
            yield pa.RecordBatch.from_arrays([*(pa.array(c.astype(np.int64)).cast(k) for c, k in zip(cells, kinds)), nothing, nothing], names=names)


def stretch(p):
    return np.log(p / (1 - p))


def level(n: np.ndarray, width: int, most: int) -> np.ndarray:
    """log2(n + 1) in whole steps of ``width``, ``most`` at most."""
    return np.searchsorted(np.array([(1 << (width * (k + 1))) - 1 for k in range(most)], n.dtype), n, side="right")


def counted(n1: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The stretched prediction of a counter, between 1e-6 and its counterpart."""
    return np.clip(np.log((n1 + np.float32(0.05)) / (n - n1 + np.float32(0.05))), -WIDEST, WIDEST)


def squash(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Tree:
    """Bits of known words in a state, by the path of a row of ``counts`` (words by states).

    Every row must have a count. Three predictors see a node: all tokens, those of the state's
    language part, those of the state. Their weights are gated by how often state and language
    part were seen there and learned on all training pairs, own token left out: ``steps`` passes,
    a gradient step after each level of the tree.
    """

    def __init__(self, counts: np.ndarray, steps: int = 4):
        m = self.words = len(counts)
        running = lambda x: np.concatenate([np.zeros((1, x.shape[1]), np.int64), np.cumsum(x, axis=0)])
        wide = counts.reshape(m, LANGS, STYLES).sum(axis=2)
        self.tables = [running(wide.sum(axis=1, keepdims=True)), running(wide), running(counts)]
        self.depth = max(1, int(m - 1).bit_length())
        self.weights = np.tile([0.05, 0.25, 0.7], (64, 1))
        tw, ts = np.nonzero(counts)
        tc = counts[tw, ts].astype(float)
        kept: dict = {}  # what a level sees is the same in each pass, and kept where the pairs are few
        for _ in range(steps):
            for d in range(self.depth):
                gain, mass = np.zeros((64, 3)), np.full(64, 200.0)
                for at in range(0, len(tw), LEARN):
                    if d in kept:
                        b, c, x, gate = kept[d]
                    else:
                        part = slice(at, at + LEARN)
                        live, bit, seen = self._level(d, tw[part], ts[part])
                        several = seen[0][0] > 1
                        b, seen = bit[several].astype(float), [(n[several], n1[several]) for n, n1 in seen]
                        c = tc[part][live][several]
                        x, gate = self._inputs(seen, b)
                        if len(tw) <= LEARN // 2:
                            kept[d] = b, c, x, gate
                    error = (b - squash(np.einsum("ij,ij->i", x, self.weights[gate]))) * c
                    mass += np.bincount(gate, weights=c, minlength=64)
                    for k in range(3):
                        gain[:, k] += np.bincount(gate, weights=error * x[:, k], minlength=64)
                self.weights += 0.05 * gain / mass[:, None]

    def _level(self, d, w, s):
        depth, m = self.depth, self.words
        lo = (w >> (depth - d)) << (depth - d)
        half = 1 << (depth - d - 1)
        mid, hi = np.minimum(lo + half, m), np.minimum(lo + 2 * half, m)
        live = mid < hi
        bit = (w >= mid)[live]
        lo, mid, hi = lo[live], mid[live], hi[live]
        seen = []
        for t, column in zip(self.tables, (np.zeros(len(lo), int), s[live] // STYLES, s[live])):
            end = t[hi, column]
            seen.append((end - t[lo, column], end - t[mid, column]))
        return live, bit, seen

    def _inputs(self, seen, own):
        p, x, left = 0.5, [], 0 if isinstance(own, int) else 1
        for (n, n1), prior in zip(seen, (0.01, KAPPA, KAPPA)):
            p = (n1 - own + prior * p) / (n - left + prior)
            x.append(stretch(np.clip(p, 1e-9, 1 - 1e-9)))
        return np.stack(x, axis=1), level(seen[2][0], 2, 7) * 8 + level(seen[1][0], 2, 7)

    def bits(self, word: np.ndarray, state: np.ndarray) -> np.ndarray:
        total = np.zeros(len(word))
        for d in range(self.depth):
            live, bit, seen = self._level(d, word, state)
            x, gate = self._inputs(seen, 0)
            p = squash(np.einsum("ij,ij->i", x, self.weights[gate]))
            total[live] -= np.log2(np.clip(np.where(bit, p, 1 - p), 1e-12, 1))
        return total


class Preceding:
    """Bits of a token's group in a context: the text's state and the hashed word before.

    ``wide``: training counts by state and group; ``counts``: those of a piece, by hashed word before,
    state and group. The bits of a group are its path in a binary tree. Five predictors see each node,
    each with the one before as its prior: all tokens, those of the language part, of the state, of the
    word before (and how it ended), of word before and state. They are stretched and mixed with weights
    that are gated by how often the last two were seen.
    """

    START = (0.0, 0.05, 0.15, 0.3, 0.5)

    def __init__(self, wide: np.ndarray, counts: np.ndarray, weights: np.ndarray | None = None):
        self.counts, m = counts, len(counts)
        by_word = counts.reshape(m, LANGS, STYLES, GROUPS).sum(axis=1)
        by_tongue = wide.reshape(LANGS, STYLES, GROUPS).sum(axis=1)
        self.nodes = [self._heap(x.reshape(-1, GROUPS)) for x in (wide.sum(axis=0), by_tongue, wide, by_word, counts)]
        self.weights = np.tile(np.array(self.START), (16, 1)) if weights is None else weights

    @staticmethod
    def _heap(counts: np.ndarray) -> np.ndarray:
        heap = np.zeros((len(counts), 2 * GROUPS), np.int64)
        heap[:, GROUPS:] = counts
        for k in range(GROUPS - 1, 0, -1):
            heap[:, k] = heap[:, 2 * k] + heap[:, 2 * k + 1]
        return heap

    def _inputs(self, word, state, node, own=0, bit=0):
        """Stretched predictions and gate at a node; ``own`` 1: the token's own occurrence is left out."""
        p, x, sizes = 0.5, [], []
        rows = (0, state // STYLES, state, word * STYLES + state % STYLES, word * STATES + state)
        for heap, row, prior in zip(self.nodes, rows, (0.01, *[KAPPA] * 4)):
            n, n1 = heap[row, node] - own, heap[row, 2 * node + 1] - bit * own
            p = (n1 + prior * p) / (n + prior)
            x.append(stretch(np.clip(p, 1e-6, 1 - 1e-6)))
            sizes.append(n)
        return x, level(sizes[4], 2, 3) * 4 + level(sizes[3], 2, 3)

    def _chance(self, x, gate):
        told = sum(self.weights[gate, i] * x[i] for i in range(len(x)))
        return squash(np.clip(told, -LIMIT, LIMIT))

    def learn(self) -> int:
        """Once through all training tokens of the piece; weights move after every bit of some cells."""
        word, state, group = np.nonzero(self.counts)
        # Cells lie in order of words: mix them.
        order = np.argsort((np.arange(len(word)) * 2654435761) & 0xFFFFFFFF, kind="stable")
        for at in range(0, len(order), CELLS):
            w, s, g = (v[order[at : at + CELLS]] for v in (word, state, group))
            c, node = self.counts[w, s, g].astype(float), np.ones(len(w), np.int64)
            for k in range(7, -1, -1):
                bit = (g >> k) & 1
                x, gate = self._inputs(w, s, node, 1, bit)
                error = (bit - self._chance(x, gate)) * c
                mass = np.bincount(gate, weights=c, minlength=16) + 200
                for i in range(len(x)):
                    self.weights[:, i] += 0.1 * np.bincount(gate, weights=error * x[i], minlength=16) / mass
                node = 2 * node + bit
        return int(self.counts.sum())

    def bits(self) -> tuple[np.ndarray, np.ndarray]:
        """Of each cell: what a held-out text and what a training text, its own occurrence left out, see."""
        m = len(self.counts)
        context = np.arange(m * STATES)
        held = np.zeros((m * STATES, 1))
        for k in range(8):
            node = np.arange(1 << k, 2 << k)
            p = self._chance(*self._inputs(*(v[:, None] for v in divmod(context, STATES)), node[None, :]))
            held = np.stack([held - np.log2(1 - p), held - np.log2(p)], axis=2).reshape(len(held), -1)
        held = held.reshape(self.counts.shape)
        own, (word, state, group) = held.copy(), np.nonzero(self.counts)
        node, cost = np.ones(len(word), np.int64), np.zeros(len(word))
        for k in range(7, -1, -1):
            bit = (group >> k) & 1
            p = self._chance(*self._inputs(word, state, node, 1, bit))
            cost -= np.log2(np.where(bit == 1, p, 1 - p))
            node = 2 * node + bit
        own[word, state, group] = cost
        return self._rounded(held), self._rounded(own)

    @staticmethod
    def _rounded(bits: np.ndarray) -> np.ndarray:
        """In half the width, rounded up, so that chances never add up to more than one."""
        short = bits.astype(np.float16)
        return np.where(short < bits, np.nextafter(short, np.float16(np.inf)), short)


def _preceding(wide: np.ndarray, weights: np.ndarray | None = None):
    """Rows (piece, its counts) -> its tokens and learned weights or, with ``weights``, its tables of bits."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for piece, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts = np.frombuffer(_unzipped(blob), np.int64).reshape(-1, STATES, GROUPS)
                mixer = Preceding(wide, counts, weights)
                if weights is None:
                    told = (mixer.learn(), mixer.weights.ravel().tolist(), None, None)
                else:
                    told = (int(counts.sum()), None, *(_zipped(x.tobytes()) for x in mixer.bits()))
                kinds = (pa.int32(), pa.int64(), pa.list_(pa.float64()), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip((piece, *told), kinds)], names=["piece", "n", "weights", "held", "own"])

    return run


class Spelling:
    """Bits of spelt words from hashed byte contexts. Learns first; ``ready`` fixes what it predicts."""

    def __init__(self, slots: list[tuple[np.ndarray, np.ndarray]]):
        self.nodes = []
        for bits, (slot, n) in zip(CONTEXTS, slots):
            heap = np.zeros((1 << bits, 512), np.float32)
            heap[slot >> 8, 256 + (slot & 255)] = n
            for k in range(255, 0, -1):
                heap[:, k] = heap[:, 2 * k] + heap[:, 2 * k + 1]
            self.nodes.append(heap)
        self.weights = np.tile(np.array([0.05, 0.2, 0.5, 0.25, 0.0]), (16, 1))
        self.map = np.tile(squash((np.arange(33) - 16) / 2.0), (16, 1))

    def ready(self) -> Spelling:
        """Keeps each node's stretched prediction and the two gates in place of the counters."""
        self.stretched, self.gates = [], {}
        for order, heap in enumerate(self.nodes):
            n, n1 = heap[:, :256], np.zeros((len(heap), 256), np.float32)
            n1[:, 1:] = heap[:, 3::2]
            self.stretched.append(counted(n1, n).ravel())
            if order in (1, 2):
                self.gates[order] = level(n.ravel(), 3 if order == 1 else 2, 3).astype(np.int8)
        self.nodes = []
        return self

    def inputs(self, contexts, node, bit):
        """Stretched predictions and gate at a node, the word's own occurrence left out of what was counted."""
        x, sizes = [], []
        for heap, context in zip(self.nodes, contexts):
            flat, base = heap.ravel(), context.astype(np.int64) * 512
            n, n1 = flat.take(base + node), flat.take(base + 2 * node + 1)
            n, n1 = np.maximum(n - 1, 0), np.maximum(n1 - bit, 0)
            x.append(counted(n1, np.maximum(n, n1)))
            sizes.append(n)
        return [*x, np.full(len(node), 0.3, np.float32)], level(sizes[2], 2, 3) * 4 + level(sizes[1], 3, 3)

    def refined(self, mixed_input, p, gate):
        """The mean of a prediction (stretched: ``mixed_input``) and what the map makes of it."""
        at = np.clip(mixed_input * 2 + 16, 0, 31.999)
        low = at.astype(int)
        part = at - low
        cell = gate * 33 + low
        flat = self.map.ravel()
        return low, part, (flat.take(cell) * (1 - part) + flat.take(cell + 1) * part + p) / 2

    def learn(self, words: list[bytes], states: np.ndarray) -> None:
        """One batch of words that each occur once: weights and map move after every bit of it."""
        contexts, byte, _ = _byte_slots(words, states)
        node = np.ones(len(byte), np.int64)
        for k in range(8):
            bit = ((byte >> (7 - k)) & 1).astype(np.float32)
            x, gate = self.inputs(contexts, node, bit)
            told = np.clip(sum(self.weights[:, i].take(gate) * x[i] for i in range(len(x))), -LIMIT, LIMIT)
            p = squash(told)
            mass = np.bincount(gate, minlength=16) + 20
            for i in range(len(CONTEXTS) + 1):
                self.weights[:, i] += 0.1 * np.bincount(gate, weights=(bit - p) * x[i], minlength=16) / mass
            low, part, _ = self.refined(told, p, gate)
            for cell, share in ((low, 1 - part), (low + 1, part)):
                key = gate * 33 + cell
                mass = np.bincount(key, weights=share, minlength=16 * 33)
                gain = np.bincount(key, weights=share * (bit - self.map[gate, cell]), minlength=16 * 33)
                self.map += (0.3 * gain / (mass + 10)).reshape(16, 33)
            node = 2 * node + bit.astype(np.int64)
        self.map = np.clip(self.map, 1e-4, 1 - 1e-4)

    def chance(self, contexts, node, weights):
        """The chance of a set bit at each node, once ``ready``."""
        base = [(c.astype(np.int64) << 8) + node for c in contexts]
        gate = self.gates[2].take(base[2]) * np.int64(4) + self.gates[1].take(base[1])
        told = (weights[:, -1] * np.float32(0.3)).take(gate)
        for i, (table, at) in enumerate(zip(self.stretched, base)):
            told += weights[:, i].take(gate) * table.take(at)
        told = np.clip(told, -LIMIT, LIMIT)
        return self.refined(told, squash(told), gate)[2]

    def bits(self, words: list[bytes], states: np.ndarray) -> np.ndarray:
        out, weights = [], self.weights.astype(np.float32)
        for at in range(0, len(words), 8192):
            contexts, byte, sizes = _byte_slots(words[at : at + 8192], states[at : at + 8192])
            node, chance = np.ones(len(byte), np.int64), np.ones(len(byte))
            for k in range(8):
                bit = (byte >> (7 - k)) & 1
                p = self.chance(contexts, node, weights)
                chance *= np.where(bit == 1, p, 1 - p)
                node = 2 * node + bit
            out.append(np.add.reduceat(-np.log2(chance), np.cumsum(sizes) - sizes))
        return np.concatenate(out) if out else np.empty(0)


def _forget() -> None:
    """Frees the spelling that an earlier task of this worker process has left."""
    vars(zlib).get("_strataweave_spelling", {}).clear()


def _spelling(model: dict, ready: bool = False) -> Spelling:
    """The model's spelling, built once in a worker process."""
    kept, name = vars(zlib).setdefault("_strataweave_spelling", {}), (model["name"], ready)  # the latest one alone
    if name not in kept:
        kept.clear()
        kept[name] = Spelling(model["slots"])
        if ready:
            kept[name].ready()
    kept[name].weights, kept[name].map = model["weights"].copy(), model["map"].copy()
    return kept[name]


def _learners(model: dict):
    """Rows (learner, words, pairs) in learner order -> (learner, words, weights and map) of each."""

    def run(batches):
        import pyarrow as pa

        def answer(learner, n, spelling):
            state = np.concatenate([spelling.weights.ravel(), spelling.map.ravel()])
            return pa.RecordBatch.from_arrays([pa.array([learner], pa.int32()), pa.array([n], pa.int64()), pa.array([state.tolist()])], names=["learner", "n", "state"])

        spelling, n = _spelling(model), 0
        for learner, rows, last in _by_bucket(batches, 3):
            for words, pairs in rows:
                words = _unzipped(words).split(b"\n")
                word, state, count = np.frombuffer(_unzipped(pairs), np.int32).reshape(3, -1)
                each = np.bincount(word, weights=count, minlength=len(words))
                once = [i for i in np.flatnonzero(each[word] == 1) if words[word[i]]]
                # Words lie in the order of their first chunks: mix them by a hash.
                once.sort(key=lambda i: zlib.crc32(words[word[i]]))
                for at in range(0, len(once), BATCH):
                    part = once[at : at + BATCH]
                    spelling.learn([words[word[i]] for i in part], state[part].astype(np.int64))
                    n += len(part)
            if last:
                yield answer(learner, n, spelling)
                spelling, n = _spelling(model), 0

    return run


def _costs(model: dict):
    """Rows (bucket, kind, chunk, words, pairs, links) in that order: the vocabulary's first (kind 0), then
    the chunks' (kind 1), each of which is answered by the costs of its pairs and codes of its phrases."""

    def run(batches):
        import pyarrow as pa
        from xxhash import xxh64_intdigest

        spelling = _spelling(model, ready=True)

        class Answers:
            def __init__(self, bucket: int):
                self.bucket, self.own, self.trees, self.waiting, self.size = bucket, _Bucket(), None, [], 0

            def ready(self) -> None:
                key, count = self.own.pairs.done()
                words = len(self.own.index)
                counts = np.zeros((words, STATES), np.int64)
                counts.ravel()[key.astype(np.int64)] = count
                self.each = counts.sum(axis=1)
                names, buckets = list(self.own.index), len(model["top"])
                # Fewer buckets than groups: a tree for each group of the bucket.
                self.group = np.zeros(words, np.int64) if buckets >= GROUPS else grouped(np.fromiter(map(xxh64_intdigest, names), np.uint64, words))
                self.place, self.trees = np.empty(words, np.int64), {}
                for group in np.unique(self.group):
                    own = np.flatnonzero(self.group == group)
                    order = own[np.argsort(np.array([names[i] for i in own], object), kind="stable")]
                    self.place[order] = np.arange(len(order))
                    self.trees[group] = Tree(counts[order])
                self.phrases = Phrases(*self.own.links.done())
                self.cost = np.full((2, words, STATES), np.nan, np.float32)  # in its group, spelt

            def ask(self, chunk, words, pairs, links) -> None:
                key = np.empty(0, np.int64)
                if pairs is not None:
                    local, state, _ = np.frombuffer(_unzipped(pairs), np.int32).reshape(3, -1)
                    key = self.own.places(words)[local] * STATES + state
                self.waiting.append((chunk, key, links))
                self.size += len(key)

            def answers(self):
                names = list(self.own.index)
                known = len(self.each)
                if len(names) > self.cost.shape[1]:
                    self.cost = np.concatenate([self.cost, np.full((2, len(names) - self.cost.shape[1], STATES), np.nan, np.float32)], axis=1)
                new = np.unique(np.concatenate([key for _, key, _ in self.waiting]))
                cost = self.cost.reshape(2, -1)
                new = new[np.isnan(cost[1, new])]
                word, state = new // STATES, new % STATES
                novel = model["novel"][state]
                cost[1, new] = spelling.bits([names[i] for i in word], state) - np.log2(novel)
                cost[0, new] = np.inf
                old = np.flatnonzero(word < known)
                for group, tree in self.trees.items():
                    mine = old[self.group[word[old]] == group]
                    told = tree.bits(self.place[word[mine]], state[mine]) + model["top"][self.bucket, state[mine]] - np.log2(1 - novel[mine])
                    cost[0, new[mine]] = told
                each = np.concatenate([self.each, np.zeros(len(names) - known, np.int64)])
                out = []
                for chunk, key, links in self.waiting:
                    before, code, _ = _link(links)
                    held, own = self.phrases.ask(before, code)
                    raw = cost[:, key].tobytes() + each[key // STATES].tobytes() + (held + 32 * own).astype(np.int16).tobytes()
                    out.append((chunk, self.bucket, len(key), _zipped(raw)))
                self.waiting, self.size = [], 0
                kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary())
                return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["chunk", "bucket", "size", "costs"])

        now = None
        for bucket, rows, last in _by_bucket(batches, 6):
            now = now or Answers(bucket)
            for kind, chunk, words, pairs, links in rows:
                if kind == 0:
                    now.own.add(words, pairs, _unzipped(links) if links else None)
                    continue
                if now.trees is None:
                    now.ready()
                now.ask(chunk, words, pairs, links)
                if now.size >= ASKED:
                    yield now.answers()
            if last:
                if now.waiting:
                    yield now.answers()
                now = None

    return run


def _assemble(train_tokens: int, distinct: int, hits: np.ndarray, buckets: int, lower: bool = False, groups: bytes | None = None):
    """``hits``: the chance that a prediction of each gate is right. ``groups``: packed bits of each cell, for held-out and for training texts."""
    table = None

    def run(docs, answers):
        import pyarrow as pa

        from .bpe import unpacked

        nonlocal table
        _forget()
        if table is None and groups is not None:
            table = np.frombuffer(_unzipped(groups), np.float16).reshape(2, -1)
        # A chunk that occurs twice has equal answers twice.
        replies = {b: (n, blob) for b, n, blob in zip(*(answers[c].to_pylist() for c in ("bucket", "size", "costs")))}
        raw = [(n, _unzipped(blob)) for _, (n, blob) in sorted(replies.items())]
        codes = np.concatenate([np.empty(0, np.int16), *(np.frombuffer(x, np.int16, offset=16 * n) for n, x in raw)])
        sure = np.r_[0.0, np.stack([-np.log2(1 - hits), -np.log2(hits)], axis=1).ravel()]
        cost = np.concatenate([np.empty((2, 0), np.float32), *(np.frombuffer(x, np.float32, 2 * n).reshape(2, n) for n, x in raw)], axis=1)
        seen = np.concatenate([np.empty(0), *(np.frombuffer(x, np.int64, n, 8 * n) for n, x in raw)])
        lead = math.log10(train_tokens + 0.5 * (distinct + 1)) if train_tokens else math.log10(0.5)
        out = []
        for ids, texts in unpacked(docs):
            *_, at, size, links, cells = _pairs(texts, np.zeros(len(texts), bool), buckets, lower)
            _, _, place, first, text = links
            if at.max() + 1 != cost.shape[1] or place.max(initial=-1) + 1 != len(codes):
                raise ValueError("the rows of a chunk changed between two readings of the input")
            learned = np.array([is_train(i) for i in ids])
            group = 0.0 if table is None else table[np.repeat(learned, size).astype(np.int8), cells].astype(np.float32)
            word_bits = -np.logaddexp2(-(cost[0, at] + group), -cost[1, at])
            train = learned[text]
            code = np.where(place >= 0, codes[place] if len(codes) else 0, 0)
            code = np.where(train, code // 32, code % 32)
            hit = (code > 0) & (code % 2 == 0)
            begin = np.cumsum(size) - size
            add = lambda x: np.add.reduceat(x, begin)
            base = add(np.log10(seen + 0.5)[at]) - size * lead
            inside = np.repeat(hit, np.diff(np.r_[first, len(at)]))
            bits = add(np.where(inside, 0.0, word_bits.astype(float))) + np.bincount(text, weights=sure[code], minlength=len(size))
            for row in zip(ids, size.tolist(), add((seen > 0)[at].astype(np.int64)).tolist(), base.tolist(), bits.tolist(), map(len, texts)):
                held = row[0] is not None and zlib.crc32(str(row[0]).encode()) % FOLDS == HELD
                out.append((row[0], held, row[1], row[2], train_tokens, row[3], -row[4] * math.log10(2), row[4] / max(1, row[5])))
        names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte"]
        kinds = [pa.int64(), pa.bool_(), *[pa.int64()] * 3, *[pa.float64()] * 3]
        cols = list(zip(*out)) or [[]] * len(names)
        return pa.table([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)

    return run


def train(asked: DataFrame, buckets: int) -> tuple[dict, DataFrame]:
    """The model's bounded tables, and the facts (kinds 4 and 6: the vocabulary by bucket)."""
    flat = asked.select("bucket", "words", "pairs", "links").repartition("bucket").sortWithinPartitions("bucket")
    facts = settle(flat.mapInArrow(_statistics, FACTS), "lm-facts")
    few = facts.filter("kind IN (0, 1, 2, 5, 8)").groupBy("kind", "a", "b").agg(F.sum("n").alias("n")).toArrow().to_pandas()
    kind = {k: g for k, g in few.groupby("kind")}
    totals = np.zeros((buckets, STATES), np.int64)
    if 0 in kind:
        totals[kind[0]["a"], kind[0]["b"]] = kind[0]["n"]
    once = np.zeros(STATES)
    if 1 in kind:
        once[kind[1]["b"]] = kind[1]["n"]
    cells = facts.filter("kind = 3").groupBy("a", F.col("b").cast("int").alias("b")).agg(F.least(F.sum("n"), F.lit(1 << 30)).cast("int").alias("n"))
    cells = {c: x.to_numpy() for c, x in zip("abn", cells.toArrow().columns)}
    slots = []
    for order in range(len(CONTEXTS)):
        own = np.flatnonzero(cells["a"] == order)
        own = own[np.argsort(cells["b"][own])]
        slots.append((cells["b"][own], cells["n"][own]))
    wide = np.zeros((STATES, GROUPS), np.int64)
    if 8 in kind:
        wide[kind[8]["a"], kind[8]["b"]] = kind[8]["n"]
    top = np.zeros((buckets, STATES))
    filled = np.flatnonzero(totals.sum(axis=1))
    groups = np.searchsorted(np.arange(GROUPS) * buckets // GROUPS, filled, side="right") - 1
    for group in np.unique(groups) if buckets > GROUPS else ():  # a bucket within its group
        own = filled[groups == group]
        at, state = np.divmod(np.arange(len(own) * STATES), STATES)
        top[own] = Tree(totals[own]).bits(at, state).reshape(len(own), STATES)
    right, wrong = np.full(GATES, 1.0), np.full(GATES, 3.0)
    for code, n in zip(kind[5]["a"], kind[5]["n"]) if 5 in kind else ():
        (right if code % 2 == 0 else wrong)[(code - 1) // 2] += n
    tokens_all = int(totals.sum())
    rate = (once.sum() + 0.5) / (tokens_all + 1)
    novel = np.clip((once + 20 * rate) / (totals.sum(axis=0) + 20), 1e-9, 1 - 1e-9) if tokens_all else np.full(STATES, 1 - 1e-9)
    start = Spelling([])
    model = {
        "slots": slots, "weights": start.weights, "map": start.map, "top": top, "novel": novel, "name": uuid.uuid4().hex,
        "tokens": tokens_all, "hits": right / (right + wrong), "distinct": int(kind[2]["n"].sum()) if 2 in kind else 0,
    }
    # Learners get whole buckets: one for every LEARNER words, so none has much more than that unless a bucket does.
    learners = int(min(buckets, 1 + once.sum() // LEARNER))
    words = facts.filter("kind = 4").select((F.col("a") % learners).alias("learner"), "words", "pairs", "a", "b")
    # A count of partitions of their own, so that little data with much work isn't put together.
    lessons = words.repartition(learners, "learner").sortWithinPartitions("learner", "a", "b").select("learner", "words", "pairs")
    learned = sorted(lessons.mapInArrow(_learners(model), "learner int, n long, state array<double>").filter("n > 0").collect())
    if learned:
        mean = np.average(np.array([r.state for r in learned]), axis=0, weights=[r.n for r in learned])
        cut = start.weights.size
        model["weights"], model["map"] = mean[:cut].reshape(start.weights.shape), mean[cut:].reshape(start.map.shape)
    pieces = facts.filter("kind = 7").select("a", "pairs").repartition(PIECES, "a")
    schema = "piece int, n long, weights array<double>, held binary, own binary"
    told = sorted(pieces.mapInArrow(_preceding(wide), schema).select("piece", "n", "weights").collect())
    model["groups"] = None
    if told:
        weights = np.average(np.array([r.weights for r in told]), axis=0, weights=[r.n for r in told]).reshape(16, -1)
        # What no token was seen after is told by what holds for its state.
        blank, cells = Preceding(wide, np.zeros((1, STATES, GROUPS), np.int64), weights), (STATES * GROUPS << BEFORE) // PIECES
        groups = np.tile(blank.bits()[0].ravel(), (2, 1 << BEFORE))
        for r in pieces.mapInArrow(_preceding(wide, weights), schema).select("piece", "held", "own").toArrow().to_batches():
            for piece, *sides in zip(*(c.to_pylist() for c in r.columns)):
                for side, raw in enumerate(sides):
                    groups[side, piece * cells : (piece + 1) * cells] = np.frombuffer(_unzipped(raw), np.float16)
        model["groups"] = _zipped(groups.tobytes())
    return model, facts


def score(docs: DataFrame, buckets: int | None = None, lower: bool = False) -> DataFrame:
    """Scores of every row of ``docs``, learned from those that aren't held out.

    ``buckets`` of the vocabulary: by default 256, and beyond 8 GB as many as grow with the square
    root of the input, as a vocabulary does. ``lower``: A-Z are lower-cased first.
    """
    bounded_batches(docs.sparkSession)
    texts = stable(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text")), "lm-docs")
    buckets = buckets or max(256, int(input_bytes(texts) ** 0.5 / 350))
    asked = settle(texts.mapInArrow(_pack_pairs(buckets, lower), "bucket int, chunk long, words binary, pairs binary, links binary"), "lm-pairs")
    model, facts = train(asked, buckets)
    groups = model.pop("groups")
    known = facts.filter("kind IN (4, 6)").select(
        F.col("a").alias("bucket"),
        F.lit(0).alias("kind"),
        F.col("b").alias("chunk"),
        "words",
        F.when(F.col("kind") == 4, F.col("pairs")).alias("pairs"),
        F.when(F.col("kind") == 6, F.col("pairs")).alias("links"),
    )
    rows = known.unionAll(asked.filter("bucket >= 0").select("bucket", F.lit(1).alias("kind"), "chunk", "words", "pairs", "links"))
    rows = rows.repartition(buckets, "bucket").sortWithinPartitions("bucket", "kind", "chunk")
    answers = rows.mapInArrow(_costs(model), "chunk long, bucket int, size int, costs binary")
    packed = texts.mapInArrow(_pack_docs(CHUNK_BYTES), "chunk long, ids array<long>, size long, texts binary")
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"
    assemble = _assemble(model["tokens"], model["distinct"], model["hits"], buckets, lower, groups)
    return packed.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(assemble, schema)


def op2_lm_score(spark, sf_dir: str) -> DataFrame:
    return score(read(spark, sf_dir, "documents"), lower=True)
