"""Toxicity by lexicon: Levenshtein automata intersected with a trie, scored in context.

The lexicon is learned from labelled documents: whole words, and stems (prefixes) for
inflected ones, that toxic documents use in several contexts and other documents hardly ever.
It goes into a trie. The trie and the automata "within ``n`` edits of what the path spells"
are walked together; the states of that walk are kept as a lazily built automaton, so a word
costs a few dictionary lookups and most words die after two letters. Each distinct word is
matched once per task while it stays in a bounded cache.

A word of nine letters may be misspelled by two edits, of five by one. A shorter one may be by
one edit if what it then takes in, in the labelled documents, are hits in toxic ones.

A hit is judged by its window: within quotation marks, on a quoted line or beside a reporting
verb it counts as quotation, otherwise as abuse. A logistic model over the counts of exact,
misspelled and quoted hits gives the score.

Learning uses at most ``LABELLED_ROWS`` labelled documents (chosen by a hash of the id), never
those whose crc32(doc_id) mod 5 is 0; where labels of a document disagree, it counts as toxic.
Terms are counted and chosen in Spark, without a cap; the chosen ones reach the driver, no more
than those documents can support. Without toxic labels the lexicon is empty and every score is low.

Null and blank texts have no words and the score of a text without hits. A null doc_id is
neither learned from nor held out. Repeated rows give repeated results, other columns are
ignored, an empty table gives no rows.
"""

from __future__ import annotations

import math
import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, read, settle

FOLDS = 5
LABELLED_ROWS = 10_000
#: Least number of different contexts of a term in toxic documents.
CONTEXTS = 4
#: How much more often than elsewhere a term must occur in toxic documents.
LIFT = 20.0
STEMS = (4, 5, 6)
CACHE_WORDS = 300_000
#: Words around a hit that are looked at.
REACH = 6
TOKEN = re.compile(r"[^\W_]+")
QUOTES = re.compile("[\"“”„«»]")
#: Reporting verbs of the languages at hand.
REPORTING = frozenset(
    "said says wrote writes called calls quoted quotes quoting sagte sagt schrieb schreibt nannte dit disait appela écrit dijo dice llamó escribió".split()
)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def edits_for(word: str, trusted: frozenset = frozenset()) -> int:
    """Edits allowed to a lexicon word: under 5 letters 1 for ``trusted`` ones, else none; 1 under 9, else 2."""
    return int(word in trusted) if len(word) < 5 else 1 if len(word) < 9 else 2


class Matcher:
    """Finds the lexicon entry that a word spells, misspells or begins with.

    A state is a set of (trie node, edits made, may still skip): the words of the trie that
    the letters read so far can lead to. States are numbered and their moves kept.
    """

    def __init__(self, words: dict[str, float], stems: dict[str, float], trusted: frozenset = frozenset()):
        self.trusted = trusted
        self.children: list[dict[str, int]] = [{}]
        self.ends: dict[int, tuple[str, float]] = {}
        self.stem_ends: dict[int, tuple[str, float]] = {}
        self.allowed: list[int] = [0]
        for group, ends in ((words, self.ends), (stems, self.stem_ends)):
            for term, weight in group.items():
                ends[self._node(term, edits_for(term, trusted) if ends is self.ends else 0)] = (term, weight)
        self.reset()

    def _node(self, term: str, edits: int) -> int:
        at = 0
        self.allowed[0] = max(self.allowed[0], edits)
        for letter in term:
            at = self.children[at].setdefault(letter, len(self.children))
            if at == len(self.children):
                self.children.append({})
                self.allowed.append(0)
            self.allowed[at] = max(self.allowed[at], edits)
        return at

    def reset(self) -> None:
        self.states: dict[frozenset, int] = {}
        self.members: list[frozenset] = []
        self.moves: list[dict[str, int]] = []
        self.start = self._state(self._closed({(0, 0)}))

    def _closed(self, pairs: set[tuple[int, int]]) -> frozenset:
        """With the states that leaving out a letter of the lexicon's word leads to."""
        todo = list(pairs)
        while todo:
            node, made = todo.pop()
            for child in self.children[node].values():
                if made < self.allowed[child] and (child, made + 1) not in pairs:
                    pairs.add((child, made + 1))
                    todo.append((child, made + 1))
        return frozenset(pairs)

    def _state(self, members: frozenset) -> int:
        if members not in self.states:
            self.states[members] = len(self.members)
            self.members.append(members)
            self.moves.append({})
        return self.states[members]

    def _move(self, state: int, letter: str) -> int:
        found = set()
        for node, made in self.members[state]:
            if made < self.allowed[node]:
                found.add((node, made + 1))  # a letter too many
            for c, child in self.children[node].items():
                if c == letter:
                    found.add((child, made))
                elif made < self.allowed[child]:
                    found.add((child, made + 1))
        return self._state(self._closed(found))

    def find(self, word: str) -> tuple[str, int, float] | None:
        """(entry, edits, weight) of the nearest entry, whole words before stems."""
        if len(self.members) > 100_000:
            self.reset()
        state, stem = self.start, None
        for letter in word:
            moves = self.moves[state]
            if letter not in moves:
                moves[letter] = self._move(state, letter)
            state = moves[letter]
            if not self.members[state]:
                return stem
            for node, made in self.members[state] if self.stem_ends else ():
                if made == 0 and node in self.stem_ends:
                    stem = (self.stem_ends[node][0], 0, self.stem_ends[node][1])
        best = None
        for node, made in self.members[state]:
            if node in self.ends:
                term, weight = self.ends[node]
                if made <= edits_for(term, self.trusted) and (best is None or (made, term) < (best[1], best[0])):
                    best = (term, made, weight)
        return best if best and (best[1] == 0 or not stem) else stem or best


class Found(dict):
    """word -> what the matcher finds; bounded."""

    def __init__(self, matcher: Matcher):
        super().__init__()
        self.matcher = matcher

    def __missing__(self, word: str):
        if len(self) >= CACHE_WORDS:
            self.clear()
        value = self[word] = self.matcher.find(word)
        return value


def features(text: str | None, found: Found) -> list[float]:
    """Counts of one text: log-scaled abusive exact and misspelled hits, quoted hits, density, any."""
    low = (text or "").lower()
    words = TOKEN.findall(low)
    hits = [i for i, w in enumerate(words) if found[w]]
    exact = fuzzy = quoted = 0
    if hits:
        spots = list(TOKEN.finditer(low))
        for i in hits:
            begin, end = spots[i].span()
            line = low.rfind("\n", 0, begin) + 1
            stop = low.find("\n", end)
            before = len(QUOTES.findall(low, line, begin)) % 2 == 1
            inside = before and QUOTES.search(low, end, len(low) if stop < 0 else stop) is not None
            near = words[max(0, i - REACH) : i]
            if inside or low.startswith(">", line) or REPORTING & set(near):
                quoted += 1
            elif found[words[i]][1]:
                fuzzy += 1
            else:
                exact += 1
    n = max(1, len(words))
    return [math.log1p(exact), math.log1p(fuzzy), math.log1p(quoted), min(1.0, 20 * (exact + fuzzy) / n), float(exact > 0), float(exact > 1)]


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 0.3) -> np.ndarray:
    """Weights (last: bias) of a ridge logistic regression, by Newton steps."""
    x = np.c_[x, np.ones(len(x))]
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-3
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + penalty * w
        hessian = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _terms(word: str) -> list[str]:
    return [word] + [word[:n] + "*" for n in STEMS if len(word) > n]


def _toxic_terms(batches):
    import pyarrow as pa
    from xxhash import xxh64_intdigest

    for batch in batches:
        pairs = set()
        for text in batch.column(0).to_pylist():
            words = TOKEN.findall((text or "").lower())
            for i, w in enumerate(words):
                if len(w) >= 3 and not w.isdigit():
                    near = " ".join(words[max(0, i - 1) : i] + words[i + 1 : i + 2])
                    context = xxh64_intdigest(near) >> 1
                    pairs.update((t, context) for t in _terms(w))
        cols = list(zip(*pairs)) or [[], []]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64())], names=["term", "context"])


def _uses(batches):
    """(term, uses) in each batch's texts; the empty term counts all words."""
    from collections import Counter

    import pyarrow as pa

    for batch in batches:
        count: Counter = Counter({"": 0})
        for text in batch.column(0).to_pylist():
            words = Counter(TOKEN.findall((text or "").lower()))
            count[""] += words.total()
            for w, n in words.items():
                for t in _terms(w) if len(w) >= 3 else ():
                    count[t] += n
        yield pa.RecordBatch.from_arrays([pa.array(list(count), pa.string()), pa.array(list(count.values()), pa.int64())], names=["term", "n"])


def labelled(docs: DataFrame, labels: DataFrame, rows: int = LABELLED_ROWS) -> DataFrame:
    """(text, toxic) of the labelled documents to learn from."""
    own = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").filter(~held_out(F.col("doc_id")))
    own = own.groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max("toxic").cast("int").alias("toxic"))
    own = own.orderBy(F.xxhash64("id"), "id").limit(rows)
    return docs.select("doc_id", "text").join(F.broadcast(own), F.col("doc_id") == F.col("id")).select("text", "toxic")


def learn_lexicon(train: DataFrame) -> tuple[dict[str, float], dict[str, float]]:
    """Words and stems with their log lift."""
    counts = {r.toxic: r.n for r in train.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts.get(1) or not counts.get(0):
        return {}, {}
    toxic, clean = train.filter("toxic = 1").select("text"), train.filter("toxic = 0").select("text")
    terms = toxic.mapInArrow(_toxic_terms, "term string, context long").distinct().groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    terms = terms.filter(F.col("n") >= CONTEXTS)
    uses = lambda texts: texts.mapInArrow(_uses, "term string, n long").groupBy("term").agg(F.sum("n").alias("uses"))
    outside = settle(uses(clean), "toxic-outside")
    whole = lambda df: (df.filter("term = ''").agg(F.sum("uses")).first()[0] or 0)
    total, others = whole(uses(toxic)), max(1, whole(outside))
    # Without other uses at all, chance alone must be unlikely to put every use into toxic documents.
    rare = math.log(1e-6) / math.log(counts[1] / (counts[0] + counts[1]))
    lift = (F.col("n") / total) / ((F.coalesce("uses", F.lit(0)) + 0.5) / others)
    good = terms.filter(F.col("n") >= min(rare, 8)).join(outside, "term", "left").withColumn("lift", lift).filter(F.col("lift") >= LIFT)
    found = {r.term: (r.n, math.log(r.lift)) for r in good.select("term", "n", "lift").collect()}
    words = {t: x for t, (_, x) in sorted(found.items()) if not t.endswith("*")}
    # A stem counts where it gathers more than the word that is commonest under it.
    most: dict[str, int] = {}
    for w in words:
        for k in STEMS:
            most[w[:k]] = max(most.get(w[:k], 0), found[w][0])
    stems = {t[:-1]: x for t, (n, x) in sorted(found.items()) if t.endswith("*") and n > 1.5 * most.get(t[:-1], 0)}
    return words, stems


def trusted_short(train: DataFrame, words: dict[str, float], stems: dict[str, float]) -> frozenset:
    """The short words whose misspellings, by one edit, are found in toxic documents alone."""
    short = frozenset(w for w in words if len(w) < 5)
    if not short:
        return short

    def misspelled(batches):
        import pyarrow as pa

        found = Found(Matcher(words, stems, short))
        for batch in batches:
            hits = {(found[w][0], t) for text, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for w in set(TOKEN.findall((text or "").lower())) if found[w] and found[w][1]}
            hits = [h for h in hits if h[0] in short]
            yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in hits], pa.string()), pa.array([x for _, x in hits], pa.int32())], names=["term", "toxic"])

    rows = train.select("text", "toxic").mapInArrow(misspelled, "term string, toxic int").groupBy("term").agg(F.min("toxic").alias("least")).collect()
    return short - {r.term for r in rows if r.least == 0}


def toxicity(docs: DataFrame, labels: DataFrame, rows: int = LABELLED_ROWS) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs``."""
    bounded_batches(docs.sparkSession)
    train = settle(labelled(docs, labels, rows).repartition(16), "toxic-train")
    words, stems = learn_lexicon(train)
    trusted = trusted_short(train, words, stems)
    names = ["exact", "fuzzy", "quoted", "density", "any", "several"]

    def seen(batches):
        import pyarrow as pa

        found = Found(Matcher(words, stems, trusted))
        for batch in batches:
            x = np.array([features(t, found) for t in batch.column(0).to_pylist()]).reshape(-1, len(names))
            yield pa.RecordBatch.from_arrays([*map(pa.array, x.T), batch.column(1)], names=[*names, "toxic"])

    schema = ", ".join(f"{n} double" for n in names) + ", toxic int"
    table = np.array(train.mapInArrow(seen, schema).collect(), float).reshape(-1, len(names) + 1)
    weight = fit(table[:, :-1], table[:, -1]) if len(table) and table[:, -1].any() else np.r_[np.zeros(len(names)), -6.0]

    def scored(batches):
        import pyarrow as pa

        found = Found(Matcher(words, stems, trusted))
        for batch in batches:
            x = np.array([features(t, found) for t in batch.column(2).to_pylist()]).reshape(-1, len(names))
            p = 1 / (1 + np.exp(-np.clip(x @ weight[:-1] + weight[-1], -30, 30)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"]
            )

    rows_in = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows_in.mapInArrow(scored, "doc_id long, held_out boolean, score double, predicted int")


def op8_toxicity(spark, sf_dir: str) -> DataFrame:
    return toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
