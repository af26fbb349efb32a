"""Periodic runs against brute force: the tree's own search, the operator and the query's digests."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

from strataweave.llm import periodic
from strataweave.llm.hashing import WordHash


def brute(w, least=24, exponent=3):
    out = []
    for q in range(1, len(w) // exponent + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(least, exponent * q):
                own = w[i : i + length]
                if not any(all(own[x] == own[x + d] for x in range(length - d)) for d in range(1, q)):
                    out.append((i, length, q))
            i = max(j, i) + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def some_words(rng):
    k, n = rng.choice([1, 2, 2, 3, 5]), rng.randint(0, 120)
    kind = rng.random()
    if kind < 0.3:
        return [rng.choice("abcde"[:k]) for _ in range(n)]
    w = []
    if kind < 0.6:
        while len(w) < n:
            root = [rng.choice("abc"[:k]) for _ in range(rng.randint(1, 9))]
            w += (root * 9)[: rng.randint(1, 60)]
        return w
    w = [rng.choice("ab") for _ in range(n)]
    for _ in range(3):
        if w:
            a = rng.randrange(len(w))
            w += w[a : rng.randrange(a, len(w)) + 1]
    return w[:200]


@pytest.mark.parametrize("part", [1 << 19, 60])
@pytest.mark.parametrize("least, exponent", [(24, 3), (8, 3), (3, 3), (6, 2)])
def test_runs_of_many_texts(monkeypatch, part, least, exponent):
    monkeypatch.setattr(periodic, "PART", part)
    rng = random.Random(least * exponent)
    n = 0
    for _ in range(40):
        texts = [[c.encode() for c in some_words(rng)] for _ in range(rng.randint(0, 6))]
        want = [brute(w, least, exponent) for w in texts]
        assert periodic.text_runs(texts, WordHash(), least, exponent) == want
        n += sum(map(len, want))
    assert n > 20


def test_suffix_tree():
    s = np.array([*map(ord, "mississippi"), 0])
    tree = periodic.SuffixTree(s)
    text = "mississippi\0"
    assert [text[i:] for i in tree.leaves] == sorted(text[i:] for i in range(12))
    first, last = tree.node(np.array([1]), np.array([4]))  # issi
    assert sorted(tree.leaves[first[0] : last[0] + 1]) == [1, 4]
    assert tree.blocks().tolist() == [0, 1, 2, 3, 4, 8, 9, 10, 11]
    at = lambda c: tree.symbols[text.index(c)]
    assert tree.child(np.array([1, 1, 1]), np.array([4, 4, 4]), np.array([at("s"), at("p"), at("m")])).tolist() == [1, 4, -1]


def expected(doc_id, text):
    w = (text or "").encode().split()
    n = len(w)
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is not None and n and h % 10 == 0:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
    runs = brute(w)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    gone = {i for a, length, q in runs for i in range(a + q, a + length)}
    digest = lambda b: hashlib.sha256(b).hexdigest()
    return (
        doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
        digest("".join("%d,%d,%d\n" % r for r in runs).encode()), digest(b" ".join(x for i, x in enumerate(w) if i not in gone)),
    )


def test_query(spark, tmp_path):
    rng = random.Random(7)
    vocab = ["ka", "mo", "É", "a\x1cb", " "]
    texts = [None, "", " \n\t ", "one", "x " * 23, "x " * 24, "x y " * 12, "p q r " * 3 + "end", "  a" * 40]
    texts += [" ".join(rng.choice(vocab) for _ in range(rng.randint(0, 90))) for _ in range(60)]
    texts += [" ".join(some_words(rng)) for _ in range(60)]
    texts.append(" ".join(f"w{i % 700}" for i in range(3_000)))
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [(None, "x " * 30), (5, "x " * 24), (5, "other text " * 20), (-3, "n " * 50)]
    docs = spark.createDataFrame([(i, t, "r", 0, "k") for i, t in rows], "doc_id long, text string, runs string, start int, kept string").repartition(3)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = periodic.op11_periodic_runs(spark, str(tmp_path)).collect()
    order = lambda r: tuple((x is not None, x) for x in r)
    want = sorted((expected(*r) for r in rows), key=order)
    assert sorted((tuple(r) for r in got), key=order) == want
    assert sum(r[1] for r in want) > 20
    assert any(r[1] and zlib.crc32(str(r[0]).encode()) % 10 == 0 for r in want)


def test_empty(spark):
    assert periodic.digests(periodic.periodic_runs(spark.createDataFrame([], "doc_id long, text string"))).count() == 0


def test_very_long_text():
    """Runs deep in a long text, and one run over all of it."""
    w = [b"%d" % i for i in range(50_000)] + [b"%d" % (i % 11) for i in range(50_000)]
    assert periodic.text_runs([w, [b"x"] * 300_000], WordHash()) == [[(50_000, 50_000, 11)], [(0, 300_000, 1)]]
