"""Hard-negative mining against brute force, with awkward rows, ties, blocks and windows."""

import math
import random
import struct

import pytest

from strataweave.llm import negatives


def brute(rows, anchors, positives=5, per=3, low=50, high=95):
    kept = {}
    for i, label, v in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        x = tuple(math.floor(256 * c) for c in v)
        kept[i] = min(kept.get(i, (label, x)), (label, x), key=lambda r: (r[0], struct.pack(f"<{len(r[1])}i", *r[1])))
    product = lambda x, y: sum(a * b for a, b in zip(x, y))
    out = []
    for a in anchors:
        if a not in kept:
            continue
        scored = sorted((-product(kept[a][1], v), i, label) for i, (label, v) in kept.items() if i != a)
        for s, p, _ in [x for x in scored if x[2] == kept[a][0]][:positives]:
            found = [(n, t) for t, n, label in scored if label != kept[a][0] and low * -s <= 100 * -t <= high * -s][:per]
            out += [(a, p, k + 1, n, -s, -t) for k, (n, t) in enumerate(found)]
    return sorted(out)


def vectors(rng, n, dim=6):
    centres = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(5)]
    return [[x + rng.gauss(0, 0.4) for x in rng.choice(centres)] for _ in range(n)]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(12)
    out = [(i, rng.randrange(3), v) for i, v in enumerate(vectors(rng, 120))]
    out += [(200 + i, rng.randrange(3), out[7][2]) for i in range(25)]  # ties in one cluster
    out += [(300, None, [1.0] * 6), (None, 1, [1.0] * 6), (301, 1, None), (302, 1, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (303, 1, [float("nan")] * 6), (304, 1, [float("inf")] * 6)]
    out += [(305, 1, []), (306, 2, [0.5]), (307, 0, [0.0] * 6), (308, 9, [2.0] * 6), (309, 8, [-2.0] * 6)]
    out += [out[3], (5, 2, [9.0] * 6), (5, 0, [3.0] * 6)]  # a repeated row, and one id three times
    return out


@pytest.mark.parametrize("block, products, first", [(1 << 15, 1 << 21, 8), (4, 40, 1)])
def test_hard_negatives(spark, rows, monkeypatch, block, products, first):
    monkeypatch.setattr(negatives, "BLOCK", block)
    monkeypatch.setattr(negatives, "PRODUCTS", products)
    monkeypatch.setattr(negatives, "FIRST", first)
    table = spark.createDataFrame([(i, label, v, "v", 0) for i, label, v in rows], "vec_id long, label int, embedding array<float>, v string, cluster int").repartition(3)
    asked = [*range(0, 40, 3), 5, 205, 300, 305, 307, 308, 999, 3]
    anchors = spark.createDataFrame([(i,) for i in asked], "id long")
    import numpy as np

    single = [(i, label, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, label, v in rows]
    want = brute(single, sorted(set(asked)))
    assert len(want) > 60
    assert sorted(map(tuple, negatives.hard_negatives(table, anchors).collect())) == want
    if first == 1:
        assert sorted(map(tuple, negatives.hard_negatives(table, anchors, 2, 4, 20, 100).collect())) == brute(single, sorted(set(asked)), 2, 4, 20, 100)


def test_wide_products(spark):
    """Products too large for doubles are exact whole numbers."""
    rng = random.Random(1)
    rows = [(i, i % 2, [float(rng.randrange(1 << 20)) / 256 + (1 << 21) for _ in range(3)]) for i in range(40)]
    table = spark.createDataFrame(rows, "vec_id long, label long, embedding array<double>")
    anchors = spark.createDataFrame([(0,), (7,)], "id long")
    got = sorted(map(tuple, negatives.hard_negatives(table, anchors, high=100).collect()))
    assert got == brute(rows, [0, 7], high=100) and got


def test_too_wide(spark):
    table = spark.createDataFrame([(0, 1, [1e30]), (1, 2, [1.0])], "vec_id long, label long, embedding array<double>")
    with pytest.raises(Exception, match="32 bits"):
        negatives.hard_negatives(table, table.selectExpr("vec_id AS id")).collect()


def test_nothing_to_mine(spark):
    empty = spark.createDataFrame([], "vec_id long, label int, embedding array<float>")
    assert negatives.hard_negatives(empty, empty.selectExpr("vec_id AS id")).count() == 0
    alone = spark.createDataFrame([(50, 1, [1.0, 2.0])], empty.schema)
    assert negatives.hard_negatives(alone, alone.selectExpr("vec_id AS id")).count() == 0
    assert negatives.hard_negatives(alone, empty.selectExpr("vec_id AS id")).count() == 0
