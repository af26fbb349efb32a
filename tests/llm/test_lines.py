"""Line dedup against brute force, with awkward rows, and its runs batch by batch."""

import random

import pytest

from strataweave.llm import lines

SPACE = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(SPACE))


def brute(rows, least_chars=40, least_docs=5):
    held = {}
    for d, text in rows:
        for line in (text or "").split("\n"):
            if d is not None and len(key(line)) >= least_chars:
                held.setdefault(key(line), set()).add(d)
    gone = lambda d, line: d is not None and len(key(line)) >= least_chars and len(held[key(line)]) >= least_docs and d < max(held[key(line)])
    out = []
    for d, text in rows:
        all_lines = (text or "").split("\n")
        kept = [x for x in all_lines if not gone(d, x)]
        out.append((d, len(all_lines), len(all_lines) - len(kept), "\n".join(kept)))
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(13)
    long = ["Ünïcode lines of more than forty code points count " + str(i) for i in range(6)]
    shared = ["A Line Shared By Many Documents, Well Over Forty Characters", "exactly thirty-nine characters are here", "exactly forty characters are found here."]
    out = [(None, shared[0] + "\n" + shared[0]), (1, None), (2, ""), (3, "\n"), (4, "\n\n"), (5, shared[0]), (6, shared[0].upper() + "\r\n\t " + shared[0] + " \x0b")]
    out += [(7, "x\n" + shared[0] + "\n" + shared[2]), (7, "another text of document 7\n" + shared[0]), (7, "another text of document 7\n" + shared[0])]
    out += [(i, "\n".join(rng.choice(long + shared) + rng.choice(["", " ", "\t"]) for _ in range(rng.randint(1, 8)))) for i in range(8, 60)]
    out += [(60, "\n".join(f"line {i} of a very long text, distinct from all others" for i in range(20_000))), (-1, shared[2] + "\n" + shared[1])]
    return out


def test_line_dedup(spark, rows):
    docs = spark.createDataFrame([(d, t, "gone", 1, "k") for d, t in rows], "doc_id long, text string, gone string, k1 int, lines string").repartition(3)
    order = lambda r: (r[0] is None, r[0] or 0, r[3])
    want = sorted(brute(rows), key=order)
    assert sum(r[2] for r in want) > 50
    done = lines.without_repeated_lines(docs)
    got = sorted(((r.doc.doc_id, r.n_lines, r.n_dropped, r.kept) for r in done.collect()), key=order)
    assert got == want
    assert done.first().doc.gone == "gone"
    got = sorted(((r.doc.doc_id, r.n_lines, r.n_dropped, r.kept) for r in lines.without_repeated_lines(docs, least_chars=3, least_docs=2, batches=5, fanout=2).collect()), key=order)
    assert got == sorted(brute(rows, 3, 2), key=order)


def test_line_dedup_of_nothing(spark):
    assert lines.without_repeated_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    all_null = spark.createDataFrame([(None, None), (1, None)], "doc_id long, text string")
    assert [(r.n_lines, r.n_dropped, r.kept) for r in lines.without_repeated_lines(all_null).collect()] == [(1, 0, "")] * 2


def test_runs_stay_few_and_frequent_keys_stop_to_grow_them(spark):
    runs = lines.LineRuns(spark, 10, least_docs=3, fanout=2)
    for b in range(7):
        batch = spark.range(10 * b, 10 * b + 10).selectExpr("id AS doc_id", "IF(id % 2 = 0, 1, id) AS k1", "0L AS k2")
        runs.add(batch, str(b))
        runs.add(batch, str(b))  # a replay changes nothing
        assert len(runs.runs()) == bin(b + 1).count("1")
    assert [(r.k1, r["last"]) for r in runs.found().collect()] == [(1, 68)]
    # An older batch has nothing to add to a key that is known in enough documents.
    before = runs.found().first().n
    runs.add(spark.createDataFrame([(-5, 1, 0), (-6, 1, 0), (-7, 1, 0)], "doc_id long, k1 long, k2 long"), "older")
    assert runs.found().first().n == before
    runs.close()
