"""Every operator against a brute-force version on a small fixture with awkward rows."""

import hashlib
import json
import math
import random
import zlib
from collections import Counter

import pytest

from strataweave.llm import bpe, decontaminate, html_text, lm, near, quality, quotes, substring, toxicity, warc

WORD = lambda t: [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", t or "") if w]


def low(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    vocab = [f"{a}{b}" for a in "ka mo re ti su".split() for b in "la ne ro shi gu".split()]
    prose = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    base, passage = prose(120), prose(70)
    changed = base.split()
    changed[40] = "changed"
    out = [base, base, " ".join(changed), prose(40) + " " + passage + " " + prose(30), prose(15) + "\n" + passage.upper(), prose(20) + "\t" + passage]
    out += [None, "", " \n\t ", "one", "four words and spaces ", prose(4000), "É ß x \x1c y z <|endoftext|>", "a b c a b c a b c\na b c\na b c"]
    out += [prose(rng.randint(1, 90)) for _ in range(20)]
    return list(enumerate(out))


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en", "s", None, i, t) for i, t in texts]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, w long, hashes string").repartition(3)


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def test_substring(spark, docs, texts, monkeypatch):
    first, want = {}, {}
    for i, t in texts:
        w = WORD(t)
        gone = [False] * len(w)
        for a in range(len(w) - 49):
            if first.setdefault(tuple(w[a : a + 50]), i) < i:
                gone[a : a + 50] = [True] * 50
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        want[i] = (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    assert any(x[1] for x in want.values())
    for group in (512, 3, 1):  # short prefixes, some longer ones, whole windows
        monkeypatch.setattr(substring, "GROUP", group)
        got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring.remove_repeats(docs).collect()}
        assert got == want
    assert substring.remove_repeats(empty(spark)).count() == 0
    left = {r.doc_id: r.text for r in substring.without_repeats(docs).collect()}
    assert 1 not in left and WORD(left[3]) == WORD(texts[3][1]) and len(WORD(left[5])) == 20


def test_substring_many_variants_of_one_passage(spark, monkeypatch):
    """More segments under one prefix than a group may have, around a passage that all documents share."""
    rng = random.Random(8)
    vocab = [f"w{i}" for i in range(30)]
    say = lambda n: [rng.choice(vocab) for _ in range(n)]
    passage = say(58)
    texts = [say(rng.randint(0, 40)) + passage[rng.randint(0, 5) : 58 - rng.randint(0, 5)] + say(rng.randint(0, 40)) for _ in range(60)]
    first, want = {}, {}
    for i, w in enumerate(texts):
        gone = [False] * len(w)
        for a in range(len(w) - 49):
            if first.setdefault(tuple(w[a : a + 50]), i) < i:
                gone[a : a + 50] = [True] * 50
        want[i] = sum(gone)
    monkeypatch.setattr(substring, "GROUP", 8)
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in substring.remove_repeats(docs).collect()} == want


def test_substring_very_long_text(spark):
    """A text of over 2^20 words is cut into overlapping parts; a passage at the cut is found."""
    n = substring.PART
    long = [f"w{i}" for i in range(n + 500)]
    rows = [(1, " ".join(long[n - 30 : n + 40])), (2, " ".join(long)), (3, " ".join(long[n + 440 :]))]
    got = {r.doc_id: (r.n_words, r.n_removed) for r in substring.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (70, 0), 2: (n + 500, 70), 3: (60, 60)}


def test_substring_repeated_ids_and_nulls(spark):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(1, long), (1, long), (None, long), (2, long + " tail"), (3, "x " * 51 + "x")]
    df = substring.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"))
    got = Counter((r.doc_id, r.n_words, r.n_removed) for r in df.collect())
    assert got == Counter({(1, 60, 0): 2, (None, 60, 0): 1, (2, 61, 60): 1, (3, 52, 0): 1})


def test_lm(spark, docs, texts):
    count = Counter()
    for i, t in texts:
        if zlib.crc32(str(i).encode()) % 5 != 1:
            count.update(WORD(t))
            count[None] += 1
    n, v = count.total(), len(count)
    rows = lm.score(docs).collect()
    assert len(rows) == len(texts)
    for r in rows:
        w = [*WORD(texts[r.doc_id][1]), None]
        base = sum(math.log10((count[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(count[x] > 0 for x in w), n)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 1)
        assert abs(r.base_score - base) < 1e-6 * abs(base) and r.score < 0 and math.isfinite(r.score)
    assert lm.score(empty(spark)).count() == 0


def test_lm_learns_from_the_words_before(spark):
    """Of two words that are equally frequent, the one that follows the word before is told in far fewer bits."""
    rng = random.Random(5)
    say = lambda: " ".join(f"{'fish' if (c := rng.choice('ab')) == 'a' else 'bird'} {'swims' if c == 'a' else 'flies'} x{rng.randrange(9)}" for _ in range(60))
    rows = [(i, say()) for i in range(200)]
    held = [i for i in range(200, 999) if not lm.is_train(i)][:4]
    rows += zip(held, ["fish swims", "fish flies", "bird flies", "bird swims"])
    got = {r.doc_id: r.score for r in lm.score(spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)).collect()}
    a, b, c, d = (got[i] for i in held)
    assert a > b + 0.5 and c > d + 0.5


def test_lm_more_buckets_than_groups(spark, texts):
    """A group of several buckets: hashes find their group and bucket, and scores stay close to those of fewer buckets."""
    import numpy as np

    h = np.random.default_rng(1).integers(0, 1 << 63, 9999).astype(np.uint64) * np.uint64(2)
    for buckets in (3, 256, 300, 1000):
        bucket, group = lm.dealt(h, buckets), lm.grouped(h)
        assert 0 <= bucket.min() and bucket.max() == buckets - 1 and 0 <= group.min() and group.max() == lm.GROUPS - 1
        low, high = (bucket, group) if buckets > lm.GROUPS else (group, bucket)
        assert len(set(zip(low.tolist(), high.tolist()))) == len(set(low.tolist()))
    rows = spark.createDataFrame(texts, "doc_id long, text string").coalesce(1)
    few, many = ({r.doc_id: r for r in lm.score(rows, buckets=n).collect()} for n in (5, 300))
    for i, r in few.items():
        assert r.n_known == many[i].n_known and abs(r.score - many[i].score) < 0.05 * abs(r.score) + 1


def test_lm_groups_are_a_distribution():
    """The chances of all groups in a context add up to one at most, own occurrences left out as if the token had not been counted."""
    import numpy as np

    rng = np.random.default_rng(4)
    shape = (16, lm.STATES, lm.GROUPS)
    counts = rng.integers(1, 9, shape) * (rng.random(shape) < 0.01)
    mixer = lm.Preceding(counts.sum(axis=0), counts)
    assert mixer.learn() == counts.sum()
    held, own = (x.astype(float) for x in mixer.bits())
    total = (2.0**-held).sum(axis=2)
    assert total.max() <= 1 + 1e-9 and total.min() > 0.97
    word, state, group = (int(x[0]) for x in np.nonzero(counts))
    less = counts.copy()
    less[word, state, group] -= 1
    again, _ = lm.Preceding(less.sum(axis=0), less, mixer.weights).bits()
    assert abs(float(again[word, state, group]) - own[word, state, group]) < 0.02
    assert (own >= held - 0.05)[counts > 0].mean() > 0.99


def test_lm_query_lower_cases(spark, tmp_path, monkeypatch):
    """The query's exact columns with capitals, odd spaces, nulls and counts told in parts; letters beyond A-Z keep their case."""
    texts = ["The Cat the cat THE", "É é the\x0bCAT\u00a0x", None, "", " \t\r\n", "Cat. cat. ÀB àb àB", "the " * 9] * 3
    texts = list(enumerate(texts))
    rows = [*texts, (None, "The end"), (-7, "CAT Novel")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(lm, "MOST", 2)
    count = Counter()
    for i, t in rows:
        if i is not None and zlib.crc32(str(i).encode()) % 5 != 1:
            count.update([*WORD(low(t or "")), None])
    n, v = count.total(), len(count)
    got = {r.doc_id: r for r in lm.op2_lm_score(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        w, r = [*WORD(low(t or "")), None], got[i]
        base = sum(math.log10((count[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(count[x] > 0 for x in w), n)
        assert r.held_out == (i is not None and zlib.crc32(str(i).encode()) % 5 == 1) and abs(r.base_score - base) < 1e-9 * abs(base)


def test_lm_is_a_distribution(spark):
    """The chances of all known words in a context add up to one, as do those of all next bytes of a spelling."""
    import numpy as np

    rng = np.random.default_rng(1)
    counts = rng.integers(0, 5, (37, lm.STATES))
    counts[:, 0] += 1
    for state in (0, 5):
        bits = lm.Tree(counts).bits(np.arange(37), np.full(37, state))
        assert abs((2.0**-bits).sum() - 1) < 1e-9
    slots = [(np.arange(0, 1 << (b + 8), 997), rng.integers(1, 9, len(range(0, 1 << (b + 8), 997)))) for b in lm.CONTEXTS]
    spelling = lm.Spelling(slots)
    spelling.learn([b"abc", b"bad", b"cab"], np.array([0, 3, 1]))
    spelling.ready()
    contexts = [np.full(256, c) for c in (5, 77, 1234, 999)]
    node, total = np.ones(256, int), np.zeros(256)
    for k in range(8):
        bit = (np.arange(256) >> (7 - k)) & 1
        p = spelling.chance(contexts, node, spelling.weights.astype(np.float32))
        total -= np.log2(np.where(bit == 1, p, 1 - p))
        node = 2 * node + bit
    assert abs((2.0**-total).sum() - 1) < 1e-9


def test_lm_mixer_learns_from_all_pairs(monkeypatch):
    """Each of the four passes goes over all 8000 pairs at each level, in parts."""
    import numpy as np

    seen, squash = [], lm.squash
    monkeypatch.setattr(lm, "squash", lambda x: seen.append(len(x)) or squash(x))
    counts = np.zeros((8000, lm.STATES), np.int64)
    counts[::2, 0], counts[1::2, 1] = 2, 400
    whole = lm.Tree(counts).bits(np.arange(1), np.zeros(1, int))
    assert sum(seen) > 4 * 12 * 8000
    monkeypatch.setattr(lm, "LEARN", 999)
    assert abs(lm.Tree(counts).bits(np.arange(1), np.zeros(1, int)) - whole).max() < 1e-9


def test_lm_mixer_sees_a_level_once(monkeypatch):
    """What a level's nodes predict is found once for all four passes."""
    import numpy as np

    seen, inputs = [], lm.Tree._inputs
    monkeypatch.setattr(lm.Tree, "_inputs", lambda *a: seen.append(1) or inputs(*a))
    counts = np.random.default_rng(2).integers(0, 5, (300, lm.STATES))
    tree = lm.Tree(counts + 1)
    assert len(seen) == tree.depth == 9
    monkeypatch.setattr(lm, "LEARN", 1000)
    assert np.abs(lm.Tree(counts + 1).weights - tree.weights).max() < 1e-9 and len(seen) > 5 * 9


def test_lm_counters_in_steps():
    """The gates and counters are those of the formulas that they stand for."""
    import numpy as np

    n = np.arange(70_000)
    for width, most in ((2, 7), (2, 3), (3, 3)):
        assert (lm.level(n, width, most) == np.minimum(most, np.log2(n + 1) // width)).all()
    n1, n = np.array([0, 0, 1, 3, 200_000], np.float32), np.array([0, 5, 1, 4, 200_000], np.float32)
    assert np.abs(lm.counted(n1, n) - lm.stretch(np.clip((n1.astype(float) + 0.05) / (n + 0.1), 1e-6, 1 - 1e-6))).max() < 1e-3


def test_lm_follows_phrases():
    """What is predicted after a phrase, by brute force: with and without a training text's own occurrence."""
    import numpy as np

    rng = random.Random(7)
    seen = Counter((rng.randrange(6), rng.randrange(4)) for _ in range(60))
    rows = sorted(seen)
    phrases = lm.Phrases(np.array([a for a, _ in rows], np.uint64), np.array([b for _, b in rows], np.uint64), np.array([seen[r] for r in rows]))
    ask = [(a, b) for a in range(8) for b in range(6)]
    held, own = phrases.ask(np.array([a for a, _ in ask], np.uint64), np.array([b for _, b in ask], np.uint64))
    for (a, b), h, o in zip(ask, held, own):
        follow = {y: n for (x, y), n in seen.items() if x == a}
        top = min(follow, key=lambda y: (-follow[y], y)) if follow else None
        assert (h > 0) == bool(follow) and (h > 0 and h % 2 == 0) == (top == b)
        if seen[a, b]:
            rest = follow | {b: follow[b] - 1}
            assert (o > 0) == any(rest.values())
            if o > 0 and o % 2 == 0:
                assert rest[b] == max(rest.values())


def test_lm_does_not_depend_on_order_or_buckets(spark, texts, monkeypatch):
    """Rows behind a shuffle, small batches and other buckets: the same counts, and scores that learn alike."""
    rows = spark.createDataFrame(texts, "doc_id long, text string")
    plain = {r.doc_id: r for r in lm.score(rows.coalesce(1)).collect()}
    monkeypatch.setattr(lm, "ASKED", 10)
    monkeypatch.setattr(lm, "WORDS", 7)
    turned = {r.doc_id: r for r in lm.score(rows.repartition(5, "text"), buckets=3).collect()}
    for i, r in plain.items():
        t = turned[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (t.n_tokens, t.n_known, t.train_tokens)
        assert abs(r.base_score - t.base_score) < 1e-6 * abs(r.base_score) and abs(r.score - t.score) < 0.05 * abs(r.score) + 1


def test_lm_raises_when_rows_change_between_readings(spark):
    """Chunks are named by their content: what was not asked for has no answers."""
    cost = lm._assemble(1, 1, __import__("numpy").full(8, 0.5), 4)
    import pyarrow as pa

    blob = (8).to_bytes(8, "little") + b"a b c d "[:8]
    docs = pa.table({"chunk": [1], "ids": [[1]], "size": [len(blob)], "texts": [pa.Codec("zstd").compress(blob, asbytes=True)]})
    none = pa.table({"chunk": pa.array([], pa.int64()), "bucket": pa.array([], pa.int32()), "size": pa.array([], pa.int32()), "costs": pa.array([], pa.binary())})
    with pytest.raises(ValueError, match="changed between two readings"):
        cost(docs, none)


def test_lm_byte_contexts_stay_apart():
    """Rows of the hashed tables that 20,000 novel words use, by the last one to four bytes."""
    import numpy as np

    words = [hashlib.md5(str(i).encode()).hexdigest().encode() for i in range(20_000)]
    contexts, _, _ = lm._byte_slots(words, np.arange(len(words)) % lm.STATES)
    assert [len(np.unique(c)) > n for c, n in zip(contexts, (80, 1200, 16_400, 8_200))] == [True] * 4


def test_near_duplicates(spark, docs, texts, monkeypatch):
    sets = {}
    for i, t in texts:
        w = WORD(low(t))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}
    label = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]) and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    want = {i: (len(sets[i]), label[i], label[i] == i) for i in sets}
    for blocks in ((1024, 256), (2, 2)):  # whole groups, then blocks with hubs and strays
        monkeypatch.setattr(near, "SIGNATURE_BLOCK", blocks[0])
        monkeypatch.setattr(near, "SET_BLOCK", blocks[1])
        got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near.near_duplicates(docs).collect()}
        assert got == want
    assert near.near_duplicates(empty(spark)).count() == 0


def test_near_duplicates_chain_in_blocks(spark, monkeypatch):
    """A chain of texts, each near the next only, stays one component however it is dealt."""
    words = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(12):
        for k in range(i * 6, i * 6 + 6):
            words[k] = f"v{k}"
        rows.append((i, " ".join(words)))
    monkeypatch.setattr(near, "SET_BLOCK", 3)
    got = near.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.component_id for r in got.collect()} == {0}


def test_near_duplicates_far_signatures(spark):
    """Pairs at exactly 0.85 whose signatures differ in 16 of 48 symbols are still linked."""
    rows = []
    for pair in (244, 5012):
        first = [f"w{pair}x{i}" for i in range(374)]
        second = list(first)
        for k in range(6):
            second[30 + 60 * k] = f"v{pair}x{k}"
        rows += [(2 * pair, " ".join(first)), (2 * pair + 1, " ".join(second))]
    got = near.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert all(r.component_id == r.doc_id - r.doc_id % 2 for r in got.collect())


def test_near_duplicates_recall_at_the_threshold(spark):
    """300 pairs at exactly 0.85 (340 of 400 shingles), and 300 right below it (339 of 401): all and none are linked."""
    rows = []
    for pair in range(600):
        first = [f"w{pair}x{i}" for i in range(374)]
        second = list(first)
        for k in range(6):
            second[30 + 60 * k] = f"v{pair}x{k}"
        if pair >= 300:
            second[-1] = "other"
        rows += [(2 * pair, " ".join(first)), (2 * pair + 1, " ".join(second))]
    got = near.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).filter("component_id <> doc_id").collect()
    assert {r.doc_id for r in got} == {2 * pair + 1 for pair in range(300)}


def test_near_duplicates_loss():
    """What is lost at the threshold, by signatures that meet nowhere and by those that are too far."""
    for threshold in (80, 85):
        p, (chunks, symbols) = threshold / 100, near.shape(threshold)
        apart = (1 - p**symbols - symbols * (1 - p) * p ** (symbols - 1)) ** chunks
        n, far = chunks * symbols, near.reach(threshold, chunks * symbols)
        assert far >= 2 * chunks - 1 and apart < 1e-5
        assert sum(math.comb(n, d) * (1 - p) ** d * p ** (n - d) for d in range(far + 1, n + 1)) < 1e-5


def test_quality(spark, docs, texts):
    labels = spark.createDataFrame([(0, 1, 0), (3, 1, 0), (13, 0, 0), (11, 1, 0), (11, 0, 1)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.quality(docs, labels).collect()}
    for i, t in texts:
        w = WORD(t)
        tri = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        covered = {k + j for k in range(len(w) - 2) if tri[tuple(w[k : k + 3])] > 1 for j in range(3)}
        lines = [x for x in (t or "").split("\n") if WORD(x)]
        failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""))
        assert (r.n_dup_lines, r.n_repeat_words, r.base_failed) == (len(lines) - len(set(lines)), len(covered), failed)
        assert not (failed and r.kept)
    assert got[0].kept
    none = quality.quality(docs, labels.filter("quality > 5"))
    assert {r.ratio_sum for r in none.collect()} == {0}
    assert quality.quality(empty(spark), labels).count() == 0


def test_quality_counts_repeats_in_a_very_long_text(spark):
    """Over 2^20 windows, of which the last ten repeat the first ten."""
    n = 1_100_000
    df = spark.sql(f"SELECT 1L AS doc_id, concat_ws(' ', transform(sequence(1, {n}), x -> concat('w', IF(x > {n - 12}, x - {n - 12}, x)))) AS text")
    r = quality.base_rules(df).select("n_words", "n_repeat_words", "base_failed").first()
    assert (r.n_words, r.n_repeat_words, r.base_failed) == (n, 24, False)


def test_quality_passes_clashing_columns_through(spark):
    names = ["w", "lines", "t", "g", "hashes", "h3", "s3", "p3", "kept", "n_words", "doc", "n_grams", "ratio_sum"]
    df = spark.createDataFrame([(1, "some text here", *range(13))], f"doc_id long, text string, {', '.join(n + ' int' for n in names)}")
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    row = quality.quality(df, labels).first()
    assert [row.doc[n] for n in names] == list(range(13)) and row.n_words == 3


def test_quality_rejects_junk(spark):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(300)]
    good = [(i, " ".join(rng.choices(words, k=80))) for i in range(60)]
    junk = [(100 + i, " ".join(w + "###" for w in rng.choices(words, k=80))) for i in range(15)]
    labels = spark.createDataFrame([(i, 1) for i in range(0, 60, 2)], "doc_id long, quality int")
    rows = quality.quality(spark.createDataFrame(good + junk, "doc_id long, text string"), labels).filter("kept").collect()
    assert {r.doc_id for r in rows} == {i for i, _ in good}


def test_warc(spark, tmp_path):
    big, other = "<p>" + "é" * 80 + "</p>", "<p>" + "x" * 200 + "</p>"
    rows = [(4, "u4", big), (2, "u2\r\n", big), (9, None, big), (5, "u5", "tiny"), (6, "u6", "tiny"), (7, "u7", None), (8, "u8", other), (8, "u8", other), (None, "n", other), (3, "u3", "a\r\n\r\nWARC/1.1\r\n\r\n" * 20)]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, payload int")
    path = f"file://{tmp_path}/a"
    warc.write_archives(pages, path)
    got = warc.reconstruct(warc.read_records(spark, path, with_payload=True)).collect()
    want = Counter()
    for i, _, h in rows:
        p = (h or "").encode()
        first = min((j for j, _, x in rows if x == h and j is not None), default=None)
        again = len(p) >= 100 and i != first
        want[i, len(p), hashlib.sha256(p).hexdigest(), "revisit" if again else "response", first if again else None, p] += 1
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, bytes(r.payload)) for r in got) == want
    assert {r.url for r in got if r.page_id == 2} == {"u2%0D%0A"}
    assert all(bytes(r.record) == bytes(r.header) + bytes(r.payload) and bytes(r.header).startswith(b"WARC/1.1") for r in got)
    records = warc.read_records(spark, path, with_payload=True)
    stored = warc.payloads(records).collect()
    assert len(stored) == len({r.payload_digest for r in stored}) == len({h or "" for _, _, h in rows})
    empty_path = f"file://{tmp_path}/b"
    warc.write_archives(pages.filter("page_id > 99"), empty_path)
    assert warc.reconstruct(warc.read_records(spark, empty_path)).count() == 0


def test_warc_members_and_long_heads():
    """One gzip member a record, padding, records larger than a piece, heads of any length, no final gap."""
    import gzip

    def record(i, payload):
        http = b"HTTP/1.1 200 OK\r\nX-Long: " + b"y" * 9000 + b"\r\n\r\n"
        return f"WARC/1.1\r\nwarc-type:response\r\nWARC-Record-ID: <{i}>\r\nContent-Length: {len(http + payload)}\r\n\r\n".encode() + http + payload + b"\r\n\r\n"

    rng = random.Random(3)
    bodies = [rng.randbytes(n) for n in (0, 5, 70_000, 300_000, 1, 65_536)] + [b"\r\n\r\nWARC/1.1\r\n" * 9]
    records = [record(i, b) for i, b in enumerate(bodies)]
    for whole in (b"".join(records), gzip.compress(b"".join(records)), b"".join(map(gzip.compress, records)), b"".join(map(gzip.compress, records)) + b"\0" * 512):
        found = list(warc.parse_archive(whole))
        assert [block[block.index(b"\r\n\r\n") + 4 :] for _, _, block in found] == bodies
        assert [f["warc-record-id"] for f, _, _ in found] == [f"<{i}>" for i in range(len(bodies))]
    with pytest.raises((ValueError, __import__("zlib").error)):
        list(warc.parse_archive(gzip.compress(b"".join(records))[:-20_000]))
    assert list(warc.parse_archive(b"")) == []


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header><h1>Site</h1></header>
<nav><ul><li><a href=/>Home</a></li></ul></nav><div class="cookie-notice">We use cookies</div>
<article><h1>Title &amp; more</h1><p>First   para
graph with <b>bold</b> text.<p>Second&nbsp;one.<br>Same block</p><aside>Related</aside><p>End.</p></article>
<section id="comments"><p>Nice article, thanks a lot for writing it!</p></section><div class="sidebar"><p>Side words</p></div>
<form><label>Mail</label></form><script>var x="<p>no</p>";</script><footer>&copy; 2024</footer></body></html>"""


def test_html(spark):
    want = "Title & more\nFirst para graph with bold text.\nSecond one. Same block\nEnd."
    assert html_text.main_text(PAGE) == want
    plain = "<html><body><div><a href=a>A</a> <a href=b>B</a></div><div><p>" + "Long text of the story. " * 9 + "</p><p>Short.</p></div></body></html>"
    assert html_text.main_text(plain).endswith("\nShort.") and "A B" not in html_text.main_text(plain)
    rows = [(1, "u", PAGE, "x"), (2, None, None, "x"), (3, "u", "", "x"), (4, "u", "<nav>only</nav>", "x"), (None, "u", "<![bad[<p>ok", "x")]
    got = {r.page_id: r for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()}
    assert got[1].text == want and got[1].n_chars == len(want)
    assert [got[i].text for i in (2, 3, 4)] == ["", "", ""]


def test_html_ratios_decide_on_marked_pages():
    story = "".join(f"<p>{'Long text of the story. ' * 12}</p>" for _ in range(8))
    teasers = "".join(f"<article><p><b>T</b> <i>{i}</i></p></article>" for i in range(8))
    got = html_text.main_text(f"<body><div>{story}</div>{teasers}</body>")
    assert got.count("Long text") == 96 and "T 7" not in got
    got = html_text.main_text(f"<body><article><h1>Title</h1>{story}</article><div>{'<p><b>a</b> <i>b</i></p>' * 8}</div></body>")
    assert got.startswith("Title") and got.count("Long text") == 96 and "a b" not in got
    got = html_text.main_text(f"<body><article>{story}</article><article class='related'>{story.replace('Long', 'Other')}</article></body>")
    assert got.count("Long text") == 96 and "Other" not in got


def made_page(rng, marked, sigma=None):
    """A page and its main text: an article among furniture, known by tags, by class words, or by its links alone."""
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    title, paragraphs = say(6), [say(rng.randint(25, 60)) for _ in range(rng.randint(3, 9))] + ["Short end."]
    links = lambda n: "".join(f"<li><a href=/{i}>{say(2)}</a></li>" for i in range(n))
    around = [f"<div class='x{i}'><ul>{links(5)}</ul></div>" for i in range(3)] + ["<div><a href=a>One</a> | <a href=b>Two</a></div>", "<nav>Menu</nav>", f"<div class='cookie-notice'><p>{say(30)}</p></div>"]
    rng.shuffle(around)
    story = "".join(f"<p>{x.replace('beta', '<i>beta</i>', 1)}</p>" for x in paragraphs)
    body = f"<article><h1>{title}</h1>{story}</article>" if marked else f"<div class='c{rng.randint(1, 9)}'><h1>{title}</h1><div>{story}</div></div>"
    page = "<html><body>" + "".join(around[:3]) + body + "".join(around[3:]) + f"<div id=comments-list><p>{say(40)}</p></div><footer>{say(20)}</footer></body></html>"
    return page, "\n".join([title, *paragraphs])


def test_html_on_made_pages():
    rng = random.Random(11)
    for k in range(120):
        page, want = made_page(rng, k % 2)
        assert html_text.main_text(page) == want, page


def test_html_needs_its_ratios(monkeypatch):
    """A cloud of short words among tags, with lone long lines: only smoothed ratios above a threshold tell it from the story."""
    dense = "".join("<p><b>aa</b> <i>bb</i> <u>cc</u> <b>dd</b></p>" for _ in range(25))
    cloud = "<div>" + "".join(dense + f"<p>{'lone line ' * 25}</p>" for _ in range(7)) + dense + "</div>"
    story = [("Sentence of the story. " * (9 + k)).strip() for k in range(8)]
    page = f"<body>{cloud}<div>" + "".join(f"<p>{x}</p>" for x in story) + "</div></body>"
    want = "\n".join(story)
    assert html_text.main_text(page) == want
    with monkeypatch.context() as m:
        m.setattr(html_text, "threshold", lambda values: 0.0)
        assert html_text.main_text(page) != want
    with monkeypatch.context() as m:
        m.setattr(html_text, "smoothed", lambda ratios: ratios)
        assert html_text.main_text(page) != want


def test_html_class_words():
    story = "".join(f"<p>{'Long text of the story. ' * 12}</p>" for _ in range(4))
    got = html_text.main_text(f"<article>{story}<p class='notice-period'>Two months.</p><div class='related'><p>{'Prose on a related case. ' * 9}</p></div><div class='ad ad-1'>Buy</div><div class='comments-area'><p>First!</p></div></article>")
    assert "Two months." in got and "related case" in got and "Buy" not in got and "First!" not in got


def test_html_keeps_long_pages_whole():
    story = [f"Paragraph {i} " + "of a very long page " * 20 for i in range(5000)]
    assert html_text.main_text("<article>" + "".join(f"<p>{x}</p>" for x in story) + "</article>") == "\n".join(x.strip() for x in story)
    assert html_text.main_text("<div>" * 3000 + "<p>" + "deep text " * 30 + "</p>" + "</div>" * 3000) == ("deep text " * 30).strip()


def test_quotes(spark):
    rows = [
        (1, 0, "u", "Hello  there\nHow are you?\n\nSecond para."),
        (1, 1, "a", "> How are you?\nfine"),
        (1, 2, "u", "On Monday X wrote:\n> > how are YOU?\n> fine\nGreat"),
        (1, 3, "a", ">hello there\n> how are\n> you?\nok"),
        (1, 4, "b", None),
        (None, 0, "u", "x"),
        (2, 5, "u", "> unknown words\nreply"),
        (2, 5, "u", "> unknown words\nreply"),
    ]
    df = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, body string")
    got = Counter(tuple(r) for r in quotes.link(df).collect())
    assert got == Counter(
        {
            (1, 0, "u", rows[0][3], 0, 0, 0, None, None, 0, 0): 1,
            (1, 1, "a", "fine", 1, 1, 1, 0, "quote", 0, 1): 1,
            (1, 2, "u", "Great", 2, 2, 2, 1, "quote", 0, 2): 1,
            (1, 3, "a", "ok", 1, 4, 2, 0, "quote", 0, 1): 1,
            (1, 4, "b", "", 0, 0, 0, 3, "turn", 0, 2): 1,
            (None, 0, "u", "x", 0, 0, 0, None, None, None, None): 1,
            (2, 5, "u", "reply", 1, 1, 0, None, None, 5, 0): 2,
        }
    )
    assert quotes.link(df.filter("turn > 90")).count() == 0


def test_quotes_agree_with_sql_on_made_conversations(spark, tmp_path):
    """Conversations that quote, nest, attribute, repeat and skip turns: the SQL finds the same links and threads."""
    import duckdb

    from strataweave.llm import oracles

    rng = random.Random(21)
    say = lambda: " ".join(rng.choice("yes no maybe tea milk rain sun".split()) for _ in range(rng.randint(1, 6)))
    rows = []
    for c in range(25):
        said: list[str] = []
        for turn in range(rng.randint(1, 9)):
            if rng.random() < 0.1:
                continue
            lines = []
            if said and rng.random() < 0.7:
                source = rng.choice(said)
                if rng.random() < 0.4:
                    lines.append("On Monday Ann wrote:")
                for line in source.split("\n")[: rng.randint(1, 5)]:
                    lines.append(rng.choice(["> ", ">", "  > "]) + (line.upper() if rng.random() < 0.2 else line))
                if rng.random() < 0.3:
                    lines.append("> something nobody said")
            lines += [say() for _ in range(rng.randint(0, 3))] + ([""] + [say()] if rng.random() < 0.3 else [])
            text = rng.choice(["\n", "\r\n"]).join(lines)
            said.append("\n".join(lines))
            rows += [(c, turn, rng.choice("ua"), text)] * (2 if rng.random() < 0.1 else 1)
            if rng.random() < 0.1:
                rows.append((c, turn, "b", f"> {say()}\nother version"))
    rows += [(None, 1, "u", "> x\ny"), (3, None, "u", "> x"), (4, 90, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    df.coalesce(1).write.parquet(f"{tmp_path}/c")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/c/*.parquet'")
    found = con.execute(oracles.OP7)
    names = [x[0] for x in found.description]
    want = Counter(tuple(map(str, r)) for r in found.fetchall())
    got = quotes.link(df).select(*names).collect()
    assert Counter(tuple(map(str, r)) for r in got) == want
    assert sum(r.parent_by == "quote" for r in got) > 20 and max(r.depth or 0 for r in got) > 2


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_levenshtein_automaton():
    terms = {"idiot": 3.0, "worthless": 2.0, "scum": 1.0, "stupid": 1.5}
    m = toxicity.Matcher(terms, {"lowe": 1.0})
    rng = random.Random(5)
    words = ["idiot", "idi0t", "idoit", "worthles", "wrthles", "scum", "scam", "loweiun", "low", "stupids", "", "the"]
    for t in terms:
        for _ in range(150):
            w = list(t)
            for _ in range(rng.randint(1, 3)):
                k = rng.randrange(len(w) + 1)
                kind = rng.choice("rid")
                w[k : k + (kind != "i")] = [] if kind == "d" else [rng.choice("abcdeo")]
            words.append("".join(w))
    for w in words:
        near = sorted((edits(w, t), t) for t in terms if edits(w, t) <= toxicity.edits_for(t))
        found = m.find(w)
        if w.startswith("lowe"):
            assert found[0] == "lowe"
        else:
            assert (found[1], found[0]) == near[0] if near else found is None, w


def test_toxicity_trusts_short_words_by_their_neighbours(spark):
    """``zorg`` may be misspelled, ``quex`` may not: clean texts have ``quez``."""
    rng = random.Random(10)
    vocab = [a + b + c for a in ("bal", "kon", "mit") for b in ("la", "ne", "ro", "su") for c in ("", "n", "shi")]
    rows, labels = [], []
    for i in range(400):
        w = rng.choices(vocab, k=60)
        if i % 4 == 0:
            for _ in range(4):
                w[rng.randrange(60)] = rng.choice(["zorg", "quex"])
        else:
            w[0] = "quez"
        rows.append((i, " ".join(w)))
        labels.append((i, int(i % 4 == 0)))
    train = toxicity.labelled(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    words, stems = toxicity.learn_lexicon(train)
    assert set(words) >= {"zorg", "quex"}
    trusted = toxicity.trusted_short(train, words, stems)
    assert "zorg" in trusted and "quex" not in trusted
    m = toxicity.Matcher(words, stems, trusted)
    assert m.find("zor")[:2] == ("zorg", 1) and m.find("quez") is None


def test_toxicity_held_out(spark):
    """On the test tables' documents, all held-out labels are told apart, whatever is learned from the others."""
    read = lambda name: spark.read.parquet(f"/root/testdata/sf0.01/{name}.parquet")
    got = toxicity.toxicity(read("documents"), read("labels")).filter("held_out").join(read("labels"), "doc_id").collect()
    wrong = [r for r in got if r.predicted != r.toxic]
    assert len(got) > 50 and len(wrong) <= 0.03 * len(got)


def test_toxicity(spark):
    rng = random.Random(9)
    vocab = [a + b + c for a in ("ba", "ko", "mi") for b in ("la", "ne", "ro", "su") for c in ("", "n", "shi")]
    rows, labels = [], []
    for i in range(400):
        w = rng.choices(vocab, k=60)
        if i % 4 == 0:
            for _ in range(3):
                w[rng.randrange(60)] = rng.choice(["zorgwit", "quexify"])
        rows.append((i, " ".join(w), "x"))
        labels.append((i, 1, int(i % 4 == 0)))
    rows += [(1000, None, "x"), (1001, "", "x"), (None, "zorgwit quexify zorgwit", "x"), (1002, "quexify zorgvit zorgwit zorgwit", "x")]
    rows += [(1003, 'she said "zorgwit" ' + " ".join(vocab), "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(docs, lab).collect()}
    assert all(got[i].predicted == int(i % 4 == 0) for i in range(400))
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in range(400))
    assert [got[i].predicted for i in (1000, 1001, 1002, 1003)] == [0, 0, 1, 0]
    assert {r.predicted for r in toxicity.toxicity(docs, lab.filter("toxic > 5")).collect()} == {0}


def test_bpe(spark, docs, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.tokenizer_path())
    rows = {r.doc_id: r for r in bpe.encode(docs).collect()}
    for i, text in texts:
        ids = t.encode(text or "", add_special_tokens=False).ids
        back = t.decode(ids, skip_special_tokens=False)
        r = rows[i]
        assert (r.n_tokens, list(r.ids), r.decoded) == (len(ids), ids, back)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(back.encode()).hexdigest()
    for buckets in (1, 9):
        again = bpe.encode(docs.repartition(7, "text"), buckets=buckets).collect()
        assert Counter((r.doc_id, tuple(r.ids), r.decoded) for r in again) == Counter((r.doc_id, tuple(r.ids), r.decoded) for r in rows.values())
    joined = bpe.decode(bpe.encode(docs).select("doc_id", "ids", "decoded").withColumnRenamed("decoded", "want"), bpe.vocabulary(spark))
    assert joined.filter("decoded <> want").count() == 0 and joined.count() == len(texts)
    assert bpe.encode(empty(spark)).count() == 0


def test_bpe_raises_when_rows_change_between_readings():
    import pyarrow as pa

    blob = (8).to_bytes(8, "little") + b"a b c d "
    docs = pa.table({"chunk": [1], "ids": [[1]], "size": [len(blob)], "texts": [pa.Codec("zstd").compress(blob, asbytes=True)]})
    none = pa.table({"chunk": pa.array([], pa.int64()), "bucket": pa.array([], pa.int32()), "size": pa.array([], pa.int32()), "ids": pa.array([], pa.binary())})
    with pytest.raises(ValueError, match="changed between two readings"):
        bpe._assemble(bpe.tokenizer_path(), 4, ())(docs, none)


def test_decontamination(spark, docs, texts):
    part = " ".join(WORD(texts[11][1])[1000:1060])
    dirty = part.split()
    dirty[5] = dirty[40] = "other"
    bench = [(0, part.upper()), (1, " ".join(dirty)), (2, "nothing of it is there at all I hope"), (3, None), (4, ""), (5, "one"), (6, texts[0][1][:200]), (7, " ".join(WORD(texts[11][1])[2000:2003]))]
    items = spark.createDataFrame([(*b, 1) for b in bench], "item_id long, text string, n int")
    sets = lambda t: {tuple(w[k : k + 5]) for w in [WORD((t or "").lower())] for k in range(max(1, len(w) - 4)) if w}
    want = {}
    for i, t in texts:
        for j, b in bench:
            q = sets(b)
            if q and 100 * len(q & sets(t)) >= 80 * len(q):
                want[i, j] = (len(q), len(q & sets(t)))
    for j, b in bench:  # items below five words, inside texts of more
        q = WORD((b or "").lower())
        for i, t in texts:
            w = WORD((t or "").lower())
            if 0 < len(q) < 5 and any(w[k : k + len(q)] == q for k in range(len(w))):
                want[i, j] = (1, 1)
    got = {(r.doc_id, r.item_id): (r.n_item_shingles, r.n_shared) for r in decontaminate.contaminated(docs, items).collect()}
    assert got == want and (11, 0) in want and (11, 1) in want and (11, 7) in want
    assert decontaminate.contaminated(empty(spark), items).count() == 0
    assert decontaminate.contaminated(docs, items.filter("item_id > 99")).count() == 0


def test_registry():
    from strataweave.llm import registry

    assert sorted(registry.queries(), key=lambda n: int(n[2:].split("_")[0])) == [n for n in sorted(registry.MODULES, key=lambda n: int(n[2:].split("_")[0]))]
    assert {n[2:].split("_")[0] for n in registry.queries()} == {str(i) for i in range(1, 14)}
    assert set(registry.oracle_sql()) <= set(registry.queries())
    assert json.dumps(registry.oracle_sql())
