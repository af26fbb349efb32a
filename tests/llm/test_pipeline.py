"""The pipeline against a brute-force version of its stages on a small table."""

import random

import corpus_pipeline


def test_pipeline(spark, tmp_path):
    from tokenizers import Tokenizer

    from strataweave.llm import bpe

    rng = random.Random(2)
    vocab = [a + b for a in "ka mo re ti su na pe".split() for b in "la ne ro shi gu va".split()]
    prose = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    clean = {i: prose(rng.randint(80, 160)) for i in range(40)}
    passage, leak = prose(60), prose(40)
    docs = dict(clean)
    docs[40] = clean[3]  # exact copy
    docs[41] = clean[5] + " tail"  # near copy
    docs[42], docs[43] = prose(70) + " " + passage, passage + " " + prose(75)
    docs[44] = prose(50) + " " + leak + " " + prose(50)
    docs[45] = " ".join(w + "###" for w in prose(90).split())  # junk
    docs[46], docs[47], docs[48] = "short", "", None
    rows = [(i, t, "en", "s", len(t or "")) for i, t in docs.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(30)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    want = dict(clean) | {42: docs[42], 43: " ".join(docs[43].split()[60:])}
    t = Tokenizer.from_file(bpe.tokenizer_path())
    got = {r.doc_id: list(r.ids) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got == {i: t.encode(x, add_special_tokens=False).ids for i, x in want.items()}

    stage = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, f in corpus_pipeline.STAGES[:-1]:
        assert f(spark, stage, str(tmp_path)).columns == stage.columns
        assert f(spark, stage.limit(0), str(tmp_path)).count() == 0


def test_stages_on_awkward_rows(spark, tmp_path):
    """Clashing column names, null and repeated ids, blank and very long texts, ties."""
    names = ["w", "t", "lines", "g", "hashes", "h3", "kept", "doc", "id", "leak", "number", "spans", "d", "_n", "_text", "label", "n_words"]
    rng = random.Random(6)
    vocab = [a + b for a in "ka mo re ti su na pe".split() for b in "la ne ro shi gu va".split()]
    prose = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    long, twice = prose(200_000), prose(90)
    rows = [(1, long), (2, prose(80)), (2, prose(85)), (3, twice), (3, twice), (None, prose(90)), (None, None), (4, None), (5, " \n "), (6, twice), (7, prose(70) + " " + " ".join(long.split()[500:600]))]
    docs = spark.createDataFrame([(i, t, *range(len(names))) for i, t in rows], f"doc_id long, text string, {', '.join(f'`{n}` int' for n in names)}")
    spark.createDataFrame([(2, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, prose(40)), (1, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = {name: stage(spark, docs, str(tmp_path)).collect() for name, stage in corpus_pipeline.STAGES}
    for name, _ in corpus_pipeline.STAGES[:-1]:
        assert all(list(r[2:]) == list(range(len(names))) for r in kept[name]), name
    assert sorted((r.doc_id or 0 for r in kept["quality"]), key=str) == sorted([0, 2, 2, 3, 3, 6, 7] + [1] * (1 in {r.doc_id for r in kept["quality"]}), key=str)
    near = kept["near_duplicates"]
    assert sorted(r.doc_id for r in near if r.doc_id is not None) == [1, 2, 3, 4, 5, 7] and sum(r.doc_id is None for r in near) == 2
    assert len(next(r.text for r in near if r.doc_id == 2).split()) == 85
    cut = {(r.doc_id, len((r.text or "").split())) for r in kept["substring"]}
    assert (7, 70) in cut and (1, 200_000) in cut and (3, 90) in cut and not any(i == 6 for i, _ in cut)
    assert len(kept["decontamination"]) == len(rows) and len(kept["bpe"]) == len(rows)


def test_near_stage_links_at_080(spark):
    """Similarities of 352 / 432 = 0.815 and 347 / 437 = 0.794: only the first is a near-duplicate."""
    rows = []
    for i, changes in enumerate((0, 8, 9)):
        words = [f"w{k}" for k in range(396)]
        for k in range(changes):
            words[(20 if i == 1 else 30) + 40 * k] = f"v{i}x{k}"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()} == {0, 2}
