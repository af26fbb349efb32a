"""MinHash near-duplicates by a multi-index Hamming join.

Exact copies (equal shingle sets) collapse into one node first. A node's signature has
``chunks * symbols`` min-hashes of 16 bits. Signatures are cut into chunks; for each chunk the
one allowed error is enumerated by leaving out each symbol in turn, so signatures that differ
in one symbol of a chunk share a key there. By the pigeonhole principle two signatures at a
distance of ``2 * chunks - 1`` or less have a chunk with one error at most, so every such pair
meets under a key. Signatures that meet are linked when their distance is at most ``reach``,
which loses less than ``LOSS`` of the pairs at the threshold; the components of these links are
families. In each family, links are confirmed on full shingle sets: 100 * intersection >=
``threshold`` * union.

A pair at exactly 0.85 (8 chunks of 6 symbols) meets nowhere with a probability of 6.2e-6 and
is dropped at its distance (21 of 48 or more) with 1.8e-6; at 0.80 (10 chunks of 5) these are
1.6e-6 and 2.1e-6 (25 of 50 or more). Both fall quickly with the similarity.

Both steps run through ``graph.block_links``: groups of any size are dealt to blocks, no pairs
of a group are listed. Repeated rows are copies. Rows that share a doc_id count as one
document. Null doc_ids, null and blank texts link with nothing. An empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, bounded_batches, read, settle
from .graph import block_links, components
from .hashing import WordHash, shingle_set

WIDTH = 5
THRESHOLD = 85
LOSS = 5e-6
SIGNATURE_BLOCK, SET_BLOCK = 1024, 256

_rng = np.random.default_rng(20240229)
_MULTIPLY = _rng.integers(1, 1 << 63, 128, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FLIP = _rng.integers(0, 1 << 63, 128, dtype=np.uint64)


def shape(threshold: int) -> tuple[int, int]:
    """Chunks and symbols a chunk: the longest chunks whose pairs at the threshold meet nowhere with at most 1e-5."""
    p = threshold / 100
    for symbols, chunks in ((6, 8), (5, 10), (4, 12), (3, 16), (2, 24)):
        if (1 - p**symbols - symbols * (1 - p) * p ** (symbols - 1)) ** chunks <= 1e-5:
            return chunks, symbols
    raise ValueError(f"a threshold of {threshold} is too low for signatures")


def reach(threshold: int, length: int) -> int:
    """The least distance beyond which less than ``LOSS`` of the pairs at the threshold lie."""
    p, lost = 1 - threshold / 100, 0.0
    for d in range(length, 0, -1):
        lost += math.comb(length, d) * p**d * (1 - p) ** (length - d)
        if lost > LOSS:
            return d
    return 0


def signature(shingles: np.ndarray, length: int) -> np.ndarray:
    """16 bits of each min-hash."""
    least = np.array([((shingles ^ f) * m).min() for m, f in zip(_MULTIPLY[:length], _FLIP[:length])], np.uint64)
    return ((least * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)).astype(np.uint16)


def chunk_keys(sig: np.ndarray, chunks: int, symbols: int) -> np.ndarray:
    """The keys of a signature: every chunk with each of its symbols left out."""
    s = sig.reshape(chunks, symbols).astype(np.uint64)
    at = np.arange(symbols, dtype=np.uint64)
    place = np.arange(chunks, dtype=np.uint64)[:, None] * np.uint64(symbols)
    with np.errstate(over="ignore"):
        mixed = (s + at * np.uint64(0x10001) + np.uint64(1)) * np.uint64(0xFF51AFD7ED558CCD)
        mixed ^= mixed >> np.uint64(31)
        mixed *= np.uint64(0xC4CEB9FE1A85EC53)
        mixed ^= mixed >> np.uint64(33)
        rest = mixed.sum(axis=1, dtype=np.uint64)[:, None] - mixed
        keys = (rest + place + at + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    return (keys ^ (keys >> np.uint64(32))).astype(np.int64).ravel()


def _sketch(width: int, length: int):
    def run(batches):
        from hashlib import blake2b

        import pyarrow as pa

        words = WordHash()
        for batch in batches:
            ids, sizes, digests, sigs = batch.column(0), [], [], []
            for text in batch.column(1).to_pylist():
                s = shingle_set(words.array((text or b"").translate(LOWER).split()), width)
                sizes.append(len(s))
                digests.append(blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                sigs.append(signature(s, length).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(sigs, pa.binary())], names=["doc_id", "n", "digest", "sig"]
            )

    return run


def _keys(chunks: int, symbols: int):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            nodes = batch.column(0).to_numpy()
            sigs = [np.frombuffer(s, np.uint16) for s in batch.column(2).to_pylist()]
            keys = np.concatenate([chunk_keys(s, chunks, symbols) for s in sigs]) if sigs else np.empty(0, np.int64)
            each = chunks * symbols
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys), pa.array(np.repeat(nodes, each)), pa.array(np.repeat(batch.column(1).to_numpy(), each))], names=["g", "node", "weight"]
            )

    return run


def _sets(width: int):
    def run(batches):
        import pyarrow as pa

        words = WordHash()
        for batch in batches:
            sets = [shingle_set(words.array((t or b"").translate(LOWER).split()), width).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["node", "payload"])

    return run


def near_signatures(far: int):
    """Which signatures are at a distance of ``far`` or less, for all pairs of a list."""

    def run(loads: list[bytes]) -> np.ndarray:
        s = np.frombuffer(b"".join(loads), np.uint16).reshape(len(loads), -1)
        if len(s) == 2:
            near = (s[0] != s[1]).sum() <= far
            return np.array([[False, near], [near, False]])
        distance = np.zeros((len(s), len(s)), np.uint8)
        for column in s.T:
            distance += column[:, None] != column[None, :]
        return distance <= far

    return run


def similar_sets(threshold: int):
    """Which sets have 100 * intersection >= threshold * union, for all pairs of a list."""

    def run(loads: list[bytes]) -> np.ndarray:
        sets = [np.frombuffer(x, np.uint64) for x in loads]
        sizes = np.array([len(x) for x in sets])
        n = len(sets)
        if n == 2:
            both = np.intersect1d(sets[0], sets[1], assume_unique=True).size
            near = 100 * both >= threshold * (sizes.sum() - both)
            return np.array([[False, near], [near, False]])
        owner = np.repeat(np.arange(n), sizes)
        values, column = np.unique(np.concatenate(sets), return_inverse=True)
        shared = np.bincount(column, minlength=len(values)) > 1
        order = np.argsort(column, kind="stable")
        order = order[shared[column[order]]]
        owner, column = owner[order], column[order]
        both = np.zeros((n, n))
        step = max(1, (16 << 20) // n)
        starts = np.flatnonzero(np.r_[True, column[1:] != column[:-1]]) if len(column) else np.empty(0, int)
        dense = np.cumsum(np.r_[0, column[1:] != column[:-1]]) if len(column) else column
        for low in range(0, len(starts), step):
            part = slice(starts[low], starts[low + step] if low + step < len(starts) else len(column))
            m = np.zeros((n, min(step, len(starts) - low)), np.float32)
            m[owner[part], dense[part] - low] = 1
            both += m @ m.T
        return 100 * both >= threshold * (sizes[:, None] + sizes[None, :] - both)

    return run


def near_duplicates(docs: DataFrame, threshold: int = THRESHOLD, width: int = WIDTH) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of ``docs``."""
    bounded_batches(docs.sparkSession)
    chunks, symbols = shape(threshold)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    rows = settle(texts.mapInArrow(_sketch(width, chunks * symbols), "doc_id long, n long, digest binary, sig binary"), "near-rows")
    full = rows.filter("digest IS NOT NULL AND doc_id IS NOT NULL")
    classes = full.groupBy("digest").agg(F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("weight"))
    classes = settle(classes, "near-classes")
    sigs = full.select("doc_id", "digest", "sig").join(classes.select("digest", F.col("node").alias("doc_id"), "weight"), ["digest", "doc_id"])
    sigs = settle(sigs.select(F.col("doc_id").alias("node"), "weight", "sig").dropDuplicates(["node"]), "near-sigs")

    keyed = sigs.mapInArrow(_keys(chunks, symbols), "g long, node long, weight long")
    met = block_links(keyed, sigs.select("node", F.col("sig").alias("payload")), near_signatures(reach(threshold, chunks * symbols)), SIGNATURE_BLOCK, "near-met")
    # Rows with one doc_id are one document, whatever their texts.
    same_id = full.groupBy("doc_id").agg(F.min("digest").alias("x"), F.max("digest").alias("y")).filter("x <> y")
    ids = full.join(same_id.select("doc_id"), "doc_id", "left_semi").join(classes, "digest").filter("doc_id <> node")
    tied = settle(ids.select(F.col("doc_id").alias("a"), F.col("node").alias("b")), "near-tied")

    family = components(met, "near-family")
    members = settle(family.join(sigs.select("node", "weight"), "node").select(F.col("label").alias("g"), "node", "weight"), "near-members")
    wanted = texts.join(members.select(F.col("node").alias("doc_id")), "doc_id", "left_semi")
    sets = settle(wanted.mapInArrow(_sets(width), "node long, payload binary").dropDuplicates(["node"]), "near-sets")
    links = block_links(members, sets, similar_sets(threshold), SET_BLOCK, "near-links").unionByName(tied)
    label = components(links, "near-label")

    named = classes.join(label, "node", "left").select("digest", F.coalesce("label", "node").alias("component_id"))
    out = rows.select("doc_id", "n", "digest").join(settle(named, "near-named"), "digest", "left")
    return out.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"),
        F.coalesce(F.col("doc_id") == F.coalesce("component_id", "doc_id"), F.lit(True)).alias("kept"),
    )


def op3_near_duplicates(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))
