"""BPE encoding and decoding through a distinct-word table.

Texts are cut into words at ASCII white space, which no token of the vocabulary crosses.
Each task packs its documents into chunks and sends the chunk's distinct words to buckets of
the distinct-word table, by a hash of the word. A task goes through a bucket's rows one by one
and encodes each distinct word once, whatever number of chunks asks for it; it holds the
bucket's words, not its rows. The ids come back to the chunk, where they are joined to the
words by position and, through the id-to-piece table of the vocabulary, turned into decoded
text again. Words, not their occurrences, are shuffled, so a frequent word costs one entry a
chunk and no key is hot.

A chunk is named by a digest of its documents, so answers can't meet other words than those
asked for. The input is read twice; if it isn't a plain scan of files, it is written first. Where
a chunk still has no answers, because rows changed in between, the job fails.

A null text is an empty one: no tokens, empty decoded text. Columns besides doc_id and text
are ignored, repeated rows give repeated results, an empty table gives no rows, and a text of
any length is one row of one chunk.
"""

from __future__ import annotations

import hashlib
import os
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, input_bytes, read, stable

CHUNK_BYTES = 16 << 20
CHUNK_ROWS = 20_000
TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _load(path: str):
    """The tokenizer of a file, loaded once in each worker process."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import tokenizers

    loaded = vars(tokenizers).setdefault("_strataweave_loaded", {})
    if path not in loaded:
        found = tokenizers.Tokenizer.from_file(path)
        found.no_padding()
        found.no_truncation()
        loaded[path] = found
    return loaded[path]


def _pieces(tokenizer) -> list[bytes]:
    size = tokenizer.get_vocab_size(with_added_tokens=True)
    return [(tokenizer.id_to_token(i) or "").encode() for i in range(size)]


def _chunks(batches, most: int = CHUNK_BYTES):
    """(chunk, ids, texts) in reading order; ``chunk`` is a digest of the chunk's content."""
    from xxhash import xxh64

    def closed(ids, texts):
        digest = xxh64(repr(ids))
        digest.update(struct.pack(f"<{len(texts)}q", *map(len, texts)))
        for text in texts:
            digest.update(text)
        return digest.intdigest() >> 1, ids, texts

    ids: list = []
    texts: list[bytes] = []
    size = 0
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            ids.append(doc_id)
            texts.append(text or b"")
            size += len(texts[-1])
            if size >= most or len(ids) >= CHUNK_ROWS:
                yield closed(ids, texts)
                ids, texts, size = [], [], 0
    if ids:
        yield closed(ids, texts)


def _dealt(texts: list[bytes], buckets: int) -> list[list[bytes]]:
    """The distinct words of a chunk, dealt to buckets, in an order that follows from them alone."""
    found: set[bytes] = set()
    for text in texts:
        found.update(text.split())
    parts: list[list[bytes]] = [[] for _ in range(buckets)]
    for w in sorted(found):
        parts[zlib.crc32(w) % buckets].append(w)
    return parts


def _pack_words(buckets: int):
    def run(batches):
        import pyarrow as pa

        zstd = pa.Codec("zstd", 3)
        for chunk, _, texts in _chunks(batches):
            rows = [(b, blob) for b, p in enumerate(_dealt(texts, buckets)) if (blob := b"\n".join(p))]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([b for b, _ in rows], pa.int32()),
                    pa.array([chunk] * len(rows), pa.int64()),
                    pa.array([len(x) for _, x in rows], pa.int32()),
                    pa.array([zstd.compress(x, asbytes=True) for _, x in rows], pa.binary()),
                ],
                names=["bucket", "chunk", "size", "words"],
            )

    return run


def _pack_docs(most: int = CHUNK_BYTES):
    def run(batches):
        import pyarrow as pa

        zstd = pa.Codec("zstd", 3)
        for chunk, ids, texts in _chunks(batches, most):
            sizes = struct.pack(f"<{len(texts)}q", *map(len, texts))
            raw = sizes + b"".join(texts)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([chunk], pa.int64()),
                    pa.array([ids], pa.list_(pa.int64())),
                    pa.array([len(raw)], pa.int64()),
                    pa.array([zstd.compress(raw, asbytes=True)], pa.binary()),
                ],
                names=["chunk", "ids", "size", "texts"],
            )

    return run


def unpacked(docs):
    """(ids, texts) of each packed chunk of an Arrow table."""
    import pyarrow as pa

    zstd = pa.Codec("zstd", 1)
    for ids_of, size, blob in zip(docs["ids"], docs["size"], docs["texts"]):
        ids = ids_of.as_py()
        raw = zstd.decompress(blob.as_py(), size.as_py(), asbytes=True)
        at, texts = 8 * len(ids), []
        for n in struct.unpack(f"<{len(ids)}q", raw[:at]):
            texts.append(raw[at : at + n])
            at += n
        yield ids, texts


def _encode_words(path: str):
    """Rows in bucket order -> for each the number of ids of every word, then the ids.

    Holds the distinct words of one bucket; each is encoded once, whichever chunk asks first.
    """

    def run(batches):
        import pyarrow as pa

        zstd, tokenizer = pa.Codec("zstd", 3), _load(path)
        bucket, known = None, {}
        for batch in batches:
            out = []
            for b, chunk, size, blob in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if b != bucket:
                    bucket, known = b, {}
                words = zstd.decompress(blob, size, asbytes=True).split(b"\n")
                new = [w for w in words if w not in known]
                for at in range(0, len(new), 8192):
                    part = new[at : at + 8192]
                    for w, e in zip(part, tokenizer.encode_batch([w.decode("utf-8", "replace") for w in part], add_special_tokens=False)):
                        known[w] = np.array(e.ids, np.int32)
                ids = [known[w] for w in words]
                raw = np.array([len(words), *map(len, ids)], np.int32).tobytes() + np.concatenate(ids).tobytes()
                out.append((chunk, b, len(raw), zstd.compress(raw, asbytes=True)))
            cols = list(zip(*out)) or [[]] * 4
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["chunk", "bucket", "size", "ids"])

    return run


def _assemble(path: str, buckets: int, more: tuple[str, ...]):
    cache: dict = {}

    def run(docs, answers):
        import pyarrow as pa

        if "pieces" not in cache:
            cache["pieces"] = np.array(_pieces(_load(path)), object)
            cache["shown"] = np.array([str(i).encode() for i in range(len(cache["pieces"]))], object)
        pieces, shown, zstd = cache["pieces"], cache["shown"], pa.Codec("zstd", 1)
        # A chunk that occurs twice has equal answers twice.
        replies = {b: (blob, n) for b, n, blob in zip(*(answers[c].to_pylist() for c in ("bucket", "size", "ids")))}
        out: list[tuple] = []
        for doc_ids, texts in unpacked(docs):
            known, decoded = {}, {}
            for b, words in enumerate(_dealt(texts, buckets)):
                if not words:
                    continue
                if b not in replies:
                    raise ValueError("the rows of a chunk changed between two readings of the input")
                raw = np.frombuffer(zstd.decompress(*replies[b], asbytes=True), np.int32)
                ends = np.cumsum(raw[1 : len(words) + 1]).tolist()
                ids = raw[len(words) + 1 :]
                text, piece = shown[ids].tolist(), pieces[ids].tolist()
                begin = 0
                for w, end in zip(words, ends, strict=True):
                    known[w], decoded[w] = b" ".join(text[begin:end]), b" ".join(piece[begin:end])
                    begin = end
            for doc_id, raw in zip(doc_ids, texts):
                words = raw.split()
                ids = b" ".join(filter(None, map(known.__getitem__, words)))
                text = b" ".join(filter(None, map(decoded.__getitem__, words)))
                row = (doc_id, ids.count(b" ") + 1 if ids else 0, hashlib.sha256(ids).hexdigest(), hashlib.sha256(text).hexdigest())
                extra = {"ids": lambda: np.fromstring(ids, np.int32, sep=" ") if ids else np.empty(0, np.int32), "decoded": text.decode}
                out.append((*row, *(extra[m]() for m in more)))
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), *(pa.list_(pa.int32()) if m == "ids" else pa.string() for m in more)]
        names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *more]
        cols = list(zip(*out)) or [[] for _ in names]
        return pa.table([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)

    return run


def encode(docs: DataFrame, path: str | None = None, more: tuple[str, ...] = ("ids", "decoded"), buckets: int | None = None) -> DataFrame:
    """doc_id, n_tokens and digests of every row; ``more``: also the ids, the decoded text.

    ``buckets`` of the distinct-word table: by default 256, and beyond 8 GB as many as grow with
    the square root of the input, as a vocabulary does.
    """
    bounded_batches(docs.sparkSession)
    path = path or tokenizer_path()
    texts = stable(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text")), "bpe-docs")
    buckets = buckets or max(256, int(input_bytes(texts) ** 0.5 / 350))
    asked = texts.mapInArrow(_pack_words(buckets), "bucket int, chunk long, size int, words binary")
    dealt = asked.repartition("bucket").sortWithinPartitions("bucket")
    answers = dealt.mapInArrow(_encode_words(path), "chunk long, bucket int, size int, ids binary")
    packed = texts.mapInArrow(_pack_docs(), "chunk long, ids array<long>, size long, texts binary")
    kinds = {"ids": "ids array<int>", "decoded": "decoded string"}
    schema = ", ".join(["doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", *(kinds[m] for m in more)])
    return packed.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_assemble(path, buckets, more), schema)


def vocabulary(spark: SparkSession, path: str | None = None) -> DataFrame:
    """The id-to-piece table; as many rows as the vocabulary has, whatever the corpus."""
    tokenizer = _load(path or tokenizer_path())
    return spark.createDataFrame([(i, p.decode()) for i, p in enumerate(_pieces(tokenizer))], "id int, piece string")


def decode(encoded: DataFrame, pieces: DataFrame) -> DataFrame:
    """Rows of (doc_id, ids) with ``decoded``: every id joined with its piece, pieces joined by one space."""
    rows = encoded.withColumn("_row", F.monotonically_increasing_id())
    parts = rows.select("_row", F.posexplode("ids").alias("pos", "id")).join(F.broadcast(pieces), "id")
    texts = parts.groupBy("_row").agg(F.sort_array(F.collect_list(F.struct("pos", "piece"))).alias("p"))
    texts = texts.select("_row", F.array_join("p.piece", " ").alias("decoded"))
    back = rows.drop("decoded").join(texts, "_row", "left").drop("_row")
    return back.withColumn("decoded", F.coalesce("decoded", F.lit("")))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(read(spark, sf_dir, "documents"), more=())
