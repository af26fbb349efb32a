"""Hard-negative mining over K-means inverted lists with stored centroid radii.

For each anchor: its positives are the ``POSITIVES`` rows of its label with the highest inner products;
for each positive, the hard negatives are the ``NEGATIVES`` rows of other labels with the highest
products within a window that the positive's product sets. Higher products come first, ties
go to the smaller id. Results are exact whatever the clusters are.

Centroids are fitted (by Spark's K-means) to at most ``SAMPLE`` rows, those with the smallest hashes of their ids; every row
then joins the inverted list of its nearest centroid, and a list stores the largest distance of a
member, its radius. By Cauchy and Schwarz no member's product with an anchor a exceeds
a * centroid + |a| * radius, nor falls below a * centroid - |a| * radius. An anchor visits lists by
falling upper bound, skips those whose bounds lie outside all its windows, and stops when the bound
falls strictly below the kth product that it has. Visits go in rounds, four times as many lists in each: a round asks for lists,
requests meet the lists' rows, and what comes back raises the kth products before the next round.

A list is dealt into blocks of about ``BLOCK`` rows by a hash of the id, so a cluster of a third of all rows
is many blocks. A task holds one block and streams the requests past it. At most ``LISTS`` centroids
are fitted, so what every task gets of them is bounded by ``LISTS`` vectors. The rows of lists move
once a round; requests carry the anchor's vector to each block.

Rows with a null id or label, a null vector, or any null or non-finite component take no part. Rows
that share an id are one row: that of the smallest label, then of the smallest bytes of the packed vector. Of vectors of different
lengths, the shorter count as padded with zeros. Scaled components over 2^31 or products over
64 bits are an error. Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, read, settle

POSITIVES, NEGATIVES = 5, 3
#: The window of a negative's product, in hundredths of the positive's.
LOW, HIGH = 50, 95
#: Rows that K-means is fitted to and lists, both at most; rounds of K-means.
SAMPLE, LISTS, ITERATIONS = 20_000, 2_048, 5
#: Rows of a block, about; products that a task holds at a time.
BLOCK, PRODUCTS = 1 << 15, 1 << 21
#: Lists that an anchor asks for in its first round, and how many times more in each later one.
FIRST, MORE = 8, 4
WIDE = 1 << 62


def packed(batch_of_vectors) -> tuple[list[bytes | None], np.ndarray]:
    """Vectors as little-endian 32-bit floor(256 * x), None for those that take no part, and their largest absolute component."""
    out, big = [], []
    for v in batch_of_vectors:
        x = np.array(v if v is not None else [None], np.float64)  # None becomes NaN
        if not np.isfinite(x).all():
            out.append(None)
            big.append(0)
            continue
        x = np.floor(256 * x)
        big.append(int(min(np.abs(x).max(initial=0), 2.0**62)))
        if big[-1] >= 1 << 31:
            raise ValueError("a scaled component doesn't fit into 32 bits")
        out.append(x.astype("<i4").tobytes())
    return out, np.array(big, np.int64)


def quantized(rows: DataFrame) -> DataFrame:
    """``rows``: vec_id, label, embedding. One row an id: vec_id, label, v (packed), big."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            v, big = packed(batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(v, pa.binary()), pa.array(big)], names=["vec_id", "label", "v", "big"])

    sound = rows.filter("vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL")
    sound = sound.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    found = sound.mapInArrow(run, "vec_id long, label long, v binary, big long").filter("v IS NOT NULL")
    return found.groupBy("vec_id").agg(F.min(F.struct("label", "v", "big")).alias("r")).select("vec_id", "r.label", "r.v", "r.big")


def matrix(vectors: list[bytes], dim: int) -> np.ndarray:
    """Packed vectors as rows of whole doubles, padded with zeros."""
    if all(len(v) == 4 * dim for v in vectors):
        return np.frombuffer(b"".join(vectors), "<i4").reshape(len(vectors), dim).astype(np.float64)
    out = np.zeros((len(vectors), dim))
    for row, v in zip(out, vectors):
        row[: len(v) // 4] = np.frombuffer(v, "<i4")
    return out


@dataclass
class Index:
    """Inverted lists. ``lists``: cluster, block, vec_id, label, v."""

    lists: DataFrame
    centroids: np.ndarray
    radius: np.ndarray
    blocks: np.ndarray
    dim: int
    #: Whether doubles hold all products exactly.
    small: bool


def fitted(rows: DataFrame, n: int, dim: int) -> np.ndarray:
    """Centroids of at most ``SAMPLE`` rows."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            m = matrix(batch.column(0).to_pylist(), dim)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, m.size + 1, dim or 1, dtype=np.int32)), pa.array(m.ravel()))
            yield pa.RecordBatch.from_arrays([flat], names=["x"])

    sample = settle(rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("v"), "knn-sample")
    points = sample.mapInArrow(run, "x array<double>").select(array_to_vector("x").alias("features"))
    k = min(LISTS, max(1, round(n**0.5)), SAMPLE)
    if k == 1 or n < 2 or dim == 0:
        return np.zeros((1, dim))
    model = KMeans(k=k, maxIter=ITERATIONS, seed=1, initSteps=2).fit(points)
    return np.array([c for c in model.clusterCenters()], np.float64).reshape(-1, dim)


def inverted_lists(rows: DataFrame) -> Index | None:
    """Every row of ``quantized`` rows in the list of its nearest centroid; None without rows."""
    spark = rows.sparkSession
    bounded_batches(spark)
    rows = settle(rows, "knn-rows")
    facts = rows.agg(F.count(F.lit(1)).alias("n"), F.max("big").alias("big"), F.max(F.length("v")).alias("size")).first()
    if not facts.n:
        return None
    dim, most = facts.size // 4, facts.size // 4 * facts.big**2
    if most >= 1 << 62:
        raise ValueError("inner products don't fit into 64 bits")
    centroids = fitted(rows, facts.n, dim)
    shared = spark.sparkContext.broadcast(centroids)

    def run(batches):
        import pyarrow as pa

        c = shared.value
        square = (c * c).sum(1)
        for batch in batches:
            x = matrix(batch.column(2).to_pylist(), dim)
            cluster = np.argmin(square - 2 * (x @ c.T), 1) if len(x) else np.empty(0, np.int64)
            far = np.sqrt(((x - c[cluster]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(cluster.astype(np.int32)), pa.array(far)], names=["vec_id", "label", "v", "cluster", "far"])

    assigned = settle(rows.select("vec_id", "label", "v").mapInArrow(run, "vec_id long, label long, v binary, cluster int, far double"), "knn-assigned")
    heads = {r.cluster: r for r in assigned.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("far")).collect()}
    radius = np.array([heads[i].far if i in heads else -1.0 for i in range(len(centroids))])
    blocks = np.array([-(-heads[i].n // BLOCK) if i in heads else 0 for i in range(len(centroids))])
    sizes = spark.createDataFrame([(i, int(b)) for i, b in enumerate(blocks) if b], "cluster int, blocks int")
    lists = assigned.join(F.broadcast(sizes), "cluster").select("cluster", F.pmod(F.xxhash64("vec_id"), "blocks").cast("int").alias("block"), "vec_id", "label", "v")
    return Index(lists, centroids, radius, blocks, dim, most * BLOCK * 8 < 1 << 53)


REQUEST = "cluster int, block int, id long, label long, v binary, low array<long>, high array<long>, kth array<long>, at int"


def _requests(index: Index, visits: int):
    """Anchors with what they have -> requests for their next lists, and a row of cluster -1 that tells how far they came."""
    lists = index.lists.sparkSession.sparkContext.broadcast((index.centroids, index.radius, index.blocks))
    dim = index.dim

    def run(batches):
        import pyarrow as pa

        names = ["cluster", "block", "id", "label", "v", "low", "high", "kth", "at"]
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), *[pa.list_(pa.int64())] * 3, pa.int32()]
        centroids, radius, blocks = lists.value
        for batch in batches:
            rows = batch.to_pylist()
            a = matrix([r["v"] for r in rows], dim)
            middle = a @ centroids.T
            norm = np.sqrt((a * a).sum(1))[:, None]
            reach = norm * np.maximum(radius, 0)
            slack = 1e-9 * (np.abs(middle) + norm * (np.sqrt((centroids * centroids).sum(1)) + np.maximum(radius, 0))) + 1e-6
            upper, lower = middle + reach + slack, middle - reach - slack
            out = []
            for row, up, down in zip(rows, upper, lower):
                may = np.zeros(len(up), bool)
                for low, high, kth in zip(row["low"], row["high"], row["kth"]):
                    may |= (up >= low) & (down <= high) & (np.minimum(up, high) >= kth) & (low <= high)
                may &= blocks > 0
                order = np.argsort(-up, kind="stable")
                chosen = np.flatnonzero(may[order[row["at"] :]])[: visits + 1] + row["at"]
                at = int(chosen[visits]) if len(chosen) > visits else len(up)
                rest = [row[k] for k in ("id", "label", "v", "low", "high", "kth")]
                for c in order[chosen[:visits]]:
                    out += [(int(c), b, *rest, None) for b in range(int(blocks[c]))]
                out.append((-1, -1, row["id"], *[None] * 5, at))
            columns = list(zip(*out)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    return run


def _best(score: np.ndarray, ok: np.ndarray, k: int, small: bool) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k highest scores that are ``ok`` in each row; of equal ones the first columns."""
    n = score.shape[1]
    some = np.flatnonzero(ok.any(1))
    if not len(some):
        return some, some
    score, ok = score[some], ok[some]
    if small:
        code = np.where(ok, score * n + (n - 1 - np.arange(n)), -WIDE)
        top = np.argpartition(-code, min(k, n) - 1, axis=1)[:, :k] if n > k else np.tile(np.arange(n), (len(code), 1))
    else:
        top = np.argsort(np.where(ok, -score, WIDE), axis=1, kind="stable")[:, :k]
    row = np.repeat(np.arange(len(some)), top.shape[1])
    column = top.ravel()
    good = ok[row, column]
    return some[row[good]], column[good]


def _visits(dim: int, k: int, same: bool, small: bool):
    """Rows by (cluster, block), members first -> each request's k best members of the block for each of its windows."""

    def run(batches):
        import pyarrow as pa

        names = ["anchor_id", "number", "score", "vec_id"]
        key, members, block = None, [], None
        for batch in batches:
            rows = batch.to_pylist()
            found: list[list] = [[] for _ in names]
            edges = [i for i in range(len(rows)) if i == 0 or any(rows[i][c] != rows[i - 1][c] for c in ("cluster", "block", "asks"))]
            for first, end in zip(edges, [*edges[1:], len(rows)]):
                part = rows[first:end]
                if (part[0]["cluster"], part[0]["block"]) != key:
                    key, members, block = (part[0]["cluster"], part[0]["block"]), [], None
                if not part[0]["asks"]:
                    members += [(r["id"], r["label"], r["v"]) for r in part]
                    continue
                if not members:
                    continue
                if block is None:
                    members.sort(key=lambda m: m[0])
                    block = np.array([m[0] for m in members]), np.array([m[1] for m in members]), matrix([m[2] for m in members], dim)
                    if not small:
                        block = (*block[:2], block[2].astype(np.int64))
                ids, labels, m = block
                width = max(1, PRODUCTS // len(ids))
                for at in range(0, len(part), width):
                    asked = part[at : at + width]
                    q = matrix([r["v"] for r in asked], dim)
                    score = (q @ m.T if small else q.astype(np.int64) @ m.T).astype(np.int64)
                    own, label = np.array([r["id"] for r in asked])[:, None], np.array([r["label"] for r in asked])[:, None]
                    apart = ((labels == label) & (ids != own)) if same else labels != label
                    for w in range(max(len(r["low"]) for r in asked)):
                        bound = np.array([(max(r["low"][w], r["kth"][w]), r["high"][w]) if w < len(r["low"]) else (WIDE, -WIDE) for r in asked])
                        row, column = _best(score, apart & (score >= bound[:, :1]) & (score <= bound[:, 1:]), k, small)
                        for c, x in zip(found, (own[row, 0], np.full(len(row), w), score[row, column], ids[column])):
                            c.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c) if c else np.empty(0, np.int64), pa.int64()) for c in found], names=names)

    return run


def ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("anchor_id", "number").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def search(index: Index, anchors: DataFrame, k: int, same: bool) -> DataFrame:
    """(anchor_id, number, score, vec_id, rank): for each window of an anchor its k best rows of its label or of others.

    ``anchors``: id, label, v, low, high; window ``number`` takes products from low[number] to high[number].
    """
    none = F.transform("low", lambda x: F.lit(-WIDE).cast("long"))
    state = settle(anchors.withColumns({"kth": none, "at": F.lit(0)}), "knn-state")
    members = index.lists.select("cluster", "block", F.lit(False).alias("asks"), F.col("vec_id").alias("id"), "label", "v", *(F.lit(None).cast("array<long>").alias(c) for c in ("low", "high", "kth")))
    best, visits, last = None, FIRST, len(index.centroids)
    while True:
        asked = settle(state.select("id", "label", "v", "low", "high", "kth", "at").mapInArrow(_requests(index, visits), REQUEST), "knn-asked")
        wanted = asked.filter("cluster >= 0")
        rows = members.join(F.broadcast(wanted.select("cluster").distinct()), "cluster", "left_semi").unionByName(wanted.withColumn("asks", F.lit(True)).drop("at"))
        sorted_rows = rows.repartition("cluster", "block").sortWithinPartitions("cluster", "block", "asks")
        found = sorted_rows.mapInArrow(_visits(index.dim, k, same, index.small), "anchor_id long, number long, score long, vec_id long")
        if best is not None:
            found = found.unionByName(best.drop("rank"))
        best = settle(ranked(found, k), "knn-best")
        going = asked.filter((F.col("cluster") < 0) & (F.col("at") < last)).select("id", "at")
        kth = best.filter(F.col("rank") == k).groupBy(F.col("anchor_id").alias("id")).agg(F.map_from_entries(F.collect_list(F.struct("number", "score"))).alias("known"))
        raised = F.transform("low", lambda x, i: F.coalesce(F.try_element_at("known", i.cast("long")), F.lit(-WIDE).cast("long")))
        state = settle(state.drop("at", "kth").join(going, "id").join(kth, "id", "left").withColumn("kth", raised).drop("known"), "knn-state")
        if not state.take(1):
            return best
        visits *= MORE


def hard_negatives(rows: DataFrame, anchors: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``rows``: vec_id, label, embedding; ``anchors``: the vec_ids (column ``id``) to mine for.
    """
    spark = rows.sparkSession
    index = inverted_lists(quantized(rows))
    if index is None:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    chosen = settle(index.lists.select(F.col("vec_id").alias("id"), "label", "v").join(anchors.select("id").distinct(), "id", "left_semi"), "knn-anchors")
    every = chosen.withColumns({"low": F.array(F.lit(-WIDE).cast("long")), "high": F.array(F.lit(WIDE).cast("long"))})
    near = search(index, every, positives, True).select("anchor_id", (F.col("rank") - 1).cast("long").alias("number"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    # A negative product's window is empty; the others' ends are rounded inwards.
    part = lambda share, more: F.expr(f"{share} * (positive_score div 100) + ({share} * (positive_score % 100) + {more}) div 100")
    window = F.struct("number", part(low, 99).alias("low"), part(high, 0).alias("high"))
    windows = near.filter("positive_score >= 0").groupBy(F.col("anchor_id").alias("id")).agg(F.sort_array(F.collect_list(window)).alias("w"))
    asked = chosen.join(windows, "id").withColumns({"low": F.col("w.low"), "high": F.col("w.high")}).drop("w")
    found = search(index, asked, negatives, False)
    return found.join(near, ["anchor_id", "number"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )


def op12_hard_negatives(spark, sf_dir: str) -> DataFrame:
    table = read(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table.select("vec_id", label.alias("label"), "embedding")
    return hard_negatives(rows, table.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("id")))
