"""Approximate nearest neighbours with an inverted multi-index.

Vectors are halved; each half is quantised with its own codebook of ``k``
centroids (Lloyd's iterations over at most about ``FIT`` vectors chosen by a
hash of their id), so a pair of centroids is one of k * k cells; every vector is
indexed. A query walks the cells in ascending order of the two summed
half distances with a heap, until the visited cells hold ``candidates``
entries; those entries are reranked by their true distance.

How many candidates a recall needs depends on the vectors, so it is measured:
``calibration`` vectors get their exact neighbours by one pass over all
vectors, and ``candidates`` becomes the number of entries that the walk has
seen when it has met the share ``recall`` of those neighbours. The codebooks
have at most ``MAX_CENTROIDS`` centroids each, which bounds what is broadcast.

Queries are the vectors that ``asked`` selects, all by default; they are
searched among all vectors. A query travels once per visited first-half
centroid with the list of its cells there, meets that centroid's entries in one
sorted stream, and is compared with them by matrix products; each block returns
its best ``n`` only. A centroid's entries are cut into blocks of about
``BLOCK`` vectors, which is what a worker holds at a time, and a query visits
each.

Defined results: NULL ids, NULL or empty vectors, vectors with NULL or
non-finite elements, and vectors of another length than the most frequent one
(the smallest, on ties) take no part; of rows that repeat an id, the smallest
vector stands for it; ties in distance go to the smaller id; a table with
fewer than two usable vectors gives no rows. Distances are Euclidean.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm._frames import materialise

NEIGHBOURS = 10
RECALL = 0.95
CALIBRATION = 256
MAX_CENTROIDS = 2048
PER_CELL = 50
ITERATIONS = 8
BLOCK = 50_000
#: Vectors that the codebooks are fitted on, chosen by a hash of their id; all are where the table has no more.
FIT = 500_000


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float32, copy=False).reshape(-1, width)


def _nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return ((centroids * centroids).sum(axis=1) - 2 * (x @ centroids.T)).argmin(axis=1)


def codebooks(vectors: DataFrame, width: int, k: int, iterations: int) -> list[np.ndarray]:
    """Two codebooks by Lloyd's method; each round sums distributedly and returns 2 * k centroids."""
    sc = vectors.sparkSession.sparkContext
    half = width // 2
    cuts = [slice(0, half), slice(half, width)]
    rows = vectors.orderBy(F.xxhash64("id"), "id").limit(k).select("vec").collect()
    start = np.array([r.vec for r in rows], np.float32)
    books = [start[:, c].copy() for c in cuts]
    for _ in range(iterations):
        shared = sc.broadcast(books)

        def sums(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            now = shared.value
            total = [np.zeros((len(b), b.shape[1] + 1)) for b in now]
            for batch in batches:
                x = _matrix(batch.column(0), width)
                for t, b, c in zip(total, now, cuts):
                    at = _nearest(x[:, c], b)
                    np.add.at(t, at, np.hstack([x[:, c], np.ones((len(x), 1))]))
            for h, t in enumerate(total):
                n, m = t.shape
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n * m, h), pa.int32()), pa.array(np.repeat(np.arange(n), m), pa.int32()), pa.array(np.tile(np.arange(m), n), pa.int32()), pa.array(t.ravel())], names=["h", "c", "d", "s"])

        got = vectors.select("vec").mapInArrow(sums, "h int, c int, d int, s double").groupBy("h", "c", "d").agg(F.sum("s").alias("s")).toPandas()
        new = []
        for h, b in enumerate(books):
            t = np.zeros((len(b), b.shape[1] + 1))
            g = got[got["h"] == h]
            t[g["c"].to_numpy(), g["d"].to_numpy()] = g["s"].to_numpy()
            alive = t[:, -1] > 0
            nb = b.copy()
            nb[alive] = (t[alive, :-1] / t[alive, -1:]).astype(np.float32)
            new.append(nb)
        books = new
    return books


def cells_of_query(d1: np.ndarray, d2: np.ndarray, sizes: np.ndarray, want: int) -> list[tuple[int, int]]:
    """Centroid pairs in ascending order of d1[i] + d2[j] until their sizes reach *want* (multi-sequence walk with a heap)."""
    o1, o2 = d1.argsort(kind="stable").tolist(), d2.argsort(kind="stable").tolist()
    a, b = d1[o1].tolist(), d2[o2].tolist()
    heap, out, have = [(a[0] + b[0], 0, 0)], [], 0
    reached = [0] * len(a)
    while heap and have < want:
        _, i, j = heapq.heappop(heap)
        n = sizes[o1[i], o2[j]]
        if n:
            out.append((o1[i], o2[j]))
            have += n
        # row i goes on to the right; the row below starts when row i does
        reached[i] = j + 1
        if j + 1 < len(b):
            heapq.heappush(heap, (a[i] + b[j + 1], i, j + 1))
        if j == 0 and i + 1 < len(a):
            heapq.heappush(heap, (a[i + 1] + b[0], i + 1, 0))
    return out


def _needed(entries: DataFrame, books: list[np.ndarray], sizes: np.ndarray, width: int, n: int, recall: float, calibration: int) -> int:
    """Entries that the walk must see to meet the share *recall* of the exact neighbours of some vectors."""
    asked = entries.select("id", "vec").orderBy(F.xxhash64("id"), "id").limit(calibration).collect()
    own, x = np.array([r.id for r in asked]), np.array([r.vec for r in asked], np.float64)
    shared = entries.sparkSession.sparkContext.broadcast((own, x))

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q = shared.value
        for batch in batches:
            e = _matrix(batch.column(1), width).astype(np.float64)
            d = (q * q).sum(axis=1)[:, None] - 2 * (q @ e.T) + (e * e).sum(axis=1)
            d[ids[:, None] == batch.column(0).to_numpy()] = np.inf
            at = np.argpartition(d, min(n, d.shape[1]) - 1, axis=1)[:, :n]
            row, place = np.repeat(np.arange(len(q)), at.shape[1]), at.ravel()
            yield pa.RecordBatch.from_arrays([pa.array(row, pa.int32()), pa.array(d[row, place]), batch.column(2).take(pa.array(place)), batch.column(3).take(pa.array(place))], names=["q", "d", "i", "j"])

    best = Window.partitionBy("q").orderBy("d")
    found = entries.mapInArrow(nearest, "q int, d double, i int, j int").where("d < double('inf')").withColumn("r", F.row_number().over(best)).where(F.col("r") <= n).select("q", "i", "j").toPandas()
    half, seen = width // 2, []
    for q, hits in found.groupby("q"):
        a, b = (((x[q, c] - m) ** 2).sum(axis=1) for c, m in zip((slice(0, half), slice(half, width)), books))
        walk = a[:, None] + b
        order = np.argsort(walk, axis=None)
        total = np.cumsum(sizes.ravel()[order])
        seen += total[np.searchsorted(walk.ravel()[order], walk[hits["i"], hits["j"]], "right") - 1].tolist()
    return int(np.quantile(seen, recall, method="higher")) if seen else 1


def nearest_neighbours(table: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", n: int = NEIGHBOURS, candidates: int | None = None, recall: float = RECALL, calibration: int = CALIBRATION, per_cell: int = PER_CELL, iterations: int = ITERATIONS, k: int | None = None, asked: Column | None = None) -> DataFrame:
    """vec_id, neighbour_id, rank (from 1) and distance for the *n* nearest others of each vector that *asked*, a condition on ``id``, selects."""
    spark = table.sparkSession
    names = "vec_id bigint, neighbour_id bigint, rank int, distance double"
    v = F.col("vec")
    usable = table.select(table[f"`{id_col}`"].cast("long").alias("id"), table[f"`{vec_col}`"].cast("array<double>").alias("vec")).where("id IS NOT NULL AND vec IS NOT NULL AND size(vec) > 0")
    usable = usable.where(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    usable = materialise(usable.groupBy("id").agg(F.min("vec").alias("vec")), "vectors")
    common = usable.groupBy(F.size("vec").alias("w")).count().orderBy(F.desc("count"), "w").first()
    if common is None or common["count"] < 2:
        return spark.createDataFrame([], names)
    width, total = common["w"], common["count"]
    vectors = usable.where(F.size("vec") == width).select("id", v.cast("array<float>").alias("vec"))
    k = k or max(1, int(round((total / per_cell) ** 0.5)))
    k = min(k, total, MAX_CENTROIDS)
    half = width // 2
    share = max(1, -(-total // FIT))
    fitted = vectors if share == 1 else materialise(vectors.where(F.pmod(F.xxhash64("id", F.lit("fit")), F.lit(share)) == 0), "fit")
    books = codebooks(fitted, width, k, iterations)
    shared_books = spark.sparkContext.broadcast(books)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = shared_books.value
        for batch in batches:
            x = _matrix(batch.column(1), width)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(_nearest(x[:, :half], b[0]), pa.int32()), pa.array(_nearest(x[:, half:], b[1]), pa.int32())], names=["id", "vec", "i", "j"])

    entries = materialise(vectors.mapInArrow(assign, "id bigint, vec array<float>, i int, j int"), "entries")
    sizes = np.zeros((k, k), np.int64)
    held = entries.groupBy("i", "j").count().toPandas()
    sizes[held["i"], held["j"]] = held["count"]
    if candidates is None:
        candidates = _needed(entries, books, sizes, width, n, recall, calibration)
    shared_sizes = spark.sparkContext.broadcast(sizes)
    parts = np.maximum(1, -(-sizes.sum(axis=1) // BLOCK))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b, size = shared_books.value, shared_sizes.value
        for batch in batches:
            x = _matrix(batch.column(1), width)
            d = [((x[:, c] ** 2).sum(axis=1)[:, None] - 2 * (x[:, c] @ m.T) + (m * m).sum(axis=1)) for c, m in zip((slice(0, half), slice(half, width)), b)]
            rows, blocks, chunks, lists = [], [], [], []
            for q in range(len(x)):
                by: dict[int, list[int]] = {}
                for i, j in cells_of_query(d[0][q], d[1][q], size, candidates + 1):
                    by.setdefault(i, []).append(j)
                for i, own in by.items():
                    for c in range(parts[i]):
                        rows.append(q)
                        blocks.append(i)
                        chunks.append(c)
                        lists.append(own)
            yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int32()), pa.array(chunks, pa.int32()), pa.array([1] * len(rows), pa.int32()), batch.column(0).take(pa.array(rows, pa.int64())), batch.column(1).take(pa.array(rows, pa.int64())), pa.array(lists, pa.list_(pa.int32()))], names=["block", "chunk", "kind", "id", "vec", "cells"])

    form = "block int, chunk int, kind int, id bigint, vec array<float>, cells array<int>"
    queries = (entries if asked is None else entries.where(asked)).select("id", "vec").mapInArrow(route, form)
    chunk = F.pmod(F.xxhash64("id"), F.element_at(F.array(*[F.lit(int(p)) for p in parts]), F.col("i") + 1)) if parts.max() > 1 else F.lit(0)
    stored = entries.select(F.col("i").alias("block"), chunk.cast("int").alias("chunk"), F.lit(0).alias("kind"), "id", "vec", F.array("j").alias("cells"))
    stream = queries.unionByName(stored).repartition("block", "chunk").sortWithinPartitions("block", "chunk", "kind")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, ids, vecs, cells = None, [], [], []
        block: tuple | None = None
        for batch in batches:
            which, kind = batch.column(0).to_numpy().astype(np.int64) << 32 | batch.column(1).to_numpy(), batch.column(2).to_numpy()
            cuts = [0, *(np.flatnonzero((np.diff(which) != 0) | (np.diff(kind) != 0)) + 1).tolist(), len(which)]
            for a, b in zip(cuts, cuts[1:]):
                part = batch.slice(a, b - a)
                if which[a] != here:
                    here, ids, vecs, cells, block = which[a], [], [], [], None
                x, own = _matrix(part.column(4), width), part.column(3).to_numpy()
                if kind[a] == 0:
                    ids.append(own)
                    vecs.append(x)
                    cells.append(part.column(5).flatten().to_numpy())
                    continue
                if block is None:
                    c = np.concatenate(cells)
                    order = np.argsort(c, kind="stable")
                    e = np.concatenate(vecs)[order].astype(np.float64)
                    block = (np.concatenate(ids)[order], e, (e * e).sum(axis=1), np.searchsorted(c[order], np.arange(len(shared_sizes.value) + 1)))
                yield from _answer(own, x.astype(np.float64), part.column(5), block, n)

    found = stream.mapInArrow(compare, "vec_id bigint, neighbour_id bigint, distance double")
    best = Window.partitionBy("vec_id").orderBy("distance", "neighbour_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= n).select("vec_id", "neighbour_id", "rank", "distance")


def _answer(own: np.ndarray, x: np.ndarray, lists: pa.Array, block: tuple, n: int) -> Iterator[pa.RecordBatch]:
    """The best n entries of the block's asked cells for each query."""
    ids, e, norm, start = block
    counts = np.diff(lists.offsets.to_numpy())
    q, cell = np.repeat(np.arange(len(own)), counts), lists.flatten().to_numpy()
    order = np.argsort(cell, kind="stable")
    q, cell = q[order], cell[order]
    edges = np.r_[0, np.flatnonzero(np.diff(cell)) + 1, len(cell)]
    best_d, best_i = np.full((len(own), n), np.inf), np.full((len(own), n), -1, np.int64)
    xx = (x * x).sum(axis=1)
    for a, b in zip(edges[:-1], edges[1:]):
        s, t = start[cell[a]], start[cell[a] + 1]
        if s == t:
            continue
        who = q[a:b]
        d = xx[who][:, None] - 2 * (x[who] @ e[s:t].T) + norm[s:t]
        d[own[who][:, None] == ids[s:t]] = np.inf
        both_d = np.hstack([best_d[who], np.maximum(d, 0)])
        both_i = np.hstack([best_i[who], np.broadcast_to(ids[s:t], d.shape)])
        # by distance, then id: exact ties are broken as the final ranking does
        keep = np.lexsort((both_i, both_d), axis=1)[:, :n] if both_d.shape[1] <= 4 * n else _partial(both_d, both_i, n)
        best_d[who], best_i[who] = np.take_along_axis(both_d, keep, 1), np.take_along_axis(both_i, keep, 1)
    ok = np.isfinite(best_d)
    if ok.any():
        row, _ = np.nonzero(ok)
        yield pa.RecordBatch.from_arrays([pa.array(own[row]), pa.array(best_i[ok]), pa.array(np.sqrt(best_d[ok]))], names=["vec_id", "neighbour_id", "distance"])


def _partial(d: np.ndarray, i: np.ndarray, n: int) -> np.ndarray:
    """Places of the n smallest (distance, id) of each row, ties at the edge included before cutting."""
    edge = np.partition(d, n - 1, axis=1)[:, n - 1 : n]
    width = int((d <= edge).sum(axis=1).max())
    at = np.argpartition(d, min(width, d.shape[1]) - 1, axis=1)[:, :width]
    order = np.lexsort((np.take_along_axis(i, at, 1), np.take_along_axis(d, at, 1)), axis=1)[:, :n]
    return np.take_along_axis(at, order, 1)
