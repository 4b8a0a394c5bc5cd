"""MinHash near-duplicates by an inverted join over signature coordinates.

1. One pass over the texts gives each document a signature of ``k``
   coordinates: minima of ``k`` permuted hashes over its word shingles.
2. Documents with the same signature are one *class*, named by its smallest
   id; a class's members match in all coordinates. From here on a class is one
   entry, however many copies it has.
3. Every class is posted under each (coordinate, value). Lists of one class
   can't collide and go. With a class's lists in ascending order of length, two
   classes that agree in at least ``t`` coordinates share one of the first
   ``s - t + 1`` of a class's ``s`` lists (the prefix), so only those lists are
   merged and the long tail is skipped; a class with fewer than ``t`` shared
   lists is skipped altogether.
4. Merging: every two classes of a prefix list have their collisions counted
   over all coordinates; a pair that shares several prefix lists counts in the
   one of the lowest coordinate only. Lists of more than ``_BLOCK`` classes are
   cut into blocks, and the pairs of blocks are spread over the tasks. What
   leaves a task is linear in what enters it: the number of links of each class
   and a tree that connects what is linked. Nothing is capped.

``near_duplicates``, one row for each document that has a near duplicate:
doc_id, class_id, group_id (the smallest id that is connected with it), copies
(other documents of its class) and links (other classes with at least ``t``
equal coordinates). A document without a row is the only one of its class and
has no link. No pairs are listed, so that groups of copies cost no more rows
than they have documents, but every pair of differing signatures is counted.

``near_pairs`` lists the links: all pairs of classes with at least ``t`` equal
coordinates, and one pair (class, member) for each further member of a class. A
group of n distinct near copies may have n * (n - 1) / 2 pairs.

Defined results: NULL texts, empty texts and texts without a word take no
part; texts shorter than a shingle have the whole text as their one shingle;
rows with NULL id take no part; of rows that repeat an id, the one with the
smallest signature stands for it. An empty table gives no rows. Ids are cast to
bigint. Texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm._frames import fresh, materialise, whole_groups
from graphloom.llm._text import U64, Tokens, byte_slices, mix, shingles, texts_of

COORDINATES = 64
SHINGLE = 3
THRESHOLD = 0.5
_SLICE = 1 << 20
#: Classes of a list that meet in one task, and pairs that are compared at a time.
_BLOCK = 4096
_PAIRS = 1 << 15


def _permutations(k: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    x = mix(np.arange(1, 2 * k + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed))
    return x[:k] | U64(1), x[k:]


def signatures(texts: list[str], k: int, shingle: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(texts x k) int32 signatures, and which texts have any word."""
    t = Tokens(texts)
    a, b = _permutations(k, seed)
    out = np.zeros((len(texts), k), np.int32)
    count = np.diff(t.first)
    for i in np.flatnonzero(count).tolist():
        h = t.hash[t.first[i] : t.first[i + 1]]
        s = shingles(h, min(shingle, len(h)))
        low = np.full(k, np.iinfo(np.uint64).max, U64)
        for c in range(0, len(s), 4096):
            low = np.minimum(low, (s[c : c + 4096] * a[:, None] + b[:, None]).min(axis=1))
        out[i] = (low >> U64(32)).astype(np.uint32).view(np.int32)
    return out, count > 0


def signature_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = COORDINATES, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, sig (array of k ints) of each document with a word."""
    src = docs.select(docs[f"`{id_col}`"].cast("long").alias("doc_id"), docs[f"`{text_col}`"].cast("string").alias("text")).where("doc_id IS NOT NULL AND text IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in byte_slices(batch.column(1), _SLICE):
                sig, ok = signatures(texts_of(batch.column(1), i, j), k, shingle)
                flat = pa.array(sig[ok].ravel(), pa.int32())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, ok.sum() * k + 1, k), pa.int32()), flat)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i).filter(pa.array(ok)), lists], names=["doc_id", "sig"])

    return src.mapInArrow(run, "doc_id bigint, sig array<int>")


def _join(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Give connected places one label, the smallest place among them."""
    while True:
        u, v = label[a], label[b]
        apart = u != v
        if not apart.any():
            return
        a, b, u, v = a[apart], b[apart], u[apart], v[apart]
        np.minimum.at(label, np.maximum(u, v), np.minimum(u, v))
        while (low := label[label]).tobytes() != label.tobytes():
            label[:] = low


def _merge(t: int, as_pairs: bool):
    """Prefix lists, or pairs (x, y) of blocks of them, sorted by (cv, x, y, block) -> links and a tree for each, or the pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cv, x, y, block, doc, mask, sig in whole_groups(batches, 3):
            n, mask = len(cv), mask.view(U64)
            head = np.flatnonzero(np.r_[True, (cv[1:] != cv[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])])
            size = np.diff(np.r_[head, n])
            begin, end = np.repeat(head, size), np.repeat(head + size, size)
            # within a block each meets the later ones, across two blocks those of the first meet the second
            across, second = x < y, block == y
            ahead = np.repeat(np.add.reduceat((across & ~second).astype(np.int64), head), size)
            first = np.where(across, np.where(second, end, begin + ahead), np.arange(n) + 1)
            many = end - first
            total = np.cumsum(many)
            bit = U64(1) << (cv >> 32).astype(U64)
            label, links = np.arange(n), np.zeros(n, np.int64)
            a = 0
            while a < n:
                b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + _PAIRS, "right")))
                p = np.repeat(np.arange(a, b), many[a:b])
                q = np.arange(len(p)) - np.repeat(total[a:b] - many[a:b] - (total[a - 1] if a else 0), many[a:b]) + first[p]
                packed = np.packbits(sig[p] == sig[q], axis=1, bitorder="little")
                equal = np.zeros((len(p), 8), np.uint8)
                equal[:, : packed.shape[1]] = packed
                equal = equal.view(U64).ravel()
                count = np.bitwise_count(equal)
                shared = equal & mask[p] & mask[q]
                own = (count >= t) & ((shared & (~shared + U64(1))) == bit[p])
                p, q, count = p[own], q[own], count[own]
                if as_pairs:
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(doc[p], doc[q])), pa.array(np.maximum(doc[p], doc[q])), pa.array(count.astype(np.int32))], names=["doc_a", "doc_b", "matches"])
                else:
                    links += np.bincount(p, minlength=n) + np.bincount(q, minlength=n)
                    _join(label, p, q)
                a = b
            if not as_pairs:
                on = np.flatnonzero(links)
                yield pa.RecordBatch.from_arrays([pa.array(doc[on]), pa.array(doc[label[on]]), pa.array(links[on])], names=["class_id", "root", "links"])

    return run


def _merged(docs: DataFrame, id_col: str, text_col: str, k: int, shingle: int, threshold: float, as_pairs: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """doc_id, sig of all documents; sig, class_id, n of their classes; and what merging the prefix lists gives."""
    if k > 64:
        raise ValueError("signatures have at most 64 coordinates")
    t = max(1, int(np.ceil(threshold * k)))
    sigs = materialise(signature_table(docs, id_col, text_col, k, shingle).groupBy("doc_id").agg(F.min("sig").alias("sig")), "signatures")
    classes = materialise(sigs.groupBy("sig").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("n")), "classes")
    postings = classes.select("class_id", F.posexplode("sig").alias("c", "v")).select("class_id", F.shiftleft(F.col("c").cast("long"), 32).bitwiseOR(F.col("v").cast("long").bitwiseAND(F.lit(0xFFFFFFFF))).alias("cv"))
    shared = postings.groupBy("cv").agg(F.count("*").alias("n")).where("n > 1")
    own = postings.join(shared, "cv").groupBy("class_id").agg(F.array_sort(F.collect_list(F.struct("n", "cv"))).alias("lists")).where(F.size("lists") >= t)
    # a class's unshared lists come first in its order, so they only shift the places of the shared ones
    own = own.select("class_id", F.expr(f"slice(lists, 1, size(lists) - {t - 1})").alias("lists"))
    own = own.select("class_id", "lists", F.expr("aggregate(lists, 0L, (a, x) -> a | shiftleft(1L, cast(x.cv >> 32 as int)))").alias("mask"))
    own = materialise(own.join(classes.select("class_id", "sig"), "class_id"), "prefixes")
    listed = own.select("class_id", "mask", "sig", F.explode("lists").alias("x")).select(F.col("x.cv").alias("cv"), F.col("x.n").alias("n"), "class_id", "mask", "sig")
    # only a list that many classes have in their prefixes is cut; there are few, if any
    hot = listed.where(F.col("n") > _BLOCK).groupBy("cv").count().where(F.col("count") > _BLOCK).select("cv", F.ceil(F.col("count") / _BLOCK).cast("int").alias("blocks"))
    hot = materialise(hot, "hot")
    zero = F.lit(0)
    if hot.isEmpty():
        tiles = listed.select("cv", zero.alias("x"), zero.alias("y"), zero.alias("block"), "class_id", "mask", "sig")
    else:
        cut = listed.join(hot, "cv", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("block", F.pmod(F.xxhash64("class_id"), F.col("blocks")).cast("int"))
        cut = cut.withColumn("o", F.explode(F.sequence(zero, F.col("blocks") - 1)))
        tiles = cut.select("cv", F.least("block", "o").alias("x"), F.greatest("block", "o").alias("y"), "block", "class_id", "mask", "sig")
    form = "doc_a bigint, doc_b bigint, matches int" if as_pairs else "class_id bigint, root bigint, links bigint"
    found = tiles.repartition("cv", "x", "y").sortWithinPartitions("cv", "x", "y", "block").mapInArrow(_merge(t, as_pairs), form)
    return sigs, classes, found


def near_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = COORDINATES, shingle: int = SHINGLE, threshold: float = THRESHOLD) -> DataFrame:
    """doc_a < doc_b and the number of equal coordinates, as the module describes."""
    sigs, classes, found = _merged(docs, id_col, text_col, k, shingle, threshold, True)
    members = sigs.join(classes.where("n > 1"), "sig").where("doc_id <> class_id").select(F.col("class_id").alias("doc_a"), F.col("doc_id").alias("doc_b"), F.lit(k).alias("matches"))
    return members.unionByName(found)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = COORDINATES, shingle: int = SHINGLE, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, class_id, group_id, copies, links of each document that has a near duplicate, as the module describes."""
    sigs, classes, found = _merged(docs, id_col, text_col, k, shingle, threshold, False)
    found = materialise(found, "links")
    groups = components(found.select(F.col("root").alias("doc_a"), F.col("class_id").alias("doc_b"))).withColumnRenamed("doc_id", "class_id")
    links = found.groupBy("class_id").agg(F.sum("links").alias("links"))
    known = classes.join(links, "class_id", "left").join(groups, "class_id", "left").where("n > 1 OR links > 0")
    known = known.select("sig", "class_id", F.coalesce("group_id", "class_id").alias("group_id"), (F.col("n") - 1).alias("copies"), F.coalesce("links", F.lit(0)).alias("links"))
    return sigs.join(known, "sig").select("doc_id", "class_id", "group_id", "copies", "links")


def components(pairs: DataFrame, max_rounds: int = 60) -> DataFrame:
    """doc_id, group_id (the smallest id connected with it) for every id in *pairs*.

    Alternating large-star and small-star steps; each round writes its edges to
    the shared folder, and rounds end when the edges' sum of ids settles.
    """
    edges = materialise(pairs.select(F.col("doc_a").alias("u"), F.col("doc_b").alias("v")).where("u <> v").distinct(), "edges")
    last = None
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low2 = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low2, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(low2.select("u", F.col("m").alias("v"))).distinct()
        edges = materialise(small, "edges")
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if now == last:
            break
        last = now
    else:
        raise RuntimeError("components did not settle")
    low = edges.groupBy("u").agg(F.min("v").alias("group_id")).withColumnRenamed("u", "doc_id")
    return low.unionByName(low.select(F.col("group_id").alias("doc_id"), "group_id").distinct())


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """*docs* without those that have a connected document with a smaller id."""
    gone = near_duplicates(docs, id_col, text_col, **how).where("doc_id <> group_id").select(F.col("doc_id").alias(name := fresh(docs, "__gone")))
    return docs.join(gone, docs[f"`{id_col}`"].cast("long") == F.col(f"`{name}`"), "left_anti")
