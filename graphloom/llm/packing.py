"""Packing by shortest-pack-first over the length histogram.

Lengths are placed longest first; each goes to the open pack with the most
free space that can take it, or opens a pack. Only (pattern, count) entries
are handled: the histogram has at most ``capacity`` bins, so the packing runs
on the driver in a time that doesn't depend on the number of documents. Every
pattern slot stands for an interval of ranks within a length; documents get
their rank and join their interval.

Ranks come from a window over (length, salt) with per-salt offsets; a length
has one salt for each ``rank_rows`` pieces, so that no window holds many more,
however many documents share a length. The histogram and the offsets are small
and broadcast; so are the intervals, unless there are more than ``SLOTS``.

Defined results: a text longer than the capacity is cut into full pieces and a
rest, all of it is packed; NULL and empty texts have length 0, one row, and
NULL pack_id and pack_offset; NULL ids are packed as any other; repeated rows
are packed as often as they occur (equal rows are interchangeable). An empty
table gives no rows. Other columns are not returned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm._frames import materialise

CAPACITY = 2048
RANK_ROWS = 1 << 20
SLOTS = 200_000


def word_count(text: Column) -> Column:
    """Number of maximal runs without white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0))


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Patterns (count, [(length, first rank), ...]): *count* packs, whose i-th takes rank first+i of each length."""
    open_: dict[int, list[tuple[int, list[tuple[int, int]]]]] = {}
    most = -1
    for length in sorted(histogram, reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"length {length} is not in 1..{capacity}")
        todo, rank = histogram[length], 0
        most = max(open_, default=-1)
        while todo:
            while most >= length and not open_.get(most):
                most -= 1
            if most < length:
                open_.setdefault(capacity - length, []).append((todo, [(length, rank)]))
                break
            count, slots = open_[most].pop()
            n = min(count, todo)
            if count > n:
                open_[most].append((count - n, [(size, r + n) for size, r in slots]))
            open_.setdefault(most - length, []).append((n, [*slots, (length, rank)]))
            todo, rank = todo - n, rank + n
        open_ = {f: p for f, p in open_.items() if p}
    return [p for f in sorted(open_) for p in open_[f]]


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: Column | None = None, capacity: int = CAPACITY, rank_rows: int = RANK_ROWS) -> DataFrame:
    """doc_id, piece, start, length, pack_id, pack_offset: where each piece of each document goes."""
    spark = docs.sparkSession
    n = length if length is not None else word_count(docs[f"`{text_col}`"].cast("string"))
    sized = docs.select(docs[f"`{id_col}`"].alias("doc_id"), F.coalesce(n.cast("long"), F.lit(0)).alias("n"))
    last = F.greatest(F.ceil(F.col("n") / capacity), F.lit(1)).cast("int") - 1
    pieces = sized.withColumn("piece", F.explode(F.sequence(F.lit(0), last)))
    pieces = pieces.select("doc_id", "piece", (F.col("piece").cast("long") * capacity).alias("start"), F.least(F.col("n") - F.col("piece").cast("long") * capacity, F.lit(capacity)).cast("int").alias("length"))
    pieces = materialise(pieces, "pieces")
    histogram = {r.length: r["count"] for r in pieces.where("length > 0").groupBy("length").count().collect()}
    salts = {size: -(-c // rank_rows) for size, c in histogram.items()}
    if max(salts.values(), default=1) > 1:
        many = spark.createDataFrame(sorted(salts.items()), "length int, salts bigint")
        pieces = pieces.join(F.broadcast(many), "length", "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("doc_id", "piece"), "salts"), F.lit(0)).cast("int")).drop("salts")
        counts = sorted((r.length, r.salt, r["count"]) for r in pieces.where("length > 0").groupBy("length", "salt").count().collect())
    else:
        pieces = pieces.withColumn("salt", F.lit(0))
        counts = [(size, 0, c) for size, c in histogram.items()]
    offsets, before = [], dict.fromkeys(histogram, 0)
    for size, salt, c in counts:
        offsets.append((size, salt, before[size]))
        before[size] += c
    slots, packs = [], 0
    for count, entries in plan(histogram, capacity):
        at = 0
        for size, rank in entries:
            slots.append((size, rank, rank + count, packs, at))
            at += size
        packs += count
    at_salt = spark.createDataFrame(offsets, "length int, salt int, before bigint")
    slot = spark.createDataFrame(slots, "s_length int, low bigint, high bigint, first_pack bigint, pack_offset int")
    slot = F.broadcast(slot) if len(slots) <= SLOTS else slot
    ranked = pieces.join(F.broadcast(at_salt), ["length", "salt"], "left").withColumn("rank", F.col("before") + F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece")) - 1)
    joined = ranked.join(slot, (F.col("length") == F.col("s_length")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")), "left")
    return joined.select("doc_id", "piece", "start", "length", (F.col("first_pack") + F.col("rank") - F.col("low")).alias("pack_id"), "pack_offset")
