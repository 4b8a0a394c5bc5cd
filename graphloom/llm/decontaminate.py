"""Benchmark decontamination with a distributed positional inverted index.

The training texts are indexed by document shards (slices of the table, as the
scan delivers them): for every test term that occurs, its ascending list of
positions. Terms that no test item has can never be looked up and are not
stored. The index is a table in the shared folder, so the search never returns
to the texts.

Each test item gives its windows of ``phrase`` consecutive tokens (a shorter
item is one window). A window's terms are ordered by their number of
occurrences in the whole training corpus; starting from the list of the rarest,
lists shifted by their term's place in the window are intersected in that
order. A *phrase* match has every term exactly at its place; a *proximity*
match has every term within ``slack`` of the place that the rarest term's
position implies.

Result: one row per (doc_id, item_id) with any match: the item's number of
windows, how many match as a phrase and how many at least by proximity, the
token position of the first match, and ``contaminated``: some phrase match, or
proximity matches of at least ``near_share`` of the windows.

Defined results: NULL and empty texts, and texts or items without tokens, match
nothing; NULL ids take no part; rows that repeat an id are joined into one
result row with the largest counts. Items are searched in blocks of
``block_tokens`` tokens, so a test set of any size fits. Texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm._frames import fresh, materialise
from graphloom.llm._text import Tokens, byte_slices, texts_of

PHRASE = 10
SLACK = 2
NEAR_SHARE = 0.5
BLOCK_TOKENS = 2_000_000
_SLICE = 1 << 21
_INDEX = "doc_ids array<bigint>, bases array<int>, terms array<bigint>, counts array<int>, positions array<int>"
_FOUND = "doc_id bigint, item_id bigint, windows int, phrase_windows int, near_windows int, first_position int"


class _Lookup:
    """Position of a hash in a sorted vocabulary, or -1, by a direct-address table over low bits."""

    def __init__(self, vocabulary: np.ndarray):
        self.v = vocabulary
        self.bits = np.uint64(max(12, int(len(vocabulary)).bit_length() + 3))
        self.mask = np.uint64((1 << int(self.bits)) - 1)
        slot = (vocabulary & self.mask).astype(np.int64)
        order = np.argsort(slot, kind="stable")
        self.order, self.start = order, np.searchsorted(slot[order], np.arange((1 << int(self.bits)) + 1)).astype(np.int32)
        self.depth = int(np.diff(self.start).max(initial=0))

    def __call__(self, h: np.ndarray) -> np.ndarray:
        out = np.full(len(h), -1, np.int32)
        slot = (h & self.mask).astype(np.int64)
        low, high = self.start[slot], self.start[slot + 1]
        live = np.flatnonzero(low < high)
        for _ in range(self.depth):
            at = self.order[low[live]]
            hit = self.v[at] == h[live]
            out[live[hit]] = at[hit]
            low[live] += 1
            live = live[~hit]
            live = live[low[live] < high[live]]
        return out


def index(docs: DataFrame, vocabulary: np.ndarray, gap: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The positional index of *docs* over the given (sorted, uint64) test terms; one row per document shard."""
    src = docs.select(docs[f"`{id_col}`"].cast("long").alias("doc_id"), docs[f"`{text_col}`"].cast("string").alias("text")).where("doc_id IS NOT NULL AND text IS NOT NULL")
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = _Lookup(shared.value)
        for batch in batches:
            for a, b in byte_slices(batch.column(1), _SLICE):
                t = Tokens(texts_of(batch.column(1), a, b))
                term = lookup(t.hash)
                bases = t.first[:-1] + gap * np.arange(len(t.first) - 1)
                at = np.flatnonzero(term >= 0)
                where = at + gap * np.repeat(np.arange(len(t.first) - 1), np.diff(t.first))[at]
                term = term[at]
                order = np.argsort(term, kind="stable")
                terms, counts = np.unique(term, return_counts=True)
                row = [batch.column(0).slice(a, b - a).to_numpy(), bases.astype(np.int32), shared.value[terms].view(np.int64), counts.astype(np.int32), where[order].astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array([x], pa.list_(p)) for x, p in zip(row, (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32()))], names=["doc_ids", "bases", "terms", "counts", "positions"])

    return src.mapInArrow(run, _INDEX)


class Windows:
    """The windows of equal length n of several items: terms (rows of vocabulary places), by item."""

    def __init__(self, n: int, items: np.ndarray, of_item: np.ndarray, terms: np.ndarray, frequency: np.ndarray):
        self.n, self.items, self.of_item, self.terms = n, items, of_item, terms
        self.order = np.argsort(frequency[terms], axis=1, kind="stable")
        self.anchor = self.order[:, 0]


def _cut(items: list[tuple[int, np.ndarray]], phrase: int, frequency: np.ndarray) -> list[Windows]:
    by: dict[int, list[tuple[int, np.ndarray]]] = {}
    for item, terms in items:
        by.setdefault(min(phrase, len(terms)), []).append((item, terms))
    out = []
    for n, group in by.items():
        rows = [np.lib.stride_tricks.sliding_window_view(t, n) for _, t in group]
        out.append(Windows(n, np.array([i for i, _ in group]), np.repeat(np.arange(len(group)), [len(r) for r in rows]), np.concatenate(rows), frequency))
    return out


def _search(w: Windows, start: np.ndarray, count: np.ndarray, keys: np.ndarray, slack: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window, position where it starts, is a phrase) of every match within one shard."""
    row = np.arange(len(w.terms))
    lead = w.terms[row, w.anchor]
    many = count[lead]
    who = np.repeat(row, many)
    nth = np.arange(len(who)) - np.repeat(np.cumsum(many) - many, many)
    begin = (keys[start[lead][who] + nth] & 0xFFFFFFFF) - w.anchor[who]
    exact = np.ones(len(who), bool)
    for r in range(1, w.n):
        place = w.order[who, r]
        term = w.terms[who, place].astype(np.int64) << 32
        want = begin + place
        at = np.searchsorted(keys, term + np.maximum(want - slack, 0))
        near = keys[np.minimum(at, len(keys) - 1)]
        ok = (at < len(keys)) & (near >= term) & (near <= term + np.maximum(want + slack, -1))
        who, begin, exact, term, want = who[ok], begin[ok], exact[ok], term[ok], want[ok]
        if not len(who):
            break
        goal = term + np.maximum(want, 0)
        at = np.searchsorted(keys, goal)
        exact &= (want >= 0) & (at < len(keys)) & (keys[np.minimum(at, len(keys) - 1)] == goal)
    return who, begin, exact


def _blocks(bench: DataFrame, id_col: str, text_col: str, limit: int) -> Iterator[list[tuple[int, np.ndarray]]]:
    block, size = [], 0
    for r in bench.select(bench[f"`{id_col}`"].cast("long").alias("i"), bench[f"`{text_col}`"].cast("string").alias("t")).where("i IS NOT NULL AND t IS NOT NULL").toLocalIterator():
        h = Tokens([r.t]).hash
        if len(h):
            block.append((r.i, h))
            size += len(h)
        if size >= limit:
            yield block
            block, size = [], 0
    if block:
        yield block


def find_matches(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", phrase: int = PHRASE, slack: int = SLACK, near_share: float = NEAR_SHARE, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Matches of test items in training documents, as the module describes."""
    spark = docs.sparkSession
    parts = []
    gap = 2 * (phrase + slack)
    for block in _blocks(bench, item_col, item_text_col, block_tokens):
        vocabulary = np.unique(np.concatenate([h for _, h in block]))
        stored = materialise(index(docs, vocabulary, gap, id_col, text_col), "postings")
        seen = stored.select(F.explode(F.arrays_zip("terms", "counts")).alias("x")).groupBy("x.terms").agg(F.sum("x.counts").alias("n")).toPandas()
        frequency = np.zeros(len(vocabulary), np.int64)
        frequency[np.searchsorted(vocabulary, seen["terms"].to_numpy(dtype=np.int64).view(np.uint64))] = seen["n"].to_numpy(dtype=np.int64)
        windows = _cut([(i, np.searchsorted(vocabulary, h).astype(np.int32)) for i, h in block], phrase, frequency)
        shared = spark.sparkContext.broadcast((vocabulary, windows))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            words, groups = shared.value
            for batch in batches:
                for r in range(len(batch)):
                    ids, bases, terms, counts, positions = (c[r].values.to_numpy(zero_copy_only=False) for c in batch.columns)
                    if not len(terms):
                        continue
                    place = np.searchsorted(words, terms.view(np.uint64))
                    count = np.zeros(len(words), np.int64)
                    count[place] = counts
                    start = np.cumsum(count) - count
                    keys = np.repeat(place.astype(np.int64) << 32, counts) + positions
                    for w in groups:
                        who, begin, exact = _search(w, start, count, keys, slack)
                        if not len(who):
                            continue
                        anchor = begin + w.anchor[who]
                        doc = np.searchsorted(bases, anchor, "right") - 1
                        order = np.lexsort((begin, ~exact, who, w.of_item[who], doc))
                        who, begin, exact, doc = who[order], begin[order], exact[order], doc[order]
                        item = w.of_item[who]
                        first_of_window = np.r_[True, (np.diff(who) != 0) | (np.diff(doc) != 0)]
                        new = np.r_[True, (np.diff(item) != 0) | (np.diff(doc) != 0)]
                        cut = np.flatnonzero(new)
                        near = np.add.reduceat(first_of_window.astype(np.int32), cut)
                        phrases = np.add.reduceat((first_of_window & exact).astype(np.int32), cut)
                        first = np.maximum(np.minimum.reduceat(begin - bases[doc], cut), 0)
                        total = np.bincount(w.of_item, minlength=len(w.items))
                        yield pa.RecordBatch.from_arrays([pa.array(x, p) for x, p in ((ids[doc[cut]], pa.int64()), (w.items[item[cut]], pa.int64()), (total[item[cut]], pa.int32()), (phrases, pa.int32()), (near, pa.int32()), (first, pa.int32()))], names=["doc_id", "item_id", "windows", "phrase_windows", "near_windows", "first_position"])

        parts.append(stored.mapInArrow(run, _FOUND))
    if not parts:
        found = spark.createDataFrame([], _FOUND)
    else:
        found = parts[0]
        for p in parts[1:]:
            found = found.unionByName(p)
    found = found.groupBy("doc_id", "item_id").agg(F.max("windows").alias("windows"), F.max("phrase_windows").alias("phrase_windows"), F.max("near_windows").alias("near_windows"), F.min("first_position").alias("first_position"))
    return found.withColumn("contaminated", (F.col("phrase_windows") > 0) | (F.col("near_windows") >= near_share * F.col("windows")))


def drop_contaminated(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", **how) -> DataFrame:
    """*docs* without those that contain a test item."""
    name = fresh(docs, "__bad")
    bad = find_matches(docs, bench, id_col, **how).where("contaminated").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(bad, docs[f"`{id_col}`"].cast("long") == F.col(f"`{name}`"), "left_anti")


def sql(phrase: int = PHRASE, slack: int = SLACK, near_share: float = NEAR_SHARE) -> str:
    """DuckDB SQL for find_matches over ``documents`` and ``benchmark``."""
    return f"""
WITH words AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) AS term, unnest(range(len(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')))) AS pos FROM documents),
tests AS (SELECT item_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) AS term, unnest(range(len(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')))) AS pos, len(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) AS size FROM benchmark),
known AS (SELECT w.* FROM words w SEMI JOIN tests t ON w.term = t.term),
often AS (SELECT term, count(*) AS n FROM known GROUP BY term),
windows AS (SELECT s.item_id, s.pos AS win, least({phrase}, s.size) AS len, t.term, t.pos - s.pos AS place, coalesce(o.n, 0) AS n
  FROM tests s JOIN tests t ON s.item_id = t.item_id AND t.pos >= s.pos AND t.pos < s.pos + least({phrase}, s.size) AND s.pos + least({phrase}, s.size) <= s.size LEFT JOIN often o ON o.term = t.term),
anchors AS (SELECT * FROM windows QUALIFY row_number() OVER (PARTITION BY item_id, win ORDER BY n, place) = 1),
starts AS (SELECT a.item_id, a.win, a.len, k.doc_id, k.pos - a.place AS begin FROM anchors a JOIN known k ON a.term = k.term),
checked AS (SELECT s.item_id, s.win, s.len, s.doc_id, s.begin, w.place, max(CASE WHEN k.pos = s.begin + w.place THEN 1 ELSE 0 END) AS exact
  FROM starts s JOIN windows w ON s.item_id = w.item_id AND s.win = w.win JOIN known k ON k.doc_id = s.doc_id AND k.term = w.term AND k.pos BETWEEN s.begin + w.place - {slack} AND s.begin + w.place + {slack}
  GROUP BY s.item_id, s.win, s.len, s.doc_id, s.begin, w.place),
hits AS (SELECT item_id, win, doc_id, begin, count(*) = sum(exact) AS exact FROM checked GROUP BY item_id, win, len, doc_id, begin HAVING count(*) = len),
total AS (SELECT item_id, count(DISTINCT win) AS windows FROM windows GROUP BY item_id),
found AS (SELECT h.doc_id, h.item_id, CAST(any_value(t.windows) AS INTEGER) AS windows, CAST(count(DISTINCT CASE WHEN exact THEN win END) AS INTEGER) AS phrase_windows, CAST(count(DISTINCT win) AS INTEGER) AS near_windows, CAST(greatest(min(begin), 0) AS INTEGER) AS first_position
  FROM hits h JOIN total t ON h.item_id = t.item_id GROUP BY h.doc_id, h.item_id)
SELECT *, phrase_windows > 0 OR near_windows >= {near_share} * windows AS contaminated FROM found"""
