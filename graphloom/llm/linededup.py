"""Line dedup with content-defined chunks of lines.

A text is split at newlines; a rolling hash over the hashes of the last
``window`` lines ends a chunk wherever it is 0 modulo ``divisor``, so chunk
boundaries depend on nearby lines only and survive shifts. A chunk of at least
two lines that occurs more than once in the whole corpus is kept at its first
occurrence (smallest document id, then first place in it) and removed
elsewhere, after its bytes have been compared.

``remove_repeats`` follows that rule, of which there is SQL; a passage inside an
otherwise different document is found only where its ends are boundaries.
``remove_repeated_runs`` has no such limit: every two successive lines that are
not blank are a span, with the blank lines between them, and a line goes if any
of its spans occurs earlier. So each run of two or more lines that occurs
earlier is removed whole, and the first occurrence of every line stays.

Chunks are known by 128 bits of a hash; how often each occurs, whether all its
bytes are equal and which occurrence is first are aggregates that the tasks
combine before they exchange them, so a chunk that a large part of the corpus
has meets in no task. Only chunks whose occurrences are equal byte by byte are
removed. The texts cross the network once, towards their list of repeated
chunks; that exchange serves both the byte comparison and the rewriting.

Defined results: NULL text stays NULL with 0 removed; an empty text is one
empty line and stays; chunks of one line and chunks of white space only are
never removed; a text that loses every chunk becomes empty. Rows that repeat
both id and text are one document (all kept or cut alike); rows with the same
id and other texts are ordered by a hash of their text; a NULL id sorts first.
Texts are processed whole. Extra columns are kept; input columns called
``chunks_removed`` are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm._frames import fresh, materialise

WINDOW = 2
DIVISOR = 3
_BASE = 31
_MASK = (1 << 32) - 1
_SPAN = [("k", "bigint"), ("id", "bigint"), ("n", "int"), ("a", "int"), ("b", "int"), ("h", "bigint"), ("g", "bigint")]
_BODY = [("k", "bigint"), ("id", "bigint"), ("n", "int"), ("h", "bigint"), ("g", "bigint"), ("body", "string")]
_ARROW = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}


def _record(rows: list[tuple], form: list[tuple[str, str]]) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [()] * len(form)
    return pa.RecordBatch.from_arrays([pa.array(c, _ARROW[t]) for c, (_, t) in zip(cols, form)], names=[n for n, _ in form])


def line_hash(line: str) -> int:
    return int(hashlib.md5(line.encode("utf-8", "surrogatepass")).hexdigest()[:8], 16)


def chunk_spans(text: str, window: int = WINDOW, divisor: int = DIVISOR) -> list[tuple[int, int, int]]:
    """(first character, end character, lines) of each chunk; chunks are separated by the newline between them."""
    out: list[tuple[int, int, int]] = []
    recent: list[int] = []
    leave = pow(_BASE, window, 1 << 32)
    roll = at = start = lines = 0
    for line in text.split("\n"):
        h = line_hash(line)
        recent.append(h)
        roll = (roll * _BASE + h - (recent.pop(0) * leave if len(recent) > window else 0)) & _MASK
        lines += 1
        at += len(line)
        if roll % divisor == 0:
            out.append((start, at, lines))
            start, lines = at + 1, 0
        at += 1
    if lines:
        out.append((start, at - 1, lines))
    return out


def _body_hash(body: str) -> int:
    """128 bits, of which the upper half is signed."""
    return int.from_bytes(hashlib.blake2b(body.encode("utf-8", "surrogatepass"), digest_size=16).digest(), "big", signed=True)


def _halves(h: int) -> tuple[int, int]:
    low = h & 0xFFFFFFFFFFFFFFFF
    return h >> 64, low - (1 << 64) if low >> 63 else low


def pair_spans(text: str) -> list[tuple[int, int, int]]:
    """(first character, end character, 2) of every two successive lines that are not blank."""
    lines: list[tuple[int, int]] = []
    at = 0
    for line in text.split("\n"):
        if line and not line.isspace():
            lines.append((at, at + len(line)))
        at += len(line) + 1
    return [(a, b, 2) for (a, _), (_, b) in zip(lines, lines[1:])]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted spans with those that overlap as one."""
    out: list[tuple[int, int]] = []
    for a, b in spans:
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, divisor: int = DIVISOR) -> DataFrame:
    """*docs* with repeated chunks cut from the text, and chunks_removed."""
    return _cut(docs, id_col, text_col, lambda text: chunk_spans(text, window, divisor))


def remove_repeated_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """*docs* without the runs of two or more lines that occur earlier, and chunks_removed: how many runs went."""
    return _cut(docs, id_col, text_col, pair_spans)


def _cut(docs: DataFrame, id_col: str, text_col: str, spans_of: Callable[[str], list[tuple[int, int, int]]]) -> DataFrame:
    """*docs* without the spans of two or more lines that occur earlier, and chunks_removed."""
    kept = [c for c in docs.columns if c.lower() != "chunks_removed"]
    base = docs.select(*[docs[f"`{c}`"].cast("string").alias(c) if c.lower() == text_col.lower() else docs[f"`{c}`"] for c in kept])
    key, cuts = fresh(base, "__key"), fresh(base, "__cuts")
    place = [c.lower() for c in kept].index(text_col.lower())
    ident = [c.lower() for c in kept].index(id_col.lower())
    keyed = base.withColumn(key, F.xxhash64(F.col(f"`{kept[ident]}`"), F.col(f"`{kept[place]}`")))
    narrow = keyed.select(F.col(f"`{key}`").alias("k"), F.col(f"`{kept[ident]}`").cast("long").alias("id"), F.col(f"`{kept[place]}`").alias("text")).where("text IS NOT NULL")

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k, i, text in zip(*(c.to_pylist() for c in batch.columns)):
                for n, (a, b, lines) in enumerate(spans_of(text)):
                    if lines > 1 and not (body := text[a:b]).isspace():
                        rows.append((k, i, n, a, b, *_halves(_body_hash(body))))
            yield _record(rows, _SPAN)

    found = materialise(narrow.mapInArrow(chunks, ", ".join(f"{n} {t}" for n, t in _SPAN)), "chunks")
    often = found.groupBy("h", "g").agg(F.count("*").alias("times")).where("times > 1").select("h", "g")
    repeated = materialise(found.join(often, ["h", "g"]).select(*[n for n, _ in _SPAN]), "repeated")
    spans = repeated.groupBy("k").agg(F.collect_set(F.struct("id", "n", "a", "b", "h", "g")).alias(cuts)).withColumnRenamed("k", key)
    # every column goes along, so that this exchange of the texts is the one below too
    with_spans = keyed.join(spans, key)
    order = with_spans.columns
    keys, spot, shift = order.index(key), order.index(cuts), order.index(kept[0])

    def bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = (batch.column(i).to_pylist() for i in (keys, place + shift, spot))
            yield _record([(k, c["id"], c["n"], c["h"], c["g"], text[c["a"] : c["b"]]) for k, text, cs in zip(*columns) for c in cs], _BODY)

    occurrences = with_spans.mapInArrow(bodies, ", ".join(f"{n} {t}" for n, t in _BODY))
    first = occurrences.groupBy("h", "g").agg(F.min("body").alias("low"), F.max("body").alias("high"), F.min(F.struct("id", "k", "n")).alias("first")).where("low = high").select("h", "g", "first")
    later = repeated.join(first, ["h", "g"]).where(~F.struct("id", "k", "n").eqNullSafe(F.col("first")))
    cut = later.groupBy("k").agg(F.array_sort(F.collect_set(F.struct("a", "b"))).alias(cuts)).withColumnRenamed("k", key)
    joined = keyed.join(cut, key, "left").select(*[f"`{c}`" for c in kept], f"`{cuts}`")
    schema = T.StructType([*base.schema.fields, T.StructField("chunks_removed", T.IntegerType())])

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.columns[-1]
            cols, n = list(batch.columns[:-1]), [0] * len(lists)
            if lists.null_count < len(lists):
                texts = cols[place].to_pylist()
                for i, spans_ in enumerate(lists.to_pylist()):
                    if spans_:
                        own = merged([(s["a"], s["b"]) for s in spans_])
                        texts[i], n[i] = without(texts[i], own), len(own)
                cols[place] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*cols, pa.array(n, pa.int32())], names=schema.names)

    return joined.mapInArrow(rewrite, schema)


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without whole-line spans (sorted), each with one adjoining newline."""
    parts, at = [], 0
    for a, b in spans:
        if a > at:
            parts.append(text[at : a - 1])
        at = b + 1
    if at <= len(text):
        parts.append(text[at:])
    return "\n".join(parts)


def sql(window: int = WINDOW, divisor: int = DIVISOR) -> str:
    """DuckDB SQL for doc_id, text, chunks_removed of ``documents``."""
    terms = " + ".join(f"coalesce(lag(h, {j}) OVER w, 0) * {pow(_BASE, j, 1 << 32)}" if j else "h" for j in range(window))
    return f"""
WITH lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents),
hashed AS (SELECT *, ('0x' || substr(md5(line), 1, 8))::BIGINT AS h FROM lines),
marked AS (SELECT *, CASE WHEN ({terms}) % 4294967296 % {divisor} = 0 THEN 1 ELSE 0 END AS cut FROM hashed WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
placed AS (SELECT *, coalesce(sum(cut) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS n FROM marked),
chunks AS (SELECT doc_id, n, string_agg(line, chr(10) ORDER BY i) AS body, count(*) AS lines FROM placed GROUP BY doc_id, n),
ranked AS (SELECT *, row_number() OVER (PARTITION BY body, lines > 1 ORDER BY doc_id, n) AS nth FROM chunks),
judged AS (SELECT *, lines > 1 AND nth > 1 AND trim(body, ' ' || chr(10) || chr(9) || chr(13)) <> '' AS gone FROM ranked)
SELECT doc_id, coalesce(string_agg(body, chr(10) ORDER BY n) FILTER (NOT gone), '') AS text, CAST(count(*) FILTER (gone) AS INTEGER) AS chunks_removed
FROM judged GROUP BY doc_id"""
