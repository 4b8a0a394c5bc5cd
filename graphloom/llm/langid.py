"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts n-grams of every labelled text in one distributed pass; the
log-probability matrix (n_buckets x languages, a fixed size) is broadcast and
texts are scored as sparse rows against it, one Arrow batch at a time.

Defined results: a NULL or empty text, or one without letters, has
``pred_lang`` NULL, ``posterior`` NULL, ``n_grams`` 0 and ``accepted`` false.
Texts are scored whole, however long. Ties go to the language that sorts
first. Rows with NULL label train nothing. An empty training table gives a
model that accepts nothing. Repeated rows count as often as they occur.
Columns of the input that are called like an output column are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm._text import byte_slices, code_points, letter_table, texts_of

ORDERS = (1, 2, 3)
BUCKET_BITS = 16
_SLICE = 1 << 20
_K = [np.uint32(x) for x in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F)]


def gram_buckets(texts: list[str]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """For each order, the bucket of the n-gram that starts at each place; and each text's range of places.

    Letters are lower-cased, every other run of characters is one separator,
    and each text is preceded and followed by separators.
    """
    pad = max(ORDERS)
    lengths = np.fromiter((len(t) for t in texts), np.int64, len(texts))
    start = pad + np.concatenate([[0], np.cumsum(lengths + pad)[:-1]])
    gap = "\0" * pad
    low = letter_table()[code_points(gap + gap.join(texts) + gap)]
    letter = low != 0
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    end = start + lengths
    keep[start - 1] = True
    for k in range(pad - 1):
        keep[end + k] = True
    at = np.cumsum(keep)
    seq = low[keep]
    first, last = at[start - 1] - 1, at[end - 1]
    places = len(seq) - pad + 1
    out = []
    x = np.full(places, 0, np.uint32)
    for n in range(1, pad + 1):
        x = x + seq[n - 1 : n - 1 + places] * _K[n - 1]
        if n in ORDERS:
            h = x + np.uint32(n) * _K[3]
            h ^= h >> np.uint32(15)
            h *= _K[1]
            out.append(h >> np.uint32(32 - BUCKET_BITS))
    return out, first, last


@dataclass
class LanguageModel:
    """languages, log priors, and the log-probability of each bucket (one row a language)."""

    languages: list[str]
    log_prior: np.ndarray
    log_prob: np.ndarray


def train(docs: DataFrame, text_col: str = "text", label_col: str = "lang", alpha: float = 0.5) -> LanguageModel:
    """Fit on every row with a label. What reaches the driver is at most languages x 2**BUCKET_BITS counts."""
    size = 1 << BUCKET_BITS
    src = docs.select(docs[f"`{label_col}`"].cast("string").alias("lang"), docs[f"`{text_col}`"].cast("string").alias("text")).where("lang IS NOT NULL AND text IS NOT NULL")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        seen: dict[str, int] = {}
        for batch in batches:
            for a, b in byte_slices(batch.column(1), _SLICE):
                langs, texts = batch.column(0).slice(a, b - a).to_pylist(), texts_of(batch.column(1), a, b)
                order = sorted(range(len(langs)), key=langs.__getitem__)
                grams, first, last = gram_buckets([texts[i] for i in order])
                i = 0
                while i < len(order):
                    lang, j = langs[order[i]], i
                    while j < len(order) and langs[order[j]] == lang:
                        j += 1
                    counts = total.setdefault(lang, np.zeros(size, np.int64))
                    inside = np.zeros(last[j - 1] - first[i] + 1, np.int8)
                    np.add.at(inside, first[i:j] - first[i], 1)
                    np.add.at(inside, last[i:j] - first[i], -1)
                    inside = np.cumsum(inside[:-1]).astype(bool)
                    for g in grams:
                        counts += np.bincount(g[first[i] : last[j - 1]][inside], minlength=size)
                    seen[lang] = seen.get(lang, 0) + j - i
                    i = j
        for lang, counts in total.items():
            at = np.flatnonzero(counts)
            n = len(at) + 1
            yield pa.RecordBatch.from_arrays([pa.array([lang] * n), pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(counts[at], seen[lang]), pa.int64())], names=["lang", "bucket", "n"])

    counted = src.mapInArrow(count, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(counted["lang"].unique())
    matrix, docs_of = np.zeros((len(languages), size)), np.zeros(len(languages))
    row = counted["lang"].map({x: i for i, x in enumerate(languages)}).to_numpy(dtype=np.int64)
    bucket, n = counted["bucket"].to_numpy(), counted["n"].to_numpy()
    real = bucket >= 0
    matrix[row[real], bucket[real]] = n[real]
    docs_of[row[~real]] = n[~real]
    matrix += alpha
    return LanguageModel(languages, np.log(np.maximum(docs_of, 1) / max(docs_of.sum(), 1)), np.log(matrix / matrix.sum(axis=1, keepdims=True)).astype(np.float32))


def score(model: LanguageModel, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best language (-1: none), its posterior, and the number of n-grams, of each text."""
    grams, first, last = gram_buckets(texts)
    n = len(texts)
    joint = np.zeros((n, len(model.languages)))
    cuts = np.stack([first, last], axis=1).ravel()
    for g in grams:
        for k in range(len(model.languages)):
            joint[:, k] += np.add.reduceat(model.log_prob[k][g], cuts[:-1] if cuts[-1] == len(g) else cuts, dtype=np.float64)[::2]
    empty = (last - first <= 1) | (not model.languages)
    if not model.languages:
        return np.full(n, -1), np.full(n, np.nan), np.zeros(n, np.int64)
    joint += model.log_prior
    best = joint.argmax(axis=1)
    posterior = 1 / np.exp(joint - joint.max(axis=1, keepdims=True)).sum(axis=1)
    return np.where(empty, -1, best), np.where(empty, np.nan, posterior), np.where(empty, 0, (last - first) * len(ORDERS))


def identify(docs: DataFrame, model: LanguageModel, text_col: str = "text", min_posterior: float = 0.9) -> DataFrame:
    """*docs* with pred_lang, posterior, n_grams and accepted (posterior >= *min_posterior*)."""
    outs = ("pred_lang", "posterior", "n_grams", "accepted")
    kept = [c for c in docs.columns if c.lower() not in outs]
    src = docs.select(*[f"`{c}`" for c in kept])
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = [c.lower() for c in kept].index(text_col.lower())
    schema = T.StructType([*src.schema.fields, T.StructField("pred_lang", T.StringType()), T.StructField("posterior", T.DoubleType()), T.StructField("n_grams", T.LongType()), T.StructField("accepted", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        names = np.array([*m.languages, None], dtype=object)
        for batch in batches:
            text = batch.column(place)
            for a, b in byte_slices(text, _SLICE):
                best, post, n = score(m, texts_of(text, a, b))
                with np.errstate(invalid="ignore"):
                    ok = post >= min_posterior
                cols = [c.slice(a, b - a) for c in batch.columns]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(names[best], pa.string()), pa.array(post, pa.float64(), mask=best < 0), pa.array(n, pa.int64()), pa.array(ok)], names=schema.names)

    return src.mapInArrow(run, schema)
