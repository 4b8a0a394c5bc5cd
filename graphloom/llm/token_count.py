"""Token counts of whole texts with a public byte-level BPE vocabulary.

The vocabulary file's bytes are read by the driver (a fixed size) and
broadcast; Arrow functions return lengths only. Long texts are cut where the
pre-tokeniser always cuts (between a non-space and a space), and pieces are
encoded in batches of about equal bytes.

Defined results: NULL text -> NULL count; empty text -> 0; a text without any
safe boundary is encoded in one piece; special-token strings are ordinary
text. Repeated rows and NULL ids stay as they are. Input columns called
``n_tokens`` are replaced.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_BOUNDARY = re.compile(r"(?<=\S)(?=[ \n])")
_encoders: dict[int, object] = {}


def split_safely(text: str, limit: int) -> list[str]:
    """Pieces of about *limit* characters, cut only before a space or newline that follows a non-space."""
    out, a = [], 0
    while len(text) - a > limit:
        m = _BOUNDARY.search(text, a + limit)
        if not m:
            break
        out.append(text[a : m.start()])
        a = m.start()
    out.append(text[a:])
    return out


def _encoder(vocabulary: bytes, pattern: str):
    key = hash((vocabulary, pattern))
    if key not in _encoders:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in vocabulary.splitlines() if line)}
        _encoders[key] = tiktoken.Encoding("public", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _encoders[key]


def lengths(encoder, texts: list[str | None], piece_chars: int, batch_bytes: int) -> list[int | None]:
    """Number of tokens of each text; pieces are gathered into batches of *batch_bytes* UTF-8 bytes."""
    out = np.zeros(len(texts), np.int64)
    owner: list[int] = []
    pieces: list[str] = []
    size = 0

    def flush() -> None:
        nonlocal size
        if not pieces:
            return
        for i, tokens in zip(owner, encoder.encode_ordinary_batch(pieces, num_threads=1)):
            out[i] += len(tokens)
        owner.clear()
        pieces.clear()
        size = 0

    for i, t in enumerate(texts):
        for p in split_safely(t, piece_chars) if t else ():
            owner.append(i)
            pieces.append(p)
            size += len(p.encode())
            if size >= batch_bytes:
                flush()
    flush()
    return [None if t is None else int(n) for t, n in zip(texts, out)]


def count_tokens(docs: DataFrame, vocabulary_path: str, text_col: str = "text", keep: list[str] | None = None, pattern: str = PATTERN, piece_chars: int = 1 << 16, batch_bytes: int = 1 << 20) -> DataFrame:
    """The *keep* columns of *docs* (all but the text by default) and n_tokens."""
    with open(vocabulary_path, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    kept = [c for c in (keep if keep is not None else [c for c in docs.columns if c.lower() != text_col.lower()]) if c.lower() != "n_tokens"]
    src = docs.select(*[docs[f"`{c}`"] for c in kept], docs[f"`{text_col}`"].cast("string"))
    schema = T.StructType([*src.schema.fields[:-1], T.StructField("n_tokens", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared.value, pattern)
        for batch in batches:
            n = lengths(encoder, batch.columns[-1].to_pylist(), piece_chars, batch_bytes)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(n, pa.int64())], names=schema.names)

    return src.mapInArrow(run, schema)
