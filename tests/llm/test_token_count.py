import os

import pytest
from cases import mixed, table

from graphloom.llm import token_count as C
from graphloom.llm.queries import VOCABULARY

pytestmark = pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary file")


def test_counts_of_whole_texts(spark):
    with open(VOCABULARY, "rb") as f:
        encoder = C._encoder(f.read(), C.PATTERN)
    rows = mixed()
    d = table(spark, rows)
    for how in ({}, {"piece_chars": 7, "batch_bytes": 50}):
        out = C.count_tokens(d, VOCABULARY, **how)
        assert out.columns == [c for c in d.columns if c not in ("text", "n_tokens")] + ["n_tokens"]
        want = sorted((i, -1 if t is None else len(encoder.encode_ordinary(t))) for i, t in rows if i is not None)
        assert sorted((r.doc_id, -1 if r.n_tokens is None else r.n_tokens) for r in out.collect() if r.doc_id is not None) == want
    assert C.count_tokens(table(spark, []), VOCABULARY).collect() == []


def test_pieces_join_and_cut_before_spaces():
    text = " ".join(f"word{i}" for i in range(500)) + "\n\n  end  "
    parts = C.split_safely(text, 40)
    assert "".join(parts) == text and len(parts) > 50 and all(p[0] in " \n" for p in parts[1:])
