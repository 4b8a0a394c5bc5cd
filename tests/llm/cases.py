"""Documents with everything that a table may hold, and columns whose names clash with the operators' own."""

import random

CLASH = ["h", "k", "d", "sig", "rep", "n", "id", "a", "b", "piece", "length", "depth", "p", "shard", "terms", "counts", "n_tokens", "n_pii", "chunks_removed", "PRED_LANG", "__key", "__cuts", "group_id", "matches", "salt", "rank", "__bad"]
FORM = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"`{c}` string" for c in CLASH)


def table(spark, rows):
    """*rows* are (doc_id, text) or (doc_id, text, lang)."""
    return spark.createDataFrame([(r[0], r[1], r[2] if len(r) > 2 else "en", "s", None if r[1] is None else len(r[1]), *["x"] * len(CLASH)) for r in rows], FORM)


def words(rng, n, size=3000):
    return [f"w{rng.randrange(size)}" for _ in range(n)]


def mixed(seed=1, n=40):
    """Ordinary texts, then the difficult ones: NULLs, empties, no words, one word, very long, repeated rows and ids."""
    rng = random.Random(seed)
    rows = [(i, "\n".join(" ".join(words(rng, rng.randrange(5, 30))) for _ in range(rng.randrange(1, 12)))) for i in range(n)]
    long = "\n".join(" ".join(words(rng, 20)) for _ in range(1500))
    return rows + [(100, None), (None, None), (None, rows[0][1]), (101, ""), (102, " \n\t "), (103, "one"), (104, "…!?"), (105, long), (106, rows[3][1]), (106, rows[3][1]), (107, rows[4][1]), (107, rows[5][1]), (108, "é ß 漢字\u0000 \U0001f600"), (109, "x" * 50_000)]
