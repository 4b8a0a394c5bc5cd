import random

import numpy as np
from cases import mixed, table

from graphloom.llm import langid as I

SYLLABLES = {"en": ["the", "and", "ing", "wor", "th", "er", "ness"], "de": ["sch", "ung", "ver", "ein", "keit", "lich", "pf"], "es": ["ción", "los", "que", "ado", "mente", "ía", "ñ"]}


def _text(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def _rows(seed, n=150):
    rng = random.Random(seed)
    return [(i, _text(rng, lang, rng.randrange(3, 60)), lang) for i in range(n) for lang in [rng.choice(list(SYLLABLES))]]


def test_held_out_accuracy(spark):
    model = I.train(table(spark, _rows(1)))
    out = I.identify(table(spark, _rows(2)), model).collect()
    assert np.mean([r.pred_lang == r.lang for r in out]) >= 0.98 and np.mean([r.accepted for r in out]) >= 0.95


def test_scores_against_plain_counts(spark):
    rows = _rows(3, 40)
    model = I.train(table(spark, rows))
    counts = {x: np.full(1 << I.BUCKET_BITS, 0.5) for x in SYLLABLES}
    for _, text, lang in rows:
        for grams, first, last in [I.gram_buckets([text])]:
            for g in grams:
                np.add.at(counts[lang], g[first[0] : last[0]], 1)
    assert model.languages == sorted(SYLLABLES)
    for k, lang in enumerate(model.languages):
        assert np.allclose(model.log_prob[k], np.log(counts[lang] / counts[lang].sum()), atol=1e-5)
    best, posterior, n = I.score(model, [rows[0][1], ""])
    assert model.languages[best[0]] == rows[0][2] and best[1] == -1 and np.isnan(posterior[1]) and n[1] == 0


def test_edge_cases(spark):
    model = I.train(table(spark, _rows(1) + [(1, None), (2, "x", None)]))
    d = table(spark, mixed())
    out = {r.doc_id: r for r in I.identify(d, model).collect()}
    assert len(out) == len({r.doc_id for r in d.collect()})
    for i in (100, 101, 102, 104):
        assert (out[i].pred_lang, out[i].posterior, out[i].n_grams, out[i].accepted) == (None, None, 0, False)
    assert out[109].n_grams > 100_000
    empty = I.train(table(spark, []))
    assert not any(r.accepted for r in I.identify(d, empty).collect())
    assert I.identify(table(spark, []), model).collect() == []
