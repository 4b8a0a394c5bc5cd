import random

import numpy as np
from cases import mixed, table, words

from graphloom.llm import minhash as M


def _corpus():
    rng = random.Random(9)
    docs = {i: words(rng, rng.randrange(30, 200)) for i in range(50)}
    for i in range(60):  # near copies with more and more changes, some of copies
        base = docs[rng.choice(sorted(docs))]
        docs[100 + i] = [w if rng.random() > 0.002 * i else "new" for w in base]
    return [(i, " ".join(w)) for i, w in docs.items()]


def _groups(pairs):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(root)}


def _brute(rows, t=32):
    sigs, ok = M.signatures([t or "" for _, t in rows], M.COORDINATES, M.SHINGLE)
    ids = [i for i, _ in rows]
    return {(min(ids[x], ids[y]), max(ids[x], ids[y])): int((sigs[x] == sigs[y]).sum()) for x in range(len(rows)) for y in range(x) if ok[x] and ok[y] and (sigs[x] == sigs[y]).sum() >= t}


def test_groups_and_pairs_against_brute_force(spark):
    rows = _corpus()
    brute = _brute(rows)
    got = {(r.doc_a, r.doc_b): r.matches for r in M.near_pairs(table(spark, rows)).collect()}
    assert all(brute.get(p) == m for p, m in got.items())
    want = _groups(brute)
    assert _groups(got) == want
    assert {r.doc_id: r.group_id for r in M.components(M.near_pairs(table(spark, rows))).collect()} == want


def test_similar_texts_are_found(spark):
    # recall against the exact Jaccard similarity of word triples
    rows = _corpus()
    shingles = {i: {tuple(w[j : j + 3]) for j in range(len(w) - 2)} for i, w in ((i, t.split()) for i, t in rows)}
    group = {r.doc_id: r.group_id for r in M.components(M.near_pairs(table(spark, rows))).collect()}
    close = [(a, b) for a in shingles for b in shingles if a < b and len(shingles[a] & shingles[b]) >= 0.6 * len(shingles[a] | shingles[b])]
    assert np.mean([group.get(a, a) == group.get(b, b) for a, b in close]) >= 0.95


def test_a_group_of_many_copies_is_linear(spark):
    rng = random.Random(1)
    base = words(rng, 100)
    rows = [(i, " ".join(base[: 100 - i % 4])) for i in range(400)]
    pairs = M.near_pairs(table(spark, rows))
    assert pairs.count() < 3 * 400 and set(_groups([(r.doc_a, r.doc_b) for r in pairs.collect()]).values()) == {0}


def test_drop_and_edge_cases(spark):
    d = table(spark, mixed())
    kept = M.drop_near_duplicates(d)
    assert kept.columns == d.columns
    ids = [r.doc_id for r in kept.collect()]
    # copies go to the smallest id; what has no word or no id stays
    assert 106 not in ids and {0, 3, 100, 101, 102, 104, 105}.issubset(ids) and None in ids
    assert M.near_pairs(table(spark, [])).collect() == []
    assert M.drop_near_duplicates(table(spark, [])).collect() == []
    assert M.components(M.near_pairs(table(spark, [(1, "a b c d")]))).collect() == []


def test_all_pairs_of_distinct_near_copies(spark, monkeypatch):
    monkeypatch.setattr(M, "_BLOCK", 7)
    rng = random.Random(2)
    base = words(rng, 150)
    rows = _corpus() + [(1000 + i, " ".join(w if rng.random() > 0.02 else f"n{i}" for w in base)) for i in range(40)]
    brute = _brute(rows)
    sigs, _ = M.signatures([t for _, t in rows], M.COORDINATES, M.SHINGLE)
    rep = {}
    of = {i: rep.setdefault(sig.tobytes(), i) for (i, _), sig in sorted(zip(rows, sigs), key=lambda x: x[0][0])}
    got = [(r.doc_a, r.doc_b, r.matches) for r in M.near_pairs(table(spark, rows)).collect()]
    want = {(a, b, m) for (a, b), m in brute.items() if of[a] == a and (of[b] == b or of[b] == a)}
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 500


def test_links_and_groups_of_documents_against_brute_force(spark, monkeypatch):
    rng = random.Random(6)
    base = words(rng, 150)
    near = [(1000 + i, " ".join(w if rng.random() > 0.02 else f"n{i}" for w in base)) for i in range(40)]
    rows = _corpus() + near + [(2000 + i, near[3][1]) for i in range(5)]
    sigs, _ = M.signatures([t for _, t in rows], M.COORDINATES, M.SHINGLE)
    first, size = {}, {}
    for i, sig in sorted((i, sig.tobytes()) for (i, _), sig in zip(rows, sigs)):
        first.setdefault(sig, i)
        size[first[sig]] = size.get(first[sig], 0) + 1
    of = {i: first[sig.tobytes()] for (i, _), sig in zip(rows, sigs)}
    brute = _brute(rows)
    links = {}
    for a, b in {(of[a], of[b]) for a, b in brute if of[a] != of[b]}:
        for p, q in ((a, b), (b, a)):
            links.setdefault(p, set()).add(q)
    group = _groups(brute)
    want = {i: (c, group.get(i, i), size[c] - 1, len(links.get(c, ()))) for i, c in of.items() if size[c] > 1 or c in links}
    for block in (M._BLOCK, 7):
        monkeypatch.setattr(M, "_BLOCK", block)
        got = M.near_duplicates(table(spark, rows)).collect()
        assert {r.doc_id: tuple(r)[1:] for r in got} == want and len(got) == len(want)
    assert M.near_duplicates(table(spark, [])).collect() == []
    assert [tuple(r) for r in M.near_duplicates(table(spark, [(1, "a b c d"), (2, "x y"), (3, "A, b c D!"), (None, "x y"), (4, None), (5, "")])).orderBy("doc_id").collect()] == [(1, 1, 1, 1, 0), (3, 1, 1, 1, 0)]
