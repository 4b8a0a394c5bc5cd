import random
from collections import Counter

import pytest
from cases import mixed, table

from graphloom.llm import packing as K


def _naive(lengths, capacity):
    """Longest first, each into the open pack with the most space; what fits none of them opens a pack of its own."""
    packs = []
    for n in sorted(set(lengths), reverse=True):
        new = []
        for _ in range(lengths.count(n)):
            best = max((p for p in packs if sum(p) + n <= capacity), key=lambda p: capacity - sum(p), default=None)
            if best is None:
                new.append([n])
            else:
                best.append(n)
        packs += new
    return packs


@pytest.mark.parametrize("seed", range(20))
def test_plan_against_one_by_one(seed):
    rng = random.Random(seed)
    lengths = [rng.randrange(1, 41) for _ in range(rng.randrange(1, 300))]
    plan = K.plan(dict(Counter(lengths)), 40)
    packs = [[n for n, _ in slots] for count, slots in plan for _ in range(count)]
    assert Counter(n for p in packs for n in p) == Counter(lengths) and all(sum(p) <= 40 for p in packs)
    assert len(packs) == len(_naive(lengths, 40))
    # every rank of every length is used once
    ranks = Counter((n, r + i) for count, slots in plan for n, r in slots for i in range(count))
    assert set(ranks) == {(n, i) for n, c in Counter(lengths).items() for i in range(c)} and set(ranks.values()) == {1}


def test_documents(spark):
    rows = mixed()
    out = K.pack(table(spark, rows), capacity=200).collect()
    # a length cut over several windows, and intervals that aren't broadcast, fill the packs alike
    K_SLOTS, K.SLOTS = K.SLOTS, 3
    salted = K.pack(table(spark, rows), capacity=200, rank_rows=5).collect()
    K.SLOTS = K_SLOTS
    plain = lambda got: sorted((r.length, -1 if r.pack_id is None else r.pack_id, -1 if r.pack_offset is None else r.pack_offset) for r in got)
    assert plain(salted) == plain(out)
    size = lambda t: len((t or "").split())
    per = Counter()
    for r in out:
        per[r.doc_id] += r.length
    want = Counter()
    for i, t in rows:
        want[i] += size(t)
    assert per == want
    packs = {}
    for r in out:
        assert (r.pack_id is None) == (r.length == 0)
        if r.length:
            packs.setdefault(r.pack_id, []).append((r.pack_offset, r.length))
    for p in packs.values():
        at = 0
        for offset, n in sorted(p):
            assert offset == at
            at += n
        assert at <= 200
    assert sorted(packs) == list(range(len(packs)))
    assert K.pack(table(spark, [])).collect() == [] and [r.pack_id for r in K.pack(table(spark, [(1, None), (2, " ")])).collect()] == [None, None]


def test_bad_length():
    with pytest.raises(ValueError):
        K.plan({50: 1}, 40)
