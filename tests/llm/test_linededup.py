import random

import corpus_pipeline
from cases import mixed, table

from graphloom.llm import linededup as L


def _distinct(rows):
    seen, out = set(), []
    for r in rows:
        if r[0] is not None and r[0] not in seen:
            seen.add(r[0])
            out.append(r)
    return out


def test_same_rows_as_sql(spark, same_as_sql):
    base = mixed(n=60)
    block = "\n".join(f"shared line {i}" for i in range(14))
    rows = [(i, t if i % 3 else f"{t}\n{block}\n{t[:40]}") for i, t in base if i is not None and t is not None and i < 60] + [(70, block), (71, block), (72, ""), (73, "one"), (74, "\n\n\n\n\n\n"), (75, "\n\n\n\n\n\n\n\n\n"), (76, dict(base)[105]), (77, dict(base)[105])]
    d = table(spark, rows)
    got = same_as_sql(L.remove_repeats(d.select("doc_id", "text")), L.sql(), documents=d)
    assert sum(r[0] for r in got) > 20


def test_boundaries_resist_shifts():
    text = "\n".join(f"line {i} {i * i}" for i in range(200))
    bodies = lambda t: {t[a:b] for a, b, _ in L.chunk_spans(t)}
    assert len(bodies(text) & bodies("new\nlines\n" + text)) >= len(bodies(text)) - 2
    assert "\n".join(text[a:b] for a, b, _ in L.chunk_spans(text)) == text


def test_edge_cases(spark):
    d = table(spark, mixed())
    out = L.remove_repeats(d)
    assert [c for c in out.columns if c != "chunks_removed"] == [c for c in d.columns if c != "chunks_removed"]
    rows = out.collect()
    assert len(rows) == d.count()
    assert [(r.text, r.chunks_removed) for r in rows if r.doc_id == 100] == [(None, 0)]
    assert [(r.text, r.chunks_removed) for r in rows if r.doc_id == 101] == [("", 0)]
    # rows that repeat id and text are one document: cut alike
    assert len({(r.text, r.chunks_removed) for r in rows if r.doc_id == 106}) == 1
    assert L.remove_repeats(table(spark, [])).collect() == []


def test_collisions_are_told_apart_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(L, "_body_hash", lambda body: 1)
    texts = ["\n".join(f"{c} {i}" for i in range(30)) for c in "abcd"]
    out = L.remove_repeats(table(spark, list(enumerate(texts))))
    assert {r.text for r in out.collect()} == set(texts)


def _runs_by_brute_force(rows):
    """The texts without every line that lies in a run of two lines that occurs earlier."""
    seen, out = set(), {}
    for i, text in sorted(rows):
        lines, gone = text.split("\n"), set()
        for n, pair in enumerate(zip(lines, lines[1:])):
            gone |= {n, n + 1} if pair in seen else set()
            seen.add(pair)
        out[i] = "\n".join(x for n, x in enumerate(lines) if n not in gone)
    return out


def test_runs_inside_other_documents_are_removed_whole(spark):
    rng = random.Random(4)
    passages = [[f"passage {p} line {i} {rng.random()}" for i in range(2 + p % 4)] for p in range(12)]
    rows = []
    for i in range(60):
        host = [f"own {i} {j} {rng.random()}" for j in range(rng.randrange(2, 9))]
        at = rng.randrange(len(host) + 1)
        rows.append((i, "\n".join(host[:at] + passages[i % 12] + host[at:])))
    rows.append((60, rows[7][1]))
    out = {r.doc_id: r for r in L.remove_repeated_runs(table(spark, rows)).collect()}
    assert {i: r.text for i, r in out.items()} == _runs_by_brute_force(rows)
    assert [out[i].chunks_removed for i in range(61)] == [0] * 12 + [1] * 49 and out[60].text == ""
    staged = {r.doc_id: r.text for r in corpus_pipeline.line_dedup(spark, table(spark, rows), "").collect()}
    assert staged == {i: r.text for i, r in out.items() if r.text}


def test_runs_edge_cases(spark):
    rows = [(1, "a\n\nb\nc"), (2, "x\na\n\nb\ny"), (3, "a\nb\nz"), (4, "\n \n\n"), (5, "\n \n\n"), (6, "one"), (7, "one"), (8, None), (9, "q\nq\nq")]
    out = {r.doc_id: (r.text, r.chunks_removed) for r in L.remove_repeated_runs(table(spark, rows)).collect()}
    assert out == {**{i: (t, 0) for i, t in rows}, 2: ("x\ny", 1), 9: ("q", 1)}
    assert L.remove_repeated_runs(table(spark, mixed())).count() == len(mixed())


def test_equal_hashes_of_differing_bytes_are_left(spark, monkeypatch):
    # the 128 bits agree, the bytes don't: nothing of them goes, whatever repeats
    monkeypatch.setattr(L, "_body_hash", lambda body: 7 << 64 | 9)
    rows = [(1, "a\nb"), (2, "x\na\nb"), (3, "c\nd")]
    assert {r.doc_id: (r.text, r.chunks_removed) for r in L.remove_repeated_runs(table(spark, rows)).collect()} == {i: (t, 0) for i, t in rows}
