import random
from collections import Counter

import corpus_pipeline as C
from pyspark.sql import functions as F
from cases import mixed, table, words

FORM = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def test_stages_and_run(spark, tmp_path):
    rng = random.Random(8)
    docs = {i: "\n".join(" ".join(words(rng, 12)) for _ in range(10)) for i in range(60)}
    boiler = "\n".join(f"footer {i} of every page" for i in range(12))
    items = [(i, " ".join(words(rng, 25))) for i in range(3)]
    docs[10] += "\n" + boiler
    docs[11] += "\n" + boiler
    docs[12] += "\n" + items[0][1]
    docs[70] = docs[5].replace(docs[5].split()[3], "changed", 1).replace("\n", " ")
    docs[71] = docs[6]
    docs[72] = "12345 ... !!!"
    rows = [(i, t, "en", "s", len(t)) for i, t in docs.items()] + [(73, None, "en", "s", 0), (74, "", "en", "s", 0)]
    spark.createDataFrame(rows, FORM).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    seen, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in C.STAGES[:-1]:
        out = stage(spark, seen, str(tmp_path))
        assert out.columns == seen.columns, name
        out.write.parquet(str(tmp_path / name))
        seen = spark.read.parquet(str(tmp_path / name))
        kept[name] = {r.doc_id: r.text for r in seen.collect()}
    everyone = set(range(60)) | {70, 71}
    assert set(kept["language_id"]) == everyone
    # of a copy only single lines are left, for chunks of one line are never cut
    assert set(kept["line_dedup"]) >= everyone - {71} and len(kept["line_dedup"].get(71, "")) < len(docs[71]) / 2 and boiler in kept["line_dedup"][10] and len(kept["line_dedup"][11]) < len(docs[11])
    assert set(kept["near_dedup"]) - {71} == everyone - {70, 71}
    assert set(kept["decontamination"]) - {71} == everyone - {70, 71, 12}
    packed = C.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} == set(kept["decontamination"])
    assert sum(r.length for r in packed) == sum(len(t.split()) for t in kept["decontamination"].values())


def stages(spark, docs, items, folder):
    """Every stage on what the one before it kept, as run() has it: the rows after each."""
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    seen, out = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in C.STAGES:
        now = stage(spark, seen, str(folder))
        if name != "packing":
            assert now.schema.simpleString() == seen.schema.simpleString(), name
        now.write.parquet(f"{folder}/{name}")
        seen = spark.read.parquet(f"{folder}/{name}")
        out[name] = seen.collect()
    return out


def test_difficult_rows_and_clashing_columns(spark, tmp_path):
    rows = mixed()
    docs = table(spark, rows).withColumns({"accepted": F.lit("kept"), "a.b": F.lit(1)})
    out = stages(spark, docs, [(0, None), (1, ""), (None, "w1 w2")], tmp_path)
    for name in list(out)[:-1]:
        for r in out[name]:
            assert r["chunks_removed"] == r["PRED_LANG"] == "x" and r["accepted"] == "kept" and r["a.b"] == 1, name
    first = Counter(r.doc_id for r in out["language_id"])
    # NULL, empty and letterless texts go, the very long one and both of the repeated rows stay
    assert not {100, 101, 102, 104} & set(first) and first[105] == 1 and first[106] == 2
    assert {r.doc_id: r.text for r in out["language_id"]}[105] == dict(rows[:-1])[105]
    assert Counter(r.doc_id for r in out["packing"] if r.length)[105] == -(-30_000 // 2048)


def test_empty_tables(spark, tmp_path):
    assert all(not rows for rows in stages(spark, table(spark, []), [], tmp_path).values())
