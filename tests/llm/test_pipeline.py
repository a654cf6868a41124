import random

import corpus_pipeline
from symloom.llm.common import materialize, written
from symloom.llm.simhash import simhash64

ITEM = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron"


def corpus():
    r = random.Random(5)
    word = lambda: "".join(r.choice(["the", "ing", "wh", "ou", "ed", "st"]) for _ in range(r.randrange(1, 4)))
    rows, labels = [], []
    for i in range(300):
        words = [word() for _ in range(r.randrange(60, 120))]
        if i % 6 == 0:
            for _ in range(4):
                words.insert(r.randrange(len(words)), r.choice(["zlorp", "grunkle"]))
        rows.append([i, " ".join(words)])
        labels.append((i, 1, int(i % 6 == 0)))
    rows[11][1] = rows[1][1]  # an exact copy
    near = rows[2][1].split()
    rows[13][1] = " ".join([*near, "tail"])  # perhaps a near copy: the fingerprints decide
    rows[15][1] += " " + ITEM
    rows[17][1] = ITEM
    rows[19][1] = "write to someone@mail.example.com " + rows[19][1]
    rows[21][1] = ""
    rows[23][1] = None
    return [tuple(x) for x in rows], labels


def test_stages_take_effect(spark, tmp_path):
    rows, labels = corpus()
    full = [(i, t, "en", "src", len(t or "")) for i, t in rows]
    spark.createDataFrame([*full, full[25]], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, kept = docs.columns, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        if k < 4:
            assert docs.columns == columns
            kept.append({r.doc_id: r.text for r in docs.collect()})
    texts = dict(rows)
    assert set(kept[0]) == {i for i in texts if i % 6}
    fingerprints = {i: simhash64(texts[i]) for i in kept[0]}
    group = {i: i for i in fingerprints}
    for _ in range(3):
        for i in group:
            for j in group:
                if (fingerprints[i] ^ fingerprints[j]).bit_count() <= 4:
                    group[i] = group[j] = min(group[i], group[j])
    assert set(kept[1]) == set(group.values()) and 11 not in kept[1] and 23 not in kept[1] and 21 in kept[1]
    assert set(kept[1]) - set(kept[2]) == {17}
    assert "omicron" not in kept[2][15] and kept[2][15].startswith(texts[15][:50])
    assert set(kept[3]) == set(kept[2]) and "<EMAIL>" in kept[3][19]
    changed = {15, 19}
    assert all(kept[3][i] == texts[i] for i in kept[3] if i not in changed)
    packed = docs.collect()
    assert {r.doc_id for r in packed} == set(kept[3])
    before = len(written())
    assert sorted(map(tuple, packed)) == sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect()))
    assert len(written()) == before + 1, "only the result is left"


CLASHES = ["fp", "n", "base", "row", "score", "counts", "label", "place", "bits", "component_id", "terms", "items"]


def odd_tables(spark, folder, rows):
    extra = ", ".join(f"{c} string" for c in CLASHES)
    spark.createDataFrame([(*r, *CLASHES) for r in rows], f"doc_id long, text string, lang string, source string, n_chars long, {extra}").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


def test_stages_on_empty_tables(spark, tmp_path):
    odd_tables(spark, tmp_path, [])
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_stages_on_nulls_repeats_and_clashing_names(spark, tmp_path):
    rows = [(1, "alpha beta gamma delta x@y.example.org", None, None, None), (None, None, None, None, None), (None, "no id", "en", "s", 5), (2, None, None, "s", None), (3, "", "en", None, 0), (4, "alpha " * 40_000, "en", "s", 9)]
    odd_tables(spark, tmp_path, [*rows, rows[0], rows[2]])
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = materialize(stage(spark, docs, str(tmp_path)), name)
        assert docs.columns == columns
        assert all(r[c] == c for r in docs.collect() for c in CLASHES)
    got = sorted(((r.doc_id, r.text and r.text[:40]) for r in docs.collect()), key=str)
    # Null and empty texts are one group, of which the smallest id stays; rows without an id all stay.
    want = [(1, "alpha beta gamma delta <EMAIL>"), (2, None), (4, ("alpha " * 40)[:40]), (None, None), (None, "no id"), (None, "no id")]
    assert got == sorted(want, key=str)
