"""Language, toxicity, quality and licences on small planted corpora."""

import math
import random
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pytest

from symloom.llm import toxicity
from symloom.llm.common import crc_bucket, labelled_sample, logistic
from symloom.llm.langid import fit_languages, identify_languages
from symloom.llm.licenses import fit_licences, scan_licences
from symloom.llm.quality import fit_quality, indicators, score_quality
from symloom.llm.toxicity import NEIGHBOURS, BlockMaxIndex, bag_of, fit_toxicity, score_toxicity, toxicity_evidence

SYLLABLES = {"aa": ["the", "ing", "wh", "ou", "ed"], "bb": ["sch", "ung", "ein", "ö", "kei"], "cc": ["eau", "é", "oi", "qu", "ç"]}


def say(r, lang, n):
    return " ".join("".join(r.choice(SYLLABLES[lang]) for _ in range(r.randrange(1, 4))) for _ in range(n))


def test_languages(spark):
    r = random.Random(1)
    rows = [(i, say(r, lang := r.choice("abc") * 2, r.randrange(5, 60)), lang, "x") for i in range(400)]
    rows += [(900, None, "aa", ""), (901, "", "bb", ""), (902, "12 -- !", "cc", ""), (903, rows[0][1], None, ""), (904, "字" * 50_000, None, ""), (None, rows[1][1], rows[1][2], "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string")
    model = fit_languages(docs.filter(crc_bucket("doc_id", 4) != 2), sample_per_language=60)
    got = identify_languages(docs, model).collect()
    assert len(got) == len(rows)
    found = {x.doc_id: x for x in got}
    assert [found[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3 and found[900].score == 0
    assert found[903].lang_pred == rows[0][2] and found[904].rejected
    assert all(0 <= x.score <= 1 for x in got)
    assert sum(found[i].lang_pred == lang for i, _, lang, _ in rows[:400]) >= 396


def test_languages_without_rows(spark):
    docs = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert identify_languages(docs, fit_languages(docs)).first().lang_pred == "und"
    assert identify_languages(docs.limit(0), fit_languages(docs.limit(0))).collect() == []


def toxic_corpus():
    r = random.Random(2)
    rows, labels = [], []
    for i in range(600):
        words = say(r, "aa", r.randrange(20, 60)).split()
        toxic = i % 5 == 0
        if toxic:
            for _ in range(r.randrange(2, 5)):
                words.insert(r.randrange(len(words)), r.choice(["zlorp", "Grunkle,", "vexq" + r.choice(["an", "ol", "ur"])]))
        rows.append((i, " ".join(words), "x", 3))
        labels.append((i, 1, int(toxic)))
    rows += [(1000, None, "", 0), (1001, "", "", 0), (1002, "zlorp " * 30_000, "", 0), rows[7]]
    return rows, labels + [(1, 1, None), (None, 1, 1), (5, 1, 1), (7777, 0, 1)]


def test_toxicity(spark):
    rows, labels = toxic_corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, label string, score int").drop("score")
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = fit_toxicity(docs, known.filter(crc_bucket("doc_id", 5) != 0))
    got = score_toxicity(docs, model).select("doc_id", (crc_bucket("doc_id", 5) == 0).alias("held"), "score").collect()
    assert len(got) == len(rows) and all(0 <= x.score <= 1 for x in got)
    held = [x for x in got if x.held and x.doc_id < 600]
    assert len(held) > 80 and all((x.score >= 0.5) == (x.doc_id % 5 == 0) for x in held)
    by_id = {x.doc_id: x.score for x in got}
    assert by_id[1000] == by_id[1001] < 0.5 < by_id[1002]


def test_toxicity_neighbours_equal_dense_cosines(spark):
    """Every word of every example, IDF over all rows, z of every word: neighbours, cosines and scores by dense arithmetic."""
    rows, labels = toxic_corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, label string, score int").drop("score")
    known = [(d, t) for d, _, t in labels if d is not None and t is not None and crc32(str(d).encode()) % 5]
    model = fit_toxicity(docs, spark.createDataFrame(known, "doc_id long, toxic int"))
    texts = {d: t or "" for d, t, _, _ in rows}
    examples = {d: max(t for e, t in known if e == d) for d, _ in known if d in texts}
    words = lambda text: re.findall(r"[^\W\d_]+", text.lower())
    ids = sorted(d for d in examples if words(texts[d]))
    vocabulary = sorted({w for d in ids for w in words(texts[d])})
    assert set(vocabulary) == set(model.vocabulary)
    df = Counter(w for _, t, _, _ in rows for w in set(words(t or "")))
    sizes = [sum(v == c for v in examples.values()) for c in (0, 1)]
    share = [Counter(w for d in ids if examples[d] == c for w in set(words(texts[d]))) for c in (0, 1)]

    def weight(w):
        p, q = share[1][w] / sizes[1], share[0][w] / sizes[0]
        pooled = (share[0][w] + share[1][w]) / sum(sizes)
        return (math.log((1 + len(rows)) / (1 + df[w])) + 1) * abs(p - q) / math.sqrt(pooled * (1 - pooled) * (1 / sizes[0] + 1 / sizes[1]) + 1e-12)

    weights = np.array([weight(w) for w in vocabulary])

    def vector(text):
        bag = Counter(words(text))
        v = np.array([1 + math.log(bag[w]) if w in bag else 0.0 for w in vocabulary]) * weights
        return v / max(np.linalg.norm(v), 1e-300)

    dense = np.array([vector(texts[d]) for d in ids])
    found = {x.doc_id: x for x in toxicity_evidence(docs.select("doc_id", "text"), model).collect()}
    for d, text in texts.items():
        cosine = np.round(dense @ vector(text), 9)
        near = [i for i in np.lexsort((np.arange(len(ids)), -cosine))[:NEIGHBOURS] if cosine[i] > 0]
        assert found[d].evidence_ids == ",".join(str(ids[i]) for i in near)
        if not near:
            assert found[d].score == model.blank
            continue
        votes = cosine[near] ** 2 * model.vote[[examples[ids[i]] for i in near]]
        of_1 = votes[[examples[ids[i]] == 1 for i in near]].sum() / votes.sum()
        assert found[d].score == pytest.approx(logistic(float(model.curve @ (of_1, cosine[near[0]] * (2 * of_1 - 1), 1.0))), abs=1e-6)


def test_toxicity_with_one_class_and_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a b", 1), (2, "c d", 2), (2, "c d", 2), (None, "a", 3)], "doc_id long, text string, label int")
    model = fit_toxicity(docs, spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, toxic int"))
    got = score_toxicity(docs, model)
    assert got.columns == ["doc_id", "text", "label", "score"] and all(0 <= x.score <= 1 for x in got.collect())


def test_labelled_sample_is_bounded_in_characters(spark):
    docs = spark.createDataFrame([(i, "x" * (i + 1)) for i in range(40)] + [(99, "y" * 1000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(99, 1)], "doc_id long, toxic int")
    sample, totals = labelled_sample(docs, labels, "toxic", 30, 800)
    got = sample.collect()
    assert totals == {0: 20, 1: 21} and sum(len(x.text) for x in got if x.label == 1) <= 400 and 99 not in {x.doc_id for x in got}
    assert all(x.text == "x" * (x.doc_id + 1) for x in got) and {x.label for x in got} == {0, 1}


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [x.score for x in score_toxicity(docs, fit_toxicity(docs, none)).collect()] == [0.25, 0.25]
    assert score_toxicity(docs.limit(0), fit_toxicity(docs.limit(0), none)).collect() == []


class Asked(dict):
    """A vocabulary that counts how often it is asked."""

    asked = 0

    def get(self, *given):
        self.asked += 1
        return super().get(*given)


@pytest.mark.parametrize("at_once", [1, 3, 100_000])
def test_term_counts_ask_the_vocabulary_once_for_each_word(monkeypatch, at_once):
    monkeypatch.setattr(toxicity, "WORDS_AT_ONCE", at_once)
    monkeypatch.setattr(toxicity, "_TEXT_BLOCK", 16)
    texts = ["", "Alpha beta, ALPHA 7", "x1 y2 gamma_beta", "Äpfel beta İ½ ²zwei \u2168 ١alpha١"] * 5 + ["alpha Beta " * 9, "none"]
    vocabulary = Asked({w: i for i, w in enumerate(["alpha", "beta", "gamma", "äpfel", "y", "zwei"])})
    bags = [{vocabulary[w]: n for w, n in Counter(re.findall(r"[^\W\d_]+", t.lower())).items() if w in vocabulary} for t in texts]
    whose, terms, counts = toxicity.term_counts(texts, vocabulary)
    assert list(zip(whose.tolist(), terms.tolist(), counts.tolist(), strict=True)) == [(i, t, bag[t]) for i, bag in enumerate(bags) for t in sorted(bag)]
    if at_once > 1000:
        assert vocabulary.asked == len({w for t in texts for w in re.findall(r"[^\W\d_]+", t.lower())})


def test_words_are_those_of_the_pattern():
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for text in ("".join(every), " ".join(every), "a".join(every), "".join(every[:128]), "_1".join(every[:128])):
        assert [w for part in toxicity.words_of(text) for w in part] == [w for block in parts_of(text) for w in re.findall(r"[^\W\d_]+", block.lower())]


def parts_of(text):
    at = 0
    while at < len(text):
        cut = text.find(" ", at + toxicity._TEXT_BLOCK)
        cut = len(text) if cut < 0 else cut
        yield text[at:cut]
        at = cut


@pytest.mark.parametrize("spread", [1, 40])
def test_block_max_index_leaves_out_blocks_and_no_neighbour(spread):
    """Groups of examples with words of their own: only a query's own blocks count, unless its words are spread over all."""
    r = np.random.default_rng(spread)
    vectors = []
    for i in range(4000):
        group = i * 40 // 4000
        terms = np.unique(np.r_[(r.integers(0, spread) + group) % 40, 40 + group * 50 + r.integers(0, 50, 12)])
        values = r.random(len(terms))
        vectors.append((terms, values / np.linalg.norm(values)))
    dense = np.zeros((4000, 2040))
    for i, (terms, values) in enumerate(vectors):
        dense[i, terms] = values
    index = BlockMaxIndex(vectors, 2040, dense=40)
    queries = list(range(0, 4000, 97))
    for q, (near, cosine) in zip(queries, index.nearest([vectors[i] for i in queries], 20, queries), strict=True):
        exact = np.round(dense @ dense[q], 9)
        exact[q] = 0
        best = [i for i in np.lexsort((np.arange(4000), -exact))[:20] if exact[i] > 0]
        assert near.tolist() == best and cosine == pytest.approx(exact[best], abs=2e-9)


@pytest.mark.parametrize(("seed", "dense"), [(0, 0), (1, 5), (2, 512)])
def test_block_max_index_is_exact(seed, dense):
    r = np.random.default_rng(seed)
    vectors = []
    for _ in range(700):
        terms = np.sort(r.choice(90, r.integers(1, 8), replace=False))
        values = r.choice([0.5, 1.0, 2.0, 3.0], len(terms))
        vectors.append((terms, values / np.linalg.norm(values)))
    index = BlockMaxIndex(vectors, 90, dense=dense)
    dense = np.zeros((700, 90))
    for i, (terms, values) in enumerate(vectors):
        dense[i, terms] = values
    asked = list(range(0, 700, 35))
    for q, (near, score) in zip(asked, index.nearest([vectors[q] for q in asked], 20, asked), strict=True):
        cosine = np.round(dense @ dense[q], 9)
        cosine[q] = -1
        want = [i for i in np.lexsort((np.arange(700), -cosine))[:20] if cosine[i] > 0]
        assert near.tolist() == want
        assert np.allclose(score, cosine[want], atol=1e-8)


def test_words_of_long_texts_stay_whole():
    assert bag_of("An IDIOT, idiots. x1y " * 100_000) == Counter({"an": 100_000, "idiot": 100_000, "idiots": 100_000, "x": 100_000, "y": 100_000})


def test_quality(spark):
    r = random.Random(3)
    rows, labels = [], []
    for i in range(500):
        text = say(r, "aa", r.randrange(20, 80))
        bad = i % 4 == 0
        if bad:
            text = r.choice((text.upper() + "!!", " | ".join(text.split()), " ".join(w for w in text.split()[:8] for _ in range(9))))
        rows.append((i, text, 1))
        labels.append((i, int(not bad)))
    rows += [(900, None, 1), (901, "", 1), (902, "ab " * 400_000, 1), rows[3]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, at int")
    model = fit_quality(docs, spark.createDataFrame(labels, "doc_id long, quality int").filter(crc_bucket("doc_id", 5) != 0))
    got = score_quality(docs, model).select("doc_id", (crc_bucket("doc_id", 5) == 0).alias("held"), "score").collect()
    assert len(got) == len(rows) and all(0 <= x.score <= 1 for x in got)
    held = [x for x in got if x.held and x.doc_id < 500]
    assert sum((x.score >= 0.3) == (x.doc_id % 4 != 0) for x in held) >= 0.97 * len(held)


def test_quality_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [x.score for x in score_quality(docs, fit_quality(docs, none)).collect()] == [0.5, 0.5]
    assert score_quality(docs.limit(0), fit_quality(docs.limit(0), none)).collect() == []


def test_indicators_see_repeats_across_blocks():
    assert indicators("x y z").tolist() != indicators("x x x").tolist()
    assert len(indicators("")) > 0


def test_logistic_is_stable():
    assert logistic(1e9) <= 1 and logistic(-1e9) >= 0 and math.isclose(logistic(0), 0.5)


def test_licences(spark):
    lines = {
        1: "Some text.\nLicensed under the Apache License, Version 2.0.\nmore",
        2: "This work is licensed under the GNU General Public License, version 3.",
        3: "Released under the MIT License.\nLicensed under CC BY-NC 4.0.",
        4: "She lost her driver's license on the way to the general public office.",
        5: "",
        6: None,
        7: "license " * 50_000,
    }
    rows = [*lines.items(), (2, lines[2])]
    docs = spark.createDataFrame([(d, t, "clash", 1) for d, t in rows], "doc_id long, text string, families string, row int")
    got = sorted((x.doc_id, x.n_notices, x.families) for x in scan_licences(docs).collect())
    assert got == [(1, 1, "apache-2.0"), (2, 1, "gpl"), (2, 1, "gpl"), (3, 2, "cc-by-nc,mit"), (4, 0, ""), (5, 0, ""), (6, 0, ""), (7, 0, "")]
    assert scan_licences(docs.limit(0)).collect() == []


def test_licence_scores_match_the_model(spark):
    from symloom.llm.licenses import classify_paragraphs

    docs = spark.createDataFrame([(1, "Released under the MIT License.")], "doc_id long, text string")
    row = classify_paragraphs(docs).first()
    assert row.probability == pytest.approx(fit_licences().probabilities("Released under the MIT License.")["mit"], rel=1e-9)


def test_wrapped_licence_notices(spark):
    header = "/* This program is free software: you can redistribute it and/or modify\n * it under the terms of the GNU General Public License as published by\n * the Free Software Foundation, either version 3 of the License, or\n * (at your option) any later version.\n */"
    texts = {1: header, 2: "words before\n\n" + header + "\n\nReleased under the MIT License.\n", 3: "This software is in the public\ndomain of wishes\n\nand she renewed\nher license"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = sorted((x.doc_id, x.n_notices, x.families) for x in scan_licences(docs).collect())
    assert got == [(1, 1, "gpl"), (2, 2, "gpl,mit"), (3, 0, "")]


def test_every_paragraph_goes_by_classifier_and_notices(spark):
    """Without any order of the two conditions: the model's likeliest family of every line and block, confirmed word by word."""
    from symloom.llm.licenses import NOTICES, OVERLAP, THRESHOLD, UNKNOWN, _words, training_set

    r = random.Random(9)
    variants = [" ".join(words) for words in training_set(3)[0]]
    r.shuffle(variants)
    texts = ["\n\n".join("\n".join(variants[k : k + r.randrange(1, 4)]) for k in range(i, i + 12, 4)) for i in range(0, 240, 12)]
    docs = spark.createDataFrame([*enumerate(texts), (3, texts[3]), (99, "\n \n" * 20_000)], "doc_id long, text string")
    model = fit_licences()

    def shown(unit):
        p = model.probabilities(unit)
        best = max(p, key=p.get)
        own = set(_words(unit))
        fits = any(len(own & set(_words(n))) >= OVERLAP * len(set(_words(n))) for n in NOTICES.get(best, []))
        return best if best != UNKNOWN and p[best] >= THRESHOLD and fits else None

    want = {99: 0}
    for d, text in enumerate(texts):
        want[d] = 0
        for block in text.split("\n\n"):
            found = [f for line in block.split("\n") if (f := shown(line))]
            whole = shown(block.replace("\n", " ")) if "\n" in block else None
            want[d] += len(found) + (whole is not None and whole not in found)
    got = [(x.doc_id, x.n_notices) for x in scan_licences(docs).collect()]
    assert sorted(got) == sorted([*want.items(), (3, want[3])]) and sum(want.values()) > 20
