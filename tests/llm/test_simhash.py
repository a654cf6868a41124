import random

import pytest
import xxhash

from symloom.llm import simhash
from symloom.llm.common import scratch, written
from symloom.llm.simhash import near_duplicates, representatives, simhash64

SCHEMA = "doc_id long, text string, fp string, component_id string"


def plain_simhash(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words, word = [], ""
    for c in low + " ":
        if c in " \t\n\x0b\x0c\r":
            words += [word] if word else []
            word = ""
        else:
            word += c
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_force(rows):
    prints = [plain_simhash(t) for _, t in rows]
    group = list(range(len(rows)))

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                group[find(i)] = find(j)
    roots = {}
    for i, (doc_id, _) in enumerate(rows):
        roots.setdefault(find(i), []).append(doc_id)
    return sorted((d, f"{prints[i]:016x}", min(roots[find(i)])) for i, (d, _) in enumerate(rows))


def corpus(seed, n=150):
    r = random.Random(seed)
    words = ["Alpha", "beta", "çedille", "ÉTÉ", "gamma x", "delta", "eps", "zeta,", "eta.", "Theta"]
    texts = [None, "", " \n\t ", "one", "one  two\x0bthree", "ONE TWO THREE FOUR", "one two\tthree four"]
    for _ in range(12):
        base = [r.choice(words) + str(r.randrange(50)) for _ in range(r.randrange(3, 400))]
        for _ in range(n // 12):
            copy = list(base)
            for _ in range(r.randrange(4)):
                copy[r.randrange(len(copy))] = "changed%d" % r.randrange(99)
            texts.append(r.choice((" ", "  ", "\n")).join(copy))
    rows = list(enumerate(texts, 10))
    return [*rows, rows[8], rows[3]]


def result(spark, rows, **options):
    docs = spark.createDataFrame([(d, t, "x", "y") for d, t in rows], SCHEMA)
    got = near_duplicates(docs, **options).collect()
    return sorted((x.doc_id, x.fingerprint, x.component_id) for x in got)


@pytest.mark.parametrize(("seed", "pair_limit"), [(1, 64), (2, 2)])
def test_components_match_brute_force(spark, seed, pair_limit):
    rows = corpus(seed)
    assert result(spark, rows, pair_limit=pair_limit) == brute_force(rows)


def test_long_text_and_chunks():
    text = " ".join(f"w{i % 977}x{i % 131}" for i in range(70_000))
    assert simhash64(text) == plain_simhash(text)


def test_empty_table(spark):
    assert result(spark, []) == []


@pytest.mark.parametrize("bits", [1 << 15, 1 << 27])
def test_representatives(spark, monkeypatch, bits):
    monkeypatch.setattr(simhash, "MARK_BITS", bits)
    rows = [(i, t) for i, t in corpus(3)]
    rows += [(rows[20][0], rows[20][1]), (10, "zz last"), (5000, rows[30][1]), (5000, "aa of its own"), (None, rows[30][1]), (None, None)]
    want = sorted({d for d, _, root in brute_force([r for r in rows if r[0] is not None]) if d == root})
    assert 5000 in want
    docs = spark.createDataFrame([(d, t, d) for d, t in rows], "doc_id long, text string, fp long")
    got = representatives(docs).collect()
    assert sorted(r.doc_id for r in got if r.doc_id is not None) == want
    assert sum(r.doc_id is None for r in got) == 2 and all(r.fp == r.doc_id for r in got)
    assert {(r.doc_id, r.text) for r in got} <= set(rows) and (5000, "aa of its own") in {(r.doc_id, r.text) for r in got}


def test_stage_reaches_five_word_similarity(spark):
    import corpus_pipeline
    from symloom.llm.simhash import RADIUS, near_duplicates

    def shingles(text):
        words = text.split()
        return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}

    r = random.Random(11)
    rows = [(i, " ".join(f"w{r.randrange(5000)}" for _ in range(r.randrange(40, 80)))) for i in range(60)]
    for i in range(60):
        words = rows[i][1].split()
        for _ in range(i % 4):
            words[r.randrange(len(words))] = "other"
        rows.append((100 + i, " ".join(words) + (" tail" if i % 2 else "")))
    near = {i: i for i, _ in rows}
    alike = lambda a, b: (simhash64(a) ^ simhash64(b)).bit_count() <= RADIUS or len(shingles(a) & shingles(b)) >= 0.8 * len(shingles(a) | shingles(b))
    for i in range(60):
        if alike(rows[i][1], rows[60 + i][1]):
            near[100 + i] = i
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {x.doc_id for x in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()}
    assert kept == set(near.values())
    assert len({x.component_id for x in near_duplicates(docs).collect()}) > len(kept), "the fingerprints alone miss some"


def test_shingle_links_lose_nothing_at_any_size(spark):
    r = random.Random(5)
    texts = ["", "a", "a b", "a b c d e"]
    for size in (1, 2, 6, 7, 9, 14, 15, 40, 68, 69, 132, 400):
        base = [f"s{size}w{r.randrange(10**6)}" for _ in range(size + 4)]
        texts.append(" ".join(base))
        for share in (0.02, 0.08, 0.11, 0.13, 0.2, 0.25):
            cut = max(1, round(size * share))
            texts += [" ".join(base[cut:]), " ".join([*base, *(f"t{r.randrange(10**6)}" for _ in range(cut))])]
    texts = list(dict.fromkeys(texts))
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := t.split()) else set() for t in texts]
    near = lambda i, j: (simhash64(texts[i]) ^ simhash64(texts[j])).bit_count() <= simhash.RADIUS or 9 * len(sets[i] & sets[j]) >= 4 * (len(sets[i]) + len(sets[j])) > 0
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if root[i] != root[j] and near(i, j):
                low, high = sorted((root[i], root[j]))
                root = [low if x == high else x for x in root]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: x.component_id for x in near_duplicates(docs, shingles=True).collect()}
    assert got == dict(enumerate(root))
    assert 12 < len(set(root)) < len(texts)


@pytest.mark.parametrize("lead", [0, 5, 32])
def test_pairs_of_short_texts_meet_once_and_none_is_lost(spark, monkeypatch, lead):
    r = random.Random(7)
    texts = []
    for size in (30, 90, 90, 200, 350):
        base = [f"s{size}w{r.randrange(10**6)}" for _ in range(size)]
        for _ in range(9):
            words = list(base)
            for _ in range(r.randrange(1, 2 + size // 40)):
                words[r.randrange(size)] = f"x{r.randrange(10**6)}"
            texts.append(" ".join(words[: size - r.randrange(1 + size // 12)]))
    texts = list(dict.fromkeys(texts))
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, texts)]
    prints = [simhash64(t) - (1 << 64 if simhash64(t) >> 63 else 0) for t in texts]
    want = {tuple(sorted((prints[i], prints[j]))) for i in range(len(texts)) for j in range(i) if prints[i] != prints[j] and 9 * len(sets[i] & sets[j]) >= 4 * (len(sets[i]) + len(sets[j]))}
    monkeypatch.setattr(simhash, "LEAD", lead)
    met, candidates = [], simhash._candidates
    monkeypatch.setattr(simhash, "_candidates", lambda t, pairs, least: met.append(pairs.filter("x.size < 280 and y.size < 280").selectExpr("x.key", "y.key AS other").collect()) or candidates(t, pairs, least))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows, members = simhash.shingle_members(docs)
    got = {tuple(x) for x in simhash.alike(docs, simhash.shingle_rest(rows, members, spark.createDataFrame([], "node long, root long"))).collect()}
    assert got == want and 20 < len(want)
    assert (len(set(met[0])) == len(met[0]) > 20) == (lead == 32)


def test_pairs_of_long_texts_give_few_rows_and_none_is_lost(spark, monkeypatch):
    r = random.Random(3)
    texts = []
    for size in (350, 700, 1500):
        base = [f"s{size}w{r.randrange(10**6)}" for _ in range(size)]
        for k in range(8):
            words = list(base)
            for _ in range(r.randrange(1, 2 + size // 60)):
                words[r.randrange(size)] = f"x{r.randrange(10**6)}"
            texts.append(" ".join(words[: size - r.randrange(1 + size // 12)]))
        texts += [" ".join([*base[: size // 3], *(f"y{r.randrange(10**6)}" for _ in range(size // 2))]) for _ in range(4)]
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, texts)]
    prints = [simhash64(t) - (1 << 64 if simhash64(t) >> 63 else 0) for t in texts]
    want = {tuple(sorted((prints[i], prints[j]))) for i in range(len(texts)) for j in range(i) if prints[i] != prints[j] and 9 * len(sets[i] & sets[j]) >= 4 * (len(sets[i]) + len(sets[j]))}
    met, candidates = [], simhash._candidates
    monkeypatch.setattr(simhash, "_candidates", lambda t, pairs, least: met.append(pairs.selectExpr("x.key", "y.key AS other").collect()) or candidates(t, pairs, least))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows, members = simhash.shingle_members(docs)
    got = {tuple(x) for x in simhash.alike(docs, simhash.shingle_rest(rows, members, spark.createDataFrame([], "node long, root long"))).collect()}
    assert got == want and 20 < len(want)
    assert len(met[0]) < 2 * len(set(met[0]))


def test_the_stage_keeps_few_tables_and_shuffles_its_rows_once(spark, monkeypatch):
    plans, candidates = [], simhash._candidates

    def seen(texts, pairs, least):
        pairs.collect()
        plans.append(pairs._jdf.queryExecution().executedPlan().toString())
        return candidates(texts, pairs, least)

    monkeypatch.setattr(simhash, "_candidates", seen)
    docs = spark.createDataFrame(corpus(4), "doc_id long, text string")
    with scratch(spark):
        near_duplicates(docs, shingles=True)
        assert [p.split("symloom-")[-1].split("-")[0] for p in written()] == ["fingerprints", "distinct", "groups"]
    rest = plans[-1].split("== Initial Plan ==")[0]
    assert "SortMergeJoin" in rest and "ReusedExchange" in rest
