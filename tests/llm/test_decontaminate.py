import hashlib
import random
import re

import pytest

from symloom.llm.decontaminate import decontaminate, decontamination_report

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute_force(docs, items):
    windows = []
    for item, text in items:
        w = words(text)
        k = min(10, len(w))
        windows += [(str(item), w[i : i + k]) for i in range(len(w) - k + 1)] if w else []
    out = []
    for doc_id, text in docs:
        w = words(text)
        hit, found = set(), set()
        for item, win in windows:
            for i in range(len(w) - len(win) + 1):
                if w[i : i + len(win)] == win:
                    hit |= set(range(i, i + len(win)))
                    found.add(item)
        out.append((doc_id, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out)


def corpus(seed):
    r = random.Random(seed)
    vocabulary = ["aa", "bb", "cc", "é", "dd9", "Ee"]
    say = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    items = [(i, say(n)) for i, n in enumerate([25, 10, 11, 9, 4, 3, 14, 14, 30, 60])] + [(100, ""), (101, None), (7, say(12)), (55, "... !")]
    items.append((102, items[0][1][3:60]))
    docs = [(1, None), (2, ""), (3, "-- ??"), (4, "aa")]
    for i in range(5, 60):
        parts = [say(r.randrange(40)), "zz", say(r.randrange(20))]
        for _ in range(r.randrange(3)):
            w = (r.choice(items)[1] or "").split()
            at = r.randrange(len(w)) if w else 0
            parts.insert(r.randrange(3), ", ".join(w[at : at + r.randrange(5, 20)]).upper().replace("É", "é"))
        docs.append((i, "\n".join(parts)))
    return [*docs, docs[9]], items


@pytest.mark.parametrize(("seed", "bound"), [(1, 200_000), (2, 40)])
def test_matches_brute_force(spark, seed, bound):
    docs, items = corpus(seed)
    frame = spark.createDataFrame([(d, t, 5, "x") for d, t in docs], "doc_id long, text string, n_hit long, spans string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontamination_report(frame, bench, words_per_automaton=bound).drop("spans").collect()
    assert sorted(map(tuple, got)) == brute_force(docs, items)


@pytest.mark.parametrize("bound", [200_000, 10])
def test_spans_are_cut(spark, bound):
    item = "one two three four five six seven eight nine ten eleven"
    clean = "Nothing, here. " * 20
    rows = [(1, clean, None), (2, clean + "(One two THREE four five six seven eight nine ten!) tail é.", 9), (3, item, 9), (4, None, None), (5, "", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = {r.doc_id: (r.text, r.n_chars) for r in decontaminate(docs, bench, words_per_automaton=bound).collect()}
    left = clean + "(!) tail é."
    assert got == {1: (clean, None), 2: (left, len(left)), 4: (None, None), 5: ("", 0)}


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    bench = spark.createDataFrame([], "item_id long, text string")
    assert [tuple(r)[:4] for r in decontamination_report(docs, bench).collect()] == [(1, 2, 0, 0)]
    assert decontamination_report(docs.limit(0), bench).collect() == []
