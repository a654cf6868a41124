import hashlib
import re
import time

from symloom.llm.pii import KINDS, find_personal_data, sanitise

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

TEXTS = [
    None,
    "",
    "mail a.b+c@x-y.example.com, or é@q.de or x@y or a@b.c_d@e.f@g.h..i@j.k",
    "@x.y a@@b.c --@-.- end a@b.c.",
    "1.2.3.4 256.1.1.1 1.2.3.4.5.6.7.8 00000000000000255.0.0.1 1..2.3.4 12345678901234567890.1.1.1 9.9.9",
    "4111 1111 1111 1111 and 4111-1111-1111-1112 é 4111111111111111 4  111 5500-0000 0000-0004x378282246310005",
    "call +1 (988) 555-2485 or +49.30.1234567 or +1-2 or ++12345678901 or +1234567890123456 or +1 (2) 3 4 5 6 7 8 9 10",
    "+1 (988) 555-2485 4111 1111 1111 1111 x@y.zz",
    "1" * 30_000 + " " + "a" * 30_000 + " " + "9 " * 5000 + "." * 100 + "x@" * 500,
    "ünïcode 😀 first x@y.zz then 😀 1.2.3.4",
]


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def brute_force(text):
    text = text or ""
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    keep = {
        "email": (EMAIL, lambda m: True),
        "ip": (IP, lambda m: all(int(p) <= 255 for p in m.group().split("."))),
        "card": (CARD, lambda m: 13 <= len(digits(m)) <= 19 and luhn(digits(m))),
        "phone": (PHONE, lambda m: 9 <= len(digits(m)) <= 15),
    }
    return [(kind, m.start(), m.end()) for kind in KINDS[:4] for m in keep[kind][0].finditer(text) if keep[kind][1](m)]


def plain(spans):
    return [(s["kind"], s["start"], s["end"]) for s in spans]


def test_base_spans_match_brute_force(spark):
    docs = spark.createDataFrame([(i, t, "a", 1) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], None, 2), (None, "q@r.st", None, 0)], "doc_id long, text string, base string, row int")
    got = find_personal_data(docs).collect()
    assert len(got) == len(TEXTS) + 2
    for r in got:
        assert plain(r.base) == brute_force("q@r.st" if r.doc_id is None else TEXTS[r.doc_id]), r.doc_id


def revealing():
    rows = [(1, "Write to Zebulon at z@corp.example today"), (2, "Later Zebulon wrote from z@corp.example again"), (3, "Today the others wrote again")]
    return rows + [(i, "today again the others wrote to write from") for i in range(4, 40)]


def test_terms_that_reveal_an_entity(spark):
    docs = spark.createDataFrame([(*r, len(r[1])) for r in revealing()], "doc_id long, text string, n_chars long")
    got = {r.doc_id: plain(r.terms) for r in find_personal_data(docs).collect()}
    assert {k: v for k, v in got.items() if v} == {1: [("term", 9, 16)], 2: [("term", 6, 13)]}
    clean = {r.doc_id: (r.text, r.n_chars) for r in sanitise(docs).collect()}
    assert clean[1] == ("Write to <TERM> at <EMAIL> today", 32)
    assert clean[2][0] == "Later <TERM> wrote from <EMAIL> again"
    assert all(clean[d] == (t, len(t)) for d, t in revealing()[2:])


def test_copies_are_no_evidence(spark):
    docs = spark.createDataFrame([(i, "Zebulon is z@corp.example") for i in range(5)] + [(9, "else")], "doc_id long, text string")
    assert all(r.terms == [] for r in find_personal_data(docs).collect())


def test_overlapping_spans_become_one(spark):
    docs = spark.createDataFrame([(1, "+4222222222222 x@y.zz")], "doc_id long, text string")
    assert sanitise(docs).first().text == "<PHONE> <EMAIL>"


def test_terms_far_from_the_entity(spark):
    far = " ".join(["again"] * 100)
    rows = [(1, f"Dear Zebulon {far} z@corp.example"), (2, f"z@corp.example {far} from Zebulon to Zebulon"), (2, f"z@corp.example {far} from Zebulon to Zebulon")] + [(i, "again dear from to") for i in range(3, 40)]
    got = [(r.doc_id, plain(r.terms)) for r in find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    places = {1: [("term", 5, 12)], 2: [("term", m.start(), m.end()) for m in re.finditer("Zebulon", rows[1][1])]}
    assert sorted((d, t) for d, t in got if t) == [(1, places[1]), (2, places[2]), (2, places[2])]


def test_copies_do_not_weaken_evidence(spark):
    rows = [(i, f"{'Write' if i % 2 else 'Send'} to Zebulon at z@corp.example") for i in range(60)] + [(100 + i, "to write at send") for i in range(200)]
    got = find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all([x.value for x in r.terms] == (["zebulon"] if r.doc_id < 60 else []) for r in got)


def test_very_long_texts_take_linear_time(spark):
    numbers = " ".join(str(10**15 + 7919 * i) if i % 2 else f"word{'abcdefgh'[i % 8]}" for i in range(200_000))
    docs = spark.createDataFrame([(1, numbers), (2, "é" + numbers[:2000] + " x@y.zz")], "doc_id long, text string")
    began = time.time()
    got = {r.doc_id: plain(r.base) for r in find_personal_data(docs).collect()}
    assert got[1] == brute_force(numbers) and got[2] == brute_force("é" + numbers[:2000] + " x@y.zz")
    assert len(got[1]) > 5000 and sum(r.text.count("<CARD>") for r in sanitise(docs).collect()) > 5000
    assert time.time() - began < 120


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert find_personal_data(docs).collect() == [] == sanitise(docs).collect()


def test_query_digests(spark, tmp_path):
    from symloom.llm.pii import op9_pii

    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for r in op9_pii(spark, str(tmp_path)).collect():
        base = brute_force(TEXTS[r.doc_id])
        text = ",".join(f"{k}:{s}:{e}" for k, s, e in base)
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert r.spans.split(",term")[0] == text
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x[0] for x in base) for k in KINDS[:4]]


def test_sanitising_counts_copies_in_one_unit(spark):
    rows = [(i, f"{'Write' if i % 2 else 'Send'} to Zebulon at z@corp.example") for i in range(20)] + [(100 + i, "to write at send") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert all("Zebulon" not in r.text for r in sanitise(docs).collect() if r.doc_id < 20)
    same = " ".join(["pad"] * 40)
    rows = [(i, f"number{i} {same} Zebulon z@corp.example {same}") for i in range(20)] + [(100 + i, "pad") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert all("Zebulon" not in r.text for r in sanitise(docs).collect() if r.doc_id < 20), "one context in many texts"


def test_sanitising_reaches_the_whole_text(spark):
    far = " ".join(["again"] * 60)
    rows = [(1, f"Dear Zebulon {far} z@corp.example"), (2, f"z@corp.example {far} from Zebulon to Zebulon")] + [(i, "again dear from to") for i in range(3, 40)]
    clean = {r.doc_id: r.text for r in sanitise(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert clean[1] == f"Dear <TERM> {far} <EMAIL>" and clean[2] == f"<EMAIL> {far} from <TERM> to <TERM>"
