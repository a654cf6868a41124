import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from symloom.llm.packing import best_two_fit, pack_documents

TEXTS = [
    None,
    "",
    "  \n\t\r ",
    "Hello, World. It's the 2nd test... don't!!\nNew line\x1cunit sep É é ́x  İI.",
    "a <|endoftext|> b<|STARTOFTEXT|> <|startoftext|>. ..,, x., y.\x85z",
    "word " * 5000,
    "thblee " * 2047,
    "thblee " * 2048 + "END.",
    "x" * 300 + ".",
    *["Same text, twice."] * 2,
    *[" ".join(f"tok{i * j % 97}" for i in range(j)) for j in range(1, 120)],
]


def test_pieces_and_sequences(spark):
    rows = [(i, t, -1, "clash") for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], -1, "again"), (None, "no id", 0, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, piece int, offset string")
    got = pack_documents(docs, capacity=256, group_pieces=120).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = []
    for doc_id, text, *_ in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        for n, at in enumerate(range(0, len(ids), 256)):
            part = ids[at : at + 256]
            want.append((doc_id, n, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    key = lambda x: (x[0] is None, x)
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=key) == sorted(want, key=key)
    places = defaultdict(list)
    for r in got:
        places[r.sequence_id].append((r.offset, r.length))
    for spans in places.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 256


@pytest.mark.parametrize("seed", range(4))
def test_best_two_fit_is_tight(seed):
    r = np.random.default_rng(seed)
    lengths = np.clip(r.lognormal(5, 1.2, 20_000).astype(int), 1, 2048)
    number, offset = best_two_fit(lengths, 2048)
    fill = np.bincount(number, weights=lengths)
    assert fill.max() <= 2048
    assert len(fill) <= np.ceil(lengths.sum() / 2048) + 1
    assert len({*zip(number.tolist(), offset.tolist(), strict=True)}) == len(lengths)


def test_pair_replaces_smallest():
    # Greedy takes 6 and 3 of a bin of 10, and leaves a gap of 1; 2 + 2 fill what 3 and the gap held.
    number, _ = best_two_fit(np.array([6, 3, 2, 2]), 10)
    assert number[0] == number[2] == number[3] != number[1]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert pack_documents(docs).collect() == []
