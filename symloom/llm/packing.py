"""Packing of tokenised documents into sequences of fixed length by best-two-fit.

Documents become token pieces of at most ``capacity`` tokens. Pieces are dealt
by hash into groups of about ``GROUP_PIECES``, and each group is packed by
itself: the number of groups grows with the corpus while a group's memory stays
the same, and at worst one sequence per group is left part empty.

A bin is filled greedily with the largest piece that still fits. Then its
smallest piece is replaced by the two unpacked pieces that fill the gap it
leaves most tightly, if they fill it better.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from symloom.llm.common import map_batches, materialize, table, tasks_for, texts_of

CAPACITY = 2048
END_OF_TEXT = 0
GROUP_PIECES = 100_000
#: Entries of one generation of a worker's cache, and the longest stretch worth one (longer ones hardly recur).
_CACHE_ENTRIES = 220_000
_CACHED_CHARS = 14
_BLOCK = 1 << 20
_END = np.array([END_OF_TEXT], "<u4").tobytes()
_PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


_LETTERS = "[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u0148\u014a-\u017e]+"
_WORD = re.compile(_LETTERS)
_WORD_AND_MARKS = re.compile(rf"({_LETTERS})([!-/:-@\[-`{{-~]+)")
#: The byte-level alphabet: bytes that print stand for themselves, the others for 256 and up, in order.
_PRINTS = {*range(33, 127), *range(161, 173), *range(174, 256)}
_BYTE_LEVEL = {b: 256 + n for n, b in enumerate(b for b in range(256) if b not in _PRINTS)}


class ChunkIds(dict):
    """Token ids, as little-endian bytes, of a text's stretches between white space, encoded once each.

    The tokenizer's normaliser and splitter never look across white space, so a
    text's ids are those of its stretches in a row. They split a stretch of
    letters with ASCII punctuation behind it between the two. A word of Latin
    letters is one unit for the model, lower-cased letter by letter, so that the
    model can be asked directly; all else goes through the whole tokenizer.
    Entries live in two generations: when the younger one is full it becomes the
    older one, which is dropped then.
    """

    def __init__(self, path: str):
        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenize = self.tokenizer.model.tokenize
        self.older: dict[str, bytes] = {}

    def __missing__(self, chunk: str) -> bytes:
        ids = self.older.get(chunk)
        if ids is None:
            if chunk.isascii() and chunk.isalpha() and chunk.islower():
                ids = array("I", [t.id for t in self.tokenize(chunk)]).tobytes()
            else:
                ids = self._encode(chunk)
        if len(chunk) <= _CACHED_CHARS:
            if len(self) >= _CACHE_ENTRIES:
                self.older = dict(self)
                self.clear()
            self[chunk] = ids
        return ids

    def _encode(self, chunk: str) -> bytes:
        if _WORD.fullmatch(chunk):
            if (low := chunk.lower()) != chunk:
                return self[low]
            level = low if low.isascii() else low.encode().decode("latin-1").translate(_BYTE_LEVEL)
            return array("I", [t.id for t in self.tokenize(level)]).tobytes()
        if two := _WORD_AND_MARKS.fullmatch(chunk):
            return self[two[1]] + self[two[2]]
        return np.array(self.tokenizer.encode(chunk, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        parts, at = [], 0
        while at < len(text):
            cut = text.find(" ", at + _BLOCK)
            cut = len(text) if cut < 0 else cut
            chunks = text[at:cut].replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
            parts.append(b"".join(map(self.__getitem__, chunks)))
            at = cut
        return b"".join(parts)


_caches: dict[str, ChunkIds] = {}


def shared_ids(path: str) -> ChunkIds:
    """The Python worker's own cache; it outlives the task."""
    if path not in _caches:
        _caches[path] = ChunkIds(path)
    return _caches[path]


def _pieces(tokenizer_path: str, capacity: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = shared_ids(tokenizer_path)
        for batch, texts in texts_of(batches, 1):
            rows, piece, start, length, crc = [], [], [], [], []
            for k, text in enumerate(texts):
                ids = ids_of.encode(text) + _END
                for n, at in enumerate(range(0, len(ids), 4 * capacity)):
                    own = ids[at : at + 4 * capacity]
                    rows.append(k)
                    piece.append(n)
                    start.append(at // 4)
                    length.append(len(own) // 4)
                    crc.append(zlib.crc32(own))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return cut


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece of each row of ``docs`` (doc_id, text); null and empty texts are one piece, the end mark alone."""
    return map_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), _pieces(tokenizer_path, capacity), _PIECE)


def best_two_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each piece; every length is from 1 to ``capacity``."""
    order = np.argsort(lengths, kind="stable")
    count = np.bincount(lengths, minlength=capacity + 1)
    end = np.cumsum(count)  # pieces of one length are taken from the end of their stretch in order
    left = count.copy()
    sizes = np.arange(capacity + 1)

    def refreshed() -> tuple[np.ndarray, list[int]]:
        fit = np.maximum.accumulate(np.where(left > 0, sizes, 0))
        return fit, fit.tolist()

    largest, fast = refreshed()
    out_bin, out_offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    number = 0
    while fast[capacity]:
        content, gap = [], capacity
        while (take := fast[gap]) > 0:
            n = min(int(left[take]), gap // take)
            content += [take] * n
            gap -= n * take
            left[take] -= n
            if not left[take]:
                largest, fast = refreshed()
        smallest = content[-1]
        if gap and len(content) > 1:
            room = gap + smallest
            first = np.flatnonzero(left[: room + 1])
            second = largest[room - first]
            again = (second == first) & (left[first] < 2)
            second = np.where(again, largest[np.maximum(first - 1, 0)], second)
            total = np.where(second > 0, first + second, 0)
            if len(total) and total[best := int(np.argmax(total))] > smallest:
                pair = (int(first[best]), int(second[best]))
                content[-1:] = pair
                left[smallest] += 1
                for size in pair:
                    left[size] -= 1
                largest, fast = refreshed()
        offset = 0
        for size in content:
            end[size] -= 1
            at = order[end[size]]
            out_bin[at], out_offset[at] = number, offset
            offset += size
        number += 1
    return out_bin, out_offset


def _packer(capacity: int):
    def pack(key: tuple, pieces: pd.DataFrame) -> pd.DataFrame:
        pieces = pieces.sort_values(["length", "doc_id", "piece", "ids_crc32"], kind="stable").reset_index(drop=True)
        number, offset = best_two_fit(pieces["length"].to_numpy(), capacity)
        return pieces.drop(columns="part").assign(sequence_id=(int(key[0]) << 32) + number, offset=offset)

    return pack


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """``pieces`` with sequence_id and offset. Sequence ids are unique, not consecutive."""
    groups = tasks_for(pieces.count(), group_pieces)
    dealt = pieces.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(groups)).cast("int"))
    return dealt.groupBy("part").applyInPandas(_packer(capacity), f"{_PIECE}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """One row (doc_id, piece, start, length, ids_crc32, sequence_id, offset) per piece of each row of ``docs`` (doc_id, text).

    Only documents of more than ``capacity`` tokens are cut. Repeated rows are
    packed each on their own; a null doc_id is kept. Other columns are ignored.
    An empty table gives an empty result.
    """
    path = tokenizer_path or public_tokenizers.path("word_bpe_49k.json")
    return pack_pieces(materialize(token_pieces(docs, path, capacity), "pieces"), capacity, group_pieces)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
