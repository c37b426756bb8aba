"""Byte-level BPE encoding of whole texts with a public vocabulary."""

from __future__ import annotations

import base64
import heapq
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the published splitting pattern of this vocabulary.
WORD_PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# A word never goes on across the start of white space, so texts are first cut there.
_WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_CUT = re.compile(f" ?[^{_WHITE}]+|[{_WHITE}]+(?![^{_WHITE}])|[{_WHITE}]+")
# Distinct strings kept by a worker; beyond it the memo starts anew, results stay the same.
MEMO_ENTRIES = 400_000


class BytePairEncoder:
    """Encodes with ``ranks`` (bytes -> id; a lower id merges first); nothing is treated as a special token."""

    def __init__(self, ranks: dict[bytes, int]):
        import regex

        self.ranks = ranks
        self.vocabulary = {i: b for b, i in ranks.items()}
        self.words = regex.compile(WORD_PATTERN)
        self._reset()

    def _reset(self) -> None:
        self.memo: dict[str, int] = {}
        self.pool = np.empty(1 << 16, np.int32)
        self.starts: list[int] = [0]

    @classmethod
    @lru_cache(maxsize=4)
    def load(cls, path: str) -> BytePairEncoder:
        with open(path, "rb") as lines:
            return cls({base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())})

    def merge(self, word: bytes) -> list[int]:
        """Ids of one word: adjacent symbols are merged in the order of (rank, place).

        The symbols are a doubly linked list over the byte positions; candidates wait in a heap, and an
        entry is stale, and skipped, when one of its two symbols has been merged since it was pushed.
        """
        ranks = self.ranks
        if word in ranks:
            return [ranks[word]]
        size = len(word)
        left, right = list(range(-1, size - 1)), list(range(1, size + 1))
        end = list(range(1, size + 1))  # a symbol is word[i:end[i]]; 0 once it was merged away
        queue = [(ranks[pair], i, i + 2) for i in range(size - 1) if (pair := word[i : i + 2]) in ranks]
        heapq.heapify(queue)
        while queue:
            _, at, to = heapq.heappop(queue)
            after = right[at]
            if not end[at] or after >= size or end[after] != to:
                continue
            end[at], end[after] = to, 0
            right[at] = right[after]
            if right[at] < size:
                left[right[at]] = at
                if (rank := ranks.get(word[at : end[right[at]]])) is not None:
                    heapq.heappush(queue, (rank, at, end[right[at]]))
            if (before := left[at]) >= 0 and (rank := ranks.get(word[before:to])) is not None:
                heapq.heappush(queue, (rank, before, to))
        ids, at = [], 0
        while at < size:
            ids.append(ranks[word[at : end[at]]])
            at = right[at]
        return ids

    def _remember(self, piece: str) -> int:
        ids = [i for word in self.words.findall(piece) for i in self.merge(word.encode("utf-8", "surrogatepass"))]
        start = self.starts[-1]
        if start + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.empty(max(len(self.pool), len(ids)), np.int32)])
        self.pool[start : start + len(ids)] = ids
        self.starts.append(start + len(ids))
        self.memo[piece] = number = len(self.starts) - 2
        return number

    def encode_batch(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids) of the texts; null and empty texts have no ids."""
        if len(self.memo) > MEMO_ENTRIES:
            self._reset()
        numbers: list[int] = []
        counts = np.empty(len(texts), np.int64)
        get, remember = self.memo.get, self._remember
        for k, text in enumerate(texts):
            before = len(numbers)
            if text:
                for piece in _CUT.findall(text):
                    number = get(piece)
                    numbers.append(remember(piece) if number is None else number)
            counts[k] = len(numbers) - before
        starts = np.asarray(self.starts, np.int64)
        number = np.asarray(numbers, np.int64)
        lengths = starts[number + 1] - starts[number]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        place = np.arange(ends[-1]) - np.repeat(ends[:-1] - starts[number], lengths)
        return ends[np.concatenate([[0], np.cumsum(counts)])], self.pool[place]

    def encode(self, text: str | None) -> list[int]:
        return self.encode_batch([text])[1].tolist()

    def decode(self, ids) -> str:
        return b"".join(self.vocabulary[i] for i in ids).decode("utf-8", "replace")


def encode_corpus(df: DataFrame, ident: str, text: str, ranks_path: str = DEFAULT_RANKS) -> DataFrame:
    """(ident, ids array<int>) of every row: the ids of the whole text, unchanged, without special tokens.

    An empty text and a null text give an empty list. Strings that look like special tokens are ordinary
    text. One row for each input row: repeated and null identifiers are kept. A text of any length is one
    row's work; there is no shuffle. ``ranks_path`` must be readable by every executor. Other columns are
    not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = BytePairEncoder.load(ranks_path)
        for batch in batches:
            column = batch.column(1)
            at, step = 0, 512
            while at < batch.num_rows:  # bounded pieces: the list column of a batch stays small
                part = column.slice(at, step)
                offsets, ids = encoder.encode_batch(part.to_pylist())
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, step), lists], names=[ident, "ids"])
                at += step

    schema = df.select(F.col(ident), F.array(F.lit(0)).alias("ids")).schema
    for field in schema:
        field.nullable = True
    return df.select(ident, text).mapInArrow(run, schema)


def decode_corpus(df: DataFrame, ident: str, ids: str = "ids", ranks_path: str = DEFAULT_RANKS) -> DataFrame:
    """(ident, text): vocabulary strings of the ids concatenated; null and empty lists give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = BytePairEncoder.load(ranks_path)
        for batch in batches:
            texts = pa.array([encoder.decode(x or []) for x in batch.column(1).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), texts], names=[ident, "text"])

    schema = df.select(F.col(ident), F.lit("").alias("text")).schema
    for field in schema:
        field.nullable = True
    return df.select(ident, ids).mapInArrow(run, schema)
