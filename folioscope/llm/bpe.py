"""Encoding with a public byte-level BPE vocabulary: rank file in, token ids out.

A text is cut by the vocabulary's split pattern into pieces; the bytes of each piece are merged pairwise, lowest rank
first, leftmost first among equals. A segment tree over the byte positions holds the leftmost minimum pair rank; a merge
updates the two neighbouring pairs in logarithmic time. Pieces repeat, so a worker keeps the ids of those it has seen.

Results: null and empty text give the empty list; text that spells a special token is ordinary text; lone surrogates become U+FFFD.
"""

from __future__ import annotations

import base64
import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from ..session import spread

#: Where the vocabulary files lie unless the caller says otherwise.
VOCAB_DIR = os.environ.get("FOLIOSCOPE_TOKENIZERS", "/opt/tokenizers")
#: Fixed value: the pattern that splits text before the merges of the rank files.
SPLIT_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces that a worker remembers; beyond it the memory is emptied, which costs time but changes no result.
MEMO = 200_000
#: Longest piece, in bytes, that is remembered.
MEMO_BYTES = 64
NONE = np.iinfo(np.int64).max


def load_ranks(path: str) -> dict[bytes, int]:
    if os.path.basename(path).removesuffix(".tiktoken") not in VOCABULARIES:
        raise ValueError(f"{path} is none of {VOCABULARIES}: its texts may be split otherwise")
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class MinTree:
    """Leftmost minimum over positions, with point updates: an array-backed binary tree."""

    def __init__(self, values: list[int]):
        n = 1
        while n < len(values):
            n *= 2
        self.n = n
        self.t = [NONE] * n + values + [NONE] * (n - len(values))
        for i in range(n - 1, 0, -1):
            a, b = self.t[2 * i], self.t[2 * i + 1]
            self.t[i] = a if a <= b else b

    def set(self, i: int, value: int) -> None:
        t = self.t
        i += self.n
        t[i] = value
        while i > 1:
            i >>= 1
            a, b = t[2 * i], t[2 * i + 1]
            m = a if a <= b else b
            if t[i] == m:
                break
            t[i] = m

    def leftmost_min(self) -> tuple[int, int]:
        t, i, m = self.t, 1, self.t[1]
        if m == NONE:
            return -1, NONE
        while i < self.n:
            i = 2 * i if t[2 * i] == m else 2 * i + 1
        return i - self.n, m


def merge_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of one piece."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    get = ranks.get
    end = list(range(1, n + 1))  # end[i]: where the token that begins at i ends
    prev = list(range(-1, n - 1))
    tree = MinTree([get(piece[i : i + 2], NONE) for i in range(n - 1)] or [NONE])
    while True:
        i, r = tree.leftmost_min()
        if i < 0:
            break
        j = end[i]  # the right token of the pair
        k = end[j]
        end[i] = k
        if k < n:
            prev[k] = i
            tree.set(i, get(piece[i : end[k]], NONE))
        else:
            tree.set(i, NONE)
        if j < n - 1:
            tree.set(j, NONE)
        p = prev[i]
        if p >= 0:
            tree.set(p, get(piece[p:k], NONE))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


class Encoder:
    """Encodes texts; remembers the ids of short pieces."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = SPLIT_PATTERN):
        self.ranks, self.split, self.memo = ranks, regex.compile(pattern).findall, {}

    def _ids(self, piece: str) -> list[int]:
        raw = piece.encode("utf-8", "replace") if piece.isascii() else piece.encode("utf-8", "surrogatepass").decode("utf-8", "replace").encode()
        ids = merge_piece(raw, self.ranks)
        if len(raw) <= MEMO_BYTES:
            if len(self.memo) >= MEMO:
                self.memo.clear()
            self.memo[piece] = ids
        return ids

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        memo, out = self.memo, []
        for piece in self.split(text):
            ids = memo.get(piece)
            out += self._ids(piece) if ids is None else ids
        return out

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        memo, n = self.memo, 0
        for piece in self.split(text):
            ids = memo.get(piece)
            n += len(self._ids(piece) if ids is None else ids)
        return n


#: Vocabularies whose texts are split by SPLIT_PATTERN.
VOCABULARIES = ("byte_bpe_50k", "byte_bpe_multi_50k")


def _shared_ranks(spark: SparkSession, path: str):
    """The rank file as a broadcast of its bytes: about a megabyte, fixed by the vocabulary and independent of the data."""
    if os.path.basename(path).removesuffix(".tiktoken") not in VOCABULARIES:
        raise ValueError(f"{path} is none of {VOCABULARIES}: its texts may be split otherwise")
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


_ENCODERS: dict[bytes, Encoder] = {}


def _encoder(shared) -> Encoder:
    """One encoder a worker process and vocabulary."""
    raw = shared.value
    key = hashlib.sha256(raw).digest()
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder({base64.b64decode(a): int(b) for a, b in (x.split() for x in raw.splitlines() if x.strip())})
    return _ENCODERS[key]


def encode_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocab: str = "byte_bpe_50k", vocab_dir: str = VOCAB_DIR) -> DataFrame:
    """(id, ids array<int>) for every row of df; other columns, whatever their names, don't matter. No row is dropped or cut."""
    shared = _shared_ranks(df.sparkSession, f"{vocab_dir}/{vocab}.tiktoken")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(shared)
        for b in batches:
            flat: list[int] = []
            ends = [0]
            for t in b.column(1).to_pylist():
                flat += enc.encode(t)
                ends.append(len(flat))
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), ids], ["id", "ids"])

    kind = df.schema[id_col].dataType.simpleString()
    return spread(df.select(id_col, text_col)).mapInArrow(run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def count_tokens(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocab: str = "byte_bpe_50k", vocab_dir: str = VOCAB_DIR) -> DataFrame:
    """(id, n_tokens) for every row; null and empty text count 0."""
    shared = _shared_ranks(df.sparkSession, f"{vocab_dir}/{vocab}.tiktoken")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(shared)
        for b in batches:
            n = pa.array([enc.count(t) for t in b.column(1).to_pylist()], pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), n], ["id", "n_tokens"])

    kind = df.schema[id_col].dataType.simpleString()
    return spread(df.select(id_col, text_col)).mapInArrow(run, f"id {kind}, n_tokens int").withColumnRenamed("id", id_col)
