"""Encoding of a corpus with a public byte-level BPE vocabulary.

Method: the text is cut by the vocabulary's pattern; the symbols of a piece form
a doubly linked list, a priority queue holds the merge ranks of neighbours, and
entries that a merge has made stale are skipped when they come up. A piece of n
bytes takes O(n log n), so long runs of letters or digits are no trouble. Decoding
concatenates the strings of the vocabulary.

The ranks (50,256 entries whatever the corpus) are read on the driver from the
public file and broadcast. Pieces are memorised per task up to ``MEMO`` entries;
a full memo is emptied, which costs time only.

Defined results: null and empty text give an empty list; blank text is encoded
as it is; strings that look like special tokens are ordinary text; repeated
rows are encoded alike.
"""

from __future__ import annotations

import base64
import heapq
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.plans.runtime import spread

FOLDER = "/opt/tokenizers"
NAME = "byte_bpe_50k.tiktoken"
MEMO = 500_000
# Fixed value: the pattern that splits text before the merges of the rank file.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def load_ranks(path: str | None = None) -> dict[bytes, int]:
    """Rank of each byte string of the vocabulary; its rank is its id."""
    with open(path or os.path.join(FOLDER, NAME), "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece."""
    if piece in ranks:
        return [ranks[piece]]
    n = len(piece)
    symbol: list[bytes | None] = [piece[i : i + 1] for i in range(n)]
    left, right = list(range(-1, n - 1)), list(range(1, n + 1))
    queue = []
    for i in range(n - 1):
        r = ranks.get(piece[i : i + 2])
        if r is not None:
            queue.append((r, i, piece[i : i + 2]))
    heapq.heapify(queue)
    while queue:
        _, i, both = heapq.heappop(queue)
        j = right[i]
        # stale: one side has been merged since the entry was made
        if symbol[i] is None or j >= n or len(symbol[i]) + len(symbol[j]) != len(both) or symbol[i] + symbol[j] != both:
            continue
        symbol[i], symbol[j] = both, None
        right[i] = right[j]
        if right[j] < n:
            left[right[j]] = i
            new = both + symbol[right[j]]
            r = ranks.get(new)
            if r is not None:
                heapq.heappush(queue, (r, i, new))
        if left[i] >= 0:
            new = symbol[left[i]] + both
            r = ranks.get(new)
            if r is not None:
                heapq.heappush(queue, (r, left[i], new))
    return [ranks[s] for s in symbol if s is not None]


class Encoder:
    """Encoder with its memo; one per task."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.pattern = ranks, regex.compile(PATTERN)
        self.memo: dict[str, list[int]] = {}

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        memo, out = self.memo, []
        for p in self.pattern.findall(text):
            ids = memo.get(p)
            if ids is None:
                if len(memo) >= MEMO:
                    memo.clear()
                ids = merge(p.encode(), self.ranks)
                if len(p) <= 64:
                    memo[p] = ids
            out += ids
        return out


def decode(ids: list[int], strings: dict[int, bytes]) -> str:
    """Text of ids; strings maps an id to its bytes."""
    return b"".join(strings[i] for i in ids).decode("utf-8", errors="replace")


def encode_column(docs: DataFrame, key: str, column: str, path: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """``(key, *keep, ids)`` of each row of docs."""
    spark = docs.sparkSession
    ranks = spark.sparkContext.broadcast(load_ranks(path))
    rows = spread(docs.select(key, *keep, F.col(column).alias("__text")))
    kinds = dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder(ranks.value)
        for b in batches:
            ids = [enc.encode(t) for t in b.column(b.num_columns - 1).to_pylist()]
            ends = np.zeros(len(ids) + 1, dtype="int32")
            np.cumsum([len(x) for x in ids], out=ends[1:])
            flat = np.fromiter((i for x in ids for i in x), dtype="int32", count=int(ends[-1]))
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], lists], names=[key, *keep, "ids"])

    return rows.mapInArrow(run, ", ".join([f"{c} {kinds[c]}" for c in (key, *keep)] + ["ids array<int>"]))


def decode_column(encoded: DataFrame, key: str, column: str = "ids", path: str | None = None) -> DataFrame:
    """``(key, text)`` of each row of ids; an empty or null list gives ``''``."""
    strings = encoded.sparkSession.sparkContext.broadcast({i: s for s, i in load_ranks(path).items()})
    rows = encoded.select(key, F.col(column).alias("__ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([decode(x or [], strings.value) for x in b.column(1).to_pylist()], pa.string())], names=[key, "text"])

    return rows.mapInArrow(run, f"{key} {dict(rows.dtypes)[key]}, text string")


def count_tokens(docs: DataFrame, key: str, column: str, keep: tuple[str, ...] = (), path: str | None = None) -> DataFrame:
    """``(key, *keep, n_tokens)`` of each row of docs."""
    return encode_column(docs, key, column, path, keep).select(key, *keep, F.size("ids").cast("long").alias("n_tokens"))
