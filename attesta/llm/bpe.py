"""Encoding of the whole corpus with a public byte-level BPE vocabulary (problem 6).

A pre-token's merges are driven by a rank queue: one bucket of linked-list positions for each merge rank, and over the
ranks a bitmap of three levels of 64-bit words. Find-first-set on each level gives the least rank that waits; its bucket is
worked off from left to right, and entries whose pair has changed since are skipped. Every step costs a constant, so a
pre-token of a million bytes takes time in proportion to its length. Pre-tokens that come again are kept in a bounded
cache for each Python worker.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from attesta.sources.spread import spread

#: Folder of the public vocabularies on every machine; the session's attesta.tokenizers.dir overrides it.
TOKENIZERS_DIR = "/opt/tokenizers"
#: Pre-tokens that a worker remembers, and the longest that it remembers; then it starts afresh.
CACHE_ENTRIES, CACHE_CHARS = 200_000, 64
#: The vocabulary's own pre-token pattern, with white space as the Unicode property of that name.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"


def vocabulary_path(spark, name: str = "byte_bpe_50k.json") -> str:
    return f"{spark.conf.get('attesta.tokenizers.dir', TOKENIZERS_DIR)}/{name}"


def _byte_chars() -> dict[str, int]:
    """The printable characters that stand for the 256 bytes in byte-level vocabularies: visible Latin-1 signs for themselves, the others from U+0100 on in order."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(seen)]
    return {chr(b): b for b in seen} | {chr(256 + i): b for i, b in enumerate(rest)}


class RankQueue:
    """Ranks 0..n-1 with buckets of positions; the least rank comes first."""

    def __init__(self, n: int) -> None:
        self.low = [0] * ((n >> 6) + 1)
        self.mid = [0] * ((n >> 12) + 1)
        self.top = 0
        self.buckets: dict[int, list[int]] = {}

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is None:
            self.buckets[rank] = [position]
            w = rank >> 6
            self.low[w] |= 1 << (rank & 63)
            self.mid[w >> 6] |= 1 << (w & 63)
            self.top |= 1 << (w >> 6)
        else:
            bucket.append(position)

    def pop(self) -> tuple[int, list[int]] | None:
        """The least rank and its positions from left to right; None when empty."""
        if not self.top:
            return None
        m = (self.top & -self.top).bit_length() - 1
        word = self.mid[m]
        w = (m << 6) | ((word & -word).bit_length() - 1)
        word = self.low[w]
        rank = (w << 6) | ((word & -word).bit_length() - 1)
        word &= word - 1
        self.low[w] = word
        if not word:
            self.mid[m] &= ~(1 << (w & 63))
            if not self.mid[m]:
                self.top &= self.top - 1
        bucket = self.buckets.pop(rank)
        bucket.sort()
        return rank, bucket


class Encoder:
    """Byte-level BPE of a vocabulary file in the tokenizers' JSON form."""

    def __init__(self, path: str) -> None:
        import regex

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab = model["vocab"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.byte_ids = [0] * 256
        for c, b in _byte_chars().items():
            self.byte_ids[b] = vocab[c]
        self.ranks: dict[int, int] = {}
        self.merged: list[int] = []
        made: dict[str, int] = {}
        for rank, (a, b) in enumerate(merges):
            # A pair can't merge before its parts exist: then all entries of a rank wait when its turn comes.
            if max(made.get(a, -1), made.get(b, -1)) >= rank:
                raise ValueError(f"merge {rank} of {path} uses a later one")
            made.setdefault(a + b, rank)
            self.ranks[(vocab[a] << 20) | vocab[b]] = rank
            self.merged.append(vocab[a + b])
        self.queue = RankQueue(len(merges))
        self.split = regex.compile(PATTERN).findall
        self.cache: dict[str, list[int]] = {}

    def pre_token(self, data: bytes) -> list[int]:
        ids = [self.byte_ids[b] for b in data]
        n = len(ids)
        if n < 2:
            return ids
        ranks, merged, queue = self.ranks, self.merged, self.queue
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        for i in range(n - 1):
            if (r := ranks.get((ids[i] << 20) | ids[i + 1])) is not None:
                queue.push(r, i)
        while (least := queue.pop()) is not None:
            rank, positions = least
            for i in positions:
                j = after[i]
                if ids[i] < 0 or j >= n or ranks.get((ids[i] << 20) | ids[j]) != rank:
                    continue  # stale: a neighbour has merged since
                ids[i], ids[j] = merged[rank], -1
                k = after[i] = after[j]
                if k < n:
                    before[k] = i
                    if (r := ranks.get((ids[i] << 20) | ids[k])) is not None:
                        queue.push(r, i)
                p = before[i]
                if p >= 0 and (r := ranks.get((ids[p] << 20) | ids[i])) is not None:
                    queue.push(r, p)
        return [x for x in ids if x >= 0]

    def encode(self, text: str | None) -> list[int]:
        """The ids of a text, without special tokens; empty for an empty and for a null text."""
        if not text:
            return []
        out: list[int] = []
        cache = self.cache
        for piece in self.split(text):
            ids = cache.get(piece)
            if ids is None:
                ids = self.pre_token(piece.encode("utf-8"))
                if len(piece) <= CACHE_CHARS:
                    if len(cache) >= CACHE_ENTRIES:
                        cache.clear()
                    cache[piece] = ids
            out += ids
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One for each worker and vocabulary."""
    return Encoder(path)


def encode_texts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, ids ARRAY<INT>): one row for each row of `docs`, repeated ids included; further columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode
        for b in batches:
            lists = [encode(t.as_py()) for t in b.column(1)]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype("int32")
            flat = pa.array([i for x in lists for i in x], pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(offsets), flat)], names=[id_col, "ids"])

    d = docs.select(id_col, text_col)
    return d.mapInArrow(run, f"{id_col} {d.schema[id_col].dataType.simpleString()}, ids array<int>")


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_tokens INT) without keeping the ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(encode(t.as_py())) for t in b.column(1)], pa.int32())], names=[id_col, "n_tokens"])

    d = docs.select(id_col, text_col)
    return d.mapInArrow(run, f"{id_col} {d.schema[id_col].dataType.simpleString()}, n_tokens int")
