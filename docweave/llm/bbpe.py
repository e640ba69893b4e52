"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

The ranks and the split pattern are those of a public tokenizer; the path is a parameter.
"""

from __future__ import annotations

import base64
import functools
import heapq
import itertools
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.llm.arrowtext import sha256

#: Pre-tokens up to so many characters are remembered, up to twice so many of them in a worker.
SHORT, REMEMBERED = 48, 500_000
#: Texts and ids of more characters are worked on piece by piece.
LONG = 1 << 20


BIT = [1 << i for i in range(4096)]


class RankQueue:
    """Positions by merge rank, found through a hierarchy of bitmaps.

    Bit r % 256 of ``low[r // 256]`` is set while rank r has positions, and bit k of ``top`` while
    ``low[k]`` has any bit. Find-first-set on the top word, then on the word it points at, gives the
    lowest rank; its bucket gives the leftmost position. A bucket of one position is that number, a
    larger one a heap.
    """

    def __init__(self, n_ranks: int):
        self.low = [0] * (n_ranks // 256 + 1)
        self.top = 0
        self.buckets: dict[int, int | list[int]] = {}

    def push(self, rank: int, position: int) -> None:
        buckets = self.buckets
        bucket = buckets.get(rank)
        if bucket is None:
            buckets[rank] = position
            k = rank >> 8
            self.low[k] |= BIT[rank & 255]
            self.top |= BIT[k]
        elif type(bucket) is int:
            buckets[rank] = [bucket, position] if bucket < position else [position, bucket]
        else:
            heapq.heappush(bucket, position)

    def fill(self, ranks: list[int]) -> None:
        """Pushes position i with rank ranks[i], for all that are not negative, into the empty queue."""
        buckets, low, top = self.buckets, self.low, self.top
        for i, rank in enumerate(ranks):
            if rank >= 0:
                bucket = buckets.get(rank)
                if bucket is None:
                    buckets[rank] = i
                    k = rank >> 8
                    low[k] |= BIT[rank & 255]
                    top |= BIT[k]
                elif type(bucket) is int:
                    buckets[rank] = [bucket, i]
                else:
                    bucket.append(i)
        self.top = top

    def pop(self) -> tuple[int, int]:
        """The lowest rank and its leftmost position, taken out; the queue isn't empty."""
        top = self.top
        k = (top & -top).bit_length() - 1
        word = self.low[k]
        rank = k << 8 | (word & -word).bit_length() - 1
        bucket = self.buckets[rank]
        if type(bucket) is not int:
            if len(bucket) > 1:
                return rank, heapq.heappop(bucket)
            bucket = bucket[0]
        del self.buckets[rank]
        self.low[k] = word = word & (word - 1)
        if not word:
            self.top = top & (top - 1)
        return rank, bucket


class Codec:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.pattern = regex.compile(pattern)
        self.longest = max(map(len, ranks))
        self.queue = RankQueue(max(ranks.values()) + 1)
        self.bytes = [ranks[bytes([i])] for i in range(256)]
        self.two = [[ranks.get(bytes([i, j]), -1) for j in range(256)] for i in range(256)]
        self.names = {i: str(i) for i in ranks.values()}
        self.pieces = {str(i): b for b, i in ranks.items()}
        self.known: dict[str, str] = {}
        self.older: dict[str, str] = {}

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token: the adjacent pair of lowest rank, the leftmost first, is joined until none is left.

        Tokens are nodes of a linked list over byte positions. A queue entry is stale, and skipped, if
        the pair that now starts at its position has another rank.
        """
        get = self.ranks.get
        whole = get(piece)
        if whole is not None:
            return [whole]
        n, longest, queue, two = len(piece), self.longest, self.queue, self.two
        push, pop = queue.push, queue.pop
        single = self.bytes
        token = [single[x] for x in piece]
        pair = [two[x][y] for x, y in zip(piece, piece[1:], strict=False)]
        pair.append(-1)
        queue.fill(pair)
        after, before = list(range(1, n + 2)), list(range(-1, n))
        while queue.top:
            rank, i = pop()
            if pair[i] != rank:
                continue
            gone = after[i]
            end = after[gone]
            token[i], after[i], before[end], pair[gone] = rank, end, i, -1
            if end < n and after[end] - i <= longest and (r := get(piece[i : after[end]])) is not None:
                pair[i] = r
                push(r, i)
            else:
                pair[i] = -1
            left = before[i]
            if left >= 0:
                r = get(piece[left:end], -1) if end - left <= longest else -1
                if pair[left] != r:
                    pair[left] = r
                    if r >= 0:
                        push(r, left)
        out, i = [], 0
        while i < n:
            out.append(token[i])
            i = after[i]
        return out

    def _new(self, token: str) -> str:
        ids = self.older.get(token) or " ".join(map(self.names.__getitem__, self.merge(token.encode("utf-8"))))
        if len(token) <= SHORT:
            if len(self.known) >= REMEMBERED:  # the older half is forgotten, but for what has been met since
                self.older = dict(self.known)
                self.known.clear()
            self.known[token] = ids
        return ids

    def encode(self, text: str) -> str:
        """The ids in decimal, joined by one space."""
        get, new = self.known.get, self._new
        if len(text) <= LONG:
            return " ".join([get(t) or new(t) for t in self.pattern.findall(text)])
        found = (m[0] for m in self.pattern.finditer(text))  # of a long text few pre-tokens are held at once
        parts = iter(lambda: " ".join([get(t) or new(t) for t in itertools.islice(found, 1 << 14)]), "")
        return " ".join(parts)

    def decode(self, ids: str) -> bytes:
        pieces = self.pieces
        if len(ids) <= LONG:
            return b"".join([pieces[i] for i in ids.split(" ")]) if ids else b""
        out, at = [], 0
        while at < len(ids):
            end = ids.find(" ", at + LONG)
            end = len(ids) if end < 0 else end
            out.append(b"".join([pieces[i] for i in ids[at:end].split(" ")]))
            at = end + 1
        return b"".join(out)


def load_ranks(path: str) -> dict[bytes, int]:
    """Lines of a base64 token and its rank."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(path).read_bytes().splitlines()) if a}


@functools.lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    """Once a worker process."""
    return Codec(load_ranks(path), pattern)


#: What the query returns beside the id; ids in full with ``with_ids``.
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def encode(docs: DataFrame, path: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """One row per document: doc_id, n_tokens, digests of ids and of the bytes decoded from them.

    With ``with_ids`` also ``ids`` (array of int) and ``decoded`` (binary). The tokenizer file is a
    fixed file that every worker reads once from ``path``, as installed on each node. A null text is
    an empty one: no tokens. Null and repeated ids pass through row by row; nothing is shuffled; an
    empty table gives no rows; other columns are ignored.
    """
    schema = SCHEMA + (", ids array<int>, decoded binary" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                texts = (("" if t is None else t) for t in map(_text, part.column(1)))
                n, a, b, ids, raw = [], [], [], [], []
                for text in texts:
                    got = c.encode(text)
                    back = c.decode(got)
                    n.append(got.count(" ") + 1 if got else 0)
                    a.append(sha256(got.encode("ascii")))
                    b.append(sha256(back))
                    if with_ids:
                        ids.append(np.fromstring(got, np.int32, sep=" ") if got else np.zeros(0, np.int32))
                        raw.append(back)
                columns = [part.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    columns += [pa.array(ids, pa.list_(pa.int32())), pa.array(raw, pa.binary())]
                    names += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def _text(value: pa.Scalar) -> str | None:
    raw = value.as_buffer()
    return None if raw is None else raw.to_pybytes().decode("utf-8", "replace")
