"""Texts as Arrow batches: tokens, hashes and digests over whole blocks of rows with numpy.

A block is a run of rows of at most ``BLOCK`` bytes of text, or one longer text; so working memory
follows the longest text, never the batch or the partition.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Bytes of text in a block of several rows.
BLOCK = 1 << 19

U = np.uint64


def table(*ranges: tuple[int, int]) -> np.ndarray:
    """A lookup table over bytes: true within the given inclusive ranges."""
    out = np.zeros(256, bool)
    for a, b in ranges:
        out[a : b + 1] = True
    return out


#: Bytes of words [^\\x20\\x09-\\x0D]+, and of words of letters, digits and all beyond ASCII.
NOT_SPACE = ~table((0x20, 0x20), (0x09, 0x0D))
ALNUM = table((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
#: Bytes as they are, and with A-Z lower-cased.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


@dataclass
class Block:
    """Rows lo..hi of a batch: their bytes end to end, and n + 1 offsets into them."""

    lo: int
    hi: int
    data: np.ndarray
    offsets: np.ndarray

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()


@dataclass
class Words:
    """Word k of the block is data[starts[k]:ends[k]]; row i has words first[i]..first[i + 1]."""

    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    def rows(self) -> np.ndarray:
        """For each word its row."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def blocks(column: pa.Array, limit: int = BLOCK) -> Iterator[Block]:
    """The column's blocks in order; a null text is an empty one."""
    column = column.fill_null("").cast(pa.large_string())
    n = len(column)
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64, n + 1 + column.offset)[column.offset :] if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        hi = min(hi, n)
        yield Block(lo, hi, raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        lo = hi


def split(block: Block, kept: np.ndarray = NOT_SPACE) -> Words:
    """The maximal runs of kept bytes, none across rows."""
    inside = kept[block.data]
    n = len(inside)
    if not n:
        return Words(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(block.offsets), np.int64))
    begin, end = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    cuts = block.offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < n)]
    begin[cuts] = inside[cuts]
    end[cuts - 1] = inside[cuts - 1]
    starts = np.flatnonzero(begin)
    return Words(starts, np.flatnonzero(end) + 1, np.searchsorted(starts, block.offsets))


#: Words whose hashes are rolled at once.
STRIDE = 1 << 16

_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n at least, n being ``most`` or less; base is odd."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            x = np.full(max(n, most), b, U)
            x[0] = 1
            out.append(np.multiply.accumulate(x))
        have = _POWERS[base] = (out[0], out[1])
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all others (splitmix64's last step)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


WORD_BASE, WINDOW_BASE, OTHER_BASE = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F


def _rolled(values: np.ndarray, base: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(running sums of value i times base**i, base**-i)."""
    up, down = powers(base, len(values) + 1, most + 1)
    sums = np.zeros(len(values) + 1, U)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return sums, down


def word_hashes(data: np.ndarray, words: Words) -> np.ndarray:
    """A 64-bit polynomial hash of each word's bytes, in runs of words of at most BLOCK bytes.

    What is held besides the result follows BLOCK, however long the text or a word is.
    """
    starts, ends = words.starts, words.ends
    out = np.empty(len(starts), U)
    lo = 0
    while lo < len(starts):
        begin = int(starts[lo])
        hi = int(np.searchsorted(ends, begin + BLOCK, "right"))
        if hi > lo:
            sums, down = _rolled(data[begin : ends[hi - 1]].astype(U) + U(1), WORD_BASE, BLOCK)
            a, b = starts[lo:hi] - begin, ends[lo:hi] - begin
            out[lo:hi] = (sums[b] - sums[a]) * down[a]
            lo = hi
        else:  # one word longer than a block, piece by piece
            total, end = 0, int(ends[lo])
            for at in range(begin, end, BLOCK):
                sums, _ = _rolled(data[at : min(end, at + BLOCK)].astype(U) + U(1), WORD_BASE, BLOCK)
                total += int(sums[-1]) * pow(WORD_BASE, at - begin, 1 << 64)
            out[lo] = total % (1 << 64)
            lo += 1
    return mix(out + (ends - starts).astype(U))


def window_hashes(hashes: np.ndarray, size: int, base: int = WINDOW_BASE) -> np.ndarray:
    """Rabin-Karp: the polynomial hash of every ``size`` consecutive words, by rolling sums.

    Entry i is for words i..i+size-1; windows that run over a row's end are the caller's to leave out.
    """
    n = len(hashes)
    if n < size:
        return np.zeros(0, U)
    out = np.empty(n - size + 1, U)
    for lo in range(0, len(out), STRIDE):
        part = hashes[lo : lo + STRIDE + size - 1]
        sums, down = _rolled(part, base, STRIDE + size)
        k = len(part) - size + 1
        out[lo : lo + k] = mix((sums[size:] - sums[:-size]) * down[:k])
    return out


def windows_within(words: Words, size: int) -> np.ndarray:
    """The first words of the windows of ``size`` words that lie within one row."""
    n = int(words.first[-1])
    if n < size:
        return np.zeros(0, np.int64)
    last = np.repeat(words.first[1:], np.diff(words.first))
    at = np.arange(n - size + 1)
    return at[at + size <= last[: n - size + 1]]


def planes(values: np.ndarray) -> bytes:
    """Small integers as byte planes, low bytes first: planes of zeros shrink to nothing in a shuffle."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T).tobytes()


def unplanes(raw: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).view(kind).ravel()


def keep_rows(docs: DataFrame, text: str, decide: Callable[[Block], np.ndarray]) -> DataFrame:
    """The rows, all columns as they are, for whose texts ``decide`` says true; rows stay where they are."""
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [decide(block) for block in blocks(batch.column(at))]
            if kept:
                yield batch.filter(pa.array(np.concatenate(kept)))

    return docs.mapInArrow(run, docs.schema)


def sha256(raw: bytes) -> str:
    return hashlib.sha256(raw).hexdigest()
