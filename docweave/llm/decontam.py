"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Every window of benchmark words is a pattern. Patterns of one length form a set with its own tables:
a block is the hash of two neighbouring words (of one word for patterns of one word), and the shift
table says how far the search may move on when a block ends at its position. Where the shift is zero,
the bucket of patterns with this last block is looked up and each is compared word by word.

Texts are searched in lockstep: a batch's words are cut into stretches, each with a cursor, and all
cursors look up their shifts at once. A stretch owns the window ends within it, so cutting loses nothing.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.llm.arrowtext import ALNUM, LOWER, OTHER_BASE, WINDOW_BASE, Block, Words, blocks, keep_rows, mix, powers, sha256, split, window_hashes, word_hashes
from docweave.plans.session import checkpoint

#: Words of a window.
WINDOW = 10
#: Window ends that one cursor owns.
STRETCH = 256
#: Bytes of benchmark text in one set of tables; a larger benchmark is searched in several passes.
MOST_BYTES = 16 << 20

U = np.uint64


def _block(hashes: np.ndarray, size: int) -> np.ndarray:
    """Entry i: the block that ends at word i."""
    if size == 1:
        return hashes
    out = np.zeros(len(hashes), U)
    out[1:] = mix(hashes[1:] + hashes[:-1] * U(0x9FB21C651E98DF25))
    return out


class Patterns:
    """The Wu-Manber tables of all distinct patterns of one length, as arrays.

    Pattern p is the ``length`` words of the benchmark from ``first[p]`` on; patterns stand in buckets by
    their last block, and in each by a hash of all their words, under one key. Its items are
    ``items[of[p]:of[p + 1]]``, NO_ITEM for those without an id.
    """

    def __init__(self, length: int, data: bytes, words: Words, hashes: np.ndarray, first: np.ndarray, items: np.ndarray):
        self.length = length
        self.block = min(2, length)
        self.data, self.words = data, words
        whole, other = (window_hashes(hashes, length, base)[first] for base in (WINDOW_BASE, OTHER_BASE))
        ending = _block(hashes, self.block)
        # an open table over the low bits of the blocks: the smallest shift of all that fall together
        self.default = length - self.block + 1
        self.mask = U((1 << max(16, (4 * len(first)).bit_length())) - 1)
        self.shift = np.full(int(self.mask) + 1, self.default, np.uint8 if length < 256 else np.int32)
        for at in range(self.block - 1, length):
            np.minimum.at(self.shift, (ending[first + at] & self.mask).astype(np.int64), self.shift.dtype.type(length - 1 - at))
        keys = self.key(ending[first + length - 1], whole)
        order = np.lexsort((items, other, keys))
        keys, other, items, first = keys[order], other[order], items[order], first[order]
        new = np.concatenate(([True], (keys[1:] != keys[:-1]) | (other[1:] != other[:-1])))
        once = new | np.concatenate(([True], items[1:] != items[:-1]))
        self.keys, self.first, self.items = keys[new], first[new], items[once]
        self.of = np.append(np.flatnonzero(new[once]), len(self.items))

    @staticmethod
    def key(last: np.ndarray, whole: np.ndarray) -> np.ndarray:
        """What a pattern is looked up by: its last block and all its words."""
        return mix(last + whole * U(0x9FB21C651E98DF25))

    def same(self, p: int, data: bytes, starts: np.ndarray, ends: np.ndarray, at: int) -> bool:
        """Whether the words from ``at`` on are the pattern's, one by one."""
        mine, begin = self.words, int(self.first[p])
        return all(data[starts[at + k] : ends[at + k]] == self.data[mine.starts[begin + k] : mine.ends[begin + k]] for k in range(self.length))

    def occurrences(self, hashes: np.ndarray, first: np.ndarray, data: bytes, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int]]:
        """(first word, pattern) of every occurrence within one row of the block."""
        m = self.length
        lo, hi = first[:-1] + m - 1, first[1:]  # the window ends of each row
        pieces = np.maximum(0, -(-(hi - lo) // STRETCH))
        row = np.repeat(np.arange(len(lo)), pieces)
        if not len(row):
            return
        nth = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        at = lo[row] + nth * STRETCH
        stop = np.minimum(at + STRETCH, hi[row])
        ending = _block(hashes, self.block)
        slots = (ending & self.mask).astype(np.int64)
        found = []
        while len(at):
            shift = self.shift[slots[at]].astype(np.int64)
            hit = shift == 0
            if hit.any():
                found.append(at[hit])
            at = at + np.maximum(shift, 1)
            alive = at < stop
            at, stop = at[alive], stop[alive]
        if not found:
            return
        at = np.sort(np.concatenate(found))
        begin = at - m + 1
        # the hash of all words, rolled over the stretches that were hit alone
        whole = np.empty(len(at), U)
        for k in range(0, len(at), 4096):
            some = begin[k : k + 4096]
            whole[k : k + 4096] = window_hashes_at(hashes, m, some)
        keys = self.key(ending[at], whole)
        p = np.searchsorted(self.keys, keys)
        p[p == len(self.keys)] = 0
        for k in np.flatnonzero(self.keys[p] == keys).tolist():
            q = int(p[k])
            while q < len(self.keys) and self.keys[q] == keys[k]:  # one, but for keys equal by chance
                if self.same(q, data, starts, ends, int(begin[k])):
                    yield int(begin[k]), q
                q += 1


def window_hashes_at(hashes: np.ndarray, size: int, at: np.ndarray) -> np.ndarray:
    """window_hashes(hashes, size)[at], for few places."""
    up, _ = powers(WINDOW_BASE, size, size)
    return mix((hashes[at[:, None] + np.arange(size)] * up[:size]).sum(axis=1, dtype=U))


#: Stands for the id of items that have none; all of them count as one item.
NO_ITEM = -(1 << 63)


def tables(items: list[tuple[int | None, str | None]], window: int) -> list[Patterns]:
    """The pattern sets of these benchmark items, by length. Items without words have none."""
    texts = [(text or "").encode("utf-8", "replace") for _, text in items]
    offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts], dtype=np.int64)))
    block = Block(0, len(texts), LOWER[np.frombuffer(b"".join(texts), np.uint8)], offsets)
    words = split(block, ALNUM)
    hashes = word_hashes(block.data, words) if len(words.starts) else np.zeros(0, U)
    counts = np.diff(words.first)
    names = np.array([NO_ITEM if i is None else int(i) for i, _ in items], np.int64)
    out = []
    for m in np.unique(np.minimum(counts[counts > 0], window)).tolist():
        rows = np.flatnonzero(np.minimum(counts, window) == m)
        n = counts[rows] - m + 1
        row = np.repeat(rows, n)
        first = words.first[row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        out.append(Patterns(m, block.data.tobytes(), words, hashes, first, names[row]))
    return out


def _search(sets: list[Patterns], block: Block) -> tuple[Words, np.ndarray, list[set[int]]]:
    """The block's words, whether each is hit, and for each row the items found."""
    block = Block(block.lo, block.hi, LOWER[block.data], block.offsets)
    words = split(block, ALNUM)
    n = len(words.starts)
    hashes = word_hashes(block.data, words) if n else np.zeros(0, U)
    data = block.data.tobytes()
    marks = np.zeros(n + 1, np.int32)
    items: list[set[int]] = [set() for _ in range(block.hi - block.lo)]
    for s in sets:
        for first, pattern in s.occurrences(hashes, words.first, data, words.starts, words.ends):
            marks[first] += 1
            marks[first + s.length] -= 1
            row = int(np.searchsorted(words.first, first, "right")) - 1
            items[row].update(s.items[s.of[pattern] : s.of[pattern + 1]].tolist())
    return words, np.cumsum(marks)[:n] > 0, items


def _parts(benchmark: DataFrame, most: int) -> Iterator[list[tuple[int | None, str | None]]]:
    """The benchmark in blocks of bounded size, one after the other through the driver; one block at least."""
    part, size = [], 0
    for row in benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).toLocalIterator():
        n = len((row[1] or "").encode("utf-8", "replace"))
        if part and size + n > most:
            yield part
            part, size = [], 0
        part.append((row[0], row[1]))
        size += n
    yield part


#: A row is told by its id and a hash of its text: equal rows have equal hits.
HITS = "doc_id long, h long, hits binary, items array<long>"


def _identified(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), text.alias("text"))


def _hits(docs: DataFrame, part: list[tuple[int | None, str | None]], window: int) -> DataFrame:
    """Of the rows that one part of the benchmark hits: who they are, the hit words (a bit each) and items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = tables(part, window)
        for batch in batches:
            for block in blocks(batch.column(2)):
                words, hit, items = _search(sets, block)
                some = [i for i, x in enumerate(items) if x]
                if some:
                    mine = batch.slice(block.lo, block.hi - block.lo).take(pa.array(some))
                    masks = [np.packbits(hit[words.first[i] : words.first[i + 1]]).tobytes() for i in some]
                    yield pa.RecordBatch.from_arrays([mine.column(0), mine.column(1), pa.array(masks, pa.binary()), pa.array([sorted(items[i]) for i in some], pa.list_(pa.int64()))], ["doc_id", "h", "hits", "items"])

    return _identified(docs).mapInArrow(run, HITS)


SCHEMA = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, items array<long>"


def _report(ids: pa.Array, n_words: np.ndarray, n_hit: list[int], items: list[set[int]]) -> pa.RecordBatch:
    named = [sorted(x - {NO_ITEM}) for x in items]
    digests = [sha256(",".join(sorted(map(str, x))).encode()) for x in named]
    return pa.RecordBatch.from_arrays(
        [ids, pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array([len(x) for x in items], pa.int64()), pa.array(digests, pa.string()), pa.array([x > 0 for x in n_hit], pa.bool_()), pa.array(named, pa.list_(pa.int64()))],
        ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "items"],
    )


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, most_bytes: int = MOST_BYTES) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, and items (array of long).

    A document word is hit if any occurrence of a window covers it. The tables of the patterns go to
    the workers only up to ``most_bytes`` of benchmark text; a larger benchmark is cut into parts, each
    a pass that reads the documents and writes, in the shared folder, the rows it hits, without texts.
    What the passes found is joined to the documents at last.

    Null and empty texts have no words and no hits. Null ids pass through; repeated rows each get
    their own row. Passages of items without an id count as any others; all such items count as one in
    ``n_items``, and none is named in ``items`` or the digest. An empty benchmark hits nothing. Other
    columns are ignored.
    """
    parts = _parts(benchmark, most_bytes)
    part, more = next(parts), next(parts, None)

    def direct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = tables(part, window)
        for batch in batches:
            for block in blocks(batch.column(1)):
                words, hit, items = _search(sets, block)
                sums = np.concatenate(([0], np.cumsum(hit)))
                yield _report(batch.column(0).slice(block.lo, block.hi - block.lo), np.diff(words.first), np.diff(sums[words.first]).tolist(), items)

    if more is None:
        return _identified(docs).select("doc_id", "text").mapInArrow(direct, SCHEMA)
    found = _all_hits(docs, itertools.chain((part, more), parts), window).groupBy("doc_id", "h").agg(F.collect_set("hits").alias("hits"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))  # a row for each part at most, and copies

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(1)):
                mine = batch.slice(block.lo, block.hi - block.lo)
                n_hit = [int(np.bitwise_count(np.bitwise_or.reduce([np.frombuffer(m, np.uint8) for m in x])).sum()) if x else 0 for x in mine.column(2).to_pylist()]
                n_words = np.diff(split(Block(0, 0, LOWER[block.data], block.offsets), ALNUM).first)
                yield _report(mine.column(0), n_words, n_hit, [set(x or ()) for x in mine.column(3).to_pylist()])

    rows = _identified(docs).alias("d").join(found.alias("f"), F.col("d.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("d.h") == F.col("f.h")), "left")
    return rows.select("d.doc_id", "d.text", "f.hits", "f.items").mapInArrow(count, SCHEMA)


def _all_hits(docs: DataFrame, parts: Iterator[list], window: int) -> DataFrame:
    """The hits of all parts, one pass after the other, each written before the next part is fetched; copies of a row once."""
    return functools.reduce(DataFrame.unionByName, [checkpoint(_hits(docs, part, window).dropDuplicates(["doc_id", "h"])) for part in parts])


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, most_bytes: int = MOST_BYTES) -> DataFrame:
    """The rows of ``docs`` without any benchmark window, with all their columns and in any order.

    Null and empty texts hold no window and stay; repeated rows stay or go together; items without an
    id count as any others; an empty table or benchmark takes nothing away. Beyond ``most_bytes`` of
    benchmark the passes write which rows they hit, and these are left out by a join.
    """
    parts = _parts(benchmark, most_bytes)
    part, more = next(parts), next(parts, None)
    made: list[Patterns] = []

    def decide(block: Block) -> np.ndarray:
        if not made and part:
            made.extend(tables(part, window))
        return np.array([not x for x in _search(made, block)[2]], bool)

    if more is None:
        return keep_rows(docs, "text", decide)
    found = _all_hits(docs, itertools.chain((part, more), parts), window).select("doc_id", "h").distinct()
    mine = docs["doc_id"].cast("long").eqNullSafe(found["doc_id"]) & (F.xxhash64(docs["text"].cast("string")) == found["h"])
    return docs.join(found, mine, "left_anti")
