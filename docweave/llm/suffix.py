"""Sparse suffix arrays: repeated passages of a least length, found from minimiser positions.

1. Retain. Of every ``gram`` consecutive words a hash is taken; in each window of ``least`` words the
   least hash marks a position. Equal windows mark equal places, so only suffixes that begin at marked
   positions are kept, about one of twenty.
2. Sort and compare neighbours. Suffixes are dealt and sorted by a 64-bit hash of their first ``gram``
   words, and a suffix whose hash no neighbour has is dropped; contents aren't sorted. Within a worker's batch only the first of equal
   ones goes on, so a passage that a third of all documents share makes no hot bucket.
3. Extend. Around each suffix that is left, the windows of ``least`` words that reach left and right
   over it, and whose mark it is, are counted by rolling hashes over the whole table, as in substring;
   neighbours' common prefixes aren't measured. Windows that stand elsewhere merge into maximal passages.
4. Remove all occurrences but the first, in (document, start) order.

Every repeat of ``least`` words or more has a mark within, so none is lost, and what is left out in
step 2 stands nowhere else.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from docweave.llm.arrowtext import BLOCK, OTHER_BASE, Block, Words, blocks, split, window_hashes, windows_within, word_hashes
from docweave.llm.substring import FLUSH, NO_ID, PACKED, Layout, U, Windowed, apply, count, counted, dealt, group_of, identified, joined, layout, packed_rows, repeats_of, row_ids, solved, span_of, texts_of, unpack_windows

#: Words of a passage at least, and of the first words by which suffixes are sorted.
LEAST, GRAM = 50, 8


def marks(words: Words, hashes: np.ndarray, least: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts of the windows of ``least`` words, the marked position of each, hashes of all grams)."""
    at = windows_within(words, least)
    grams = window_hashes(hashes, gram)
    width = least - gram + 1
    marked = np.zeros(len(at), np.int64)
    if len(at):
        view = np.lib.stride_tricks.sliding_window_view(grams, width)
        for lo in range(0, len(at), 1 << 15):
            part = at[lo : lo + (1 << 15)]
            marked[lo : lo + len(part)] = part + view[part].argmin(axis=1)  # the leftmost of equal ones
    return at, marked, grams


def retain(docs: DataFrame, least: int, gram: int, at: Layout) -> DataFrame:
    """Kind 0: suffixes by bucket of their first words; kind 1: suffixes known to be shared, by group of documents."""

    def flush(held: list[Windowed]) -> Iterator[pa.RecordBatch]:
        ids, places, keys, _ = joined(held)
        first, later = repeats_of(ids, places, keys)
        yield from packed_rows(((keys[first] >> U(32)) % U(at.parts)).astype(np.int32), 0, ids[first], places[first], keys[first])
        shared = np.flatnonzero(np.isin(keys, keys[later]))
        yield from packed_rows(group_of(ids[shared], at.groups) % at.parts, 1, ids[shared], places[shared])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            ids = row_ids(batch)
            for block in blocks(batch.column(1)):
                words = split(block)
                if not len(words.starts):
                    continue
                _, marked, grams = marks(words, word_hashes(block.data, words), least, gram)
                places = np.unique(marked)
                row = np.searchsorted(words.first, places, "right") - 1
                held.append((ids[block.lo + row], places - words.first[row], grams[places], None))
                n += len(places)
                if n >= FLUSH // 2:
                    yield from flush(held)
                    held, n = [], 0
        if n:
            yield from flush(held)

    return docs.mapInArrow(run, PACKED)


def neighbours(retained: DataFrame, at: Layout) -> DataFrame:
    """Kind 1: suffixes whose first words a neighbour in sorted order shares."""

    def solve(held: list[Windowed]) -> Iterator[pa.RecordBatch]:
        ids, places, keys, _ = joined(held)
        order = np.argsort(keys, kind="stable")
        same = keys[order][1:] == keys[order][:-1]
        shared = np.sort(order[np.concatenate((same, [False])) | np.concatenate(([False], same))])
        yield from packed_rows(group_of(ids[shared], at.groups) % at.parts, 1, ids[shared], places[shared])

    return solved(retained, at, solve)


def extend(docs: DataFrame, shared: DataFrame, least: int, gram: int, at: Layout) -> DataFrame:
    """The windows over shared suffixes, as substring.scan() gives them: kind 0 to compare, kind 1 repeats already."""

    def reach(texts: list[bytes], keys: list[tuple[int, int]], places: list[np.ndarray]) -> Windowed:
        offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
        block = Block(0, len(texts), np.frombuffer(b"".join(texts), np.uint8), offsets)
        words = split(block)
        hashes = word_hashes(block.data, words)
        start, marked, _ = marks(words, hashes, least, gram)
        wanted = np.zeros(len(hashes) + 1, bool)
        for i, a in enumerate(places):
            place = a + words.first[i]
            wanted[place[place < words.first[i + 1]]] = True
        start = start[wanted[marked]]
        row = np.searchsorted(words.first, start, "right") - 1
        whole, other = window_hashes(hashes, least), window_hashes(hashes, least, OTHER_BASE)
        return np.array(keys, np.int64)[row], start - words.first[row], whole[start], other[start]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed: list[Windowed] = []
        ids, places = np.zeros((0, 2), np.int64), np.zeros(0, np.int64)
        held, n = [], 0
        texts, keys, found, size = [], [], [], 0
        for batch in batches:
            kinds, doc, text, hs, raw = batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4), batch.column(5).to_pylist(), batch.column(6)
            for i, kind in enumerate(kinds):
                if kind == 1:
                    packed.append(unpack_windows(raw[i].as_buffer().to_pybytes()))
                    continue
                if packed:
                    ids, places, _, _ = joined(packed)
                a, b = span_of(ids, doc[i], hs[i])
                body = text[i].as_buffer()
                if b == a or body is None:
                    continue
                texts.append(body.to_pybytes())
                keys.append((NO_ID if doc[i] is None else doc[i], hs[i]))
                found.append(places[a:b])
                size += body.size
                if size >= BLOCK:
                    held.append(reach(texts, keys, found))
                    n += len(held[-1][0])
                    texts, keys, found, size = [], [], [], 0
                    if n >= FLUSH:
                        yield from counted(held, at)
                        held, n = [], 0
        if texts:
            held.append(reach(texts, keys, found))
        if held:
            yield from counted(held, at)

    return dealt(shared.unionByName(texts_of(docs, at)), at, 1, ["part", "sub", "kind"]).mapInArrow(run, PACKED)


def dedup(docs: DataFrame, least: int = LEAST, gram: int = GRAM, with_text: bool = False, at: Layout | None = None) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept_sha256 and the removed spans (and ``kept`` with_text).

    A word goes if it stands in a passage of ``least`` words or more that also starts earlier: in a
    document of a smaller id, or earlier in its own. Null, empty and shorter texts lose nothing. Rows
    without an id sort before all others, and rows that share one are a document's versions, as in substring. An
    empty table gives no rows; other columns are ignored.
    """
    if not 0 < gram < least:
        raise ValueError("the first words must be fewer than those of a passage")
    docs = identified(docs)
    at = at or layout(docs)
    shared = neighbours(retain(docs, least, gram, at), at)
    return apply(docs, count(extend(docs, shared, least, gram, at), at), least, at, with_text)
