"""Substring dedup: Rabin-Karp hashes of every fixed-length token window, counted in Spark.

1. Scan. Every window of ``window`` words is hashed by a rolling polynomial. Windows gather in a
   worker up to ``FLUSH``; there, of windows with one hash only the first in (document, start) order
   goes on, all others are repeats already. This is the count's map side: a passage that a third of
   all documents share leaves each flush once.
2. Count. The survivors go, packed by bucket, to the reducers, which sort each bucket and keep the
   first of each hash over the whole table; the others are repeats.
3. Remove. Repeats go, packed by group of documents, to the texts, whose repeated windows merge into
   maximal intervals of removed words.

Nothing is collected, and no pairs are made: the rows of a bucket or a group are batches of numbers
whose count is at most the number of windows. A shuffle has at most ``MOST_PARTS`` partitions; beyond
that each holds several buckets, which are told apart after the shuffle and streamed in sorted order,
so a task's memory follows the bucket, at any size of the table. Windows count as equal if a 64-bit
hash, the partition, which comes from an independent hash, and as many further bytes of that hash
agree as keep the expected number of false repeats in the whole table under 1/1000 (see layout()).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.llm.arrowtext import BLOCK, NOT_SPACE, OTHER_BASE, Block, Words, blocks, planes, sha256, split, unplanes, window_hashes, windows_within, word_hashes
from docweave.plans.session import shuffle_partitions, size_in_bytes

#: Words of a window.
WINDOW = 20
#: Windows that a worker gathers before it packs them.
FLUSH = 1 << 20
#: Bytes of input a bucket and a group of documents are sized for.
BUCKET_BYTES = 8 << 20
#: Partitions of a shuffle at most.
MOST_PARTS = 1 << 15

U = np.uint64
#: Stands for a null id inside, along with a hash of the text; sorts before all others.
NO_ID = -(1 << 63)
#: The primes of XXH64.
PRIMES = (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)
PACKED = "part int, sub int, kind int, doc_id long, text string, h long, packed binary"
COLUMNS = ["part", "sub", "kind", "doc_id", "text", "h", "packed"]

#: (block, words, word hashes) to (first words of the windows, their hashes, their second hashes)
Windows = Callable[[Block, Words, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]


@dataclass(frozen=True)
class Layout:
    """Partitions of a shuffle, buckets (and groups of documents) in each, bytes of the second hash that a window carries."""

    parts: int
    within: int = 1
    extra: int = 0

    @property
    def groups(self) -> int:
        return self.parts * self.within


def layout(docs: DataFrame, most_parts: int = MOST_PARTS, bucket_bytes: int = BUCKET_BYTES) -> Layout:
    """A bucket for each ``bucket_bytes`` of input, or the session's number of partitions, whichever is more.

    Where the optimizer doesn't know the size, the texts' bytes are counted.
    """
    size = size_in_bytes(docs)
    if size >= 1 << 50:
        size = int(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    buckets = max(shuffle_partitions(docs.sparkSession), -(-size // bucket_bytes))
    parts = min(buckets, max(most_parts, 1))
    # of n windows, n * n / 2 pairs are equal by chance at 2 ** -(64 + log2(parts)); a quarter of the bytes stand for n
    bits = 2 * math.log2(max(size, 4) / 4) - 1 + 10 - 64 - math.log2(parts)
    return Layout(parts, -(-buckets // parts), min(8, max(0, math.ceil(bits / 8))))


def every_window(size: int) -> Windows:
    def of(block: Block, words: Words, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = windows_within(words, size)
        return at, window_hashes(hashes, size)[at], window_hashes(hashes, size, OTHER_BASE)[at]

    return of


def identified(docs: DataFrame) -> DataFrame:
    """doc_id, text and h: zero, but for a row without an id a negative hash of its text, which tells such rows apart."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.withColumn("h", F.when(F.col("doc_id").isNull(), F.xxhash64("text").bitwiseOR(F.lit(NO_ID))).otherwise(F.lit(0)).cast("long"))


def row_ids(batch: pa.RecordBatch) -> np.ndarray:
    """(id, h) of every row of identified(), ordered as numbers are: rows without an id first."""
    return np.stack((batch.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False), batch.column(2).to_numpy(zero_copy_only=False)), axis=1)


def in_order(docs: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.lexsort((starts, docs[:, 1], docs[:, 0]))


def span_of(docs: np.ndarray, doc: int | None, h: int) -> tuple[int, int]:
    """Where in sorted rows of (id, h) those of one row stand."""
    mine = NO_ID if doc is None else doc
    a, b = np.searchsorted(docs[:, 0], mine, "left"), np.searchsorted(docs[:, 0], mine, "right")
    return a + np.searchsorted(docs[a:b, 1], h, "left"), a + np.searchsorted(docs[a:b, 1], h, "right")


def of_row(at: Layout) -> list[Column]:
    """part and sub of a row of identified(), as group_of() has them."""
    group = F.pmod(F.xxhash64(F.when(F.col("h") != 0, F.col("h")).otherwise(F.col("doc_id"))), F.lit(at.groups))
    return [F.pmod(group, F.lit(at.parts)).cast("int").alias("part"), F.floor(group / at.parts).cast("int").alias("sub")]


def pack(docs: np.ndarray, starts: np.ndarray, keys: np.ndarray | None = None, second: np.ndarray | None = None, extra: int = 0) -> bytes:
    """Sorted (doc, start) pairs, and the hashes of each: documents, ids or rows of (id, h), once, differences in byte planes."""
    wide = docs.reshape(len(docs), -1)
    cut = np.flatnonzero(np.concatenate(([True], (wide[1:] != wide[:-1]).any(axis=1))))
    ids, counts = wide[cut], np.diff(np.append(cut, len(docs))).astype(np.uint32)
    steps = starts.astype(np.int64)
    steps[1:] -= starts[:-1]
    steps[cut] = starts[cut]
    jumps = ids.copy()
    jumps[1:] -= ids[:-1]
    head = np.array([len(ids), len(docs), docs.ndim, extra], np.int64).tobytes()
    out = head + b"".join(planes(np.ascontiguousarray(x)) for x in jumps.T) + planes(counts) + planes(steps.astype(np.uint32))
    if keys is not None:
        out += keys.tobytes() + (planes(second)[: extra * len(docs)] if extra else b"")
    return out


Windowed = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]


def unpack(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(documents, starts, hashes)."""
    return unpack_windows(raw)[:3]


def unpack_windows(raw: bytes) -> Windowed:
    """(documents, starts, hashes, what is carried of the second hashes if anything is)."""
    n_ids, n, width, extra = np.frombuffer(raw, np.int64, 4).tolist()
    at = 32
    ids = np.stack([np.cumsum(unplanes(raw[at + k * 8 * n_ids : at + (k + 1) * 8 * n_ids], np.int64)) for k in range(width)], axis=1)
    ids = ids if width > 1 else ids[:, 0]
    at += 8 * n_ids * width
    counts = unplanes(raw[at : at + 4 * n_ids], np.uint32).astype(np.int64)
    at += 4 * n_ids
    steps = unplanes(raw[at : at + 4 * n], np.uint32).astype(np.int64)
    at += 4 * n
    cut = np.cumsum(counts) - counts
    total = np.cumsum(steps)
    starts = total - np.repeat(total[cut] - steps[cut], counts) if n else total
    keys = np.frombuffer(raw, U, n if at < len(raw) else 0, at)
    second = unplanes(raw[at + 8 * n :] + bytes((8 - extra) * n), U) if extra and len(keys) else None
    return np.repeat(ids, counts, axis=0), starts, keys, second


def joined(held: list[Windowed]) -> Windowed:
    """All of these in (document, start) order."""
    ids, starts, keys = (np.concatenate(x) for x in list(zip(*held, strict=True))[:3])
    second = np.concatenate([x[3] for x in held]) if held[0][3] is not None else None
    held.clear()
    order = in_order(ids, starts)
    return ids[order], starts[order], keys[order] if len(keys) else keys, None if second is None else second[order]


def repeats_of(docs: np.ndarray, starts: np.ndarray, keys: np.ndarray, second: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of the first window of each key, and of those that come later. Input sorted by (doc, start)."""
    order = np.argsort(keys, kind="stable") if second is None else np.lexsort((second, keys))
    sorted_keys = keys[order]
    head = np.ones(len(order), bool)
    head[1:] = sorted_keys[1:] != sorted_keys[:-1]
    if second is not None:
        head[1:] |= second[order][1:] != second[order][:-1]
    firsts = order[head]
    owner = firsts[np.cumsum(head) - 1]
    same = (docs[order] == docs[owner]).all(axis=1) & (starts[order] == starts[owner])  # rows of one id, at one place
    return np.sort(order[head | same]), np.sort(order[~(head | same)])


def group_of(docs: np.ndarray, groups: int) -> np.ndarray:
    """The group of documents that an id belongs to: pmod(xxhash64(id), groups), as Spark has it; h stands for the id where it isn't zero."""
    if docs.ndim > 1:
        docs = np.where(docs[:, 1] != 0, docs[:, 1], docs[:, 0])
    turn = lambda x, k: (x << U(k)) | (x >> U(64 - k))
    p1, p2, p3, p4, p5 = (U(x) for x in PRIMES)
    h = (U(42) + p5 + U(8)) ^ (turn(docs.view(U) * p2, 31) * p1)
    h = turn(h, 27) * p1 + p4
    h = (h ^ (h >> U(33))) * p2
    h = (h ^ (h >> U(29))) * p3
    h ^= h >> U(32)
    return (h.view(np.int64) % groups).astype(np.int32)


def packed_rows(part: np.ndarray, kind: int, docs: np.ndarray, starts: np.ndarray, keys: np.ndarray | None = None, second: np.ndarray | None = None, extra: int = 0, within: int | None = None) -> Iterator[pa.RecordBatch]:
    """One row for each part with its pairs, in batches; the pairs come sorted and stay so. ``within`` a part, ``part`` is the sub."""
    if not len(part):
        return
    order = np.argsort(part, kind="stable")
    part = part[order]
    cuts = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
    ends = np.append(cuts[1:], len(part))
    names, rows, size = [], [], 0
    for a, b in zip(cuts.tolist(), ends.tolist(), strict=True):
        pick = order[a:b]
        names.append(int(part[a]))
        rows.append(pack(docs[pick], starts[pick], None if keys is None else keys[pick], None if second is None else second[pick], extra))
        size += len(rows[-1])
        if len(rows) == 512 or size > BLOCK:
            yield batch_of(names, kind, rows, within)
            names, rows, size = [], [], 0
    if rows:
        yield batch_of(names, kind, rows, within)


def batch_of(parts: list[int], kind: int, rows: list[bytes], within: int | None = None) -> pa.RecordBatch:
    n = len(rows)
    part, sub = (parts, [0] * n) if within is None else ([within] * n, parts)
    return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(sub, pa.int32()), pa.array([kind] * n, pa.int32()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.string()), pa.nulls(n, pa.int64()), pa.array(rows, pa.binary())], COLUMNS)


def counted(held: list[Windowed], at: Layout) -> Iterator[pa.RecordBatch]:
    """Of gathered windows with both whole hashes: kind 0, the first of each, by bucket; kind 1, the others, by group of documents."""
    ids, starts, keys, other = joined(held)
    first, later = repeats_of(ids, starts, keys, other if at.extra else None)
    yield from packed_rows((other[first] % U(at.parts)).astype(np.int32), 0, ids[first], starts[first], keys[first], other[first], at.extra)
    yield from packed_rows(group_of(ids[later], at.groups) % at.parts, 1, ids[later], starts[later])


def scan(docs: DataFrame, windows: Windows, at: Layout) -> DataFrame:
    """Kind 0: windows to count, by bucket; kind 1: repeats found within a flush, by group of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            ids = row_ids(batch)
            for block in blocks(batch.column(1)):
                words = split(block)
                if not len(words.starts):
                    continue
                first, keys, other = windows(block, words, word_hashes(block.data, words))
                row = np.searchsorted(words.first, first, "right") - 1
                held.append((ids[block.lo + row], first - words.first[row], keys, other))
                n += len(first)
                if n >= FLUSH:
                    yield from counted(held, at)
                    held, n = [], 0
        if n:
            yield from counted(held, at)

    return docs.mapInArrow(run, PACKED)


def dealt(rows: DataFrame, at: Layout, kind: int, order: list[str]) -> DataFrame:
    """Rows by part, sorted; where parts hold several buckets, rows of ``kind`` are told apart by them first."""

    def fine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Windowed] = []
        n = part = 0

        def flush() -> Iterator[pa.RecordBatch]:
            ids, starts, keys, second = joined(held)
            if kind:
                yield from packed_rows(group_of(ids, at.groups) // at.parts, kind, ids, starts, within=part)
            else:
                yield from packed_rows(((keys >> U(20)) % U(at.within)).astype(np.int32), kind, ids, starts, keys, second, 0 if second is None else at.extra, within=part)

        for batch in batches:
            mine = batch.column(2).to_numpy() == kind
            yield batch.filter(pa.array(~mine))
            for i in np.flatnonzero(mine).tolist():
                if held and part != batch.column(0)[i].as_py():  # a task may have several parts
                    yield from flush()
                    n = 0
                part = batch.column(0)[i].as_py()
                held.append(unpack_windows(batch.column(6)[i].as_buffer().to_pybytes()))
                n += len(held[-1][1])
                if n >= FLUSH:
                    yield from flush()
                    n = 0
        if held:
            yield from flush()

    rows = rows.repartitionById(at.parts, "part")
    if at.within > 1:
        rows = rows.mapInArrow(fine, PACKED)
    return rows.sortWithinPartitions(*order) if order else rows


def solved(rows: DataFrame, at: Layout, solve: Callable[[list[Windowed]], Iterator[pa.RecordBatch]]) -> DataFrame:
    """``solve`` on every bucket of kind 0, one after the other in a task; kind 1 passes through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Windowed] = []
        now = None
        for batch in batches:
            kinds, subs, parts, raw = batch.column(2).to_numpy(), batch.column(1).to_numpy(), batch.column(0).to_numpy(), batch.column(6)
            for i in range(batch.num_rows):
                body = raw[i].as_buffer().to_pybytes()
                if kinds[i] == 1:
                    yield batch_of([int(parts[i])], 1, [body])
                    continue
                if (parts[i], subs[i]) != now and held:
                    yield from solve(held)
                now = (parts[i], subs[i])
                held.append(unpack_windows(body))
        if held:
            yield from solve(held)

    return dealt(rows, at, 0, ["part", "sub"] if at.within > 1 else []).mapInArrow(run, PACKED)


def count(packed: DataFrame, at: Layout) -> DataFrame:
    """Repeats over the whole table: kind 1, by group of documents; those found already pass through."""

    def solve(held: list[Windowed]) -> Iterator[pa.RecordBatch]:
        ids, starts, keys, second = joined(held)
        _, later = repeats_of(ids, starts, keys, second)
        yield from packed_rows(group_of(ids[later], at.groups) % at.parts, 1, ids[later], starts[later])

    return solved(packed, at, solve)


def covered(n_words: int, starts: np.ndarray, size: int) -> np.ndarray:
    """Which words the windows at these starts cover: overlapping windows merge into maximal intervals."""
    marks = np.zeros(n_words + 1, np.int32)
    starts = starts[starts + size <= n_words]
    np.add.at(marks, starts, 1)
    np.add.at(marks, starts + size, -1)
    return np.cumsum(marks[:-1]) > 0


def spans(mask: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate(([0], mask.astype(np.int8), [0]))))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def apply(docs: DataFrame, repeats: DataFrame, size: int, at: Layout, with_text: bool) -> DataFrame:
    """The documents without the words of their repeats. Of each group its repeats come first, then its texts in a stream."""
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string, spans array<struct<start:int,end:int>>" + (", kept string" if with_text else "")
    names = ["doc_id", "n_words", "n_removed", "kept_sha256", "spans"] + ["kept"] * with_text
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, ids, starts = [], np.zeros((0, 2), np.int64), np.zeros(0, np.int64)
        for batch in batches:
            kinds_, doc, text, hs, raw = batch.column(2).to_pylist(), batch.column(3), batch.column(4), batch.column(5).to_pylist(), batch.column(6)
            rows: list[tuple] = []
            for i, kind in enumerate(kinds_):
                if kind == 1:
                    held.append(unpack_windows(raw[i].as_buffer().to_pybytes()))
                    continue
                if held:
                    ids, starts, _, _ = joined(held)
                key = doc[i].as_py()
                body = text[i].as_buffer()
                a, b = span_of(ids, key, hs[i])
                n, mask, left = without(b"" if body is None else body.to_pybytes(), starts[a:b], size)
                rows.append((key, n, int(mask.sum()), sha256(left), [{"start": x, "end": y} for x, y in spans(mask)], left.decode("utf-8", "replace") if with_text else None))
            if rows:
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(columns[k], kinds[k]) for k in range(len(names))], names)

    return dealt(repeats.unionByName(texts_of(docs, at)), at, 1, ["part", "sub", "kind"]).mapInArrow(run, schema)


def texts_of(docs: DataFrame, at: Layout) -> DataFrame:
    """Kind 2: the texts, by group of documents."""
    return docs.select(*of_row(at), F.lit(2).alias("kind"), "doc_id", "text", "h", F.lit(None).cast("binary").alias("packed"))


def without(body: bytes, starts: np.ndarray, size: int) -> tuple[int, np.ndarray, bytes]:
    """(number of words, which go, the others joined by one space); a long text's words are never listed one by one."""
    if len(body) <= BLOCK:
        words = body.split()
        mask = covered(len(words), starts, size) if len(starts) else np.zeros(len(words), bool)
        return len(words), mask, b" ".join(words if not len(starts) else [w for w, m in zip(words, mask.tolist(), strict=True) if not m])
    data = np.frombuffer(body, np.uint8)
    words = split(Block(0, 1, data, np.array([0, len(data)])))
    mask = covered(len(words.starts), starts, size)
    # each word that stays is copied with the byte after it, which becomes a space
    shown = NOT_SPACE[data]
    for a, b in spans(mask):
        shown[words.starts[a] : words.ends[b - 1]] = False
    after = words.ends[~mask]
    after = after[after < len(data)]
    shown[after] = True
    data = data.copy()
    data[after] = 32
    return len(mask), mask, data[shown].tobytes().removesuffix(b" ")


def dedup(docs: DataFrame, window: int = WINDOW, with_text: bool = False, windows: Windows | None = None, at: Layout | None = None) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept_sha256 and the removed spans (and ``kept`` with_text).

    A word goes if a window over it has a word sequence that also starts earlier: in a document of a
    smaller id, or earlier in its own. Windows are judged on the input. Null and empty texts have no
    words. Rows without an id sort before all others, by a hash of the text, and each loses its own
    repeats alone; exact copies without an id are as rows that share one. Rows that share an id are one document's versions: at
    one place neither is earlier, so exact repeats of a row stay both; what a start loses it loses in
    each version that reaches it. An empty table gives no rows; other columns are ignored.
    """
    docs = identified(docs)
    at = at or layout(docs)
    return apply(docs, count(scan(docs, windows or every_window(window), at), at), window, at, with_text)
