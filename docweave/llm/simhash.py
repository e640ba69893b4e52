"""SimHash near-duplicates through distributed vantage-point trees.

1. Fingerprints: each text's word shingles vote, bit by bit, with their XXH64.
2. Equal fingerprints are merged; what follows works on distinct fingerprints, however many copies.
3. A vantage-point tree is built on a bounded sample: each node splits at the median Hamming distance
   to its vantage point. Every fingerprint has one home leaf, its shard. It also visits, as a query,
   every other leaf that the triangle inequality can't rule out within the link distance: those beyond
   a boundary that the ball around it overlaps. A pair on two sides of a boundary is found from the
   near side alone, so only those visits are made that go from near to far. The tree has at most
   ``MOST_SHARDS`` leaves, since visits grow with its depth (eight a fingerprint at 64). A shard with
   more points than one search should have is dealt over cells: two fingerprints within 3 bits agree
   in one of four blocks of 16, so each point goes to one cell for each block, by as many of its bits
   as the shard's load asks for. So a fingerprint has some thirty copies at most, at any size.
4. Each shard, or cell, searches its own vantage-point tree, exactly, and gives back a spanning forest of the
   links it found: fewer rows than points, however dense the links are.
5. Connected components over these forests; the least document id names the component.

Groups of near copies, for a corpus pipeline, take these steps at 3 of 64 bits, and 4 again at 75 of 256,
a distance so wide that the top tree is one leaf: see near_copies().
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from docweave.llm.arrowtext import LOWER, Block, blocks, mix, split, window_hashes, word_hashes
from docweave.llm.components import components
from docweave.plans.session import checkpoint, forget, shuffle_partitions

#: Words of a shingle, bits that may differ.
SHINGLE, DISTANCE = 3, 3
#: Fingerprints that the top tree is built on, for each shard.
SAMPLE_PER_SHARD = 512
#: Distinct fingerprints at home in a shard, about; most shards. Both are powers of two.
SHARD_SIZE, MOST_SHARDS = 4096, 64
#: Visits that one task is sent, about.
TASK_VISITS = 1 << 22
#: Points of a leaf of a shard's own tree.
LEAF = 256

U = np.uint64


def signature(text: bytes, size: int, n_words: int) -> list[int]:
    """The SimHash, and further words of 64 bits that vote with bijections of the same shingle hashes."""
    words = text.lower().split()
    if not words:
        return [0] * n_words
    joined = b" ".join(words)
    h64 = xxhash.xxh64_intdigest
    m = min(size, len(words))
    ends = []
    at = -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    begins = [0, *(e + 1 for e in ends[: len(ends) - m])]
    hashes = np.array([h64(joined[a:b], 42) for a, b in zip(begins, ends[m - 1 :], strict=True)], U)
    n = len(hashes)
    out = []
    for k in range(n_words):
        h = mix(hashes + U(k * 0x9E3779B97F4A7C15 % (1 << 64))) if k else hashes
        votes = np.zeros(64, np.int64)
        for lo in range(0, n, 8192):
            votes += np.unpackbits(h[lo : lo + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out.append(int(np.packbits(2 * votes > n, bitorder="little").view(U)[0]))
    return out


def fingerprint(text: bytes, size: int = SHINGLE) -> int:
    """SimHash of a text: A-Z lower-cased, words between ASCII white space, shingles of ``size`` words.

    Fewer words make one shingle; no words make fingerprint zero. A bit is set if over half are.
    """
    return signature(text, size, 1)[0]


def fingerprints(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """doc_id and fp (the 64 bits as a long) of every row; a null text is an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(1)):
                fps = np.array([fingerprint(block.text(i), size) for i in range(block.hi - block.lo)], U)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(block.lo, block.hi - block.lo), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


def apart(a: np.ndarray, b: np.ndarray | np.uint64) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def _differ(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bits that differ between fingerprints of one word or several, which are the last axis."""
    bits = apart(a[..., 0], b[..., 0])
    if a.shape[-1] > 1:
        bits = bits.astype(np.int16)
        for k in range(1, a.shape[-1]):
            bits += apart(a[..., k], b[..., k])
    return bits


class Top:
    """The tree over shards, as arrays: node i splits at distance ``cut[i]`` from ``point[i]``.

    Children are 2 i + 1 (near, distance up to the cut) and 2 i + 2; leaves are the shards.
    """

    def __init__(self, sample: np.ndarray, depth: int):
        self.depth = depth
        self.point = np.zeros((1 << depth) - 1, U)
        self.cut = np.zeros((1 << depth) - 1, np.int64)
        rng = np.random.default_rng(7)
        parts = {0: np.sort(sample)}
        for i in range((1 << depth) - 1):
            part = parts.pop(i)
            if len(part):
                tried = part[rng.integers(0, len(part), min(8, len(part)))]
                inside = [apart(part, v) for v in tried]
                # the cut nearest to the middle whose boundary the fewest points lie near
                best = min(range(len(tried)), key=lambda k: self._near(inside[k]))
                self.point[i], d = tried[best], inside[best]
                self.cut[i] = self._cut(d)
                parts[2 * i + 1], parts[2 * i + 2] = part[d <= self.cut[i]], part[d > self.cut[i]]
            else:
                parts[2 * i + 1] = parts[2 * i + 2] = part

    @staticmethod
    def _cut(d: np.ndarray) -> int:
        return int(np.sort(d)[(len(d) - 1) // 2])

    def _near(self, d: np.ndarray) -> float:
        cut = self._cut(d)
        share = np.mean(d <= cut)
        return float(np.mean(np.abs(d - cut - 0.5) < DISTANCE + 0.5)) + 4 * abs(share - 0.5)

    def visits(self, fps: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index, shard, 1 if at home there, else 0) of every shard that each fingerprint must see."""
        index = np.arange(len(fps))
        node = np.zeros(len(fps), np.int64)
        home = np.ones(len(fps), bool)
        for _ in range(self.depth):
            d = apart(fps[index], self.point[node]).astype(np.int64)
            near = d <= self.cut[node]
            own = np.where(near, 2 * node + 1, 2 * node + 2)
            # at home only near points cross, so that a pair is met once; a visitor goes wherever the ball reaches
            cross = np.where(near, d + reach > self.cut[node], (d - reach <= self.cut[node]) & ~home)
            far = np.where(near, 2 * node + 2, 2 * node + 1)
            index = np.concatenate((index, index[cross]))
            node = np.concatenate((own, far[cross]))
            home = np.concatenate((home, np.zeros(int(cross.sum()), bool)))
        return index, node - ((1 << self.depth) - 1), home.astype(np.int8)


class Forest:
    """Union-find over the points of a shard."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        """Joins a[i] and b[i] for all i: least labels spread until nothing changes."""
        label = self.label
        while True:
            x, y = label[a], label[b]
            apart_ = x != y
            if not apart_.any():
                return
            x, y, a, b = x[apart_], y[apart_], a[apart_], b[apart_]
            np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
            while True:  # every label points at a root
                up = label[label]
                if (up == label).all():
                    break
                label[:] = up


def _cheapest(inner: np.ndarray, outer: np.ndarray, reach: int) -> tuple[int, int]:
    """(pairs left to compare at most, cut) of the split at which they are fewest, by distances to a vantage point."""
    most = int(max(inner.max(), outer.max()))
    i, o = (np.cumsum(np.bincount(d, minlength=most + 1)) for d in (inner, outer))
    cut = np.arange(most + 1)
    near, below = i * o[np.minimum(cut + reach, most)], np.where(cut >= reach, o[np.maximum(cut - reach, 0)], 0)
    left = np.where((i > 0) & (i < i[-1]), near + (i[-1] - i) * (o[-1] - np.maximum(below, i)), i[-1] * o[-1])
    best = int(left.argmin())
    return int(left[best]), best


def search(home: np.ndarray, guests: np.ndarray, reach: int) -> np.ndarray:
    """Labels over home then guests: equal for points of one component of the links met here.

    Met are all links between two points at home and between a guest and a point at home. Guests that
    only meet through a third shard are joined there. Fingerprints are numbers, or rows of several. A node
    splits numbers at the median distance. Rows, whose reach is wide, it splits where the fewest pairs are
    left, unless every cut spares fewer than are spent on looking for it.
    """
    fps = np.concatenate((home, guests))
    wide = fps.ndim > 1
    fps = fps.reshape(len(fps), -1)
    forest = Forest(len(fps))
    rng = np.random.default_rng(11)
    met = np.zeros(len(fps), bool)
    most = (1024, 2048) if not wide else (256, 1024)
    stack = [(np.arange(len(home)), np.arange(len(fps)))]
    while stack:
        inner, outer = stack.pop()  # every pair of one of inner, at home, and one of outer
        if not len(inner) or not len(outer):
            continue
        labels = forest.label
        if (labels[inner] == labels[inner[0]]).all():
            outer = outer[labels[outer] != labels[inner[0]]]  # all else are joined to all of inner already
            if not len(outer):
                continue
        if len(inner) > (COPY_LEAF if wide else LEAF):
            tried = []
            for _ in range(TRIED if wide else 1):
                point = fps[inner[rng.integers(0, len(inner))]]
                tried.append((_differ(fps[inner], point).astype(np.int64), _differ(fps[outer], point).astype(np.int64)))
            if wide:
                di, do = min(tried, key=lambda t: _cheapest(*t, reach))
                left, cut = _cheapest(di, do, reach)
                if left + 2 * TRIED * (len(inner) + len(outer)) > len(inner) * len(outer):
                    cut = -1
            else:
                di, do = tried[0]
                cut = int(np.sort(di)[(len(di) - 1) // 2])
                if not (di > cut).any():
                    cut -= 1
            if cut >= 0 and (di <= cut).any():
                beyond, within = outer[do + reach > cut], inner[di <= cut]
                if wide:  # what lies within meets these from its own side
                    met[within] = True
                    beyond = beyond[~met[beyond]]
                    met[within] = False
                stack.append((inner[di > cut], beyond))
                stack.append((within, outer[do - reach <= cut]))
                continue
        for lo in range(0, len(outer), most[1]):
            part = outer[lo : lo + most[1]]
            for at in range(0, len(inner), most[0]):
                some, others = inner[at : at + most[0]], part
                if (forest.label[some] == forest.label[some[0]]).all():
                    others = part[forest.label[part] != forest.label[some[0]]]
                i, j = np.nonzero(_differ(fps[some][:, None], fps[others][None, :]) <= reach)
                forest.link(some[i], others[j])
    return forest.label


def _cells(top: Top, bits: np.ndarray, fps: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cell, fingerprint, 1 if at home there else 0) of every visit.

    A shard's points stand in one cell, or if it has bits, in one for each of reach + 1 blocks, chosen by
    that many bits of the block: points within reach agree in all bits of some block.
    """
    index, shard, home = top.visits(fps, reach)
    points = fps[index]
    cell = shard.astype(U) << U(32)
    many = np.flatnonzero(bits[shard] > 0)
    if not len(many):
        return cell, points, home
    width = 64 // (reach + 1)
    few = np.flatnonzero(bits[shard] == 0)
    out = [(cell[few], points[few], home[few])]
    mask = (U(1) << bits[shard[many]].astype(U)) - U(1)
    for j in range(reach + 1):
        block = points[many] >> U(j * width) & mask
        out.append((cell[many] | U(j + 1) << U(24) | block, points[many], home[many]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _send(fps: DataFrame, top: Top, reach: int, bits: np.ndarray, parts: int) -> DataFrame:
    """Every visit, packed: (part, cells, fingerprints and whether they are at home)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_ = batch.column(0).to_numpy().view(U)
            for lo in range(0, len(all_), 1 << 14):
                cell, points, home = _cells(top, bits, all_[lo : lo + (1 << 14)], reach)
                part = (mix(cell) % U(parts)).astype(np.int64)
                order = np.argsort(part, kind="stable")
                part, cell, points, home = part[order], cell[order], points[order], home[order]
                cut = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
                ends = np.append(cut[1:], len(part))
                rows = [cell[a:b].tobytes() + points[a:b].tobytes() + home[a:b].tobytes() for a, b in zip(cut.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(part[cut], pa.int32()), pa.array(rows, pa.binary())], ["part", "packed"])

    return fps.select("fp").mapInArrow(run, "part int, packed binary")


def links(fps: DataFrame, reach: int = DISTANCE, shard_size: int = SHARD_SIZE, most_shards: int = MOST_SHARDS) -> DataFrame:
    """(a, b) edges over distinct fingerprints whose components are those of all pairs within ``reach``."""
    spark = fps.sparkSession
    n = fps.count()
    depth = 0
    while (1 << depth) < most_shards and (n >> depth) > shard_size:
        depth += 1
    asked = SAMPLE_PER_SHARD << depth
    sample = fps.select("fp").where(F.pmod(F.xxhash64("fp"), F.lit(1 << 30)) < int(min(1.0, asked / max(n, 1)) * (1 << 30))).limit(2 * asked) if n > asked else fps.select("fp")
    top = Top(np.array([r[0] for r in sample.collect()], np.int64).view(U), depth)  # bounded by 2 * SAMPLE_PER_SHARD * MOST_SHARDS
    load = np.zeros(1 << depth, np.int64)
    for shard, _, total in _loads(fps, top, reach):  # 2 rows a shard, a bounded number
        load[shard] += total
    bits = np.ceil(np.log2(np.maximum(load / (2 * shard_size), 1))).astype(np.int64).clip(0, 64 // (reach + 1))
    bits[load <= 4 * shard_size] = 0
    visits = int((load * np.where(bits > 0, reach + 1, 1)).sum())
    parts = max(shuffle_partitions(spark), -(-visits // TASK_VISITS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            for raw in batch.column(1).to_pylist():
                k = len(raw) // 17
                held.append((np.frombuffer(raw, U, k), np.frombuffer(raw, U, k, 8 * k), np.frombuffer(raw, np.int8, k, 16 * k)))
        if not held:
            return
        cell, points, home = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        order = np.lexsort((home, cell))
        cell, points, home = cell[order], points[order], home[order]
        cut = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))
        found: list[np.ndarray] = []
        size = 0
        for a, b in zip(cut.tolist(), np.append(cut[1:], len(cell)).tolist(), strict=True):
            guests = int(b - a - home[a:b].sum())
            if guests == b - a or b - a == 1:
                continue  # nobody at home, or alone
            found.append(_forest(points[a + guests : b], points[a : a + guests], reach))
            size += len(found[-1])
            if size > 1 << 16:
                yield _edges(found)
                found, size = [], 0
        if found:
            yield _edges(found)

    return _send(fps, top, reach, bits, parts).repartitionById(parts, "part").mapInArrow(run, "a long, b long")


def _loads(fps: DataFrame, top: Top, reach: int) -> list:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, 1 << top.depth), np.int64)
        for batch in batches:
            all_ = batch.column(0).to_numpy().view(U)
            for lo in range(0, len(all_), 1 << 14):
                _, shard, home = top.visits(all_[lo : lo + (1 << 14)], reach)
                for k in (0, 1):
                    sums[k] += np.bincount(shard[home == k], minlength=1 << top.depth)
        home, shard = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), pa.array(home, pa.int32()), pa.array(sums[home, shard])], ["shard", "home", "n"])

    return fps.select("fp").mapInArrow(run, "shard int, home int, n long").groupBy("shard", "home").agg(F.sum("n")).collect()


def _forest(home: np.ndarray, guests: np.ndarray, reach: int) -> np.ndarray:
    """(a, b) of a spanning forest of the links that a cell finds."""
    labels = search(home, guests, reach)
    fps = np.concatenate((home, guests))
    joined = np.flatnonzero(labels != np.arange(len(labels)))
    return np.stack((fps[joined], fps[labels[joined]]), axis=1)


def _edges(found: list[np.ndarray]) -> pa.RecordBatch:
    both = np.unique(np.concatenate(found), axis=0).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(both[:, k])) for k in (0, 1)], ["a", "b"])


# --- groups of near copies, for a corpus pipeline ---

#: Near copies are texts whose sets of five-word shingles have a Jaccard coefficient of 4/5 or more.
COPY_SHINGLE, COPY_LIKE = 5, (4, 5)
#: Candidates differ in so many of 256 bits at most. At 0.8 it is 38 on average with a deviation of 6.
COPY_WORDS, COPY_DISTANCE = 4, 75
#: Points of a leaf of a cell's tree, and vantage points that a node of it chooses from.
COPY_LEAF, TRIED = 32, 4
#: Cells that a fingerprint is dealt to, one for each band of least hashes: a pair at 0.8 shares none with
#: a chance of (1 - 0.8 ** 4) ** 32 = 5e-8, whatever else the table holds.
BANDS, BAND = 32, 4
#: Texts that one task compares with each other, or with as many more.
TEXTS = 1024

_RNG = np.random.default_rng(23)
_XOR, _ODD = (_RNG.integers(0, 1 << 64, BANDS * BAND, dtype=U) for _ in range(2))
_ODD |= U(1)


def _shingles(block: Block, size: int) -> list[np.ndarray]:
    """Each row's set of shingles as sorted hashes; fewer words make one shingle, no words none."""
    block = Block(block.lo, block.hi, LOWER[block.data], block.offsets)
    words = split(block)
    hashes = word_hashes(block.data, words) if len(words.starts) else np.zeros(0, U)
    grams = window_hashes(hashes, size)
    out = []
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        out.append(np.unique(grams[a : b - size + 1]) if b - a >= size else window_hashes(hashes[a:b], b - a) if b > a else hashes[a:b])
    return out


def _sketch(grams: np.ndarray) -> np.ndarray:
    """The SimHash of a set of shingles in COPY_WORDS numbers, then the keys of its bands; none of an empty set."""
    if not len(grams):
        return np.zeros(COPY_WORDS, U)
    out = []
    for k in range(COPY_WORDS):
        h = mix(grams + U(k * 0x9E3779B97F4A7C15 % (1 << 64)))
        votes = np.zeros(64, np.int64)
        for lo in range(0, len(h), 8192):
            votes += np.unpackbits(h[lo : lo + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out.append(np.packbits(2 * votes > len(h), bitorder="little").view(U))
    least = np.full(BANDS * BAND, ~U(0), U)
    for lo in range(0, len(grams), 4096):
        least = np.minimum(least, ((grams[lo : lo + 4096, None] ^ _XOR) * _ODD).min(axis=0))
    keys = mix((mix(least).reshape(BANDS, BAND) * _ODD[:BAND]).sum(axis=1, dtype=U) + np.arange(BANDS, dtype=U))
    return np.concatenate((*out, keys))


def _described(docs: DataFrame, size: int) -> DataFrame:
    """Of every row the id, a hash of the text, fp (a hash of the set of shingles), the sketch and its first word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(2)):
                n = block.hi - block.lo
                sets = _shingles(block, size)
                fps = np.array([xxhash.xxh64_intdigest(x.tobytes()) for x in sets], U).view(np.int64)
                sketches = [_sketch(x) for x in sets]
                words = np.array([x[0] for x in sketches], U).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(block.lo, n), batch.column(1).slice(block.lo, n), pa.array(fps), pa.array(words), pa.array([x.tobytes() for x in sketches], pa.binary())], ["doc_id", "h", "fp", "word", "sketch"])

    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), text.alias("text")).mapInArrow(run, "doc_id long, h long, fp long, word long, sketch binary")


def _candidates(points: DataFrame, reach: int) -> DataFrame:
    """(a, b) edges over the first words of the sketches, which join those of all candidates.

    links() finds the first words within its own distance. For what lies further apart, points stand in
    one cell for each band, at home in all. Each cell searches a vantage-point tree of its own over all
    256 bits and gives back a forest of the pairs within ``reach``.
    """
    parts = 4 * shuffle_partitions(points.sparkSession)
    words = checkpoint(points.select(F.col("word").alias("fp")).distinct())

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = [x for x in batch.column(0).to_pylist() if len(x) > 8 * COPY_WORDS]
            if not some:
                continue
            all_ = np.frombuffer(b"".join(some), U).reshape(len(some), COPY_WORDS + BANDS)
            rows = np.empty((len(some), BANDS, 1 + COPY_WORDS), U)
            rows[:, :, 0], rows[:, :, 1:] = all_[:, COPY_WORDS:], all_[:, None, :COPY_WORDS]
            rows = rows.reshape(-1, 1 + COPY_WORDS)
            part = (rows[:, 0] >> U(20)) % U(parts)
            order = np.argsort(part, kind="stable")
            rows, part = rows[order], part[order]
            cut = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
            ends = np.append(cut[1:], len(part))
            yield pa.RecordBatch.from_arrays([pa.array(part[cut].astype(np.int32)), pa.array([rows[x:y].tobytes() for x, y in zip(cut.tolist(), ends.tolist(), strict=True)], pa.binary())], ["part", "packed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [x for batch in batches for x in batch.column(1).to_pylist()]
        if not held:
            return
        rows = np.frombuffer(b"".join(held), U).reshape(-1, 1 + COPY_WORDS)
        del held
        order = np.argsort(rows[:, 0], kind="stable")
        keys = rows[order, 0]
        cut = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        sizes = np.diff(np.append(cut, len(keys)))
        two = cut[sizes == 2]
        x, y = order[two], order[two + 1]
        near = _differ(rows[x, 1:], rows[y, 1:]) <= reach  # a tree of two points
        pairs = [(x[near], y[near])]
        for at, n in zip(cut[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
            cell = order[at : at + n]
            labels = search(rows[cell, 1:], np.zeros((0, COPY_WORDS), U), reach)
            joined = np.flatnonzero(labels != np.arange(n))
            pairs.append((cell[joined], cell[labels[joined]]))
        a, b = (rows[np.concatenate(z), 1] for z in zip(*pairs, strict=True))
        a, b = a[a != b], b[a != b]
        found = np.unique(np.stack((np.minimum(a, b), np.maximum(a, b)), axis=1), axis=0).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(found[:, 0])), pa.array(np.ascontiguousarray(found[:, 1]))], ["a", "b"])

    cells = points.select("sketch").mapInArrow(send, "part int, packed binary").repartitionById(parts, "part").mapInArrow(run, "a long, b long")
    return links(words).union(cells)


def _alike(sets: list[np.ndarray], bits: np.ndarray, reach: int) -> tuple[list[int], list[int]]:
    """A spanning forest of the pairs of near copies, each told by its exact coefficient."""
    up, down = COPY_LIKE
    n = np.array([len(x) for x in sets], np.int64)
    label = np.arange(len(sets))
    a, b = [], []
    for i in range(len(sets) - 1):
        later = np.arange(i + 1, len(sets))
        later = later[label[later] != label[i]]
        later = later[(down * np.minimum(n[later], n[i]) >= up * np.maximum(n[later], n[i])) & (n[later] > 0)]
        later = later[apart(bits[later], bits[i]).sum(axis=1) <= reach]
        for lo in range(0, len(later), 64):
            some = later[lo : lo + 64]
            some = some[label[some] != label[i]]
            if not len(some):
                continue
            grams = np.concatenate([sets[j] for j in some.tolist()])
            place = np.minimum(np.searchsorted(sets[i], grams), n[i] - 1)
            both = np.add.reduceat((sets[i][place] == grams).astype(np.int64), np.cumsum(n[some]) - n[some])
            for j in some[down * both >= up * (n[some] + n[i] - both)].tolist():
                if label[j] != label[i]:
                    a.append(i)
                    b.append(j)
                    label[label == label[j]] = label[i]
    return a, b


def _verified(docs: DataFrame, points: DataFrame, wide: DataFrame, reach: int, size: int, texts: int = TEXTS) -> DataFrame:
    """(a, b) edges whose components are those of all near copies within the components ``wide`` (node, root).

    Up to ``texts`` of a component are compared in one task. In a larger component all are first held
    against some of them, in rounds; what that doesn't join to its largest part is then compared, block
    by block, with all others. Pairs within that part needn't be looked at.
    """
    total = wide.groupBy("root").agg(F.count("*").alias("total")).where("total > 1")
    members = wide.join(total, "root").join(points, F.col("node") == points.fp).select("fp", "root", "total", "least.*")
    id_, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    rows = docs.select(id_.isNull().alias("none"), F.coalesce(id_, F.lit(0)).alias("id"), F.xxhash64(text).alias("h"), text.alias("text"))
    # written: texts of groups alone, read up to three times
    members = checkpoint(rows.join(members, ["none", "id", "h"]).select("fp", "root", "total", "text"))

    def solve(fps: list[int], bodies: pa.Array) -> pa.RecordBatch:
        sets = [x for block in blocks(bodies) for x in _shingles(block, size)]
        _, once = np.unique(np.array(fps, np.int64), return_index=True)
        sets, fps = [sets[i] for i in once], [fps[i] for i in once]
        bits = np.array([_sketch(x)[:COPY_WORDS] for x in sets], U)
        a, b = _alike(sets, bits, reach)
        return pa.RecordBatch.from_arrays([pa.array([fps[i] for i in a], pa.int64()), pa.array([fps[i] for i in b], pa.int64())], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, fps, bodies = None, [], []
        for batch in batches:
            names = list(zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True))
            ids, column = batch.column(3).to_pylist(), batch.column(4)
            lo = 0
            for i in range(1, len(names) + 1):
                if i < len(names) and names[i] == names[lo]:
                    continue
                if names[lo] != now:
                    if len(fps) > 1:
                        yield solve(fps, pa.concat_arrays(bodies))
                    now, fps, bodies = names[lo], [], []
                fps += ids[lo:i]
                bodies.append(column.slice(lo, i - lo))
                lo = i
        if len(fps) > 1:
            yield solve(fps, pa.concat_arrays(bodies))

    def compared(dealt: DataFrame) -> DataFrame:
        dealt = dealt.select("root", "i", "j", "fp", "text").repartition(4 * shuffle_partitions(docs.sparkSession), "root", "i", "j")
        return dealt.sortWithinPartitions("root", "i", "j").mapInArrow(run, "a long, b long")

    zero = F.lit(0).cast("long")
    found = checkpoint(compared(members.where(F.col("total") <= texts).select("*", zero.alias("i"), zero.alias("j"))))
    large = members.where(F.col("total") > texts)
    forget(docs.sparkSession)
    if large.isEmpty():
        return found
    near, rest = None, large.select("fp", "root")
    for n in range(ROUNDS):
        many = rest.groupBy("root").agg(F.count("*").alias("left")).where(F.col("left") > texts)
        if n and many.isEmpty():
            break
        picked = rest.join(many, "root").where(F.pmod(F.xxhash64("fp", F.lit(n)), F.col("left")) < CENTRES).select("fp", "root")
        held = checkpoint(_held(large, checkpoint(picked), size, texts))
        near = held if near is None else checkpoint(near.union(held).groupBy("root", "fp").agg(F.flatten(F.collect_list("near")).alias("near")))
        rest = checkpoint(_apart(near))
    edges = found.union(near.select(F.col("fp").alias("a"), F.explode("near").alias("b")).where("a <> b"))
    # what isn't in its component's main part is compared with all of it, block by block
    sizes = large.groupBy("root").agg(F.count("*").alias("all")).join(rest.groupBy("root").agg(F.count("*").alias("out")), "root")
    sizes = sizes.select("root", F.ceil(F.col("out") / texts).alias("n_out"), F.ceil((F.col("all") - F.col("out")) / texts).alias("n_in"))
    dealt = large.join(rest.select("fp", F.lit(False).alias("near")), "fp", "left").withColumn("near", F.coalesce("near", F.lit(True))).join(sizes, "root")
    mine = F.when(F.col("near"), F.col("n_out") + F.pmod(F.xxhash64("fp"), "n_in")).otherwise(F.pmod(F.xxhash64("fp"), "n_out"))
    met = F.sequence(zero, F.when(F.col("near"), F.col("n_out")).otherwise(F.col("n_out") + F.col("n_in")) - 1)
    dealt = dealt.withColumn("mine", mine).withColumn("met", F.explode(met)).select("*", F.least("mine", "met").alias("i"), F.greatest("mine", "met").alias("j"))
    return edges.union(compared(dealt))


#: Texts of a large component that all of it is held against in a round, about, and rounds at most.
CENTRES, ROUNDS = 32, 3


def _held(large: DataFrame, picked: DataFrame, size: int, texts: int) -> DataFrame:
    """(root, fp, near) of every text of the components that have picked ones: which of these are near copies.

    A component is dealt over slices, each of which gets the picked texts first, then its own in a stream.
    """
    up, down = COPY_LIKE
    slices = F.ceil(F.col("total") / (4 * texts))
    centres = large.join(picked, ["fp", "root"], "left_semi").select("root", F.explode(F.sequence(F.lit(0).cast("long"), slices - 1)).alias("slice"), F.lit(0).alias("kind"), "fp", "text")
    all_ = large.join(picked.select("root").distinct(), "root", "left_semi").select("root", F.pmod(F.xxhash64("fp"), slices).alias("slice"), F.lit(1).alias("kind"), "fp", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, centre = None, []
        for batch in batches:
            sets = (x for block in blocks(batch.column(4)) for x in _shingles(block, size))
            rows: tuple[list, list, list] = ([], [], [])
            for root, part, kind, fp, mine in zip(*(batch.column(k).to_pylist() for k in range(4)), sets, strict=True):
                if (root, part) != now:
                    now, centre = (root, part), []
                if not kind:
                    centre.append((fp, mine))
                    continue
                found = []
                for other, theirs in centre:
                    if len(mine) and down * min(len(mine), len(theirs)) >= up * max(len(mine), len(theirs)):
                        both = len(np.intersect1d(mine, theirs, True))
                        if down * both >= up * (len(mine) + len(theirs) - both):
                            found.append(other)
                for column, cell in zip(rows, (root, fp, found), strict=True):
                    column.append(cell)
            yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.list_(pa.int64()))], ["root", "fp", "near"])

    dealt = centres.unionByName(all_).repartition(4 * shuffle_partitions(large.sparkSession), "root", "slice").sortWithinPartitions("root", "slice", "kind")
    return dealt.mapInArrow(run, "root long, fp long, near array<long>")


@F.pandas_udf(ArrayType(LongType()))
def _main_part(pairs: pd.Series) -> pd.Series:
    """Of picked texts that stand together with others (c, x, n times) those of the largest part."""

    def largest(rows: list) -> list[int]:
        up: dict[int, int] = {}

        def top(x: int) -> int:
            while up.setdefault(x, x) != x:
                x = up[x]
            return x

        for r in rows:
            a, b = top(r["c"]), top(r["x"])
            up[max(a, b)] = min(a, b)
        sizes: dict[int, int] = {}
        for r in rows:
            if r["c"] == r["x"]:
                sizes[top(r["c"])] = sizes.get(top(r["c"]), 0) + r["n"]
        best = max(sizes, key=lambda k: (sizes[k], k))
        return [k for k in up if top(k) == best]

    return pairs.map(largest)


def _apart(near: DataFrame) -> DataFrame:
    """(fp, root) of the texts that no picked one joins to the largest part of their component.

    Two picked texts are of one part if a text is near both: at most as many pairs as picked texts squared.
    """
    first = F.col("near")[0]
    pairs = near.where(F.size("near") > 0).select("root", first.alias("c"), F.explode("near").alias("x")).groupBy("root", "c", "x").agg(F.count("*").alias("n"))
    main = pairs.groupBy("root").agg(F.collect_list(F.struct("c", "x", "n")).alias("pairs")).select("root", _main_part("pairs").alias("main"))
    return near.join(main, "root", "left").where((F.size("near") == 0) | ~F.array_contains("main", F.get("near", F.lit(0)))).select("fp", "root")


def _copies(docs: DataFrame, reach: int, size: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The described rows, their distinct sets of shingles with the least row of each, and edges between near copies."""
    rows = checkpoint(_described(docs, size))
    row = F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), "h")
    points = checkpoint(rows.groupBy("fp").agg(F.min(row).alias("least"), F.min("word").alias("word"), F.min("sketch").alias("sketch")))
    roots = components(_candidates(points, reach))
    wide = points.join(roots, points.word == roots.node, "left").select(F.col("fp").alias("node"), F.coalesce("root", "word").alias("root"))
    wide = checkpoint(wide)
    forget(docs.sparkSession)
    rows, points = rows.drop("word", "sketch"), points.drop("word", "sketch")
    return rows, points, _verified(docs, points, wide, reach, size)


def near_copies(docs: DataFrame, reach: int = COPY_DISTANCE, size: int = COPY_SHINGLE) -> DataFrame:
    """(doc_id, component_id) of groups of near copies, chains included.

    Texts link if the Jaccard coefficient of their sets of shingles is 0.8 or more, each link told by
    the exact coefficient. All candidates come of searches in vantage-point trees over SimHash bits:

    * links() finds the pairs within 3 of 64 bits, by the top tree, its shards and their own trees;
    * further apart, pairs within ``reach`` of 256 bits are found. Balls so wide overlap every boundary
      of a top tree, which thus is one leaf. As a full shard is in links(), it is dealt over cells, here
      those of the bands of least hashes, and each cell searches its own tree.

    Texts without words are copies of each other. Nulls are as in near_duplicates().
    """
    rows, points, edges = _copies(docs, reach, size)
    return _named(rows, points, edges).select("doc_id", F.when(~F.col("component_id.none"), F.col("component_id.id")).alias("component_id"))


def one_of_each(docs: DataFrame, reach: int = COPY_DISTANCE, size: int = COPY_SHINGLE) -> DataFrame:
    """The rows with all their columns, of each group of near copies one: the least id's, if any has an id.

    Rows are told apart by id and text, so that texts that share an id, or have none, stand for
    themselves. Of rows that share both, one stays.
    """
    _, points, edges = _copies(docs, reach, size)
    have = {c.lower() for c in docs.columns}
    names = [next(f"{n}{'_' * k}" for k in range(len(have) + 1) if f"{n}{'_' * k}" not in have) for n in ("__none", "__id", "__h")]
    kept = _least(points, edges).select("component_id.*").distinct().toDF(*names)
    id_ = F.col("doc_id").cast("long")
    keys = dict(zip(names, (id_.isNull(), F.coalesce(id_, F.lit(0)), F.xxhash64(F.col("text").cast("string"))), strict=True))
    return docs.withColumns(keys).join(kept, names, "left_semi").dropDuplicates(names).select(*(F.col(f"`{c}`") for c in docs.columns))


def near_duplicates(docs: DataFrame, reach: int = DISTANCE, size: int = SHINGLE, shard_size: int = SHARD_SIZE) -> DataFrame:
    """Per row: doc_id, fingerprint (16 hex digits) and component_id, the least id it is linked to.

    Fingerprints link at ``reach`` or fewer differing bits, chains included. Null, empty and wordless
    texts have fingerprint zero and link like any other. A null id is no candidate for component_id
    unless all ids of the component are null, which gives null. Repeated rows each get their row. An
    empty table gives no rows; other columns are ignored.
    """
    rows = checkpoint(fingerprints(docs, size))  # slim: two numbers a row
    points = checkpoint(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    return _named(rows, points, links(points, reach, shard_size)).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _least(points: DataFrame, edges: DataFrame) -> DataFrame:
    """fp and component_id, the least of all points that the edges join."""
    roots = components(edges)
    named = points.join(roots, points.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    # written, so that a component with very many fingerprints can be split over tasks in the join
    named = checkpoint(named)
    least = checkpoint(named.groupBy("root").agg(F.min("least").alias("component_id")))
    return named.join(least, "root").select("fp", "component_id")


def _named(rows: DataFrame, points: DataFrame, edges: DataFrame) -> DataFrame:
    """rows with component_id, the least id of all rows whose fingerprints the edges join."""
    return rows.join(_least(points, edges), "fp")
