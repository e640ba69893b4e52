"""Quality rules: a linear-chain conditional random field labels each line content or boilerplate.

Lines are described by yes/no features. The field has a weight for each feature and state and for each
pair of neighbouring states; Viterbi decoding gives the best sequence of a document's lines, and a
document is retained if enough of its words stand in content lines. Base rules go first.

The weights are fitted on a bounded sample of labelled documents, whole ones, of which the executors send
only the lines' features: a first pass without transitions finds which lines of poor documents look poor, then
the chain is fitted to the sequences so labelled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docweave.llm.arrowtext import NOT_SPACE, Block, Words, blocks, keep_rows, mix, split, table, window_hashes, windows_within, word_hashes

#: Base rules: fewest words, and the most of 100 words that may stand in repeated windows of REPEAT words.
LEAST_WORDS, MOST_REPEATED, REPEAT = 10, 20, 5
#: Least share of words in content lines of a document that stays.
CONTENT_SHARE = 0.5
#: Labelled documents that the field is fitted on, at most, and lines of all of them together. None is cut.
SAMPLE_DOCS, SAMPLE_LINES = 2000, 400_000

U = np.uint64
SYMBOL = table(*((ord(c), ord(c)) for c in "#*$%&|<>"))
UPPER, LOWER_, DIGIT = table((0x41, 0x5A)), table((0x61, 0x7A)), table((0x30, 0x39))
LEAD = ~table((0x80, 0xBF))  # bytes that begin a code point

FEATURES = (
    "bias", "one or two words", "under six words", "over forty words", "a symbol", "symbols over 2 %", "symbols over 8 %",
    "upper case over 30 %", "upper case over 70 %", "digits over 10 %", "exclamations over 2 %", "bars over 2 %",
    "ends a sentence", "seen before", "words repeated", "mostly repeated", "words short", "words long", "few distinct words",
)
N = len(FEATURES)


@dataclass
class Lines:
    """Of a block: each line's row, features (bits), words, and each row's base counts."""

    row: np.ndarray
    bits: np.ndarray
    words: np.ndarray
    base: dict[str, np.ndarray]


def _sums(flags: np.ndarray) -> np.ndarray:
    out = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=out[1:])
    return out


def _line_bounds(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = len(block.offsets) - 1
    breaks = np.flatnonzero(block.data == 10)
    row = np.concatenate((np.arange(n), np.searchsorted(block.offsets, breaks, "right") - 1))
    starts = np.concatenate((block.offsets[:-1], breaks + 1))
    order = np.lexsort((starts, row))
    row, starts = row[order], starts[order]
    ends = np.empty_like(starts)
    ends[:-1] = starts[1:] - 1
    ends[-1:] = block.offsets[-1]
    last = np.flatnonzero(row[1:] != row[:-1])
    ends[last] = block.offsets[row[last] + 1]
    return row, starts, ends


def _later(keys: np.ndarray) -> np.ndarray:
    """True where an equal key stands before."""
    out = np.zeros(len(keys), bool)
    order = np.argsort(keys, kind="stable")
    out[order[1:]] = keys[order][1:] == keys[order][:-1]
    return out


def describe(block: Block) -> Lines:
    data, n = block.data, len(block.offsets) - 1
    words = split(block)
    hashes = word_hashes(data, words) if len(words.starts) else np.zeros(0, U)
    # words in windows that the text has twice or more
    at = windows_within(words, REPEAT)
    rows_of_words = words.rows()
    keys = mix(window_hashes(hashes, REPEAT)[at] + rows_of_words[at].astype(U) * U(0x9E3779B97F4A7C15))
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    twice = np.zeros(len(keys), bool)
    twice[order[1:]] |= same
    twice[order[:-1]] |= same
    marks = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(marks, at[twice], 1)
    np.add.at(marks, at[twice] + REPEAT, -1)
    repeated = _sums(np.cumsum(marks[:-1]) > 0)
    new_word = _sums(~_later(mix(hashes + rows_of_words.astype(U) * U(0xD6E8FEB86659FD93))))

    row, starts, ends = _line_bounds(block)
    a, b = np.searchsorted(words.starts, starts), np.searchsorted(words.starts, ends)
    n_words = b - a
    line_hash = word_hashes(data, Words(starts, ends, np.array([0, len(starts)]))) if len(data) else np.zeros(len(starts), U)
    seen = _later(mix(line_hash + row.astype(U) * U(0xA0761D6478BD642F))) & (n_words > 0)

    solid, symbol = _sums(NOT_SPACE[data]), _sums(SYMBOL[data])
    inside = _sums(NOT_SPACE[data] & LEAD[data])  # code points of words: white space is ASCII
    offs = block.offsets
    base = {
        "n_words": np.diff(words.first), "word_chars": np.diff(inside[offs]), "n_symbols": np.diff(symbol[offs]),
        "n_dup_lines": np.bincount(row[seen], minlength=n), "n_repeat_words": np.diff(repeated[words.first]),
    }

    some = n_words > 0
    row, starts, ends, a, b, n_words, seen = (x[some] for x in (row, starts, ends, a, b, n_words, seen))
    of = lambda sums: sums[ends] - sums[starts]
    chars, letters = np.maximum(of(solid), 1), np.maximum(of(_sums(UPPER[data] | LOWER_[data] | (data >= 0x80))), 1)
    upper, digit, call, bar, sym = of(_sums(UPPER[data])), of(_sums(DIGIT[data])), of(_sums(data == 33)), of(_sums(data == 124)), of(symbol)
    final = data[words.ends[b - 1] - 1] if len(b) else np.zeros(0, np.uint8)
    again, fresh = repeated[b] - repeated[a], new_word[b] - new_word[a]
    share = lambda part, whole, percent: 100 * part > percent * whole
    flags = (
        np.ones(len(row), bool), n_words <= 2, n_words < 6, n_words > 40, sym > 0, share(sym, chars, 2), share(sym, chars, 8),
        share(upper, letters, 30), share(upper, letters, 70), share(digit, chars, 10), share(call, chars, 2), share(bar, chars, 2),
        np.isin(final, np.frombuffer(b".!?", np.uint8)), seen, again > 0, share(again, n_words, 50), share(n_words, chars, 33), chars > 12 * n_words, share(n_words - fresh, n_words, 70),
    )
    bits = np.zeros(len(row), np.int32)
    for k, flag in enumerate(flags):
        bits |= flag.astype(np.int32) << k
    return Lines(row, bits, n_words, base)


@dataclass(frozen=True)
class Field:
    """State 0 is content, 1 boilerplate. emit[k]: what feature k adds to boilerplate; move[s][t]: from s to t."""

    emit: tuple[float, ...]
    move: tuple[tuple[float, float], tuple[float, float]]

    def decode(self, bits: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
        """The best label of every line: Viterbi, all rows in step, line by line."""
        emit = _features(bits) @ np.array(self.emit)
        (cc, cb), (bc, bb) = self.move
        counts = np.bincount(row, minlength=n)
        first = np.cumsum(counts) - counts
        label = np.zeros(len(bits), np.int8)
        from_c, from_b = np.zeros(len(bits), np.int8), np.zeros(len(bits), np.int8)
        live = np.flatnonzero(counts)
        content, boiler = np.zeros(len(live)), emit[first[live]]
        last_c, last_b = np.zeros(n), np.zeros(n)
        step = 0
        while len(live):
            last_c[live], last_b[live] = content, boiler
            step += 1
            on = counts[live] > step
            live, content, boiler = live[on], content[on], boiler[on]
            at = first[live] + step
            to_c, to_b = boiler + bc > content + cc, boiler + bb >= content + cb
            from_c[at], from_b[at] = to_c, to_b
            content, boiler = np.where(to_c, boiler + bc, content + cc), np.where(to_b, boiler + bb, content + cb) + emit[at]
        live = np.flatnonzero(counts)
        at = first[live] + counts[live] - 1
        now = (last_b[live] > last_c[live]).astype(np.int8)
        while len(live):
            label[at] = now
            on = at > first[live]
            live, at, now = live[on], at[on], now[on]
            now = np.where(now == 1, from_b[at], from_c[at])
            at = at - 1
        return label


def _features(bits: np.ndarray) -> np.ndarray:
    return ((bits[:, None] >> np.arange(N)) & 1).astype(np.float64)


#: What fit() gave on 2000 labelled documents, rounded; used where there are no labels of both kinds.
DEFAULT = Field((-1.33, 0.33, 0.59, -1.05, 3.09, 3.07, 2.90, 1.42, 1.20, -0.05, 1.28, 1.13, -3.04, -0.15, 1.48, 2.26, 0.09, -0.04, 1.85), ((1.29, -1.21), (-0.60, 0.51)))


#: Lines that are multiplied in step when a chain's sums are taken.
STRETCH = 32


class Chains:
    """Sequences end to end, cut into stretches, for forward and backward sums over all of them.

    A line is a 2 x 2 matrix of what each pair of states weighs; a stretch is the product of its lines,
    so that the sums go first within all stretches at once, then from stretch to stretch, then within
    again: steps follow the stretch and the number of stretches of the longest sequence, and what is
    held follows the number of lines.
    """

    def __init__(self, counts: np.ndarray):
        n = -(-counts // STRETCH)
        self.n_stretches, self.first = int(n.sum()), np.cumsum(n) - n  # of each sequence
        self.length = n
        row = np.repeat(np.arange(len(counts)), counts)
        place = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
        self.at = self.first[row] * STRETCH + place  # of each line among all slots
        self.begins = place == 0

    def spread(self, weights: np.ndarray) -> np.ndarray:
        """(2, 2, place, stretch), so that a place's numbers lie together; slots without a line change nothing."""
        out = np.zeros((2, 2, self.n_stretches * STRETCH))
        out[0, 0] = out[1, 1] = 1.0
        out[:, :, self.at] = weights
        return np.ascontiguousarray(out.reshape(2, 2, self.n_stretches, STRETCH).swapaxes(2, 3))

    def across(self, whole: np.ndarray, backward: bool) -> np.ndarray:
        """The state before each stretch, or after it if backward."""
        out = np.full((2, self.n_stretches), 0.5)
        for k in range(1, int(self.length.max(initial=0))):
            live = np.flatnonzero(self.length > k)
            to = self.first[live] + (self.length[live] - 1 - k if backward else k)
            at = to + 1 if backward else to - 1
            out[:, to] = _onwards(out[:, at], whole[:, :, at], backward)
        return out

    def sums(self, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each line (last axis) the probabilities of its states, and of the pairs with the line before."""
        a = self.spread(weights)
        whole = a[:, :, 0]
        for k in range(1, STRETCH):
            b = a[:, :, k]
            whole = np.stack([np.stack([whole[i, 0] * b[0, j] + whole[i, 1] * b[1, j] for j in (0, 1)]) for i in (0, 1)])
            whole /= whole[0, 0] + whole[0, 1] + whole[1, 0] + whole[1, 1]
        before, after = np.empty((2, STRETCH, self.n_stretches)), np.empty((2, STRETCH, self.n_stretches))
        now = self.across(whole, False)
        for k in range(STRETCH):
            before[:, k] = now
            now = _onwards(now, a[:, :, k], False)
        now = self.across(whole, True)
        for k in range(STRETCH - 1, -1, -1):
            after[:, k] = now
            now = _onwards(now, a[:, :, k], True)
        before, after = (x.swapaxes(1, 2).reshape(2, -1)[:, self.at] for x in (before, after))
        pairs = before[:, None] * weights * after[None, :]
        pairs /= pairs.sum(axis=(0, 1))
        return pairs.sum(axis=0), pairs


def _onwards(state: np.ndarray, a: np.ndarray, backward: bool) -> np.ndarray:
    """The state's share after one matrix each, or before it if backward."""
    if backward:
        x, y = a[0, 0] * state[0] + a[0, 1] * state[1], a[1, 0] * state[0] + a[1, 1] * state[1]
    else:
        x, y = state[0] * a[0, 0] + state[1] * a[1, 0], state[0] * a[0, 1] + state[1] * a[1, 1]
    total = x + y
    return np.stack((x / total, y / total))


def fit(sequences: list[tuple[int, np.ndarray]], rounds: int = 200) -> Field:
    """The field for (quality, features of the lines) of documents. Deterministic; DEFAULT without both kinds.

    Lines with the same features count as one kind of line, many times over.
    """
    sequences = [(q, np.asarray(b, np.int64)) for q, b in sequences if len(b)]
    if not any(q for q, _ in sequences) or all(q for q, _ in sequences):
        return DEFAULT
    kinds, kind = np.unique(np.concatenate([b for _, b in sequences]), return_inverse=True)
    x = _features(kinds)
    counts = np.array([len(b) for _, b in sequences])
    poor = np.repeat([1.0 - q for q, _ in sequences], counts)
    weigh = np.where(poor > 0, 0.5 / max(poor.sum(), 1), 0.5 / max((1 - poor).sum(), 1))
    sum_by = lambda w: np.bincount(kind, w, len(kinds))
    share, share_poor = sum_by(weigh), sum_by(weigh * poor)
    w = np.zeros(N)
    for _ in range(rounds):  # the first pass: each line alone
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= 4.0 * (x.T @ (share * p - share_poor) + 1e-4 * w)
    label = ((x @ w > 0)[kind] & (poor > 0)).astype(np.int64)
    # the chain: gradient ascent on the likelihood of the label sequences, by forward and backward sums
    chains = Chains(counts)
    pair = np.flatnonzero(~chains.begins)
    want_move = np.bincount(label[pair - 1] * 2 + label[pair], minlength=4).reshape(2, 2).astype(float)
    want = x.T @ sum_by(label.astype(float))
    move = np.zeros((2, 2))
    speed_w, speed_m = np.zeros(N), np.zeros((2, 2))
    total = len(kind)
    for _ in range(rounds // 2):
        emit = np.clip(x @ w, -60, 60)[kind]
        state = np.exp(np.stack((np.minimum(0, -emit), np.minimum(0, emit))))  # the greater weighs 1
        p, pairs = chains.sums(np.where(chains.begins, 1.0, np.exp(move)[:, :, None]) * state[None])
        got_move = pairs[:, :, pair].sum(axis=2)
        grad_w = (want - x.T @ sum_by(p[1])) / total - 1e-4 * w
        grad_m = (want_move - got_move) / total - 1e-4 * move
        speed_w, speed_m = 0.9 * speed_w + grad_w, 0.9 * speed_m + grad_m
        w, move = w + 0.5 * speed_w, move + 0.5 * speed_m
    return Field(tuple(w.tolist()), (tuple(move[0].tolist()), tuple(move[1].tolist())))


def sample(docs: DataFrame, labels: DataFrame, most: int = SAMPLE_DOCS, most_lines: int = SAMPLE_LINES) -> list[tuple[int, np.ndarray]]:
    """(quality, features) of labelled documents, with all their lines.

    Of the labels those whose ids hash lowest count, at most ``most``; of the rows that have these ids,
    in an order that their ids and texts fix, at most ``most``, and no more than have ``most_lines``
    lines together. A document is never cut.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(3)):
                lines = describe(block)
                first = np.searchsorted(lines.row, np.arange(block.hi - block.lo + 1))
                rows = [lines.bits[a:b].tolist() for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
                mine = batch.slice(block.lo, block.hi - block.lo)
                yield pa.RecordBatch.from_arrays([*mine.columns[:3], pa.array(np.diff(first)), pa.array(rows, pa.list_(pa.int32()))], ["place", "h", "quality", "n", "bits"])

    chosen = labels.where("doc_id is not null and quality in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("int").alias("quality"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).select("doc_id", "quality", F.xxhash64("doc_id").alias("place"))
    some = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")  # most rows at the most
    found = some.select("place", F.xxhash64("text").alias("h"), "quality", "text").mapInArrow(run, "place long, h long, quality int, n long, bits array<int>")
    found = found.where(F.col("n") <= most_lines).orderBy("place", "h", "quality", "n").limit(most)
    so_far = F.sum("n").over(Window.orderBy("place", "h", "quality", "n").rowsBetween(Window.unboundedPreceding, 0))  # most rows at the most
    return [(r[0], np.array(r[1], np.int64)) for r in found.withColumn("so_far", so_far).where(F.col("so_far") <= most_lines).select("quality", "bits").collect()]


SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_lines long, n_content_lines long, content_words long"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def verdict(block: Block, field: Field, share: float) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray, dict[str, np.ndarray]]:
    """(base counts, base_failed, kept, what was labelled) of a block's rows."""
    n = block.hi - block.lo
    lines = describe(block)
    good = field.decode(lines.bits, lines.row, n) == 0
    content = np.bincount(lines.row[good], lines.words[good], minlength=n).astype(np.int64)
    words, again = lines.base["n_words"], lines.base["n_repeat_words"]
    failed = (words < LEAST_WORDS) | (100 * again > MOST_REPEATED * words)
    counts = {"n_lines": np.bincount(lines.row, minlength=n), "n_content_lines": np.bincount(lines.row[good], minlength=n), "content_words": content}
    return lines.base, failed, ~failed & (content >= share * words), counts


def judge(docs: DataFrame, field: Field, share: float = CONTENT_SHARE) -> DataFrame:
    """Per row: doc_id, the base counts, base_failed, kept, and the lines and words labelled content.

    Null and empty texts have no words, so they fail the base rules. Lines without words have no label.
    Null and repeated ids pass through row by row; nothing is shuffled; an empty table gives no rows;
    other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(1)):
                base, failed, kept, counts = verdict(block, field, share)
                columns = [batch.column(0).slice(block.lo, block.hi - block.lo), *(pa.array(base[c].astype(np.int64)) for c in COUNTS), pa.array(failed), pa.array(kept)]
                columns += [pa.array(x.astype(np.int64)) for x in counts.values()]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", *COUNTS, "base_failed", "kept", *counts])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id long, {SCHEMA}")


def rules(docs: DataFrame, labelled: DataFrame, labels: DataFrame, share: float = CONTENT_SHARE, most: int = SAMPLE_DOCS) -> DataFrame:
    """judge() with the field fitted on ``most`` documents of ``labelled`` that ``labels`` (doc_id, quality) covers."""
    return judge(docs, fit(sample(labelled, labels, most)), share)


def retain(docs: DataFrame, labelled: DataFrame, labels: DataFrame, share: float = CONTENT_SHARE, most: int = SAMPLE_DOCS) -> DataFrame:
    """The rows of ``docs`` that rules() keeps, with all their columns, whatever their names, and where they are.

    Null and empty texts go, as the base rules have it; repeated rows and rows that share an id are judged
    one by one; without labels of both kinds the field is DEFAULT; an empty table stays empty.
    """
    field = fit(sample(labelled, labels, most))
    return keep_rows(docs, "text", lambda block: verdict(block, field, share)[2])
