"""Token counts by count-only Viterbi over a unigram vocabulary.

An Aho-Corasick automaton lists every vocabulary piece that ends at each character; dynamic programming
carries the best score up to it and the number of pieces of that best path. No path is kept, so memory
is the longest piece's length, however long the text. Rules as in the public unigram tokenizers: of
equal scores the path whose last piece begins first stays; a character that is no piece by itself may
stand as unknown, at the least score less ten, and counts its UTF-8 bytes, as byte fallback has it.

Spaces become ``MARK``, one of which leads. Where no piece of the vocabulary has a mark after another
character, the best path of a text is that of its parts, cut before each run of marks; parts recur, and
are solved once a worker as long as it remembers them.

The installed vocabularies have no unigram model, and none is trained here: the query takes the pieces of
a merge model, with log-probabilities from their ranks. Its counts are those of that unigram model, not of
the merge model's own encoder, from which they differ by about one percent in sum.
"""

from __future__ import annotations

import functools
import math
import re
from collections.abc import Iterable, Iterator

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
#: What is added to a rank in the law that gives a merge model's pieces their probabilities.
ZIPF = 2.7
#: How much less than the least score an unknown character scores.
PENALTY = 10.0
#: Parts up to so many characters are remembered, so many of them in a worker.
SHORT, REMEMBERED = 48, 1_000_000
#: The parts of a text of more characters are not held all at once.
LONG = 1 << 20


def load_pieces(path: str) -> list[tuple[str, float]]:
    """The ordinary pieces of a model file and their log-probabilities; control, unknown and byte pieces match no text.

    A unigram model's scores are taken as they are. A merge model's are ranks, whole numbers below
    zero, whose sums mean nothing; by_rank() makes log-probabilities of them.
    """
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    skip = lambda i: model.is_unknown(i) or model.is_control(i) or model.is_byte(i) or model.is_unused(i)
    pieces = [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size()) if not skip(i)]
    return by_rank(pieces) if all(s <= 0 and s == int(s) for _, s in pieces) else pieces


def by_rank(pieces: list[tuple[str, float]]) -> list[tuple[str, float]]:
    """Zipf's law as Mandelbrot has it: the probability of a piece is in proportion to 1 / (rank + ZIPF)."""
    total = math.log(sum(1.0 / (ZIPF - s) for _, s in pieces)) if pieces else 0.0
    return [(p, -math.log(ZIPF - s) - total) for p, s in pieces]


class Counter:
    def __init__(self, pieces: Iterable[tuple[str, float]]):
        pieces = [(p, float(s)) for p, s in pieces if p]
        self.automaton = ahocorasick.Automaton()
        for p, s in pieces:
            self.automaton.add_word(p, (len(p), s))
        self.automaton.make_automaton()
        self.single = {p for p, _ in pieces if len(p) == 1}
        self.unknown = min((s for _, s in pieces), default=0.0) - PENALTY
        self.ring = max((len(p) for p, _ in pieces), default=1) + 1
        apart = not any(MARK in p.lstrip(MARK) for p, _ in pieces)
        alone = apart and not any("\n" in p for p, _ in pieces)  # then a line break is a part, always unknown
        self.parts = re.compile(f"{MARK}+[^{MARK}\n]*|\n|[^{MARK}\n]+" if alone else f"{MARK}+[^{MARK}]*|[^{MARK}]+" if apart else ".+", re.DOTALL)
        self.known: dict[str, tuple[float, int]] = {}

    def solve(self, part: str) -> tuple[float, int]:
        """(score, pieces) of the best path over the whole part."""
        n, ring, single = len(part), self.ring, self.single
        score, count = [0.0] * ring, [0] * ring
        at, best, pieces = 1, None, 0  # the position to settle next, and its best so far

        def settle(end: int, best: float | None, pieces: int) -> None:
            c = part[end - 1]
            if c not in single:
                s = score[(end - 1) % ring] + self.unknown
                if best is None or s > best:
                    best, pieces = s, count[(end - 1) % ring] + len(c.encode("utf-8", "replace"))
            score[end % ring], count[end % ring] = best, pieces

        for last, (length, gain) in self.automaton.iter(part):  # at each end, the longest piece first
            while at <= last:
                settle(at, best, pieces)
                at, best, pieces = at + 1, None, 0
            begin = (last + 1 - length) % ring
            s = score[begin] + gain
            if best is None or s > best:
                best, pieces = s, count[begin] + 1
        while at <= n:
            settle(at, best, pieces)
            at, best, pieces = at + 1, None, 0
        return score[n % ring], count[n % ring]

    def _new(self, part: str) -> tuple[float, int]:
        found = self.solve(part)
        if len(part) <= SHORT:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[part] = found
        return found

    def count(self, text: str) -> tuple[float, int]:
        """(score, pieces) of a text; nothing for an empty one."""
        if not text:
            return 0.0, 0
        get, new = self.known.get, self._new
        text = MARK + text.replace(" ", MARK)
        parts = self.parts.findall(text) if len(text) <= LONG else (m[0] for m in self.parts.finditer(text))
        score, pieces = 0.0, 0
        for s, n in (get(p) or new(p) for p in parts):
            score += s
            pieces += n
        return score, pieces


@functools.lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    """Once a worker process."""
    return Counter(load_pieces(path))


def counts(docs: DataFrame, path: str) -> DataFrame:
    """Per row: doc_id, n_tokens, n_chars (code points) and score, the best path's.

    ``path`` is a model file installed on every node. A null text is an empty one: no tokens. Null and
    repeated ids pass through row by row; nothing is shuffled; an empty table gives no rows; other
    columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                tokens, chars, scores = [], [], []
                for value in part.column(1):
                    raw = value.as_buffer()
                    text = "" if raw is None else raw.to_pybytes().decode("utf-8", "replace")
                    s, n = c.count(text)
                    tokens.append(n)
                    chars.append(len(text))
                    scores.append(s)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(tokens, pa.int64()), pa.array(chars, pa.int64()), pa.array(scores, pa.float64())], ["doc_id", "n_tokens", "n_chars", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_tokens long, n_chars long, score double")
