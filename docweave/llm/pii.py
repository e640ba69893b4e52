"""Personal data by a semi-Markov conditional random field.

A text is cut into tokens; a segment of up to ``LONGEST`` tokens on one line may be an entity of some type.
Its score is a sum of weights of features of the whole span (its shape, digits, checksums, the word before
it), and of a weight for the types of two segments that follow each other; a token outside entities is a
segment of its own type. Dynamic programming over token boundaries and types picks the segmentation,
boundaries and types together, of the highest score.

The weights are those of the greatest conditional likelihood: train() ascends the gradient of the
probability that the field gives the right segmentation among all, whose sum over all segmentations the
same lattice yields forward and backward.

A segment without a digit, an @, a quote, a spelled "at" or "dot", or a word before it that announces a
secret, is no entity to this field, so only the neighbourhoods of these are decoded: the rest can't change.
A run of 16 or more of the characters that keys are written in is one token, however long.

Spans of the base patterns always stand; the field adds those that overlap none of them.
"""

from __future__ import annotations

import functools
import json
import pkgutil
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.llm.arrowtext import sha256

KINDS = ("email", "ip", "card", "phone", "secret", "iban", "ssn")
BASE = KINDS[:4]
#: Tokens of an entity at most.
LONGEST = 20
#: Tokens before a segment among which a word may announce it.
BEFORE = 4

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
TOKEN = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}|[^\W_]+|\S")
TRIGGER = re.compile(r"[0-9@\"]|[(\[]at[)\]]|\sdot\s|(?<![A-Za-z])(?i:pass(?:word|wd|phrase)|secret|token|api.?key)")
SPELLED_AT = re.compile(r"[(\[](?:at|dot)[)\]]")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or 0) <= 255


def base_spans(text: str) -> list[Span]:
    """The base patterns' spans in code points, by kind, then start; in time linear in the text.

    Emails are found from their @: the local part is the run of its characters before, which is where
    a leftmost match begins. Addresses are taken from maximal dotted runs, four parts at a time.
    """
    found: list[Span] = []
    at, done = text.find("@"), 0
    while at >= 0:
        begin = at
        while begin > done and text[begin - 1] in LOCAL:
            begin -= 1
        m = DOMAIN.match(text, at + 1) if begin < at else None
        if m:
            found.append(("email", begin, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    if DIGIT.search(text):
        for m in DOTTED.finditer(text):
            parts = m[0].split(".")
            begin = m.start()
            for k in range(0, len(parts) - 3, 4):
                four = parts[k : k + 4]
                end = begin + sum(map(len, four)) + 3
                if all(map(_octet, four)):
                    found.append(("ip", begin, end))
                begin = end + 1
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", m.start(), m.end()))
        for m in PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                found.append(("phone", m.start(), m.end()))
    return found


# --- the field ---

SPAN_FEATURES = (
    "bias", "mail shape", "mail shape, spelled in brackets", "mail shape, spelled in words", "four octets", "card digits", "passes luhn", "grouped in fours", "phone digits", "leads with + or (", "phone punctuation",
    "key characters", "letters and digits", "in quotes", "sixteen or longer", "announced", "announced as another", "digits go on", "letters go on", "odd characters", "spaces", "date or amount", "joined on", "country code before",
    "account shape", "account checksum", "three, two, four digits", "letters alone", "digits alone", "after : or =", "hex digits", "under ten", "spelled on", "more groups follow", "begins as keys do", "three, three, four digits",
)
N = len(SPAN_FEATURES)
ANNOUNCED, OTHER = SPAN_FEATURES.index("announced"), SPAN_FEATURES.index("announced as another")

#: Words that announce an entity.
CUES = {
    "email": {"email", "mail", "e-mail", "contact", "write", "mailto"},
    "ip": {"ip", "host", "server", "address", "addr", "ipv4"},
    "card": {"card", "visa", "credit", "mastercard", "debit", "amex"},
    "phone": {"phone", "tel", "call", "mobile", "fax", "cell", "telephone"},
    "secret": {"key", "api", "token", "secret", "password", "passwd", "passphrase", "api_key", "apikey", "pass", "pwd", "bearer"},
    "iban": {"iban", "account", "konto", "bank"},
    "ssn": {"ssn", "social", "security"},
}
#: The type that each of these words announces.
CUE = {word: kind for kind, words in CUES.items() for word in words}
MAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
SPELLED = re.compile(r"[A-Za-z0-9._-]+\s?(?:@|\(at\)|\[at\])\s?[A-Za-z0-9-]+(?:\s?(?:\.|\(dot\)|\[dot\])\s?[A-Za-z0-9-]+)+")
WORDED = re.compile(r"[A-Za-z0-9_-]+(?: dot [A-Za-z0-9_-]+)* at [A-Za-z0-9-]+(?: dot [A-Za-z0-9-]+)+")
FOUR = re.compile(r"([0-9]{1,3})\.([0-9]{1,3})\.([0-9]{1,3})\.([0-9]{1,3})")
GROUPED = re.compile(r"[0-9]{4}(?:[ -][0-9]{4}){3}")
CALL = re.compile(r"\+?[0-9 ().-]+")
BLOB = re.compile(r"[A-Za-z0-9+/_=.!$%&*#^~-]+")
HEX = re.compile(r"[0-9a-f]+|[0-9A-F]+")
COUNTRY = re.compile(r"\+[0-9]{1,3}[ -]?$")
DATE = re.compile(r"[0-9]{1,4}[-/.][0-9]{1,2}[-/.][0-9]{1,4}|[0-9]+(?:,[0-9]{3})*(?:\.[0-9]+)?|[0-9]+,[0-9]+")
ACCOUNT = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}")
SPELLED_ON = re.compile(r"\s?[(\[](?:dot|at)[)\]]| dot [A-Za-z]")
MORE_GROUPS = re.compile(r" [A-Z0-9]{1,4}(?![A-Za-z0-9])")
#: How keys of known makers begin.
PREFIXES = ("eyJ", "ghp_", "gho_", "AKIA", "sk-", "xox")
LOCAL_CALL = re.compile(r"\(?[0-9]{3}\)?[ .-]{1,2}[0-9]{3}[ .-][0-9]{4}")
SOCIAL = re.compile(r"[0-9]{3}-[0-9]{2}-[0-9]{4}")


def _checksum(account: str) -> bool:
    """Whether the number that an account's letters and digits stand for leaves 1 over 97."""
    moved = account[4:] + account[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def features(text: str, begin: int, end: int, before: str) -> tuple[list[int], int]:
    """Indexes of the features that hold for text[begin:end], whatever its type, and the type announced, or -1."""
    span = text[begin:end]
    digits = "".join(c for c in span if "0" <= c <= "9")
    inner = span[1:-1] if len(span) > 2 and span[0] == span[-1] and span[0] in "\"'" else span
    four = FOUR.fullmatch(span)
    holds = [0]
    add = holds.append
    shaped = True
    if MAIL.fullmatch(span):
        add(1)
    elif "at" in span and SPELLED.fullmatch(span):
        add(2)
    elif " at " in span and WORDED.fullmatch(span):
        add(3)
    elif four and all(map(_octet, four.groups())):
        add(4)
    else:
        shaped = False
    if 13 <= len(digits) <= 19 and len(digits) + 4 >= len(span):
        add(5)
        if luhn(digits):
            add(6)
        shaped = True
    if GROUPED.fullmatch(span):
        add(7)
    if 9 <= len(digits) <= 15 and CALL.fullmatch(span):
        add(8)
        if span[0] in "+(":
            add(9)
        if any(c in span for c in "()-. "):
            add(10)
        shaped = True
    if BLOB.fullmatch(inner):
        add(11)
        if digits and len(digits) < len(inner):
            add(12)
        if len(inner) >= 16:
            add(14)
        elif len(inner) < 10:
            add(31)
        if len(inner) >= 16 and HEX.fullmatch(inner):
            add(30)
        shaped = True
    if inner is not span:
        add(13)
    if end < len(text) and "0" <= text[end] <= "9" or begin and "0" <= text[begin - 1] <= "9":
        add(17)
    if end < len(text) and text[end].isalpha() or begin and text[begin - 1].isalpha():
        add(18)
    if " " in span:
        add(20)
    if DATE.fullmatch(span):
        add(21)
    if end + 1 < len(text) and text[end] in ".-@_/%!$&" and text[end + 1].isalnum() or begin > 1 and text[begin - 1] in "._-@%+/!$&" and text[begin - 2].isalnum():
        add(22)
    if begin and COUNTRY.search(text, max(0, begin - 5), begin):
        add(23)
    if len(digits) > 8 and ACCOUNT.fullmatch(span):
        add(24)
        shaped = True
        if _checksum(span.replace(" ", "")):
            add(25)
    if SOCIAL.fullmatch(span):
        add(26)
    if SPELLED_ON.match(text, end):
        add(32)
    if MORE_GROUPS.match(text, end):
        add(33)
    if inner.startswith(PREFIXES):
        add(34)
    if LOCAL_CALL.fullmatch(span):
        add(35)
    if inner.isalpha():
        add(27)
    elif len(digits) == len(span):
        add(28)
    if text[max(0, begin - 2) : begin].strip()[-1:] in (":", "="):
        add(29)
    if not shaped:
        add(19)
    kind = CUE.get(before)
    return holds, KINDS.index(kind) if kind else -1


@dataclass(frozen=True)
class Model:
    """weights: a row for each type, a column for each feature; moves[a][b]: from a segment of type a to one of b, the last type being none."""

    weights: np.ndarray
    moves: np.ndarray

    def score(self, holds: list[int], cue: int) -> np.ndarray:
        """The score of a segment as each type."""
        out = self.weights[:, holds].sum(axis=1)
        if cue >= 0:
            out += self.weights[:, OTHER]
            out[cue] += self.weights[cue, ANNOUNCED] - self.weights[cue, OTHER]
        return out


#: What none, a token outside entities, is as a type.
NONE = len(KINDS)

Tokens = list[tuple[int, int]]


def regions(text: str) -> Iterator[Tokens]:
    """Tokens around triggers: those within LONGEST (and BEFORE) tokens on the same line, merged."""
    reach, done = LONGEST + BEFORE, 0
    for m in TRIGGER.finditer(text):
        at = m.end() - 1 if m[0][0].isspace() else m.start()
        if at < done:
            continue
        line = text.rfind("\n", 0, at) + 1
        line = max(line, done)
        # back to a white space with enough tokens after it, or to the line's begin
        wide = 256
        while True:
            lo = max(line, at - wide)
            while lo > line and not text[lo - 1].isspace():
                lo -= 1
            tokens = [(t.start(), t.end()) for t in TOKEN.finditer(text, lo, at)]
            if lo == line or len(tokens) > reach:
                break
            wide *= 2
        lo = tokens[-reach - 1][0] if len(tokens) > reach else lo
        # on from there, until no trigger is near
        end = text.find("\n", at)
        end = len(text) if end < 0 else end
        out: Tokens = []
        left = reach
        for t in TOKEN.finditer(text, lo, end):
            out.append((t.start(), t.end()))
            if t.end() <= at:
                continue
            left = reach if TRIGGER.search(text, max(lo, t.start() - 1), t.end() + 1) else left - 1
            if not left:
                break
        done = out[-1][1] if out else at + 1
        if out:
            yield out


def candidates(text: str, tokens: Tokens) -> list[tuple[int, int, list[int], int]]:
    """(first token, token after the last, features, announced type) of every segment that may be an entity."""
    n = len(tokens)
    words = [text[a:b] for a, b in tokens]
    cue = [""] * n  # the last word before each token, past punctuation
    for i in range(n):
        for k in range(i - 1, max(-1, i - 1 - BEFORE), -1):
            if words[k][0].isalpha():
                cue[i] = words[k].lower()
                break
    hot = [bool(DIGIT.search(w)) or w in "@\"" or w == "dot" or w in ("at", "dot") and 0 < k < n - 1 and words[k - 1] in "([" or CUE.get(cue[k]) == "secret" for k, w in enumerate(words)]
    sums = np.concatenate(([0], np.cumsum(hot))).tolist()
    out = []
    for i in range(n):
        first = words[i][0]
        if not (first.isalnum() or first in "+(\"'"):
            continue
        begin = tokens[i][0]
        for j in range(i + 1, min(n, i + LONGEST) + 1):
            w = words[j - 1]
            if len(w) == 1 and not w.isalnum() and w not in PLAIN:
                break
            if sums[j] > sums[i] and _may(text, begin, tokens[j - 1][1]):
                out.append((i, j, *features(text, begin, tokens[j - 1][1], cue[i])))
    return out


#: Single characters besides letters and digits that a segment may hold.
PLAIN = frozenset("@.()[]+-_%\"'=/!$&*#^~")


def _may(text: str, begin: int, end: int) -> bool:
    """Whether a segment is a candidate at all.

    Entities have six characters or more, begin and end with a letter, a digit, a quote or base64's
    padding, some with + or (, and with a space inside have nine digits or a spelled "at".
    """
    last = text[end - 1]
    if end - begin < 6 or not (last.isalnum() or last in "\"'=!"):
        return False
    span = text[begin:end]
    return " " not in span or "at" in span or sum("0" <= c <= "9" for c in span) >= 9


def decode(text: str, model: Model) -> list[Span]:
    """The best segmentation's entities: bounded-entity dynamic programming over token boundaries and types."""
    found: list[Span] = []
    moves = model.moves.tolist()
    for tokens in regions(text):
        some = candidates(text, tokens)
        if not some:
            continue
        n = len(tokens)
        ending: list[list] = [[] for _ in range(n + 1)]
        for i, j, holds, cue in some:
            ending[j].append((i, model.score(holds, cue).tolist()))
        # of each boundary and type of the segment before it: the best score, and where that segment began and after which type
        best: list[dict[int, tuple[float, int, int]]] = [{NONE: (0.0, -1, NONE)}]
        for j in range(1, n + 1):
            here: dict[int, tuple[float, int, int]] = {}
            y = max(best[j - 1], key=lambda y, j=j: best[j - 1][y][0] + moves[y][NONE])
            here[NONE] = (best[j - 1][y][0] + moves[y][NONE], j - 1, y)
            for i, scores in ending[j]:
                for k, s in enumerate(scores):
                    for y, (was, _, _) in best[i].items():
                        total = was + moves[y][k] + s
                        if k not in here or total > here[k][0] + 1e-12:
                            here[k] = (total, i, y)
            best.append(here)
        j, y = n, max(best[n], key=lambda y: best[n][y][0])
        while j > 0:
            _, i, before = best[j][y]
            if y != NONE:
                found.append((KINDS[y], tokens[i][0], tokens[j - 1][1]))
            j, y = i, before
    return sorted(found, key=lambda s: s[1:])


# --- fitting ---


def made_up(seed: int, n: int) -> list[tuple[str, list[Span]]]:
    """Texts made up of words with planted entities and look-alikes, and the entities' spans."""
    rng = np.random.default_rng(seed)
    pick = lambda x: x[int(rng.integers(0, len(x)))]
    digits = lambda k: "".join(map(str, rng.integers(0, 10, k)))
    some = lambda chars, a, b: "".join(pick(chars) for _ in range(int(rng.integers(a, b))))

    def word() -> str:
        return "".join(pick(["an", "el", "or", "ti", "the", "ou", "re", "st", "ka", "mi"]) for _ in range(int(rng.integers(1, 5))))

    def card() -> str:
        x = "4" + digits(14)
        return next(x + str(d) for d in range(10) if luhn(x + str(d)))

    def account() -> str:
        rest = pick(["", some("ABCDEFGHIJKLMNOPQRSTUVWXYZ", 4, 5)]) + digits(int(rng.integers(14, 19)))
        country = pick(["DE", "GB", "FR", "NL", "ES", "IT"])
        x = next(y for k in range(2, 99) if _checksum(y := f"{country}{k:02d}{rest}"))
        return pick([x, " ".join(x[k : k + 4] for k in range(0, len(x), 4))])

    def entity(kind: str) -> str:
        if kind == "email":
            name, host = f"{word()}{pick(['', '.', '_'])}{digits(2)}", f"{word()}{pick(['.com', '.org', '.co.uk'])}"
            return pick([f"{name}@{host}", f"{word()} (at) {word()} (dot) org", f"{word()} [at] {word()} [dot] com", f"{word()} dot {word()} at {word()} dot com", f"{word()} at {word()} dot org", f"{word()}.{word()} (at) {word()}.{word()} (dot) co (dot) uk"])
        if kind == "ip":
            return ".".join(str(int(x)) for x in rng.integers(1, 255, 4))
        if kind == "card":
            x = card()
            return pick([x, " ".join(x[k : k + 4] for k in (0, 4, 8, 12)), "-".join(x[k : k + 4] for k in (0, 4, 8, 12))])
        if kind == "phone":
            return pick([f"+{pick('123489')} ({digits(3)}) {digits(3)}-{digits(4)}", f"({digits(3)}) {digits(3)}-{digits(4)}", f"{digits(3)}-{digits(3)}-{digits(4)}", f"+{digits(11)}", f"+{digits(2)} {digits(3)} {digits(6)}", f"{digits(3)}.{digits(3)}.{digits(4)}"])
        if kind == "iban":
            return account()
        if kind == "ssn":
            return f"{digits(3)}-{digits(2)}-{digits(4)}"
        blob = pick([some("0123456789abcdef", 20, 130) + "a1", some("ABCDEFabcdefghijklmnop0123456789", 20, 48) + "aB3", "sk-" + some("abcdefghijkl0123456789", 24, 48) + "z9", some("ABCdefghi0123456789+/", 40, 90) + "k7=="])
        return pick([f'"{blob}"', blob])

    def key() -> str:
        """A key that says itself what it is."""
        body = "ABCDEFGHIJKLMNabcdefghijklmn0123456789"
        return pick([f"eyJ{some(body, 15, 40)}.eyJ{some(body, 15, 60)}.{some(body + '_-', 30, 45)}x1", f"ghp_{some(body, 34, 36)}9z", f"AKIA{some('ABCDEFGHIJKLMNOP234567', 15, 16)}7", f"sk-{some(body, 30, 48)}4d"])

    def password() -> str:
        return pick([word() + word() + digits(int(rng.integers(1, 5))), word().capitalize() + digits(2) + pick("!$%") + word() + "7", word() + word() + word(), f'"{word()}{digits(3)}{word()}"'])

    def decoy() -> str:
        return pick([
            digits(4), digits(6), digits(10), f"{digits(1)}.{digits(2)}", f"20{digits(2)}-0{pick('123456789')}-1{digits(1)}", f"1{digits(1)}:{digits(2)}", f"{digits(2)}%", f"v{digits(1)}.{digits(1)}.{digits(1)}", f"{word()}{digits(1)}", f'"{word()}"', f'"{word()} {word()}"', f"{digits(3)},{digits(3)}",
            f"@{word()}", f"300.{digits(2)}.999.1", next(x for x in iter(lambda: digits(16), "") if not luhn(x)), f"page {digits(3)}", f"'{word()} {word()}'", f"total {digits(10)}", f"order {digits(9)}", f"No. {digits(12)}", f"{word()} at {word()}", f"the dot {word()}", f"{word()}-{word()}-{word()}-{digits(2)}",
            f"the secret of {word()}", f"a token {word()}", f"password for {word()}", f"keys and {word()}", f"https {word()}/{word()}/{digits(5)}", f"ISBN 978-{digits(1)}-{digits(3)}-{digits(5)}-{digits(1)}", f"{digits(2)} x {digits(2)} mm", f"{digits(4)} {digits(4)} {word()}", f"{word()}_{word()}_{word()}", f"19{digits(2)}-20{digits(2)}",
        ])

    out = []
    for _ in range(n):
        parts, spans, at = [], [], 0

        def put(x: str, kind: str = "") -> None:
            nonlocal at
            if kind:
                spans.append((kind, at, at + len(x)))
            parts.append(x)
            at += len(x)

        for _ in range(int(rng.integers(1, 6))):
            for _ in range(int(rng.integers(1, 8))):
                put(word() + pick([" ", " ", " ", ", "]))
            if int(rng.integers(0, 2)) == 0:
                put(decoy() + pick([" ", ". ", ", "]))
                continue
            kind = pick(KINDS)
            assigned = pick([" = ", "=", ": ", " is "])
            if kind == "secret" and rng.random() < 0.4:
                put(pick(["password", "passwd", "pwd", "passphrase", "Password"]) + pick([": ", "=", " = "]))
                put(password(), kind)
            elif kind == "secret" and rng.random() < 0.25:
                put(key(), kind)
            else:
                if rng.random() < 0.5 or kind == "secret":
                    put(pick(sorted(CUES[kind])) + (assigned if kind == "secret" else pick([" ", ": ", " is "])))
                put(entity(kind), kind)
            put(pick([" ", ". ", ", ", "\n", "; "]))
        out.append(("".join(parts), spans))
    return out


class Lattice:
    """All segmentations of one region: candidates as arrays, and the right one as segments."""

    def __init__(self, text: str, tokens: Tokens, gold: list[Span]):
        some = candidates(text, tokens)
        self.n = len(tokens)
        self.begin, self.end = (np.array([c[k] for c in some], np.int64) for k in (0, 1))
        self.cue = np.array([c[3] for c in some], np.int64)
        self.holds = np.zeros((len(some), N))
        for row, c in zip(self.holds, some, strict=True):
            row[c[2]] = 1.0
        starts, ends = {a: i for i, (a, _) in enumerate(tokens)}, {b: i + 1 for i, (_, b) in enumerate(tokens)}
        place = {(i, j): k for k, (i, j) in enumerate(zip(self.begin.tolist(), self.end.tolist(), strict=True))}
        self.path: list[tuple[int, int, int]] | None = []  # (candidate or -1, type, type before)
        inside = sorted((starts.get(a, -1), ends.get(b, -1), KINDS.index(k)) for k, a, b in gold if tokens[0][0] <= a and b <= tokens[-1][1])
        at, before = 0, NONE
        for i, j, k in inside:
            if (i, j) not in place:
                self.path = None  # the lattice lacks it: nothing to learn here
                return
            for _ in range(at, i):
                self.path.append((-1, NONE, before))
                before = NONE
            self.path.append((place[i, j], k, before))
            at, before = j, k
        for _ in range(at, self.n):
            self.path.append((-1, NONE, before))
            before = NONE

    def cued(self) -> np.ndarray:
        """(candidate, type, 2): whether announced as this type, as another."""
        out = np.zeros((len(self.cue), len(KINDS), 2))
        known = np.flatnonzero(self.cue >= 0)
        out[known, :, 1] = 1.0
        out[known, self.cue[known]] = (1.0, 0.0)
        return out


def gradient(lattice: Lattice, weights: np.ndarray, moves: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """(log likelihood of the right segmentation, its derivatives by weights and moves)."""
    cued = lattice.cued()
    score = lattice.holds @ weights.T + cued[:, :, 0] * weights[:, ANNOUNCED] + cued[:, :, 1] * weights[:, OTHER]
    n, k = lattice.n, NONE + 1
    ending: list[list[int]] = [[] for _ in range(n + 1)]
    beginning: list[list[int]] = [[] for _ in range(n + 1)]
    for c, (i, j) in enumerate(zip(lattice.begin.tolist(), lattice.end.tolist(), strict=True)):
        ending[j].append(c)
        beginning[i].append(c)
    forward, into = np.full((n + 1, k), -np.inf), np.full((n + 1, k), -np.inf)
    forward[0, NONE] = 0.0
    with np.errstate(invalid="ignore", divide="ignore"):
        for j in range(n + 1):
            if j:
                forward[j, NONE] = into[j - 1, NONE]
                if ending[j]:
                    e = ending[j]
                    forward[j, :NONE] = np.logaddexp.reduce(into[lattice.begin[e], :NONE] + score[e], axis=0)
            into[j] = np.logaddexp.reduce(forward[j][:, None] + moves, axis=0)  # of each type that may follow
        z = np.logaddexp.reduce(forward[n])
        # after[j]: all ways on from boundary j by the type that follows; backward by the type before
        after, backward = np.full((n + 1, k), -np.inf), np.full((n + 1, k), -np.inf)
        backward[n] = 0.0
        for j in range(n - 1, -1, -1):
            after[j, NONE] = backward[j + 1, NONE]
            if beginning[j]:
                b = beginning[j]
                after[j, :NONE] = np.logaddexp.reduce(score[b] + backward[lattice.end[b], :NONE], axis=0)
            backward[j] = np.logaddexp.reduce(moves + after[j][None, :], axis=1)
        pairs = np.exp(forward[:, :, None] + moves[None] + after[:, None, :] - z).sum(axis=0)
        p = np.exp(into[lattice.begin, :NONE] + score + backward[lattice.end, :NONE] - z) if len(score) else score
    by_weights, by_moves, right = -(p.T @ lattice.holds), -pairs, 0.0
    by_weights[:, ANNOUNCED] -= (p * cued[:, :, 0]).sum(axis=0)
    by_weights[:, OTHER] -= (p * cued[:, :, 1]).sum(axis=0)
    for c, y, before in lattice.path:
        right += moves[before, y]
        by_moves[before, y] += 1.0
        if c >= 0:
            right += score[c, y]
            by_weights[y] += lattice.holds[c]
            by_weights[y, ANNOUNCED] += cued[c, y, 0]
            by_weights[y, OTHER] += cued[c, y, 1]
    return right - z, by_weights, by_moves


def train(seed: int = 5, n: int = 1500, passes: int = 10, rate: float = 0.5, shrink: float = 2e-4) -> Model:
    """Adaptive gradient ascent on the conditional log likelihood of made-up texts, region by region.

    That nothing follows nothing scores nothing, so that what is far from any trigger can't matter.
    """
    lattices = [x for text, gold in made_up(seed, n) for tokens in regions(text) if (x := Lattice(text, tokens, gold)).path is not None and len(x.begin)]
    weights, moves = np.zeros((len(KINDS), N)), np.zeros((NONE + 1, NONE + 1))
    seen_w, seen_m = np.full_like(weights, 1e-3), np.full_like(moves, 1e-3)
    order = np.random.default_rng(seed)
    for _ in range(passes):
        for i in order.permutation(len(lattices)).tolist():
            _, g_w, g_m = gradient(lattices[i], weights, moves)
            g_w, g_m = g_w - shrink * weights, g_m - shrink * moves
            g_m[NONE, NONE] = 0.0
            seen_w += g_w**2
            seen_m += g_m**2
            weights += rate * g_w / np.sqrt(seen_w)
            moves += rate * g_m / np.sqrt(seen_m)
    return Model(np.round(weights, 2), np.round(moves, 2))


#: What train() gives, beside this module.
FILE = "pii_model.json"


def write_model(path: str, model: Model) -> None:
    rows = {"features": list(SPAN_FEATURES), "weights": dict(zip(KINDS, model.weights.tolist(), strict=True)), "moves": dict(zip((*KINDS, "none"), model.moves.tolist(), strict=True))}
    with open(path, "w", encoding="utf-8") as out:
        out.write(json.dumps(rows).replace("], ", "],\n ").replace("}, ", "},\n") + "\n")


@functools.lru_cache(maxsize=1)
def trained() -> Model:
    """The model that is shipped with this module; read on the driver, sent to the workers with the task."""
    rows = json.loads(pkgutil.get_data(__package__, FILE))
    if rows["features"] != list(SPAN_FEATURES):
        raise ValueError(f"{FILE} is for other features; train it again")
    return Model(np.array([rows["weights"][k] for k in KINDS]), np.array([rows["moves"][k] for k in (*KINDS, "none")]))


def spans_of(text: str, model: Model | None = None) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans), each by kind, then start. A span of the field that meets a base span is left out."""
    base = base_spans(text)
    more = decode(text, model or trained())
    taken = sorted((a, b) for _, a, b in base)
    starts = np.array([a for a, _ in taken])
    ends = np.maximum.accumulate(np.array([b for _, b in taken])) if taken else starts
    free = []
    for kind, a, b in more:
        k = int(np.searchsorted(starts, b, "left")) - 1  # the last base span that begins before b
        if k < 0 or ends[k] <= a:
            free.append((kind, a, b))
    order = {kind: i for i, kind in enumerate(KINDS)}
    return base, sorted([*base, *free], key=lambda s: (order[s[0]], s[1], s[2]))


def show(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find(docs: DataFrame, model: Model | None = None, with_redacted: bool = False) -> DataFrame:
    """Per row: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added (and ``redacted`` with_redacted).

    Offsets count code points, ends are exclusive. In ``redacted`` each span, or run of overlapping
    spans, is replaced by the first one's kind in angle brackets. A null text is an empty one: no
    spans (redacted stays null). Nothing is shuffled: repeated rows, hot keys and null ids make no
    difference. An empty table gives no rows; other columns are ignored.
    """
    model = model or trained()
    names = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"] + ["redacted"] * with_redacted
    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long" + ", redacted string" * with_redacted

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                rows: list[list] = [[] for _ in names[1:]]
                for value in part.column(1):
                    raw = value.as_buffer()
                    text = "" if raw is None else raw.to_pybytes().decode("utf-8", "replace")
                    base, all_ = spans_of(text, model)
                    kinds = [k for k, _, _ in base]
                    cells = [*(kinds.count(k) for k in BASE), sha256(show(base).encode()), show(all_), len(all_) - len(base)]
                    if with_redacted:
                        cells.append(None if raw is None else redact(text, all_))
                    for column, cell in zip(rows, cells, strict=True):
                        column.append(cell)
                kinds_ = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()] + [pa.string()] * with_redacted
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, k) for c, k in zip(rows, kinds_, strict=True))], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def redact(text: str, spans: list[Span]) -> str:
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], s[2])):
        if a >= at:
            out += [text[at:a], f"<{kind}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def replace(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """The rows with all their columns, personal data in ``text`` replaced by its kind; ``n_chars`` follows, if there is one.

    A null text stays null, an empty one empty; repeated rows, ties and null ids make no difference, since
    each row is worked on alone and stays where it is. An empty table stays empty. Other columns stay as
    they are, whatever their names.
    """
    model = model or trained()
    at = docs.columns.index("text")
    chars = docs.columns.index("n_chars") if "n_chars" in docs.columns else -1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                texts: list[str | None] = []
                for value in part.column(at):
                    raw = value.as_buffer()
                    text = None if raw is None else raw.to_pybytes().decode("utf-8", "replace")
                    texts.append(text and redact(text, spans_of(text, model)[1]))
                columns = list(part.columns)
                columns[at] = pa.array(texts, columns[at].type)
                if chars >= 0:
                    columns[chars] = pa.array([None if t is None else len(t) for t in texts], columns[chars].type)
                yield pa.RecordBatch.from_arrays(columns, schema=part.schema)

    return docs.mapInArrow(run, docs.schema)
