"""Folding for case- and accent-insensitive search, and the bounds of a folded prefix."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def fold(text: str) -> str:
    """Decompose, drop marks, lower-case, and once more: idempotent. Letters such as ß stay."""
    for _ in range(2):
        text = "".join(c for c in unicodedata.normalize("NFD", text) if unicodedata.category(c)[0] != "M").lower()
    return "".join(c for c in unicodedata.normalize("NFD", text) if unicodedata.category(c)[0] != "M")


#: Texts that are Python's at a time.
FOLDED_AT_ONCE = 64


@F.arrow_udf(StringType())
def _fold_udf(values: pa.Array) -> pa.Array:
    parts = [pa.array([None if v is None else fold(v) for v in values.slice(lo, FOLDED_AT_ONCE).to_pylist()], pa.string()) for lo in range(0, len(values), FOLDED_AT_ONCE)]
    return pa.concat_arrays(parts) if parts else values


def folded(column: Column) -> Column:
    """fold() as a column; null stays null. No built-in drops marks exactly, so texts beyond ASCII go through Python, a few at a time; others don't."""
    plain = F.length(column) == F.octet_length(column)
    return F.when(plain, F.lower(column)).otherwise(_fold_udf(F.when(~plain, column)))


def prefix_upper(prefix: str) -> str | None:
    """The least string above all that begin with ``prefix``; None if only the lower bound constrains anything."""
    while prefix:
        head, code = prefix[:-1], ord(prefix[-1]) + 1
        if code == 0xD800:
            code = 0xE000  # surrogates are no characters
        if code <= 0x10FFFF:
            return head + chr(code)
        prefix = head
    return None
