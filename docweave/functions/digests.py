"""Digests that Spark has no function for: SHA3-256, keyed tags, and chains of links."""

from __future__ import annotations

import hashlib
import hmac
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType, StructField, StructType

GENESIS = bytes(32)


def rendered(at: Column) -> Column:
    """A time in UTC microseconds, as digests are taken of it."""
    return F.date_format(at, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def preimage(id_: Column, version: Column, at: Column, op: Column, resource: Column, actor: Column) -> Column:
    """What a history row commits to: its fields joined by bars, the time in UTC microseconds."""
    return F.concat_ws("|", id_, version.cast("string"), rendered(at), op, F.coalesce(resource, F.lit("")), F.coalesce(actor, F.lit("")))


def link(before: Column, image: Column) -> Column:
    """SHA-256 of the digest before (zeros at first) and the pre-image, as bytes."""
    return F.unhex(F.sha2(F.concat(F.coalesce(before, F.lit(GENESIS)), F.encode(image, "UTF-8")), 256))


@F.pandas_udf(BinaryType())
def sha3_link(before: pd.Series, image: pd.Series) -> pd.Series:
    return pd.Series([None if i is None else hashlib.sha3_256((bytes(b) if b is not None else GENESIS) + i.encode()).digest() for b, i in zip(before, image, strict=True)])


LINKS = StructType([StructField("prev_hash", BinaryType()), StructField("row_hash", BinaryType()), StructField("prev_hash3", BinaryType()), StructField("row_hash3", BinaryType()), StructField("row_mac", StringType())])


def linked(rows: DataFrame, key: tuple[str, bytes] | None, order: str = "version_id") -> DataFrame:
    """Rows (rtype, id, version_id, image, last, last3 and any others) with their links, in order of each document's versions.

    ``order`` is the column that orders them; rows that a window by (rtype, id) in this order gave aren't dealt or sorted again.

    ``last`` and ``last3`` are the digests that the document's chain ended with before these rows, or null.
    A document's versions are one task's, sorted, and pass through it one after the other, however many.
    """
    names = rows.columns
    at = {n: names.index(n) for n in ("rtype", "id", "image", "last", "last3")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, a, b = None, None, None
        for batch in batches:
            made: tuple[list, ...] = ([], [], [], [], [])
            for rtype, id_, image, last, last3 in zip(*(batch.column(at[n]).to_pylist() for n in at), strict=True):
                if (rtype, id_) != now:
                    now, a, b = (rtype, id_), last, last3
                raw = image.encode()
                x, y = hashlib.sha256((a or GENESIS) + raw).digest(), hashlib.sha3_256((b or GENESIS) + raw).digest()
                for column, cell in zip(made, (a, x, b, y, tag(key, a, raw) if key else None), strict=True):
                    column.append(cell)
                a, b = x, y
            kinds = [pa.string() if f.name == "row_mac" else pa.binary() for f in LINKS]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, k) for c, k in zip(made, kinds, strict=True))], [*names, *LINKS.names])

    sorted_ = rows.repartition("rtype", "id").sortWithinPartitions("rtype", "id", order)
    return sorted_.mapInArrow(run, StructType([*rows.schema.fields, *LINKS.fields]))


def tag(key: tuple[str, bytes], before: bytes | None, image: bytes) -> str:
    """HMAC-SHA-256 over the digest before and the pre-image, as key id and hex."""
    return f"{key[0]}:{hmac.new(key[1], (before or GENESIS) + image, hashlib.sha256).hexdigest()}"


def check_tag(stored: str | None, keys: dict[str, bytes], before: bytes | None, image: bytes) -> str:
    """ok, mismatch, absent, unverifiable (a key that isn't here) or malformed. Only a mismatch is a finding."""
    if stored is None:
        return "absent"
    name, colon, digest = stored.partition(":")
    if not colon or len(digest) != 64 or any(c not in "0123456789abcdef" for c in digest):
        return "malformed"
    if name not in keys:
        return "unverifiable"
    return "ok" if hmac.compare_digest(tag((name, keys[name]), before, image), stored) else "mismatch"


def tag_verdict(keys: dict[str, bytes]):  # noqa: ANN201
    @F.pandas_udf(StringType())
    def verdict(stored: pd.Series, before: pd.Series, image: pd.Series) -> pd.Series:
        return pd.Series([check_tag(s, keys, bytes(b) if b is not None else None, i.encode()) for s, b, i in zip(stored, before, image, strict=True)])

    return verdict
