"""Integrity of the version history: verification, witness, counter-signatures, erasure, keys."""

from __future__ import annotations

import hashlib
import os
import stat
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweave.functions.digests import link, preimage, sha3_link, tag, tag_verdict

KEY_BYTES = 32


@dataclass
class KeyRing:
    """The signing key, and retired ones that still verify."""

    signing: tuple[str, bytes] | None = None
    retired: dict[str, bytes] = field(default_factory=dict)

    def all(self) -> dict[str, bytes]:
        return self.retired | ({self.signing[0]: self.signing[1]} if self.signing else {})

    def rotated(self, key: tuple[str, bytes]) -> KeyRing:
        return KeyRing(key, self.all())


def new_key(path: str) -> tuple[str, bytes]:
    """Writes a random key that only its owner may read; an existing file is an error."""
    raw = os.urandom(KEY_BYTES)
    with os.fdopen(os.open(path, os.O_WRONLY | os.O_CREAT | os.O_EXCL, 0o600), "w") as out:
        out.write(raw.hex() + "\n")
    return load_key(path)


def load_key(path: str) -> tuple[str, bytes]:
    """(id, secret); files that others may read, and short keys, are refused."""
    if os.name == "posix" and os.stat(path).st_mode & (stat.S_IRWXG | stat.S_IRWXO):
        raise PermissionError("a key file must be readable by its owner alone")
    try:
        raw = bytes.fromhex(Path(path).read_text().strip())
    except ValueError:
        raise ValueError("a key file holds hex digits") from None
    if len(raw) < KEY_BYTES:
        raise ValueError(f"a key has {KEY_BYTES} bytes or more")
    return hashlib.sha256(raw).hexdigest()[:16], raw


def image(df: DataFrame) -> Column:
    return preimage(df["id"], df["version_id"], df["last_updated"], df["op"], df["resource"], df["actor"])


def verify(history: DataFrame, keys: dict[str, bytes] | None = None, signatures: DataFrame | None = None) -> DataFrame:
    """(rtype, id, version_id, what) of every break: sha256, sha3-256, link, sha3 link or mac.

    Each row is recomputed from the digest it stores as its predecessor, so one altered row is reported
    once; that it names the row before as predecessor is a window over the document's versions. Rows
    without digests and erasure marks, X, aren't recomputed. A counter-signature stands in for a tag
    that is absent or names a key that isn't here.
    """
    w = Window.partitionBy("rtype", "id").orderBy("version_id")
    rows = history.select("*", F.lag("row_hash").over(w).alias("__before"), F.lag("row_hash3").over(w).alias("__before3"), F.lag("op").over(w).alias("__op"))
    im = image(rows)
    rows = rows.withColumn("__image", im)
    rows = rows.withColumn("__sha3", sha3_link(F.col("prev_hash3"), F.col("__image")))
    live = F.col("row_hash").isNotNull() & (F.col("op") != "X")
    checks = [
        F.when(live & ~F.col("row_hash").eqNullSafe(link(F.col("prev_hash"), F.col("__image"))), F.lit("sha256")),
        F.when(live & ~F.col("row_hash3").eqNullSafe(F.col("__sha3")), F.lit("sha3-256")),
        F.when(live & ~F.col("prev_hash").eqNullSafe(F.col("__before")), F.lit("link")),
        F.when(live & ~F.col("prev_hash3").eqNullSafe(F.col("__before3")), F.lit("sha3 link")),
    ]
    if keys is not None:
        rows = rows.withColumn("__mac", tag_verdict(keys)("row_mac", "prev_hash", "__image"))
        if signatures is not None:
            signed = signatures.select("rtype", "id", "version_id", F.col("row_mac").alias("__sig"))
            rows = rows.join(signed, ["rtype", "id", "version_id"], "left").withColumn("__smac", tag_verdict(keys)("__sig", "prev_hash", "__image"))
            found = (F.col("__mac") == "mismatch") | (F.col("__mac").isin("absent", "unverifiable") & (F.col("__smac") == "mismatch"))
        else:
            found = F.col("__mac") == "mismatch"
        checks.append(F.when(live & found, F.lit("mac")))
    return rows.select("rtype", "id", "version_id", F.explode(F.array_compact(F.array(*checks))).alias("what")).distinct()


def heads(history: DataFrame) -> DataFrame:
    """The last row of each document's chain."""
    return history.groupBy("rtype", "id").agg(F.max_by(F.struct("version_id", "row_hash", "row_hash3"), "version_id").alias("head")).select("rtype", "id", "head.*")


#: Groups of the witness's first level.
WITNESS_GROUPS = 4096


def witness(history: DataFrame, key: tuple[str, bytes] | None = None) -> DataFrame:
    """One row, ``witness``: the number of chains and a digest over all heads; with a key also ``mac``.

    Heads are digested in two levels, by hash group and then over the groups, so that no task sees
    them all; a group holds one of WITNESS_GROUPS parts of the documents.
    """
    line = F.concat_ws("|", "rtype", "id", F.col("version_id").cast("string"), F.coalesce(F.hex("row_hash"), F.lit("")))
    rows = heads(history).select(F.pmod(F.conv(F.substring(F.sha2(F.concat_ws("|", "rtype", "id"), 256), 1, 8), 16, 10).cast("long"), F.lit(WITNESS_GROUPS)).alias("g"), line.alias("line"))
    groups = rows.groupBy("g").agg(F.count("*").alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list("line")), "\n"), 256).alias("d"))
    all_ = groups.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.array_sort(F.collect_list(F.struct("g", "d"))).alias("ds"))
    total = F.sha2(F.array_join(F.transform("ds", lambda x: F.concat_ws(":", x["g"].cast("string"), x["d"])), "\n"), 256)
    found = all_.select(F.concat_ws(":", F.col("n").cast("string"), total).alias("witness"))
    if key is None:
        return found
    row = found.first()
    return found.withColumn("mac", F.lit(tag(key, None, row.witness.encode())))


def resign(history: DataFrame, signatures: DataFrame, ring: KeyRing, at: Column, actor: str, reason: str) -> DataFrame:
    """New counter-signatures by the signing key for every row that lacks one; an error if the history doesn't verify.

    (rtype, id, version_id, row_mac, signed_at, actor, reason), to be appended; a second run adds none.
    """
    if ring.signing is None:
        raise ValueError("there is no signing key")
    if verify(history, ring.all(), signatures).limit(1).count():
        raise ValueError("the history does not verify; nothing was signed")
    name, secret = ring.signing

    @F.pandas_udf("string")
    def sign(before, images):  # noqa: ANN001, ANN202
        import pandas as pd

        return pd.Series([tag((name, secret), bytes(b) if b is not None else None, i.encode()) for b, i in zip(before, images, strict=True)])

    rows = history.where(F.col("row_hash").isNotNull() & (F.col("op") != "X"))
    made = rows.select("rtype", "id", "version_id", sign(F.col("prev_hash"), image(rows)).alias("row_mac"), at.alias("signed_at"), F.lit(actor).alias("actor"), F.lit(reason).alias("reason"))
    have = signatures.select("rtype", "id", "version_id", "row_mac")
    return made.join(have, ["rtype", "id", "version_id", "row_mac"], "left_anti").select(*made.columns)


def purge(history: DataFrame, gone: DataFrame, at: Column, actor: str, reason: str) -> DataFrame:
    """The history without the documents in ``gone`` (rtype, id): of each one mark, X, at the next version.

    The mark holds no content, and keeps the digests that the chain ended with.
    """
    # by columns of the history, in its order
    kept = history.join(gone, ["rtype", "id"], "left_anti").select(*history.columns)
    last = history.join(gone.distinct(), ["rtype", "id"], "left_semi").groupBy("rtype", "id").agg(F.max_by(F.struct("version_id", "row_hash", "row_hash3"), "version_id").alias("h"))
    values = {
        "rtype": F.col("rtype"), "id": F.col("id"), "version_id": F.col("h.version_id") + 1, "last_updated": at, "op": F.lit("X"), "actor": F.lit(actor), "reason": F.lit(reason),
        "prev_hash": F.col("h.row_hash"), "prev_hash3": F.col("h.row_hash3"),
    }
    marks = last.select(*(values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in history.schema))
    return kept.unionByName(marks)
