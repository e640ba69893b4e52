"""What may come in from outside: ids, principals, hosts and request ids."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column

ID = re.compile(r"[A-Za-z0-9.-]{1,64}")
TOKEN = re.compile(r"[\x21-\x7e]{1,256}")
HOST = re.compile(r"(?:[A-Za-z0-9.-]{1,253}|\[[0-9A-Fa-f:.]{2,45}\])(?::[0-9]{1,5})?")


def valid_id(value: str | Column) -> bool | Column:
    """Whether a text, or each of a column, may be an id."""
    if isinstance(value, Column):
        return value.rlike(f"^(?:{ID.pattern})\\z")
    return bool(ID.fullmatch(value))


def principal(value: str | None) -> str:
    """A caller's name for the log; empty if it is missing, too long or has control characters."""
    return value if value and TOKEN.fullmatch(value) else ""


def request_id(value: str | None, fallback: str) -> str:
    return value if value and len(value) <= 128 and TOKEN.fullmatch(value) else fallback


def valid_host(value: str) -> bool:
    return bool(HOST.fullmatch(value))


def criteria_key(kind: str, criteria: list[tuple[str, str]]) -> int:
    """One signed 64-bit number for the same criteria in any order: what conditional changes are serialised by."""
    text = "&".join(f"{k}={v}" for k, v in sorted(criteria))
    return int.from_bytes(hashlib.sha256(f"{kind}?{text}".encode()).digest()[:8], "big", signed=True)
