"""SQL names from element names: snake case, fitted to a length, unique in their scope."""

from __future__ import annotations

import hashlib
import re
from string import ascii_lowercase, ascii_uppercase

LIMIT = 63
_LOWER = str.maketrans(ascii_uppercase, ascii_lowercase)


def snake(name: str) -> str:
    """An underscore before each capital but a first one, then lower case."""
    return re.sub(r"(?<!^)(?=[A-Z])", "_", name).translate(_LOWER)


def ucfirst(name: str) -> str:
    return name[:1].upper() + name[1:]


def hashed(full: str, limit: int = LIMIT) -> str:
    """The name's beginning, and eight hex digits of its SHA-256."""
    tail = hashlib.sha256(full.encode()).hexdigest()[:8]
    return f"{full[: limit - len(tail) - 1]}_{tail}"


def fit(full: str, limit: int = LIMIT) -> str:
    """The name, or if too long with its longest segments cut to four letters, the earliest of equals first; then the hash."""
    parts = full.split("_")
    while len("_".join(parts)) > limit:
        longest = max(parts, key=len)
        if len(longest) <= 4:
            return hashed(full, limit)
        parts[parts.index(longest)] = longest[:4]
    return "_".join(parts)


class Names:
    """The names of one scope: a name that is taken gets its hash."""

    def __init__(self, reserved: tuple[str, ...] = ()):
        self.taken = set(reserved)

    def give(self, full: str) -> str:
        name = fit(full)
        if name in self.taken:
            name = hashed(full)
        if name in self.taken:
            raise ValueError(f"two elements are named {name}")
        self.taken.add(name)
        return name
