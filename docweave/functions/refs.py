"""References: Type/id, or anything else kept as it is."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse(reference: str) -> tuple[str | None, str | None, str | None]:
    """(type, id, url): type and id of exactly two segments, the first of which begins with an upper-case letter."""
    parts = reference.split("/")
    plain = "://" not in reference and not reference.startswith(("#", "urn:"))
    if plain and len(parts) == 2 and parts[0] and parts[1] and parts[0][0].isupper():
        return parts[0], parts[1], None
    return None, None, reference


def split(column: Column) -> tuple[Column, Column, Column]:
    """parse() as three columns; null gives three nulls."""
    local = column.rlike(r"^\p{Lu}[^/]*/[^/]+$") & ~F.contains(column, F.lit("://")) & ~column.rlike("^(#|urn:)")
    two = F.split(column, "/", 2)
    return F.when(local, two[0]), F.when(local, two[1]), F.when(~local, column)


def join(kind: Column, id_: Column, url: Column) -> Column:
    """The reference as it was; an error if a row has both forms."""
    both = (kind.isNotNull() | id_.isNotNull()) & url.isNotNull()
    return F.when(both, F.raise_error(F.lit("a reference with both forms"))).otherwise(F.coalesce(F.concat(kind, F.lit("/"), id_), url))
