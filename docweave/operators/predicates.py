"""Search values against one target's columns, as plain Column conditions that reach the scan."""

from __future__ import annotations

import re
from decimal import Decimal, InvalidOperation

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from docweave.functions.temporal import bounds, literal
from docweave.functions.text import fold, prefix_upper
from docweave.plans.model import Target


class UnsupportedSearch(ValueError):
    """A search that can't be answered; the message names the parameter, never a value of a document."""


PREFIXES = ("eq", "ne", "lt", "gt", "ge", "le", "sa", "eb", "ap")


def _prefix(value: str, known: tuple[str, ...]) -> tuple[str, str]:
    return (value[:2], value[2:]) if value[:2] in known else ("eq", value)


def string(schema: StructType, c: dict, value: str, modifier: str | None) -> Column:
    """By default the folded prefix, as a range; :exact compares as stored, :contains looks anywhere.

    Without a folded column only case is ignored.
    """
    col, norm = F.col(c["col"]), c.get("norm")
    if modifier == "exact":
        return col == value
    if modifier not in (None, "text", "contains"):
        raise UnsupportedSearch(f"no modifier :{modifier} for this parameter")
    if norm is None:
        low = F.lower(col)
        return low.contains(value.lower()) if modifier == "contains" else low.startswith(value.lower())
    term = fold(value)
    if modifier == "contains":
        return F.col(norm).contains(term)
    upper = prefix_upper(term)
    found = F.col(norm) >= term
    return found if upper is None else found & (F.col(norm) < upper)


def token(schema: StructType, c: dict, value: str, modifier: str | None) -> Column:
    """code, system|code, system| (any code), |code (no system). A target without a system matches no system."""
    code = F.col(c["code"])
    if schema[c["code"]].dataType.typeName() != "string":
        code = code.cast("string")
    system, bar, rest = value.partition("|")
    if not bar:
        return code == value
    if c.get("system") is None:
        return F.lit(False) if system else code == rest
    if not system:
        return F.col(c["system"]).isNull() & (code == rest)
    return F.col(c["system"]) == system if not rest else (F.col(c["system"]) == system) & (code == rest)


def number(schema: StructType, c: dict, value: str, modifier: str | None) -> Column:
    """Exact comparison with eq, ne, lt, gt, ge or le."""
    op, text = _prefix(value, PREFIXES[:6])
    try:
        amount = F.lit(Decimal(text))
    except InvalidOperation:
        raise UnsupportedSearch(f"{text!r} is no number") from None
    col = F.col(c["col"])
    if schema[c["col"]].dataType.typeName() in ("double", "float"):
        amount = F.lit(float(text))
    return {"eq": col == amount, "ne": col != amount, "lt": col < amount, "gt": col > amount, "ge": col >= amount, "le": col <= amount}[op]


def quantity(schema: StructType, c: dict, value: str, modifier: str | None) -> Column:
    """number[|system[|code]]; empty parts, and parts that the target has no column for, are ignored."""
    amount, system, code = ([*value.split("|", 2), "", ""])[:3]
    found = number(schema, c, amount, None)
    if system and c.get("system"):
        found &= F.col(c["system"]) == system
    if code and c.get("code"):
        found &= F.col(c["code"]) == code
    return found


def date(schema: StructType, c: dict, value: str, modifier: str | None) -> Column:
    """A point lies in the value's range; a period (with ``hi``) overlaps it.

    An open end reaches beyond all values. A row without either end matches no period comparison; ne
    is the negation, under which nulls match nothing.
    """
    op, text = _prefix(value, PREFIXES)
    found = bounds(text)
    if found is None:
        raise UnsupportedSearch(f"{text!r} is no date")
    if op == "ap":
        raise UnsupportedSearch("the prefix ap has no fixed meaning here")
    lo, end = F.col(c["lo"]), F.col(c["hi"]) if c.get("hi") else None
    first, last = (literal(x, schema[c["lo"]].dataType.simpleString()) for x in found)
    if end is None:
        point = {"lt": lo < first, "eb": lo < first, "gt": lo >= last, "sa": lo >= last, "ge": lo >= first, "le": lo < last}
        inside = (lo >= first) & (lo < last)
        return point.get(op, ~inside if op == "ne" else inside)
    known = lo.isNotNull() | end.isNotNull()
    overlap = (lo < last) & (end.isNull() | (end >= first))
    return {
        "eq": overlap, "ne": known & ~overlap, "lt": lo < first, "eb": lo < first, "le": lo < last,
        "gt": known & (end.isNull() | (end >= last)), "sa": known & (end.isNull() | (end >= last)), "ge": known & (end.isNull() | (end >= first)),
    }[op]


#: Texts of whole numbers as a cast gives them.
WHOLE = re.compile(r"0|-?[1-9][0-9]{0,17}", re.ASCII)


def same_id(schema: StructType, column: str, values: list[str]) -> Column:
    """Whether an id column has one of these values.

    Where a table has beside it the number that it is the text of, as ``<column>_key``, the numbers are
    compared too: a cast column can't be compared with the statistics of files, a plain one can.
    """
    found = F.col(column).isin(values) if len(values) > 1 else F.col(column) == values[0]
    if f"{column}_key" not in schema.names:
        return found
    whole = [int(v) for v in values if WHOLE.fullmatch(v)]
    return F.col(f"{column}_key").isin(whole) & found if whole else F.lit(False)


def reference(schema: StructType, c: dict, value: str, modifier: str | None) -> Column:
    """Type/id; an address, a urn or #fragment as stored; a bare id of any type, or of the modifier's type."""
    if "://" in value or value.startswith(("urn:", "#")):
        return F.col(c["url"]) == value
    kind, slash, id_ = value.partition("/")
    if slash:
        return (F.col(c["type"]) == kind) & same_id(schema, c["id"], [id_])
    found = same_id(schema, c["id"], [value])
    return (F.col(c["type"]) == modifier) & found if modifier else found


def uri(schema: StructType, c: dict, value: str, modifier: str | None) -> Column:
    return F.col(c["col"]) == value


KINDS = {"string": string, "token": token, "number": number, "quantity": quantity, "date": date, "reference": reference, "uri": uri}


def predicate(schema: StructType, target: Target, value: str, modifier: str | None) -> Column:
    """The condition on the target's own table. A modifier that the target's kind doesn't know is an error."""
    allowed = target.kind == "string" or (target.kind == "reference" and modifier is not None and modifier[:1].isupper())
    if modifier is not None and not allowed:
        raise UnsupportedSearch(f"no modifier :{modifier} for this parameter")
    return KINDS[target.kind](schema, target.columns, value, modifier)
