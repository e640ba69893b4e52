"""Documents against their types: what a definition asks for beyond what the tables can hold.

The shredder refuses what has no place in the tables. Here elements that must be there, numbers' signs and
the forms of codes, ids, addresses, times and encoded bytes are checked too, by rules for each type.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.functions.lexical import Number, loads
from docweave.plans.model import Element, RelMap, Resource
from docweave.plans.session import spread

#: The forms that the public specification gives its primitive types.
FORMS = {
    "id": r"[A-Za-z0-9\-.]{1,64}", "code": r"[^\s]+(?: [^\s]+)*", "oid": r"urn:oid:[0-2](?:\.(?:0|[1-9][0-9]*))+", "uuid": r"urn:uuid:[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}", "uri": r"\S*", "url": r"\S*", "canonical": r"\S*",
    "positiveInt": r"[1-9][0-9]*", "unsignedInt": r"0|[1-9][0-9]*", "time": r"(?:[01][0-9]|2[0-3]):[0-5][0-9]:(?:[0-5][0-9]|60)(?:\.[0-9]+)?", "base64Binary": r"(?:\s*[0-9A-Za-z+/=]\s*)*", "string": r"[\s\S]+", "markdown": r"[\s\S]+",
    "instant": r".*T.*(?:Z|[+-][0-9]{2}:[0-9]{2})",
}
PATTERNS = {kind: re.compile(form, re.ASCII if kind in ("positiveInt", "unsignedInt", "time") else 0) for kind, form in FORMS.items()}

Problem = tuple[str, str]


def problems(resource: Resource, document: Any) -> Iterator[Problem]:
    """(path, what is wrong) of one document; nothing of elements that the schema lacks, which the shredder refuses."""
    if isinstance(document, dict):
        yield from _node(resource, 0, document, "")


def _node(resource: Resource, node: int, value: dict, path: str) -> Iterator[Problem]:
    for e in resource.nodes[node]:
        here = f"{path}.{e.name}" if path else e.name
        names = [v.name for v in e.variants] if e.kind == "choice" else [e.name]
        if e.required and not any(n in value or f"_{n}" in value for n in names):
            yield here, "is missing"
        for one in e.variants if e.kind == "choice" else [e]:
            if one.name in value:
                yield from _value(resource, one, value[one.name], f"{path}.{one.name}" if path else one.name)


def _value(resource: Resource, e: Element, value: Any, path: str) -> Iterator[Problem]:
    for item in value if isinstance(value, list) else [value]:
        if e.kind == "group" and isinstance(item, dict):
            if not item:
                yield path, "holds nothing"
            yield from _node(resource, e.node, item, path)
        elif e.kind == "prim" and isinstance(item, str) and (form := PATTERNS.get(e.type)) and not form.fullmatch(str.__str__(item)):
            yield path, f"is no {e.type}"


def validate(docs: DataFrame, relmap: RelMap, body: str = "body", key: str | None = None) -> DataFrame:
    """(rtype, id, path, problem) of every document that breaks a rule, and ``key`` if it is named; nothing of those that are no documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["rtype", "id", "path", "problem", "key"]
        for batch in batches:
            out: list[tuple] = []
            for text, k in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    document = loads(text or "null")
                except (ValueError, RecursionError):
                    continue
                kind, id_ = (document.get("resourceType"), document.get("id")) if isinstance(document, dict) else (None, None)
                if type(kind) is str and kind in relmap.resources:
                    out += [(kind, id_ if isinstance(id_, str) and not isinstance(id_, Number) else None, p, what, k) for p, what in problems(relmap.resources[kind], document)]
            columns = list(zip(*out, strict=True)) if out else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if n == "key" else pa.string()) for n, c in zip(names, columns, strict=True)], names)

    rows = docs.select(F.col(body).cast("string").alias("body"), (F.col(key) if key else F.lit(None)).cast("long").alias("key"))
    found = spread(rows).mapInArrow(run, "rtype string, id string, path string, problem string, key long")
    return found if key else found.drop("key")
