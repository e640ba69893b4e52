"""The relational map of nested documents: tables, elements and search targets.

A map is plain data. It is built on the driver, travels to workers inside closures, and is stored as
gzipped JSON with a checksum.
"""

from __future__ import annotations

import dataclasses
import gzip
import hashlib
import json
from dataclasses import dataclass, field

#: Types of stored columns, by the primitive's kind.
SPARK = {
    "bool": "boolean", "int": "int", "int64": "bigint", "decimal": "string", "date": "string", "datetime": "string",
    "time": "string", "str": "string", "json": "string", "num": "decimal(38,18)", "day": "date", "instant": "timestamp",
}


@dataclass(frozen=True)
class Column:
    name: str
    kind: str  # a key of SPARK
    path: str = ""
    derived: str = ""  # the column it is computed from


@dataclass
class Table:
    name: str
    kind: str = "base"  # base, elem, ext, deep, contained or history
    columns: list[Column] = field(default_factory=list)

    def column(self, name: str) -> Column:
        return next(c for c in self.columns if c.name == name)


@dataclass(frozen=True)
class Target:
    """Where a search parameter looks: ``table`` 0 is the base table, others are child tables by index.

    kind and columns: string (col, norm), token (code, system), date (lo, hi), number (col),
    quantity (col, system, code), reference (type, id, url), uri (col).
    """

    table: int
    kind: str
    columns: dict[str, str | None]


@dataclass
class Param:
    code: str
    kind: str
    targets: list[Target] = field(default_factory=list)
    note: str = ""


@dataclass
class Element:
    """One element of a document's tree.

    kind: prim, ref, group, choice, spill, resource or contained. ``table`` is the table it opens, if
    it repeats or was split off; ``columns`` are those it fills; ``node`` is its children's node.
    """

    name: str
    kind: str
    prim: str = ""
    many: bool = False
    table: int = -1
    columns: list[str] = field(default_factory=list)
    node: int = -1
    lane: int = 1  # -1: the second way into a shared table, with negated ordinals
    type: str = ""  # as the definition names it
    required: bool = False
    variants: list[Element] = field(default_factory=list)


@dataclass
class Resource:
    name: str
    tables: list[Table] = field(default_factory=list)
    nodes: list[list[Element]] = field(default_factory=list)
    params: list[Param] = field(default_factory=list)

    @property
    def base(self) -> Table:
        return self.tables[0]

    def param(self, code: str) -> Param | None:
        return next((p for p in self.params if p.code == code), None)


@dataclass
class RelMap:
    schema: str
    resources: dict[str, Resource] = field(default_factory=dict)

    def to_bytes(self) -> bytes:
        return gzip.compress(json.dumps(dataclasses.asdict(self), sort_keys=True).encode(), mtime=0)

    def checksum(self) -> str:
        return hashlib.sha256(self.to_bytes()).hexdigest()

    @staticmethod
    def from_bytes(raw: bytes) -> RelMap:
        data = json.loads(gzip.decompress(raw))

        def element(x: dict) -> Element:
            return Element(**(x | {"variants": [element(v) for v in x["variants"]]}))

        def resource(x: dict) -> Resource:
            return Resource(
                x["name"],
                [Table(t["name"], t["kind"], [Column(**c) for c in t["columns"]]) for t in x["tables"]],
                [[element(e) for e in n] for n in x["nodes"]],
                [Param(p["code"], p["kind"], [Target(**t) for t in p["targets"]], p["note"]) for p in x["params"]],
            )

        return RelMap(data["schema"], {k: resource(v) for k, v in data["resources"].items()})
