"""Documents to typed rows: every document becomes rows of the map's tables, or one error that names a path.

Documents are read in Arrow batches by one pass of Python, because only there numbers keep their text;
the rows come out tagged by table, and each table is a filter and a projection of them.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from datetime import datetime
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from docweave.functions.leaves import DocumentError, flatten
from docweave.functions.lexical import Number, dumps, loads
from docweave.functions.refs import parse
from docweave.functions.temporal import bounds, date_sort, datetime_sort
from docweave.functions.text import fold
from docweave.plans.model import Element, RelMap, Resource, Table
from docweave.plans.session import scratch, spread

TAGGED = "rtype string, rid string, tbl string, ords array<smallint>, cols map<string,string>, error string"
#: ``tbl`` of a row that holds a document's canonical text as ``body``, and of one that holds an error.
BODY, ERROR = "*body", "*error"
#: Ordinals fit a smallint.
MOST_ITEMS = 32767


@F.pandas_udf(StringType())
def canonical(body: pd.Series) -> pd.Series:
    """Sorted keys, no white space, numbers as written."""
    return body.map(lambda b: None if b is None else dumps(loads(b), sort_keys=True))


class Rows:
    """One document's rows, by (table, ords)."""

    def __init__(self, resource: Resource):
        self.resource = resource
        self.rows: dict[tuple[int, tuple[int, ...]], dict[str, str]] = {}
        self.extra: list[tuple[str, tuple[int, ...], dict[str, str]]] = []

    def at(self, table: int, ords: tuple[int, ...]) -> dict[str, str]:
        return self.rows.setdefault((table, ords), {})


def _child(path: str, name: str) -> str:
    return f"{path}.{name}" if path else name


def shred_one(resource: Resource, document: Any) -> tuple[str | None, Rows]:
    """(id, rows); DocumentError if the document doesn't fit the map."""
    if not isinstance(document, dict):
        raise DocumentError("", "is not a JSON object")
    if document.get("resourceType") != resource.name:
        raise DocumentError("resourceType", f"names another type than {resource.name}")
    rows = Rows(resource)
    if not isinstance(document.get("id", ""), str):
        raise DocumentError("id", "is not text")
    _walk(rows, 0, document, 0, (), "", {"resourceType", "id"})
    return document.get("id"), rows


def _walk(rows: Rows, node: int, value: dict, table: int, ords: tuple[int, ...], path: str, known: set[str]) -> None:
    rows.at(table, ords)
    used = set(known)
    if not known and "id" in value:
        _element_id(rows, value["id"], path, ords)
        used.add("id")
    for key, modifier in (("extension", False), ("modifierExtension", True)):
        if key in value:
            _extensions(rows, value[key], path, ords, modifier)
            used.add(key)
    there = {k.removeprefix("_") for k in value}  # most elements of a wide node aren't
    for element in rows.resource.nodes[node]:
        if element.kind != "choice" and element.name not in there:
            continue
        if element.kind == "choice":
            found = [v for v in element.variants if v.name in value or f"_{v.name}" in value]
            if len(found) > 1:
                raise DocumentError(_child(path, found[1].name), f"excludes {found[0].name}, of the same choice")
            for variant in found:
                if element.table >= 0:
                    rows.at(element.table, (*ords, 1))
                    _element(rows, variant, value, element.table, (*ords, 1), path, used)
                else:
                    _element(rows, variant, value, table, ords, path, used)
        else:
            _element(rows, element, value, table, ords, path, used)
    for key in value:
        if key not in used:
            raise DocumentError(_child(path, key), "is not in the schema")


def _element(rows: Rows, e: Element, value: dict, table: int, ords: tuple[int, ...], path: str, used: set[str]) -> None:
    shadow = f"_{e.name}"
    if e.name not in value and shadow not in value:
        return
    used.update(k for k in (e.name, shadow) if k in value)
    here = _child(path, e.name)
    item = value.get(e.name)
    if e.kind in ("prim", "ref"):
        if e.many:
            _primitives(rows, e, item, value.get(shadow), ords, here)
            return
        if e.name in value:
            rows.at(table, ords).update(_columns(e, item, here))
        if shadow in value:
            _primitive_extension(rows, value[shadow], here, ords)
        return
    if shadow in value:
        raise DocumentError(_child(path, shadow), "is not in the schema")
    if e.kind == "group":
        if e.many:
            for i, one in _items(item, here):
                _group(rows, e, one, e.table, (*ords, e.lane * i), here)
        elif e.table >= 0:
            _group(rows, e, item, e.table, (*ords, e.lane), here)
        else:
            _group(rows, e, item, table, ords, here)
    elif e.kind == "spill":
        for leaf, kind, text in flatten(item, here):
            rows.extra.append(("deep", ords, {"path": here, "leaf": leaf} | _leaf(kind, text)))
    elif e.kind == "resource":
        if not isinstance(item, dict):
            raise DocumentError(here, "is not an object")
        rows.at(table, ords)[e.columns[0]] = dumps(item)
    else:  # contained
        for i, one in _items(item, here):
            if not isinstance(one, dict):
                raise DocumentError(here, "is not an object")
            rows.extra.append(("contained", (i,), {"resource": dumps(one)}))


def _group(rows: Rows, e: Element, item: Any, table: int, ords: tuple[int, ...], path: str) -> None:
    if not isinstance(item, dict):
        raise DocumentError(path, "is not an object")
    _walk(rows, e.node, item, table, ords, path, set())


def _items(value: Any, path: str) -> Iterator[tuple[int, Any]]:
    if not isinstance(value, list):
        raise DocumentError(path, "should be a list")
    if not value:
        raise DocumentError(path, "is a list of nothing")
    if len(value) > MOST_ITEMS:
        raise DocumentError(path, f"lists more than {MOST_ITEMS} items")
    return enumerate(value, 1)


def _primitives(rows: Rows, e: Element, values: Any, shadows: Any, ords: tuple[int, ...], path: str) -> None:
    lists = [[] if x is None else x for x in (values, shadows)]
    if not all(isinstance(x, list) for x in lists):
        raise DocumentError(path, "should be a list")
    n = max(map(len, lists))
    values, shadows = (x + [None] * (n - len(x)) for x in lists)
    for i, one in _items(values, path):
        shadow = shadows[i - 1]
        if one is None and shadow is None:
            raise DocumentError(path, f"item {i} has neither value nor extension")
        if one is not None:
            rows.at(e.table, (*ords, i)).update(_columns(e, one, path))
        if shadow is not None:
            _primitive_extension(rows, shadow, path, (*ords, i))


def _columns(e: Element, value: Any, path: str) -> dict[str, str]:
    if e.kind == "ref":
        if not isinstance(value, str):
            raise DocumentError(path, "is not text")
        return {c: v for c, v in zip(e.columns, parse(value), strict=True) if v is not None}
    return {e.columns[0]: image(e.prim, value, path)}


#: The texts of numbers that a type allows, whatever their range.
WHOLE = re.compile(r"-?(?:0|[1-9][0-9]*)", re.ASCII)
WHOLE64 = re.compile(r"[+-]?[0-9]+", re.ASCII)


def _within(text: str, pattern: re.Pattern, bits: int) -> bool:
    """A whole number of the two's-complement range."""
    return len(text) < 40 and pattern.fullmatch(text) is not None and -(1 << bits) <= int(text) < 1 << bits


INSTANT = re.compile(r"([0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2})(?::([0-9]{2})(?:\.[0-9]+)?)?(Z|[+-][0-9]{2}:[0-9]{2})?", re.ASCII)


def _stated(text: str, whole_days: bool) -> bool:
    """A year, a month, a day or, unless only whole days will do, an instant that there is; a leap second is one."""
    if len(text) <= 10:
        return text.isascii() and bounds(text) is not None
    m = None if whole_days else INSTANT.fullmatch(text)
    try:
        return m is not None and int(m[2] or 0) <= 60 and datetime.fromisoformat(m[1] + (m[3] or "")) is not None
    except ValueError:
        return False


#: For each primitive: which JSON values it takes, and which texts.
FITS = {
    "bool": (bool, None), "int": (Number, lambda t: _within(t, WHOLE, 31)), "int64": (str, lambda t: _within(t, WHOLE64, 63)), "decimal": (Number, None),
    "date": (str, lambda t: _stated(t, True)), "datetime": (str, lambda t: _stated(t, False)), "instant": (str, lambda t: _stated(t, False)),
}


def image(prim: str, value: Any, path: str) -> str:
    """The stored text of a primitive; an error if it is none of its type, or a date that there isn't."""
    kind, fits = FITS.get(prim, (str, None))
    ok = isinstance(value, kind) and (kind is Number) == isinstance(value, Number)
    text = {True: "true", False: "false"}[value] if isinstance(value, bool) else str.__str__(value) if ok else ""
    if not ok or fits and not fits(text):
        raise DocumentError(path, f"is no {prim}")
    return text


def _leaf(kind: str, text: str | None) -> dict[str, str]:
    return {"v_kind": kind} | ({} if text is None else {"v_text": text})


def _element_id(rows: Rows, value: Any, path: str, ords: tuple[int, ...]) -> None:
    if not isinstance(value, str):
        raise DocumentError(_child(path, "id"), "is not text")
    rows.extra.append(("ext", ords, {"path": path, "modifier": "false", "ext_ord": "0", "leaf": "id"} | _leaf("s", value)))


def _primitive_extension(rows: Rows, value: Any, path: str, ords: tuple[int, ...]) -> None:
    if not isinstance(value, dict):
        raise DocumentError(path, "has an underscored twin that is not an object")
    for key in value:
        if key not in ("id", "extension"):
            raise DocumentError(path, f"has an underscored twin with {key!r}")
    if "id" in value:
        _element_id(rows, value["id"], path, ords)
    if "extension" in value:
        _extensions(rows, value["extension"], path, ords, False)


def _extensions(rows: Rows, value: Any, path: str, ords: tuple[int, ...], modifier: bool) -> None:
    for i, one in _items(value, path):
        url = one.get("url") if isinstance(one, dict) else None
        if not isinstance(url, str) or isinstance(url, Number):
            raise DocumentError(path, "lists an extension that no url names")
        for leaf, kind, text in flatten(one, path, "url"):
            rows.extra.append(("ext", ords, {"path": path, "modifier": str(modifier).lower(), "ext_ord": str(i), "url": url, "leaf": leaf} | _leaf(kind, text)))


def fill_folded(table: Table, row: dict[str, str]) -> None:
    for c in table.columns:
        if c.derived and c.name.endswith("_norm") and c.derived in row:
            row[c.name] = fold(row[c.derived])


class Unusual(Exception):
    """A document that the short way doesn't take; it goes the whole way, which also names what is wrong."""


class Short:
    """The walk of shred_one() for documents without extensions and ids of elements, as a function made for the type.

    Its lines name the elements, so nothing of the map is looked up for each document. Rows go to flat lists,
    from which Arrow's arrays are made at once. What isn't taken raises Unusual, wherever it is.
    """

    def __init__(self, resource: Resource, wanted: frozenset[str]):
        self.resource, self.names = resource, [t.name for t in resource.tables]
        self.wanted = [not wanted or n in wanted for n in self.names]
        self.folded = [[(c.name, c.derived) for c in t.columns if c.derived and c.name.endswith("_norm")] for t in resource.tables]
        self.env: dict[str, Any] = {"Unusual": Unusual, "Number": Number, "fold": fold, "parse": parse, "M": object(), "N": resource.name}
        self.lines: list[str] = []
        self._say(0, "def make(out):", " (R, I, T, E), ov, kv = [c.append for c in out.kept[:4]], out.ords[1], out.cols[1]", " O, OA, OV, C, K, V = out.ords[0].append, ov.append, ov.extend, out.cols[0].append, kv.append, out.cols[2].append")
        todo, done = [(0, 0)], set()
        while todo:  # (node, the table of its rows)
            if (at := todo.pop()) not in done:
                done.add(at)
                self._function(*at, todo)
        self._say(1, "return w0_0")
        exec("\n".join(self.lines), self.env)  # noqa: S102 - lines made above, with names as literals

    def _say(self, depth: int, *lines: str) -> None:
        self.lines += [" " * depth + x for x in lines]

    def _function(self, node: int, table: int, todo: list) -> None:
        self._say(1, f"def w{node}_{table}(v0, ords, id_):")
        if self.wanted[table]:
            self._say(2, "C(len(kv))")
        self._own(node, table, 2, 0)
        if self.wanted[table]:
            self._say(2, f"R(N); I(id_); T({self.names[table]!r}); E(None); O(len(ov)); OV(ords)")
        self._children(node, 2, 0, todo)
        self._say(2, "return")

    def _each(self, node: int) -> Iterator[tuple[Element, bool]]:
        for e in self.resource.nodes[node]:
            yield from ((v, True) for v in e.variants) if e.kind == "choice" and e.table < 0 else [(e, False)] if e.kind in ("prim", "ref", "group") else []

    def _own(self, node: int, table: int, at: int, k: int) -> None:
        """Lines that put an object's values into its row, and count that it has no more than known members."""
        v, n, x = f"v{k}", f"n{k}", f"v{k + 1}"
        self._say(at, f"{n} = {2 if k == 0 and node == 0 else 0}")
        for e in self.resource.nodes[node]:
            if e.kind == "choice" and e.table < 0 and len(e.variants) > 1:
                self._say(at, f"if {' + '.join(f'({o.name!r} in {v})' for o in e.variants)} > 1: raise Unusual")
        for e, _ in self._each(node):
            if e.name in ("resourceType", "id", "extension", "modifierExtension"):
                continue
            self._say(at, f"{x} = {v}.get({e.name!r}, M)", f"if {x} is not M:", f" {n} += 1")
            if e.many or e.kind == "group" and e.table >= 0:
                continue
            if e.kind == "group":
                self._say(at + 1, f"if type({x}) is not dict: raise Unusual")
                self._own(e.node, table, at + 1, k + 1)
            else:
                self._value(e, table, x, at + 1)
        self._say(at, f"if {n} != len({v}): raise Unusual")

    def _value(self, e: Element, table: int, x: str, at: int) -> None:
        if e.kind == "ref":
            self._say(at, f"if type({x}) is not str: raise Unusual")
            if self.wanted[table]:
                self._say(at, f"a, b, c = parse({x})")
                for name, column in zip("abc", e.columns, strict=True):
                    self._say(at, f"if {name} is not None:")
                    self._put(table, column, name, at + 1)
            return
        kind, fits = FITS.get(e.prim, (str, None))
        test = f"type({x}) is not {kind.__name__}"
        if fits:
            self.env[f"fits_{e.prim}"] = fits
            plain = f"{x}.isdigit() and (len({x}) < 10 and {x}[0] != '0' or {x} == '0') or " if e.prim == "int" else ""
            test += f" or not ({plain}fits_{e.prim}({x}))"
        self._say(at, f"if {test}: raise Unusual")
        if self.wanted[table]:
            self._put(table, e.columns[0], f"'true' if {x} else 'false'" if kind is bool else x, at)

    def _put(self, table: int, column: str, text: str, at: int) -> None:
        self._say(at, f"K({column!r}); V({text})", *(f"K({name!r}); V(fold({text}))" for name, source in self.folded[table] if source == column))

    def _children(self, node: int, at: int, k: int, todo: list) -> None:
        """Lines that make the rows of an object's child tables."""
        v, x = f"v{k}", f"v{k + 1}"
        for e, _ in self._each(node):
            if e.name in ("resourceType", "id", "extension", "modifierExtension"):
                continue
            if e.kind == "group" and not e.many and e.table < 0:
                before = len(self.lines)
                self._say(at, f"{x} = {v}.get({e.name!r}, M)", f"if {x} is not M:")
                inside = len(self.lines)
                self._children(e.node, at + 1, k + 1, todo)
                if len(self.lines) == inside:
                    del self.lines[before:]
            elif e.many or e.kind == "group":
                self._say(at, f"{x} = {v}.get({e.name!r}, M)", f"if {x} is not M:")
                if e.kind == "group":
                    todo.append((e.node, e.table))
                if not e.many:
                    self._say(at + 1, f"if type({x}) is not dict: raise Unusual", f"w{e.node}_{e.table}({x}, (*ords, {e.lane}), id_)")
                    continue
                step = e.lane if e.kind == "group" else 1
                self._say(at + 1, f"if type({x}) is not list or not {x} or len({x}) > {MOST_ITEMS}: raise Unusual", "i = 0", f"for y in {x}:", f" i += {step}")
                if e.kind == "group":
                    self._say(at + 2, "if type(y) is not dict: raise Unusual", f"w{e.node}_{e.table}(y, (*ords, i), id_)")
                    continue
                if self.wanted[e.table]:
                    self._say(at + 2, "C(len(kv))")
                self._value(e, e.table, "y", at + 2)
                if self.wanted[e.table]:
                    self._say(at + 2, f"R(N); I(id_); T({self.names[e.table]!r}); E(None); O(len(ov)); OV(ords); OA(i)")

    def into(self, out: Flat) -> Any:
        """The function (document, (), its id) that adds rows to ``out``."""
        return self.env["make"](out)


class Flat:
    """Tagged rows as flat lists, of which whole Arrow arrays are made."""

    def __init__(self) -> None:
        self.kept: tuple[list, ...] = ([], [], [], [], [])  # rtype, rid, tbl, error, key
        self.ords: tuple[list, list] = ([], [])  # where each row's begin, None for no list; all of them
        self.cols: tuple[list, list, list] = ([], [], [])

    def add(self, rtype: str | None, rid: str | None, tbl: str | None, ords: Any, names: Any, texts: Any, error: str | None = None) -> None:
        for column, cell in zip(self.kept, (rtype, rid, tbl, error), strict=False):
            column.append(cell)
        self.ords[0].append(None if ords is None else len(self.ords[1]))
        self.cols[0].append(None if names is None else len(self.cols[1]))
        if ords:
            self.ords[1].extend(ords)
        if names:
            self.cols[1].extend(names)
            self.cols[2].extend(texts)

    def end(self, key: int | None) -> None:
        """The rows added since the last end() are of this key."""
        keys = self.kept[4]
        keys.extend([key] * (len(self.kept[0]) - len(keys)))

    def back(self) -> None:
        """The rows added, or begun, since the last end() go."""
        n = len(self.kept[4])
        for offsets, *values in (self.ords, self.cols):
            at = next((x for x in offsets[n:] if x is not None), None)
            for v in values:
                del v[len(v) if at is None else at :]
            del offsets[n:]
        for column in self.kept:
            del column[n:]

    def batch(self, keyed: bool) -> pa.RecordBatch:
        text = lambda x: pa.array(x, pa.string())
        places = lambda x, n: pa.array([*x, n], pa.int32())
        rtype, rid, tbl, error, key = self.kept
        ords = pa.ListArray.from_arrays(places(self.ords[0], len(self.ords[1])), pa.array(self.ords[1], pa.int16()))
        cols = pa.MapArray.from_arrays(places(self.cols[0], len(self.cols[1])), text(self.cols[1]), text(self.cols[2]))
        made = {"rtype": text(rtype), "rid": text(rid), "tbl": text(tbl), "ords": ords, "cols": cols, "error": text(error)} | ({"key": pa.array(key, pa.int64())} if keyed else {})
        return pa.RecordBatch.from_arrays(list(made.values()), list(made))


def tagged(docs: DataFrame, relmap: RelMap, body: str = "body", key: str | None = None, only: Iterable[str] = (), carry: Iterable[str] = ()) -> DataFrame:
    """Rows of all documents, tagged by type and table; a document that doesn't fit is one row with an error.

    Documents of a type that the map lacks are errors too. Null bodies are errors. With ``key``, a
    column of whole numbers, every row has its document's as ``key``, errors have the table ERROR, and
    each document that fits also gives its canonical text as a row of the table BODY. ``only`` names the
    tables whose rows are wanted; errors come anyway. ``carry`` names columns of ``docs`` that the rows of
    BODY and ERROR have as texts among theirs.
    """
    wanted, carried = frozenset(only), list(carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        short: dict[str, Short] = {}
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                out, ready = Flat(), {}
                for text, k, *more in zip(*(c.slice(lo, 512).to_pylist() for c in batch.columns), strict=True):
                    beside = [(n, v) for n, v in zip(carried, more, strict=True) if v is not None]
                    try:
                        document = loads(text or "null")
                        kind, id_ = (document.get("resourceType"), document.get("id")) if type(document) is dict else (None, None)
                        if type(kind) is not str or type(id_) is not str or kind not in relmap.resources:
                            raise Unusual
                        if kind not in ready:
                            if kind not in short:
                                short[kind] = Short(relmap.resources[kind], wanted)
                            ready[kind] = short[kind].into(out)
                        ready[kind](document, (), id_)
                        if key is not None and (not wanted or BODY in wanted):
                            out.add(kind, id_, BODY, None, *zip(("body", dumps(document, sort_keys=True)), *beside, strict=True))
                    except (Unusual, ValueError, RecursionError):
                        out.back()
                        for rtype, rid, tbl, ords, cols, error in _one(relmap, text, key is not None):
                            if tbl in (BODY, ERROR) and beside:
                                cols = [*(cols or []), *beside]
                            if not wanted or tbl in wanted or error:
                                out.add(rtype, rid, tbl, ords, *((None, None) if cols is None else ([c for c, _ in cols], [v for _, v in cols])), error)
                    out.end(k)
                yield out.batch(key is not None)

    rows = docs.select(F.col(body).cast("string").alias("body"), (F.col(key) if key else F.lit(None)).cast("long").alias("key"), *(F.col(c).cast("string").alias(f"__{c}") for c in carried))
    return spread(rows).mapInArrow(run, TAGGED + (", key long" if key else ""))


def _one(relmap: RelMap, text: str | None, whole: bool = False) -> Iterator[tuple]:
    kind = id_ = None
    try:
        document = loads(text or "null")
        kind, id_ = (document.get("resourceType"), document.get("id")) if isinstance(document, dict) else (None, None)
        if not isinstance(kind, str) or kind not in relmap.resources:
            raise DocumentError("resourceType", "missing, or no type of this map")
        resource = relmap.resources[kind]
        id_, rows = shred_one(resource, document)
        if id_ is None:
            raise DocumentError("id", "missing")
    except (DocumentError, ValueError, RecursionError) as problem:
        said = str(problem) if isinstance(problem, DocumentError) else "nested too deep" if isinstance(problem, RecursionError) else "not JSON"
        named = (x if isinstance(x, str) and not isinstance(x, Number) else None for x in (kind, id_))
        yield *named, ERROR if whole else None, None, None, said
        return
    if whole:
        yield kind, id_, BODY, None, [("body", dumps(document, sort_keys=True))], None
    for (table, ords), row in rows.rows.items():
        fill_folded(resource.tables[table], row)
        yield kind, id_, resource.tables[table].name, list(ords), list(row.items()), None
    for which, ords, row in rows.extra:
        yield kind, id_, f"{resource.base.name}_{which}", list(ords), list(row.items()), None


def errors(rows: DataFrame) -> DataFrame:
    return rows.where("error is not null").select("rtype", "rid", "error")


def table_of(rows: DataFrame, table: Table, more: list[Column] | None = None) -> DataFrame:
    """One table's typed rows: id and ``more`` for the base table, else rid and ords; derived columns computed."""
    mine = rows.where((F.col("tbl") == table.name) & F.col("error").isNull())
    value = lambda name: F.col("cols")[name]
    key = [F.col("rid").alias("id"), *(more or [])] if table.kind == "base" else [F.col("rid"), F.col("ords")]
    if table.kind == "contained":
        return mine.select("rid", F.col("ords")[0].alias("ord"), value("resource").alias("resource"))
    if table.kind in ("ext", "deep"):
        shared = [value("path").alias("path")]
        ext = [value("modifier").cast("boolean").alias("modifier"), value("ext_ord").cast("smallint").alias("ext_ord"), value("url").alias("url")]
        text, kind = value("v_text"), value("v_kind")
        leaf = [value("leaf").alias("leaf"), kind.alias("v_kind"), text.alias("v_text"), F.when(kind == "n", text.try_cast("decimal(38,18)")).alias("v_num"), F.when(kind == "b", text.cast("boolean")).alias("v_bool")]
        return mine.select(*key, *shared, *(ext if table.kind == "ext" else []), *leaf)
    columns = []
    for c in table.columns:
        source = value(c.derived or c.name)
        typed = {
            "bool": lambda s=source: s.try_cast("boolean"), "int": lambda s=source: s.try_cast("int"), "int64": lambda s=source: s.try_cast("bigint"),
            "num": lambda s=source: s.try_cast("decimal(38,18)"), "day": lambda s=source: date_sort(s), "instant": lambda s=source: datetime_sort(s),
        }.get(c.kind)
        columns.append((typed() if typed else value(c.name)).alias(c.name, metadata={"path": c.path}))
    return mine.select(*key, *columns)


def shred(docs: DataFrame, relmap: RelMap, kinds: list[str] | None = None, body: str = "body") -> tuple[dict[str, DataFrame], DataFrame]:
    """({table name: rows}, errors). The tagged rows are written once, in the shared folder, by table, so that each table is read of its own files."""
    path = scratch(docs.sparkSession, "shredded")
    tagged(docs, relmap, body).withColumn("tbl", F.coalesce("tbl", F.lit(ERROR))).write.partitionBy("tbl").parquet(path)
    rows = docs.sparkSession.read.schema(TAGGED.replace("tbl string, ", "") + ", tbl string").parquet(path)
    out = {t.name: table_of(rows.where(F.col("rtype") == k), t) for k in kinds or relmap.resources for t in relmap.resources[k].tables if t.kind != "history"}
    return out, errors(rows.where(F.col("tbl") == ERROR))
