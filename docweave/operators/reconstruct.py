"""Typed rows back to documents, losslessly, with an audit that every row was used once."""

from __future__ import annotations

import json
from collections.abc import Iterator
from json.encoder import encode_basestring
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.functions.leaves import DocumentError, unflatten
from docweave.functions.lexical import Number, dumps, loads
from docweave.plans.model import Element, RelMap, Resource

Ords = tuple[int, ...]


class Builder:
    def __init__(self, resource: Resource, rows: list[tuple[str, Ords, dict[str, str]]]):
        self.resource = resource
        number = {t.name: i for i, t in enumerate(resource.tables)}
        self.rows: dict[tuple[int, Ords], dict[str, str]] = {}
        self.kids: dict[tuple[int, Ords], list[int]] = {}
        self.ext: dict[tuple[str, Ords], list[dict[str, str]]] = {}
        self.ext_kids: dict[tuple[str, Ords], set[int]] = {}
        self.deep: dict[tuple[str, Ords], list[dict[str, str]]] = {}
        self.contained: dict[int, str] = {}
        for name, ords, cols in rows:
            kind = resource.tables[number[name]].kind
            if kind == "ext":
                self.ext.setdefault((cols["path"], ords), []).append(cols)
                if ords:
                    self.ext_kids.setdefault((cols["path"], ords[:-1]), set()).add(ords[-1])
            elif kind == "deep":
                self.deep.setdefault((cols["path"], ords), []).append(cols)
            elif kind == "contained":
                self.contained[ords[0]] = cols["resource"]
            else:
                key = (number[name], ords)
                if key in self.rows:
                    raise DocumentError("", "two rows of a table have one place")
                self.rows[key] = cols
                if ords:
                    self.kids.setdefault((key[0], ords[:-1]), []).append(ords[-1])
        self.left = set(self.rows)

    def take(self, table: int, ords: Ords) -> dict[str, str]:
        self.left.discard((table, ords))
        return self.rows[table, ords]

    def document(self, id_: str | None) -> dict:
        if (0, ()) not in self.rows:
            raise DocumentError("", "has rows, but none in the base table")
        out: dict[str, Any] = {"resourceType": self.resource.name}
        if id_ is not None:
            out["id"] = id_
        self.fill(out, 0, 0, (), self.take(0, ()), "")
        if self.left:
            raise DocumentError("", f"{len(self.left)} rows of {len(self.rows)} belong nowhere")
        for rest, what in ((self.ext, "extension"), (self.deep, "spill"), (self.contained, "contained")):
            if rest:
                raise DocumentError("", f"{what} rows belong nowhere")
        return out

    def fill(self, out: dict, node: int, table: int, ords: Ords, row: dict[str, str], path: str) -> None:
        self.attached(out, path, ords, elements=True)
        for e in self.resource.nodes[node]:
            if e.kind == "choice":
                at, place = row, (table, ords)
                if e.table >= 0:
                    if (e.table, (*ords, 1)) not in self.rows:
                        continue
                    place = (e.table, (*ords, 1))
                    at = self.take(*place)
                for v in e.variants:
                    self.element(out, v, *place, at, path)
            elif e.kind == "prim" and not e.many and e.columns[0] not in row and ((f"{path}.{e.name}" if path else e.name), ords) not in self.ext:
                continue  # most elements of a wide node aren't there
            else:
                self.element(out, e, table, ords, row, path)

    def element(self, out: dict, e: Element, table: int, ords: Ords, row: dict[str, str], path: str) -> None:
        here = f"{path}.{e.name}" if path else e.name
        if e.kind in ("prim", "ref"):
            if e.many:
                self.primitives(out, e, ords, here)
                return
            value = self.value(e, row)
            if value is not None:
                out[e.name] = value
            shadow: dict[str, Any] = {}
            self.attached(shadow, here, ords)
            if shadow:
                out[f"_{e.name}"] = shadow
        elif e.kind == "group":
            if e.many:
                lane = sorted(abs(o) for o in self.kids.get((e.table, ords), []) if o * e.lane > 0)
                if lane != list(range(1, len(lane) + 1)):
                    raise DocumentError(here, "positions are not 1, 2, 3 and so on")
                if lane:
                    out[e.name] = [self.group(e, e.table, (*ords, e.lane * i), here) for i in lane]
            elif e.table >= 0:
                if (e.table, (*ords, e.lane)) in self.rows:
                    out[e.name] = self.group(e, e.table, (*ords, e.lane), here)
            else:
                inner: dict[str, Any] = {}
                self.fill(inner, e.node, table, ords, row, here)
                if inner:
                    out[e.name] = inner
        elif e.kind == "spill":
            leaves = self.deep.pop((here, ords), None)
            if leaves:
                out[e.name] = unflatten([(x["leaf"], x["v_kind"], x.get("v_text")) for x in leaves])
        elif e.kind == "resource":
            if row.get(e.columns[0]) is not None:
                out[e.name] = loads(row[e.columns[0]])
        elif self.contained:
            found = sorted(self.contained)
            if found != list(range(1, len(found) + 1)):
                raise DocumentError(here, "positions are not 1, 2, 3 and so on")
            out[e.name] = [loads(self.contained.pop(i)) for i in found]

    def group(self, e: Element, table: int, ords: Ords, path: str) -> dict:
        inner: dict[str, Any] = {}
        self.fill(inner, e.node, table, ords, self.take(table, ords), path)
        return inner

    def value(self, e: Element, row: dict[str, str]) -> Any:
        if e.kind == "ref":
            kind, id_, url = (row.get(c) for c in e.columns)
            if url is not None and (kind is not None or id_ is not None):
                raise DocumentError(e.name, "refers both to a document and to a url")
            return url if kind is None else f"{kind}/{id_}"
        text = row.get(e.columns[0])
        if text is None:
            return None
        if e.prim == "bool":
            return text == "true"
        return Number(text) if e.prim in ("int", "decimal") else text

    def primitives(self, out: dict, e: Element, ords: Ords, path: str) -> None:
        n = max([0, *self.kids.get((e.table, ords), []), *self.ext_kids.get((path, ords), ())])
        values, shadows = [], []
        for i in range(1, n + 1):
            there = (e.table, (*ords, i))
            values.append(self.value(e, self.take(*there)) if there in self.rows else None)
            shadow: dict[str, Any] = {}
            self.attached(shadow, path, (*ords, i))
            shadows.append(shadow or None)
        if any(v is not None for v in values):
            out[e.name] = values
        if any(shadows):
            out[f"_{e.name}"] = shadows

    def attached(self, out: dict, path: str, ords: Ords, elements: bool = False) -> None:
        """An element's id and extensions."""
        mine = self.ext.pop((path, ords), None)
        if mine is None:
            return
        groups: dict[tuple[str, int], tuple[str, list]] = {}
        for x in mine:
            if x["ext_ord"] == "0":
                out["id"] = x["v_text"]
                continue
            key = ("modifierExtension" if x["modifier"] == "true" else "extension", int(x["ext_ord"]))
            groups.setdefault(key, (x["url"], []))[1].append((x["leaf"], x["v_kind"], x.get("v_text")))
        for (name, i), (url, leaves) in sorted(groups.items()):
            if name == "modifierExtension" and not elements:
                raise DocumentError(path, "a primitive can not have a modifier")
            have = out.setdefault(name, [])
            if len(have) + 1 != i:
                raise DocumentError(path, "extensions are not 1, 2, 3 and so on")
            have.append({"url": url} | unflatten(leaves))


class Unusual(Exception):
    """Rows that the short way doesn't take; they go through Builder, which also names what is wrong."""


class Short:
    """Builder's text for documents without extensions, spills and contained ones, as a function made for the type.

    Its lines name the elements. Rows that are left at the end, and all else that isn't taken, raise Unusual.
    """

    def __init__(self, resource: Resource):
        self.resource, self.plain = resource, [t.kind in ("base", "elem") for t in resource.tables]
        self.env: dict[str, Any] = {"Unusual": Unusual, "q": encode_basestring}
        self.lines: list[str] = []
        todo, done = [0], set()
        while todo:
            if (node := todo.pop()) not in done:
                done.add(node)
                self._say(0, f"def b{node}(row, ords, H):", " o = []")
                self._fill(node, 1, "o", todo)
                self._say(1, "return ','.join(o)")
        exec("\n".join(self.lines), self.env)  # noqa: S102 - lines made here, with names as literals
        self.base, self.head = self.env["b0"], '{"resourceType":' + dumps(resource.name)

    def _say(self, depth: int, *lines: str) -> None:
        self.lines += [" " * depth + x for x in lines]

    def text(self, id_: str | None, rows: list[list]) -> str:
        held: list[dict | None] = [{} if p else None for p in self.plain]
        for table, ords, cols in rows:
            mine, place = held[table], tuple(ords)
            if mine is None or place in mine:
                raise Unusual
            mine[place] = cols
        base = held[0].pop((), None)
        if base is None:
            raise Unusual
        inner = self.base(base, (), held)
        if any(held):
            raise Unusual
        return ",".join([self.head, *([] if id_ is None else [f'"id":{dumps(id_)}']), *([inner] if inner else [])]) + "}"

    def _value(self, e: Element, t: str) -> str:
        if e.prim == "bool":
            return f"('true' if {t} == 'true' else 'false')"
        return t if e.prim in ("int", "decimal") else f"q({t})"

    def _read(self, e: Element, row: str, at: int, put: str) -> None:
        """Lines that take a value from a row, and ``put`` its text t if it is there."""
        if e.kind == "ref":
            kind, id_, url = (f"{row}.get({c!r})" for c in e.columns)
            self._say(at, f"k, d, u = {kind}, {id_}, {url}", "if u is not None and (k is not None or d is not None): raise Unusual", "t = u if k is None else f'{k}/{d}'", "if t is not None:", " t = q(t)", f" {put}")
        else:
            self._say(at, f"t = {row}.get({e.columns[0]!r})", "if t is not None:", f" t = {self._value(e, 't')}", f" {put}")

    def _fill(self, node: int, at: int, o: str, todo: list) -> None:
        for whole in self.resource.nodes[node]:
            if whole.kind == "choice" and whole.table >= 0:
                continue  # its rows, if any, are left
            for e in whole.variants if whole.kind == "choice" else [whole]:
                name = f"{dumps(e.name)}:"
                if e.kind in ("prim", "ref") and e.many:
                    self._say(at, "i, x = 1, []", f"while (r := H[{e.table}].pop((*ords, i), None)) is not None:", " i += 1")
                    self._read(e, "r", at + 1, "x.append(t)")
                    self._say(at, "if len(x) != i - 1: raise Unusual", f"if x: {o}.append({name + '['!r} + ','.join(x) + ']')")
                elif e.kind in ("prim", "ref"):
                    self._read(e, "row", at, f"{o}.append({name!r} + t)")
                elif e.kind == "group":
                    if e.many or e.table >= 0:
                        todo.append(e.node)
                    if e.many:
                        self._say(at, f"i, x = {e.lane}, []", f"while (r := H[{e.table}].pop((*ords, i), None)) is not None:", f" x.append('{{' + b{e.node}(r, (*ords, i), H) + '}}'); i += {e.lane}", f"if x: {o}.append({name + '['!r} + ','.join(x) + ']')")
                    elif e.table >= 0:
                        self._say(at, f"r = H[{e.table}].pop((*ords, {e.lane}), None)", f"if r is not None: {o}.append({name + '{'!r} + b{e.node}(r, (*ords, {e.lane}), H) + '}}')")
                    else:
                        self._say(at, f"{o}_ = []")
                        self._fill(e.node, at, f"{o}_", todo)
                        self._say(at, f"if {o}_: {o}.append({name + '{'!r} + ','.join({o}_) + '}}')")
                elif e.kind == "resource":
                    self._say(at, f"if row.get({e.columns[0]!r}) is not None: raise Unusual")


def _tag(df: DataFrame, resource: Resource, name: str) -> DataFrame:
    """A table's rows as (rid, row): a text of JSON, [the table's number, ords, columns]; derived columns are left behind."""
    number, table = next((i, t) for i, t in enumerate(resource.tables) if t.name == name)
    rid = F.col("id" if table.kind == "base" else "rid").alias("rid")
    ords = F.lit("[]") if table.kind == "base" else F.concat(F.lit("["), F.col("ord").cast("string"), F.lit("]")) if table.kind == "contained" else F.coalesce(F.to_json("ords"), F.lit("[]"))
    if table.kind == "contained":
        names = ["resource"]
    elif table.kind in ("ext", "deep"):
        names = ["path", "leaf", "v_kind", "v_text"] + (["modifier", "ext_ord", "url"] if table.kind == "ext" else [])
    else:
        names = [c.name for c in table.columns if not c.derived]
    cols = F.to_json(F.struct(*(F.col(n).cast("string").alias(n) for n in names)), {"ignoreNullFields": "true"}) if names else F.lit("{}")
    return df.select(rid, F.concat(F.lit(f"[{number},"), ords, F.lit(","), cols, F.lit("]")).alias("row"))


def reconstruct(tables: dict[str, DataFrame], relmap: RelMap, kind: str) -> DataFrame:
    """(id, body, error) for every id of any of the type's rows: one shuffle by id, then one pass of Python.

    A document's rows meet in one group, which is as large as the document; Python holds one document's
    rows at a time. Rows without a base row, with gaps in their ordinals or left over give an error and no body.
    """
    resource = relmap.resources[kind]
    parts = [_tag(tables[t.name], resource, t.name) for t in resource.tables if t.name in tables]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        short, names = Short(resource), [t.name for t in resource.tables]
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                ids = batch.column(0).slice(lo, 512)
                bodies: list[str | None] = []
                errors: list[str | None] = []
                for id_, text in zip(ids.to_pylist(), batch.column(1).slice(lo, 512), strict=True):
                    body = error = None
                    mine = json.loads(text.as_py())
                    try:
                        try:
                            body = short.text(id_, mine)
                        except (Unusual, KeyError):
                            body = dumps(Builder(resource, [(names[t], tuple(ords), cols) for t, ords, cols in mine]).document(id_))
                    except (DocumentError, KeyError) as problem:
                        error = str(problem) if isinstance(problem, DocumentError) else "a row lacks a column"
                    bodies.append(body)
                    errors.append(error)
                yield pa.RecordBatch.from_arrays([ids, pa.array(bodies, pa.string()), pa.array(errors, pa.string())], ["id", "body", "error"])

    grouped = rows.groupBy("rid").agg(F.concat(F.lit("["), F.array_join(F.collect_list("row"), ","), F.lit("]")).alias("rows"))
    return grouped.select(F.col("rid").alias("id"), "rows").mapInArrow(run, "id string, body string, error string")


def ordinal_gaps(children: DataFrame) -> DataFrame:
    """(rid, parent, n, most) of lanes whose ordinals aren't 1..n."""
    last = F.element_at("ords", -1)
    lanes = children.select("rid", F.slice("ords", F.lit(1), F.size("ords") - 1).alias("parent"), F.signum(last).alias("lane"), F.abs(last).alias("ord"))
    return lanes.groupBy("rid", "parent", "lane").agg(F.count("*").alias("n"), F.max("ord").alias("most")).where("n <> most").select("rid", "parent", "n", "most")


def orphans(children: DataFrame, base: DataFrame) -> DataFrame:
    """Child rows whose document has no base row."""
    return children.join(base.select(F.col("id").alias("__id")), F.col("rid") == F.col("__id"), "left_anti")
