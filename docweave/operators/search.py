"""Searches compiled to DataFrames: filters on the base table, semi-joins to child tables and chains."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from urllib.parse import parse_qsl

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.operators.predicates import UnsupportedSearch, date, predicate, same_id
from docweave.plans.model import Param, RelMap, Resource

#: Page size by default and at most; documents that includes add at most.
PAGE, MOST, MOST_INCLUDED = 50, 1000, 1000

#: Gives the DataFrame of a table by its name.
Tables = Callable[[str], DataFrame]


@dataclass
class Request:
    """A search's parameters apart: criteria, and what shapes the result."""

    criteria: list[tuple[str, str]] = field(default_factory=list)
    count: int = PAGE
    offset: int = 0
    sort: list[str] = field(default_factory=list)
    total: str = "accurate"
    cursor: str | None = None
    include: list[str] = field(default_factory=list)
    revinclude: list[str] = field(default_factory=list)

    @staticmethod
    def parse(query: str | list[tuple[str, str]]) -> Request:
        out = Request()
        for name, value in parse_qsl(query, keep_blank_values=True) if isinstance(query, str) else query:
            if name == "_count":
                out.count = min(_natural(name, value), MOST)
            elif name == "_offset":
                out.offset = _natural(name, value)
            elif name == "_sort":
                out.sort = [k for k in value.split(",") if k]
            elif name == "_total":
                out.total = value
            elif name == "_cursor":
                out.cursor = value
            elif name in ("_include", "_revinclude"):
                getattr(out, name[1:]).append(value)
            elif name in ("_format", "_pretty"):
                continue
            elif name.startswith("_") and name.split(":")[0] not in ("_id", "_lastUpdated"):
                raise UnsupportedSearch(f"no parameter {name!r}")
            else:
                out.criteria.append((name, value))
        if out.cursor is not None and out.sort:
            raise UnsupportedSearch("_cursor needs the order by id; leave out _sort")
        return out


def _natural(name: str, value: str) -> int:
    if not value.isdigit():
        raise UnsupportedSearch(f"{name} must be a number, 0 or more")
    return int(value)


def _find(resource: Resource, code: str) -> Param:
    param = resource.param(code)
    if param is None:
        raise UnsupportedSearch(f"no search parameter {code!r}")
    return param


class Searcher:
    def __init__(self, relmap: RelMap, tables: Tables):
        self.map, self.tables = relmap, tables

    def resource(self, kind: str) -> Resource:
        if kind not in self.map.resources:
            raise UnsupportedSearch(f"the map has no type {kind!r}")
        return self.map.resources[kind]

    def matches(self, kind: str, criteria: list[tuple[str, str]], depth: int = 0) -> DataFrame:
        """Base rows that meet all criteria, in no order. Conditions on the base come first, so they reach its scan."""
        resource = self.resource(kind)
        base = self.tables(resource.base.name)
        filters, semis = [], []
        for name, value in criteria:
            plain = name.split(":")[0]
            if plain == "_id" and "." not in name:
                filters.append(same_id(base.schema, "id", value.split(",")))
            elif plain == "_lastUpdated" and "." not in name:
                filters.append(_any([date(base.schema, {"lo": "last_updated"}, v, None) for v in value.split(",")]))
            elif "." in name:
                semis.append(self._chain(resource, base, name, value, depth))
            else:
                condition, ids = self._param(resource, base, name, value)
                if ids is None:
                    filters.append(condition)
                else:
                    semis.append(ids)
        for condition in filters:
            base = base.where(condition)
        for ids in semis:
            base = base.join(ids, base["id"] == ids["__rid"], "left_semi")
        return base

    def _param(self, resource: Resource, base: DataFrame, name: str, value: str) -> tuple[Column | None, DataFrame | None]:
        """A condition on the base, or the ids that any target yields: OR over values and targets.

        Where targets lie in several tables, each table gives its ids once, by one condition.
        """
        code, _, modifier = name.partition(":")
        param = _find(resource, code)
        if not param.targets:
            raise UnsupportedSearch(f"{code!r} looks nowhere: {param.note or 'no targets'}")
        by_table: dict[int, list[Column]] = {}
        for target in param.targets:
            table = base if target.table == 0 else self.tables(resource.tables[target.table].name)
            by_table.setdefault(target.table, []).extend(predicate(table.schema, target, v, modifier or None) for v in value.split(","))
        if set(by_table) == {0}:
            return _any(by_table[0]), None
        ids = [self.tables(resource.tables[t].name).where(_any(c)).select(F.col("id" if t == 0 else "rid").alias("__rid")) for t, c in by_table.items()]
        return None, reduce(DataFrame.union, ids)

    def _chain(self, resource: Resource, base: DataFrame, name: str, value: str, depth: int) -> DataFrame:
        """ref:Type.rest: ids whose reference leads to a match of the rest. One hop only."""
        if depth >= 1:
            raise UnsupportedSearch("a chain has one hop at most")
        head, _, rest = name.partition(".")
        code, _, kind = head.partition(":")
        if not kind:
            raise UnsupportedSearch(f"say which type {head!r} leads to, as {code}:Type.{rest}")
        param = _find(resource, code)
        if kind not in self.map.resources:
            raise UnsupportedSearch(f"the chain leads to {kind!r}, which the map lacks")
        targets = [t for t in param.targets if t.kind == "reference"]
        if not targets:
            raise UnsupportedSearch(f"{code!r} refers to no document")
        found = self.matches(kind, [(rest, value)], depth + 1).select(F.col("id").alias("__target"))
        ids = []
        for t in targets:
            table = base if t.table == 0 else self.tables(resource.tables[t.table].name)
            refs = table.where(F.col(t.columns["type"]) == kind).select(F.col("id" if t.table == 0 else "rid").alias("__rid"), F.col(t.columns["id"]).alias("__ref"))
            ids.append(refs.join(found, refs["__ref"] == found["__target"], "left_semi").select("__rid"))
        return reduce(DataFrame.union, ids)

    def sort_column(self, resource: Resource, code: str) -> str:
        """What a sort key orders by: the first target on the base table."""
        if code == "_id":
            return "id"
        if code == "_lastUpdated":
            return "last_updated"
        for t in _find(resource, code).targets:
            if t.table == 0:
                return t.columns[{"string": "col", "token": "code", "date": "lo", "number": "col", "quantity": "col", "reference": "id", "uri": "col"}[t.kind]]
        raise UnsupportedSearch(f"{code!r} has several values for a document and so no order")

    def page(self, kind: str, request: Request) -> DataFrame:
        """The page's base rows in order: sort keys with nulls last either way, then id. A top-k, not a full sort."""
        resource = self.resource(kind)
        found = self.matches(kind, request.criteria)
        if request.cursor is not None:
            found = found.where(F.col("id") > request.cursor)
        keys = [F.col(self.sort_column(resource, k.lstrip("-"))) for k in request.sort]
        order = [c.desc_nulls_last() if k.startswith("-") else c.asc_nulls_last() for k, c in zip(request.sort, keys, strict=True)]
        found = found.orderBy(*order, F.col("id").asc())
        if request.offset:
            found = found.offset(request.offset)
        return found.limit(request.count)

    def total(self, kind: str, request: Request) -> DataFrame:
        """One row, ``total``: all matches, whatever the page and the cursor."""
        return self.matches(kind, request.criteria).agg(F.count("*").alias("total"))

    def next_link(self, request: Request, page_ids: list[str]) -> dict[str, str] | None:
        """What asks for the next page; None unless the page is full."""
        if not request.count or len(page_ids) < request.count:
            return None
        return {"_offset": str(request.offset + request.count)} if request.sort else {"_cursor": page_ids[-1]}

    # --- includes ---

    def references(self, kind: str, code: str, matches: DataFrame) -> DataFrame:
        """Distinct (type, id) that the matches' parameter refers to."""
        resource = self.resource(kind)
        out = []
        for t in _find(resource, code).targets:
            if t.kind != "reference":
                raise UnsupportedSearch(f"{code!r} refers to no document")
            if t.table == 0:
                rows = matches
            else:
                child = self.tables(resource.tables[t.table].name)
                rows = child.join(matches.select(F.col("id").alias("__rid")), F.col("rid") == F.col("__rid"), "left_semi")
            out.append(rows.select(F.col(t.columns["type"]).alias("type"), F.col(t.columns["id"]).alias("id")).where("type is not null and id is not null"))
        return reduce(DataFrame.union, out).distinct()

    def referring(self, source: str, code: str, kind: str, matches: DataFrame) -> DataFrame:
        """Distinct (type, id) of source documents whose parameter refers to a match."""
        resource = self.resource(source)
        wanted = matches.select(F.col("id").alias("__target"))
        out = []
        for t in _find(resource, code).targets:
            if t.kind != "reference":
                raise UnsupportedSearch(f"{code!r} refers to no document")
            table = self.tables(resource.tables[t.table].name)
            rows = table.where(F.col(t.columns["type"]) == kind)
            rows = rows.join(wanted, rows[t.columns["id"]] == wanted["__target"], "left_semi")
            out.append(rows.select(F.lit(source).alias("type"), F.col("id" if t.table == 0 else "rid").alias("id")))
        return reduce(DataFrame.union, out).distinct()

    def included(self, kind: str, request: Request, matches: DataFrame, most: int = MOST_INCLUDED) -> DataFrame:
        """(type, id, truncated) of the documents that includes add to a page, by type and id.

        Matches themselves, types that the map lacks and references that lead nowhere are left out.
        Beyond ``most`` the list is cut, and every row says so.
        """
        found = []
        for value in request.include:
            source, code = ([*value.split(":"), ""])[:2]
            if source == kind:
                found.append(self.references(kind, code, matches))
        for value in request.revinclude:
            source, code = ([*value.split(":"), ""])[:2]
            found.append(self.referring(source, code, kind, matches))
        if not found:
            return matches.sparkSession.createDataFrame([], "type string, id string, truncated boolean")
        all_ = reduce(DataFrame.union, found).distinct().where(F.col("type").isin(list(self.map.resources)))
        here = matches.select(F.lit(kind).alias("type"), "id")
        all_ = all_.join(here, ["type", "id"], "left_anti")
        known = reduce(DataFrame.union, [self.tables(self.resource(t).base.name).select(F.lit(t).alias("type"), "id") for t in sorted(self.map.resources) if t in self._sources(kind, request)])
        all_ = all_.join(known, ["type", "id"], "left_semi")
        top = all_.orderBy("type", "id").limit(most + 1)
        n = top.agg(F.count("*").alias("__n"))
        cut = top.orderBy("type", "id").limit(most)
        return cut.join(F.broadcast(n)).select("type", "id", (F.col("__n") > most).alias("truncated"))  # one row

    def _sources(self, kind: str, request: Request) -> set[str]:
        """Types that the includes can bring in; any, for references."""
        if any(v.split(":")[0] == kind for v in request.include):
            return set(self.map.resources)
        return {v.split(":")[0] for v in request.revinclude}


def _any(conditions: list[Column]) -> Column:
    return reduce(Column.__or__, conditions)
