"""Batches and transactions of requests, as one commit or one each."""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from typing import Any

from docweave.functions.guards import valid_id
from docweave.functions.lexical import loads
from docweave.operators.store import Audit, Store, parse_etag

#: Deletes first, then creates, then updates; of one kind in the order of the entries.
ORDER = {"DELETE": 0, "POST": 1, "PUT": 2}


class Unsupported(ValueError):
    pass


def _entry(entry: dict) -> tuple[str, list[str], dict | None, int | None]:
    """(method, the url's parts, document, expected version); conditions that a bundle can't have are errors."""
    request = entry.get("request") or {}
    extra = [n for n in ("ifNoneExist", "ifModifiedSince", "ifNoneMatch") if n in request]
    if extra:
        raise Unsupported(f"a bundle's entry can not have {extra[0]}")
    method, url = request.get("method", ""), request.get("url", "").split("/")
    if method == "PUT" and not (len(url) == 2 and valid_id(url[1])):
        raise ValueError("a document is put at Type/id")
    return method, url, entry.get("resource"), parse_etag(request["ifMatch"]) if "ifMatch" in request else None


def rewrite(value: Any, names: dict[str, str]) -> Any:
    """The document with every ``reference`` that is a key of names replaced."""
    if isinstance(value, dict):
        return {k: names.get(v, v) if k == "reference" and type(v) is str else rewrite(v, names) for k, v in value.items()}
    return [rewrite(v, names) for v in value] if isinstance(value, list) else value


def transaction(store: Store, bundle: dict, audit: Audit = Audit()) -> list[dict]:
    """All entries in one commit, or none; responses in the order of the entries."""
    plan, names = [], {}
    for i, entry in enumerate(bundle.get("entry", [])):
        method, url, document, expected = _entry(entry)
        if method not in ORDER:
            raise Unsupported(f"a transaction's entry can not be {method or 'without a method'}")
        if method == "POST":
            document = document | {"id": uuid.uuid4().hex}
            url = [document["resourceType"], document["id"]]
        if len(url) != 2:
            raise Unsupported("an entry is for Type or Type/id")
        if entry.get("fullUrl"):
            names[entry["fullUrl"]] = "/".join(url)
        plan.append((ORDER[method], i, method, url, document, expected))
    seen: set[tuple[str, ...]] = set()
    for *_, url, _, _ in plan:
        if tuple(url) in seen:
            raise Unsupported("two entries are for one document")
        seen.add(tuple(url))
    plan.sort(key=lambda p: p[:2])
    rows = [("delete" if m == "DELETE" else "put", u[0], u[1], None if m == "DELETE" else rewrite(d, names), e) for _, _, m, u, d, e in plan]
    done = {(r.rtype, r.id): r for r in store.commit(store.changes(rows), audit).collect()}
    out: list[dict] = [{}] * len(plan)
    for _, i, method, url, _, _ in plan:
        r = done.get(tuple(url))
        status = 204 if method == "DELETE" else 201 if r.op == "C" else 200
        out[i] = {"status": status, "location": "/".join(url)} | ({"versionId": r.version_id} if r else {})
    return out


@dataclass
class Change:
    """A change that waits to be applied along with its neighbours, and where its answer goes."""

    at: int
    method: str
    rtype: str
    id: str
    document: dict | None
    expected: int | None


def _applied(store: Store, waiting: list[Change], audit: Audit, out: list[dict]) -> None:
    """One commit for all that wait: they are of different documents, so each stands or falls alone."""
    if not waiting:
        return
    rows = [("delete" if c.method == "DELETE" else "put", c.rtype, c.id, c.document, c.expected) for c in waiting]
    found = store.apply(store.changes(rows), audit)
    done, wrong = {r.seq: r for r in found.done.collect()}, {r.seq for r in found.conflicts.collect()}
    bad = {r.seq: r.error for r in found.bad.collect()}
    for i, c in enumerate(waiting):
        if i in bad:
            out[c.at] = {"status": 400, "error": f"{c.rtype}/{c.id}: {bad[i]}"}
        elif i in wrong:
            out[c.at] = {"status": 409, "error": "another version"}
        elif c.method == "DELETE":
            out[c.at] = {"status": 204}
        else:
            out[c.at] = {"status": 201 if done[i].version_id == 1 else 200, "location": f"{c.rtype}/{c.id}", "versionId": done[i].version_id}
    waiting.clear()


def batch(store: Store, bundle: dict, audit: Audit = Audit()) -> list[dict]:
    """Each entry for itself, in order; an entry that fails has its status and a message without values.

    Neighbouring changes of different documents are one commit, and so are not a folder each.
    """
    out: list[dict] = [{} for _ in bundle.get("entry", [])]
    waiting: list[Change] = []
    for at, entry in enumerate(bundle.get("entry", [])):
        try:
            method, url, document, expected = _entry(entry)
            if method == "GET":
                _applied(store, waiting, audit, out)
                asked = store.spark.createDataFrame([(url[0], url[1])], "rtype string, id string")
                row = store.read(asked).first()
                out[at] = {"status": row.status} | ({"resource": loads(row.resource)} if row.status == 200 else {})
                continue
            if method not in ORDER:
                raise Unsupported(f"a batch's entry can not be {method or 'without a method'}")
            if method == "POST":
                document = document | {"id": uuid.uuid4().hex}
                url = [document["resourceType"], document["id"]]
            elif method == "PUT" and document.get("id") != url[1]:
                raise Unsupported("the url has another id")
            if any((c.rtype, c.id) == (url[0], url[1]) for c in waiting):
                _applied(store, waiting, audit, out)
            waiting.append(Change(at, method, url[0], url[1], document, expected))
        except Unsupported as problem:
            out[at] = {"status": 501, "error": str(problem)}
        except (ValueError, IndexError, KeyError, TypeError, AttributeError):
            out[at] = {"status": 400, "error": "malformed entry"}
    _applied(store, waiting, audit, out)
    return out
