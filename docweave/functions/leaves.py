"""Any JSON as leaf rows, (dotted path, kind, text), and back."""

from __future__ import annotations

from typing import Any

from pyspark.sql.functions import udtf

from docweave.functions.lexical import Number, dumps, loads

#: (path, kind, text): kind is z, b, n or s; text keeps numbers as written.
Leaf = tuple[str, str, str | None]


class DocumentError(ValueError):
    """What is wrong with a document, and at which path; never a value of it."""

    def __init__(self, path: str, what: str):
        super().__init__(f"{path}: {what}" if path else what)


def kind_of(value: Any) -> tuple[str, str | None]:
    if value is None:
        return "z", None
    if isinstance(value, bool):
        return "b", "true" if value else "false"
    return ("n", str.__str__(value)) if isinstance(value, Number) else ("s", value)


def flatten(value: Any, at: str = "", skip: str | None = None) -> list[Leaf]:
    """Leaves in document order; ``skip`` leaves out one key at the top.

    Empty objects and arrays, and keys with dots or of digits alone, can't be told from paths: errors.
    """
    out: list[Leaf] = []
    todo: list[tuple[str, Any]] = [("", value)]
    while todo:
        path, item = todo.pop()
        if isinstance(item, dict):
            if not item:
                raise DocumentError(at, "holds an object of nothing")
            for key in item:
                if not key or key.isascii() and key.isdigit():
                    raise DocumentError(at, f"has a key {key!r} that looks like a position")
                if "." in key:
                    raise DocumentError(at, f"has a key {key!r} with a dot")
            pairs = [(f"{path}.{k}" if path else k, v) for k, v in item.items() if path or k != skip]
            todo.extend(reversed(pairs))
        elif isinstance(item, list):
            if not item:
                raise DocumentError(at, "holds a list of nothing")
            todo.extend(reversed([(f"{path}.{i}" if path else str(i), v) for i, v in enumerate(item)]))
        else:
            out.append((path, *kind_of(item)))
    if not out:
        raise DocumentError(at, "holds nothing")
    return out


def scalar(kind: str, text: str | None) -> Any:
    return {"z": lambda: None, "b": lambda: text == "true", "n": lambda: Number(text), "s": lambda: text}[kind]()


def unflatten(leaves: list[Leaf]) -> Any:
    """The value that flatten() gave these leaves, in any order; a path that is both object and array is an error."""
    if not leaves:
        raise DocumentError("", "nothing to build from")
    if len(leaves) == 1 and not leaves[0][0]:
        return scalar(*leaves[0][1:])
    tree: dict[str, Any] = {}
    for path, kind, text in leaves:
        if not path:
            raise DocumentError("", "a leaf without a path among others")
        *heads, last = path.split(".")
        node = tree
        for head in heads:
            node = node.setdefault(head, {})
            if not isinstance(node, dict):
                raise DocumentError(path, "a leaf with leaves below it")
        if last in node:
            raise DocumentError(path, "two leaves at one path")
        node[last] = (scalar(kind, text),)

    def build(node: Any) -> Any:
        if isinstance(node, tuple):
            return node[0]
        digits = [k.isascii() and k.isdigit() for k in node]
        if not any(digits):
            return {k: build(v) for k, v in node.items()}
        if not all(digits) or sorted(map(int, node)) != list(range(len(node))):
            raise DocumentError("", "leaves mix object and array, or leave a gap")
        return [build(node[str(i)]) for i in range(len(node))]

    return build(tree)


@udtf(returnType="leaf string, v_kind string, v_text string")
class JsonLeaves:
    """SELECT * FROM t, LATERAL json_leaves(t.body): a row for each leaf; none for null."""

    def eval(self, body: str):  # noqa: ANN201
        if body is not None:
            yield from flatten(loads(body))


def to_text(leaves: list[Leaf]) -> str:
    return dumps(unflatten(leaves))
