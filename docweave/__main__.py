"""python -m docweave COMMAND: the store's operations from the command line."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from docweave.functions.lexical import dumps, loads
from docweave.operators import integrity, shred
from docweave.operators.bundles import batch, transaction
from docweave.operators.store import Audit, Store
from docweave.plans.generate import read_definitions
from docweave.plans.model import RelMap
from docweave.plans.search_compile import capability, generate, support_matrix
from docweave.plans.session import prepare
from docweave.sources import documents


#: Refused documents that load shows.
MOST_SHOWN = 20


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="docweave", description=__doc__)
    p.add_argument("--store", help="the store's folder")
    p.add_argument("--map", help="the map file that gen wrote")
    p.add_argument("--key", help="the signing key's file")
    p.add_argument("--retired-key", action="append", default=[], help="a key that still verifies")
    p.add_argument("--actor", default="", help="who does this, for the history")
    p.add_argument("--reason", default="")
    sub = p.add_subparsers(dest="command", required=True)

    def add(name: str, *arguments: str, **more: str) -> None:
        c = sub.add_parser(name, **more)
        for a in arguments:
            c.add_argument(a.rstrip("*"), **({"nargs": "*"} if a.endswith("*") else {}))

    add("gen", "definitions", "parameters", "schema", "out", help="a map from definitions and search parameters")
    add("init", help="create the store")
    add("load", "path", "strict*", help="upsert documents of files; say strict to refuse what breaks a rule of its type")
    add("get", "type", "id")
    add("delete", "type", "id")
    add("export", "out", "types*")
    add("search", "type", "query", help="such as 'status=final&_count=5'")
    add("bundle", "path", help="apply a batch or transaction")
    add("history", "type", "id")
    add("transform", "path", help="show the rows that documents become")
    add("verify-audit", help="check the history; exit 1 if it is broken")
    add("chain-key-new", "path")
    add("chain-witness")
    add("chain-resign")
    add("purge", "type", "id", help="erase a document and its history")
    add("support", help="which search parameters are compiled")
    add("capability")
    add("upgrade", "destructive*", help="bring the store to the map; say destructive to drop what the map lacks")
    add("merge", help="write the tables anew with what was changed since")
    add("vacuum", help="delete folders that the present snapshot doesn't need")
    add("drop", help="delete the store")
    return p


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(arguments)
    show = lambda x: print(json.dumps(x, ensure_ascii=False, default=str))
    if a.command == "chain-key-new":
        show({"key": integrity.new_key(a.path)[0]})
        return 0
    if a.command == "gen":
        made = generate(read_definitions(a.definitions), read_definitions(a.parameters), a.schema)
        Path(a.out).write_bytes(made.to_bytes())
        show({"types": len(made.resources), "tables": sum(len(r.tables) for r in made.resources.values()), "checksum": made.checksum()})
        return 0
    relmap = RelMap.from_bytes(Path(a.map).read_bytes())
    if a.command in ("support", "capability"):
        show(support_matrix(relmap) if a.command == "support" else capability(relmap))
        return 0
    spark = prepare(spark or SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate())
    if a.command == "transform":
        for r in shred.tagged(documents.read(spark, a.path), relmap).toLocalIterator():
            show(r.asDict(recursive=True))
        return 0
    ring = integrity.KeyRing(integrity.load_key(a.key) if a.key else None, dict(map(integrity.load_key, a.retired_key)))
    store, audit = Store(spark, a.store, relmap, ring), Audit(actor=a.actor, actor_source="cli", reason=a.reason)
    if a.command == "init":
        show({"created": store.init()})
    elif a.command == "load":
        rows = documents.read(spark, a.path)
        n, bad = store.load(rows, audit, strict="strict" in a.strict)
        failed = bad.count()
        show({"loaded": n, "failed": failed, "errors": [r.asDict() for r in bad.orderBy("context").limit(MOST_SHOWN).collect()]})
        return int(failed > 0)
    elif a.command == "get":
        found = store.get_text([(a.type, a.id)])[0]
        print(found or "null")
        return int(found is None)
    elif a.command == "delete":
        return int(not store.delete(a.type, a.id, audit=audit))
    elif a.command == "export":
        store.export(a.out, a.types or None)
    elif a.command == "search":
        print(dumps(store.search(a.type, a.query)))
    elif a.command == "bundle":
        bundle = loads(Path(a.path).read_text(encoding="utf-8"))
        print(dumps((transaction if bundle.get("type") == "transaction" else batch)(store, bundle, audit)))
    elif a.command == "history":
        for r in store.history(a.type, a.id).select("version_id", "last_updated", "op", "actor", "reason").collect():
            show(r.asDict())
    elif a.command == "verify-audit":
        breaks = [r.asDict() for r in store.verify().limit(1000).collect()]
        show({"breaks": breaks})
        return int(bool(breaks))
    elif a.command == "chain-witness":
        show({"witness": store.witness()})
    elif a.command == "chain-resign":
        show({"signed": store.resign(a.actor, a.reason)})
    elif a.command == "purge":
        return int(not store.purge(a.type, a.id, a.actor, a.reason))
    elif a.command == "upgrade":
        done = store.upgrade(relmap, "destructive" in a.destructive)
        show({"added": done.added, "removed": done.removed, "filled": done.backfill})
    elif a.command == "merge":
        show({"merged": store.merge()})
    elif a.command == "vacuum":
        show({"deleted": store.vacuum()})
    elif a.command == "drop":
        store.drop()
    return 0


if __name__ == "__main__":
    sys.exit(main())
