"""Versioned documents and their rows, in snapshot folders: batches of changes published by one rename.

A snapshot names the folders of ``history`` (every version), ``access`` and ``signatures``, and of what is
live now, which is kept twice over: ``base``, for every type the latest versions, the documents and the
typed tables that documents become, each sorted by id; and ``deltas``, one for each commit since, with the
heads of the documents it changed and their rows, tagged by table. A table is its base without the
documents that a delta changed, and the deltas' rows. A commit writes what it changes and no more; once
the deltas are many, or a quarter of the base, they are merged into it, type by type.

A commit writes new folders and then moves the pointer file, so readers see the state before or after,
never between; a failed commit leaves only unreferenced folders. One driver writes at a time.
"""

from __future__ import annotations

import json
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from datetime import UTC, datetime
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from docweave.functions import guards
from docweave.functions.digests import linked
from docweave.functions.lexical import dumps, loads
from docweave.operators import integrity, reconstruct, shred, validate
from docweave.operators.search import Request, Searcher
from docweave.plans import evolve
from docweave.plans.model import RelMap
from docweave.sources import documents

CURRENT = "rtype string, id string, version_id long, last_updated timestamp, resource string"
HISTORY = (
    "rtype string, id string, version_id long, last_updated timestamp, op string, resource string, actor string, actor_source string, client string, request_id string, reason string, "
    "prev_hash binary, row_hash binary, prev_hash3 binary, row_hash3 binary, row_mac string"
)
ACCESS = "seq long, ts timestamp, request_id string, actor string, actor_source string, client string, interaction string, rtype string, id string, version_id long, outcome string, result_count long, reason string"
SIGNATURES = "rtype string, id string, version_id long, row_mac string, signed_at timestamp, actor string, reason string"
LOGS = {"history": HISTORY, "access": ACCESS, "signatures": SIGNATURES}
#: The last version of every document that ever was.
HEADS = "rtype string, id string, version_id long, last_updated timestamp, op string, row_hash binary, row_hash3 binary"
#: A delta's heads also have the document, and the change that its rows are keyed by.
DELTA = HEADS + ", resource string, seq long"
ROWS = shred.TAGGED.replace("tbl string, ", "") + ", key long, tbl string"
#: (seq, op, rtype, id, body, expected): op put or delete; expected null for any version, 0 for none.
CHANGES = "seq long, op string, rtype string, id string, body string, expected long"

#: Deltas at most, and the least number of changed documents for which the base is written anew.
MOST_DELTAS, LEAST_MERGE = 24, 20_000
#: Ids that a read names one by one, so that they reach the scan; more are joined.
MOST_NAMED = 512


class Conflict(RuntimeError):
    def __init__(self, rows: list):
        self.rows = [(r.rtype, r.id, r.expected, r.found) for r in rows]
        super().__init__(f"{len(rows)} changes expected another version")


class Rejected(ValueError):
    def __init__(self, errors: list):
        self.errors = errors
        super().__init__("; ".join(str(e) for e in errors[:10]))


class Multiple(RuntimeError):
    """Several documents match the criteria of a conditional change."""


@dataclass(frozen=True)
class Audit:
    """Who changes something and why; an actor that is no principal's name, and a request id that is none, are left out."""

    actor: str = ""
    actor_source: str = ""
    client: str = ""
    request_id: str = ""
    reason: str = ""

    def __post_init__(self) -> None:
        object.__setattr__(self, "actor", guards.principal(self.actor))
        object.__setattr__(self, "request_id", guards.request_id(self.request_id, ""))


@dataclass(frozen=True)
class Outcome:
    """What a batch did: (seq, rtype, id, version_id, op) written, (seq, rtype, id, error) refused, (seq, rtype, id, expected, found) in conflict."""

    done: DataFrame
    bad: DataFrame
    conflicts: DataFrame


def names(schema: str) -> list[str]:
    return [f.strip().split(" ")[0] for f in schema.split(",")]


class Store:
    def __init__(self, spark: SparkSession, root: str, relmap: RelMap, ring: integrity.KeyRing | None = None):
        self.spark, self.root, self.map, self.ring = spark, root.rstrip("/"), relmap, ring or integrity.KeyRing()
        path = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        self._fs = path.getFileSystem(spark._jsc.hadoopConfiguration())

    # --- snapshots ---

    def _path(self, name: str):  # noqa: ANN202
        return self.spark._jvm.org.apache.hadoop.fs.Path(name if name.startswith(self.root) else f"{self.root}/{name}")

    def _listed(self, name: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(name))) if self._fs.exists(self._path(name)) else []

    def _pointer(self) -> dict:
        found = [n for n in self._listed(".") if n.startswith("snapshot-")]
        if not found:
            raise FileNotFoundError(f"no store at {self.root}")
        return json.loads(self._text(found[-1])) | {"n": int(found[-1].split("-")[1])}

    def _text(self, name: str) -> str:
        """A small file's text, without a job."""
        stream = self._fs.open(self._path(name))
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def init(self) -> bool:
        """Creates the store; False if it is there with the same map, an error if with another."""
        try:
            state = self._pointer()
        except FileNotFoundError:
            self._publish({"logs": {t: [] for t in LOGS}, "base": {}, "tables": {}, "deltas": [], "marks": {}, "n": -1} | self._keep_map(self.map))
            return True
        if state["checksum"] != self.map.checksum():
            raise ValueError("the store has another map; upgrade it")
        return False

    def fork(self, root: str) -> Store:
        """Another store that begins as this one is; it reads this one's folders, and writes its own.

        As long as it lives this one must not be vacuumed or purged, and what it purges stays here.
        """
        made = Store(self.spark, root, self.map, self.ring)
        made._publish(self._pointer() | {"n": -1} | made._keep_map(self.map))
        return made

    def _keep_map(self, relmap: RelMap) -> dict:
        name = f"map-{relmap.checksum()}"
        if not self._fs.exists(self._path(name)):
            self._create(name, relmap.to_bytes())
        return {"checksum": relmap.checksum(), "map": name}

    def _create(self, name: str, raw: bytes) -> None:
        out = self._fs.create(self._path(name))
        out.write(bytearray(raw))
        out.close()

    def kept_map(self) -> RelMap:
        """The map that the store was last written with."""
        row = self.spark.read.format("binaryFile").load(f"{self.root}/{self._pointer()['map']}").select("content").first()
        return RelMap.from_bytes(bytes(row.content))

    def drop(self) -> None:
        self._fs.delete(self._path("."), True)

    def _publish(self, state: dict) -> None:
        """Writes the next pointer aside and renames it; if another writer was first, the rename fails."""
        n = state["n"] + 1
        aside = f"aside-{uuid.uuid4().hex}"
        self._create(aside, json.dumps({k: v for k, v in state.items() if k != "n"}).encode())
        target = self._path(f"snapshot-{n:012d}")
        if self._fs.exists(target) or not self._fs.rename(self._path(aside), target):
            self._fs.delete(self._path(aside), False)
            raise RuntimeError("another writer published first")

    def _read(self, paths: list[str], schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _write(self, df: DataFrame, name: str, by: str | None = None, **options: str) -> str:
        path = f"{self.root}/data/{name}-{uuid.uuid4().hex}"
        writer = df.write.options(**options)
        (writer.partitionBy(by) if by else writer).parquet(path)
        return path

    # --- what is live: base and deltas ---

    def _deltas(self, state: dict, kinds: set[str] | None = None) -> DataFrame | None:
        """The latest heads that the deltas hold, with ``delta``, their number; None if no delta has one of these types."""
        some = [(i, d) for i, d in enumerate(state["deltas"]) if kinds is None or kinds & set(d["types"])]
        if not some:
            return None
        all_ = reduce(DataFrame.unionByName, (self._read([d["heads"]], DELTA).withColumn("delta", F.lit(i)) for i, d in some))
        if kinds is not None:
            all_ = all_.where(F.col("rtype").isin(sorted(kinds)))
        if len(some) == 1:
            return all_
        rest = [c for c in all_.columns if c not in ("rtype", "id")]
        return all_.groupBy("rtype", "id").agg(F.max_by(F.struct(*rest), "version_id").alias("h")).select("rtype", "id", "h.*")

    def _live(self, state: dict, what: str, schema: str, kinds: set[str] | None, condition: Column | None) -> DataFrame:
        """``what`` of the base, of documents no delta has, and of the deltas."""
        paths = [p[what] for k, p in sorted(state["base"].items()) if kinds is None or k in kinds]
        base, newer = self._read(paths, schema), self._deltas(state, kinds)
        if kinds is not None:
            base = base.where(F.col("rtype").isin(sorted(kinds)))
        if condition is not None:
            base, newer = base.where(condition), None if newer is None else newer.where(condition)
        if newer is None:
            return base
        shown = newer if what == "heads" else newer.where(~F.col("op").isin("D", "X"))
        return base.join(newer.select("rtype", "id"), ["rtype", "id"], "left_anti").select(*names(schema)).unionByName(shown.select(*names(schema)))

    def heads(self, state: dict | None = None, kinds: set[str] | None = None, condition: Column | None = None) -> DataFrame:
        """The last version of every document, deleted ones too."""
        return self._live(state or self._pointer(), "heads", HEADS, kinds, condition)

    def current(self, state: dict | None = None, kinds: set[str] | None = None, condition: Column | None = None) -> DataFrame:
        """The live documents, as canonical text."""
        return self._live(state or self._pointer(), "current", CURRENT, kinds, condition)

    def table(self, name: str, state: dict | None = None) -> DataFrame:
        """``current``, ``heads``, ``history``, ``access``, ``signatures``, or a table of the map; lazily, with no Python in its plan."""
        state = state or self._pointer()
        if name in LOGS:
            return self._read(state["logs"][name], LOGS[name])
        if name in ("current", "heads"):
            return getattr(self, name)(state)
        resource, table = next((r, t) for r in self.map.resources.values() for t in r.tables if t.name == name)
        if table.kind == "history":
            return self.table("history", state).where(F.col("rtype") == resource.name)
        key = "id" if table.kind == "base" else "rid"
        schema = evolve.schema(table)
        base = self.spark.read.schema(schema).parquet(state["tables"][name]) if name in state["tables"] else self.spark.createDataFrame([], schema)
        newer = self._deltas(state, {resource.name})
        if newer is None:
            return base
        base = base.join(newer.select(F.col("id").alias(key)), key, "left_anti")
        parts = [(i, d["rows"]) for i, d in enumerate(state["deltas"]) if name in d["tables"]]
        if not parts:
            return base.select(*schema.names)
        rows = reduce(DataFrame.unionByName, (self._read([p], ROWS).where(F.col("tbl") == name).withColumn("delta", F.lit(i)) for i, p in parts))
        live = newer.where(~F.col("op").isin("D", "X")).select(F.col("rtype").alias("__rtype"), F.col("id").alias("__id"), F.col("seq").alias("__seq"), F.col("delta").alias("__delta"), F.col("version_id").alias("__version"), F.col("last_updated").alias("__at"))
        mine = (F.col("rid") == F.col("__id")) & (F.col("rtype") == F.col("__rtype")) & (F.col("key") == F.col("__seq")) & (F.col("delta") == F.col("__delta"))
        found = rows.join(live, mine)
        more = [F.col("__version").alias("version_id"), F.col("__at").alias("last_updated")] if table.kind == "base" else []
        return base.select(*schema.names).unionByName(shred.table_of(found, table, more).select(*schema.names))

    def tables(self, kind: str, state: dict | None = None) -> dict[str, DataFrame]:
        state = state or self._pointer()
        return {t.name: self.table(t.name, state) for t in self.map.resources[kind].tables if t.kind != "history"}

    def views(self, kinds: list[str] | None = None) -> list[str]:
        """Temporary views of the tables, for SQL; the names given."""
        state, out = self._pointer(), []
        for k in kinds or self.map.resources:
            for name, df in self.tables(k, state).items():
                df.createOrReplaceTempView(f"{self.map.schema}_{name}")
                out.append(f"{self.map.schema}_{name}")
        return out

    def rebuilt(self, kind: str) -> DataFrame:
        """(id, body, error) of a type's documents, put together again from their rows."""
        return reconstruct.reconstruct(self.tables(kind), self.map, kind)

    def export(self, path: str, kinds: list[str] | None = None, compress: bool = False) -> None:
        """Documents put together from their rows, one a line, by type and id; one that can't be is an error."""
        parts = []
        for k in kinds or sorted(self._pointer()["base"].keys() | {k for d in self._pointer()["deltas"] for k in d["types"]}):
            whole = F.coalesce("body", F.raise_error(F.concat(F.lit(f"{k}/"), "id", F.lit(": "), F.coalesce("error", F.lit("no rows")))))
            parts.append(self.rebuilt(k).select(F.lit(k).alias("rtype"), "id", whole.alias("resource")))
        documents.export(reduce(DataFrame.union, parts) if parts else self.current(), path, compress=compress)

    def differing(self, kind: str) -> DataFrame:
        """(id, error) of documents whose rows give another document than is stored; none if all is well."""
        built = self.rebuilt(kind).withColumn("body", shred.canonical("body"))
        both = self.current(kinds={kind}).select("id", "resource").join(built, "id", "full_outer")
        return both.where(~F.col("resource").eqNullSafe(F.col("body"))).select("id", "error")

    def merge(self) -> bool:
        """Writes the base anew with all that the deltas hold; False if there are none."""
        state = self._pointer()
        if not state["deltas"]:
            return False
        self._merge(state)
        self._publish(state)
        return True

    def _merge(self, state: dict) -> None:
        """Of every type that a delta changed, its heads, documents and tables, each sorted by id: the jobs run side by side."""
        jobs = []
        for kind in sorted({k for d in state["deltas"] for k in d["types"]}):
            for what in ("heads", "current"):
                jobs.append(((kind, what), getattr(self, what)(state, {kind}), ["id"], {}))
            resource = self.map.resources.get(kind)
            for t in resource.tables if resource else []:
                if t.kind != "history" and (t.name in state["tables"] or any(t.name in d["tables"] for d in state["deltas"])):
                    jobs.append((t.name, self.table(t.name, state), *evolve.layout(resource, t)))

        def run(job: tuple) -> tuple:
            to, df, order, options = job
            return to, self._write(df.repartitionByRange(order[0]).sortWithinPartitions(*order), to if isinstance(to, str) else "-".join(to), **options)

        with ThreadPoolExecutor(8) as pool:
            for to, path in pool.map(run, jobs):
                if isinstance(to, str):
                    state["tables"][to] = path
                else:
                    state["base"].setdefault(to[0], {})[to[1]] = path
        for kind in {k for d in state["deltas"] for k in d["types"]}:
            state["base"][kind]["n"] = self._read([state["base"][kind]["heads"]], HEADS).count()
        state["deltas"] = []

    def _due(self, state: dict) -> bool:
        changed = sum(sum(d["types"].values()) for d in state["deltas"])
        return len(state["deltas"]) >= MOST_DELTAS or changed >= max(LEAST_MERGE, sum(p["n"] for p in state["base"].values()) // 4)

    def vacuum(self) -> int:
        """Deletes the folders that the present snapshot doesn't name, and older snapshots; the number of folders."""
        state = self._pointer()
        text = json.dumps(state)
        gone = [n for n in self._listed("data") if n not in text]
        for n in gone:
            self._fs.delete(self._path(f"data/{n}"), True)
        for n in self._listed("."):
            if n.startswith("snapshot-") and int(n.split("-")[1]) < state["n"]:
                self._fs.delete(self._path(n), False)
        return len(gone)

    # --- changes ---

    def _named(self, touched: DataFrame) -> Column | None:
        """A condition that names the ids, if they are few."""
        few = touched.select("id").limit(MOST_NAMED + 1).collect()
        return F.col("id").isin([r.id for r in few]) if len(few) <= MOST_NAMED else None

    def apply(self, changes: DataFrame, audit: Audit = Audit(), at: datetime | None = None, partly: bool = True, mark: tuple[str, int] | None = None) -> Outcome:
        """Applies a batch in one commit; ``seq`` tells its changes apart.

        Changes to one document apply in order of ``seq``. A delete of a document that isn't there
        writes nothing. Documents that don't fit the map, and changes that expect another version, are
        left out along with all other changes of their documents in the batch; unless ``partly``, any of
        them leaves out the batch. With ``mark`` (name, number) a batch whose number is not above the last
        one of that name is left out as done before.
        """
        state = self._pointer()
        none = Outcome(self.spark.createDataFrame([], "seq long, rtype string, id string, version_id long, op string"), self.spark.createDataFrame([], "seq long, rtype string, id string, error string"), self.spark.createDataFrame([], "seq long, rtype string, id string, expected long, found long"))
        if mark and state["marks"].get(mark[0], -1) >= mark[1]:
            return none
        moment = F.lit((at or datetime.now(UTC)).astimezone(UTC).replace(tzinfo=None).isoformat(sep=" ")).cast("timestamp")
        # the one pass of Python: errors, canonical texts and rows, by table
        path = self._write(shred.tagged(changes.where("op = 'put'"), self.map, key="seq", carry=("rtype", "id", "expected")), "rows", "tbl")
        rows = self._read([path], ROWS)
        said = lambda name: F.col("cols")[name].alias(name)
        told = rows.where(F.col("tbl") == shred.ERROR).select(F.col("key").alias("seq"), said("rtype"), said("id"), "error")
        same = F.col("rtype").eqNullSafe(F.col("cols")["rtype"]) & F.col("rid").eqNullSafe(F.col("cols")["id"])
        bodies = rows.where(F.col("tbl") == shred.BODY)
        bad = told.union(bodies.where(~same).select(F.col("key").alias("seq"), said("rtype"), said("id"), F.lit("type or id is another in the document").alias("error")))
        bad = self._read([self._write(bad, "bad")], "seq long, rtype string, id string, error string")
        if not partly and (errors := bad.orderBy("seq").limit(20).collect()):
            raise Rejected([f"{r.rtype}/{r.id}: {r.error}" for r in errors])
        puts = bodies.where(same).select(F.col("key").alias("seq"), F.lit("put").alias("op"), "rtype", F.col("rid").alias("id"), F.col("cols")["expected"].cast("long").alias("expected"), said("body"))
        gone = changes.where("op = 'delete' and rtype is not null and id is not null").select("seq", "op", "rtype", "id", F.col("expected").cast("long").alias("expected"), F.lit(None).cast("string").alias("body"))
        good = puts.unionByName(gone)
        good = good.join(bad.where("id is not null").select("rtype", "id").distinct(), ["rtype", "id"], "left_anti")
        # versions, against the last one of each document
        if state["base"] or state["deltas"]:
            last = self.heads(state, condition=self._named(good)).select("rtype", "id", F.struct("version_id", "op", "row_hash", "row_hash3").alias("h"))
            found = good.join(last, ["rtype", "id"], "left")
        else:
            found = good.withColumn("h", F.lit(None).cast("struct<version_id:long,op:string,row_hash:binary,row_hash3:binary>"))
        w = Window.partitionBy("rtype", "id").orderBy("seq")
        was = F.coalesce(F.lag("op").over(w) == "put", F.coalesce(~F.col("h.op").isin("D", "X"), F.lit(False)))
        found = found.withColumn("live", was).where("op = 'put' or live")  # a second delete in a row does nothing
        found = found.withColumn("version_id", F.coalesce(F.col("h.version_id"), F.lit(0)) + F.row_number().over(w)).withColumn("newest", F.lead("seq").over(w).isNull())
        found = found.withColumn("found", F.when(F.col("live"), F.col("version_id") - 1).otherwise(0).cast("long"))
        shape = "seq long, rtype string, id string, expected long, found long"
        if changes.where("expected is not null").select("seq").limit(1).count():
            found = found.withColumn("wrong", F.col("expected").isNotNull() & (F.col("expected") != F.col("found")))
            aside = self._write(found, "versions")
            found = self.spark.read.schema(found.schema).parquet(aside)
            wrong = self._read([self._write(found.where("wrong").select("seq", "rtype", "id", "expected", "found"), "wrong")], shape)
        else:
            wrong = self.spark.createDataFrame([], shape)
        if not partly and (conflicts := wrong.orderBy("seq").limit(20).collect()):
            raise Conflict(conflicts)
        new = found.join(wrong.select("rtype", "id").distinct(), ["rtype", "id"], "left_anti").select(
            "seq", "rtype", "id", "version_id", moment.alias("last_updated"), F.when(F.col("op") == "delete", "D").when(F.col("live"), "U").otherwise("C").alias("op"), F.when(F.col("op") == "put", F.col("body")).alias("resource"),
            *(F.lit(v).alias(k) for k, v in audit.__dict__.items()), "h", "newest",
        )
        new = new.withColumn("image", integrity.image(new)).withColumn("last", F.col("h.row_hash")).withColumn("last3", F.col("h.row_hash3")).drop("h")
        part = self._write(linked(new, self.ring.signing, "seq").select("seq", "newest", *names(HISTORY)), "history")
        done = self._read([part], "seq long, newest boolean, " + HISTORY)
        heads = self._write(done.where("newest").select(*names(DELTA)), "delta")
        types = {r.rtype: r.n for r in self._read([heads], DELTA).groupBy("rtype").agg(F.count("*").alias("n")).collect()}  # a row for each type
        if types:
            held = [n.removeprefix("tbl=") for n in self._listed(path) if n.startswith("tbl=")]
            state["deltas"].append({"heads": heads, "rows": path, "types": types, "tables": held})
            state["logs"]["history"].append(part)
        if mark:
            state["marks"][mark[0]] = mark[1]
        if types or mark:
            if self._due(state):
                self._merge(state)
            self._publish(state)
        return Outcome(done.select("seq", "rtype", "id", "version_id", "op"), bad, wrong)

    def commit(self, changes: DataFrame, audit: Audit = Audit(), at: datetime | None = None, skip_bad: bool = False) -> DataFrame:
        """apply(), all or nothing: Rejected or Conflict are raised. With ``skip_bad`` documents that don't fit are left out."""
        if not skip_bad:
            return self.apply(changes, audit, at, partly=False).done
        out = self.apply(changes, audit, at)
        if conflicts := out.conflicts.limit(20).collect():
            raise Conflict(conflicts)
        return out.done

    def load(self, docs: DataFrame, audit: Audit = Audit(), at: datetime | None = None, mark: tuple[str, int] | None = None, strict: bool = False) -> tuple[int, DataFrame]:
        """Upserts documents (body, and context if there is one): (number written, what was refused: rtype, rid, error, context).

        Documents of one id are versions of it, in the order of the rows. Those that ``docs`` says an
        ``error`` of are refused with it; ``strict`` also refuses those that break a rule of their types.
        """
        given = [F.col(c) if c in docs.columns else F.lit(None).cast("string").alias(c) for c in ("context", "error")]
        wanted = docs.select(F.monotonically_increasing_id().alias("seq"), F.lit("put").alias("op"), "body", F.lit(None).cast("long").alias("expected"), *given)
        named = [F.get_json_object("body", f"$.{k}") for k in ("resourceType", "id")]
        path = self._write(wanted.withColumns({"rtype": named[0], "id": named[1]}), "load")
        rows = self._read([path], "seq long, op string, body string, expected long, context string, error string, rtype string, id string")
        if strict:
            broken = validate.validate(rows, self.map, key="seq").groupBy("key").agg(F.min(F.concat_ws(": ", "path", "problem")).alias("__broken"))
            rows = rows.join(broken, rows["seq"] == broken["key"], "left").withColumn("error", F.coalesce("error", "__broken")).drop("key", "__broken")
        out = self.apply(rows.where("error is null").select("seq", "op", "rtype", "id", "body", "expected"), audit, at, mark=mark)
        told = rows.select("seq", "context", F.col("error").alias("__error"), "rtype", F.col("id").alias("rid"))
        bad = told.join(out.bad.select("seq", "error"), "seq").select("rtype", "rid", "error", "context")
        return out.done.count(), bad.unionByName(told.where("__error is not null").select("rtype", "rid", F.col("__error").alias("error"), "context"))

    def changes(self, rows: list[tuple]) -> DataFrame:
        """(op, rtype, id, body or None, expected or None) in order, as a frame; numbers of documents stay as they are written."""
        return self.spark.createDataFrame([(i, op, t, d, b if b is None or type(b) is str else dumps(b), e) for i, (op, t, d, b, e) in enumerate(rows)], CHANGES)

    def put(self, document: dict | str, expected: int | None = None, audit: Audit = Audit(), at: datetime | None = None) -> int:
        """The version written."""
        document = loads(document) if type(document) is str else document
        done = self.commit(self.changes([("put", document["resourceType"], document["id"], document, expected)]), audit, at)
        return done.first().version_id

    def delete(self, rtype: str, id_: str, expected: int | None = None, audit: Audit = Audit(), at: datetime | None = None) -> bool:
        return self.commit(self.changes([("delete", rtype, id_, None, expected)]), audit, at).count() > 0

    # --- conditional changes ---

    def matching(self, rtype: str, criteria: list[tuple[str, str]]) -> list[str]:
        """At most two ids: none, one, or several."""
        return [r.id for r in self.searcher().matches(rtype, criteria).select("id").orderBy("id").limit(2).collect()]

    def conditional_create(self, document: dict, criteria: list[tuple[str, str]], **more: object) -> tuple[str, str]:
        """("created", id), or ("existing", id) of the one match; several raise Multiple."""
        found = self.matching(document["resourceType"], criteria)
        if len(found) > 1:
            raise Multiple("several documents match")
        if found:
            return "existing", found[0]
        made = {"id": uuid.uuid4().hex} | document
        self.put(made, **more)
        return "created", made["id"]

    def conditional_delete(self, rtype: str, criteria: list[tuple[str, str]], **more: object) -> str:
        found = self.matching(rtype, criteria)
        if len(found) > 1:
            raise Multiple("several documents match")
        return "deleted" if found and self.delete(rtype, found[0], **more) else "no match"

    # --- reading ---

    def read(self, asked: DataFrame) -> DataFrame:
        """The rows of ``asked`` (rtype, id and any others) with version_id, resource (its version in meta) and status 200, 404 or 410."""
        state = self._pointer()
        named = self._named(asked)
        heads = self.heads(state, condition=named).select("rtype", "id", "version_id", "op")
        texts = self.current(state, condition=named).select("rtype", "id", with_versions("resource", "version_id").alias("resource"))
        status = F.when(F.col("op").isNull(), 404).when(F.col("op").isin("D", "X"), 410).otherwise(200)
        return asked.join(heads, ["rtype", "id"], "left").join(texts, ["rtype", "id"], "left").withColumn("status", status).drop("op")

    def get_text(self, asked: list[tuple[str, str]]) -> list[str | None]:
        """Documents in the asked order from one snapshot, as JSON with meta.versionId; None where there is none.

        A few are named in one filter on the live documents; more are joined.
        """
        if len(asked) <= MOST_NAMED:
            named = F.col("id").isin(sorted({d for _, d in asked}))
            found = self.current(kinds={t for t, _ in asked}, condition=named).select("rtype", "id", "version_id", "resource").collect()
            texts = {(r.rtype, r.id): dumps(with_version(loads(r.resource), r.version_id)) for r in found}
            return [texts.get(x) for x in asked]
        want = self.spark.createDataFrame([(i, t, d) for i, (t, d) in enumerate(asked)], "pos int, rtype string, id string")
        rows = {r.pos: r.resource for r in self.read(want).select("pos", "resource").collect()}
        return [rows[i] for i in range(len(asked))]

    def get(self, asked: list[tuple[str, str]]) -> list[dict | None]:
        """get_text() as values, whose numbers are lexical.Number, so that dumps() gives them as they were written."""
        return [None if t is None else loads(t) for t in self.get_text(asked)]

    def _versions(self, rtype: str, id_: str) -> DataFrame:
        return self.table("history").where((F.col("rtype") == rtype) & (F.col("id") == id_))

    def vread(self, rtype: str, id_: str, version: int) -> DataFrame:
        return self._versions(rtype, id_).where(F.col("version_id") == version)

    def history(self, rtype: str, id_: str) -> DataFrame:
        """All versions, the newest first."""
        return self._versions(rtype, id_).orderBy(F.col("version_id").desc())

    def status(self, rtype: str, id_: str) -> tuple[str, int | None]:
        """("active" | "deleted", version), or ("unknown", None)."""
        row = self.heads(kinds={rtype}, condition=F.col("id") == id_).first()
        return ("unknown", None) if row is None else ("deleted" if row.op in ("D", "X") else "active", row.version_id)

    def searcher(self) -> Searcher:
        """Over the tables of the present snapshot."""
        state = self._pointer()
        return Searcher(self.map, lambda name: self.table(name, state))

    def search(self, rtype: str, query: str) -> dict:
        """A page as a bundle: total, matches, includes, warnings and what asks for the next page."""
        request, searcher = Request.parse(query), self.searcher()
        page = searcher.page(rtype, request)
        ids = [r.id for r in page.select("id").collect()]
        here = self.spark.createDataFrame([(i,) for i in ids], "id string")
        matched = searcher.tables(self.map.resources[rtype].base.name).join(here, "id", "left_semi")
        more = searcher.included(rtype, request, matched).collect() if request.include or request.revinclude else []
        entries = [{"resource": d, "search": {"mode": "match"}} for d in self.get([(rtype, i) for i in ids])] if ids else []
        if more:
            entries += [{"resource": d, "search": {"mode": "include"}} for d in self.get([(r.type, r.id) for r in more]) if d is not None]
        out = {"resourceType": "Bundle", "type": "searchset", "entry": entries}
        if request.total != "none":
            out["total"] = searcher.total(rtype, request).first().total
        if any(r.truncated for r in more):
            out["warning"] = "not all included documents are listed"
        if link := searcher.next_link(request, ids):
            out["next"] = link
        return out

    # --- upgrades ---

    def upgrade(self, new: RelMap, destructive: bool = False) -> evolve.Upgrade:
        """Brings the tables to another map: added columns, folded ones filled, and with ``destructive`` removals; what was done.

        Only tables that differ are written. Documents and history stay as they are. A column of
        another type is refused, and a removal unless it is asked for.
        """
        old = self.kept_map()
        done = evolve.plan(self.spark, old, new, destructive)
        self.map = old
        state = self._pointer()
        if state["deltas"]:
            self._merge(state)
        before = {t.name: t for r in old.resources.values() for t in r.tables}
        after = {t.name: t for r in new.resources.values() for t in r.tables}
        for name in sorted(set(state["tables"]) & set(after)):
            if evolve.columns(before[name]) != evolve.columns(after[name]):
                resource = next(r for r in new.resources.values() if after[name] in r.tables)
                order, options = evolve.layout(resource, after[name])
                made = evolve.upgraded(self.table(name, state), after[name], before[name])
                state["tables"][name] = self._write(made.repartitionByRange(order[0]).sortWithinPartitions(*order), name, **options)
        state["tables"] = {n: p for n, p in state["tables"].items() if n in after}
        self.map = new
        self._publish(state | self._keep_map(new))
        return done

    # --- the log, integrity, erasure ---

    def log_access(self, rows: DataFrame) -> None:
        """Appends records (all columns but seq) at once; their order is that of ``ts``, then of the rest.

        Records are sorted over the cluster and written; then each part is numbered from where the
        part before it ends, which takes one count for each part.
        """
        state = self._pointer()
        start = self.table("access", state).agg(F.coalesce(F.max("seq"), F.lit(0)).alias("n")).first().n
        order = ["ts", *sorted(c for c in rows.columns if c != "ts")]
        place = F.monotonically_increasing_id()
        aside = self._write(rows.repartitionByRange(*order).sortWithinPartitions(*order).select("*", F.shiftright(place, 33).alias("__part"), place.bitwiseAND((1 << 33) - 1).alias("__row")), "unnumbered")
        placed = self.spark.read.parquet(aside)
        counts = sorted((r.part, r.n) for r in placed.groupBy(F.col("__part").alias("part")).agg(F.count("*").alias("n")).collect())
        firsts, n = [], start
        for part, size in counts:
            firsts.append((part, n))
            n += size
        numbered = placed.join(F.broadcast(self.spark.createDataFrame(firsts, "__part long, __first long")), "__part").withColumn("seq", F.col("__first") + F.col("__row") + 1)
        state["logs"]["access"].append(self._write(numbered.select(*names(ACCESS)), "access"))
        self._publish(state)
        self._fs.delete(self._path(aside), True)

    def verify(self) -> DataFrame:
        return integrity.verify(self.table("history"), self.ring.all(), self.table("signatures"))

    def witness(self) -> str:
        return integrity.witness(self.table("history")).first().witness

    def resign(self, actor: str, reason: str) -> int:
        state = self._pointer()
        made = integrity.resign(self.table("history", state), self.table("signatures", state), self.ring, F.current_timestamp(), actor, reason)
        part = self._write(made, "signatures")
        state["logs"]["signatures"].append(part)
        self._publish(state)
        return self.spark.read.parquet(part).count()

    def purge(self, rtype: str, id_: str, actor: str, reason: str) -> bool:
        """Erases a document, its rows and its history, leaving one mark; the only rewriting of history there is.

        Only folders of the history that hold the document are written anew, and the type's part of the base.
        """
        state = self._pointer()
        gone = self.spark.createDataFrame([(rtype, id_)], "rtype string, id string")
        mine = (F.col("rtype") == rtype) & (F.col("id") == id_)
        files = [r.f for r in self.table("history", state).where(mine).select(F.col("_metadata.file_path").alias("f")).distinct().collect()] if state["logs"]["history"] else []  # at most one for each version
        held = [p for p in state["logs"]["history"] if any(p.rsplit("/", 1)[1] in f for f in files)]
        if not held:
            return False
        left = integrity.purge(self._read(held, HISTORY), gone, F.current_timestamp(), actor, reason)
        part = self._write(left, "history")
        state["logs"]["history"] = [p for p in state["logs"]["history"] if p not in held] + [part]
        mark = self._read([part], HISTORY).where(mine).select(*names(HEADS), F.lit(None).cast("string").alias("resource"), F.lit(None).cast("long").alias("seq"))
        state["deltas"].append({"heads": self._write(mark, "delta"), "rows": "", "types": {rtype: 1}, "tables": []})
        self._merge(state)
        self._publish(state)
        self.vacuum()  # erased content must not stay in older folders
        return True


@F.pandas_udf(StringType())
def with_versions(texts: pd.Series, versions: pd.Series) -> pd.Series:
    """The documents' texts with meta.versionId, all else as it is written."""
    return pd.Series([None if t is None else dumps(with_version(loads(t), v)) for t, v in zip(texts, versions, strict=True)], dtype=object)


def with_version(document: dict, version: int) -> dict:
    meta = document.get("meta")
    return document | {"meta": (meta if isinstance(meta, dict) else {}) | {"versionId": str(version)}}


def etag(version: int | Column) -> str | Column:
    """The tag of a version, or of a column of them."""
    if isinstance(version, Column):
        return F.concat(F.lit('W/"'), version.cast("string"), F.lit('"'))
    return f'W/"{version}"'


def parse_etag(value: str) -> int:
    inner = value.strip().removeprefix("W/").strip('"')
    if not inner.isdigit():
        raise ValueError("no version in the tag")
    return int(inner)
