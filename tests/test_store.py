"""Versions, conflicts, bundles, integrity, erasure, logs, files, streams and upgrades."""

import copy
import gzip
import json
from datetime import datetime

import pytest
from docweave.functions.digests import check_tag, tag
from docweave.operators import bundles, integrity
from docweave.operators.store import Audit, Conflict, Multiple, Rejected, Store, etag, parse_etag
from docweave.plans import evolve
from docweave.plans.model import Param, Table
from docweave.plans.search_compile import add_folded, generate
from docweave.sources import documents
from docweave.streaming.load import AccessLog, stream_load
from pyspark.sql import functions as F

import spec


@pytest.fixture(scope="module")
def relmap():
    return generate(spec.DEFINITIONS, spec.PARAMETERS, "r5")


@pytest.fixture
def store(spark, relmap, tmp_path):
    made = Store(spark, f"file://{tmp_path}/store", relmap)
    assert made.init()
    return made


def patient(id_, family, **more):
    return {"resourceType": "Patient", "id": id_, "active": True, "name": [{"family": family}]} | more


def test_versions(store):
    assert not store.init()
    assert store.status("Patient", "a") == ("unknown", None)
    assert store.put(patient("a", "One")) == 1
    assert store.put(patient("a", "Two")) == 2
    assert store.delete("Patient", "a")
    assert not store.delete("Patient", "a")
    assert store.status("Patient", "a") == ("deleted", 3)
    assert store.get([("Patient", "a")]) == [None]
    assert store.put(patient("a", "Four")) == 4
    with pytest.raises(Conflict) as e:
        store.put(patient("a", "X"), expected=2)
    assert e.value.rows == [("Patient", "a", 2, 4)]
    assert store.put(patient("a", "Five"), expected=4) == 5
    with pytest.raises(Conflict):
        store.put(patient("a", "X"), expected=0)
    assert [(r.version_id, r.op) for r in store.history("Patient", "a").collect()] == [(5, "U"), (4, "C"), (3, "D"), (2, "U"), (1, "C")]
    assert json.loads(store.vread("Patient", "a", 2).first().resource)["name"][0]["family"] == "Two"
    got = store.get([("Patient", "none"), ("Patient", "a"), ("Patient", "a")])
    assert got[0] is None
    assert got[1]["meta"]["versionId"] == "5"
    assert got[1] == got[2]
    assert parse_etag(etag(5)) == 5
    assert store.verify().collect() == []


def test_a_batch_is_all_or_nothing(store):
    rows = [("put", "Patient", "a", patient("a", "A"), None), ("put", "Patient", "a", patient("a", "B"), 1), ("delete", "Patient", "a", None, 2), ("put", "Patient", "a", patient("a", "C"), 0), ("delete", "Patient", "zz", None, None), ("put", "Patient", "b", patient("b", "B"), None)]
    done = store.commit(store.changes(rows))
    assert sorted((r.seq, r.id, r.version_id, r.op) for r in done.collect()) == [(0, "a", 1, "C"), (1, "a", 2, "U"), (2, "a", 3, "D"), (3, "a", 4, "C"), (5, "b", 1, "C")]
    with pytest.raises(Rejected) as e:
        store.commit(store.changes([("put", "Patient", "ok", patient("ok", "O"), None), ("put", "Patient", "bad", patient("bad", "Zzyzx", nonsense="Zzyzx"), None)]))
    assert "nonsense" in str(e.value)
    assert "Zzyzx" not in str(e.value)
    assert store.status("Patient", "ok") == ("unknown", None)
    assert store.verify().count() == 0


def test_conditional_changes(store):
    who = [("identifier", "urn:mrn|12345")]
    new = {"resourceType": "Patient", "identifier": [{"system": "urn:mrn", "value": "12345"}]}
    state, id_ = store.conditional_create(new, who)
    assert state == "created"
    assert store.conditional_create(new, who) == ("existing", id_)
    store.put(new | {"id": "twin"})
    with pytest.raises(Multiple):
        store.conditional_create(new, who)
    with pytest.raises(Multiple):
        store.conditional_delete("Patient", who)
    store.delete("Patient", "twin")
    assert store.conditional_delete("Patient", who) == "deleted"
    assert store.conditional_delete("Patient", who) == "no match"


def test_bundles(store):
    store.put(patient("old", "Old"))
    obs = {"resourceType": "Observation", "status": "final", "subject": {"reference": "urn:uuid:aaaa-bbbb"}}
    entries = [
        {"fullUrl": "urn:uuid:cccc", "resource": obs | {"id": "o"}, "request": {"method": "PUT", "url": "Observation/o"}},
        {"fullUrl": "urn:uuid:aaaa-bbbb", "resource": {"resourceType": "Patient", "active": True}, "request": {"method": "POST", "url": "Patient"}},
        {"request": {"method": "DELETE", "url": "Patient/old"}},
    ]
    out = bundles.transaction(store, {"entry": entries})
    assert [r["status"] for r in out] == [201, 201, 204]
    assert store.get([("Observation", "o")])[0]["subject"]["reference"] == out[1]["location"]
    poison = [{"resource": patient("p", "P"), "request": {"method": "PUT", "url": "Patient/p"}}, {"resource": patient("q", "Q", nonsenseElement=1), "request": {"method": "PUT", "url": "Patient/q"}}]
    with pytest.raises(Rejected):
        bundles.transaction(store, {"entry": poison})
    assert store.get([("Patient", "p")]) == [None]
    for request in ({"method": "GET", "url": "Patient/p"}, {"method": "PUT", "url": "Patient/p", "ifNoneExist": "x"}):
        with pytest.raises(bundles.Unsupported):
            bundles.transaction(store, {"entry": [{"resource": patient("p", "P"), "request": request}]})
    mixed = [{"request": {"method": "GET", "url": "Observation/o"}}, {"request": {"method": "GET", "url": "Patient/old"}}, {"request": {"method": "GET", "url": "Patient/never"}}, {"request": {"method": "DELETE", "url": "Observation/o"}}, *poison, {"resource": patient("p", "P2"), "request": {"method": "PUT", "url": "Patient/p", "ifMatch": 'W/"9"'}}, {"request": {"method": "PATCH", "url": "x"}}]
    assert [r["status"] for r in bundles.batch(store, {"entry": mixed})] == [200, 410, 404, 204, 201, 400, 409, 501]


def test_search_bundle(store):
    store.load(store.spark.createDataFrame([(json.dumps(d),) for d in [*spec.PATIENTS, *spec.OBSERVATIONS, spec.ORGANIZATION]], "body string"))
    found = store.search("Observation", "status=final&_include=Observation:subject&_count=1")
    assert [(e["resource"]["id"], e["search"]["mode"]) for e in found["entry"]] == [("pulse", "match"), ("rook", "include")]
    assert found["total"] == 2
    assert found["next"] == {"_cursor": "pulse"}
    assert "total" not in store.search("Patient", "_total=none&_lastUpdated=ge2000")
    assert store.search("Patient", "_lastUpdated=lt2000")["entry"] == []


def tampered(history, **change):
    out = history
    for name, (where, value) in change.items():
        out = out.withColumn(name, F.when(F.expr(where), value).otherwise(F.col(name)))
    return out


def test_tampering_is_found(spark, relmap, tmp_path):
    key = integrity.new_key(str(tmp_path / "key"))
    store = Store(spark, f"file://{tmp_path}/store", relmap, integrity.KeyRing(key))
    store.init()
    who = Audit("practitioner-42", "header", "10.0.0.7", "req-abc", "treatment")
    for i in range(4):
        store.put(patient("a", f"V{i}"), audit=who)
    store.put(patient("b", "B"))
    h = store.table("history").cache()
    keys = store.ring.all()
    assert integrity.verify(h, keys).collect() == []
    found = lambda df, k=keys: sorted((r.id, r.version_id, r.what) for r in integrity.verify(df, k).collect())
    assert found(tampered(h, resource=("id = 'a' and version_id = 2", F.lit("{}")))) == [("a", 2, "mac"), ("a", 2, "sha256"), ("a", 2, "sha3-256")]
    assert found(tampered(h, actor=("version_id = 4", F.lit("other")))) == [("a", 4, "mac"), ("a", 4, "sha256"), ("a", 4, "sha3-256")]
    assert found(h.where("not (id = 'a' and version_id = 2)")) == [("a", 3, "link"), ("a", 3, "sha3 link")]
    assert found(tampered(h, row_hash3=("version_id = 4", F.lit(b"x" * 32)))) == [("a", 4, "sha3-256")]
    assert found(tampered(h, row_mac=("version_id = 4", F.lit(None))) ) == []
    truncated = h.where("version_id < 4")
    assert found(truncated) == []
    assert integrity.witness(truncated).first().witness != store.witness()
    assert store.witness().startswith("2:")
    row = h.where("id = 'a' and version_id = 1").first()
    assert (row.actor, row.client, row.reason) == ("practitioner-42", "10.0.0.7", "treatment")


def test_keys_rotate_and_resign(spark, relmap, tmp_path):
    first, second = integrity.new_key(str(tmp_path / "k1")), integrity.new_key(str(tmp_path / "k2"))
    store = Store(spark, f"file://{tmp_path}/store", relmap)
    store.init()
    store.put(patient("a", "unkeyed"))
    store.ring = integrity.KeyRing(first)
    store.put(patient("a", "first"))
    store.ring = store.ring.rotated(second)
    store.put(patient("a", "second"))
    assert store.verify().count() == 0
    assert store.resign("auditor", "rotation") == 3
    assert store.resign("auditor", "rotation") == 0
    store.ring = integrity.KeyRing(second)  # the first key is gone: the counter-signature stands in
    assert store.verify().count() == 0
    signed = store.table("signatures")
    bad = signed.withColumn("row_mac", F.when(F.col("version_id") == 1, F.concat(F.lit(second[0]), F.lit(":" + "0" * 64))).otherwise(F.col("row_mac")))
    assert [(r.version_id, r.what) for r in integrity.verify(store.table("history"), store.ring.all(), bad).collect()] == [(1, "mac")]
    with pytest.raises(FileExistsError):
        integrity.new_key(str(tmp_path / "k1"))
    (tmp_path / "k1").chmod(0o644)
    with pytest.raises(PermissionError):
        integrity.load_key(str(tmp_path / "k1"))
    assert check_tag(None, {}, None, b"") == "absent"
    assert check_tag("x", {}, None, b"") == "malformed"
    assert check_tag(tag(first, None, b"i"), {}, None, b"i") == "unverifiable"
    assert check_tag(tag(first, None, b"i"), {first[0]: first[1]}, None, b"j") == "mismatch"


def test_erasure(store):
    for i in range(3):
        store.put(patient("gone", f"V{i}"))
    store.put(patient("stays", "S"))
    assert store.purge("Patient", "gone", "officer", "request")
    assert not store.purge("Patient", "never", "officer", "request")
    rows = store.history("Patient", "gone").collect()
    assert [(r.version_id, r.op, r.resource) for r in rows] == [(4, "X", None)]
    assert rows[0].prev_hash is not None
    assert store.verify().count() == 0
    assert store.get([("Patient", "gone"), ("Patient", "stays")])[0] is None
    assert store.put(patient("gone", "again")) == 5


def test_access_log(store):
    log = AccessLog(store, "async", most=5, batch=100, wait=60)
    at = datetime(2026, 1, 1)
    assert [log.record(ts=at.replace(second=i), actor=f"a{i % 2}", interaction="read", outcome="ok") for i in range(6)] == [True] * 5 + [False]
    assert (log.refused, log.lost) == (1, 0)
    log.close()
    sync = AccessLog(store, "sync")
    sync.record(ts=at.replace(hour=1), actor="z", interaction="search", outcome="ok", result_count=3)
    AccessLog(store, "off").record(actor="nobody")
    rows = store.table("access").orderBy("seq").collect()
    assert [(r.seq, r.actor) for r in rows] == [(1, "a0"), (2, "a1"), (3, "a0"), (4, "a1"), (5, "a0"), (6, "z")]


def test_files_and_streams(spark, store, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "one.json").write_text(json.dumps(patient("one", "O")))
    (src / "bundle.json.gz").write_bytes(gzip.compress(json.dumps({"resourceType": "Bundle", "entry": [{"resource": patient("two", "T")}, {"fullUrl": "x"}]}).encode()))
    (src / "lines.ndjson").write_text(json.dumps(patient("three", "H")) + "\n\n" + '{"resourceType":"Patient","id":"bad","nope":1.50}\nnot json\n')
    (src / "odd.json").write_text("[1]")
    rows = documents.read(spark, f"file://{src}")
    assert rows.where("error is not null").count() == 1
    n, bad = store.load(rows.where("error is null").select("body"))
    assert n == 3
    assert sorted(str(r.rid) for r in bad.collect()) == ["None", "bad"]
    documents.export(store.table("current"), f"file://{tmp_path}/out", compress=True)
    again = documents.read_lines(spark, f"file://{tmp_path}/out")
    assert sorted(json.loads(r.body)["id"] for r in again.collect()) == ["one", "three", "two"]
    stream_in = tmp_path / "stream"
    stream_in.mkdir()
    (stream_in / "a.ndjson").write_text("\n".join(json.dumps(patient(f"s{i}", "S")) for i in range(5)))
    for _ in range(2):
        stream_load(spark, store, f"file://{stream_in}", f"file://{tmp_path}/cp").awaitTermination()
        (stream_in / "b.ndjson").write_text(json.dumps(patient("s0", "again")))
    assert store.table("current").where("id like 's%'").count() == 5
    assert store.status("Patient", "s0") == ("active", 2)


def test_upgrades(spark, relmap):
    old = copy.deepcopy(relmap)
    old.resources.pop("Organization")
    dropped = old.resources["Patient"].base.columns.pop()
    up = evolve.plan(spark, old, relmap)
    assert ("patient", dropped.name, "string") in up.added
    assert any(t == "organization" for t, _, _ in up.added)
    with pytest.raises(ValueError, match="destructive"):
        evolve.plan(spark, relmap, old)
    assert ("patient", dropped.name) in evolve.plan(spark, relmap, old, destructive=True).removed
    assert evolve.plan(spark, relmap, relmap) == evolve.Upgrade([], [], [])
    # a map from before folding: its rows get their folded values
    plain = copy.deepcopy(relmap)
    for r in plain.resources.values():
        for t in r.tables:
            t.columns = [c for c in t.columns if not c.name.endswith("_norm")]
    up = evolve.plan(spark, plain, relmap)
    assert ("patient_name", "family", "family_norm") in up.backfill
    was, now = (next(t for t in m.resources["Patient"].tables if t.name == "patient_name") for m in (plain, relmap))
    rows = spark.createDataFrame([("muller", [1], "Müller"), ("none", [1], None)], "rid string, ords array<smallint>, family string")
    got = {r.rid: r.family_norm for r in evolve.upgraded(rows, now, was).collect()}
    assert got == {"muller": "muller", "none": None}
    assert evolve.schema(now)["ords"].dataType.simpleString() == "array<smallint>"


def test_install_and_drop(spark, relmap):
    small = copy.deepcopy(relmap)
    small.schema = "docweave_test"
    small.resources = {"Organization": small.resources["Organization"]}
    assert evolve.install(spark, small) == evolve.install(spark, small)
    assert spark.table("docweave_test.organization").count() == 0
    evolve.drop(spark, small)
    assert not spark.catalog.databaseExists("docweave_test")
    add_folded(small)
    small.resources["Organization"].params.append(Param("x", "token"))
    small.resources["Organization"].tables.append(Table("more", "elem"))
