"""Stored tables: base and deltas, merging, upgrades, exact numbers, reports, repeated batches."""

import copy
import json

import pytest
from docweave.functions import lexical
from docweave.operators import bundles, store as stores
from docweave.operators.store import Store
from docweave.plans import evolve
from docweave.plans.search_compile import generate
from docweave.sources import documents
from docweave.streaming.load import stream_load

import spec


@pytest.fixture(scope="module")
def relmap():
    return generate(spec.DEFINITIONS, spec.PARAMETERS, "r5")


@pytest.fixture
def store(spark, relmap, tmp_path):
    made = Store(spark, f"file://{tmp_path}/store", relmap)
    made.init()
    return made


def bodies(spark, texts):
    return spark.createDataFrame([(t,) for t in texts], "body string")


ODD = '{"resourceType":"Observation","id":"n","valueQuantity":{"value":1.50},"referenceRange":[{"low":{"value":1e2},"high":{"value":12345678901234567890.123456789}}]}'


def test_numbers_stay_as_they_are_written(store):
    versions = [store.put(ODD), store.put(lexical.loads(ODD))]
    assert versions == [1, 2]
    text = store.get_text([("Observation", "n")])[0]
    assert all(x in text for x in ("1.50", "1e2", "12345678901234567890.123456789", '"versionId":"2"'))
    assert lexical.dumps(store.get([("Observation", "n")])[0]) == text
    bundle = lexical.loads('{"type":"transaction","entry":[{"resource":' + ODD.replace('"n"', '"t"') + ',"request":{"method":"PUT","url":"Observation/t"}}]}')
    bundles.transaction(store, bundle)
    bundles.batch(store, lexical.loads(lexical.dumps(bundle).replace('"t"', '"b"').replace("Observation/t", "Observation/b")))
    for id_ in "tb":
        assert "1.50" in store.get_text([("Observation", id_)])[0]
        assert "1e2" in store.vread("Observation", id_, 1).first().resource
    assert '"value":1.50' in lexical.dumps(store.search("Observation", "_id=b"))


def test_rows_give_the_documents_back(spark, store, tmp_path):
    store.load(bodies(spark, spec.TEXTS + [json.dumps(d) for d in [*spec.PATIENTS, *spec.OBSERVATIONS, spec.ORGANIZATION]]))
    store.delete("Patient", "rook")
    store.put(spec.PATIENTS[0] | {"active": True})
    for _ in range(2):
        for kind in ("Patient", "Observation", "Organization", "Bundle", "Questionnaire", "QuestionnaireResponse"):
            assert store.differing(kind).collect() == []
        assert store.table("patient").where("id = 'rook'").count() == 0
        assert store.table("patient").where("id = 'tern'").first().active is True
        assert store.table("patient").where("id = 'tern'").first().version_id == 2
        assert store.table("patient_name").where("rid = 'tern'").count() == 2
        store.merge()
    assert not store.merge()
    store.export(f"file://{tmp_path}/out", ["Patient"])
    out = {json.loads(r.body)["id"]: r.body for r in documents.read_lines(spark, f"file://{tmp_path}/out").collect()}
    assert sorted(out) == ["p1", "p2", "p3", "quill", "tern", "umber", "vole"]
    assert '"valueDecimal":1.50' in out["p1"]
    names = store.views(["Patient"])
    assert "r5_patient_name" in names
    assert spark.sql("SELECT count(*) n FROM r5_patient p JOIN r5_patient_name c ON c.rid = p.id WHERE c.family_norm LIKE 'oka%'").first().n == 1
    assert store.vacuum() > 0
    assert store.differing("Patient").collect() == []


def test_searches_run_no_python_and_prune(spark, store):
    store.load(bodies(spark, [json.dumps(d) for d in [*spec.PATIENTS, *spec.OBSERVATIONS]]))

    def plan(query):
        return store.searcher().matches("Patient", [tuple(p.split("=")) for p in query.split("&")])._jdf.queryExecution().toString()

    assert "Python" not in plan("family=oka&birthdate=ge1960&_id=rook") and "InArrow" not in plan("family=oka")
    store.merge()
    merged = plan("family=oka&birthdate=ge1960&_id=rook,quill")
    assert "Python" not in merged
    for filter_ in ("In(id, [quill,rook])", "GreaterThanOrEqual(family_norm,oka)", "GreaterThanOrEqual(birth_date_sort,1960-01-01)"):
        assert filter_ in merged
    assert "LeftAnti" not in merged
    assert [r.id for r in store.searcher().matches("Patient", [("family", "oka")]).orderBy("id").collect()] == ["quill", "rook"]


def test_many_deltas_are_merged(store, monkeypatch):
    monkeypatch.setattr(stores, "MOST_DELTAS", 3)
    for i in range(4):
        store.put({"resourceType": "Organization", "id": f"o{i % 2}", "name": f"N{i}"})
    state = store._pointer()
    assert len(state["deltas"]) == 1
    assert state["base"]["Organization"]["n"] == 2
    assert sorted((r.id, r.version_id, r.name, r.name_norm) for r in store.table("organization").collect()) == [("o0", 2, "N2", "n2"), ("o1", 2, "N3", "n3")]
    assert store.put({"resourceType": "Organization", "id": "o0", "name": "last"}, expected=2) == 3
    assert store.verify().count() == 0


def test_layout(relmap):
    patient = relmap.resources["Patient"]
    assert evolve.layout(patient, patient.base)[0] == ["id"]
    assert "parquet.bloom.filter.enabled#gender" in evolve.layout(patient, patient.base)[1]
    name = next(t for t in patient.tables if t.name == "patient_identifier")
    order, options = evolve.layout(patient, name)
    assert order == ["rid", "ords"]
    assert "parquet.bloom.filter.enabled#value" in options


def test_a_store_is_upgraded(spark, relmap, tmp_path):
    old = copy.deepcopy(relmap)
    for r in old.resources.values():
        for t in r.tables:
            t.columns = [c for c in t.columns if not c.name.endswith("_norm")]
        r.params = [p for p in r.params if p.kind != "string"]
    patient = old.resources["Patient"]
    lost = patient.base.column("birth_date_sort")
    patient.base.columns.remove(lost)
    store = Store(spark, f"file://{tmp_path}/store", old)
    store.init()
    store.load(bodies(spark, [json.dumps(d) for d in spec.PATIENTS]))
    newer = Store(spark, f"file://{tmp_path}/store", relmap)
    with pytest.raises(ValueError, match="upgrade"):
        newer.init()
    before = store._pointer()
    done = newer.upgrade(relmap)
    assert ("patient_name", "family", "family_norm") in done.backfill
    assert ("patient", "birth_date_sort", "date") in done.added
    assert not newer.init()
    assert newer.kept_map() == relmap
    assert [r.id for r in newer.searcher().matches("Patient", [("family", "akes"), ("birthdate", "1967")]).collect()] == ["tern"]
    assert newer.table("history").count() == 5 and newer.verify().count() == 0
    after = newer._pointer()
    assert after["logs"] == before["logs"]
    assert newer.upgrade(relmap) == evolve.Upgrade([], [], [])
    with pytest.raises(ValueError, match="destructive"):
        newer.upgrade(old)
    assert ("patient", "birth_date_sort") in newer.upgrade(old, destructive=True).removed
    assert "birth_date_sort" not in newer.table("patient").columns
    assert newer.differing("Patient").collect() == []


def test_lines_end_at_line_feeds_alone(spark, store, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    odd = json.dumps({"resourceType": "Organization", "id": "u", "name": "a\u2028b\x85c"}, ensure_ascii=False)
    (src / "a.ndjson").write_bytes((odd + "\r\n \r\n" + '{"resourceType":"Organization","id":"bad","nope":1}\nnot json\n').encode())
    (src / "latin").write_bytes(b"\xe9\xff")
    n, bad = store.load(documents.read(spark, f"file://{src}"))
    assert n == 1
    assert store.get([("Organization", "u")])[0]["name"] == "a\u2028b\x85c"
    told = sorted((r.context.rsplit("/", 1)[1], r.error) for r in bad.collect())
    assert told == [("a.ndjson:3", "nope: is not in the schema"), ("a.ndjson:4", "not JSON"), ("latin", "is not UTF-8")]


def test_a_batch_of_a_stream_counts_once(spark, store, tmp_path):
    doc = json.dumps({"resourceType": "Organization", "id": "s", "name": "S"})
    for _ in range(2):
        store.load(bodies(spark, [doc]), mark=("stream", 4))
    assert store.status("Organization", "s") == ("active", 1)
    store.load(bodies(spark, [doc]), mark=("stream", 5))
    assert store.status("Organization", "s") == ("active", 2)
    src = tmp_path / "in"
    src.mkdir()
    (src / "a").write_text(doc)
    stream_load(spark, store, f"file://{src}", f"file://{tmp_path}/cp").awaitTermination()
    assert store._pointer()["marks"][f"file://{tmp_path}/cp"] == 0
    assert store.status("Organization", "s") == ("active", 3)


def test_read_says_what_became_of_each(spark, store):
    for d in spec.PATIENTS[:2]:
        store.put(d)
    store.delete("Patient", "rook")
    asked = spark.createDataFrame([("Patient", i, k) for k, i in enumerate(("tern", "rook", "never"))], "rtype string, id string, k int")
    assert sorted((r.k, r.status, r.version_id) for r in store.read(asked).collect()) == [(0, 200, 1), (1, 410, 2), (2, 404, None)]


def test_refused_and_conflicting_changes_stand_alone(store):
    org = lambda i, **more: {"resourceType": "Organization", "id": i, "name": i} | more
    store.put(org("a"))
    rows = [("put", "Organization", "a", org("a"), 7), ("put", "Organization", "b", org("b"), 0), ("put", "Organization", "c", org("c", nope=1), None), ("put", "Organization", "d", org("other"), None)]
    out = store.apply(store.changes(rows))
    assert [(r.seq, r.version_id) for r in out.done.collect()] == [(1, 1)]
    assert [(r.seq, r.expected, r.found) for r in out.conflicts.collect()] == [(0, 7, 1)]
    assert sorted((r.seq, r.error) for r in out.bad.collect()) == [(2, "nope: is not in the schema"), (3, "type or id is another in the document")]


def test_purge_rewrites_only_what_holds_the_document(store):
    for i in "abc":
        store.put({"resourceType": "Organization", "id": i, "name": i})
    before = store._pointer()["logs"]["history"]
    assert store.purge("Organization", "b", "officer", "request")
    after = store._pointer()["logs"]["history"]
    assert len(set(before) & set(after)) == 2 and len(after) == 3
    assert store.table("organization").orderBy("id").select("id").collect() == [("a",), ("c",)]
    assert store.verify().count() == 0
    assert store.status("Organization", "b") == ("deleted", 2)


def test_strict_loads(spark, tmp_path):
    from docweave.catalog_rows import RULES, rule_map

    store = Store(spark, f"file://{tmp_path}/checks", rule_map())
    store.init()
    docs = [(f'{{"resourceType":"Check","id":"c{i}",{text}}}', f"f:{i}") for i, (text, _) in enumerate(RULES)] + [("broken", "f:x")]
    n, bad = store.load(spark.createDataFrame(docs, "body string, context string"), strict=True)
    assert n == 1
    assert sorted((r.context, r.error) for r in bad.collect()) == sorted([(f"f:{i}", says) for i, (_, says) in enumerate(RULES) if says] + [("f:x", "not JSON")])
    n, bad = store.load(spark.createDataFrame(docs, "body string, context string"))
    assert (n, bad.count()) == (len(RULES), 1)


def test_tables_in_a_database(spark, relmap, tmp_path):
    """Through the database that comes with Spark; it has no arrays, so base tables alone."""
    from docweave.sources import jdbc

    assert len(jdbc.ranges("id", 1)) == 1
    for n in (2, 16, 64, 1000):
        conditions = jdbc.ranges("id", n)
        values = spark.createDataFrame([("-a",), ("0",), ("Zz",), ("z9",), (None,), ("m.1",)], "id string")
        assert [sum(values.where(c).where(values.id.eqNullSafe(v)).count() for c in conditions) for v in ("-a", "0", "Zz", "z9", None, "m.1")] == [1] * 6
    try:
        spark._jvm.java.lang.Class.forName("org.apache.derby.iapi.jdbc.AutoloadedDriver")
    except Exception:
        pytest.skip("no database driver")
    store = Store(spark, f"file://{tmp_path}/s", relmap)
    store.init()
    store.load(bodies(spark, [json.dumps(d) for d in [*spec.PATIENTS, spec.ORGANIZATION]]))
    url, base = f"jdbc:derby:{tmp_path}/db;create=true", relmap.resources["Organization"].base
    driver = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    jdbc.write_table(store.table("organization"), url, base, **driver)
    back = jdbc.read_table(spark, url, base, n=4, **driver)
    assert back.columns == store.table("organization").columns
    assert [(r.id, r.name, r.name_norm, r.version_id) for r in back.collect()] == [("dock", "Dock Seven", "dock seven", 1)]
    plan = back.where("id = 'dock'").select("name")._jdf.queryExecution().toString()
    scan = next(line for line in plan.split("Physical Plan")[1].splitlines() if "JDBCRelation" in line)
    assert "EqualTo(id,dock)" in scan.replace("ID", "id")
    assert "part_of_display" not in scan
