"""The command line, end to end."""

import json

import pytest
from docweave.__main__ import main
from docweave.functions import guards

import spec


def test_commands(spark, tmp_path, capsys):
    (tmp_path / "definitions.json").write_text(json.dumps({"resourceType": "Bundle", "entry": [{"resource": d} for d in spec.DEFINITIONS]}))
    (tmp_path / "parameters.json").write_text(json.dumps({"resourceType": "Bundle", "entry": [{"resource": p} for p in spec.PARAMETERS]}))
    (tmp_path / "docs.ndjson").write_text("\n".join(json.dumps(d) for d in [*spec.PATIENTS, *spec.OBSERVATIONS]) + '\n{"resourceType":"Patient","id":"bad","x":1}\n')

    def run(*arguments, code=0):
        base = ["--store", f"file://{tmp_path}/store", "--map", f"{tmp_path}/map.gz", "--key", f"{tmp_path}/key", "--actor", "tester"]
        assert main([*base, *arguments], spark) == code
        return [json.loads(line) for line in capsys.readouterr().out.splitlines()]

    assert run("gen", f"{tmp_path}/definitions.json", f"{tmp_path}/parameters.json", "r5", f"{tmp_path}/map.gz")[0]["types"] == 6
    run("chain-key-new", f"{tmp_path}/key")
    assert run("init") == [{"created": True}]
    assert run("load", f"file://{tmp_path}/docs.ndjson", code=1)[0]["loaded"] == 8
    assert run("get", "Patient", "tern")[0]["name"][0]["family"] == "Åkesson"
    assert run("get", "Patient", "nobody", code=1) == [None]
    assert [e["resource"]["id"] for e in run("search", "Patient", "family=okafor&_sort=-birthdate")[0]["entry"]] == ["quill", "rook"]
    run("delete", "Patient", "vole")
    assert [r["op"] for r in run("history", "Patient", "vole")] == ["D", "C"]
    (tmp_path / "bundle.json").write_text(json.dumps({"type": "transaction", "entry": [{"resource": spec.ORGANIZATION, "request": {"method": "PUT", "url": "Organization/dock"}}]}))
    assert run("bundle", f"{tmp_path}/bundle.json")[0][0]["status"] == 201
    assert run("verify-audit") == [{"breaks": []}]
    assert run("chain-witness")[0]["witness"].startswith("9:")
    assert run("chain-resign")[0]["signed"] == 10
    run("purge", "Patient", "quill")
    run("export", f"file://{tmp_path}/out", "Patient")
    assert sum(len(f.read_text().splitlines()) for f in (tmp_path / "out").glob("part-*")) == 3
    assert any(r["tbl"] == "patient_name" for r in run("transform", f"file://{tmp_path}/docs.ndjson"))
    assert run("support")[0]
    assert run("capability")[0]["kind"] == "instance"
    run("drop")
    with pytest.raises(FileNotFoundError):
        run("verify-audit")


def test_guards():
    assert guards.valid_id("a-1.B")
    assert not any(map(guards.valid_id, ("", "a/b", "x" * 65, "a\n")))
    assert guards.principal("practitioner-42") == "practitioner-42"
    assert guards.principal("a\nb") == guards.principal(None) == ""
    assert guards.request_id("x" * 200, "made") == "made"
    assert guards.valid_host("example.org:8080")
    assert not guards.valid_host("example.org/path")
    assert guards.criteria_key("P", [("a", "1"), ("b", "2")]) == guards.criteria_key("P", [("b", "2"), ("a", "1")])
