"""Files of documents, in pieces."""


def test_a_file_gives_its_documents_in_pieces(spark, tmp_path):
    """Lines keep their numbers, and a file is not cut into all its lines at once."""
    from docweave.sources import documents

    found = documents._documents("f", b'{"a":1}\n\n  \n{"b":2}\nx')
    assert next(found) == ('{"a":1}', "f:1", None)
    assert list(found) == [('{"b":2}', "f:4", None), ("x", "f:5", None)]


def test_documents_of_files_are_bounded(spark, tmp_path, monkeypatch):
    """More customers make more files and more bundles, none larger than the bound."""
    from docweave import catalog_rows
    from docweave.sources import documents

    seen = []
    read = documents.read
    monkeypatch.setattr(catalog_rows, "FILE_DOCUMENTS", 5)
    monkeypatch.setattr(documents, "read", lambda s, p: seen.append(p) or read(s, p))
    spark.range(80).selectExpr("id AS c_custkey", "'x' AS c_name", "1 AS c_nationkey", "cast(id AS double) AS c_acctbal", "'s' AS c_mktsegment").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    found = {r.kind: r.n for r in catalog_rows.read_files(spark, str(tmp_path)).collect()}
    assert found == {"line": 20, "gzipped line": 20, "bundle": 20, "not JSON": 20}
    contexts = [r.context.split("#")[0].rsplit(":", 1)[0] if "#" not in r.context else r.context.split("#")[0] for r in read(spark, seen[0]).select("context").collect()]
    assert max(map(contexts.count, set(contexts))) == 5
