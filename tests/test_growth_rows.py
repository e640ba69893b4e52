"""Documents to rows and back: the short way, and what is read of what is written."""


def test_shred_reads_each_table_of_its_own_files(spark):
    from docweave.catalog_documents import order_map
    from docweave.operators import shred

    docs = spark.createDataFrame([('{"resourceType":"Order","id":"1","status":"O","tag":["a","b"]}',), ('{"resourceType":"Order","id":"2","shoe":1}',)], "body string")
    tables, errors = shred.shred(docs, order_map())
    assert "PartitionFilters: [isnotnull(tbl" in tables["order_tag"]._jdf.queryExecution().toString()
    assert [(r.rid, r.value) for r in tables["order_tag"].orderBy("ords").collect()] == [("1", "a"), ("1", "b")]
    assert [(r.rid, r.error) for r in errors.collect()] == [("2", "shoe: is not in the schema")]


def test_the_short_way_gives_the_rows_of_the_whole_way():
    """Documents of all shapes: either the same rows, or left to the whole way."""
    from docweave.catalog_documents import order_map
    from docweave.operators import reconstruct, shred

    made = order_map()
    texts = ['{"resourceType":"Order","id":"7","total":1.50,"customer":{"reference":"Customer/3"},"tag":["a"],"item":[{"number":1,"part":{"reference":"#x"}},{}]}', '{"resourceType":"Order","id":"8"}', '{"resourceType":"Order","item":[],"id":"9"}', '{"resourceType":"Order","id":"10","tag":[null]}', '{"resourceType":"Order","id":"11","total":"1"}', '{"resourceType":"Order","id":"12","item":[{"id":"x"}]}']
    short = shred.Short(made.resources["Order"], frozenset())
    taken = 0
    for text in texts:
        whole = sorted((t, tuple(o or ()), sorted(c)) for _, _, t, o, c, e in shred._one(made, text) if not e)
        out = shred.Flat()
        try:
            document = shred.loads(text)
            short.into(out)(document, (), document.get("id"))
        except shred.Unusual:
            out.back()
            assert out.batch(False).num_rows == 0
            continue
        taken += 1
        out.end(None)
        rows = out.batch(False).to_pylist()
        assert sorted((r["tbl"], tuple(r["ords"]), sorted(r["cols"])) for r in rows) == whole
        numbers = {t.name: i for i, t in enumerate(made.resources["Order"].tables)}
        again = reconstruct.Short(made.resources["Order"]).text(document["id"], [[numbers[t], list(o), dict(c)] for t, o, c in whole])
        assert again == text
    assert taken == 2


def test_wide_and_damaged_documents_give_what_they_gave(spark):
    """Elements that aren't there are passed over, their twins aren't; a batch's rows are texts until their turn."""
    from docweave.catalog_rows import thing_map
    from docweave.operators import reconstruct, shred

    texts = ['{"resourceType":"Thing","id":"1","nick":["a",null],"wide":{"f0":"x","f150":"y"},"_active":{"id":"z"}}', '{"resourceType":"Thing","id":"2","nick":["a",null],"_nick":[null,{"id":"n"}],"wide":{"f0":"x","_f7":{"id":"t"},"f150":"y"},"_born":{"id":"z"}}']
    tables, errors = shred.shred(spark.createDataFrame([(t,) for t in texts], "body string"), thing_map())
    assert [(r.rid, r.error) for r in errors.collect()] == [("1", "nick: item 2 has neither value nor extension")]
    back = reconstruct.reconstruct(tables, thing_map(), "Thing")
    found = [(r.id, shred.loads(r.body)) for r in back.collect()]
    assert found == [("2", shred.loads(texts[1]))]
    assert "collect_list(named_struct" not in back._jdf.queryExecution().toString()
