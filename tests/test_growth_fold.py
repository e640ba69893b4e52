"""Folding of long texts."""


def test_only_texts_beyond_ascii_are_folded_in_python(spark):
    from docweave.functions.text import fold, folded

    texts = [None, "", "ABC", "Ça Éa", "İß", "x" * 3000 + "É"] * 50
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").coalesce(1)
    found = rows.select("t", folded(rows.t).alias("f"))
    assert "octet_length" in found._jdf.queryExecution().toString()
    assert all(r.f == (None if r.t is None else fold(r.t)) for r in found.collect())
