"""The pipeline's stages on a small corpus with planted cases."""

import random

import corpus_pipeline
import public_tokenizers
import tiktoken
from docweave.llm import bbpe


def test_pipeline(spark, tmp_path):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice(["ka", "to", "mi", "ren", "so", "lu", "ved", "an"]) for _ in range(rng.randint(1, 4)))
    line = lambda n: " ".join(word() for _ in range(n)).capitalize() + "."
    text = lambda: "\n".join(line(rng.randint(12, 25)) for _ in range(6))
    docs = [(i, text(), "en", "src") for i in range(60)]
    junk = lambda: "\n".join(" | ".join(word() for _ in range(9)) for _ in range(7))
    docs += [(100 + i, junk(), "en", "src") for i in range(30)]
    docs += [(200, docs[3][1], "en", "src"), (201, docs[4][1].replace(docs[4][1].split()[20], "edited", 1), "en", "src")]
    item = line(16)
    docs += [(300, f"{text()}\n{item}\n{text()}", "en", "src"), (301, text() + "\nWrite to jo.doe@example.org today.", "en", "src")]
    spark.createDataFrame([(*d, len(d[1])) for d in docs], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(d[0], int(d[0] < 100), 0) for d in docs if d[0] < 120], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        now = stage(spark, now, str(tmp_path))
        if i < 4:
            assert now.columns == columns
            now.write.parquet(f"{tmp_path}/out{i}")
            now = spark.read.parquet(f"{tmp_path}/out{i}")
        kept[name] = {r.doc_id for r in now.select("doc_id").collect()}
    clean = {*range(60), 200, 201, 300, 301}
    assert kept["quality rules"] == clean
    assert kept["simhash near-dedup"] == clean - {200, 201}
    assert kept["benchmark decontamination"] == kept["personal data"] == clean - {200, 201, 300}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bbpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    texts = {r.doc_id: r for r in spark.read.parquet(f"{tmp_path}/out3").collect()}
    assert "<email>" in texts[301].text
    assert texts[301].n_chars == len(texts[301].text)
    run = {r.doc_id: r.ids for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert run == {i: library.encode_ordinary(r.text) for i, r in texts.items()}


def tables(spark, at, documents, labels=(), items=()):
    spark.createDataFrame(documents, "doc_id long, text string, lang string, source string, n_chars long, __id string, h string, part int, __fp long").repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame(list(items), "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at)


def test_stages_on_odd_rows(spark, tmp_path):
    """Nulls, empty and long texts, repeated rows, shared ids and clashing names go through every stage as it says."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9)))
    text = lambda n: " ".join(word() for _ in range(n)).capitalize() + "."
    a, b, c, d = text(40), text(50), text(60), text(60_000)
    rows = [(1, None), (2, ""), (3, " \n\t"), (None, None), (None, a), (None, a), (None, b), (7, a), (7, c), (7, c), (8, d), (9, "one two")]
    at = tables(spark, tmp_path, [(i, t, "en", None, None if t is None else len(t), "clash", "clash", 5, 6) for i, t in rows], items=[(None, None), (1, ""), (2, "never seen words here")])
    now = spark.read.parquet(f"{at}/documents.parquet")
    names = now.columns
    seen = []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        now = stage(spark, now, at)
        if i < 4:
            assert now.columns == names
            now.write.parquet(f"{tmp_path}/s{i}")
            now = spark.read.parquet(f"{tmp_path}/s{i}")
            assert all(r["__id"] == "clash" and r.part == 5 for r in now.collect())
        seen.append(sorted(str(r.doc_id) for r in now.select("doc_id").collect()))
    assert seen[0] == ["7", "7", "7", "8", "None", "None", "None"]
    assert seen[1:] == [["7", "7", "8", "None"]] * 4
    # the same rows by the stages themselves, before the base rules take any away
    every = spark.read.parquet(f"{at}/documents.parquet")
    assert corpus_pipeline.decontaminate(spark, every, at).count() == len(rows)
    masked = corpus_pipeline.mask_personal_data(spark, every, at)
    assert sorted((str(r.doc_id), str(r.text)) for r in masked.collect()) == sorted((str(i), str(t)) for i, t in rows)
    assert corpus_pipeline.tokenize(spark, every, at).where("n_tokens = 0").count() == 3
    # texts without words are copies of each other; of equal rows one stays
    assert corpus_pipeline.near_dedup(spark, every, at).count() == 6


def test_stages_on_empty_tables(spark, tmp_path):
    at = tables(spark, tmp_path, [])
    now = spark.read.parquet(f"{at}/documents.parquet")
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        now = stage(spark, now, at)
        if i < 4:
            now.write.parquet(f"{tmp_path}/s{i}")
            now = spark.read.parquet(f"{tmp_path}/s{i}")
    assert now.count() == 0
    assert corpus_pipeline.run(spark, at).count() == 0
