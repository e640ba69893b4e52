import random

import pytest

SCHEMA = "doc_id long, text string, fp string, part int, kind string, packed string, n_chars long"


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and long texts, ties, repeated rows, clashing column names."""
    rng = random.Random(4)
    words = ["the", "License", "of", "année", "a1", "MIT", "x.", "B-c", "12", "über"]
    long_ = " ".join(rng.choice(words) for _ in range(4000))
    passage = " ".join(f"p{i}" for i in range(70))
    texts = [
        None, "", " \n\t ", "one", "one two", "Licensed under the MIT License.", passage, f"start {passage} end", f"{passage} {passage}",
        long_, long_, long_ + " tail", "a " * 500, "mail me: jo.doe@example.org or +1 (389) 555-5010 now", "🙂 é ß 日本 " * 30, "x" * 5000,
        "10.0.0.1 and 4111 1111 1111 1111", f"before\n{passage}\nafter", "Licensed under the MIT License.\nAll rights reserved.",
    ]
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [(3, "one"), (3, "one"), (None, "no id here at all"), (None, None), (7, "another text of the same id with some words more")]
    return [(i, t, "clash", 5, "clash", "clash", None if t is None else len(t)) for i, t in rows]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
