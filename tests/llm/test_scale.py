"""Layouts, hashes and texts of sizes that small tables don't reach by themselves."""

import tracemalloc

import numpy as np
import pytest
from docweave.llm import arrowtext, substring, suffix
from test_dedup import brute_removed


@pytest.mark.parametrize(("run", "size"), [(substring.dedup, 20), (suffix.dedup, 50)])
@pytest.mark.parametrize("at", [substring.Layout(3, 4, 2), substring.Layout(1, 7, 8), substring.Layout(5, 1, 3)])
def test_several_buckets_in_a_partition(odd, odd_rows, run, size, at):
    want = brute_removed([r[:2] for r in odd_rows], size)
    got = {}
    for r in run(odd, with_text=True, at=at).collect():
        got.setdefault(r.doc_id, []).append((r.n_words, r.n_removed, r.kept_sha256, r.kept))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


def test_layout_follows_the_input(spark, tmp_path):
    docs = spark.range(1000).selectExpr("id AS doc_id", "repeat(cast(id AS string), 300) AS text")
    docs.write.parquet(f"file://{tmp_path}/d")
    docs = substring.identified(spark.read.parquet(f"file://{tmp_path}/d"))
    one = substring.layout(docs)
    many = substring.layout(docs, most_parts=4, bucket_bytes=100)
    assert (one.parts, one.within, one.extra) == (4, 1, 0)
    assert many.parts == 4 and many.within > 5


def test_second_hash_tells_windows_apart():
    docs, starts = np.array([[1, 0], [1, 0], [2, 0], [3, 0]]), np.array([0, 5, 0, 0])
    keys, second = np.array([7, 7, 7, 7], np.uint64), np.array([1, 2, 1, 3], np.uint64)
    first, later = substring.repeats_of(docs, starts, keys, second)
    assert (first.tolist(), later.tolist()) == ([0, 1, 3], [2])
    back = substring.unpack_windows(substring.pack(docs, starts, keys, second << np.uint64(0), 2))
    assert back[3].tolist() == [1, 2, 1, 3]


def test_hashes_do_not_depend_on_blocks(monkeypatch):
    rng = np.random.default_rng(3)
    data = rng.choice(np.frombuffer(b"abc  \n", np.uint8), 20000)
    data[3000:9000] = 97
    words = arrowtext.split(arrowtext.Block(0, 1, data, np.array([0, len(data)])))
    whole = arrowtext.word_hashes(data, words)
    windows = arrowtext.window_hashes(whole, 20)
    monkeypatch.setattr(arrowtext, "BLOCK", 512)
    monkeypatch.setattr(arrowtext, "STRIDE", 64)
    assert (arrowtext.word_hashes(data, words) == whole).all()
    assert (arrowtext.window_hashes(whole, 20) == windows).all()


def test_long_text_is_cut_as_a_short_one(monkeypatch):
    rng = np.random.default_rng(4)
    body = b"  " + b" ".join(rng.choice([b"a", b"bb", "é".encode()], 3000).tolist()) + b"\n\n"
    for starts in (np.array([], np.int64), np.array([0, 1, 700]), np.array([2980]), np.arange(2981)):
        short = substring.without(body, starts, 20)
        with monkeypatch.context() as m:
            m.setattr(substring, "BLOCK", 10)
            long_ = substring.without(body, starts, 20)
        assert short[0] == long_[0] and (short[1] == long_[1]).all() and short[2] == long_[2]


def test_memory_of_a_long_text():
    """Under ten bytes for each byte of text, beyond the text itself."""
    n = 8_000_000
    data = np.tile(np.frombuffer(b"lorem ipsum dolor ", np.uint8), n // 18)
    block = arrowtext.Block(0, 1, data, np.array([0, len(data)]))
    arrowtext.window_hashes(arrowtext.word_hashes(data[:100], arrowtext.split(arrowtext.Block(0, 1, data[:100], np.array([0, 100])))), 20)
    tracemalloc.start()
    words = arrowtext.split(block)
    hashes = arrowtext.word_hashes(block.data, words)
    arrowtext.window_hashes(hashes, 20)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 10 * len(data) + 40_000_000
