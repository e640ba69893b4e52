"""Near-duplicates, substrings and suffixes against brute force."""

import hashlib
import re

import corpus_pipeline
import numpy as np
import pytest
import xxhash
from docweave.llm import components, simhash, substring, suffix
from docweave.plans.session import checkpoint

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_fingerprint(text, size=3):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(text)
    shingles = [" ".join(w[k : k + size]) for k in range(max(1, len(w) - size + 1))] if w else []
    votes = [sum(xxhash.xxh64_intdigest(s.encode(), 42) >> b & 1 for s in shingles) for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * votes[b] > len(shingles))


def brute_components(pairs, n):
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


def test_fingerprints(odd_rows):
    for _, text, *_ in odd_rows:
        assert simhash.fingerprint((text or "").encode()) == brute_fingerprint(text)


def test_near_duplicates(spark, odd, odd_rows):
    got = {(r.doc_id, r.fingerprint): r.component_id for r in simhash.near_duplicates(odd).collect()}
    fps = [brute_fingerprint(t) for _, t, *_ in odd_rows]
    roots = brute_components([(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3], len(fps))
    for i, (doc, *_) in enumerate(odd_rows):
        ids = [d for (d, *_), r in zip(odd_rows, roots, strict=True) if r == roots[i] and d is not None]
        assert got[doc, f"{fps[i]:016x}"] == (min(ids) if ids else None)
    assert simhash.near_duplicates(odd).count() == len(odd_rows)


def test_no_rows(empty):
    for found in (simhash.near_duplicates(empty), simhash.near_copies(empty), simhash.one_of_each(empty), substring.dedup(empty), suffix.dedup(empty)):
        assert found.count() == 0


def clustered(rng, n):
    """Fingerprints of which many lie close together, in chains too."""
    base = rng.integers(0, 1 << 63, n // 8, dtype=np.int64).view(np.uint64)
    out = [base]
    for _ in range(7):
        flips = np.zeros(len(base), np.uint64)
        for _ in range(int(rng.integers(1, 4))):
            flips ^= np.uint64(1) << rng.integers(0, 64, len(base)).astype(np.uint64)
        base = base ^ flips
        out.append(base)
    return np.unique(np.concatenate(out))


@pytest.mark.parametrize(("shard_size", "most_shards"), [(40, 4096), (40, 64), (40, 2), (5, 1), (100000, 64)])
def test_links_over_shards(spark, shard_size, most_shards):
    fps = clustered(np.random.default_rng(3), 3000)
    points = checkpoint(spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long"))
    edges = simhash.links(points, shard_size=shard_size, most_shards=most_shards)
    roots = {r.node: r.root for r in components.components(edges).collect()}
    signed = fps.view(np.int64).tolist()
    pairs = [(i, int(j)) for i in range(len(fps)) for j in np.flatnonzero(np.bitwise_count(fps[:i] ^ fps[i]) <= 3)]
    want = brute_components(pairs, len(fps))
    least = {}
    for i, r in enumerate(want):
        least[r] = min(least.get(r, signed[i]), signed[i])
    assert [roots.get(x, x) for x in signed] == [least[r] for r in want]


def test_copies_of_a_fingerprint_are_bounded():
    """Visits don't grow with the table once shards are dealt over cells."""
    rng = np.random.default_rng(1)
    fps = rng.integers(0, 1 << 63, 50_000, dtype=np.int64).view(np.uint64)
    top = simhash.Top(fps[:8192], 6)
    for bits in (0, 4, 16):
        cells, _, _ = simhash._cells(top, np.full(64, bits), fps, 3)
        assert len(cells) < (9 if bits == 0 else 36) * len(fps)
        assert len(np.unique(cells)) > (60 if bits == 0 else 1000)


def test_search_meets_all_links():
    fps = clustered(np.random.default_rng(8), 4000)
    labels = simhash.search(fps, np.zeros(0, np.uint64), 3)
    pairs = [(i, int(j)) for i in range(len(fps)) for j in np.flatnonzero(np.bitwise_count(fps[:i] ^ fps[i]) <= 3)]
    assert labels.tolist() == brute_components(pairs, len(fps))


def near_families(rng, n):
    """Fingerprints of 256 bits in families of which many lie within 75 bits, in chains too."""
    out = rng.integers(0, 1 << 64, (n // 12, 4), dtype=np.uint64)
    while len(out) < n:
        some = out[rng.integers(0, len(out), min(n - len(out), n // 4))].copy()
        for _ in range(int(rng.integers(2, 90))):
            some[np.arange(len(some)), rng.integers(0, 4, len(some))] ^= np.uint64(1) << rng.integers(0, 64, len(some)).astype(np.uint64)
        out = np.concatenate((out, some))
    return out


def bits_apart(fps):
    return np.bitwise_count(fps[:, None] ^ fps[None, :]).sum(axis=2)


def test_search_of_wide_fingerprints(monkeypatch):
    """A tree over 256 bits meets all links within 75, and prunes where points stand in families."""
    rng = np.random.default_rng(10)
    fps = near_families(rng, 900)
    none = np.zeros((0, 4), np.uint64)
    pairs = list(zip(*(x.tolist() for x in np.nonzero(bits_apart(fps) <= 75)), strict=True))
    assert simhash.search(fps, none, 75).tolist() == brute_components(pairs, len(fps))
    compared, differ = [], simhash._differ
    monkeypatch.setattr(simhash, "_differ", lambda a, b: compared.append(differ(a, b)) or compared[-1])
    tight = np.repeat(rng.integers(0, 1 << 64, (20, 4), dtype=np.uint64), 50, axis=0)
    tight[:, 0] ^= rng.integers(0, 1 << 16, len(tight), dtype=np.uint64)
    assert len(set(simhash.search(tight, none, 75).tolist())) == 20
    assert sum(x.size for x in compared) < len(tight) ** 2 / 4


def test_candidates_of_near_copies_come_of_trees(spark):
    """Points within 3 bits of the first word join wherever they stand, others within 75 bits in a cell."""
    rng = np.random.default_rng(11)
    bits = near_families(rng, 700)
    bits[600:, 0] = bits[:100, 0] ^ (np.uint64(1) << rng.integers(0, 64, 100).astype(np.uint64))
    pool = rng.integers(0, 1 << 64, (simhash.BANDS, 300), dtype=np.uint64)
    keys = np.stack([pool[k, rng.integers(0, 300, len(bits))] for k in range(simhash.BANDS)], axis=1)
    rows = [(i, int(bits[i, 0].view(np.int64)), bytearray(np.concatenate((bits[i], keys[i])).tobytes())) for i in range(len(bits))]
    points = checkpoint(spark.createDataFrame(rows, "fp long, word long, sketch binary"))
    roots = {r.node: r.root for r in components.components(simhash._candidates(points, 75)).collect()}
    near = np.bitwise_count(bits[:, None, 0] ^ bits[None, :, 0]) <= 3
    cells = (bits_apart(bits) <= 75) & (keys[:, None] == keys[None, :]).any(axis=2)
    first, both = (brute_components(list(zip(*(x.tolist() for x in np.nonzero(m)), strict=True)), len(bits)) for m in (near, near | cells))
    got = [roots.get(word, word) for _, word, _ in rows]
    assert [got.index(x) for x in got] == both
    assert len(set(both)) < len(set(first)) < len(bits)


def test_near_dedup_goes_through_the_distributed_trees(spark, monkeypatch):
    rng = np.random.default_rng(12)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 6))
    a, b = ([word() for _ in range(200)] for _ in range(2))
    docs = spark.createDataFrame([(1, " ".join(a)), (2, " ".join(edited(rng, a, 2, word))), (3, " ".join(b))], "doc_id long, text string")
    searched, links = [], simhash.links
    monkeypatch.setattr(simhash, "links", lambda fps, *more: searched.append(fps.count()) or links(fps, *more))
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()) == [1, 3]
    assert searched == [3]


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(5000, 5000), (7, 7)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got.get(i, 0) == 0 for i in range(301))
    assert all(got[1000 + i] == 1000 for i in range(1, 200))


def test_one_of_each(spark, odd):
    text = " ".join(f"w{i * 7919 % 1000}" for i in range(300))
    near = text.replace("w919", "changed")
    other = " ".join(f"v{i * 31 % 777}" for i in range(300))
    docs = spark.createDataFrame([(9, text, "a"), (4, near, "b"), (5, other, "c"), (4, near, "b"), (6, text, "d")], "doc_id long, text string, lang string")
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, r.lang) for r in kept.collect()) == [(4, "b"), (5, "c")]
    assert simhash.one_of_each(odd).columns == odd.columns


def brute_removed(rows, size):
    first = {}
    for doc, text in rows:
        w = (text or "").encode().split()
        for k in range(len(w) - size + 1):
            g, at = tuple(w[k : k + size]), (-1 if doc is None else doc, k)
            first[g] = min(first.get(g, at), at)
    out = {}
    for doc, text in rows:
        w = (text or "").encode().split()
        gone = [False] * len(w)
        for k in range(len(w) - size + 1):
            if first[tuple(w[k : k + size])] < (-1 if doc is None else doc, k):
                gone[k : k + size] = [True] * size
        kept = b" ".join(x for x, m in zip(w, gone, strict=True) if not m)
        out.setdefault(doc, []).append((len(w), sum(gone), hashlib.sha256(kept).hexdigest(), kept.decode()))
    return out


@pytest.mark.parametrize(("run", "size"), [(lambda d: substring.dedup(d, with_text=True), 20), (lambda d: suffix.dedup(d, with_text=True), 50)])
def test_repeats(odd, odd_rows, run, size):
    want = brute_removed([r[:2] for r in odd_rows], size)
    got = {}
    for r in run(odd).collect():
        got.setdefault(r.doc_id, []).append((r.n_words, r.n_removed, r.kept_sha256, r.kept))
        assert sum(s.end - s.start for s in r.spans) == r.n_removed
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


def test_packing():
    docs, starts = np.array([-(1 << 63), 2, 2, 9]), np.array([5, 0, 70000, 3])
    extra = np.array([1, 2, 3, 1 << 63], np.uint64)
    a, b, c = substring.unpack(substring.pack(docs, starts, extra))
    assert (a == docs).all() and (b == starts).all() and (c == extra).all()


def test_group_is_sparks(spark):
    ids = [0, 1, -5, 1 << 40, -(1 << 63)]
    rows = spark.createDataFrame([(i,) for i in ids], "i long").selectExpr("cast(pmod(xxhash64(i), 97) as int) g").collect()
    assert substring.group_of(np.array(ids), 97).tolist() == [r.g for r in rows]


def test_near_copies_of_eighty_percent(spark):
    rng = np.random.default_rng(12)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 6))
    texts, group = [], []
    passage = [word() for _ in range(60)]  # stands in many unrelated texts
    for g in range(120):
        w = [word() for _ in range(int(rng.integers(80, 400)))]
        if g % 3 == 0:
            w[20:20] = passage
        texts.append(w)
        group.append(g)
        for _ in range(g % 4):  # each edit breaks five shingles
            near = list(w)
            for k in rng.choice(len(w), max(1, len(w) // 50), replace=False):
                near[k] = word()
            texts.append(near)
            group.append(g)
    shingles = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in texts]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string")
    found = {r.doc_id: r.component_id for r in simhash.near_copies(docs).collect()}
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if group[i] == group[j] and len(shingles[i] & shingles[j]) >= 0.8 * len(shingles[i] | shingles[j])]
    assert len(pairs) > 80
    assert np.mean([found[i] == found[j] for i, j in pairs]) > 0.9
    assert all(group[i] == group[c] for i, c in found.items())  # unrelated texts stay apart, shared passage or not


def edited(rng, words, n, new):
    """The words with n of them replaced, two shingles or more apart."""
    out = list(words)
    for k in rng.choice(len(words) // 10, n, replace=False):
        out[10 * int(k) + 5] = new()
    return out


def likeness(a, b, size=5):
    a, b = ({tuple(w[k : k + size]) for k in range(len(w) - size + 1)} for w in (a, b))
    return len(a & b) / len(a | b)


@pytest.mark.parametrize("n", [200, 1500])
def test_near_copies_of_shared_passages(spark, n):
    """Texts of three passages out of twenty: the share of near copies found doesn't fall as the table grows."""
    rng = np.random.default_rng(5)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 6))
    passages = [[word() for _ in range(40)] for _ in range(20)]
    texts = [sum((passages[k] for k in rng.choice(20, 3, replace=False)), []) for _ in range(n)]
    pairs = []
    for i in range(0, 60):
        texts.append(edited(rng, texts[i], 2, word))
        pairs.append((i, len(texts) - 1))
    assert all(likeness(texts[i], texts[j]) >= 0.8 for i, j in pairs)
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string")
    found = {r.doc_id: r.component_id for r in simhash.near_copies(docs).collect()}
    assert all(found[i] == found[j] for i, j in pairs)


def test_near_copies_are_verified(spark):
    """Texts at 0.66 to 0.79 that share a passage stay apart, those at 0.8 and more do not."""
    rng = np.random.default_rng(6)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 6))
    texts, want = [], []
    for g in range(40):
        base = [word() for _ in range(200)]
        other = base[: 165 + g % 30] + [word() for _ in range(35 - g % 30)]
        texts += [base, other]
        want.append(likeness(base, other) >= 0.8)
    assert 10 < sum(want) < 30
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string")
    found = {r.doc_id: r.component_id for r in simhash.near_copies(docs).collect()}
    assert [found[2 * g] == found[2 * g + 1] for g in range(40)] == want


def test_near_copies_in_blocks(spark):
    """Components above a task's texts give the links of all pairs."""
    rng = np.random.default_rng(7)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 6))
    base = [word() for _ in range(120)]
    texts = [base]
    for _ in range(60):
        texts.append(edited(rng, texts[int(rng.integers(0, len(texts)))], int(rng.integers(1, 4)), word))
    docs = checkpoint(spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string"))
    rows, points, _ = simhash._copies(docs, 75, 5)
    fps = {r.least.id: r.fp for r in points.collect()}
    wide = checkpoint(spark.createDataFrame([(x, min(fps.values())) for x in fps.values()], "node long, root long"))
    edges = checkpoint(simhash._verified(docs, points, wide, 256, 5, texts=7))
    found = {r.doc_id: r.component_id.id for r in simhash._named(rows, points, edges).collect()}
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if likeness(texts[i], texts[j]) >= 0.8]
    roots = brute_components(pairs, len(texts))
    assert len(set(roots)) > 1
    assert [found[i] for i in range(len(texts))] == roots


def test_one_of_each_without_ids(spark):
    """Texts without an id, or of one id, are as many as they are; copies of them go."""
    rng = np.random.default_rng(9)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 6))
    a, b, c, d, e = (" ".join(word() for _ in range(100)) for _ in range(5))
    rows = [(None, a), (None, b), (None, b), (1, b), (2, c), (2, d), (3, d), (None, c), (None, e), (None, e), (4, None), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = sorted(((r.doc_id, r.text) for r in simhash.one_of_each(docs).collect()), key=str)
    assert kept == sorted([(None, a), (1, b), (2, c), (2, d), (None, e), (4, None)], key=str)


@pytest.mark.parametrize(("run", "size"), [(substring.dedup, 20), (suffix.dedup, 50)])
def test_repeats_without_ids(spark, run, size):
    """A text without an id loses its own repeats, and none that another text without an id has."""
    word = lambda p, n: " ".join(f"{p}{i}" for i in range(n))
    texts = {
        "twice": f"{word('a', 80)} {word('a', 80)}", "whole": word("b", 200),
        "first": f"{word('p', 60)} {word('c', 40)}", "second": f"{word('p', 60)} {word('d', 40)}",
    }
    rows = [(None, t) for t in texts.values()] + [(3, f"{word('e', 30)} {word('b', 60)}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = {r.kept.split()[-1]: r for r in run(docs, with_text=True).collect()}
    assert found["a79"].n_removed == 80
    assert found["b199"].n_removed == 0
    assert sorted((found["c39"].n_removed, found["d39"].n_removed)) == [0, 60]
    assert found["e29"].n_removed == 60
