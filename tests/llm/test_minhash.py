"""Near duplicates against brute force over full shingle sets."""

import random
from itertools import combinations

import numpy as np
import pytest

from roleweave.llm import minhash, vectors
from roleweave.llm.components import components


def shingle_set(text, size=5):
    words = (text or "").encode().lower().split()
    if len(words) < size:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}


def classes(rows):
    sets = [(i, shingle_set(t)) for i, t in rows]
    parent = {i: i for i, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, x), (b, y) in combinations(sets, 2):
        if x and y and 100 * len(x & y) >= 85 * len(x | y):
            parent[max(root(a), root(b))] = min(root(a), root(b))
    return {i: (len(s), root(i)) for i, s in sets}


def edited(text, seed, edits):
    rng = random.Random(seed)
    words = text.split()
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"x{rng.random()}"
    return " ".join(words)


def result(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in df.collect()}


@pytest.fixture(scope="module")
def rows(prose):
    base = prose(1, 150)
    out = [(i, edited(base, i, i % 6)) for i in range(60)]  # copies from equal to about 0.6 alike
    out += [(100 + i, base) for i in range(40)]  # exact copies
    out += [(200 + i, prose(i + 10, 80)) for i in range(40)]
    out += [(300, ""), (301, None), (302, " \t\n"), (303, "one two"), (304, "ONE  two"), (305, "one two three")]
    out += [(306, base.upper()), (307, "a b c d e"), (308, "A\vB c\td e"), (309, prose(1, 5000))]
    return out


def test_classes_match_brute_force(documents, rows):
    got = minhash.near_duplicates(documents(rows, extra=True))
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert result(got) == classes(rows)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got.collect())


def test_small_blocks_give_the_same(documents, rows):
    got = minhash.near_duplicates(documents(rows), minhash.Settings(block=7))
    assert result(got) == classes(rows)


def test_null_and_repeated_ids(documents, prose):
    a, b = prose(1, 60), prose(2, 60)
    rows = [(None, a), (1, a), (1, a), (2, b), (1, b), (5, b), (7, prose(3, 20))]
    got = minhash.near_duplicates(documents(rows)).collect()
    assert {(r["doc_id"], r["component_id"], r["kept"]) for r in got} == {
        (None, None, True), (1, 1, True), (2, 1, False), (5, 1, False), (7, 7, True),
    }
    left = minhash.remove_near_duplicates(documents(rows)).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"] == a) for r in left) == [
        (False, 1, False), (False, 1, True), (False, 7, False), (True, 0, True),
    ]


def test_empty_table(documents):
    assert minhash.near_duplicates(documents([])).collect() == []
    assert minhash.remove_near_duplicates(documents([])).collect() == []


def test_every_pair_within_the_radius_shares_an_index():
    s = minhash.Settings()
    rng = np.random.default_rng(1)
    one = rng.integers(0, 9, (200, s.length)).astype(np.uint16)
    two = one.copy()
    for r in range(200):
        two[r, rng.choice(s.length, s.radius, replace=False)] += 100
    shared = np.zeros(200, bool)
    for i, mask in enumerate(s.masks()):
        shared |= minhash._index_key(one, mask, i) == minhash._index_key(two, mask, i)
    assert shared.all()


def test_words_and_shingles_of_a_buffer():
    texts = [b"", b"A b\x0bC  d", b"a b c d e f g", b" ", "é É x".encode(), b"a b c d e f g h i"]
    data = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.cumsum([0, *map(len, texts)])
    hashes, at = vectors.word_hashes(data, offsets)
    assert np.diff(at).tolist() == [len(t.split()) for t in texts]
    words = [w.lower() for t in texts for w in t.split()]
    assert len(set(words)) == len(set(hashes.tolist())) == len(set(zip(words, hashes.tolist())))
    values, ends = vectors.distinct_shingles(data, offsets, 5)
    assert np.diff(ends).tolist() == [len(shingle_set(t.decode())) for t in texts]
    assert set(values[ends[2] : ends[3]]) <= set(values[ends[5] : ends[6]])


def test_components_of_chains_and_hubs(spark):
    chain = [(i, i + 1) for i in range(0, 60)]
    hub = [(1000, 1001 + i) for i in range(300)]
    links = spark.createDataFrame([*chain, *hub, (5, 5), (None, 3)], "a long, b long")
    got = {r["node"]: r["component"] for r in components(links).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{1000 + i: 1000 for i in range(301)}}
    assert components(links.filter("false")).collect() == []
