"""The chain's marginals against enumeration, and held-out accuracy on form alone."""

import zlib
from itertools import product

import numpy as np
import pytest

from roleweave.llm import crf


def test_marginals_match_enumeration():
    rng = np.random.default_rng(2)
    owner = np.array([0, 0, 0, 0, 1, 3, 3])
    bad, moves = rng.normal(size=7), rng.normal(size=(2, 2))
    marginal, expected, norm = crf.forward_backward(bad, owner, moves)
    total = np.zeros((2, 2))
    for k, text in enumerate((0, 1, 3)):
        rows = np.flatnonzero(owner == text)
        weights = {}
        for states in product((0, 1), repeat=len(rows)):
            score = sum(bad[r] * s for r, s in zip(rows, states)) + sum(moves[a, b] for a, b in zip(states, states[1:]))
            weights[states] = np.exp(score)
        z = sum(weights.values())
        assert abs(np.log(z) - norm[k]) < 1e-9
        for place, r in enumerate(rows):
            assert abs(sum(w for s, w in weights.items() if s[place]) / z - marginal[r]) < 1e-9
        for states, w in weights.items():
            for a, b in zip(states, states[1:]):
                total[a, b] += w / z
    assert np.allclose(total, expected)


def test_line_features_by_line():
    texts = [b"Good line here.\n\n | a | b |\nGood line here.", b"", b"\n\n", "ÉÉ é 12".encode(), b"one"]
    data = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.cumsum([0, *map(len, texts)])
    features, owner, sizes, number = crf.line_features(data, offsets)
    assert owner.tolist() == [0, 0, 0, 3, 4] and number.tolist() == [0, 1, 2, 0, 0]
    assert sizes.tolist() == [15, 10, 15, 10, 3]
    column = dict(zip(crf.FEATURES, features.T))
    assert column["copies_in_text"].tolist() == [0, 0, 1, 0, 0]
    assert column["ends_in_mark"].tolist() == [1, 0, 1, 0, 0]
    assert column["single_odd_words"][1] == pytest.approx(3 / 5)
    assert column["first"].tolist() == [1, 0, 0, 1, 1] and column["last"].tolist() == [0, 0, 1, 1, 1]


@pytest.fixture(scope="module")
def rows(prose):
    good = [(i, ". ".join(prose(i * 7 + k, 9).capitalize() for k in range(4)) + ".\n" + prose(i + 900, 12) + ".") for i in range(150)]
    bad = [(1000 + i, "\n".join(" | ".join(prose(i * 5 + k, 6).upper().split()) for k in range(3))) for i in range(150)]
    return good + bad


def test_held_out_accuracy(spark, documents, rows):
    odd = [(5000, None), (5001, ""), (5002, " \n\t"), (None, rows[0][1]), (0, rows[0][1]), (5003, "word " * 60_000), (5004, "\n".join(["line here."] * 2000))]
    labels = spark.createDataFrame([(i, int(i < 1000), 0) for i, _ in rows] + [(None, 1, 0), (3, None, 1), (99999, 0, 0), (1, 1, 0)], "doc_id long, quality int, toxic int")
    got = crf.document_quality(documents(rows + odd, extra=True), labels, crf.Settings(steps=80)).collect()
    assert len(got) == len(rows) + len(odd)
    assert all(r["held_out"] == (zlib.crc32(("" if r["doc_id"] is None else str(r["doc_id"])).encode()) % 3 == 1) for r in got)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    held = [r for r in got if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 2000]
    assert sum(r["predicted"] == int(r["doc_id"] < 1000) for r in held) / len(held) > 0.97
    assert {r["doc_id"]: r["score"] for r in got if r["doc_id"] in (5000, 5001, 5002)} == {5000: 0, 5001: 0, 5002: 0}
    assert len({r["score"] for r in got if r["doc_id"] in (0, None)}) == 1


def test_held_out_labels_change_nothing(spark, documents, rows):
    def scores(flip):
        labels = spark.createDataFrame(
            [(i, int(i < 1000) ^ int(flip and zlib.crc32(str(i).encode()) % 3 == 1)) for i, _ in rows], "doc_id long, quality int"
        )
        return sorted((r["doc_id"], r["score"]) for r in crf.document_quality(documents(rows), labels, crf.Settings(steps=20)).collect())

    assert scores(False) == scores(True)


def test_no_labels_and_no_rows(spark, documents, rows):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r["score"] for r in crf.document_quality(documents(rows[:5]), none).collect()} == {0.5}
    assert crf.document_quality(documents([]), none).collect() == []


def test_lines_are_labelled(spark, documents, rows):
    labels = spark.createDataFrame([(i, int(i < 1000)) for i, _ in rows], "doc_id long, quality int")
    model = crf.learn(documents(rows), labels, crf.Settings(steps=40))
    got = crf.line_quality(documents([(1, "A good line of words.\n\nAnother one."), (2, "")]), model).orderBy("line").collect()
    assert [(r["doc_id"], r["line"], r["n_bytes"]) for r in got] == [(1, 0, 21), (1, 1, 12)]
    assert all(0 <= r["good"] <= 1 for r in got)
