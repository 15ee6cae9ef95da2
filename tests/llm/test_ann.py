"""Neighbours found against all inner products."""

import math

import numpy as np

from roleweave.llm import ann
from roleweave.llm.storage import share_package

SCHEMA = "vec_id long, embedding array<float>, label int, rank int, block int"


def table(spark, rows):
    share_package(spark)
    return spark.createDataFrame([(i, v, 0, 1, 2) for i, v in rows], SCHEMA).repartition(3)


def brute(rows, k=20):
    fine = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            v = [float(np.float32(x)) for x in v]
            fine[i] = min(fine.get(i, v), v)
    out = {}
    for q in (i for i in fine if i % 20 == 0):
        scores = [(-float(np.dot(fine[q], v)), i) for i, v in fine.items() if i != q and len(v) == len(fine[q])]
        out[q] = [(i, -s) for s, i in sorted(scores)[:k]]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert len(out[r["query_id"]]) == r["rank"]
    return out


def test_recall_and_scores(spark):
    rng = np.random.default_rng(5)
    rows = [(i, (v * (1 + i % 3)).tolist()) for i, v in enumerate(rng.normal(size=(3000, 24)))]
    got, want = found(ann.search_table(table(spark, rows), ann.Settings(block=700, least_block=100, chunk=60))), brute(rows)
    assert got.keys() == want.keys() and all(len(v) == 20 for v in got.values())
    hits = [len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 20 for q in want]
    assert np.mean(hits) >= 0.9
    vectors = {i: np.array(v, np.float32).astype(float) for i, v in rows}
    assert all(abs(s - vectors[q] @ vectors[i]) < 1e-9 for q, f in got.items() for i, s in f)
    assert all(f == sorted(f, key=lambda x: (-x[1], x[0])) for f in got.values())


def test_odd_vectors_and_ties(spark):
    one, two = [1.0, 2.0, 2.0], [2.0, 1.0, 0.5]
    rows = [(0, one), (20, two), (20, one), *[(i, one) for i in range(1, 15)], *[(i, two) for i in range(30, 39)]]
    rows += [(40, None), (41, []), (42, [0.0, 0.0, 0.0]), (43, [1.0, None, 1.0]), (44, [float("nan"), 1.0, 1.0]), (45, [float("inf"), 1.0, 1.0]), (None, one)]
    rows += [(60, [1.0, 1.0]), (61, [3.0, 1.0]), (80, [0.0, 1.0, 0.0, 0.0])]
    got, want = found(ann.search_table(table(spark, rows))), brute(rows)
    assert {q: [i for i, _ in f] for q, f in got.items()} == {q: [i for i, _ in f] for q, f in want.items() if f}


def test_fewer_candidates_than_neighbours_and_none(spark):
    rows = [(i, [float(i + 1), 1.0]) for i in range(0, 60, 10)]
    got, want = found(ann.search_table(table(spark, rows), ann.Settings(block=2, least_block=1))), brute(rows)
    assert {q: [i for i, _ in f] for q, f in got.items()} == {q: [i for i, _ in f] for q, f in want.items()}
    assert ann.search_table(table(spark, rows).filter("false")).collect() == []
