"""Whitening against exact fractions and double-precision eigenvectors; refinement of clustered eigenvalues."""

import math
from fractions import Fraction

import numpy as np
import pytest

from roleweave.llm import whitening
from roleweave.llm.storage import share_package

SCHEMA = "vec_id long, embedding array<float>, label int, n long, component int, x string, width int"


def table(spark, rows, parts=3):
    share_package(spark)
    return spark.createDataFrame([(i, v, 0, 1, 2, "clash", 3) for i, v in rows], SCHEMA).repartition(parts)


def whole(v):
    return [math.floor(1024 * float(np.float32(c))) + 100_000 for c in v]


def random_rows(seed, n, width, scale=1.0):
    rng = np.random.default_rng(seed)
    mix = rng.normal(size=(width, width))
    return [(i, (scale * (rng.normal(size=width) @ mix + 3)).tolist()) for i in range(n)]


def check(rows, got, components=8):
    x = [whole(v) for _, v in rows]
    n, width = len(x), len(x[0])
    sums = [sum(col) for col in zip(*x)]
    deviation = sorted((i, sum((n * a - s) ** 2 for a, s in zip(r, sums))) for (i, _), r in zip(rows, x))
    assert sorted({(r["vec_id"], r["deviation"]) for r in got}) == sorted(set(deviation))
    d = np.array([[float(Fraction(n * a - s, n)) for a, s in zip(r, sums)] for r in x])
    v = d.T @ d / n
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = min(components, width)
    assert len(got) == n * k and {r["n"] for r in got} == {n}
    out = np.full((n, k), np.nan)
    place = {i: p for p, (i, _) in enumerate(rows)}
    for r in got:
        out[place[r["vec_id"]], r["component"] - 1] = r["whitened"]
        assert abs(r["explained"] - values[r["component"] - 1] / np.trace(v)) < 1e-9
    want = d @ vectors[:, :k] / np.sqrt(values[:k])
    sign = np.sign((out * want).sum(0))
    assert np.abs(out - want * sign).max() < 1e-6
    error = np.abs(out.T @ out / n - np.eye(k)).max()
    assert all(abs(r["identity_error"] - error) < 1e-9 and r["identity_error"] < 1e-10 for r in got)


@pytest.mark.parametrize("width", [3, 24])
def test_against_double_precision(spark, width):
    rows = random_rows(7, 500, width)
    check(rows, whitening.whitened(table(spark, rows)).collect())


def test_partitions_do_not_matter(spark):
    rows = random_rows(8, 300, 12)
    results = [sorted(tuple(r) for r in whitening.whitened(table(spark, rows, parts)).collect()) for parts in (1, 7)]
    assert all(a[:4] == b[:4] and np.allclose(a[4:], b[4:], rtol=1e-9, atol=1e-12) for a, b in zip(*results))


def test_odd_rows(spark):
    good = random_rows(9, 60, 4) + [(500, [1.0, 2.0, 3.0, 4.0])]
    odd = [(1000, None), (1001, []), (1002, [1.0, None, 2.0, 1.0]), (1003, [float("nan")] * 4), (1004, [float("inf"), 0.0, 0.0, 0.0])]
    check(good, whitening.whitened(table(spark, good + odd)).collect())
    repeated = whitening.whitened(table(spark, good + good + [(None, good[0][1])])).collect()
    assert len(repeated) == 4 * (2 * len(good) + 1) and sum(r["vec_id"] is None for r in repeated) == 4
    widths = whitening.whitened(table(spark, good + [(i + 2000, v[:2]) for i, v in good])).collect()
    check(good, [r for r in widths if r["vec_id"] < 2000])
    assert whitening.whitened(table(spark, good).filter("false")).collect() == []


def test_no_variance(spark):
    one = whitening.whitened(table(spark, [(1, [0.5, 0.25])])).collect()
    assert [(r["component"], r["whitened"], r["explained"], r["deviation"], r["identity_error"]) for r in sorted(one)] == [(1, None, 0.0, 0, 0.0), (2, None, 0.0, 0, 0.0)]
    line = whitening.whitened(table(spark, [(i, [i / 4.0, i / 2.0, 1.0]) for i in range(40)])).collect()
    by = {c: [r for r in line if r["component"] == c] for c in (1, 2, 3)}
    assert all(r["whitened"] is not None and r["explained"] == pytest.approx(1) for r in by[1])
    assert all(r["whitened"] is None and r["explained"] == 0 for c in (2, 3) for r in by[c])
    assert {r["identity_error"] for r in line} == {by[1][0]["identity_error"]} and by[1][0]["identity_error"] < 1e-9


def test_large_entries_stay_exact(spark):
    rows = [(i, [1e15 * (i % 3), float(i)]) for i in range(30)]
    got = whitening.whitened(table(spark, rows)).collect()
    x = [whole(v) for _, v in rows]
    sums = [sum(col) for col in zip(*x)]
    want = {i: sum((30 * a - s) ** 2 for a, s in zip(r, sums)) for (i, _), r in zip(rows, x)}
    assert max(want.values()) >= 1 << 63
    assert all(r["deviation"] == (want[r["vec_id"]] if want[r["vec_id"]] < 1 << 63 else None) for r in got)
    assert all(r["identity_error"] < 1e-4 for r in got)


@pytest.mark.parametrize("spread", [0.0, 1e-12, 1e-7, 1e-3])
def test_clusters_are_refined_beyond_double_precision(spread):
    rng = np.random.default_rng(2)
    q, _ = np.linalg.qr(rng.normal(size=(20, 20)))
    values = np.array([3.0] + [1.0 + spread * i for i in range(6)] + [0.5] * 4 + [0.1 * (1 + i) / 9 for i in range(9)])
    a = (q * values) @ q.T
    a = ((a + a.T) / 2).astype(np.longdouble)
    _, first = np.linalg.eigh(a.astype(np.float32))
    found, x = whitening.refine(a, first[:, ::-1].astype(np.longdouble))
    assert np.abs(found - np.sort(np.linalg.eigvalsh(a.astype(float)))[::-1]).max() < 1e-14
    assert float(np.abs(x.T @ x - np.eye(20)).max()) < 1e-17 * 50
    assert float(np.abs(a @ x - x * found).max()) < 1e-16
    assert np.abs(a.astype(np.float32) @ first - first * np.linalg.eigvalsh(a.astype(np.float32))).max() > 1e-8  # where it started
