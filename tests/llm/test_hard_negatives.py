"""Hard negatives against all inner products, and the bounds of the trees."""

import math

import duckdb
import numpy as np
import pytest

from roleweave.llm import hard_negatives as hn
from roleweave.llm.storage import share_package

SCHEMA = "vec_id long, embedding array<float>, label int, cell int, width int, x string, rank int"
SMALL = hn.Settings(cells=3, least_block=40, block=120, chunk=3, batch=2, leaf=4, fanout=3)


def table(spark, rows):
    share_package(spark)
    return spark.createDataFrame([(i, v, label, 9, 9, "clash", 1) for i, v, label in rows], SCHEMA).repartition(3)


def brute(rows):
    fine = {}
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        row = ((label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * float(np.float32(x))) for x in v])
        fine[i] = min(fine.get(i, row), row)
    out = []
    for a, (label, x) in fine.items():
        if a % 50:
            continue
        scores = sorted((-sum(p * q for p, q in zip(x, y)), i, other) for i, (other, y) in fine.items() if i != a and len(y) == len(x))
        for p, positive, _ in [s for s in scores if s[2] == label][:5]:
            fits = [(n, i) for n, i, other in scores if other != label and -50 * p <= -100 * n <= -95 * p][:3]
            out += [(a, positive, r, i, -p, -n) for r, (n, i) in enumerate(fits, 1)]
    return sorted(out)


def found(df):
    return sorted(tuple(r) for r in df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def clustered(seed, n, width, clusters):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, width))
    return [(i, (centres[i % clusters] + 0.2 * rng.normal(size=width)).tolist(), int(rng.integers(10))) for i in range(n)]


@pytest.mark.parametrize("settings", [SMALL, hn.Settings()])
def test_whole_result(spark, settings):
    rows = clustered(3, 700, 8, 12) + [(700 + i, [0.5] * 8, i % 4) for i in range(200)]  # a large group of equal vectors
    want = brute(rows)
    assert want and found(hn.mine(table(spark, rows), settings)) == want


def test_odd_rows_and_ties(spark):
    rows = [(i, [1.0, 2.0, float(i % 3)], i % 3) for i in range(1, 120)] + [(150, [-1.0, 0.0, 0.0], 2), (200, [0.0, 0.0, 0.0], 1)]
    rows += [(0, [1.0, 2.0, 0.5], 5), (0, [1.0, 1.0, 0.5], 5), (50, [3.0, 1.0, 1.0], 0), (None, [1.0, 1.0, 1.0], 1)]
    rows += [(250, None, 1), (300, [1.0, None, 2.0], 1), (350, [float("nan"), 1.0, 1.0], 1), (400, [1.0, 1.0, float("-inf")], 1), (450, [1.0, 1.0, 1.0], None)]
    rows += [(500, [1.0, 1.0], 3), (501, [1.0, 1.0], 3), (502, [0.8, 0.8], 4), (550, [], 3), (551, [], 3), (552, [], 4), (600, [4.0], 1)]
    assert found(hn.mine(table(spark, rows), SMALL)) == brute(rows)
    assert hn.mine(table(spark, rows).filter("false")).collect() == []


def test_too_large_components_are_refused(spark):
    with pytest.raises(ArithmeticError):
        hn.mine(table(spark, [(0, [1e20, 1.0], 1), (1, [1.0, 1.0], 1)]))


def test_sql_statement(spark, tmp_path):
    rows = clustered(5, 300, 6, 5)
    df = table(spark, rows)
    con = duckdb.connect()
    df.select("vec_id", "embedding", "label").toPandas().to_parquet(tmp_path / "embeddings.parquet")
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet'")
    want = con.execute(hn.ORACLE).fetchdf()[["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]]
    assert found(hn.mine(df)) == sorted(map(tuple, want.itertuples(index=False)))


def test_tree_covers_its_points_and_skips_work():
    rows = clustered(9, 3000, 16, 60)
    x = np.floor(256 * np.array([v for _, v, _ in rows]))
    longest = float(np.sqrt((x * x).sum(1)).max())
    tree = hn.CoverTree(np.arange(len(x)), np.array([r[2] for r in rows]), x, longest, 16, 16)
    lifted = hn._lift(tree.vectors, longest)
    for start, end, centre, covering in zip(tree.start, tree.end, tree.centre, tree.covering):
        chord = np.sqrt(((lifted[start:end] - hn._lift(centre[None], longest)) ** 2).sum(1))
        assert (hn._angle(chord, longest) <= covering + 1e-7).all()
    leaves = tree.children[:, 0] == tree.children[:, 1]
    assert (tree.end - tree.start)[leaves].sum() == len(x)
    anchors = np.arange(0, 3000, 50)
    low, high = np.full((60, 1), -np.inf), np.full((60, 1), np.inf)
    search = hn.Search(tree.ids[anchors], tree.labels[anchors], tree.vectors[anchors], low, high, 3, False)
    search.visit(tree)
    assert search.verified < 0.3 * 60 * 3000
    scores = tree.vectors[anchors] @ tree.vectors.T
    scores[tree.labels[anchors][:, None] == tree.labels[None, :]] = -np.inf
    best = np.sort(scores, 1)[:, -3:]
    assert np.allclose(np.sort(search.found[0][2].reshape(60, 3), 1), best)
