"""The impact index against all pairs: equal results, little read, no table of all pairs."""

import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from roleweave.operators import tfidf as V
from roleweave.operators import topk as K


def _tables(spark, docs, queries):
    weights = spark.createDataFrame([(d, f, w) for d, fs in docs.items() for f, w in fs.items()], "doc long, feature string, weight double")
    asks = spark.createDataFrame([(q, f, w) for q, fs in queries.items() for f, w in fs.items()], "query long, feature string, weight double")
    return weights.repartition(3), asks


def _brute(docs, queries, k, digits=None):
    out = {}
    for q, asked in queries.items():
        scores = {d: sum(w * asked[f] for f, w in fs.items() if f in asked) for d, fs in docs.items() if asked.keys() & fs.keys()}
        scores = {d: s if digits is None else round(s, digits) for d, s in scores.items()}
        out[q] = sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:k]
    return out


def _zipf(seed, n, features, size):
    rng = random.Random(seed)
    return {i: {f"f{min(int(rng.paretovariate(0.6)), features)}": rng.random() ** 3 + 1e-6 for _ in range(size)} for i in range(n)}


@pytest.mark.parametrize(("k", "digits"), [(1, None), (7, None), (7, 2), (500, None)])
def test_equals_all_pairs(spark, monkeypatch, k, digits):
    monkeypatch.setattr(K, "BLOCK_DOCUMENTS", 40)
    docs, queries = _zipf(1, 300, 60, 8), _zipf(2, 25, 60, 6)
    queries[100] = {"none": 1.0}
    docs.update({1000 + i: dict(docs[0]) for i in range(60)})  # equal documents: ties
    weights, asks = _tables(spark, docs, queries)
    got = defaultdict(list)
    for r in K.best_documents(K.build_index(weights, len(docs)), asks, k, digits=digits).orderBy("query", "rank").collect():
        got[r["query"]].append((r["doc"], r["score"]))
    want = _brute(docs, queries, k, digits)
    assert got.keys() == {q for q, rows in want.items() if rows}
    for q, rows in got.items():
        assert [s for _, s in rows] == pytest.approx([s for _, s in want[q]], abs=1e-9)
        assert [d for d, _ in rows] == [d for d, _ in want[q]]


def test_light_entries_are_not_read(spark):
    rng = random.Random(3)
    docs = {i: {"common": rng.random() * 0.1 + 1e-6, f"rare{i % 50}": 0.9} for i in range(2000)}
    queries = {q: {"common": 0.2, f"rare{q}": 0.9} for q in range(50)}
    weights, asks = _tables(spark, docs, queries)
    index = K.build_index(weights, len(docs))
    seeds = K.seeds(index, asks, 3, 6)
    scored = K.dot_scores(index, asks)(seeds)
    low = scored.groupBy("query").agg(F.sort_array(F.collect_list("score"), asc=False)[2].alias("threshold"))
    found = K.candidates(index, asks, low, 1e-9)
    assert found.count() <= 50 * 40  # of 50 * 2000 pairs that share a feature


def test_pairs_are_not_shuffled_for_few_queries(spark):
    docs, queries = _zipf(1, 30, 20, 5), _zipf(2, 5, 20, 4)
    weights, asks = _tables(spark, docs, queries)
    none = spark.createDataFrame([], "query long, threshold double")
    found = K.candidates(K.build_index(weights, len(docs)), asks, none, 1e-9)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(doc#" in plan and not re.search(r"hashpartitioning\(query#\d+L?, doc#", plan)


def test_no_documents_and_no_queries(spark):
    weights, asks = _tables(spark, {1: {"a": 1.0}}, {1: {"a": 1.0}})
    index = K.build_index(weights, 1)
    assert K.best_documents(index, asks.where("false"), 3).collect() == []
    assert K.best_documents(K.build_index(weights.where("false"), 0), asks, 3).collect() == []


@pytest.mark.parametrize("frequent", [5, 20_000])
def test_best_pairs_equal_the_pair_table(spark, monkeypatch, frequent):
    monkeypatch.setattr(V, "HOT_TERMS", frequent)
    rng = random.Random(5)
    words = [f"w{i}" for i in range(200)]
    text = lambda n: " ".join(words[min(int(rng.paretovariate(0.5)), 199)] for _ in range(n))
    docs = spark.createDataFrame([(i, text(rng.randint(0, 30))) for i in range(120)], "doc_id long, text string")
    asks = spark.createDataFrame([(i, text(12)) for i in range(9)], "q long, text string")
    docs, asks = (t.withColumn("terms", V.term_counts(F.col("text"), [])).drop("text") for t in (docs, asks))
    pairs = V.cosine_pairs(docs, asks, "doc_id", "q").withColumn("similarity", F.round("similarity", 6)).collect()
    want = defaultdict(list)
    for r in sorted(pairs, key=lambda r: (r["q"], -r["similarity"], r["doc_id"])):
        want[r["q"]].append((r["doc_id"], r["similarity"]))
    got = defaultdict(list)
    for r in V.best_pairs(docs, asks, "doc_id", "q", 5, digits=6).orderBy("q", "rank").collect():
        got[r["q"]].append((r["doc_id"], r["similarity"]))
    assert got == {q: rows[:5] for q, rows in want.items()}
