"""Every stage on its own input, against plain Python."""

import pytest

import corpus_pipeline
from roleweave.llm import crf, decontaminate, minhash, queries
from roleweave.llm.storage import stage
from tests.llm.test_decontaminate import brute as hit_words
from tests.llm.test_minhash import classes

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    out = [docs]
    for name, function in corpus_pipeline.STAGES:
        docs = stage(function(spark, docs, FOLDER), name)
        out.append(docs)
    return out


def rows(df):
    return sorted((r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect())


def test_stages_and_columns(steps):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "mixing", "sharding"]
    assert all(s.columns == corpus_pipeline.DOCUMENT_COLUMNS for s in steps[:-1])


def test_quality_stage(spark, steps):
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    scored = crf.document_quality(steps[0], labels).filter("predicted = 1").select("doc_id").collect()
    assert [i for i, _ in rows(steps[1])] == sorted(r["doc_id"] for r in scored)
    quality = {r["doc_id"]: r["quality"] for r in labels.collect()}
    kept = {i for i, _ in rows(steps[1])}
    judged = [(i in kept, q) for i, q in quality.items() if i in {d for d, _ in rows(steps[0])}]
    assert sum(k == bool(q) for k, q in judged) / len(judged) > 0.9


def test_near_duplicate_stage(steps):
    before = rows(steps[1])
    want = sorted(i for i, (n, root) in classes(before).items() if i == root)
    assert [i for i, _ in rows(steps[2])] == want


def test_decontamination_stage(spark, steps):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    before = rows(steps[2])
    assert rows(steps[3]) == [(i, t) for i, t in before if not hit_words(t, items)[4]]
    assert len(rows(steps[3])) < len(before)


def test_mixing_and_sharding_stages(steps):
    assert {i for i, _ in rows(steps[4])} == {i for i, _ in rows(steps[3])}
    shards = steps[5].groupBy("shard").count().collect()
    assert sum(r["count"] for r in shards) == steps[4].count()
    assert max(r["count"] for r in shards) - min(r["count"] for r in shards) <= 1


def test_every_operator_is_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert "pipeline" in names and all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 11))
    assert set(queries.ORACLES) <= set(names)
    assert decontaminate.WINDOW == 13 and minhash.Settings().similar == (85, 100)


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").filter("false")
    for _, function in corpus_pipeline.STAGES:
        docs = function(spark, docs, FOLDER)
        assert docs.count() == 0
