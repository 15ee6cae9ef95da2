"""Counts and base scores against a dictionary; the model's distribution sums to one and beats the base."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from roleweave.llm import lm

SMALL = lm.Settings(vocabulary=24, dimensions=6, noise=16, batch=256, head=40, longest=12, rounds=2)


def out(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 7 == 2


def tokens(text):
    return (text or "").encode().lower().split() + [b""]


@pytest.fixture(scope="module")
def rows(prose):
    import random

    rng = random.Random(3)
    made = [(i, " ".join(rng.choice([["le", "la", "et"], ["the", "and", "of"]][i % 2]) for _ in range(40)) + f" tail{i % 9}") for i in range(80)]
    return made + [(100, None), (101, ""), (102, " \t\n"), (None, "The AND of"), (103, prose(1, 3000)), (104, "x" * 50_000), (105, "É é É"), (80, "le la"), (80, "le la")]


def test_scores(documents, rows):
    got = lm.language_scores(documents(rows, extra=True), SMALL).collect()
    counts = Counter(t for i, x in rows if not out(i) for t in tokens(x))
    n, v = sum(counts.values()), len(counts)
    base = lambda x: round(sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in tokens(x)), 6)
    want = sorted((str(i), out(i), len(tokens(x)), sum(counts[t] > 0 for t in tokens(x)), n, base(x)) for i, x in rows)
    assert sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)
    made = [r for r in got if r["doc_id"] is not None and r["doc_id"] < 80]
    assert sum(r["score"] for r in made) > sum(r["base_score"] for r in made)  # the languages are told apart


def test_probabilities_sum_to_one(documents, rows):
    learning = documents([r for r in rows if not out(r[0])])
    counts = lm.count_tokens(learning).cache()
    lex = lm.lexicon(counts, SMALL)
    weights = lm.train(learning, lex, SMALL)
    k = SMALL.classes
    scorer = lm.Scorer(weights, SMALL)
    for one, two in ((0, 0), (3, 1), (k - 1, 5)):
        logs = scorer.logs(np.full(k, one), np.full(k, two), np.arange(k))
        assert abs((10**logs).sum() - 1) < 1e-4
    table = {bytes(r["token"]): r["c"] for r in counts.collect()}
    classes = {t for t, i in lex.ids.items() if i < SMALL.vocabulary}
    for b in range(256):  # a tail class is shared out among its tokens and the unseen
        inside = sum(c for t, c in table.items() if t and t[-1] == b and t not in classes)
        assert inside == lex.tail_total[b]
        assert abs((1 - lex.unseen[b]) * (inside / max(inside, 1)) + lex.unseen[b] - 1) < 1e-9


def test_nothing_to_learn_from(documents):
    assert lm.language_scores(documents([]), SMALL).collect() == []
    only = next(i for i in range(100) if out(i))
    got = lm.language_scores(documents([(only, "some words")]), SMALL).collect()
    assert len(got) == 1 and got[0]["held_out"] and got[0]["n_known"] == 0 and math.isfinite(got[0]["score"])
    assert got[0]["base_score"] == 0.0 and got[0]["train_tokens"] == 0


def test_gradient_steps_raise_the_likelihood():
    rng = np.random.default_rng(0)
    kind = np.tile([0, 1, 2, 3], 500)
    lex = lm.Lexicon({b"": 0}, np.array([1]), 1, 1, np.zeros(256), np.ones(256), np.bincount(kind, minlength=SMALL.classes).astype(float))
    trainer = lm.Trainer(lm.first_weights(lex, SMALL), lex, SMALL, 1)
    sizes = np.array([len(kind)])
    one, two = lm._contexts(kind, sizes, 0)
    before = lm.Scorer(trainer.w, SMALL).logs(one, two, kind).mean()
    for _ in range(10):
        trainer.learn(kind, sizes, 0)
    assert lm.Scorer(trainer.w, SMALL).logs(one, two, kind).mean() > before + 0.3
    assert rng is not None


def test_training_does_not_follow_the_partitions(documents):
    import random

    rng = random.Random(5)
    follow = {f"w{i}": [f"w{(7 * i + k) % 20}" for k in range(2)] for i in range(20)}
    rows = []
    for i in range(600):
        words = [f"w{rng.randrange(20)}"]
        while len(words) < 60:
            words.append(rng.choice(follow[words[-1]]))
        rows.append((i, " ".join(words)))
    settings = lm.Settings(vocabulary=24, dimensions=6, noise=16, batch=64, head=40, longest=12)
    gain = {}
    for parts in (1, 64):
        got = [r for r in lm.language_scores(documents(rows).repartition(parts), settings).collect() if r["held_out"]]
        gain[parts] = sum(r["score"] - r["base_score"] for r in got) / sum(r["n_tokens"] for r in got)
    assert gain[1] > 0.3 and abs(gain[64] - gain[1]) < 0.1 * gain[1], gain


def test_units_hold_every_token_with_its_contexts(documents, rows):
    learning = documents([r for r in rows if not out(r[0])]).repartition(7)
    lex = lm.lexicon(lm.count_tokens(learning).cache(), SMALL)
    small = lm.Settings(**{**vars(SMALL), "unit": 2})
    end, want = lex.ids[lm.END], Counter()
    for r in learning.collect():
        _, kind, sizes, _ = lm._classes([(r["text"] or "").encode()], lex.ids, small)
        want.update(zip(*(x.tolist() for x in (*lm._contexts(kind, sizes, end), kind))))
    units = lm._units(learning, lex, small).collect()
    got = Counter(x for u in units for x in zip(*(a.tolist() for a in lm._unpack([bytes(b) for b in u["blocks"]], end))))
    assert got == want and len({(u["turn"], u["lane"]) for u in units}) == len(units) > 4


def test_small_corpora_gain_from_context(spark):
    """Held-out tokens of a small table score better than by the same model without context, by a tenth of a decade each."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    settings = lm.Settings()
    kept = docs.filter(~lm.held_out(F.col("doc_id")))
    lex = lm.lexicon(lm.count_tokens(kept), settings)
    weights = lm.train(kept, lex, settings)
    plain = lm.Weights(**{name: value.copy() for name, value in vars(weights).items()})
    plain.left[:] = 0
    plain.bias = lm.first_weights(lex, settings).bias
    texts = [(r["text"] or "").encode() for r in docs.filter(lm.held_out(F.col("doc_id"))).collect()]
    scores = []
    for w in (weights, plain):
        scorer, total, n = lm.Scorer(w, settings), 0.0, 0
        for text in texts:
            _, kind, sizes, _ = lm._classes([text], lex.ids, settings)
            total += scorer.logs(*lm._contexts(kind, sizes, lex.ids[lm.END]), kind).sum()
            n += len(kind)
        scores.append(total / n)
    assert scores[0] >= scores[1] + 0.1
