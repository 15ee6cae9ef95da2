"""Weights against a direct search for the power; draws against quotas."""

import math
from collections import Counter, defaultdict

import pytest

from roleweave.llm import mixing


def entropy(w):
    return -sum(x * math.log(x) for x in w if x > 0) / math.log(len(w))


def rows_of(prose, sizes):
    return [(s * 10_000 + i, prose(s * 999 + i, 3 + i % 5), f"src{s}") for s, n in enumerate(sizes) for i in range(n)]


@pytest.mark.parametrize(
    "settings", [mixing.Settings(), mixing.Settings(entropy=0.9), mixing.Settings(entropy=0.99, passes=2.0), mixing.Settings(entropy=0.97, budget=900, passes=50.0)]
)
def test_weights_and_draws(documents, prose, settings):
    rows = rows_of(prose, [300, 40, 25, 12])
    got = mixing.drawn_documents(documents(rows, extra=True), settings).collect()
    tokens, size = Counter(), {i: len(t.split()) for i, t, _ in rows}
    for i, _, s in rows:
        tokens[s] += size[i]
    weight = {r["source"]: r["weight"] for r in got}
    total = sum(tokens.values())

    def at(p):
        w = {s: (n / total) ** p for s, n in tokens.items()}
        return {s: x / sum(w.values()) for s, x in w.items()}

    def budget(w):
        return settings.budget or max(tokens[s] / w[s] for s in tokens)

    def fits(p):
        w = at(p)
        return max(budget(w) * w[s] / tokens[s] for s in tokens) <= settings.passes

    powers = [i / 20_000 for i in range(20_001)]
    best = max(p for p in powers if entropy(at(p).values()) >= settings.entropy)
    if not fits(best):
        best = max(best, min((p for p in powers if fits(p)), default=1.0))
    assert all(abs(weight[s] - at(best)[s]) < 1e-3 for s in weight)
    drawn = Counter()
    for r in got:
        drawn[r["source"]] += size[r["doc_id"]]
    for s in tokens:
        quota = min(budget(weight) * weight[s], settings.passes * tokens[s])
        assert -1e-6 <= quota - drawn[s] < 8  # short by less than a document
    epochs = defaultdict(list)
    for r in got:
        epochs[r["doc_id"]].append(r["epoch"])
    assert all(sorted(e) == list(range(len(e))) for e in epochs.values())
    times = defaultdict(set)
    for i, _, s in rows:
        times[s].add(len(epochs.get(i, [])))
    assert all(max(t) - min(t) <= 1 for t in times.values())
    if not settings.budget:
        assert len(epochs) == len(rows)


def test_odd_rows(documents, prose):
    rows = [(1, "a b c", None), (2, None, None), (3, "", "empty"), (4, prose(1, 4000), "long"), (None, "x y", "long"), (5, "p q", "long"), (5, "p q", "long")]
    got = Counter((r["doc_id"], r["source"]) for r in mixing.mix(documents(rows, extra=True)).collect())
    assert set(got) == {(r[0], r[2]) for r in rows}
    assert got[5, "long"] == 2 and got[3, "empty"] == 1


def test_empty_and_single_source(documents, prose):
    assert mixing.drawn_documents(documents([])).collect() == []
    rows = [(i, prose(i, 4)) for i in range(9)]
    assert mixing.drawn_documents(documents(rows)).count() == 9


def test_many_sources_go_by_a_shuffle(documents, prose, monkeypatch):
    rows = rows_of(prose, [60, 8, 5])
    want = Counter(r["doc_id"] for r in mixing.mix(documents(rows)).collect())
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert Counter(r["doc_id"] for r in mixing.mix(documents(rows)).collect()) == want


def test_positions_are_block_permutations_of_every_pass(documents, prose):
    rows = rows_of(prose, [300, 40, 25, 12])
    settings = mixing.Settings(entropy=0.99, passes=6.0)
    got = mixing.drawn_documents(documents(rows), settings).collect()
    # The natural entropy is below the target: the power is below 1 and small sources repeat.
    natural = Counter(r[2] for r in rows)
    assert entropy([n / len(rows) for n in natural.values()]) < 0.7 and max(r["epoch"] for r in got) >= 2
    orders = defaultdict(list)
    for s in natural:
        mine = sorted((r for r in got if r["source"] == s), key=lambda r: r["position"])
        assert [r["position"] for r in mine] == list(range(len(mine)))
        assert [r["epoch"] for r in mine] == sorted(r["epoch"] for r in mine)
        assert all(abs(r["share"] - (r["position"] + 0.5) / len(mine)) < 1e-12 for r in mine)
        for epoch in {r["epoch"] for r in mine}:
            part = [r for r in mine if r["epoch"] == epoch]
            blocks = [b for i, b in enumerate(r["block"] for r in part) if i == 0 or part[i - 1]["block"] != b]
            assert len(blocks) == len(set(blocks))  # each block stands together
            orders[s].append([r["doc_id"] for r in part])
    first, second = orders["src3"][:2]
    assert sorted(first) == sorted(second) and first != second and first != sorted(first)
    # Any stretch in the order of share holds the sources in proportion.
    mixed = [r["source"] for r in sorted(got, key=lambda r: (r["share"], r["source"]))]
    draws = Counter(mixed)
    for at in range(0, len(mixed) - 100, 50):
        for s, n in Counter(mixed[at : at + 100]).items():
            assert abs(n - 100 * draws[s] / len(mixed)) <= 2.5


def test_many_rows_without_an_id(documents, prose):
    rows = [(None, prose(i, 6), "a") for i in range(120)] + [(i, prose(i, 6), "b") for i in range(10)]
    got = mixing.drawn_documents(documents(rows), mixing.Settings(entropy=0.5, budget=300)).collect()
    a = [r for r in got if r["source"] == "a"]
    assert sorted(r["position"] for r in a) == list(range(len(a))) and 20 < len(a) < 60
    assert len({r["block"] for r in a}) > 1
