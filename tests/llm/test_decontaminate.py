"""Benchmark windows against a search at every position."""

import hashlib
import re

import pytest

from roleweave.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(text, items):
    w, hit, found = words(text), set(), set()
    for item_id, item in items:
        v = words(item)
        for window in {tuple(v[i : i + 13]) for i in range(max(len(v) - 12, 1))} if v else ():
            for s in range(len(w) - len(window) + 1):
                if tuple(w[s : s + len(window)]) == window:
                    hit |= set(range(s, s + len(window)))
                    found.add(str(item_id))
    digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
    return len(w), len(hit), len(found), digest, bool(hit) and 20 * len(hit) >= len(w)


@pytest.fixture(scope="module")
def items(prose):
    long = prose(1, 40)
    return [(1, long), (2, prose(2, 13)), (10, prose(3, 12)), (3, "two words"), (4, "solo"), (5, ""), (6, None), (7, "..."),
            (8, "a a a a a a a a a a a a a a a"), (11, long)]


@pytest.fixture(scope="module")
def rows(prose, items):
    long, thirteen, twelve = items[0][1], items[1][1], items[2][1]
    part = " ".join(long.split()[5:18])
    return [
        (1, prose(50, 30) + " " + long.upper() + ". " + prose(51, 30)), (2, part), (3, " ".join(long.split()[5:17])),
        (4, prose(52, 300) + " " + thirteen + ", " + twelve), (5, "Two-words; solo solo TWO WORDS"), (6, ""), (7, None), (8, " .,;"),
        (9, "a " * 40), (10, "a " * 12), (11, prose(53, 3000) + " " + part + " " + part), (12, prose(54, 50)), (12, part), (None, part),
        (13, "É solo Éa"), (13, "É solo Éa"), (14, thirteen.replace(" ", "...")),
    ]


def check(spark, documents, rows, items):
    table = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contamination(documents(rows, extra=True), table).collect()
    key = lambda r: tuple((x is not None, x) for x in r)
    mine = sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in got), key=key)
    assert mine == sorted(((i, *brute(t, items)) for i, t in rows), key=key)


def test_matches_brute_force(spark, documents, rows, items):
    check(spark, documents, rows, items)


def test_large_benchmark_goes_by_shuffles(spark, documents, rows, items, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 0)
    check(spark, documents, rows, items)


def test_empty_tables(spark, documents, rows):
    check(spark, documents, rows, [])
    check(spark, documents, [], [(1, "a b c")])


def test_removal_keeps_clean_rows(spark, documents, rows, items):
    table = spark.createDataFrame(items, "item_id long, text string")
    left = decontaminate.remove_contaminated(documents(rows), table).collect()
    want = [(i, t) for i, t in rows if not brute(t, items)[4]]
    assert sorted((str(r["doc_id"]), r["text"] or "") for r in left) == sorted((str(i), t or "") for i, t in want)
