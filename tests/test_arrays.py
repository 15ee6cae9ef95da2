from collections import Counter

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from roleweave.functions import arrays as A

_SETTINGS = settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


@_SETTINGS
@given(items=st.lists(st.sampled_from("abcdeé"), max_size=30))
def test_run_counts(one, items):
    got = one(A.run_counts(F.col("x")), x=items)
    assert {r["term"]: r["tf"] for r in got} == dict(Counter(items))
    assert [r["term"] for r in got] == sorted(set(items))


@_SETTINGS
@given(items=st.lists(st.text("ab", max_size=5), max_size=15))
def test_keep_first_by_prefix(one, items):
    seen, want = set(), []
    for t in items:
        if t[:2] not in seen:
            seen.add(t[:2])
            want.append(t)
    assert one(A.keep_first_by_prefix(F.col("x"), 2), x=items) == want


def test_word_grams(one):
    tokens = F.regexp_extract_all(F.col("x"), F.lit(r"\w+|\W+"), F.lit(0))
    grams = one(A.word_grams(tokens, 3, ["b", "c"]), x=" a b, c")
    assert [g for g in grams if g is not None] == ["a", "b", "c", "b, c"]
    assert one(A.word_grams(tokens, 3, ["b"]), x="") == []


def test_explode_items_and_with_computed(spark):
    df = spark.createDataFrame([(1, ["a", "b"]), (2, [])], "id int, xs array<string>")
    rows = A.explode_items(df, ["id"], F.col("xs"), "x").collect()
    assert sorted((r["id"], r["x"]) for r in rows) == [(1, "a"), (1, "b")]
    assert A.with_computed(df, {"n": F.size("xs")}).where("n = 0").count() == 1


def test_run_counts_of_nothing(one):
    assert one(A.run_counts(F.array().cast("array<string>"))) == []
    assert one(A.run_counts(F.lit(None).cast("array<string>"))) == []
    assert [tuple(r) for r in one(A.run_counts(F.col("x")), x=["b"])] == [("b", 1)]
