import math
import re
from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from roleweave.operators import joins as J
from roleweave.operators import market as M
from roleweave.operators import profiles as P
from roleweave.operators import rank as W
from roleweave.operators import score as R
from roleweave.operators import tfidf as V

u, j = F.col("u"), F.col("j")
_SETTINGS = settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


@_SETTINGS
@given(user=st.sets(st.sampled_from("abcdef")), job=st.sets(st.sampled_from("abcdef")))
def test_overlap_properties(one, user, job):
    got = one(R.skill_overlap(u, j), u=sorted(user), j=sorted(job))
    raw = len(user & job) / len(job) if job else 0.0
    capped = len(job) < 4 and raw > 0.5
    assert got["score"] == (0.5 if capped else raw)
    assert got["capped"] is capped
    assert got["matched"] == sorted(user & job)
    assert sorted(got["matched"] + got["missing"]) == sorted(job)
    assert got["extra"] == sorted(user - job)
    assert 0 <= got["score"] <= 1


def test_plain_overlap(one):
    got = one(R.plain_overlap(u, j), u=[" SQL", "Go"], j=["sql", "sql", "go", "x"])
    assert (got["matched"], got["missing"], round(got["score"], 4)) == (["go", "sql"], ["x"], 0.6667)
    assert one(R.plain_overlap(u, j, strip=False), u=[" SQL"], j=["sql"])["score"] == 0.0
    assert one(R.plain_overlap(u, j), u=["a"], j=[])["score"] == 0.0


@pytest.mark.parametrize(
    ("role", "title", "text", "score", "hits"),
    [
        ("Nurse ", "the nurse", "triage and patient care", 2 / 5 + 0.3, ["patient care", "triage"]),
        ("nurse", "x", "", 0.0, []),
        ("big data wizard", "x", "data of a wizard", 2 / 3, ["data", "wizard"]),
        ("a b", "a b", "a b", 0.0, []),
        ("", "x", "y", 0.0, []),
    ],
)
def test_role_fit(one, vocab, role, title, text, score, hits):
    got = one(R.role_fit(F.col("r"), F.col("t"), F.col("m"), vocab), r=role, t=title, m=text)
    assert got["score"] == pytest.approx(score)
    assert got["hits"] == hits


def test_final_reason_flags(one):
    weights = tuple(F.lit(w) for w in (0.5, 0.5, 0.5))
    assert one(R.final_score(weights, F.lit(1.0), F.lit(1.0), F.lit(1.0))) == 1.0
    reason = R.match_reason(F.lit(2), F.lit(5), F.lit(0.4), F.lit(0.22), F.lit(True))
    assert one(reason) == "2 of 5 skills found in the full page | duties fit the role in part | text close to the profile"
    assert one(R.match_reason(F.lit(0), F.lit(0), F.lit(0.0), F.lit(0.0), F.lit(False))).startswith("Too few")
    assert one(R.few_skills(F.lit(False), F.lit(4))) is False
    assert one(R.snippet_unreliable(F.lit(False), F.lit(7))) is True


def test_weights_sections_focus(one):
    w = P.normalized_weights(F.col("a"), F.col("b"), F.col("c"))
    assert tuple(one(w, a=0.0, b=0.0, c=0.0)) == (0.20, 0.50, 0.30)
    assert tuple(one(w, a=1.0, b=1.0, c=2.0)) == (0.25, 0.25, 0.5)
    text = "Profile: keen.\nTechnical Skills sql, go EXPERIENCE two years Education none"
    got = {k: one(c, x=text) for k, c in P.resume_sections(F.col("x")).items()}
    assert got == {"skills_text": "sql, go", "experience_text": "two years", "summary_text": ": keen. technical"}
    focus = P.focus_text(F.lit("dev"), F.array(F.lit("a"), F.lit("b")), F.lit("s" * 600), F.lit(""))
    assert one(focus) == "dev a b " + "s" * 600
    cut = P.focus_text(F.lit("dev"), F.array(F.lit("a"), F.lit("b")), F.lit("s" * 600), F.lit("e" * 9), 1, 500, 3)
    assert one(cut) == "dev a " + "s" * 500 + " eee"
    assert one(P.query_text(F.lit(" "), F.lit(" dev "))) == "dev"


def _brute_vectors(docs, stop, bigrams, cap):
    def grams(t):
        words = [w for w in re.findall(r"\w{2,}", t.lower()) if w not in stop]
        return words + ([f"{a} {b}" for a, b in zip(words, words[1:], strict=False)] if bigrams else [])

    counts = {i: Counter(grams(t)) for i, t in docs.items()}
    total, df = Counter(), Counter()
    for c in counts.values():
        total.update(c)
        df.update(c.keys())
    keep = sorted(total, key=lambda t: (-total[t], t))[:cap]
    idf = {t: math.log((1 + len(docs)) / (1 + df[t])) + 1 for t in keep}

    def unit(c):
        w = {t: n * idf[t] for t, n in c.items() if t in idf}
        norm = math.sqrt(sum(x * x for x in w.values()))
        return {t: x / norm for t, x in w.items()} if norm else {}

    return {i: unit(c) for i, c in counts.items()}, lambda t: unit(Counter(grams(t)))


DOCS = {1: "red fox and blue fox", 2: "blue whale, red sea", 3: "", 4: "and", 5: "fox fox fox the sea of red", 6: "unrelated words"}


@pytest.mark.parametrize(("bigrams", "cap"), [(True, 6), (True, None), (False, None), (False, 3)])
@pytest.mark.parametrize("hot", [2, 20_000])
def test_cosine_equals_brute_force(spark, monkeypatch, bigrams, cap, hot):
    monkeypatch.setattr(V, "HOT_TERMS", hot)
    stop = {"and", "of", "the"}
    vectors, unit = _brute_vectors(DOCS, stop, bigrams, cap)
    counted = spark.createDataFrame(list(DOCS.items()), "id long, text string").select(
        "id", V.term_counts(F.col("text"), stop, bigrams).alias("terms")
    )
    texts = {10: "a red fox in the sea", 11: "nothing known", 12: "blue"}
    queries = spark.createDataFrame(list(texts.items()), "q long, text string").select(
        "q", V.term_counts(F.col("text"), stop, bigrams).alias("terms")
    )
    want = {
        (q, i): sum(w * unit(t).get(term, 0) for term, w in v.items())
        for q, t in texts.items() for i, v in vectors.items()
    }
    one_query = queries.where("q = 10").select("terms")
    got = {r["id"]: r["similarity"] for r in V.cosine_to_query(counted, one_query, "id", cap).collect()}
    assert got == pytest.approx({i: want[10, i] for i in DOCS})
    if hot == 2:
        pairs = {(r["q"], r["id"]): r["similarity"] for r in V.cosine_pairs(counted, queries, "id", "q", cap).collect()}
        assert pairs == pytest.approx({k: s for k, s in want.items() if s > 0})


def test_ranks_and_pages(spark):
    rows = [(i, i % 3, float(i % 7)) for i in range(1000)]
    df = spark.createDataFrame(rows, "id long, g int, s double").repartition(7)
    order = [F.col("s").desc(), F.col("id").asc()]
    want = {i: n + 1 for n, (i, _, _) in enumerate(sorted(rows, key=lambda r: (-r[2], r[0])))}
    ranked = W.with_rank(df, order)
    assert {r["id"]: r["rank"] for r in ranked.collect()} == want
    for g in range(3):
        ordered = sorted((r for r in rows if r[1] == g), key=lambda r: (-r[2], r[0]))
        got = W.with_rank(df, order, group="g").where(F.col("g") == g)
        assert {r["id"]: r["rank"] for r in got.collect()} == {i: n + 1 for n, (i, _, _) in enumerate(ordered)}
    assert sorted(r["rank"] for r in W.result_page(ranked, 2, 20).collect()) == list(range(21, 41))
    assert sorted(r["rank"] for r in W.result_page(ranked, 99, 300).collect()) == list(range(901, 1001))
    assert W.result_page(ranked.where("id < 0"), 1, 10).count() == 0
    top = W.top_k_per(df, ["g"], order, 2).collect()
    assert sorted((r["g"], r["rank"]) for r in top) == [(g, k) for g in range(3) for k in (1, 2)]


def test_skill_gap_follows_the_sort(spark):
    df = spark.createDataFrame([(1, 0.9, "z", ["a"]), (2, 0.5, "a", ["b"]), (3, 0.4, "b", ["b"])], "arrival_seq long, final_score double, job_title string, missing_skills array<string>")
    best = M.skill_gap(df, W.sort_keys("Best Match"), rows=1)
    title = M.skill_gap(df, W.sort_keys("Job Title (A-Z)"), rows=2)
    assert [tuple(r) for r in best.collect()] == [("a", 1)]
    assert [tuple(r) for r in title.collect()] == [("b", 2)]


def test_choose_and_full_texts(spark):
    postings = spark.createDataFrame([(1, "t", "u1", "x" * 10), (2, "t", "u2", "x" * 10), (3, "t", "", "x"), (4, "t", None, "y")], "posting_id long, job_title string, job_link string, job_description string")
    pages = spark.createDataFrame([("u1", "p" * 61), ("u2", "p" * 60), ("", "p" * 99)], "job_link string, text string")
    got = {r["posting_id"]: (r["used_full_desc"], r["scored_text"][0]) for r in R.choose_text(postings, pages).collect()}
    assert got == {1: (True, "p"), 2: (False, "x"), 3: (False, "x"), 4: (False, "y")}
    assert [r["posting_id"] for r in R.full_texts(postings, pages).collect()] == [1]


def test_cosine_over_all_terms_shuffles_numbers_only(spark):
    docs = spark.createDataFrame([(1, "red fox"), (1, "red sea"), (None, "fox"), (2, None)], "id long, text string").select(
        "id", V.term_counts(F.col("text"), [], False).alias("terms")
    )
    query = spark.createDataFrame([("red red whale",)], "text string").select(V.term_counts(F.col("text"), [], False).alias("terms"))
    found = V.cosine_to_query(docs, query, "id")
    assert "hashpartitioning(term" not in found._jdf.queryExecution().toString()
    # The rows of an id that comes twice are summed; the two words in two rows weigh less than the sea.
    two, one = math.log(5 / 3) + 1, math.log(5 / 2) + 1
    want = {1: 2 * two / math.sqrt(3 * two**2 + one**2), None: 0.0, 2: 0.0}
    assert {r["id"]: r["similarity"] for r in found.collect()} == pytest.approx(want)


@pytest.mark.parametrize("hot", [1, 3, 10_000])
def test_rows_of_a_term_shuffle_once_and_frequent_ones_not_at_all(spark, monkeypatch, hot):
    monkeypatch.setattr(V, "HOT_KEYS", hot)
    texts = {i: f"common {'often' if i % 2 else 'seldom'} pair{i // 2} own{i} own{i} red" if i % 5 else "common" for i in range(40)} | {40: None}
    docs = spark.createDataFrame(list(texts.items()), "id long, text string").repartition(3).select("id", V.term_counts(F.col("text"), [], False).alias("terms"))
    query = spark.createDataFrame([("red own3 pair3 whale common",)], "text string").select(V.term_counts(F.col("text"), [], False).alias("terms"))
    found = V.cosine_to_query(docs, query, "id")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(_a") == 1
    counts = {i: {w: (t or "").split().count(w) for w in (t or "").split()} for i, t in texts.items()}
    df = {w: sum(w in c for c in counts.values()) for c in counts.values() for w in c}
    vector = lambda c: {w: tf * (math.log(42 / (df[w] + 1)) + 1) for w, tf in c.items() if w in df}
    asked = vector(dict.fromkeys(["red", "own3", "pair3", "whale", "common"], 1))
    length = lambda v: math.sqrt(sum(x * x for x in v.values())) or 1.0
    want = {i: sum(x * asked.get(w, 0.0) for w, x in v.items()) / length(v) / length(asked) for i, v in ((i, vector(c)) for i, c in counts.items())}
    assert {r["id"]: r["similarity"] for r in found.collect()} == pytest.approx(want)
    assert V.cosine_to_query(docs.where("false"), query, "id").collect() == []
    assert [r["similarity"] for r in V.cosine_to_query(docs.where("id = 40"), query, "id").collect()] == [0.0]


def test_parts_follow_the_bytes_of_a_scan(spark, tmp_path, monkeypatch):
    spark.range(20_000).selectExpr("id", "id % 7 AS k").coalesce(1).write.parquet(str(tmp_path / "t"))
    scan = spark.read.parquet(str(tmp_path / "t"))
    size = J.estimated_bytes(scan)
    assert J.dealt_by(scan, scan, "k") is scan
    assert J.dealt_by(scan, scan, "id", part_bytes=size // 40).rdd.getNumPartitions() >= 40
    monkeypatch.setattr(J, "SPREAD_BYTES", size // 40)
    assert J.spread(scan).rdd.getNumPartitions() >= 40
