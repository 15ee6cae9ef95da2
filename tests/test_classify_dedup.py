import dataclasses

import pytest
from pyspark.sql import functions as F

from roleweave.functions import text as T
from roleweave.operators import classify as C
from roleweave.operators import dedup as D
from roleweave.operators import market as M
from roleweave.vocabulary import KeywordSet

x = F.col("x")


@pytest.mark.parametrize(
    ("text", "mode", "level"),
    [
        ("Remote or hybrid", "Remote", "Mid"),
        ("work/from home", "Onsite", "Mid"),
        ("(hybrid)", "Hybrid", "Mid"),
        ("internal lead", "Onsite", "Intern"),
        ("jr dev", "Onsite", "Entry"),
        ("dev jr", "Onsite", "Mid"),
        ("a lead dev", "Onsite", "Senior"),
        ("lead dev", "Onsite", "Mid"),
        ("new grad manager", "Onsite", "Entry"),
    ],
)
def test_mode_and_level(one, text, mode, level):
    assert one(C.work_mode(C.spaced_match(x)), x=text) == mode
    assert one(C.career_level(C.spaced_match(x)), x=text) == level


@pytest.mark.parametrize(
    ("kind", "time", "text", "want"),
    [
        ("", "part_time", "x", "Part-time"),
        ("contract", "", "x", "Contract"),
        ("", "full_time", "temporary", "Contract"),
        ("", "full_time", "x", "Full-time"),
        (None, None, "x", "Other"),
        ("", "", "full time internship", "Internship"),
    ],
)
def test_employment_type(one, kind, time, text, want):
    column = C.employment_type(C.spaced_match(F.col("k"), F.col("t"), x), F.col("k"), F.col("t"))
    assert one(column, k=kind, t=time, x=text) == want


def test_industry_and_quality(one, vocab):
    assert one(C.industry(C.spaced_match(x), vocab), x="Payroll at a hospital") == "Healthcare"
    assert one(C.industry(C.spaced_match(x), vocab), x="nothing") == "Other"

    def direct(link, title="Dev", description="fine"):
        column = C.direct_employer(F.col("l"), F.col("d"), F.col("t"), vocab)
        return one(column, l=link, d=description, t=title)

    assert direct("https://firm.example/1")
    assert not direct(" ")
    assert not direct("https://jobs.Aggregator.example/1")
    assert not direct("https://firm.example/1", description="a Staffing\n Agency")
    assert not direct("https://firm.example/1", title="Bootcamp")
    assert direct("https://firm.example/1", description="no bootcamp here")


def test_country_and_keywords(one):
    assert one(C.in_country(x), x="Australia") is True  # unanchored on purpose
    assert one(C.in_country(x), x="France") is False
    assert one(C.in_country(x), x=None) is False
    rules = KeywordSet(("c++", "a.b"), ("three", "hr"))
    match = C.keyword_match(F.col("t"), F.col("d"), rules)
    assert one(match, t="C++ dev", d=None) is True
    assert one(match, t="C++ dev, chrome", d="") is False
    assert one(match, t="axb", d="") is False
    assert one(C.keyword_match(F.col("t"), F.col("d"), KeywordSet(("a.b",), ()), quote=False), t="axb", d="") is True


def test_facets_and_nulls(spark):
    df = spark.createDataFrame([(1, "a", None, None), (2, "b", 1.0, None), (3, None, None, 2.0)], "id int, k string, lo double, hi double")
    assert [r["id"] for r in C.facet_filter(df, {"k": "b", "id": "All"}).collect()] == [2]
    assert C.drop_incomplete(df, ["k", "lo"]).count() == 1
    assert C.drop_empty(df, ["lo", "hi"]).count() == 2
    profile = {r["column"]: (r["rows"], r["nulls"]) for r in M.null_profile(df).collect()}
    assert profile == {"id": (3, 0), "k": (3, 1), "lo": (3, 2), "hi": (3, 2)}
    mean = M.salary_means(df, "lo", "hi").first()
    assert (mean["avg_min"], mean["avg_max"]) == (1.0, 2.0)
    assert M.salary_means(df.where("id = 1"), "lo", "hi").first()["avg_min"] is None
    assert [tuple(r) for r in M.value_counts(df.union(df), "k", 1).collect()] == [("a", 2)]


POSTINGS = [
    (1, "Dev", "Acme", "X", "http://a"),
    (2, " dev ", "ACME", "x", "http://b"),
    (3, "Ops", "Acme", "X", "HTTP://A "),
    (4, "Ops", "Acme", "X", ""),
    (5, "QA", "Acme", "X", None),
    (6, "Dev", "Beta", "X", "http://b"),
    (7, "Dev", "Beta", "X", "http://c"),
]
COLUMNS = "arrival_seq long, job_title string, company string, job_location string, job_link string"


def _brute(rows, collapse):
    links, first = set(), []
    for r in rows:
        link = (r[4] or "").lower().strip()
        if (link or collapse) and link in links:
            continue
        links.add(link)
        first.append(r)
    triples, kept = set(), []
    for r in first:
        key = tuple(" ".join(v.lower().split()) for v in r[1:4])
        if key not in triples:
            triples.add(key)
            kept.append(r[0])
    return kept


@pytest.mark.parametrize("collapse", [True, False])
def test_dedup_two_passes(spark, collapse):
    df = spark.createDataFrame(POSTINGS, COLUMNS)
    got = D.deduplicate_postings(df.repartition(5), collapse)
    assert sorted(r["arrival_seq"] for r in got.collect()) == _brute(POSTINGS, collapse)
    assert D.deduplicate_postings(got, collapse).count() == got.count()


def test_dedup_hot_key(spark):
    rows = [(i, f"t{i % 50}", "c", "l", "" if i % 3 == 0 else f"u{i % 400}") for i in range(1, 1500)]
    df = spark.createDataFrame(rows, COLUMNS)
    got = sorted(r["arrival_seq"] for r in D.deduplicate_postings(df, collapse_empty_links=True).collect())
    assert got == _brute(rows, True)


def test_drop_repeats(spark):
    df = spark.createDataFrame([(2, "a"), (1, "a"), (3, "b")], "arrival_seq long, job_link string")
    assert sorted(r[0] for r in D.drop_repeats(df).collect()) == [1, 3]
    assert D.drop_repeats(df.select("job_link").withColumnRenamed("job_link", "z")).count() == 2


@pytest.mark.parametrize("limit", [D.BROADCAST_BYTES, 0])
def test_losers_go_and_texts_are_not_shuffled(spark, monkeypatch, limit):
    monkeypatch.setattr(D, "BROADCAST_BYTES", limit)
    rows = [(i, f"u{i % 7}", f"t{i % 5}", "c", "l", f"text {i}") for i in range(60)] + [(None, "v", "x", "c", "l", "no number")]
    df = spark.createDataFrame(rows, "arrival_seq long, job_link string, job_title string, company string, job_location string, job_description string")
    kept = D.deduplicate_postings(df)
    assert sorted(r["arrival_seq"] for r in kept.collect()) == [0, 1, 2, 3, 4]
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert ("strategy=broadcast" in plan) == bool(limit)
    text_first = kept.where("arrival_seq < 60").select("job_description")
    executed = text_first._jdf.queryExecution().executedPlan().toString()
    assert ("Exchange hashpartitioning" in executed) == (not limit)
    assert D.deduplicate_postings(df.where("false")).count() == 0


def test_phrases_without_blanks_need_no_normalized_text(spark, vocab, monkeypatch):
    """Descriptions are normalized for phrases with blanks only; results are those of the normalized text."""
    texts = ["a\tbad  offer", "bad\nOffer", "x Badword", "bad", "offer", None, "bad-offer", " bad\u2003offer "]
    rows = spark.createDataFrame([(i, t, d) for i, (t, d) in enumerate((t, d) for t in texts for d in texts)], "i int, t string, d string")
    normalize = T.normalize
    for phrases in ({"badword", "offer x"}, {"bad offer", "badword"}, {"offer"}, {"bad-"}):
        words = dataclasses.replace(vocab, quality={"text": sorted(phrases), "title": ["x bad"], "domain": []})
        if not any(" " in p for p in phrases):
            monkeypatch.setattr(T, "normalize", lambda c: F.raise_error(F.lit("normalized")) if "d" == str(c)[8:-2] else normalize(c))
        flag = C.direct_employer(F.lit("https://a.example/"), F.col("d"), F.col("t"), words)
        monkeypatch.undo()

        def plain(t):
            return " ".join((t or "").lower().split())

        got = {r["i"]: r["f"] for r in rows.select("i", flag.alias("f")).collect()}
        for r in rows.collect():
            joint = plain(r["t"]) + " " + plain(r["d"])
            assert got[r["i"]] == (not any(p in joint for p in phrases) and "x bad" not in plain(r["t"])), (r, phrases)
