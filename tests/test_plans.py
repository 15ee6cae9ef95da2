import re
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from roleweave.operators import rank as W
from roleweave.operators import topk
from roleweave.operators.profiles import build_profiles
from roleweave.operators.skills import SkillExtractor
from roleweave.plans import search as S
from roleweave.plans.many import search_many

SF = "/root/testdata/sf0.001"

POSTINGS = [
    (1, "Data Engineer", "Acme", "X", "Spark, Kafka and SQL on AWS. Python too.", "http://a.example/1", "United States"),
    (2, "Data Engineer", "acme ", "x", "same triple", "http://a.example/2", "United States"),
    (3, "Nurse", "Clinic", "X", "patient care and triage", "http://b.example/3", "United States"),
    (4, "Dev", "Repost", "X", "Python", "http://reposts.example/4", "United States"),
    (5, "Dev", "Far", "X", "Python, SQL", "http://c.example/5", "Norway"),
    (6, "Analyst", "Beta", "Y", "SQL", "http://c.example/6", "United States"),
]
SCHEMA = "posting_id long, job_title string, company string, job_location string, job_description string, job_link string, search_country string"


@pytest.fixture(scope="module")
def found(spark, vocab):
    postings = (
        spark.createDataFrame(POSTINGS, SCHEMA)
        .withColumn("arrival_seq", F.col("posting_id"))
        .withColumns({c: F.lit("") for c in ("contract_type", "contract_time")})
    )
    extractor = SkillExtractor(spark, vocab)
    raw = spark.createDataFrame(
        [(1, "data engineer", "sql; python", "Summary builds pipelines skills Spark experience Kafka", 0.0, 0.0, 0.0)],
        "profile_id long, role string, typed_skills string, resume_text string, w_profile double, w_skill double, w_role double",
    )
    profiles = build_profiles(raw, extractor, vocab)
    results = S.search(postings, profiles, extractor, vocab)
    return postings, profiles, extractor, results


def test_search(found):
    rows = {r["posting_id"]: r for r in found[3].collect()}
    assert sorted(rows) == [1, 3, 6]
    best = rows[1]
    assert best["expanded_job_skills"] == ["aws", "kafka", "python", "spark", "sql"]
    assert best["matched_skills"] == ["kafka", "python", "spark", "sql"] and best["missing_skills"] == ["aws"]
    assert best["skill_score"] == 0.8 and best["industry"] == "Technology"
    assert best["final_score"] == pytest.approx(0.2 * best["nlp_score"] + 0.5 * 0.8 + 0.3 * best["role_score"])
    assert rows[6]["skill_score"] == 0.5 and rows[6]["skill_score_capped"] and rows[6]["few_skills"]
    assert rows[3]["nlp_score"] == 0.0


def test_ranks_and_sorts(found):
    results = found[3]
    assert {r["posting_id"]: r["rank"] for r in S.ranked(results).collect()}[1] == 1
    by_title = S.ranked(results, S.SearchOptions(sort="Job Title (A-Z)")).orderBy("rank").collect()
    assert [r["posting_id"] for r in by_title] == [6, 1, 3]
    assert W.top_k(results, W.sort_keys("Role Match"), 1).first()["posting_id"] == 1


def test_rescore_from_full_text(found, spark, vocab):
    postings, profiles, extractor, results = found
    pages = spark.createDataFrame([("http://c.example/6", "SQL, Python, Spark, Kafka, AWS and more. " + "x" * 40)], "job_link string, text string")
    before = {r["posting_id"]: r for r in results.collect()}
    after = {r["posting_id"]: r for r in S.rescore(postings, results, pages, profiles, extractor, vocab).collect()}
    assert sorted(after) == sorted(before)
    assert after[6]["used_full_desc"] and after[6]["skill_score"] == 0.8 and not after[6]["skill_score_capped"]
    assert after[6]["nlp_score"] == before[6]["nlp_score"]
    assert after[1]["final_score"] == before[1]["final_score"] and not after[1]["used_full_desc"]


def test_blank_profile_is_rejected(spark, vocab, found):
    raw = spark.createDataFrame([(1, " ", "", "", 1.0, 0.0, 0.0)], "profile_id long, role string, typed_skills string, resume_text string, w_profile double, w_skill double, w_role double")
    with pytest.raises(ValueError, match="blank"):
        S.one_profile(build_profiles(raw, found[2], vocab))


def test_result_does_not_depend_on_partitions(found, vocab):
    postings, profiles, extractor, results = found
    again = S.search(postings.repartition(13), profiles, extractor, vocab)
    assert {r["posting_id"]: round(r["final_score"], 9) for r in again.collect()} == {
        r["posting_id"]: round(r["final_score"], 9) for r in results.collect()
    }


def test_every_oracle_has_a_query_and_the_entry_runs(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() == 10


@pytest.mark.parametrize("name", ["t3_match_text", "e1_posting_skills", "d1_dedup_hot_key", "r6_tfidf_cosine", "x7_x8_main_text"])
def test_queries_equal_duckdb(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "part", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    cur = con.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in cur.description]
    want = sorted(cur.fetchall())
    got = sorted(tuple(r[c] for c in columns) for r in entry.queries()[name](spark, SF).collect())
    assert got == want


def test_many_profiles_equal_one_at_a_time(found, spark, vocab):
    postings, _, extractor, _ = found
    more = postings.unionByName(postings.withColumns({"posting_id": F.col("posting_id") + 100, "arrival_seq": F.col("arrival_seq") + 100, "job_link": F.concat("job_link", F.lit("/x")), "company": F.concat("company", F.lit(" B"))}))
    raw = spark.createDataFrame(
        [(1, "data engineer", "sql; python", "Summary builds pipelines skills Spark experience Kafka", 0.0, 0.0, 0.0), (2, "nurse", "", "patient care", 1.0, 0.0, 1.0),
         (3, "sql wizard", "", "", 0.0, 0.0, 1.0), (4, "xx", "", "", 1.0, 1.0, 1.0)],
        "profile_id long, role string, typed_skills string, resume_text string, w_profile double, w_skill double, w_role double",
    )
    profiles = build_profiles(raw, extractor, vocab)
    got = {}
    for r in search_many(more, profiles, extractor, vocab, 3).orderBy("profile_id", "rank").collect():
        got.setdefault(r["profile_id"], []).append((r["posting_id"], r["final_score"], r["skill_score"], tuple(r["matched_skills"])))
    for number in (1, 2):
        rows = S.search(more, profiles, extractor, vocab, profile_id=number).where("final_score > 0").collect()
        want = sorted(((-round(r["final_score"], 6), r["arrival_seq"], r) for r in rows), key=lambda x: x[:2])[:3]
        assert got.get(number, []) == [(r["posting_id"], round(r["final_score"], 6), round(r["skill_score"], 6), tuple(r["matched_skills"])) for _, _, r in want]
    assert 1 in got and 4 not in got


def test_many_pairs_are_not_sent_to_every_task(found, vocab, monkeypatch):
    """Pairs beyond the measured bound are joined by shuffles, however small their file is."""
    postings, profiles, extractor, _ = found
    want = sorted(search_many(postings, profiles, extractor, vocab, 3).collect())
    monkeypatch.setattr(topk, "SENT_BYTES", 0)
    result = search_many(postings, profiles, extractor, vocab, 3)
    plan = result._jdf.queryExecution().sparkPlan().toString()
    joins = re.findall(r"(\w+Join) \[doc#\d+L?\], \[doc#\d+L?\], Inner", plan)
    assert "SortMergeJoin" in joins  # of pairs and lists; the other one reads a table of documents
    assert sorted(result.collect()) == want


def test_registries_need_no_session():
    """Names and statements can be listed before a session exists."""
    code = "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries()); from pyspark import SparkContext; assert SparkContext._active_spark_context is None"
    subprocess.run([sys.executable, "-W", "error::SyntaxWarning", "-c", code], check=True, cwd=Path(entry.__file__).parent)


def test_a_search_makes_only_what_is_read(found, vocab, monkeypatch):
    postings, profiles, extractor, results = found
    written = []
    monkeypatch.setattr(S, "staged", lambda df, name: written.append(name) or df)
    parts = [["posting_id", "salary"], ["posting_id", "job_level_norm"], ["posting_id", "skill_score", "missing_skills"],
             ["posting_id", "role_score"], ["posting_id", "few_skills", "industry"]]
    wide = postings.withColumn("salary", F.col("posting_id") * 10.0)
    for columns in parts:
        part = S.search(wide, profiles, extractor, vocab, columns=columns)
        assert part.columns == columns and not written
        want = results.withColumn("salary", F.col("posting_id") * 10.0).select(*columns)
        assert sorted(map(str, part.collect())) == sorted(map(str, want.collect()))
    scored = S.search(wide, profiles, extractor, vocab, columns=["posting_id", "final_score"])
    assert written == ["features"]
    assert {r[0]: round(r[1], 9) for r in scored.collect()} == {r["posting_id"]: round(r["final_score"], 9) for r in results.collect()}


def test_rescore_takes_only_pages_of_found_postings(found, spark, vocab):
    """Links of dropped postings are not asked for, so their pages are not extracted."""
    postings, profiles, extractor, _ = found
    results = S.search(postings, profiles, extractor, vocab, columns=S.RESCORE_COLUMNS)
    pages = spark.createDataFrame(
        [(f"http://{x}", "SQL, Python, Spark, Kafka, AWS and more. " + "x" * 40) for x in ("c.example/6", "c.example/5")],
        "job_link string, text string",
    )
    asked = []

    def texts(wanted):
        asked.extend(r["job_link"] for r in wanted.collect())
        return pages.join(wanted, "job_link", "left_semi")

    got = S.rescore(postings, results, texts, profiles, extractor, vocab)
    want = S.rescore(postings, found[3], pages, profiles, extractor, vocab)
    assert sorted(asked) == ["http://a.example/1", "http://b.example/3", "http://c.example/6"]
    shown = ["posting_id", "used_full_desc", "expanded_job_skills", "matched_skills", "role_hits", "final_score", "few_skills"]
    assert sorted(got.select(shown).collect()) == sorted(want.select(shown).collect())


def test_the_best_ten_make_no_classes(spark, monkeypatch):
    monkeypatch.setattr("roleweave.operators.classify.industry", lambda *_: F.raise_error(F.lit("not read")))
    assert len(entry.queries()["plan_search_top"](spark, SF).collect()) == 10
