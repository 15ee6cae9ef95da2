"""Clean-and-match over a posting table with given skill lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roleweave.functions import text as T
from roleweave.operators import classify, score
from roleweave.operators.dedup import drop_repeats
from roleweave.operators.rank import top_k
from roleweave.operators.tfidf import cosine_to_query, term_counts
from roleweave.vocabulary import KeywordSet, Vocabulary, array_literal

TEXT_COLUMNS = ("job_title", "company", "job_location", "job_level", "job_type", "job_summary", "job_skills")


def clean_postings(raw: DataFrame) -> DataFrame:
    """Normalize texts, drop rows without title or skills, drop repeats, list the skills."""
    present = [c for c in TEXT_COLUMNS if c in raw.columns]
    clean = raw.withColumns({c: T.normalize(F.col(c)) for c in present})
    clean = clean.withColumnsRenamed({"job_summary": "job_description", "job level": "job_level"})
    clean = clean.withColumns(
        {c: T.blank_to_null(F.col(c)) for c in ("job_title", "job_skills")}
    )
    kept = drop_repeats(classify.drop_incomplete(clean, ["job_title", "job_skills"]))
    if "first_seen" in kept.columns:
        kept = kept.withColumn("first_seen", T.parse_date(F.col("first_seen")))
    return kept.withColumns(
        {
            "job_skills_list": T.split_items(F.col("job_skills")),
            "job_text": T.join_fields(" ", F.col("job_title"), F.col("job_description"), F.col("job_skills")),
        }
    )


def match_skills(postings: DataFrame, resume_skills: list[str]) -> DataFrame:
    """Add score, matched and missing skills of one resume."""
    overlap = score.plain_overlap(array_literal(resume_skills), F.col("job_skills_list"))
    return postings.withColumn("_o", overlap).withColumns(
        {
            "skill_score": F.col("_o.score"),
            "matched_skills": F.col("_o.matched"),
            "missing_skills": F.col("_o.missing"),
        }
    ).drop("_o")


def match_text(postings: DataFrame, resume_text: str, vocab: Vocabulary, id_col: str = "arrival_seq") -> DataFrame:
    """(id, similarity) of one resume text: single words, no feature limit."""
    counted = postings.select(
        id_col, term_counts(F.col("job_text"), vocab.stopwords, bigrams=False).alias("terms")
    )
    query = postings.sparkSession.createDataFrame([(resume_text,)], "text string").select(
        term_counts(F.col("text"), vocab.stopwords, bigrams=False).alias("terms")
    )
    return cosine_to_query(counted, query, id_col, max_features=None)


def keyword_subset(postings: DataFrame, rules: KeywordSet, quote: bool = True) -> DataFrame:
    return postings.where(
        classify.keyword_match(F.col("job_title"), F.col("job_description"), rules, quote)
    )


def best(postings: DataFrame, score_column: str, k: int = 10, id_col: str = "arrival_seq") -> DataFrame:
    return top_k(postings, [F.col(score_column).desc_nulls_last(), F.col(id_col).asc()], k)
