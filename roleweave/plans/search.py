"""Search and rank: one profile against a table of postings.

Plan shape: the wide texts are read, deduplicated and turned into features row by row, then
staged once without the texts.  Everything after that (vocabulary, similarity, ranks) joins narrow
rows by posting id.
"""

from __future__ import annotations

from collections.abc import Callable, Collection
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from roleweave.functions import text as T
from roleweave.functions.arrays import with_computed
from roleweave.operators import classify, score
from roleweave.operators.dedup import deduplicate_postings
from roleweave.operators.rank import SORT_COLUMNS, sort_keys, with_rank
from roleweave.operators.skills import SkillExtractor, canonicalize
from roleweave.operators.tfidf import cosine_to_query, term_counts
from roleweave.staging import staged
from roleweave.vocabulary import Vocabulary, array_literal, bounded_rows


@dataclass(frozen=True)
class SearchOptions:
    direct_only: bool = True
    home_country_only: bool = True
    facets: dict[str, str] = field(default_factory=dict)
    sort: str = "Best Match"
    max_features: int | None = None


def one_profile(profiles: DataFrame, profile_id=None) -> Row:
    """The single profile of a search, picked by its id if one is given; its values become literals of the plan."""
    if profile_id is not None:
        profiles = profiles.where(F.col("profile_id") == profile_id)
    rows = bounded_rows(profiles, max_rows=1)
    if not rows:
        raise ValueError("the profile is blank: give a role, skills or a resume")
    return rows[0]


#: The result columns behind each part of a search; a posting's own columns need none of them.
CLASS_COLUMNS = frozenset({"work_mode", "industry", "job_level_norm", "employment_type_norm"})
SIMILARITY_COLUMNS = frozenset({"nlp_score", "final_score", "match_reason"})
ROLE_COLUMNS = frozenset({"role_score", "role_hits", "final_score", "match_reason"})
SKILL_COLUMNS = SIMILARITY_COLUMNS | {  # the similarity reads the skills too
    "job_skills", "expanded_job_skills", "matched_skills", "missing_skills", "extra_user_skills", "skill_score",
    "skill_score_capped", "few_skills", "snippet_unreliable",
}


def _reads(columns: Collection[str] | None, part: frozenset[str]) -> bool:
    return columns is None or not part.isdisjoint(columns)


def flagged(
    postings: DataFrame, vocab: Vocabulary, options: SearchOptions, columns: Collection[str] | None = None
) -> DataFrame:
    """Deduplicated postings with matching texts, classes and the flags of both filters.

    Matching texts and classes are each left out where neither ``columns`` nor the facets read anything made of them.
    """
    unique = deduplicate_postings(postings)
    direct = classify.direct_employer(
        F.col("job_link"), F.col("job_description"), F.col("job_title"), vocab
    )
    # Computed first, so that dropped postings cost nothing further.
    checked = with_computed(unique, {"is_clean": direct if options.direct_only else F.lit(True)})
    in_scope = F.lit(True)
    if options.home_country_only:
        in_scope = classify.in_country(F.col("search_country"))
    for name, value in options.facets.items():
        if value != "All":
            in_scope = in_scope & (F.col(name) == value)
    classes = _reads(columns, CLASS_COLUMNS) or any(v != "All" for v in options.facets.values())
    if classes or _reads(columns, SKILL_COLUMNS | ROLE_COLUMNS):
        checked = classify.with_matching(checked)
    if classes:
        checked = classify.add_classes(checked, vocab)
    return checked.withColumn("in_scope", in_scope)


def funnel_counts(rows: DataFrame) -> dict[str, F.Column]:
    """Postings fetched (after deduplication), cleaned and analyzed."""
    clean = F.col("is_clean")
    return {"fetched": F.lit(True), "cleaned": clean, "analyzed": clean & F.col("in_scope")}


def posting_features(
    postings: DataFrame, extractor: SkillExtractor, vocab: Vocabulary, role: str, columns: Collection[str] | None = None
) -> DataFrame:
    """Per posting ``with_matching``: canonical skills, role fit and term counts, as far as ``columns`` need them.

    The texts end here.  A skill list that came with the posting is used; an empty one is
    extracted from the text.
    """
    features = {}
    if _reads(columns, SKILL_COLUMNS):
        postings = _with_skills(postings, extractor)
        features["expanded_job_skills"] = canonicalize(F.col("_skills"), vocab)
    if _reads(columns, ROLE_COLUMNS):
        features["_role"] = score.role_fit(F.lit(role), F.col("match_title"), F.col("matching"), vocab)
    if _reads(columns, SIMILARITY_COLUMNS):
        job_text = T.posting_text(
            *[F.col(c) for c in ("job_title", "job_description", "job_skills", "company", "job_location")]
        )
        features["terms"] = term_counts(job_text, vocab.stopwords)
    if features:
        postings = with_computed(postings, features)
    return postings.drop("job_description", "_skills", "job_skills_list", *classify.MATCHING_COLUMNS)


def _with_skills(postings: DataFrame, extractor: SkillExtractor) -> DataFrame:
    given = F.col("job_skills_list") if "job_skills_list" in postings.columns else F.lit(None).cast("array<string>")
    found = extractor.posting_skills(F.col("job_title"), F.col("job_description"), F.col("matching"))
    skills = F.when(F.size(given) > 0, given).otherwise(found)
    return with_computed(postings, {"_skills": skills}).withColumn("job_skills", T.join_list(F.col("_skills")))


def search(
    postings: DataFrame,
    profiles: DataFrame,
    extractor: SkillExtractor,
    vocab: Vocabulary,
    options: SearchOptions = SearchOptions(),
    profile_id=None,
    columns: Collection[str] | None = None,
) -> DataFrame:
    """Scored postings of one profile, one row each, ready to be ranked, paged or exported.

    ``columns`` names the result columns that are read; skills, role fit or similarity that stand
    behind none of them are not made.  Everything is, if it is not given.
    """
    profile = one_profile(profiles, profile_id)
    spark = postings.sparkSession
    kept = flagged(postings, vocab, options, columns).where("is_clean AND in_scope").drop("is_clean", "in_scope")
    features = posting_features(kept, extractor, vocab, profile["role"], columns)
    if not _reads(columns, SIMILARITY_COLUMNS):
        # The similarity has no row for a posting without an id.
        return _own_scores(features.where("posting_id IS NOT NULL"), profile).select(*columns)
    # Read three times below (vocabulary, similarity, scores), so written once.
    features = staged(features, "features")
    query = spark.createDataFrame([(profile["query_text"],)], "text string").select(
        term_counts(F.col("text"), vocab.stopwords).alias("terms")
    )
    similarity = cosine_to_query(features, query, "posting_id", options.max_features, written=True)
    found = score_postings(features.drop("terms"), similarity, profile).drop("_role")
    return found if columns is None else found.select(*columns)


def score_postings(features: DataFrame, similarity: DataFrame, profile: Row) -> DataFrame:
    """Join the similarity and add overlap, final score, reason and reliability flags."""
    weights = tuple(F.lit(profile[w]) for w in ("w_profile", "w_skill", "w_role"))
    scored = _own_scores(features, profile).join(similarity.withColumnRenamed("similarity", "nlp_score"), "posting_id")
    return scored.withColumns(
        {
            "final_score": score.final_score(
                weights, F.col("nlp_score"), F.col("skill_score"), F.col("role_score")
            ),
            "match_reason": score.match_reason(
                F.size("matched_skills"), F.size("expanded_job_skills"), F.col("role_score"), F.col("nlp_score"),
                F.col("used_full_desc"),
            ),
        }
    )


def _own_scores(features: DataFrame, profile: Row) -> DataFrame:
    """What the posting's own skills and role fit say, as far as they were made; no join."""
    if "used_full_desc" not in features.columns:
        features = features.withColumn("used_full_desc", F.lit(False))
    if "_role" in features.columns:
        features = features.withColumns({"role_score": F.col("_role.score"), "role_hits": F.col("_role.hits")})
    if "expanded_job_skills" not in features.columns:
        return features
    overlap = score.skill_overlap(array_literal(profile["skills"]), F.col("expanded_job_skills"))
    n_skills = F.size("expanded_job_skills")
    return (
        features.withColumn("_o", overlap)
        .withColumns(
            {
                "skill_score": F.col("_o.score"),
                "matched_skills": F.col("_o.matched"),
                "missing_skills": F.col("_o.missing"),
                "extra_user_skills": F.col("_o.extra"),
                "skill_score_capped": F.col("_o.capped"),
            }
        )
        .drop("_o")
        .withColumns(
            {
                "few_skills": score.few_skills(F.col("skill_score_capped"), n_skills),
                "snippet_unreliable": score.snippet_unreliable(F.col("used_full_desc"), n_skills),
            }
        )
    )


def ranked(results: DataFrame, options: SearchOptions = SearchOptions()) -> DataFrame:
    """(posting_id, rank) in the chosen order; join the columns a page needs by id."""
    keys = results.select("posting_id", "arrival_seq", SORT_COLUMNS[options.sort])
    # Sorting samples its input first, so the scores are written once instead of made twice.
    return with_rank(staged(keys, "keys"), sort_keys(options.sort)).select("posting_id", "rank")


#: What a search has to make for ``rescore``.
RESCORE_COLUMNS = ("posting_id", "nlp_score", "expanded_job_skills", "role_score", "role_hits", "used_full_desc")


def rescore(
    postings: DataFrame,
    results: DataFrame,
    page_text: DataFrame | Callable[[DataFrame], DataFrame],
    profiles: DataFrame,
    extractor: SkillExtractor,
    vocab: Vocabulary,
    profile_id=None,
) -> DataFrame:
    """Score again from full page texts where they add enough; the similarity stays as it was.

    ``results`` need the ``RESCORE_COLUMNS`` of a search; ``page_text`` is that of ``score.full_texts``.
    """
    profile = one_profile(profiles, profile_id)
    results = staged(results, "results")  # read three times below
    texts = score.full_texts(postings, page_text, only=results)
    fit = score.role_fit(
        F.lit(profile["role"]),
        T.match_text(F.col("job_title")),
        classify.spaced_match(F.col("job_title"), F.col("text")),
        vocab,
    )
    fresh = texts.select(
        "posting_id",
        canonicalize(extractor.posting_skills(F.col("job_title"), F.col("text")), vocab).alias("_skills"),
        fit.alias("_fit"),
    )
    old_fit = F.struct(F.col("role_score").alias("score"), F.col("role_hits").alias("hits"))
    used = F.col("_fit").isNotNull()
    features = (
        results.join(fresh, "posting_id", "left")
        .withColumns(
            {
                "expanded_job_skills": F.coalesce("_skills", "expanded_job_skills"),
                "_role": F.when(used, F.col("_fit")).otherwise(old_fit),
                "used_full_desc": used | F.col("used_full_desc"),
            }
        )
        .drop("_skills", "_fit", "nlp_score")
    )
    return score_postings(features, results.select("posting_id", F.col("nlp_score").alias("similarity")), profile).drop("_role")
