"""Skill overlap, role coverage and the weighted final score."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roleweave.functions import text as T
from roleweave.functions.arrays import let
from roleweave.operators.joins import hot_join, unmatched_key
from roleweave.staging import staged
from roleweave.vocabulary import Vocabulary, map_literal

# Thresholds of the scoring rules.
MIN_SKILLS_FOR_FULL_SCORE = 4
CAPPED_SCORE = 0.50
ROLE_TITLE_BONUS = 0.30
MIN_ROLE_WORD_CHARS = 3
STRONG_ROLE, MODERATE_ROLE = 0.70, 0.40
GOOD_SIMILARITY, MODERATE_SIMILARITY = 0.22, 0.10
MIN_SNIPPET_SKILLS = 8
FULL_TEXT_MARGIN = 50

_SEPARATOR = "\u0003"


def _share(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def skill_overlap(user: Column, job: Column) -> Column:
    """Overlap of two canonical skill lists.

    A posting with fewer than four skills cannot score above one half: its text was probably
    cut short, so the result is capped and flagged.
    """

    def of_matched(matched: Column) -> Column:
        raw = _share(F.size(matched), F.size(job))
        capped = (F.size(job) < MIN_SKILLS_FOR_FULL_SCORE) & (raw > CAPPED_SCORE)
        return F.struct(
            F.when(capped, F.lit(CAPPED_SCORE)).otherwise(raw).alias("score"),
            matched.alias("matched"),
            F.sort_array(F.array_except(job, user)).alias("missing"),
            F.sort_array(F.array_except(user, job)).alias("extra"),
            F.size(job).alias("job_skills_count"),
            capped.alias("capped"),
        )

    return let(F.sort_array(F.array_intersect(user, job)), of_matched)


def plain_overlap(user: Column, job: Column, strip: bool = True) -> Column:
    """Share of distinct job skills that the user has; no canonical form and no cap."""
    mine = F.transform(user, lambda s: F.lower(T.strip_blank(s) if strip else s))
    matched = F.sort_array(F.array_intersect(job, mine))
    return F.struct(
        _share(F.size(matched), F.size(F.array_distinct(job))).alias("score"),
        matched.alias("matched"),
        F.sort_array(F.array_except(job, mine)).alias("missing"),
    )


def overlap_by_rows(
    user: DataFrame, job: DataFrame, pairs: DataFrame, user_id: str, job_id: str
) -> DataFrame:
    """Overlap counts from long (id, skill) tables for given (user, job) pairs.

    For lists of any length: counting happens on rows, so no list is gathered.
    """
    job_sizes = job.groupBy(job_id).agg(F.count(F.lit(1)).alias("job_skills_count"))
    hits = (
        pairs.join(job, job_id)
        .join(user, [user_id, "skill"], "left_semi")
        .groupBy(user_id, job_id)
        .agg(F.count(F.lit(1)).alias("matched_count"))
    )
    return (
        pairs.join(job_sizes, job_id, "left")
        .join(hits, [user_id, job_id], "left")
        .na.fill(0, ["job_skills_count", "matched_count"])
        .withColumn("score", _share(F.col("matched_count"), F.col("job_skills_count")))
    )


def role_keywords(role: Column, vocab: Vocabulary) -> Column:
    """Keywords of a role, null if the role is unknown."""
    joined = {r: _SEPARATOR.join(ks) for r, ks in vocab.roles.items()}
    return F.split(F.try_element_at(map_literal(joined), role_key(role)), _SEPARATOR)


def role_key(role: Column) -> Column:
    return F.lower(T.strip_blank(T.text_or_empty(role)))


def role_fit(role: Column, match_title: Column, matching: Column, vocab: Vocabulary) -> Column:
    """Share of role keywords inside the text, plus a bonus if the title names the role.

    Title and text are matching texts.  An unknown role is scored by its own words of three or more letters.
    """
    key = role_key(role)
    words = F.filter(F.split(key, rf"{T.BLANK}+"), lambda w: F.length(w) >= MIN_ROLE_WORD_CHARS)
    keywords = role_keywords(role, vocab)
    bonus = F.when(
        keywords.isNotNull() & (key != "") & F.contains(match_title, key), ROLE_TITLE_BONUS
    ).otherwise(0.0)

    def of_terms(terms: Column) -> Column:
        def of_hits(hits: Column) -> Column:
            share = _share(F.size(hits), F.size(terms))
            return F.struct(F.least(share + bonus, F.lit(1.0)).alias("score"), hits.alias("hits"))

        found = let(matching, lambda m: F.filter(terms, lambda k: F.contains(m, k)))
        return let(found, of_hits)

    return let(F.coalesce(keywords, words), of_terms)


def final_score(weights: tuple, similarity: Column, skill: Column, role: Column) -> Column:
    w_profile, w_skill, w_role = weights
    return F.least(w_profile * similarity + w_skill * skill + w_role * role, F.lit(1.0))


def match_reason(
    matched: Column, total: Column, role: Column, similarity: Column, full_text: Column
) -> Column:
    """One line that explains a score, in our own words."""
    source = F.when(full_text, "the full page").otherwise("the snippet")
    skills = F.when(
        total > 0,
        F.concat(matched.cast("string"), F.lit(" of "), total.cast("string"), F.lit(" skills found in "), source),
    ).otherwise("Too few skills to judge")
    role_part = (
        F.when(role >= STRONG_ROLE, "duties fit the role well")
        .when(role >= MODERATE_ROLE, "duties fit the role in part")
        .otherwise("duties hardly fit the role")
    )
    text_part = (
        F.when(similarity >= GOOD_SIMILARITY, "text close to the profile")
        .when(similarity >= MODERATE_SIMILARITY, "text somewhat close to the profile")
        .otherwise("text far from the profile")
    )
    return F.concat_ws(" | ", skills, role_part, text_part)


def few_skills(capped: Column, job_skills_count: Column) -> Column:
    """The posting yielded too few skills to trust its skill score."""
    return capped | (job_skills_count < MIN_SKILLS_FOR_FULL_SCORE)


def snippet_unreliable(full_text: Column, job_skills_count: Column) -> Column:
    """Scored from the snippet alone, with few skills."""
    return ~full_text & (job_skills_count < MIN_SNIPPET_SKILLS)


def choose_text(postings: DataFrame, page_text: DataFrame) -> DataFrame:
    """Left join full page texts by link and take one where it adds enough.

    ``page_text`` has one row per link.  Postings without a link get a key of their own, so they
    are spread over all tasks instead of meeting in one; a link of very many postings is split.
    """
    link = F.coalesce(F.col("job_link"), F.lit(""))
    keyed = postings.withColumn("_link", unmatched_key(link, link != "", F.col("posting_id")))
    pages = page_text.select(F.col("job_link").alias("_link"), F.col("text").alias("_page"))
    longer = F.length("_page") > F.length(T.text_or_empty(F.col("job_description"))) + FULL_TEXT_MARGIN
    used = F.coalesce(longer, F.lit(False))
    return (
        hot_join(keyed, pages, ["_link"], F.xxhash64("posting_id"), "left")
        .withColumn("used_full_desc", used)
        .withColumn("scored_text", F.when(F.col("used_full_desc"), F.col("_page")).otherwise(F.col("job_description")))
        .drop("_link", "_page")
    )


def full_texts(
    postings: DataFrame, page_text: DataFrame | Callable[[DataFrame], DataFrame], only: DataFrame | None = None
) -> DataFrame:
    """(posting_id, job_title, text) of the postings whose full page adds enough.

    The snippet itself is not needed, so only its length is shuffled.  ``only`` names the
    postings to look at.  A link of very many postings is split.  ``page_text`` may be a function that
    makes the texts for a table of links (``job_link``), so that no other pages are extracted.
    """
    link = F.coalesce(F.col("job_link"), F.lit(""))
    short = postings.where(link != "").select(
        "posting_id", "job_title", "job_link", F.length(T.text_or_empty(F.col("job_description"))).alias("_n")
    )
    if only is not None:
        short = short.join(only.select("posting_id"), "posting_id", "left_semi")
    short = staged(short, "links")
    if not isinstance(page_text, DataFrame):
        page_text = page_text(short.select("job_link").distinct())
    return (
        hot_join(short, page_text.select("job_link", "text"), ["job_link"], F.xxhash64("posting_id"))
        .where(F.length("text") > F.col("_n") + FULL_TEXT_MARGIN)
        .select("posting_id", "job_title", "text")
    )


def role_breakdown(
    scored: DataFrame, role: Column, weights: tuple, vocab: Vocabulary
) -> DataFrame:
    """One row per posting and role keyword, with the weighted parts of the final score.

    ``scored`` needs posting_id, job_title, matching (text), nlp_score, skill_score, role_score.
    """
    w_profile, w_skill, w_role = weights
    parts = scored.select(
        "posting_id",
        F.explode(role_keywords(role, vocab)).alias("keyword"),
        "matching",
        F.contains(F.lower(T.text_or_empty(F.col("job_title"))), role_key(role)).alias("title_bonus"),
        (w_profile * F.col("nlp_score")).alias("profile_part"),
        (w_skill * F.col("skill_score")).alias("skill_part"),
        (w_role * F.col("role_score")).alias("role_part"),
    )
    return parts.withColumn("hit", F.contains("matching", F.col("keyword"))).drop("matching")
