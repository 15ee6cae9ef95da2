"""Search for a table of profiles: the best postings of each, without a table of all pairs.

The weighted score is a sum over common features: terms of the texts, skills, role keywords found in
the text and roles named by the title, each with the profile's weight.  Its caps only lower it, so
the impact index finds every posting that can be among the best, and those are scored by the exact rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roleweave.functions import text as T
from roleweave.functions.arrays import with_computed
from roleweave.operators import score
from roleweave.operators.skills import SkillExtractor, canonicalize
from roleweave.operators.tfidf import explode_terms, fitted, query_weights, term_counts, unit_weights
from roleweave.operators.topk import best_documents, build_index, dot_scores, sent_if_small
from roleweave.plans.search import SearchOptions, flagged
from roleweave.staging import staged
from roleweave.vocabulary import Vocabulary, array_literal

#: So many keywords are looked for in a text by one expression.
KEYWORDS_AT_ONCE = 2_000


def _profile_roles(profiles: DataFrame, vocab: Vocabulary) -> DataFrame:
    """Profiles with ``_key`` (of the role), ``_keywords`` and ``_named``: whether the role is a known one."""
    key = score.role_key(F.col("role"))
    known = score.role_keywords(F.col("role"), vocab)
    words = F.filter(F.split(key, rf"{T.BLANK}+"), lambda w: F.length(w) >= score.MIN_ROLE_WORD_CHARS)
    return profiles.withColumns(
        {"_key": key, "_keywords": F.coalesce(known, words), "_named": known.isNotNull() & (key != "")}
    )


def _found(text: Column, words: list[str]) -> Column:
    """The words that a text contains, in parts of a bounded number of words."""
    parts = [words[i : i + KEYWORDS_AT_ONCE] for i in range(0, len(words), KEYWORDS_AT_ONCE)] or [[]]
    return F.concat(*[F.filter(array_literal(part), lambda w: F.contains(text, w)) for part in parts])


def _features(postings: DataFrame, extractor: SkillExtractor, vocab: Vocabulary, keywords: list[str], roles: list[str]) -> DataFrame:
    """Per posting: canonical skills, keywords in the text, roles in the title, term counts; no texts."""
    found = extractor.posting_skills(F.col("job_title"), F.col("job_description"), F.col("matching"))
    listed = with_computed(postings, {"_skills": found}).withColumn("job_skills", T.join_list(F.col("_skills")))
    job_text = T.posting_text(
        *[F.col(c) for c in ("job_title", "job_description", "job_skills", "company", "job_location")]
    )
    return listed.select(
        "posting_id",
        "arrival_seq",
        canonicalize(F.col("_skills"), vocab).alias("skills"),
        _found(F.col("matching"), keywords).alias("keywords"),
        _found(F.col("match_title"), roles).alias("roles"),
        term_counts(job_text, vocab.stopwords).alias("terms"),
    )


def _lists(name: str, items: Column, weight: Column) -> tuple[Column, Column]:
    return F.explode(F.transform(F.array_distinct(items), lambda x: F.concat(F.lit(f"{name}:"), x))).alias("feature"), weight.alias("weight")


def search_many(
    postings: DataFrame,
    profiles: DataFrame,
    extractor: SkillExtractor,
    vocab: Vocabulary,
    k: int,
    options: SearchOptions = SearchOptions(),
    digits: int = 6,
) -> DataFrame:
    """The k best postings of every profile: scores, matched skills and ``rank``; ties follow arrival.

    Scores are rounded to ``digits`` before they are ranked.  Postings that share nothing with a
    profile (final score 0) are left out.  The distinct role keywords of all profiles become
    literals of the plan, in parts; terms and skills do not.
    """
    kept = flagged(postings, vocab, options).where("is_clean AND in_scope")
    asks = _profile_roles(profiles, vocab).withColumn("terms", term_counts(F.col("query_text"), vocab.stopwords))
    asks = staged(asks.drop("query_text", "focus_text"), "profiles")
    words = sorted(r[0] for r in asks.select(F.explode("_keywords")).distinct().collect())
    roles = sorted(r[0] for r in asks.where("_named").select("_key").distinct().collect())
    features = staged(_features(kept, extractor, vocab, words, roles), "features")

    terms, vocabulary = fitted(features, "posting_id", options.max_features, written=True)
    asked = explode_terms(asks, "profile_id").where("term IS NOT NULL").select("term").distinct()
    wanted = staged(vocabulary.join(asked, "term", "left_semi"), "wanted")
    similar = staged(unit_weights(terms, vocabulary, wanted, "posting_id", options.max_features is not None), "similar")
    of_text = staged(query_weights(asks, wanted, "profile_id"), "queries")

    skill_names = asks.select(F.explode("skills").alias("skill")).distinct()
    skills = features.select("posting_id", F.explode("skills").alias("skill"), F.try_divide(F.lit(1.0), F.size("skills")).alias("weight"))
    weights = (
        similar.select("posting_id", F.concat(F.lit("t:"), "term").alias("feature"), "weight")
        .union(skills.join(skill_names, "skill", "left_semi").select("posting_id", F.concat(F.lit("s:"), "skill"), "weight"))
        .union(features.select("posting_id", *_lists("k", F.col("keywords"), F.lit(1.0))))
        .union(features.select("posting_id", *_lists("r", F.col("roles"), F.lit(1.0))))
        .withColumnRenamed("posting_id", "doc")
    )
    per_keyword = F.try_divide(F.col("w_role"), F.size("_keywords"))
    query = F.col("profile_id").alias("query")
    queries = (
        of_text.join(asks.select("profile_id", "w_profile"), "profile_id")
        .select(query, F.concat(F.lit("t:"), "term").alias("feature"), (F.col("w_profile") * F.col("qw")).alias("weight"))
        .union(asks.select(query, *_lists("s", F.col("skills"), F.col("w_skill"))))
        # a keyword that a role lists twice counts twice
        .union(asks.select(query, F.explode("_keywords").alias("_k"), per_keyword.alias("_w")).groupBy("query", F.concat(F.lit("k:"), "_k")).agg(F.sum("_w")))
        .union(asks.where("_named").select(query, F.concat(F.lit("r:"), "_key"), F.col("w_role") * score.ROLE_TITLE_BONUS))
        .where("weight > 0")
    )
    index, queries = build_index(weights, features.count()), staged(queries, "asks")

    text_index = type(index)(similar.select(F.col("posting_id").alias("doc"), F.col("term").alias("feature"), "weight"), index.cells)
    similarity = dot_scores(text_index, of_text.select(query, F.col("term").alias("feature"), F.col("qw").alias("weight")))
    narrow = features.select(F.col("posting_id").alias("doc"), "arrival_seq", F.col("skills").alias("_job"), "keywords", "roles")
    me = asks.select(query, F.col("skills").alias("_mine"), "_keywords", "_key", "_named", "w_profile", "w_skill", "w_role")

    def exact(pairs: DataFrame) -> DataFrame:
        # Written pairs take less than a byte each: their files say nothing about what a broadcast of them takes.
        pairs = sent_if_small(staged(pairs, "pairs"), otherwise="merge")
        joined = pairs.join(similarity(pairs).withColumnRenamed("score", "_sim"), ["query", "doc"], "left").join(me, "query").join(narrow, "doc")
        hits = F.filter("_keywords", lambda w: F.array_contains("keywords", w))
        bonus = F.when(F.col("_named") & F.array_contains("roles", F.col("_key")), score.ROLE_TITLE_BONUS).otherwise(0.0)
        role = F.least(F.coalesce(F.try_divide(F.size(hits), F.size("_keywords")), F.lit(0.0)) + bonus, F.lit(1.0))
        scored = joined.withColumns(
            {"nlp_score": F.coalesce("_sim", F.lit(0.0)), "_o": score.skill_overlap(F.col("_mine"), F.col("_job")), "role_score": role}
        )
        final = score.final_score(
            tuple(F.col(w) for w in ("w_profile", "w_skill", "w_role")), F.col("nlp_score"), F.col("_o.score"), F.col("role_score")
        )
        return scored.select(
            "query", "doc", "arrival_seq", final.alias("score"), F.round("nlp_score", digits).alias("nlp_score"),
            F.round("_o.score", digits).alias("skill_score"), F.round("role_score", digits).alias("role_score"),
            F.col("_o.matched").alias("matched_skills"),
        ).where("score > 0")

    best = best_documents(index, queries, k, exact, digits, (F.col("arrival_seq"),))
    return best.select(
        F.col("query").alias("profile_id"), F.col("doc").alias("posting_id"), "rank", F.col("score").alias("final_score"),
        "nlp_score", "skill_score", "role_score", "matched_skills",
    )
