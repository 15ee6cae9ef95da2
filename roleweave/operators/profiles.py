"""Candidate profiles: resume sections, skills, focus text and weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roleweave.functions import text as T
from roleweave.operators.skills import SkillExtractor, canonicalize
from roleweave.vocabulary import Vocabulary

# Words that open and close a resume section; the section text is group 2.
SECTION_PATTERNS = {
    "skills_text": r"(skills|technical skills|core skills)(.*?)(experience|projects|education|certifications|$)",
    "experience_text": (
        r"(experience|work experience|projects|project experience)(.*?)(education|certifications|skills|$)"
    ),
    "summary_text": r"(summary|profile|objective)(.*?)(skills|experience|education|$)",
}
# Weights used when all given weights are zero (profile, skill, role).
DEFAULT_WEIGHTS = (0.20, 0.50, 0.30)


def resume_sections(text: Column, patterns=SECTION_PATTERNS) -> dict[str, Column]:
    """Section texts; a missing section is empty, the leftmost cue wins."""
    lowered = F.lower(T.normalize(text))
    return {
        name: T.normalize(F.regexp_extract(lowered, f"(?is){pattern}", 2))
        for name, pattern in patterns.items()
    }


def profile_skills(typed: Column, resume: Column, extractor: SkillExtractor, vocab: Vocabulary) -> Column:
    """Canonical union of typed skills, skills found in the typed text and resume skills."""
    listed = canonicalize(T.split_typed(typed), vocab)
    union = F.array_union(
        F.array_union(listed, extractor.resume_skills(typed)), extractor.resume_skills(resume)
    )
    return canonicalize(union, vocab)


def focus_text(
    role: Column, skills: Column, summary: Column, experience: Column,
    max_skills: int | None = None, summary_chars: int | None = None, experience_chars: int | None = None,
) -> Column:
    """Role, skills and resume sections as one text, whole unless a limit is given."""

    def part(text: Column, limit: int | None) -> Column:
        return text if limit is None else T.prefix(text, limit)

    return T.normalize(
        T.join_fields(
            " ",
            role,
            F.array_join(skills if max_skills is None else F.slice(skills, 1, max_skills), " "),
            part(summary, summary_chars),
            part(experience, experience_chars),
        )
    )


def normalized_weights(profile: Column, skill: Column, role: Column) -> Column:
    """Weights scaled to sum 1; all-zero weights take the defaults."""
    total = profile + skill + role

    def share(w: Column, default: float) -> Column:
        return F.when(total == 0, F.lit(default)).otherwise(F.try_divide(w, total))

    names = ("w_profile", "w_skill", "w_role")
    return F.struct(
        *[share(w, d).alias(n) for w, d, n in zip((profile, skill, role), DEFAULT_WEIGHTS, names, strict=True)]
    )


def query_text(focus: Column, role: Column) -> Column:
    """Focus text, or the role if there is none."""
    return F.coalesce(T.blank_to_null(T.normalize(focus)), T.normalize(role))


def build_profiles(
    raw: DataFrame, extractor: SkillExtractor, vocab: Vocabulary, patterns=SECTION_PATTERNS
) -> DataFrame:
    """``profile_id, role, typed_skills, resume_text, w_*`` -> usable profiles.

    A profile without role, skills and resume text is rejected.
    """
    sections = resume_sections(F.col("resume_text"), patterns)
    base = raw.withColumns(
        {
            **sections,
            "skills": profile_skills(F.col("typed_skills"), F.col("resume_text"), extractor, vocab),
            "_w": normalized_weights(F.col("w_profile"), F.col("w_skill"), F.col("w_role")),
        }
    )
    focus = focus_text(F.col("role"), F.col("skills"), F.col("summary_text"), F.col("experience_text"))
    blank = (
        (T.normalize(F.col("role")) == "")
        & (F.size("skills") == 0)
        & (T.normalize(F.col("resume_text")) == "")
    )
    return (
        base.withColumn("focus_text", focus)
        .where(~blank)
        .select(
            "profile_id",
            T.text_or_empty(F.col("role")).alias("role"),
            "skills",
            "focus_text",
            query_text(F.col("focus_text"), F.col("role")).alias("query_text"),
            "_w.w_profile",
            "_w.w_skill",
            "_w.w_role",
        )
    )
