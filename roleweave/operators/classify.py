"""Filters and classifiers: row-local predicates over one matching text per posting."""

from __future__ import annotations

import functools
import operator
import re
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roleweave.functions import text as T
from roleweave.functions.arrays import let, with_computed
from roleweave.vocabulary import KeywordSet, Vocabulary, array_literal

# Words that decide the work mode, career level and employment type.
REMOTE_WORDS = ("remote", "work from home", "wfh")
HYBRID_WORDS = ("hybrid",)
INTERN_WORDS = ("intern", "internship")
ENTRY_WORDS = ("entry", "junior", "jr ", "new grad", "recent graduate")
SENIOR_WORDS = ("senior", " lead ", "principal", "director", "manager")
PART_TIME_WORDS = ("part-time", "part time")
CONTRACT_WORDS = ("contract", "temporary")
FULL_TIME_WORDS = ("full-time", "full time")
# Fixed value: country pattern, unanchored.
HOME_COUNTRY = "united states|usa|us"

_INLINE_WORDS = 100


def contains_any(text: Column, words: Iterable[str]) -> Column:
    """Substring test against a list; short lists become plain ORs inside generated code."""
    words = sorted(words)
    if len(words) > _INLINE_WORDS:
        return F.exists(array_literal(words), lambda w: F.contains(text, w))
    return functools.reduce(operator.or_, [F.contains(text, F.lit(w)) for w in words], F.lit(False))


def direct_employer(link: Column, description: Column, title: Column, vocab: Vocabulary) -> Column:
    """Keep postings with a link, off the barred domains and free of barred phrases."""
    href, head = (F.lower(T.normalize(c)) for c in (link, title))
    rules = {k: vocab.quality.get(k, ()) for k in ("domain", "text", "title")}
    # Normalizing changes blanks only, so a phrase without any is in the text as it is or not at all.
    spaced = [p for p in rules["text"] if re.search(r"\s", p)]
    plain = {*rules["text"]} - {*spaced}
    barred = let(F.lower(T.text_or_empty(description)), lambda d: contains_any(d, plain))
    if spaced:
        whole = F.concat(head, F.lit(" "), F.lower(T.normalize(description)))
        barred = barred | let(whole, lambda t: contains_any(t, spaced))
    return (
        let(href, lambda h: (h != "") & ~let(T.link_authority(h), lambda d: contains_any(d, rules["domain"])))
        & ~let(head, lambda h: contains_any(h, {*rules["title"], *plain}))
        & ~barred
    )


def industry(matching: Column, vocab: Vocabulary) -> Column:
    """First industry, in rule order, with a keyword inside the text."""

    def of_text(text: Column) -> Column:
        result = F.when(F.lit(False), "")
        for label, keywords in vocab.industries:
            result = result.when(contains_any(text, keywords), label)
        return result.otherwise("Other")

    return let(matching, of_text)


def work_mode(matching: Column) -> Column:
    return let(
        matching,
        lambda m: F.when(contains_any(m, REMOTE_WORDS), "Remote")
        .when(contains_any(m, HYBRID_WORDS), "Hybrid")
        .otherwise("Onsite"),
    )


def career_level(matching: Column) -> Column:
    return let(
        matching,
        lambda m: F.when(contains_any(m, INTERN_WORDS), "Intern")
        .when(contains_any(m, ENTRY_WORDS), "Entry")
        .when(contains_any(m, SENIOR_WORDS), "Senior")
        .otherwise("Mid"),
    )


def employment_type(matching: Column, contract_type: Column, contract_time: Column) -> Column:
    kind, time = T.text_or_empty(contract_type), T.text_or_empty(contract_time)
    return let(
        matching,
        lambda m: F.when(contains_any(m, INTERN_WORDS), "Internship")
        .when(contains_any(m, PART_TIME_WORDS) | (time == "part_time"), "Part-time")
        .when(contains_any(m, CONTRACT_WORDS) | (kind == "contract"), "Contract")
        .when(contains_any(m, FULL_TIME_WORDS) | (time == "full_time"), "Full-time")
        .otherwise("Other"),
    )


def spaced_match(*cols: Column) -> Column:
    """Matching text of several fields joined by one space."""
    return T.join_match(*[T.match_text(c) for c in cols])


def with_matching(postings: DataFrame) -> DataFrame:
    """Add ``match_title``, ``match_desc`` and their joint ``matching`` text, made once per row."""
    return with_computed(
        postings,
        {
            "match_title": T.match_text(F.col("job_title")),
            "match_desc": T.match_text(F.col("job_description")),
        },
    ).withColumn("matching", T.join_match(F.col("match_title"), F.col("match_desc")))


MATCHING_COLUMNS = ("match_title", "match_desc", "matching")


def add_classes(prepared: DataFrame, vocab: Vocabulary) -> DataFrame:
    """Add work mode, industry, level and employment type to postings ``with_matching``."""
    title, description, matching = (F.col(c) for c in MATCHING_COLUMNS)
    job_type = T.match_text(F.col("job_type")) if "job_type" in prepared.columns else F.lit("")
    contract = [T.match_text(F.col(c)) for c in ("contract_type", "contract_time")]
    return prepared.withColumns(
        {
            "work_mode": work_mode(T.join_match(job_type, description, title)),
            "industry": industry(matching, vocab),
            "job_level_norm": career_level(matching),
            "employment_type_norm": employment_type(
                T.join_match(*contract, matching), F.col("contract_type"), F.col("contract_time")
            ),
        }
    )


def in_country(country: Column, pattern: str = HOME_COUNTRY) -> Column:
    """Unanchored match; a missing country does not match."""
    return F.coalesce(F.lower(country).rlike(pattern), F.lit(False))


def facet_filter(postings: DataFrame, facets: Mapping[str, str]) -> DataFrame:
    """Equality facets; the value ``All`` leaves a facet open."""
    for name, value in facets.items():
        if value != "All":
            postings = postings.where(F.col(name) == value)
    return postings


def keyword_match(title: Column, description: Column, rules: KeywordSet, quote: bool = True) -> Column:
    """An include term in title or description and no exclude term in the title.

    ``quote=False`` reads the terms as patterns instead of literal text.
    """
    head, body = (F.lower(T.text_or_empty(c)) for c in (title, description))

    def pattern(terms):
        return "|".join(sorted(re.sub(r"([^\w\s])", r"\\\1", t) if quote else t for t in terms))

    included = head.rlike(pattern(rules.include)) | body.rlike(pattern(rules.include))
    if not rules.exclude:
        return included
    return included & ~head.rlike(pattern(rules.exclude))


def drop_incomplete(df: DataFrame, required: list[str]) -> DataFrame:
    return df.na.drop(subset=required)


def drop_empty(df: DataFrame, columns: list[str]) -> DataFrame:
    """Drop rows in which all the columns are null."""
    return df.na.drop(how="all", subset=columns)
