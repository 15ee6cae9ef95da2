"""Skill extraction, validation and canonicalization.

Gating is a property of the dictionary, not of a posting, so aliasing, membership and validity
are resolved once on the dictionary side into *surface tables* (surface form -> canonical skill).
A posting then needs one row-local array intersection: no join and no shuffle of its text.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roleweave.functions import text as T
from roleweave.functions.arrays import explode_items, gram_at, gram_starts, let, sorted_distinct
from roleweave.operators.joins import broadcast_if_small
from roleweave.vocabulary import Vocabulary, array_literal, map_literal, one_of

# Cue phrases that introduce a list of requirements; group 1 is the list text.
REQUIREMENT_CUES = (
    r"(?:experience with|proficiency in|proficient in|knowledge of|expertise in|skilled in|"
    r"hands[- ]on experience with|experience using|working knowledge of|familiarity with|"
    r"familiar with)\s+([a-zA-Z0-9+#/\-\s,]{3,})",
    r"(?:required skills?|preferred skills?|technical skills?|core skills?|key skills?)"
    r"[:\s]+([a-zA-Z0-9+#/\-\s,]{3,})",
    r"(?:must have|should have|nice to have)\s+([a-zA-Z0-9+#/\-\s,]{3,})",
    r"(?:tools?|technologies?|stack|platforms?)[:\s]+([a-zA-Z0-9+#/\-\s,]{3,})",
    r"(?:using|use of|build using|reports using|develop and maintain|maintain)"
    r"\s+([a-zA-Z0-9+#/\-\s,]{3,})",
)
# Words that mark a citizenship or clearance demand, never a skill.
NON_SKILL_WORDS = rf"{T.LEFT_EDGE}(?:citizen|citizenship|clearance){T.RIGHT_EDGE}"
# Separators allowed around a one-letter skill, and chunk separators.
CHUNK_BREAKS = ".;•●○–—"
LETTER_LEFT = rf"(?:^|[,;:\s/(\[{CHUNK_BREAKS}])"
LETTER_RIGHT = rf"(?:$|[,;:\s/)\]{CHUNK_BREAKS}])"

TOKENS = rf"{T.WORD}+|{T.NON_WORD}+"
_WORD_EDGED = re.compile(r"\w(.*\w)?", re.DOTALL)


def _empty() -> Column:
    return F.array().cast("array<string>")


Surfaces = dict[str, list[str]]

# --- validity and canonical form -------------------------------------------------------------


def valid_skill(term: Column, vocab: Vocabulary) -> Column:
    """Whether a term looks like a skill (first matching rule wins)."""

    def of_term(s: Column) -> Column:
        words = F.split(s, rf"{T.BLANK}+")
        return (
            F.when(one_of(s, vocab.single_letters), True)
            .when(barred_term(s, vocab), False)
            .when(one_of(s, vocab.known), True)
            .when(F.size(words) >= 2, False)
            .otherwise(~s.rlike(NON_SKILL_WORDS))
        )

    return let(F.lower(T.strip_blank(T.text_or_empty(term))), of_term)


def barred_term(s: Column, vocab: Vocabulary) -> Column:
    """Whether length, form or a stop list rules a lower-case term out."""
    return (
        ~F.length(s).between(2, 40)
        | one_of(s, vocab.stop("generic"))
        | s.rlike(r"^\p{Nd}{5}|&|http|www\.|@")
        | one_of(s, vocab.stop("location"))
        | F.arrays_overlap(F.split(s, rf"{T.BLANK}+"), array_literal(vocab.stop("institution")))
        | ~s.rlike("[a-z0-9+#]")
        | s.rlike(r"^\p{Nd}+$")
    )


def resolve_alias(term: Column, vocab: Vocabulary) -> Column:
    """One alias step."""
    return F.when(
        one_of(term, vocab.aliases), F.try_element_at(map_literal(vocab.aliases), term)
    ).otherwise(term)


def known_skill(term: Column, vocab: Vocabulary) -> Column:
    """Membership after one alias step; blank terms are unknown."""
    return let(
        F.lower(T.strip_blank(T.text_or_empty(term))),
        lambda s: (s != "") & let(resolve_alias(s, vocab), lambda c: one_of(c, vocab.known)),
    )


def _unslashed(token: Column, vocab: Vocabulary) -> Column:
    """Parts of an ``a/b`` token; a token that is a known term or an alias stays whole."""
    whole = one_of(token, vocab.known | set(vocab.aliases))
    parts = F.filter(F.transform(F.split(token, "/"), T.strip_blank), lambda p: p != "")
    return F.when(whole | ~F.contains(token, F.lit("/")), F.array(token)).otherwise(parts)


def split_slashes(terms: Column, vocab: Vocabulary) -> Column:
    cleaned = F.transform(terms, lambda t: F.lower(T.strip_blank(T.text_or_empty(t))))
    return F.flatten(F.transform(F.filter(cleaned, lambda t: t != ""), lambda t: _unslashed(t, vocab)))


def canonicalize(terms: Column, vocab: Vocabulary) -> Column:
    """Split slashes, apply one alias step, drop junk; sorted and distinct.

    Permissive on purpose: an unknown single word is kept.
    """
    parts = split_slashes(F.coalesce(terms, _empty()), vocab)
    named = F.array_distinct(F.transform(parts, lambda t: resolve_alias(t, vocab)))
    return F.sort_array(F.filter(named, lambda t: valid_skill(t, vocab)))


def plain_word(term: Column, vocab: Vocabulary) -> Column:
    """Whether ``canonicalize`` leaves a term as it is, told by one pattern: most words of a text.

    True only of 2 to 40 low letters, the first one of a to z, that no list names; what is false is not decided.
    """
    named = {w for kind in ("generic", "location", "institution") for w in vocab.stop(kind)}
    named |= {*vocab.aliases, "citizen", "citizenship", "clearance"}
    low = term.rlike(r"^[a-z]\p{Ll}{1,39}\z")
    return F.coalesce(low & ~F.contains(term, F.lit("http")) & ~one_of(term, named), F.lit(False))


def canonicalize_rows(skills: DataFrame, vocab: Vocabulary, id_col: str, term_col: str) -> DataFrame:
    """Canonicalize a long (id, term) table: distinct canonical skills per id, as rows.

    For ids that may own any number of terms: partial aggregation drops repeats before the
    shuffle and no list is gathered.
    """
    one = F.when(plain_word(F.col(term_col), vocab), F.array(F.col(term_col))).otherwise(
        canonicalize(F.array(F.col(term_col)), vocab)
    )
    return explode_items(skills, [id_col], one, "skill").distinct()


# --- surface forms ---------------------------------------------------------------------------


def valid_known_terms(spark: SparkSession, vocab: Vocabulary) -> frozenset[str]:
    """Known terms that also look like skills: what the final gate lets through.

    The gate depends on the dictionary only, so it runs once per dictionary entry instead of
    once per posting.
    """
    kept = F.filter(array_literal(sorted(vocab.known)), lambda t: valid_skill(t, vocab))
    return frozenset(spark.sql("SELECT 1").select(kept.alias("terms")).first()["terms"])


def _gate(found: Iterable[tuple[str, str]], vocab: Vocabulary, passing: frozenset[str]) -> Surfaces:
    """Surface form -> canonical skills after one more alias step and the final gate."""
    kept: Surfaces = {}
    for surface, term in sorted(set(found)):
        canonical = vocab.resolve(term)
        if canonical in passing and canonical not in kept.setdefault(surface, []):
            kept[surface].append(canonical)
    return {s: c for s, c in kept.items() if c}


def scan_surfaces(vocab: Vocabulary, passing: frozenset[str]) -> Surfaces:
    """Forms searched in matching text: dictionary terms and alias variants."""
    terms = {t for t in vocab.dictionary if not (len(t) == 1 and t in vocab.single_letters)}
    return _gate([*((t, t) for t in terms), *vocab.aliases.items()], vocab, passing)


def acronym_surfaces(vocab: Vocabulary, passing: frozenset[str]) -> Surfaces:
    """Forms searched, ignoring case, in the raw text."""
    named = ((a, vocab.resolve(a)) for a in vocab.acronyms)
    return _gate(((a, f) for a, f in named if f in vocab.known), vocab, passing)


def token_surfaces(vocab: Vocabulary, passing: frozenset[str]) -> Surfaces:
    """List tokens that count when they equal a known term or an alias of one."""
    named = ((t, vocab.resolve(t)) for t in vocab.known | set(vocab.aliases))
    return _gate(((t, f) for t, f in named if f in passing), vocab, passing)


def letter_surfaces(vocab: Vocabulary, passing: frozenset[str]) -> Surfaces:
    """Single-letter skills, which need list separators around them."""
    letters = {t for t in vocab.dictionary if len(t) == 1 and t in vocab.single_letters}
    return _gate(((t, t) for t in letters), vocab, passing)


class TokenMatcher:
    """Surface forms matched against whole tokens."""

    def __init__(self, surfaces: Surfaces):
        self._surfaces = array_literal(surfaces)
        self._canonical = map_literal({s: _SEVERAL.join(c) for s, c in surfaces.items()})

    def in_tokens(self, tokens: Column) -> Column:
        hits = F.array_intersect(tokens, self._surfaces)
        return F.flatten(
            F.transform(hits, lambda t: F.split(F.try_element_at(self._canonical, t), _SEVERAL))
        )


_SEVERAL = "\u0003"


class TextMatcher:
    """Surface forms matched inside texts, between non-word characters."""

    def __init__(self, surfaces: Surfaces):
        plain = {s: c for s, c in surfaces.items() if _WORD_EDGED.fullmatch(s)}
        self._tokens = TokenMatcher(plain)
        longer: dict[str, list[str]] = {}
        for s in plain:
            words = re.findall(r"\w+", s)
            if len(words) > 1:
                longer.setdefault(words[0], []).append(s)
        self._first_words = array_literal(longer)
        self._longer = map_literal({w: _SEVERAL.join(ss) for w, ss in longer.items()})
        # Terms that start or end with punctuation are few; each is one literal pattern.
        self._odd = {s: c for s, c in surfaces.items() if s not in plain}

    def in_text(self, text: Column, words: Column | None = None) -> Column:
        """Hits in a text; its ``distinct_words`` may be given if at hand.

        Forms of several words are looked for in the text itself, if it has their first word.
        """
        if words is None:
            return let(text, lambda t: let(distinct_words(t), lambda w: self.in_text(t, w)))
        named = F.transform(
            F.array_intersect(words, self._first_words), lambda w: F.split(F.try_element_at(self._longer, w), _SEVERAL)
        )
        longer = F.filter(F.flatten(named), lambda s: F.contains(text, s) & F.rlike(text, _bounded(s)))
        return F.concat(self._tokens.in_tokens(F.concat(words, longer)), literal_hits(text, self._odd))


def distinct_words(text: Column) -> Column:
    """The words of a text, each once; an empty one may be among them, and a null has only that."""
    return F.array_distinct(F.split(T.text_or_empty(text), rf"{T.NON_WORD}+"))


def _bounded(term: Column) -> Column:
    """``bounded_pattern`` of a column, the term first: Java looks for literal text faster than for an edge."""
    literal = F.regexp_replace(term, r"([^\p{L}\p{N}_\s])", r"\\$1")
    return F.concat(literal, F.lit(rf"{T.RIGHT_EDGE}(?<!{T.WORD}"), literal, F.lit(")"))


def literal_hits(text: Column, surfaces: Surfaces) -> Column:
    """One literal pattern per surface form, tried only where the form occurs at all."""
    hits = [
        F.when(F.contains(text, F.lit(s)) & text.rlike(bounded_pattern(s)), array_literal(c)).otherwise(_empty())
        for s, c in surfaces.items()
    ]
    return F.concat(*hits) if hits else _empty()


def bounded_pattern(term: str) -> str:
    """Regex for a literal term between non-word characters."""
    return T.LEFT_EDGE + quoted(term) + T.RIGHT_EDGE


def quoted(term: str) -> str:
    return re.sub(r"([^\w\s])", r"\\\1", term)


# --- row-local scans ------------------------------------------------------------------------


def single_letter_hits(matching_text: Column, surfaces: Surfaces, words: Column | None = None) -> Column:
    """One-letter skills between list separators, at text edges or at chunk edges.

    A chunk ends at a chunk break, so its edges count as separators.  A letter that is a word is only
    looked for in texts that have it among their ``words``, if those are given.
    """

    def hit(letter: str) -> Column:
        # The letter first: looking for one character is faster than looking for a separator.
        found = matching_text.rlike(f"{quoted(letter)}(?={LETTER_RIGHT})(?<={LETTER_LEFT}{quoted(letter)})")
        if words is None or not re.fullmatch(r"\w", letter):
            return found
        return F.array_contains(words, letter) & found

    hits = [F.when(hit(s), array_literal(c)).otherwise(_empty()) for s, c in surfaces.items()]
    return F.concat(*hits) if hits else _empty()


def _trim_list_token(token: Column) -> Column:
    return F.lower(F.regexp_replace(token, r"^[ .:\-]+|[ .:\-]+$", ""))


def requirement_tokens(text: Column, matching_text: Column, cues=REQUIREMENT_CUES) -> Column:
    """Tokens of the lists that follow a requirement cue, parenthesized notes removed."""
    bare = T.match_text(F.regexp_replace(text, r"\([^\n]*?\)", " "))
    body = F.when(F.contains(text, F.lit("(")), bare).otherwise(matching_text)

    def of_body(b: Column) -> Column:
        lists = F.concat(*[F.regexp_extract_all(b, F.lit(cue), F.lit(1)) for cue in cues])
        parts = F.flatten(F.transform(lists, lambda m: F.split(m, r",|;|/|\band\b|\bor\b")))
        return F.filter(F.transform(parts, _trim_list_token), lambda p: p != "")

    return let(body, of_body)


def colon_parts(text: Column) -> Column:
    """Tokens to the right of each line's first colon, slashes left in."""
    lines = F.filter(F.split(text, T.LINE_BREAK), lambda s: F.contains(s, F.lit(":")))
    rights = F.transform(
        lines,
        lambda s: F.regexp_replace(F.regexp_replace(s, r"(?s)^[^:]*:", ""), r"\(.*?\)", ""),
    )
    parts = F.flatten(F.transform(rights, lambda r: F.split(r, r"[,;|]")))
    return F.filter(F.transform(parts, _trim_list_token), lambda p: p != "")


def list_token(p: Column, vocab: Vocabulary) -> Column:
    """Whether a token of a list is neither an address nor part of an institution's name."""
    return ~p.rlike(r"^(?:https?://|www\.)") & ~F.arrays_overlap(
        F.split(p, rf"{T.BLANK}+"), array_literal(vocab.stop("institution"))
    )


def colon_tokens(text: Column, vocab: Vocabulary) -> Column:
    """Tokens to the right of each line's first colon."""
    parts = F.flatten(F.transform(colon_parts(text), lambda p: _unslashed(p, vocab)))
    return F.filter(parts, lambda p: list_token(p, vocab))


class SkillExtractor:
    """Posting- and resume-side extraction over one vocabulary; every result is a column."""

    def __init__(self, spark: SparkSession, vocab: Vocabulary, cues=REQUIREMENT_CUES):
        self._vocab, self._cues = vocab, cues
        passing = valid_known_terms(spark, vocab)
        acronyms = acronym_surfaces(vocab, passing)
        # A one-word acronym is in the raw text if and only if it is in the matching text, but
        # for the word that replaces "&" there.
        words = {a: c for a, c in acronyms.items() if re.fullmatch(r"\w+", a) and a != "and"}
        self._raw_acronyms = {a: c for a, c in acronyms.items() if a not in words}
        scan = scan_surfaces(vocab, passing)
        merged = {s: sorted({*scan.get(s, ()), *words.get(s, ())}) for s in sorted({*scan, *words})}
        self._scan = TextMatcher(merged)
        self._tokens = TokenMatcher(token_surfaces(vocab, passing))
        self._letters = letter_surfaces(vocab, passing)

    def dictionary_hits(self, text: Column, matching_text: Column) -> Column:
        """Dictionary, alias, acronym and one-letter hits of a text, not yet sorted."""
        raw = literal_hits(F.lower(text), self._raw_acronyms) if self._raw_acronyms else _empty()

        def of_words(words: Column) -> Column:
            letters = single_letter_hits(matching_text, self._letters, words)
            return F.concat(self._scan.in_text(matching_text, words), raw, letters)

        return let(distinct_words(matching_text), of_words)

    def requirement_hits(self, text: Column, matching_text: Column) -> Column:
        return self._tokens.in_tokens(requirement_tokens(text, matching_text, self._cues))

    def colon_hits(self, text: Column) -> Column:
        return self._tokens.in_tokens(colon_tokens(text, self._vocab))

    def posting_skills(self, title: Column, text: Column, matching_text: Column | None = None) -> Column:
        """Skills of a posting; ``matching_text`` of title and text may be given if at hand."""
        full = F.concat(T.text_or_empty(title), F.lit("\n"), T.text_or_empty(text))

        def of_matching(m: Column) -> Column:
            return sorted_distinct(
                F.concat(self.dictionary_hits(full, m), self.requirement_hits(full, m))
            )

        matching = T.match_text(full) if matching_text is None else matching_text
        blank = ~T.text_or_empty(text).rlike(T.NON_BLANK)
        return F.when(blank, _empty()).otherwise(let(matching, of_matching))

    def resume_skills(self, text: Column) -> Column:
        source = F.regexp_replace(T.text_or_empty(text), rf"https?://{T.NON_BLANK}+", " ")
        source = F.regexp_replace(source, rf"www\.{T.NON_BLANK}+", " ")

        def of_source(s: Column) -> Column:
            return let(
                T.match_text(s),
                lambda m: sorted_distinct(
                    F.concat(self.dictionary_hits(s, m), self.colon_hits(s), self.requirement_hits(s, m))
                ),
            )

        return F.when(T.normalize(text) == "", _empty()).otherwise(let(source, of_source))


# --- dictionaries beyond the inline bound ---------------------------------------------------


def scan_terms_by_join(
    texts: DataFrame, id_col: str, text_col: str, surfaces: DataFrame
) -> DataFrame:
    """The dictionary scan as a join, for dictionaries too large to inline: (id, skill) rows.

    A gram carries only the tokens around it, never the text.  Spark broadcasts the dictionary
    while its estimated size allows and shuffles otherwise; repeats are dropped per row before.
    """
    words = F.size(F.regexp_extract_all("surface", F.lit(rf"{T.WORD}+"), F.lit(0)))
    longest = surfaces.agg(F.coalesce(F.max(words), F.lit(1))).first()[0]
    literal = F.regexp_replace("surface", r"([^\p{L}\p{N}_\s])", r"\\$1")
    rows = surfaces.select(
        F.regexp_replace("surface", rf"^{T.NON_WORD}+|{T.NON_WORD}+$", "").alias("core"),
        F.concat(F.lit(T.LEFT_EDGE), literal, F.lit(T.RIGHT_EDGE)).alias("pattern"),
        "surface",
        "canonical",
    )
    tokens = F.regexp_extract_all(text_col, F.lit(TOKENS), F.lit(0))
    grams = explode_items(texts, [id_col], context_grams(tokens, longest), "g").select(
        id_col, "g.gram", "g.context"
    )
    hits = grams.join(broadcast_if_small(rows), F.col("gram") == F.col("core"))
    exact = (F.col("gram") == F.col("surface")) | F.rlike("context", F.col("pattern"))
    return hits.where(exact).select(id_col, F.col("canonical").alias("skill")).distinct()


def context_grams(
    tokens: Column,
    longest: int,
    keep: Callable[[Column, int], Column] | None = None,
    shortest: int = 1,
    pair: Callable[[Column, Column, int], Column] | None = None,
    context: bool = True,
) -> Column:
    """Grams with up to two neighbouring tokens on each side, or with nulls without ``context``.

    ``keep`` tells by first word and length which to make, ``pair`` by the first two words and the length.
    """

    def gram(tok: Column, i: Column, words: int) -> Column:
        if not context:
            return F.struct(gram_at(tok, i, words).alias("gram"), F.lit(None).cast("string").alias("context"))
        around = [F.get(tok, i + offset) for offset in range(-3, 2 * words)]
        punctuated = (F.trim(T.text_or_empty(around[1])) != "") | (F.trim(T.text_or_empty(around[-2])) != "")
        return F.struct(
            gram_at(tok, i, words).alias("gram"),
            F.when(punctuated, F.concat_ws("", *around)).alias("context"),
        )

    def of_tokens(tok: Column) -> Column:
        def of_length(words: int) -> Column:
            starts = gram_starts(tok, words)
            if keep is not None:
                starts = F.filter(starts, lambda i: keep(F.get(tok, i - 1), words))
            if pair is not None and words > 1:
                starts = F.filter(starts, lambda i: pair(F.get(tok, i - 1), F.get(tok, i + 1), words))
            return F.transform(starts, lambda i: gram(tok, i, words))

        return F.concat(*[of_length(k) for k in range(shortest, longest + 1)])

    return let(tokens, of_tokens)


# --- extraction quality ---------------------------------------------------------------------


def extraction_quality(expected: DataFrame, extracted: DataFrame, id_col: str = "name") -> DataFrame:
    """Found, missed and unexpected counts and coverage per sample.

    Both inputs are long (sample, skill) tables, so a sample may hold any number of skills.
    """
    both = (
        expected.select(id_col, "skill").distinct().withColumn("wanted", F.lit(1))
        .join(extracted.select(id_col, "skill").distinct().withColumn("got", F.lit(1)), [id_col, "skill"], "full")
    )
    counts = both.groupBy(id_col).agg(
        F.count_if(F.col("wanted").isNotNull() & F.col("got").isNotNull()).alias("found"),
        F.count_if(F.col("wanted").isNotNull() & F.col("got").isNull()).alias("missed"),
        F.count_if(F.col("wanted").isNull() & F.col("got").isNotNull()).alias("unexpected"),
    )
    return counts.withColumn("coverage", coverage(F.col("found"), F.col("found") + F.col("missed")))


# Coverage percentages for the verdicts.
PASS_PERCENT = 90.0
PARTIAL_PERCENT = 75.0


def coverage(found: Column, expected: Column) -> Column:
    return found * 100.0 / F.greatest(expected, F.lit(1))


def quality_verdict(quality: DataFrame) -> DataFrame:
    """Overall coverage and verdict over all samples."""
    total = quality.agg(F.sum("found").alias("found"), F.sum(F.col("found") + F.col("missed")).alias("expected"))
    percent = coverage(F.col("found"), F.col("expected"))
    return total.select(
        "found", "expected", percent.alias("coverage"),
        F.when(percent >= PASS_PERCENT, "PASS").when(percent >= PARTIAL_PERCENT, "PARTIAL")
        .otherwise("FAIL").alias("verdict"),
    )


def missed_skills(expected: DataFrame, extracted: DataFrame, id_col: str = "name") -> DataFrame:
    """Distinct skills that some sample expected and did not get, as rows."""
    return (
        expected.select(id_col, "skill").distinct()
        .join(extracted.select(id_col, "skill").distinct(), [id_col, "skill"], "left_anti")
        .select("skill").distinct()
    )
