"""Text normalization as native column expressions (no Python workers).

Java's ``\\w`` and ``\\s`` are ASCII-only and ``(?U)`` also counts combining marks, so the
character classes are spelled out: letters, numbers and underscore for words, every Unicode
separator and control space for blanks.  The same classes are valid in RE2, which keeps the
DuckDB cross-checks literal.
"""

from __future__ import annotations

from string import ascii_letters, digits

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]"
NON_WORD = r"[^\p{L}\p{N}_]"
# Latin-1 members one by one: Java tests those with a bit set, ranges one after the other.
_BLANKS = (
    r"\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
BLANK = f"[{_BLANKS}]"
NON_BLANK = f"[^{_BLANKS}]"
LINE_BREAK = r"\r\n|[\n-\r\x1c-\x1e\x85\x{2028}\x{2029}]"
LEFT_EDGE = rf"(?<!{WORD})"
RIGHT_EDGE = rf"(?!{WORD})"


def _runs(members: str) -> str:
    """Runs of a class that has the space, but for single spaces: those that become one space.

    Most blanks of a text are single spaces already, which are not copied.  ASCII letters and digits are
    ruled out first, one by one: Java tests those with a bit set, ranges (ten times slower) one after the other.
    """
    return rf"[[^{ascii_letters}{digits}]&&[{members}]](?:[{members}]+|(?<! ))"


_BLANK_RUNS = _runs(_BLANKS)
_MATCH_RUNS = _runs(_BLANKS + r"|()\[\]{}:")


def text_or_empty(col: Column) -> Column:
    return F.coalesce(col.cast("string"), F.lit(""))


def normalize(col: Column) -> Column:
    """Null to empty, blank runs (no-break space included) to one space, ends trimmed."""
    return F.trim(F.regexp_replace(text_or_empty(col), _BLANK_RUNS, " "))


def first_words(col: Column, n: int) -> Column:
    """The first ``n`` words of the normalized text; the rest of the text is not looked at."""
    start = rf"^{BLANK}*({NON_BLANK}+(?:{BLANK}+{NON_BLANK}+){{0,{n - 1}}})"
    return normalize(F.regexp_extract(text_or_empty(col), start, 1))


def match_text(col: Column) -> Column:
    """Lowered text for matching: ``&`` and ``/`` spelled out, brackets, bars and colons dropped."""
    lowered = F.lower(text_or_empty(col))
    spelled = F.replace(F.replace(lowered, F.lit("&"), F.lit(" and ")), F.lit("/"), F.lit(" / "))
    return F.trim(F.regexp_replace(spelled, _MATCH_RUNS, " "))


def join_match(*matching: Column) -> Column:
    """Matching text of several fields from their own matching texts; empty ones add nothing."""
    return F.concat_ws(" ", *[blank_to_null(m) for m in matching])


def key_text(col: Column) -> Column:
    """Comparison key: lowered, blank runs collapsed, ends trimmed."""
    return normalize(F.lower(text_or_empty(col)))


def strip_blank(col: Column) -> Column:
    """Trim every kind of blank, not only spaces."""
    return F.regexp_replace(col, rf"^{BLANK}+|{BLANK}+$", "")


def blank_to_null(col: Column) -> Column:
    return F.nullif(col, F.lit(""))


def split_items(col: Column, separators: str = ",") -> Column:
    """Trimmed, lowered, non-empty items of a separated list; repeats are kept."""
    parts = F.split(text_or_empty(col), f"[{separators}]")
    items = F.transform(parts, lambda s: F.lower(strip_blank(s)))
    return F.filter(items, lambda s: s != "")


TYPED_SEPARATORS = ",;|"


def split_typed(col: Column) -> Column:
    return split_items(col, TYPED_SEPARATORS)


def join_fields(separator: str, *cols: Column) -> Column:
    """Concatenate with a separator; nulls count as empty fields, not as missing ones."""
    return F.concat_ws(separator, *[text_or_empty(c) for c in cols])


def posting_text(title, description, skills, company, location) -> Column:
    return join_fields(" | ", title, description, skills, company, location)


def join_list(col: Column, separator: str = ", ") -> Column:
    return F.array_join(col, separator)


def parse_date(col: Column) -> Column:
    """Unparseable dates become null instead of failing the job."""
    return F.try_to_timestamp(col)


def parse_number(col: Column) -> Column:
    """Unparseable numbers and NaN become null."""
    value = col.try_cast("double")
    return F.when(~F.isnan(value), value)


def link_authority(link: Column) -> Column:
    """Lowered authority of a link (port and user info kept), every ``www.`` removed."""
    authority = F.regexp_extract(link, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)", 1)
    return F.lower(F.replace(authority, F.lit("www."), F.lit("")))


def prefix(col: Column, length: int) -> Column:
    return F.substring(col, 1, length)


def title_case(col: Column) -> Column:
    """Upper-case the first letter of every letter run, so ``a/b x`` becomes ``A/B X``."""
    runs = F.regexp_extract_all(col, F.lit(r"\p{L}+|[^\p{L}]+"), F.lit(0))
    return F.array_join(F.transform(runs, _capitalize), "")


def _capitalize(col: Column) -> Column:
    """Title-case the first letter; a letter whose capital form is two letters keeps the second low."""
    first = F.upper(F.substring(col, 1, 1))
    return F.concat(
        F.substring(first, 1, 1), F.lower(F.substring(first, 2, 2)), F.substring(col, 2, 1_000_000_000)
    )


def display_fallback(col: Column) -> Column:
    """Display form of a term that has no dictionary entry."""
    return (
        F.when(F.contains(col, F.lit(" ")), title_case(col))
        .when(col.rlike(r"^\p{L}+$"), _capitalize(col))
        .otherwise(col)
    )


def display_name(col: Column, names: Column) -> Column:
    """Dictionary display name, else the fallback casing; ``names`` maps term to name."""
    term = F.lower(strip_blank(text_or_empty(col)))
    return F.coalesce(F.try_element_at(names, term), display_fallback(term))


def display_list(col: Column, names: Column) -> Column:
    return F.transform(col, lambda s: display_name(s, names))
