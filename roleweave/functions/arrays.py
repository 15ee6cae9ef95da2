"""Row-local array helpers: everything here stays inside one row, so nothing shuffles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body``.

    A lambda that captures an outer expression evaluates it again for every element; binding
    it as the element of a one-element array keeps array look-ups linear.
    """
    return F.transform(F.array(value), body)[0]


def with_computed(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns that are computed exactly once per row.

    The optimizer copies a projected expression into every filter and every field access above
    it; a generated one-element list is not copied.  Worth it for heavy text expressions only.
    The outer form matters: for the plain one Spark adds a size filter that evaluates the list
    a second time.
    """
    row = F.struct(*[c.alias(name) for name, c in columns.items()])
    return df.select("*", F.inline_outer(F.array(row)))


def explode_items(df: DataFrame, keep: list, items: Column, name: str) -> DataFrame:
    """One row per list item; the list expression is evaluated once (see ``with_computed``)."""
    return df.select(*keep, F.explode_outer(items).alias(name)).where(F.col(name).isNotNull())


def word_grams(tokens: Column, max_words: int, first_words: list[str]) -> Column:
    """Words, and grams of 2..max_words words that start with one of ``first_words``.

    ``tokens`` alternates word and separator runs.  Because separators stay in the gram, a
    plain equality test on a gram is an exact bounded match of a term that starts and ends
    with a word character.
    """

    def of_tokens(tok: Column) -> Column:
        words = F.transform(gram_starts(tok, 1), lambda i: gram_at(tok, i, 1))
        if max_words < 2:
            return words
        starts = F.filter(gram_starts(tok, 2), lambda i: F.get(tok, i - 1).isin(first_words))

        def longer(first: Column) -> Column:
            # A gram that runs past the end is null; it matches nothing.
            return F.concat(*[of_length(first, k) for k in range(2, max_words + 1)])

        def of_length(first: Column, k: int) -> Column:
            return F.transform(first, lambda i: gram_at(tok, i, k))

        return F.concat(words, let(starts, longer))

    return let(tokens, of_tokens)


def gram_at(tok: Column, start: Column, words: int) -> Column:
    """The gram of so many words at a 1-based position.

    Element look-ups only: ``slice`` copies the whole array each time it is called.
    """
    parts = [F.get(tok, start + offset) for offset in range(-1, 2 * words - 2)]
    return parts[0] if words == 1 else F.concat(*parts)


def gram_starts(tok: Column, words: int) -> Column:
    """1-based positions at which a gram of so many words starts."""
    first = F.when(F.get(tok, F.lit(0)).rlike(r"^[\p{L}\p{N}_]"), 1).otherwise(2)
    last = F.size(tok) - 2 * (words - 1)
    return F.when(first <= last, F.sequence(first, last, F.lit(2))).otherwise(
        F.array().cast("array<int>")
    )


def run_counts(items: Column) -> Column:
    """``array<struct<term, tf>>`` of the distinct items of an array, in sorted order.

    Sort once, keep the index of each run's first element, subtract neighbours: the term
    frequencies of a document without a (document, term) shuffle.
    """

    def of_sorted(s: Column) -> Column:
        marked = F.transform(s, lambda e, i: F.when((i == 0) | (e != F.get(s, i - 1)), i))

        def of_heads(h: Column) -> Column:
            ends = F.slice(F.concat(F.slice(h, 2, F.size(h)), F.array(F.size(s))), 1, F.size(h))
            return F.zip_with(
                h, ends, lambda start, end: F.struct(F.get(s, start).alias("term"), (end - start).alias("tf"))
            )

        return let(F.filter(marked, lambda i: i.isNotNull()), of_heads)

    return let(F.sort_array(F.coalesce(items, F.array())), of_sorted)


def keep_first_by_prefix(items: Column, length: int | None = None) -> Column:
    """Drop items seen earlier, by their first ``length`` characters if given; order is kept."""

    def of_sorted(s: Column) -> Column:
        return F.filter(
            s, lambda e, j: (j == 0) | (e["k"] != F.get(s, j - 1)["k"])
        )

    keyed = F.transform(
        items,
        lambda t, i: F.struct((t if length is None else F.substring(t, 1, length)).alias("k"), i.alias("i"), t.alias("t")),
    )
    firsts = let(F.sort_array(keyed), of_sorted)
    ordered = F.sort_array(F.transform(firsts, lambda e: F.struct(e["i"].alias("i"), e["t"].alias("t"))))
    return F.transform(ordered, lambda e: e["t"])


def sorted_distinct(items: Column) -> Column:
    return F.sort_array(F.array_distinct(items))
