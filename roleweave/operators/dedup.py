"""Keep-first deduplication that survives hot keys.

A window per key would sort all copies of a hot key in one task.  Instead the winner of each
key is a minimum over narrow rows, which partial aggregation reduces before the shuffle, and the
wide rows meet the winners once, on their unique arrival number.  Postings meet the losers instead:
those are written first, and where their size allows it they go to every task, so that texts stay
where they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roleweave.functions import text as T
from roleweave.staging import staged

#: Losers up to this many bytes go to every task; beyond it the rows meet them by a shuffle.
BROADCAST_BYTES = 64 * 1024 * 1024
#: Bytes of a row in a broadcast table besides its key, generously.
ROW_BYTES = 64


def keep_first(df: DataFrame, keys: list, order: str = "arrival_seq") -> DataFrame:
    """The row with the lowest ``order`` for each key; ``order`` must be unique."""
    named = [k.alias(f"_k{i}") if not isinstance(k, str) else F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]
    winners = (
        df.select(F.col(order), *named)
        .groupBy(*[f"_k{i}" for i in range(len(keys))])
        .agg(F.min(order).alias(order))
        .select(order)
    )
    return df.join(winners, order, "left_semi")


def posting_keys(postings: DataFrame, collapse_empty_links: bool = False) -> DataFrame:
    """Arrival number, link key and (title, company, location) key of each posting."""
    link = F.lower(T.strip_blank(T.text_or_empty(F.col("job_link"))))
    if not collapse_empty_links:
        link = F.when(link == "", F.concat(F.lit("\u0000"), F.col("arrival_seq"))).otherwise(link)
    triple = F.struct(
        *[T.key_text(F.col(c)).alias(c) for c in ("job_title", "company", "job_location")]
    )
    return postings.select("arrival_seq", link.alias("link_key"), triple.alias("triple_key"))


def first_by_link(keys: DataFrame) -> DataFrame:
    """First pass: earliest posting of each link."""
    return keys.groupBy("link_key").agg(
        F.min("arrival_seq").alias("arrival_seq"),
        F.min_by("triple_key", "arrival_seq").alias("triple_key"),
    )


def first_by_triple(keys: DataFrame) -> DataFrame:
    """Second pass: earliest posting of each (title, company, location)."""
    return keys.groupBy("triple_key").agg(F.min("arrival_seq").alias("arrival_seq"))


def deduplicate_postings(postings: DataFrame, collapse_empty_links: bool = False) -> DataFrame:
    """Keep-first by link, then keep-first by (title, company, location) among the survivors.

    A posting without a link is compared by its triple only; with ``collapse_empty_links`` all
    empty links share one key instead, and one such posting survives the first pass.
    """
    keys = posting_keys(postings, collapse_empty_links)
    winners = first_by_triple(first_by_link(keys)).select("arrival_seq")
    return without_losers(postings, keys.select("arrival_seq").join(winners, "arrival_seq", "left_anti"))


def without_losers(rows: DataFrame, losers: DataFrame, order: str = "arrival_seq") -> DataFrame:
    """``rows`` whose ``order`` is not null and not in ``losers``; the losers' size is measured, not estimated."""
    losers = staged(losers.where(F.col(order).isNotNull()), "losers")
    n, longest = losers.agg(F.count(F.lit(1)), F.max(F.octet_length(F.col(order).cast("string")))).first()
    small = n * ((longest or 0) + ROW_BYTES) <= BROADCAST_BYTES
    return rows.where(F.col(order).isNotNull()).join(F.broadcast(losers) if small else losers.hint("merge"), order, "left_anti")


def drop_repeats(df: DataFrame, link: str = "job_link", order: str = "arrival_seq") -> DataFrame:
    """Keep-first by link where that column exists, else distinct rows."""
    return keep_first(df, [link], order) if link in df.columns else df.dropDuplicates()
