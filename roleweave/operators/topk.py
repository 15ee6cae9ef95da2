"""The best k documents for every query of a table, exact, without a table of all pairs.

Documents are lists of weighted features (terms, skills, keywords), queries too, and a score is at most
the sum of products of common features.  The inverted lists are cut by impact: a cell holds the
documents of one feature whose weights share half an octave, for one block of documents, and knows its
largest weight.  A query's threshold is the score of its k-th best seed (documents that stand
first in its lists).  Lists are taken from the lightest product up as long as all of them together, each
feature once at its heaviest, stay below a share of the threshold: those are not read.  The others are summed per
query and document, and only sums that reach the threshold with all that was left out on top are kept
and scored exactly.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from roleweave.staging import staged

#: Documents in a block: no cell and no task of the lists outgrows it.
BLOCK_DOCUMENTS = 100_000
#: Cells lighter than 2 to the minus half of this are one.
LIGHTEST = 40
#: What is not read may be worth this share of the threshold: less read, or fewer pairs to score exactly.
UNREAD_SHARE = 0.2


@dataclass(frozen=True)
class Index:
    """``lists``: (feature, bucket, block, doc, weight); ``cells``: (feature, bucket, block, heaviest)."""

    lists: DataFrame
    cells: DataFrame


#: Tables of queries up to this many bytes go to every task.
SENT_BYTES = 64 * 1024 * 1024
#: Bytes of a sent row besides its texts, generously.
ROW_BYTES = 96


def sent_if_small(rows: DataFrame, otherwise: str | None = None) -> DataFrame:
    """``rows`` with a hint to broadcast them if their measured size allows it, else with the hint ``otherwise``.

    Without one, Spark may still broadcast by the size of files, which for a written table of numbers in
    order is a hundredth of what its rows take.
    """
    texts = [F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c, t in rows.dtypes if t == "string"]
    size = F.sum(reduce(Column.__add__, texts, F.lit(ROW_BYTES)).cast("long"))
    if (rows.agg(size).first()[0] or 0) <= SENT_BYTES:
        return F.broadcast(rows)
    return rows.hint(otherwise) if otherwise else rows


def build_index(weights: DataFrame, n_documents: int) -> Index:
    """Index (doc, feature, weight) rows, one per document and feature; weights are above zero."""
    blocks = max(1, -(-n_documents // BLOCK_DOCUMENTS))
    bucket = F.greatest(F.least(F.floor(F.log2("weight") * -2), F.lit(LIGHTEST)), F.lit(-LIGHTEST)).cast("int")
    lists = weights.where("weight > 0").select(
        "feature", bucket.alias("bucket"), F.pmod(F.xxhash64("doc"), F.lit(blocks)).cast("int").alias("block"), "doc", "weight"
    )
    lists = staged(lists, "lists")
    cells = lists.groupBy("feature", "bucket", "block").agg(F.max("weight").alias("heaviest"))
    return Index(lists, staged(cells, "cells"))


def dot_scores(index: Index, queries: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """Scores of given pairs as sums of products: (query, doc) -> (query, doc, score)."""

    asked = sent_if_small(queries.select("query", "feature", F.col("weight").alias("_qw")))

    def of(pairs: DataFrame) -> DataFrame:
        # Pairs meet lists by document, so a sum is made where the list is and features are not shuffled per pair.
        held = pairs.join(index.lists.select("doc", "feature", "weight"), "doc")
        found = held.join(asked, ["query", "feature"])
        products = F.sort_array(F.collect_list(F.col("_qw") * F.col("weight")))
        # Summed from the smallest up, so that equal documents have equal scores whatever the order of the rows.
        score = F.aggregate(products, F.lit(0.0), lambda total, x: total + x)
        return found.groupBy("query", "doc").agg(score.alias("score"))

    return of


def seeds(index: Index, queries: DataFrame, k: int, per_query: int) -> DataFrame:
    """(query, doc): the documents that are best by the first k entries of each of the query's lists."""
    first = Window.partitionBy("feature").orderBy(F.col("weight").desc(), "doc")
    heads = index.lists.join(queries.select("feature").distinct(), "feature", "left_semi")
    heads = heads.withColumn("_place", F.row_number().over(first)).where(F.col("_place") <= k)
    sums = (
        queries.select("query", "feature", F.col("weight").alias("_qw"))
        .join(heads.select("feature", "doc", "weight"), "feature")
        .groupBy("query", "doc")
        .agg(F.sum(F.col("_qw") * F.col("weight")).alias("_part"))
    )
    order = Window.partitionBy("query").orderBy(F.col("_part").desc(), "doc")
    return sums.withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= per_query).select("query", "doc")


def candidates(index: Index, queries: DataFrame, thresholds: DataFrame, margin: float) -> DataFrame:
    """(query, doc): every pair whose score may reach the query's threshold; a query without one takes all its lists."""
    impact = index.cells.groupBy("feature", "bucket").agg(F.max("heaviest").alias("_most"))
    reach = queries.join(impact, "feature").withColumn("_most", F.col("weight") * F.col("_most"))
    # A document holds a feature in one bucket, so the next heavier bucket adds the difference only.
    buckets = Window.partitionBy("query", "feature").orderBy("_most", F.col("bucket").desc())
    reach = reach.withColumn("_more", F.col("_most") - F.coalesce(F.lag("_most").over(buckets), F.lit(0.0)))
    lighter = Window.partitionBy("query").orderBy("_most", "feature", F.col("bucket").desc())
    reach = reach.withColumn("_sum", F.sum("_more").over(lighter)).join(thresholds, "query", "left")
    goal = F.coalesce("threshold", F.lit(0.0)) - margin
    reach = staged(reach.withColumn("_read", F.col("_sum") >= goal * UNREAD_SHARE), "reach")
    unread = reach.where("NOT _read").groupBy("query").agg(F.max("_sum").alias("_unread"))
    goals = queries.select("query").distinct().join(thresholds, "query", "left").join(unread, "query", "left")
    goals = goals.select("query", (goal - F.coalesce("_unread", F.lit(0.0))).alias("_goal"))
    wanted = sent_if_small(reach.where("_read").select("query", "feature", "bucket", F.col("weight").alias("_qw")))
    cells = sent_if_small(reach.where("_read").select("feature", "bucket").distinct())
    # Dealt by document first: the products of a document are summed where they are made, and only the lists are shuffled.
    lists = index.lists.select("feature", "bucket", "doc", "weight").join(cells, ["feature", "bucket"], "left_semi")
    sums = (
        lists.repartition("doc").join(wanted, ["feature", "bucket"])
        .groupBy("query", "doc")
        .agg(F.sum(F.col("_qw") * F.col("weight")).alias("_part"))
    )
    return sums.join(goals, "query").where("_part >= _goal").select("query", "doc")


def best_documents(
    index: Index,
    queries: DataFrame,
    k: int,
    score: Callable[[DataFrame], DataFrame] | None = None,
    digits: int | None = None,
    order: tuple[Column, ...] | None = None,
) -> DataFrame:
    """The k best documents of each query: the columns that ``score`` returns, and ``rank`` from 1.

    ``queries`` holds (query, feature, weight) with weights above zero, one row per query and feature.
    ``score`` turns (query, doc) pairs into rows with their exact ``score``, which is nowhere above the sum of
    products; by default it is that sum.  With ``digits`` scores are rounded before they are
    ranked.  Ties follow ``order``, by default the document.  Documents that share no feature with a query are left out.
    """
    exact = score or dot_scores(index, queries)
    margin = 1e-9 + (0.0 if digits is None else 10.0**-digits)
    rounded = F.col("score") if digits is None else F.round("score", digits)

    def top(pairs: DataFrame) -> DataFrame:
        ranking = Window.partitionBy("query").orderBy(F.col("score").desc(), *(order or (F.col("doc"),)))
        scored = exact(pairs).withColumn("score", rounded)
        return scored.withColumn("rank", F.row_number().over(ranking)).where(F.col("rank") <= k)

    thresholds = top(seeds(index, queries, k, 2 * k)).where(F.col("rank") == k).select("query", F.col("score").alias("threshold"))
    return top(candidates(index, queries, staged(thresholds, "thresholds"), margin))
