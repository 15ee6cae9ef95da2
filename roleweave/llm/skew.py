"""Joins and numberings that stay even when one key holds a large share of all rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A key is hot from this share of the left rows on, so there are at most as many hot keys as its inverse.
HOT_SHARE = 1 / 1000
#: Below this many rows a key is never worth splitting.
LEAST_HOT_ROWS = 200


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], spread: Column, how: str = "inner", same_plan: bool = False) -> DataFrame:
    """Join with the hot keys of ``left`` split over several tasks.

    Keys with at least a thousandth of the left rows are counted first; there can be no more than a
    thousand of them, which bounds what is broadcast.  Their left rows are dealt by ``spread`` (a
    hash of other columns) and their right rows are repeated once per part.  ``how`` is inner,
    left or left_semi or left_anti; ``right`` should hold few rows per key.  Rows with a null key match nothing.
    ``same_plan`` shuffles both sides at every size instead of leaving a small side to be broadcast.
    """
    plan = (lambda df: df.hint("merge")) if same_plan else (lambda df: df)
    counts = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    counts = counts.filter(F.col("_rows") >= LEAST_HOT_ROWS)
    found = counts.orderBy(F.desc("_rows")).limit(int(1 / HOT_SHARE)).collect()
    if not found:
        return left.join(plan(right), keys, how)
    schema = counts.schema
    limit = max(LEAST_HOT_ROWS, found[-1]["_rows"] if len(found) >= 1 / HOT_SHARE else 0)
    hot = left.sparkSession.createDataFrame(found, schema).select(
        *keys, F.ceil(F.col("_rows") / limit).cast("int").alias("_parts")
    )
    dealt = left.join(F.broadcast(hot), keys, "left").withColumn(
        "_salt", F.coalesce(F.pmod(F.xxhash64(spread, F.lit("salt")), F.col("_parts")), F.lit(0)).cast("int")
    )
    copied = right.join(F.broadcast(hot), keys, "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_parts") - 1, F.lit(0))))
    )
    return dealt.drop("_parts").join(plan(copied.drop("_parts")), [*keys, "_salt"], how).drop("_salt")


def numbered(df: DataFrame, keys: list[str], order: list[str], total: int, name: str) -> DataFrame:
    """Number the rows of each key from 0 without gaps, with no task that holds a whole key.

    Rows are dealt to about sqrt(total) buckets by a hash of ``order``; a bucket starts where the
    counts of the earlier ones end.  Neither a bucket nor a key's list of buckets outgrows
    sqrt(total) by much.  ``order`` has to tell rows apart; equal rows share their numbers in any order.
    """
    buckets = max(1, math.isqrt(max(total, 1)))
    dealt = df.withColumn("_bucket", F.pmod(F.xxhash64(*order, F.lit(name)), F.lit(buckets)))
    by = [*keys, "_bucket"]
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        dealt.groupBy(*by)
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .drop("_n")
    )
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1
    return dealt.withColumn("_place", place).join(starts, by).withColumn(name, F.col("_start") + F.col("_place")).drop(
        "_bucket", "_place", "_start"
    )
