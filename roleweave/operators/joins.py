"""Join helpers: broadcast only what is small, keep hot keys apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BROADCAST_BYTES = 64 * 1024 * 1024


def estimated_bytes(df: DataFrame) -> int:
    """The optimizer's own size estimate: plan-time only, no job runs."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def broadcast_if_small(df: DataFrame, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast only if the size estimate allows it; AQE decides otherwise."""
    return F.broadcast(df) if estimated_bytes(df) <= max_bytes else df


def unmatched_key(key: Column, matches: Column, row_id: Column) -> Column:
    """Join key that spreads rows which cannot match over all tasks.

    Rows without a partner (blank link, already resolved term) would otherwise all hash to the
    one partition of their shared key.  The NUL prefix never occurs in a real key.
    """
    return F.when(matches, key).otherwise(F.concat(F.lit("\u0000"), row_id.cast("string")))


#: A key with this share of the rows is split, so there are at most as many as its inverse.
HOT_SHARE = 1 / 1000


def hot_join(left: DataFrame, right: DataFrame, keys: list[str], salt: Column, how: str = "inner") -> DataFrame:
    """Inner or left join of ``left`` with its frequent keys dealt over several tasks.

    ``left`` is read twice, its keys alone the first time: a written table or a scan.  ``right``
    has few rows per key; those of a frequent key are repeated once per part.
    """
    counts = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    total = left.agg(F.count(F.lit(1))).scalar()
    hot = counts.where((F.col("_n") > total * HOT_SHARE) & (F.col("_n") > 1000))
    parts = F.ceil(F.col("_n") / F.greatest(total * HOT_SHARE, F.lit(1000))).cast("int")
    hot = F.broadcast(hot.select(*keys, parts.alias("_parts")))  # at most 1,000 rows
    dealt = left.join(hot, keys, "left").withColumn("_part", F.coalesce(F.pmod(salt, F.col("_parts")), F.lit(0)).cast("int"))
    repeated = right.join(hot, keys, "left").withColumn(
        "_part", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_parts") - 1, F.lit(0))))
    )
    return dealt.drop("_parts").join(repeated.drop("_parts"), [*keys, "_part"], how).drop("_part")


def dealt_by(df: DataFrame, scan: DataFrame, *keys: str, part_bytes: int = 2 * 1024 * 1024) -> DataFrame:
    """Deal ``df`` by ``keys`` where the configured shuffle partitions would hold more than so many bytes of ``scan`` each.

    What a task sorts or counts then stays the same however large the scan is.  The number follows from
    file sizes; while the configured one is enough, ``df`` is returned as it is.
    """
    parts = -(-estimated_bytes(scan) // part_bytes)
    if parts <= int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        return df
    return df.repartition(parts, *keys)


#: Bytes of a scan's files that a task of a spread scan takes at most, about.
SPREAD_BYTES = 32 * 1024 * 1024


def spread(scan: DataFrame) -> DataFrame:
    """Spread a small scan over all cores; a scan with enough splits is returned as it is.

    A small file is often one row group, hence one task, however many byte ranges Spark cuts it
    into and however heavy the row-local work on it.  Files and splits are known at plan time, so
    at scale this adds no shuffle.  A few large files give tasks of a bounded size, not one per core.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    splits = scan._jdf.queryExecution().toRdd().getNumPartitions()
    if splits >= 4 * cores or min(splits, len(scan._jdf.inputFiles())) >= cores:
        return scan
    return scan.repartition(max(cores, -(-estimated_bytes(scan) // SPREAD_BYTES)))
