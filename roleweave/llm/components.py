"""Connected components of a link table by alternating star contraction, on Spark throughout."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roleweave.llm.skew import salted_join
from roleweave.llm.storage import stage


def _stars(links: DataFrame, large: bool) -> DataFrame:
    """One contraction: each node's larger (or smaller) neighbours move to its smallest neighbour."""
    pairs = links.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        pairs = pairs.union(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
    else:
        pairs = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("least"))
    joined = salted_join(pairs, least, ["u"], F.col("v"))
    if large:
        out = joined.filter("v > u").select(F.col("least").alias("a"), F.col("v").alias("b"))
    else:
        out = joined.select(F.col("least").alias("a"), F.col("v").alias("b")).union(
            least.select(F.col("least").alias("a"), F.col("u").alias("b"))
        )
    return out.filter("a <> b").distinct()


def _fingerprint(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())


def components(links: DataFrame) -> DataFrame:
    """Columns ``node`` and ``component`` (smallest node reachable) for the nodes of links ``a``-``b``.

    A hub with a third of all links is reduced map-side for its minimum and split for the join back.
    Links with a null end or from a node to itself are ignored; an empty table gives an empty result.
    """
    links = stage(links.select("a", "b").filter("a <> b").distinct(), "links")
    seen = _fingerprint(links)
    while seen[0]:
        links = stage(_stars(stage(_stars(links, True), "links"), False), "links")
        now = _fingerprint(links)
        if now == seen:
            break
        seen = now
    members = links.select(F.col("b").alias("node"), F.col("a").alias("component"))
    roots = links.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
    return stage(members.union(roots), "components")
