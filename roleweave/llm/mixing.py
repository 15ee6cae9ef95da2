"""Temperature mixing of sources: weights are token shares to a power, found by bisection, realised in passes.

A power below 1 flattens the shares.  It is the largest that meets a target entropy, raised as far as
a limit on repetition asks.  A source's quota is its weight of the budget: so many whole passes over
its documents and a part of one more, for which blocks of documents are permuted and taken until the
quota is used up.  Every pass has a permutation of its own, which ``positions`` writes out.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roleweave.llm.skew import salted_join
from roleweave.llm.storage import stage
from roleweave.llm.words import lower_ascii

#: Up to this many sources (below 300 bytes each) go to all tasks; beyond it documents meet them by a shuffle.
BROADCAST_SOURCES = 100_000
_GRID = 63
_TURNS = 5


@dataclass(frozen=True)
class Settings:
    """``entropy``: least entropy of the weights, as a share of that of equal weights.

    ``passes``: a source is gone through no more often than this.  ``budget``: tokens to draw; None
    is the least that goes through every source once, so no document is left out.
    """

    entropy: float = 0.95
    passes: float = 4.0
    budget: int | None = None
    seed: int = 17


def n_tokens(text: Column) -> Column:
    """Words between ASCII blanks."""
    return F.size(F.array_remove(F.split(lower_ascii(text), r"[\x20\x09-\x0D]+"), "")).cast("long")


def _source(docs: DataFrame) -> Column:
    return F.when(F.col("source").isNull(), F.lit("\u0000")).otherwise(F.col("source").cast("string"))


def source_sizes(narrow: DataFrame) -> DataFrame:
    """Per ``_source``: its tokens and documents, from one row per document with its tokens ``n``."""
    return narrow.groupBy("_source").agg(F.sum("n").alias("tokens"), F.count(F.lit(1)).alias("docs"))


def _moments(sizes: DataFrame, total: int, powers: list[float]) -> dict[float, tuple[float, float]]:
    """For each power: the sum of shares to it, and that sum weighted by the shares' logarithms."""
    share = F.col("tokens") / F.lit(float(total))
    aggregates = []
    for p in powers:
        aggregates += [F.sum(F.pow(share, F.lit(p))), F.sum(F.pow(share, F.lit(p)) * F.log(share))]
    row = sizes.filter("tokens > 0").agg(*[a.alias(f"m{i}") for i, a in enumerate(aggregates)]).first()
    return {p: (row[2 * i], row[2 * i + 1]) for i, p in enumerate(powers)}


def _bisect(sizes: DataFrame, total: int, holds, upward: bool) -> float:
    """The end of the range of powers in [0, 1] for which ``holds``; each pass halves it six times.

    ``upward``: it holds from some power upwards, and the smallest is wanted; else the largest.
    """
    low, high = 0.0, 1.0
    for _ in range(_TURNS):
        grid = [low + (high - low) * i / (_GRID + 1) for i in range(1, _GRID + 1)]
        moments = _moments(sizes, total, grid)
        for p in grid:
            if holds(p, *moments[p]) == upward:
                high = p
                break
            low = p
    return high if upward else low


def exponent(sizes: DataFrame, settings: Settings) -> float:
    """The power for the shares; ``sizes`` is the result of ``source_sizes``."""
    some = sizes.filter("tokens > 0")
    total, sources, least, most = some.agg(F.sum("tokens"), F.count(F.lit(1)), F.min("tokens"), F.max("tokens")).first()
    if not sources or sources == 1 or least == most:
        return 1.0
    target = settings.entropy * math.log(sources)

    def even(p: float, z: float, logs: float) -> bool:
        return math.log(z) - p * logs / z >= target

    def within(p: float, z: float, logs: float) -> bool:
        budget = settings.budget or total * z * (most / total) ** (1 - p)
        return budget * (least / total) ** p / z <= settings.passes * least

    ends = _moments(sizes, total, [0.0, 1.0])
    power = 1.0 if even(1.0, *ends[1.0]) else _bisect(sizes, total, even, False)
    if not within(power, *_moments(sizes, total, [power])[power]) and power < 1.0:
        power = max(power, _bisect(sizes, total, within, True)) if within(1.0, *ends[1.0]) else 1.0
    return power


def weights(sizes: DataFrame, settings: Settings) -> DataFrame:
    """Per source: weight, quota in tokens, whole passes, and the tokens of the last part (``rest``).

    A source without tokens has weight 0 and is passed through once if no budget is set.
    """
    power = exponent(sizes, settings)
    some = sizes.filter("tokens > 0")
    total, most = some.agg(F.coalesce(F.sum("tokens"), F.lit(1)), F.max("tokens")).first()
    z = _moments(sizes, total, [power])[power][0] or 1.0
    budget = settings.budget or total * z * ((most or total) / total) ** (1 - power)
    weight = F.when(F.col("tokens") > 0, F.pow(F.col("tokens") / F.lit(float(total)), F.lit(power)) / F.lit(z)).otherwise(F.lit(0.0))
    quota = F.least(weight * F.lit(float(budget)), F.col("tokens") * F.lit(float(settings.passes)))
    once = F.lit(0 if settings.budget else 1)
    whole = F.when(F.col("tokens") > 0, F.floor(F.col("quota") / F.col("tokens") + F.lit(1e-9))).otherwise(once)
    out = sizes.withColumn("weight", weight).withColumn("quota", quota).withColumn("whole", whole.cast("int"))
    rest = F.greatest(F.floor(F.col("quota") - F.col("whole") * F.col("tokens") + F.lit(1e-6)), F.lit(0)).cast("long")
    blocks = F.ceil(F.sqrt(F.col("docs").cast("double"))).cast("long")
    return out.withColumn("rest", rest).withColumn("blocks", blocks).withColumn("power", F.lit(power))


def _nameless(text: Column) -> Column:
    """Stands for a missing doc_id, so that such rows do not go as one."""
    return F.when(F.col("doc_id").isNull(), F.xxhash64(text))


def _block(settings: Settings) -> Column:
    named = F.xxhash64("doc_id", F.lit(settings.seed))
    return F.pmod(F.when(F.col("doc_id").isNull(), F.xxhash64("_nameless", F.lit(settings.seed))).otherwise(named), F.col("blocks"))


def _turn(settings: Settings, epoch: str = "whole") -> Column:
    """The place of a block in a pass, the last one by default."""
    return F.xxhash64("_source", "block", epoch, F.lit(settings.seed))


def _place(settings: Settings) -> Column:
    """The place of a document in its block in the last pass."""
    named = F.xxhash64("doc_id", "whole", F.lit(settings.seed + 1))
    return F.when(F.col("doc_id").isNull(), F.xxhash64("_nameless", "whole", F.lit(settings.seed + 1))).otherwise(named)


def _meet(docs: DataFrame, sources: DataFrame, count: int) -> DataFrame:
    if count <= BROADCAST_SOURCES:
        return docs.join(F.broadcast(sources), "_source")
    return salted_join(docs, sources, ["_source"], F.col("doc_id"))


def mix(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Documents as often as they are drawn: their columns, and weight, epoch (from 0), block.

    The part of the last pass takes blocks in permuted order, and of the block that would go beyond
    the quota the documents in permuted order that fit.  A source's blocks number the root of its
    documents, so neither a block nor a list of blocks gathers a hot source in one task.

    Null is a source like others.  Null, empty and blank texts have no tokens; they go with their
    block.  Rows that share a doc_id go together, rows without one go by their texts.  Columns named like the new ones are replaced; an
    empty table gives none.
    """
    source = docs.drop("weight", "epoch", "block")
    narrow = source.select(_source(docs).alias("_source"), "doc_id", _nameless(F.col("text")).alias("_nameless"), n_tokens(F.col("text")).alias("n"))
    narrow = stage(narrow, "tokens")
    sizes = stage(source_sizes(narrow), "sources")
    plan = stage(weights(sizes, settings), "weights")
    count = plan.count()

    placed = _meet(narrow, plan.select("_source", "blocks", "whole", "rest"), count).filter("rest > 0")
    placed = placed.withColumn("block", _block(settings)).withColumn("turn", _turn(settings))
    blocks = placed.groupBy("_source", "rest", "block", "turn").agg(F.sum("n").alias("n"))
    running = F.sum("n").over(Window.partitionBy("_source").orderBy("turn", "block"))
    blocks = blocks.withColumn("before", running - F.col("n"))
    edge = blocks.filter((F.col("before") <= F.col("rest")) & (F.col("before") + F.col("n") > F.col("rest")))
    edge = edge.groupBy("_source").agg(F.min(F.struct("before", "turn", "block")).alias("edge"))
    edge = stage(edge.select("_source", "edge.turn", "edge.block", "edge.before"), "edges")

    inside = placed.select("_source", "block", "doc_id", "_nameless", "whole", "rest", "n").join(
        F.broadcast(edge) if count <= BROADCAST_SOURCES else edge, ["_source", "block"]
    )
    inside = inside.withColumn("place", _place(settings))
    used = F.sum("n").over(Window.partitionBy("_source", "block").orderBy("place"))
    last = inside.withColumn("used", used + F.col("before")).filter("used <= rest").groupBy("_source").agg(F.max("place").alias("last"))
    limits = plan.join(edge.select("_source", F.col("turn").alias("edge_turn"), F.col("block").alias("edge_block")), "_source", "left").join(
        last, "_source", "left"
    )
    limits = stage(limits, "limits")

    keyed = source.withColumn("_source", _source(docs)).withColumn("_nameless", _nameless(F.col("text")))
    drawn = _meet(keyed, limits.select("_source", "weight", "whole", "rest", "blocks", "edge_turn", "edge_block", "last"), count)
    drawn = drawn.withColumn("block", _block(settings)).withColumn("turn", _turn(settings))
    earlier = (F.col("turn") < F.col("edge_turn")) | ((F.col("turn") == F.col("edge_turn")) & (F.col("block") < F.col("edge_block")))
    partly = (F.col("block") == F.col("edge_block")) & (_place(settings) <= F.col("last"))
    all_fit = F.col("edge_block").isNull()
    more = F.coalesce((F.col("rest") > 0) & (all_fit | earlier | F.coalesce(partly, F.lit(False))), F.lit(False))
    times = F.col("whole") + more.cast("int")
    return drawn.withColumn("_times", times).filter("_times > 0").select(
        *source.columns, "weight", F.explode(F.sequence(F.lit(0), F.col("_times") - 1)).alias("epoch"), "block",
    )


def positions(draws: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``draws`` (doc_id, source, epoch, block) with ``position`` and ``share``: the order in which to read them.

    ``position`` counts a source's draws from 0 without gaps: pass by pass, in each pass its blocks in
    permuted order, in each block the documents in permuted order.  ``share`` is the middle of the
    draw's place among those of its source, between 0 and 1: in the order of share, every stretch holds the
    sources in proportion to their draws.  A source's blocks number the root of its documents, so no
    task holds a whole source.  ``draws`` is read twice; it should be a written table.
    """
    placed = draws.withColumn("_source", _source(draws)).withColumn("_turn", _turn(settings, "epoch"))
    placed = placed.withColumn("_place", F.xxhash64("doc_id", "epoch", F.lit(settings.seed + 1)))
    block = ["_source", "epoch", "_turn", "block"]
    running = F.sum("_n").over(Window.partitionBy("_source").orderBy("epoch", "_turn", "block"))
    starts = placed.groupBy(*block).agg(F.count(F.lit(1)).alias("_n"))
    starts = starts.withColumn("_start", running - F.col("_n")).withColumn("_all", F.sum("_n").over(Window.partitionBy("_source"))).drop("_n")
    inside = F.row_number().over(Window.partitionBy(*block).orderBy("_place", "doc_id")) - 1
    found = placed.withColumn("_inside", inside).join(starts, block).withColumn("position", F.col("_start") + F.col("_inside"))
    share = (F.col("position") + 0.5) / F.col("_all")
    return found.withColumn("share", share).select(*draws.drop("position", "share").columns, "position", "share")


def drawn_documents(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Per draw: doc_id, source, epoch, block, weight of the source, position and share (see ``positions``)."""
    draws = mix(docs.select("doc_id", "source", "text"), settings).select(
        F.col("doc_id").cast("long").alias("doc_id"), "source", "epoch", "block", "weight"
    )
    return positions(stage(draws, "draws"), settings)
