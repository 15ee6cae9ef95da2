"""Balanced label propagation: linked documents move to their neighbours' shards under quotas, in SQL functions only.

Links are star-shaped: documents that share a group are neighbours, so a group of any size costs one
row per document.  Documents start evenly dealt.  In every round each group counts its members per
shard; members move to a shard that holds more of them.  A shard takes no more than the rows that it
gives to the same partner shard plus the room left by its quota.  Documents without neighbours pull nowhere, so they
fill what is left at the end, and shards differ by at most one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roleweave.llm.skew import numbered, salted_join
from roleweave.llm.storage import stage

SHARDS = 40


def _quotas(total: int, shards: int) -> list[int]:
    """Rows per shard; at most one apart."""
    return [total // shards + (j < total % shards) for j in range(shards)]


def _shard_of(rank, quotas: list[int]):
    """The shard of a running number when shards are filled one after the other."""
    ends, end = [], 0
    for q in quotas:
        end += q
        ends.append(end)
    return F.size(F.filter(F.array(*[F.lit(e).cast("long") for e in ends]), lambda e: e <= rank)).cast("int")


def _grants(wanted: dict[tuple[int, int], int], room: list[int]) -> list[tuple[int, int, int]]:
    """How many rows may move between each two shards: what is swapped, then what fits the room."""
    out = []
    free = list(room)
    for (i, j), n in sorted(wanted.items(), key=lambda x: (-x[1], x[0])):
        swap = min(n, wanted.get((j, i), 0))
        more = min(n - swap, free[j])
        free[j] -= more
        if swap + more:
            out.append((i, j, swap + more))
    return out


def _propose(state: DataFrame, room: list[int]) -> DataFrame:
    """Each grouped row with the shard it wants: the one with most of its group that has room or may swap."""
    votes = state.groupBy("group", "shard").agg(F.count(F.lit(1)).alias("votes"))
    votes = votes.withColumn("free", F.element_at(F.array(*[F.lit(r > 0) for r in room]), F.col("shard") + 1))
    ranked = votes.groupBy("group").agg(
        F.max(F.struct("votes", (-F.col("shard")).alias("back"))).alias("best"),
        F.max(F.when(F.col("free"), F.struct("votes", (-F.col("shard")).alias("back")))).alias("open"),
        F.count(F.lit(1)).alias("shards"),
        F.map_from_entries(F.collect_list(F.struct("shard", "votes"))).alias("held"),
    )
    spread = ranked.filter("shards > 1")
    joined = salted_join(state, spread, ["group"], F.col("order"), "left")
    own = F.element_at("held", F.col("shard"))

    def better(target):
        there = target["votes"]
        return (there > own) | ((there == own) & (-target["back"] < F.col("shard")))

    target = F.when(better(F.col("open")), -F.col("open.back")).when(better(F.col("best")), -F.col("best.back"))
    return joined.withColumn("target", target.cast("int")).drop("best", "open", "shards", "held")


def propagate(rows: DataFrame, shards: int, total: int, rounds: int | None = None) -> DataFrame:
    """Move grouped ``rows`` (group, order, shard) together; no shard ends above its quota.

    ``total`` counts all rows, those without a group too.  What a round grants is a table of at most
    shards x shards counts; which rows move is settled by a gapless numbering within each move.
    Rounds go on until no move is granted, at most twice the number of shards unless ``rounds`` says so:
    a group proposes one open shard a round, so it fills about one shard a round.
    """
    quotas = _quotas(total, shards)
    state = stage(rows, "shards")
    for _ in range(2 * shards if rounds is None else rounds):
        sizes = {r["shard"]: r["n"] for r in state.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}
        room = [q - sizes.get(j, 0) for j, q in enumerate(quotas)]
        proposed = stage(_propose(state, room), "moves")
        moving = proposed.filter("target is not null")
        asked = moving.groupBy("shard", "target").agg(F.count(F.lit(1)).alias("n")).collect()
        grants = _grants({(r["shard"], r["target"]): r["n"] for r in asked}, room)
        if not grants:
            break
        table = state.sparkSession.createDataFrame(grants, "shard int, target int, granted long")
        placed = numbered(moving, ["shard", "target"], ["order"], sum(r["n"] for r in asked), "place")
        moved = placed.join(F.broadcast(table), ["shard", "target"], "left").withColumn(
            "shard", F.when(F.col("place") < F.col("granted"), F.col("target")).otherwise(F.col("shard"))
        )
        still = proposed.filter("target is null")
        state = stage(still.select(*state.columns).union(moved.select(*state.columns)), "shards")
    return state


def shard(docs: DataFrame, shards: int = SHARDS, rounds: int | None = None, also: list[str] | None = None) -> DataFrame:
    """Documents in shards 0 to ``shards`` - 1, equal texts together as far as even sizes allow.

    Columns doc_id, size (UTF-8 bytes of the text and 16), text_crc32, law ("rows": shards differ by
    at most one document), shard, slot (from 0 without gaps in each shard), grown_shard (null under
    this law), and those of ``also``.  Null texts have no bytes and no neighbours; empty texts are
    equal to each other.  Null and repeated doc_ids are rows like others.  A group larger than a
    shard fills some and ends in another.  An empty table gives none; fewer rows than shards leave
    shards empty.
    """
    text = F.col("text").cast("string")
    raw = F.coalesce(text.cast("binary"), F.lit(b""))
    base = docs.select(
        F.col("doc_id").cast("long"),
        *(also or []),
        (F.octet_length(raw) + 16).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"),
        F.when(text.isNotNull(), F.sha2(raw, 256)).alias("group"),
    )
    base = stage(base.withColumn("order", F.xxhash64("doc_id", "group", "size", *(also or []))), "documents")
    total = base.count()
    quotas = _quotas(total, shards)
    ranked = stage(numbered(base, [], ["order", "doc_id"], total, "rank"), "ranked").withColumn("shard", _shard_of(F.col("rank"), quotas)).drop("rank")

    counts = ranked.filter("group is not null").groupBy("group").agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
    marked = stage(salted_join(ranked, counts, ["group"], F.col("order"), "left").select(*ranked.columns, "members"), "marked")
    linked = propagate(marked.filter("members is not null").drop("members"), shards, total, rounds)

    taken = {r["shard"]: r["n"] for r in linked.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}
    left = [q - taken.get(j, 0) for j, q in enumerate(quotas)]
    idle = numbered(marked.filter("members is null").drop("members", "shard"), [], ["order", "doc_id"], total, "rank")
    idle = idle.withColumn("shard", _shard_of(F.col("rank"), left)).drop("rank")
    placed = stage(linked.select(*ranked.columns).union(idle.select(*ranked.columns)), "placed")
    out = numbered(placed, ["shard"], ["order", "doc_id"], total, "slot")
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int"),
        F.col("slot").cast("long"), F.lit(None).cast("int").alias("grown_shard"), *(also or []),
    )
