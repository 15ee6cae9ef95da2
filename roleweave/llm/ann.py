"""Approximate nearest neighbours by collision counting over single-projection sorted arrays.

Every vector is projected on random directions; per direction a sorted array of the projections is
the index.  A query opens a window around its own projection in every array and widens all windows
by steps (virtual rehashing) until enough vectors lie in most of its windows.  Those are verified
by the exact inner product on the original vectors.

Largest inner product becomes smallest distance by one more coordinate that brings all vectors to
one length, while queries are scaled to it.  Vectors are indexed in blocks of bounded size and
queries come in chunks of bounded size; every chunk visits every block.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roleweave.llm.storage import stage


@dataclass(frozen=True)
class Settings:
    """``share`` of a block is verified at least; a vector is a candidate from ``collisions`` of ``projections`` on.

    ``first`` is the half width of the first windows in standard deviations, ``widen`` the factor of
    every further step.  There are ``blocks`` blocks as long as they hold ``least_block`` to ``block``
    vectors; every block gives each query its best, so larger ones keep that output small.  On 64 random directions recall is about 0.97; it rises with ``share``.
    """

    neighbours: int = 20
    projections: int = 64
    collisions: int = 54
    share: float = 0.2
    first: float = 1.4
    widen: float = 1.2
    block: int = 32_768
    least_block: int = 2048
    blocks: int = 16
    chunk: int = 4096
    seed: int = 29


def usable(vector: Column) -> Column:
    """True for vectors of finite components that are not all zero."""
    fine = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.coalesce(fine & F.exists(vector, lambda x: x != 0), F.lit(False))


class Block:
    """Sorted projections of the vectors of one block, and their search."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, longest: float, settings: Settings):
        self.ids, self.vectors, self.s = ids, vectors, settings
        self.longest = longest
        lengths = (vectors * vectors).sum(1)
        lifted = np.concatenate([vectors, np.sqrt(np.maximum(longest * longest - lengths, 0))[:, None]], 1)
        rng = np.random.default_rng(settings.seed)
        self.directions = rng.normal(size=(lifted.shape[1], settings.projections))
        projected = lifted @ self.directions
        order = np.argsort(projected, 0, kind="stable")
        self.sorted = np.take_along_axis(projected, order, 0)
        self.ranks = np.empty(order.shape, np.int32)
        np.put_along_axis(self.ranks, order, np.arange(len(ids), dtype=np.int32)[:, None].repeat(order.shape[1], 1), 0)
        self.kind = np.uint16 if len(ids) < 1 << 15 else np.uint32
        self.ranks = np.ascontiguousarray(self.ranks.T).astype(self.kind)
        self.unit = longest

    def counts(self, projected: np.ndarray, radius: np.ndarray) -> np.ndarray:
        """For each query and vector, in how many arrays the vector lies in the query's window."""
        out = np.zeros((len(projected), len(self.ids)), np.uint8)
        for i in range(self.s.projections):
            low = np.searchsorted(self.sorted[:, i], projected[:, i] - radius, "left")
            high = np.searchsorted(self.sorted[:, i], projected[:, i] + radius, "right")
            below = self.ranks[i][None, :] - low.astype(self.kind)[:, None]  # wraps around left of the window
            out += below < (high - low).astype(self.kind)[:, None]
        return out

    def search(self, query_ids: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query number, vector id and score of each query's best verified vectors in this block."""
        s, n = self.s, len(self.ids)
        scaled = queries * (self.longest / np.sqrt((queries * queries).sum(1)))[:, None]
        projected = scaled @ self.directions[:-1]
        enough = min(n, s.neighbours + 1 + math.ceil(s.share * n))
        found: list[tuple[int, np.ndarray, np.ndarray]] = []
        open_, radius = np.arange(len(queries)), s.first * self.unit
        while len(open_):
            counts = self.counts(projected[open_], np.full(len(open_), radius))
            near = counts >= s.collisions
            done = near.sum(1) >= enough
            for row in np.flatnonzero(done):
                q = open_[row]
                found.append((q, *self._verify(query_ids[q], queries[q], np.flatnonzero(near[row]))))
            open_ = open_[~done]
            radius *= s.widen
        return (
            np.concatenate([np.full(len(i), q) for q, i, _ in found] or [np.zeros(0, np.int64)]),
            np.concatenate([i for _, i, _ in found] or [np.zeros(0, np.int64)]),
            np.concatenate([v for _, _, v in found] or [np.zeros(0)]),
        )

    def _verify(self, query_id: int, query: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rows = rows[self.ids[rows] != query_id]
        score = (self.vectors[rows] * query).sum(1)  # row by row, so equal vectors score alike
        best = np.lexsort((self.ids[rows], -score))[: self.s.neighbours]
        return self.ids[rows][best], score[best]


def _unique(ids: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One row per id, by id: the smallest vector in component order."""
    order = np.lexsort((*vectors.T[::-1], ids))
    ids, vectors = ids[order], vectors[order]
    first = np.ones(len(ids), bool)
    first[1:] = ids[1:] != ids[:-1]
    return ids[first], vectors[first]


def nearest(points: DataFrame, queries: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """For each query its nearest points found: query_id, rank (from 1), vec_id, score.

    Both tables hold vec_id and embedding.  Nearest is the largest inner product, in double
    precision; ties go to the smaller vec_id.  A point with the query's own vec_id is no candidate;
    with fewer candidates than neighbours all are returned.  Vectors that are null, zero or hold null
    or non-finite components and rows without vec_id take no part; vectors meet those of their own
    length only.  Of rows that share a vec_id the smallest vector counts.  Empty tables give none.
    """
    columns = [F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding")]
    fit = lambda t: t.select(*columns).filter(usable(F.col("embedding")) & F.col("vec_id").isNotNull())
    points, queries = stage(fit(points), "points"), stage(fit(queries), "queries")
    square = F.aggregate("embedding", F.lit(0.0), lambda t, x: t + x.cast("double") * x.cast("double"))
    longest, n = points.agg(F.max(F.sqrt(square)), F.count(F.lit(1))).first()
    m = queries.count()
    size = min(settings.block, max(settings.least_block, math.ceil(n / settings.blocks)))
    blocks, chunks = max(1, math.ceil(n / size)), max(1, math.ceil(m / settings.chunk))
    place = lambda count, name: F.pmod(F.xxhash64("vec_id", F.lit(name)), F.lit(count)).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    dims = F.size("embedding").alias("dims")
    sides = points.select(place(blocks, "block").alias("block"), every(chunks).alias("chunk"), dims, F.lit(False).alias("asks"), "vec_id", "embedding").union(
        queries.select(every(blocks).alias("block"), place(chunks, "chunk").alias("chunk"), dims, F.lit(True).alias("asks"), "vec_id", "embedding")
    )

    def visit(table: pa.Table) -> pa.Table:
        width = table.column("dims")[0].as_py()
        vectors = table.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
        ids, asks = table.column("vec_id").to_numpy(), table.column("asks").to_numpy()
        query_ids, asked = _unique(ids[asks], vectors[asks])
        ids, vectors = _unique(ids[~asks], vectors[~asks])
        number, found, score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        if len(ids) and len(query_ids):
            block = Block(ids, vectors, longest, settings)
            parts = [block.search(query_ids[at : at + 256], asked[at : at + 256]) for at in range(0, len(query_ids), 256)]
            number = np.concatenate([p[0] + 256 * i for i, p in enumerate(parts)]).astype(np.int64)
            found, score = (np.concatenate([p[k] for p in parts]) for k in (1, 2))
        return pa.table({"query_id": pa.array(query_ids[number], pa.int64()), "vec_id": pa.array(found, pa.int64()), "score": pa.array(score, pa.float64())})

    best = sides.groupBy("block", "chunk", "dims").applyInArrow(visit, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= settings.neighbours)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def search_table(vectors: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Every row as a point; rows with a vec_id divisible by 20 as queries."""
    return nearest(vectors, vectors.filter(F.col("vec_id") % 20 == 0), settings)
