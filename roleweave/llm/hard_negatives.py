"""Hard negatives by cover trees over norm-augmented candidates, exact.

One more coordinate brings all candidates to one length, so that the largest inner product is the
smallest angle.  Candidates are dealt to the nearest of a bounded number of pivots, the top level of
the tree; a task builds the levels below for one part of a pivot's cell.  At every level a node's
children are a farthest-first net of its points (the node's own centre first), each with the covering
angle that it reaches.  An anchor at angle t from a centre of covering angle r meets inner products
between cos(t+r) and cos(t-r) of both lengths, which skips nodes outside all of its windows.  The
descent is best first, in rounds for many anchors at once, and leaves are verified in integers.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roleweave.llm.storage import stage

#: Inner products stay exact in double precision below this.
_EXACT = 2.0**53
#: Added to covering angles: rounding of angles near zero is below it.
_SLACK = 1e-6


@dataclass(frozen=True)
class Settings:
    """``positives`` per anchor, ``negatives`` per positive, window as hundredths of the positive's score.

    ``every``: anchors are the rows whose vec_id it divides.  There are ``cells`` pivots or, in large
    tables, one for ``block`` rows, at most ``most_cells``; cells of more rows than a block come in
    parts.  ``chunk`` anchors visit a part at once.  ``leaf`` and ``fanout`` shape the trees.
    """

    positives: int = 5
    negatives: int = 3
    low: int = 50
    high: int = 95
    every: int = 50
    cells: int = 16
    most_cells: int = 4096
    block: int = 16_384
    least_block: int = 512
    chunk: int = 4096
    batch: int = 256
    leaf: int = 128
    fanout: int = 16


def _lift(vectors: np.ndarray, longest: float) -> np.ndarray:
    """Vectors with the coordinate that brings each to the length ``longest``."""
    rest = np.sqrt(np.maximum(longest * longest - (vectors * vectors).sum(1), 0.0))
    return np.concatenate([vectors, rest[:, None]], 1)


def _angle(chord: np.ndarray, longest: float) -> np.ndarray:
    return 2 * np.arcsin(np.minimum(1.0, chord / (2 * longest))) + _SLACK


def _range(cosine: np.ndarray, covering: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest inner product below a node, for anchors whose length times the longest is ``reach``."""
    at = np.arccos(np.clip(cosine, -1.0, 1.0))
    low, high = np.cos(np.minimum(at + covering, np.pi)), np.cos(np.maximum(at - covering, 0.0))
    return reach * low - 1e-3, reach * high + 1e-3


class CoverTree:
    """Nodes in arrays: rows ``start`` to ``end``, centre, covering angle, range of labels, first and last child."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, longest: float, leaf: int, fanout: int):
        self.longest = longest
        lifted = _lift(vectors, longest)
        order = np.arange(len(ids))
        centre = lifted[0]
        todo = [(0, len(ids), centre, float(np.sqrt(((lifted - centre) ** 2).sum(1).max())))]
        nodes, children, at = [], [], 0
        while at < len(todo):
            start, end, centre, radius = todo[at]
            at += 1
            nodes.append((start, end, centre, radius))
            if end - start <= leaf or radius == 0.0:
                children.append((0, 0))
                continue
            points = lifted[start:end]
            near = ((points - centre) ** 2).sum(1)
            owner, centres = np.zeros(end - start, np.int32), [centre]
            while len(centres) < fanout:
                far = int(near.argmax())
                if near[far] * 4 <= radius * radius:
                    break
                centres.append(points[far].copy())
                new = ((points - centres[-1]) ** 2).sum(1)
                closer = new < near
                owner[closer] = len(centres) - 1
                near[closer] = new[closer]
            by = np.argsort(owner, kind="stable")
            order[start:end], lifted[start:end] = order[start:end][by], points[by]
            owner, near = owner[by], near[by]
            edges = np.searchsorted(owner, np.arange(len(centres) + 1))
            first = len(todo)
            for j, c in enumerate(centres):
                if edges[j + 1] > edges[j]:
                    todo.append((start + int(edges[j]), start + int(edges[j + 1]), c, float(np.sqrt(near[edges[j] : edges[j + 1]].max()))))
            children.append((first, len(todo)))
        self.ids, self.labels, self.vectors = ids[order], labels[order], vectors[order]
        self.start = np.array([n[0] for n in nodes])
        self.end = np.array([n[1] for n in nodes])
        self.centre = np.array([n[2] for n in nodes])[:, :-1]
        self.covering = _angle(np.array([n[3] for n in nodes]), longest)
        self.children = np.array(children)
        self.least = np.array([self.labels[s:e].min() for s, e in zip(self.start, self.end)])
        self.most = np.array([self.labels[s:e].max() for s, e in zip(self.start, self.end)])


@dataclass
class Search:
    """The best ``k`` of every anchor in each of its windows, over all trees it is shown.

    ``low`` and ``high`` hold a row per anchor and a column per window, both ends included; ``same``
    asks for the anchor's own label, else for other ones.  The anchor itself is no candidate.
    """

    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    low: np.ndarray
    high: np.ndarray
    k: int
    same: bool
    verified: int = 0
    found: list = field(default_factory=list)

    def __post_init__(self):
        self.length = np.sqrt((self.vectors * self.vectors).sum(1))
        self.worst = np.array(self.low, np.float64)  # what a candidate has to reach at least
        empty = np.zeros(0, np.int64)
        self.found = [(empty, empty, np.zeros(0)) for _ in range(self.low.shape[1])]

    def _bounds(self, tree: CoverTree, who: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For pairs of anchor and node: whether a window asks for it, and its priority."""
        dots = np.einsum("ij,ij->i", self.vectors[who], tree.centre[nodes])
        reach = self.length[who] * tree.longest
        low, high = _range(dots / np.where(reach > 0, reach, 1.0), tree.covering[nodes], reach)
        open_ = (high[:, None] >= self.worst[who]) & (low[:, None] <= self.high[who])
        mine = self.labels[who]
        if self.same:
            labels = (tree.least[nodes] <= mine) & (mine <= tree.most[nodes])
        else:
            labels = (tree.least[nodes] != mine) | (tree.most[nodes] != mine)
        priority = np.where(open_, np.minimum(high[:, None], self.high[who]), -np.inf).max(1)
        return open_.any(1) & labels, priority

    def visit(self, tree: CoverTree) -> None:
        """Descend from the root: each round opens every anchor's best nodes, twice as many as the round before."""
        anchors = len(self.ids)
        priority = np.full((anchors, len(tree.start)), -np.inf)
        who = np.arange(anchors)
        wanted, value = self._bounds(tree, who, np.zeros(anchors, np.int64))
        priority[who[wanted], 0] = value[wanted]
        width = 4
        while True:
            who = np.flatnonzero(priority.max(1) > -np.inf)
            if not len(who):
                return
            take = min(width, priority.shape[1])
            best = np.argpartition(-priority[who], take - 1, 1)[:, :take]
            pair_who, pair_node = np.repeat(who, take), best.ravel()
            known = priority[pair_who, pair_node] > -np.inf
            pair_who, pair_node = pair_who[known], pair_node[known]
            priority[pair_who, pair_node] = -np.inf
            wanted, _ = self._bounds(tree, pair_who, pair_node)  # results since then may rule it out
            pair_who, pair_node = pair_who[wanted], pair_node[wanted]
            first, last = tree.children[pair_node].T
            inner = last > first
            self._verify(tree, pair_who[~inner], pair_node[~inner])
            counts = (last - first)[inner]
            down_who = np.repeat(pair_who[inner], counts)
            down = np.repeat(first[inner] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
            wanted, value = self._bounds(tree, down_who, down)
            priority[down_who[wanted], down[wanted]] = value[wanted]
            width *= 2

    def _verify(self, tree: CoverTree, who: np.ndarray, nodes: np.ndarray) -> None:
        by = np.argsort(nodes, kind="stable")
        who, nodes = who[by], nodes[by]
        cuts = np.flatnonzero(np.diff(nodes)) + 1
        parts: list[list] = [[f] for f in self.found]
        for group in np.split(np.arange(len(nodes)), cuts) if len(nodes) else []:
            a, node = who[group], nodes[group[0]]
            for start in range(tree.start[node], tree.end[node], 4096):  # a leaf of equal vectors has any size
                rows = slice(start, min(start + 4096, tree.end[node]))
                scores = self.vectors[a] @ tree.vectors[rows].T  # whole numbers below 2**53: exact
                fits = (tree.labels[rows][None, :] == self.labels[a][:, None]) == self.same
                fits &= tree.ids[rows][None, :] != self.ids[a][:, None]
                self.verified += scores.size
                for j, part in enumerate(parts):
                    i, c = np.nonzero(fits & (scores >= self.worst[a, j][:, None]) & (scores <= self.high[a, j][:, None]))
                    if len(i):
                        part.append((a[i], tree.ids[rows][c], scores[i, c]))
        for j, part in enumerate(parts):
            if len(part) > 1:
                self._keep(j, *(np.concatenate([p[x] for p in part]) for x in range(3)))

    def _keep(self, j: int, who: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        by = np.lexsort((ids, -scores, who))
        who, ids, scores = who[by], ids[by], scores[by]
        place = np.arange(len(who)) - np.searchsorted(who, who)
        best = place < self.k
        self.found[j] = who[best], ids[best], scores[best]
        full = place == self.k - 1
        self.worst[who[full], j] = scores[full]


def candidates(vectors: DataFrame) -> DataFrame:
    """Rows that take part: vec_id, label and whole-number components ``x``; one row per vec_id."""
    fine = F.forall("embedding", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    label = F.col("label").cast("long")
    rows = vectors.select("vec_id", "label", "embedding").filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & fine)
    rows = rows.select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label).alias("label"),
        F.transform("embedding", lambda x: F.floor(x.cast("double") * 256)).alias("x"),
    )
    return rows.groupBy("vec_id").agg(F.min(F.struct("label", "x")).alias("row")).select("vec_id", "row.label", "row.x")


def _matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), width)


def _by_width(batch: pa.RecordBatch) -> list[tuple[int, pa.RecordBatch]]:
    widths = np.asarray(batch.column("x").value_lengths())
    return [(int(w), batch.filter(pa.array(widths == w))) for w in np.unique(widths)]


def _place(points: DataFrame, pivots: dict[int, np.ndarray], longest: float) -> DataFrame:
    """Each point's cell (its nearest pivot of the same width) and its angle from the pivot."""
    lifted = {w: _lift(p, longest) for w, p in pivots.items()}

    def deal(batches):
        for batch in batches:
            for width, rows in _by_width(batch):
                x = _lift(_matrix(rows.column("x"), width), longest)
                centres = lifted[width]
                cell = (x @ centres.T).argmax(1)
                angle = _angle(np.sqrt(((x - centres[cell]) ** 2).sum(1)), longest)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(cell), width), pa.int32()), pa.array(cell, pa.int32()), pa.array(angle), *rows.columns],
                    names=["width", "cell", "angle", *rows.schema.names],
                )

    return points.mapInArrow(deal, "width int, cell int, angle double, vec_id long, label long, x array<long>")


class Index:
    """Candidates dealt to cells, with the cells' pivots, covering angles, label ranges and parts."""

    def __init__(self, points: DataFrame, settings: Settings):
        self.s = settings
        square = F.aggregate("x", F.lit(0.0), lambda t, v: t + v.cast("double") * v.cast("double"))
        largest = F.max(square).alias("largest")
        totals = points.groupBy(F.size("x").alias("width")).agg(largest, F.count(F.lit(1)).alias("n")).collect()  # a row per width
        if any(r["largest"] >= _EXACT for r in totals):
            raise ArithmeticError("inner products of these vectors leave the range of exact whole numbers")
        self.longest = max([1.0, *(math.sqrt(r["largest"]) for r in totals)])
        self.n = sum(r["n"] for r in totals)
        self.block = min(settings.block, max(settings.least_block, math.ceil(self.n / settings.cells)))
        self.cells: dict[int, list] = {}
        pivots: dict[int, np.ndarray] = {}
        for r in totals:
            number = min(settings.most_cells, max(settings.cells, math.ceil(r["n"] / settings.block)))
            rows = points.filter(F.size("x") == r["width"]).orderBy(F.xxhash64("vec_id"), "vec_id").limit(number).select("x").collect()
            distinct = sorted({tuple(p["x"]) for p in rows})
            pivots[r["width"]] = np.array(distinct, np.float64).reshape(len(distinct), r["width"])
        self.pivots = pivots
        self.placed = stage(_place(points, pivots, self.longest), "placed")
        seen = self.placed.groupBy("width", "cell").agg(
            F.count(F.lit(1)).alias("n"), F.max("angle").alias("angle"), F.min("label").alias("least"), F.max("label").alias("most")
        )
        for c in sorted(seen.collect(), key=lambda c: (c["width"], c["cell"])):  # at most most_cells rows a width
            self.cells.setdefault(c["width"], []).append((c["cell"], c["angle"], c["least"], c["most"], max(1, math.ceil(c["n"] / self.block))))

    def visits(self, anchors: DataFrame, chunks: int, same: bool) -> DataFrame:
        """Anchors with the cell parts that may hold what they ask for."""
        pivots, cells, longest = self.pivots, self.cells, self.longest
        names = ["vec_id", "label", "x", "low", "high"]

        def route(batches):
            for batch in batches:
                for width, rows in _by_width(batch):
                    x, label = _matrix(rows.column("x"), width), rows.column("label").to_numpy()
                    windows = [_matrix(rows.column(c), len(rows.column(c)[0])) for c in ("low", "high")]
                    chunk = rows.column("chunk").to_numpy()
                    reach = np.sqrt((x * x).sum(1)) * longest
                    for cell, angle, least, most, parts in cells[width]:
                        low, high = _range(x @ pivots[width][cell] / np.where(reach > 0, reach, 1.0), angle, reach)
                        goes = ((high[:, None] >= windows[0]) & (low[:, None] <= windows[1])).any(1)
                        goes &= ((least <= label) & (label <= most)) if same else ((least != label) | (most != label))
                        some = rows.filter(pa.array(goes)).select(names)
                        for part in range(parts):
                            keys = [np.full(some.num_rows, v, np.int32) for v in (width, cell, part)]
                            yield pa.RecordBatch.from_arrays(
                                [*map(pa.array, keys), pa.array(chunk[goes]), *some.columns], names=["width", "cell", "part", "chunk", *names]
                            )

        dealt = anchors.withColumn("chunk", F.pmod(F.xxhash64("vec_id", F.lit("chunk")), F.lit(chunks)).cast("int"))
        schema = "width int, cell int, part int, chunk int, vec_id long, label long, x array<long>, low array<double>, high array<double>"
        return dealt.select(*names, "chunk").mapInArrow(route, schema)

    def best(self, anchors: DataFrame, k: int, same: bool, count: int) -> DataFrame:
        """Per anchor (vec_id, label, x) and window (``low``, ``high``): its ``k`` best as anchor_id, window, rank, vec_id, score."""
        s, longest = self.s, self.longest
        chunks = max(1, math.ceil(count / s.chunk))
        parts = [(w, c[0], c[4]) for w, cs in self.cells.items() for c in cs]  # at most most_cells a width
        parts = F.broadcast(self.placed.sparkSession.createDataFrame(parts, "width int, cell int, parts int"))
        keys = ["width", "cell", "part", "chunk"]
        part = F.pmod(F.xxhash64("vec_id", F.lit("part")), F.col("parts")).cast("int")
        points = self.placed.join(parts, ["width", "cell"]).withColumn("part", part).drop("parts", "angle")
        points = points.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))

        def mine(points: pa.Table, asks: pa.Table) -> pa.Table:
            out: list[tuple] = []
            if points.num_rows and asks.num_rows:
                width = points.column("width")[0].as_py()
                ids, labels, x = points.column("vec_id").to_numpy(), points.column("label").to_numpy(), _matrix(points.column("x"), width)
                by = np.argsort(ids)
                tree = CoverTree(ids[by], labels[by], x[by], longest, s.leaf, s.fanout)
                for at in range(0, asks.num_rows, s.batch):
                    some = asks.slice(at, s.batch)
                    windows = [_matrix(some.column(c), len(some.column(c)[0])) for c in ("low", "high")]
                    search = Search(some.column("vec_id").to_numpy(), some.column("label").to_numpy(), _matrix(some.column("x"), width), *windows, k, same)
                    search.visit(tree)
                    out += [(search.ids[w], np.full(len(w), j, np.int32), i, v.astype(np.int64)) for j, (w, i, v) in enumerate(search.found)]
            columns = [np.concatenate([o[x] for o in out]) if out else np.zeros(0, np.int64) for x in range(4)]
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64()]
            return pa.table([pa.array(c, t) for c, t in zip(columns, types)], names=["anchor_id", "window", "vec_id", "score"])

        asks = self.visits(anchors, chunks, same)
        found = points.groupBy(*keys).cogroup(asks.groupBy(*keys)).applyInArrow(mine, "anchor_id long, window int, vec_id long, score long")
        order = Window.partitionBy("anchor_id", "window").orderBy(F.desc("score"), "vec_id")
        return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def mine(vectors: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Per anchor and positive its hardest negatives: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Rows with a null vec_id, label or vector, or a null or non-finite component, take no part; an empty
    vector has inner product 0 with other empty ones.  Vectors meet those of their own length only.  Of
    rows that share a vec_id the smallest label, then the smallest vector counts.  Ties go to the smaller
    vec_id.  A positive without negatives in its window gives no rows; neither does an empty table.
    Other columns are ignored.  Components so large that an inner product could leave the exact whole
    numbers of double precision raise ArithmeticError.
    """
    s = settings
    points = stage(candidates(vectors), "candidates")
    index = Index(points, s)
    if not index.cells:
        return vectors.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    anchors = points.filter(F.col("vec_id") % s.every == 0)
    count = anchors.count()
    edge = lambda v: F.array(F.lit(v))
    open_ = anchors.withColumns({"low": edge(float("-inf")), "high": edge(float("inf"))})
    positives = stage(index.best(open_, s.positives, True, count).select("anchor_id", "rank", "vec_id", "score"), "positives")

    # Whole numbers n with low*p <= 100*n <= high*p; the windows of an anchor number as many as positives are asked for.
    floor = lambda of: F.expr(f"({of} - pmod({of}, 100)) div 100")
    low, high = -floor(f"(-score * {s.low})"), floor(f"(score * {s.high})")
    ends = positives.select("anchor_id", "rank", low.cast("double").alias("low"), high.cast("double").alias("high"))
    window = F.sort_array(F.collect_list(F.struct("rank", "low", "high"))).alias("windows")
    ends = ends.groupBy("anchor_id").agg(window)
    pad = lambda name, v: F.transform(  # noqa: E731 - every anchor gets as many windows; those beyond its positives are empty
        F.sequence(F.lit(0), F.lit(s.positives - 1)), lambda i: F.coalesce(F.get(F.col(f"windows.{name}"), i), F.lit(v))
    )
    asking = anchors.join(ends.withColumnRenamed("anchor_id", "vec_id"), "vec_id").select(
        "vec_id", "label", "x", pad("low", float("inf")).alias("low"), pad("high", float("-inf")).alias("high")
    )
    found = index.best(asking, s.negatives, False, count)
    positives = positives.select("anchor_id", (F.col("rank") - 1).alias("window"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return found.join(positives, ["anchor_id", "window"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )


ORACLE = """
WITH fit AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda c: floor(256 * CAST(c AS DOUBLE))) AS x
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS vec_id, a.label = b.label AS same, CAST(list_inner_product(a.x, b.x) AS BIGINT) AS score
  FROM fit a JOIN fit b ON a.vec_id <> b.vec_id
  WHERE a.vec_id % 50 = 0
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER w AS INT) AS rank, n.vec_id AS negative_id, p.positive_score, n.score AS negative_score
FROM positives p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.same
  AND 50 * p.positive_score <= 100 * n.score AND 100 * n.score <= 95 * p.positive_score
WINDOW w AS (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.vec_id)
QUALIFY row_number() OVER w <= 3
"""
