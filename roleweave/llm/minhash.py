"""Near-duplicate documents: b-bit min-hash signatures joined under a Hamming radius by several indexes.

A document's signature holds one 16-bit symbol per permutation of its word shingles; symbols of two
documents agree as often as their sets overlap.  The signature is cut into chunks.  By the pigeonhole
principle two signatures within the radius agree in some chunk but for ``errors`` symbols, so one
index per chunk and choice of left-out symbols finds every such pair.  Pairs are then confirmed on
the full shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roleweave.llm import vectors
from roleweave.llm.components import components
from roleweave.llm.skew import salted_join
from roleweave.llm.storage import stage


@dataclass(frozen=True)
class Settings:
    """Shingle size, similarity (a fraction), and the cut of the signature.

    The radius is ``chunks * (errors + 1) - 1`` symbols of ``chunks * symbols``.  With 66 symbols and
    radius 21 a pair of similarity 0.85 lies outside with a chance of about 1 in 5,000, one of 0.9
    with less than 1 in 10 million.
    """

    words: int = 5
    similar: tuple[int, int] = (85, 100)
    chunks: int = 11
    symbols: int = 6
    errors: int = 1
    block: int = 1024

    @property
    def length(self) -> int:
        return self.chunks * self.symbols

    @property
    def radius(self) -> int:
        return self.chunks * (self.errors + 1) - 1

    def masks(self) -> list[np.ndarray]:
        """The symbol positions that each index compares, in index order."""
        kept = list(combinations(range(self.symbols), self.symbols - self.errors))
        return [c * self.symbols + np.array(k) for c in range(self.chunks) for k in kept]


def _rounds(n: int) -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(20240607).integers(0, 1 << 63, (2, n), dtype=np.uint64)
    return draw[0] * np.uint64(2) + np.uint64(1), draw[1]


def signatures(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Per row of ``doc_id`` and ``text``: n_shingles, a 128-bit digest of the set (s1, s2), the signature.

    Null and blank texts have no shingles and a null signature.
    """
    words, length = settings.words, settings.length

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factor, shift = _rounds(length)
        for batch in vectors.slices(batches, "text"):
            values, offsets = vectors.distinct_shingles(*vectors.text_buffer(batch.column("text")), words)
            n = np.diff(offsets)
            some = np.flatnonzero(n)
            sums, sig = np.zeros((2, len(n)), np.uint64), np.zeros((len(n), length), np.uint16)
            if len(some):
                at = offsets[some]
                sums[0, some] = np.add.reduceat(values, at)
                sums[1, some] = np.add.reduceat(vectors.mix(values + factor[0]), at)
                for k in range(length):
                    sig[some, k] = np.minimum.reduceat(values * factor[k] + shift[k], at).astype(np.uint16)
            packed = [s.tobytes() if c else None for s, c in zip(sig, n)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(n.astype(np.int64)),
                    pa.array(sums[0].view(np.int64)),
                    pa.array(sums[1].view(np.int64)),
                    pa.array(packed, pa.binary()),
                ],
                ["doc_id", "n_shingles", "s1", "s2", "sig"],
            )

    source = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text"))
    return source.mapInArrow(rows, "doc_id long, n_shingles long, s1 long, s2 long, sig binary")


def _matrix(column: pa.Array, length: int) -> np.ndarray:
    return np.frombuffer(vectors.text_buffer(column)[0], np.uint16).reshape(-1, length)


def _index_key(sig: np.ndarray, mask: np.ndarray, number: int) -> np.ndarray:
    key = np.full(len(sig), np.uint64(number + 1), np.uint64)
    for k in mask:
        key = vectors.mix(key + sig[:, k].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return key


def index_keys(nodes: DataFrame, settings: Settings) -> DataFrame:
    """One row per node and index: the node's key in that index."""
    masks, length = settings.masks(), settings.length

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sig = _matrix(batch.column("sig"), length)
            for i, mask in enumerate(masks):
                key = _index_key(sig, mask, i).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(key)], ["node", "key"])

    return nodes.select("node", "sig").mapInArrow(rows, "node long, key long")


def within_radius(pairs: DataFrame, nodes: DataFrame, settings: Settings) -> DataFrame:
    """The pairs ``a``, ``b`` whose signatures differ in at most ``radius`` symbols."""
    length, radius = settings.length, settings.radius

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            apart = (_matrix(batch.column("sa"), length) != _matrix(batch.column("sb"), length)).sum(1)
            yield batch.select(["a", "b"]).filter(pa.array(apart <= radius))

    sig = nodes.select("node", "sig")
    first = salted_join(pairs, sig.toDF("a", "sa"), ["a"], F.col("b"))
    both = first.join(sig.toDF("b", "sb"), "b")
    return both.select("a", "b", "sa", "sb").mapInArrow(rows, "a long, b long")


def shingle_sets(docs: DataFrame, nodes: DataFrame, settings: Settings) -> DataFrame:
    """The full shingle sets (sorted 64-bit hashes) of the documents named in ``nodes``."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in vectors.slices(batches, "text"):
            values, offsets = vectors.distinct_shingles(*vectors.text_buffer(batch.column("text")), settings.words)
            packed = [values[s:e].tobytes() for s, e in zip(offsets[:-1], offsets[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(packed, pa.binary())], ["node", "shingles"])

    source = docs.select(F.col("doc_id").cast("long").alias("node"), F.col("text").cast("binary").alias("text"))
    return source.join(nodes, "node", "left_semi").mapInArrow(rows, "node long, shingles binary")


def confirmed(pairs: DataFrame, sets: DataFrame, settings: Settings) -> DataFrame:
    """The pairs ``a``, ``b`` whose full sets are similar enough."""
    over, under = settings.similar

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("xa"), batch.column("xb")):
                a, b = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                common = 0
                if under * min(len(a), len(b)) >= over * max(len(a), len(b)):
                    at = np.searchsorted(a, b)
                    common = int((a[np.minimum(at, len(a) - 1)] == b).sum())
                keep.append(under * common >= over * (len(a) + len(b) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    first = salted_join(pairs, sets.toDF("a", "xa"), ["a"], F.col("b"))
    both = first.join(sets.toDF("b", "xb"), "b")
    return both.select("a", "b", "xa", "xb").mapInArrow(rows, "a long, b long").distinct()


def private_counts(sets: DataFrame, pool: DataFrame) -> DataFrame:
    """For each node of ``pool`` that has any: how many of its shingles no other node of it has.

    Two nodes share no private shingle, which bounds how similar they can be: copies with edits of
    their own drop out here, however many there are of them.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = vectors.text_buffer(batch.column("shingles"))
            owner = np.repeat(np.arange(batch.num_rows), np.diff(offsets) // 8)
            for at in range(0, len(owner), 1 << 18):
                part = slice(at, at + (1 << 18))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("node").take(pa.array(owner[part])), pa.array(np.frombuffer(data, np.int64)[part])],
                    ["node", "shingle"],
                )

    each = sets.join(pool, "node", "left_semi").mapInArrow(rows, "node long, shingle long")
    once = each.groupBy("shingle").agg(F.min("node").alias("node"), F.max("node").alias("last")).filter("node = last")
    return once.groupBy("node").agg(F.count(F.lit(1)).alias("private"))


def _whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Regroup sorted batches so that no group of equal keys is cut."""
    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table])
        same = np.ones(held.num_rows, bool)
        for k in keys:
            column = held.column(k).to_numpy()
            same &= column == column[-1]
        cut = held.num_rows - int(np.argmin(same[::-1])) if not same.all() else 0
        if cut:
            yield held.slice(0, cut).combine_chunks()
            held = held.slice(cut)
    if held is not None and held.num_rows:
        yield held.combine_chunks()


def _pairs_in(sizes: np.ndarray, most: int = 2_000_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers of all pairs inside consecutive groups, some ``most`` pairs (or one group) at a time."""
    starts = np.cumsum(sizes) - sizes
    parts = np.cumsum(sizes * (sizes - 1) // 2) // most
    for part in np.unique(parts):
        mine = parts == part
        left, right = [], []
        for size in np.unique(sizes[mine & (sizes > 1)]):
            i, j = np.triu_indices(size, 1)
            at = starts[mine & (sizes == size)][:, None]
            left.append((at + i).ravel())
            right.append((at + j).ravel())
        if left:
            yield np.concatenate(left), np.concatenate(right)


def cross_pairs(members: DataFrame, settings: Settings) -> DataFrame:
    """Pairs within the radius that share an index key but no component yet.

    ``members`` holds key, node, leader, label, sig, the key's row count n, the node's set size and
    how many of its shingles are private.  A key with many rows is
    cut into blocks of about ``block`` rows and every two blocks meet in a task of their own, so no
    task holds a whole key.  A pair is given out under the first index that both agree in, and not
    at all if one of the two leads the key, as that pair has been confirmed or refused before.
    """
    masks, length, radius = settings.masks(), settings.length, settings.radius
    over, under = settings.similar

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_groups(batches, ["key", "low", "high"]):
            key, low, high = (table.column(c).to_numpy() for c in ("key", "low", "high"))
            node, label, leader, own = (table.column(c).to_numpy() for c in ("node", "label", "leader", "own"))
            size, private = table.column("n_shingles").to_numpy(), table.column("private").to_numpy()
            sig = _matrix(table.column("sig").combine_chunks(), length)
            edge = np.flatnonzero((key[1:] != key[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])) + 1
            sizes = np.diff(np.concatenate([[0], edge, [len(key)]]))
            for i, j in _pairs_in(sizes):
                want = (label[i] != label[j]) & ((own[i] != own[j]) | (low[i] == high[i]))
                want &= (node[i] != leader[i]) & (node[j] != leader[j])
                common = np.minimum(size[i] - private[i], size[j] - private[j])
                want &= under * common >= over * np.maximum(size[i] + private[j], size[j] + private[i])
                yield from near_rows(key, node, sig, i[want], j[want])

    def near_rows(key: np.ndarray, node: np.ndarray, sig: np.ndarray, i: np.ndarray, j: np.ndarray) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(i), 50_000):
            x, y = i[at : at + 50_000], j[at : at + 50_000]
            differs = sig[x] != sig[y]
            first = np.full(len(x), -1)
            for number in range(len(masks) - 1, -1, -1):
                first[~differs[:, masks[number]].any(1)] = number
            near = differs.sum(1) <= radius
            for number in np.unique(first[near]):
                mine = near & (first == number)
                near[mine] = _index_key(sig[x[mine]], masks[number], number).view(np.int64) == key[x[mine]]
            a, b = node[x[near]], node[y[near]]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    blocks = F.ceil(F.col("n") / settings.block).cast("int")
    own = F.pmod(F.xxhash64("node"), blocks).cast("int")
    dealt = (
        members.withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        .select(
            "key", "node", "label", "leader", "own", "sig", "n_shingles", "private",
            F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"),
        )
    )
    by = ["key", "low", "high"]
    return dealt.repartition(*by).sortWithinPartitions(*by).mapInArrow(rows, "a long, b long").distinct()


def _mixed(labelled: DataFrame) -> DataFrame:
    """Keys whose nodes are in several components, with their row counts."""
    ends = labelled.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.count(F.lit(1)).alias("n"))
    return ends.filter("x < y").select("key", "n")


def near_duplicates(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Classes of near-duplicate documents: doc_id, n_shingles, component_id, kept.

    Documents whose distinct shingle sets overlap by ``similar`` or more are linked; component_id is
    the smallest doc_id reachable and ``kept`` marks it.  Equal sets are merged first, so copies cost
    one row each.  Each index key then links to its smallest node; keys that still hold several
    components are searched exactly, in blocks, among the nodes that may still have a partner.

    Null, empty and blank texts are linked with nothing.  A null doc_id gives a null component and
    is kept, linked with nothing.  Rows that share a doc_id are one document with several texts, and
    every row of a kept one is kept.  Further columns are ignored; an empty table gives none.
    """
    base = stage(signatures(docs, settings), "signatures")
    digest = ["n_shingles", "s1", "s2"]
    some = base.filter("n_shingles > 0 and doc_id is not null")
    classes = some.groupBy(*digest).agg(F.min("doc_id").alias("node"))
    mapped = stage(salted_join(some, classes, digest, F.col("doc_id")), "classes")
    nodes = mapped.filter("doc_id = node").select("node", "sig", "n_shingles")

    keys = index_keys(nodes, settings)
    buckets = keys.groupBy("key").agg(F.min("node").alias("leader"), F.max("node").alias("last"), F.count("node").alias("n"))
    buckets = stage(buckets.filter("leader < last").drop("last"), "buckets")
    shared = stage(salted_join(keys, buckets, ["key"], F.col("node")), "shared")
    sets = stage(shingle_sets(docs, shared.select("node").distinct(), settings), "sets")

    stars = stage(shared.filter("node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct(), "stars")
    links = stage(confirmed(within_radius(stars, nodes, settings), sets, settings), "links")
    found = components(links)

    labelled = shared.drop("n").join(found.withColumnRenamed("component", "label"), "node", "left")
    labelled = stage(labelled.withColumn("label", F.coalesce("label", "node")), "labelled")
    suspects = stage(salted_join(labelled, _mixed(labelled), ["key"], F.col("node")), "suspects")
    pool = stage(suspects.select("node").distinct(), "pool")
    over, under = settings.similar
    alive = nodes.join(pool, "node", "left_semi").join(private_counts(sets, pool), "node", "left")
    alive = alive.withColumn("private", F.coalesce("private", F.lit(0)))
    alive = alive.filter(under * (F.col("n_shingles") - F.col("private")) >= over * F.col("n_shingles"))
    left = stage(suspects.drop("n").join(alive, "node"), "left")
    members = salted_join(left, _mixed(left), ["key"], F.col("node"))
    more = stage(cross_pairs(members, settings), "cross")
    links = links.union(confirmed(more, sets, settings))
    found = components(links)

    # A document with several texts ties their nodes together through its id.
    repeated = mapped.filter("doc_id <> node").join(
        mapped.filter("doc_id = node").select("doc_id").distinct(), "doc_id", "left_semi"
    )
    odd = repeated.select(F.col("node").alias("a"), F.col("doc_id").alias("b"))
    if not odd.isEmpty():
        found = components(links.union(odd))

    final = mapped.groupBy("doc_id", "node").agg(F.count(F.lit(1)).alias("rows"))
    final = salted_join(final, found, ["node"], F.col("doc_id"), "left")
    final = final.groupBy("doc_id").agg(F.min(F.coalesce("component", "node")).alias("component_id"))
    out = base.select("doc_id", "n_shingles").join(final, "doc_id", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    out = out.withColumn("component_id", component)
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def remove_near_duplicates(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One document of each class, the smallest doc_id, with all columns of ``docs``.

    Of rows with equal doc_id and text one stays.  Rows with a null doc_id all stay.
    """
    losers = near_duplicates(docs, settings).filter("not kept").select(F.col("doc_id").alias("_doc")).distinct()
    left = docs.join(stage(losers, "losers"), F.col("doc_id").cast("long") == F.col("_doc"), "left_anti")
    again = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1 and doc_id is not null").select("doc_id")
    again = stage(again, "repeated")
    if again.isEmpty():
        return left
    once = left.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return left.join(again, "doc_id", "left_anti").unionByName(once)
