"""Log-bilinear language model: trained in numpy by noise-contrastive estimation, scored exactly.

The model predicts classes: the most frequent tokens one by one, and all others by their last byte.
A rare token's probability is its class's, times its share of that class; each class keeps a share
for tokens never seen.  The next class's logit is the product of its vector with the weighted sum
of the vectors of the two tokens before, plus a bias.  Training never normalises; scoring does, by
matrix products over all classes for every distinct pair of preceding tokens.

The corpus is dealt into units of about as many tokens, and the number of units follows its tokens
alone.  A turn trains a unit in every lane from the same weights and averages them; the next turn
goes on from there.  How the input was partitioned changes which texts share a unit, nothing else.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roleweave.llm import vectors
from roleweave.llm.skew import salted_join
from roleweave.llm.storage import stage

#: The end of a text as a token; no word is empty.
END = b""
CONTEXT = 2
#: What the squared gradients of a weight start from.
FIRST_SQUARE = 1e-2


@dataclass(frozen=True)
class Settings:
    """Model and training sizes; at most ``head`` tokens of up to ``longest`` bytes are sent to all tasks.

    ``rounds`` are passes over the corpus; a unit is at most about ``unit`` steps of ``batch`` tokens.
    Where one pass has fewer than ``least_steps`` steps one after another, each unit is gone through
    several times in its turn, so that small corpora are trained as long as larger ones.
    """

    vocabulary: int = 768
    dimensions: int = 16
    noise: int = 64
    batch: int = 8192
    unit: int = 64
    rate: float = 0.1
    rounds: int = 1
    least_steps: int = 1000
    head: int = 200_000
    longest: int = 64
    seed: int = 7

    @property
    def classes(self) -> int:
        return self.vocabulary + 256


def held_out(doc_id: Column) -> Column:
    """Rows that no count or weight may learn from; a null id is taken as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 7 == 2


def tokens(text: bytes | None) -> list[bytes]:
    """Words between ASCII blanks with A-Z lower-cased; the end is not included."""
    return (text or b"").lower().split()


def count_tokens(docs: DataFrame, flush: int = 500_000) -> DataFrame:
    """``token``, ``c``: how often each token occurs in all of ``docs``, ends included."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            keys, values = list(counts.keys()), np.fromiter(counts.values(), np.int64, len(counts))
            counts.clear()
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(values)], ["token", "n"])

        for batch in vectors.slices(batches, "text"):
            for text in batch.column("text").to_pylist():
                counts.update(tokens(text))
            counts[END] += batch.num_rows
            if len(counts) >= flush:
                yield out()
        if counts:
            yield out()

    source = docs.select(F.col("text").cast("binary").alias("text"))
    return source.mapInArrow(rows, "token binary, n long").groupBy("token").agg(F.sum("n").alias("c"))


@dataclass
class Lexicon:
    """What every task needs: ids and counts of frequent tokens, shares of the tail classes."""

    ids: dict[bytes, int]  # the most frequent first; the first ``vocabulary`` are classes of their own
    counts: np.ndarray
    total: int
    distinct: int
    tail_total: np.ndarray  # training tokens of each tail class
    unseen: np.ndarray  # share of each tail class left to tokens never seen
    class_counts: np.ndarray

    @property
    def base(self) -> float:
        return float(self.total + self.distinct + 1)


def lexicon(counts: DataFrame, settings: Settings) -> Lexicon:
    """Frequent tokens (a bounded list) and totals per class, over all of ``counts``."""
    short = counts.filter(F.octet_length("token") <= settings.longest)
    # Tokens by frequency band, at most some 1,000 bands; whole bands are taken while they fit.
    band = F.floor(F.log2(F.col("c").cast("double")) * 16).cast("int")
    bands = short.groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("n")).collect()
    room, cutoff = settings.head, None
    for r in sorted(bands, key=lambda r: -r["band"]):
        room -= r["n"]
        if room < 0:
            break
        cutoff = r["band"]
    table = short.filter(band >= cutoff).toArrow() if cutoff is not None else short.limit(0).toArrow()
    top = sorted(zip(table.column("token").to_pylist(), table.column("c").to_pylist()), key=lambda x: (-x[1], x[0]))
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    ids = {token: i for i, (token, _) in enumerate(top)}
    seen = np.array([c for _, c in top], np.int64)
    if END not in ids:  # no training rows, or too rare for a small head
        ids[END] = len(ids)
        seen = np.append(seen, (counts.filter(F.octet_length("token") == 0).agg(F.coalesce(F.max("c"), F.lit(0))).first()[0]))
    spared = F.octet_length("token") == 0  # the end is always a class
    if ids[END] >= settings.vocabulary:
        swap = next(t for t, i in ids.items() if i == settings.vocabulary - 1)
        at = ids[END]
        ids[swap], ids[END] = at, settings.vocabulary - 1
        seen[[at, settings.vocabulary - 1]] = seen[[settings.vocabulary - 1, at]]
    last = F.conv(F.hex(F.expr("substring(token, -1, 1)")), 16, 10).cast("int")
    sums = counts.filter(~spared).groupBy(last.alias("b")).agg(F.sum("c").alias("n"), F.sum((F.col("c") == 1).cast("long")).alias("once"))
    tail_total, once = np.zeros(256), np.zeros(256)
    for r in sums.collect():  # at most 256 rows
        tail_total[r["b"]], once[r["b"]] = r["n"], r["once"]
    class_counts = np.zeros(settings.classes)
    for token, i in ids.items():
        if i < settings.vocabulary:
            class_counts[i] = seen[i]
            if token:
                tail_total[token[-1]] -= seen[i]
                once[token[-1]] -= seen[i] == 1
    class_counts[settings.vocabulary :] = tail_total
    unseen = (once + 1) / (tail_total + once + 1)
    return Lexicon(ids, seen, int(total), int(distinct), tail_total, unseen, class_counts)


@dataclass
class Weights:
    """Context vectors, context weights, target vectors and biases."""

    left: np.ndarray
    mixed: np.ndarray
    right: np.ndarray
    bias: np.ndarray

    def flat(self) -> np.ndarray:
        return np.concatenate([self.left.ravel(), self.mixed.ravel(), self.right.ravel(), self.bias])

    @staticmethod
    def of(flat: np.ndarray, settings: Settings) -> Weights:
        k, d = settings.classes, settings.dimensions
        ends = np.cumsum([k * d, CONTEXT * d, k * d])
        a, b, c, e = np.split(flat, ends)
        return Weights(a.reshape(k, d), b.reshape(CONTEXT, d), c.reshape(k, d), e)


def _noise(lex: Lexicon) -> np.ndarray:
    return ((lex.class_counts + 1) / (lex.class_counts + 1).sum()).astype(np.float32)


def first_weights(lex: Lexicon, settings: Settings) -> Weights:
    """Small random vectors; biases at the classes' own frequencies."""
    rng = np.random.default_rng(settings.seed)
    k, d = settings.classes, settings.dimensions
    left, right = (rng.normal(0, 0.1, (k, d)).astype(np.float32) for _ in range(2))
    mixed = np.repeat(np.array([[1.0], [0.5]], np.float32), d, 1)
    return Weights(left, mixed, right, np.log(_noise(lex)))


def _classes(texts: list[bytes | None], ids: dict[bytes, int], settings: Settings):
    """Per token over all texts with their ends: id (-1: not frequent), class, text number, and the words."""
    words, sizes = [], []
    for text in texts:
        found = tokens(text)
        sizes.append(len(found) + 1)
        words += found
        words.append(END)
    number = np.fromiter((ids.get(w, -1) for w in words), np.int64, len(words))
    kind = number.copy()
    for i in np.flatnonzero((number < 0) | (number >= settings.vocabulary)):
        kind[i] = settings.vocabulary + words[i][-1]
    return number, kind, np.array(sizes, np.int64), words


def _contexts(kind: np.ndarray, sizes: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The classes one and two places before each token; ends stand before a text."""
    one, two = np.full(len(kind), end), np.full(len(kind), end)
    one[1:], two[2:] = kind[:-1], kind[:-2]
    starts = np.cumsum(sizes) - sizes
    one[starts] = end
    two[starts] = end
    second = starts[sizes > 1] + 1
    two[second] = end
    return one, two


def _scatter(rows: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    return np.stack([np.bincount(rows, values[:, k], n) for k in range(values.shape[1])], 1).astype(np.float32)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Trainer:
    """Stochastic steps with per-weight rates; noise samples are shared by a batch."""

    def __init__(self, weights: Weights, lex: Lexicon, settings: Settings, seed: int):
        self.w, self.s = weights, settings
        self.noise = _noise(lex)
        self.logs = np.log(settings.noise * self.noise)
        self.cumulative = np.cumsum(self.noise.astype(np.float64))
        self.rng = np.random.default_rng(seed)
        self.squares = [np.full(x.shape, FIRST_SQUARE, np.float32) for x in (weights.left, weights.mixed, weights.right, weights.bias)]

    def step(self, one: np.ndarray, two: np.ndarray, target: np.ndarray) -> None:
        w, n, k = self.w, len(target), self.s.classes
        a, b = w.left[one], w.left[two]
        predicted = a * w.mixed[0] + b * w.mixed[1]
        goal = w.right[target]
        drawn = np.searchsorted(self.cumulative, self.rng.random(self.s.noise) * self.cumulative[-1])
        other = w.right[drawn]
        true = (predicted * goal).sum(1) + w.bias[target] - self.logs[target]
        false = predicted @ other.T + w.bias[drawn] - self.logs[drawn]
        g_true, g_false = _sigmoid(true) - 1, _sigmoid(false)
        g_predicted = g_true[:, None] * goal + g_false @ other
        right = _scatter(target, g_true[:, None] * predicted, k)
        np.add.at(right, drawn, g_false.T @ predicted)
        bias = np.bincount(target, g_true, k).astype(np.float32)
        np.add.at(bias, drawn, g_false.sum(0))
        left = _scatter(one, g_predicted * w.mixed[0], k) + _scatter(two, g_predicted * w.mixed[1], k)
        mixed = np.stack([(g_predicted * a).sum(0), (g_predicted * b).sum(0)])
        for x, g, square in zip((w.left, w.mixed, w.right, w.bias), (left, mixed, right, bias), self.squares):
            g /= n
            square += g * g
            x -= self.s.rate * g / np.sqrt(square)

    def learn(self, kind: np.ndarray, sizes: np.ndarray, end: int) -> None:
        self.walk(*_contexts(kind, sizes, end), kind)

    def walk(self, one: np.ndarray, two: np.ndarray, target: np.ndarray) -> None:
        """Every token once in random order, in batches of the same size but for one token."""
        order = self.rng.permutation(len(target))
        for rows in np.array_split(order, ceil(len(order) / self.s.batch)) if len(order) else ():
            self.step(one[rows], two[rows], target[rows])


def schedule(total: int, settings: Settings) -> tuple[int, int]:
    """Lanes, and turns in a pass, for ``total`` tokens.

    Averaged lanes go no further than one of them, so lanes grow as the cube root of the units and
    steps one after another as the power 2/3.
    """
    units = max(1, ceil(total / (settings.batch * settings.unit)))
    lanes = int(units ** (1 / 3) + 1e-9)
    return lanes, ceil(units / lanes)


def _unpack(blocks: list[bytes], end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The classes one and two places before each token, and its own; each block begins with the two before it."""
    runs = [np.frombuffer(b, np.uint16).astype(np.int64) for b in blocks]
    one, two, target = (np.concatenate([r[at : len(r) - 2 + at] for r in runs]) for at in (1, 0, 2))
    return one, np.where(one == end, end, two), target


def _units(docs: DataFrame, lex: Lexicon, settings: Settings) -> DataFrame:
    """The corpus as ``turn``, ``lane`` and ``blocks`` of classes: one row, a unit, for each turn and lane.

    Blocks of up to a batch are dealt out to the lanes in turn, whatever partitions they come from.
    """
    assert settings.classes <= 1 << 16
    lanes, turns = schedule(lex.total, settings)
    share = ceil(lex.total / (lanes * turns))
    sent = docs.sparkSession.sparkContext.broadcast(lex)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = sent.value
        run = np.full(2, lex.ids[END], np.uint16)  # every text ends with an end, so its first contexts are ends
        out = lambda run: pa.RecordBatch.from_arrays([pa.array([run.tobytes()], pa.binary())], ["block"])
        for batch in vectors.slices(batches, "text"):
            _, kind, _, _ = _classes(batch.column("text").to_pylist(), lex.ids, settings)
            run = np.concatenate([run, kind.astype(np.uint16)])
            while len(run) >= settings.batch + 2:
                yield out(run[: settings.batch + 2])
                run = run[settings.batch :]
        if len(run) > 2:
            yield out(run)

    def units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, turn, seen = [], 0, 0

        def out() -> pa.RecordBatch:
            values = [pa.array([turn], pa.int32()), pa.array([held], pa.list_(pa.binary()))]
            return pa.RecordBatch.from_arrays(values, ["turn", "blocks"])

        for batch in batches:
            for block in batch.column("block").to_pylist():
                now = min(seen // share, turns - 1)
                if now > turn:
                    yield out()
                    held, turn = [], now
                held.append(block)
                seen += len(block) // 2 - 2
        if held:
            yield out()

    dealt = docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(blocks, "block binary").repartition(lanes)
    packed = dealt.mapInArrow(units, "turn int, blocks array<binary>").withColumn("lane", F.spark_partition_id())
    return stage(packed, "units", ["turn"])


def train(docs: DataFrame, lex: Lexicon, settings: Settings) -> Weights:
    """Turn by turn, a unit in every lane from the shared weights and rates; the results are averaged by their tokens."""
    weights, end, pieces = first_weights(lex, settings), lex.ids[END], 16
    if not lex.total:
        return weights
    units, (lanes, turns) = _units(docs, lex, settings), schedule(lex.total, settings)
    steps = ceil(lex.total / (lanes * settings.batch))  # of a pass, one after another
    repeats = max(1, ceil(settings.least_steps / (settings.rounds * steps)))
    small = replace(lex, ids={}, counts=np.zeros(0, np.int64))
    state = np.concatenate([weights.flat(), np.full(len(weights.flat()), FIRST_SQUARE, np.float32)])
    for turn in range(settings.rounds * turns):
        start = docs.sparkSession.sparkContext.broadcast((small, state))

        def rows(batches: Iterator[pa.RecordBatch], turn: int = turn, start=start) -> Iterator[pa.RecordBatch]:
            lex, state = start.value
            total, learnt = np.zeros(len(state)), 0
            for batch in batches:
                for lane, blocks in zip(batch.column("lane").to_pylist(), batch.column("blocks").to_pylist()):
                    flat, squares = np.split(state.copy(), 2)
                    trainer = Trainer(Weights.of(flat, settings), lex, settings, [settings.seed, turn, lane])
                    trainer.squares = list(vars(Weights.of(squares, settings)).values())
                    one, two, target = _unpack(blocks, end)
                    for _ in range(repeats):
                        trainer.walk(one, two, target)
                    total += np.concatenate([trainer.w.flat(), *[x.ravel() for x in trainer.squares]]) * float(len(target))
                    learnt += len(target)
            if learnt:
                mean = [x.astype(np.float32).tobytes() for x in np.array_split(total / learnt, pieces)]
                at = pa.array(range(pieces), pa.int32())
                yield pa.RecordBatch.from_arrays([at, pa.array(mean, pa.binary()), pa.array([learnt] * pieces, pa.int64())], ["at", "value", "n"])

        def mean(table: pa.Table) -> pa.Table:
            n = table.column("n").to_pylist()
            total = sum(np.frombuffer(v, np.float32) * float(c) for v, c in zip(table.column("value").to_pylist(), n))
            value = (total / sum(n)).astype(np.float32).tobytes()
            return pa.table([table.column("at").slice(0, 1), pa.array([value], pa.binary())], ["at", "value"])

        parts = units.filter(F.col("turn") == turn % turns).mapInArrow(rows, "at int, value binary, n long")
        met = parts.groupBy("at").applyInArrow(mean, "at int, value binary").collect()  # ``pieces`` rows
        start.destroy()
        if met:
            state = np.concatenate([np.frombuffer(r["value"], np.float32) for r in sorted(met, key=lambda r: r["at"])])
    return Weights.of(np.split(state, 2)[0], settings)


class Scorer:
    """Normalised log10 probabilities of classes; each pair of preceding classes is normalised once."""

    def __init__(self, weights: Weights, settings: Settings):
        self.w, self.k = weights, settings.classes
        self.norm = np.full(self.k * self.k, np.nan, np.float32)

    def logs(self, one: np.ndarray, two: np.ndarray, target: np.ndarray) -> np.ndarray:
        w, key = self.w, one * self.k + two
        fresh = np.unique(key[np.isnan(self.norm[key])])
        for at in range(0, len(fresh), 4096):
            part = fresh[at : at + 4096]
            predicted = w.left[part // self.k] * w.mixed[0] + w.left[part % self.k] * w.mixed[1]
            logits = predicted @ w.right.T + w.bias
            most = logits.max(1)
            self.norm[part] = most + np.log(np.exp(logits - most[:, None]).sum(1))
        predicted = w.left[one] * w.mixed[0] + w.left[two] * w.mixed[1]
        logit = (predicted * w.right[target]).sum(1) + w.bias[target]
        return (logit - self.norm[key]).astype(np.float64) / np.log(10)


def score_texts(docs: DataFrame, counts: DataFrame, lex: Lexicon, weights: Weights, settings: Settings) -> DataFrame:
    """Scores of every text; tokens outside the frequent ones meet their counts by a join."""
    context = docs.sparkSession.sparkContext
    sent = context.broadcast((lex, weights))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex, weights = sent.value
        scorer, end = Scorer(weights, settings), lex.ids[END]
        v = settings.vocabulary
        with np.errstate(divide="ignore"):
            base = np.log10((lex.counts + 1) / lex.base)
            share = np.log10((1 - lex.unseen) / np.maximum(lex.tail_total, 1))
            inside = np.log10(np.maximum(lex.counts, 1))
        for batch in vectors.slices(batches, "text"):
            number, kind, sizes, words = _classes(batch.column("text").to_pylist(), lex.ids, settings)
            value = scorer.logs(*_contexts(kind, sizes, end), kind)
            frequent = number >= 0
            rare_class = frequent & (number >= v)
            value[rare_class] += inside[number[rare_class]] + share[kind[rare_class] - v]
            starts = np.cumsum(sizes) - sizes
            known = np.add.reduceat((frequent & (lex.counts[number] > 0)).astype(np.int64), starts)
            plain = np.add.reduceat(np.where(frequent, base[number], 0.0), starts)
            total = np.add.reduceat(value, starts)
            none = pa.nulls(batch.num_rows, pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("doc_id"), batch.column("held_out"), pa.array(sizes), pa.array(known),
                 pa.array(plain), pa.array(total), none],
                names,
            )
            owner = np.repeat(np.arange(len(sizes)), sizes)
            left = np.flatnonzero(~frequent)
            if len(left):
                m = len(left)
                which = pa.array(owner[left])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row").take(which), pa.nulls(m, pa.int64()), pa.nulls(m, pa.bool_()),
                     *[pa.nulls(m, t) for t in (pa.int64(), pa.int64(), pa.float64(), pa.float64())],
                     pa.array([words[i] for i in left], pa.binary())],
                    names,
                )

    names = ["row", "doc_id", "held_out", "n_tokens", "known", "base", "total", "token"]
    source = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"),
        held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("binary").alias("text"),
    )
    done = stage(
        source.mapInArrow(rows, "row long, doc_id long, held_out boolean, n_tokens long, known long, base double, total double, token binary"),
        "scored",
    )
    texts = done.filter("token is null").drop("token")
    rare = done.filter("token is not null").groupBy("row", "token").agg(F.count(F.lit(1)).alias("n"))
    with np.errstate(divide="ignore"):
        logs = np.log10((1 - lex.unseen) / np.maximum(lex.tail_total, 1))
    shares = F.array(*[F.lit(float(x)) for x in logs])
    unseen = F.array(*[F.lit(float(x)) for x in np.log10(lex.unseen)])
    last = F.conv(F.hex(F.expr("substring(token, -1, 1)")), 16, 10).cast("int") + 1
    met = salted_join(rare, counts, ["token"], F.col("row"), "left")
    seen = F.coalesce("c", F.lit(0))
    own = F.when(seen > 0, F.log10(seen) + F.element_at(shares, last)).otherwise(F.element_at(unseen, last))
    sums = met.groupBy("row").agg(
        F.sum(F.when(seen > 0, F.col("n")).otherwise(0)).alias("more_known"),
        F.sum(F.col("n") * F.log10((seen + 1) / F.lit(lex.base))).alias("more_base"),
        F.sum(F.col("n") * own).alias("more"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0))
    return texts.join(sums, "row", "left").select(
        "doc_id", "held_out", "n_tokens",
        (F.col("known") + zero("more_known")).cast("long").alias("n_known"),
        F.lit(lex.total).cast("long").alias("train_tokens"),
        (F.col("base") + zero("more_base")).alias("base_score"),
        (F.col("total") + zero("more")).alias("score"),
    )


def language_scores(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Score every text: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Counts and weights come from rows that are not held out, all of them.  ``score`` is the model's
    log10 probability of the text and its end, ``base_score`` the smoothed unigram one.  Null, empty
    and blank texts are one token, the end.  Rows with a null doc_id learn and are scored; repeated
    rows count as often as they occur.  Without any training row every token is unseen, and scores
    are finite.  Other columns are ignored; an empty table gives none.
    """
    learning = docs.filter(~held_out(F.col("doc_id"))).select("text")
    counts = stage(count_tokens(learning), "tokens")
    lex = lexicon(counts, settings)
    weights = train(learning, lex, settings)
    return score_texts(docs, counts, lex, weights, settings)
