"""Document quality from a linear-chain conditional random field over lines.

Every line with words is labelled good or bad from its own features and those of the lines before
and after.  Documents lend their label to all their lines for training.  A document's quality is the
mean of its lines' forward-backward marginals, weighted by their lengths and calibrated on the
documents learnt from.  Features look at form only: no word is known to the model.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roleweave.llm import vectors

_KINDS = np.zeros(256, np.int64)  # 0 other blank or control, 1 small, 2 capital, 3 digit, 4 plain mark, 5 odd mark, 6 beyond ASCII
_KINDS[0x61:0x7B] = 1
_KINDS[0x41:0x5B] = 2
_KINDS[0x30:0x3A] = 3
_KINDS[[ord(c) for c in ".,;:'\"?()-"]] = 4
_KINDS[[ord(c) for c in "!#$%&*+/<=>@[\\]^_`{|}~"]] = 5
_KINDS[0x80:] = 6
FEATURES = (
    "length", "words", "word_length", "capitals", "digits", "marks", "odd_marks", "beyond_ascii",
    "repeats_previous_word", "distinct_words", "single_odd_words", "ends_in_mark", "copies_in_text", "first", "last",
)


@dataclass(frozen=True)
class Settings:
    """``sample`` labelled documents of up to ``longest`` lines are learnt from; that bounds the driver's part."""

    sample: int = 6000
    longest: int = 300
    steps: int = 200
    rate: float = 0.1
    penalty: float = 1e-3
    seed: int = 11


@dataclass
class Model:
    """Feature scales, weights for the bad state (own, previous, next line), transitions, calibration."""

    centre: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    moves: np.ndarray
    slope: float = 1.0
    shift: float = 0.0


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learnt from; a null id is taken as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def line_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Features, owner row, byte length and place in the text of every line that has a word."""
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    breaks = np.flatnonzero(data == 10)
    edge[breaks] = edge[breaks + 1] = True  # a line break stands alone
    bounds = np.flatnonzero(edge)
    if len(bounds) < 2:
        return np.zeros((0, len(FEATURES)), np.float32), *(np.zeros(0, np.int64) for _ in range(3))
    starts, ends = bounds[:-1], bounds[1:]
    hashes, at = vectors.word_hashes(data, np.concatenate([starts, ends[-1:]]))
    keep = np.flatnonzero(np.diff(at) > 0)
    owner = np.searchsorted(offsets, starts[keep], "right") - 1
    counts = np.diff(at)[keep].astype(np.float64)
    size = (ends - starts)[keep].astype(np.float64)
    kinds = np.zeros((7, len(keep)))
    classes = _KINDS[data]
    for k in range(1, 7):
        total = np.concatenate([[0], np.cumsum(classes == k)])
        kinds[k] = (total[ends] - total[starts])[keep]
    line = np.repeat(np.arange(len(keep)), counts.astype(np.int64))
    again = np.zeros(len(hashes))
    again[1:] = (hashes[1:] == hashes[:-1]) & (line[1:] == line[:-1])
    order = np.lexsort((hashes, line))
    fresh = np.ones(len(hashes))
    fresh[1:] = (hashes[order][1:] != hashes[order][:-1]) | (line[order][1:] != line[order][:-1])
    first = at[keep]
    per_line = lambda x: np.add.reduceat(x, first) if len(first) else np.zeros(0)
    blank = classes == 0
    alone = np.zeros(len(data), bool)
    padded = np.concatenate([[True], blank, [True]])
    alone[(classes == 5) & padded[:-2] & padded[2:]] = True
    total = np.concatenate([[0], np.cumsum(alone)])
    odd = (total[ends] - total[starts])[keep]
    place = np.arange(len(hashes)) - np.repeat(first, counts.astype(np.int64))
    digest = per_line(vectors.mix(hashes + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    copies = np.zeros(len(keep))
    by = np.lexsort((digest, owner))
    same = np.zeros(len(keep), bool)
    same[1:] = (digest[by][1:] == digest[by][:-1]) & (owner[by][1:] == owner[by][:-1])
    copies[by] = same
    opens = np.ones(len(keep))
    opens[1:] = owner[1:] != owner[:-1]
    closes = np.ones(len(keep))
    closes[:-1] = opens[1:]
    letters = np.maximum(kinds[1] + kinds[2] + kinds[6], 1)
    tail = ends[keep] - 1
    marks = kinds[4:6].sum(0)
    features = np.stack(
        [
            np.log1p(size), np.log1p(counts), np.minimum(size / counts, 40) / 10, kinds[2] / letters, kinds[3] / size,
            kinds[4] / size, np.sqrt(kinds[5] / size), kinds[6] / letters, per_line(again) / counts, per_line(fresh) / counts,
            odd / counts, (_KINDS[data[tail]] == 4) & (marks > 0), copies, opens, closes,
        ],
        1,
    )
    number = np.arange(len(keep)) - np.repeat(np.flatnonzero(opens), np.diff(np.append(np.flatnonzero(opens), len(keep))))
    return features.astype(np.float32), owner, size.astype(np.int64), number


def with_neighbours(features: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Own features, those of the lines before and after (zero outside the text), and a constant."""
    before, after = np.zeros_like(features), np.zeros_like(features)
    same = (owner[1:] == owner[:-1])[:, None]
    before[1:] = features[:-1] * same
    after[:-1] = features[1:] * same
    return np.concatenate([features, before, after, np.ones((len(features), 1), features.dtype)], 1)


def forward_backward(bad: np.ndarray, owner: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginal of the bad state per line, expected moves in total, and the log normaliser per text.

    ``bad`` holds the bad state's score per line (the good one's is 0); all texts advance together.
    """
    n = len(bad)
    starts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]])) if n else np.zeros(0, np.int64)
    sizes = np.diff(np.append(starts, n))
    by = np.argsort(-sizes, kind="stable")
    starts_, sizes_ = starts[by], sizes[by]
    active = np.searchsorted(-sizes_, -np.arange(1, (sizes_[0] if n else 0) + 1), "right")
    most = np.maximum(bad, 0)
    local = np.stack([np.exp(-most), np.exp(bad - most)], 1)
    step = np.exp(moves)
    alpha, beta, scale = np.zeros((n, 2)), np.ones((n, 2)), np.ones(n)
    for t, m in enumerate(active):
        at = starts_[:m] + t
        value = local[at] if t == 0 else (alpha[at - 1] @ step) * local[at]
        scale[at] = value.sum(1)
        alpha[at] = value / scale[at][:, None]
    for t in range(len(active) - 2, -1, -1):
        at = starts_[: active[t + 1]] + t
        beta[at] = ((local[at + 1] * beta[at + 1]) @ step.T) / scale[at + 1][:, None]
    marginal = alpha[:, 1] * beta[:, 1] / np.maximum((alpha * beta).sum(1), 1e-300)
    inner = np.setdiff1d(np.arange(n), starts)
    pair = alpha[inner - 1][:, :, None] * step[None] * (local[inner] * beta[inner])[:, None, :] / scale[inner][:, None, None]
    norm = np.add.reduceat(np.log(scale) + most, starts)[np.arange(len(starts))] if n else np.zeros(0)
    return marginal, pair.sum(0), norm


def fit(features: np.ndarray, owner: np.ndarray, sizes: np.ndarray, labels: np.ndarray, settings: Settings) -> Model:
    """Maximum likelihood by gradient steps with per-weight rates; ``labels`` (1 good) holds one per line."""
    centre, spread = features.mean(0), np.maximum(features.std(0), 1e-3)
    x = with_neighbours((features - centre) / spread, owner).astype(np.float64)
    y = 1.0 - labels
    fresh = np.concatenate([[True], owner[1:] != owner[:-1]])
    texts = int(fresh.sum())
    inner = np.flatnonzero(~fresh)
    stays = np.zeros((2, 2))
    np.add.at(stays, (y[inner - 1].astype(int), y[inner].astype(int)), 1)
    weights, moves = np.zeros(x.shape[1]), np.zeros((2, 2))
    state = [np.zeros_like(weights), np.zeros_like(weights), np.zeros_like(moves), np.zeros_like(moves)]
    for turn in range(1, settings.steps + 1):
        marginal, expected, _ = forward_backward(x @ weights, owner, moves)
        grads = (x.T @ (marginal - y) / texts + settings.penalty * weights, (expected - stays) / texts + settings.penalty * moves)
        for p, g, m, v in zip((weights, moves), grads, state[::2], state[1::2]):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= settings.rate * (m / (1 - 0.9**turn)) / (np.sqrt(v / (1 - 0.99**turn)) + 1e-8)
    model = Model(centre, spread, weights, moves)
    raw = raw_scores(model, features, owner, sizes)[1]
    good = labels[fresh]
    for _ in range(50):  # logistic calibration by damped Newton steps
        p = 1 / (1 + np.exp(-np.clip(model.slope * raw + model.shift, -30, 30)))
        r, w = good - p, np.maximum(p * (1 - p), 1e-6)
        h = np.array([[(w * raw * raw).sum() + 1, (w * raw).sum()], [(w * raw).sum(), w.sum() + 1e-3]])
        move = np.linalg.solve(h, [(r * raw).sum() - (model.slope - 1), r.sum()])
        model.slope += 0.5 * move[0]
        model.shift += 0.5 * move[1]
    model.slope = max(model.slope, 1e-3)
    return model


def raw_scores(model: Model, features: np.ndarray, owner: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts with lines, their length-weighted good marginal as log odds, and the marginal per line."""
    x = with_neighbours((features - model.centre) / model.spread, owner)
    marginal, _, _ = forward_backward((x @ model.weights).astype(np.float64), owner, model.moves)
    if not len(owner):
        return np.zeros(0, np.int64), np.zeros(0), marginal
    starts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
    mean = np.add.reduceat((1 - marginal) * sizes, starts) / np.add.reduceat(sizes, starts)
    mean = np.clip(mean, 1e-9, 1 - 1e-9)
    return owner[starts], np.log(mean / (1 - mean)), marginal


def learn(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model:
    """Fit on a sample of labelled documents in hash order, never on held-out ones.

    Several labels of a document count as the lowest.  Without any usable label every text scores 0.5.
    """
    chosen = labels.filter("quality is not null and doc_id is not null").filter(~held_out(F.col("doc_id")))
    chosen = chosen.groupBy(F.col("doc_id").cast("long")).agg(F.min("quality").alias("quality"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(settings.sample)
    width = len(FEATURES)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in vectors.slices(batches, "text"):
            features, owner, sizes, _ = line_features(*vectors.text_buffer(batch.column("text")))
            for i in range(batch.num_rows):
                mine = slice(*np.searchsorted(owner, [i, i + 1]))
                if 0 < mine.stop - mine.start <= settings.longest:
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("doc_id").slice(i, 1), batch.column("quality").slice(i, 1),
                         pa.array([features[mine].tobytes()], pa.binary()), pa.array([sizes[mine].tobytes()], pa.binary())],
                        ["doc_id", "quality", "features", "sizes"],
                    )

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    joined = texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "quality", "text")
    got = joined.mapInArrow(rows, "doc_id long, quality int, features binary, sizes binary")
    got = got.dropDuplicates(["doc_id"]).orderBy("doc_id").collect()  # at most ``sample`` texts of ``longest`` lines
    if not got:
        return Model(np.zeros(width), np.ones(width), np.zeros(3 * width + 1), np.zeros((2, 2)), 0.0, 0.0)
    parts = [np.frombuffer(r["features"], np.float32).reshape(-1, width) for r in got]
    sizes = np.concatenate([np.frombuffer(r["sizes"], np.int64) for r in got])
    counts = [len(p) for p in parts]
    owner = np.repeat(np.arange(len(got)), counts)
    labels_ = np.repeat([float(r["quality"]) for r in got], counts)
    return fit(np.concatenate(parts), owner, sizes, labels_, settings)


def _score(model: Model, batch: pa.RecordBatch) -> np.ndarray:
    features, owner, sizes, _ = line_features(*vectors.text_buffer(batch.column("text")))
    which, raw, _ = raw_scores(model, features, owner, sizes)
    score = np.zeros(batch.num_rows)
    score[which] = 1 / (1 + np.exp(-np.clip(model.slope * raw + model.shift, -30, 30)))
    return score


def score_documents(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """``docs`` columns ``keep`` and ``score``: the calibrated quality of each whole text; 0 without words."""
    fields = docs.select(*keep).schema

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in vectors.slices(batches, "_bytes"):
            texts = batch.select(["_bytes"]).rename_columns(["text"])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(_score(model, texts))], [*keep, "score"])

    source = docs.select(*keep, F.col("text").cast("binary").alias("_bytes"))
    schema = type(fields)([*fields.fields]).add("score", "double")
    return source.mapInArrow(rows, schema)


def line_quality(docs: DataFrame, model: Model) -> DataFrame:
    """Every line with words: doc_id, line (from 0 among those), n_bytes, good (its marginal)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in vectors.slices(batches, "text"):
            features, owner, sizes, number = line_features(*vectors.text_buffer(batch.column("text")))
            _, _, marginal = raw_scores(model, features, owner, sizes)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(owner)), pa.array(number), pa.array(sizes), pa.array(1 - marginal)],
                ["doc_id", "line", "n_bytes", "good"],
            )

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return source.mapInArrow(rows, "doc_id long, line long, n_bytes long, good double")


def document_quality(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Per document: doc_id, held_out, score (0 to 1), predicted (1 from 0.5 on).

    Null, empty and blank texts score 0.  Rows with a null or repeated doc_id are scored each on its
    text.  Only the text is an input of the score; other columns are ignored.
    """
    model = learn(docs, labels, settings)
    scored = score_documents(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model, ["doc_id"])
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
