"""Whitening of embeddings: eigenvectors in single precision, refined by matrix products in higher precision.

Components become whole numbers, so sums and second moments about a whole-number centre are exact and
do not depend on partitions; the covariance is their exact quotient.  Its eigenvectors are first found in
float32.  Refinement after Ogita and Aishima corrects all of them at once from the residuals of
orthogonality and of diagonality, by matrix products in extended precision, and converges
quadratically.  Eigenvalues that lie too close together to be told apart that way form a cluster;
its vectors are turned by the eigenvectors of the covariance restricted to their span, and refined again.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roleweave.llm.storage import stage

#: Whole numbers up to here are exact in double precision.
_EXACT = 2.0**53
#: Eigenvalues closer than this share of the largest always form a cluster: rounding would be divided by their gap.
_CLOSE = 1e-8
#: Rows worked on at a time.
_ROWS = 8192


@dataclass(frozen=True)
class Settings:
    """A component c becomes floor(``scale`` * c) + ``shift``; ``components`` are returned at most."""

    scale: int = 1024
    shift: int = 100_000
    components: int = 8


# ---------------------------------------------------------------- eigenvectors


def _relative_gaps(values: np.ndarray, limit: float) -> list[np.ndarray]:
    """Runs of eigenvalues, sorted downwards, whose neighbours are at most ``limit`` apart; only runs of two or more."""
    cuts = np.flatnonzero(values[:-1] - values[1:] > limit) + 1
    return [run for run in np.split(np.arange(len(values)), cuts) if len(run) > 1]


def _correct(a: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, float]:
    """One correction of approximate eigenvectors: new vectors, eigenvalues, what counts as close, and the size of the change."""
    r = np.eye(len(a), dtype=a.dtype) - x.T @ x
    r = (r + r.T) / 2
    s = x.T @ (a @ x)
    s = (s + s.T) / 2
    values = np.diagonal(s) / (1 - np.diagonal(r))
    off = s - np.diag(np.diagonal(s))
    top = np.abs(values).max()
    close = max(2 * (np.sqrt((off * off).sum()) + top * np.sqrt((r * r).sum())), _CLOSE * top)
    gap = values[None, :] - values[:, None]
    apart = np.abs(gap) > close
    # half the orthogonality residual, and a turn, which keeps what is orthogonal so to second order
    turn = np.where(apart, (s + (values[None, :] + values[:, None]) / 2 * r) / np.where(apart, gap, 1), 0)
    change = r / 2 + turn
    return x + x @ change, values, float(close), float(np.abs(change).max())


def refine(a: np.ndarray, x: np.ndarray, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and eigenvectors of the symmetric ``a`` (extended precision) from approximate ones ``x``.

    Every round corrects once.  Vectors of values closer than the correction can part are solved for in
    the space that they span, by an eigenproblem of the cluster's size about its centre; the
    spread of a cluster is small, so double precision resolves it far below that of the whole matrix.
    """
    kind = a.dtype
    best = np.inf
    for _ in range(rounds):
        x, values, close, change = _correct(a, x)
        order = np.argsort(-values, kind="stable")
        x, values = x[:, order], values[order]
        for run in _relative_gaps(values, close):
            basis = x[:, run]
            centre = values[run].mean()
            inner = basis.T @ (a @ basis - centre * basis)
            inner = (inner + inner.T) / 2
            size = float(np.abs(inner).max())
            if size > 0:
                _, turn = np.linalg.eigh((inner / size).astype(np.float64))
                x[:, run] = basis @ turn[:, ::-1].astype(kind)
        if change < 8 * np.finfo(kind).eps * len(a) or (change < 1e-15 and change >= best / 2):
            break
        best = change
    x, values, _, _ = _correct(a, x)
    order = np.argsort(-values, kind="stable")
    return values[order], x[:, order]


def eigenvectors(moments: list[list[int]], sums: list[int], n: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Eigenvalues (falling), unit eigenvectors in columns and trace of the covariance.

    ``moments`` and ``sums`` are exact whole numbers about one centre.  The largest component of every
    vector is positive.
    """
    width = len(sums)
    exact = [[n * moments[i][j] - sums[i] * sums[j] for j in range(width)] for i in range(width)]  # n * n times the covariance
    top = max((abs(exact[i][i]) for i in range(width)), default=0)
    if not top:
        return np.zeros(width), np.eye(width), 0.0
    high = np.array([[v / top for v in row] for row in exact], np.float64)
    kind = np.longdouble
    rest = [[_remainder(v, top, h) for v, h in zip(row, line)] for row, line in zip(exact, high.tolist())]
    a = high.astype(kind) + np.array(rest, np.float64).astype(kind)
    _, first = np.linalg.eigh(high.astype(np.float32))
    values, vectors = refine(a, first[:, ::-1].astype(kind))
    vectors = vectors / np.sqrt((vectors * vectors).sum(0))
    values = (vectors * (a @ vectors)).sum(0)
    sign = np.sign(vectors[np.abs(vectors).argmax(0), np.arange(width)])
    scale = top / n / n
    return (values * scale).astype(np.float64), (vectors * sign).astype(np.float64), sum(exact[i][i] for i in range(width)) / n / n


def _remainder(value: int, top: int, quotient: float) -> float:
    """value / top - quotient, of which the double ``quotient`` is the nearest."""
    over, under = quotient.as_integer_ratio()
    return (value * under - over * top) / (top * under)


# ---------------------------------------------------------------- tables


def fit_list(vectors: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Rows that take part, as vec_id and whole numbers ``x``."""
    fine = F.forall("embedding", lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    x = F.transform("embedding", lambda c: F.floor(c.cast("double") * settings.scale) + settings.shift)
    return vectors.filter(fine & (F.size("embedding") > 0)).select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"))


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch, np.ndarray]]:
    """Width, rows and their matrix of whole numbers, a bounded number of rows at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, _ROWS):
            rows = batch.slice(at, _ROWS)
            widths = np.asarray(rows.column("x").value_lengths())
            for width in np.unique(widths):
                some = rows.filter(pa.array(widths == width))
                yield int(width), some, some.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _add(totals: dict, width: int, values: list[int]) -> None:
    """Add whole numbers of any size."""
    old = totals.get(width)
    totals[width] = values if old is None else [a + b for a, b in zip(old, values)]


def _total(rows: DataFrame, measure, length: Column | None = None) -> dict[int, tuple[int, list[int]]]:
    """Sum ``measure`` (matrix to a list of whole numbers) over all rows of each width: {width: (rows, sums)}.

    A task gives one row per entry of its own total, added up by place; what comes back to the driver has the
    size of one total per width, whatever the number of rows.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, list[int]] = {}
        for width, rows, x in _parts(batches):
            _add(totals, width, [rows.num_rows, *measure(width, x)])
        for width, values in totals.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([width] * len(values), pa.int32()), pa.array(range(len(values)), pa.int32()), pa.array([str(v) for v in values])],
                names=["width", "place", "value"],
            )

    parts = rows.mapInArrow(add, "width int, place int, value string")
    added = parts.groupBy("width", "place").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value"))
    out: dict[int, list[int]] = {}
    for r in added.orderBy("width", "place").collect():
        out.setdefault(r["width"], []).append(int(r["value"]))
    return {width: (values[0], values[1:]) for width, values in out.items()}


def _column_sums(_: int, x: np.ndarray) -> list[int]:
    if np.abs(x).max(initial=0) < 2**62 // max(len(x), 1):
        return x.sum(0).tolist()
    return x.astype(object).sum(0).tolist()


@dataclass(frozen=True)
class Fit:
    """The fit of one width: rows ``n``, sums, eigenvalues (falling), eigenvectors in columns, trace."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    @property
    def rank(self) -> int:
        """Components that have variance beyond rounding."""
        return int((self.values > self.values[0] * len(self.values) * 2.0**-52).sum()) if self.trace else 0


def fit(rows: DataFrame, components: int) -> dict[int, Fit]:
    """Fits for every width of ``rows`` (a written table of ``fit_list``): two passes over it."""
    sums = _total(rows, _column_sums)
    centres = {w: [s // n for s in total] for w, (n, total) in sums.items()}

    def moments(width: int, x: np.ndarray) -> list[int]:
        d = x - np.array(centres[width], np.int64)
        top = float(np.abs(d).max(initial=0))
        d = d.astype(np.float64) if top * top * len(d) < _EXACT else d.astype(object)  # either way without rounding
        gram = d.T @ d
        return [int(gram[i, j]) for i in range(width) for j in range(i + 1)]

    out = {}
    for width, (n, lower) in _total(rows, moments).items():
        square = [[0] * width for _ in range(width)]
        values = iter(lower)
        for i in range(width):
            for j in range(i + 1):
                square[i][j] = square[j][i] = next(values)
        total = sums[width][1]
        about = [s - n * c for s, c in zip(total, centres[width])]
        e, v, trace = eigenvectors(square, about, n)
        out[width] = Fit(n, total, e[:components], v[:, :components], trace)
    return out


def _whiten(f: Fit, x: np.ndarray) -> np.ndarray:
    """Whitened rows; a component without variance is not a number."""
    whole = np.array([s // f.n for s in f.sums], np.int64)
    part = np.array([s % f.n / f.n for s in f.sums])
    scale = np.full(len(f.values), np.nan)
    scale[: f.rank] = np.sqrt(f.values[: f.rank])
    return ((x - whole).astype(np.float64) - part) @ f.vectors / scale


def _deviations(f: Fit, x: np.ndarray) -> list[int | None]:
    """Sum over dimensions of (n*x - S)^2; null beyond 64 bits."""
    d = float(f.n) * np.abs(x).max(initial=0) + max(map(abs, f.sums))
    if d < 2.0**62:
        d = x * np.int64(f.n) - np.array(f.sums, np.int64)
        if float(np.abs(d).max(initial=0)) ** 2 * x.shape[1] < 2.0**62:
            return (d * d).sum(1).tolist()
    d = x.astype(object) * f.n - np.array(f.sums, object)
    return [v if v < 1 << 63 else None for v in (d * d).sum(1).tolist()]


def identity_errors(rows: DataFrame, fits: dict[int, Fit]) -> dict[int, float]:
    """Largest entry of the whitened rows' own covariance minus the identity, for the components that have variance.

    One more pass: sums and second moments of the whitened rows, added in fixed point (2**-40).
    """

    def moments(width: int, x: np.ndarray) -> list[int]:
        f = fits[width]
        w = _whiten(f, x)[:, : f.rank]
        values = [*w.sum(0), *(w.T @ w)[np.tril_indices(f.rank)]]
        return [round(float(v) * 2**40) for v in values]

    out = {}
    for width, (n, values) in _total(rows, moments).items():
        k = fits[width].rank
        mean = np.array([v / n / 2**40 for v in values[:k]])
        covariance = np.zeros((k, k))
        covariance[np.tril_indices(k)] = [v / n / 2**40 for v in values[k:]]
        error = np.abs(covariance - np.tril(np.outer(mean, mean)) - np.eye(k))
        out[width] = float(error.max(initial=0.0))
    return out


def whitened(vectors: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Per row and component: vec_id, component (from 1), n, deviation, whitened, explained, identity_error.

    Rows with a null or empty vector, or a null or non-finite entry, take no part; a row without vec_id
    or with one that others have is a row like others.  Vectors of different lengths are fitted each
    among their own.  There are at most as many components as dimensions.  A component without variance
    (equal rows, one row) has whitened null and explained 0 and is left out of identity_error.
    ``deviation`` is null beyond 64 bits.  Other columns are ignored; an empty table gives none.
    """
    rows = stage(fit_list(vectors, settings), "fit")
    fits = fit(rows, settings.components)
    errors = identity_errors(rows, fits)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for width, some, x in _parts(batches):
            f = fits[width]
            k = len(f.values)
            share = np.array([e / f.trace if i < f.rank else 0.0 for i, e in enumerate(f.values)])
            values = _whiten(f, x).ravel()
            m = len(x)
            yield pa.RecordBatch.from_arrays(
                [
                    some.column("vec_id").take(pa.array(np.repeat(np.arange(m), k))),
                    pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()),
                    pa.array(np.full(m * k, f.n), pa.int64()),
                    pa.array(_deviations(f, x), pa.int64()).take(pa.array(np.repeat(np.arange(m), k))),
                    pa.array(values, mask=np.isnan(values)),
                    pa.array(np.tile(share, m)),
                    pa.array(np.full(m * k, errors[width])),
                ],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.mapInArrow(write, "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
