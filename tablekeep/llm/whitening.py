"""Embedding whitening by spectrum slicing.

Vectors become whole numbers. Spark adds up the sums of all dimensions, then
the products of all pairs of dimensions of the centred vectors, both exactly;
the driver gets d + d(d + 1)/2 numbers, whatever the rows. The leading
eigenvalues of the covariance are isolated by counting: the factorisation
L D Lᵀ of the covariance minus a shift has as many positive pivots as there are
eigenvalues above the shift (Sylvester's law of inertia), so bisection on the
count finds an interval that holds eigenvalue number j alone. A Rayleigh
quotient iteration that starts in the interval converges cubically to it, and
counts on both sides of the value found certify its number. Eigenvalues too
close to be told apart are taken from one narrow interval, their vectors kept
orthogonal to those found before.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablekeep.session import ship_package

from . import vectors

OFFSET = 100_000
COMPONENTS = 8
#: Eigenvalues below this share of the largest count as zero: the covariance
#: is rounded to doubles, which leaves them no correct digits to divide by.
RANK = 1e-11
#: Intervals narrower than this share of the largest eigenvalue are not cut
#: further; what they hold counts as equal.
NARROW = 1e-13
_PIVOT = (1 + 17 ** 0.5) / 8


def positive_pivots(a: np.ndarray) -> int:
    """Number of positive eigenvalues of a symmetric matrix, from the signs of
    the blocks of D in P A Pᵀ = L D Lᵀ with complete pivoting: a block is one
    number, or two rows with one positive and one negative eigenvalue where all
    the diagonal is small (Bunch and Parlett)."""
    a = a.copy()
    positive = 0
    while len(a):
        diagonal = np.abs(np.diag(a))
        i = int(diagonal.argmax())
        off = np.abs(a - np.diag(np.diag(a)))
        r, c = divmod(int(off.argmax()), len(a))
        if max(diagonal[i], off[r, c]) == 0:
            return positive
        picked = [i] if diagonal[i] >= _PIVOT * off[r, c] else [r, c]
        rest = np.delete(np.arange(len(a)), picked)
        block, side = a[np.ix_(picked, picked)], a[np.ix_(rest, picked)]
        positive += 1 if len(picked) == 2 else int(block[0, 0] > 0)
        a = a[np.ix_(rest, rest)] - side @ np.linalg.solve(block, side.T)
        a = (a + a.T) / 2
    return positive


class Spectrum:
    """Counts of eigenvalues above shifts of one symmetric matrix, each
    factorised once."""

    def __init__(self, a: np.ndarray) -> None:
        self.a, self.size = a, len(a)
        self.top = float(np.abs(a).sum(axis=1).max(initial=0.0))  # Gershgorin
        self.counts: dict[float, int] = {}

    def above(self, shift: float) -> int:
        if shift not in self.counts:
            self.counts[shift] = positive_pivots(self.a - shift * np.eye(self.size))
        return self.counts[shift]

    def isolate(self, number: int, low: float, high: float) -> tuple[float, float]:
        """An interval within (low, high] that holds eigenvalue ``number``
        (from 1, falling) alone, or as narrow as ``NARROW``."""
        for shift, n in self.counts.items():  # what is known narrows the start
            if n >= number and low < shift < high:
                low = shift
        for shift, n in self.counts.items():
            if n < number and low < shift < high:
                high = shift
        while high - low > NARROW * self.top and not (self.above(low) == number and self.above(high) == number - 1):
            middle = (low + high) / 2
            if self.above(middle) >= number:
                low = middle
            else:
                high = middle
        return low, high

    def leading(self, most: int) -> list[tuple[float, np.ndarray]]:
        """The ``most`` largest eigenvalues, as far as they are above ``RANK``
        of the largest, with their unit vectors."""
        found: list[tuple[float, np.ndarray]] = []
        floor, start = -1e-9 * self.top - 1e-300, 1.01 * self.top + 1e-300
        while len(found) < min(most, self.size) and self.top > 0:
            number = len(found) + 1
            low, high = self.isolate(number, floor, start)
            while True:
                value, vector = self.converge((low + high) / 2, [v for _, v in found])
                slack = 4 * NARROW * self.top
                if low - slack <= value <= high + slack and self.above(value - slack) >= number > self.above(value + slack):
                    break
                # the iteration ended elsewhere: begin nearer to the eigenvalue
                middle = (low + high) / 2
                if high - low <= NARROW * self.top or middle in (low, high):
                    raise RuntimeError(f"eigenvalue {number} was not certified")
                low, high = (middle, high) if self.above(middle) >= number else (low, middle)
            if value <= RANK * max(self.top / self.size, found[0][0] if found else value):
                break
            found.append((value, vector))
        return found

    def converge(self, shift: float, others: list[np.ndarray]) -> tuple[float, np.ndarray]:
        """Rayleigh quotient iteration from two steps of inverse iteration at
        ``shift``, orthogonal to ``others``."""
        w = np.cos(np.arange(1, self.size + 1) * 1.7)  # any fixed start that no plain basis is orthogonal to
        best = (np.inf, shift, w)
        for step in range(40):
            matrix = self.a - shift * np.eye(self.size)
            try:
                w = np.linalg.solve(matrix, w)
            except np.linalg.LinAlgError:  # the shift is an eigenvalue
                w = np.linalg.solve(matrix + 1e-15 * self.top * np.eye(self.size), w)
            for _ in range(2):
                for v in others:
                    w = w - v * (v @ w)
            w = w / np.linalg.norm(w)
            value = float(w @ self.a @ w)
            residual = float(np.linalg.norm(self.a @ w - value * w))
            if residual < best[0]:
                best = (residual, value, w)
            elif step > 3:  # as good as doubles can hold
                break
            if step >= 1:
                shift = value
        return best[1], best[2]


@dataclass
class Whitening:
    """The fit: rows, sums of the whole components, eigenvalues and vectors
    (columns), trace, and the largest error of the whitened covariance."""

    n: int
    sums: list[int]
    values: np.ndarray
    basis: np.ndarray
    trace: float
    identity_error: float = 0.0

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S/n in doubles, from whole numbers and the fraction of S/n."""
        low = np.array([s // self.n for s in self.sums], np.int64)
        part = np.array([(s % self.n) / self.n for s in self.sums])
        return (x - low).astype(np.float64) - part

    def whiten(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.basis / np.sqrt(self.values)

    def deviations(self, x: np.ndarray) -> list[int]:
        """Sum over dimensions of (n x - S)^2 of each row, exact."""
        low = np.array([s // self.n for s in self.sums], np.int64)
        rest = np.array([s % self.n for s in self.sums], object)
        most = (int(np.abs(x - low).max(initial=0)) + 1) * self.n
        if len(self.sums) * most * most < 1 << 63:
            return (((x - low) * self.n - rest.astype(np.int64)) ** 2).sum(axis=1).tolist()
        return (((x - low).astype(object) * self.n - rest) ** 2).sum(axis=1).tolist()


def offset_whole(column: pa.Array, dims: int) -> np.ndarray:
    return vectors.whole(column, dims) + OFFSET


def common_length(df: DataFrame, vector_col: str) -> int:
    """The length most finite vectors have (ties: the longer one); 0 if there
    is none."""
    v = F.col(vector_col).cast("array<double>")
    top = (df.filter(vectors.finite(v) & (F.size(v) > 0)).groupBy(F.size(v).alias("d")).count()
           .orderBy(F.col("count").desc(), F.col("d").desc()).first())
    return top["d"] if top else 0


def fit(rows: DataFrame, dims: int, components: int = COMPONENTS) -> Whitening | None:
    """Fit on all rows of ``rows(id, vector)``; None if there are none."""
    def sums(batch: pa.RecordBatch) -> np.ndarray:
        x = offset_whole(batch.column(1), dims)
        return np.concatenate([[len(x)], x.sum(axis=0)])
    totals = vectors.exact_totals(rows, sums)
    if not totals:
        return None
    n, total = totals[0], [totals[i + 1] for i in range(dims)]
    low = np.array([s // n for s in total], np.int64)
    upper = np.triu_indices(dims)

    def products(batch: pa.RecordBatch) -> np.ndarray:
        y = offset_whole(batch.column(1), dims) - low
        most = int(np.abs(y).max(initial=0))
        if len(y) * most * most < 1 << 53:  # doubles are exact there
            f = y.astype(np.float64)
            return (f.T @ f)[upper].astype(np.int64)
        return np.array([sum((y[:, i].astype(object) * y[:, j].astype(object)).tolist()) for i, j in zip(*upper)], object)
    got = vectors.exact_totals(rows, products)
    rest = [s - n * int(v) for s, v in zip(total, low)]
    covariance = np.zeros((dims, dims))
    for at, (i, j) in enumerate(zip(*upper)):  # whole numbers up to the one rounding of the quotient
        covariance[i, j] = covariance[j, i] = (n * got[at] - rest[i] * rest[j]) / (n * n)
    pairs = Spectrum(covariance).leading(components)
    values = np.array([v for v, _ in pairs])
    basis = np.array([w * np.sign(w[np.abs(w).argmax()]) for _, w in pairs]).reshape(-1, dims).T
    model = Whitening(n, total, values, basis, float(np.trace(covariance)))
    if len(pairs):
        model.identity_error = identity_error(rows, model, dims)
    return model


def identity_error(rows: DataFrame, model: Whitening, dims: int) -> float:
    """Largest absolute entry of the covariance of all whitened rows minus the
    identity, from one more pass."""
    m = len(model.values)

    def run(batch: pa.RecordBatch) -> np.ndarray:
        z = model.whiten(offset_whole(batch.column(1), dims))
        return np.concatenate([z.sum(axis=0), (z.T @ z).reshape(-1)])
    got = vectors.float_totals(rows, run)
    mean = np.array([got[i] for i in range(m)]) / model.n
    second = np.array([got[m + i] for i in range(m * m)]).reshape(m, m) / model.n
    return float(np.abs(second - np.outer(mean, mean) - np.eye(m)).max())


def whitened(rows: DataFrame, model: Whitening, dims: int) -> DataFrame:
    """``(id, whitened array<double>, deviation decimal)`` of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = offset_whole(batch.column(1), dims)
                z = model.whiten(x)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(z) + 1, dtype=np.int32) * z.shape[1]), pa.array(z.reshape(-1)))
                yield pa.RecordBatch.from_arrays([batch.column(0), flat, pa.array([str(v) for v in model.deviations(x)])],
                                                 names=["id", "whitened", "deviation"])
    ship_package(rows.sparkSession)
    out = rows.mapInArrow(run, "id long, whitened array<double>, deviation string")
    return out.withColumn("deviation", F.col("deviation").cast("decimal(38,0)"))


def whitening_report(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(vec_id, component, n, deviation, whitened, explained,
    identity_error)``: a row for every vector and component.

    Vectors that are null, empty or hold a null or non-finite entry are
    dropped, and where lengths differ all but those of the most common one. No
    rows, or no variance, give an empty result; fewer than eight eigenvalues
    above zero as many components. Repeated rows count each, null ids stay
    null. A deviation beyond a long is null. Other columns are ignored.
    """
    empty = df.sparkSession.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    dims = common_length(df, vector_col)
    if not dims:
        return empty
    rows = vectors.usable(df, id_col, vector_col, dims)
    model = fit(rows, dims)
    if model is None or not len(model.values):
        return empty
    explained = F.array(*[F.lit(float(v / model.trace)) for v in model.values])
    return (whitened(rows, model, dims)
            .select("id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
            .select(F.col("id").alias("vec_id"), (F.col("at") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"),
                    F.expr("try_cast(deviation AS bigint)").alias("deviation"), "whitened",
                    F.get(explained, F.col("at")).alias("explained"), F.lit(model.identity_error).alias("identity_error")))
