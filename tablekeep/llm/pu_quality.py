"""Quality classifier by positive-unlabelled learning.

A linear scorer on text statistics minimises the non-negative unbiased PU risk
(Kiryo et al. 2017) with logistic loss::

    prior * E_P[loss(g)] + max(0, E_U[loss(-g)] - prior * E_P[loss(-g)])

Trusted positives are labelled good rows; the unlabelled side is all documents.
Where the second term is not below zero, the risk is convex: loss(g) - loss(-g)
is -g, so it is E_U[loss(-g)] less the positives' mean score times the prior.
Newton steps go down it, with sums over all documents for the loss, gradient
and curvature of the unlabelled side (one Spark aggregate a step); they stop
where the second term, the estimated risk of the negatives, would fall below
zero. The class prior is estimated from the labelled training rows, or, where
no bad row is labelled, from the positives and unlabelled scores alone. The
margin is then mapped to a probability on the labelled rows.

Features of all documents are computed once and staged; mean and scale are of
all documents. All labelled training rows are learned from. Of each kind, up to
``max_rows`` (a documented parameter) come to the driver, whatever ids they
share; if there are more of either, none do, and their sums are Spark
aggregates as well. Labels are learned from training rows only; labels, language, source and id are never
inputs of a score. A text of any length is read whole, in time linear in it.
"""

from __future__ import annotations

import zlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablekeep.operators import ranking

from . import common, vectors

MAX_ROWS = 20_000  # labelled rows of a kind that the driver holds; of more it gets sums
MOST_STEPS = 25
L2, L2_ROWS = 0.05, 20.0  # penalty of the weights: L2, and L2_ROWS divided by the positives there are
FOLDS = 5
_COUNTED = ["#*$%&|<>", "!", "|", "?", ".", ",", ";:", "0123456789", "/\\_=+~^@", "()[]{}", "\"'`-"]


def text_features(text: str | None) -> list[float]:
    """Statistics of a whole text; a null text is empty. All are finite."""
    text = text or ""
    data = common.utf8(text)
    words = data.split()
    n, chars = max(1, len(words)), max(1, len(text))
    lines = [x for x in text.split("\n") if x]
    upper = len(data) - len(data.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    vocabulary = set(words)
    ratios = [sum(map(text.count, group)) / n for group in _COUNTED]
    ratios += [
        upper / chars,
        sum(map(bytes.isupper, words)) / n,
        1 - len(vocabulary) / n,
        1 - len(set(zip(words, words[1:]))) / n if len(words) > 1 else 0.0,
        sum(map(bytes.__eq__, words, words[1:])) / n,
        1 - len(set(lines)) / max(1, len(lines)),
        len(lines) / n,
        max(map(len, words), default=0) / 100,
    ]
    return [np.log1p(len(words)), len(data) / n / 10, *np.log1p(np.multiply(ratios, 100.0)), *np.minimum(ratios, 4.0)]


class Model(NamedTuple):
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    slope: float
    shift: float
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(self.slope * z + self.shift, -30, 30)))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def scaled(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Features as the scorer sees them, and a column of ones."""
    return np.column_stack([np.clip((x - mean) / scale, -8, 8), np.ones(len(x))])


def risk_sums(z: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Sums over rows: number, loss of taking them for bad, its gradient and
    its curvature (flat)."""
    g = z @ w
    p = _sigmoid(g)
    return np.concatenate([[len(z), np.logaddexp(0, g).sum()], z.T @ p, ((z * (p * (1 - p))[:, None]).T @ z).reshape(-1)])


def _settled(values: np.ndarray, digits: int = 12) -> np.ndarray:
    """Without the last digits, which depend on the order sums arrive in."""
    return np.array([float(f"{v:.{digits}g}") for v in values])


class Unlabelled:
    """The unlabelled side of the risk; here of an array of features."""

    def __init__(self, x: np.ndarray) -> None:
        self.x = x

    def moments(self) -> tuple[int, np.ndarray, np.ndarray]:
        return len(self.x), self.x.mean(axis=0), self.x.std(axis=0)

    def sums(self, fn) -> np.ndarray:
        """Sum over all rows of what ``fn`` gives for some."""
        return fn(self.x)


class UnlabelledRows(Unlabelled):
    """The same over a table ``(doc_id, x)`` of packed features, by Spark
    aggregates."""

    def __init__(self, features: DataFrame, width: int) -> None:
        self.features, self.width = features, width

    def sums(self, fn) -> np.ndarray:
        width = self.width
        got = vectors.float_totals(self.features, lambda batch: fn(_unpacked(batch.column(1), width)))
        return np.array([got[i] for i in range(len(got))])

    def moments(self) -> tuple[int, np.ndarray, np.ndarray]:
        """Two passes: the second sums squares about the mean."""
        d = self.width
        first = self.sums(lambda x: np.append(x.sum(axis=0), len(x)))
        if not len(first):
            return 0, np.zeros(d), np.ones(d)
        mean = first[:d] / first[d]
        return int(first[d]), mean, np.sqrt(self.sums(lambda x: ((x - mean) ** 2).sum(axis=0)) / first[d])


class Labelled:
    """Labelled training rows as the scorer sees them, good ones (kind 1) and
    bad ones (kind 0); here arrays."""

    def __init__(self, z_p: np.ndarray, z_n: np.ndarray) -> None:
        self.z = {1: z_p, 0: z_n}

    def count(self, kind: int) -> int:
        return len(self.z[kind])

    def sums(self, kind: int, fn) -> np.ndarray:
        """Sum over all rows of a kind of what ``fn`` gives for some."""
        return fn(self.z[kind])

    def quantiles(self, w: np.ndarray, shares: np.ndarray) -> np.ndarray:
        """Quantiles of the good rows' margins."""
        return np.quantile(self.z[1] @ w, shares)

    def settled(self, values: np.ndarray) -> np.ndarray:
        return values


class LabelledRows(Labelled):
    """The same of a staged table ``(kind, doc_id, x)`` of which ``counts``
    says how many rows a kind has, by Spark aggregates."""

    def __init__(self, marked: DataFrame, counts: dict[int, int], width: int) -> None:
        self.marked, self.counts, self.width = marked, counts, width

    def placed(self, mean: np.ndarray, scale: np.ndarray) -> LabelledRows:
        self.mean, self.scale = mean, scale
        return self

    def count(self, kind: int) -> int:
        return self.counts.get(kind, 0)

    def sums(self, kind: int, fn) -> np.ndarray:
        width, mean, scale = self.width, self.mean, self.scale
        got = vectors.float_totals(self.marked.filter(F.col("kind") == kind).select("x"),
                                   lambda batch: fn(scaled(_unpacked(batch.column(0), width), mean, scale)))
        return np.array([got[i] for i in range(len(got))])

    def quantiles(self, w: np.ndarray, shares: np.ndarray) -> np.ndarray:
        width, mean, scale = self.width, self.mean, self.scale

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(scaled(_unpacked(batch.column(0), width), mean, scale) @ w)], names=["g"])
        margins = common.stage(common.map_arrow(self.marked.filter("kind = 1").select("x"), run, "g double"), "pu-margins")
        place = (self.count(1) - 1) * np.asarray(shares)
        low = np.floor(place).astype(int)
        wanted = sorted({*low.tolist(), *np.ceil(place).astype(int).tolist()})
        ranked = ranking.row_number(margins, [], [("g", False)]).filter(F.col("rn").isin([n + 1 for n in wanted]))
        at = {r.rn - 1: r.g for r in ranked.collect()}  # two a quantile
        below, above = (np.array([at[n] for n in x.tolist()]) for x in (low, np.ceil(place).astype(int)))
        return below + (above - below) * (place - low)

    def settled(self, values: np.ndarray) -> np.ndarray:
        return _settled(values, 8)


def estimated_prior(shares_p: np.ndarray, shares_u: np.ndarray, n_u: int) -> float:
    """Upper bound of the positive share of the unlabelled rows: the least
    ratio of their mass to the positives' mass above a score, from the shares
    of both at or above cuts."""
    ratio = [(u + 1 / np.sqrt(n_u)) / max(p, 1e-9) for p, u in zip(shares_p, shares_u)]
    return float(np.clip(min(ratio), 0.02, 0.98))


def minimise(z_p: np.ndarray, risk_u, prior: float, l2: float = 1e-3, non_negative: bool = True) -> np.ndarray:
    """Weights (the last is the bias) of the least PU risk. ``risk_u(w)``: the
    mean loss of the unlabelled rows, its gradient and curvature."""
    return _minimise(z_p.mean(axis=0), lambda w: np.logaddexp(0, z_p @ w).mean(), risk_u, prior, l2, non_negative)


def _minimise(mean_p: np.ndarray, loss_p, risk_u, prior: float, l2: float, non_negative: bool = True) -> np.ndarray:
    """The same from the positives' mean and ``loss_p(w)``, their mean loss if
    taken for bad."""
    d = len(mean_p)
    ridge = l2 * np.append(np.ones(d - 1), 0)
    pull = prior * mean_p

    def at(w: np.ndarray):
        f, grad, hess = risk_u(w)
        negatives = f - prior * loss_p(w)
        return f - pull @ w + ridge @ (w * w) / 2, grad - pull + ridge * w, hess + np.diag(ridge + 1e-9), negatives
    w = np.zeros(d)
    value, grad, hess, _ = at(w)
    for _ in range(MOST_STEPS):
        step = -np.linalg.solve(hess, grad)
        for _ in range(12):  # shorter while the risk does not fall, or that of the negatives falls below zero
            next_value, next_grad, next_hess, negatives = at(w + step)
            if next_value <= value + 1e-12 and (negatives >= 0 or not non_negative):
                break
            step = step / 2
        else:
            break
        gain = value - next_value
        w, value, grad, hess = w + step, next_value, next_grad, next_hess
        if gain < 1e-7:
            break
    return w


def fit_on(x_p: np.ndarray, x_n: np.ndarray, u: Unlabelled, l2: float | None = None, n_p: float | None = None, n_n: float | None = None,
           rows: LabelledRows | None = None) -> Model:
    """Fit on features of trusted positives, labelled bad rows (class prior
    and calibration only) and the unlabelled side. ``n_p`` and ``n_n`` are the
    counts that the positives and bad rows stand for, if these differ: they
    give the prior and weigh the rows in the calibration. With ``rows`` the
    labelled rows are in that table, not in the arrays. Without positives or
    unlabelled rows every score is 0.5."""
    many_p, many_n = (len(x_p), len(x_n)) if rows is None else (rows.count(1), rows.count(0))
    n_p, n_n = many_p if n_p is None else n_p, many_n if n_n is None else n_n
    l2 = L2 + L2_ROWS / max(1, many_p) if l2 is None else l2
    d = x_p.shape[1]
    n_u, mean, scale = u.moments() if many_p else (0, np.zeros(d), np.ones(d))
    if not many_p or not n_u:
        return Model(np.zeros(d), np.ones(d), np.zeros(d), 0.0, 1.0, 0.0, 0.5)
    mean, scale = _settled(mean), np.where(scale < 1e-9, 1.0, _settled(scale))
    known = Labelled(scaled(x_p, mean, scale), scaled(x_n, mean, scale)) if rows is None else rows.placed(mean, scale)
    mean_p = known.sums(1, lambda z: z.sum(axis=0)) / many_p

    def loss_p(w: np.ndarray) -> float:
        return known.sums(1, lambda z: np.array([np.logaddexp(0, z @ w).sum()]))[0] / many_p

    def risk_u(w: np.ndarray):
        got = u.sums(lambda x: risk_sums(scaled(x, mean, scale), w))
        return got[1] / got[0], got[2:d + 3] / got[0], got[d + 3:].reshape(d + 1, d + 1) / got[0]
    if many_n:
        prior = n_p / (n_p + n_n)
    else:
        w = _minimise(mean_p, loss_p, risk_u, 0.5, l2, False)
        cuts = known.quantiles(w, np.linspace(0.0, 0.9, 46))
        shares_p = known.sums(1, lambda z: ((z @ w)[:, None] >= cuts).sum(axis=0).astype(float)) / many_p
        prior = estimated_prior(shares_p, u.sums(lambda x: ((scaled(x, mean, scale) @ w)[:, None] >= cuts).sum(axis=0).astype(float)) / n_u, n_u)
    w = _settled(_minimise(mean_p, loss_p, risk_u, prior, l2), 8)
    slope, shift = 1.0, 0.0
    if many_n:
        for _ in range(200):  # Newton steps of a two-parameter logistic regression
            def sums(kind: int) -> np.ndarray:
                def part(z: np.ndarray) -> np.ndarray:
                    g = z @ w
                    p = _sigmoid(slope * g + shift)  # noqa: B023
                    r, h = kind - p, p * (1 - p) + 1e-9
                    return np.array([np.sum(h * g * g), np.sum(h * g), np.sum(h), np.sum(r * g), np.sum(r)])
                return known.sums(kind, part)
            hgg, hg, h, rg, r = n_p / many_p * sums(1) + n_n / many_n * sums(0)
            step = np.linalg.solve(np.array([[hgg + 1.0, hg], [hg, h + 1e-3]]), np.array([rg - (slope - 1), r]))
            slope, shift = slope + np.clip(step[0], -1, 1), shift + np.clip(step[1], -1, 1)
            if np.abs(step).max() < 1e-8:
                break
        slope, shift = known.settled(np.array([slope, shift]))
        if slope <= 0:  # the labels contradict the risk: leave the margin as it is
            slope, shift = 1.0, 0.0
    return Model(mean, scale, w[:-1], float(w[-1]), float(slope), float(shift), float(prior))


def fit(x_p: np.ndarray, x_n: np.ndarray, x_u: np.ndarray, l2: float | None = None, n_p: float | None = None, n_n: float | None = None) -> Model:
    """``fit_on`` of arrays."""
    return fit_on(x_p, x_n, Unlabelled(x_u), l2, n_p, n_n)


def held_out(id_col: str = "doc_id"):
    """Rows never learned from: crc32 of the id as text, modulo 5, is 0. A
    null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def in_fold(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % FOLDS == 0


def _unpacked(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(-1, width).astype(np.float64)


def features(docs: DataFrame) -> DataFrame:
    """``(doc_id, x)``, staged: the packed text statistics of every row."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = np.array([text_features(t) for t in batch.column(1).to_pylist()], dtype=np.float32)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in x], pa.binary())], names=["doc_id", "x"])
    return common.stage(common.map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, x binary"), "pu-features")


def train_on(rows: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, repeats: bool = False) -> Model:
    """Fit on staged features and labels: all different rows with a label, by
    id and features. The class shares are those of all labelled training rows.
    Beyond ``max_rows`` of a kind the rows stay with the tasks. With
    ``repeats`` equal rows count as often as they are there."""
    width = len(text_features(""))
    marks = (labels.filter("doc_id is not null and quality is not null").filter(~held_out())
             .select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("quality") != 0).cast("int").alias("kind"))
             .groupBy("doc_id").agg(F.max("kind").alias("kind")))
    n_kind = {r.kind: r["count"] for r in marks.groupBy("kind").count().collect()}
    marked = rows.join(marks, "doc_id").select("kind", "doc_id", "x")
    marked = common.stage(marked if repeats else marked.distinct(), "pu-labelled")
    n_rows = {r.kind: r["count"] for r in marked.groupBy("kind").count().collect()}
    # a class counts as many as it has labels, if rows under them are fewer
    n_p, n_n = (max(n_rows[k], 0 if repeats else n_kind.get(k, 0)) if k in n_rows else 0 for k in (1, 0))
    unlabelled = UnlabelledRows(rows, width)
    if max(n_rows.values(), default=0) > max_rows:
        none = np.zeros((0, width))
        return fit_on(none, none, unlabelled, n_p=n_p, n_n=n_n, rows=LabelledRows(marked, n_rows, width))
    got = marked.select("kind", "x").toArrow()
    kind, x = got.column("kind").to_numpy(), _unpacked(got.column("x"), width)
    order = np.lexsort([*x.T, kind])  # the same sums whatever the order of arrival
    kind, x = kind[order], x[order]
    return fit_on(x[kind == 1], x[kind == 0], unlabelled, n_p=n_p, n_n=n_n)


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Model:
    """Fit on the labelled training rows among ``docs`` and all of ``docs``,
    repeated rows as often as they are there."""
    return train_on(features(docs), labels, max_rows, repeats=True)


def score(docs: DataFrame, model: Model, out: str = "score") -> DataFrame:
    """All columns of ``docs`` and ``out``: the probability of good quality."""
    at = docs.columns.index("text")
    names = [*docs.columns, out]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = np.array([text_features(t) for t in batch.column(at).to_pylist()], dtype=np.float32).astype(np.float64)
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.score(x))], names=names)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return common.map_arrow(docs, run, f"{fields}, {out} double")


def classify(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, cut: float = 0.3) -> DataFrame:
    """``(doc_id, held_out, score, predicted)``, one row per row of ``docs``.

    Null texts are empty texts and get a score; null and repeated ids keep
    their rows; an empty table gives an empty result, and without usable
    labels every score is 0.5; other columns are ignored, whatever their
    names.
    """
    rows = features(docs)
    model, width = train_on(rows, labels, max_rows), len(text_features(""))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(_unpacked(batch.column(1), width)))], names=["doc_id", "score"])
    scored = common.map_arrow(rows, run, "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score",
                         (F.col("score") >= cut).cast("int").alias("predicted"))
