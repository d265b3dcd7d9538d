"""Cross-validated linear models from two readings of the table.

Least squares, ridge and lasso need a training set's second moments only, and those of a union of folds are the
sum of the folds'.  One pass makes, for every fold of every repeat and for the test rows, the QR factor R of
[1, x, y] (columns + 2 rows at most, R'R = the moments, without squaring the condition).  A training set is the
stack of its folds' factors: every model of every fold, a whole lasso path included, is fitted on these.  The sum of
squared errors of a fold comes from its own factor; a second pass over the rows adds up the absolute errors of all
models at once.

Features: numeric columns, standardised by the training set (population deviation, constant columns are left at
0), and one column per label of each categorical; a null is the label ``missing``, unknown labels are all 0.
The intercept is not penalised.

* linear: least squares, of least norm where columns depend on each other;
* ridge: (X'X + alpha I) b = X'y;
* lasso: 1/(2n) |y - Xb|^2 + alpha |b|_1 by coordinate descent on X'X, all folds and penalties together.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .chained import FACTOR, LANES, _combined, _Factors
from .split import folds as add_folds

cloudpickle.register_pickle_by_value(sys.modules[__name__])

MISSING = "missing"
MAX_FEATURES = 4000
TEST = (255, 255)
CLOSE, IDLE = 1e-7, 3


@dataclass
class Model:
    """Weights of [1, features], in the order of ``names``."""

    kind: str
    alpha: float
    names: list[str]
    weights: np.ndarray


@dataclass
class Scores:
    """What ``evaluate`` found: one row per model and fold, one per model on the test rows, and the models
    fitted on all training rows."""

    folds: list[tuple]  # (model, repeat, fold, n, mae, rmse, r2)
    test: list[tuple]  # (model, n, mae, rmse, r2)
    models: dict[str, Model]


def feature_columns(train: DataFrame, numeric: Sequence[str], categorical: Sequence[str]) -> list[tuple[str, Column]]:
    """(name, double column) of every feature; labels are those of ``train``, sorted."""
    out = [(c, F.col(f"`{c}`").cast("double")) for c in numeric]
    if categorical:
        value = {c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(MISSING)) for c in categorical}
        found = train.agg(*[F.array_sort(F.collect_set(value[c])).alias(f"l{k}") for k, c in enumerate(categorical)]).first()
        out += [(f"{c}={v}", (value[c] == v).cast("double")) for k, c in enumerate(categorical) for v in found[k]]
    if len(out) > MAX_FEATURES:
        raise ValueError(f"{len(out)} features, at most {MAX_FEATURES} are fitted on one machine")
    return out


def _factors_by_cell(width: int, repeats: int):
    """Rows (fold per repeat; -1 for test rows; x, y) to factors of [1, x, y] by (repeat, fold)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = _Factors(width)
        for batch in batches:
            z = np.column_stack([np.ones(batch.num_rows), *(c.to_numpy(zero_copy_only=False) for c in batch.columns[repeats:])])
            if not np.isfinite(z).all():
                raise ValueError("a feature or label is null or not finite: fill it first")
            for r in range(repeats):
                fold = batch.column(r).to_numpy()
                for f in np.unique(fold).tolist():
                    if f >= 0:
                        got.add(bytes((r, f)), z[fold == f])
                    elif not r:
                        got.add(bytes(TEST), z[fold == f])
        yield from got.batches()
    return run


def _errors(width: int, repeats: int, weights: dict[tuple[int, int], np.ndarray]):
    """Sums of absolute errors: (repeat, fold, model) of each task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            z = np.column_stack([np.ones(batch.num_rows), *(c.to_numpy(zero_copy_only=False) for c in batch.columns[repeats:])])
            for r in range(repeats):
                fold = batch.column(r).to_numpy()
                for f in np.unique(fold).tolist():
                    cell = (r, f) if f >= 0 else TEST
                    if f >= 0 or not r:
                        part = z[fold == f]
                        e = np.abs(part[:, -1:] - part[:, :-1] @ weights[cell]).sum(0)
                        total[cell] = total.get(cell, 0) + e
        rows = [(r, f, m, float(e)) for (r, f), es in total.items() for m, e in enumerate(es)]
        yield pa.RecordBatch.from_pylist([dict(zip(("r", "f", "m", "e"), x)) for x in rows],
                                         schema=pa.schema([("r", pa.int32()), ("f", pa.int32()), ("m", pa.int32()), ("e", pa.float64())]))
    return run


def factors(rows: DataFrame, width: int, repeats: int) -> dict[tuple[int, int], np.ndarray]:
    """The factor of each (repeat, fold), and of the test rows."""
    parts = rows.mapInArrow(_factors_by_cell(width, repeats), FACTOR).withColumn("lane", F.pmod(F.spark_partition_id(), F.lit(LANES)))
    parts = parts.repartition("mask", "lane").sortWithinPartitions("mask").select("mask", "data").mapInArrow(_combined(width), FACTOR)
    parts = parts.repartition("mask").sortWithinPartitions("mask").mapInArrow(_combined(width), FACTOR)
    return {(r["mask"][0], r["mask"][1]): np.frombuffer(r["data"], "<f8").reshape(-1, width) for r in parts.collect()}


class _Training:
    """A training set by its factor: means, deviations, and the centred, scaled factor."""

    def __init__(self, parts: Sequence[np.ndarray], numeric: int):
        r = np.linalg.qr(np.concatenate(parts), mode="r")
        r = r if len(r) == r.shape[1] else np.vstack([r, np.zeros((r.shape[1] - len(r), r.shape[1]))])
        self.n = r[0, 0] ** 2
        self.means = r[0, 1:] / r[0, 0]
        self.c = r[1:, 1:]  # the rows below the constant column hold the centred moments
        self.scale = np.ones(r.shape[1] - 2)
        deviation = np.linalg.norm(self.c[:, :-1], axis=0) / math.sqrt(self.n)
        flat = deviation <= 1e-12 * np.maximum(1, np.abs(self.means[:-1]))
        self.scale[:numeric] = np.where(flat, 1.0, deviation)[:numeric]
        self.x, self.y = np.where(flat, 0.0, self.c[:, :-1] / self.scale), self.c[:, -1]

    def back(self, slopes: np.ndarray) -> np.ndarray:
        """Weights of [1, features] from slopes of the scaled features (… x features)."""
        b = slopes / self.scale
        return np.concatenate([self.means[-1] - b @ self.means[:-1, None], b], axis=-1)

    def linear(self) -> np.ndarray:
        return self.back(np.linalg.lstsq(self.x, self.y, rcond=1e-12)[0])

    def ridge(self, alpha: float) -> np.ndarray:
        return self.back(np.linalg.solve(self.x.T @ self.x + alpha * np.eye(self.x.shape[1]), self.x.T @ self.y))


def lasso_slopes(trainings: Sequence[_Training], alphas: np.ndarray, tol: float = 1e-12, most: int = 20_000) -> np.ndarray:
    """(training set, penalty, feature) slopes of the scaled features: cyclic coordinate descent for all sets and
    penalties at once.  Every 40 rounds an active-set search goes on from there, which ends at the optimum after few
    steps.  A problem is settled by that, by a duality gap below ``tol`` of the label's variance, or, where columns are
    equal but for 1e-6 or so, by a gap below ``CLOSE`` from where ``IDLE`` such searches on end have not got lower."""
    g = np.stack([t.x.T @ t.x / t.n for t in trainings])
    c = np.stack([t.x.T @ t.y / t.n for t in trainings])
    size = np.array([max(t.y @ t.y / t.n, 1e-300) for t in trainings])[:, None]
    b = np.zeros((len(trainings), len(alphas), g.shape[1]))
    diagonal = np.einsum("fpp->fp", g)
    live = [j for j in range(g.shape[1]) if (diagonal[:, j] > 0).any()]
    own = np.where(diagonal > 0, diagonal, np.inf)  # constant columns stay at 0
    settled = np.zeros(b.shape[:2], bool)

    def gaps() -> np.ndarray:
        gb = b @ g
        left = c[:, None] - gb
        fit, quad = (b * c[:, None]).sum(2), (b * gb).sum(2)
        rr, yr = size - 2 * fit + quad, size - fit
        s = np.minimum(1, alphas / np.maximum(np.abs(left).max(2), 1e-300))
        return (0.5 * rr + alphas * np.abs(b).sum(2) - s * yr + 0.5 * s * s * rr) / size

    def independent(f: int, a: int) -> None:
        """Where columns with a slope depend on each other, slides along the dependence, which leaves the fit as it
        is, in the direction in which the slopes get smaller, until one of them is 0."""
        while True:
            on = np.flatnonzero(b[f, a])
            values, vectors = np.linalg.eigh(g[f][np.ix_(on, on)])
            if not len(on) or values[0] > 1e-11 * values[-1]:
                return
            v = vectors[:, 0] * (-1 if np.sign(b[f, a, on]) @ vectors[:, 0] > 0 else 1)
            ends = np.where(b[f, a, on] * v < 0, -b[f, a, on] / np.where(v == 0, 1, v), np.inf)
            k = int(ends.argmin())
            if not np.isfinite(ends[k]):
                return
            b[f, a, on] += ends[k] * v
            b[f, a, on[k]] = 0.0

    def value(f: int, a: int, x: np.ndarray) -> float:
        return 0.5 * x @ g[f] @ x - c[f] @ x + alphas[a] * np.abs(x).sum()

    def solved(f: int, a: int, steps: int = 200) -> bool:
        """Steps to the solution for the present signs, or as far as lowers the objective most before a sign
        changes; then takes in the feature that is furthest out.  True at the optimum."""
        x, alpha, slack = b[f, a], alphas[a], 1e-12 * math.sqrt(size[f, 0])
        for _ in range(steps):
            independent(f, a)
            sign = np.sign(x)
            left = c[f] - x @ g[f]
            on = np.flatnonzero(sign)
            if not len(on) or np.abs(left[on] - alpha * sign[on]).max() <= slack + 1e-10 * alpha:
                out = np.where((sign == 0) & (diagonal[f] > 0), np.abs(left), 0)
                j = int(out.argmax())
                if out[j] <= alpha * (1 + 1e-9) + slack:
                    return True
                sign[j] = np.sign(left[j])
                on = np.flatnonzero(sign)
            goal = np.zeros_like(x)
            goal[on] = np.linalg.lstsq(g[f][np.ix_(on, on)], c[f, on] - alpha * sign[on], rcond=1e-12)[0]
            move = goal - x
            with np.errstate(divide="ignore", invalid="ignore"):
                ends = np.where((x != 0) & (move != 0), -x / move, np.inf)
            ends = np.unique(np.append(ends[(ends > 0) & (ends < 1)], 1.0))
            tried = [np.where(np.isclose(x + t * move, 0, atol=1e-14 * (1 + np.abs(x).max())), 0, x + t * move) for t in ends]
            best = min(tried, key=lambda y: value(f, a, y))
            if value(f, a, best) >= value(f, a, x):
                return False
            x[:] = best
        return False

    lowest, idle = np.full(b.shape[:2], np.inf), np.zeros(b.shape[:2], int)
    for sweep in range(most):
        for j in live:
            left = c[:, j, None] - (b @ g[:, j, :, None])[..., 0] + b[:, :, j] * g[:, j, j, None]
            b[:, :, j] = np.sign(left) * np.maximum(np.abs(left) - alphas, 0) / own[:, j, None]
        if sweep % 40 == 39:
            gap = gaps()
            settled |= gap <= tol
            for f, a in np.argwhere(~settled):
                settled[f, a] = solved(f, a)
                now = value(f, a, b[f, a])
                idle[f, a] = 0 if now < lowest[f, a] - 1e-14 * size[f, 0] else idle[f, a] + 1
                lowest[f, a] = min(now, lowest[f, a])
            settled |= (idle >= IDLE) & (gap <= CLOSE)
            if settled.all():
                break
    if not settled.all() and gaps().max() > CLOSE:
        raise RuntimeError("coordinate descent did not settle")
    return b


def _fit(trainings: Sequence[_Training], models: dict[str, tuple[str, float]]) -> np.ndarray:
    """(training set, model, weight)."""
    lassos = sorted({a for k, a in models.values() if k == "lasso"})
    slopes = lasso_slopes(trainings, np.array(lassos)) if lassos else None
    out = []
    for i, t in enumerate(trainings):
        out.append([t.linear() if k == "linear" else t.ridge(a) if k == "ridge" else t.back(slopes[i, lassos.index(a)]) for k, a in models.values()])
    return np.array(out)


def _fold_scores(part: np.ndarray, weights: np.ndarray) -> tuple[int, np.ndarray, float]:
    """(rows, squared error per model, squared deviation of the label) of a fold from its factor."""
    r = np.linalg.qr(part, mode="r")
    sse = ((r[:, -1:] - r[:, :-1] @ weights.T) ** 2).sum(0)
    return round(r[0, 0] ** 2), sse, float((r[1:, -1] ** 2).sum())


#: The registry: name -> (kind, penalty).
MODELS = {"linear": ("linear", 0.0), "ridge": ("ridge", 1.0), "lasso": ("lasso", 0.01)}


def _rows(df: DataFrame, xs: Sequence[tuple[str, Column]], label: str, k: int, repeats: int, key: str, split: str | None) -> DataFrame:
    for r in range(repeats):
        df = add_folds(df, k, key, repeat=r, col=f"__f{r}")
    test = (F.col(split) == "test") if split else F.lit(False)
    return df.select(*[F.when(test, -1).otherwise(F.col(f"__f{r}")).alias(f"f{r}") for r in range(repeats)],
                     *[x.alias(f"x{i}") for i, (_, x) in enumerate(xs)], F.col(f"`{label}`").cast("double").alias("y"))


def evaluate(df: DataFrame, label: str, numeric: Sequence[str], categorical: Sequence[str] = (), models: dict[str, tuple[str, float]] = MODELS,
             k: int = 5, repeats: int = 1, key: str = "record_id", split: str | None = "split") -> Scores:
    """Repeated k-fold of every model on the training rows, and fits on all of them scored on the test rows
    (``split`` is ``test``); without ``split`` all rows are training rows."""
    train = df.where(F.col(split) != "test") if split else df
    xs = feature_columns(train, numeric, categorical)
    rows, width, names = _rows(df, xs, label, k, repeats, key, split), len(xs) + 2, [n for n, _ in xs]
    parts = factors(rows, width, repeats)
    cells = sorted(c for c in parts if c != TEST)
    if not cells:
        return Scores([], [], {})
    others = {(r, f): [parts[q] for q in cells if q[0] == r and q[1] != f] for r, f in cells}
    usable = [c for c in cells if others[c]]
    whole = _Training([parts[c] for c in cells if c[0] == 0], len(numeric))
    fitted = _fit([whole, *(_Training(others[c], len(numeric)) for c in usable)], models)
    weights = dict(zip(usable, fitted[1:])) | {TEST: fitted[0]}
    weights |= {c: fitted[0] for c in cells if c not in weights}  # a single fold has no training rows: not reported
    found = rows.mapInArrow(_errors(width, repeats, {c: w.T for c, w in weights.items()}), "r int, f int, m int, e double")
    absolute = {(r["r"], r["f"], r["m"]): r["e"] for r in found.groupBy("r", "f", "m").agg(F.sum("e").alias("e")).collect()}
    folds, test = [], []
    for c in [*usable, *([TEST] if TEST in parts else [])]:
        n, sse, sst = _fold_scores(parts[c], weights[c])
        for m, name in enumerate(models):
            row = (n, absolute[(*c, m)] / n, math.sqrt(sse[m] / n), 1 - float(sse[m]) / sst if sst > 0 else None)
            if c == TEST:
                test.append((name, *row))
            else:
                folds.append((name, *c, *row))
    return Scores(folds, test, {name: Model(kind, a, names, fitted[0][m]) for m, (name, (kind, a)) in enumerate(models.items())})


@dataclass
class Path:
    """A lasso path: penalties from the smallest that sets all slopes to 0, the squared error of each fold
    (fold, penalty), and the model at the penalty of the least mean error."""

    alphas: np.ndarray
    errors: np.ndarray
    best: Model


def lasso_path(df: DataFrame, label: str, numeric: Sequence[str], categorical: Sequence[str] = (), penalties: int = 100, least: float = 1e-3,
               k: int = 5, key: str = "record_id") -> Path:
    """The penalties run down to ``least`` of the largest in equal ratios; one pass over the rows."""
    xs = feature_columns(df, numeric, categorical)
    parts = factors(_rows(df, xs, label, k, 1, key, None), len(xs) + 2, 1)
    cells = sorted(parts)
    whole = _Training([parts[c] for c in cells], len(numeric))
    top = float(np.abs(whole.x.T @ whole.y).max()) / whole.n
    alphas = top * least ** (np.arange(penalties) / (penalties - 1))
    trainings = [_Training([parts[q] for q in cells if q != c], len(numeric)) for c in cells]
    slopes = lasso_slopes(trainings, alphas)
    errors = np.array([[s / n for s in sse] for n, sse, _ in (_fold_scores(parts[c], t.back(slopes[i])) for i, (c, t) in enumerate(zip(cells, trainings)))])
    at = int(np.argmin(errors.mean(0)))
    best = whole.back(lasso_slopes([whole], alphas[at:at + 1])[0, 0])
    return Path(alphas, errors, Model("lasso", float(alphas[at]), [n for n, _ in xs], best))


def predict(df: DataFrame, model: Model, xs: Sequence[tuple[str, Column]], out: str = "prediction") -> DataFrame:
    """``df`` with the model's prediction, a sum of products of its feature columns."""
    total = F.lit(float(model.weights[0]))
    for (name, x), b in zip(xs, model.weights[1:]):
        total = total + F.coalesce(x, F.lit(0.0)) * F.lit(float(b))
    return df.withColumn(out, total)
