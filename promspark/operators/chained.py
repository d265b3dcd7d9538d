"""Chained equations (MICE) from one reading of the training rows.

Each step of the method regresses one incomplete column on all others over the rows where it was observed, and
gives its missing cells the prediction.  A step is linear in the row, so rows with the same missing columns need
not be kept: a factor R of at most columns + 1 rows with R'R = Z'Z (their QR factor) has the same moments, now
and after every step.  Training rows become such factors by one pass (a small group of rows stays as it is); all
rounds then run on the factors, by the same update as on rows.

* one aggregate reads counts and means, one pass the factors: no job per step, no checkpoint per round;
* factors up to ``limit`` bytes are chained on the driver; a larger table of them stays in the shared folder, and
  each step is a sum over it (tasks repeat the steps of the round so far; a round's end is written);
* ``transform`` replays the steps on batches of rows of any split.

Predictors are centred on the training means, which are also the starting values.  Columns are taken by rising
number of missing cells.  Categorical columns are coded by their sorted labels, and decoded by rounding half to
even and clipping to the range of codes; bounds given in ``clip`` hold for the result of numeric columns.
Observed cells never change.  NaN counts as missing.  A column without an observed training value stays as it is.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written_table

cloudpickle.register_pickle_by_value(sys.modules[__name__])

FACTOR = "mask binary, data binary"
MAX_LABELS = 10_000
LANES = 256


def _squeezed(z: np.ndarray) -> np.ndarray:
    """At most as many rows as columns, with the same moments."""
    return np.linalg.qr(z, mode="r") if len(z) > z.shape[1] else z


class _Factors:
    """Rows by mask, squeezed whenever a mask has twice as many as it needs."""

    def __init__(self, width: int):
        self.width, self.held, self.rows, self.sizes = width, {}, 0, {}

    def add(self, mask: bytes, z: np.ndarray) -> None:
        parts = self.held.setdefault(mask, [])
        parts.append(z)
        self.rows += len(z)
        self.sizes[mask] = size = self.sizes.get(mask, 0) + len(z)
        if size >= 2 * self.width:
            self.held[mask] = [_squeezed(np.concatenate(parts))]
            self.sizes[mask] = len(self.held[mask][0])
            self.rows += self.sizes[mask] - size

    def batches(self, size: int = 1000) -> Iterator[pa.RecordBatch]:
        masks = list(self.held)
        for k in range(0, len(masks), size):
            part = masks[k:k + size]
            data = [_squeezed(np.concatenate(self.held.pop(m))).astype("<f8").tobytes() for m in part]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.binary()), pa.array(data, pa.binary())], names=["mask", "data"])
        self.rows = 0
        self.sizes.clear()


def _from_rows(means: np.ndarray, most: int = 1 << 25):
    """Rows of nullable doubles to factors by mask: a 1 in front, centred, missing cells 0."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = _Factors(len(means) + 1)
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False).astype(np.float64) for c in batch.columns]) - means
            gone = np.isnan(x)
            z = np.column_stack([np.ones(len(x)), np.where(gone, 0.0, x)])
            bits = np.packbits(gone, axis=1)
            order = np.lexsort(bits.T)
            bits, z = bits[order], z[order]
            starts = np.flatnonzero(np.append(True, (bits[1:] != bits[:-1]).any(1))) if len(bits) else []
            for a, b in zip(starts, [*starts[1:], len(z)]):
                got.add(bits[a].tobytes(), z[a:b])
            if got.rows * got.width * 8 > most:
                yield from got.batches()
        yield from got.batches()
    return run


def _combined(width: int):
    """Factors sorted by mask to one per mask."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got, last = _Factors(width), None
        for batch in batches:
            for mask, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if mask != last and got.rows * width * 8 > 1 << 22:
                    yield from got.batches()
                last = mask
                got.add(mask, np.frombuffer(data, "<f8").reshape(-1, width))
        yield from got.batches()
    return run


def _unpacked(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, missing cells per row) of a batch of factors."""
    z = [np.frombuffer(d, "<f8").reshape(-1, width) for d in batch.column(1).to_pylist()]
    counts = [len(p) for p in z]
    bits = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint8).reshape(len(z), -1)
    gone = np.unpackbits(bits, axis=1)[:, :width - 1].astype(bool)
    return (np.concatenate(z) if z else np.zeros((0, width))), np.repeat(gone, counts, axis=0)


def ridge(s: np.ndarray, c: int, alpha: float) -> np.ndarray:
    """Weights of [1, columns] that predict column ``c`` from moments ``s``; slopes are penalised, c's own is 0."""
    others = [k for k in range(1, len(s)) if k != c]
    n, m, mc = s[0, 0], s[0, others] / s[0, 0], s[0, c] / s[0, 0]
    inner = s[np.ix_(others, others)] - n * np.outer(m, m)
    against = s[others, c] - n * m * mc
    if alpha > 0:
        slopes = np.linalg.solve(inner + alpha * np.eye(len(others)), against)
    else:  # columns may depend on each other
        slopes = np.linalg.lstsq(inner, against, rcond=None)[0]
    w = np.zeros(len(s))
    w[others], w[0] = slopes, mc - m @ slopes
    return w


def _replay(z: np.ndarray, gone: np.ndarray, steps: Sequence[tuple[int, np.ndarray]]) -> np.ndarray:
    for c, w in steps:
        rows = gone[:, c - 1]
        z[rows, c] = z[rows] @ w
    return z


def _chain_here(z: np.ndarray, gone: np.ndarray, order: Sequence[int], rounds: int, alpha: float) -> list[tuple[int, np.ndarray]]:
    """All rounds on factors in memory; the moments of all rows are kept up to date, those of the rows without a
    column are taken off."""
    steps, h = [], z.T @ z
    missing = {c: np.flatnonzero(gone[:, c - 1]) for c in order}
    present = {c: np.flatnonzero(~gone[:, c - 1]) for c in order if 2 * len(missing[c]) > len(z)}
    for _ in range(rounds):
        for c in order:
            rows = missing[c]
            part = z[present.get(c, rows)]
            w = ridge(part.T @ part if c in present else h - part.T @ part, c, alpha)
            z[rows, c] = z[rows] @ w
            h[c] = h[:, c] = z.T @ z[:, c]
            steps.append((c, w))
    return steps


def _chain_there(table: DataFrame, width: int, order: Sequence[int], rounds: int, alpha: float) -> list[tuple[int, np.ndarray]]:
    """The same on a table of factors that stays distributed."""
    done: list[tuple[int, np.ndarray]] = []
    for _ in range(rounds):
        now: list[tuple[int, np.ndarray]] = []
        for c in order:
            def moments(batches, c=c, steps=tuple(now)):
                total = np.zeros((width, width))
                for batch in batches:
                    z, gone = _unpacked(batch, width)
                    z = _replay(z, gone, steps)[~gone[:, c - 1]]
                    total += z.T @ z
                yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()], pa.list_(pa.float64()))], names=["part"])

            cells = table.mapInArrow(moments, "part array<double>").select(F.posexplode("part").alias("k", "x")).groupBy("k").agg(F.sum("x").alias("x"))
            s = np.zeros(width * width)
            for r in cells.collect():
                s[r["k"]] = r["x"]
            now.append((c, ridge(s.reshape(width, width), c, alpha)))

        def advanced(batches, steps=tuple(now)):
            for batch in batches:
                z, gone = _unpacked(batch, width)
                z, data, at = _replay(z, gone, steps), [], 0
                for d in batch.column(1).to_pylist():
                    k = len(d) // (8 * width)
                    data.append(z[at:at + k].astype("<f8").tobytes())
                    at += k
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary())], names=["mask", "data"])

        table = written_table(table.mapInArrow(advanced, FACTOR))
        done += now
    return done


class ChainedImputer:
    """Chained equations over numeric and categorical columns; see the module.

    After ``fit``: ``steps`` is (round, column, [intercept, a slope per other column in order]) in fitting order,
    ``means`` the starting values, ``labels`` the codes of the categorical columns."""

    def __init__(self, cols: Sequence[str], rounds: int = 10, alpha: float = 1.0, clip: dict | None = None,
                 categorical: Sequence[str] = (), limit: int = 1 << 28):
        self.cols, self.rounds, self.alpha, self.clip = list(cols), rounds, alpha, clip or {}
        self.categorical, self.limit = [c for c in cols if c in set(categorical)], limit
        self.labels: dict[str, list[str]] = {}
        self.means: dict[str, float] = {}
        self.steps: list[tuple[int, str, list[float]]] = []
        self._steps: list[tuple[int, np.ndarray]] = []
        self.factor_rows = 0

    def _number(self, c: str) -> Column:
        if c in self.labels:
            at = F.array_position(F.array(*map(F.lit, self.labels[c])).cast("array<string>"), F.col(f"`{c}`").cast("string"))
            return F.when(at > 0, (at - 1).cast("double"))
        x = F.col(f"`{c}`").cast("double")
        return F.when(~F.isnan(x), x)

    def fit(self, train: DataFrame, labels_from: DataFrame | None = None) -> "ChainedImputer":
        """``labels_from``: the rows whose labels are coded (the training rows unless given)."""
        self.labels = {}
        if self.categorical:
            found = (labels_from or train).agg(*[F.array_sort(F.collect_set(F.col(f"`{c}`").cast("string"))).alias(f"l{k}") for k, c in enumerate(self.categorical)]).first()
            self.labels = {c: list(found[k]) for k, c in enumerate(self.categorical)}
            wide = [c for c in self.categorical if len(self.labels[c]) > MAX_LABELS]
            if wide:
                raise ValueError(f"more than {MAX_LABELS} labels: {wide}")
        numbers = train.select(*[self._number(c).alias(f"c{k}") for k, c in enumerate(self.cols)])
        one = numbers.agg(F.count(F.lit(1)).alias("n"), *[f(f"c{k}").alias(f"{f.__name__}{k}") for k in range(len(self.cols)) for f in (F.count, F.avg)]).first()
        self._used = [k for k in range(len(self.cols)) if one[f"count{k}"]]
        self.means = {self.cols[k]: one[f"avg{k}"] for k in self._used}
        gaps = {j + 1: one["n"] - one[f"count{k}"] for j, k in enumerate(self._used)}
        order = sorted((j for j, n in gaps.items() if n), key=lambda j: (gaps[j], j))
        self._steps, width = [], len(self._used) + 1
        if order and width > 2:
            means = np.array(list(self.means.values()))
            parts = numbers.select(*[f"c{k}" for k in self._used]).mapInArrow(_from_rows(means), FACTOR)
            # the factors of a frequent mask meet in lanes first, one per lane then
            parts = parts.withColumn("lane", F.pmod(F.spark_partition_id(), F.lit(LANES)))
            parts = parts.repartition("mask", "lane").sortWithinPartitions("mask").select("mask", "data").mapInArrow(_combined(width), FACTOR)
            table = written_table(parts.repartition("mask").sortWithinPartitions("mask").mapInArrow(_combined(width), FACTOR))
            self.factor_rows = int(table.agg(F.sum(F.octet_length("data"))).first()[0] or 0) // (8 * width)
            if self.factor_rows * width * 8 <= self.limit:
                held = [_unpacked(b, width) for b in table.toArrow().to_batches()]
                z, gone = (np.concatenate([h[k] for h in held]) for k in range(2))
                self._steps = _chain_here(z, gone, order, self.rounds, self.alpha)
            else:
                self._steps = _chain_there(table, width, order, self.rounds, self.alpha)
        elif order:  # nothing to regress on: the mean
            self._steps = [(c, np.zeros(width)) for _ in range(self.rounds) for c in order]
        mean = np.array([0.0, *self.means.values()])
        self.steps = []
        for k, (c, w) in enumerate(self._steps):
            others = [j for j in range(1, width) if j != c]
            self.steps.append((k // max(1, len(order)), self.cols[self._used[c - 1]], [float(mean[c] + w[0] - mean[others] @ w[others]), *map(float, w[others])]))
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with the missing cells of the fitted columns filled; numeric columns become double."""
        names = [self.cols[k] for k in self._used]
        if not names:
            return df
        means, steps = np.array([self.means[c] for c in names]), self._steps
        kind = "struct<" + ", ".join(f"c{k}: double" for k in range(len(names))) + ">"

        @F.pandas_udf(kind)
        def filled(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for rows in parts:
                x = rows.to_numpy(np.float64, na_value=np.nan) - means
                gone = np.isnan(x)
                z = _replay(np.column_stack([np.ones(len(x)), np.where(gone, 0.0, x)]), gone, steps)
                yield pd.DataFrame(z[:, 1:] + means, columns=[f"c{k}" for k in range(len(names))])

        out = df.withColumn("__filled", filled(F.struct(*[self._number(c).alias(f"c{k}") for k, c in enumerate(names)])))
        done = {}
        for k, c in enumerate(names):
            got = F.col(f"__filled.c{k}")
            if c in self.labels:
                code = F.least(F.greatest(F.rint(got), F.lit(0.0)), F.lit(float(len(self.labels[c]) - 1))).cast("int")
                label = F.get(F.array(*map(F.lit, self.labels[c])).cast("array<string>"), code)
                done[c] = F.coalesce(F.col(f"`{c}`"), label.cast(df.schema[c].dataType))
            else:
                lo, hi = self.clip.get(c, (None, None))
                got = F.greatest(F.lit(float(lo)), got) if lo is not None else got
                got = F.least(F.lit(float(hi)), got) if hi is not None else got
                done[c] = F.coalesce(self._number(c), got)
        return out.withColumns(done).drop("__filled")
