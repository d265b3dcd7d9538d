"""Operator 12: whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation.

X is the matrix of the distinct vectors, centred.  From a start direction v the method alternates u = Xv and
v = X'u, orthogonalises each new direction against all earlier ones, and collects the norms in a bidiagonal
matrix B.  The singular values of B become those of X (their squares over n are the eigenvalues of the
covariance), its right singular vectors, carried back by V, the components.

* Entries are scaled and rounded down to integers.  A vector is packed into as few bytes as hold it, distinct
  vectors meet in one shuffle, and are written once as blocks of rows; every step reads these blocks.
* A step is one job: each task centres its blocks, multiplies them by the direction and by what makes the
  earlier u of its rows (u_j = X w_j, so no vector as long as the table is ever stored), and returns sums of as
  many numbers as there are dimensions.  Spark adds them up; the small products are left to the driver.
* Where the orthogonalisation of u cancels most of it, a second pass repeats it on the result.
* An exhausted direction (a norm of 0) is replaced by a fresh one orthogonal to all before, so several equal
  eigenvalues are found too.  The method ends when the residuals of the leading components are at the limit of
  double precision, or after as many steps as dimensions, when the factorisation is complete.

Rules: rows whose vector is null or holds null or non-finite entries are left out.  Vectors shorter than the
longest one count as 0 beyond their end; an empty vector is all 0.  Scaled entries beyond 64 bits stop at the
largest integers.  Repeated vectors count once in the fit, and each gets its rows in the result.  Components
whose deviation is not above 1e-10 of the largest are not reported; a table of one distinct vector has none,
and gives no rows, as does an empty table.  A deviation beyond 64 bits is null.  Repeated and null keys are
kept; extra columns are ignored.  Sizes: the driver and each task hold matrices of dimensions x steps.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, written
from .words import tidy

SCALE, COMPONENTS = 256, 4
BLOCK_BYTES = 1 << 22
BLOCK = "rows int, width int, data binary"
#: Norms under this share of the Frobenius norm count as 0; deviations under RANK of the largest are not reported.
NOTHING, RANK, CLOSE, CANCELLED = 1e-13, 1e-10, 1e-15, 1e-4
_BIG = float(np.nextafter(2.0 ** 63, 0))


def usable(vector: Column) -> Column:
    """True for vectors without null and non-finite entries."""
    inf = F.lit(float("inf"))
    return vector.isNotNull() & F.forall(vector, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) != inf), F.lit(False)))


def _scaled(column: pa.Array, dims: int, scale: float) -> np.ndarray:
    """The integer vectors of a batch, shorter ones filled up with 0."""
    offsets = column.offsets.to_numpy()
    values = column.values.to_numpy(zero_copy_only=False)[offsets[0]:offsets[-1]]
    x = np.clip(np.floor(values * scale), -2.0 ** 63, _BIG).astype(np.int64)
    sizes = np.diff(offsets)
    if len(sizes) and (sizes == dims).all():
        return x.reshape(len(sizes), dims)
    out = np.zeros((len(sizes), dims), np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(x)) - np.repeat(offsets[:-1] - offsets[0], sizes)] = x
    return out


def _widths(x: np.ndarray) -> np.ndarray:
    """Bytes per entry that hold each row."""
    low, high = (x.min(1), x.max(1)) if x.shape[1] else (np.zeros(len(x)), np.zeros(len(x)))
    out = np.full(len(x), 8)
    for w in (4, 2, 1):
        out[(low >= -(1 << 8 * w - 1)) & (high < 1 << 8 * w - 1)] = w
    return out


def _pack(dims: int, scale: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _scaled(batch.column(0), dims, scale)
            w = _widths(x)
            data = [None] * len(x)
            for width in set(w.tolist()):
                rows = np.flatnonzero(w == width)
                raw = np.ascontiguousarray(x[rows].astype(f"<i{width}")).tobytes()
                for k, r in enumerate(rows.tolist()):
                    data[r] = raw[k * width * dims:(k + 1) * width * dims]
            yield pa.RecordBatch.from_arrays([pa.array(w.astype(np.int32)), pa.array(data, pa.binary())], names=["width", "data"])
    return run


def _blocks(dims: int):
    """Packed rows of one width, put together."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[bytes]] = {}

        def block(width: int) -> pa.RecordBatch:
            rows = held.pop(width)
            return pa.RecordBatch.from_arrays([pa.array([len(rows)], pa.int32()), pa.array([width], pa.int32()), pa.array([b"".join(rows)], pa.binary())],
                                              names=["rows", "width", "data"])

        for batch in batches:
            for width, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held.setdefault(width, []).append(data)
                if len(held[width]) * width * max(1, dims) >= BLOCK_BYTES // 2:
                    yield block(width)
        for width in list(held):
            yield block(width)
    return run


def _matrices(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[np.ndarray]:
    for batch in batches:
        for rows, width, data in zip(*(batch.column(k) for k in range(3))):
            yield np.frombuffer(data.as_buffer(), f"<i{width.as_py()}").reshape(rows.as_py(), dims)


def _moments(dims: int):
    """One row per task: rows, largest absolute entry, and the high and low 32 bits of the sums."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, most, high, low = 0, 0, np.zeros(dims, np.int64), np.zeros(dims, np.int64)
        for x in _matrices(batches, dims):
            x = x.astype(np.int64)
            n += len(x)
            most = max(most, int(x.max(initial=0)), -int(x.min(initial=0)))
            high += (x >> 32).sum(0)
            low += (x & 0xFFFFFFFF).sum(0)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([str(most)]), pa.array([high.tolist()], pa.list_(pa.int64())), pa.array([low.tolist()], pa.list_(pa.int64()))],
                                             names=["n", "most", "high", "low"])
    return run


def _sums(per_task, dims: int):
    """A function of a centred block to an array, added up over the blocks of a task: one row per task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for x in _matrices(batches, dims):
            got = per_task(x)
            total = got if total is None else total + got
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["part"])
    return run


@dataclass
class Fit:
    """What the fit found: sizes and sums of the distinct vectors, and the leading components as columns."""

    n: int
    sums: list[int]
    most: int
    trace: float
    values: np.ndarray  # eigenvalues, falling
    vectors: np.ndarray  # dimensions x components
    steps: int
    identity_error: float

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums]) if self.n else np.zeros(len(self.sums))


class Rows:
    """The distinct vectors as a written table of blocks, and products over them."""

    def __init__(self, table: DataFrame, dims: int):
        self.table, self.dims = table, dims
        # a moment's sum has as many entries as dimensions, exact as decimals
        parts = table.mapInArrow(tidy(_moments(dims)), "n bigint, most string, high array<bigint>, low array<bigint>")
        parts = written(parts)
        one = parts.agg(F.sum("n").alias("n"), F.max(F.col("most").cast("decimal(20,0)")).alias("most")).first()
        self.n, self.most, self.sums = int(one["n"] or 0), int(one["most"] or 0), [0] * dims
        both = parts.select(F.posexplode(F.arrays_zip("high", "low")).alias("d", "s"))
        for r in both.groupBy("d").agg(*[F.sum(F.col(f"s.{c}").cast("decimal(28,0)")).alias(c) for c in ("high", "low")]).collect():
            self.sums[r["d"]] = (int(r["high"]) << 32) + int(r["low"])
        self.mean = np.array([s / self.n for s in self.sums]) if self.n else np.zeros(dims)

    def total(self, per_block) -> np.ndarray:
        """The sum over all blocks of ``per_block(centred rows)``, a flat array of a fixed size."""
        mean = self.mean

        def centred(x: np.ndarray) -> np.ndarray:
            return per_block(x.astype(np.float64) - mean)

        parts = self.table.mapInArrow(tidy(_sums(centred, self.dims)), "part array<double>")
        rows = parts.select(F.posexplode("part").alias("k", "x")).groupBy("k").agg(F.sum("x").alias("x")).collect()
        out = np.zeros(max((r["k"] for r in rows), default=-1) + 1)
        for r in rows:
            out[r["k"]] = r["x"]
        return out


def _product(v: np.ndarray, w: np.ndarray, c: np.ndarray | None = None):
    """Per block: U'r, X'r and r'r of r = Xv, where U = XW are the earlier left vectors; with ``c``, of
    r = Xv - Uc."""
    def run(x: np.ndarray) -> np.ndarray:
        u, r = x @ w, x @ v
        r = r if c is None else r - u @ c
        return np.concatenate([u.T @ r, x.T @ r, [r @ r]])
    return run


def _fresh(v: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """A direction orthogonal to the columns of ``v``."""
    d = rng.standard_normal(len(v))
    for _ in range(3):
        d -= v @ (v.T @ d)
        d /= np.linalg.norm(d)
    return d


def bidiagonalise(rows: Rows, components: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray, float, int]:
    """(singular values, right singular vectors as columns, squared Frobenius norm, steps) of the centred rows."""
    d, rng = rows.dims, np.random.default_rng(12)
    size = float(rows.total(lambda x: np.array([np.einsum("ij,ij->", x, x)]))[0]) if rows.n else 0.0
    tiny = NOTHING * np.sqrt(size)
    right, left = np.zeros((d, 0)), np.zeros((d, 0))  # V; W with U = XW
    back = np.zeros((d, 0))  # X'U
    b = np.zeros((0, 0))  # U'XV, bidiagonal
    v, beta = (_fresh(right, rng) if d else None), 0.0
    while v is not None and right.shape[1] < d and size > 0:
        k = left.shape[1]
        got = rows.total(_product(v, left))
        c, g, rr = got[:k], got[k:k + d], got[-1]
        alpha2 = rr - c @ c
        if alpha2 < CANCELLED * rr and k:  # little is left of r: orthogonalise what is left once more
            again = rows.total(_product(v, left, c))
            more, g, rr = again[:k], again[k:k + d], again[-1]
            alpha2, g, c = rr - more @ more, g - back @ more, c + more
        else:
            g = g - back @ c
        alpha = np.sqrt(max(alpha2, 0.0))
        right = np.column_stack([right, v])
        b = np.pad(b, ((0, 0), (0, 1)))
        if k and beta:
            b[k - 1, -1] = beta
        if alpha <= tiny:  # no new left vector; and nothing is left at all after a fresh direction
            if not beta:
                break
            v, beta = (_fresh(right, rng) if right.shape[1] < d else None), 0.0
            continue
        b = np.pad(b, ((0, 1), (0, 0)))
        b[k, -1] = alpha
        left = np.column_stack([left, (v - left @ c) / alpha])
        back = np.column_stack([back, g / alpha])
        p = back[:, -1] - alpha * v
        for _ in range(2):
            p -= right @ (right.T @ p)
        beta = float(np.linalg.norm(p))
        values, tail = np.linalg.svd(b)[1], np.abs(np.linalg.svd(b)[0][-1])
        if len(values) > components and (beta * tail[:components] <= CLOSE * values[0]).all():
            break
        v, beta = (p / beta, beta) if beta > tiny else (_fresh(right, rng) if right.shape[1] < d else None, 0.0)
    if not b.size:
        return np.zeros(0), np.zeros((d, 0)), size, right.shape[1]
    _, values, turn = np.linalg.svd(b)
    vectors = right @ turn[:len(values)].T
    return values, vectors / np.linalg.norm(vectors, axis=0), size, right.shape[1]


def _vectors(df: DataFrame, vector: str) -> Column:
    return F.col(f"`{vector}`").cast("array<double>")


def fit(df: DataFrame, vector: str = "embedding", scale: float = SCALE, components: int = COMPONENTS) -> Fit:
    vectors = bounded_batches(df).select(_vectors(df, vector).alias("v")).where(usable(F.col("v")))
    dims = max(1, int(vectors.agg(F.max(F.size("v")).alias("d")).first()["d"] or 0))
    distinct = vectors.mapInArrow(tidy(_pack(dims, scale)), "width int, data binary").distinct()
    rows = Rows(written(distinct.mapInArrow(tidy(_blocks(dims)), BLOCK)), dims)
    values, vectors, size, steps = bidiagonalise(rows, components)
    keep = [k for k in range(min(components, len(values))) if values[k] > RANK * values[0]]
    values, vectors = values[keep] ** 2 / max(rows.n, 1), vectors[:, keep]
    error = 0.0
    if keep:
        onto, m = vectors / np.sqrt(values), len(keep)

        def second(x: np.ndarray) -> np.ndarray:
            w = x @ onto
            return np.concatenate([(w.T @ w).ravel(), w.sum(0)])

        got = rows.total(second) / rows.n
        error = float(np.abs(got[:m * m].reshape(m, m) - np.outer(got[m * m:], got[m * m:]) - np.eye(m)).max())
    return Fit(rows.n, rows.sums, rows.most, size / max(rows.n, 1), values, vectors, steps, error)


def _deviations(x: np.ndarray, n: int, sums: list[int], most: int) -> list[int | None]:
    """Sums of (n x - S) squared, exactly."""
    reach = n * most + max((abs(s) for s in sums), default=0)
    if reach * reach * max(1, len(sums)) < 1 << 63:
        d = n * x - np.array(sums, np.int64)
        return np.einsum("ij,ij->i", d, d).tolist()
    exact = ((n * x.astype(object) - np.array(sums, object)) ** 2).sum(1)
    return [int(e) if e < 1 << 63 else None for e in exact]


def _whiten(found: Fit, scale: float):
    mean, onto, dims = found.mean, found.vectors / np.sqrt(found.values), len(found.sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                x = _scaled(part.column(1), dims, scale)
                w = (x.astype(np.float64) - mean) @ onto
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(_deviations(x, found.n, found.sums, found.most), pa.int64()), pa.array(w.tolist(), pa.list_(pa.float64()))],
                                                 names=["key", "deviation", "w"])
    return run


def whiten(df: DataFrame, found: Fit, key: str = "vec_id", vector: str = "embedding", scale: float = SCALE) -> DataFrame:
    """One row per usable row and component, numbered from 1: the row's coordinate in units of deviation."""
    kind = df.select(F.col(f"`{key}`")).schema[0].dataType.simpleString()
    rows = bounded_batches(df).select(F.col(f"`{key}`").alias("key"), _vectors(df, vector).alias("v")).where(usable(F.col("v")))
    rows = rows.mapInArrow(tidy(_whiten(found, scale)), f"key {kind}, deviation bigint, w array<double>")
    share = F.array(*[F.lit(float(e / found.trace)) for e in found.values]) if len(found.values) else F.array().cast("array<double>")
    rows = rows.select("key", "deviation", F.posexplode("w").alias("k", "whitened"))
    return rows.select(F.col("key").alias(key), (F.col("k") + 1).alias("component"), F.lit(found.n).cast("long").alias("n"), "deviation", "whitened",
                       F.get(share, F.col("k")).alias("explained"), F.lit(found.identity_error).alias("identity_error"))
