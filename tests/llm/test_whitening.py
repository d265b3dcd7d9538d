import numpy as np
import pytest
from pyspark.sql import functions as F

from promspark.llm import queries, whitening


def brute(rows, scale=256):
    """(n, sums, covariance) of the distinct integer vectors, by definition."""
    dims = max((len(r) for r in rows), default=0)
    x = {tuple(int(np.floor(scale * c)) for c in r) + (0,) * (dims - len(r)) for r in rows}
    x = np.array(sorted(x), object).reshape(-1, dims)
    n, sums = len(x), x.sum(0)
    c = (x - sums / n).astype(float) if n else np.zeros((0, dims))
    return n, [int(s) for s in sums], c.T @ c / max(n, 1)


def check(rows, got, components=4, loose=1e-7):
    n, sums, cov = brute([v for _, v in rows])
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1], vectors[:, ::-1]
    rank = min(components, int((np.sqrt(np.maximum(values, 0)) > 1e-9 * np.sqrt(values[0])).sum()))
    assert len(got) == len(rows) * rank
    by = {}
    for r in got:
        by.setdefault(r.vec_id, []).append(r)
    whitened = {k: [r.whitened for r in sorted(rs, key=lambda r: r.component)] for k, rs in by.items()}
    mean, want = np.array([s / n for s in sums]), {}
    for k, v in rows:
        x = np.array([int(np.floor(256 * c)) for c in v] + [0] * (len(sums) - len(v)), object)
        dev = int(sum((n * a - s) ** 2 for a, s in zip(x, sums)))
        assert {r.deviation for r in by[k]} == {dev if dev < 1 << 63 else None} and {r.n for r in by[k]} == {n}
        want[k] = ((x - mean).astype(float) @ vectors[:, :rank]) / np.sqrt(values[:rank])
    for c in range(rank):
        a, b = np.array([whitened[k][c] for k, _ in rows]), np.array([want[k][c] for k, _ in rows])
        assert min(np.abs(a - b).max(), np.abs(a + b).max()) < loose * max(1, np.abs(b).max())
    for r in got:
        assert abs(r.explained - values[r.component - 1] / values.sum()) < 1e-9 and r.identity_error < 1e-6


@pytest.mark.parametrize("seed, dims, n", [(1, 12, 300), (2, 40, 25), (3, 3, 50), (4, 1, 9)])
def test_against_eigenvectors(spark, seed, dims, n):
    rng = np.random.default_rng(seed)
    x = (rng.standard_normal((n, dims)) * np.linspace(2, 0.3, dims) + 5).tolist()
    rows = list(enumerate(x + x[:5]))
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").repartition(5)
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    check(rows, whitening.whiten(df, whitening.fit(df)).collect())


def test_bad_rows_short_vectors_ties_and_clashing_columns(spark):
    inf, nan = float("inf"), float("nan")
    good = [[1.0, 2.0, 0.5], [1.0, 2.0, 0.5], [0.0, 1.0], [], [-3.0, 0.1, 7.0], [2.5, -1.0, 0.25], [1.0, 1.0, 1.0]]
    bad = [None, [1.0, None, 2.0], [nan, 1.0, 1.0], [1.0, inf, 1.0], [-inf]]
    rows = list(enumerate(good + bad))
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumns({c: F.lit("x") for c in ("n", "key", "v", "data", "component", "w")})
    found = whitening.whiten(df, whitening.fit(df)).collect()
    assert {r.vec_id for r in found} == set(range(len(good)))
    check(rows[:len(good)], found)


def test_rank_and_equal_eigenvalues(spark):
    def run(vectors):
        df = spark.createDataFrame(list(enumerate(vectors)), "vec_id bigint, embedding array<double>")
        f = whitening.fit(df)
        return f, whitening.whiten(df, f).collect()

    f, rows = run([[1.0, 0.0], [0.0, 1.0]])
    assert len(f.values) == 1 and len(rows) == 2 and {round(abs(r.whitened), 9) for r in rows} == {1.0}
    f, rows = run([[1.0, 2.0]] * 3)
    assert f.n == 1 and not rows
    assert not run([])[1] and not run([None, []])[1]
    # four equal eigenvalues: the corners of a cross
    cross = [[float(s * (k == j)) for j in range(4)] for k in range(4) for s in (1, -1)]
    f, rows = run(cross)
    assert len(f.values) == 4 and np.allclose(f.values, f.values[0]) and f.identity_error < 1e-12
    assert np.allclose(f.vectors.T @ f.vectors, np.eye(4))


def test_large_values_stay_exact(spark):
    rows = list(enumerate([[2.0 ** 40, 1.0], [-(2.0 ** 40), 3.0], [0.0, 2.0 ** 30], [1e300, 0.0]]))
    df = spark.createDataFrame(rows[:3], "vec_id bigint, embedding array<double>")
    check(rows[:3], whitening.whiten(df, whitening.fit(df)).collect())
    assert whitening.fit(spark.createDataFrame(rows, df.schema)).most == int(np.nextafter(2.0 ** 63, 0))


def test_whole_table(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = queries.op12_whitening(spark, sf).collect()
    rows = [(k, v) for k, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    check(rows, got)
