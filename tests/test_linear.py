import numpy as np
import pytest

from promspark.operators import linear as L
from promspark.operators import split as SP


def table(spark, n=400, seed=1, shift=1000.0):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, 3)) * [1, 5, 0.1] + [0, shift, 3]
    g = rng.integers(0, 3, n)
    y = x @ [2.0, -0.3, 8.0] + np.array([0.0, 1.0, -2.0])[g] + rng.standard_normal(n)
    rows = [(k, *map(float, x[k]), 7.0, None if g[k] == 2 else "ab"[g[k]], float(y[k])) for k in range(n)]
    df = spark.createDataFrame(rows, "record_id int, x0 double, x1 double, x2 double, flat double, g string, y double")
    return df, rows


def matrix(rows):
    x = np.array([[*r[1:5], r[5] == "a", r[5] == "b", r[5] is None] for r in rows], float)
    return x, np.array([r[6] for r in rows])


def brute(kind, alpha, x, y):
    """Intercept and slopes by definition, on standardised numeric columns."""
    m, s = x.mean(0), x.std(0)
    s[:4] = np.where(s[:4] < 1e-9, 1, s[:4])
    s[4:] = 1
    z, c = (x - m) / s, y - y.mean()
    z[:, 3] = 0
    if kind == "linear":
        b = np.linalg.lstsq(z, c, rcond=1e-10)[0]
    elif kind == "ridge":
        b = np.linalg.solve(z.T @ z + alpha * np.eye(z.shape[1]), z.T @ c)
    else:
        b = np.zeros(z.shape[1])
        for _ in range(5000):
            for j in range(len(b)):
                if z[:, j].any():
                    r = c - z @ b + z[:, j] * b[j]
                    b[j] = np.sign(z[:, j] @ r) * max(abs(z[:, j] @ r) / len(c) - alpha, 0) / (z[:, j] @ z[:, j] / len(c))
    return y.mean() - (m / s) @ b, b / s


def test_every_fold_of_every_model_against_rows(spark):
    df, rows = table(spark, 300)
    df = SP.random_split(df, "record_id", 75)
    got = L.evaluate(df.repartition(3), "y", ["x0", "x1", "x2", "flat"], ["g"], L.MODELS | {"lasso2": ("lasso", 0.3)}, k=3, repeats=2)
    frames = {r: SP.folds(df, 3, "record_id", repeat=r).select("record_id", "split", "fold").collect() for r in range(2)}
    assert len(got.folds) == 4 * 2 * 3 and len(got.test) == 4
    x, y = matrix(rows)
    for name, r, f, n, mae, rmse, r2 in got.folds:
        kind, alpha = (L.MODELS | {"lasso2": ("lasso", 0.3)})[name]
        fold = {t.record_id: t.fold for t in frames[r] if t.split == "train"}
        a = np.array([k for k, g in fold.items() if g != f])
        b = np.array([k for k, g in fold.items() if g == f])
        i, w = brute(kind, alpha, x[a], y[a])
        e = y[b] - i - x[b] @ w
        assert n == len(b) and abs(mae - np.abs(e).mean()) < 1e-6 and abs(rmse - np.sqrt((e ** 2).mean())) < 1e-6
        assert abs(r2 - (1 - (e ** 2).sum() / ((y[b] - y[b].mean()) ** 2).sum())) < 1e-6
    split = {t.record_id: t.split for t in frames[0]}
    a, b = ([k for k in split if split[k] == s] for s in ("train", "test"))
    for name, n, mae, rmse, r2 in got.test:
        i, w = brute(*(L.MODELS | {"lasso2": ("lasso", 0.3)})[name], x[a], y[a])
        e = y[b] - i - x[b] @ w
        assert n == len(b) and abs(rmse - np.sqrt((e ** 2).mean())) < 1e-6 and abs(mae - np.abs(e).mean()) < 1e-6
    assert got.models["linear"].names == ["x0", "x1", "x2", "flat", "g=a", "g=b", "g=missing"]


def test_large_offsets_keep_their_precision(spark):
    df, rows = table(spark, 300, shift=1e7)
    got = L.evaluate(df, "y", ["x0", "x1", "x2"], [], {"linear": ("linear", 0.0)}, split=None)
    x, y = matrix(rows)
    x = x[:, :3]
    b = np.linalg.lstsq(x - x.mean(0), y - y.mean(), rcond=None)[0]
    assert np.abs(got.models["linear"].weights[1:] - b).max() < 1e-6


def test_lasso_path(spark):
    df, rows = table(spark, 300)
    path = L.lasso_path(df, "y", ["x0", "x1", "x2", "flat"], ["g"], penalties=20, k=4)
    assert len(path.alphas) == 20 and path.errors.shape == (4, 20) and abs(path.alphas[-1] / path.alphas[0] - 1e-3) < 1e-12
    x, y = matrix(rows)
    fold = [r.fold for r in SP.folds(df, 4, "record_id").orderBy("record_id").collect()]
    for f, j in [(0, 0), (1, 7), (3, 19)]:
        a, b = (np.flatnonzero((np.array(fold) != f) == t) for t in (True, False))
        i, w = brute("lasso", path.alphas[j], x[a], y[a])
        assert abs(path.errors[f, j] - ((y[b] - i - x[b] @ w) ** 2).mean()) < 1e-6
    assert path.best.alpha == path.alphas[int(path.errors.mean(0).argmin())]
    assert np.abs(brute("lasso", path.alphas[0] * (1 + 1e-9), x, y)[1]).max() < 1e-9


def test_edges(spark):
    df, _ = table(spark, 30)
    xs = L.feature_columns(df, ["x0"], ["g"])
    model = L.Model("linear", 0.0, [n for n, _ in xs], np.array([1.0, 2.0, 0.5, 0.0, -1.0]))
    r = L.predict(df, model, xs).where("record_id = 0").first()
    assert abs(r.prediction - (1 + 2 * r.x0 + {"a": 0.5, "b": 0.0, None: -1.0}[r.g])) < 1e-12
    assert L.evaluate(df.limit(0), "y", ["x0"], split=None).folds == []
    with pytest.raises(Exception, match="fill it first"):
        L.evaluate(df.selectExpr("record_id", "y", "CAST(NULL AS DOUBLE) AS x0"), "y", ["x0"], split=None)


def test_lasso_with_nearly_equal_columns_ends(monkeypatch):
    """Columns that differ by 1e-6 of their deviation: no search goes on to the last sweep for what rounding hides."""
    rng = np.random.default_rng(4)
    base = rng.normal(size=(3000, 4))
    x = np.column_stack([base, *(base + rng.normal(size=base.shape) * 5e-7 for _ in range(3)), np.eye(4)[rng.integers(0, 4, 3000)], np.eye(2)[rng.integers(0, 2, 3000)]])
    y = base @ [3.0, -2.0, 1.0, 0.5] + x[:, 16:20] @ [0.0, 1.0, 2.0, 4.0] + rng.normal(size=3000)
    z = np.column_stack([np.ones(3000), x, y])
    tried, plain = [], np.linalg.lstsq

    def counted(*args, **kwargs):
        tried.append(1)
        return plain(*args, **kwargs)

    monkeypatch.setattr(np.linalg, "lstsq", counted)
    t = L._Training([z[:1500], z[1500:]], 16)
    slopes = L.lasso_slopes([t], np.array([0.01]))[0, 0]
    monkeypatch.undo()
    assert len(tried) < 2000
    # the same fit as with one column of each group of equal ones
    one = L._Training([np.column_stack([np.ones(3000), base, x[:, 16:], y])], 4)
    few = L.lasso_slopes([one], np.array([0.01]))[0, 0]
    assert np.allclose(slopes[:16].reshape(4, 4).sum(0), few[:4], atol=1e-5)
