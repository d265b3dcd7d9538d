import numpy as np
import pytest
from pyspark.sql import functions as F

from promspark.operators.chained import ChainedImputer


def brute(train, other, rounds, alpha):
    """Chained ridge regressions on rows; fitted on train, applied to both."""
    means, gaps = np.nanmean(train, 0), np.isnan(train).sum(0)
    order = sorted((c for c in range(train.shape[1]) if gaps[c]), key=lambda c: (gaps[c], c))
    both, gone = [np.where(np.isnan(x), means, x) for x in (train, other)], [np.isnan(x) for x in (train, other)]
    for _ in range(rounds):
        for c in order:
            rest = [k for k in range(train.shape[1]) if k != c]
            rows = ~gone[0][:, c]
            x, y = both[0][rows][:, rest], both[0][rows, c]
            xc = x - x.mean(0)
            beta = np.linalg.solve(xc.T @ xc + alpha * np.eye(len(rest)), xc.T @ (y - y.mean()))
            for f, g in zip(both, gone):
                f[g[:, c], c] = y.mean() + (f[g[:, c]][:, rest] - x.mean(0)) @ beta
    return both


def data(seed, n=600, p=6, share=0.15):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, p)) @ rng.standard_normal((p, p)) + 10 * rng.standard_normal(p)
    x[rng.random((n, p)) < share * rng.random(p)] = np.nan
    x[:, 0] = np.where(np.isnan(x[:, 0]), 1.0, x[:, 0])  # a complete column
    return x


def frame(spark, x, **more):
    rows = [(k, *[None if np.isnan(v) else float(v) for v in r]) for k, r in enumerate(x)]
    return spark.createDataFrame(rows, "id int, " + ", ".join(f"x{k} double" for k in range(x.shape[1])))


def numbers(df, p):
    return np.array([[r[f"x{k}"] for k in range(p)] for r in df.orderBy("id").collect()])


@pytest.mark.parametrize("seed, p, share, limit", [(1, 6, 0.15, 1 << 28), (2, 3, 0.9, 1 << 28), (3, 4, 0.4, 0)])
def test_against_chained_regressions_on_rows(spark, seed, p, share, limit):
    train, test = data(seed, 500, p, share), data(seed + 10, 200, p, share)
    cols = [f"x{k}" for k in range(p)]
    imp = ChainedImputer(cols, rounds=3, alpha=1.0, limit=limit).fit(frame(spark, train).repartition(3))
    want = brute(train, test, 3, 1.0)
    for x, w in zip((train, test), want):
        got = numbers(imp.transform(frame(spark, x)), p)
        assert np.abs(got - w).max() < 1e-6 * max(1, np.abs(w).max())
        assert (got[~np.isnan(x)] == x[~np.isnan(x)]).all()


def test_rows_are_squeezed_without_changing_the_result(spark):
    train = data(4, 4000, 3, 0.3)
    imp = ChainedImputer(["x0", "x1", "x2"], rounds=2).fit(frame(spark, train))
    assert imp.factor_rows <= 4 * 4  # masks x (columns + 1)
    want = brute(train, train[:50], 2, 1.0)[1]
    assert np.abs(numbers(imp.transform(frame(spark, train[:50])), 3) - want).max() < 1e-6


def test_categoricals_are_coded_rounded_and_clipped(spark):
    rng = np.random.default_rng(5)
    level = rng.integers(0, 3, 900)
    rows = [(k, float(10 * v + rng.random()), None if k % 9 == 0 else "abc"[v], None if k % 7 == 0 else int(v) + 1, "x") for k, v in enumerate(level.tolist())]
    df = spark.createDataFrame(rows, "id int, x double, label string, code int, extra string")
    imp = ChainedImputer(["x", "label", "code"], rounds=5, categorical=["label", "code"]).fit(df.where("id < 700"), labels_from=df)
    assert imp.labels == {"label": ["a", "b", "c"], "code": ["1", "2", "3"]}
    out = imp.transform(df)
    assert out.columns == df.columns and dict(out.dtypes)["code"] == "int"
    got = out.orderBy("id").collect()
    assert all(r.label == "abc"[v] and r.code == v + 1 and r.extra == "x" for r, v in zip(got, level.tolist()))
    far = imp.transform(spark.createDataFrame([(1, 500.0, None, None, "x"), (2, -500.0, None, None, "x")], df.schema)).orderBy("id").collect()
    assert [(r.label, r.code) for r in far] == [("c", 3), ("a", 1)]


def test_edges(spark):
    df = spark.createDataFrame([(1, 2.0, None), (2, None, None), (3, 4.0, None), (4, float("nan"), None)], "id int, a double, b double")
    got = ChainedImputer(["a", "b"], rounds=2).fit(df).transform(df).orderBy("id").collect()
    assert [(r.a, r.b) for r in got] == [(2.0, None), (3.0, None), (4.0, None), (3.0, None)]
    none = df.limit(0)
    assert ChainedImputer(["a", "b"]).fit(none).transform(df).count() == 4
    clipped = ChainedImputer(["a"], clip={"a": (None, 2.5)}).fit(df).transform(df)
    assert clipped.agg(F.min("a"), F.max("a")).first()[:] == (2.0, 4.0) and clipped.where("id = 2").first().a == 2.5
