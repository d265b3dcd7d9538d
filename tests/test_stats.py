import itertools
import math

import numpy as np
from pyspark.sql import functions as F

from promspark.operators import stats as S


def _kendall_brute(x, y):
    n = len(x)
    s = sum(np.sign(x[i] - x[j]) * np.sign(y[i] - y[j]) for i, j in itertools.combinations(range(n), 2))
    def ties(v):
        _, c = np.unique(v, return_counts=True)
        return sum(t * (t - 1) / 2 for t in c)
    n0 = n * (n - 1) / 2
    return s, s / math.sqrt((n0 - ties(x)) * (n0 - ties(y)))


def test_kendall_matches_brute_force(spark):
    rng = np.random.default_rng(3)
    x = rng.integers(0, 6, 300)
    y = x + rng.integers(0, 4, 300)
    df = spark.createDataFrame([(int(a), int(b)) for a, b in zip(x, y)], "x int, y int")
    r = S.kendall_tau_b(df, "x", "y", with_p=True).first()
    s, tau = _kendall_brute(x, y)
    assert r.s == s
    assert abs(r.tau_b - round(tau, 6)) < 1e-9
    assert 0 <= r.p_value < 1e-6


def test_kendall_of_continuous_columns(spark):
    """More levels than the old grid held; large groups go through ranges of y."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=700)
    y = x + rng.normal(size=700)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double")
    s, tau = _kendall_brute(x, y)
    for small in (100_000, 20):
        r = S.kendall_tau_b(df, "x", "y", with_p=False, small=small).first()
        assert r.s == s and abs(r.tau_b - round(tau, 6)) < 1e-9
    assert S.kendall_tau_b(df.limit(1), "x", "y").first().tau_b is None
    assert S.kendall_tau_b(df.limit(0), "x", "y").first().n == 0


def test_rank_table_average_ties(spark):
    df = spark.createDataFrame([(v,) for v in [10, 20, 20, 30, 30, 30]], "v int")
    got = {r.v: r.rank for r in S.rank_table(df, "v", buckets=2).collect()}
    assert got == {10: 1.0, 20: 2.5, 30: 5.0}


def test_spearman_invariant_under_monotone_transform(spark):
    rng = np.random.default_rng(5)
    x = rng.integers(0, 20, 200)
    y = x + rng.integers(0, 10, 200)
    df = spark.createDataFrame([(int(a), int(b)) for a, b in zip(x, y)], "x int, y int")
    a = S.spearman(df, ["x"], "y", with_p=False).first().r
    b = S.spearman(df.withColumn("x", F.exp(F.col("x") / 5.0)), ["x"], "y", with_p=False).first().r
    assert a == b


def test_pearson_matrix_matches_numpy(spark):
    rng = np.random.default_rng(1)
    m = rng.normal(size=(100, 3))
    df = spark.createDataFrame([tuple(map(float, r)) for r in m], "a double, b double, c double")
    got = {(r.a, r.b): r.r for r in S.corr_matrix(df, ["a", "b", "c"]).collect()}
    c = np.corrcoef(m.T)
    assert abs(got[("a", "b")] - round(c[0, 1], 6)) < 1e-9 and abs(got[("b", "c")] - round(c[1, 2], 6)) < 1e-9


def test_bh_adjust_monotone_and_capped(spark):
    ps = [0.001, 0.008, 0.039, 0.041, 0.042, 0.06, 0.074, 0.205, 0.212, 0.216]
    df = spark.createDataFrame([(f"f{i}", p) for i, p in enumerate(ps)], "feature string, p_value double")
    out = sorted((r.p_value, r.p_adj) for r in S.bh_adjust(df).collect())
    m = len(ps)
    ref = [min(1.0, min(ps[j] * m / (j + 1) for j in range(i, m))) for i in range(m)]
    assert all(abs(a[1] - b) < 1e-12 for a, b in zip(out, ref))
    assert all(out[i][1] <= out[i + 1][1] for i in range(m - 1))


def test_welch_and_chi2_against_hand_formulas(spark):
    ys = [(1, 10.0), (1, 12.0), (1, 14.0), (0, 20.0), (0, 21.0), (0, 25.0), (0, 30.0)]
    df = spark.createDataFrame(ys, "f int, y double")
    r = S.group_effects(df, ["f"], "y", with_p=False).first()
    a, b = np.array([10, 12, 14.0]), np.array([20, 21, 25, 30.0])
    se2 = a.var(ddof=1) / 3 + b.var(ddof=1) / 4
    assert abs(r.t - round((a.mean() - b.mean()) / math.sqrt(se2), 6)) < 1e-9
    tab = spark.createDataFrame([(1, 1)] * 20 + [(1, 0)] * 5 + [(0, 1)] * 10 + [(0, 0)] * 15, "f int, y int")
    c = S.chi2_2x2(tab, ["f"], "y", with_p=False).first()
    obs = np.array([[15, 10], [5, 20]], dtype=float)
    exp = obs.sum(1, keepdims=True) * obs.sum(0, keepdims=True) / obs.sum()
    chi = (np.maximum(0, np.abs(obs - exp) - 0.5) ** 2 / exp).sum()
    assert abs(c.chi2 - round(chi, 6)) < 1e-9


def _avg_ranks(v):
    order = np.argsort(v, kind="mergesort")
    ranks = np.empty(len(v))
    vals = v[order]
    i = 0
    while i < len(v):
        j = i
        while j + 1 < len(v) and vals[j + 1] == vals[i]:
            j += 1
        ranks[order[i:j + 1]] = (i + j) / 2.0 + 1
        i = j + 1
    return ranks


def test_spearman_matrix_is_pairwise_complete(spark):
    rng = np.random.default_rng(9)
    n = 300
    cols = {c: rng.integers(0, 6, n).astype(float) for c in "abc"}
    cols["b"] = cols["a"] + rng.integers(0, 3, n)
    for c, frac in (("a", 0.1), ("b", 0.2), ("c", 0.05)):
        cols[c][rng.random(n) < frac] = np.nan
    rows = [tuple(None if np.isnan(cols[c][i]) else float(cols[c][i]) for c in "abc") for i in range(n)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    got = {(r.a, r.b): (r.r, r.n) for r in S.spearman_matrix(df, ["a", "b", "c"]).collect()}
    for x, y in [("a", "b"), ("a", "c"), ("b", "c")]:
        ok = ~np.isnan(cols[x]) & ~np.isnan(cols[y])
        rho = np.corrcoef(_avg_ranks(cols[x][ok]), _avg_ranks(cols[y][ok]))[0, 1]
        assert got[(x, y)][1] == ok.sum()
        assert abs(got[(x, y)][0] - round(rho, 6)) < 1e-9
