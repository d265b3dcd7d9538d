import numpy as np

from promspark.operators.quantiles import exact_quantiles, grouped_percentiles


def test_exact_quantiles_with_hot_value_and_refinement(spark):
    rng = np.random.default_rng(7)
    vals = np.concatenate([rng.normal(size=4000), np.full(2000, 0.25), rng.exponential(size=1000) * 50])
    df = spark.createDataFrame([(float(v),) for v in vals], "x double")
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 0.99, 1.0]
    got = exact_quantiles(df, "x", probs, bins=8)   # forces refinement
    want = np.quantile(vals, probs)
    for p, w in zip(probs, want):
        assert abs(got[p] - w) < 1e-9


def test_grouped_percentiles_match_numpy(spark):
    rows = [(g, float(v)) for g in ("a", "b") for v in ([1, 2, 2, 3, 9] if g == "a" else [5, 5, 5])]
    df = spark.createDataFrame(rows, "g string, v double")
    out = {r.g: (r.p25, r.p50, r.p75) for r in grouped_percentiles(df, ["g"], "v", [0.25, 0.5, 0.75]).collect()}
    assert out["a"] == tuple(np.quantile([1, 2, 2, 3, 9], [0.25, 0.5, 0.75]))
    assert out["b"] == (5.0, 5.0, 5.0)


def test_values_on_bin_edges_and_wide_ranges(spark):
    """Values at or one rounding step beside a computed bin edge, repeated values, huge and tiny ones."""
    edges = np.linspace(0.1, 1.7, 17)
    vals = np.concatenate([edges, np.nextafter(edges, 2), np.nextafter(edges, -2), np.full(9, 0.7), [1e300, -1e300, 5e-324, 0.0]])
    df = spark.createDataFrame([(float(v),) for v in vals], "x double")
    probs = [k / (len(vals) - 1) for k in range(len(vals))]
    got = exact_quantiles(df, "x", probs, bins=16)
    want = np.sort(vals)
    for k, p in enumerate(probs):
        h = (len(vals) - 1) * p
        lo, hi = want[int(np.floor(h))], want[int(np.ceil(h))]
        assert got[p] == lo + (h - np.floor(h)) * (hi - lo)


def test_grouped_percentiles_against_numpy(spark):
    import numpy as np

    from promspark.operators.quantiles import grouped_percentiles
    rng = np.random.default_rng(7)
    rows = [(["a", "b", None][k % 3] if k % 5 else "hot", None if k % 11 == 0 else float(rng.choice([rng.normal(), k % 4]))) for k in range(1500)]
    df = spark.createDataFrame(rows + [("one", 3.5), ("none", None)], "g string, v double").repartition(6)
    probs = [0.0, 0.013, 0.25, 0.5, 0.999, 1.0]
    got = {r.g: r[1:] for r in grouped_percentiles(df, ["g"], "v", probs).collect()}
    assert set(got) == {"a", "b", None, "hot", "one"} and set(got["one"]) == {3.5}
    for g in ("a", "b", None, "hot"):
        assert np.allclose(got[g], np.quantile([v for h, v in rows if h == g and v is not None], probs), rtol=0, atol=1e-12)
    whole = grouped_percentiles(df, [], "v", [0.5], ["m"]).first().m
    assert abs(whole - np.median([v for _, v in rows if v is not None] + [3.5])) < 1e-12
    assert grouped_percentiles(df.limit(0), ["g"], "v", [0.5]).count() == 0
