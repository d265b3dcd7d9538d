from promspark.plans import variants as V

def test_fills_are_projections_of_the_split_table(spark, tmp_path, monkeypatch):
    """Only the split table is written; the report reads the fills once."""
    spark.range(600).selectExpr("id as o_orderkey", "id * 7 % 50 as o_custkey").write.parquet(f"{tmp_path}/orders.parquet")
    made, plain = [], V.written_table

    def counted(df):
        made.append(df.columns)
        return plain(df)

    monkeypatch.setattr(V, "written_table", counted)
    got = V.prepared_variants(spark, str(tmp_path), rounds=2)
    sizes = {r["variant"]: r["count"] for r in got.groupBy("variant").count().collect()}
    assert len(made) == 1 and set(sizes) == {"keep_nulls", "median_mode", "mice"} and len(set(sizes.values())) == 1
    assert got.where("variant <> 'keep_nulls' and target is null").count() == 0


def test_registry_runs_every_model_on_every_variant(spark, tmp_path, monkeypatch):
    """M23 ran the linear family only."""
    from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
    from promspark.operators import model as M
    from promspark.queries.model import m23_m29_registry
    spark.range(600).selectExpr("id as o_orderkey", "id * 7 % 50 as o_custkey").write.parquet(f"{tmp_path}/orders.parquet")
    makes = M.regressors() | {"forest": lambda: RandomForestRegressor(numTrees=2, maxDepth=3, seed=1), "boosting": lambda: GBTRegressor(maxIter=2, maxDepth=3, seed=1)}
    monkeypatch.setattr(M, "regressors", lambda *_: makes)
    got = m23_m29_registry(spark, str(tmp_path)).collect()
    assert {(r["dataset"], r["model"]) for r in got} == {(d, m) for d in ("keep_nulls", "median_mode", "mice") for m in ("linear", "ridge", "lasso", "tree", "forest", "boosting")}
    assert all(r["cv_rmse"] is not None and r["test_rmse"] is not None for r in got) and sorted(r["rank"] for r in got) == list(range(1, 19))
