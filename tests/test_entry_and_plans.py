import __spark_entry__ as entry
from promspark.queries import registry


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert set(df.columns) == {"procedure", "age_band", "n", "success_rate", "mean_gain", "n_with_gain"}


def test_registry_contract():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 100
    own = registry()
    assert set(own) <= set(q)
    # the names of the optional subpackage are not taken by the package's own queries
    for k in own:
        assert not k.lower().startswith("op") and "pipeline" not in k.lower()


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_preparation_plan_has_no_exchange_and_prunes_columns(spark):
    from promspark.fixture import load_prom
    from promspark.plans.prepare import prepare
    df, _ = prepare(load_prom(spark, "/root/testdata/sf0.001"))
    plan = _plan(df)
    assert "Exchange" not in plan
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint>" in plan


def test_no_cartesian_or_nested_loop_joins(spark):
    q = entry.queries()
    for key in ["D08_success_by_group", "T03_kendall_tau_b", "A22_box_stats", "P08_stratified_split",
                "T02_T18_spearman_ranked", "M20_auc", "J05_semi_join_top10", "D20_equal_width_bins"]:
        plan = _plan(q[key](spark, "/root/testdata/sf0.001"))
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, key
