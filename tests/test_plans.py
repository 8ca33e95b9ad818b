"""Physical-plan assertions where scale matters."""

from pyspark.sql import functions as F

from flowlens.operators import evaluate as E
from flowlens.operators import results as R
from flowlens.plans import bindings as B

SF = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filter_and_projection_reach_the_scan(spark):
    s = B.scores(spark, SF, "test").select("score")
    plan = _plan(s)
    assert "PushedFilters: [Or(Or(Or(GreaterThanOrEqual(ts," in plan
    assert "ReadSchema: struct<ts:timestamp_ntz,event_type:string,value:double>" in plan


def test_auc_plan_gathers_only_tiny_tables(spark):
    from tests.test_ordering import single_partition_inputs

    plan = _plan(E.auc_ap(B.scores(spark, SF)))
    for feeder in single_partition_inputs(plan):
        # per-partition totals, or the final one-row aggregate's partial input
        assert feeder.startswith("HashAggregate("), feeder


def test_top_anomalies_uses_group_limit(spark):
    st = B.store(spark, SF)
    plan = _plan(R.top_anomalies(st["predictions"], st["runs"], 100))
    assert "WindowGroupLimit" in plan


def test_mixed_batch_uses_group_limit(spark):
    from flowlens.operators import prep as P

    f = B.flows(spark, SF)
    quotas = spark.createDataFrame([("BENIGN", 5), ("ATK_A", 2)], "label string, quota int")
    assert "WindowGroupLimit" in _plan(P.mixed_batch(f, quotas, "label", 42, ["l_orderkey", "l_linenumber"]))
