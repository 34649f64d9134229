"""How often payments travel on the way to one row a work."""

from workrisk.operators import build
from workrisk.plans import adapter


def test_payments_travel_once_by_work(spark, sf_dir):
    raw = adapter.payments(spark, sf_dir).localCheckpoint()
    plan = build.payment_rollup(raw)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1, plan


def test_rollup_is_the_same_for_frequent_works(spark):
    rows = [("a", f"t{k % 3}", f"V{k % 7}", None, "Payment Success" if k % 2 else None, float(k)) for k in range(500)] + [("b", None, None, None, "x", 1.0), (None, "t", "V", None, "x", 1.0)]
    df = spark.createDataFrame(rows, "work_id string, work_type string, vendor string, paid_on date, status string, amount double")
    got = {r.work_id: r for r in build.payment_rollup(df).collect()}
    a, b = got["a"], got["b"]
    assert set(got) == {"a", "b"}
    assert (a.total_expenditure, a.payment_count, a.distinct_vendors, a.work_type, a.primary_vendor, a.payments_not_successful) == (124750.0, 500, 7, "t0", "V0", 250)
    assert (b.payment_count, b.distinct_vendors, b.work_type, b.primary_vendor, b.payments_not_successful) == (1, 0, None, None, 1)


def test_aggregates_run_twice_at_most(spark, sf_dir):
    """A distinct count beside other aggregates makes four of two."""
    raw = adapter.payments(spark, sf_dir).localCheckpoint()
    plan = build.payment_rollup(raw)._jdf.queryExecution().executedPlan().toString()
    assert sum(" ObjectHashAggregate(" in x or "HashAggregate(" in x or "SortAggregate(" in x for x in plan.splitlines()) == 2, plan
