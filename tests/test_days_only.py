"""Readers of device-days: history meets the days, and points are not moved by day for their labels."""
import pytest
from pyspark.sql import functions as F

from pvlake import session
from pvlake.operators import daily, splits
from pvlake.plans import context
from pvlake.plans.context import RunContext
from tests.test_shared_history import same, sf  # noqa: F401  sf: a fixture


@pytest.mark.parametrize("sent", [session.SENT_ROWS, 0], ids=["sent", "joined"])
def test_days_equal_those_of_the_feature_table(spark, sf, monkeypatch, sent):  # noqa: F811
    monkeypatch.setattr(session, "SENT_ROWS", sent)
    names = []
    for module in (context, daily):
        real = module.materialize
        monkeypatch.setattr(module, "materialize", lambda df, name, *a, real=real: names.append(name) or real(df, name, *a))
    got = {(r["split"], r["deviceSn"], r["date"]): r for r in RunContext(spark, sf, days_only=True).days.collect()}
    assert "features" not in names and "daily" not in names and names.count("day_grain") == 1  # before, all points met their history
    want = RunContext(spark, sf).daily
    rows = want.collect()
    assert len(rows) == len(got) > 200
    for r in rows:
        mine = got[r["split"], r["deviceSn"], r["date"]]
        assert mine.__fields__ == want.columns and all(same(mine[c], r[c]) for c in want.columns), (mine, r)


@pytest.mark.parametrize("sent", [session.SENT_ROWS, 0], ids=["sent", "joined"])
def test_holdout_by_device(spark, sf, monkeypatch, sent):  # noqa: F811
    monkeypatch.setattr(session, "SENT_ROWS", sent)
    points = RunContext(spark, sf).points
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        labelled = splits.with_holdout(points, 3)
        plan = labelled._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert ("Exchange hashpartitioning" in plan) == (sent == 0)  # before, all columns of all points were dealt out by day
    days = {(r[0], r[1]) for r in splits.seen_holdout_days(points, 3).collect()}
    rows = labelled.collect()
    assert len(rows) == points.count() and len(days) > 60
    for r in rows:
        assert r["_holdout"] is not None and (r["split"] != "train" or r["_holdout"] == ((r["deviceSn"], r["date"]) in days)), r
    assert any(r["deviceSn"] is None for r in rows) and any(r["date"] is None for r in rows)
    assert labelled.columns == ["deviceSn", "date", *[c for c in points.columns if c not in ("deviceSn", "date")], "_holdout"]
    assert labelled.filter(F.col("_holdout")).count() > 0
