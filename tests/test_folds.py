"""Labellings of one shared base."""
import pytest
from pyspark.sql import functions as F

from pvlake.config import Settings
from pvlake.operators.history import device_history, device_slot_history
from pvlake.plans import context
from pvlake.plans.context import LabelContext, RunContext

SF = "/root/testdata/sf0.001"
LABELLINGS = [Settings(), Settings(unseen_strategy="low_capacity"), *[Settings(unseen_fold=i, n_unseen_folds=3) for i in range(3)]]


@pytest.fixture()
def fresh(monkeypatch):
    monkeypatch.setattr(context, "_CACHE", {})
    monkeypatch.setattr(context, "_BASES", {})
    names = []
    real = context.materialize
    monkeypatch.setattr(context, "materialize", lambda df, name, *a: names.append(name) or real(df, name, *a))
    return names


def test_labels_equal_and_base_written_once(spark, fresh):
    for s in LABELLINGS:
        got = LabelContext.get(spark, SF, s).scalar.select("row_id", "eval_split")
        want = RunContext(spark, SF, s).labelled.select("row_id", "eval_split")
        assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0, s
    assert fresh.count("shared_base") == 1


def test_history_is_shared(spark, fresh):
    for s in LABELLINGS[1:3]:
        ctx = LabelContext.get(spark, SF, s)
        by_device, by_slot = ctx.own_history
        for got, want in ((by_device, device_history(ctx.train_rows)), (by_slot, device_slot_history(ctx.train_rows))):
            rounded = [[F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes] for df in (got, want)]
            a, b = got.select(rounded[0]), want.select(rounded[1])
            assert a.count() == b.count() and a.exceptAll(b).count() == 0
    assert fresh.count("shared_history") == fresh.count("shared_slots") == 1


def test_settled_medians(spark):
    """Constant days are carried; days with several values get their exact median; missing stays missing."""
    from pvlake.operators.carried import extents, settle
    from pvlake.session import materialize

    rows = spark.createDataFrame(
        [("a", 1.0, 5.0), ("a", 1.0, None), ("b", 1.0, 2.0), ("b", 4.0, 2.0), ("b", None, 9.0), ("c", None, 1.0), ("d", 1.0, 1.0), ("d", 2.0, 1.0), ("d", 9.0, 1.0)],
        "k string, x double, y double")
    grouped = materialize(rows.groupBy("k").agg(*extents(["x", "y"])), "test_settled")
    got = {r["k"]: (r["mx"], r["my"]) for r in settle(grouped, rows, ["k"], {"mx": "x", "my": "y"}).collect()}
    assert got == {"a": (1.0, 5.0), "b": (2.5, 2.0), "c": (None, 1.0), "d": (2.0, 1.0)}
    calm = rows.filter("k in ('a', 'c')")
    grouped = materialize(calm.groupBy("k").agg(*extents(["x", "y"])), "test_calm")
    out = settle(grouped, calm, ["k"], {"mx": "x", "my": "y"})
    assert "percentile" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert {r["k"]: (r["mx"], r["my"]) for r in out.collect()} == {"a": (1.0, 5.0), "c": (None, 1.0)}


def test_day_readers_move_narrow_points(spark, fresh):
    """The supplier queries write only what device-days read, and the days are those of the whole feature table."""
    from pvlake.plans import registry

    whole, ctx = RunContext(spark, SF, source="lineitem"), registry.sctx(spark, SF)
    assert len(ctx.features.columns) < 0.7 * len(whole.features.columns) and ctx.scalar.count() == whole.scalar.count()
    assert ctx.daily.columns == whole.daily.columns
    rounded = [F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in whole.daily.dtypes]
    got, want = ctx.daily.select(rounded), whole.daily.select(rounded)
    assert got.count() == want.count() and got.exceptAll(want).count() == 0


def test_summary_takes_narrow_points_or_the_whole_table_there_is(spark, fresh):
    from pvlake.plans import registry

    want = sorted(map(str, registry.REGISTRY["split_summary"].build(spark, SF).collect()))
    narrow = RunContext.get(spark, SF, days_only=True)
    assert "slot_id" in narrow.features.columns and "sin_hour" not in narrow.features.columns
    whole = RunContext.get(spark, SF)
    assert "sin_hour" in whole.features.columns and RunContext.get(spark, SF, days_only=True) is whole
    assert sorted(map(str, registry.REGISTRY["split_summary"].build(spark, SF).collect())) == want
