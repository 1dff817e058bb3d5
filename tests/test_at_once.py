"""Labellings run at the same time over one shared base."""
import threading

from pyspark.sql import functions as F

from pvlake.config import Settings
from pvlake.operators.drift import split_summary
from pvlake.plans import context, evaluation
from pvlake.plans.context import RunContext
from tests.test_shared_history import same, sf  # noqa: F401  sf: a fixture


def test_folds_run_at_the_same_time(spark, sf, monkeypatch):  # noqa: F811
    meet, bases = threading.Barrier(3), set()

    def fold_rows(e, fold):
        bases.add(id(e.ctx.base))
        assert e.ctx.settings == Settings(unseen_fold=fold, n_unseen_folds=3) and {"enriched", "locations"} <= set(e.ctx.base.__dict__)
        meet.wait(60)  # one after another, the first would wait in vain
        return spark.createDataFrame([(fold,)], "fold int")

    monkeypatch.setattr(evaluation, "fold_rows", fold_rows)
    assert [r[0] for r in evaluation.unseen_cv(spark, sf).collect()] == [0, 1, 2] and len(bases) == 1


def test_stored_reports_share_one_base(spark, sf, monkeypatch):  # noqa: F811
    from pvlake.plans import registry
    from pvlake.sources import report_store as S

    names = []
    real = context.materialize
    for holder, name, value in ((context, "_CACHE", {}), (context, "_BASES", {}), (registry, "_STORES", {}), (registry, "_FOLDS", {}), (registry, "_EXPERIMENTS", {}),
                                (context, "materialize", lambda df, name, *a: names.append(name) or real(df, name, *a))):
        monkeypatch.setattr(holder, name, value)
    store = registry.report_store(spark, sf)
    assert names.count("shared_base") == names.count("shared_enriched") == names.count("shared_history") == 1
    assert "points" not in names and "features" not in names  # before, the drift report labelled and joined all points once more
    assert names.count("narrow_features") == 5
    ctx = RunContext(spark, sf)
    want, got = ({r["eval_split"]: r for r in df.collect()} for df in (split_summary(ctx.features, ctx.daily), store.read(S.DRIFT)))
    assert got.keys() == want.keys() and all(same(got[k][c], want[k][c]) for k in want for c in want[k].asDict())
    folds = store.read(S.CV_FOLDS)
    assert folds.select("fold").distinct().count() == 3 and store.read(S.STRESS).filter(F.col("candidate").isNotNull()).count() == 8
