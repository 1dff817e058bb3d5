"""Features of a labelling, taken from the shared base, against those of the labelling alone."""
import datetime
import math

import pytest
from pyspark.sql import functions as F

from pvlake.config import Settings
from pvlake.models.standin import StandInPredictors
from pvlake.operators import quantiles
from pvlake.plans import context
from pvlake.plans.context import LabelContext, RunContext
from pvlake.plans.experiment import Experiment


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    """40 devices of uneven size, one without a name, rows without time or value, rows that come twice."""
    at, rows = datetime.datetime(2024, 1, 1), []
    for u in [*range(40), None]:
        for i in range(6 + (u or 3) % 7 * 4):
            ts = None if i == 3 and (u or 0) % 5 == 1 else at + datetime.timedelta(days=(3 * i + (u or 0)) % 30, minutes=15 * ((7 * i + (u or 0)) % 96))
            rows.append((len(rows), ts, u, "x", None if i == 4 else float((13 * i + 5 * (u or 0)) % 300), None))
    rows += rows[10:30]
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{path}/events.parquet")
    return str(path)


def same(a, b):
    return a == b or (isinstance(a, float) and isinstance(b, float) and math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-12))


@pytest.mark.parametrize("settings, hot", [(Settings(unseen_strategy="low_capacity"), False),
                                           (Settings(unseen_fold=2, n_unseen_folds=3, cap_rows="train_mask"), True)], ids=["low", "fold-hot"])
def test_features_equal_the_labelling_alone(spark, sf, settings, hot, monkeypatch):
    if hot:
        monkeypatch.setattr(quantiles, "HOT_GROUP_ROWS", 5)
        monkeypatch.setattr(quantiles, "COLLECT_LIMIT", 7)
    alone = RunContext(spark, sf, settings)
    shared = LabelContext(context.SharedBase(spark, sf, Settings(), "events"), settings)
    assert shared.features.columns == alone.features.columns
    order = lambda df: sorted((tuple(r) for r in df.collect()), key=lambda r: [(x is None, str(x)) for x in r[:4]])
    first = ["row_id", "date", "split", "eval_split"]
    cols = [*first, *[c for c in alone.features.columns if c not in first]]
    got, want = order(shared.features.select(*cols)), order(alone.features.select(*cols))
    assert len(got) == len(want) > 500
    bad = {c for g, w in zip(got, want) for c, x, y in zip(cols, g, w) if not same(x, y)}
    assert not bad


def test_narrow_tables_score_alike_and_are_narrow(spark, sf, monkeypatch):
    written = {}
    real = context.materialize
    monkeypatch.setattr(context, "materialize", lambda df, name, *a: written.setdefault(name, df.columns) and real(df, name, *a))
    s = Settings(unseen_fold=0, n_unseen_folds=3)
    narrow = Experiment(LabelContext(context.SharedBase(spark, sf, Settings(), "events"), s), StandInPredictors())
    wide = Experiment(RunContext(spark, sf, s), StandInPredictors())
    rows = [{(r.eval_split, r.candidate): r for r in e.metrics_long.collect()} for e in (narrow, wide)]
    assert rows[0].keys() == rows[1].keys() and len(rows[0]) > 40
    for k, r in rows[0].items():
        assert all(same(x, y) for x, y in zip(r, rows[1][k])), (k, r, rows[1][k])
    assert set(written["narrow_features"]) <= set(StandInPredictors.columns)
    assert "points" not in narrow.__dict__  # metrics don't write every candidate of every point
    # the points that are joined with their days carry few columns, whatever the features hold
    assert len(wide.base_points.columns) <= 15 and len(wide.ctx.features.columns) > 50
    assert narrow.base_points.filter(F.col("pred_norm_point").isNull()).count() == 0
