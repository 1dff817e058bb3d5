"""Report store lookups, calibration levels, capacity weights and the stacking conditions on small inputs."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from pvlake.config import FOLD_METRICS
from pvlake.models.stacking import fit_conditions, fit_stacking
from pvlake.operators.diagnostics import calibration_groups, multi_level_calibration
from pvlake.operators.profiles import neighbour_capacity
from pvlake.sources import report_store as S


def test_store_keeps_runs_and_lookups_follow_the_published_order(spark, tmp_path):
    store = S.ReportStore(spark, str(tmp_path))
    assert S.drift_lookup(store) is None and S.cv_top_candidates(store) is None and S.stress_lookup(store) is None and S.cv_lookup(store) is None
    schema = "eval_split string, devices long, train_device_overlap_ratio double, daily_target_mean double, low_load_share_lt_0_05 double, low_load_share_lt_0_10 double"
    store.write(S.DRIFT, spark.createDataFrame([("test2", 3, 0.0, 1.0, 0.1, 0.2), ("train", 9, 1.0, 2.0, 0.0, 0.1), ("other", 1, 0.0, 0.0, 0.0, 0.0)], schema), "2024-01-01")
    store.write(S.DRIFT, spark.createDataFrame([("train", 10, 1.0, 2.5, 0.0, 0.1)], schema), "2024-01-02")
    old = S.drift_lookup(store, "2024-01-01").orderBy("position").collect()
    assert [(r.position, r.eval_split, r.devices) for r in old] == [(1, "train", 9), (5, "test2", 3)]
    assert [r.devices for r in S.drift_lookup(store).collect()] == [10]
    store.write(S.DRIFT, spark.createDataFrame([("train", 11, 1.0, 2.5, 0.0, 0.1)], schema), "2024-01-02")  # written again: replaced
    assert [r.devices for r in S.drift_lookup(store).collect()] == [11]
    cand = [(f"c{i}", FOLD_METRICS[0], float((7 * i) % 9), 0.1, 0.0, 1.0) for i in range(9)] + [("c0", "valid_unseen_daily_mape", -1.0, 0.0, 0.0, 0.0)]
    store.write(S.CV_CANDIDATES, spark.createDataFrame(cand, "candidate string, metric string, mean double, std double, min double, max double"), "r")
    top = S.cv_top_candidates(store).orderBy("position").collect()
    assert [(r.position, r["mean"]) for r in top] == [(i + 1, float(i)) for i in range(5)]
    store.write(S.STRESS, spark.createDataFrame([("b", 0.2, 0.3, 0.4), ("a", 0.1, 0.3, 0.4)],
                "candidate string, combined_validation_daily_mape double, valid_unseen_daily_mape double, test2_daily_mape double"), "r")
    assert [(r.candidate, r.chosen) for r in S.stress_lookup(store).orderBy("position").collect()] == [("a", True), ("b", False)]


def test_calibration_levels(spark):
    """Groups with enough validation days decide, the most specific first; one scan makes all groups."""
    rows = [("valid_seen", 2.0, 1.0, "r1", "f1", "q1", "normal")] * 12 + [("valid_seen", 1.0, 1.0, "r2", "f1", "q1", "normal")] * 3
    rows += [("test1", 2.0, 1.0, "r1", "f1", "q1", "normal"), ("test1", 1.0, 1.0, "r2", "f9", "none", "low"), ("test1", 0.0, 0.0, "r2", "f1", "q1", "normal")]
    days = spark.createDataFrame(rows, "eval_split string, y_true_day double, p double, region string, family string, capacity string, risk string")
    groups = calibration_groups(days)
    got = {(r.level, r.key): (r.days, r.ratio, r.factor) for r in groups.collect()}
    overall = 27 / 15
    assert got["all", ""] == (15, overall, overall) and got["region", "r1"][:2] == (12, 2.0) and got["region", "r2"][0] == 3
    assert got["region", "r1"][2] == pytest.approx((12 * 2.0 + 10 * overall) / 22)
    assert {k for k, _ in got} == {"all", "region", "family", "capacity", "risk"}
    out = {r.eval_split: r for r in multi_level_calibration(days, groups).collect()}
    assert (out["test1"].days_by_region, out["test1"].days_by_family, out["test1"].days_by_all) == (1, 1, 1)
    assert out["valid_seen"].daily_mape_after < out["valid_seen"].daily_mape_before


def test_neighbour_capacity_weights(spark):
    pairs = spark.createDataFrame([("a", 1.0, 10.0), ("a", 3.0, 2.0), ("b", 0.0, 4.0), ("b", 0.1, 8.0), ("c", None, 1.0), ("d", 2.0, None)],
                                  "deviceSn string, distance double, t_mean double")
    got = {r.deviceSn: r.neighbour_daily_mean for r in neighbour_capacity(pairs).collect()}
    assert got == {"a": pytest.approx((10 + 2 / 3) / (1 + 1 / 3)), "b": pytest.approx(6.0)}


def test_stacking_conditions_notice_a_wrong_fit(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(80, 3))
    y = 3 * x[:, 0] - 2 * x[:, 1] + 0.1 * rng.normal(size=80)
    days = spark.createDataFrame([(*map(float, r), float(t)) for r, t in zip(x, y)], "a double, b double, c double, y double")
    model, _ = fit_stacking(days, ["a", "b", "c"], "y", F.lit(True))
    assert model["coef"]["b"] == 0.0 and model["coef"]["a"] > 0
    assert all(r.optimal for r in fit_conditions(spark, model).filter("b = 'target'").collect())
    wrong = {**model, "weights": model["weights"] + np.array([0.1, 0.1, 0.0])}
    assert not all(r.optimal for r in fit_conditions(spark, wrong).filter("b = 'target'").collect())
