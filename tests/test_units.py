"""Unit and property tests on hand-made rows (expectations computed in the test)."""
import math
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from pvlake.functions.columns import haversine_km, nan_to_null, sanitize
from pvlake.operators.neighbours import nearest_neighbour_stats
from pvlake.operators.policy import _guard, rescale_factor
from pvlake.operators.splits import unseen_count


@pytest.mark.parametrize("n,expected", [(1, 4), (3, 4), (4, 4), (17, 4), (20, 5), (40, 8), (100, 8)])
def test_unseen_count(spark, n, expected):
    got = spark.range(1).select(unseen_count(F.lit(n)).alias("n")).first()["n"]
    assert got == expected


def test_nan_is_missing_and_empty_sum_is_zero(spark):
    df = spark.createDataFrame([("a", float("nan")), ("a", None), ("b", 1.0)], "k string, v double")
    out = {r["k"]: r["s"] for r in df.select("k", nan_to_null(F.col("v")).alias("v")).groupBy("k").agg(
        F.coalesce(F.sum("v"), F.lit(0.0)).alias("s")).collect()}
    assert out == {"a": 0.0, "b": 1.0}


def test_sanitize(spark):
    df = spark.createDataFrame(
        [(None, 1.0, 1.0), (-2.0, 1.0, 1.0), (3.0, 0.0, 1.0), (3.0, 1.0, 1e-9), (3.0, 1.0, 1.0)],
        "p double, is_solar_available double, solar_proxy double")
    assert [r[0] for r in df.select(sanitize(F.col("p"))).collect()] == [0.0, 0.0, 0.0, 0.0, 3.0]


def test_rescale_zero_raw_sum_and_missing(spark):
    df = spark.createDataFrame([(2.0, 0.0), (None, 5.0), (4.0, 2.0)], "d double, s double")
    got = [r[0] for r in df.select(rescale_factor(F.col("d"), F.col("s"))).collect()]
    assert got == [2.0 / 1e-9, 0.0, 2.0]


def test_guard_is_inclusive_and_never_raises(spark):
    df = spark.createDataFrame([(0.0, 0.15), (0.0, 0.1500001), (0.5, 0.01)], "h double, day double")
    got = [r[0] for r in df.select(_guard(F.col("h"), F.col("day"), 0.15, 0.7)).collect()]
    assert got == [0.7, 1.0, 1.0]
    assert all(g <= 1.0 for g in got)


def _haversine(lat1, lon1, lat2, lon2):
    p1, p2 = math.radians(lat1), math.radians(lat2)
    a = math.sin(math.radians(lat2 - lat1) / 2) ** 2 + math.cos(p1) * math.cos(p2) * math.sin(
        math.radians(lon2 - lon1) / 2) ** 2
    return 2 * 6371.0 * math.asin(math.sqrt(min(a, 1.0)))


def test_haversine(spark):
    df = spark.createDataFrame([(10.0, 20.0, -30.0, 170.0)], "a double, b double, c double, d double")
    got = df.select(haversine_km(F.col("a"), F.col("b"), F.col("c"), F.col("d"))).first()[0]
    assert got == pytest.approx(_haversine(10.0, 20.0, -30.0, 170.0), rel=1e-12)


@pytest.mark.parametrize("seed,n_train,n_query,spread", [(1, 40, 60, 30.0), (2, 1, 3, 5.0), (3, 4, 6, 170.0),
                                                          (4, 200, 50, 1.0), (5, 400, 400, 0.02)])
def test_grid_knn_matches_brute_force(spark, seed, n_train, n_query, spread):
    rnd = random.Random(seed)
    devs = [f"D{i:04d}" for i in range(max(n_train, n_query))]
    rows, loc = [], {}
    for i, d in enumerate(devs[:n_query]):
        loc[d] = (max(-89.0, min(89.0, rnd.uniform(-spread, spread) / 2)), rnd.uniform(-spread, spread))
    for i, d in enumerate(devs[:n_train]):
        if spread < 0.1 and i % 10 == 0:  # a dense cluster plus a few devices spread worldwide
            loc[d] = (rnd.uniform(-60, 60), rnd.uniform(-180, 180))
        loc.setdefault(d, (rnd.uniform(-60, 60), rnd.uniform(-180, 180)))
        for day in range(3):
            rows.append((d, f"2024-01-0{day + 1}", rnd.random(), loc[d][0], loc[d][1]))
    train = spark.createDataFrame(rows, "deviceSn string, date string, pvGenTotal double, latitude double, longitude double")
    qrows = [(d, "2024-01-01", 0.0, loc[d][0], loc[d][1]) for d in devs[:max(n_query, n_train)] if d in loc]
    points = spark.createDataFrame(qrows, train.schema).unionByName(train)
    got = {r["deviceSn"]: r for r in nearest_neighbour_stats(train, points).collect()}

    pdf = pd.DataFrame(rows, columns=["deviceSn", "date", "y", "lat", "lon"])
    daily = pdf.groupby(["deviceSn", "date"])["y"].sum().groupby("deviceSn")
    stats = pd.DataFrame({"mean": daily.mean(), "p90": daily.quantile(0.9)})
    for q in {r[0] for r in qrows}:
        cands = sorted((_haversine(loc[q][0], loc[q][1], loc[t][0], loc[t][1]), t) for t in stats.index if t != q)
        if not cands:
            cands = [(0.0, q)]
        top3, top5 = cands[:3], cands[:5]
        r = got[q]
        assert r["nn_1_distance_km"] == pytest.approx(top3[0][0], abs=1e-6)
        assert r["nn_3_daily_mean"] == pytest.approx(sum(stats.loc[t, "mean"] for _, t in top3) / len(top3))
        assert r["nn_5_daily_p90"] == pytest.approx(sum(stats.loc[t, "p90"] for _, t in top5) / len(top5))


def test_split_properties(spark):
    from pvlake.plans.context import RunContext

    ctx = RunContext.get(spark, "/root/testdata/sf0.001")
    lab = ctx.scalar
    assert lab.count() == ctx.points.count()  # labels partition the rows
    trained = lab.filter((F.col("split") == "train") & (F.col("eval_split") == "train")).select("deviceSn").distinct()
    unseen = lab.filter(F.col("eval_split") == "valid_unseen").select("deviceSn").distinct()
    assert trained.join(unseen, "deviceSn").count() == 0


def test_blend_endpoints_and_guards(spark):
    from pvlake.plans.registry import experiment

    e = experiment(spark, "/root/testdata/sf0.001")
    sd = e.policy_days
    bad = sd.filter(
        (F.col("k_guard_broad") > F.col("k_fallback") + 1e-12)
        | (F.col("k_guard_precision") > F.col("k_fallback") + 1e-12)
        | (F.col("k_guard_piecewise") > F.col("k_fallback") + 1e-12)).count()
    assert bad == 0
    pts = e.points
    a0 = pts.select(F.max(F.abs(F.col("pred_validated_blend") - (
        F.col("pred_norm_calibrated") * sd.agg(F.first("blend_alpha")).scalar()
        + F.col("pred_daily_model_rescaled") * (1 - sd.agg(F.first("blend_alpha")).scalar()))))).first()[0]
    assert a0 < 1e-12


def test_knn_devices_without_coordinates(spark):
    """Missing coordinates sort last, in name order (NaN distance), as in the reference."""
    rnd = random.Random(7)
    loc = {}
    for i in range(12):
        d = f"T{i:02d}"
        loc[d] = (None, None) if i in (2, 5, 9) else (rnd.uniform(0, 2), rnd.uniform(0, 2))
    rows = [(d, f"2024-01-0{k + 1}", rnd.random(), la, lo) for d, (la, lo) in loc.items() for k in range(2)]
    schema = "deviceSn string, date string, pvGenTotal double, latitude double, longitude double"
    train = spark.createDataFrame(rows, schema)
    queries = [("Q0", "2024-01-01", 0.0, None, None), ("Q1", "2024-01-01", 0.0, 1.0, 1.0)]
    points = spark.createDataFrame(queries, schema).unionByName(train)
    got = {r["deviceSn"]: r for r in nearest_neighbour_stats(train, points).collect()}

    pdf = pd.DataFrame(rows, columns=["deviceSn", "date", "y", "lat", "lon"])
    daily = pdf.groupby(["deviceSn", "date"])["y"].sum().groupby("deviceSn")
    mean = daily.mean()
    qloc = {**{d: v for d, v in loc.items()}, "Q0": (None, None), "Q1": (1.0, 1.0)}
    for q in qloc:
        def key(t):
            la, lo = qloc[q]
            tl = loc[t]
            if la is None or tl[0] is None:
                return (1, 0.0, t)
            return (0, _haversine(la, lo, tl[0], tl[1]), t)
        order = sorted((t for t in mean.index if t != q), key=key)
        top3, top5 = order[:3], order[:5]
        r = got[q]
        first = key(top3[0])
        if first[0] == 1:
            assert r["nn_1_distance_km"] is None, q
        else:
            assert r["nn_1_distance_km"] == pytest.approx(first[1], abs=1e-6), q
        assert r["nn_3_daily_mean"] == pytest.approx(sum(mean[t] for t in top3) / 3), q
        assert r["nn_5_daily_mean"] == pytest.approx(sum(mean[t] for t in top5) / 5), q


def test_knn_candidates_of_one_site_stay_few(spark):
    """6,000 devices at one point: six candidates, and every device has the first other names."""
    from pvlake.operators.neighbours import K_MAX, candidates

    n = 6000
    train = spark.range(n).select(
        F.format_string("D%05d", F.col("id")).alias("deviceSn"), F.lit("2024-01-01").alias("date"),
        F.col("id").cast("double").alias("pvGenTotal"), F.lit(10.0).alias("latitude"), F.lit(20.0).alias("longitude"))
    site = train.select(F.col("deviceSn").alias("t_dev"), F.col("latitude").alias("t_lat"), F.col("longitude").alias("t_lon"))
    assert candidates(site).count() == K_MAX + 1
    got = nearest_neighbour_stats(train, train)
    rows = {r["deviceSn"]: r for r in got.filter(F.col("deviceSn").isin("D00000", "D00003", "D05999")).collect()}
    assert got.count() == n
    for name, i in (("D00000", 0), ("D00003", 3), ("D05999", 5999)):
        first = [j for j in range(7) if j != i][:5]
        assert rows[name]["nn_1_distance_km"] == 0.0
        assert rows[name]["nn_3_daily_mean"] == pytest.approx(sum(first[:3]) / 3)
        assert rows[name]["nn_5_daily_mean"] == pytest.approx(sum(first) / 5)


def test_knn_sites_match_brute_force(spark):
    """Several sites of many devices, some devices only asking."""
    rnd = random.Random(11)
    sites = [(rnd.uniform(-2, 2), rnd.uniform(-2, 2)) for _ in range(5)]
    loc = {f"D{i:03d}": sites[rnd.randrange(5)] for i in range(80)}
    schema = "deviceSn string, date string, pvGenTotal double, latitude double, longitude double"
    train = spark.createDataFrame([(d, "2024-01-01", rnd.random(), *loc[d]) for d in list(loc)[:60]], schema)
    asking = spark.createDataFrame([(d, "2024-01-01", 0.0, *loc[d]) for d in list(loc)[60:]], schema)
    got = {r["deviceSn"]: r for r in nearest_neighbour_stats(train, train.unionByName(asking)).collect()}
    mean = {r["deviceSn"]: r["pvGenTotal"] for r in train.collect()}
    for d, at in loc.items():
        near = sorted((round(_haversine(*at, *loc[t]), 9), t) for t in mean if t != d)[:5]
        assert got[d]["nn_5_daily_mean"] == pytest.approx(sum(mean[t] for _, t in near) / 5), d


def test_leakage_audit_reports_a_poisoned_table(spark):
    from pvlake.operators.reports import leakage_audit
    from pvlake.plans.context import RunContext
    from pvlake.plans.features import point_feature_columns

    ctx = RunContext.get(spark, "/root/testdata/sf0.001")
    names = point_feature_columns(ctx.features)
    assert tuple(leakage_audit(ctx.features, names).first()) == (0, 0, 0, "")
    poisoned = ctx.features.withColumns({
        "device_history_days": F.col("device_history_days") + 1, "device_slot_mean": F.col("device_slot_mean") + 0.5})
    row = leakage_audit(poisoned, [*names, "daily_target"]).first()
    assert row["devices_with_other_days"] > 0 and row["slots_with_other_rows"] > 0
    assert row["history_devices_outside_training"] > 0 and row["label_columns_in_features"] == "daily_target"


def test_models_default_to_published_sizes(spark):
    import inspect

    from pvlake.models.boosting import boost
    from pvlake.models.gbt import GbtConfig, gbt

    point, daily = gbt(GbtConfig(), "y", "p"), gbt(GbtConfig(), "y", "p", daily=True)
    assert (point.getMaxIter(), point.getStepSize(), point.getMinInstancesPerNode()) == (700, 0.035, 30)
    assert (daily.getMaxIter(), daily.getStepSize(), daily.getMinInstancesPerNode()) == (500, 0.04, 15)
    default = {k: v.default for k, v in inspect.signature(boost).parameters.items()}
    assert (default["rounds"], default["learning_rate"], default["row_share"], default["column_share"]) == (700, 0.035, 0.85, 0.85)


def test_registered_fits_have_published_sizes(spark, monkeypatch):
    from pvlake.models import boosting
    from pvlake.plans import registry

    sf, asked = "/root/testdata/sf0.001", []
    cfg = registry.experiment(spark, sf, predictors="gbt").predictors.cfg
    assert (cfg.point_trees, cfg.daily_trees, cfg.point_step, cfg.daily_step, cfg.max_depth) == (700, 500, 0.035, 0.04, 6)

    def boost(every, train_rows, cols, label, **kw):
        asked.append((kw["loss"], kw["rounds"], kw["learning_rate"], kw["depth"]))
        return boosting.Boosted(0.5, 0.1, [])

    monkeypatch.setattr(boosting, "boost", boost)
    for name in ("huber_point_predictions", "fair_point_predictions"):
        registry.REGISTRY[name].build(spark, sf)
    assert asked == [("huber", 700, 0.035, 6), ("fair", 700, 0.035, 6)]
