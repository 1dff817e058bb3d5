"""pandas -> Spark semantic rules on hand-made rows."""
import datetime as dt

import pytest
from pyspark.sql import functions as F

from pvlake.functions.columns import physics_features, spatial_features, time_features
from pvlake.plans.features import daily_feature_columns, point_feature_columns


def test_time_parts_and_cyclic(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1, 13, 47),), (dt.datetime(2024, 12, 31, 0, 0),), (None,)],
                               "us_timestamp timestamp_ntz")
    r = time_features(df).collect()
    assert (r[0]["hour"], r[0]["minute"], r[0]["slot_id"], r[0]["weekday"], r[0]["is_weekend"]) == (13, 47, 55, 0, 0)
    assert r[1]["day_of_year"] == 366 and r[1]["weekday"] == 1  # leap year, Tuesday
    assert r[2]["hour"] is None and r[2]["is_weekend"] == 0.0  # missing time: weekend flag 0 as pandas


def test_radiation_proxy_skips_missing_and_clips(spark):
    df = spark.createDataFrame(
        [(30.0, None, 500.0, 40.0, 1.0), (30.0, None, None, None, None), (-5.0, -20.0, None, 10.0, 0.0)],
        "altitude double, global_tilted_irradiance_instant double, shortwave_radiation double, "
        "cloud_cover_H double, is_day double")
    out = physics_features(df, F.lit(10.0)).collect()
    assert out[0]["radiation_proxy"] == 500.0
    assert out[0]["elevation_weight"] == pytest.approx(0.5)
    assert out[0]["radiation_cloud_adjusted"] == pytest.approx(500.0 * 0.6)
    assert out[1]["radiation_proxy"] == 0.0 and out[1]["is_solar_available"] == 0.0
    assert out[2]["radiation_proxy"] == 0.0 and out[2]["elevation_weight"] == 0.0  # clip, sun below horizon
    assert out[0]["is_solar_available"] == 1.0


def test_cloud_median_fill(spark):
    df = spark.createDataFrame([(30.0, 100.0, None)], "altitude double, shortwave_radiation double, "
                                                      "cloud_cover_H double")
    out = physics_features(df, F.lit(50.0)).first()
    assert out["radiation_cloud_adjusted"] == pytest.approx(50.0)


def test_spatial_rounding_bins_and_family(spark):
    df = spark.createDataFrame([(25.25, -80.35, "xxEP1234567yy"), (None, 1.0, "EP12"), (-0.05, 12.0, "ABC")],
                               "latitude double, longitude double, deviceSn string")
    out = spatial_features(df).collect()
    assert (out[0]["lat_round_1"], out[0]["lon_round_1"]) == (25.2, -80.4)  # half-even like numpy
    assert out[0]["region_lon_5"] == -85.0 and out[0]["region_lat_10"] == 20.0
    assert out[0]["lat_lon_bin"] == "25.2_-80.4"
    assert out[0]["device_family_code"] == 1234567.0
    assert out[1]["lat_lon_bin"] == "nan_1.0" and out[1]["device_family_code"] == -1.0
    assert out[2]["region_lat_5"] == -5.0


def test_feature_lists_exclude_labels(spark):
    from pvlake.plans.context import RunContext

    ctx = RunContext.get(spark, "/root/testdata/sf0.001")
    point = point_feature_columns(ctx.features)
    assert "pvGenTotal" not in point and "y_norm" not in point and "y_norm_clipped" not in point
    assert "deviceSn" not in point and "lat_lon_bin" not in point and "row_id" not in point
    assert "solar_proxy" in point and "nn_3_daily_mean" in point
    daily = daily_feature_columns(ctx.daily)
    assert "target_per_solar" not in daily and "daily_target_log1p" not in daily
    assert "target_per_solar" in daily_feature_columns(ctx.daily, reproduce_leak=True)


def test_all_empty_column_is_pruned(spark):
    from pvlake.models.gbt import non_empty

    df = spark.createDataFrame([(1.0, None), (2.0, None)], "a double, b double")
    assert non_empty(df, ["a", "b"]) == ["a"]
