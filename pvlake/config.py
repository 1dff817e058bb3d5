"""Named constants of the forecasting workflow.

Fixed values: these must equal the workflow being reproduced for results to
match, so they are kept together here as plain data.
"""

from __future__ import annotations

from dataclasses import dataclass

# --- fixed values -----------------------------------------------------------
FEATURE_EPS = 1e-6
METRIC_EPS = 1e-9
RESCALE_FLOOR = 1e-9
SOLAR_OFF_CUT = 1e-8
SOLAR_AVAILABLE_CUT = 1e-4
NORM_TRAIN_CUT = 1e-5
Y_NORM_CAP_QUANTILE = 0.995
HOLDOUT_DAYS = 7
UNSEEN_MIN, UNSEEN_MAX = 4, 8
HISTORY_RAMP_DAYS = 14.0
COLD_ALPHA_CUT = 1e-6
EARTH_RADIUS_KM = 6371.0
BROAD_GUARD = (0.15, 0.7)
PRECISION_GUARD = (0.06, 0.4)
PIECEWISE_GUARD = (0.04, 0.06, 0.50, 0.55)
LOW_LOAD_CUTS = (0.05, 0.10)
WEATHER_BIN_CUTS = (300.0, 700.0)
BLEND_ALPHAS = tuple(i / 10 for i in range(11))
EVAL_SPLITS = ("train", "valid_seen", "valid_unseen", "test1", "test2")
SOURCE_SPLITS = ("train", "test1", "test2")

RADIATION_CANDIDATES = (
    "global_tilted_irradiance_instant",
    "global_tilted_irradiance",
    "shortwave_radiation_instant",
    "shortwave_radiation",
)
PHYSICS_NUMERIC = (
    "altitude",
    "zenith_angle",
    "azimuth",
    "is_day",
    "shortwave_radiation",
    "direct_radiation",
    "diffuse_radiation",
    "direct_normal_irradiance",
    "global_tilted_irradiance",
    "terrestrial_radiation",
    "shortwave_radiation_instant",
    "direct_radiation_instant",
    "diffuse_radiation_instant",
    "direct_normal_irradiance_instant",
    "global_tilted_irradiance_instant",
    "terrestrial_radiation_instant",
    "cloud_cover_H",
)
OPTIONAL_WEATHER = (
    "temperature_2m",
    "relative_humidity_2m",
    "apparent_temperature",
    "precipitation",
    "rain",
    "wind_speed_10m",
    "wind_speed_80m",
    "visibility",
    "cloud_cover_H",
    "cloud_cover_low_H",
    "cloud_cover_mid_H",
    "cloud_cover_high_H",
    "shortwave_radiation_H",
    "global_tilted_irradiance_H",
    "uv_index_H",
)
SUMMED_WEATHER = ("precipitation", "rain", "shortwave_radiation_H", "global_tilted_irradiance_H")
POINT_EXCLUDED = ("pvGenTotal", "y_norm", "y_norm_clipped", "us_timestamp", "date_H", "date", "split", "eval_split")
CATEGORICAL = ("deviceSn", "lat_lon_bin")
DAILY_EXCLUDED = ("deviceSn", "date", "split", "eval_split", "daily_target", "daily_target_log1p")
# label-derived daily columns kept out of model inputs unless reproducing the leak
LABEL_DERIVED_DAILY = ("target_per_solar",)
# label and label-derived columns; none may be a model input
LABEL_COLUMNS = ("pvGenTotal", "y_norm", "y_norm_clipped", "daily_target", "daily_target_log1p", "target_per_solar")
# acceptance gates on daily MAPE
ACCEPTANCE_GATES = (("valid_seen", 0.09), ("valid_unseen", 0.18), ("test1", 0.10))
# prediction candidates in selection order, with their experiment names
CANDIDATES = (
    ("pred_irradiance_baseline", "E00_irradiance_baseline"),
    ("pred_raw_point", "E01_lgbm_raw_point"),
    ("pred_norm_point", "E03_lgbm_norm_target"),
    ("pred_daily_model_rescaled", "E02_lgbm_daily_rescaled"),
    ("pred_norm_calibrated", "E05_norm_plus_daily_calibration"),
    ("pred_validated_blend", "E07_validated_blend"),
    ("pred_history_fallback", "E08_history_dynamic_fallback"),
    ("pred_low_output_guard", "E09_low_output_guard"),
    ("pred_precision_low_output_guard", "E10_precision_low_output_guard"),
    ("pred_piecewise_low_output_guard", "E11_piecewise_low_output_guard"),
    ("pred_seen_new_branch", "E06_seen_new_branch"),
)
# columns of the points beside the base predictions that policies, sinks and reports read
BASE_POINT_COLUMNS = ("row_id", "split", "eval_split", "deviceSn", "date", "us_timestamp", "pvGenTotal", "slot_id", "device_history_days",
                      "region_lat_5", "region_lon_5", "cloud_cover_H", "pred_irradiance_baseline", "pred_raw_point", "pred_norm_point")
BASELINE_INPUTS = ("solar_proxy", "elevation_weight", "is_solar_available", "nn_3_daily_mean")
DEPLOYMENT_CANDIDATE = "pred_precision_low_output_guard"
COLD_START_EXPERIMENTS = (
    "E05_norm_plus_daily_calibration", "E07_validated_blend", "E08_history_dynamic_fallback",
    "E09_low_output_guard", "E10_precision_low_output_guard", "E11_piecewise_low_output_guard",
    "E02_lgbm_daily_rescaled",
)
FOLD_METRICS = ("combined_validation_daily_mape", "valid_seen_daily_mape", "valid_unseen_daily_mape",
                "test1_daily_mape", "test2_daily_mape")
STRESS_CANDIDATES = (
    "pred_norm_calibrated", "pred_validated_blend", "pred_history_fallback", "pred_low_output_guard",
    "pred_precision_low_output_guard", "pred_piecewise_low_output_guard", "pred_daily_model_rescaled",
    "pred_seen_new_branch",
)
# device-day rollup: (output, input, aggregate) in output order
DAILY_AGGS = (
    ("daily_target", "pvGenTotal", "sum"),
    ("rows_in_day", "pvGenTotal", "size"),
    ("solar_proxy_sum", "solar_proxy", "sum"),
    ("solar_proxy_max", "solar_proxy", "max"),
    ("radiation_proxy_sum", "radiation_proxy", "sum"),
    ("radiation_proxy_max", "radiation_proxy", "max"),
    ("elevation_weight_sum", "elevation_weight", "sum"),
    ("elevation_weight_max", "elevation_weight", "max"),
    ("is_solar_available_mean", "is_solar_available", "mean"),
    ("latitude", "latitude", "median"),
    ("longitude", "longitude", "median"),
    ("region_lat_5", "region_lat_5", "median"),
    ("region_lon_5", "region_lon_5", "median"),
    ("region_lat_10", "region_lat_10", "median"),
    ("region_lon_10", "region_lon_10", "median"),
    ("device_family_code", "device_family_code", "median"),
    ("device_daily_mean", "device_daily_mean", "median"),
    ("device_daily_p90", "device_daily_p90", "median"),
    ("device_history_days", "device_history_days", "median"),
    ("nn_3_daily_mean", "nn_3_daily_mean", "median"),
    ("nn_3_daily_p90", "nn_3_daily_p90", "median"),
    ("nn_5_daily_mean", "nn_5_daily_mean", "median"),
    ("nn_1_distance_km", "nn_1_distance_km", "median"),
)
# drift report metrics
DRIFT_METRICS = (
    "daily_target_mean",
    "daily_target_median",
    "daily_target_p10",
    "daily_target_p90",
    "low_load_share_lt_0_05",
    "low_load_share_lt_0_10",
    "solar_proxy_sum_median",
    "radiation_proxy_sum_median",
    "nonzero_row_ratio",
    "train_device_overlap_ratio",
)
# daily sink columns and the candidate each one sums
DAILY_SINK = (
    ("final_pred_daily", "final_prediction"),
    ("baseline_daily", "pred_irradiance_baseline"),
    ("raw_point_daily", "pred_raw_point"),
    ("norm_point_daily", "pred_norm_point"),
    ("calibrated_daily", "pred_norm_calibrated"),
    ("validated_blend_daily", "pred_validated_blend"),
    ("history_fallback_daily", "pred_history_fallback"),
    ("low_output_guard_daily", "pred_low_output_guard"),
    ("precision_low_output_guard_daily", "pred_precision_low_output_guard"),
    ("piecewise_low_output_guard_daily", "pred_piecewise_low_output_guard"),
    ("seen_new_branch_daily", "pred_seen_new_branch"),
    ("deployment_daily", "deployment_prediction"),
)
# stacking inputs
STACK_COLS = ("baseline_daily", "raw_point_daily", "norm_point_daily", "calibrated_daily", "validated_blend_daily",
              "history_fallback_daily", "low_output_guard_daily", "precision_low_output_guard_daily",
              "piecewise_low_output_guard_daily", "seen_new_branch_daily")
# ---------------------------------------------------------------------------


@dataclass(frozen=True)
class Settings:
    """Run-time switches (not fixed values)."""

    holdout_days: int = HOLDOUT_DAYS
    unseen_fold: int | None = None
    n_unseen_folds: int | None = None
    unseen_strategy: str = "default"
    # y_norm cap rows: "split_train" (every split=train row, as published) or
    # "train_mask" (only rows that stay in training after labelling)
    cap_rows: str = "split_train"
    # exact percentiles (pandas parity) or percentile_approx for very large groups
    approx_quantiles: bool = False
