"""Independent DuckDB SQL for the correctness gate.

These statements restate the semantics in plain SQL over the pre-registered
tables (``events`` ...). They are written separately from the DataFrame code
and use brute force where the Spark side is clever (e.g. all device pairs for
the nearest neighbours), so a match checks the Spark plan, not a copy of it.
Fractional literals are written as doubles (``1e-6``, ``60e0``).
"""

from __future__ import annotations

from pvlake.config import FOLD_METRICS, STACK_COLS

PV_POINTS = r"""
pv_points AS (
  SELECT event_id AS row_id, ts AS us_timestamp, strftime(ts, '%Y-%m-%d') AS date,
    'EP' || lpad(CAST(user_id // 10 AS VARCHAR), 7, '0') || 'U' || lpad(CAST(user_id AS VARCHAR), 5, '0') AS deviceSn,
    CASE WHEN user_id % 10 = 9 THEN 'test2'
         WHEN user_id % 2 = 0 AND strftime(ts, '%Y-%m-%d') >= '2024-01-24' THEN 'test1'
         ELSE 'train' END AS split,
    CASE WHEN hour(ts) BETWEEN 3 AND 20 THEN value / 400e0 ELSE 0e0 END AS pvGenTotal,
    25e0 + (user_id * 37 % 2000) / 100e0 AS latitude,
    -80e0 - (user_id * 53 % 4000) / 100e0 AS longitude,
    CAST(60 - 6 * abs(hour(ts) + minute(ts) / 60e0 - 12) AS DOUBLE) AS altitude,
    CAST(90 - (60 - 6 * abs(hour(ts) + minute(ts) / 60e0 - 12)) AS DOUBLE) AS zenith_angle,
    15e0 * hour(ts) AS azimuth,
    CASE WHEN hour(ts) BETWEEN 3 AND 20 THEN 1e0 ELSE 0e0 END AS is_day,
    CASE WHEN event_id % 11 = 0 THEN NULL ELSE CAST(event_id * 7 % 900 AS DOUBLE) END AS global_tilted_irradiance_instant,
    CASE WHEN event_id % 13 = 0 THEN NULL ELSE CAST(event_id * 3 % 800 - 20 AS DOUBLE) END AS shortwave_radiation,
    CASE WHEN event_id % 17 = 0 THEN NULL ELSE CAST(event_id * 13 % 130 - 10 AS DOUBLE) END AS cloud_cover_H,
    event_id % 25 + 5e-1 AS temperature_2m,
    CAST(event_id % 4 AS DOUBLE) AS rain,
    CAST(NULL AS DOUBLE) AS empty_weather
  FROM events
)"""


def labels_sql(strategy: str = "default", fold: int = 0, k: int = 0, holdout: int = 7) -> str:
    if strategy == "low_capacity":
        pick = """
unseen AS (
  SELECT deviceSn FROM (
    SELECT deviceSn, row_number() OVER (ORDER BY cap, deviceSn) - 1 AS pos FROM (
      SELECT deviceSn, avg(s) AS cap FROM (
        SELECT p.deviceSn, p.date, coalesce(sum(p.pvGenTotal), 0e0) AS s
        FROM pv_points p JOIN cands c ON p.deviceSn = c.deviceSn
        WHERE p.split = 'train' AND p.date IS NOT NULL GROUP BY p.deviceSn, p.date) GROUP BY deviceSn))
  WHERE pos < (SELECT n FROM cand_n))"""
    elif k > 1:
        pick = f"""
unseen AS (
  SELECT deviceSn FROM (SELECT deviceSn, row_number() OVER (ORDER BY deviceSn) - 1 AS pos FROM cands)
  WHERE pos % {k} = {fold % k})"""
    else:
        pick = """
unseen AS (
  SELECT deviceSn FROM (SELECT deviceSn, row_number() OVER (ORDER BY deviceSn) - 1 AS pos FROM cands)
  WHERE pos < (SELECT n FROM cand_n))"""
    return f"""
train_days AS (SELECT DISTINCT deviceSn, date FROM pv_points WHERE split = 'train' AND date IS NOT NULL),
holdout AS (
  SELECT deviceSn, date FROM (
    SELECT deviceSn, date, row_number() OVER (PARTITION BY deviceSn ORDER BY date DESC) AS r FROM train_days)
  WHERE r <= {holdout}),
cands AS (
  SELECT DISTINCT deviceSn FROM pv_points WHERE split = 'train'
  EXCEPT SELECT DISTINCT deviceSn FROM pv_points WHERE split = 'test1'),
cand_n AS (SELECT greatest(4, least(8, greatest(count(*) // 4, 1))) AS n FROM cands),
{pick.strip()},
labelled AS (
  SELECT p.*,
    CASE WHEN p.split = 'test1' THEN 'test1'
         WHEN p.split = 'test2' THEN 'test2'
         WHEN p.split = 'train' AND u.deviceSn IS NOT NULL THEN 'valid_unseen'
         WHEN p.split = 'train' AND h.deviceSn IS NOT NULL THEN 'valid_seen'
         ELSE 'train' END AS eval_split
  FROM pv_points p
  LEFT JOIN holdout h ON p.deviceSn = h.deviceSn AND p.date = h.date
  LEFT JOIN unseen u ON p.deviceSn = u.deviceSn
)"""


SCALAR_FEATURES = r"""
f_time AS (
  SELECT *, CAST(hour(us_timestamp) AS DOUBLE) AS hour, CAST(minute(us_timestamp) AS DOUBLE) AS minute,
    CAST(dayofyear(us_timestamp) AS DOUBLE) AS day_of_year, CAST(month(us_timestamp) AS DOUBLE) AS month,
    CAST(isodow(us_timestamp) - 1 AS DOUBLE) AS weekday
  FROM labelled
),
f_time2 AS (
  SELECT *, hour * 4 + floor(minute / 15e0) AS slot_id,
    CASE WHEN weekday >= 5 THEN 1e0 ELSE 0e0 END AS is_weekend
  FROM f_time
),
f_phys AS (
  SELECT *,
    sin(2 * pi() * hour / 24) AS sin_hour, cos(2 * pi() * hour / 24) AS cos_hour,
    sin(2 * pi() * slot_id / 96) AS sin_slot, cos(2 * pi() * slot_id / 96) AS cos_slot,
    sin(2 * pi() * day_of_year / 365) AS sin_doy, cos(2 * pi() * day_of_year / 365) AS cos_doy,
    greatest(coalesce(altitude, 0e0), 0e0) AS altitude_pos,
    greatest(sin(radians(coalesce(altitude, 0e0))), 0e0) AS elevation_weight,
    greatest(cos(radians(coalesce(zenith_angle, 90e0))), 0e0) AS zenith_cos,
    sin(radians(coalesce(azimuth, 0e0))) AS azimuth_sin,
    cos(radians(coalesce(azimuth, 0e0))) AS azimuth_cos,
    greatest(coalesce(greatest(global_tilted_irradiance_instant, shortwave_radiation), 0e0), 0e0) AS radiation_proxy
  FROM f_time2
),
f_phys2 AS (
  SELECT *, radiation_proxy * elevation_weight AS solar_proxy,
    radiation_proxy * (1 - least(greatest(coalesce(cloud_cover_H, (SELECT median(cloud_cover_H) FROM pv_points)), 0e0), 100e0) / 100) AS radiation_cloud_adjusted,
    radiation_proxy * elevation_weight AS radiation_x_elevation
  FROM f_phys
),
feat AS (
  SELECT *,
    CASE WHEN solar_proxy > 1e-4 AND coalesce(is_day, 1e0) > 0 THEN 1e0 ELSE 0e0 END AS is_solar_available,
    round_even(latitude, 1) AS lat_round_1, round_even(longitude, 1) AS lon_round_1,
    floor(latitude / 5e0) * 5 AS region_lat_5, floor(longitude / 5e0) * 5 AS region_lon_5,
    floor(latitude / 10e0) * 10 AS region_lat_10, floor(longitude / 10e0) * 10 AS region_lon_10,
    coalesce(CAST(round_even(latitude, 1) AS VARCHAR), 'nan') || '_' || coalesce(CAST(round_even(longitude, 1) AS VARCHAR), 'nan') AS lat_lon_bin,
    coalesce(TRY_CAST(nullif(regexp_extract(deviceSn, 'EP(\d{7})', 1), '') AS DOUBLE), -1e0) AS device_family_code
  FROM f_phys2
)"""

HISTORY = r"""
train_rows AS (SELECT * FROM feat WHERE split = 'train' AND eval_split = 'train'),
tr_daily AS (
  SELECT deviceSn, date, coalesce(sum(pvGenTotal), 0e0) AS daily_sum
  FROM train_rows WHERE date IS NOT NULL GROUP BY deviceSn, date),
dev_stats AS (
  SELECT deviceSn, avg(daily_sum) AS device_daily_mean, quantile_cont(daily_sum, 0.5) AS device_daily_median,
    quantile_cont(daily_sum, 0.9) AS device_daily_p90, max(daily_sum) AS device_daily_max,
    CAST(count(*) AS DOUBLE) AS device_history_days
  FROM tr_daily GROUP BY deviceSn),
slot_stats AS (
  SELECT deviceSn, slot_id, avg(pvGenTotal) AS device_slot_mean, quantile_cont(pvGenTotal, 0.9) AS device_slot_p90
  FROM train_rows WHERE slot_id IS NOT NULL GROUP BY deviceSn, slot_id),
gslot AS (
  SELECT slot_id, avg(pvGenTotal) AS global_slot_mean, quantile_cont(pvGenTotal, 0.9) AS global_slot_p90
  FROM train_rows WHERE slot_id IS NOT NULL GROUP BY slot_id),
tdev AS (
  SELECT l.deviceSn AS t_dev, l.t_lat, l.t_lon, d.t_mean, d.t_p90 FROM
    (SELECT deviceSn, median(latitude) AS t_lat, median(longitude) AS t_lon FROM train_rows GROUP BY deviceSn) l
    LEFT JOIN (SELECT deviceSn, avg(daily_sum) AS t_mean, quantile_cont(daily_sum, 0.9) AS t_p90
               FROM tr_daily GROUP BY deviceSn) d ON l.deviceSn = d.deviceSn),
qdev AS (SELECT deviceSn, median(latitude) AS latitude, median(longitude) AS longitude FROM feat GROUP BY deviceSn),
nn_pairs AS (
  SELECT q.deviceSn, t.t_dev, t.t_mean, t.t_p90,
    2 * 6371e0 * asin(sqrt(least(pow(sin(radians(t.t_lat - q.latitude) / 2), 2)
      + cos(radians(q.latitude)) * cos(radians(t.t_lat)) * pow(sin(radians(t.t_lon - q.longitude) / 2), 2), 1e0))) AS distance
  FROM qdev q, tdev t WHERE t.t_dev <> q.deviceSn),
nn_ranked AS (SELECT *, row_number() OVER (PARTITION BY deviceSn ORDER BY distance, t_dev) AS r FROM nn_pairs),
nn AS (
  SELECT deviceSn, min(distance) AS nn_1_distance_km,
    avg(CASE WHEN r <= 3 THEN t_mean END) AS nn_3_daily_mean, avg(CASE WHEN r <= 3 THEN t_p90 END) AS nn_3_daily_p90,
    avg(t_mean) AS nn_5_daily_mean, avg(t_p90) AS nn_5_daily_p90
  FROM nn_ranked WHERE r <= 5 GROUP BY deviceSn),
joined AS (
  SELECT f.*, ds.device_daily_mean, ds.device_daily_median, ds.device_daily_p90, ds.device_daily_max,
    ds.device_history_days, ss.device_slot_mean, ss.device_slot_p90, gs.global_slot_mean, gs.global_slot_p90,
    nn.nn_1_distance_km, nn.nn_3_daily_mean, nn.nn_3_daily_p90, nn.nn_5_daily_mean, nn.nn_5_daily_p90
  FROM feat f
  LEFT JOIN dev_stats ds ON f.deviceSn = ds.deviceSn
  LEFT JOIN slot_stats ss ON f.deviceSn = ss.deviceSn AND f.slot_id = ss.slot_id
  LEFT JOIN gslot gs ON f.slot_id = gs.slot_id
  LEFT JOIN nn ON f.deviceSn = nn.deviceSn),
meds AS (
  SELECT median(device_daily_mean) AS m1, median(device_daily_median) AS m2, median(device_daily_p90) AS m3,
    median(device_daily_max) AS m4, median(device_slot_mean) AS m5, median(device_slot_p90) AS m6 FROM joined),
enriched AS (
  SELECT * REPLACE (
    coalesce(device_daily_mean, nn_3_daily_mean, (SELECT m1 FROM meds)) AS device_daily_mean,
    coalesce(device_daily_median, nn_3_daily_mean, (SELECT m2 FROM meds)) AS device_daily_median,
    coalesce(device_daily_p90, nn_3_daily_mean, (SELECT m3 FROM meds)) AS device_daily_p90,
    coalesce(device_daily_max, nn_3_daily_mean, (SELECT m4 FROM meds)) AS device_daily_max,
    coalesce(device_history_days, 0e0) AS device_history_days,
    coalesce(device_slot_mean, global_slot_mean, (SELECT m5 FROM meds)) AS device_slot_mean,
    coalesce(device_slot_p90, global_slot_mean, (SELECT m6 FROM meds)) AS device_slot_p90)
  FROM joined),
ynorm AS (SELECT *, pvGenTotal / (solar_proxy + 1e-6) AS y_norm FROM enriched),
leak_safe_target AS (
  SELECT row_id, y_norm, least(greatest(y_norm, 0e0),
    (SELECT quantile_cont(y_norm, 0.995) FROM ynorm WHERE split = 'train' AND eval_split = 'train')) AS y_norm_clipped
  FROM ynorm),
points AS (
  SELECT *, least(greatest(y_norm, 0e0),
    (SELECT quantile_cont(y_norm, 0.995) FROM ynorm WHERE split = 'train')) AS y_norm_clipped
  FROM ynorm)"""

DAILY = r"""
daily AS (
  SELECT split, deviceSn, date,
    coalesce(sum(pvGenTotal), 0e0) AS daily_target, count(*) AS rows_in_day,
    coalesce(sum(solar_proxy), 0e0) AS solar_proxy_sum, max(solar_proxy) AS solar_proxy_max,
    coalesce(sum(radiation_proxy), 0e0) AS radiation_proxy_sum, max(radiation_proxy) AS radiation_proxy_max,
    coalesce(sum(elevation_weight), 0e0) AS elevation_weight_sum, max(elevation_weight) AS elevation_weight_max,
    avg(is_solar_available) AS is_solar_available_mean,
    median(latitude) AS latitude, median(longitude) AS longitude,
    median(region_lat_5) AS region_lat_5, median(region_lon_5) AS region_lon_5,
    median(region_lat_10) AS region_lat_10, median(region_lon_10) AS region_lon_10,
    median(device_family_code) AS device_family_code,
    median(device_daily_mean) AS device_daily_mean, median(device_daily_p90) AS device_daily_p90,
    median(device_history_days) AS device_history_days,
    median(nn_3_daily_mean) AS nn_3_daily_mean, median(nn_3_daily_p90) AS nn_3_daily_p90,
    median(nn_5_daily_mean) AS nn_5_daily_mean, median(nn_1_distance_km) AS nn_1_distance_km,
    avg(temperature_2m) AS temperature_2m_mean, max(temperature_2m) AS temperature_2m_max,
    avg(rain) AS rain_mean, max(rain) AS rain_max, coalesce(sum(rain), 0e0) AS rain_sum,
    avg(cloud_cover_H) AS cloud_cover_H_mean, max(cloud_cover_H) AS cloud_cover_H_max,
    min(eval_split) AS eval_split,
    ln(1 + coalesce(sum(pvGenTotal), 0e0)) AS daily_target_log1p,
    coalesce(sum(pvGenTotal), 0e0) / (coalesce(sum(solar_proxy), 0e0) + 1e-6) AS target_per_solar
  FROM points WHERE date IS NOT NULL GROUP BY split, deviceSn, date)"""

SPLIT_SUMMARY = r"""
train_devs AS (SELECT DISTINCT deviceSn FROM points WHERE eval_split = 'train'),
dd AS (SELECT DISTINCT eval_split, deviceSn FROM daily),
devs AS (
  SELECT dd.eval_split, count(*) AS devices,
    count(t.deviceSn) / greatest(count(*), 1) AS train_device_overlap_ratio
  FROM dd LEFT JOIN train_devs t ON dd.deviceSn = t.deviceSn GROUP BY dd.eval_split),
per_day AS (
  SELECT eval_split, count(*) AS days, min(date) AS date_min, max(date) AS date_max,
    avg(daily_target) AS daily_target_mean, quantile_cont(daily_target, 0.5) AS daily_target_median,
    stddev_samp(daily_target) AS daily_target_std,
    quantile_cont(daily_target, 0.1) AS daily_target_p10, quantile_cont(daily_target, 0.9) AS daily_target_p90,
    avg(CASE WHEN daily_target < 0.05 THEN 1e0 ELSE 0e0 END) AS low_load_share_lt_0_05,
    avg(CASE WHEN daily_target < 0.10 THEN 1e0 ELSE 0e0 END) AS low_load_share_lt_0_10,
    median(solar_proxy_sum) AS solar_proxy_sum_median, median(radiation_proxy_sum) AS radiation_proxy_sum_median,
    median(latitude) AS latitude_median, median(longitude) AS longitude_median,
    count(DISTINCT coalesce(CAST(region_lat_5 AS VARCHAR), 'nan') || '_' || coalesce(CAST(region_lon_5 AS VARCHAR), 'nan')) AS region5_count
  FROM daily GROUP BY eval_split),
per_point AS (
  SELECT eval_split, avg(CASE WHEN pvGenTotal > 0 THEN 1e0 ELSE 0e0 END) AS nonzero_row_ratio
  FROM points GROUP BY eval_split),
summary AS (
  SELECT per_day.*, devs.devices, devs.train_device_overlap_ratio, per_point.nonzero_row_ratio
  FROM per_day JOIN devs ON per_day.eval_split = devs.eval_split
  LEFT JOIN per_point ON per_day.eval_split = per_point.eval_split)"""

DRIFT_METRICS = (
    "daily_target_mean", "daily_target_median", "daily_target_p10", "daily_target_p90",
    "low_load_share_lt_0_05", "low_load_share_lt_0_10", "solar_proxy_sum_median",
    "radiation_proxy_sum_median", "nonzero_row_ratio", "train_device_overlap_ratio",
)
COMPARED = ("valid_seen", "valid_unseen", "test1", "test2")


def drift_sql() -> str:
    unions = "\n  UNION ALL ".join(
        f"SELECT eval_split, '{m}' AS metric, CAST({m} AS DOUBLE) AS value FROM summary" for m in DRIFT_METRICS)
    cols = ",\n    ".join(
        f"max(value) FILTER (WHERE eval_split = '{s}') AS {s}" for s in ("train",) + COMPARED)
    ratios = ",\n  ".join(
        f"CASE WHEN abs(train) > 1e-12 THEN {s} / train END AS {s}_vs_train_ratio" for s in COMPARED)
    return f"""
long_metrics AS (
  {unions}),
drift AS (
  SELECT metric,
    {cols}
  FROM long_metrics GROUP BY metric),
drift_out AS (SELECT *,
  {ratios}
  FROM drift)"""


def chain(*parts: str) -> str:
    """Join CTE fragments into one WITH clause."""
    return "WITH " + ",\n".join(p.strip() for p in parts)


def features_chain(strategy: str = "default", fold: int = 0, k: int = 0) -> list[str]:
    return [PV_POINTS, labels_sql(strategy, fold, k), SCALAR_FEATURES, HISTORY]


def sanitize(x: str) -> str:
    return f"(CASE WHEN is_solar_available <= 0 OR solar_proxy <= 1e-8 THEN 0e0 ELSE greatest(coalesce({x}, 0e0), 0e0) END)"


CANDIDATES = (
    "pred_irradiance_baseline", "pred_raw_point", "pred_norm_point", "pred_daily_model_rescaled",
    "pred_norm_calibrated", "pred_validated_blend", "pred_history_fallback", "pred_low_output_guard",
    "pred_precision_low_output_guard", "pred_piecewise_low_output_guard", "pred_seen_new_branch",
)
EXPERIMENTS = (
    "E00_irradiance_baseline", "E01_lgbm_raw_point", "E03_lgbm_norm_target", "E02_lgbm_daily_rescaled",
    "E05_norm_plus_daily_calibration", "E07_validated_blend", "E08_history_dynamic_fallback",
    "E09_low_output_guard", "E10_precision_low_output_guard", "E11_piecewise_low_output_guard",
    "E06_seen_new_branch",
)


def _blend(a: str) -> str:
    return sanitize(f"{a} * pred_norm_calibrated + (1 - {a}) * pred_daily_model_rescaled")


EXPERIMENT = f"""
bl_train_daily AS (
  SELECT deviceSn, date, coalesce(sum(pvGenTotal), 0e0) AS s FROM points
  WHERE eval_split = 'train' AND date IS NOT NULL GROUP BY deviceSn, date),
bl_dev AS (SELECT deviceSn, avg(s) AS dev_total FROM bl_train_daily GROUP BY deviceSn),
bl_nn AS (SELECT deviceSn, median(nn_3_daily_mean) AS nn_total FROM points GROUP BY deviceSn),
bl AS (
  SELECT p.*, coalesce(d.dev_total, n.nn_total, (SELECT avg(s) FROM bl_train_daily)) AS bl_total,
    sum(p.solar_proxy) OVER (PARTITION BY p.deviceSn, p.date) AS bl_sw,
    sum(p.elevation_weight) OVER (PARTITION BY p.deviceSn, p.date) AS bl_ew,
    count(*) OVER (PARTITION BY p.deviceSn, p.date) AS bl_n
  FROM points p LEFT JOIN bl_dev d ON p.deviceSn = d.deviceSn LEFT JOIN bl_nn n ON p.deviceSn = n.deviceSn),
base AS (
  SELECT *,
    {sanitize("CASE WHEN bl_sw > 0 THEN bl_total * solar_proxy / bl_sw WHEN bl_ew > 0 THEN bl_total * elevation_weight / bl_ew ELSE bl_total / bl_n END")} AS pred_irradiance_baseline,
    {sanitize("global_slot_mean")} AS pred_raw_point,
    {sanitize("device_slot_mean")} AS pred_norm_point
  FROM bl),
dpred AS (
  SELECT split, deviceSn, date, greatest(coalesce(device_daily_mean, 0e0), 0e0) AS pred_daily_model,
    greatest(coalesce(device_daily_p90, 0e0), 0e0) AS pred_day_calibrated FROM daily),
resc AS (
  SELECT b.*, d.pred_daily_model, d.pred_day_calibrated,
    sum(b.pred_norm_point) OVER (PARTITION BY b.split, b.deviceSn, b.date) AS raw_sum
  FROM base b LEFT JOIN dpred d ON b.split = d.split AND b.deviceSn = d.deviceSn AND b.date = d.date),
resc2 AS (
  SELECT *,
    {sanitize("pred_norm_point * (pred_daily_model / greatest(raw_sum, 1e-9))")} AS pred_daily_model_rescaled,
    {sanitize("pred_norm_point * (pred_day_calibrated / greatest(raw_sum, 1e-9))")} AS pred_norm_calibrated
  FROM resc),
alphas AS (SELECT i / 10e0 AS a FROM range(0, 11) t(i)),
blend_day AS (
  SELECT a.a, r.eval_split, r.deviceSn, r.date, coalesce(sum(r.pvGenTotal), 0e0) AS y,
    sum({_blend("a.a")}) AS p
  FROM resc2 r, alphas a WHERE r.eval_split IN ('valid_seen', 'valid_unseen') GROUP BY ALL),
blend_split AS (
  SELECT a, eval_split, avg(abs(y - p) / greatest(abs(y), 1e-9)) AS dm FROM blend_day GROUP BY ALL),
blend_scores AS (
  SELECT a AS alpha, 0.5 * max(dm) FILTER (WHERE eval_split = 'valid_seen')
    + 0.5 * max(dm) FILTER (WHERE eval_split = 'valid_unseen') AS combined
  FROM blend_split GROUP BY a),
best_alpha AS (SELECT alpha FROM blend_scores WHERE isfinite(combined) ORDER BY round(combined, 9), alpha LIMIT 1),
seen_devs AS (SELECT DISTINCT deviceSn FROM points WHERE split = 'train' AND eval_split = 'train'),
pol AS (
  SELECT r.*, (SELECT alpha FROM best_alpha) AS blend_alpha,
    least(greatest(coalesce(device_history_days, 0e0) / 14e0, 0e0), 1e0) AS cold_start_alpha,
    r.deviceSn IN (SELECT deviceSn FROM seen_devs) AS seen_device
  FROM resc2 r),
pol2 AS (SELECT *, {_blend("blend_alpha")} AS pred_validated_blend FROM pol),
pol3 AS (
  SELECT *, {sanitize("cold_start_alpha * pred_validated_blend + (1 - cold_start_alpha) * pred_daily_model_rescaled")} AS pred_history_fallback
  FROM pol2),
pol4 AS (
  SELECT *, sum(pred_history_fallback) OVER (PARTITION BY split, eval_split, deviceSn, date) AS fb_day FROM pol3),
pol5 AS (
  SELECT *,
    cold_start_alpha <= 1e-6 AND fb_day <= 0.15 AS hit_broad,
    cold_start_alpha <= 1e-6 AND fb_day <= 0.06 AS hit_precision,
    cold_start_alpha <= 1e-6 AND fb_day <= 0.04 AS hit_low,
    cold_start_alpha <= 1e-6 AND fb_day > 0.04 AND fb_day <= 0.06 AS hit_mid
  FROM pol4),
pol6 AS (
  SELECT *,
    {sanitize("CASE WHEN hit_broad THEN pred_history_fallback * 0.7 ELSE pred_history_fallback END")} AS pred_low_output_guard,
    {sanitize("CASE WHEN hit_precision THEN pred_history_fallback * 0.4 ELSE pred_history_fallback END")} AS pred_precision_low_output_guard,
    {sanitize("CASE WHEN hit_low THEN pred_history_fallback * 0.5 WHEN hit_mid THEN pred_history_fallback * 0.55 ELSE pred_history_fallback END")} AS pred_piecewise_low_output_guard,
    {sanitize("CASE WHEN seen_device THEN pred_norm_calibrated ELSE pred_daily_model_rescaled END")} AS pred_seen_new_branch
  FROM pol5),
cand_long AS (
  UNPIVOT (SELECT split, eval_split, deviceSn, date, pvGenTotal, {", ".join(CANDIDATES)} FROM pol6)
  ON {", ".join(CANDIDATES)} INTO NAME candidate VALUE pred),
cand_point AS (
  SELECT candidate, eval_split, avg(abs(pvGenTotal - pred)) AS mae, sqrt(avg((pvGenTotal - pred) ^ 2)) AS rmse,
    avg(abs(pvGenTotal - pred) / greatest(abs(pvGenTotal), 1e-9)) AS mape
  FROM cand_long GROUP BY candidate, eval_split),
cand_day AS (
  SELECT candidate, eval_split, deviceSn, date, coalesce(sum(pvGenTotal), 0e0) AS y, coalesce(sum(pred), 0e0) AS p
  FROM cand_long WHERE date IS NOT NULL GROUP BY ALL),
cand_daily AS (
  SELECT candidate, eval_split, count(*) AS n_days, avg(abs(y - p)) AS daily_mae, sqrt(avg((y - p) ^ 2)) AS daily_rmse,
    avg(abs(y - p) / greatest(abs(y), 1e-9)) AS daily_mape
  FROM cand_day GROUP BY candidate, eval_split),
cand_names AS (
  SELECT * FROM (VALUES {", ".join(f"('{c}', {i}, '{e}')" for i, (c, e) in enumerate(zip(CANDIDATES, EXPERIMENTS)))})
  t(candidate, ordinal, experiment)),
cand_metrics AS (
  SELECT n.experiment, p.candidate, p.eval_split, p.mae, p.rmse, p.mape, d.daily_mae, d.daily_rmse, d.daily_mape, d.n_days
  FROM cand_point p JOIN cand_daily d ON p.candidate = d.candidate AND p.eval_split = d.eval_split
  JOIN cand_names n ON p.candidate = n.candidate),
cand_scores AS (
  SELECT n.candidate, n.ordinal,
    0.5 * max(daily_mape) FILTER (WHERE eval_split = 'valid_seen')
    + 0.5 * max(daily_mape) FILTER (WHERE eval_split = 'valid_unseen') AS combined
  FROM cand_metrics m JOIN cand_names n ON m.candidate = n.candidate GROUP BY n.candidate, n.ordinal),
best_cand AS (SELECT candidate FROM cand_scores WHERE isfinite(combined) ORDER BY round(combined, 9), ordinal LIMIT 1),
final_points AS (
  SELECT *, CASE (SELECT candidate FROM best_cand)
    {" ".join(f"WHEN '{c}' THEN {c}" for c in CANDIDATES)} END AS final_prediction,
    pred_precision_low_output_guard AS deployment_prediction
  FROM pol6)"""

GUARDS = """
guard_out AS (
  SELECT guard, eval_split, sum(CASE WHEN hit THEN 1 ELSE 0 END) AS guarded_point_rows,
    count(DISTINCT CASE WHEN hit THEN split || '|' || deviceSn || '|' || date END) AS guarded_days
  FROM (UNPIVOT (SELECT split, eval_split, deviceSn, date, hit_broad AS broad, hit_precision AS precision,
                   hit_low AS piecewise_low, hit_mid AS piecewise_mid, (hit_low OR hit_mid) AS piecewise_all FROM pol5)
        ON broad, precision, piecewise_low, piecewise_mid, piecewise_all INTO NAME guard VALUE hit)
  GROUP BY guard, eval_split)"""

METRICS_OUT = """
metrics_out AS (
  SELECT experiment, candidate, eval_split, mae, rmse, mape, daily_mae, daily_rmse, daily_mape, n_days FROM cand_metrics
  UNION ALL
  SELECT n.experiment, s.candidate, 'combined_validation', NULL, NULL, NULL, NULL, NULL, s.combined, NULL
  FROM cand_scores s JOIN cand_names n ON s.candidate = n.candidate WHERE s.combined IS NOT NULL)"""

DAILY_SINK = """
daily_sink AS (
  SELECT split, eval_split, deviceSn, date, coalesce(sum(pvGenTotal), 0e0) AS actual_daily,
    sum(final_prediction) AS final_pred_daily, sum(pred_irradiance_baseline) AS baseline_daily,
    sum(pred_raw_point) AS raw_point_daily, sum(pred_norm_point) AS norm_point_daily,
    sum(pred_norm_calibrated) AS calibrated_daily, sum(pred_validated_blend) AS validated_blend_daily,
    sum(pred_history_fallback) AS history_fallback_daily, sum(pred_low_output_guard) AS low_output_guard_daily,
    sum(pred_precision_low_output_guard) AS precision_low_output_guard_daily,
    sum(pred_piecewise_low_output_guard) AS piecewise_low_output_guard_daily,
    sum(pred_seen_new_branch) AS seen_new_branch_daily, sum(deployment_prediction) AS deployment_daily
  FROM final_points WHERE date IS NOT NULL GROUP BY split, eval_split, deviceSn, date)"""

BLEND_REPORT = """
r1_pts AS (
  SELECT a.a AS alpha_norm_calibrated, f.eval_split, f.deviceSn, f.date, f.pvGenTotal,
    greatest(a.a * f.pred_norm_calibrated + (1 - a.a) * f.pred_daily_model_rescaled, 0e0) AS p
  FROM final_points f, alphas a WHERE f.eval_split IN ('valid_seen', 'valid_unseen', 'test1', 'test2')),
r1_point AS (
  SELECT alpha_norm_calibrated, eval_split, avg(abs(pvGenTotal - p)) AS mae, sqrt(avg((pvGenTotal - p) ^ 2)) AS rmse,
    avg(abs(pvGenTotal - p) / greatest(abs(pvGenTotal), 1e-9)) AS mape
  FROM r1_pts GROUP BY ALL),
r1_day AS (
  SELECT alpha_norm_calibrated, eval_split, deviceSn, date, coalesce(sum(pvGenTotal), 0e0) AS y, coalesce(sum(p), 0e0) AS p
  FROM r1_pts WHERE date IS NOT NULL GROUP BY ALL),
r1_daily AS (
  SELECT alpha_norm_calibrated, eval_split, avg(abs(y - p)) AS daily_mae, sqrt(avg((y - p) ^ 2)) AS daily_rmse,
    avg(abs(y - p) / greatest(abs(y), 1e-9)) AS daily_mape
  FROM r1_day GROUP BY ALL),
r1 AS (
  SELECT p.*, d.daily_mae, d.daily_rmse, d.daily_mape
  FROM r1_point p JOIN r1_daily d ON p.alpha_norm_calibrated = d.alpha_norm_calibrated AND p.eval_split = d.eval_split),
r2a AS (
  SELECT alpha_norm_calibrated,
    max(daily_mape) FILTER (WHERE eval_split = 'test1') AS test1,
    max(daily_mape) FILTER (WHERE eval_split = 'test2') AS test2,
    max(daily_mape) FILTER (WHERE eval_split = 'valid_seen') AS valid_seen,
    max(daily_mape) FILTER (WHERE eval_split = 'valid_unseen') AS valid_unseen
  FROM r1 GROUP BY alpha_norm_calibrated),
r2 AS (SELECT *, 0.5 * (valid_seen + valid_unseen) AS combined_valid, 0.5 * (test1 + test2) AS combined_test FROM r2a),
r3 AS (
  (SELECT alpha_norm_calibrated, combined_valid AS score, 'validation' AS selected_on FROM r2
   ORDER BY combined_valid, alpha_norm_calibrated LIMIT 1)
  UNION ALL
  (SELECT alpha_norm_calibrated, combined_test AS score, 'test' AS selected_on FROM r2
   ORDER BY combined_test, alpha_norm_calibrated LIMIT 1)),
r4 AS (
  UNPIVOT (SELECT alpha_norm_calibrated, combined_valid, combined_test, test1, test2 FROM r2)
  ON combined_valid, combined_test, test1, test2 INTO NAME metric_group VALUE daily_mape)"""


def experiment_chain(*extra: str, strategy: str = "default", fold: int = 0, k: int = 0) -> str:
    return chain(*features_chain(strategy, fold, k), DAILY, EXPERIMENT, *extra)


def folds_chain(k: int) -> str:
    """The long rows of every fold, as CTE ``folds``; each fold is the whole chain with its own labels."""
    metrics = ", ".join(FOLD_METRICS)
    one = """SELECT * FROM ({chain}
SELECT {fold} AS fold, candidate, metric, value, (SELECT candidate FROM best_cand) AS best_prediction_column,
  (SELECT alpha FROM best_alpha) AS best_blend_alpha
FROM (SELECT 'selected' AS candidate, {metrics} FROM cand_table WHERE candidate = (SELECT candidate FROM best_cand)
      UNION ALL SELECT candidate, {metrics} FROM cand_table) UNPIVOT INCLUDE NULLS (value FOR metric IN ({metrics})))"""
    parts = [one.format(chain=experiment_chain(CANDIDATE_TABLE, fold=i, k=k), fold=i, metrics=metrics) for i in range(k)]
    return "WITH folds AS (" + "\nUNION ALL\n".join(parts) + ")"

REPORTS = """
sd_sums AS (
  SELECT split, deviceSn, date, coalesce(sum(pvGenTotal), 0e0) AS daily_sum FROM points
  WHERE date IS NOT NULL GROUP BY split, deviceSn, date),
hist_range AS (SELECT min(daily_sum) AS lo, max(daily_sum) AS hi FROM sd_sums),
hist AS (
  SELECT split, bin, count(*) AS days,
    (SELECT lo FROM hist_range) + (bin - 1) * ((SELECT hi - lo FROM hist_range) / 32) AS bin_lo,
    (SELECT lo FROM hist_range) + bin * ((SELECT hi - lo FROM hist_range) / 32) AS bin_hi
  FROM (SELECT split, CASE WHEN r.hi > r.lo THEN least(floor((daily_sum - r.lo) / (r.hi - r.lo) * 32) + 1, 32)
                           ELSE 1 END AS bin
        FROM sd_sums, hist_range r) GROUP BY split, bin),
loc_table AS (
  SELECT split, deviceSn, median(latitude) AS latitude, median(longitude) AS longitude FROM points GROUP BY split, deviceSn),
scatter0 AS (
  SELECT eval_split, deviceSn, date, coalesce(sum(pvGenTotal), 0e0) AS y_true_day, coalesce(sum(final_prediction), 0e0) AS y_pred_day
  FROM final_points WHERE date IS NOT NULL GROUP BY eval_split, deviceSn, date),
scatter AS (SELECT *, greatest((SELECT max(y_true_day) FROM scatter0), (SELECT max(y_pred_day) FROM scatter0)) * 1.05 AS axis_limit FROM scatter0),
final_by_split AS (SELECT * FROM cand_metrics WHERE candidate = (SELECT candidate FROM best_cand)),
deploy_by_split AS (SELECT * FROM cand_metrics WHERE candidate = 'pred_precision_low_output_guard'),
mape_rank AS (SELECT eval_split, daily_mape, row_number() OVER (ORDER BY daily_mape, eval_split) AS rank FROM final_by_split),
curve_days AS (
  SELECT eval_split, deviceSn, date, coalesce(sum(pvGenTotal), 0e0) AS total,
    CASE WHEN eval_split IN ('test1', 'test2', 'valid_seen', 'valid_unseen') THEN 0 ELSE 1 END AS pref
  FROM final_points WHERE date IS NOT NULL GROUP BY eval_split, deviceSn, date),
curve_pick AS (SELECT * FROM curve_days ORDER BY pref, total DESC, eval_split, deviceSn, date LIMIT 1),
curve AS (
  SELECT c.eval_split AS chosen_eval_split, f.deviceSn, f.date, f.us_timestamp, f.pvGenTotal, f.final_prediction AS prediction
  FROM final_points f JOIN curve_pick c ON f.deviceSn = c.deviceSn AND f.date = c.date),
cand_rank AS (
  SELECT candidate, combined, row_number() OVER (ORDER BY round(combined, 9), ordinal) AS rank FROM cand_scores WHERE isfinite(combined)),
cold_evidence AS (
  SELECT experiment, max(daily_mape) FILTER (WHERE eval_split = 'valid_unseen') AS valid_unseen,
    max(daily_mape) FILTER (WHERE eval_split = 'test2') AS test2
  FROM cand_metrics WHERE experiment IN ('E05_norm_plus_daily_calibration', 'E07_validated_blend',
    'E08_history_dynamic_fallback', 'E09_low_output_guard', 'E10_precision_low_output_guard',
    'E11_piecewise_low_output_guard', 'E02_lgbm_daily_rescaled') GROUP BY experiment),
deploy_cmp AS (
  SELECT f.eval_split, f.daily_mape AS final_daily_mape, d.daily_mape AS deployment_daily_mape
  FROM final_by_split f JOIN deploy_by_split d ON f.eval_split = d.eval_split
  WHERE f.eval_split IN ('valid_seen', 'valid_unseen', 'test1', 'test2')),
top5 AS (SELECT candidate, combined FROM cand_scores WHERE isfinite(combined) ORDER BY round(combined, 9), ordinal LIMIT 5),
worst AS (
  SELECT * FROM (
    SELECT eval_split, deviceSn, date, y_true_day, y_pred_day,
      abs(y_true_day - y_pred_day) / greatest(abs(y_true_day), 1e-9) AS ape,
      row_number() OVER (PARTITION BY eval_split ORDER BY abs(y_true_day - y_pred_day) / greatest(abs(y_true_day), 1e-9) DESC, deviceSn, date) AS rank
    FROM scatter0) WHERE rank <= 10),
gates AS (
  SELECT f.eval_split, f.daily_mape, g.max_daily_mape, f.daily_mape <= g.max_daily_mape AS passed
  FROM final_by_split f JOIN (VALUES ('valid_seen', 0.09), ('valid_unseen', 0.18), ('test1', 0.10)) g(eval_split, max_daily_mape)
  ON f.eval_split = g.eval_split),
keep_revert AS (
  SELECT candidate, combined, b AS baseline_combined, (b - combined) / b AS relative_gain,
    combined < b AS keep, (b - combined) / b >= 0.01 AS preferred
  FROM (SELECT *, (SELECT combined FROM cand_scores WHERE candidate = 'pred_irradiance_baseline') AS b
        FROM cand_scores WHERE isfinite(combined))),
leak_devices AS (
  SELECT p.deviceSn, p.told, coalesce(t.days, 0) AS days
  FROM (SELECT deviceSn, max(device_history_days) AS told FROM points GROUP BY deviceSn) p
  LEFT JOIN (SELECT deviceSn, count(DISTINCT date) AS days FROM points
             WHERE split = 'train' AND eval_split = 'train' AND date IS NOT NULL GROUP BY deviceSn) t ON p.deviceSn = t.deviceSn),
leak_slots AS (
  SELECT p.told, t.own FROM
    (SELECT deviceSn, slot_id, max(device_slot_mean) AS told FROM points WHERE slot_id IS NOT NULL GROUP BY deviceSn, slot_id) p
    JOIN (SELECT deviceSn, slot_id, avg(pvGenTotal) AS own FROM points WHERE split = 'train' AND eval_split = 'train'
          AND slot_id IS NOT NULL GROUP BY deviceSn, slot_id) t ON p.deviceSn = t.deviceSn AND p.slot_id = t.slot_id),
leak AS (
  SELECT count(*) FILTER (WHERE told <> days) AS devices_with_other_days,
    count(*) FILTER (WHERE told > 0 AND days = 0) AS history_devices_outside_training,
    (SELECT count(*) FROM leak_slots WHERE abs(told - own) > 1e-9 * greatest(abs(own), 1)) AS slots_with_other_rows,
    '' AS label_columns_in_features
  FROM leak_devices),
prof AS (
  SELECT s.deviceSn, s.slot_id, s.m / (x.mx + 1e-9) AS profile FROM
    (SELECT deviceSn, slot_id, avg(solar_proxy) AS m FROM points WHERE slot_id IS NOT NULL GROUP BY deviceSn, slot_id) s
    JOIN (SELECT deviceSn, max(m) AS mx FROM (SELECT deviceSn, slot_id, avg(solar_proxy) AS m FROM points
          WHERE slot_id IS NOT NULL GROUP BY deviceSn, slot_id) GROUP BY deviceSn) x ON s.deviceSn = x.deviceSn),
prof_norm AS (SELECT deviceSn, sqrt(sum(profile * profile)) AS nrm FROM prof GROUP BY deviceSn),
pair_cos AS (
  SELECT a.deviceSn AS d1, b.deviceSn AS d2, sum(a.profile * b.profile) AS dot
  FROM prof a JOIN prof b ON a.slot_id = b.slot_id AND a.deviceSn <> b.deviceSn GROUP BY a.deviceSn, b.deviceSn),
similarity AS (
  SELECT n1.deviceSn, coalesce(sum(CASE WHEN n1.nrm > 0 AND n2.nrm > 0 THEN p.dot / (n1.nrm * n2.nrm) ELSE 0e0 END), 0e0)
    / greatest((SELECT count(*) FROM prof_norm) - 1, 1) AS radiation_similarity_mean
  FROM prof_norm n1 LEFT JOIN pair_cos p ON p.d1 = n1.deviceSn LEFT JOIN prof_norm n2 ON p.d2 = n2.deviceSn
  GROUP BY n1.deviceSn),
wdays AS (
  SELECT deviceSn, date, avg(solar_proxy) AS solar_mean, max(solar_proxy) AS solar_max, avg(temperature_2m) AS temperature_2m,
    CASE WHEN max(solar_proxy) > 700 THEN 2 WHEN max(solar_proxy) > 300 AND max(solar_proxy) <= 700 THEN 1 ELSE 0 END AS weather_bin
  FROM points WHERE date IS NOT NULL GROUP BY deviceSn, date),
wrows AS (
  SELECT p.row_id, coalesce(w.weather_bin, 0) AS weather_bin FROM points p
  LEFT JOIN wdays w ON p.deviceSn = w.deviceSn AND p.date = w.date),
region_cap AS (
  SELECT c.deviceSn, c.region_lat_5, c.region_lon_5, r.region_daily_mean, r.region_train_devices FROM
    (SELECT deviceSn, floor(median(latitude) / 5e0) * 5 AS region_lat_5, floor(median(longitude) / 5e0) * 5 AS region_lon_5
     FROM points GROUP BY deviceSn) c
  LEFT JOIN (
    SELECT c2.region_lat_5, c2.region_lon_5, avg(d.m) AS region_daily_mean, count(*) AS region_train_devices
    FROM (SELECT deviceSn, floor(median(latitude) / 5e0) * 5 AS region_lat_5, floor(median(longitude) / 5e0) * 5 AS region_lon_5
          FROM points GROUP BY deviceSn) c2
    JOIN (SELECT deviceSn, avg(daily_sum) AS m FROM tr_daily GROUP BY deviceSn) d ON c2.deviceSn = d.deviceSn
    GROUP BY c2.region_lat_5, c2.region_lon_5) r
  ON c.region_lat_5 = r.region_lat_5 AND c.region_lon_5 = r.region_lon_5)"""


CANDIDATE_TABLE = """
cand_table AS (
  SELECT m.candidate,
    max(m.daily_mape) FILTER (WHERE m.eval_split = 'valid_seen') AS valid_seen_daily_mape,
    max(m.daily_mape) FILTER (WHERE m.eval_split = 'valid_unseen') AS valid_unseen_daily_mape,
    max(m.daily_mape) FILTER (WHERE m.eval_split = 'test1') AS test1_daily_mape,
    max(m.daily_mape) FILTER (WHERE m.eval_split = 'test2') AS test2_daily_mape,
    max(s.combined) AS combined_validation_daily_mape
  FROM cand_metrics m LEFT JOIN (SELECT * FROM cand_scores WHERE isfinite(combined)) s ON m.candidate = s.candidate
  GROUP BY m.candidate)"""

DIAGNOSTICS = """
adaptive AS (
  SELECT eval_split, avg(abs(y - p) / greatest(abs(y), 1e-9)) AS daily_mape,
    count(*) FILTER (WHERE hit) AS guarded_days, max(thr) AS threshold
  FROM (
    SELECT eval_split, y, thr, hit, CASE WHEN hit THEN fb * 0.7 ELSE fb END AS p FROM (
      SELECT *, coalesce(h <= 1e-6 AND fb <= thr, false) AS hit FROM (
        SELECT split, eval_split, deviceSn, date, coalesce(sum(pvGenTotal), 0e0) AS y,
          coalesce(sum(pred_history_fallback), 0e0) AS fb, max(cold_start_alpha) AS h,
          (SELECT quantile_cont(daily_target, 0.15) FROM daily WHERE eval_split = 'train') AS thr
        FROM pol3 WHERE date IS NOT NULL GROUP BY split, eval_split, deviceSn, date)))
  GROUP BY eval_split),
b4_cells AS (
  SELECT deviceSn, floor(median(latitude) / 5e0) * 5 AS cell_lat, floor(median(longitude) / 5e0) * 5 AS cell_lon
  FROM points GROUP BY deviceSn),
b4_days AS (
  SELECT d.*, c.cell_lat, c.cell_lon FROM (
    SELECT split, eval_split, deviceSn, date, coalesce(sum(pvGenTotal), 0e0) AS y,
      coalesce(sum(pred_validated_blend), 0e0) AS p
    FROM pol2 WHERE date IS NOT NULL GROUP BY split, eval_split, deviceSn, date) d
  LEFT JOIN b4_cells c ON d.deviceSn = c.deviceSn),
b4_ratio AS (
  SELECT cell_lat, cell_lon, CASE WHEN sum(p) > 0 THEN sum(y) / sum(p) END AS f
  FROM b4_days WHERE eval_split IN ('valid_seen', 'valid_unseen') GROUP BY cell_lat, cell_lon),
grouped_cal AS (
  SELECT d.eval_split, avg(abs(d.y - d.p) / greatest(abs(d.y), 1e-9)) AS daily_mape_before,
    avg(abs(d.y - d.p * coalesce(r.f, 1e0)) / greatest(abs(d.y), 1e-9)) AS daily_mape_after
  FROM b4_days d LEFT JOIN b4_ratio r ON d.cell_lat IS NOT DISTINCT FROM r.cell_lat AND d.cell_lon IS NOT DISTINCT FROM r.cell_lon
  GROUP BY d.eval_split),
b6_off AS (
  SELECT slot_id, quantile_cont(pvGenTotal - final_prediction, 0.1) AS r_lo,
    quantile_cont(pvGenTotal - final_prediction, 0.9) AS r_hi
  FROM final_points WHERE eval_split IN ('valid_seen', 'valid_unseen') AND slot_id IS NOT NULL GROUP BY slot_id),
intervals AS (
  SELECT eval_split,
    avg(CASE WHEN pvGenTotal >= final_prediction + o.r_lo - 1e-12 AND pvGenTotal <= final_prediction + o.r_hi + 1e-12 THEN 1e0 ELSE 0e0 END) AS coverage,
    avg(o.r_hi - o.r_lo) AS mean_width
  FROM final_points f LEFT JOIN b6_off o ON f.slot_id = o.slot_id GROUP BY eval_split),
resid_buckets AS (
  SELECT region_lat_5, region_lon_5, floor(cloud_cover_H / 20e0) * 20 AS cloud_band, count(*) AS rows,
    avg(pvGenTotal - final_prediction) AS mean_residual, avg(abs(pvGenTotal - final_prediction)) AS mean_abs_residual
  FROM final_points GROUP BY ALL)"""


SUPPLIER_POINTS = r"""
li AS (
  SELECT *, CAST(l_shipdate AS TIMESTAMP) + to_hours(CAST(l_orderkey % 24 AS INTEGER))
    + to_minutes(CAST(l_linenumber * 15 % 60 AS INTEGER)) AS ts
  FROM lineitem),
pv_points AS (
  SELECT l_orderkey * 8 + l_linenumber AS row_id, ts AS us_timestamp, strftime(ts, '%Y-%m-%d') AS date,
    'EP' || lpad(CAST(l_suppkey % 1000 AS VARCHAR), 7, '0') || 'S' || lpad(CAST(l_suppkey AS VARCHAR), 6, '0') AS deviceSn,
    CASE WHEN l_returnflag = 'R' THEN 'test1' WHEN l_suppkey % 10 = 9 THEN 'test2' ELSE 'train' END AS split,
    l_quantity / 50e0 AS pvGenTotal,
    20e0 + (l_suppkey * 37 % 3000) / 100e0 AS latitude,
    -70e0 - (l_suppkey * 53 % 5000) / 100e0 AS longitude,
    CAST(60 - 6 * abs(hour(ts) + minute(ts) / 60e0 - 12) AS DOUBLE) AS altitude,
    CAST(90 - (60 - 6 * abs(hour(ts) + minute(ts) / 60e0 - 12)) AS DOUBLE) AS zenith_angle,
    15e0 * hour(ts) AS azimuth,
    CASE WHEN hour(ts) BETWEEN 3 AND 20 THEN 1e0 ELSE 0e0 END AS is_day,
    CAST(l_orderkey * 7 % 900 AS DOUBLE) AS global_tilted_irradiance_instant,
    CAST(NULL AS DOUBLE) AS shortwave_radiation,
    CAST(l_orderkey * 13 % 130 - 10 AS DOUBLE) AS cloud_cover_H,
    l_orderkey % 25 + 5e-1 AS temperature_2m,
    CAST(NULL AS DOUBLE) AS rain
  FROM li)"""


def supplier_chain(*extra: str) -> str:
    return chain(SUPPLIER_POINTS, labels_sql(), SCALAR_FEATURES, HISTORY, DAILY, *extra)


CAPACITY = """
own AS (SELECT deviceSn, avg(daily_sum) AS m FROM tr_daily GROUP BY deviceSn),
idw AS (
  SELECT deviceSn, sum(t_mean / greatest(distance, 0.1e0)) / sum(1e0 / greatest(distance, 0.1e0)) AS neighbour_daily_mean
  FROM nn_ranked WHERE r <= 5 AND distance IS NOT NULL AND t_mean IS NOT NULL GROUP BY deviceSn),
capacities AS (
  SELECT c.*, i.neighbour_daily_mean, coalesce(o.m, i.neighbour_daily_mean, c.region_daily_mean, (SELECT avg(m) FROM own)) AS capacity,
    CASE WHEN o.m IS NOT NULL THEN 'own' WHEN i.neighbour_daily_mean IS NOT NULL THEN 'neighbours'
         WHEN c.region_daily_mean IS NOT NULL THEN 'region' ELSE 'all' END AS capacity_source
  FROM region_cap c LEFT JOIN own o ON c.deviceSn = o.deviceSn LEFT JOIN idw i ON c.deviceSn = i.deviceSn)"""

_LEVELS = ("region", "family", "capacity", "risk")

CALIBRATION = f"""
edges AS (SELECT quantile_cont(nn_3_daily_mean, 0.25) AS q1, quantile_cont(nn_3_daily_mean, 0.5) AS q2, quantile_cont(nn_3_daily_mean, 0.75) AS q3 FROM nn),
lv_days AS (
  SELECT b.eval_split, b.y, b.p,
    CAST(CAST(d.region_lat_5 AS BIGINT) AS VARCHAR) || '|' || CAST(CAST(d.region_lon_5 AS BIGINT) AS VARCHAR) AS region,
    coalesce(CAST(CAST(d.device_family_code AS BIGINT) AS VARCHAR), 'none') AS family,
    CASE WHEN d.nn_3_daily_mean IS NULL THEN 'none' WHEN d.nn_3_daily_mean > q3 THEN 'q4' WHEN d.nn_3_daily_mean > q2 THEN 'q3'
         WHEN d.nn_3_daily_mean > q1 THEN 'q2' ELSE 'q1' END AS capacity,
    CASE WHEN b.p < 0.05 THEN 'very low' WHEN b.p < 0.1 THEN 'low' ELSE 'normal' END AS risk
  FROM b4_days b LEFT JOIN daily d ON b.split = d.split AND b.deviceSn = d.deviceSn AND b.date = d.date, edges),
lv_val AS (SELECT * FROM lv_days WHERE eval_split IN ('valid_seen', 'valid_unseen')),
lv_sums AS (
  {" UNION ALL ".join(f"SELECT '{c}' AS level, {c} AS key, count(*) AS days, sum(y) AS y, sum(p) AS p FROM lv_val GROUP BY {c}" for c in _LEVELS)}
  UNION ALL SELECT 'all', '', count(*), sum(y), sum(p) FROM lv_val),
lv_ratio AS (SELECT level, key, days, CASE WHEN p > 0 THEN y / p END AS ratio FROM lv_sums),
lv_all AS (SELECT coalesce(max(ratio), 1e0) AS f FROM lv_ratio WHERE level = 'all'),
cal_groups AS (
  SELECT level, key, days, ratio, CASE WHEN level = 'all' THEN f ELSE coalesce((days * ratio + 10e0 * f) / (days + 10e0), f) END AS factor
  FROM lv_ratio, lv_all),
lv_used AS (
  SELECT d.*, coalesce({", ".join(f"g_{c}.factor" for c in _LEVELS)}, f) AS factor,
    CASE {" ".join(f"WHEN g_{c}.factor IS NOT NULL THEN '{c}'" for c in _LEVELS)} ELSE 'all' END AS used
  FROM lv_days d {" ".join(f"LEFT JOIN (SELECT * FROM cal_groups WHERE level = '{c}' AND days >= 10 AND ratio IS NOT NULL) g_{c} ON d.{c} = g_{c}.key" for c in _LEVELS)}, lv_all),
multi_cal AS (
  SELECT eval_split, avg(abs(y - p) / greatest(abs(y), 1e-9)) AS daily_mape_before,
    avg(abs(y - p * factor) / greatest(abs(y), 1e-9)) AS daily_mape_after,
    {", ".join(f"count(*) FILTER (WHERE used = '{c}') AS days_by_{c}" for c in (*_LEVELS, "all"))}
  FROM lv_used GROUP BY eval_split)"""


def stacking_sql(rows: str) -> str:
    """Gram matrix and X'y of the median-filled, standardised daily predictions over the days ``rows``."""
    cols = ", ".join(STACK_COLS)
    return f"""
st_rows AS (SELECT row_number() OVER () AS id, actual_daily, {cols} FROM daily_sink WHERE {rows}),
st_long AS (SELECT * FROM st_rows UNPIVOT INCLUDE NULLS (v FOR name IN ({cols}))),
st_med AS (SELECT name, coalesce(median(v), 0e0) AS m FROM st_long GROUP BY name),
st_fill AS (SELECT l.id, l.actual_daily, l.name, coalesce(l.v, s.m) AS v FROM st_long l JOIN st_med s ON l.name = s.name),
st_stat AS (SELECT name, avg(v) AS mu, stddev_pop(v) AS sd FROM st_fill GROUP BY name),
st_z AS (
  SELECT f.id, f.actual_daily - (SELECT avg(actual_daily) FROM st_rows) AS y, f.name,
    (f.v - s.mu) / CASE WHEN coalesce(s.sd, 0e0) = 0 THEN 1e0 ELSE s.sd END AS z
  FROM st_fill f JOIN st_stat s ON f.name = s.name),
st_out AS (
  SELECT a.name AS a, b.name AS b, sum(a.z * b.z) AS value, NULL AS optimal FROM st_z a JOIN st_z b ON a.id = b.id AND a.name <= b.name GROUP BY a.name, b.name
  UNION ALL SELECT name, 'target', sum(z * y), 'true' FROM st_z GROUP BY name)"""


POINT_FEATURES = """latitude longitude altitude zenith_angle azimuth is_day global_tilted_irradiance_instant shortwave_radiation
  cloud_cover_H temperature_2m rain empty_weather hour minute slot_id day_of_year month weekday is_weekend sin_hour cos_hour
  sin_slot cos_slot sin_doy cos_doy altitude_pos elevation_weight zenith_cos azimuth_sin azimuth_cos radiation_proxy solar_proxy
  radiation_cloud_adjusted radiation_x_elevation is_solar_available lat_round_1 lon_round_1 region_lat_5 region_lon_5
  region_lat_10 region_lon_10 device_family_code device_daily_mean device_daily_median device_daily_p90 device_daily_max
  device_history_days device_slot_mean device_slot_p90 global_slot_mean global_slot_p90 nn_1_distance_km nn_3_daily_mean
  nn_3_daily_p90 nn_5_daily_mean nn_5_daily_p90""".split()
DAILY_FEATURES = """rows_in_day solar_proxy_sum solar_proxy_max radiation_proxy_sum radiation_proxy_max elevation_weight_sum
  elevation_weight_max is_solar_available_mean latitude longitude region_lat_5 region_lon_5 region_lat_10 region_lon_10
  device_family_code device_daily_mean device_daily_p90 device_history_days nn_3_daily_mean nn_3_daily_p90 nn_5_daily_mean
  nn_1_distance_km temperature_2m_mean temperature_2m_max rain_mean rain_max rain_sum cloud_cover_H_mean cloud_cover_H_max""".split()


def feature_list_sql() -> str:
    parts = [f"SELECT '{grain}' AS grain, '{c}' AS feature, count({c}) AS train_values, count({c}) > 0 AS used FROM {table} WHERE {rows}"
             for grain, table, rows, cols in (("point", "points", "split = 'train' AND eval_split = 'train'", POINT_FEATURES),
                                              ("daily", "daily", "eval_split = 'train'", DAILY_FEATURES)) for c in cols]
    return "feature_list AS (" + " UNION ALL ".join(parts) + ")"


DRIFT_LOOKUP = """
drift_rows AS (
  SELECT n.position, s.eval_split, s.devices, s.train_device_overlap_ratio, s.daily_target_mean, s.low_load_share_lt_0_05, s.low_load_share_lt_0_10
  FROM summary s JOIN (VALUES ('train', 1), ('valid_seen', 2), ('valid_unseen', 3), ('test1', 4), ('test2', 5)) n(eval_split, position)
  ON s.eval_split = n.eval_split)"""
