"""Distribution-shift diagnosis: split summary (R5) and drift vs train."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pvlake import config as C
from pvlake.functions.columns import quantile
from pvlake.operators.quantiles import exact_quantiles

COMPARED_SPLITS = ("valid_seen", "valid_unseen", "test1", "test2")


def _null_safe_key(*cols: str):
    return F.concat_ws("_", *[F.coalesce(F.col(c).cast("string"), F.lit("nan")) for c in cols])


def split_summary(point: DataFrame, daily: DataFrame, approx: bool = False,
                  group_bound: int | None = None) -> DataFrame:
    """18 statistics per eval_split (daily table + point table, joined on eval_split)."""
    train_devices = point.filter(F.col("eval_split") == "train").select("deviceSn").distinct().withColumn(
        "_is_train_dev", F.lit(1))
    lo, hi = C.LOW_LOAD_CUTS
    y = F.col("daily_target")
    day_dev = daily.select("eval_split", "deviceSn").distinct().join(train_devices, "deviceSn", "left")
    devices = day_dev.groupBy("eval_split").agg(
        F.count(F.lit(1)).alias("devices"),
        (F.count("_is_train_dev") / F.greatest(F.count(F.lit(1)), F.lit(1))).alias("train_device_overlap_ratio"),
    )
    continuous = {  # day sums: many distinct values per split, so hot-group-safe when exact
        "daily_target": {"daily_target_median": 0.5, "daily_target_p10": 0.10, "daily_target_p90": 0.90},
        "solar_proxy_sum": {"solar_proxy_sum_median": 0.5},
        "radiation_proxy_sum": {"radiation_proxy_sum_median": 0.5},
    }
    approx_q = [quantile(c, p, True).alias(n) for c, qs in continuous.items() for n, p in qs.items()] \
        if approx else []
    per_day = daily.groupBy("eval_split").agg(
        F.count(F.lit(1)).alias("days"),
        F.min("date").alias("date_min"),
        F.max("date").alias("date_max"),
        F.avg(y).alias("daily_target_mean"),
        F.stddev_samp(y).alias("daily_target_std"),
        F.avg(F.when(y < lo, 1.0).otherwise(0.0)).alias("low_load_share_lt_0_05"),
        F.avg(F.when(y < hi, 1.0).otherwise(0.0)).alias("low_load_share_lt_0_10"),
        # device-level columns: few distinct values, plain exact percentile
        quantile("latitude", 0.5, approx).alias("latitude_median"),
        quantile("longitude", 0.5, approx).alias("longitude_median"),
        F.countDistinct(_null_safe_key("region_lat_5", "region_lon_5")).alias("region5_count"),
        *approx_q,
    )
    if not approx:
        for c, qs in continuous.items():
            per_day = per_day.join(exact_quantiles(daily, ["eval_split"], c, qs, group_bound=group_bound),
                                   "eval_split", "left")
    per_point = point.groupBy("eval_split").agg(
        F.avg(F.when(F.col("pvGenTotal") > 0, 1.0).otherwise(0.0)).alias("nonzero_row_ratio"))
    return per_day.join(devices, "eval_split").join(per_point, "eval_split", "left")


def drift_table(summary: DataFrame) -> DataFrame:
    """One row per metric; train value, each split's value and its ratio to train."""
    long = summary.select(
        "eval_split",
        *[F.col(m).cast("double").alias(m) for m in C.DRIFT_METRICS],
    ).unpivot("eval_split", list(C.DRIFT_METRICS), "metric", "value")
    wide = long.groupBy("metric").pivot("eval_split", ["train", *COMPARED_SPLITS]).agg(F.first("value"))
    train = F.col("train")
    ratios = {
        f"{s}_vs_train_ratio": F.when(F.abs(train) > 1e-12, F.col(s) / train)
        for s in COMPARED_SPLITS
    }
    return wide.withColumns(ratios)
