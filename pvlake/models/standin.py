"""Deterministic stand-in predictors.

They let the whole policy chain (reconcile, blend, fallback, guards,
selection, metrics, sinks) run and be checked exactly against SQL without a
model fit: point predictions come from history features, daily predictions
from the device-day table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pvlake.functions.columns import sanitize

SD = ["split", "deviceSn", "date"]


class StandInPredictors:
    name = "standin"
    #: Features that these predictions, the baseline and the policies read.
    columns = ("row_id", "split", "eval_split", "deviceSn", "date", "us_timestamp", "pvGenTotal", "slot_id", "solar_proxy", "elevation_weight",
               "is_solar_available", "region_lat_5", "region_lon_5", "cloud_cover_H", "device_daily_mean", "device_daily_p90",
               "device_history_days", "device_slot_mean", "global_slot_mean", "nn_3_daily_mean")

    def point(self, points: DataFrame, feat: DataFrame) -> DataFrame:
        """raw point model := global slot mean; normalised model := device slot mean (both sanitized)."""
        return points.withColumns({
            "pred_raw_point": sanitize(F.col("global_slot_mean")),
            "pred_norm_point": sanitize(F.col("device_slot_mean")),
        })

    def daily(self, daily: DataFrame, sd: DataFrame) -> DataFrame:
        """daily model := device daily mean; calibrated daily := device daily p90 (clipped at 0)."""
        return daily.select(
            *SD,
            F.greatest(F.coalesce(F.col("device_daily_mean"), F.lit(0.0)), F.lit(0.0)).alias("pred_daily_model"),
            F.greatest(F.coalesce(F.col("device_daily_p90"), F.lit(0.0)), F.lit(0.0)).alias("pred_day_calibrated"),
        )
