"""M4: irradiance baseline without a model.

Daily total per device = its mean training daily sum, else the median of its
neighbour daily mean, else the global mean training daily sum. The total is
spread over the device-day by solar_proxy share, else elevation share, else
evenly. Grouping is by (device, date) without split, as published.

Shares, training sums and the neighbour value are one aggregate at device-day
grain, written once; device totals are rolled up from it, and the points meet total and
shares in one join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pvlake.functions.columns import sanitize
from pvlake.operators.carried import settle
from pvlake.session import materialize

D = ["deviceSn", "date"]


def irradiance_baseline(points: DataFrame, out: str = "pred_irradiance_baseline",
                        approx: bool = False) -> DataFrame:
    train = F.col("eval_split") == "train"
    days = points.dropna(subset=D).groupBy(*D).agg(
        F.sum("solar_proxy").alias("_sw"),
        F.sum("elevation_weight").alias("_ew"),
        F.count(F.lit(1)).alias("_n"),
        F.sum(F.when(train, F.col("pvGenTotal"))).alias("_sum"),
        F.count(F.when(train, 1)).alias("_train"),
        F.min("nn_3_daily_mean").alias("_lo_nn_3_daily_mean"),
        F.max("nn_3_daily_mean").alias("_hi_nn_3_daily_mean"),
    )
    days = materialize(days, "baseline_days")
    day_sum = F.when(F.col("_train") > 0, F.coalesce(F.col("_sum"), F.lit(0.0)))
    overall = days.agg(F.avg(day_sum)).scalar()
    devices = materialize(days.groupBy("deviceSn").agg(
        F.avg(day_sum).alias("_own"),
        F.min("_lo_nn_3_daily_mean").alias("_lo_nn_3_daily_mean"),
        F.max("_hi_nn_3_daily_mean").alias("_hi_nn_3_daily_mean")), "baseline_devices")
    devices = settle(devices, points, ["deviceSn"], {"_nn": "nn_3_daily_mean"}, approx)
    totals = devices.select("deviceSn", F.coalesce("_own", "_nn", overall).alias("_total"))
    days = days.join(totals, "deviceSn").select(*D, "_sw", "_ew", "_n", "_total")
    pred = (
        F.when(F.col("_sw") > 0, F.col("_total") * F.col("solar_proxy") / F.col("_sw"))
        .when(F.col("_ew") > 0, F.col("_total") * F.col("elevation_weight") / F.col("_ew"))
        .otherwise(F.col("_total") / F.col("_n"))
    )
    return points.join(days, D, "left").withColumn(out, sanitize(pred)).drop("_sw", "_ew", "_n", "_total")
