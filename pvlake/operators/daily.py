"""Device-day rollup (A7-A10) and dataset profile.

One ``groupBy(split, deviceSn, date)`` with every aggregate in the same pass
(map-side partial aggregation, one shuffle of partial rows). ``eval_split``
is functionally determined by the key, so it is carried with ``first`` in the
same aggregate instead of a join back. Columns that are constant within a day are
carried, not ranked (``carried``): percentiles run only for days where a value varies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pvlake import config as C
from pvlake.functions.columns import quantile
from pvlake.operators.carried import extents, settle
from pvlake.operators.quantiles import exact_quantiles
from pvlake.session import materialize, sent_if_small

SD = ["split", "deviceSn", "date"]

def _agg(kind: str, col: str):
    c = F.col(col)
    if kind == "sum":
        return F.coalesce(F.sum(c), F.lit(0.0))
    if kind == "size":
        return F.count(F.lit(1))
    return F.max(c) if kind == "max" else F.avg(c)


def daily_aggregates(point_df: DataFrame) -> tuple[list, dict[str, str]]:
    """(aggregates of a day, its columns by median: output to input)."""
    cols = set(point_df.columns)
    medians = {out: src for out, src, kind in C.DAILY_AGGS if src in cols and kind == "median"}
    exprs = [_agg(kind, src).alias(out) for out, src, kind in C.DAILY_AGGS if src in cols and kind != "median"]
    for col in C.OPTIONAL_WEATHER:
        if col in cols:
            exprs.append(F.avg(col).alias(f"{col}_mean"))
            exprs.append(F.max(col).alias(f"{col}_max"))
            if col in C.SUMMED_WEATHER:
                exprs.append(F.coalesce(F.sum(col), F.lit(0.0)).alias(f"{col}_sum"))
    if "eval_split" in cols:
        exprs.append(F.first("eval_split", ignorenulls=True).alias("eval_split"))
    return exprs, medians


def make_daily_frame(point_df: DataFrame, approx: bool = False, by_device: DataFrame | None = None) -> DataFrame:
    """``by_device``: a written table of columns that all points of a device share. They are joined to its days then, where
    ``point_df`` doesn't hold them."""
    rows = point_df.dropna(subset=SD)
    exprs, medians = daily_aggregates(point_df)
    days = materialize(rows.groupBy(*SD).agg(*exprs, *extents(list(medians.values()))), "day_grain")
    daily = settle(days, rows, SD, medians, approx)
    columns = set(point_df.columns)
    if by_device is not None:
        shared = {out: src for out, src, kind in C.DAILY_AGGS if kind == "median" and src in by_device.columns and src not in columns}
        columns |= set(shared.values())
        daily = daily.join(sent_if_small(by_device.select("deviceSn", *[F.col(src).alias(out) for out, src in shared.items()])), "deviceSn", "left")
    order = [out for out, src, _ in C.DAILY_AGGS if src in columns]
    daily = daily.select(*SD, *order, *[c for c in daily.columns if c not in {*SD, *order}])
    daily = daily.withColumn("rows_in_day", F.col("rows_in_day").cast("bigint"))
    return daily.withColumns({
        "daily_target_log1p": F.log1p("daily_target"),
        "target_per_solar": F.col("daily_target") / (F.col("solar_proxy_sum") + C.FEATURE_EPS),
    })


def describe_dataset(point_df: DataFrame, approx: bool = False) -> DataFrame:
    """Per source split profile of rows and device-day sums."""
    per_point = point_df.groupBy("split").agg(
        F.countDistinct("deviceSn").alias("devices"),
        F.count(F.lit(1)).alias("rows"),
        F.min("date").alias("date_min"),
        F.max("date").alias("date_max"),
        F.avg(F.when(F.col("pvGenTotal") > 0, 1.0).otherwise(0.0)).alias("nonzero_row_ratio"),
    )
    day = point_df.dropna(subset=SD).groupBy(*SD).agg(F.coalesce(F.sum("pvGenTotal"), F.lit(0.0)).alias("s"))
    per_day = day.groupBy("split").agg(
        F.count(F.lit(1)).alias("files"),
        F.avg("s").alias("daily_sum_mean"),
        F.min("s").alias("daily_sum_min"),
        F.max("s").alias("daily_sum_max"),
    )
    median = day.groupBy("split").agg(quantile("s", 0.5, True).alias("daily_sum_median")) if approx \
        else exact_quantiles(day, ["split"], "s", {"daily_sum_median": 0.5})
    return per_point.join(per_day, "split", "left").join(median, "split", "left")
