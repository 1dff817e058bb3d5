"""Report tables behind the figures and summaries (R12-R19) and the documented
checks (B2, B8, B9, B10). Only the data is produced; drawing is out of scope.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pvlake import config as C
from pvlake.functions.columns import quantile
from pvlake.operators.metrics import ape
from pvlake.operators.splits import train_mask

SD = ["split", "deviceSn", "date"]
BINS = 32


def daily_energy_histogram(daily: DataFrame, bins: int = BINS) -> DataFrame:
    """Device-day sums (``daily_target``) by split in ``bins`` equal-width bins shared by all splits."""
    day = daily.select("split", F.col("daily_target").alias("daily_sum"))
    span = day.agg(F.struct(F.min("daily_sum").alias("lo"), F.max("daily_sum").alias("hi")).alias("r")).scalar()
    lo, hi = span.getField("lo"), span.getField("hi")
    width = (hi - lo) / bins
    b = F.when(hi > lo, F.least(F.floor((F.col("daily_sum") - lo) / (hi - lo) * bins) + 1, F.lit(bins))).otherwise(1)
    counts = day.groupBy("split", b.cast("bigint").alias("bin")).agg(F.count(F.lit(1)).alias("days"))
    return counts.withColumns({
        "bin_lo": lo + (F.col("bin") - 1) * width,
        "bin_hi": lo + F.col("bin") * width,
    })


def device_location_table(points: DataFrame, approx: bool = False) -> DataFrame:
    """Median location per (split, device)."""
    return points.groupBy("split", "deviceSn").agg(
        quantile("latitude", 0.5, approx).alias("latitude"), quantile("longitude", 0.5, approx).alias("longitude"))


def device_day_pairs(daily_predictions: DataFrame, pred: str) -> DataFrame:
    """Actual and predicted sum per (eval_split, device, date), from the daily sink's rows."""
    return daily_predictions.groupBy("eval_split", "deviceSn", "date").agg(
        F.coalesce(F.sum("actual_daily"), F.lit(0.0)).alias("y_true_day"),
        F.coalesce(F.sum(pred), F.lit(0.0)).alias("y_pred_day"))


def daily_scatter(daily_predictions: DataFrame, pred: str) -> DataFrame:
    """Actual vs predicted per (eval_split, device, date) and the shared axis limit."""
    day = device_day_pairs(daily_predictions, pred)
    lim = day.agg(F.greatest(F.max("y_true_day"), F.max("y_pred_day")) * 1.05).scalar()
    return day.withColumn("axis_limit", lim)


def mape_ranking(metrics_by_split: DataFrame) -> DataFrame:
    """Splits in daily-MAPE order (a handful of rows)."""
    w = Window.orderBy(F.col("daily_mape"), F.col("eval_split"))
    return metrics_by_split.select("eval_split", "daily_mape", F.row_number().over(w).alias("rank"))


def example_curve(points: DataFrame, pred: str) -> DataFrame:
    """Points, in time order, of the largest-output evaluation device-day (any day if none)."""
    keys = ["eval_split", "deviceSn", "date"]
    days = points.dropna(subset=keys).groupBy(*keys).agg(F.coalesce(F.sum("pvGenTotal"), F.lit(0.0)).alias("total"))
    is_eval = F.col("eval_split").isin("test1", "test2", "valid_seen", "valid_unseen")
    ranked = days.withColumn("_pref", F.when(is_eval, 0).otherwise(1))
    chosen = ranked.orderBy("_pref", F.col("total").desc(), *keys).limit(1).select(
        "deviceSn", "date", F.col("eval_split").alias("chosen_eval_split"))
    return points.join(F.broadcast(chosen), ["deviceSn", "date"]).select(
        "chosen_eval_split", "deviceSn", "date", "us_timestamp", "pvGenTotal", F.col(pred).alias("prediction"))


def candidate_ranking(candidate_scores: DataFrame) -> DataFrame:
    """Candidates ordered by combined validation score (11 rows)."""
    w = Window.orderBy(F.round("combined", 9), F.col("ordinal"))
    return candidate_scores.select("candidate", "combined", F.row_number().over(w).alias("rank"))


def cold_start_evidence(metrics_long: DataFrame) -> DataFrame:
    """Daily MAPE on valid_unseen and test2 for the cold-start experiments."""
    sub = metrics_long.filter(F.col("experiment").isin(*C.COLD_START_EXPERIMENTS)
                              & F.col("eval_split").isin("valid_unseen", "test2"))
    return sub.groupBy("experiment").pivot("eval_split", ["valid_unseen", "test2"]).agg(F.first("daily_mape"))


def deployment_comparison(final_by_split: DataFrame, deployment_by_split: DataFrame) -> DataFrame:
    """Final vs deployment daily MAPE per evaluation split."""
    keep = F.col("eval_split").isin("valid_seen", "valid_unseen", "test1", "test2")
    f = final_by_split.filter(keep).select("eval_split", F.col("daily_mape").alias("final_daily_mape"))
    d = deployment_by_split.filter(keep).select("eval_split", F.col("daily_mape").alias("deployment_daily_mape"))
    return f.join(d, "eval_split", "full")


def top_candidates(candidate_scores: DataFrame, n: int = 5) -> DataFrame:
    """The n best candidates (a top-k report, so the limit is the feature)."""
    return candidate_scores.orderBy(F.round("combined", 9), "ordinal").limit(n).select("candidate", "combined")


def worst_days(daily_predictions: DataFrame, pred: str, k: int = 10) -> DataFrame:
    """B2: the k highest-APE device-days per eval_split. The rank filter lets Spark
    keep only k rows per split in each task before the shuffle (WindowGroupLimit)."""
    day = device_day_pairs(daily_predictions, pred)
    day = day.withColumn("ape", ape(F.col("y_true_day"), F.col("y_pred_day")))
    w = Window.partitionBy("eval_split").orderBy(F.col("ape").desc(), "deviceSn", "date")
    return day.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def acceptance_gates(final_by_split: DataFrame) -> DataFrame:
    """Pass flags against the published daily-MAPE gates (3-row threshold table)."""
    spark = final_by_split.sparkSession
    gates = spark.createDataFrame(list(C.ACCEPTANCE_GATES), "eval_split string, max_daily_mape double")
    return final_by_split.select("eval_split", "daily_mape").join(F.broadcast(gates), "eval_split").withColumn(
        "passed", F.col("daily_mape") <= F.col("max_daily_mape"))


def keep_or_revert(candidate_scores: DataFrame, baseline: str = "pred_irradiance_baseline",
                   min_gain: float = 0.01) -> DataFrame:
    """A candidate is kept when it beats the baseline score; preferred when by >= 1 %."""
    base = candidate_scores.agg(
        F.first(F.when(F.col("candidate") == baseline, F.col("combined")), ignorenulls=True)).scalar()
    gain = (F.col("_b") - F.col("combined")) / F.col("_b")
    return candidate_scores.withColumn("_b", base).select(
        "candidate", "combined", F.col("_b").alias("baseline_combined"), gain.alias("relative_gain"),
        (F.col("combined") < F.col("_b")).alias("keep"), (gain >= min_gain).alias("preferred"))


def leakage_audit(features: DataFrame, model_columns: list[str]) -> DataFrame:
    """One row about a feature table as it stands. Devices whose history counts other days than their
    training days, devices with history but no training day, (device, slot) pairs whose mean is not that of
    their training rows, and label columns among the model inputs. All must be 0 or empty."""
    trained = features.filter(train_mask())
    days = trained.dropna(subset=["date"]).groupBy("deviceSn").agg(F.countDistinct("date").alias("_days"))
    told = features.groupBy("deviceSn").agg(F.max("device_history_days").alias("_told"))
    own = F.coalesce(F.col("_days"), F.lit(0))
    devices = told.join(days, "deviceSn", "left").agg(
        F.count(F.when(F.col("_told") != own, 1)).alias("devices_with_other_days"),
        F.count(F.when((F.col("_told") > 0) & (own == 0), 1)).alias("history_devices_outside_training"))
    pair = ["deviceSn", "slot_id"]
    means = trained.dropna(subset=pair).groupBy(*pair).agg(F.avg("pvGenTotal").alias("_own"))
    told = features.dropna(subset=pair).groupBy(*pair).agg(F.max("device_slot_mean").alias("_told"))
    off = F.abs(F.col("_told") - F.col("_own")) > 1e-9 * F.greatest(F.abs(F.col("_own")), F.lit(1.0))
    slots = told.join(means, pair).agg(F.count(F.when(off, 1)).alias("n")).scalar()
    leaked = sorted(set(model_columns) & set(C.LABEL_COLUMNS))
    return devices.withColumns({"slots_with_other_rows": slots, "label_columns_in_features": F.lit(",".join(leaked))})
