"""Documented follow-ups: adaptive guard (M27), grouped calibration (B4),
residual-quantile intervals (B6) and residual buckets (B7).

All are aggregates plus joins on small keyed tables; group factors and
interval offsets are computed on validation or training rows only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pvlake import config as C
from pvlake.functions.columns import quantile
from pvlake.operators.metrics import ape
from pvlake.operators.quantiles import exact_quantile_scalar, exact_quantiles
from pvlake.session import materialize

ADAPTIVE_QUANTILE = 0.15
ADAPTIVE_MULTIPLIER = 0.7  # not published; the broad guard's multiplier is used
SD = ["split", "deviceSn", "date"]
#: Most specific first: 5-degree cell, device family, quarter of the neighbours' output, predicted output.
CALIBRATION_LEVELS = ("region", "family", "capacity", "risk")
MIN_DAYS, PRIOR_DAYS = 10, 10.0  # not published


def adaptive_guard(policy_days: DataFrame, daily: DataFrame, approx: bool = False) -> DataFrame:
    """The broad guard with its threshold at the 15 % quantile of training daily sums."""
    train = daily.filter(F.col("eval_split") == "train")
    thr = train.agg(quantile("daily_target", ADAPTIVE_QUANTILE, True)).scalar() if approx \
        else exact_quantile_scalar(train, "daily_target", ADAPTIVE_QUANTILE)
    h = F.col("cold_start_alpha")
    fb_day = F.col("s_norm") * F.col("k_fallback")
    hit = F.coalesce((h <= C.COLD_ALPHA_CUT) & (fb_day <= thr), F.lit(False))
    pred = F.when(hit, fb_day * ADAPTIVE_MULTIPLIER).otherwise(fb_day)
    days = policy_days.select("eval_split", "y_true_day", pred.alias("p"), hit.alias("hit"))
    return days.groupBy("eval_split").agg(
        F.avg(ape(F.col("y_true_day"), F.col("p"))).alias("daily_mape"),
        F.count(F.when(F.col("hit"), 1)).alias("guarded_days"),
        F.first(F.lit(thr)).alias("threshold"))


def grouped_calibration(policy_days: DataFrame, features: DataFrame, candidate_factor: str = "k_blend") -> DataFrame:
    """Per 5-degree region, ratio sum(actual) / sum(prediction) on validation days,
    applied to every day of that region (1 where undefined); daily MAPE by split."""
    cells = features.groupBy("deviceSn").agg(
        (F.floor(F.median("latitude") / 5) * 5).cast("double").alias("cell_lat"),
        (F.floor(F.median("longitude") / 5) * 5).cast("double").alias("cell_lon"))
    days = policy_days.select("eval_split", "deviceSn", "y_true_day",
                              (F.col("s_norm") * F.col(candidate_factor)).alias("p")).join(cells, "deviceSn", "left")
    val = days.filter(F.col("eval_split").isin("valid_seen", "valid_unseen"))
    ratio = val.groupBy("cell_lat", "cell_lon").agg(
        F.when(F.sum("p") > 0, F.sum("y_true_day") / F.sum("p")).alias("group_factor"))
    cal = days.join(ratio, ["cell_lat", "cell_lon"], "left").withColumn(
        "p_cal", F.col("p") * F.coalesce(F.col("group_factor"), F.lit(1.0)))
    return cal.groupBy("eval_split").agg(
        F.avg(ape(F.col("y_true_day"), F.col("p"))).alias("daily_mape_before"),
        F.avg(ape(F.col("y_true_day"), F.col("p_cal"))).alias("daily_mape_after"))


def calibration_days(policy_days: DataFrame, daily: DataFrame, neighbours: DataFrame, candidate_factor: str = "k_blend") -> DataFrame:
    """Device-days with prediction ``p`` and their group on every calibration level (``CALIBRATION_LEVELS``)."""
    edges = exact_quantiles(neighbours, [], "nn_3_daily_mean", {"q1": 0.25, "q2": 0.5, "q3": 0.75}).select(F.struct("q1", "q2", "q3").alias("q")).scalar()
    keys = daily.select(*SD, "region_lat_5", "region_lon_5", "device_family_code", "nn_3_daily_mean")
    days = policy_days.select(*SD, "eval_split", "y_true_day", (F.col("s_norm") * F.col(candidate_factor)).alias("p")).join(keys, SD, "left")
    whole = lambda c: F.col(c).cast("long").cast("string")
    near = F.col("nn_3_daily_mean")
    very_low, low = C.LOW_LOAD_CUTS
    return days.withColumns({
        "region": F.concat_ws("|", whole("region_lat_5"), whole("region_lon_5")),
        "family": F.coalesce(whole("device_family_code"), F.lit("none")),
        "capacity": F.when(near.isNull(), "none").otherwise(F.concat(F.lit("q"), sum(
            (F.when(near > edges.getField(q), 1).otherwise(0) for q in ("q1", "q2", "q3")), F.lit(1)).cast("string"))),
        "risk": F.when(F.col("p") < very_low, "very low").when(F.col("p") < low, "low").otherwise("normal"),
    })


def calibration_groups(days: DataFrame) -> DataFrame:
    """(level, key, days, ratio, factor) of every group on every level, from validation days in one aggregate.

    ``ratio`` is sum(actual) / sum(prediction); ``factor`` is drawn towards the ratio of all days by ``PRIOR_DAYS``."""
    val = days.filter(F.col("eval_split").isin("valid_seen", "valid_unseen"))
    levels = list(CALIBRATION_LEVELS)
    sets = val.groupingSets([*[[F.col(c)] for c in levels], []], *levels).agg(
        F.grouping_id().alias("_id"), F.count(F.lit(1)).alias("days"), F.sum("y_true_day").alias("_y"), F.sum("p").alias("_p"))
    # a level's grouping id has every bit but its own
    every = (1 << len(levels)) - 1
    level, key = F.lit("all"), F.lit("")
    for i, c in enumerate(levels):
        own = F.col("_id") == every - (1 << (len(levels) - 1 - i))
        level, key = F.when(own, c).otherwise(level), F.when(own, F.col(c)).otherwise(key)
    groups = sets.select(level.alias("level"), key.alias("key"), "days", F.when(F.col("_p") > 0, F.col("_y") / F.col("_p")).alias("ratio"))
    groups = materialize(groups, "calibration_groups")
    overall = F.coalesce(groups.filter("level = 'all'").agg(F.max("ratio")).scalar(), F.lit(1.0))
    drawn = (F.col("days") * F.col("ratio") + PRIOR_DAYS * overall) / (F.col("days") + PRIOR_DAYS)
    return groups.withColumn("factor", F.when(F.col("level") == "all", overall).otherwise(F.coalesce(drawn, overall)))


def multi_level_calibration(days: DataFrame, groups: DataFrame) -> DataFrame:
    """B4 applied: each day takes the factor of the first level whose group has ``MIN_DAYS`` validation days, else that of
    all days. Daily MAPE by split before and after, and the days that each level decided."""
    out, chosen, used = days, F.lit(None).cast("double"), F.lit(None).cast("string")
    for c in CALIBRATION_LEVELS:
        own = groups.filter((F.col("level") == c) & (F.col("days") >= MIN_DAYS) & F.col("ratio").isNotNull()).select(
            F.col("key").alias(c), F.col("factor").alias(f"_f_{c}"))
        out = out.join(own, c, "left")
        chosen, used = F.coalesce(chosen, F.col(f"_f_{c}")), F.coalesce(used, F.when(F.col(f"_f_{c}").isNotNull(), c))
    overall = groups.filter("level = 'all'").agg(F.max("factor")).scalar()
    out = out.withColumns({"used": F.coalesce(used, F.lit("all")), "p_cal": F.col("p") * F.coalesce(chosen, overall, F.lit(1.0))})
    return out.groupBy("eval_split").agg(
        F.avg(ape(F.col("y_true_day"), F.col("p"))).alias("daily_mape_before"),
        F.avg(ape(F.col("y_true_day"), F.col("p_cal"))).alias("daily_mape_after"),
        *[F.count(F.when(F.col("used") == c, 1)).alias(f"days_by_{c}") for c in (*CALIBRATION_LEVELS, "all")])


def residual_intervals(points: DataFrame, pred: str = "final_prediction", lo: float = 0.1, hi: float = 0.9,
                       approx: bool = False) -> DataFrame:
    """Per-slot residual quantiles from validation rows give an interval around
    every prediction; report interval coverage and mean width by split."""
    resid = (F.col("pvGenTotal") - F.col(pred))
    val = points.filter(F.col("eval_split").isin("valid_seen", "valid_unseen") & F.col("slot_id").isNotNull())
    if approx:
        offsets = val.groupBy("slot_id").agg(quantile(resid, lo, True).alias("r_lo"), quantile(resid, hi, True).alias("r_hi"))
    else:
        offsets = exact_quantiles(val, ["slot_id"], resid, {"r_lo": lo, "r_hi": hi})
    scored = points.join(F.broadcast(offsets), "slot_id", "left").select(  # <= 96 rows
        "eval_split", "pvGenTotal", (F.col(pred) + F.col("r_lo")).alias("lower"),
        (F.col(pred) + F.col("r_hi")).alias("upper"))
    # a quantile is itself a residual, so the boundary is met exactly; 1e-12 keeps
    # last-bit differences in the prediction from flipping those rows
    inside = (F.col("pvGenTotal") >= F.col("lower") - 1e-12) & (F.col("pvGenTotal") <= F.col("upper") + 1e-12)
    return scored.groupBy("eval_split").agg(
        F.avg(F.when(inside, 1.0).otherwise(0.0)).alias("coverage"),
        F.avg(F.col("upper") - F.col("lower")).alias("mean_width"))


def residual_buckets(points: DataFrame, pred: str = "final_prediction", cloud_step: float = 20.0) -> DataFrame:
    """Mean residual by 5-degree cell and cloud-cover band."""
    band = F.floor(F.col("cloud_cover_H") / cloud_step) * cloud_step if "cloud_cover_H" in points.columns \
        else F.lit(None).cast("double")
    return points.groupBy(
        "region_lat_5", "region_lon_5", band.cast("double").alias("cloud_band")).agg(
        F.count(F.lit(1)).alias("rows"),
        F.avg(F.col("pvGenTotal") - F.col(pred)).alias("mean_residual"),
        F.avg(F.abs(F.col("pvGenTotal") - F.col(pred))).alias("mean_abs_residual"))
