"""Reconciliation, blends, fallbacks, guards and candidate selection
(M8, M13, M15-M24) on the device-day table.

Every policy candidate is the sanitized normalised point prediction ``n``
times a per-device-day factor:

    rescaled   k_resc = daily_model / max(S_n, 1e-9)        (M8; 0 when missing)
    calibrated k_cal  = daily_calibrated / max(S_n, 1e-9)
    blend      a*k_cal + (1-a)*k_resc                        (M15, a from M16)
    fallback   h*k_blend + (1-h)*k_resc, h = clip(days/14)   (M17)
    guards     k_fallback * multiplier(h, S_n*k_fallback)    (M18-M20)
    seen/new   k_cal if the device trained, else k_resc      (M22)

with S_n the device-day sum of n. ``n`` is already zero where the sun is off
and every factor is >= 0, so the sanitising step after each policy is a no-op
and daily sums are S_n * k. The whole chain therefore runs on device-day rows
(about 1/96 of the points); points are touched once more only to attach the
factors for point metrics and the prediction sink.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pvlake import config as C
from pvlake.operators.metrics import ape

SD = ["split", "deviceSn", "date"]
NORM = "pred_norm_point"

# candidate -> factor column on the device-day table (None: point column summed directly)
FACTOR = {
    "pred_irradiance_baseline": None,
    "pred_raw_point": None,
    "pred_norm_point": "k_norm",
    "pred_daily_model_rescaled": "k_resc",
    "pred_norm_calibrated": "k_cal",
    "pred_validated_blend": "k_blend",
    "pred_history_fallback": "k_fallback",
    "pred_low_output_guard": "k_guard_broad",
    "pred_precision_low_output_guard": "k_guard_precision",
    "pred_piecewise_low_output_guard": "k_guard_piecewise",
    "pred_seen_new_branch": "k_seen_new",
}
DAY_SUM = {"pred_irradiance_baseline": "s_base", "pred_raw_point": "s_raw"}
CANDIDATE_NAMES = [c for c, _ in C.CANDIDATES]


def device_day_table(points: DataFrame, seen_devices: DataFrame) -> DataFrame:
    """One row per (split, device, date) with label and base prediction sums."""
    sd = points.dropna(subset=SD).groupBy(*SD).agg(
        F.first("eval_split", ignorenulls=True).alias("eval_split"),
        F.coalesce(F.sum("pvGenTotal"), F.lit(0.0)).alias("y_true_day"),
        F.coalesce(F.sum(NORM), F.lit(0.0)).alias("s_norm"),
        F.coalesce(F.sum("pred_raw_point"), F.lit(0.0)).alias("s_raw"),
        F.coalesce(F.sum("pred_irradiance_baseline"), F.lit(0.0)).alias("s_base"),
        F.count(F.lit(1)).alias("n_rows"),
        F.first("device_history_days", ignorenulls=True).alias("_hist"),
    )
    seen = seen_devices.select("deviceSn", F.lit(True).alias("seen_device"))
    return sd.join(seen, "deviceSn", "left").withColumns({
        "seen_device": F.coalesce(F.col("seen_device"), F.lit(False)),
        "cold_start_alpha": F.least(F.greatest(F.coalesce(F.col("_hist"), F.lit(0.0)) / C.HISTORY_RAMP_DAYS,
                                               F.lit(0.0)), F.lit(1.0)),
    }).drop("_hist")


def rescale_factor(daily_pred: Column, raw_sum: Column) -> Column:
    """M8 as a factor: daily / max(raw sum, 1e-9); missing -> 0; clipped at 0."""
    return F.greatest(F.coalesce(daily_pred / F.greatest(raw_sum, F.lit(C.RESCALE_FLOOR)), F.lit(0.0)),
                      F.lit(0.0))


def with_base_factors(sd: DataFrame) -> DataFrame:
    return sd.withColumns({
        "k_norm": F.lit(1.0),
        "k_resc": rescale_factor(F.col("pred_daily_model"), F.col("s_norm")),
        "k_cal": rescale_factor(F.col("pred_day_calibrated"), F.col("s_norm")),
    })


def combined_validation(score_by_split: DataFrame, keys: list[str], metric: str = "daily_mape") -> DataFrame:
    seen = F.first(F.when(F.col("eval_split") == "valid_seen", F.col(metric)), ignorenulls=True)
    unseen = F.first(F.when(F.col("eval_split") == "valid_unseen", F.col(metric)), ignorenulls=True)
    return score_by_split.groupBy(*keys).agg((0.5 * seen + 0.5 * unseen).alias("combined"))


def blend_scan(sd: DataFrame) -> DataFrame:
    """Combined validation daily MAPE of a*calibrated + (1-a)*rescaled for a in 0..1 step .1.

    Exploding 11 alphas over device-day rows (a generator, not a join)."""
    alphas = F.array(*[F.lit(a) for a in C.BLEND_ALPHAS])
    rows = sd.filter(F.col("eval_split").isin("valid_seen", "valid_unseen")).select(
        "eval_split", "y_true_day", "s_norm", "k_cal", "k_resc", F.explode(alphas).alias("alpha"))
    pred = F.col("s_norm") * (F.col("alpha") * F.col("k_cal") + (1 - F.col("alpha")) * F.col("k_resc"))
    by_split = rows.groupBy("alpha", "eval_split").agg(F.avg(ape(F.col("y_true_day"), pred)).alias("daily_mape"))
    return combined_validation(by_split, ["alpha"]).filter(
        F.col("combined").isNotNull() & ~F.isnan("combined")
        & (F.abs(F.col("combined")) != float("inf")))


def tie_key(score: Column) -> Column:
    """Scores equal to 1e-9 count as ties (the list order decides), so float noise
    from summation order cannot reorder equal candidates."""
    return F.round(score, 9)


def best_alpha(scan: DataFrame) -> Column:
    """Minimum score, ties to the lowest alpha (scalar subquery)."""
    return scan.agg(F.min_by("alpha", F.struct(tie_key(F.col("combined")), F.col("alpha")))).scalar()


def _guard(alpha_h: Column, day_pred: Column, threshold: float, multiplier: float) -> Column:
    hit = (alpha_h <= C.COLD_ALPHA_CUT) & (day_pred <= threshold)
    return F.when(F.coalesce(hit, F.lit(False)), F.lit(multiplier)).otherwise(F.lit(1.0))


def _piecewise(alpha_h: Column, day_pred: Column) -> Column:
    lo_t, hi_t, lo_m, mid_m = C.PIECEWISE_GUARD
    cold = alpha_h <= C.COLD_ALPHA_CUT
    return (
        F.when(cold & (day_pred <= lo_t), F.lit(lo_m))
        .when(cold & (day_pred > lo_t) & (day_pred <= hi_t), F.lit(mid_m))
        .otherwise(F.lit(1.0))
    )


def with_policy_factors(sd: DataFrame, alpha: Column) -> DataFrame:
    """M15, M17-M20, M22 factors; ``alpha`` is the chosen blend weight."""
    h = F.col("cold_start_alpha")
    sd = sd.withColumn("blend_alpha", alpha)
    sd = sd.withColumn("k_blend", F.col("blend_alpha") * F.col("k_cal") + (1 - F.col("blend_alpha")) * F.col("k_resc"))
    sd = sd.withColumn("k_fallback", h * F.col("k_blend") + (1 - h) * F.col("k_resc"))
    fb_day = F.col("s_norm") * F.col("k_fallback")
    broad_t, broad_m = C.BROAD_GUARD
    prec_t, prec_m = C.PRECISION_GUARD
    sd = sd.withColumns({
        "g_broad": _guard(h, fb_day, broad_t, broad_m),
        "g_precision": _guard(h, fb_day, prec_t, prec_m),
        "g_piecewise": _piecewise(h, fb_day),
        "k_seen_new": F.when(F.col("seen_device"), F.col("k_cal")).otherwise(F.col("k_resc")),
    })
    return sd.withColumns({
        "k_guard_broad": F.col("k_fallback") * F.col("g_broad"),
        "k_guard_precision": F.col("k_fallback") * F.col("g_precision"),
        "k_guard_piecewise": F.col("k_fallback") * F.col("g_piecewise"),
    })


def day_sum(candidate: str) -> Column:
    if candidate in DAY_SUM:
        return F.col(DAY_SUM[candidate])
    return F.col("s_norm") * F.col(FACTOR[candidate])


def candidate_daily_scores(sd: DataFrame) -> DataFrame:
    """Daily metrics of all candidates by eval_split, in one pass over device-days (long form)."""
    aggs = []
    for i, cand in enumerate(CANDIDATE_NAMES):
        d = F.col("y_true_day") - day_sum(cand)
        aggs += [
            F.avg(F.abs(d)).alias(f"c{i}_daily_mae"),
            F.sqrt(F.avg(d * d)).alias(f"c{i}_daily_rmse"),
            F.avg(ape(F.col("y_true_day"), day_sum(cand))).alias(f"c{i}_daily_mape"),
        ]
    wide = sd.groupBy("eval_split").agg(F.count(F.lit(1)).alias("n_days"), *aggs)
    stack = F.explode(F.array(*[
        F.struct(F.lit(cand).alias("candidate"), F.lit(i).alias("ordinal"),
                 F.col(f"c{i}_daily_mae").alias("daily_mae"), F.col(f"c{i}_daily_rmse").alias("daily_rmse"),
                 F.col(f"c{i}_daily_mape").alias("daily_mape"))
        for i, cand in enumerate(CANDIDATE_NAMES)]))
    return wide.select("eval_split", "n_days", stack.alias("m")).select("eval_split", "n_days", "m.*")


def select_candidate(daily_scores: DataFrame) -> tuple[DataFrame, Column]:
    """Candidate with the lowest combined validation daily MAPE, first in list order on ties."""
    comb = combined_validation(daily_scores, ["candidate", "ordinal"]).filter(
        F.col("combined").isNotNull() & ~F.isnan("combined") & (F.abs(F.col("combined")) != float("inf")))
    best = comb.agg(F.min_by("candidate", F.struct(tie_key(F.col("combined")), F.col("ordinal")))).scalar()
    return comb, best


def guard_summary(sd: DataFrame) -> DataFrame:
    """Triggered point rows and triggered device-days per eval_split, per guard and band."""
    lo_t, hi_t, lo_m, mid_m = C.PIECEWISE_GUARD
    flags = {
        "broad": F.col("g_broad") != 1.0,
        "precision": F.col("g_precision") != 1.0,
        "piecewise_low": F.col("g_piecewise") == lo_m,
        "piecewise_mid": F.col("g_piecewise") == mid_m,
        "piecewise_all": F.col("g_piecewise") != 1.0,
    }
    stack = F.explode(F.array(*[F.struct(F.lit(k).alias("guard"), v.alias("hit")) for k, v in flags.items()]))
    rows = sd.select("eval_split", "n_rows", stack.alias("g")).select("eval_split", "n_rows", "g.*")
    return rows.groupBy("guard", "eval_split").agg(
        F.sum(F.when(F.col("hit"), F.col("n_rows")).otherwise(0)).alias("guarded_point_rows"),
        F.count(F.when(F.col("hit"), 1)).alias("guarded_days"),
    )


def choose(candidate: Column, values: list[Column]) -> Column:
    """The value of the named candidate; the (scalar-subquery) name is referenced once."""
    names = F.array(*[F.lit(c) for c in CANDIDATE_NAMES])
    return F.try_element_at(F.array(*values), F.array_position(names, candidate).cast("int"))


def attach_candidates(points: DataFrame, sd: DataFrame, final: Column | None = None) -> DataFrame:
    """Point-level candidate columns: n times the device-day factor (one join on the day key)."""
    factors = [v for v in FACTOR.values() if v]
    day = sd.select(*SD, *factors)
    joined = points.join(day, SD, "left")
    cols = {cand: F.col(NORM) * F.coalesce(F.col(k), F.lit(0.0))
            for cand, k in FACTOR.items() if k and cand != NORM}
    out = joined.withColumns(cols).drop(*factors)
    if final is not None:
        out = out.withColumn("final_prediction", choose(final, [F.col(c) for c in CANDIDATE_NAMES]))
    return out.withColumn("deployment_prediction", F.col(C.DEPLOYMENT_CANDIDATE))
