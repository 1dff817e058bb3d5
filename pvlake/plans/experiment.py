"""The experiment run: baseline and model predictions, reconciliation, blend
scan, fallback, guards, seen/new branch, candidate selection, metrics and sinks.

Shuffles over the point table: the baseline's (device, date) shares, one
device-day aggregate of the base predictions, and one join of device-day
factors back to the points. Everything else runs on device-day rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pvlake import config as C
from pvlake.operators import policy as P
from pvlake.operators.baseline import irradiance_baseline
from pvlake.operators.metrics import METRICS, ape
from pvlake.operators.splits import train_mask
from pvlake.plans.context import RunContext
from pvlake.session import materialize

EXPERIMENT = dict(C.CANDIDATES)
SD = ["split", "deviceSn", "date"]
SED = ["split", "eval_split", "deviceSn", "date"]


@dataclass
class Experiment:
    ctx: RunContext
    predictors: object

    @property
    def tables(self) -> tuple[DataFrame, DataFrame]:
        """The feature and the device-day table, with the columns that the predictors need."""
        return self.ctx.tables_for(getattr(self.predictors, "columns", None))

    @cached_property
    def base_points(self) -> DataFrame:
        """Points with baseline and sanitized raw/normalised point predictions (persisted).

        Of the features only those go along that policies, sinks and reports read: the rest stays in the feature
        table, so the joins of points with their days move narrow rows."""
        features = self.tables[0]
        pts = self.predictors.point(features, features)
        pts = pts.select(*[c for c in pts.columns if c in C.BASE_POINT_COLUMNS + C.BASELINE_INPUTS])
        pts = irradiance_baseline(pts, approx=self.ctx.settings.approx_quantiles)
        return materialize(pts.select(*[c for c in pts.columns if c in C.BASE_POINT_COLUMNS]), "base_points")

    @cached_property
    def seen_devices(self) -> DataFrame:
        return self.tables[0].filter(train_mask()).select("deviceSn").distinct()

    @cached_property
    def device_days(self) -> DataFrame:
        """Device-day table with base factors (before the blend choice)."""
        sd = P.device_day_table(self.base_points, self.seen_devices)
        dp = self.predictors.daily(self.tables[1], sd)
        return materialize(P.with_base_factors(sd.join(dp, SD, "left")), "device_days")

    @cached_property
    def blend_scores(self) -> DataFrame:
        return P.blend_scan(self.device_days)

    @cached_property
    def alpha(self) -> Column:
        return P.best_alpha(self.blend_scores)

    @cached_property
    def policy_days(self) -> DataFrame:
        return materialize(P.with_policy_factors(self.device_days, self.alpha), "policy_days")

    @cached_property
    def daily_scores(self) -> DataFrame:
        return P.candidate_daily_scores(self.policy_days)

    @cached_property
    def selection(self) -> tuple[DataFrame, Column]:
        return P.select_candidate(self.daily_scores)

    @property
    def candidate_scores(self) -> DataFrame:
        return self.selection[0]

    @property
    def best_candidate(self) -> Column:
        return self.selection[1]

    @cached_property
    def points(self) -> DataFrame:
        """K1 source: every point with all candidate columns, final and deployment prediction."""
        return materialize(P.attach_candidates(self.base_points, self.policy_days, self.best_candidate), "policy_points", ["eval_split"])

    @cached_property
    def point_scores(self) -> DataFrame:
        """Point metrics of every candidate by eval_split: one aggregate pass (long form)."""
        aggs = []
        y = F.col("pvGenTotal")
        for i, cand in enumerate(P.CANDIDATE_NAMES):
            d = y - F.col(cand)
            aggs += [F.avg(F.abs(d)).alias(f"c{i}_mae"), F.sqrt(F.avg(d * d)).alias(f"c{i}_rmse"),
                     F.avg(ape(y, F.col(cand))).alias(f"c{i}_mape")]
        scored = P.attach_candidates(self.base_points, self.policy_days)  # not the written points: nobody may ask for them
        wide = scored.groupBy("eval_split").agg(*aggs)
        stack = F.explode(F.array(*[
            F.struct(F.lit(cand).alias("candidate"), F.col(f"c{i}_mae").alias("mae"),
                     F.col(f"c{i}_rmse").alias("rmse"), F.col(f"c{i}_mape").alias("mape"))
            for i, cand in enumerate(P.CANDIDATE_NAMES)]))
        return wide.select("eval_split", stack.alias("m")).select("eval_split", "m.*")

    @cached_property
    def metrics_long(self) -> DataFrame:
        """E5 for all candidates: (experiment, candidate, eval_split, six metrics, n_days) + combined rows."""
        both = self.point_scores.join(self.daily_scores, ["eval_split", "candidate"])
        exp = F.create_map(*[x for cand, e in C.CANDIDATES for x in (F.lit(cand), F.lit(e))])
        both = both.withColumn("experiment", exp[F.col("candidate")])
        comb = self.candidate_scores.select(
            exp[F.col("candidate")].alias("experiment"), "candidate", "ordinal",
            F.lit("combined_validation").alias("eval_split"), F.col("combined").alias("daily_mape"))
        return materialize(both.unionByName(comb, allowMissingColumns=True), "metrics_long")

    def by_split(self, candidate: Column) -> DataFrame:
        """E6 for one candidate (final or deployment), one row per eval_split."""
        return self.metrics_long.filter(
            (F.col("candidate") == candidate) & (F.col("eval_split") != "combined_validation")
        ).select("eval_split", *METRICS, "n_days")

    @property
    def final_by_split(self) -> DataFrame:
        return self.by_split(self.best_candidate)

    @property
    def deployment_by_split(self) -> DataFrame:
        return self.by_split(F.lit(C.DEPLOYMENT_CANDIDATE))

    @property
    def guard_summary(self) -> DataFrame:
        return P.guard_summary(self.policy_days)

    @property
    def daily_predictions(self) -> DataFrame:
        """K2: SED sums of the label and 12 prediction columns, from the device-day table."""
        sd = self.policy_days
        final_sum = P.choose(self.best_candidate, [P.day_sum(c) for c in P.CANDIDATE_NAMES])
        cols = {"actual_daily": F.col("y_true_day"), "final_pred_daily": final_sum,
                "deployment_daily": P.day_sum(C.DEPLOYMENT_CANDIDATE)}
        for out, cand in C.DAILY_SINK:
            if out not in cols:
                cols[out] = P.day_sum(cand)
        return sd.select(*SED, *[v.alias(k) for k, v in cols.items()])

    def prediction_sink(self) -> DataFrame:
        """K1 projection."""
        return self.points.select(
            "split", "eval_split", "deviceSn", "date", "us_timestamp", "pvGenTotal",
            *P.CANDIDATE_NAMES, "final_prediction", "deployment_prediction")


def blend_weight_scan(points: DataFrame, sd: DataFrame) -> DataFrame:
    """11 alphas x 4 splits, six metrics of clip(a*calibrated + (1-a)*rescaled, 0).

    Point part: one pass over points with 11 x 3 aggregates; daily part on device-days."""
    splits = ("valid_seen", "valid_unseen", "test1", "test2")
    y = F.col("pvGenTotal")
    aggs = []
    for i, a in enumerate(C.BLEND_ALPHAS):
        p = F.greatest(a * F.col("pred_norm_calibrated") + (1 - a) * F.col("pred_daily_model_rescaled"), F.lit(0.0))
        d = y - p
        aggs += [F.avg(F.abs(d)).alias(f"a{i}_mae"), F.sqrt(F.avg(d * d)).alias(f"a{i}_rmse"),
                 F.avg(ape(y, p)).alias(f"a{i}_mape")]
    pt = points.filter(F.col("eval_split").isin(*splits)).groupBy("eval_split").agg(*aggs)
    stack = F.explode(F.array(*[
        F.struct(F.lit(a).alias("alpha_norm_calibrated"), F.col(f"a{i}_mae").alias("mae"),
                 F.col(f"a{i}_rmse").alias("rmse"), F.col(f"a{i}_mape").alias("mape"))
        for i, a in enumerate(C.BLEND_ALPHAS)]))
    pt = pt.select("eval_split", stack.alias("m")).select("eval_split", "m.*")
    alphas = F.array(*[F.lit(a) for a in C.BLEND_ALPHAS])
    days = sd.filter(F.col("eval_split").isin(*splits)).select(
        "eval_split", "y_true_day", "s_norm", "k_cal", "k_resc", F.explode(alphas).alias("alpha_norm_calibrated"))
    a = F.col("alpha_norm_calibrated")
    pday = F.col("s_norm") * F.greatest(a * F.col("k_cal") + (1 - a) * F.col("k_resc"), F.lit(0.0))
    d = F.col("y_true_day") - pday
    dd = days.groupBy("alpha_norm_calibrated", "eval_split").agg(
        F.avg(F.abs(d)).alias("daily_mae"), F.sqrt(F.avg(d * d)).alias("daily_rmse"),
        F.avg(ape(F.col("y_true_day"), pday)).alias("daily_mape"))
    return pt.join(dd, ["alpha_norm_calibrated", "eval_split"])


def blend_summary(scan: DataFrame) -> DataFrame:
    """R2: alpha rows x split columns of daily MAPE, plus combined_valid / combined_test."""
    wide = scan.groupBy("alpha_norm_calibrated").pivot(
        "eval_split", ["test1", "test2", "valid_seen", "valid_unseen"]).agg(F.first("daily_mape"))
    return wide.withColumns({
        "combined_valid": 0.5 * (F.col("valid_seen") + F.col("valid_unseen")),
        "combined_test": 0.5 * (F.col("test1") + F.col("test2")),
    })


def blend_argmin(summary: DataFrame) -> DataFrame:
    """Best alpha on validation and (diagnostic) on test; ties to the first (lowest) alpha."""
    def pick(col: str, label: str) -> DataFrame:
        return summary.agg(
            F.min_by("alpha_norm_calibrated", F.struct(col, "alpha_norm_calibrated")).alias("alpha_norm_calibrated"),
            F.min(col).alias("score")).withColumn("selected_on", F.lit(label))
    return pick("combined_valid", "validation").unionByName(pick("combined_test", "test"))


def blend_long(summary: DataFrame) -> DataFrame:
    """Wide -> long for the four plotted groups."""
    return summary.unpivot("alpha_norm_calibrated", ["combined_valid", "combined_test", "test1", "test2"],
                           "metric_group", "daily_mape")
