"""Cross-validation over unseen-device folds (R7-R9), the low-capacity stress
run (R10) and the flat model-comparison table (R11).

Folds run in one Spark application over one written base: a fold only changes
labels, which are a projection of that base, and each device's history is computed once for all
folds (``context.SharedBase``). Results stay long (fold, candidate, metric,
value) and the summaries are plain aggregates.
"""

from __future__ import annotations

from functools import partial, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pvlake.config import FOLD_METRICS, STRESS_CANDIDATES, Settings
from pvlake.plans.context import LabelContext, at_once
from pvlake.plans.experiment import Experiment


def candidate_split_table(e: Experiment) -> DataFrame:
    """One row per candidate: combined validation and per-split daily MAPE."""
    scores = e.metrics_long.filter(F.col("eval_split") != "combined_validation")
    wide = scores.groupBy("candidate").pivot(
        "eval_split", ["valid_seen", "valid_unseen", "test1", "test2"]).agg(F.first("daily_mape"))
    wide = wide.select("candidate", *[F.col(s).alias(f"{s}_daily_mape")
                                      for s in ("valid_seen", "valid_unseen", "test1", "test2")])
    comb = e.candidate_scores.select("candidate", F.col("combined").alias("combined_validation_daily_mape"))
    return wide.join(comb, "candidate", "left")


def fold_rows(e: Experiment, fold: int) -> DataFrame:
    """Long rows for one fold: the selected model's metrics and every candidate's scores."""
    table = candidate_split_table(e)
    best = e.best_candidate
    selected = table.filter(F.col("candidate") == best).select(
        F.lit("selected").alias("candidate"), *FOLD_METRICS)
    every = table.select("candidate", *FOLD_METRICS)
    long = selected.unionByName(every).unpivot("candidate", list(FOLD_METRICS), "metric", "value")
    return long.withColumns({"fold": F.lit(fold), "best_prediction_column": best, "best_blend_alpha": e.alpha})


def unseen_cv(spark: SparkSession, sf_dir: str, folds: int = 3, predictors=None,
              base: Settings = Settings()) -> DataFrame:
    """R7. ``predictors``: makes the predictors of one fold (fitted ones hold models); stand-ins by default.
    The folds run at the same time over their shared base."""
    from pvlake.models.standin import StandInPredictors

    def fold(i: int) -> DataFrame:
        s = Settings(**{**base.__dict__, "unseen_fold": i, "n_unseen_folds": folds})
        return fold_rows(Experiment(LabelContext.get(spark, sf_dir, s), (predictors or StandInPredictors)()), i)

    LabelContext.get(spark, sf_dir, base).base.prepare()
    return reduce(DataFrame.unionByName, at_once(*[partial(fold, i) for i in range(folds)]))


def cv_aggregate(fold_table: DataFrame) -> DataFrame:
    """Mean, std (ddof 1), min, max of the selected model's metrics over folds."""
    sel = fold_table.filter(F.col("candidate") == "selected")
    return sel.groupBy("metric").agg(
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"))


def cv_candidate_summary(fold_table: DataFrame) -> DataFrame:
    """Stability of each candidate over folds (combined and valid_unseen scores), best first."""
    keep = F.col("metric").isin("combined_validation_daily_mape", "valid_unseen_daily_mape")
    rows = fold_table.filter((F.col("candidate") != "selected") & keep & F.col("value").isNotNull())
    return rows.groupBy("candidate", "metric").agg(
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max")).orderBy("metric", "mean", "candidate")


def cold_start_stress(e: Experiment) -> DataFrame:
    """The cold-start candidates under the low-capacity unseen split, best first."""
    return candidate_split_table(e).filter(F.col("candidate").isin(*STRESS_CANDIDATES)).orderBy(
        "combined_validation_daily_mape", "candidate")


def model_comparison(e: Experiment) -> DataFrame:
    """(experiment, eval_split, six metrics), combined validation rows included."""
    return e.metrics_long.select("experiment", "eval_split", "mae", "rmse", "mape",
                                 "daily_mae", "daily_rmse", "daily_mape")

