"""Regressors for the point and daily models (M1-M3, M5-M7, M9, M10, M25, B1 by MLlib; M26 on binned rows).

Gradient-boosted trees stand in for the published boosting library; fits are
distributed MLlib jobs. A depth-6 tree is about seven jobs, so jobs and not rows
set the time of a fit on few rows: the assembled training rows are written once
into as few partitions as their count needs (``ROWS_PER_TASK``), and each model
is fitted when it is first asked for. All training rows are fitted, as published;
the rows of the two validation splits only end a fit (``validation_tol``) when
another tree no longer improves them, and the published tree counts are the
maximum. Test splits are never looked at. Inputs are imputed with exact medians of
the training rows; an all-empty column is dropped first because imputation has nothing to learn
from it.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import partial

from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pvlake import config as C
from pvlake.functions.columns import sanitize
from pvlake.models.trees import Forest, fit_forest, task_rows
from pvlake.operators.quantiles import column_quantiles, exact_quantile_scalar
from pvlake.operators.splits import train_mask, validation_mask
from pvlake.plans.features import daily_feature_columns, point_feature_columns
from pvlake.session import materialize

SD = ["split", "deviceSn", "date"]


#: Assembled rows a task holds during a fit: fewer partitions mean fewer and cheaper tasks a job.
ROWS_PER_TASK = 100_000


@dataclass(frozen=True)
class GbtConfig:
    """The published sizes and rates; 48 leaves are nearest to depth 6. Tree counts are the maximum;
    ``validation_tol`` None grows all of them."""

    point_trees: int = 700
    daily_trees: int = 500
    point_step: float = 0.035
    daily_step: float = 0.04
    max_depth: int = 6
    subsampling_rate: float = 0.9
    feature_subset: str = "0.85"
    min_instances: int = 30
    daily_min_instances: int = 15
    seed: int = 42
    checkpoint_interval: int = 25
    validation_tol: float | None = 0.0
    reproduce_leak: bool = False


#: The sizes that registered queries fit, in tests too.
REGISTERED = GbtConfig()


def non_empty(df: DataFrame, cols: list[str]) -> list[str]:
    """B1: columns with at least one value in ``df`` (one aggregate pass)."""
    if not cols:
        return []
    counts = df.agg(*[F.count(F.col(c)).alias(c) for c in cols]).first().asDict()
    return [c for c in cols if counts[c] > 0]


def train_medians(train: DataFrame, cols: list[str]) -> dict[str, float]:
    """Exact median of each feature column over training rows (one number a column)."""
    return column_quantiles(train, cols, 0.5)


def impute(df: DataFrame, cols: list[str], medians: dict[str, float], out: str = "_inputs") -> tuple[DataFrame, list[str]]:
    """Median-filled feature columns as one vector column (originals stay untouched): a filled copy of every
    column beside the table's own makes projections of over a hundred columns."""
    filled = [F.coalesce(nan_safe(F.col(c).cast("double")), F.lit(medians.get(c, 0.0))) for c in cols]
    return df.withColumn(out, array_to_vector(F.array(*filled))), [out]


def vector(df: DataFrame, cols: list[str]) -> Column:
    """The feature vector: one vector column as from ``impute``, or plain columns with NULL as NaN."""
    if len(cols) == 1 and isinstance(df.schema[cols[0]].dataType, VectorUDT):
        return F.col(cols[0])
    return array_to_vector(F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) for c in cols]))


def nan_safe(c):
    return F.when(F.isnan(c), F.lit(None).cast("double")).otherwise(c)


def gbt(cfg: GbtConfig, label: str, pred: str, daily: bool = False, weight: str | None = None) -> GBTRegressor:
    """M1, or M2 with ``daily``."""
    trees, step, leaf = (cfg.daily_trees, cfg.daily_step, cfg.daily_min_instances) if daily else (
        cfg.point_trees, cfg.point_step, cfg.min_instances)
    kw = dict(featuresCol="features", labelCol=label, predictionCol=pred, maxIter=trees,
              maxDepth=cfg.max_depth, stepSize=step, subsamplingRate=cfg.subsampling_rate,
              featureSubsetStrategy=cfg.feature_subset, minInstancesPerNode=leaf, seed=cfg.seed,
              checkpointInterval=cfg.checkpoint_interval)
    if cfg.validation_tol is not None:
        kw |= dict(validationIndicatorCol="_held", validationTol=cfg.validation_tol)
    if weight:
        kw["weightCol"] = weight
    return GBTRegressor(**kw)


def assembled(rows: DataFrame, cols: list[str], keep: list[str], name: str, per_task: Callable[[int], int] = lambda n: ROWS_PER_TASK) -> DataFrame:
    """``keep`` and the feature vector, written in as many partitions as the rows need and at most as they come in.
    ``per_task``: rows of a partition by the number of all rows."""
    out, n = rows.select(vector(rows, cols).alias("features"), *keep), rows.count()
    parts = max(1, -(-n // per_task(n)))
    return materialize(out.coalesce(parts), name).coalesce(parts)


def fit(every: DataFrame, train_rows, cols: list[str], label: str, estimator, keep: tuple = ()):
    """The model fitted on ``train_rows`` of ``every``; rows of the validation splits may end the fit."""
    rows = every.filter(F.col(label).isNotNull() & (train_rows | validation_mask())).withColumn("_held", ~train_rows)
    if not estimator.hasParam("validationIndicatorCol") or not estimator.isDefined("validationIndicatorCol"):
        rows = rows.filter(train_rows)
    elif not rows.filter("_held").limit(1).count():  # nothing to stop on: all trees
        estimator = estimator.copy()
        estimator.clear(estimator.validationIndicatorCol)
    return estimator.fit(assembled(rows, cols, [label, "_held", *keep], "fit_rows"))


def predict(model, rows: DataFrame, cols: list[str]) -> DataFrame:
    return model.transform(rows.withColumn("features", vector(rows, cols))).drop("features")


def fit_predict(train: DataFrame, every: DataFrame, cols: list[str], label: str, pred: str,
                estimator: Callable[[DataFrame, str], Forest]) -> tuple[Forest, DataFrame]:
    """M3: fit on ``train``, predict every row of ``every``."""
    rows = train.filter(F.col(label).isNotNull())
    model = estimator(assembled(rows, cols, [label], "fit_rows", partial(task_rows, rows.sparkSession)), label)
    return model, model.predict(every, vector(every, cols), pred)


def calibration_weights(daily: DataFrame, low_output_weight: float = 3.0) -> DataFrame:
    """M10 weights: training days below the exact 25 % quantile of training day sums weigh more."""
    q25 = exact_quantile_scalar(daily.filter(F.col("eval_split") == "train"), "daily_target", 0.25)
    return daily.withColumn("weight", F.when(F.col("daily_target") < q25, low_output_weight).otherwise(1.0))


class GbtPredictors:
    """Point and daily model predictions for the experiment plan. A model is fitted when it is first asked for."""

    name = "gbt"

    def __init__(self, cfg: GbtConfig = GbtConfig()):
        self.cfg = cfg
        self.models: dict[str, object] = {}
        self.point_columns: list[str] = []
        self._point: tuple[DataFrame, list[str]] | None = None

    def point_inputs(self, feat: DataFrame) -> tuple[DataFrame, list[str]]:
        if self._point is None:
            train = feat.filter(train_mask())
            cols = non_empty(train, point_feature_columns(feat))
            self.point_columns = cols
            self._medians = train_medians(train, cols)
            self._point = impute(feat, cols, self._medians)
        return self._point

    def point_model(self, feat: DataFrame, name: str):
        """M5 ``raw``: the label. M6 ``norm``: the normalised label on rows with sun."""
        if name not in self.models:
            every, cols = self.point_inputs(feat)
            label, rows = ("pvGenTotal", train_mask()) if name == "raw" else (
                "y_norm_clipped", train_mask() & (F.col("solar_proxy") > C.NORM_TRAIN_CUT))
            source = every if name == "raw" else every.filter(F.col("solar_proxy") > C.NORM_TRAIN_CUT)
            self.models[name] = fit(source, rows, cols, label, gbt(self.cfg, label, f"_{name}"))
        return self.models[name]

    def point(self, points: DataFrame, feat: DataFrame) -> DataFrame:
        """Both point predictions of ``points``, from models fitted on the written feature table ``feat``."""
        fits = self.point_inputs(feat)[1]
        with ThreadPoolExecutor(2) as pool:  # independent fits: their short jobs overlap
            raw, norm = pool.map(lambda m: self.point_model(feat, m), ("raw", "norm"))
        every, _ = impute(points, self.point_columns, self._medians)
        every = predict(norm, predict(raw, every, fits), fits)
        return every.withColumns({
            "pred_raw_point": sanitize(F.col("_raw")),
            "pred_norm_point": sanitize(F.col("_norm") * F.col("solar_proxy")),
        }).drop("_raw", "_norm", *fits)

    def norm_day_sums(self, feat: DataFrame) -> DataFrame:
        """Device-day sums of the normalised point model alone, as ``s_norm``."""
        model, (every, cols) = self.point_model(feat, "norm"), self.point_inputs(feat)
        pred = sanitize(F.col("_norm") * F.col("solar_proxy"))
        return predict(model, every.dropna(subset=SD), cols).groupBy(*SD).agg(F.sum(pred).alias("s_norm"))

    def _daily_inputs(self, daily: DataFrame, sd: DataFrame) -> tuple[DataFrame, dict[str, list[str]]]:
        """Device-days with both models' inputs; the calibrator's hold the day's raw point sum too."""
        cols = daily_feature_columns(daily, self.cfg.reproduce_leak)
        joined = daily.join(sd.select(*SD, F.col("s_norm").alias("pred_norm_point_sum")), SD, "left")
        joined = materialize(joined, "daily_inputs")
        train = joined.filter(F.col("eval_split") == "train")
        cols = non_empty(train, cols)
        med = train_medians(train, cols + ["pred_norm_point_sum"])
        every, plain = impute(joined, cols, med, "_daily_inputs")
        every, more = impute(every, cols + ["pred_norm_point_sum"], med, "_calibrator_inputs")
        return every.withColumn("_log_target", F.log1p("daily_target")), {"daily": plain, "calibrator": more}

    def daily(self, daily: DataFrame, sd: DataFrame) -> DataFrame:
        """M7 and M9: the daily model on log1p target, and the calibrator with the day's raw point sum as an extra input."""
        every, inputs = self._daily_inputs(daily, sd)
        train = F.col("eval_split") == "train"
        todo = [k for k in inputs if k not in self.models]
        with ThreadPoolExecutor(2) as pool:
            fits = pool.map(lambda k: fit(every, train, inputs[k], "_log_target", gbt(self.cfg, "_log_target", f"_{k}", daily=True)), todo)
            self.models |= dict(zip(todo, fits, strict=True))
        for k, some in inputs.items():
            every = predict(self.models[k], every, some)
        return every.select(
            *SD,
            F.greatest(F.expm1("_daily"), F.lit(0.0)).alias("pred_daily_model"),
            F.greatest(F.expm1("_calibrator"), F.lit(0.0)).alias("pred_day_calibrated"),
        )

    def weighted_calibration(self, daily: DataFrame, sd: DataFrame) -> DataFrame:
        """The calibrator with three times the weight on low-output training days. Fits its own model only."""
        every, inputs = self._daily_inputs(daily, sd)
        cols = inputs["calibrator"]
        every = calibration_weights(every)
        model = fit(every, F.col("eval_split") == "train", cols, "_log_target",
                    gbt(self.cfg, "_log_target", "_cal", daily=True, weight="weight"), keep=("weight",))
        self.models["weighted_calibrator"] = model
        return predict(model, every, cols).select(*SD, "weight", F.greatest(F.expm1("_cal"), F.lit(0.0)).alias("pred_day_calibrated"))

    def importances(self, feat: DataFrame, top: int = 25) -> DataFrame:
        """Top feature importances of the normalised point model."""
        from pyspark.sql import SparkSession

        imp = self.point_model(feat, "norm").featureImportances.toArray().tolist()
        spark = SparkSession.active()
        rows = sorted(zip(self.point_columns, imp, strict=True), key=lambda r: (-r[1], r[0]))[:top]
        return spark.createDataFrame([(f, float(v)) for f, v in rows], "feature string, importance double")


def random_forest(table: DataFrame, label: str, trees: int = 200, depth: int = 18, min_leaf: int = 5, seed: int = 42) -> Forest:
    """The published random-forest comparison settings."""
    return fit_forest(table, label, trees, depth, min_leaf, seed)
