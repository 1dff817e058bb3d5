"""Stored report tables and lookups of saved summaries.

Each report is a parquet table under ``root/<report>/run_id=<run>``. A run is written
as a whole and replaces itself when written again; run ids sort by time. The lookups
pick the published rows in the published order from a stored run, without building
anything again; a report that was never stored gives None.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pvlake import config as C
from pvlake.sources.telemetry_csv import path_exists

DRIFT, CV_FOLDS, CV_AGGREGATE, CV_CANDIDATES, STRESS = "drift_summary", "cv_folds", "cv_aggregate", "cv_candidates", "stress_summary"


class ReportStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def write(self, report: str, rows: DataFrame, run_id: str) -> None:
        rows.write.mode("overwrite").parquet(f"{self.root}/{report}/run_id={run_id}")

    def read(self, report: str, run_id: str | None = None) -> DataFrame | None:
        """Rows of one run, the latest by default."""
        path = f"{self.root}/{report}"
        if not path_exists(self.spark, path):
            return None
        rows = self.spark.read.schema(self.spark.read.parquet(path).drop("run_id").schema.add("run_id", "string")).parquet(path)
        run = F.lit(run_id) if run_id is not None else rows.agg(F.max("run_id")).scalar()
        return rows.filter(F.col("run_id") == run).drop("run_id")


def _in_order(rows: DataFrame, column: str, names: tuple[str, ...]) -> DataFrame:
    """Rows named in ``names`` with their place there as ``position``."""
    place = F.array_position(F.array(*map(F.lit, names)), F.col(column))
    return rows.withColumn("position", place.cast("int")).filter("position > 0")


def _ranked(rows: DataFrame, *order) -> DataFrame:
    """``position`` over a handful of report rows."""
    return rows.withColumn("position", F.row_number().over(Window.orderBy(*order)))


def drift_lookup(store: ReportStore, run_id: str | None = None) -> DataFrame | None:
    """Split rows of the stored drift summary, in split order."""
    rows = store.read(DRIFT, run_id)
    return None if rows is None else _in_order(rows, "eval_split", C.EVAL_SPLITS).select(
        "position", "eval_split", "devices", "train_device_overlap_ratio", "daily_target_mean", "low_load_share_lt_0_05", "low_load_share_lt_0_10")


def cv_lookup(store: ReportStore, run_id: str | None = None) -> DataFrame | None:
    """The stored fold aggregate, in metric order."""
    rows = store.read(CV_AGGREGATE, run_id)
    return None if rows is None else _in_order(rows, "metric", C.FOLD_METRICS).select("position", "metric", "mean", "std", "min", "max")


def cv_top_candidates(store: ReportStore, n: int = 5, run_id: str | None = None) -> DataFrame | None:
    """The ``n`` candidates with the best stored mean over folds (a top-k report)."""
    rows = store.read(CV_CANDIDATES, run_id)
    if rows is None:
        return None
    combined = rows.filter(F.col("metric") == C.FOLD_METRICS[0])
    return _ranked(combined, F.round("mean", 9), "candidate").filter(F.col("position") <= n).select("position", "candidate", "mean", "std")


def stress_lookup(store: ReportStore, run_id: str | None = None) -> DataFrame | None:
    """Stored stress scores, best first; the first one is the stress run's choice."""
    rows = store.read(STRESS, run_id)
    if rows is None:
        return None
    ranked = _ranked(rows, F.round("combined_validation_daily_mape", 9), "candidate")
    return ranked.select("position", "candidate", "combined_validation_daily_mape", "valid_unseen_daily_mape", "test2_daily_mape",
                         (F.col("position") == 1).alias("chosen"))
