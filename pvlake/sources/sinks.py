"""Output writers (K1-K4). Large outputs are written by the executors,
partitioned by evaluation split; the metrics document is a handful of rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pvlake.operators.metrics import METRICS


def write_point_predictions(experiment, path: str, fmt: str = "parquet") -> None:
    """K1: scored points, partitioned by eval_split."""
    experiment.prediction_sink().write.mode("overwrite").partitionBy("eval_split").format(fmt).option(
        "header", True).save(path)


def write_daily_predictions(experiment, path: str, fmt: str = "parquet") -> None:
    """K2: device-day sums of the label and every prediction column."""
    experiment.daily_predictions.write.mode("overwrite").partitionBy("eval_split").format(fmt).option(
        "header", True).save(path)


def metrics_document(metrics_long: DataFrame) -> DataFrame:
    """K3: one JSON object per experiment, {eval_split: {metric: value}}."""
    per_split = metrics_long.select(
        "experiment", "eval_split", F.struct(*[F.col(m) for m in METRICS]).alias("m"))
    doc = per_split.groupBy("experiment").agg(F.map_from_entries(
        F.collect_list(F.struct("eval_split", "m"))).alias("splits"))
    return doc.select("experiment", F.to_json("splits").alias("metrics_json"))


def write_metrics_json(experiment, path: str) -> None:
    """K3: a JSON line per experiment (a dozen)."""
    metrics_document(experiment.metrics_long).coalesce(1).write.mode("overwrite").json(path)


def read_metrics_json(spark: SparkSession, path: str) -> DataFrame:
    """K3 read back: (experiment, eval_split, metrics)."""
    values = ", ".join(f"{m}: DOUBLE" for m in METRICS)
    docs = spark.read.schema("experiment STRING, metrics_json STRING").json(path)
    splits = F.from_json("metrics_json", f"MAP<STRING, STRUCT<{values}>>")
    return docs.select("experiment", F.explode(splits).alias("eval_split", "m")).select("experiment", "eval_split", "m.*")


def write_split_metrics(df: DataFrame, path: str) -> None:
    """K4: one row per eval_split as CSV."""
    df.orderBy("eval_split").coalesce(1).write.mode("overwrite").option("header", True).csv(path)
