"""Feature plan: labels -> time -> physics -> spatial -> history -> target scaling.

Everything is one lazy DataFrame plan; the global scalars (cloud median, y_norm
cap, fill medians) are scalar subqueries, so the plan stays declarative and the
optimizer prunes columns a caller does not select.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from pvlake import config as C
from pvlake.config import Settings
from pvlake.functions.columns import physics_features, quantile, spatial_features, time_features, to_number
from pvlake.operators.quantiles import exact_quantile_scalar
from pvlake.operators.splits import assign_eval_split, train_mask


def label(points: DataFrame, s: Settings = Settings()) -> DataFrame:
    return assign_eval_split(points, s.holdout_days, s.unseen_fold, s.n_unseen_folds, s.unseen_strategy)


def scalar_features(points: DataFrame, s: Settings = Settings(), raw: DataFrame | None = None) -> DataFrame:
    """F1-F14 (row-local apart from the global cloud median). ``raw``: the same rows before labelling,
    so the median needs one column of the source and no labels."""
    df = time_features(points)
    cloud_median = None
    if "cloud_cover_H" in df.columns:
        cloud = to_number(F.col("cloud_cover_H"))
        source = df if raw is None else raw
        if s.approx_quantiles:
            cloud_median = source.agg(quantile(cloud, 0.5, True)).scalar()
        else:
            cloud_median = exact_quantile_scalar(source, cloud, 0.5)
    df = physics_features(df, cloud_median)
    return spatial_features(df)


def _y_norm() -> Column:
    return F.col("pvGenTotal") / (F.col("solar_proxy") + C.FEATURE_EPS)


def target_cap(source: DataFrame, s: Settings = Settings(), group_bound: int | None = None) -> Column:
    """F16: the cap of the normalised label, from the rows of ``source`` that the settings name."""
    cap_rows = source.filter(F.col("split") == "train") if s.cap_rows == "split_train" else source.filter(train_mask())
    if s.approx_quantiles:
        return cap_rows.agg(quantile(_y_norm(), C.Y_NORM_CAP_QUANTILE, True)).scalar()
    # y_norm is continuous over all training rows: exact without holding every value
    return exact_quantile_scalar(cap_rows, _y_norm(), C.Y_NORM_CAP_QUANTILE, group_bound=group_bound)


def target_features(df: DataFrame, s: Settings = Settings(), group_bound: int | None = None,
                    cap_source: DataFrame | None = None, cap: Column | None = None) -> DataFrame:
    """F16-F17. ``cap_source``: a written table with the same rows that the cap is taken from; ``cap``: the cap where it is known."""
    if cap is None:
        cap = target_cap(df if cap_source is None else cap_source, s, group_bound)
    return df.withColumn("y_norm", _y_norm()).withColumn(
        "y_norm_clipped", F.least(F.greatest(F.col("y_norm"), F.lit(0.0)), cap))


def point_feature_columns(df: DataFrame) -> list[str]:
    """numeric columns minus the excluded and categorical names."""
    skip = set(C.POINT_EXCLUDED) | set(C.CATEGORICAL) | {"row_id"}
    return [f.name for f in df.schema.fields if f.name not in skip and isinstance(f.dataType, NumericType)]


def daily_feature_columns(daily: DataFrame, reproduce_leak: bool = False) -> list[str]:
    skip = set(C.DAILY_EXCLUDED)
    if not reproduce_leak:
        skip |= set(C.LABEL_DERIVED_DAILY)
    return [f.name for f in daily.schema.fields if f.name not in skip and isinstance(f.dataType, NumericType)]


def feature_table(train: DataFrame, cols: list[str], grain: str) -> DataFrame:
    """F18 + B1: each model input of a grain with its number of training values; without any it is not used."""
    counts = train.agg(*[F.count(F.col(c)).alias(c) for c in cols])
    return counts.unpivot([], cols, "feature", "train_values").select(
        F.lit(grain).alias("grain"), "feature", "train_values", (F.col("train_values") > 0).alias("used"))
