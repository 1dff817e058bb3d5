"""Leakage-safe evaluation labels.

Labels are decided on small keyed tables and joined back to the points:
* seen holdout: distinct (device, date) of split=train rows, last N observed
  dates per device (a window over one device's *dates*, never its points);
* unseen devices: train devices that never appear in test1, picked in name
  order (default / fold) or by lowest mean daily output (low capacity).
Precedence of the final label: test split -> unseen -> seen holdout -> train.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pvlake import config as C
from pvlake.operators.ranking import first_n, ordinal_position
from pvlake.session import cut_lineage, sent_if_small


def unseen_count(n_candidates: Column) -> Column:
    """n = max(4, min(8, (len // 4) or 1)); every candidate when there are fewer."""
    quarter = F.floor(n_candidates / 4)
    return F.greatest(F.lit(C.UNSEEN_MIN), F.least(F.lit(C.UNSEEN_MAX), F.greatest(quarter, F.lit(1))))


def unseen_candidates(points: DataFrame) -> DataFrame:
    """Distinct train devices without any test1 row."""
    train_dev = points.filter(F.col("split") == "train").select("deviceSn").distinct()
    test1_dev = points.filter(F.col("split") == "test1").select("deviceSn").distinct()
    return train_dev.join(test1_dev, "deviceSn", "left_anti")


def daily_sums(points: DataFrame, keys: list[str], value: str = "pvGenTotal",
               name: str = "daily_sum") -> DataFrame:
    """A1: per-day sums; all-missing days sum to 0 like pandas; NULL keys dropped."""
    return (
        points.dropna(subset=keys)
        .groupBy(*keys)
        .agg(F.coalesce(F.sum(value), F.lit(0.0)).alias(name))
    )


def pick_unseen(points: DataFrame, unseen_fold: int | None = None,
                n_unseen_folds: int | None = None, strategy: str = "default") -> DataFrame:
    """One row per unseen device (column deviceSn)."""
    cands = unseen_candidates(points)
    n = unseen_count(cands.agg(F.count(F.lit(1))).scalar())
    if strategy == "low_capacity":
        train_rows = points.filter(F.col("split") == "train").join(cands, "deviceSn", "left_semi")
        capacity = daily_sums(train_rows, ["deviceSn", "date"]).groupBy("deviceSn").agg(
            F.avg("daily_sum").alias("capacity"))
        # at most 8 are ever taken: bounded top-n, ties broken by name
        top = first_n(capacity, [F.col("capacity").asc_nulls_last(), F.col("deviceSn")], C.UNSEEN_MAX)
        return top.filter(F.col("pos") < n).select("deviceSn")
    if n_unseen_folds and n_unseen_folds > 1:
        k = int(n_unseen_folds)
        fold = int(unseen_fold or 0) % k
        ranked = ordinal_position(cands, [F.col("deviceSn")])
        return ranked.filter(F.pmod(F.col("pos"), F.lit(k)) == fold).select("deviceSn")
    top = first_n(cands, [F.col("deviceSn")], C.UNSEEN_MAX)
    return top.filter(F.col("pos") < n).select("deviceSn")


def seen_holdout_days(points: DataFrame, holdout_days: int = C.HOLDOUT_DAYS) -> DataFrame:
    """Last ``holdout_days`` observed dates per device among split=train rows."""
    days = points.filter(F.col("split") == "train").select("deviceSn", "date").dropna().distinct()
    w = Window.partitionBy("deviceSn").orderBy(F.col("date").desc())
    return days.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= holdout_days).select(
        "deviceSn", "date", F.lit(True).alias("_holdout"))


def with_holdout(points: DataFrame, holdout_days: int = C.HOLDOUT_DAYS) -> DataFrame:
    """P2 as ``_holdout``, for rows of the training split. The held-out dates of a device are all from one date on, so one row
    a device is joined, and points are not shuffled by day where these rows are few."""
    since = cut_lineage(seen_holdout_days(points, holdout_days).groupBy("deviceSn").agg(F.min("date").alias("_since")))
    keys = ["deviceSn", "date"]
    return points.join(sent_if_small(since), "deviceSn", "left").select(
        *keys, *[c for c in points.columns if c not in keys], F.coalesce(F.col("date") >= F.col("_since"), F.lit(False)).alias("_holdout"))


def assign_eval_split(points: DataFrame, holdout_days: int = C.HOLDOUT_DAYS,
                      unseen_fold: int | None = None, n_unseen_folds: int | None = None,
                      unseen_strategy: str = "default") -> DataFrame:
    unseen = pick_unseen(points, unseen_fold, n_unseen_folds, unseen_strategy).select(
        "deviceSn", F.lit(True).alias("_unseen"))
    if unseen_strategy == "low_capacity" or not (n_unseen_folds and n_unseen_folds > 1):
        unseen = F.broadcast(unseen)  # at most 8 rows
    labelled = with_holdout(points, holdout_days).join(unseen, "deviceSn", "left")
    split = F.col("split")
    is_train = split == "train"
    label = (
        F.when(split == "test1", "test1")
        .when(split == "test2", "test2")
        .when(is_train & F.col("_unseen").isNotNull(), "valid_unseen")
        .when(is_train & F.col("_holdout"), "valid_seen")
        .otherwise("train")
    )
    return labelled.withColumn("eval_split", label).drop("_holdout", "_unseen")


def label_once(points: DataFrame, holdout_days: int = C.HOLDOUT_DAYS) -> DataFrame:
    """What every labelling of ``points`` needs, in one pass: ``eval_split`` as if no device were unseen, and each
    unseen candidate's place in name order (``_place``) and among the lowest capacities (``_low``, only the few that can be taken)."""
    cands = unseen_candidates(points)
    place = ordinal_position(cands, [F.col("deviceSn")], "_place")
    train_rows = points.filter(F.col("split") == "train").join(cands, "deviceSn", "left_semi")
    capacity = daily_sums(train_rows, ["deviceSn", "date"]).groupBy("deviceSn").agg(F.avg("daily_sum").alias("capacity"))
    low = first_n(capacity, [F.col("capacity").asc_nulls_last(), F.col("deviceSn")], C.UNSEEN_MAX, "_low").select("deviceSn", "_low")
    label = (
        F.when(F.col("split").isin("test1", "test2"), F.col("split"))
        .when((F.col("split") == "train") & F.col("_holdout"), "valid_seen")
        .otherwise("train")
    )
    labelled = with_holdout(points, holdout_days).join(place.join(F.broadcast(low), "deviceSn", "left"), "deviceSn", "left")  # low: at most 8 rows
    return labelled.withColumn("eval_split", label).drop("_holdout")


def unseen_in(s, n_candidates: Column) -> Column:
    """Whether a row of ``label_once`` belongs to an unseen device under the settings ``s``."""
    if s.unseen_strategy == "low_capacity":
        hit = F.col("_low") < unseen_count(n_candidates)
    elif s.n_unseen_folds and s.n_unseen_folds > 1:
        hit = F.pmod(F.col("_place"), F.lit(int(s.n_unseen_folds))) == int(s.unseen_fold or 0) % int(s.n_unseen_folds)
    else:
        hit = F.col("_place") < unseen_count(n_candidates)
    return F.coalesce(hit, F.lit(False))


def train_mask() -> Column:
    """P9."""
    return (F.col("split") == "train") & (F.col("eval_split") == "train")


def validation_mask() -> Column:
    """P10."""
    return F.col("eval_split").isin("valid_seen", "valid_unseen")
