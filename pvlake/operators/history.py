"""History enrichment.

History comes only from rows that stay in training (P9). Device, slot and
neighbour statistics are joined once, at the grain of the (device, slot) pairs
that occur in the points; missing values are filled there, and one join brings
the result to the points. The cascade is device stat -> neighbour / global-slot
stat -> row-weighted median of the unfilled column; the medians come from the
same pair table, each pair counting as often as it has points.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pvlake.functions.columns import quantile
from pvlake.operators.quantiles import exact_quantiles
from pvlake.operators.splits import daily_sums
from pvlake.session import materialize

DEVICE_FILLED = ("device_daily_mean", "device_daily_median", "device_daily_p90", "device_daily_max")
SLOT_FILLED = ("device_slot_mean", "device_slot_p90")


def device_history(train_rows: DataFrame, approx: bool = False) -> DataFrame:
    """A2: statistics of each device's daily sums."""
    daily = daily_sums(train_rows, ["deviceSn", "date"])
    return daily.groupBy("deviceSn").agg(
        F.avg("daily_sum").alias("device_daily_mean"),
        quantile("daily_sum", 0.5, approx).alias("device_daily_median"),
        quantile("daily_sum", 0.9, approx).alias("device_daily_p90"),
        F.max("daily_sum").alias("device_daily_max"),
        F.count(F.lit(1)).cast("double").alias("device_history_days"),
    )


def _mean_and_p90(rows: DataFrame, keys: list[str], mean_name: str, p90_name: str, approx: bool,
                  group_bound: int | None = None) -> DataFrame:
    """Mean and p90 of the label per key. A device (and so its slots) may hold a large
    share of all rows, so the exact p90 uses the hot-group-safe quantile."""
    rows = rows.dropna(subset=keys)
    if approx:
        return rows.groupBy(*keys).agg(F.avg("pvGenTotal").alias(mean_name),
                                       quantile("pvGenTotal", 0.9, True).alias(p90_name))
    means = rows.groupBy(*keys).agg(F.avg("pvGenTotal").alias(mean_name))
    p90 = exact_quantiles(rows, keys, "pvGenTotal", {p90_name: 0.9}, group_bound=group_bound)
    return means.join(p90, keys, "left")


def device_slot_history(train_rows: DataFrame, approx: bool = False, group_bound: int | None = None) -> DataFrame:
    """A3: per (device, slot) mean and p90 of the label."""
    return _mean_and_p90(train_rows, ["deviceSn", "slot_id"], "device_slot_mean", "device_slot_p90", approx,
                         group_bound)


def global_slot_history(train_rows: DataFrame, approx: bool = False, group_bound: int | None = None) -> DataFrame:
    """A4: per slot mean and p90 (at most 96 rows, safe to broadcast)."""
    return _mean_and_p90(train_rows, ["slot_id"], "global_slot_mean", "global_slot_p90", approx, group_bound)


def own_pairs(points: DataFrame, by_device: DataFrame, by_slot: DataFrame) -> DataFrame:
    """Each (device, slot) pair of the points with its number of points as ``_rows`` and its own statistics.

    A pair without training rows keeps its device's; a missing slot is a pair too."""
    return (points.groupBy("deviceSn", "slot_id").agg(F.count(F.lit(1)).alias("_rows"))
            .join(by_device, "deviceSn", "left").join(by_slot, ["deviceSn", "slot_id"], "left"))


def filled(df: DataFrame, medians) -> DataFrame:
    """The cascade for missing statistics; ``medians`` is a struct of the unfilled columns' medians."""
    med = {c: medians.getField(c) for c in DEVICE_FILLED + SLOT_FILLED}
    fills = {c: F.coalesce(F.col(c), F.col("nn_3_daily_mean"), med[c]) for c in DEVICE_FILLED}
    fills.update({c: F.coalesce(F.col(c), F.col("global_slot_mean"), med[c]) for c in SLOT_FILLED})
    fills["device_history_days"] = F.coalesce(F.col("device_history_days"), F.lit(0.0))
    return df.withColumns(fills)


def weighted_medians(long: DataFrame, group_bound: int):
    """Row-weighted medians of stacked (``_rows``, name, value) as a struct; each name is one (hot) group."""
    cols = DEVICE_FILLED + SLOT_FILLED
    per_name = exact_quantiles(long, ["name"], "value", {"m": 0.5}, group_bound=group_bound, weight="_rows")
    return per_name.groupBy().pivot("name", list(cols)).agg(F.first("m")).select(F.struct(*cols).alias("m")).scalar()


def stacked(rows: DataFrame, cols: tuple[str, ...]) -> DataFrame:
    return rows.select("_rows", *cols).unpivot(["_rows"], list(cols), "name", "value")


def pair_history(points: DataFrame, train_rows: DataFrame, nn_stats: DataFrame,
                 approx: bool = False, group_bound: int | None = None,
                 own: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """J1 + J2 for each (device, slot) pair of the points, with its number of points as ``_rows``.

    ``own``: the device and (device, slot) statistics of ``train_rows`` where they exist already.
    """
    by_device, by_slot = own or (device_history(train_rows, approx), device_slot_history(train_rows, approx, group_bound))
    pairs = materialize(
        own_pairs(points, by_device, by_slot)
        .join(F.broadcast(global_slot_history(train_rows, approx, group_bound)), "slot_id", "left")
        .join(nn_stats, "deviceSn", "left"), "pair_history")
    # row-weighted medians of the unfilled columns, all six in one pass
    return filled(pairs, weighted_medians(stacked(pairs, DEVICE_FILLED + SLOT_FILLED), pairs.count()))


def enrich(points: DataFrame, train_rows: DataFrame, nn_stats: DataFrame,
           approx: bool = False, group_bound: int | None = None, own: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Points with their pair's history: one join. ``group_bound``: rows of the point table (see exact_quantiles)."""
    pairs = pair_history(points, train_rows, nn_stats, approx, group_bound, own).drop("_rows")
    pairs = pairs.withColumnsRenamed({"deviceSn": "_device", "slot_id": "_slot"})
    return points.join(pairs, points["deviceSn"].eqNullSafe(pairs["_device"])
                       & points["slot_id"].eqNullSafe(pairs["_slot"]), "left").drop("_device", "_slot")


def device_values(points: DataFrame, train_rows: DataFrame, nn_stats: DataFrame, approx: bool = False, group_bound: int | None = None,
                  own: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """What ``enrich`` gives all points of a device alike, one row a device."""
    pairs = pair_history(points, train_rows, nn_stats, approx, group_bound, own)
    alike = [*DEVICE_FILLED, "device_history_days", *[c for c in nn_stats.columns if c != "deviceSn"]]
    return pairs.groupBy("deviceSn").agg(*[F.max(c).alias(c) for c in alike])
