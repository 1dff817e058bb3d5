"""Device radiation profiles (A12), mean profile similarity (A13), weather bins
and neighbour capacity proxies (B3).

A13 avoids the device x device similarity matrix: with unit profile vectors
u_i and S = sum_j u_j, the mean cosine similarity to all other devices is
(u_i . S - u_i . u_i) / max(n - 1, 1). That needs two aggregates over long
(device, slot) rows plus one 96-row slot table, so it scales with the number
of devices instead of its square.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pvlake import config as C
from pvlake.session import materialize

IDW_FLOOR_KM = 0.1  # unpublished


def radiation_profile(points: DataFrame) -> DataFrame:
    """Per (device, slot) mean solar_proxy divided by the device maximum + 1e-9 (long form)."""
    slot_mean = points.dropna(subset=["deviceSn", "slot_id"]).groupBy("deviceSn", "slot_id").agg(
        F.avg("solar_proxy").alias("slot_mean"))
    # a device has at most 96 slot rows here, so a device window is bounded (not a point window)
    dev_max = F.max("slot_mean").over(Window.partitionBy("deviceSn"))
    return slot_mean.select("deviceSn", "slot_id", (F.col("slot_mean") / (dev_max + 1e-9)).alias("profile"))


def radiation_similarity(points: DataFrame) -> DataFrame:
    """Mean cosine similarity of each device profile to all other devices."""
    prof = radiation_profile(points)
    norm = F.sqrt(F.sum(F.col("profile") ** 2).over(Window.partitionBy("deviceSn")))
    unit = materialize(prof.select(  # read twice below: written once
        "deviceSn", "slot_id", F.when(norm > 0, F.col("profile") / norm).otherwise(0.0).alias("u")), "unit_profiles")
    slot_total = unit.groupBy("slot_id").agg(F.sum("u").alias("_s"))  # <= 96 rows
    n_dev = unit.select("deviceSn").distinct().agg(F.count(F.lit(1))).scalar()
    sims = unit.join(F.broadcast(slot_total), "slot_id").groupBy("deviceSn").agg(
        F.sum(F.col("u") * F.col("_s")).alias("_dot"), F.sum(F.col("u") * F.col("u")).alias("_self"))
    return sims.select(
        "deviceSn",
        ((F.col("_dot") - F.col("_self")) / F.greatest(n_dev - 1, F.lit(1))).alias("radiation_similarity_mean"))


def add_radiation_similarity(points: DataFrame) -> DataFrame:
    """A13 wiring: left join, missing -> 0; a no-op when solar_proxy has at most one distinct value."""
    distinct = points.select("solar_proxy").distinct().limit(2).count()
    if distinct <= 1:
        return points
    return points.join(materialize(radiation_similarity(points), "similarity"), "deviceSn", "left").fillna(
        {"radiation_similarity_mean": 0.0})


def weather_days(points: DataFrame) -> DataFrame:
    """Per (device, date) solar mean / max, temperature mean and the weather bin."""
    aggs = [F.avg("solar_proxy").alias("solar_mean"), F.max("solar_proxy").alias("solar_max")]
    if "temperature_2m" in points.columns:
        aggs.append(F.avg("temperature_2m").alias("temperature_2m"))
    lo, hi = C.WEATHER_BIN_CUTS
    day = points.dropna(subset=["deviceSn", "date"]).groupBy("deviceSn", "date").agg(*aggs)
    return day.withColumn(
        "weather_bin",
        F.when(F.col("solar_max") > hi, 2).when((F.col("solar_max") > lo) & (F.col("solar_max") <= hi), 1)
        .otherwise(0).cast("int"))


def add_weather_bins(points: DataFrame) -> DataFrame:
    """A14 wiring: map the day's bin back to its rows, default 0."""
    bins = weather_days(points).select("deviceSn", "date", "weather_bin")
    return points.join(bins, ["deviceSn", "date"], "left").fillna({"weather_bin": 0})


def neighbour_capacity(pairs: DataFrame, floor_km: float = IDW_FLOOR_KM) -> DataFrame:
    """Mean training daily output of a device's nearest training devices, weighted by inverse distance.

    ``pairs`` as from ``neighbour_pairs``; closer than ``floor_km`` counts as that far."""
    known = pairs.filter(F.col("distance").isNotNull() & F.col("t_mean").isNotNull())
    w = 1 / F.greatest(F.col("distance"), F.lit(floor_km))
    return known.groupBy("deviceSn").agg((F.sum(w * F.col("t_mean")) / F.sum(w)).alias("neighbour_daily_mean"))


def region_capacity(features: DataFrame, pairs: DataFrame) -> DataFrame:
    """Capacity proxies of each device: mean training daily output of the devices in its 5-degree cell, of its
    neighbours by distance, and the first of own history, neighbours, cell and all devices that is known."""
    from pvlake.operators.splits import daily_sums, train_mask

    train = features.filter(train_mask())
    own = materialize(daily_sums(train, ["deviceSn", "date"]).groupBy("deviceSn").agg(F.avg("daily_sum").alias("m")), "own_means")
    cells = materialize(features.groupBy("deviceSn").agg(
        (F.floor(F.median("latitude") / 5) * 5).cast("double").alias("region_lat_5"),
        (F.floor(F.median("longitude") / 5) * 5).cast("double").alias("region_lon_5")), "device_cells")
    cell_cap = cells.join(own, "deviceSn").groupBy("region_lat_5", "region_lon_5").agg(
        F.avg("m").alias("region_daily_mean"), F.count(F.lit(1)).alias("region_train_devices"))
    overall = own.agg(F.avg("m")).scalar()
    out = cells.join(cell_cap, ["region_lat_5", "region_lon_5"], "left").join(own, "deviceSn", "left").join(
        neighbour_capacity(pairs), "deviceSn", "left")
    chain = (("own", F.col("m")), ("neighbours", F.col("neighbour_daily_mean")), ("region", F.col("region_daily_mean")), ("all", overall))
    return out.withColumns({
        "capacity": F.coalesce(*[c for _, c in chain]),
        "capacity_source": F.coalesce(*[F.when(c.isNotNull(), name) for name, c in chain]),
    }).drop("m")
