"""Exact k-nearest training devices by great-circle distance, without pairing
every device with every training device.

Training devices are bucketed into a lat/lon grid. A query device looks at
the 3x3 block of cells around its own cell (an equi-join on the cell id) and
is *resolved* when its k-th nearest candidate lies strictly closer than the
block's guaranteed radius (no device outside the block can be closer), or when
the block already holds every other training device. Unresolved devices move
to a grid with cells twice as wide. The last level covers the globe, so the
result is exact for every device. The starting cell width follows the
training-device density, so a typical device is resolved on the first level.
Of the training devices at one location only the first names are candidates.

Semantics kept from the workflow: the device itself is excluded, and a device
that is the only training device falls back to itself; ties in distance are
broken by device name.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pvlake import config as C
from pvlake.functions.columns import haversine_km, quantile
from pvlake.operators.ranking import first_n
from pvlake.operators.splits import daily_sums
from pvlake.session import cut_lineage, materialize

K_MAX = 5
KM_PER_DEG = math.pi / 180.0 * C.EARTH_RADIUS_KM
TARGET_CANDIDATES = 64  # aimed at, not a limit
MIN_WIDTH = 1e-3  # degrees, about 100 m


def _final_grid(ncols: int, nrows: int) -> bool:
    return ncols <= 3 and nrows <= 3


def _final(width_raw: float) -> bool:
    _, ncols, nrows = _grid(width_raw)
    return _final_grid(ncols, nrows)


def device_locations(points: DataFrame, approx: bool = False) -> DataFrame:
    """A5 query side: median lat/lon per device over all rows."""
    return points.groupBy("deviceSn").agg(
        quantile("latitude", 0.5, approx).alias("latitude"),
        quantile("longitude", 0.5, approx).alias("longitude"),
    )


def train_device_table(train_rows: DataFrame, approx: bool = False) -> DataFrame:
    """A5 candidate side + daily mean / p90 of each training device."""
    loc = train_rows.groupBy("deviceSn").agg(
        quantile("latitude", 0.5, approx).alias("t_lat"),
        quantile("longitude", 0.5, approx).alias("t_lon"),
    )
    daily = daily_sums(train_rows, ["deviceSn", "date"]).groupBy("deviceSn").agg(
        F.avg("daily_sum").alias("t_mean"),
        quantile("daily_sum", 0.9, approx).alias("t_p90"),
    )
    return loc.join(daily, "deviceSn", "left").withColumnRenamed("deviceSn", "t_dev")


def _grid(width_raw: float) -> tuple[float, int, int]:
    ncols = max(1, int(360.0 // width_raw))
    width = 360.0 / ncols
    nrows = max(1, math.ceil(180.0 / width))
    return width, ncols, nrows


def _cells(lat: Column, lon: Column, width: Column, nrows: Column, ncols: Column) -> tuple[Column, Column]:
    row = F.least(F.floor((lat + 90.0) / width), nrows - 1)
    col = F.pmod(F.floor((lon + 180.0) / width), ncols)
    return row.cast("int"), col.cast("int")


def _guaranteed_km(lat: Column, lon: Column, row: Column, col: Column, width: Column, ncols: Column) -> Column:
    """Distance below which no device outside the 3x3 block can lie."""
    lo = F.greatest((row - 1) * width - 90.0, F.lit(-90.0))
    hi = F.least((row + 2) * width - 90.0, F.lit(90.0))
    d_lat = F.least(lat - lo, hi - lat) * KM_PER_DEG
    west = (col - 1) * width - 180.0
    east = (col + 2) * width - 180.0
    dlon = F.least(F.least(lon - west, east - lon), F.lit(90.0))
    d_lon = C.EARTH_RADIUS_KM * F.asin(F.least(F.cos(F.radians(lat)) * F.sin(F.radians(dlon)), F.lit(1.0)))
    return F.when(ncols <= 3, d_lat).otherwise(F.least(d_lat, d_lon))


def _block(row: Column, col: Column, ncols: Column) -> Column:
    offsets = F.array(*[F.lit(i) for i in (-1, 0, 1)])
    return F.array_distinct(F.flatten(F.transform(offsets, lambda dr: F.transform(
        offsets, lambda dc: F.struct((row + dr).alias("cr"), F.pmod(col + dc, ncols).alias("cc"))))))


def _start_width(box: tuple, n_train: int) -> float:
    """Cell width holding about K_MAX devices at the average density of the bounding box."""
    area = max((box[1] - box[0]) * (box[3] - box[2]), 1e-4)
    return float(min(max(math.sqrt(area * K_MAX / max(n_train, 1)), 0.01), 120.0))


def summarise(ranked: DataFrame) -> DataFrame:
    r = F.col("_rank")
    return ranked.groupBy("deviceSn").agg(
        F.min("distance").alias("nn_1_distance_km"),
        F.avg(F.when(r <= 3, F.col("t_mean"))).alias("nn_3_daily_mean"),
        F.avg(F.when(r <= 3, F.col("t_p90"))).alias("nn_3_daily_p90"),
        F.avg(F.when(r <= 5, F.col("t_mean"))).alias("nn_5_daily_mean"),
        F.avg(F.when(r <= 5, F.col("t_p90"))).alias("nn_5_daily_p90"),
    )


def candidates(located: DataFrame) -> DataFrame:
    """The training devices that can be chosen at all: devices at one location have one distance and
    ties go by name, so beyond the first ``K_MAX`` + 1 names (one may be the asking device) none is.
    Spark keeps that many per location in each task before the shuffle, and a site with any
    number of devices is a few candidates."""
    place = Window.partitionBy("t_lat", "t_lon").orderBy("t_dev")
    return located.withColumn("_at", F.row_number().over(place)).filter(F.col("_at") <= K_MAX + 1).drop("_at")


def nearest_neighbour_stats(train_rows: DataFrame, points: DataFrame, approx: bool = False) -> DataFrame:
    return summarise(neighbour_pairs(train_device_table(train_rows, approx), device_locations(points, approx)))


def neighbour_pairs(train_devices: DataFrame, locations: DataFrame) -> DataFrame:
    """(deviceSn, _rank, distance, t_dev, t_mean, t_p90): the ``K_MAX`` nearest training devices of each device.

    ``train_devices`` as from ``train_device_table``, ``locations`` as from ``device_locations``."""
    # device dimensions (one row per device) are reused by every level: written once;
    # the per-level state below is checkpointed so lineage does not grow with the levels
    train = materialize(train_devices, "knn_train")
    has_loc = F.col("t_lat").isNotNull() & F.col("t_lon").isNotNull()
    located = materialize(candidates(train.filter(has_loc)), "knn_candidates")
    is_candidate = located.select(F.col("t_dev").alias("deviceSn"), F.lit(1).alias("_is_candidate"))
    queries = materialize(locations.join(is_candidate, "deviceSn", "left").fillna(
        {"_is_candidate": 0}), "knn_queries")

    stats = located.agg(  # one small aggregate: count and bounding box of the candidates
        F.count(F.lit(1)).alias("m"), F.min("t_lat").alias("lat0"), F.max("t_lat").alias("lat1"),
        F.min("t_lon").alias("lon0"), F.max("t_lon").alias("lon1")).first()
    n_train, n_located = train.count(), stats["m"]
    pending = queries.filter(F.col("latitude").isNotNull() & F.col("longitude").isNotNull())
    pending = pending.withColumn("_avail", F.lit(n_located) - F.col("_is_candidate"))

    base = _start_width((stats["lat0"], stats["lat1"], stats["lon0"], stats["lon1"]), n_located) \
        if n_located else 360.0
    top = 0  # the coarsest level: 3x3 cells cover the globe
    while not _final(base * 2.0 ** top):
        top += 1
    bottom = -max(0, math.ceil(math.log2(base / MIN_WIDTH)))
    grid = {lvl: _grid(base * 2.0 ** lvl) for lvl in range(bottom, top + 1)}
    spark = train.sparkSession
    levels = F.broadcast(spark.createDataFrame(  # one row per level (<= ~30)
        [(lvl, w, nc, nr, _final_grid(nc, nr)) for lvl, (w, nc, nr) in grid.items()],
        "_lvl int, _w double, _nc int, _nr int, _final boolean"))

    # start level per device: devices in a dense neighbourhood start on finer
    # cells (each level quarters the expected candidates), so no device meets
    # more than about TARGET_CANDIDATES candidates on its first try
    w0, nc0, nr0 = grid[0]
    t_row, t_col = _cells(F.col("t_lat"), F.col("t_lon"), F.lit(w0), F.lit(nr0), F.lit(nc0))
    density = located.groupBy(t_row.alias("cr"), t_col.alias("cc")).agg(F.count(F.lit(1)).alias("_c"))
    q_row, q_col = _cells(F.col("latitude"), F.col("longitude"), F.lit(w0), F.lit(nr0), F.lit(nc0))
    near = pending.select("deviceSn", F.explode(_block(q_row, q_col, F.lit(nc0))).alias("_cell")).select(
        "deviceSn", F.col("_cell.cr").alias("cr"), F.col("_cell.cc").alias("cc"))
    crowd = near.join(density, ["cr", "cc"]).groupBy("deviceSn").agg(F.sum("_c").alias("_crowd"))
    finer = F.ceil(F.log(4.0, F.greatest(F.col("_crowd") / TARGET_CANDIDATES, F.lit(1.0))))
    pending = pending.join(crowd, "deviceSn", "left").withColumn(
        "_lvl", F.greatest(F.lit(bottom), -F.coalesce(finer, F.lit(0))).cast("int")).drop("_crowd")
    pending = cut_lineage(pending)

    done: list[DataFrame] = []
    while True:
        present = [r[0] for r in pending.select("_lvl").distinct().collect()]  # a few level numbers
        if not present:
            break
        q = pending.join(levels, "_lvl")
        q_row, q_col = _cells(F.col("latitude"), F.col("longitude"), F.col("_w"), F.col("_nr"), F.col("_nc"))
        q = q.withColumns({"_row": q_row, "_col": q_col})
        q = q.withColumn("_guar", _guaranteed_km(F.col("latitude"), F.col("longitude"), F.col("_row"),
                                                 F.col("_col"), F.col("_w"), F.col("_nc")))
        q = q.withColumn("_cell", F.explode(_block(F.col("_row"), F.col("_col"), F.col("_nc")))).filter(
            (F.col("_cell.cr") >= 0) & (F.col("_cell.cr") < F.col("_nr")))
        q = q.select("*", F.col("_cell.cr").alias("cr"), F.col("_cell.cc").alias("cc")).drop("_cell")
        # training devices bucketed on every level in use (a generator over a short list)
        t = located.withColumn("_lvl", F.explode(F.array(*[F.lit(lvl) for lvl in present]))).join(levels, "_lvl")
        t_row, t_col = _cells(F.col("t_lat"), F.col("t_lon"), F.col("_w"), F.col("_nr"), F.col("_nc"))
        t = t.select("_lvl", t_row.alias("cr"), t_col.alias("cc"), "t_dev", "t_lat", "t_lon", "t_mean", "t_p90")
        pairs = q.join(t, ["_lvl", "cr", "cc"]).filter(F.col("t_dev") != F.col("deviceSn"))
        pairs = pairs.withColumn("distance", haversine_km(
            F.col("latitude"), F.col("longitude"), F.col("t_lat"), F.col("t_lon")))
        w = Window.partitionBy("deviceSn").orderBy(F.col("distance"), F.col("t_dev"))
        ranked = pairs.withColumns({
            "_rank": F.row_number().over(w),
            "_found": F.count(F.lit(1)).over(Window.partitionBy("deviceSn")),
        }).filter(F.col("_rank") <= K_MAX)
        ranked = cut_lineage(ranked)
        status = ranked.groupBy("deviceSn").agg(
            F.max("distance").alias("_kth"), F.first("_found").alias("_found"),
            F.first("_guar").alias("_guar"), F.first("_avail").alias("_avail"), F.first("_final").alias("_final"))
        ok = F.col("_final") | (F.col("_found") >= F.col("_avail")) | (
            (F.col("_found") >= K_MAX) & (F.col("_kth") < F.col("_guar")))
        accepted = status.filter(ok).select("deviceSn")
        done.append(ranked.join(accepted, "deviceSn", "left_semi").select(
            "deviceSn", "_rank", "distance", "t_dev", "t_mean", "t_p90"))
        # unresolved devices move one level coarser; past the top level nothing is left to find
        rest = pending.join(accepted, "deviceSn", "left_anti").withColumn("_lvl", F.col("_lvl") + 1)
        pending = cut_lineage(rest.filter(F.col("_lvl") <= top))

    cols = "deviceSn string, _rank int, distance double, t_dev string, t_mean double, t_p90 double"
    near = spark.createDataFrame([], cols)
    for part in done:
        near = near.unionByName(part)
    # training devices without coordinates have no distance: like NaN in a sort they come
    # after every located candidate, in name order. A device without coordinates sees
    # every training device that way. Either tail needs at most K_MAX + 1 names (bounded).
    found = near.groupBy("deviceSn").agg(F.count(F.lit(1)).alias("_f"))
    short = queries.join(found, "deviceSn", "left").fillna({"_f": 0}).filter(F.col("_f") < K_MAX)
    short = short.withColumn("_located", F.col("latitude").isNotNull() & F.col("longitude").isNotNull())
    tails = []
    for located_query, pool in ((True, train.filter(~has_loc)), (False, train)):
        names = first_n(pool, [F.col("t_dev")], K_MAX + 1, "_pos").select(
            "t_dev", "t_mean", "t_p90", "_pos", F.lit(located_query).alias("_located"))
        tail = short.filter(F.col("_located") == located_query).join(F.broadcast(names), "_located")
        tail = tail.filter(F.col("t_dev") != F.col("deviceSn"))
        tail = tail.withColumn("_rank", (F.col("_f") + F.row_number().over(
            Window.partitionBy("deviceSn").orderBy("_pos"))).cast("int"))
        tails.append(tail.select("deviceSn", "_rank", F.lit(None).cast("double").alias("distance"),
                                 "t_dev", "t_mean", "t_p90"))
    near = near.unionByName(tails[0]).unionByName(tails[1]).filter(F.col("_rank") <= K_MAX)
    # the only training device has no other candidate: it falls back to itself
    if n_train == 1:
        alone = queries.join(near.select("deviceSn").distinct(), "deviceSn", "left_anti").join(
            train.withColumnRenamed("t_dev", "deviceSn"), "deviceSn", "inner").select(
            "deviceSn", F.lit(1).alias("_rank"),
            F.when(F.col("t_lat").isNotNull() & F.col("t_lon").isNotNull(), F.lit(0.0)).alias("distance"),
            F.col("deviceSn").alias("t_dev"), "t_mean", "t_p90")
        near = near.unionByName(alone)
    return near
