"""Point-telemetry views derived from the driver's tables.

``pv_points`` maps ``events`` to the 15-minute telemetry shape with column
arithmetic only (one narrow projection, no shuffle), so every downstream
operator runs over the whole table and its cost grows with it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _null_double():
    return F.lit(None).cast("double")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pv_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = read_table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "value")
    h, m = F.hour("ts"), F.minute("ts")
    uid, eid = F.col("user_id"), F.col("event_id")
    daylight = (h >= 3) & (h <= 20)
    date = F.date_format(F.col("ts"), "yyyy-MM-dd")
    altitude = 60 - 6 * F.abs(h + m / 60.0 - 12)
    return ev.select(
        eid.alias("row_id"),
        F.col("ts").alias("us_timestamp"),
        date.alias("date"),
        F.concat(
            F.lit("EP"), F.lpad(F.expr("user_id div 10").cast("string"), 7, "0"),
            F.lit("U"), F.lpad(uid.cast("string"), 5, "0"),
        ).alias("deviceSn"),
        F.when(uid % 10 == 9, "test2")
        .when((uid % 2 == 0) & (date >= "2024-01-24"), "test1")
        .otherwise("train").alias("split"),
        F.when(daylight, F.col("value") / 400.0).otherwise(0.0).alias("pvGenTotal"),
        (25.0 + (uid * 37 % 2000) / 100.0).alias("latitude"),
        (-80.0 - (uid * 53 % 4000) / 100.0).alias("longitude"),
        altitude.cast("double").alias("altitude"),
        (90 - altitude).cast("double").alias("zenith_angle"),
        (15.0 * h).alias("azimuth"),
        F.when(daylight, 1.0).otherwise(0.0).alias("is_day"),
        F.when(eid % 11 == 0, _null_double()).otherwise((eid * 7 % 900).cast("double"))
        .alias("global_tilted_irradiance_instant"),
        F.when(eid % 13 == 0, _null_double()).otherwise((eid * 3 % 800 - 20).cast("double"))
        .alias("shortwave_radiation"),
        F.when(eid % 17 == 0, _null_double()).otherwise((eid * 13 % 130 - 10).cast("double"))
        .alias("cloud_cover_H"),
        (eid % 25 + 0.5).alias("temperature_2m"),
        (eid % 4).cast("double").alias("rain"),
        _null_double().alias("empty_weather"),
    )


def supplier_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second, larger telemetry shape: (supplier, ship day) as device-day, quantity as label.

    Used for scale runs of the same operators; geometry columns are arithmetic
    on the row keys so the feature code paths are exercised.
    """
    li = read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_shipdate", "l_returnflag")
    ts = F.col("l_shipdate").cast("timestamp_ntz") + F.make_dt_interval(
        F.lit(0), (F.col("l_orderkey") % 24).cast("int"), (F.col("l_linenumber") * 15 % 60).cast("int"))
    h = F.hour(ts)
    altitude = 60 - 6 * F.abs(h + F.minute(ts) / 60.0 - 12)
    sk = F.col("l_suppkey")
    return li.select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("row_id"),
        ts.alias("us_timestamp"),
        F.date_format(ts, "yyyy-MM-dd").alias("date"),
        F.concat(F.lit("EP"), F.lpad((sk % 1000).cast("string"), 7, "0"), F.lit("S"),
                 F.lpad(sk.cast("string"), 6, "0")).alias("deviceSn"),
        F.when(F.col("l_returnflag") == "R", "test1")
        .when(sk % 10 == 9, "test2").otherwise("train").alias("split"),
        (F.col("l_quantity") / 50.0).alias("pvGenTotal"),
        (20.0 + (sk * 37 % 3000) / 100.0).alias("latitude"),
        (-70.0 - (sk * 53 % 5000) / 100.0).alias("longitude"),
        altitude.cast("double").alias("altitude"),
        (90 - altitude).cast("double").alias("zenith_angle"),
        (15.0 * h).alias("azimuth"),
        F.when((h >= 3) & (h <= 20), 1.0).otherwise(0.0).alias("is_day"),
        (F.col("l_orderkey") * 7 % 900).cast("double").alias("global_tilted_irradiance_instant"),
        (F.col("l_orderkey") * 13 % 130 - 10).cast("double").alias("cloud_cover_H"),
        (F.col("l_orderkey") % 25 + 0.5).alias("temperature_2m"),
    )
