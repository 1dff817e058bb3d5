"""Column expressions (JVM-side, whole-stage codegen; no Python UDFs).

Each helper returns a ``Column`` or adds columns with ``withColumns`` so the
optimizer sees one projection per feature group.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from pvlake import config as C

TWO_PI = 2.0 * math.pi


def nan_to_null(c: Column) -> Column:
    """pandas treats NaN as missing; Spark NaN poisons sum/avg/max, so map it to NULL."""
    return F.when(F.isnan(c), F.lit(None).cast("double")).otherwise(c)


def to_number(c: Column) -> Column:
    """Coerce to double; unparsable text and NaN become NULL."""
    return nan_to_null(c.try_cast("double"))


def sanitize(pred: Column, is_solar_available: Column | None = None,
             solar_proxy: Column | None = None) -> Column:
    """Missing -> 0, clip at 0, zero when the sun is off."""
    avail = F.col("is_solar_available") if is_solar_available is None else is_solar_available
    proxy = F.col("solar_proxy") if solar_proxy is None else solar_proxy
    off = F.coalesce((avail <= 0) | (proxy <= C.SOLAR_OFF_CUT), F.lit(False))
    return F.when(off, F.lit(0.0)).otherwise(F.greatest(F.coalesce(pred, F.lit(0.0)), F.lit(0.0)))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance; argument of asin clamped to 1 against rounding."""
    phi1, phi2 = F.radians(lat1), F.radians(lat2)
    dphi = F.radians(lat2 - lat1)
    dlam = F.radians(lon2 - lon1)
    a = F.pow(F.sin(dphi / 2), 2) + F.cos(phi1) * F.cos(phi2) * F.pow(F.sin(dlam / 2), 2)
    return 2.0 * C.EARTH_RADIUS_KM * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def time_features(df: DataFrame, ts_col: str = "us_timestamp") -> DataFrame:
    """Calendar parts, slot, weekend flag, cyclic encodings."""
    ts = F.col(ts_col)
    hour = F.hour(ts).cast("double")
    minute = F.minute(ts).cast("double")
    df = df.withColumns({
        "hour": hour,
        "minute": minute,
        "slot_id": hour * 4 + F.floor(minute / 15).cast("double"),
        "day_of_year": F.dayofyear(ts).cast("double"),
        "month": F.month(ts).cast("double"),
        "weekday": F.weekday(ts).cast("double"),
    })
    return df.withColumns({
        "is_weekend": F.coalesce(F.col("weekday") >= 5, F.lit(False)).cast("double"),
        "sin_hour": F.sin(TWO_PI * F.col("hour") / 24),
        "cos_hour": F.cos(TWO_PI * F.col("hour") / 24),
        "sin_slot": F.sin(TWO_PI * F.col("slot_id") / 96),
        "cos_slot": F.cos(TWO_PI * F.col("slot_id") / 96),
        "sin_doy": F.sin(TWO_PI * F.col("day_of_year") / 365),
        "cos_doy": F.cos(TWO_PI * F.col("day_of_year") / 365),
    })


def coerce_physics(df: DataFrame) -> DataFrame:
    """F1 on the solar/irradiance columns that are present."""
    present = [c for c in C.PHYSICS_NUMERIC if c in df.columns]
    return df.withColumns({c: to_number(F.col(c)) for c in present}) if present else df


def physics_features(df: DataFrame, cloud_median: Column | None) -> DataFrame:
    """F6-F10. ``cloud_median`` is a scalar Column (global median of cloud_cover_H)."""
    df = coerce_physics(df)
    cols = set(df.columns)
    altitude = F.coalesce(F.col("altitude"), F.lit(0.0)) if "altitude" in cols else F.lit(0.0)
    zenith = F.coalesce(F.col("zenith_angle"), F.lit(90.0)) if "zenith_angle" in cols else F.lit(90.0)
    azimuth = F.coalesce(F.col("azimuth"), F.lit(0.0)) if "azimuth" in cols else F.lit(0.0)
    available = [c for c in C.RADIATION_CANDIDATES if c in cols]
    if len(available) >= 2:
        radiation = F.greatest(*[F.col(c) for c in available])
    elif available:
        radiation = F.col(available[0])
    else:
        radiation = F.lit(0.0)
    df = df.withColumns({
        "altitude_pos": F.greatest(altitude, F.lit(0.0)),
        "elevation_weight": F.greatest(F.sin(F.radians(altitude)), F.lit(0.0)),
        "zenith_cos": F.greatest(F.cos(F.radians(zenith)), F.lit(0.0)),
        "azimuth_sin": F.sin(F.radians(azimuth)),
        "azimuth_cos": F.cos(F.radians(azimuth)),
        "radiation_proxy": F.greatest(F.coalesce(radiation, F.lit(0.0)), F.lit(0.0)),
    })
    df = df.withColumn("solar_proxy", F.col("radiation_proxy") * F.col("elevation_weight"))
    if "cloud_cover_H" in cols:
        cloud = F.coalesce(F.col("cloud_cover_H"), cloud_median)
        cloud_adj = F.col("radiation_proxy") * (1 - F.least(F.greatest(cloud, F.lit(0.0)), F.lit(100.0)) / 100)
    else:
        cloud_adj = F.col("radiation_proxy")
    is_day = F.coalesce(F.col("is_day"), F.lit(1.0)) if "is_day" in cols else F.lit(1.0)
    return df.withColumns({
        "radiation_cloud_adjusted": cloud_adj,
        "radiation_x_elevation": F.col("radiation_proxy") * F.col("elevation_weight"),
        "is_solar_available": F.coalesce(
            (F.col("solar_proxy") > C.SOLAR_AVAILABLE_CUT) & (is_day > 0), F.lit(False)
        ).cast("double"),
    })


def _text_or_nan(c: Column) -> Column:
    return F.when(c.isNull(), F.lit("nan")).otherwise(c.cast("string"))


def spatial_features(df: DataFrame) -> DataFrame:
    """Rounding (half-even), grid cells, location bin, device family code."""
    df = df.withColumns({"latitude": to_number(F.col("latitude")), "longitude": to_number(F.col("longitude"))})
    lat, lon = F.col("latitude"), F.col("longitude")
    family = F.regexp_extract(F.col("deviceSn").cast("string"), r"EP(\d{7})", 1)
    return df.withColumns({
        "lat_round_1": F.bround(lat, 1),
        "lon_round_1": F.bround(lon, 1),
        "region_lat_5": F.floor(lat / 5).cast("double") * 5,
        "region_lon_5": F.floor(lon / 5).cast("double") * 5,
        "region_lat_10": F.floor(lat / 10).cast("double") * 10,
        "region_lon_10": F.floor(lon / 10).cast("double") * 10,
        "lat_lon_bin": F.concat(_text_or_nan(F.bround(lat, 1)), F.lit("_"), _text_or_nan(F.bround(lon, 1))),
        "device_family_code": F.coalesce(F.nullif(family, F.lit("")).try_cast("double"), F.lit(-1.0)),
    })


def quantile(c: Column | str, p: float, approx: bool = False, accuracy: int = 100_000,
             frequency: Column | None = None) -> Column:
    """Linear-interpolated quantile (pandas parity) or the approximate sketch."""
    col = F.col(c) if isinstance(c, str) else c
    if approx:
        return F.percentile_approx(col, F.lit(p), F.lit(accuracy))
    if frequency is not None:
        return F.percentile(col, F.lit(p), frequency)
    return F.percentile(col, F.lit(p))
