"""Partitioned CSV telemetry (S1-S4), device-day sampling (S5), read-back.

Layout ``root/{train,test1,test2}/<deviceSn>/<YYYY-MM-DD>.csv``: split, device
and date come from the path (``_metadata.file_path``), not from Hive-style
``key=value`` folders, so there is no partition discovery. Files may carry
different column sets (header drift): the reader binds every record to its own file's header in the
scan itself (one variant value a record, keyed by column name), so quoted commas,
quoted line breaks and byte-order marks are the CSV parser's business and no line is
moved, joined or written again. Only the distinct column lists reach the driver.
A file is a device-day and is read by one task. The date is the file's name, whatever a
``date`` column says (but for ``split=`` folders written by Spark, whose ``date=`` folders or files carry it); a file without ``us_timestamp`` keeps its rows with a missing timestamp.
Values are coerced (bad numbers / timestamps -> NULL). The reader recognises numbers and
timestamps, so a device name that is a number loses leading zeros, as in the published loader;
timestamps are read and kept in the session's time zone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pvlake import config as C
from pvlake.functions.columns import to_number

TEXT_COLUMNS = {"deviceSn", "date_H", "split", "date"}
RECORD_OPTIONS = {"header": True, "multiLine": True, "escape": '"', "singleVariantColumn": "record"}


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def list_csv_globs(spark: SparkSession, root: str) -> list[str]:
    """One glob per split folder that exists (absent splits are skipped)."""
    root = root.rstrip("/")
    out = []
    for s in C.SOURCE_SPLITS:
        for folder in (s, f"split={s}"):  # published folders, or those that partitionBy writes from split and a second column
            if path_exists(spark, f"{root}/{folder}"):
                out.append(f"{root}/{folder}/*/*.csv")
    return out


def records(reader, paths) -> DataFrame:
    """(record, path) of every data record; works for a batch and a stream reader."""
    return reader.format("csv").options(**RECORD_OPTIONS).load(paths).select("record", F.col("_metadata.file_path").alias("path"))


def column_names(rows: DataFrame) -> list[str]:
    """Every column name of the records: one pass that sends a row per distinct column list and task."""
    lists = rows.select(F.expr("json_object_keys(to_json(record))").alias("names")).distinct()
    return sorted({n for r in lists.collect() for n in r["names"] or []})


def field(name: str) -> Column:
    """A record's value as text; NULL where its file has no such column."""
    quote = "'" if '"' in name else '"'
    return F.try_variant_get("record", f"$[{quote}{name}{quote}]", "string")


def _coerce(df: DataFrame) -> DataFrame:
    cols = {}
    for name in df.columns:
        if name == "us_timestamp":
            cols[name] = F.col(name).try_cast("timestamp_ntz")
        elif name not in TEXT_COLUMNS and not name.startswith("_"):
            cols[name] = to_number(F.col(name))
    return df.withColumns(cols)


def parse_records(rows: DataFrame, names: list[str] | None = None) -> DataFrame | None:
    """Records as columns; split, date and (in files without it) deviceSn come from the path. None without a record.

    ``names``: the columns to read, which saves the pass that finds them.
    """
    names = column_names(rows) if names is None else list(names)
    if not names:
        return None
    parts = F.split(F.col("path"), "/")
    stem = F.regexp_replace(F.element_at(parts, -1), r"\.csv$", "")
    named = lambda key: F.nullif(F.regexp_extract("path", f"/{key}=([^/]+)/", 1), F.lit(""))
    folder = F.coalesce(named("deviceSn"), F.element_at(parts, -2))
    # files that Spark wrote have no date in their name; in the published layout only the name counts
    written = F.when(named("split").isNotNull(), F.try_to_date(field("date")))
    own_date = written if "date" in names else F.try_to_date(named("date"))
    from_path = {
        "split": F.coalesce(named("split"), F.element_at(parts, -3)),
        "date": F.date_format(F.coalesce(F.try_to_date(stem), own_date), "yyyy-MM-dd"),
        "deviceSn": F.when(F.expr("array_contains(json_object_keys(to_json(record)), 'deviceSn')"), field("deviceSn")).otherwise(folder)
        if "deviceSn" in names else folder,
    }
    own = [field(n).alias(n) for n in names if n not in from_path]
    if "us_timestamp" not in names:
        own.append(F.lit(None).cast("string").alias("us_timestamp"))
    return _coerce(rows.select(*own, *[c.alias(n) for n, c in from_path.items()]))


def load_point_data(spark: SparkSession, root: str) -> DataFrame:
    """S3: every CSV of the existing splits, unioned by name; error when there is none."""
    globs = list_csv_globs(spark, root)
    rows = parse_records(records(spark.read, globs)) if globs else None
    if rows is None:
        raise FileNotFoundError(f"No csv files found under {root}")
    return rows


def sample_device_days(points: DataFrame, fraction: float, seed: int = 42,
                       keys: tuple[str, ...] = ("split", "deviceSn", "date")) -> DataFrame:
    """Keep whole device-days with probability ``fraction`` (deterministic hash, no shuffle)."""
    name = F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys], F.lit(str(seed)))
    bucket = F.conv(F.substring(F.md5(name.cast("binary")), 1, 8), 16, 10).cast("long") % 1_000_000
    return points.filter(bucket < F.lit(int(round(fraction * 1_000_000))))


def read_predictions(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Scored points written by the prediction sink."""
    if fmt == "csv":
        df = spark.read.option("header", True).csv(path)
        return _coerce(df)
    return spark.read.parquet(path)

