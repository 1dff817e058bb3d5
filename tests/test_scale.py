"""What a query writes and moves follows the size of its tables."""
import datetime
from pathlib import Path

from pyspark.sql import functions as F

from pvlake.plans import registry


def events(spark, path, users, days=2):
    """A few events for each of ``users`` and for nobody."""
    at = datetime.datetime(2024, 1, 1, 10)
    rows = [(i * days + d, at + datetime.timedelta(days=20 * d, minutes=15 * (i % 8)), u, "x", float(i % 40 + d), None)
            for i, u in enumerate([*users, None]) for d in range(days)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").coalesce(1).write.mode(
        "overwrite").parquet(f"{path}/events.parquet")
    return str(path)


def test_csv_files_do_not_grow_with_devices(spark, tmp_path, monkeypatch):
    counts = {}
    for n in (20, 400):
        root = tmp_path / f"csv{n}"
        monkeypatch.setattr(registry, "_scratch", lambda spark, name, root=root: str(root))
        sf = events(spark, tmp_path / f"sf{n}", range(n))
        got = registry.REGISTRY["csv_roundtrip"].build(spark, sf)
        rows = got.select("row_id", "deviceSn", "date", "split").collect()
        want = registry.ctx(spark, sf).points.select("row_id", "deviceSn", "date", "split").fillna("__HIVE_DEFAULT_PARTITION__", ["deviceSn"]).collect()
        assert sorted(rows, key=lambda r: r.row_id) == sorted(want, key=lambda r: r.row_id)
        counts[n] = len(list(Path(root).rglob("*.csv")))
    assert counts[20] == counts[400], counts
    assert got.filter((F.col("row_id") % 2 == 0) & F.col("temperature_2m").isNotNull()).count() == 0


def test_wide_stages_are_compiled(spark, tmp_path):
    """A context asks Spark not to run generated methods that the JVM refuses to compile; a limit that is set stays."""
    from pvlake.plans.context import LabelContext, RunContext

    name = "spark.sql.codegen.hugeMethodLimit"
    for make in (lambda p: RunContext(spark, p), lambda p: LabelContext.get(spark, p)):
        spark.conf.unset(name)
        make(str(tmp_path / "none"))
        assert int(spark.conf.get(name)) <= 8000
        spark.conf.set(name, "5000")
        make(str(tmp_path / "other"))
        assert spark.conf.get(name) == "5000"
    spark.conf.unset(name)
