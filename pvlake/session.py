"""SparkSession construction and lineage helpers."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "pvlake") -> SparkSession:
    """Session for local runs and tests. On a cluster use the provided session."""
    cpus = os.environ.get("BENCH_CPUS", "8")
    master = master or f"local[{cpus}]"
    parts = shuffle_partitions or int(cpus)
    spark = (
        SparkSession.builder.master(master)
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")

        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the cluster's shared ``spark.checkpoint.dir``.

    Only a local-mode session (tests, single machine) without one gets a
    temporary folder; on a cluster a machine-local folder would not survive an
    executor loss, so a missing setting is an error there.
    """
    sc = spark.sparkContext
    configured = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(configured)
        return configured
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder (HDFS / object store) for cluster runs")
    local = tempfile.mkdtemp(prefix="pvlake-ckpt-")
    sc.setCheckpointDir(local)
    return local


#: Bytecodes of a method that the JVM still compiles; Spark's own limit is the largest method it can load.
COMPILED_METHOD = 8000


def compiled_stages(spark: SparkSession) -> None:
    """Let stages whose generated method the JVM would only interpret (tables of many columns) run as
    separate, compiled projections instead. A limit that somebody set is left alone."""
    if spark.conf.get("spark.sql.codegen.hugeMethodLimit", "65535") == "65535":
        spark.conf.set("spark.sql.codegen.hugeMethodLimit", str(COMPILED_METHOD))


def drop_materialized(spark: SparkSession) -> None:
    """Delete the tables this application wrote under the checkpoint folder (call when done)."""
    base = spark.sparkContext.getCheckpointDir()
    if not base:
        return
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{base}/tables")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(path):
        fs.delete(path, True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder (survives executor loss)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def materialize(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` as parquet under the shared checkpoint folder and read it back.

    Used for tables that many later stages read: the plan is cut (short
    lineage, fast analysis), later scans get column pruning and filter
    pushdown, and nothing is recomputed after an executor loss.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    base = spark.sparkContext.getCheckpointDir()
    path = f"{base}/tables/{name}-{uuid.uuid4().hex[:12]}"
    writer = df.write.mode("overwrite")
    if partition_by:  # folder pruning for later filters on these columns
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    out = spark.read.parquet(path)
    return out.select(*df.columns) if partition_by else out


#: Rows of a written per-device table that go to every executor (some ten MB) rather than that points are shuffled.
SENT_ROWS = 500_000


def sent_if_small(table: DataFrame) -> DataFrame:
    """``table`` (written, so counting is cheap) for a join: broadcast up to ``SENT_ROWS`` rows, else as the planner likes."""
    return F.broadcast(table) if table.count() <= SENT_ROWS else table
