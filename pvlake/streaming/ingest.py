"""Incremental ingest of telemetry CSV files with Structured Streaming.

A CSV file-source stream notices new ``<split>/<device>/<date>.csv`` files;
``foreachBatch`` parses the micro-batch's records like the batch reader (so header
drift is handled exactly as in batch mode) and overwrites the folder of its batch
id in a parquet table. A batch that runs again replaces its own rows, so replay
does not ingest a file twice; ``availableNow`` processes whatever has landed and
stops.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pvlake.sources.telemetry_csv import parse_records, records


def _write_batch(out_path: str):
    def run(batch: DataFrame, batch_id: int) -> None:
        rows = parse_records(batch)
        if rows is not None:
            rows.write.mode("overwrite").partitionBy("split").parquet(f"{out_path}/ingest_batch={batch_id}")
    return run


def start_ingest(spark: SparkSession, root: str, out_path: str, checkpoint: str,
                 max_files_per_trigger: int = 10_000, available_now: bool = True):
    reader = spark.readStream.option("maxFilesPerTrigger", max_files_per_trigger)
    rows = records(reader, f"{root.rstrip('/')}/*/*/*.csv")
    writer = rows.writeStream.foreachBatch(_write_batch(out_path)).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    return writer.start()
