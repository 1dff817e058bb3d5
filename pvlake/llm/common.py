"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pvlake.session import ensure_checkpoint_dir

#: Java / RE2 form of the white space that separates words.
WS = r"[\x20\x09-\x0D]+"


def on_workers(spark: SparkSession) -> SparkSession:
    """Let Python workers find this package where the driver has it (a cluster may ship it with ``--py-files`` instead)."""
    root = str(Path(__file__).resolve().parents[2])
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])
    return spark


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return on_workers(spark).read.parquet(f"{sf_dir}/documents.parquet")


def id_and_text(docs: DataFrame) -> DataFrame:
    """Only the two columns that operators read, so no other column's name can clash."""
    on_workers(docs.sparkSession)
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))


def whole_row(docs: DataFrame) -> Column:
    """All columns of ``docs`` as one struct, so no name of theirs can clash with an operator's own."""
    return F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in docs.columns])


def unpacked(rows: DataFrame, names: list[str], row: str = "row", **replaced: Column) -> DataFrame:
    """The columns ``names`` of the struct ``row``, some of them replaced."""
    return rows.select(*[replaced.get(c, F.col(row).getField(c)).alias(c) for c in names])


def whole_text() -> Column:
    return F.coalesce(F.col("text"), F.lit(""))


def store(df: DataFrame, name: str) -> DataFrame:
    """``materialize`` with stronger compression, for tables that hold texts."""
    spark = df.sparkSession
    base = ensure_checkpoint_dir(spark)
    path = f"{base}/tables/{name}-{uuid.uuid4().hex[:12]}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_buffers(batch: pa.RecordBatch, name: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, row offsets) without building Python strings; null counts as empty."""
    column = batch.column(batch.schema.get_field_index(name))
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    if len(offsets) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def sliced(batches: Iterable[pa.RecordBatch], limit: int = 16 << 20, name: str = "text") -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``limit`` text bytes (a longer text alone), so memory stays bounded."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        _, offsets = text_buffers(batch, name)
        start = 0
        while start < batch.num_rows:
            stop = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
            stop = max(start + 1, min(stop, batch.num_rows))
            yield batch.slice(start, stop - start)
            start = stop


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit finaliser (splitmix), element-wise."""
    z = x + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))
