"""Order-based positions without funnelling a table through one task.

``ordinal_position`` gives every row its 0-based index in a total order:
range-partition on the order keys, number rows inside each partition, and add
the row count of all earlier partitions (a table with one row per partition,
broadcast). The result is checkpointed so the indices stay fixed even when a
stage is recomputed after an executor loss.

``first_n`` is the bounded top-n: TakeOrderedAndProject keeps n rows per
partition, then merges; only n rows ever meet in one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pvlake.session import cut_lineage

_LOCAL_BITS = 33


def ordinal_position(df: DataFrame, order: list[Column], name: str = "pos",
                     partitions: int | None = None) -> DataFrame:
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    tagged = cut_lineage(ranged.withColumn("_mid", F.monotonically_increasing_id()))
    tagged = tagged.withColumns({
        "_pid": F.shiftright(F.col("_mid"), _LOCAL_BITS),
        "_local": F.col("_mid").bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1)),
    })
    sizes = tagged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    offsets = sizes.select(
        "_pid",
        F.coalesce(
            F.sum("_n").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)),
            F.lit(0),
        ).alias("_off"),
    )
    # one row per partition: bounded by the partition count
    return (
        tagged.join(F.broadcast(offsets), "_pid")
        .withColumn(name, F.col("_off") + F.col("_local"))
        .drop("_mid", "_pid", "_local", "_off")
    )


def first_n(df: DataFrame, order: list[Column], n: int, name: str = "pos") -> DataFrame:
    """The first ``n`` rows in ``order`` with their 0-based position (n is small and fixed)."""
    top = df.orderBy(*order).limit(n)
    return top.withColumn(name, F.row_number().over(Window.orderBy(*order)) - 1)
