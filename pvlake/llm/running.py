"""Running totals inside groups of any size: no group has to fit into one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pvlake.session import materialize


def running(df: DataFrame, group: str, order: list[str], totals: dict, name: str) -> DataFrame:
    """``df`` with running totals (own row included) of each group in ascending ``order``.

    ``totals`` maps a new column to (aggregate function, column). Rows are dealt by range of
    (group, order) and written, so a large group lies in several parts. Each part is totalled alone;
    a group that meets several parts gets the total of its earlier ones. P parts have at most P - 1
    such borders, so that table has at most 2 P rows and may be broadcast. ``group`` holds no nulls;
    nulls in ``order`` come first.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    held = materialize(df.repartitionByRange(n, group, *order).withColumn("_part", F.spark_partition_id()), name)
    sums = held.groupBy(group, "_part").agg(*[f(c).alias(t) for t, (f, c) in totals.items()])
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    earlier = sums.select(
        group, "_part", F.count("*").over(Window.partitionBy(group)).alias("_parts"),
        *[F.coalesce(_merge(f)(t).over(before), F.lit(0)).alias(f"_e_{t}") for t, (f, _) in totals.items()]
    ).where("_parts > 1").drop("_parts")
    here = Window.partitionBy("_part", group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = held.withColumns({t: f(c).over(here) for t, (f, c) in totals.items()})
    out = out.join(F.broadcast(earlier), [group, "_part"], "left")
    return out.withColumns({t: _add(f, F.col(t), F.coalesce(f"_e_{t}", F.lit(0))) for t, (f, _) in totals.items()}).select(
        *df.columns, *totals)


def _merge(f):
    """The aggregate that joins totals of parts."""
    return F.sum if f is F.count else f


def _add(f, a, b):
    return a.bitwiseXOR(b) if f is F.bit_xor else a + b
