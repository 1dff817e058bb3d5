"""Medians of columns that are mostly constant within their key.

A column copied from a device (its place, its history, its neighbours) has one
value within a device-day, and then the median is that value. So a key's least and
greatest value are taken in the aggregate that runs anyway; an exact median is taken in
a second pass only for the keys where they differ, over those keys' rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pvlake.functions.columns import quantile


def extents(cols: list[str]) -> list[Column]:
    """Aggregates that ``settle`` needs beside a key's own ones."""
    return [f(c).alias(f"_{n}_{c}") for c in cols for n, f in (("lo", F.min), ("hi", F.max))]


def settle(grouped: DataFrame, points: DataFrame, keys: list[str], cols: dict[str, str], approx: bool = False) -> DataFrame:
    """``grouped`` (a written table) with each column's median under its output name; ``cols`` maps output to column."""
    lo = {c: F.col(f"_lo_{c}") for c in cols.values()}
    differs = reduce(lambda a, b: a | b, [F.coalesce(lo[c] != F.col(f"_hi_{c}"), F.lit(False)) for c in cols.values()])
    drop = [f"_{n}_{c}" for c in cols.values() for n in ("lo", "hi")]
    varying = grouped.filter(differs).select(*keys)
    if not varying.limit(1).count():
        return grouped.withColumns({out: lo[c] for out, c in cols.items()}).drop(*drop)
    medians = points.join(varying, keys, "left_semi").groupBy(*keys).agg(
        *[quantile(F.col(c), 0.5, approx).alias(f"_m_{out}") for out, c in cols.items()], F.lit(True).alias("_varying"))
    out = grouped.join(medians, keys, "left")
    return out.withColumns({o: F.when(F.col("_varying"), F.col(f"_m_{o}")).otherwise(lo[c]) for o, c in cols.items()}).drop(
        *drop, *[f"_m_{o}" for o in cols], "_varying")
