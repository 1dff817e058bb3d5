"""Error metrics (E1-E6) at point and device-day grain.

For many prediction columns the aggregates of every column are built into
one ``groupBy(eval_split)`` (one pass over points) and one pass over the
device-day table, instead of one evaluation per column and split.
Missing labels are skipped at point grain (numpy would give NaN).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pvlake import config as C

D = ["deviceSn", "date"]
METRICS = ("mae", "rmse", "mape", "daily_mae", "daily_rmse", "daily_mape")


def ape(y: Column, p: Column) -> Column:
    return F.abs(y - p) / F.greatest(F.abs(y), F.lit(C.METRIC_EPS))
