"""Output projection shared by a Spark query and its SQL restatement.

A spec is ``"name:kind, ..."`` with kind d (double, rounded), l (bigint),
s (string), t (timestamp). Both sides end in the same projection, so names,
types and rounding agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIGITS = 6
SCALE = "1e6"
# ties at the 7th decimal are common (means of 6-decimal labels) and 1-ulp
# summation noise would split them; a biased floor puts them in the same bucket
BIAS = "0.5001"


def rounded(c):
    """Same double on both engines: floor(x * 1e6 + 0.5001) / 1e6 (NULL/NaN kept)."""
    x = c.cast("double")
    return F.when(F.isnan(x), x).otherwise(F.floor(x * 1e6 + 0.5001).cast("double") / 1e6)


def parse(spec: str) -> list[tuple[str, str]]:
    out = []
    for item in spec.replace("\n", " ").split(","):
        item = item.strip()
        if item:
            name, kind = item.split(":")
            out.append((name.strip(), kind.strip()))
    return out


def spark_project(df: DataFrame, spec: str) -> DataFrame:
    cols = []
    for name, kind in parse(spec):
        c = F.col(name)
        if kind == "d":
            cols.append(rounded(c).alias(name))
        elif kind == "l":
            cols.append(c.cast("bigint").alias(name))
        elif kind == "s":
            cols.append(c.cast("string").alias(name))
        else:
            cols.append(c.alias(name))
    return df.select(*cols)


def sql_project(source: str, spec: str) -> str:
    cols = []
    for name, kind in parse(spec):
        q = f'"{name}"'
        if kind == "d":
            cols.append(f"floor(CAST({q} AS DOUBLE) * {SCALE} + {BIAS}) / {SCALE} AS {q}")
        elif kind == "l":
            cols.append(f"CAST({q} AS BIGINT) AS {q}")
        elif kind == "s":
            cols.append(f"CAST({q} AS VARCHAR) AS {q}")
        else:
            cols.append(q)
    return f"SELECT {', '.join(cols)} FROM {source}"


def doubles(*names: str) -> str:
    return ", ".join(f"{n}:d" for n in names)
