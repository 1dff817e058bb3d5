"""Gradient boosting with losses MLlib's GBT lacks (M11 Huber, M12 Fair).

The training and validation rows are binned and written once (``models.trees``). Each round
grows one regression tree on the negative gradient of the loss, on a seeded share of the
training rows and of the columns at each node: a level is one pass over the blocks. The
trees of the running rounds go along with a pass; every few rounds their steps are added to
the score of each row, which is written with its block, and the mean losses are taken.
Boosting ends when that of the validation splits has not improved for ``patience`` rounds.
The published number of rounds is the maximum. All trees score every row of the feature
table in a single pass at the end.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pvlake.models import trees as T
from pvlake.models.gbt import assembled, vector
from pvlake.operators.quantiles import exact_quantiles
from pvlake.operators.splits import validation_mask


def negative_gradient(loss: str, r: np.ndarray, delta: float = 0.9, c: float = 1.0) -> np.ndarray:
    if loss == "huber":
        return np.clip(r, -delta, delta)
    if loss == "fair":
        return c * r / (np.abs(r) + c)
    if loss == "squared":
        return r
    raise ValueError(loss)


def loss_value(loss: str, r: Column | np.ndarray, delta: float = 0.9, c: float = 1.0) -> Column | np.ndarray:
    m = F if isinstance(r, Column) else np
    a = m.abs(r)
    if loss == "huber":
        small, large = r * r / 2, delta * (a - delta / 2)
        return F.when(a <= delta, small).otherwise(large) if m is F else np.where(a <= delta, small, large)
    if loss == "fair":
        return c * c * (a / c - m.log1p(a / c))
    if loss == "squared":
        return r * r / 2
    raise ValueError(loss)


@dataclass
class Boosted:
    """Trees with equal weight on top of ``init``; ``history`` has (round, training loss, validation loss)."""

    init: float
    rate: float
    trees: list[T.Tree]
    history: list[tuple] = field(default_factory=list)
    cuts: list[np.ndarray] = field(default_factory=list)

    def predict(self, rows: DataFrame, cols: list[str], out: str) -> DataFrame:
        """One pass over ``rows`` for all trees."""
        if not self.trees:
            return rows.withColumn(out, F.lit(self.init))
        total = T.sum_of(rows.sparkSession, self.trees, self.cuts)
        return rows.withColumn(out, self.init + self.rate * total(vector_to_array(vector(rows, cols))))


def stepped(data: T.Binned, trees: list[T.Tree], rate: float, label: str) -> T.Binned:
    """The blocks with the trees' steps added to their scores, written again."""
    width = data.width

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, codes, x in T.each_block(batches, width):
            score = x["_score"] + rate * sum(t.predict(codes) for t in trees)
            yield pa.RecordBatch.from_pydict({"block": pa.array([number], pa.int64()), "codes": [codes.tobytes()], label: [x[label].tobytes()],
                                              "_held": [x["_held"].tobytes()], "_score": [score.tobytes()]})

    return data.written(data.blocks.mapInArrow(add, data.blocks.schema), "boost_blocks")


def mean_losses(data: T.Binned, loss: str, label: str, delta: float, c: float) -> list[float | None]:
    """Mean loss of the training rows and of the validation rows."""
    width = data.width

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, x in T.each_block(batches, width):
            value, held = loss_value(loss, x[label] - x["_score"], delta, c), x["_held"] > 0
            yield pa.RecordBatch.from_pydict({"held": [False, True], "s": [value[~held].sum(), value[held].sum()], "n": [int((~held).sum()), int(held.sum())]})

    got = data.blocks.select("block", F.lit(b"").alias("codes"), label, "_held", "_score").mapInArrow(sums, "held boolean, s double, n long")
    mean = {r["held"]: r["s"] / r["n"] if r["n"] else None for r in got.groupBy("held").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).collect()}
    return [mean.get(False), mean.get(True)]


def boost(every: DataFrame, train_rows: Column, cols: list[str], label: str, loss: str = "huber",
          rounds: int = 700, learning_rate: float = 0.035, depth: int = 6, delta: float = 0.9, c: float = 1.0,
          min_instances: int = 30, row_share: float = 0.85, column_share: float = 0.85, seed: int = 42,
          checkpoint_every: int = 5, patience: int = 10, tol: float = 1e-4) -> Boosted:
    """Fitted on ``train_rows`` of ``every``; defaults are the published sizes."""
    rows = every.filter(F.col(label).isNotNull() & (train_rows | validation_mask())).withColumn("_held", ~train_rows)
    table = assembled(rows, cols, [label, "_held"], "boost_rows", partial(T.task_rows, rows.sparkSession))
    own = table.filter(~F.col("_held"))
    median = exact_quantiles(own, [], label, {"q": 0.5}) if loss == "huber" else own.agg(F.avg(label))
    out = Boosted(float(median.first()[0] or 0.0), learning_rate, [])
    data = T.bin_rows(table.withColumn("_score", F.lit(out.init)), [label, "_held", "_score"], "boost_blocks")
    out.cuts, k = data.cuts, math.ceil(column_share * data.width)
    best, best_at, new = None, 0, []

    def weigh(number: int, x: dict, codes: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        score = x["_score"] + learning_rate * sum(t.predict(codes) for t in new)
        kept = np.random.default_rng([seed, m, number]).random(len(codes)) < row_share
        return [((kept & (x["_held"] == 0)).astype(float), negative_gradient(loss, x[label] - score, delta, c))]

    for m in range(rounds):
        new.append(T.grow_over_blocks(data, weigh, depth, min_instances, k, seed, m))
        if (m + 1) % checkpoint_every:
            continue
        data = stepped(data, new, learning_rate, label)
        out.trees += new
        new = []
        fit_loss, held_loss = mean_losses(data, loss, label, delta, c)
        out.history.append((m + 1, fit_loss, held_loss))
        if held_loss is None:
            continue
        if best is None or best - held_loss > tol * max(held_loss, 0.01):
            best, best_at = held_loss, m + 1
        elif m + 1 - best_at >= patience:
            break
    out.trees += new
    if best is not None:
        out.trees = out.trees[:best_at]
    return out
