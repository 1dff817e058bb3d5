"""Non-negative ridge stacking of daily candidate predictions.

Median imputation and standardisation statistics, the p x p Gram matrix of
the standardised inputs and their product with the centred target are each
one aggregate over the training days (p <= 12, so the result is a few hundred
numbers). The tiny non-negative ridge problem is solved on the driver by
active sets; scoring is a Column expression over all days.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pvlake.operators.quantiles import exact_quantiles


def nonneg_ridge(gram: np.ndarray, xty: np.ndarray, alpha: float) -> np.ndarray:
    """argmin_w ||y - Xw||^2 + alpha ||w||^2 subject to w >= 0, given X'X and X'y.

    Active sets: free the weight with the steepest descent, solve the free ones exactly, and put back to zero
    the first one that would turn negative on the way. Ends at the optimum after finitely many sets, however collinear the inputs."""
    p = len(xty)
    q = gram + alpha * np.eye(p)
    w, free = np.zeros(p), np.zeros(p, bool)
    tol = 1e-12 * max(1.0, float(np.abs(xty).max(initial=0.0)))
    while True:
        down = np.where(free, -np.inf, xty - q @ w)
        if free.all() or down.max() <= tol:
            return w
        free[int(down.argmax())] = True
        while True:
            to = np.zeros(p)
            to[free] = np.linalg.solve(q[np.ix_(free, free)], xty[free])
            bad = free & (to <= 0)
            if not bad.any():
                w = to
                break
            step = np.where(bad, w / np.where(bad, w - to, 1.0), np.inf)
            w = w + max(0.0, float(step.min())) * (to - w)
            free &= ~(bad & (step <= step.min()))
            w[~free] = 0.0


def fit_stacking(days: DataFrame, pred_cols: list[str], target: str, train_rows: Column,
                 alpha: float = 0.1, out: str = "stacked_daily_pred") -> tuple[dict, DataFrame]:
    train = days.filter(train_rows)
    long = train.select(*pred_cols).unpivot([], list(pred_cols), "name", "value")
    med = {c: 0.0 for c in pred_cols} | {  # one row per prediction column
        r["name"]: r["m"] for r in exact_quantiles(long, ["name"], "value", {"m": 0.5}).collect()}
    filled = {c: F.coalesce(F.col(c), F.lit(float(med[c] or 0.0))) for c in pred_cols}
    stats = train.select(*[v.alias(k) for k, v in filled.items()], F.col(target)).agg(
        *[F.avg(c).alias(f"m_{c}") for c in pred_cols],
        *[F.stddev_pop(c).alias(f"s_{c}") for c in pred_cols],
        F.avg(target).alias("y_mean")).first().asDict()
    scale = {c: (stats[f"s_{c}"] or 0.0) or 1.0 for c in pred_cols}
    z = {c: (filled[c] - stats[f"m_{c}"]) / scale[c] for c in pred_cols}
    yc = F.col(target) - stats["y_mean"]
    p = len(pred_cols)
    sums = train.agg(
        *[F.sum(z[a] * z[b]).alias(f"g_{i}_{j}") for i, a in enumerate(pred_cols)
          for j, b in enumerate(pred_cols) if j >= i],
        *[F.sum(z[a] * yc).alias(f"r_{i}") for i, a in enumerate(pred_cols)]).first().asDict()
    gram = np.zeros((p, p))
    for i in range(p):
        for j in range(i, p):
            gram[i, j] = gram[j, i] = sums[f"g_{i}_{j}"] or 0.0
    xty = np.array([sums[f"r_{i}"] or 0.0 for i in range(p)])
    w = nonneg_ridge(gram, xty, alpha)
    score = F.lit(float(stats["y_mean"]))
    for c, wc in zip(pred_cols, w):
        score = score + float(wc) * z[c]
    model = {"coef": dict(zip(pred_cols, w.tolist())), "intercept": stats["y_mean"], "alpha": alpha,
             "names": list(pred_cols), "weights": w, "gram": gram, "xty": xty}
    return model, days.withColumn(out, F.greatest(score, F.lit(0.0)))


def fit_conditions(spark, model: dict, tol: float = 1e-6) -> DataFrame:
    """The normal equations of a fit and whether its weights solve them: (a, b, value, optimal).

    Rows (a, b) hold the Gram matrix (a <= b) and rows (a, 'target') X'y. A non-negative ridge fit is optimal exactly when
    the gradient (G + alpha I) w - X'y is zero for each positive weight and not negative for each zero weight."""
    names, w, gram, xty = model["names"], model["weights"], model["gram"], model["xty"]
    gradient = gram @ w + model["alpha"] * w - xty
    slack = tol * max(1.0, float(np.abs(xty).max()))
    optimal = np.where(w > 0, np.abs(gradient) <= slack, gradient >= -slack)
    rows = [(*sorted((a, b)), float(gram[i, j]), None) for i, a in enumerate(names) for j, b in enumerate(names) if j >= i]
    rows += [(a, "target", float(xty[i]), bool(optimal[i])) for i, a in enumerate(names)]
    return spark.createDataFrame(rows, "a string, b string, value double, optimal boolean")
