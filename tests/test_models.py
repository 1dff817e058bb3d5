"""Boosted fits: they stop on the validation splits, grow where there is signal, and lose less per round."""
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pvlake.models import gbt
from pvlake.models.boosting import boost, loss_value
from pvlake.operators.splits import train_mask


@pytest.fixture(scope="module")
def signal(spark):
    """A learnable label: a step and a product of two features, a few outliers, three splits of equal law."""
    rng = np.random.default_rng(8)
    x = rng.uniform(-1, 1, size=(1500, 4))
    y = 2.0 * (x[:, 0] > 0.2) + x[:, 1] * x[:, 2] + rng.normal(size=1500) * 0.05
    part = np.array(["train", "valid_seen", "valid_unseen"])[np.minimum(rng.integers(0, 5, 1500) // 3 * rng.integers(1, 3, 1500), 2)]
    y = np.where((part == "train") & (rng.random(1500) < 0.02), y + 20, y)
    rows = pd.DataFrame(x, columns=list("abcd")).assign(y=y, eval_split=part, split="train")
    return spark.createDataFrame(rows).repartition(3)


def mean_error(df, pred, split="valid_seen"):
    return df.filter(F.col("eval_split") == split).agg(F.avg(F.abs(F.col(pred) - F.col("y")))).first()[0]


def test_fit_stops_on_validation_and_learns(signal):
    clean = signal.filter("y < 10")
    cfg = gbt.GbtConfig(point_trees=60, point_step=0.1, max_depth=3)
    model = gbt.fit(clean, train_mask(), list("abcd"), "y", gbt.gbt(cfg, "y", "p"))
    one = gbt.fit(clean, train_mask(), list("abcd"), "y", gbt.gbt(gbt.GbtConfig(point_trees=1, max_depth=3), "y", "p"))
    assert 10 < model.getNumTrees <= 60, model.getNumTrees
    assert mean_error(gbt.predict(model, clean, list("abcd")), "p") < 0.9 * mean_error(gbt.predict(one, clean, list("abcd")), "p")
    noise = clean.withColumn("y", F.rand(3))  # nothing to learn: the fit ends early
    assert gbt.fit(noise, train_mask(), list("abcd"), "y", gbt.gbt(cfg, "y", "p")).getNumTrees < 30


def test_fit_without_validation_rows_grows_all_trees(signal):
    only = signal.filter(train_mask())
    cfg = gbt.GbtConfig(point_trees=4, max_depth=2)
    assert gbt.fit(only, train_mask(), list("abcd"), "y", gbt.gbt(cfg, "y", "p")).getNumTrees == 4


def test_fit_rows_are_few_partitions(signal):
    assert gbt.assembled(signal.repartition(7), list("abcd"), ["y"], "test_fit_rows").rdd.getNumPartitions() == 1


@pytest.mark.parametrize("loss", ["huber", "fair"])
def test_boosting_loses_less_each_time(signal, loss):
    fitted = boost(signal, train_mask(), list("abcd"), "y", loss=loss, rounds=20, learning_rate=0.3, depth=3)
    fit_loss = [h[1] for h in fitted.history]
    assert len(fit_loss) >= 3 and all(b < a for a, b in zip(fit_loss, fit_loss[1:]))
    # the ensemble that scores all rows in one pass is the running score of the loop
    scored = fitted.predict(signal, list("abcd"), "p")
    value = scored.filter(train_mask()).agg(F.avg(loss_value(loss, F.col("y") - F.col("p")))).first()[0]
    at = dict((h[0], h[1]) for h in fitted.history)[len(fitted.trees)]
    assert value == pytest.approx(at, rel=1e-9)
    # outliers in the training rows hardly move it, unlike a squared loss's mean
    assert mean_error(scored, "p") < 0.6


def test_boosting_stops_without_progress(spark, signal):
    noise = signal.withColumn("y", F.rand(5))
    fitted = boost(noise, train_mask(), list("abcd"), "y", loss="fair", rounds=200, learning_rate=0.3, depth=3)
    assert fitted.history[-1][0] < 200 and len(fitted.trees) <= fitted.history[-1][0]


def test_medians_are_exact(spark):
    rows = spark.createDataFrame([(float(i), None if i % 2 else 2.0 * i, float("nan")) for i in range(101)], "a double, b double, c double")
    assert gbt.train_medians(rows, ["a", "b", "c"]) == {"a": 50.0, "b": 100.0}


def test_imputed_inputs_are_one_vector(spark):
    """Filled copies of 60 columns beside the table's own made stages that the JVM only interpreted."""
    rows = spark.createDataFrame([(*[float(i) for i in range(59)], None), (*[None] * 59, 7), (float("nan"), *[-1.0] * 58, 8)],
                                 ", ".join([*[f"c{i} double" for i in range(59)], "c59 int"]))
    cols = rows.columns
    out, inputs = gbt.impute(rows, cols, {c: 100.0 for c in cols[:-1]})
    assert set(out.columns) - set(cols) == set(inputs) and len(inputs) == 1
    got = [r[0].toArray().tolist() for r in gbt.assembled(out, inputs, [], "test_inputs").collect()]
    assert sorted(got) == sorted([[*[float(i) for i in range(59)], 0.0], [100.0] * 59 + [7.0], [100.0, *[-1.0] * 58, 8.0]])
    plain = gbt.assembled(rows, ["c1", "c59"], [], "test_plain").collect()
    assert sorted(str(r[0].toArray().tolist()) for r in plain) == ["[-1.0, 8.0]", "[1.0, nan]", "[nan, 7.0]"]


def test_medians_of_many_rows_read_values_once(spark, monkeypatch):
    """Above ``small`` rows only a share of the rows is stacked, and the medians stay exact."""
    from pvlake.operators import quantiles

    stacked = []
    real = quantiles.exact_quantiles
    monkeypatch.setattr(quantiles, "exact_quantiles", lambda df, *a, **kw: stacked.append(df.count()) or real(df, *a, **kw))
    monkeypatch.setattr(quantiles, "GUIDE_ROWS", 500)
    monkeypatch.setattr(quantiles, "HOT_GROUP_ROWS", 1000)
    rows = spark.range(20000).select(
        (F.col("id") * 7919 % 20000).cast("double").alias("a"), (F.col("id") % 3).alias("b"), F.lit(None).cast("double").alias("none"),
        F.when(F.col("id") % 7 == 0, float("nan")).when(F.col("id") % 5 == 0, None).otherwise(F.sqrt("id")).alias("c"),
        F.when(F.col("id") % 4000 == 0, F.col("id").cast("double")).alias("rare"))
    want = {c: rows.filter(~F.isnan(F.col(c).cast("double"))).agg(F.percentile(F.col(c), F.lit(0.5))).first()[0] for c in rows.columns}
    assert gbt.train_medians(rows, rows.columns) == {c: v for c, v in want.items() if v is not None}
    assert max(stacked) < 20000, stacked  # before: 5 values of each of the 20,000 rows
