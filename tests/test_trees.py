"""Trees on binned rows: the same trees however rows are spread, few jobs, and they learn."""
import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from pvlake.models import trees as T
from pvlake.session import materialize


@pytest.fixture(scope="module")
def table(spark):
    """4,000 rows; a step, a product that holds for one of four kinds only, a constant input and missing values."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(4000, 6))
    x[:, 4], x[:, 5] = 7.0, rng.integers(0, 4, 4000)
    y = np.round(10 * (x[:, 0] > 0.3) + 5 * x[:, 1] * (x[:, 5] == 2) + rng.normal(size=4000))
    x[::50, 3] = np.nan
    rows = spark.createDataFrame([(*map(float, a), float(b)) for a, b in zip(x, y, strict=True)], "a double, b double, c double, d double, e double, f double, y double")
    return materialize(rows.repartition(3).select(array_to_vector(F.array(*"abcdef")).alias("features"), "y"), "test_trees")


def predicted(forest, table):
    return sorted((r["y"], r["p"]) for r in forest.predict(table, F.col("features"), "p").select("y", "p").collect())


def r2(pairs):
    y, p = np.array(pairs).T
    return 1 - ((y - p) ** 2).mean() / y.var()


def test_forest_needs_few_jobs_and_learns(spark, table):
    """Before, a level of some of the nodes was a job: deep trees took hundreds of passes."""
    spark.sparkContext.setJobGroup("forest", "forest")
    try:
        forest = T.fit_forest(table, "y", 30, 18, 5, 42)
        pairs = predicted(forest, table)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("forest")) < 40
    assert forest.trees.count() == 30 and r2(pairs) > 0.9
    for t in forest.load(0, 30):
        inner = t.left >= 0
        assert 100 < inner.sum() and (t.left[inner] > np.flatnonzero(inner)).all() and len(t.left) == 2 * inner.sum() + 1


def test_same_trees_shuffled_or_shared(table, monkeypatch):
    want = T.fit_forest(table, "y", 5, 8, 5, 42)
    pairs = predicted(want, table)
    for local, model in ((700, 1 << 30), (10**6, 1 << 30), (300, 5000)):  # upper levels by passes; whole trees gathered; several batches of trees
        for name, value in (("SHARED_BYTES", 0), ("LOCAL_ROWS", local), ("BATCH_TREES", 3), ("MODEL_BYTES", model)):
            monkeypatch.setattr(T, name, value)
        got = T.fit_forest(table, "y", 5, 8, 5, 42)
        assert (len(got.batches()) > 1) == (model < 1 << 30)
        assert sorted(len(t.left) for t in got.load(0, 5)) == sorted(len(t.left) for t in want.load(0, 5))
        assert np.allclose(predicted(got, table), pairs, atol=1e-9)


def test_best_split_is_the_least_squares_one():
    rng = np.random.default_rng(3)
    codes, y, w = rng.integers(0, 9, (300, 3)).astype(np.uint8), rng.normal(size=300), rng.integers(0, 4, 300).astype(float)
    t = T.grow(codes, w, y, 1, 5, 3, 1, 0)
    spread = lambda m: (w[m] * (y[m] - np.average(y[m], weights=w[m])) ** 2).sum() if w[m].sum() >= 5 else np.inf
    loss = {(f, c): spread(codes[:, f] <= c) + spread(codes[:, f] > c) for f in range(3) for c in range(8)}
    assert min(loss, key=loss.get) == (t.feature[0], t.cut[0])
    left = codes[:, t.feature[0]] <= t.cut[0]
    assert np.allclose(t.value[1:], [np.average(y[m], weights=w[m]) for m in (left, ~left)])
    alike = T.grow(codes, w, np.full(300, 0.1), 9, 5, 3, 1, 0)
    assert len(alike.left) == 1  # equal values are not split


def test_cuts_lie_between_few_values(table):
    cuts = T.find_cuts(table, 6)
    assert cuts[5].tolist() == [0.5, 1.5, 2.5] and len(cuts[4]) == 0
    assert all(20 < len(c) < T.BINS for c in cuts[:4])
    codes = T.coded(np.array([[0.0, 0.0, 0.0, np.nan, 7.0, 1.5]]), cuts)
    assert codes[0, 3] == len(cuts[3]) and codes[0, 5] == 1


def test_passes_over_blocks_grow_the_tree_of_one_task(table):
    data = T.bin_rows(table, ["y"], "test_blocks")
    rows = data.blocks.collect()
    assert len(rows) == 3 and sum(len(r["codes"]) for r in rows) == 4000 * 6
    codes, y = (np.frombuffer(b"".join(r[c] for r in rows), kind) for c, kind in (("codes", np.uint8), ("y", float)))
    want = T.grow(codes.reshape(-1, 6), np.ones(4000), y, 4, 30, 5, 7, 3)
    got = T.grow_over_blocks(data, lambda number, x, codes: [(np.ones(len(codes)), x["y"])], 4, 30, 5, 7, 3)
    assert len(want.left) > 15 and all(np.allclose(a, b) for a, b in ((got.feature, want.feature), (got.cut, want.cut), (got.left, want.left), (got.value, want.value)))


def test_boosting_passes_read_a_byte_a_value(table, monkeypatch):
    """Before, each round decoded the vectors again and every few rounds wrote them anew."""
    from pvlake import session
    from pvlake.models import boosting

    written = []
    real = session.materialize
    monkeypatch.setattr(T, "materialize", lambda df, name, *a: written.append((name, out := real(df, name, *a))) or out)
    monkeypatch.setattr(session, "cut_lineage", lambda df: pytest.fail("vectors are written again"))
    rows = table.withColumns({"split": F.lit("train"), "eval_split": F.when(F.abs("y") % 5 == 1, "valid_seen").otherwise("train")}).withColumn("inputs", F.col("features"))
    fitted = boosting.boost(rows, F.col("eval_split") == "train", ["inputs"], "y", loss="squared", rounds=10, learning_rate=0.5, depth=3)
    assert [name for name, _ in written] == ["boost_blocks"] * 3  # the start, then every five rounds
    for _, blocks in written:
        assert blocks.agg(F.sum(F.length("codes"))).first()[0] == 4000 * 6
    assert len(fitted.trees) == 10 and r2(sorted((r["y"], r["p"]) for r in fitted.predict(rows, ["inputs"], "p").collect())) > 0.9
