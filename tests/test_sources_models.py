"""Sources in the published folder layout, stacking solver and CV summaries."""
import itertools
import os
import tempfile

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pvlake.models.stacking import nonneg_ridge
from pvlake.sources.telemetry_csv import load_point_data, sample_device_days


def _write_layout(root):
    # train/<device>/<date>.csv with two header variants; test2 absent; one file names its device
    rows = {
        ("train", "EP1234567A", "2024-01-01"): "us_timestamp,pvGenTotal,latitude,longitude,altitude\n"
                                              "2024-01-01 10:00:00,0.5,30.0,-90.0,40\n2024-01-01 10:15:00,bad,30.0,-90.0,41\n",
        ("train", "EP1234567A", "2024-01-02"): "longitude,us_timestamp,pvGenTotal,latitude,cloud_cover_H\n"
                                              "-90.0,2024-01-02 11:00:00,0.7,30.0,55\n",
        ("test1", "DIR_NAME", "2024-01-03"): "us_timestamp,pvGenTotal,latitude,longitude,deviceSn\n"
                                            "2024-01-03 09:00:00,0.1,31.0,-91.0,EP7654321B\n",
    }
    for (split, dev, day), text in rows.items():
        os.makedirs(f"{root}/{split}/{dev}", exist_ok=True)
        with open(f"{root}/{split}/{dev}/{day}.csv", "w") as fh:
            fh.write(text)


def test_published_layout_with_header_drift(spark):
    root = tempfile.mkdtemp(prefix="pvlake-csv-")
    _write_layout(root)
    df = load_point_data(spark, root)
    got = df.select("split", "deviceSn", "date", "us_timestamp", "pvGenTotal", "altitude", "cloud_cover_H").toPandas()
    got = got.sort_values(["date", "us_timestamp"]).reset_index(drop=True)
    assert list(got["split"]) == ["train", "train", "train", "test1"]
    assert list(got["deviceSn"]) == ["EP1234567A", "EP1234567A", "EP1234567A", "EP7654321B"]
    assert list(got["date"]) == ["2024-01-01", "2024-01-01", "2024-01-02", "2024-01-03"]
    assert got["pvGenTotal"].isna().tolist() == [False, True, False, False]  # 'bad' coerced to missing
    assert got["altitude"].isna().tolist() == [False, False, True, True]  # missing column -> NULL
    assert got["cloud_cover_H"].tolist()[2] == 55.0


def test_no_files_raises(spark):
    with pytest.raises(FileNotFoundError):
        load_point_data(spark, tempfile.mkdtemp(prefix="pvlake-empty-"))


def test_sampling_keeps_whole_days(spark):
    from pvlake.sources.fixture import pv_points
    pts = pv_points(spark, "/root/testdata/sf0.001")
    kept = sample_device_days(pts, 0.5)
    full = pts.groupBy("split", "deviceSn", "date").count()
    part = kept.groupBy("split", "deviceSn", "date").count()
    assert part.join(full, ["split", "deviceSn", "date", "count"], "left_anti").count() == 0
    assert 0 < part.count() < full.count()
    assert kept.count() == sample_device_days(pts, 0.5).count()  # deterministic


def _brute_nnls(g, r, alpha):
    p = len(r)
    q = g + alpha * np.eye(p)
    best, best_val = None, np.inf
    for mask in itertools.product([0, 1], repeat=p):
        idx = [i for i in range(p) if mask[i]]
        w = np.zeros(p)
        if idx:
            w[idx] = np.linalg.solve(q[np.ix_(idx, idx)], r[idx])
            if (w < -1e-12).any():
                continue
        val = 0.5 * w @ q @ w - r @ w
        if val < best_val:
            best, best_val = w, val
    return best


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_nonneg_ridge_matches_enumeration(seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(50, 4))
    y = x @ np.array([1.0, -2.0, 0.5, 0.0]) + rng.normal(size=50) * 0.1
    g, r = x.T @ x, x.T @ y
    assert np.allclose(nonneg_ridge(g, r, 0.1), _brute_nnls(g, r, 0.1), atol=1e-8)


def test_cv_summaries_match_pandas(spark):
    from pvlake.plans.evaluation import cv_aggregate, cv_candidate_summary
    rows = [(f, c, m, float(v)) for f, (c, m, v) in itertools.product(range(3), [
        ("selected", "combined_validation_daily_mape", 1), ("selected", "valid_unseen_daily_mape", 2),
        ("pred_a", "combined_validation_daily_mape", 3), ("pred_a", "valid_unseen_daily_mape", 4)])]
    rows = [(f, c, m, v * (f + 1)) for f, c, m, v in rows]
    table = spark.createDataFrame(rows, "fold int, candidate string, metric string, value double")
    pdf = pd.DataFrame(rows, columns=["fold", "candidate", "metric", "value"])
    agg = {r["metric"]: r for r in cv_aggregate(table).collect()}
    exp = pdf[pdf.candidate == "selected"].groupby("metric")["value"].agg(["mean", "std", "min", "max"])
    for metric, e in exp.iterrows():
        assert agg[metric]["mean"] == pytest.approx(e["mean"]) and agg[metric]["std"] == pytest.approx(e["std"])
    cand = cv_candidate_summary(table).filter(F.col("candidate") == "pred_a").count()
    assert cand == 2


def test_published_layout_keeps_every_file(spark, tmp_path):
    """The date in a file's name wins, and a file without us_timestamp keeps its rows."""
    files = {
        "train/EP1/2024-01-02.csv": "us_timestamp,pvGenTotal,date\n2024-01-02 00:00:00,1.5,1999-12-31\n",
        "train/EP2/2024-01-03.csv": "pvGenTotal,latitude\n2.5,30\n3.5,31\n",
        "test1/EP1/2024-01-04.csv": "us_timestamp,deviceSn,pvGenTotal\n2024-01-04 00:15:00,EP9,bad\n",
    }
    for name, text in files.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    rows = sorted((r.split, r.deviceSn, r.date, r.us_timestamp is None, r.pvGenTotal) for r in load_point_data(spark, str(tmp_path)).collect())
    assert rows == [("test1", "EP9", "2024-01-04", False, None), ("train", "EP1", "2024-01-02", False, 1.5),
                    ("train", "EP2", "2024-01-03", True, 2.5), ("train", "EP2", "2024-01-03", True, 3.5)]


def test_ingest_replay_replaces_its_batch(spark, tmp_path):
    from pvlake.sources.telemetry_csv import records
    from pvlake.streaming.ingest import _write_batch

    (tmp_path / "in/train/EP1").mkdir(parents=True)
    (tmp_path / "in/train/EP1/2024-01-02.csv").write_text("us_timestamp,pvGenTotal\n2024-01-02 00:00:00,1\n2024-01-02 00:15:00,2\n")
    lines = records(spark.read, f"{tmp_path}/in/*/*/*.csv")
    for _ in range(2):
        _write_batch(f"{tmp_path}/out")(lines, 3)
    assert spark.read.parquet(f"{tmp_path}/out").count() == 2


def test_header_binding_is_the_parsers(spark, tmp_path):
    """Quoted commas and line breaks, doubled quotes, byte-order marks, a data line equal to the header, odd names."""
    files = {
        "train/EP1/2024-01-02.csv": "\ufeffus_timestamp,\"note, x\",pvGenTotal\n2024-01-02 00:00:00,\"a,b\",1.5\n2024-01-02 00:15:00,\"two\nlines \"\"q\"\"\",2.5\n",
        "train/EP2/2024-01-03.csv": "pvGenTotal,us_timestamp,it's\npvGenTotal,us_timestamp,it's\n0.5,2024-01-03 01:00:00,x\n",
        "test1/EP3/notes.csv": "pvGenTotal,date\n9,2024-01-09\n",
        "test2/EP4/2024-01-04.csv": "pvGenTotal,us_timestamp\n",
    }
    for name, text in files.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text, encoding="utf-8")
    df = load_point_data(spark, str(tmp_path))
    assert {"us_timestamp", "note, x", "it's", "pvGenTotal"} <= set(df.columns)
    rows = [tuple(r) for r in df.select("split", "deviceSn", "date", F.col("us_timestamp").cast("string"), "pvGenTotal").collect()]
    assert sorted(rows, key=str) == sorted([
        ("train", "EP1", "2024-01-02", "2024-01-02 00:00:00", 1.5), ("train", "EP1", "2024-01-02", "2024-01-02 00:15:00", 2.5),
        ("train", "EP2", "2024-01-03", None, None), ("train", "EP2", "2024-01-03", "2024-01-03 01:00:00", 0.5),
        ("test1", "EP3", None, None, 9.0)], key=str)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
