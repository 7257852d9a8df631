"""A5/A6 against numpy, W6/W9 invariants."""

import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from hydroframe.operators.metrics import hydro_metrics, low_flow_metrics
from hydroframe.operators.windows import chronological_split, lookback_windows


def np_metrics(t, p):
    mae = np.mean(np.abs(t - p)); rmse = np.sqrt(np.mean((t - p) ** 2))
    sst = np.sum((t - t.mean()) ** 2)
    nse = 1 - np.sum((t - p) ** 2) / sst if sst > 0 else 0.0
    corr = np.corrcoef(t, p)[0, 1] if len(t) > 1 else 0.0
    a = np.std(p) / (np.std(t) + 1e-8); b = np.mean(p) / (np.mean(t) + 1e-8)
    kge = 1 - np.sqrt((corr - 1) ** 2 + (a - 1) ** 2 + (b - 1) ** 2)
    smape = np.mean(2 * np.abs(p - t) / (np.abs(t) + np.abs(p) + 1e-8)) * 100
    return mae, rmse, nse, kge, smape


def test_hydro_metrics_match_numpy(spark):
    rng = np.random.default_rng(3)
    t = rng.gamma(2, 2, 500); p = t + rng.normal(0, 1, 500)
    df = spark.createDataFrame([("g", float(a), float(b)) for a, b in zip(t, p)], "g string, y_true double, y_pred double")
    r = hydro_metrics(df, ["g"]).first()
    np.testing.assert_allclose([r.MAE, r.RMSE, r.NSE, r.KGE, r.sMAPE], np_metrics(t, p), rtol=1e-9)
    assert r.R2 == r.NSE


def test_metric_edge_cases(spark):
    df = spark.createDataFrame([("one", 2.0, 1.0), ("const", 3.0, 1.0), ("const", 3.0, 2.0)],
                               "g string, y_true double, y_pred double")
    r = {x.g: x for x in hydro_metrics(df, ["g"]).collect()}
    assert r["const"].NSE == 0.0 and r["const"].KGE is None  # constant truth: corr undefined
    assert r["one"].NSE == 0.0 and r["one"].KGE is not None  # n = 1: corr = 0
    lf = low_flow_metrics(df.withColumn("Q90_reference", F.lit(0.0)), ["g"]).collect()
    assert all(x.n_dry_samples == 0 and x.RMSE_dry is None for x in lf)


def test_lookback_window_count_and_content(spark):
    n, L, H = 50, 7, 3
    rows = [("s", dt.date(2000, 12, 1) + dt.timedelta(days=i), float(i), float(i * 10)) for i in range(n)]
    df = spark.createDataFrame(rows, "station_id string, date date, y double, x double")
    w = lookback_windows(df, L, H, ["x"], "y", block_rows=8).orderBy("window_end_date").collect()
    assert len(w) == n - L - H + 1
    for k, r in enumerate(w):
        t = k + L - 1
        assert [s.y for s in r.inputs] == [float(i) for i in range(t - L + 1, t + 1)]
        assert [s.x for s in r.inputs] == [float(i * 10) for i in range(t - L + 1, t + 1)]
        assert r.target == float(t + H)


def test_split_disjoint_and_tail(spark):
    rows = [("s", dt.date(2000, 1, 1) + dt.timedelta(days=i)) for i in range(100)]
    df = spark.createDataFrame(rows, "station_id string, target_date date")
    s = chronological_split(df, "2000-01-01", "2000-02-29", "2000-03-01").collect()
    lab = {r.target_date: r.split for r in s}
    pool = [d for d in sorted(lab) if d <= dt.date(2000, 2, 29)]
    assert len(pool) == 60 and [lab[d] for d in pool[-9:]] == ["val"] * 9 and lab[pool[-10]] == "train"
    assert all(lab[d] == "test" for d in lab if d >= dt.date(2000, 3, 1))
