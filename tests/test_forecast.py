"""Forecasting jobs: flows back in their unit, trees against persistence, parallel sweeps, labels from the halo."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from hydroframe.operators import forecast as FC
from hydroframe.operators import metrics as M
from hydroframe.operators import windows as W

SPLIT = W.DateSplit("2000-01-01", "2002-06-30", "2002-07-01", None, 0.15)


@pytest.fixture(scope="module")
def daily(spark):
    """Two stations whose flow jumps with the season: today's value says little about the one a week ahead, the rain does."""
    rng, rows = random.Random(2), []
    for station, level in (("a", 5.0), ("b", 40.0)):
        rain = [rng.random() for _ in range(1100)]
        for i in range(1100):
            flow = level * (1 + (4.0 if i >= 7 and rain[i - 7] > 0.7 else 0.0)) + rng.random()
            rows.append((station, i, flow, rain[i]))
    d = spark.createDataFrame(rows, "station_id string, i int, streamflow_m3s double, rain double")
    return d.select("station_id", F.date_add(F.lit("2000-01-01").cast("date"), F.col("i")).alias("date"), "streamflow_m3s", "rain").cache()


@pytest.fixture(scope="module")
def labelled(daily):
    d = W.log_target(daily, "streamflow_m3s", "target_log").withColumn("target_raw", F.col("streamflow_m3s"))
    fit = W.fit_scale(d, ["target_log", "rain"])
    d = W.standardise(d, ["target_log", "rain"], fit=fit)
    return W.lookback_windows(d, 10, 7, ["rain"], "target_log", split=SPLIT).cache(), fit["target_log"], d


def test_scores_are_in_flow_units(labelled):
    windows, fit, _ = labelled
    raw = {(r["station_id"], r["target_date"]): r["target_raw"] for r in windows.collect()}
    for r in FC.fit_windows(windows, ["target_log", "rain"], FC.linear(), fit)[1].collect():
        assert math.isclose(r["y_true"], raw[r["station_id"], r["target_date"]], rel_tol=1e-9) and r["y_pred"] >= 0


def test_linear_fit_equals_numpy(labelled):
    windows, _, _ = labelled
    train = windows.where("split = 'train'").collect()
    x = np.array([[1.0, r["inputs"][-1]["target_log"], r["inputs"][-1]["rain"]] for r in train])
    b = np.linalg.lstsq(x, np.array([r["target"] for r in train]), rcond=None)[0]
    model, _ = FC.fit_windows(windows, ["target_log", "rain"], FC.linear(reg_param=0.0), steps=1)
    assert np.allclose([model.intercept, *model.coefficients], b, atol=1e-8)


def test_trees_beat_persistence(labelled, daily):
    windows, fit, _ = labelled
    score = lambda d: {r["station_id"]: r["NSE"] for r in M.hydro_metrics(d, ["station_id"]).collect()}
    trees = score(FC.fit_windows(windows, ["target_log", "rain"], FC.boosted_trees(trees=10), fit, steps=3)[1].where("split = 'test'"))
    lag = score(M.persistence_forecast(daily, 7).where("target_date >= '2002-07-01'"))
    assert all(trees[s] > 0.5 > lag[s] for s in ("a", "b"))


def test_parallel_sweep_equals_the_serial_one(spark, labelled):
    _, fit, d = labelled
    args = (spark, d, ["rain"], "target_log", [5, 10], [1, 7], [("passado", "2000-01-01", "2001-06-30")], "2002-07-01")
    models = {"linreg": FC.linear, "trees": lambda: FC.boosted_trees(trees=2, depth=2)}
    one, many = (FC.sweep(*args, target_fit=fit, parallelism=n, models=models).collect() for n in (1, 4))
    assert len(one) == 8 and {r["status"] for r in one} == {"success"}
    assert [r[:6] for r in one] == [r[:6] for r in many]
    assert np.allclose([r[6:9] for r in one], [r[6:9] for r in many], rtol=1e-6)


def test_labels_in_the_halo_equal_those_of_whole_windows(labelled):
    windows, _, d = labelled
    plain = W.lookback_windows(d, 10, 7, ["rain"], "target_log")
    want = W.chronological_split(plain.select("station_id", "target_date"), SPLIT.train_start, SPLIT.train_end, SPLIT.test_start, SPLIT.test_end, SPLIT.val_fraction)
    key = lambda d: {tuple(r) for r in d.select("station_id", "target_date", "split", "n_pool", "split_error").collect()}
    assert key(windows) == key(want) and len(key(want)) == windows.count()


def test_small_blocks_give_the_same_windows(labelled):
    _, _, d = labelled
    w = lambda n: sorted(map(repr, W.lookback_windows(d, 10, 7, ["rain"], "target_log", block_rows=n, split=SPLIT).collect()))
    assert w(10) == w(4096)


def test_no_exchange_above_the_arrays(labelled):
    _, _, d = labelled
    plan = W.lookback_windows(d, 10, 7, ["rain"], "target_log", split=SPLIT)._jdf.queryExecution().executedPlan().toString()
    lines = plan.split("\n")
    first = next(i for i, x in enumerate(lines) if "collect_list" in x)
    assert not any("Exchange" in x or "Join" in x for x in lines[:first])


def test_row_split_without_dates(spark):
    d = spark.range(100).select(F.lit("s").alias("station_id"), F.date_add(F.lit("2000-01-01").cast("date"), F.col("id").cast("int")).alias("date"), F.col("id").alias("time_idx"), F.col("id").cast("double").alias("y"), (F.col("id") % 3).alias("k"))
    w = W.tft_datasets(d, 5, 2, ["k"], "y").collect()
    first = {s: [r["decoder_start_idx"] for r in w if r["dataset"] == s] for s in ("train", "val", "test")}
    assert (min(first["train"]), max(first["train"])) == (5, 68)  # the decoder's last row is 69
    assert (min(first["val"]), max(first["val"])) == (70, 83) and (min(first["test"]), max(first["test"])) == (85, 98)
    assert {r["target_center"] for r in w} == {34.5}


def test_model_inputs_have_roles(spark):
    d = spark.range(60).select(F.lit("s").alias("station_id"), F.date_add(F.lit("2000-01-01").cast("date"), F.col("id").cast("int")).alias("date"), F.col("id").alias("time_idx"), F.col("id").cast("double").alias("y"), (F.col("id") * 2.0).alias("k"), F.lit("clay").alias("static_soil"), F.lit(3).alias("static_area"))
    r = W.model_inputs(d, 4, 2, "y", ["time_idx", "k", "absent"], ["static_soil"], ["static_area"]).where("decoder_start_idx = 20").first()
    assert r["known_names"] == ["time_idx", "k", "relative_time_idx"]
    assert r["encoder_reals"] == [[16.0, 32.0, -1.0], [17.0, 34.0, -0.75], [18.0, 36.0, -0.5], [19.0, 38.0, -0.25]]
    assert r["decoder_reals"] == [[20.0, 40.0, 0.0], [21.0, 42.0, 0.25]]
    assert (r["encoder_target"], r["decoder_target"]) == ([16.0, 17.0, 18.0, 19.0], [20.0, 21.0])
    assert (r["static_categoricals"]["static_soil"], r["static_reals"]["static_area"], r["target_scales"][0]) == ("clay", 3.0, 20.5)


def test_persistence_of_all_horizons_in_one_pass(spark, daily):
    got = M.persistence_forecasts(daily, [1, 7, 30], block_rows=30).collect()
    flow = {(r["station_id"], r["date"].toordinal()): r["streamflow_m3s"] for r in daily.collect()}
    assert len(got) == 2 * (3 * 1100 - 38)
    for r in got:
        assert r["issue_date"].toordinal() == r["target_date"].toordinal() - r["horizon"]
        assert (r["y_true"], r["y_pred"]) == (flow[r["station_id"], r["target_date"].toordinal()], flow[r["station_id"], r["issue_date"].toordinal()])
