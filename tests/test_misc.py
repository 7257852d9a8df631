"""Smaller operators: P2 P7 P12 J9 F2 F7 F8 F13 S5 S7 S9 S10 S11 S13 M3."""

import datetime as dt
import json
import math
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from hydroframe.functions.scalar import get_or_default, inverse_target, parse_study_name, study_name
from hydroframe.operators import experiments as X
from hydroframe.operators import prepare as P


def test_choose_sources_and_missing_column(spark):
    df = spark.createDataFrame([("s", 1.0, 2.0, 3.0, 4.0)],
                               "station_id string, p_mswep double, tmean_era5land double, aet_era5land double, "
                               "streamflow_m3s double")
    out = P.choose_sources(df)
    assert set(out.columns) == {"station_id", "precipitation", "temperature", "actual_evapotransp", "streamflow_m3s"}
    with pytest.raises(ValueError):
        P.choose_sources(df.drop("p_mswep"))


def test_period_split_and_roles(spark):
    rows = [("s", dt.date(1985, 1, 1), 1.0, "x"), ("s", dt.date(1995, 1, 1), 2.0, "x"),
            ("s", dt.date(2015, 1, 1), 3.0, "x"), ("s", dt.date(2019, 1, 1), 4.0, "x")]
    df = P.assign_period(spark.createDataFrame(rows, "station_id string, date date, static_a double, static_b string"))
    parts = P.split_by_period(df)
    assert {k: v.count() for k, v in parts.items()} == {"Passado": 1, "Recente": 1, "Teste": 1}
    roles = P.feature_roles(df)
    assert roles["static_reals"] == ["static_a"] and roles["static_categoricals"] == ["static_b"]


def test_experiment_grid_and_names(spark):
    g = X.experiment_grid(spark, [7, 15], ["lstm", "tft"], [("passado", "1980-01-01", "1990-12-31")], [30, 60])
    names = sorted(r.study_name for r in g.collect())
    assert len(names) == 8 and "tft_passado_lb60_h15" in names
    p = spark.createDataFrame([("tft_recente_lb90_h30",), ("lstm_passado_lb30",), ("bad",)], "s string") \
             .select(parse_study_name("s").alias("p")).collect()
    assert (p[0].p.model, p[0].p.lookback, p[0].p.horizon) == ("tft", 90, 30)
    assert p[1].p.horizon == 1 and p[2].p is None
    one = spark.range(1).select(study_name(F.lit("tft"), F.lit("passado"), F.lit(30), F.lit(7)).alias("n")).first()
    assert one.n == "tft_passado_lb30_h7"


def test_inverse_target_and_map_default(spark):
    r = spark.range(1).select(inverse_target(F.lit(0.5), F.lit(1.0), F.lit(2.0)).alias("y"),
                              inverse_target(F.lit(-5.0), F.lit(0.0), F.lit(1.0)).alias("z"),
                              get_or_default(F.create_map(F.lit("a"), F.lit(1.0)), "b", 0.0).alias("d")).first()
    assert math.isclose(r.y, math.expm1(2.0)) and r.z == 0.0 and r.d == 0.0


def test_json_csv_cache_and_sinks(spark):
    from hydroframe.sources.files import read_best_trials, read_or_build, read_results_csv
    from hydroframe.sources.sinks import write_by_period, write_scaling_metadata, write_trials
    d = tempfile.mkdtemp(prefix="hf-misc-")
    with open(os.path.join(d, "tft_passado_lb30_h7_best.json"), "w") as f:
        json.dump({"study_name": "tft_passado_lb30_h7", "metric": "NSE", "direction": "maximize", "best_value": 0.8,
                   "best_trial": 3, "best_params": {"lr": 0.01}, "best_metrics": {"NSE": 0.8, "KGE": 0.7},
                   "search_config": {"n_trials": 20, "val_fraction": 0.15}}, f, indent=2)
    b = read_best_trials(spark, os.path.join(d, "*_best.json")).first()
    assert b.best_metrics.NSE == 0.8 and b.search_config.n_trials == 20 and b.best_params["lr"] == "0.01"
    with open(os.path.join(d, "results.csv"), "w") as f:
        f.write("model,period,lookback,horizon,NSE,LogNSE\ntft,passado,30,7,0.8,0.7\n")
    r = read_results_csv(spark, os.path.join(d, "results.csv"),
                         "model string, period string, lookback int, horizon int, NSE double, LogNSE double")
    assert r.first().LogNSE == 0.7
    calls = []

    def build():
        calls.append(1)
        return spark.createDataFrame([(1, "Passado")], "x int, period string")
    t1 = read_or_build(spark, os.path.join(d, "cache"), {"x", "period"}, build)
    t2 = read_or_build(spark, os.path.join(d, "cache"), {"x", "period"}, build)
    assert t1.count() == t2.count() == 1 and len(calls) == 1
    write_by_period(t2, os.path.join(d, "byperiod"))
    assert os.path.isdir(os.path.join(d, "byperiod", "period=Passado"))
    write_scaling_metadata(spark.createDataFrame([("s", "v", 0.0, 1.0)], "station_id string, column string, min double, max double"),
                           os.path.join(d, "meta"))
    u = write_trials([spark.createDataFrame([(0, 1.0)], "number int, lr double"),
                      spark.createDataFrame([(1, 5)], "number int, layers int")], os.path.join(d, "trials"))
    assert set(u.columns) == {"number", "lr", "layers"} and u.count() == 2


def test_sweep_records_cells(spark):
    from hydroframe.operators.forecast import sweep
    rows = [("s", dt.date(2000, 1, 1) + dt.timedelta(days=i), math.sin(i / 5.0), float(i % 7)) for i in range(400)]
    df = spark.createDataFrame(rows, "station_id string, date date, y double, x double")
    out = sweep(spark, df, ["x"], "y", [5], [1, 2000], [("passado", "2000-01-01", "2000-09-30")], "2000-10-01").collect()
    st = {r.horizon: r.status for r in out}
    assert st[1] == "success" and st[2000] == "failed"


def test_readiness_report_tables(spark, tmp_path_factory=None):
    from hydroframe.operators.readiness import Thresholds, readiness_report
    from hydroframe.sources.sinks import write_report
    d0 = dt.date(2000, 1, 1)
    flow = spark.createDataFrame([("s", d0 + dt.timedelta(days=i), float(v)) for i, v in enumerate([1, 9, 9, 1, 1, 9, 1])],
                                 "station_id string, date date, streamflow_m3s double")
    files = {"streamflow": flow,
             "precipitation": spark.createDataFrame([("s", d0, 1.0, None)], "station_id string, date date, p_a double, p_b double")}
    stations = spark.createDataFrame([("s",), ("t",)], "station_id string")
    attrs = {"human_intervention": spark.createDataFrame([("s", 0.1, 0.0, 0.0)], "station_id string, consumptive_use_perc double, regulation_degree double, reservoirs_vol double"),
             "quality_check": spark.createDataFrame([("s", 99.0)], "station_id string, q_quality_control_perc double"),
             "location": spark.createDataFrame([("s", "Rio", -25.0, -50.0, "high")], "station_id string, gauge_name string, gauge_lat double, gauge_lon double, area_gsim_quality string"),
             "land_cover": spark.createDataFrame([("s", 50.0, 10.0, 1.0, "forest")], "station_id string, forest_perc double, crop_perc double, imperv_perc double, dom_land_cover string")}
    th = Thresholds(required_start_date="2000-01-01", required_end_date="2000-01-01", streamflow_event_quantile=0.5,
                    lstm_lookback_auto_from_events=True)
    rep = readiness_report(files, stations, attrs, flow, th)
    assert set(rep) == {"coverage", "intervention", "decision", "events", "event_summary", "lookback", "event_windows"}
    dec = {r.station_id: r.verdict for r in rep["decision"].collect()}
    assert dec == {"s": "APROVADA", "t": "REPROVADA"}
    lb = rep["lookback"].first()
    assert lb.lstm_lookback_source == "fixed_default_no_event_recurrence" and lb.lstm_lookback_days == 30
    out = tempfile.mkdtemp(prefix="hf-report-")
    write_report(rep, out)
    assert sorted(os.listdir(out)) == sorted(rep)


def test_bootstrap_identical_predictions_give_zero(spark):
    from hydroframe.operators.metrics import bootstrap_nse_difference
    rows = [("g", i, float(i % 13), float(i % 13) + 0.5, float(i % 13) + 0.5) for i in range(300)]
    df = spark.createDataFrame(rows, "g string, id long, t double, a double, b double")
    r = bootstrap_nse_difference(df, ["g"], "id", "t", "a", "b", replicates=50).first()
    assert r.replicates == 50 and r.q025 == 0.0 and r.q975 == 0.0


def test_bootstrap_metric_differences_identical_predictions(spark):
    from hydroframe.operators.metrics import bootstrap_metric_differences
    rows = [("g", i, float(i % 13) + 1.0, float(i % 11) + 0.5, float(i % 11) + 0.5) for i in range(300)]
    df = spark.createDataFrame(rows, "g string, id long, t double, a double, b double")
    out = {r.metric: r for r in bootstrap_metric_differences(df, ["g"], "id", "t", "a", "b", replicates=40).collect()}
    assert set(out) == {"NSE", "KGE", "LogNSE"}
    assert all(r.replicates == 40 and r.q025 == 0.0 and r.q975 == 0.0 for r in out.values())


def test_bootstrap_weights_are_independent_and_spread_is_right(spark):
    """Weights of two replicates are uncorrelated, with mean and variance 1; the spread of a bootstrap
    mean is sigma / sqrt(n); predictions that differ give an interval around their difference."""
    import numpy as np
    from hydroframe.operators.metrics import bootstrap_nse_difference, poisson1_thresholds, replicate_weight
    assert poisson1_thresholds()[-1] == pytest.approx(1.0, abs=1e-15)
    d = spark.range(2000).select("id", *[replicate_weight(F.col("id"), F.lit(r), 3).alias(f"w{r}") for r in range(60)])
    w = np.array([tuple(r)[1:] for r in d.collect()], dtype=float)
    c = np.corrcoef(w.T)
    assert np.abs(c - np.eye(60)).max() < 0.12 and abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.03
    y = np.random.default_rng(0).normal(size=2000)
    means = (w * y[:, None]).sum(0) / w.sum(0)
    assert means.std() == pytest.approx(y.std() / np.sqrt(2000), rel=0.35)
    rows = [("g", i, float(v), float(v) + 0.1 * (i % 3), float(v) + 0.3 * (i % 5)) for i, v in enumerate(y)]
    r = bootstrap_nse_difference(spark.createDataFrame(rows, "g string, b long, t double, a double, p double"),
                                 ["g"], "b", "t", "a", "p", replicates=200).first()
    true = float(((0.3 * (np.arange(2000) % 5)) ** 2 - (0.1 * (np.arange(2000) % 3)) ** 2).sum() / ((y - y.mean()) ** 2).sum())
    assert r.q025 < true < r.q975 and r.q025 < r.q500 < r.q975


def test_attention_takes_all_samples_and_long_series_are_binned(spark):
    """A19 over more than 32 samples; W12 with 480 lags (bins of 4, kernel wider than one bin) as numpy has it."""
    import numpy as np
    from hydroframe.operators import importance as I
    rng = np.random.default_rng(1)
    m = rng.random((50, 480))
    df = spark.createDataFrame([("s", m.tolist())], "study string, attention array<array<double>>")
    means = I.mean_attention_per_lag(I.attention_cells(df))
    got = {r.lag: r.mean_attention for r in means.collect()}
    assert all(got[i] == pytest.approx(v) for i, v in enumerate(m.mean(0)))
    assert I.attention_cells(df, max_samples=32).select("sample_pos").distinct().count() == 32
    binned = m.mean(0).reshape(120, 4).mean(1)
    k = np.exp(-np.arange(-6, 7) ** 2 / (2 * 2.0 ** 2))
    want = np.convolve(binned, k / k.sum(), mode="same")
    out = {r.bin: r.smoothed for r in I.smooth_lags(means).collect()}
    assert len(out) == 120 and all(out[i] == pytest.approx(v) for i, v in enumerate(want))


def test_quality_flags_are_no_features_and_grid_checks_default_columns(spark):
    from hydroframe.operators import prepare as P
    from hydroframe.operators import windows as W
    df = spark.createDataFrame([("s", 1.0, 1, 2.0)], "station_id string, qual_flag double, qual_control_by_ana int, p double")
    assert P.feature_roles(df)["time_varying_unknown_reals"] == ["p"]
    days = spark.sql("SELECT 's' AS station_id, d AS date, 'Teste' AS period, IF(month(d) = 2, NULL, 1.0D) AS streamflow_m3s "
                     "FROM (SELECT explode(sequence(DATE'2001-01-01', DATE'2001-04-30')) AS d)")
    g = W.monthly_window_grid(days, 1, 1)
    got = {str(r.target_start_date): r.is_candidate for r in g.collect()}
    assert got["2001-04-01"] and not got["2001-02-01"] and not got["2001-03-01"]


def test_read_errors_do_not_overwrite_and_listing_reads_no_file(spark, tmp_path):
    from hydroframe.sources.files import read_or_build
    from hydroframe.sources.text import file_listing
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "part-0.parquet").write_bytes(b"not a table")
    with pytest.raises(Exception):
        read_or_build(spark, str(tmp_path / "t"), {"x"}, lambda: spark.range(1).select(F.col("id").alias("x")))
    assert (tmp_path / "t" / "part-0.parquet").read_bytes() == b"not a table"
    (tmp_path / "1_streamflow_m3s.txt").write_text("x")
    assert [r.file_name for r in file_listing(spark, str(tmp_path)).collect()] == ["1_streamflow_m3s.txt"]


def test_no_scratch_folder_on_a_cluster():
    from types import SimpleNamespace
    from hydroframe.session import checkpoint_dir
    conf = SimpleNamespace(get=lambda key, default=None: None)
    with pytest.raises(ValueError):
        checkpoint_dir(SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="spark://head:7077")))
