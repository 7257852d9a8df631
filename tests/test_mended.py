"""Cases in which files, payloads or tables are not as uniform as one would like."""

import json

import pytest
from pyspark.sql import functions as F

from hydroframe.operators import experiments as X
from hydroframe.operators import importance as I
from hydroframe.operators import prepare as P
from hydroframe.operators import readiness as R
from hydroframe.sources.files import read_importance
from hydroframe.sources.text import read_daily_files, read_static_attributes, read_whitespace_table


def put(folder, **files):
    for name, text in files.items():
        (folder / f"{name}.txt").write_text(text)
    return str(folder)


def test_each_file_goes_by_its_own_header(spark, tmp_path):
    d = put(tmp_path, a_p="year month day p_x p_y\n2000 1 1 1.0 2.0\n", b_p="day month year p_y p_x\n2 1 2000 4.0 3.0\n\n", c_p="year month day p_y\n2000 1 3 nan\n")
    got = {r["station_id"]: (str(r["date"]), r["p_x"], r["p_y"]) for r in read_daily_files(spark, d, "p").collect()}
    assert got == {"a": ("2000-01-01", 1.0, 2.0), "b": ("2000-01-02", 3.0, 4.0), "c": ("2000-01-03", None, None)}


def test_like_headers_need_no_join(spark, tmp_path):
    d = put(tmp_path, a_p="year p_x\n1 2\n", b_p="year p_x\n3 4\n")
    t = read_whitespace_table(spark, f"{d}/*_p.txt")
    assert "Join" not in t._jdf.queryExecution().executedPlan().toString() and {(r["year"], r["p_x"]) for r in t.collect()} == {(1, 2.0), (3, 4.0)}
    (tmp_path / "e").mkdir()
    (tmp_path / "e" / "x_p.txt").write_text("")
    with pytest.raises(ValueError, match="no line"):
        read_whitespace_table(spark, f"{tmp_path}/e/*_p.txt")


def test_coverage_counts_rows_without_a_date(spark, tmp_path):
    d = put(tmp_path, s_streamflow_m3s="year month day streamflow_m3s\n2000 1 1 1.0\n2000 2 30 nan\n2000 1 3 2.0\n2000 13 1 5.0\n")
    assert read_daily_files(spark, d, "streamflow_m3s").count() == 2
    t = read_daily_files(spark, d, "streamflow_m3s", keep_undated=True)
    r = R.coverage_summary({"streamflow": t}, t.select("station_id")).first()
    assert (r["rows"], r["missing_pct_best_source"], str(r["date_max"])) == (4, 25.0, "2000-01-03")


def test_static_attributes_take_the_first_row_of_each_file(spark, tmp_path):
    d = put(tmp_path, camels_br_soil="gauge_id clay kind\n10 1.5 loam\n20 nan sand\n10 9.9 peat\n", camels_br_area="gauge_id km2\n20 7\n", camels_br_other="code x\n1 2\n")
    t = read_static_attributes(spark, d)
    assert t.columns == ["station_id", "static_area_km2", "static_soil_clay", "static_soil_kind"]
    assert {r["station_id"]: tuple(r)[1:] for r in t.collect()} == {"10": (None, 1.5, "loam"), "20": (7.0, None, "sand")}
    assert dict(t.dtypes)["static_soil_kind"] == "string" and dict(t.dtypes)["static_soil_clay"] == "double"


def test_first_row_per_station_is_repeatable(spark):
    d = spark.createDataFrame([("s", 2, "b"), ("s", 1, "z"), ("s", 1, "a"), ("t", None, "c")], "station_id string, o int, v string")
    for parts in (1, 4):
        assert {(r["station_id"], r["v"]) for r in P.first_row_per_station(d.repartition(parts)).collect()} == {("s", "a"), ("t", "c")}
    assert {r["v"] for r in P.first_row_per_station(d.withColumn("n", -F.col("o")), "n").collect()} == {"b", "c"}


def test_a_folder_without_payloads_is_an_error(spark, tmp_path):
    (tmp_path / "other_tft_feature_importance.json").write_text(json.dumps({"feature_importance": {"a": 1}}))
    with pytest.raises(ValueError, match="no importance payload"):
        read_importance(spark, str(tmp_path))


def test_results_without_a_known_model_are_an_error(spark):
    d = spark.createDataFrame([("gru", "passado", 0.5, 1.0, 7, "x", 30)], "model string, period string, LogNSE double, NSE double, horizon int, study_name string, lookback int")
    assert not X.normalise_results(d).collect()
    with pytest.raises(ValueError, match="no row"):
        X.normalise_results(d, required=True)
    with pytest.raises(Exception, match="no tft study for period passado and horizon 15"):
        X.best_study_per_horizon(d.withColumn("model", F.lit("tft")), "passado", horizons=[7, 15]).collect()
    assert X.best_study_per_horizon(d.withColumn("model", F.lit("tft")), "passado", horizons=[7]).first()["lookback"] == 30


def test_bars_count_names_that_the_first_entry_lacks(spark):
    rows = [("s", 0, {"a": 0.5}), ("s", 1, {"a": 0.3, "b": 0.8}), ("t", 0, {"b": 0.4}), ("t", 1, {"b": float("nan")})]
    entries = spark.createDataFrame(rows, "study string, entry long, m map<string,double>")
    names = spark.createDataFrame([("oni", 0), ("a", 1), ("b", 2), ("c", 3), ("d", 4)], "variable string, position int")
    got = {(r["study"], r["variable"]): r["bar_value"] for r in I.bar_values(entries, names).collect()}
    assert {v for _, v in got} == {"oni", "a", "b", "c"}  # the first four
    assert got["s", "b"] == pytest.approx(40.0) and got["t", "b"] == pytest.approx(40.0) and got["s", "a"] == pytest.approx(40.0) and got["t", "a"] == 0.0


def test_encoder_variables_of_both_shapes(spark):
    d = spark.createDataFrame([("s", [{"a": 1.0, "b": 2.0}, {"a": 3.0}])], "study string, encoder_variables array<map<string,double>>")
    assert {(r["variable"], r["importance"]) for r in I.encoder_variable_means(d).collect()} == {("a", 2.0), ("b", 1.0)}
    d = spark.createDataFrame([("s", {"a": 1.5})], "study string, encoder_variables map<string,double>")
    assert [(r["variable"], r["importance"]) for r in I.encoder_variable_means(d).collect()] == [("a", 1.5)]


def test_seasons(spark):
    d = spark.createDataFrame([(7, f"2000-{m:02d}-15", 0, float(m)) for m in range(1, 13)] + [(7, None, 0, 100.0)], "horizon int, date string, lag int, value double").withColumn("date", F.col("date").cast("date"))
    got = {r["season"]: (r["mean_attention"], r["n_samples"]) for r in I.seasonal_attention(d).collect()}
    assert got == {"DJF": (5.0, 3), "MAM": (4.0, 3), "JJA": (7.0, 3), "SON": (10.0, 3), None: (178.0 / 13, 13)}


def test_scaling_from_written_metadata(spark):
    d = spark.createDataFrame([("s", "Passado", 1.0), ("s", "Teste", 5.0), ("s", "Recente", 3.0), ("t", "Passado", 2.0), ("t", "Teste", None)], "station_id string, period string, x double")
    scaled, meta = P.min_max_scale(d, ["x"])
    key = lambda t: sorted(map(repr, t.select("station_id", "period", "x").collect()))
    assert key(P.apply_min_max(d, meta, ["x"])) == key(scaled)


def test_training_splits_are_written_in_one_pass(spark, tmp_path):
    rows = [("s", f"19{y}-06-01", 1.0, 2.0) for y in range(85, 99)] + [("s", "1991-06-02", None, 2.0)]
    d = spark.createDataFrame(rows, "station_id string, date string, streamflow_m3s double, oni double").withColumn("date", F.col("date").cast("date"))
    t = P.write_training_splits(d, str(tmp_path / "t"), features=("oni",))
    assert {r["period"]: r["n_rows"] for r in P.split_metadata(t).collect()} == {"Passado": 6, "Recente": 8}
    t = P.write_training_splits(d.where("date < '1990-01-01'"), str(tmp_path / "t"), features=("oni",))  # the other period's folder stays
    assert {r["period"]: r["n_rows"] for r in P.split_metadata(t).collect()} == {"Passado": 5, "Recente": 8}
    assert {r["streamflow_m3s"] for r in P.split_by_period(t)["Recente"].collect()} == {1.0}
