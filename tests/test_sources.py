"""Text, JSON and streaming sources on files written to a scratch folder."""

import json
import os
import tempfile

from pyspark.sql import functions as F

from hydroframe.operators.prepare import monthly_index_long
from hydroframe.sources.files import read_importance
from hydroframe.sources.text import read_attribute_tables, read_daily_files, read_monthly_index


def test_daily_files_and_monthly_index(spark):
    d = tempfile.mkdtemp(prefix="hf-src-")
    for sid, rows in {"100": ["2000 1 1 5.0", "2000 1 2 nan", "2000 1 3 NaN", "2000 2 30 1.0"],
                      "200": ["1999 12 31   7.5"]}.items():
        with open(os.path.join(d, f"{sid}_streamflow_m3s.txt"), "w") as f:
            f.write("year month day streamflow_m3s\n" + "\n".join(rows) + "\n")
    t = read_daily_files(spark, d, "streamflow_m3s").orderBy("station_id", "date").collect()
    assert [(r.station_id, str(r.date), r.streamflow_m3s) for r in t] == [
        ("100", "2000-01-01", 5.0), ("100", "2000-01-02", None), ("100", "2000-01-03", None),
        ("200", "1999-12-31", 7.5)]  # bad date dropped (lenient P1)
    with open(os.path.join(d, "oni.txt"), "w") as f:
        f.write(" 1950 2023\n" + "1999 " + " ".join(["0.5"] * 11) + " -99.9\nYEAR x\n2000 " + " ".join(["1.0"] * 12) + "\n")
    wide = read_monthly_index(spark, os.path.join(d, "oni.txt"))
    long = monthly_index_long(wide).collect()
    assert len(long) == 24 and sum(r.oni is None for r in long) == 1


def test_attribute_tables(spark):
    d = tempfile.mkdtemp(prefix="hf-attr-")
    with open(os.path.join(d, "camels_br_location.txt"), "w") as f:
        f.write("gauge_id gauge_name gauge_lat\n10 RioA -25.5\n20 RioB nan\n")
    with open(os.path.join(d, "camels_br_other.txt"), "w") as f:
        f.write("code x\n1 2\n")
    t = read_attribute_tables(spark, d)
    assert list(t) == ["location"]
    rows = t["location"].orderBy("gauge_id").collect()
    assert rows[0].gauge_lat == -25.5 and rows[1].gauge_lat is None and rows[0].gauge_name == "RioA"


def test_importance_two_shapes(spark):
    d = tempfile.mkdtemp(prefix="hf-json-")
    docs = {"tft_passado_lb30_h7_tft_feature_importance.json": {"feature_importance": {"a": 1.0},
                                                                "encoder_variables": {"oni": 2.0}},
            "tft_recente_lb60_h7_tft_feature_importance.json": {"feature_importance": {"a": 3.0},
                                                                "encoder_variables": [{"oni": 1.0}, {"oni": 3.0}]},
            "other_tft_feature_importance.json": {"feature_importance": {"a": 9.0}}}
    for name, doc in docs.items():
        with open(os.path.join(d, name), "w") as f:
            json.dump(doc, f)
    r = {x.source: x for x in read_importance(spark, d).collect()}
    assert len(r) == 2
    assert r["tft_passado_lb30_h7_tft_feature_importance.json"].encoder_variables == [{"oni": 2.0}]
    assert len(r["tft_recente_lb60_h7_tft_feature_importance.json"].encoder_variables) == 2


def test_streaming_daily_files(spark):
    from hydroframe.streaming import daily_stream
    d = tempfile.mkdtemp(prefix="hf-stream-")
    with open(os.path.join(d, "7_streamflow_m3s.txt"), "w") as f:
        f.write("year month day streamflow_m3s\n1985 3 1 2.0\n2012 3 1 4.0\n")
    s = daily_stream(spark, d, "streamflow_m3s", ["year", "month", "day", "streamflow_m3s"])
    q = s.writeStream.format("memory").queryName("hf_daily").outputMode("append").start()
    q.processAllAvailable(); q.stop()
    rows = spark.sql("SELECT * FROM hf_daily ORDER BY date").collect()
    assert [(r.station_id, r.period) for r in rows] == [("7", "Passado"), ("7", "Teste")]
