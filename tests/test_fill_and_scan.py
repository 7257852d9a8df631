"""W1 gap fill and the blocked scans against pandas / plain windows on hand and random series."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from hydroframe.operators.prepare import fill_short_gaps
from hydroframe.operators.scan import blocked_scan, neighbour_rows, row_index


def _frame(spark, rows):
    return spark.createDataFrame(rows, "station_id string, date date, v double")


def _series(values, start=dt.date(2000, 12, 20), step=1):
    return [(start + dt.timedelta(days=i * step), None if (v is None or np.isnan(v)) else float(v))
            for i, v in enumerate(values)]


def _pandas_fill(values, mode):
    s = pd.Series(values, dtype="float64")
    if mode == "inside":
        return s.interpolate(method="linear", limit=3, limit_direction="both", limit_area="inside")
    return s.interpolate(method="linear", limit=5)


def _check(spark, stations, mode, limit):
    rows = []
    for sid, vals, start, step in stations:
        rows += [(sid, d, v) for d, v in _series(vals, start, step)]
    got = fill_short_gaps(_frame(spark, rows), ["v"], limit=limit, mode=mode).toPandas()
    for sid, vals, start, step in stations:
        g = got[got.station_id == sid].sort_values("date")["v"].to_numpy(dtype="float64")
        exp = _pandas_fill([np.nan if v is None else v for v in vals], mode).to_numpy()
        np.testing.assert_allclose(g, exp, rtol=1e-12, equal_nan=True)


GAPS = [1.0, None, 3.0, None, None, 5.0, None, None, None, 9.0, None, None, None, None, None, None, None, 20.0,
        None, None, None, None, None, None, None, None, None, None, None, None, None, None, 50.0, None, None]


@pytest.mark.parametrize("mode,limit", [("inside", 3), ("forward", 5)])
def test_fill_hand_gaps_across_year_blocks(spark, mode, limit):
    lead = [None, None] + GAPS
    _check(spark, [("a", GAPS, dt.date(2000, 12, 20), 1), ("b", lead, dt.date(1999, 12, 25), 1),
                   ("c", [None, None, None], dt.date(2001, 1, 1), 1), ("d", [4.0], dt.date(2001, 1, 1), 1)],
           mode, limit)


def test_seven_day_gap_inside_keeps_middle_null(spark):
    vals = [1.0] + [None] * 7 + [9.0]
    rows = [("s", d, v) for d, v in _series(vals)]
    got = fill_short_gaps(_frame(spark, rows), ["v"], 3, "inside").orderBy("date").toPandas()["v"].tolist()
    assert got[1:4] == [2.0, 3.0, 4.0] and np.isnan(got[4]) and got[5:8] == [6.0, 7.0, 8.0]


@pytest.mark.parametrize("seed", [1, 2, 3])
@pytest.mark.parametrize("mode,limit", [("inside", 3), ("forward", 5)])
def test_fill_random_against_pandas(spark, seed, mode, limit):
    rng = np.random.default_rng(seed)
    stations = []
    for k in range(3):
        n = int(rng.integers(5, 900))
        vals = rng.normal(size=n)
        vals[rng.random(n) < rng.uniform(0.1, 0.6)] = np.nan
        # every few days, so one station spans several year blocks
        stations.append((f"s{k}", [None if np.isnan(v) else v for v in vals], dt.date(1990, 6, 1), int(rng.integers(1, 4))))
    _check(spark, stations, mode, limit)


def test_row_index_and_neighbours_equal_plain_windows(spark):
    rng = np.random.default_rng(7)
    rows = []
    for s in range(4):
        days = sorted(set(rng.integers(0, 3000, size=int(rng.integers(1, 400))).tolist()))
        rows += [(f"s{s}", dt.date(1995, 1, 1) + dt.timedelta(days=int(d)), float(d)) for d in days]
    df = _frame(spark, rows)
    w = Window.partitionBy("station_id").orderBy("date")
    plain = df.select("station_id", "date", (F.row_number().over(w) - 1).alias("p"),
                      F.lag("v").over(w).alias("lag"), F.lead("v").over(w).alias("lead"))
    got = row_index(df, ["station_id"], "date", "p")
    got = neighbour_rows(got, ["station_id"], "date", prev_cols=["v"], next_cols=["v"])
    a = plain.orderBy("station_id", "date").collect()
    b = got.select("station_id", "date", "p", F.col("v__prev").alias("lag"), F.col("v__next").alias("lead")) \
           .orderBy("station_id", "date").collect()
    assert a == b


def test_blocked_flags_are_running_counts(spark):
    rows = [("s", dt.date(1999, 12, 28) + dt.timedelta(days=i), float(i % 3)) for i in range(10)]
    got = blocked_scan(_frame(spark, rows), ["station_id"], "date", pos="p",
                       flags={"n0": F.col("v") == 0}).orderBy("date").collect()
    assert [r.n0 for r in got] == [1, 1, 1, 2, 2, 2, 3, 3, 3, 4]
    assert [r.p for r in got] == list(range(10))
