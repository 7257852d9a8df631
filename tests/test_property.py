"""Hypothesis property test: W1 equals pandas interpolate on arbitrary gap patterns."""

import datetime as dt

import numpy as np
import pandas as pd
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from hydroframe.operators.prepare import fill_short_gaps

series = st.lists(st.one_of(st.none(), st.integers(-50, 50).map(float)), min_size=1, max_size=60)


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(vals=series, step=st.integers(1, 20), mode=st.sampled_from(["inside", "forward"]))
def test_fill_matches_pandas(spark, vals, step, mode):
    start = dt.date(1999, 11, 1)  # with steps up to 20 days the series crosses year blocks
    rows = [("s", start + dt.timedelta(days=i * step), v) for i, v in enumerate(vals)]
    df = spark.createDataFrame(rows, "station_id string, date date, v double")
    limit = 3 if mode == "inside" else 5
    got = fill_short_gaps(df, ["v"], limit, mode).orderBy("date").toPandas()["v"].to_numpy(dtype="float64")
    s = pd.Series([np.nan if v is None else v for v in vals], dtype="float64")
    if mode == "inside":
        exp = s.interpolate(method="linear", limit=3, limit_direction="both", limit_area="inside")
    else:
        exp = s.interpolate(method="linear", limit=5)
    np.testing.assert_allclose(got, exp.to_numpy(), rtol=1e-12, equal_nan=True)


flows = st.lists(st.one_of(st.none(), st.integers(0, 6).map(float)), min_size=2, max_size=50)


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(vals=flows, gaps=st.lists(st.integers(1, 40), min_size=50, max_size=50),
       q=st.sampled_from([0.5, 0.75, 0.9]), min_days=st.integers(1, 3))
def test_events_match_brute_force(spark, vals, gaps, q, min_days):
    from hydroframe.operators.readiness import detect_events
    from tests.test_events import brute_events
    if all(v is None for v in vals):
        return
    dates, d = [], dt.date(1999, 12, 1)
    for i in range(len(vals)):  # absent dates between rows, crossing year blocks
        dates.append(d)
        d = d + dt.timedelta(days=gaps[i])
    rows = [("s", x, v) for x, v in zip(dates, vals)]
    df = spark.createDataFrame(rows, "station_id string, date date, streamflow_m3s double")
    got = sorted((r.event_start_date, r.event_end_date, r.peak_date, r.peak_streamflow_m3s, r.event_duration_days)
                 for r in detect_events(df, q, min_days).collect())
    _, exp = brute_events(dates, np.array([np.nan if v is None else v for v in vals]), q, min_days)
    assert got == sorted(e[:5] for e in exp)
