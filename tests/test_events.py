"""W2/W3/A8 against a brute-force pandas implementation of the reference rules."""

import datetime as dt

import numpy as np
import pandas as pd

from hydroframe.operators.readiness import detect_events, event_summary, inter_event_gaps


def brute_events(dates, flows, q, min_days):
    s = pd.DataFrame({"date": pd.to_datetime(dates), "f": flows}).sort_values("date").reset_index(drop=True)
    thr = s["f"].dropna().quantile(q)
    ev = s["f"].fillna(-np.inf) >= thr
    grp = (ev != ev.shift(fill_value=False)).cumsum()
    out = []
    for _, g in s[ev].groupby(grp[ev]):
        start, end = g["date"].min(), g["date"].max()
        dur = (end - start).days + 1
        if dur < min_days:
            continue
        pk = g.loc[g["f"].idxmax()]
        out.append((start.date(), end.date(), pk["date"].date(), float(pk["f"]), dur, float(g["f"].mean())))
    return thr, out


def _df(spark, rows):
    return spark.createDataFrame(rows, "station_id string, date date, streamflow_m3s double")


def test_events_match_brute_force_random(spark):
    rng = np.random.default_rng(11)
    rows, expect = [], {}
    for s in range(3):
        n = 700
        days = np.sort(rng.choice(np.arange(1500), size=n, replace=False))  # absent dates
        dates = [dt.date(1996, 1, 1) + dt.timedelta(days=int(d)) for d in days]
        flows = np.round(rng.gamma(2.0, 3.0, size=n), 1)  # ties
        flows[rng.random(n) < 0.05] = np.nan  # nulls split events
        rows += [(f"s{s}", d, None if np.isnan(f) else float(f)) for d, f in zip(dates, flows)]
        expect[f"s{s}"] = brute_events(dates, flows, 0.8, 2)[1]
    got = detect_events(_df(spark, rows), 0.8, 2).collect()
    for sid, exp in expect.items():
        g = sorted((r.event_start_date, r.event_end_date, r.peak_date, r.peak_streamflow_m3s, r.event_duration_days,
                    round(r.event_mean_streamflow_m3s, 9)) for r in got if r.station_id == sid)
        e = sorted((a, b, c, d, e_, round(f, 9)) for a, b, c, d, e_, f in exp)
        assert g == e
        ids = sorted(r.event_id for r in got if r.station_id == sid)
        assert ids == list(range(1, len(ids) + 1))


def test_peak_tie_takes_earliest_and_gaps(spark):
    d0 = dt.date(2000, 1, 1)
    flows = [1, 5, 9, 9, 1, 1, 9, 8, 1, 1]
    rows = [("s", d0 + dt.timedelta(days=i), float(f)) for i, f in enumerate(flows)]
    ev = detect_events(_df(spark, rows), 0.5, 1)
    g = inter_event_gaps(ev).orderBy("event_id").collect()
    assert [r.peak_date for r in g] == [d0 + dt.timedelta(days=2), d0 + dt.timedelta(days=6)]
    assert g[1].inter_event_gap_days == 2 and g[1].days_between_event_starts == 5
    assert g[0].days_until_next_event_from_end == 2 and g[1].next_event_start_date is None


def test_summary_branches(spark):
    d0 = dt.date(2000, 1, 1)
    rows = [("flat", d0 + dt.timedelta(days=i), 1.0) for i in range(5)]
    rows += [("nulls", d0 + dt.timedelta(days=i), None) for i in range(5)]
    rows += [("outside", dt.date(1990, 1, 1), 3.0)]
    rows += [("ok", d0 + dt.timedelta(days=i), float(v)) for i, v in enumerate([1, 9, 1, 9, 9, 1, 1, 9])]
    s = {r.station_id: r for r in event_summary(_df(spark, rows), 0.5, 1, "1999-01-01", "2001-01-01").collect()}
    assert s["nulls"].event_count is None and s["nulls"].analysis_start_date is None
    assert s["outside"].event_count == 0 and s["outside"].analysis_start_date == dt.date(1999, 1, 1)
    assert s["flat"].event_count == 1  # every day ≥ threshold: one long event
    ok = s["ok"]
    assert ok.event_count == 3 and ok.average_days_between_event_starts == 3.0
    assert ok.suggested_lstm_lookback_days == 3 and ok.median_inter_event_gap_days == 1.5
