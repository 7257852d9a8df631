"""DuckDB SQL oracles for the registered queries (same column names, doubles rounded to 6)."""

from __future__ import annotations

ORACLE: dict[str, str] = {}


def r4(expr: str) -> str:
    """Half-even rounding to 4 places done in exact decimal arithmetic (as the library does)."""
    return f"CAST(round_even(CAST(round({expr}, 9) AS DECIMAL(38,9)), 4) AS DOUBLE)"

# Shared CTE text: the stand-in daily flow (orders ⋈ customer, one row per station-day of its span).
DAILY_FLOW = """
obs AS (
  SELECT CAST(c.c_nationkey AS VARCHAR) AS station_id, CAST(o.o_orderdate AS DATE) AS date,
         SUM(o.o_totalprice) AS streamflow_m3s
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey GROUP BY 1, 2),
span AS (SELECT station_id, MIN(date) AS a, MAX(date) AS b FROM obs GROUP BY 1),
cal AS (SELECT station_id, CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS date FROM span),
daily AS (SELECT cal.station_id, cal.date, obs.streamflow_m3s FROM cal LEFT JOIN obs USING (station_id, date))
"""


def fill_cte(name: str, src: str, col: str, limit: int, mode: str, extra: str = "") -> str:
    """Gap fill of one column by row position (reference semantics, plain windows)."""
    if mode == "inside":
        cond = f"pp IS NOT NULL AND np IS NOT NULL AND (p - pp <= {limit} OR np - p <= {limit})"
        val = "pv + (nv - pv) * (p - pp) / (np - pp)"
    else:
        cond = f"pp IS NOT NULL AND p - pp <= {limit}"
        val = "CASE WHEN np IS NOT NULL THEN pv + (nv - pv) * (p - pp) / (np - pp) ELSE pv END"
    return f"""
{name}_p AS (SELECT *, row_number() OVER (PARTITION BY station_id ORDER BY date) - 1 AS p FROM {src}),
{name}_n AS (SELECT *,
   last_value({col} IGNORE NULLS) OVER w1 AS pv,
   last_value(CASE WHEN {col} IS NOT NULL THEN p END IGNORE NULLS) OVER w1 AS pp,
   first_value({col} IGNORE NULLS) OVER w2 AS nv,
   first_value(CASE WHEN {col} IS NOT NULL THEN p END IGNORE NULLS) OVER w2 AS np
  FROM {name}_p
  WINDOW w1 AS (PARTITION BY station_id ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
         w2 AS (PARTITION BY station_id ORDER BY p ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
{name} AS (SELECT * EXCLUDE (p, pv, pp, nv, np, {col}),
   CASE WHEN {col} IS NULL AND {cond} THEN {val} ELSE {col} END AS {col} {extra} FROM {name}_n)
"""


def events_ctes(src: str, q: float, min_days: int, start: str, end: str) -> str:
    return f"""
s AS (SELECT station_id, date, streamflow_m3s FROM {src}
      WHERE date BETWEEN DATE '{start}' AND DATE '{end}'),
thr AS (SELECT station_id, quantile_cont(streamflow_m3s, {q}) AS thr FROM s GROUP BY 1),
sp AS (SELECT s.*, thr.thr, row_number() OVER (PARTITION BY s.station_id ORDER BY s.date) AS p
       FROM s JOIN thr USING (station_id)),
ev AS (SELECT *, p - row_number() OVER (PARTITION BY station_id ORDER BY date) AS isl
       FROM sp WHERE streamflow_m3s >= thr),
evg AS (SELECT station_id, MIN(date) AS event_start_date, MAX(date) AS event_end_date,
               first(date ORDER BY streamflow_m3s DESC, date) AS peak_date,
               MAX(streamflow_m3s) AS peak_streamflow_m3s,
               CAST(MAX(date) - MIN(date) + 1 AS INTEGER) AS event_duration_days,
               AVG(streamflow_m3s) AS event_mean_streamflow_m3s
        FROM ev GROUP BY station_id, isl),
events AS (SELECT station_id,
               CAST(row_number() OVER (PARTITION BY station_id ORDER BY event_start_date) AS INTEGER) AS event_id,
               event_start_date, event_end_date, peak_date, peak_streamflow_m3s, event_duration_days,
               event_mean_streamflow_m3s
           FROM evg WHERE event_duration_days >= {min_days}),
gaps AS (SELECT *,
    lag(event_end_date) OVER w AS previous_event_end_date,
    lead(event_start_date) OVER w AS next_event_start_date,
    CAST(event_start_date - lag(event_start_date) OVER w AS INTEGER) AS days_between_event_starts,
    CAST(event_start_date - lag(event_end_date) OVER w - 1 AS INTEGER) AS inter_event_gap_days,
    CAST(lead(event_start_date) OVER w - event_start_date AS INTEGER) AS days_until_next_event_start,
    CAST(lead(event_start_date) OVER w - event_end_date - 1 AS INTEGER) AS days_until_next_event_from_end
  FROM events WINDOW w AS (PARTITION BY station_id ORDER BY event_start_date))
"""


ORACLE["event_summary"] = f"""
WITH {DAILY_FLOW},
{fill_cte('filled', 'daily', 'streamflow_m3s', 3, 'inside')},
{events_ctes('filled', 0.9, 2, '1995-03-01', '2001-06-30')},
ser AS (SELECT station_id, COUNT(*) AS n, COUNT(streamflow_m3s) AS valid,
               MIN(CASE WHEN streamflow_m3s IS NOT NULL THEN date END) AS sf_start,
               first(date ORDER BY streamflow_m3s DESC NULLS LAST, date) AS sf_peak_date,
               MAX(streamflow_m3s) AS sf_peak, quantile_cont(streamflow_m3s, 0.9) AS thr
        FROM s GROUP BY 1),
eg AS (SELECT station_id, COUNT(*) AS cnt, AVG(event_duration_days) AS avg_dur,
              AVG(inter_event_gap_days) AS avg_gap, median(inter_event_gap_days) AS med_gap,
              AVG(days_between_event_starts) AS avg_bs, median(days_between_event_starts) AS med_bs,
              MIN(event_start_date) AS fst, MAX(event_end_date) AS lst, AVG(peak_streamflow_m3s) AS avg_peak,
              first(peak_date ORDER BY peak_streamflow_m3s DESC, event_start_date) AS pk_date,
              MAX(peak_streamflow_m3s) AS pk
       FROM gaps GROUP BY 1),
st AS (SELECT DISTINCT station_id FROM filled),
j AS (SELECT st.station_id, COALESCE(ser.n, 0) AS n, COALESCE(ser.valid, 0) AS valid, COALESCE(eg.cnt, 0) AS cnt,
             ser.*, eg.* EXCLUDE (cnt)
      FROM st LEFT JOIN ser USING (station_id) LEFT JOIN eg USING (station_id)),
k AS (SELECT *, (n > 0 AND valid > 0 AND cnt > 0) AS full_, n = 0 AS empty_,
             {r4('avg_bs')} AS rec, CAST(lst - fst + 1 AS INTEGER) AS span_ FROM j)
SELECT station_id,
  CASE WHEN full_ OR empty_ THEN DATE '1995-03-01' END AS analysis_start_date,
  CASE WHEN full_ OR empty_ THEN DATE '2001-06-30' END AS analysis_end_date,
  CASE WHEN full_ THEN sf_start END AS streamflow_start_date,
  CASE WHEN full_ THEN sf_peak_date END AS streamflow_peak_date,
  CASE WHEN full_ THEN round({r4('sf_peak')}, 6) END AS streamflow_peak_m3s,
  CASE WHEN full_ THEN CAST(sf_peak_date - sf_start AS INTEGER) END AS days_from_streamflow_start_to_peak,
  CASE WHEN full_ OR empty_ OR (valid > 0 AND cnt = 0) THEN CAST(cnt AS BIGINT) END AS event_count,
  CASE WHEN full_ THEN round({r4('avg_dur')}, 6) END AS average_event_duration_days,
  CASE WHEN full_ THEN round({r4('avg_gap')}, 6) END AS average_inter_event_gap_days,
  CASE WHEN full_ THEN round({r4('med_gap')}, 6) END AS median_inter_event_gap_days,
  CASE WHEN full_ THEN round(rec, 6) END AS average_days_between_event_starts,
  CASE WHEN full_ THEN round({r4('med_bs')}, 6) END AS median_days_between_event_starts,
  CASE WHEN full_ THEN round(rec, 6) END AS event_recurrence_every_n_days,
  CASE WHEN full_ AND span_ > 0 THEN round({r4('cnt / (span_ / 365.25)')}, 6) END AS event_frequency_per_year,
  CASE WHEN full_ THEN round({r4('avg_peak')}, 6) END AS average_peak_streamflow_m3s,
  CASE WHEN full_ THEN pk_date END AS peak_flow_date,
  CASE WHEN full_ THEN round({r4('pk')}, 6) END AS peak_flow_streamflow_m3s,
  CASE WHEN full_ THEN fst END AS first_event_start_date,
  CASE WHEN full_ THEN lst END AS last_event_end_date,
  CASE WHEN full_ THEN round({r4('thr')}, 6) END AS event_threshold_streamflow_m3s,
  CASE WHEN full_ THEN CAST(0.9 AS DOUBLE) END AS event_quantile,
  CASE WHEN full_ THEN CAST(2 AS INTEGER) END AS min_duration_days,
  CASE WHEN full_ AND rec IS NOT NULL THEN CAST(greatest(1, round_even(rec, 0)) AS INTEGER) END AS suggested_lstm_lookback_days
FROM k
"""


def rnd(cols: list[str]) -> str:
    """Select list rounding double columns to 6 places."""
    return ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in cols)


ORACLE["gap_fill_inside"] = f"""
WITH {DAILY_FLOW},
{fill_cte('filled', 'daily', 'streamflow_m3s', 3, 'inside')}
SELECT station_id, date, round(streamflow_m3s, 6) AS streamflow_m3s FROM filled
"""

ORACLE["gap_fill_forward"] = f"""
WITH {DAILY_FLOW},
{fill_cte('filled', 'daily', 'streamflow_m3s', 5, 'forward')}
SELECT station_id, date, round(streamflow_m3s, 6) AS streamflow_m3s FROM filled
"""

# Stand-in forcings, monthly index (wide → long with the sentinel cell) and static attributes.
PREP_CTES = f"""
{DAILY_FLOW},
forc AS (SELECT CAST(s.s_nationkey AS VARCHAR) AS station_id, CAST(l.l_shipdate AS DATE) AS date,
                SUM(l.l_quantity) AS precipitation, AVG(l.l_discount) AS temperature, AVG(l.l_tax) AS actual_evapotransp
         FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey GROUP BY 1, 2),
joined AS (SELECT COALESCE(daily.station_id, forc.station_id) AS station_id, COALESCE(daily.date, forc.date) AS date,
                  daily.streamflow_m3s, forc.precipitation, forc.temperature, forc.actual_evapotransp
           FROM daily FULL OUTER JOIN forc ON daily.station_id = forc.station_id AND daily.date = forc.date),
mi AS (SELECT CAST(year(l_shipdate) AS INTEGER) AS year, CAST(month(l_shipdate) AS INTEGER) AS month,
              AVG(l_discount) AS v FROM lineitem GROUP BY 1, 2),
yrs AS (SELECT DISTINCT year FROM mi),
cells AS (SELECT y.year, CAST(g.month AS INTEGER) AS month, mi.v
          FROM yrs y CROSS JOIN (SELECT unnest(generate_series(1, 12)) AS month) g
          LEFT JOIN mi ON mi.year = y.year AND mi.month = g.month),
oni AS (SELECT year, month,
               CASE WHEN (CASE WHEN year = (SELECT MIN(year) FROM mi WHERE month = 1) AND month = 1 THEN -99.9 ELSE v END) > -99.0
                    THEN v END AS oni
        FROM cells WHERE year BETWEEN 1900 AND 2100),
sa AS (SELECT CAST(n.n_nationkey AS VARCHAR) AS station_id, CAST(n.n_regionkey AS DOUBLE) AS static_region_key,
              n.n_name AS static_nation_name, CAST(s.n AS DOUBLE) AS static_n_suppliers, s.bal AS static_mean_acctbal
       FROM nation n LEFT JOIN (SELECT s_nationkey, COUNT(*) AS n, AVG(s_acctbal) AS bal FROM supplier GROUP BY 1) s
       ON n.n_nationkey = s.s_nationkey)
"""

PERIOD_CASE = """CASE WHEN date BETWEEN DATE '1995-01-01' AND DATE '1996-12-31' THEN 'Passado'
     WHEN date BETWEEN DATE '1997-01-01' AND DATE '1999-12-31' THEN 'Recente'
     WHEN date BETWEEN DATE '2000-01-01' AND DATE '2001-08-01' THEN 'Teste' END"""

MASTER_FILL = ["streamflow_m3s", "precipitation", "temperature", "actual_evapotransp", "oni",
               "static_region_key", "static_n_suppliers", "static_mean_acctbal"]
MASTER_DOUBLES = MASTER_FILL + ["sin_day", "cos_day", "sin_month", "cos_month"]
MASTER_OTHER = ["station_id", "date", "year", "month", "day", "day_of_year", "period", "static_nation_name", "time_idx"]


def _chain_fill(src: str, cols: list[str], limit: int, mode: str) -> tuple[str, str]:
    parts, cur = [], src
    for i, c in enumerate(cols):
        name = f"f{i}"
        parts.append(fill_cte(name, cur, c, limit, mode))
        cur = name
    return ",\n".join(parts), cur


_fill_m, _last_m = _chain_fill("m2", MASTER_FILL, 5, "forward")
MASTER_CTES = f"""
{PREP_CTES},
m0 AS (SELECT j.*, CAST(year(j.date) AS INTEGER) AS year, CAST(month(j.date) AS INTEGER) AS month,
              CAST(day(j.date) AS INTEGER) AS day, CAST(dayofyear(j.date) AS INTEGER) AS day_of_year FROM joined j),
m1 AS (SELECT m0.*, oni.oni,
              sin(2 * pi() * day_of_year / 366.0) AS sin_day, cos(2 * pi() * day_of_year / 366.0) AS cos_day,
              sin(2 * pi() * month / 12.0) AS sin_month, cos(2 * pi() * month / 12.0) AS cos_month,
              {PERIOD_CASE} AS period,
              sa.static_region_key, sa.static_nation_name, sa.static_n_suppliers, sa.static_mean_acctbal
       FROM m0 LEFT JOIN oni USING (year, month) LEFT JOIN sa USING (station_id)),
m2 AS (SELECT *, row_number() OVER (PARTITION BY station_id ORDER BY date) - 1 AS time_idx FROM m1),
{_fill_m},
master AS (SELECT * FROM {_last_m}
           WHERE {' AND '.join(f'{c} IS NOT NULL' for c in MASTER_DOUBLES + MASTER_OTHER)})
"""

ORACLE["master_dataset"] = f"""
WITH {MASTER_CTES}
SELECT {', '.join(MASTER_OTHER)}, {rnd(MASTER_DOUBLES)} FROM master
"""

ORACLE["monthly_index_long"] = f"""
WITH {PREP_CTES}
SELECT year, month, round(oni, 6) AS oni FROM oni
"""

FIN_FILL = ["streamflow_m3s", "precipitation", "temperature", "actual_evapotransp", "oni",
            "static_region_key", "static_n_suppliers", "static_mean_acctbal", "month_sin", "month_cos"]
_fill_f, _last_f = _chain_fill("p1", FIN_FILL, 3, "inside")
FINAL_CTES = f"""
{PREP_CTES},
p0 AS (SELECT j.*, CAST(year(j.date) AS INTEGER) AS year, CAST(month(j.date) AS INTEGER) AS month,
              CAST(day(j.date) AS INTEGER) AS day FROM joined j),
p1 AS (SELECT p0.*, oni.oni, sa.static_region_key, sa.static_nation_name, sa.static_n_suppliers,
              sa.static_mean_acctbal,
              sin(2 * pi() * (month - 1) / 12.0) AS month_sin, cos(2 * pi() * (month - 1) / 12.0) AS month_cos
       FROM p0 LEFT JOIN oni USING (year, month) LEFT JOIN sa USING (station_id)),
{_fill_f},
p3 AS (SELECT *, {PERIOD_CASE} AS period FROM {_last_f}),
p4 AS (SELECT * FROM p3 WHERE period IN ('Passado', 'Recente', 'Teste')),
fin AS (SELECT *, CAST(date - MIN(date) OVER (PARTITION BY station_id) AS INTEGER) AS time_idx FROM p4)
"""


def _scale_ctes(cols: list[str]) -> str:
    aggs = ", ".join(f"CAST(MIN(CASE WHEN period IN ('Passado', 'Recente') THEN {c} END) AS DOUBLE) AS {c}__lo, "
                     f"CAST(MAX(CASE WHEN period IN ('Passado', 'Recente') THEN {c} END) AS DOUBLE) AS {c}__hi"
                     for c in cols)
    return f"fit AS (SELECT station_id, {aggs} FROM fin GROUP BY station_id)"


ORACLE["prepare_scaled"] = f"""
WITH {FINAL_CTES},
{_scale_ctes(FIN_FILL)}
SELECT fin.station_id, date, year, month, day, period, time_idx, static_nation_name,
  {', '.join(f'''round(CASE WHEN {c}__lo IS NULL THEN CAST({c} AS DOUBLE)
        WHEN abs({c}__lo - {c}__hi) <= 1e-8 + 1e-5 * abs({c}__hi) THEN CASE WHEN {c} IS NOT NULL THEN 0.0 END
        ELSE ({c} - {c}__lo) / ({c}__hi - {c}__lo) END, 6) AS {c}''' for c in FIN_FILL)}
FROM fin LEFT JOIN fit ON fin.station_id = fit.station_id
"""

ORACLE["scaling_metadata"] = f"""
WITH {FINAL_CTES},
{_scale_ctes(FIN_FILL)}
SELECT * FROM (
{' UNION ALL '.join(f"SELECT station_id, '{c}' AS column, round({c}__lo, 6) AS min, round({c}__hi, 6) AS max FROM fit"
                    for c in FIN_FILL)}
) WHERE min IS NOT NULL
"""

ORACLE["period_counts"] = f"""
WITH {PREP_CTES}
SELECT station_id, {PERIOD_CASE} AS period, COUNT(*) AS n_rows FROM joined GROUP BY 1, 2
"""

ORACLE["training_ready"] = f"""
WITH {FINAL_CTES},
st AS (SELECT station_id, COALESCE(greatest(MIN(CASE WHEN streamflow_m3s IS NOT NULL THEN date END), DATE '1995-02-01'),
              DATE '1995-02-01') AS start_ FROM fin GROUP BY 1)
SELECT fin.station_id, date, period, time_idx, year, month, day, round(streamflow_m3s, 6) AS streamflow_m3s,
       {rnd(['precipitation', 'oni', 'month_sin', 'month_cos', 'static_region_key', 'static_n_suppliers', 'static_mean_acctbal'])},
       static_nation_name
FROM fin JOIN st ON fin.station_id = st.station_id
WHERE date >= start_ AND streamflow_m3s IS NOT NULL AND precipitation IS NOT NULL AND oni IS NOT NULL
  AND month_sin IS NOT NULL AND month_cos IS NOT NULL
"""

EVENT_CTES = f"""
{DAILY_FLOW},
{fill_cte('filled', 'daily', 'streamflow_m3s', 3, 'inside')},
{events_ctes('filled', 0.9, 2, '1995-03-01', '2001-06-30')}
"""

ORACLE["flow_events"] = f"""
WITH {EVENT_CTES}
SELECT station_id, event_id, event_start_date, event_end_date, peak_date, {rnd(['peak_streamflow_m3s'])},
       event_duration_days, {rnd(['event_mean_streamflow_m3s'])}, previous_event_end_date, next_event_start_date,
       days_between_event_starts, inter_event_gap_days, days_until_next_event_start, days_until_next_event_from_end
FROM gaps
"""

ORACLE["event_windows"] = f"""
WITH {EVENT_CTES},
lb0 AS (SELECT station_id, {r4('AVG(days_between_event_starts)')} AS rec FROM gaps GROUP BY 1),
lb AS (SELECT station_id,
              CAST(CASE WHEN rec IS NULL THEN 30 ELSE greatest(1, round_even(rec, 0)) END AS INTEGER) AS L,
              CASE WHEN rec IS NULL THEN 'fixed_default_no_event_recurrence' ELSE 'auto_event_recurrence' END AS src
       FROM lb0)
SELECT e.station_id, event_id, CAST(event_start_date - L AS DATE) AS input_start_date,
       CAST(event_start_date - 1 AS DATE) AS input_end_date, event_start_date AS target_start_date,
       event_end_date AS target_end_date, L AS input_window_days,
       CAST(event_end_date - event_start_date + 1 AS INTEGER) AS target_window_days,
       event_start_date, event_end_date, peak_date, {rnd(['peak_streamflow_m3s'])},
       L AS lstm_lookback_days, src AS lstm_lookback_source
FROM events e JOIN lb ON e.station_id = lb.station_id
"""

FORCING_FILES = f"""
{DAILY_FLOW},
fg AS (SELECT CAST(s.s_nationkey AS VARCHAR) AS station_id, CAST(l.l_shipdate AS DATE) AS date,
              SUM(l.l_quantity) AS p_total, SUM(CASE WHEN l.l_quantity > 45 THEN l.l_quantity END) AS p_large,
              AVG(l.l_discount) AS tmean, MAX(l.l_discount) AS tmax, AVG(l.l_tax) AS aet_mean
       FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey GROUP BY 1, 2),
found AS (
  SELECT station_id, 'precipitation' AS variable, COUNT(*) AS rows, MIN(date) AS date_min, MAX(date) AS date_max,
         least(AVG(CASE WHEN p_total IS NULL THEN 1.0 ELSE 0.0 END) * 100.0,
               AVG(CASE WHEN p_large IS NULL THEN 1.0 ELSE 0.0 END) * 100.0) AS miss, 5.0 AS lim FROM fg GROUP BY 1
  UNION ALL
  SELECT station_id, 'temperature', COUNT(*), MIN(date), MAX(date),
         least(AVG(CASE WHEN tmean IS NULL THEN 1.0 ELSE 0.0 END) * 100.0,
               AVG(CASE WHEN tmax IS NULL THEN 1.0 ELSE 0.0 END) * 100.0), 5.0 FROM fg GROUP BY 1
  UNION ALL
  SELECT station_id, 'evapotransp', COUNT(*), MIN(date), MAX(date),
         AVG(CASE WHEN aet_mean IS NULL THEN 1.0 ELSE 0.0 END) * 100.0, 5.0 FROM fg GROUP BY 1
  UNION ALL
  SELECT station_id, 'streamflow', COUNT(*), MIN(date), MAX(date),
         AVG(CASE WHEN streamflow_m3s IS NULL THEN 1.0 ELSE 0.0 END) * 100.0, 5.0 FROM daily GROUP BY 1),
grid AS (SELECT CAST(n_nationkey AS VARCHAR) AS station_id, v.variable FROM nation
         CROSS JOIN (VALUES ('precipitation'), ('temperature'), ('evapotransp'), ('streamflow')) v(variable)),
cov AS (SELECT g.station_id, g.variable, f.rows IS NOT NULL AS file_exists, COALESCE(f.rows, 0) AS rows,
               f.date_min, f.date_max,
               COALESCE(f.rows IS NOT NULL AND f.date_min <= DATE '1995-01-10', false) AS coverage_start_ok,
               COALESCE(f.rows IS NOT NULL AND f.date_max >= DATE '2001-07-01', false) AS coverage_end_ok,
               CASE WHEN f.rows IS NOT NULL THEN {r4('COALESCE(f.miss, 100.0)')} ELSE 100.0 END AS missing_pct_best_source,
               f.miss AS miss_raw
        FROM grid g LEFT JOIN found f ON g.station_id = f.station_id AND g.variable = f.variable),
cov2 AS (SELECT *, coverage_start_ok AND coverage_end_ok AND COALESCE(miss_raw, 100.0) <= 5.0 AS variable_ready FROM cov)
"""

ORACLE["coverage"] = f"""
WITH {FORCING_FILES}
SELECT station_id, variable, file_exists, rows, date_min, date_max, coverage_start_ok, coverage_end_ok,
       round(missing_pct_best_source, 6) AS missing_pct_best_source, variable_ready FROM cov2
"""

GAUGE_BASE = """
gb AS (SELECT CAST(s.s_suppkey AS VARCHAR) AS gauge_id, s.s_suppkey AS k, s.s_name, s.s_acctbal, s.s_nationkey,
              CAST(n.n_nationkey AS DOUBLE) AS n_nationkey, CAST(n.n_regionkey AS DOUBLE) AS n_regionkey,
              CAST(p.p_size AS DOUBLE) AS p_size, p.p_retailprice, p.p_type
       FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey
       LEFT JOIN part p ON s.s_suppkey = p.p_partkey),
ga AS (SELECT gauge_id, k, s_acctbal, CAST(s_nationkey AS VARCHAR) AS station_id,
              p_size / 250.0 AS consumptive_use_perc,
              (p_retailprice - floor(p_retailprice)) / 50.0 AS regulation_degree,
              CASE WHEN p_type IN ('SMALL', 'PROMO') THEN 0.0 ELSE p_size / 10.0 END AS reservoirs_vol,
              100.0 - abs(s_acctbal) / 1000.0 AS q_quality_control_perc,
              100.0 - abs(s_acctbal) / 500.0 AS q_stream_stage_perc,
              s_name AS gauge_name, -20.0 - n_nationkey * 0.6 AS gauge_lat, -40.0 - n_regionkey AS gauge_lon,
              p_retailprice * 10.0 AS area_ana, p_retailprice * 10.0 AS area_gsim,
              CASE WHEN n_regionkey <= 2 THEN 'high' ELSE 'low' END AS area_gsim_quality,
              p_size * 20.0 AS elev_mean, p_retailprice / 100.0 AS slope_mean, p_retailprice * 10.0 AS area,
              100.0 - p_size * 2.0 AS crop_perc, p_size * 2.0 AS forest_perc, p_retailprice / 200.0 AS imperv_perc,
              p_type AS dom_land_cover, s_acctbal / 1000.0 AS p_mean, p_size / 10.0 AS pet_mean,
              p_retailprice / 1000.0 AS aridity, n_regionkey / 4.0 AS p_seasonality
       FROM gb)
"""

INTERVENTION = f"""
{GAUGE_BASE},
sfirst AS (SELECT station_id, AVG(consumptive_use_perc) AS consumptive_use_perc,
                  AVG(regulation_degree) AS regulation_degree, AVG(reservoirs_vol) AS reservoirs_vol,
                  AVG(q_quality_control_perc) AS q_quality_control_perc,
                  MIN(gauge_name) AS gauge_name, AVG(gauge_lat) AS gauge_lat,
                  AVG(forest_perc) AS forest_perc, AVG(crop_perc) AS crop_perc,
                  AVG(imperv_perc) AS imperv_perc, MIN(dom_land_cover) AS dom_land_cover
           FROM ga GROUP BY 1),
hi AS (SELECT h.station_id, COALESCE(h.gauge_name, '') AS gauge_name,
              h.q_quality_control_perc, h.consumptive_use_perc, h.regulation_degree, h.reservoirs_vol,
              h.forest_perc, h.crop_perc, h.imperv_perc, h.dom_land_cover,
              h.q_quality_control_perc >= 95.0 AS q_quality_ok, h.consumptive_use_perc <= 0.2 AS consumptive_ok,
              h.regulation_degree <= 0.01 AS regulation_ok, h.reservoirs_vol <= 0.0 AS reservoir_ok
       FROM sfirst h),
iv AS (SELECT CAST(n.n_nationkey AS VARCHAR) AS station_id, hi.station_id IS NOT NULL AS attribute_found,
              hi.* EXCLUDE (station_id),
              COALESCE(q_quality_ok AND consumptive_ok AND regulation_ok AND reservoir_ok, false) AS human_intervention_ready
       FROM nation n LEFT JOIN hi ON CAST(n.n_nationkey AS VARCHAR) = hi.station_id)
"""

ORACLE["human_intervention"] = f"""
WITH {INTERVENTION}
SELECT station_id, CASE WHEN attribute_found THEN true ELSE false END AS attribute_found, gauge_name,
       {rnd(['q_quality_control_perc', 'consumptive_use_perc', 'regulation_degree', 'reservoirs_vol',
             'forest_perc', 'crop_perc', 'imperv_perc'])}, dom_land_cover,
       q_quality_ok, consumptive_ok, regulation_ok, reservoir_ok, human_intervention_ready
FROM iv
"""

ORACLE["readiness_decision"] = f"""
WITH {FORCING_FILES}, {INTERVENTION},
dyn AS (SELECT station_id, bool_and(variable_ready) AS dynamic_data_ready,
               CAST(SUM(CASE WHEN NOT file_exists THEN 1 ELSE 0 END) AS INTEGER) AS missing_dynamic_files
        FROM cov2 GROUP BY 1),
dj AS (SELECT dyn.*, COALESCE(iv.human_intervention_ready, false) AS h FROM dyn LEFT JOIN iv USING (station_id))
SELECT station_id,
  CASE WHEN dynamic_data_ready AND h THEN 'APROVADA'
       WHEN NOT dynamic_data_ready AND h THEN 'REPROVADA_DADOS_DINAMICOS'
       WHEN dynamic_data_ready AND NOT h THEN 'REPROVADA_INTERVENCAO' ELSE 'REPROVADA' END AS verdict,
  dynamic_data_ready, h AS human_intervention_ready, missing_dynamic_files,
  CASE WHEN dynamic_data_ready AND h THEN 'A bacia atende cobertura temporal, faltantes maximos e criterios de intervencao humana.'
       WHEN NOT dynamic_data_ready AND h THEN 'Atributos de intervencao estao bons, mas as series dinamicas nao atendem cobertura/faltantes.'
       WHEN dynamic_data_ready AND NOT h THEN 'Series dinamicas estao boas, mas a intervencao humana/qualidade nao atende os criterios definidos.'
       ELSE 'A bacia nao atende aos criterios minimos de dados dinamicos e/ou intervencao humana.' END AS rationale
FROM dj
"""

RANK_DOUBLES = ["consumptive_use_perc", "regulation_degree", "reservoirs_vol", "q_quality_control_perc",
                "q_stream_stage_perc", "gauge_lat", "gauge_lon", "area_ana", "area_gsim", "elev_mean", "slope_mean",
                "area", "crop_perc", "forest_perc", "imperv_perc", "p_mean", "pet_mean", "aridity", "p_seasonality",
                "score_quality", "score_forest", "score_imperv", "score_consumptive", "score_regulation",
                "score_reservoirs", "score_data_availability", "recommended_score"]
RANK_OTHER = ["gauge_id", "gauge_name", "area_gsim_quality", "dom_land_cover", "has_local_dynamic_data", "rank"]

AVAIL = """
files AS (SELECT DISTINCT printf('%d_%s.txt', l_suppkey,
                 CASE WHEN l_returnflag = 'A' THEN 'precipitation' WHEN l_returnflag = 'R' THEN 'temperature'
                      WHEN l_linestatus = 'F' THEN 'actual_evapotransp' ELSE 'streamflow_m3s' END) AS file_name
          FROM lineitem),
av0 AS (SELECT file_name, CASE WHEN ends_with(file_name, '_precipitation.txt') THEN '_precipitation.txt'
                               WHEN ends_with(file_name, '_temperature.txt') THEN '_temperature.txt'
                               WHEN ends_with(file_name, '_actual_evapotransp.txt') THEN '_actual_evapotransp.txt'
                               WHEN ends_with(file_name, '_streamflow_m3s.txt') THEN '_streamflow_m3s.txt' END AS suffix
        FROM files),
avail AS (SELECT left(file_name, length(file_name) - length(suffix)) AS gauge_id FROM av0
          WHERE suffix IS NOT NULL GROUP BY 1 HAVING COUNT(DISTINCT suffix) = 4)
"""

RANKED = f"""
{GAUGE_BASE}, {AVAIL},
cand AS (SELECT * EXCLUDE (k, s_acctbal, station_id) FROM ga
         WHERE gauge_lat <= -22.0 AND gauge_lat >= -34.0 AND area_gsim_quality = 'high'
           AND q_quality_control_perc >= 95.0),
sc0 AS (SELECT c.*, a.gauge_id IS NOT NULL AS has_local_dynamic_data FROM cand c LEFT JOIN avail a USING (gauge_id)),
sc1 AS (SELECT *, q_quality_control_perc / 100.0 AS score_quality, forest_perc / 100.0 AS score_forest,
               1.0 - imperv_perc / 100.0 AS score_imperv, 1.0 / (1.0 + consumptive_use_perc) AS score_consumptive,
               1.0 / (1.0 + regulation_degree * 100.0) AS score_regulation, 1.0 / (1.0 + reservoirs_vol) AS score_reservoirs,
               CAST(has_local_dynamic_data AS DOUBLE) AS score_data_availability FROM sc0),
sc2 AS (SELECT *, 0.24 * score_quality + 0.16 * score_regulation + 0.16 * score_consumptive + 0.12 * score_forest
                  + 0.08 * score_imperv + 0.04 * score_reservoirs + 0.2 * score_data_availability AS recommended_score
        FROM sc1),
ranked AS (SELECT *, CAST(row_number() OVER (ORDER BY recommended_score DESC, has_local_dynamic_data DESC,
                    regulation_degree, consumptive_use_perc, reservoirs_vol, q_quality_control_perc DESC, gauge_id)
                    AS INTEGER) AS rank FROM sc2)
"""

ORACLE["dynamic_availability"] = f"WITH {AVAIL} SELECT gauge_id FROM avail"
ORACLE["ranking_scores"] = f"WITH {RANKED} SELECT {', '.join(RANK_OTHER)}, {rnd(RANK_DOUBLES)} FROM ranked"
ORACLE["ranking_top"] = f"WITH {RANKED} SELECT {', '.join(RANK_OTHER)}, {rnd(RANK_DOUBLES)} FROM ranked WHERE rank <= 15"

CMP_DOUBLES = ["gauge_lat", "area", "consumptive_use_perc", "regulation_degree", "reservoirs_vol",
               "q_quality_control_perc", "q_stream_stage_perc", "forest_perc", "crop_perc", "imperv_perc",
               "recommended_score"]
ORACLE["ranking_comparison"] = f"""
WITH {RANKED},
src AS (SELECT *, 0 AS s FROM ranked WHERE gauge_id = '72' UNION ALL SELECT *, 1 AS s FROM ranked WHERE rank <= 5),
dd AS (SELECT *, row_number() OVER (PARTITION BY gauge_id ORDER BY s, rank) AS kk FROM src),
kept AS (SELECT *, CAST(row_number() OVER (ORDER BY s, rank) AS INTEGER) AS row_order FROM dd WHERE kk = 1)
SELECT rank, gauge_id, gauge_name, has_local_dynamic_data, dom_land_cover, row_order, {rnd(CMP_DOUBLES)} FROM kept
"""

ORACLE["ranking_recommendation"] = f"""
WITH {RANKED},
c AS (SELECT *, row_number() OVER (ORDER BY CASE WHEN gauge_id = '72' THEN 0 ELSE 1 END, rank) AS kk
      FROM ranked WHERE gauge_id = '72' OR rank <= 2)
SELECT CASE WHEN kk = 1 THEN 'Bacia principal' ELSE 'Bacia reserva' END AS recommendation_role,
       gauge_id, gauge_name, rank, has_local_dynamic_data,
       {rnd(['recommended_score', 'q_quality_control_perc', 'consumptive_use_perc', 'regulation_degree',
             'reservoirs_vol', 'forest_perc', 'crop_perc', 'imperv_perc'])},
       CASE WHEN kk = 1 THEN 'Melhor equilibrio entre baixa intervencao humana, alta qualidade hidrologica e disponibilidade local das quatro series dinamicas.'
            ELSE 'Melhor alternativa caso seja necessario trocar a bacia principal, mantendo alta qualidade e baixa intervencao; pode exigir coleta adicional das series dinamicas.' END AS rationale
FROM c WHERE kk <= 2
"""

WIN_FEATS = ["precipitation", "temperature", "actual_evapotransp", "sin_day", "cos_day", "sin_month", "cos_month"]


def _z(c: str) -> str:
    return f"({c} - mu_{c}) / CASE WHEN sd_{c} IS NULL OR sd_{c} = 0 THEN 1.0 ELSE sd_{c} END"


SCALED = f"""
{MASTER_CTES},
t0 AS (SELECT station_id, date, time_idx, ln(1 + greatest(streamflow_m3s, 0)) AS target_log,
              greatest(streamflow_m3s, 0.0) AS target_raw, streamflow_m3s, {', '.join(WIN_FEATS)} FROM master),
stt AS (SELECT {', '.join(f'AVG({c}) AS mu_{c}, stddev_pop({c}) AS sd_{c}' for c in ['target_log'] + WIN_FEATS)} FROM t0),
zz AS (SELECT station_id, date, time_idx, target_raw, streamflow_m3s,
              {', '.join(f'{_z(c)} AS {c}' for c in ['target_log'] + WIN_FEATS)} FROM t0, stt),
wins AS (SELECT station_id, date AS window_end_date, COUNT(*) OVER f AS n_steps, first_value(date) OVER f AS first_input_date,
                SUM(target_log) OVER f AS sum_inputs_target, SUM(precipitation) OVER f AS sum_inputs_precip,
                lead(date, 7) OVER o AS target_date, lead(target_log, 7) OVER o AS target,
                lead(target_raw, 7) OVER o AS target_raw, row_number() OVER o AS rn
         FROM zz WINDOW f AS (PARTITION BY station_id ORDER BY date ROWS BETWEEN 29 PRECEDING AND CURRENT ROW),
                        o AS (PARTITION BY station_id ORDER BY date)),
wv AS (SELECT * FROM wins WHERE rn >= 30 AND target_date IS NOT NULL)
"""

ORACLE["lookback_windows"] = f"""
WITH {SCALED}
SELECT station_id, window_end_date, target_date, CAST(n_steps AS INTEGER) AS n_steps, first_input_date,
       {rnd(['sum_inputs_target', 'sum_inputs_precip', 'target', 'target_raw'])}
FROM wv
"""

ORACLE["chronological_split"] = f"""
WITH {SCALED},
pool AS (SELECT station_id, target_date,
                target_date BETWEEN DATE '1995-01-01' AND DATE '1999-12-31' AS in_pool,
                target_date BETWEEN DATE '2000-01-01' AND DATE '2001-08-01' AS in_test FROM wv),
cnt AS (SELECT station_id, SUM(CASE WHEN in_pool THEN 1 ELSE 0 END) AS n_pool,
               SUM(CASE WHEN in_test THEN 1 ELSE 0 END) AS n_test FROM pool GROUP BY 1),
rk AS (SELECT p.*, c.n_pool, c.n_test,
              SUM(CASE WHEN in_pool THEN 1 ELSE 0 END) OVER (PARTITION BY p.station_id ORDER BY target_date
                  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS prank,
              least(greatest(CAST(round_even(c.n_pool * 0.15, 0) AS BIGINT), 1), c.n_pool - 1) AS n_val
       FROM pool p JOIN cnt c ON p.station_id = c.station_id),
lab AS (SELECT *, CASE WHEN in_pool AND prank > n_pool - n_val THEN 'val' WHEN in_pool THEN 'train'
                       WHEN in_test THEN 'test' END AS split,
               CASE WHEN n_pool < 20 THEN 'too few training windows' WHEN n_test = 0 THEN 'no test window' END AS split_error
        FROM rk)
SELECT station_id, split, CAST(n_pool AS BIGINT) AS n_pool, split_error, COUNT(*) AS n_windows,
       MIN(target_date) AS first_target_date, MAX(target_date) AS last_target_date
FROM lab GROUP BY station_id, split, n_pool, split_error
"""

ORACLE["encoder_decoder_windows"] = f"""
WITH {MASTER_CTES},
ed AS (SELECT station_id, COUNT(*) OVER e AS n_enc, COUNT(*) OVER dcd AS n_dec,
              first_value(date) OVER e AS encoder_first_date, lead(date, 1) OVER o AS decoder_start_date,
              lead(time_idx, 1) OVER o AS decoder_start_idx, lead(date, 7) OVER o AS decoder_last_date,
              SUM(streamflow_m3s) OVER dcd AS sum_decoder_target, SUM(precipitation) OVER e AS sum_encoder_precip
       FROM master WINDOW o AS (PARTITION BY station_id ORDER BY date),
              e AS (PARTITION BY station_id ORDER BY date ROWS BETWEEN 29 PRECEDING AND CURRENT ROW),
              dcd AS (PARTITION BY station_id ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 7 FOLLOWING))
SELECT station_id, decoder_start_date, decoder_start_idx, encoder_first_date, decoder_last_date,
       {rnd(['sum_decoder_target', 'sum_encoder_precip'])}
FROM ed WHERE n_enc = 30 AND n_dec = 7
"""

GRID_REQ = ["streamflow_m3s", "precipitation", "temperature", "actual_evapotransp", "oni"]
GRID = f"""
{FINAL_CTES},
mon AS (SELECT station_id, CAST(date_trunc('month', date) AS DATE) AS month_start, COUNT(*) AS rows,
               SUM({' + '.join(f'CASE WHEN {c} IS NULL THEN 1 ELSE 0 END' for c in GRID_REQ)}) AS missing,
               first(period ORDER BY date) FILTER (WHERE period IS NOT NULL) AS period
        FROM fin GROUP BY 1, 2),
tg AS (SELECT station_id, month_start AS target_start_date, rows AS target_rows, missing AS target_missing_values,
              CAST(unnest(generate_series(1, 24)) AS INTEGER) AS window_months
       FROM mon WHERE period IN ('Teste')),
offs AS (SELECT station_id, target_start_date, window_months, unnest(generate_series(1, window_months)) AS k FROM tg),
inp AS (SELECT o.station_id, o.target_start_date, o.window_months, COALESCE(SUM(m.rows), 0) AS input_rows,
               COUNT(m.rows) AS input_month_count, COALESCE(SUM(m.missing), 0) AS input_missing_values
        FROM offs o LEFT JOIN mon m ON m.station_id = o.station_id
             AND m.month_start = CAST(o.target_start_date - to_months(CAST(o.k AS INTEGER)) AS DATE)
        GROUP BY 1, 2, 3),
grid AS (SELECT t.station_id, strftime(t.target_start_date, '%Y-%m') AS target_month, t.window_months,
                CAST(t.target_start_date - to_months(t.window_months) AS DATE) AS input_start_date,
                CAST(t.target_start_date - 1 AS DATE) AS input_end_date, t.target_start_date,
                CAST(last_day(t.target_start_date) AS DATE) AS target_end_date,
                CAST(i.input_rows AS BIGINT) AS input_rows, CAST(t.target_rows AS BIGINT) AS target_rows,
                i.input_month_count = t.window_months AS has_full_input_months, t.target_rows > 0 AS has_target_month,
                CAST(i.input_missing_values AS BIGINT) AS input_missing_values,
                CAST(t.target_missing_values AS BIGINT) AS target_missing_values,
                i.input_missing_values = 0 AND t.target_missing_values = 0 AS has_complete_data
         FROM tg t JOIN inp i ON t.station_id = i.station_id AND t.target_start_date = i.target_start_date
              AND t.window_months = i.window_months),
grid2 AS (SELECT *, has_full_input_months AND has_target_month AND has_complete_data AS is_candidate FROM grid)
"""

ORACLE["monthly_window_grid"] = f"WITH {GRID} SELECT * FROM grid2"
ORACLE["window_candidates"] = f"""
WITH {GRID}
SELECT station_id, target_month, COUNT(*) AS candidate_windows, MIN(window_months) AS min_window_months,
       MAX(window_months) AS max_window_months
FROM grid2 WHERE is_candidate GROUP BY 1, 2
"""

ORACLE["first_index_at_or_after"] = f"""
WITH {MASTER_CTES}
SELECT station_id, MIN(CASE WHEN date >= DATE '2000-01-01' THEN time_idx END) AS first_idx FROM master GROUP BY 1
"""

ORACLE["standardise_by_station"] = f"""
WITH {MASTER_CTES},
st AS (SELECT station_id, AVG(precipitation) AS mp, stddev_pop(precipitation) AS sp, AVG(temperature) AS mt,
              stddev_pop(temperature) AS stt FROM master GROUP BY 1)
SELECT m.station_id, date, {rnd(['precipitation', 'temperature'])},
       round((precipitation - mp) / CASE WHEN sp = 0 THEN 1.0 ELSE sp END, 6) + 0.0 AS precipitation_z,
       round((temperature - mt) / CASE WHEN stt = 0 THEN 1.0 ELSE stt END, 6) + 0.0 AS temperature_z
FROM master m JOIN st ON m.station_id = st.station_id
"""

PRED = """
pr AS (SELECT l.l_returnflag AS "group",
              CASE WHEN l.l_shipdate < TIMESTAMP '1999-01-01' THEN 'train' ELSE 'test' END AS split,
              l.l_extendedprice AS y_true, l.l_quantity * p.p_retailprice AS y_pred
       FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey)
"""


def metrics_select(src: str, keys: str) -> str:
    return f"""
mm AS (SELECT {keys}, COUNT(*) AS n, AVG(abs(y_true - y_pred)) AS MAE,
              sqrt(AVG((y_true - y_pred) * (y_true - y_pred))) AS RMSE,
              SUM((y_true - y_pred) * (y_true - y_pred)) AS ssr, var_pop(y_true) * COUNT(*) AS sst,
              covar_pop(y_true, y_pred) AS cv, stddev_pop(y_true) AS sdt, stddev_pop(y_pred) AS sdp,
              AVG(y_true) AS mt, AVG(y_pred) AS mp,
              AVG(2.0 * abs(y_pred - y_true) / (abs(y_true) + abs(y_pred) + 1e-8)) * 100.0 AS sMAPE
       FROM {src} GROUP BY {keys}),
mk AS (SELECT *, CASE WHEN sst > 0 THEN 1.0 - ssr / sst ELSE 0.0 END AS nse,
              CASE WHEN n > 1 THEN (CASE WHEN sdt * sdp = 0 THEN NULL ELSE cv / (sdt * sdp) END) ELSE 0.0 END AS corr_,
              sdp / (sdt + 1e-8) AS alpha, mp / (mt + 1e-8) AS beta FROM mm)
SELECT {keys}, {rnd(['MAE', 'RMSE'])}, round(nse, 6) + 0.0 AS R2, round(nse, 6) + 0.0 AS NSE,
       round(1.0 - sqrt((corr_ - 1) * (corr_ - 1) + (alpha - 1) * (alpha - 1) + (beta - 1) * (beta - 1)), 6) + 0.0 AS KGE,
       {rnd(['sMAPE'])}
FROM mk
"""


ORACLE["hydro_metrics"] = f"WITH {PRED}, {metrics_select('pr', '\"group\", split')}"

ORACLE["low_flow_metrics"] = f"""
WITH {PRED},
q AS (SELECT "group", quantile_cont(y_true, 0.10) AS q90 FROM pr WHERE split = 'train' GROUP BY 1),
t AS (SELECT pr.*, q.q90, ln(greatest(y_true, 1e-6)) AS lt, ln(greatest(y_pred, 1e-6)) AS lp
      FROM pr JOIN q USING ("group") WHERE split = 'test'),
g AS (SELECT "group", first(q90) AS q90, SUM((lt - lp) * (lt - lp)) AS ssr, var_pop(lt) * COUNT(*) AS sst,
             sqrt(AVG(CASE WHEN y_true <= q90 THEN (y_true - y_pred) * (y_true - y_pred) END)) AS rmse_dry,
             COUNT(CASE WHEN y_true <= q90 THEN 1 END) AS n_dry FROM t GROUP BY 1)
SELECT "group", round(q90, 6) + 0.0 AS Q90_reference,
       round(CASE WHEN sst > 0 THEN 1.0 - ssr / sst ELSE 0.0 END, 6) + 0.0 AS LogNSE,
       round(rmse_dry, 6) + 0.0 AS RMSE_dry, n_dry AS n_dry_samples
FROM g
"""

ORACLE["persistence_metrics"] = f"""
WITH {DAILY_FLOW},
{fill_cte('filled', 'daily', 'streamflow_m3s', 5, 'forward')},
pp AS (SELECT station_id, date, streamflow_m3s AS y, row_number() OVER (PARTITION BY station_id ORDER BY date) AS p
       FROM filled),
pairs AS (SELECT a.station_id, h.horizon, a.y AS y_true, b.y AS y_pred
          FROM pp a CROSS JOIN (VALUES (1), (7)) h(horizon)
          JOIN pp b ON a.station_id = b.station_id AND b.p = a.p - h.horizon
          WHERE a.y IS NOT NULL AND b.y IS NOT NULL),
{metrics_select('pairs', 'station_id, horizon')}
"""

TRIALS = """
tr AS (SELECT o_orderpriority AS study_name, o_orderkey AS number, o_totalprice AS value,
              CASE o_orderpriority WHEN '1-URGENT' THEN 'NSE' WHEN '2-HIGH' THEN 'RMSE' WHEN '3-MEDIUM' THEN 'KGE'
                   WHEN '4-NOT SPECIFIED' THEN 'val_loss' WHEN '5-LOW' THEN 'LogNSE' END AS metric,
              CASE WHEN o_orderstatus = 'F' THEN 'COMPLETE' WHEN o_orderstatus = 'O' THEN 'RUNNING' ELSE 'FAIL' END AS state
       FROM orders),
trc AS (SELECT *, CASE WHEN metric IN ('val_loss', 'RMSE', 'MAE', 'sMAPE') THEN 1.0 ELSE -1.0 END AS sgn
        FROM tr WHERE state = 'COMPLETE' AND value IS NOT NULL)
"""

ORACLE["best_so_far"] = f"""
WITH {TRIALS}
SELECT study_name, number, round(value, 6) + 0.0 AS value, metric, state,
       round(MIN(sgn * value) OVER (PARTITION BY study_name ORDER BY number
             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) * sgn, 6) + 0.0 AS best_so_far
FROM trc
"""

ORACLE["best_trial"] = f"""
WITH {TRIALS},
r AS (SELECT *, row_number() OVER (PARTITION BY study_name ORDER BY sgn * value, number) AS k,
             COUNT(*) OVER (PARTITION BY study_name) AS n_complete FROM trc)
SELECT study_name, metric, number AS best_trial, round(value, 6) + 0.0 AS best_value, n_complete FROM r WHERE k = 1
"""

ORACLE["guarded_objective"] = f"""
WITH {TRIALS},
g AS (SELECT study_name, number, metric, CASE WHEN state = 'COMPLETE' THEN value END AS v FROM tr)
SELECT study_name, number,
       round(CASE WHEN v IS NULL OR isnan(v) OR isinf(v)
                  THEN (CASE WHEN metric IN ('val_loss', 'RMSE', 'MAE', 'sMAPE') THEN CAST('inf' AS DOUBLE) ELSE -1e9 END)
                  ELSE v END, 6) + 0.0 AS objective
FROM g
"""

RESULTS = """
res AS (SELECT CASE WHEN l_returnflag = 'R' THEN 'lstm' ELSE 'tft' END AS model,
               CASE WHEN l_linestatus = 'F' THEN 'passado' ELSE 'recente' END AS period,
               CAST(l_linenumber * 30 AS INTEGER) AS lookback,
               CAST(CASE WHEN l_tax < 0.02 THEN 1 WHEN l_tax < 0.04 THEN 7 WHEN l_tax < 0.06 THEN 15 ELSE 30 END AS INTEGER) AS horizon,
               CASE WHEN l_quantity >= 50 THEN 'failed' ELSE 'success' END AS status,
               1.0 - l_discount * 5.0 AS NSE, 1.0 - l_discount * 4.0 - l_tax AS LogNSE, 1.0 - l_tax * 6.0 AS KGE,
               l_extendedprice / 1000.0 AS MAE, l_extendedprice / 700.0 AS RMSE, l_quantity / 10.0 AS RMSE_dry,
               l_extendedprice / 100000.0 AS val_loss
        FROM lineitem),
res2 AS (SELECT *, printf('%s_%s_lb%d_h%d', model, period, lookback, horizon) AS study_name FROM res)
"""

ORACLE["axis_means"] = f"""
WITH {RESULTS}
SELECT model, period, horizon, lookback, round(AVG(NSE), 6) + 0.0 AS mean_nse, round(AVG(KGE), 6) + 0.0 AS mean_kge,
       round(AVG(MAE), 6) + 0.0 AS mean_mae, round(AVG(val_loss), 6) + 0.0 AS mean_val_loss,
       GROUPING_ID(model, period, horizon, lookback) AS axis_id
FROM res2 WHERE status = 'success'
GROUP BY GROUPING SETS ((model, period, horizon), (model, period, lookback))
"""

ORACLE["status_counts"] = f"""
WITH {RESULTS}
SELECT model, period, COUNT(CASE WHEN status = 'success' THEN 1 END) AS n_success,
       COUNT(CASE WHEN status = 'failed' THEN 1 END) AS n_failed FROM res2 GROUP BY 1, 2
"""

ORACLE["nse_by_lookback"] = f"""
WITH {RESULTS}
SELECT model, period, lookback, horizon, round(NSE, 6) + 0.0 AS nse FROM res2 WHERE status = 'success'
"""

ORACLE["lognse_boxplot"] = f"""
WITH {RESULTS},
nr AS (SELECT lower(trim(model)) AS model, lower(trim(period)) AS period, TRY_CAST(CAST(LogNSE AS VARCHAR) AS DOUBLE) AS v
       FROM res2),
f AS (SELECT * FROM nr WHERE model IN ('lstm', 'tft') AND period IN ('passado', 'recente') AND v IS NOT NULL),
q AS (SELECT period, model, COUNT(v) AS n, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS med,
             quantile_cont(v, 0.75) AS q3 FROM f GROUP BY 1, 2),
w AS (SELECT f.period, f.model,
             MIN(CASE WHEN v >= q1 - 1.5 * (q3 - q1) THEN v END) AS wl,
             MAX(CASE WHEN v <= q3 + 1.5 * (q3 - q1) THEN v END) AS wh,
             COUNT(CASE WHEN v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1) THEN 1 END) AS n_outliers
      FROM f JOIN q USING (period, model) GROUP BY 1, 2)
SELECT q.period, q.model, q.n, round(q1, 6) + 0.0 AS q1, round(med, 6) + 0.0 AS median, round(q3, 6) + 0.0 AS q3,
       round(wl, 6) + 0.0 AS whisker_low, round(wh, 6) + 0.0 AS whisker_high, n_outliers
FROM q JOIN w USING (period, model)
"""

MS_METRICS = ["NSE", "KGE", "MAE", "RMSE", "LogNSE", "RMSE_dry"]
ORACLE["mean_std_summary"] = f"""
WITH {RESULTS}
SELECT model, horizon, period, COUNT(*) AS n_runs,
       {', '.join(f'round(AVG({m}), 6) + 0.0 AS {m}_mean, round(stddev_samp({m}), 6) + 0.0 AS {m}_std' for m in MS_METRICS)}
FROM res2 WHERE status = 'success' GROUP BY 1, 2, 3
"""

ORACLE["best_study_per_horizon"] = f"""
WITH {RESULTS},
r AS (SELECT horizon, lookback, row_number() OVER (PARTITION BY horizon
             ORDER BY LogNSE DESC NULLS LAST, NSE DESC NULLS LAST, study_name) AS k
      FROM res2 WHERE lower(trim(model)) = 'tft' AND lower(trim(period)) = 'passado')
SELECT horizon, lookback, printf('tft_passado_lb%d_h%d', lookback, horizon) AS study FROM r WHERE k = 1
"""

PAT = r"^(lstm|tft)_(passado|recente)_lb(\d+)(?:_h(\d+))?$"
ORACLE["study_names"] = f"""
WITH {RESULTS},
s AS (SELECT DISTINCT study_name FROM res2)
SELECT study_name, regexp_extract(study_name, '{PAT}', 1) AS model, regexp_extract(study_name, '{PAT}', 2) AS period,
       CAST(regexp_extract(study_name, '{PAT}', 3) AS INTEGER) AS lookback,
       CAST(CASE WHEN regexp_extract(study_name, '{PAT}', 4) = '' THEN '1'
                 ELSE regexp_extract(study_name, '{PAT}', 4) END AS INTEGER) AS horizon
FROM s WHERE regexp_matches(study_name, '{PAT}')
"""

PAYLOADS = """
pl AS (SELECT event_id, printf('tft_%s_lb%d_h7', CASE WHEN day(ts) <= 15 THEN 'passado' ELSE 'recente' END,
                               length(event_type) * 30) AS study,
              CAST(json_extract(props, '$.k') AS DOUBLE) AS k, CAST(value AS DOUBLE) AS v,
              CAST(hour(ts) AS DOUBLE) AS hr FROM events),
plr AS (SELECT event_id, study, study || '_tft_feature_importance.json' AS source, f.feature, f.score
        FROM pl CROSS JOIN LATERAL (VALUES ('k', k), ('value', v), ('hour', hr)) f(feature, score)),
imp AS (SELECT regexp_extract(source, '^tft_(passado|recente)_lb\\d+_h\\d+_tft_feature_importance\\.json$', 1) AS period,
               feature, score, source, event_id, study
        FROM plr WHERE regexp_matches(source, '^tft_(passado|recente)_lb\\d+_h\\d+_tft_feature_importance\\.json$'))
"""

PIVOT = f"""
{PAYLOADS},
pv AS (SELECT feature, COALESCE(AVG(CASE WHEN period = 'passado' THEN score END), 0.0) AS passado,
              COALESCE(AVG(CASE WHEN period = 'recente' THEN score END), 0.0) AS recente FROM imp GROUP BY 1),
pv2 AS (SELECT *, (0.0 + passado + recente) / 2.0 AS overall FROM pv)
"""

ORACLE["importance_pivot"] = f"WITH {PIVOT} SELECT feature, {rnd(['passado', 'recente', 'overall'])} FROM pv2"
ORACLE["importance_top_k"] = f"""
WITH {PIVOT} SELECT feature, {rnd(['passado', 'recente', 'overall'])} FROM pv2 ORDER BY overall DESC, feature LIMIT 3
"""
ORACLE["importance_sources"] = f"WITH {PAYLOADS} SELECT period, COUNT(DISTINCT source) AS n_sources FROM imp GROUP BY 1"
ORACLE["importance_percent"] = f"""
WITH {PAYLOADS},
t AS (SELECT event_id, SUM(score) AS tot FROM plr GROUP BY 1)
SELECT p.event_id, p.feature, round(p.score, 6) + 0.0 AS score,
       round(CASE WHEN tot > 0 THEN p.score / tot * 100.0 ELSE 0.0 END, 6) + 0.0 AS percent
FROM plr p JOIN t USING (event_id)
"""
ORACLE["importance_top_in_map"] = f"""
WITH {PAYLOADS},
r AS (SELECT event_id, feature, score, row_number() OVER (PARTITION BY event_id ORDER BY score DESC, feature) - 1 AS pos
      FROM plr)
SELECT event_id, CAST(pos AS INTEGER) AS pos, feature, round(score, 6) + 0.0 AS score FROM r WHERE pos < 2
"""

ATT = """
emb AS (SELECT printf('study_%d', label) AS study, vec_id, embedding,
               row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS sample_pos FROM embeddings),
cells0 AS (SELECT study, sample_pos, unnest(range(len(embedding))) AS lag0, unnest(embedding) AS value0
           FROM emb),
cells AS (SELECT study, sample_pos, CAST(lag0 AS INTEGER) AS lag, CAST(value0 AS DOUBLE) AS value FROM cells0),
mal AS (SELECT study, lag, AVG(CASE WHEN isnan(value) THEN NULL ELSE value END) AS mean_attention FROM cells GROUP BY 1, 2)
"""
ORACLE["attention_per_lag"] = f"WITH {ATT} SELECT study, lag, {rnd(['mean_attention'])} FROM mal"

ORACLE["attention_head"] = f"""
WITH {ATT} SELECT study, sample_pos, lag, round(CASE WHEN isnan(value) THEN NULL ELSE value END, 6) + 0.0 AS value
FROM cells WHERE sample_pos < 32
"""

ORACLE["attention_smoothed"] = f"""
WITH {ATT},
nn AS (SELECT study, MAX(lag) + 1 AS n FROM mal GROUP BY 1),
b0 AS (SELECT m.study, m.lag, m.mean_attention, greatest(1, CAST(floor(nn.n / 120) AS INTEGER)) AS bs, nn.n
       FROM mal m JOIN nn USING (study)),
bins AS (SELECT study, CAST(floor(lag / bs) AS INTEGER) AS bin, AVG(mean_attention) AS binned, first(bs) AS bs,
                first(n) AS n FROM b0 GROUP BY 1, 2),
bk AS (SELECT *, greatest(1.0, bs / 2.0) AS sigma, CAST(floor(greatest(1.0, bs / 2.0) * 3) AS INTEGER) AS r,
              CAST(ceil(n / bs) AS INTEGER) AS nb FROM bins),
nrm AS (SELECT study, bin, SUM(exp(-(m * m) / (2 * sigma * sigma))) AS norm
        FROM bk, LATERAL (SELECT unnest(generate_series(-r, r)) AS m) GROUP BY 1, 2),
sm AS (SELECT a.study, a.bin, SUM(exp(-((b.bin - a.bin) * (b.bin - a.bin)) / (2 * b.sigma * b.sigma)) / nb2.norm
                                  * COALESCE(b.binned, 0.0)) AS smoothed
       FROM bk a JOIN bk b ON a.study = b.study AND abs(b.bin - a.bin) <= b.r
       JOIN nrm nb2 ON nb2.study = b.study AND nb2.bin = b.bin
       WHERE a.bin < a.nb GROUP BY 1, 2)
SELECT bk.study, bk.bin, round(bk.binned, 6) + 0.0 AS binned, round(sm.smoothed, 6) + 0.0 AS smoothed
FROM bk JOIN sm USING (study, bin)
"""

ENC = f"""
{PAYLOADS},
ent AS (SELECT study, event_id, row_number() OVER (PARTITION BY study ORDER BY event_id) - 1 AS entry FROM pl),
names AS (SELECT DISTINCT p.study, p.feature AS variable FROM plr p JOIN ent e ON p.event_id = e.event_id WHERE e.entry = 0),
evm AS (SELECT n.study, n.variable, AVG(CASE WHEN isnan(COALESCE(p.score, 0.0)) THEN NULL ELSE COALESCE(p.score, 0.0) END) AS importance
        FROM names n JOIN ent e ON e.study = n.study
        LEFT JOIN plr p ON p.event_id = e.event_id AND p.feature = n.variable GROUP BY 1, 2)
"""
ORACLE["encoder_variable_means"] = f"WITH {ENC} SELECT study, variable, {rnd(['importance'])} FROM evm"
ORACLE["top_variable_names"] = f"""
WITH {ENC},
top AS (SELECT variable, row_number() OVER (ORDER BY importance DESC, study, variable) AS o FROM evm
        ORDER BY importance DESC, study, variable LIMIT 4),
nm AS (SELECT variable, CAST(MIN(o) AS INTEGER) AS position FROM top GROUP BY 1)
SELECT * FROM nm UNION ALL SELECT 'oni', 0 WHERE NOT EXISTS (SELECT 1 FROM nm WHERE variable = 'oni')
"""

ORACLE["monthly_index_lags"] = f"""
WITH {PREP_CTES},
oi AS (SELECT year, month, oni, year * 12 + month - 1 AS i FROM oni)
SELECT a.year, a.month, round(a.oni, 6) + 0.0 AS oni,
       {', '.join(f"round(s{j}.oni, 6) + 0.0 AS {'oni_lag' + str(k) if k > 0 else 'oni_lead' + str(-k)}"
                  for j, k in enumerate((-3, -2, -1, 1, 2, 3)))}
FROM oi a
{' '.join(f'LEFT JOIN oi s{j} ON s{j}.i + ({k}) = a.i' for j, k in enumerate((-3, -2, -1, 1, 2, 3)))}
"""

ORACLE["tft_dataset_split"] = f"""
WITH {MASTER_CTES},
mr AS (SELECT *, date BETWEEN DATE '1995-01-01' AND DATE '1999-12-31' AS in_pool,
              SUM(CASE WHEN date BETWEEN DATE '1995-01-01' AND DATE '1999-12-31' THEN 1 ELSE 0 END)
                OVER (PARTITION BY station_id ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS prank,
              SUM(CASE WHEN date BETWEEN DATE '1995-01-01' AND DATE '1999-12-31' THEN 1 ELSE 0 END)
                OVER (PARTITION BY station_id) AS n_pool
       FROM master),
mr2 AS (SELECT *, least(greatest(CAST(round_even((1.0 - 0.15) * n_pool, 0) AS BIGINT), 1), n_pool - 1) AS split_row FROM mr),
st AS (SELECT station_id, MAX(CASE WHEN in_pool AND prank = split_row + 1 THEN time_idx END) AS val_start_idx,
              MIN(CASE WHEN date >= DATE '2000-01-01' THEN time_idx END) AS test_start_idx,
              AVG(CASE WHEN in_pool AND prank <= split_row THEN streamflow_m3s END) AS target_center,
              stddev_samp(CASE WHEN in_pool AND prank <= split_row THEN streamflow_m3s END) AS target_scale
       FROM mr2 GROUP BY 1),
base AS (SELECT * FROM master WHERE date <= DATE '2001-08-01'),
ed AS (SELECT station_id, COUNT(*) OVER e AS n_enc, COUNT(*) OVER dcd AS n_dec,
              first_value(date) OVER e AS enc_first_date, lead(time_idx, 1) OVER o AS decoder_start_idx,
              lead(date, 7) OVER o AS dec_last_date, lead(time_idx, 7) OVER o AS dec_last_idx
       FROM base WINDOW o AS (PARTITION BY station_id ORDER BY date),
              e AS (PARTITION BY station_id ORDER BY date ROWS BETWEEN 29 PRECEDING AND CURRENT ROW),
              dcd AS (PARTITION BY station_id ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 7 FOLLOWING)),
lab AS (SELECT ed.*, st.val_start_idx, st.test_start_idx, st.target_center, st.target_scale,
               CASE WHEN enc_first_date >= DATE '1995-01-01' AND dec_last_idx < val_start_idx
                         AND dec_last_date <= DATE '1999-12-31' THEN 'train'
                    WHEN dec_last_date <= DATE '1999-12-31' AND decoder_start_idx >= val_start_idx THEN 'val'
                    WHEN decoder_start_idx >= test_start_idx THEN 'test' END AS dataset
        FROM ed JOIN st USING (station_id) WHERE n_enc = 30 AND n_dec = 7)
SELECT station_id, dataset, val_start_idx, test_start_idx, round(target_center, 6) + 0.0 AS target_center,
       round(target_scale, 6) + 0.0 AS target_scale, 30 AS encoder_length, COUNT(*) AS n_windows,
       MIN(decoder_start_idx) AS first_decoder_idx, MAX(decoder_start_idx) AS last_decoder_idx
FROM lab WHERE dataset IS NOT NULL
GROUP BY station_id, dataset, val_start_idx, test_start_idx, target_center, target_scale
"""

ORACLE["row_split_datasets"] = f"""
WITH {MASTER_CTES},
mr AS (SELECT *, row_number() OVER (PARTITION BY station_id ORDER BY date) - 1 AS pos, COUNT(*) OVER (PARTITION BY station_id) AS n FROM master),
mr2 AS (SELECT *, CAST(floor(0.7::DOUBLE * n) AS BIGINT) AS train_end, CAST(floor(0.85::DOUBLE * n) AS BIGINT) AS val_end FROM mr),
st AS (SELECT station_id, any_value(train_end) AS train_end, any_value(val_end) AS val_end,
              MAX(CASE WHEN pos = train_end THEN time_idx END) AS val_start_idx, MAX(CASE WHEN pos = val_end THEN time_idx END) AS test_start_idx,
              AVG(CASE WHEN time_idx < train_end THEN streamflow_m3s END) AS target_center,
              stddev_samp(CASE WHEN time_idx < train_end THEN streamflow_m3s END) AS target_scale FROM mr2 GROUP BY 1),
ed AS (SELECT station_id, COUNT(*) OVER e AS n_enc, COUNT(*) OVER dcd AS n_dec, lead(time_idx, 1) OVER o AS first_idx, lead(time_idx, 7) OVER o AS last_idx
       FROM master WINDOW o AS (PARTITION BY station_id ORDER BY date),
              e AS (PARTITION BY station_id ORDER BY date ROWS BETWEEN 29 PRECEDING AND CURRENT ROW),
              dcd AS (PARTITION BY station_id ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 7 FOLLOWING)),
lab AS (SELECT *, CASE WHEN last_idx < train_end THEN 'train' WHEN last_idx < val_end AND first_idx >= val_start_idx THEN 'val'
                       WHEN first_idx >= test_start_idx THEN 'test' END AS dataset
        FROM ed JOIN st USING (station_id) WHERE n_enc = 30 AND n_dec = 7)
SELECT station_id, dataset, val_start_idx, test_start_idx, {rnd(['target_center', 'target_scale'])}, COUNT(*) AS n_windows,
       MIN(first_idx) AS first_decoder_idx, MAX(first_idx) AS last_decoder_idx
FROM lab WHERE dataset IS NOT NULL GROUP BY station_id, dataset, val_start_idx, test_start_idx, target_center, target_scale
"""

_KNOWN = ["time_idx", "precipitation", "temperature", "actual_evapotransp", "oni", "sin_day", "cos_day", "sin_month", "cos_month"]
ORACLE["model_inputs"] = f"""
WITH {MASTER_CTES},
mr AS (SELECT *, date BETWEEN DATE '1995-01-01' AND DATE '1999-12-31' AS in_pool FROM master),
mr2 AS (SELECT *, COUNT(CASE WHEN in_pool THEN 1 END) OVER (PARTITION BY station_id ORDER BY date ROWS UNBOUNDED PRECEDING) AS prank,
               COUNT(CASE WHEN in_pool THEN 1 END) OVER (PARTITION BY station_id) AS n_pool FROM mr),
mr3 AS (SELECT *, least(greatest(CAST(round_even((1.0 - 0.15) * n_pool, 0) AS BIGINT), 1), n_pool - 1) AS split_row FROM mr2),
st AS (SELECT station_id, MAX(CASE WHEN in_pool AND prank = split_row + 1 THEN time_idx END) AS val_start_idx,
              MIN(CASE WHEN date >= DATE '2000-01-01' THEN time_idx END) AS test_start_idx,
              AVG(CASE WHEN in_pool AND prank <= split_row THEN streamflow_m3s END) AS target_center,
              stddev_samp(CASE WHEN in_pool AND prank <= split_row THEN streamflow_m3s END) AS target_scale,
              CASE WHEN any_value(n_pool) < 32 THEN 'training window too short for the lookback' END AS split_error FROM mr3 GROUP BY 1),
ed AS (SELECT station_id, static_nation_name, static_mean_acctbal, COUNT(*) OVER e AS n_enc, COUNT(*) OVER dcd AS n_dec,
              first_value(date) OVER e AS enc_first_date, first_value(time_idx) OVER e AS enc_first_idx, lead(time_idx, 1) OVER o AS decoder_start_idx,
              lead(date, 1) OVER o AS decoder_start_date, lead(date, 7) OVER o AS dec_last_date, lead(time_idx, 7) OVER o AS dec_last_idx,
              {', '.join(f'SUM(CAST({c} AS DOUBLE)) OVER dcd AS decoder_{c}' for c in _KNOWN)}, SUM(oni) OVER e AS encoder_oni,
              MAX(streamflow_m3s) OVER e AS highest_encoder_target, MAX(streamflow_m3s) OVER dcd AS highest_decoder_target
       FROM (SELECT * FROM master WHERE date <= DATE '2001-08-01') WINDOW o AS (PARTITION BY station_id ORDER BY date),
              e AS (PARTITION BY station_id ORDER BY date ROWS BETWEEN 29 PRECEDING AND CURRENT ROW),
              dcd AS (PARTITION BY station_id ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 7 FOLLOWING)),
lab AS (SELECT *, CASE WHEN enc_first_date >= DATE '1995-01-01' AND dec_last_idx < val_start_idx AND dec_last_date <= DATE '1999-12-31' THEN 'train'
                    WHEN dec_last_date <= DATE '1999-12-31' AND decoder_start_idx >= val_start_idx THEN 'val'
                    WHEN decoder_start_idx >= test_start_idx THEN 'test' END AS dataset,
               (enc_first_idx - decoder_start_idx) / 30.0::DOUBLE AS first_relative_idx, (dec_last_idx - decoder_start_idx) / 30.0::DOUBLE AS last_relative_idx
        FROM ed JOIN st USING (station_id) WHERE n_enc = 30 AND n_dec = 7)
SELECT station_id, dataset, decoder_start_date, decoder_start_idx, 30 AS encoder_length, 7 AS decoder_length, static_nation_name,
       {rnd(['first_relative_idx', 'last_relative_idx', *(f'decoder_{c}' for c in _KNOWN), 'encoder_oni', 'highest_encoder_target', 'highest_decoder_target',
             'static_mean_acctbal', 'target_center', 'target_scale'])}, split_error
FROM lab WHERE dataset IS NOT NULL
"""

ORACLE["forecast_one_lag"] = f"""
WITH {SCALED},
w1 AS (SELECT z.station_id, z.target_log AS x, wv.target_date, wv.target FROM wv JOIN zz z ON z.station_id = wv.station_id AND z.date = wv.window_end_date),
pool AS (SELECT *, target_date BETWEEN DATE '1995-01-01' AND DATE '1999-12-31' AS in_pool,
                target_date BETWEEN DATE '2000-01-01' AND DATE '2001-08-01' AS in_test FROM w1),
rk AS (SELECT *, COUNT(CASE WHEN in_pool THEN 1 END) OVER (PARTITION BY station_id ORDER BY target_date ROWS UNBOUNDED PRECEDING) AS prank,
              COUNT(CASE WHEN in_pool THEN 1 END) OVER (PARTITION BY station_id) AS n_pool FROM pool),
lab AS (SELECT *, CASE WHEN in_pool AND prank > n_pool - least(greatest(CAST(round_even(n_pool * 0.15, 0) AS BIGINT), 1), n_pool - 1) THEN 'val'
                       WHEN in_pool THEN 'train' WHEN in_test THEN 'test' END AS split FROM rk),
lin AS (SELECT regr_slope(target, x) AS slope, regr_intercept(target, x) AS intercept FROM lab WHERE split = 'train'),
pr AS (SELECT station_id, split, greatest(exp(target * sd + mu) - 1, 0.0) AS y_true, greatest(exp((slope * x + intercept) * sd + mu) - 1, 0.0) AS y_pred
       FROM lab, lin, (SELECT mu_target_log AS mu, CASE WHEN sd_target_log IS NULL OR sd_target_log = 0 THEN 1.0 ELSE sd_target_log END AS sd FROM stt)
       WHERE split IS NOT NULL),
a5 AS (WITH {metrics_select('pr', 'station_id, split').strip()}),
q AS (SELECT station_id, quantile_cont(y_true, 0.10) AS q90 FROM pr WHERE split = 'train' GROUP BY 1),
t AS (SELECT pr.*, q90, ln(greatest(y_true, 1e-6)) AS lt, ln(greatest(y_pred, 1e-6)) AS lp FROM pr JOIN q USING (station_id)),
g AS (SELECT station_id, split, any_value(q90) AS q90, SUM((lt - lp) * (lt - lp)) AS ssr, var_pop(lt) * COUNT(*) AS sst,
             sqrt(AVG(CASE WHEN y_true <= q90 THEN (y_true - y_pred) * (y_true - y_pred) END)) AS rmse_dry,
             COUNT(CASE WHEN y_true <= q90 THEN 1 END) AS n_dry FROM t GROUP BY 1, 2)
SELECT a5.*, round(q90, 6) + 0.0 AS Q90_reference, round(CASE WHEN sst > 0 THEN 1.0 - ssr / sst ELSE 0.0 END, 6) + 0.0 AS LogNSE,
       round(rmse_dry, 6) + 0.0 AS RMSE_dry, n_dry AS n_dry_samples
FROM a5 JOIN g USING (station_id, split)
"""

ORACLE["expanding_window_folds"] = f"""
WITH {SCALED},
f AS (SELECT wv.station_id, wv.target_date, c.cutoff AS fold_cutoff FROM wv
      CROSS JOIN (VALUES (1997), (1998), (1999), (2000)) c(cutoff)),
r AS (SELECT *, CASE WHEN year(target_date) < fold_cutoff THEN 'train'
                     WHEN year(target_date) < fold_cutoff + 1 THEN 'val' END AS fold_role FROM f)
SELECT station_id, CAST(fold_cutoff AS INTEGER) AS fold_cutoff, fold_role, COUNT(*) AS n_windows,
       MIN(target_date) AS first_target_date, MAX(target_date) AS last_target_date
FROM r WHERE fold_role IS NOT NULL GROUP BY 1, 2, 3
"""


# Bootstrap oracle: the Poisson(1) inverse-CDF thresholds come from the same rule as the library.
from hydroframe.operators.metrics import poisson1_thresholds as _p1  # noqa: E402

_CASE = "CASE " + " ".join(f"WHEN u < {t!r} THEN {k}" for k, t in enumerate(_p1())) + f" ELSE {len(_p1())} END"
ORACLE["bootstrap_nse_difference"] = """
WITH b AS (SELECT l.l_returnflag AS "group", CAST(floor(l.l_orderkey / 64) AS BIGINT) AS block,
                  l.l_extendedprice AS t, l.l_quantity * p.p_retailprice AS a, l.l_extendedprice * (1.0 - l.l_discount) AS bb
           FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey),
r AS (SELECT b.*, rep.replicate FROM b CROSS JOIN (SELECT unnest(range(1000)) AS replicate) rep),
bu AS (SELECT block, replicate, ('0x' || substr(md5('7:' || block || ':' || replicate), 1, 12))::BIGINT / 281474976710656.0 AS u
       FROM (SELECT DISTINCT block FROM b) CROSS JOIN (SELECT unnest(range(1000)) AS replicate)),
u AS (SELECT r.*, bu.u FROM r JOIN bu USING (block, replicate)),
w AS (SELECT *, CAST(""" + _CASE + """ AS DOUBLE) AS w FROM u),
g AS (SELECT "group", replicate, SUM(w) AS sw, SUM(w * t) AS swt, SUM(w * t * t) AS swt2,
             SUM(w * (t - a) * (t - a)) AS sa, SUM(w * (t - bb) * (t - bb)) AS sb FROM w GROUP BY 1, 2),
n AS (SELECT "group", swt2 - swt * swt / sw AS sst, sa, sb FROM g),
dd AS (SELECT "group", (CASE WHEN sst > 0 THEN 1.0 - sa / sst ELSE 0.0 END) - (CASE WHEN sst > 0 THEN 1.0 - sb / sst ELSE 0.0 END) AS diff FROM n)
SELECT "group", COUNT(*) AS replicates, round(quantile_cont(diff, 0.025), 6) + 0.0 AS q025,
       round(quantile_cont(diff, 0.5), 6) + 0.0 AS q500, round(quantile_cont(diff, 0.975), 6) + 0.0 AS q975
FROM dd GROUP BY 1
"""

ORACLE["encoder_series_scaled"] = f"""
WITH {ENC},
ev AS (SELECT e.study, e.entry, COALESCE(p.score, 0.0) AS v
       FROM ent e LEFT JOIN plr p ON p.event_id = e.event_id AND p.feature = 'k'),
nn AS (SELECT study, COUNT(*) AS n FROM ev GROUP BY 1),
bk AS (SELECT ev.study, CAST(floor(entry / CASE WHEN n > 200 THEN greatest(1, floor(n / 200)) ELSE 1 END) AS BIGINT) AS point,
              v FROM ev JOIN nn USING (study)),
pt AS (SELECT study, point, AVG(CASE WHEN isnan(v) THEN NULL ELSE v END) AS value FROM bk GROUP BY 1, 2),
mm AS (SELECT study, MIN(value) AS lo, MAX(value) AS hi FROM pt GROUP BY 1)
SELECT pt.study, point, round(value, 6) + 0.0 AS value,
       round(COALESCE(CASE WHEN hi - lo = 0 THEN NULL ELSE (value - lo) * 100.0 / (hi - lo) END, 0.0), 6) + 0.0 AS scaled
FROM pt JOIN mm USING (study)
"""

ORACLE["encoder_bar_values"] = f"""
WITH {ENC},
top AS (SELECT variable, row_number() OVER (ORDER BY importance DESC, study, variable) AS o FROM evm
        ORDER BY importance DESC, study, variable LIMIT 4),
al AS (SELECT variable, MIN(o) AS position FROM top GROUP BY 1 UNION ALL SELECT 'oni', 0 WHERE NOT EXISTS (SELECT 1 FROM top WHERE variable = 'oni')),
nm AS (SELECT variable FROM al ORDER BY position LIMIT 4),
j AS (SELECT ent.study, nm.variable, AVG(CASE WHEN isnan(p.score) THEN NULL ELSE COALESCE(p.score, 0.0) END) AS importance
      FROM ent CROSS JOIN nm LEFT JOIN plr p ON p.event_id = ent.event_id AND p.feature = nm.variable GROUP BY 1, 2),
mx AS (SELECT variable, MAX(importance) AS m FROM j GROUP BY 1)
SELECT j.variable, study, round(CASE WHEN m <= 1.0 THEN importance * 100.0 ELSE importance END, 6) + 0.0 AS bar_value
FROM j JOIN mx USING (variable)
"""

ORACLE["bootstrap_metric_differences"] = """
WITH b AS (SELECT l.l_returnflag AS "group", CAST(floor(l.l_orderkey / 64) AS BIGINT) AS block,
                  l.l_extendedprice AS t, l.l_quantity * p.p_retailprice AS a, l.l_extendedprice * (1.0 - l.l_discount) AS bb
           FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey),
r AS (SELECT b.*, rep.replicate FROM b CROSS JOIN (SELECT unnest(range(1000)) AS replicate) rep),
bu AS (SELECT block, replicate, ('0x' || substr(md5('7:' || block || ':' || replicate), 1, 12))::BIGINT / 281474976710656.0 AS u
       FROM (SELECT DISTINCT block FROM b) CROSS JOIN (SELECT unnest(range(1000)) AS replicate)),
u AS (SELECT r.*, bu.u FROM r JOIN bu USING (block, replicate)),
w AS (SELECT *, CAST(""" + _CASE + """ AS DOUBLE) AS w, ln(greatest(t, 1e-6)) AS lt, ln(greatest(a, 1e-6)) AS la,
             ln(greatest(bb, 1e-6)) AS lb FROM u),
g AS (SELECT "group", replicate, SUM(w) AS sw,
             SUM(w * t) AS st, SUM(w * t * t) AS stt, SUM(w * (t - a) * (t - a)) AS ra, SUM(w * (t - bb) * (t - bb)) AS rb,
             SUM(w * a) AS sa, SUM(w * a * a) AS saa, SUM(w * t * a) AS sta,
             SUM(w * bb) AS sb, SUM(w * bb * bb) AS sbb, SUM(w * t * bb) AS stb,
             SUM(w * lt) AS lst, SUM(w * lt * lt) AS lstt, SUM(w * (lt - la) * (lt - la)) AS lra,
             SUM(w * (lt - lb) * (lt - lb)) AS lrb
      FROM w GROUP BY 1, 2),
m AS (SELECT *, st / sw AS mt, sa / sw AS ma, sb / sw AS mb,
             stt - st * st / sw AS sst, lstt - lst * lst / sw AS lsst FROM g),
v AS (SELECT *, stt / sw - mt * mt AS vt, saa / sw - ma * ma AS va, sbb / sw - mb * mb AS vb,
             sta / sw - mt * ma AS ca, stb / sw - mt * mb AS cb FROM m),
c AS (SELECT *,
        CASE WHEN sw > 1 THEN (CASE WHEN sqrt(vt * va) = 0 THEN NULL ELSE ca / sqrt(vt * va) END) ELSE 0.0 END AS cra,
        CASE WHEN sw > 1 THEN (CASE WHEN sqrt(vt * vb) = 0 THEN NULL ELSE cb / sqrt(vt * vb) END) ELSE 0.0 END AS crb
      FROM v),
k AS (SELECT "group",
        (CASE WHEN sst > 0 THEN 1.0 - ra / sst ELSE 0.0 END) - (CASE WHEN sst > 0 THEN 1.0 - rb / sst ELSE 0.0 END) AS d_nse,
        (1.0 - sqrt((cra - 1) * (cra - 1) + (sqrt(va) / (sqrt(vt) + 1e-8) - 1) * (sqrt(va) / (sqrt(vt) + 1e-8) - 1)
                    + (ma / (mt + 1e-8) - 1) * (ma / (mt + 1e-8) - 1)))
        - (1.0 - sqrt((crb - 1) * (crb - 1) + (sqrt(vb) / (sqrt(vt) + 1e-8) - 1) * (sqrt(vb) / (sqrt(vt) + 1e-8) - 1)
                    + (mb / (mt + 1e-8) - 1) * (mb / (mt + 1e-8) - 1))) AS d_kge,
        (CASE WHEN lsst > 0 THEN 1.0 - lra / lsst ELSE 0.0 END) - (CASE WHEN lsst > 0 THEN 1.0 - lrb / lsst ELSE 0.0 END) AS d_log
      FROM c),
dl AS (SELECT "group", 'NSE' AS metric, d_nse AS diff FROM k UNION ALL SELECT "group", 'KGE', d_kge FROM k
       UNION ALL SELECT "group", 'LogNSE', d_log FROM k)
SELECT "group", metric, COUNT(diff) AS replicates, round(quantile_cont(diff, 0.025), 6) + 0.0 AS q025,
       round(quantile_cont(diff, 0.5), 6) + 0.0 AS q500, round(quantile_cont(diff, 0.975), 6) + 0.0 AS q975
FROM dl GROUP BY 1, 2
"""

ORACLE["seasonal_attention"] = f"""
WITH c AS (SELECT CASE label % 3 WHEN 0 THEN 7 WHEN 1 THEN 15 ELSE 30 END AS horizon, DATE '1995-01-01' + CAST(vec_id % 2400 AS INTEGER) AS date,
                  unnest(range(len(embedding)))::INTEGER AS lag, unnest(embedding)::DOUBLE AS value FROM embeddings),
s AS (SELECT *, CASE WHEN month(date) IN (12, 1, 2) THEN 'DJF' WHEN month(date) <= 5 THEN 'MAM' WHEN month(date) <= 8 THEN 'JJA' ELSE 'SON' END AS season FROM c)
SELECT horizon, season, lag, round(AVG(value), 6) + 0.0 AS mean_attention, COUNT(value) AS n_samples, GROUPING(season) = 1 AS all_seasons
FROM s GROUP BY GROUPING SETS ((horizon, season, lag), (horizon, lag))
"""

ORACLE["training_splits"] = f"""
WITH {FINAL_CTES},
st AS (SELECT station_id, COALESCE(greatest(MIN(CASE WHEN streamflow_m3s IS NOT NULL THEN date END), DATE '1995-02-01'),
              DATE '1995-02-01') AS start_ FROM fin GROUP BY 1)
SELECT fin.station_id, period, COUNT(*) AS n_rows, MIN(date) AS first_date, MAX(date) AS last_date, round(AVG(streamflow_m3s), 6) + 0.0 AS mean_target
FROM fin JOIN st ON fin.station_id = st.station_id
WHERE date >= start_ AND streamflow_m3s IS NOT NULL AND precipitation IS NOT NULL AND oni IS NOT NULL
  AND month_sin IS NOT NULL AND month_cos IS NOT NULL
GROUP BY fin.station_id, period
"""

ORACLE["target_round_trip"] = """
WITH t AS (SELECT l_returnflag, l_extendedprice AS y, (ln(1 + greatest(l_extendedprice, 0)) - 9.5) / 0.75 AS z FROM lineitem)
SELECT l_returnflag, COUNT(*) AS n, round(AVG(z), 6) + 0.0 AS mean_z, round(MAX(abs(greatest(exp(z * 0.75 + 9.5) - 1, 0.0) - y)), 3) + 0.0 AS largest_error,
       round(MIN(greatest(exp((z - 20) * 0.75 + 9.5) - 1, 0.0)), 6) + 0.0 AS clipped FROM t GROUP BY 1
"""

ORACLE["calendar_helpers"] = """
WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders)
SELECT date, CAST(date_trunc('month', date) AS DATE) AS month_start, last_day(date) AS month_end, CAST(date - INTERVAL 3 MONTH AS DATE) AS three_months_back,
       CAST(date - INTERVAL 1 DAY AS DATE) AS day_before, CAST(date - CAST(date_trunc('month', date) AS DATE) + 1 AS INTEGER) AS days_of_month FROM d
"""

ORACLE["payload_fields"] = f"""
WITH {PAYLOADS}
SELECT event_id, printf('tft_%s_lb%d', CASE WHEN study LIKE '%passado%' THEN 'passado' ELSE 'recente' END, CAST(trunc(v) AS INTEGER) % 90) AS study_name,
       round(COALESCE(k, -1.0), 6) + 0.0 AS k, -1.0::DOUBLE AS absent FROM pl
"""

ORACLE["best_sources"] = """
WITH j AS (SELECT CAST(s_nationkey AS VARCHAR) AS station_id, year(l_shipdate) AS year, month(l_shipdate) AS month, day(l_shipdate) AS day, l_quantity, l_tax
           FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)
SELECT station_id, make_date(year, month, day) AS date, SUM(l_quantity) AS precipitation, round(AVG(l_tax), 6) + 0.0 AS temperature FROM j GROUP BY station_id, year, month, day
"""
