"""Readiness: coverage checks, human-impact limits, verdicts, flow events.

All stations are assessed in one plan; ``station_id`` is a key everywhere.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hydroframe.functions.scalar import round4
from hydroframe.operators.prepare import date_range
from hydroframe.operators.quantile import exact_quantiles, small
from hydroframe.operators.scan import blocked_scan, neighbour_rows, row_index
from hydroframe.session import cut_lineage

KEY = "station_id"
FLOW = "streamflow_m3s"


@dataclass(frozen=True)
class Thresholds:
    """The reference's readiness limits (dates and event settings are arguments)."""
    required_start_date: str = "1980-01-01"
    required_end_date: str = "2018-12-31"
    max_missing_pct_streamflow: float = 5.0
    max_missing_pct_precip: float = 5.0
    max_missing_pct_temperature: float = 5.0
    max_missing_pct_evapotransp: float = 5.0
    min_q_quality_control_perc: float = 95.0
    max_consumptive_use_perc: float = 0.20
    max_regulation_degree: float = 0.01
    max_reservoirs_vol: float = 0.0
    streamflow_event_quantile: float = 0.90
    streamflow_event_min_duration_days: int = 1
    lstm_lookback_days: int = 30
    lstm_lookback_auto_from_events: bool = False


# Variable names and the column prefix whose best (least missing) source counts.
VARIABLES = ("precipitation", "temperature", "evapotransp", "streamflow")
SOURCE_PREFIX = {"precipitation": "p_", "temperature": "t", "evapotransp": "aet_"}

# Verdict labels and rationale texts.
VERDICTS = {
    (True, True): ("APROVADA",
                   "A bacia atende cobertura temporal, faltantes maximos e criterios de intervencao humana."),
    (False, True): ("REPROVADA_DADOS_DINAMICOS",
                    "Atributos de intervencao estao bons, mas as series dinamicas nao atendem cobertura/faltantes."),
    (True, False): ("REPROVADA_INTERVENCAO",
                    "Series dinamicas estao boas, mas a intervencao humana/qualidade nao atende os criterios definidos."),
    (False, False): ("REPROVADA",
                     "A bacia nao atende aos criterios minimos de dados dinamicos e/ou intervencao humana."),
}


# ---- A1, A2, P19 -------------------------------------------------------------------------

def _best_source_missing(df: DataFrame, variable: str) -> Column:
    """A1 as an aggregate: null share × 100 of the best source column (minimum over the columns with the
    variable's prefix; streamflow uses its own column; no such column → 100)."""
    if variable == "streamflow":
        cols = [FLOW] if FLOW in df.columns else []
    else:
        cols = [c for c in df.columns if c.startswith(SOURCE_PREFIX[variable])
                and c not in (KEY, "date", "year", "month", "day")]
    pct = [F.avg(F.col(c).isNull().cast("double")) * 100.0 for c in cols] or [F.lit(100.0)]
    return pct[0] if len(pct) == 1 else F.least(*pct)


def missing_pct_best_source(df: DataFrame, variable: str) -> DataFrame:
    """A1: per station, null share ×100 of the best source column. Rows absent from the file do not count."""
    return df.groupBy(KEY).agg(_best_source_missing(df, variable).alias("missing_pct"))


def coverage_summary(files: dict[str, DataFrame], stations: DataFrame, th: Thresholds = Thresholds()) -> DataFrame:
    """A2 + P19: one row per station and variable. ``files`` maps variable → the scanned frame
    of all stations' files for it (``station_id``, ``date`` + source columns); a station without
    a file for a variable gets ``file_exists=false``, 0 rows, 100 % missing. Rows without a valid date count as
    rows and for missing values (``read_daily_files(keep_undated=True)`` keeps them).
    """
    limit = {"streamflow": th.max_missing_pct_streamflow, "precipitation": th.max_missing_pct_precip,
             "temperature": th.max_missing_pct_temperature, "evapotransp": th.max_missing_pct_evapotransp}
    parts = []
    for var, df in files.items():
        stats = df.groupBy(KEY).agg(F.count(F.lit(1)).alias("rows"), F.min("date").alias("date_min"),
                                    F.max("date").alias("date_max"), _best_source_missing(df, var).alias("missing_pct"))
        parts.append(stats.withColumn("variable", F.lit(var)))
    found = reduce(lambda a, b: a.unionByName(b), parts)
    grid = stations.select(KEY).distinct().select(KEY, F.explode(F.array(*[F.lit(v) for v in files])).alias("variable"))
    j = grid.join(found, [KEY, "variable"], "left")
    exists = F.col("rows").isNotNull()
    start_ok = exists & F.coalesce(F.col("date_min") <= F.lit(th.required_start_date).cast("date"), F.lit(False))
    end_ok = exists & F.coalesce(F.col("date_max") >= F.lit(th.required_end_date).cast("date"), F.lit(False))
    lim = F.create_map(*[x for v, m in limit.items() for x in (F.lit(v), F.lit(m))])[F.col("variable")]
    miss = F.coalesce(F.col("missing_pct"), F.lit(100.0))
    return j.select(
        KEY, "variable", exists.alias("file_exists"),
        F.coalesce(F.col("rows"), F.lit(0)).alias("rows"), "date_min", "date_max",
        start_ok.alias("coverage_start_ok"), end_ok.alias("coverage_end_ok"),
        F.when(exists, round4(miss)).otherwise(F.lit(100.0)).alias("missing_pct_best_source"),
        (start_ok & end_ok & (miss <= lim)).alias("variable_ready"),
    )


# ---- P14, J4 -----------------------------------------------------------------------------

def human_intervention(human: DataFrame, quality: DataFrame, location: DataFrame, land: DataFrame,
                       stations: DataFrame | None = None, th: Thresholds = Thresholds()) -> DataFrame:
    """J4 + P14: human ⋈ quality (inner), location and land cover (left); four threshold flags.
    With ``stations`` given, a station missing from the attributes gets ``attribute_found=false``."""
    m = (human.join(quality, KEY, "inner")
              .join(location.select(KEY, "gauge_name", "gauge_lat", "gauge_lon", "area_gsim_quality"), KEY, "left")
              .join(land.select(KEY, "forest_perc", "crop_perc", "imperv_perc", "dom_land_cover"), KEY, "left"))
    q_ok = F.col("q_quality_control_perc") >= th.min_q_quality_control_perc
    c_ok = F.col("consumptive_use_perc") <= th.max_consumptive_use_perc
    r_ok = F.col("regulation_degree") <= th.max_regulation_degree
    s_ok = F.col("reservoirs_vol") <= th.max_reservoirs_vol
    out = m.select(
        KEY, F.lit(True).alias("attribute_found"), F.coalesce(F.col("gauge_name"), F.lit("")).alias("gauge_name"),
        F.col("q_quality_control_perc").cast("double"), F.col("consumptive_use_perc").cast("double"),
        F.col("regulation_degree").cast("double"), F.col("reservoirs_vol").cast("double"),
        F.coalesce(F.col("forest_perc").cast("double"), F.lit(0.0)).alias("forest_perc"),
        F.coalesce(F.col("crop_perc").cast("double"), F.lit(0.0)).alias("crop_perc"),
        F.coalesce(F.col("imperv_perc").cast("double"), F.lit(0.0)).alias("imperv_perc"),
        F.coalesce(F.col("dom_land_cover"), F.lit("")).alias("dom_land_cover"),
        q_ok.alias("q_quality_ok"), c_ok.alias("consumptive_ok"), r_ok.alias("regulation_ok"),
        s_ok.alias("reservoir_ok"), (q_ok & c_ok & r_ok & s_ok).alias("human_intervention_ready"))
    if stations is None:
        return out
    s = stations.select(KEY).distinct()
    j = s.join(out, KEY, "left")
    return j.withColumn("attribute_found", F.coalesce(F.col("attribute_found"), F.lit(False))) \
            .withColumn("human_intervention_ready", F.coalesce(F.col("human_intervention_ready"), F.lit(False)))


def decision(coverage: DataFrame, intervention: DataFrame) -> DataFrame:
    """2×2 verdict per station + count of missing files."""
    dyn = coverage.groupBy(KEY).agg(F.bool_and("variable_ready").alias("dynamic_data_ready"),
                                    F.count_if(~F.col("file_exists")).cast("int").alias("missing_dynamic_files"))
    j = dyn.join(intervention.select(KEY, "human_intervention_ready"), KEY, "left")
    d, h = F.col("dynamic_data_ready"), F.coalesce(F.col("human_intervention_ready"), F.lit(False))
    verdict = rationale = None
    for (dk, hk), (v, r) in VERDICTS.items():
        cond = (d if dk else ~d) & (h if hk else ~h)
        verdict = F.when(cond, F.lit(v)) if verdict is None else verdict.when(cond, F.lit(v))
        rationale = F.when(cond, F.lit(r)) if rationale is None else rationale.when(cond, F.lit(r))
    return j.select(KEY, verdict.alias("verdict"), d.alias("dynamic_data_ready"),
                    h.alias("human_intervention_ready"), "missing_dynamic_files", rationale.alias("rationale"))


# ---- W2, W3 ------------------------------------------------------------------------------

def _analysis_series(daily: DataFrame, start: str | None, end: str | None, flow: str) -> DataFrame:
    s = daily.select(KEY, "date", F.col(flow).cast("double").alias(flow)).filter(F.col("date").isNotNull())
    return date_range(s, start, end)


def event_thresholds(series: DataFrame, quantile: float, flow: str = FLOW, exact: bool = True) -> DataFrame:
    """Per-station flow threshold: exact (linear) quantile of non-null flow, whose work is spread over ranges of
    flow whatever the series length; ``exact=False`` uses ``percentile_approx``. A station without flow has none."""
    if exact:
        return exact_quantiles(series, [KEY], flow, [quantile], ["event_threshold"])
    q = F.percentile_approx(flow, quantile, 100000).cast("double")
    return series.groupBy(KEY).agg(q.alias("event_threshold")).where(F.col("event_threshold").isNotNull())


def detect_events(daily: DataFrame, quantile: float = 0.90, min_duration_days: int = 1,
                  start: str | None = None, end: str | None = None, flow: str = FLOW,
                  exact: bool = True, keep_threshold: bool = False) -> DataFrame:
    """High-flow events per station (gaps and islands).

    Event day = flow ≥ station threshold (null flow is not an event day). Islands are runs of
    event days **by row position**: absent dates do not split an event, a null-flow row does.
    Island key = position among all rows − position among event rows (both blocked row
    indexes), so no window spans a whole station. Duration = calendar days + 1; events shorter
    than ``min_duration_days`` are dropped **before** numbering; peak = earliest maximum.
    """
    s = _analysis_series(daily, start, end, flow)
    thr = small(cut_lineage(event_thresholds(s, quantile, flow, exact)))
    flag = F.coalesce(F.col(flow) >= F.col("event_threshold"), F.lit(False))
    s = blocked_scan(s.join(thr, KEY, "inner"), [KEY], "date", pos="_pos", flags={"_erank": flag})
    ev = s.filter(flag)
    g = ev.groupBy(KEY, (F.col("_pos") - F.col("_erank")).alias("_island"), "event_threshold").agg(
        F.min("date").alias("event_start_date"), F.max("date").alias("event_end_date"),
        F.max(F.struct(F.col(flow), (-F.unix_date("date")).alias("nd"), F.col("date"))).alias("_peak"),
        F.avg(flow).alias("event_mean_streamflow_m3s"))
    g = g.withColumn("event_duration_days", F.datediff("event_end_date", "event_start_date") + 1)
    g = g.filter(F.col("event_duration_days") >= min_duration_days)
    g = row_index(g, [KEY], "event_start_date", "_eid")
    out = [KEY, (F.col("_eid") + 1).cast("int").alias("event_id"), "event_start_date", "event_end_date",
           F.col("_peak.date").alias("peak_date"), F.col(f"_peak.{flow}").alias("peak_streamflow_m3s"),
           "event_duration_days", "event_mean_streamflow_m3s"]
    # keep_threshold lets the summary reuse the station threshold instead of a second percentile pass
    return g.select(*out, *(["event_threshold"] if keep_threshold else []))


def inter_event_gaps(events: DataFrame) -> DataFrame:
    """previous/next event neighbours and the four gap columns (lag/lead, blocked)."""
    e = neighbour_rows(events, [KEY], "event_start_date", prev_cols=["event_end_date", "event_start_date"],
                       next_cols=["event_start_date"])
    return e.select(
        *events.columns,
        F.col("event_end_date__prev").alias("previous_event_end_date"),
        F.col("event_start_date__next").alias("next_event_start_date"),
        F.datediff("event_start_date", "event_start_date__prev").alias("days_between_event_starts"),
        (F.datediff("event_start_date", "event_end_date__prev") - 1).alias("inter_event_gap_days"),
        F.datediff("event_start_date__next", "event_start_date").alias("days_until_next_event_start"),
        (F.datediff("event_start_date__next", "event_end_date") - 1).alias("days_until_next_event_from_end"),
    )


# ---- A8 ----------------------------------------------------------------------------------

# The summary table's columns.
SUMMARY_COLUMNS = (
    "analysis_start_date", "analysis_end_date", "streamflow_start_date", "streamflow_peak_date",
    "streamflow_peak_m3s", "days_from_streamflow_start_to_peak", "event_count", "average_event_duration_days",
    "average_inter_event_gap_days", "median_inter_event_gap_days", "average_days_between_event_starts",
    "median_days_between_event_starts", "event_recurrence_every_n_days", "event_frequency_per_year",
    "average_peak_streamflow_m3s", "peak_flow_date", "peak_flow_streamflow_m3s", "first_event_start_date",
    "last_event_end_date", "event_threshold_streamflow_m3s", "event_quantile", "min_duration_days",
    "suggested_lstm_lookback_days",
)


def event_summary(daily: DataFrame, quantile: float = 0.90, min_duration_days: int = 1,
                  start: str | None = None, end: str | None = None, flow: str = FLOW,
                  exact: bool = True, events: DataFrame | None = None) -> DataFrame:
    """One row per station with the 23 summary columns (rounded half-even to 4 places).

    Branches as in the reference: no rows in the window → analysis dates and 0 events;
    no valid flow → all null; no event → all null with 0 events.
    """
    if events is None:
        events = detect_events(daily, quantile, min_duration_days, start, end, flow, exact, keep_threshold=True)
    gaps = inter_event_gaps(events)
    s = _analysis_series(daily, start, end, flow)
    stats = [F.count(F.lit(1)).alias("_n"), F.count(flow).alias("_valid"),
             F.min(F.when(F.col(flow).isNotNull(), F.col("date"))).alias("_sf_start"),
             F.max(F.struct(F.col(flow), (-F.unix_date("date")).alias("nd"), F.col("date"))).alias("_sf_peak")]
    reuse = "event_threshold" in events.columns  # the threshold only shows when events exist
    series = s.groupBy(KEY).agg(*stats)
    if not reuse:
        thr = event_thresholds(s, quantile, flow, exact).withColumnRenamed("event_threshold", "_thr")
        series = series.join(thr, KEY, "left")  # a row a station on both sides
    ev = gaps.groupBy(KEY).agg(
        F.count(F.lit(1)).alias("_count"), F.avg("event_duration_days").alias("_avg_dur"),
        F.avg("inter_event_gap_days").alias("_avg_gap"), F.median("inter_event_gap_days").alias("_med_gap"),
        F.avg("days_between_event_starts").alias("_avg_bs"), F.median("days_between_event_starts").alias("_med_bs"),
        F.min("event_start_date").alias("_first"), F.max("event_end_date").alias("_last"),
        F.avg("peak_streamflow_m3s").alias("_avg_peak"),
        F.max(F.struct(F.col("peak_streamflow_m3s"), (-F.unix_date("event_start_date")).alias("ns"),
                       F.col("peak_date"))).alias("_pk"),
        *([F.first("event_threshold").alias("_thr")] if reuse else []))
    stations = daily.select(KEY).distinct()
    j = stations.join(series, KEY, "left").join(ev, KEY, "left")
    n = F.coalesce(F.col("_n"), F.lit(0))
    valid = F.coalesce(F.col("_valid"), F.lit(0))
    count = F.coalesce(F.col("_count"), F.lit(0))
    full = (n > 0) & (valid > 0) & (count > 0)
    empty_window = n == 0

    def only(c):
        return F.when(full, c)

    a_start = F.lit(start).cast("date") if start else F.lit(None).cast("date")
    a_end = F.lit(end).cast("date") if end else F.lit(None).cast("date")
    span = F.datediff("_last", "_first") + 1
    rec = round4(F.col("_avg_bs"))
    cols = {
        "analysis_start_date": F.when(full | empty_window, a_start),
        "analysis_end_date": F.when(full | empty_window, a_end),
        "streamflow_start_date": only(F.col("_sf_start")),
        "streamflow_peak_date": only(F.col("_sf_peak.date")),
        "streamflow_peak_m3s": only(round4(F.col(f"_sf_peak.{flow}"))),
        "days_from_streamflow_start_to_peak": only(F.datediff("_sf_peak.date", "_sf_start")),
        "event_count": F.when(full | empty_window | ((valid > 0) & (count == 0)), count.cast("long")),
        "average_event_duration_days": only(round4(F.col("_avg_dur"))),
        "average_inter_event_gap_days": only(round4(F.col("_avg_gap"))),
        "median_inter_event_gap_days": only(round4(F.col("_med_gap"))),
        "average_days_between_event_starts": only(rec),
        "median_days_between_event_starts": only(round4(F.col("_med_bs"))),
        "event_recurrence_every_n_days": only(rec),
        "event_frequency_per_year": only(F.when(span > 0, round4(F.col("_count") / (span / F.lit(365.25))))),
        "average_peak_streamflow_m3s": only(round4(F.col("_avg_peak"))),
        "peak_flow_date": only(F.col("_pk.peak_date")),
        "peak_flow_streamflow_m3s": only(round4(F.col("_pk.peak_streamflow_m3s"))),
        "first_event_start_date": only(F.col("_first")),
        "last_event_end_date": only(F.col("_last")),
        "event_threshold_streamflow_m3s": only(round4(F.col("_thr"))),
        "event_quantile": only(F.lit(float(quantile))),
        "min_duration_days": only(F.lit(int(min_duration_days))),
        "suggested_lstm_lookback_days": only(F.when(rec.isNotNull(), F.greatest(F.lit(1), F.bround(rec, 0).cast("int")))),
    }
    return j.select(KEY, *[cols[c].alias(c) for c in SUMMARY_COLUMNS])


# ---- W4, W5 ------------------------------------------------------------------------------

def lookback_choice(summary: DataFrame, default_days: int = 30, auto: bool = False) -> DataFrame:
    """Per station lookback and its source label."""
    sug = F.col("suggested_lstm_lookback_days")
    if not auto:
        days, src = F.lit(default_days), F.lit("fixed_default")
    else:
        days = F.coalesce(sug, F.lit(default_days))
        src = F.when(sug.isNull(), F.lit("fixed_default_no_event_recurrence")).otherwise(F.lit("auto_event_recurrence"))
    return summary.select(KEY, days.cast("int").alias("lstm_lookback_days"), src.alias("lstm_lookback_source"))


def event_windows(events: DataFrame, lookback: DataFrame | int) -> DataFrame:
    """Training window per event: input = L days ending the day before the event start;
    target = the event. ``lookback`` is an int or the per-station frame from ``lookback_choice``."""
    if isinstance(lookback, int):
        e = events.withColumn("_L", F.lit(lookback))
    else:
        e = events.join(lookback.select(KEY, F.col("lstm_lookback_days").alias("_L")), KEY, "left")
    in_start = F.date_sub(F.col("event_start_date"), F.col("_L"))
    in_end = F.date_sub(F.col("event_start_date"), 1)
    return e.select(
        KEY, "event_id", in_start.alias("input_start_date"), in_end.alias("input_end_date"),
        F.col("event_start_date").alias("target_start_date"), F.col("event_end_date").alias("target_end_date"),
        (F.datediff(in_end, in_start) + 1).alias("input_window_days"),
        (F.datediff("event_end_date", "event_start_date") + 1).alias("target_window_days"),
        "event_start_date", "event_end_date", "peak_date", "peak_streamflow_m3s")


def readiness_report(files: dict[str, DataFrame], stations: DataFrame, attributes: dict[str, DataFrame],
                     streamflow: DataFrame, th: Thresholds = Thresholds(), analysis_start: str | None = None,
                     analysis_end: str | None = None) -> dict[str, DataFrame]:
    """The seven readiness tables for all stations (S12 writes them with ``sinks.write_report``):
    coverage, intervention, decision, events, event summary, lookback choice, event windows."""
    cov = coverage_summary(files, stations, th)
    iv = human_intervention(attributes["human_intervention"], attributes["quality_check"], attributes["location"],
                            attributes["land_cover"], stations, th)
    ev = detect_events(streamflow, th.streamflow_event_quantile, th.streamflow_event_min_duration_days,
                       analysis_start, analysis_end)
    summ = event_summary(streamflow, th.streamflow_event_quantile, th.streamflow_event_min_duration_days,
                         analysis_start, analysis_end, events=ev)
    lb = lookback_choice(summ, th.lstm_lookback_days, th.lstm_lookback_auto_from_events)
    return {"coverage": cov, "intervention": iv, "decision": decision(cov, iv), "events": inter_event_gaps(ev),
            "event_summary": summ, "lookback": lb, "event_windows": event_windows(ev, lb)}
