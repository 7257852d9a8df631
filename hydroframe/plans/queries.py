"""Registered queries: each runs library operators over the driver's tables (through the
stand-ins in ``bindings``) and has an equivalent DuckDB SQL oracle in ``oracle.py``.

Doubles are rounded to 6 places at the very end (presentation only) so that the Spark result
and the SQL oracle hash alike despite different float summation orders.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hydroframe.operators import prepare as P
from hydroframe.operators import readiness as R
from hydroframe.plans import bindings as B
from hydroframe.session import configure, cut_lineage

QueryFn = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, QueryFn] = {}

# Query parameters (fixed for the registered queries; all are function arguments in the library).
ANALYSIS_START, ANALYSIS_END = "1995-03-01", "2001-06-30"
EVENT_QUANTILE, EVENT_MIN_DAYS = 0.9, 2
# Stand-in periods over the driver's 1995-2001 calendar (same three-way shape as the reference).
TEST_PERIODS = (("Passado", "1995-01-01", "1996-12-31"),
                ("Recente", "1997-01-01", "1999-12-31"),
                ("Teste", "2000-01-01", "2001-08-01"))


def register(name: str):
    def deco(fn: QueryFn) -> QueryFn:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            configure(spark)
            return fn(spark, sf_dir)
        run.__name__, run.__doc__ = fn.__name__, fn.__doc__
        REGISTRY[name] = run
        return run
    return deco


def round_like_sql(c, digits: int = 6):
    """Round as the SQL engine does for doubles: ``round(x·10^d) / 10^d`` with half away from zero
    on the binary product (Spark's ``round`` on the product equals that for |x·10^d| < 2^52);
    infinities and NaN pass through; ``+ 0.0`` folds -0.0 into 0.0."""
    m = float(10 ** digits)
    r = F.round(c * F.lit(m), 0) / F.lit(m)
    return F.when(F.isnan(c) | (F.abs(c) == F.lit(float("inf"))), c).otherwise(r) + F.lit(0.0)


def finish(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double column (presentation step for the oracle comparison)."""
    return df.select(*[round_like_sql(F.col(f.name), digits).alias(f.name)
                       if isinstance(f.dataType, T.DoubleType) else F.col(f.name) for f in df.schema.fields])


# ---- flagship ---------------------------------------------------------------------------

def filled_flow(spark, d, limit=3, mode="inside"):
    return P.fill_short_gaps(B.daily_flow(spark, d), ["streamflow_m3s"], limit=limit, mode=mode)


@register("event_summary")
def q_event_summary(spark: SparkSession, d: str) -> DataFrame:
    """Daily flow (orders ⋈ customer, densified) → W1 gap fill (limit 3, inside) → W2 events →
    W3 gaps → A8 summary per station."""
    daily = cut_lineage(filled_flow(spark, d))
    events = cut_lineage(R.detect_events(daily, EVENT_QUANTILE, EVENT_MIN_DAYS, ANALYSIS_START, ANALYSIS_END,
                                         keep_threshold=True))
    return finish(R.event_summary(daily, EVENT_QUANTILE, EVENT_MIN_DAYS, ANALYSIS_START, ANALYSIS_END,
                                  events=events))


# ---- prepare ----------------------------------------------------------------------------

@register("gap_fill_inside")
def q_gap_fill_inside(spark, d):
    """W1 preset (a): limit 3, both directions, inside gaps only, by row position."""
    return finish(filled_flow(spark, d, 3, "inside"))


@register("gap_fill_forward")
def q_gap_fill_forward(spark, d):
    """W1 preset (b): limit 5, forward; trailing nulls take the last value."""
    return finish(filled_flow(spark, d, 5, "forward"))


MASTER_FILL = ["streamflow_m3s", "precipitation", "temperature", "actual_evapotransp", "oni",
               "static_region_key", "static_n_suppliers", "static_mean_acctbal"]


def joined_daily(spark, d):
    """Daily flow (densified) ⋈ forcing file, full outer on (station, date)."""
    return P.outer_join_variables([B.daily_flow(spark, d), B.daily_forcings(spark, d)])


def monthly_index(spark, d):
    return P.monthly_index_long(B.monthly_index_wide(spark, d))


def master_dataset(spark, d):
    """Master plan: J1 → P3 → J2 (monthly index) → P4 (origin 1) → P5 → J5 (statics) → P10 →
    W1 (forward, limit 5) → P8."""
    m = P.calendar_parts(joined_daily(spark, d))
    m = P.attach_monthly(m, monthly_index(spark, d))
    m = P.cyclic_encoding(m, origin=1)
    m = P.assign_period(m, TEST_PERIODS)
    m = P.attach_static(m, B.station_attributes(spark, d), prefix="static_")
    # P10 (time_idx = row position before the drop) comes out of the same blocked pass as W1.
    m = P.fill_short_gaps(m, MASTER_FILL, limit=5, mode="forward", keep_position="time_idx")
    return P.complete_cases(m)


@register("master_dataset")
def q_master_dataset(spark, d):
    return finish(master_dataset(spark, d))


@register("monthly_index_long")
def q_monthly_index_long(spark, d):
    """U1 + F12: wide monthly index → (year, month, oni), sentinel → null."""
    return finish(monthly_index(spark, d))


def finalized(spark, d):
    """prepare flow up to scaling: J1 → P3 → J2 → J5 → P4 (origin 0) → W1 (inside, 3) → P5 → P6 → P9."""
    m = P.calendar_parts(joined_daily(spark, d)).drop("day_of_year")
    m = P.attach_monthly(m, monthly_index(spark, d))
    m = P.attach_static(m, B.station_attributes(spark, d), prefix="static_")
    m = P.cyclic_encoding(m, origin=0)
    m = P.fill_short_gaps(m, P.numeric_columns(m), limit=3, mode="inside")
    m = P.keep_periods(P.assign_period(m, TEST_PERIODS), TEST_PERIODS)
    return P.calendar_index(m)


SCALE_FIT = ("Passado", "Recente")


@register("prepare_scaled")
def q_prepare_scaled(spark, d):
    """A3: min-max per station fitted on the past and recent periods."""
    m = cut_lineage(finalized(spark, d))
    scaled, _ = P.min_max_scale(m, P.numeric_columns(m), SCALE_FIT)
    return finish(scaled)


@register("scaling_metadata")
def q_scaling_metadata(spark, d):
    m = finalized(spark, d)
    return finish(P.fit_min_max(m, P.numeric_columns(m), SCALE_FIT))


@register("period_counts")
def q_period_counts(spark, d):
    """Rows per station and period (null period counted) before the period filter."""
    return P.period_counts(P.assign_period(joined_daily(spark, d), TEST_PERIODS))


@register("training_ready")
def q_training_ready(spark, d):
    """Per station start = max(floor, first flow date); fixed column order; complete cases."""
    m = cut_lineage(finalized(spark, d))
    return finish(P.training_ready(m, "streamflow_m3s", ("precipitation", "oni", "month_sin", "month_cos"),
                                   floor_date="1995-02-01"))


# ---- readiness --------------------------------------------------------------------------

@register("flow_events")
def q_flow_events(spark, d):
    """W2 + W3: events with neighbour gaps."""
    daily = cut_lineage(filled_flow(spark, d))
    ev = R.detect_events(daily, EVENT_QUANTILE, EVENT_MIN_DAYS, ANALYSIS_START, ANALYSIS_END)
    return finish(R.inter_event_gaps(ev))


@register("event_windows")
def q_event_windows(spark, d):
    """W5 (auto lookback from the event recurrence) + W4 windows."""
    daily = cut_lineage(filled_flow(spark, d))
    ev = cut_lineage(R.detect_events(daily, EVENT_QUANTILE, EVENT_MIN_DAYS, ANALYSIS_START, ANALYSIS_END,
                                     keep_threshold=True))
    summ = R.event_summary(daily, EVENT_QUANTILE, EVENT_MIN_DAYS, ANALYSIS_START, ANALYSIS_END, events=ev)
    lb = R.lookback_choice(summ, 30, auto=True)
    return finish(R.event_windows(ev, lb).join(lb, "station_id", "inner"))


READINESS = R.Thresholds(required_start_date="1995-01-10", required_end_date="2001-07-01")


def stations(spark, d):
    return B.table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("station_id"))


def forcing_files(spark, d):
    """The four per-variable 'files'; the shared daily aggregates are materialised once."""
    return B.forcing_files(cut_lineage(B.forcing_daily(spark, d)), cut_lineage(B.daily_flow(spark, d)))


@register("coverage")
def q_coverage(spark, d):
    """A1 + A2 + P19: coverage per station × variable, missing files included."""
    return finish(R.coverage_summary(forcing_files(spark, d), stations(spark, d), READINESS))


def intervention(spark, d):
    t = B.station_attribute_tables(spark, d)
    return R.human_intervention(t["human_intervention"], t["quality_check"], t["location"], t["land_cover"],
                                stations(spark, d), READINESS)


@register("human_intervention")
def q_human_intervention(spark, d):
    """J4 + P14: intervention flags per station (absent → attribute_found = false)."""
    return finish(intervention(spark, d))


@register("readiness_decision")
def q_readiness_decision(spark, d):
    """2×2 verdict per station."""
    cov = R.coverage_summary(forcing_files(spark, d), stations(spark, d), READINESS)
    return R.decision(cov, intervention(spark, d))


# ---- ranking ----------------------------------------------------------------------------

from hydroframe.operators import ranking as K  # noqa: E402

TARGET_GAUGE = "72"


def candidates(spark, d):
    """J3 star join → P13 candidate filter → S6/J6 availability flag → K1 score, not yet ranked."""
    cand = K.southern_candidates(K.star_join(B.gauge_attributes(spark, d)))
    return K.score(cand, K.dynamic_availability(B.file_listing(spark, d)))


@register("dynamic_availability")
def q_dynamic_availability(spark, d):
    return K.dynamic_availability(B.file_listing(spark, d))


@register("ranking_scores")
def q_ranking_scores(spark, d):
    return finish(K.ranked(candidates(spark, d)))


@register("ranking_top")
def q_ranking_top(spark, d):
    """K2: top 15, without ranking the others."""
    return finish(K.top_candidates(candidates(spark, d), 15))


@register("ranking_comparison")
def q_ranking_comparison(spark, d):
    """K3 + U3: target first, then top 5, deduplicated."""
    return finish(K.comparison_table(K.leaders(cut_lineage(candidates(spark, d)), TARGET_GAUGE, 5), TARGET_GAUGE, 5))


@register("ranking_recommendation")
def q_ranking_recommendation(spark, d):
    """K4: principal and reserve."""
    return finish(K.recommendation(K.leaders(cut_lineage(candidates(spark, d)), TARGET_GAUGE, 2), TARGET_GAUGE))


# ---- windows and splits -----------------------------------------------------------------

from hydroframe.operators import windows as W  # noqa: E402

WINDOW_FEATURES = ["precipitation", "temperature", "actual_evapotransp", "sin_day", "cos_day", "sin_month", "cos_month"]
LOOKBACK, HORIZON = 30, 7


SPLIT = W.DateSplit("1995-01-01", "1999-12-31", "2000-01-01", "2001-08-01", 0.15)


def scaled_master_and_fit(spark, d):
    """A4 + F1 on the master table: log1p(clip) target and features z-scored on all rows (T1); and the fit."""
    m = cut_lineage(master_dataset(spark, d))
    m = W.log_target(m, "streamflow_m3s", "target_log")
    m = m.withColumn("target_raw", F.greatest(F.col("streamflow_m3s"), F.lit(0.0)))
    fit = W.fit_scale(m, ["target_log", *WINDOW_FEATURES])
    return W.standardise(m, ["target_log", *WINDOW_FEATURES], fit=fit), fit


def scaled_master(spark, d):
    return scaled_master_and_fit(spark, d)[0]


def sequence_windows(spark, d, split=None):
    return W.lookback_windows(scaled_master(spark, d), LOOKBACK, HORIZON, WINDOW_FEATURES, "target_log", split=split)


@register("lookback_windows")
def q_lookback_windows(spark, d):
    """L=30, H=7 windows, summarised per window (the arrays themselves are checked in tests)."""
    w = sequence_windows(spark, d)
    return finish(w.select(
        "station_id", "window_end_date", "target_date", F.size("inputs").alias("n_steps"),
        F.col("inputs")[0]["date"].alias("first_input_date"),
        F.aggregate("inputs", F.lit(0.0), lambda a, x: a + x["target_log"]).alias("sum_inputs_target"),
        F.aggregate("inputs", F.lit(0.0), lambda a, x: a + x["precipitation"]).alias("sum_inputs_precip"),
        "target", "target_raw"))


@register("chronological_split")
def q_chronological_split(spark, d):
    """Validation tail of the train pool by target date; counts per station and split."""
    return sequence_windows(spark, d, SPLIT).groupBy("station_id", "split", "n_pool", "split_error").agg(
        F.count(F.lit(1)).alias("n_windows"), F.min("target_date").alias("first_target_date"),
        F.max("target_date").alias("last_target_date"))


@register("encoder_decoder_windows")
def q_encoder_decoder_windows(spark, d):
    """Encoder 30 rows, decoder 7 rows (all targets), summarised per window."""
    m = cut_lineage(master_dataset(spark, d))
    w = W.encoder_decoder_windows(m, LOOKBACK, HORIZON, ["precipitation"], "streamflow_m3s")
    return finish(w.select(
        "station_id", "decoder_start_date", "decoder_start_idx",
        F.col("encoder")[0]["date"].alias("encoder_first_date"),
        F.col("decoder")[HORIZON - 1]["date"].alias("decoder_last_date"),
        F.aggregate("decoder", F.lit(0.0), lambda a, x: a + x["target"]).alias("sum_decoder_target"),
        F.aggregate("encoder", F.lit(0.0), lambda a, x: a + x["precipitation"]).alias("sum_encoder_precip")))


GRID_REQUIRED = ["streamflow_m3s", "precipitation", "temperature", "actual_evapotransp", "oni"]


def window_grid(spark, d):
    return W.monthly_window_grid(cut_lineage(finalized(spark, d)), 1, 24, ("Teste",), GRID_REQUIRED, True)


@register("monthly_window_grid")
def q_monthly_window_grid(spark, d):
    """W7 + A9: target months of the test period × 1..24 month windows."""
    return window_grid(spark, d)


@register("window_candidates")
def q_window_candidates(spark, d):
    """Candidate windows per target month."""
    return W.candidate_summary(window_grid(spark, d))


@register("first_index_at_or_after")
def q_first_index_at_or_after(spark, d):
    """A10: first time_idx at or after the test start, per station."""
    return W.first_index_at_or_after(master_dataset(spark, d), "2000-01-01")


@register("standardise_by_station")
def q_standardise_by_station(spark, d):
    """A4 (group fit): z-scores per station."""
    m = master_dataset(spark, d).select("station_id", "date", "precipitation", "temperature")
    return finish(W.standardise(m, ["precipitation", "temperature"], by=["station_id"], suffix="_z"))


# ---- metrics ----------------------------------------------------------------------------

from hydroframe.operators import metrics as M  # noqa: E402


@register("hydro_metrics")
def q_hydro_metrics(spark, d):
    """A5: MAE, RMSE, R2/NSE, KGE, sMAPE per group and split of the prediction stand-in."""
    return finish(M.hydro_metrics(B.predictions(spark, d), ["group", "split"]))


@register("low_flow_metrics")
def q_low_flow_metrics(spark, d):
    """A7 (10 % quantile of the train rows per group) + A6 on the test rows."""
    p = B.predictions(spark, d)
    q90 = M.low_flow_reference(p.filter(F.col("split") == "train"), ["group"], "y_true", 0.10)
    test = p.filter(F.col("split") == "test").join(q90, "group", "inner")
    return finish(M.low_flow_metrics(test, ["group"]))


@register("persistence_metrics")
def q_persistence_metrics(spark, d):
    """M2 + J10 + A5: persistence forecast (H = 1 and 7 rows) on the gap-filled daily flow,
    scored per station where both values exist."""
    daily = cut_lineage(filled_flow(spark, d, 5, "forward"))
    p = M.persistence_forecasts(daily, [1, 7]).filter(F.col("y_true").isNotNull() & F.col("y_pred").isNotNull())
    return finish(M.hydro_metrics(p, ["station_id", "horizon"]))


# ---- experiments ------------------------------------------------------------------------

from hydroframe.operators import experiments as X  # noqa: E402
from hydroframe.functions.scalar import parse_study_name  # noqa: E402


@register("best_so_far")
def q_best_so_far(spark, d):
    """Running best per study over complete trials, by the metric's direction."""
    return finish(X.best_so_far(B.trials(spark, d)))


@register("best_trial")
def q_best_trial(spark, d):
    """K6 + P17: best complete trial per study, earliest on ties."""
    return finish(X.best_trial(B.trials(spark, d)))


@register("guarded_objective")
def q_guarded_objective(spark, d):
    """P16 + P17: non-finite objectives replaced by the direction's worst value."""
    t = B.trials(spark, d)
    v = F.when(F.col("state") == "COMPLETE", F.col("value"))
    return finish(t.select("study_name", "number", X.guard_non_finite(v, X.is_minimised(F.col("metric")))
                           .alias("objective")))


@register("axis_means")
def q_axis_means(spark, d):
    """Grouping sets (model, period, horizon) and (model, period, lookback)."""
    r = B.experiment_results(spark, d).withColumnsRenamed({"NSE": "nse", "KGE": "kge", "MAE": "mae"})
    return finish(X.mean_by_axis(r))


@register("status_counts")
def q_status_counts(spark, d):
    """A14."""
    return X.status_counts(B.experiment_results(spark, d))


@register("nse_by_lookback")
def q_nse_by_lookback(spark, d):
    """Successful runs' NSE series by lookback."""
    r = B.experiment_results(spark, d).withColumnRenamed("NSE", "nse")
    return finish(X.nse_by_lookback(r))


@register("lognse_boxplot")
def q_lognse_boxplot(spark, d):
    """P18 + A15: normalised result rows → box statistics per period × model."""
    return finish(X.boxplot_stats(X.normalise_results(B.experiment_results(spark, d))))


@register("mean_std_summary")
def q_mean_std_summary(spark, d):
    """Mean ± sample std by model × horizon × period (successful runs)."""
    r = B.experiment_results(spark, d).filter(F.col("status") == "success")
    return finish(X.mean_std_summary(r))


@register("best_study_per_horizon")
def q_best_study_per_horizon(spark, d):
    """K5: best TFT study per horizon for the past period."""
    return X.best_study_per_horizon(B.experiment_results(spark, d), "passado")


@register("study_names")
def q_study_names(spark, d):
    """F7 + F8: study names built and parsed back."""
    r = B.experiment_results(spark, d).select("study_name").distinct()
    return r.select("study_name", parse_study_name("study_name").alias("p")).select("study_name", "p.*")


# ---- importance and attention -----------------------------------------------------------

from hydroframe.operators import importance as I  # noqa: E402


def importance_rows(spark, d):
    return I.importance_rows(B.importance_payloads(spark, d))


@register("importance_pivot")
def q_importance_pivot(spark, d):
    """S8 + A16 + U2."""
    return finish(I.mean_importance_pivot(importance_rows(spark, d)))


@register("importance_top_k")
def q_importance_top_k(spark, d):
    """K7: top 3 features overall."""
    return finish(I.top_k_features(I.mean_importance_pivot(importance_rows(spark, d)), 3))


@register("importance_sources")
def q_importance_sources(spark, d):
    """A17."""
    return I.distinct_sources(importance_rows(spark, d))


@register("importance_percent")
def q_importance_percent(spark, d):
    """Per payload, each feature's share of the payload's total in percent."""
    p = B.importance_payloads(spark, d).select("event_id", F.explode("feature_importance").alias("feature", "score"))
    return finish(I.to_percent(p, ["event_id"]))


@register("importance_top_in_map")
def q_importance_top_in_map(spark, d):
    """K8: the two largest entries of each payload's map."""
    p = B.importance_payloads(spark, d)
    t = p.select("event_id", F.posexplode(I.top_in_map(F.col("feature_importance"), 2)).alias("pos", "e"))
    return finish(t.select("event_id", "pos", F.col("e.key").alias("feature"), F.col("e.value").alias("score")))


def attention(spark, d, max_samples=None):
    """Cells of all samples, with the sample position per study by vec_id (blocked scan)."""
    from hydroframe.operators.scan import blocked_scan
    a = B.attention_rows(spark, d)
    a = blocked_scan(a, ["study"], "vec_id", pos="sample_pos", block=F.floor(F.col("vec_id") / 4096))
    return I.attention_cells_long(a, "study", "sample_pos", "attention_row", max_samples)


@register("attention_per_lag")
def q_attention_per_lag(spark, d):
    """Mean attention per lag over all samples of each study."""
    return finish(I.mean_attention_per_lag(attention(spark, d)))


@register("attention_head")
def q_attention_head(spark, d):
    """The first 32 samples of each study, as the picture of the matrix shows them."""
    return finish(attention(spark, d, 32))


@register("attention_smoothed")
def q_attention_smoothed(spark, d):
    """Lag binning and Gaussian smoothing of the mean attention."""
    return finish(I.smooth_lags(I.mean_attention_per_lag(attention(spark, d))))


def encoder_entries(spark, d):
    """List-form encoder importances: one entry (map) per payload of a study, entry position by
    event id (blocked scan)."""
    from hydroframe.operators.scan import blocked_scan
    p = B.importance_payloads(spark, d).select("study", "event_id", F.col("feature_importance").alias("m"))
    return blocked_scan(p, ["study"], "event_id", pos="entry", block=F.floor(F.col("event_id") / 4096))


@register("encoder_variable_means")
def q_encoder_variable_means(spark, d):
    """Mean importance over entries per study and variable (absent → 0)."""
    return finish(I.encoder_variable_means_long(encoder_entries(spark, d)))


@register("top_variable_names")
def q_top_variable_names(spark, d):
    """K9: top 4 (study, variable) pairs → unique names, index variable forced in."""
    return I.top_variable_names(I.encoder_variable_means_long(encoder_entries(spark, d)), 4)


# ---- forecasting (rows-only: model fits have no SQL oracle) -----------------------------

from hydroframe.operators import forecast as FC  # noqa: E402


def labelled_windows(spark, d):
    """W6 + W9 windows of the scaled master table, written once for the fit's passes, and the target's scale."""
    m, fit = scaled_master_and_fit(spark, d)
    w = W.lookback_windows(m, LOOKBACK, HORIZON, WINDOW_FEATURES, "target_log", split=SPLIT)
    return cut_lineage(w), fit["target_log"]


@register("forecast_lag_regression")
def q_forecast_lag_regression(spark, d):
    """M1: ridge regression on the L=30, H=7 windows of all stations, fitted on the train
    windows of the chronological split; A5/A6 per station and split, in flow units (F2)."""
    w, target_fit = labelled_windows(spark, d)
    return finish(FC.score(FC.fit_windows(w, ["target_log", *WINDOW_FEATURES], FC.linear(), target_fit)[1]))


@register("forecast_one_lag")
def q_forecast_one_lag(spark, d):
    """M1 with one feature, the last known scaled log flow: least squares over all stations, A5/A6 in flow units (F2)."""
    w, target_fit = labelled_windows(spark, d)
    return finish(FC.score(FC.fit_windows(w, ["target_log"], FC.linear(reg_param=0.0), target_fit, steps=1)[1]))


@register("forecast_boosted_trees")
def q_forecast_boosted_trees(spark, d):
    """M1 with gradient-boosted trees over the last seven steps of each window; A5/A6 in flow units (F2)."""
    w, target_fit = labelled_windows(spark, d)
    return finish(FC.score(FC.fit_windows(w, ["target_log", *WINDOW_FEATURES], FC.boosted_trees(), target_fit, steps=7)[1]))


@register("monthly_index_lags")
def q_monthly_index_lags(spark, d):
    """Documented extra: monthly index with ±1..3 month shifts."""
    return finish(P.monthly_lags(monthly_index(spark, d)))


@register("tft_dataset_split")
def q_tft_dataset_split(spark, d):
    """W8 + W9 (multi-step builder): windows per station and dataset, with the group target
    normalisation and the split indexes."""
    m = cut_lineage(master_dataset(spark, d))
    w = W.tft_datasets(m, LOOKBACK, HORIZON, ["precipitation"], "streamflow_m3s", "1995-01-01", "1999-12-31",
                       "2000-01-01", "2001-08-01", 0.15)
    return finish(w.groupBy("station_id", "dataset", "val_start_idx", "test_start_idx", "target_center",
                            "target_scale", "encoder_length").agg(
        F.count(F.lit(1)).alias("n_windows"), F.min("decoder_start_idx").alias("first_decoder_idx"),
        F.max("decoder_start_idx").alias("last_decoder_idx")))


@register("row_split_datasets")
def q_row_split_datasets(spark, d):
    """W9 fallback of the multi-step builder: without dates, 70 / 85 / 100 % of the rows of each station."""
    m = cut_lineage(master_dataset(spark, d))
    w = W.tft_datasets(m, LOOKBACK, HORIZON, ["precipitation"], "streamflow_m3s")
    return finish(w.groupBy("station_id", "dataset", "val_start_idx", "test_start_idx", "target_center", "target_scale").agg(
        F.count(F.lit(1)).alias("n_windows"), F.min("decoder_start_idx").alias("first_decoder_idx"),
        F.max("decoder_start_idx").alias("last_decoder_idx")))


# The multi-step model's known reals.
KNOWN_REALS = ["time_idx", "precipitation", "temperature", "actual_evapotransp", "oni", "sin_day", "cos_day", "sin_month", "cos_month"]


@register("model_inputs")
def q_model_inputs(spark, d):
    """W8 with roles: windows with relative index, known reals of encoder and decoder, statics and target scales, summarised
    per window (the arrays themselves are checked in tests)."""
    m = cut_lineage(master_dataset(spark, d))
    roles = P.feature_roles(m)
    w = W.model_inputs(m, LOOKBACK, HORIZON, "streamflow_m3s", KNOWN_REALS, roles["static_categoricals"], roles["static_reals"],
                       train_start=SPLIT.train_start, train_end=SPLIT.train_end, test_start=SPLIT.test_start, test_end=SPLIT.test_end)
    total = lambda steps, i: F.aggregate(steps, F.lit(0.0), lambda a, x: a + x[i])
    known, names = [c for c in KNOWN_REALS if c in m.columns], roles["static_categoricals"]
    return finish(w.select(
        "station_id", "dataset", "decoder_start_date", "decoder_start_idx", "encoder_length", "decoder_length",
        F.col("encoder_reals")[0][len(known)].alias("first_relative_idx"), F.col("decoder_reals")[HORIZON - 1][len(known)].alias("last_relative_idx"),
        *[total("decoder_reals", i).alias(f"decoder_{c}") for i, c in enumerate(known)],
        total("encoder_reals", known.index("oni")).alias("encoder_oni"),
        F.array_max("encoder_target").alias("highest_encoder_target"), F.array_max("decoder_target").alias("highest_decoder_target"),
        *[F.col("static_categoricals")[c].alias(c) for c in names], F.col("static_reals")["static_mean_acctbal"].alias("static_mean_acctbal"),
        F.col("target_scales")[0].alias("target_center"), F.col("target_scales")[1].alias("target_scale"), "split_error"))


@register("expanding_window_folds")
def q_expanding_window_folds(spark, d):
    """Documented extra: expanding-window folds (cut-offs 1997-2000) over the L=30, H=7 windows;
    window counts and target-date span per station, fold and role."""
    w = sequence_windows(spark, d).select("station_id", "target_date")
    f = W.expanding_window_folds(w, [1997, 1998, 1999, 2000])
    return f.groupBy("station_id", "fold_cutoff", "fold_role").agg(
        F.count(F.lit(1)).alias("n_windows"), F.min("target_date").alias("first_target_date"),
        F.max("target_date").alias("last_target_date"))


@register("bootstrap_nse_difference")
def q_bootstrap_nse_difference(spark, d):
    """Documented extra: 1000-replicate bootstrap interval of NSE(a) − NSE(b) per return flag;
    a = quantity × retail price, b = extended price after discount."""
    li = B.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice",
                                               "l_quantity", "l_discount", "l_returnflag")
    part = B.table(spark, d, "part").select("p_partkey", "p_retailprice")
    j = li.join(part, li.l_partkey == part.p_partkey, "inner").select(
        F.col("l_returnflag").alias("group"), F.floor(F.col("l_orderkey") / 64).alias("block"),
        F.col("l_extendedprice").alias("y_true"), (F.col("l_quantity") * F.col("p_retailprice")).alias("pred_a"),
        (F.col("l_extendedprice") * (F.lit(1.0) - F.col("l_discount"))).alias("pred_b"))
    return finish(M.bootstrap_nse_difference(j, ["group"], "block", "y_true", "pred_a", "pred_b", 1000, 7))


@register("encoder_series_scaled")
def q_encoder_series_scaled(spark, d):
    """W12 series variant + F15: one variable's importance over entries per study, block-averaged
    to at most ~200 points and scaled to 0-100."""
    e = encoder_entries(spark, d).select("study", "entry", I.entry_value(F.col("m"), F.lit("k")).alias("v"))
    return finish(I.series_downsample(e, "study", "entry", "v", 200))


@register("encoder_bar_values")
def q_encoder_bar_values(spark, d):
    """The first four K9 names × studies: mean encoder importance over all entries (percent when all ≤ 1)."""
    entries = cut_lineage(encoder_entries(spark, d))
    return finish(I.bar_values(entries, I.top_variable_names(I.encoder_variable_means_long(entries), 4)))


@register("bootstrap_metric_differences")
def q_bootstrap_metric_differences(spark, d):
    """Documented extra: 1000-replicate bootstrap intervals of the NSE, KGE and LogNSE differences
    between two predictions per return flag (same stand-in as bootstrap_nse_difference)."""
    li = B.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice",
                                               "l_quantity", "l_discount", "l_returnflag")
    part = B.table(spark, d, "part").select("p_partkey", "p_retailprice")
    j = li.join(part, li.l_partkey == part.p_partkey, "inner").select(
        F.col("l_returnflag").alias("group"), F.floor(F.col("l_orderkey") / 64).alias("block"),
        F.col("l_extendedprice").alias("y_true"), (F.col("l_quantity") * F.col("p_retailprice")).alias("pred_a"),
        (F.col("l_extendedprice") * (F.lit(1.0) - F.col("l_discount"))).alias("pred_b"))
    return finish(M.bootstrap_metric_differences(j, ["group"], "block", "y_true", "pred_a", "pred_b", 1000, 7))


@register("seasonal_attention")
def q_seasonal_attention(spark, d):
    """Documented extra: attention means by horizon, season and lag over dated samples."""
    a = B.dated_attention_rows(spark, d)
    cells = a.select("horizon", "date", F.posexplode("attention_row").alias("lag", "value"))
    return finish(I.seasonal_attention(cells))


@register("training_splits")
def q_training_splits(spark, d):
    """P11 + P7: the curated rows written once, a folder a period; the written table's metadata."""
    import uuid

    from hydroframe.session import checkpoint_dir
    m = cut_lineage(finalized(spark, d)).drop("period")
    path = f"{checkpoint_dir(spark)}/training-{uuid.uuid4().hex}"
    features = ("precipitation", "oni", "month_sin", "month_cos")
    return finish(P.split_metadata(P.write_training_splits(m, path, TEST_PERIODS, features=features, floor_date="1995-02-01")))


from hydroframe.functions import scalar as S  # noqa: E402


@register("target_round_trip")
def q_target_round_trip(spark, d):
    """F1 + F2: scaled log target and back; per flag the largest error, and what values far below the range come back as."""
    t = B.table(spark, d, "lineitem").select("l_returnflag", F.col("l_extendedprice").alias("y"))
    t = t.withColumn("z", (S.log1p_clipped("y") - 9.5) / 0.75)
    back = lambda z: S.inverse_target(z, F.lit(9.5), F.lit(0.75))
    t = t.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.avg("z").alias("mean_z"), F.max(F.abs(back(F.col("z")) - F.col("y"))).alias("largest_error"),
                                      F.min(back(F.col("z") - 20)).alias("clipped"))
    return finish(t.withColumn("largest_error", round_like_sql(F.col("largest_error"), 3)))


@register("calendar_helpers")
def q_calendar_helpers(spark, d):
    """F4 + F5 on all order dates."""
    t = B.table(spark, d, "orders").select(F.to_date("o_orderdate").alias("date")).distinct()
    return t.select("date", S.month_start("date").alias("month_start"), S.month_end("date").alias("month_end"), S.months_back("date", 3).alias("three_months_back"),
                    S.day_before("date").alias("day_before"), S.inclusive_days(S.month_start("date"), "date").alias("days_of_month"))


@register("payload_fields")
def q_payload_fields(spark, d):
    """F8 + F13: study names built from parts, map fields with a default."""
    p = B.importance_payloads(spark, d)
    period = F.when(F.col("study").contains("passado"), "passado").otherwise("recente")
    lookback = S.get_or_default("feature_importance", "value", 0.0).cast("int") % 90
    return finish(p.select("event_id", S.study_name(F.lit("tft"), period, lookback).alias("study_name"), S.get_or_default("feature_importance", "k", -1.0).alias("k"),
                           S.get_or_default("feature_importance", "absent", -1.0).alias("absent")))


@register("best_sources")
def q_best_sources(spark, d):
    """P1 + P2: dates from year, month and day, and the preferred source column of each variable."""
    li = B.table(spark, d, "lineitem").select("l_suppkey", "l_shipdate", "l_quantity", "l_tax")
    sup = B.table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").cast("string").alias("station_id"))
    day = [F.year("l_shipdate").alias("year"), F.month("l_shipdate").alias("month"), F.dayofmonth("l_shipdate").alias("day")]
    t = li.join(sup, li.l_suppkey == sup.s_suppkey).groupBy("station_id", *day).agg(F.sum("l_quantity").alias("p_mswep"), F.avg("l_tax").alias("tmean_era5land"))
    return finish(P.build_date(P.choose_sources(t, {"precipitation": "p_mswep", "temperature": "tmean_era5land"}), drop_parts=True))
