"""Experiment tables: sweep grid, trial histories, best trials and metric summaries
(J9 P16 P17 P18 W10 K5 K6 A12 A13 A14 A15 A21 U4)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hydroframe.functions.scalar import normalise_text, study_name
from hydroframe.operators.quantile import quantiles_of_counts, small, value_counts
from hydroframe.session import cut_lineage

# Metrics that are minimised (all others are maximised).
MINIMISED = ("val_loss", "RMSE", "MAE", "sMAPE")
# Accepted model and period labels of the result tables.
MODELS = ("lstm", "tft")
PERIODS = ("passado", "recente")


def experiment_grid(spark: SparkSession, horizons, models, periods, lookbacks) -> DataFrame:
    """Horizon × model × period × lookback with the study name ``model_period_lbL_hH``.
    Built by nested ``explode`` of the axis arrays (a generator, no join)."""
    row = spark.range(1).select(
        F.array(*[F.lit(h) for h in horizons]).alias("h"), F.array(*[F.lit(m) for m in models]).alias("m"),
        F.array(*[F.struct(F.lit(p).alias("period"), F.lit(s).alias("train_start"), F.lit(e).alias("train_end"))
                  for p, s, e in periods]).alias("p"),
        F.array(*[F.lit(lb) for lb in lookbacks]).alias("lb"))
    g = (row.select(F.explode("h").alias("horizon"), "m", "p", "lb")
            .select("horizon", F.explode("m").alias("model"), "p", "lb")
            .select("horizon", "model", F.explode("p").alias("p"), "lb")
            .select("horizon", "model", "p.*", F.explode("lb").alias("lookback")))
    return g.withColumn("study_name", study_name("model", "period", "lookback", "horizon"))


def is_minimised(metric: Column) -> Column:
    """True for metrics optimised downwards."""
    return metric.isin(list(MINIMISED))


def guard_non_finite(value: Column, minimise: Column) -> Column:
    """A null/NaN/infinite objective becomes +inf (minimised) or -1e9 (maximised)."""
    bad = value.isNull() | F.isnan(value) | (F.abs(value) == F.lit(float("inf")))
    return F.when(bad, F.when(minimise, F.lit(float("inf"))).otherwise(F.lit(-1e9))).otherwise(value)


def normalise_results(df: DataFrame, value_col: str = "LogNSE", required: bool = False) -> DataFrame:
    """lower+trim labels, numeric coercion, membership filter, non-null value;
    missing columns raise, and so does a result without rows (checked on the spot) with ``required``."""
    missing = sorted({"model", "period", value_col} - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {missing}")
    d = df.withColumns({"model": normalise_text("model"), "period": normalise_text("period"),
                        value_col: F.col(value_col).cast("string").try_cast("double")})
    d = d.filter(F.col("model").isin(list(MODELS)) & F.col("period").isin(list(PERIODS)) & F.col(value_col).isNotNull())
    if required and d.isEmpty():
        raise ValueError(f"no row with a known model and period and a value of {value_col}")
    return d


def union_ragged(frames: list[DataFrame]) -> DataFrame:
    """U4: union by name; missing columns become null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def best_so_far(trials: DataFrame, study: str = "study_name", number: str = "number", value: str = "value",
                metric: str = "metric", state: str = "state", block_trials: int = 4096) -> DataFrame:
    """Running best over COMPLETE trials with a value, in trial order, min or max by the
    metric's direction. Blocked: running extreme inside blocks of trial numbers, plus the
    extreme of all earlier blocks from a one-row-per-block table."""
    d = trials.filter((F.col(state) == "COMPLETE") & F.col(value).isNotNull())
    sign = F.when(is_minimised(F.col(metric)), F.lit(1.0)).otherwise(F.lit(-1.0))
    d = d.withColumn("_sv", sign * F.col(value)).withColumn("_sign", sign)
    d = d.withColumn("_b", F.floor(F.col(number) / block_trials))
    run = Window.partitionBy(study, "_b").orderBy(number).rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("_in", F.min("_sv").over(run))
    blocks = d.groupBy(study, "_b").agg(F.min("_sv").alias("_bm"))
    before = Window.partitionBy(study).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(study, "_b", F.min("_bm").over(before).alias("_carry"))
    j = d.join(blocks, [study, "_b"], "inner")
    best = F.least(F.col("_in"), F.coalesce(F.col("_carry"), F.col("_in"))) * F.col("_sign")
    return j.select(*trials.columns, best.alias("best_so_far"))


def best_trial(trials: DataFrame, study: str = "study_name", number: str = "number", value: str = "value",
               metric: str = "metric", state: str = "state") -> DataFrame:
    """K6: per study the best COMPLETE trial by direction, earliest trial number on ties.
    One aggregate (``min`` of a struct), so a study with many trials is combined map-side."""
    d = trials.filter((F.col(state) == "COMPLETE") & F.col(value).isNotNull())
    sign = F.when(is_minimised(F.col(metric)), F.lit(1.0)).otherwise(F.lit(-1.0))
    key = F.struct((sign * F.col(value)).alias("sv"), F.col(number).alias("n"), F.col(value).alias("v"),
                   F.col(metric).alias("m"))
    g = d.groupBy(study).agg(F.min(key).alias("_b"), F.count(F.lit(1)).alias("n_complete"))
    return g.select(study, F.col("_b.m").alias("metric"), F.col("_b.n").alias("best_trial"),
                    F.col("_b.v").alias("best_value"), "n_complete")


def best_study_per_horizon(results: DataFrame, period: str, model: str = "tft", horizons: list[int] | None = None) -> DataFrame:
    """K5: per horizon the study with the highest LogNSE, then NSE (nulls last; study name as
    the final tie key). An aggregate of a struct, not a window per horizon. ``horizons``: those wanted; one without
    a study is an error when the result is computed."""
    d = results.filter((normalise_text("model") == model) & (normalise_text("period") == period))
    key = F.struct(F.col("LogNSE").isNull().alias("a"), (-F.col("LogNSE")).alias("b"),
                   F.col("NSE").isNull().alias("c"), (-F.col("NSE")).alias("d"),
                   F.col("study_name").alias("s"), F.col("lookback").alias("lb"))
    g = d.groupBy("horizon").agg(F.min(key).alias("_k"))
    if horizons is not None:
        wanted = results.sparkSession.range(1).select(F.explode(F.array(*[F.lit(int(h)) for h in horizons])).alias("horizon"))
        g = wanted.join(g.withColumn("horizon", F.col("horizon").cast("int")), "horizon", "left")
        text = F.concat(F.lit(f"no {model} study for period {period} and horizon "), F.col("horizon").cast("string"))
        g = g.withColumn("_k", F.when(F.col("_k").isNull(), F.raise_error(text)).otherwise(F.col("_k")))
    return g.select("horizon", F.col("_k.lb").alias("lookback"),
                    F.format_string("tft_%s_lb%d_h%d", F.lit(period), F.col("_k.lb"), F.col("horizon")).alias("study"))


def mean_by_axis(results: DataFrame) -> DataFrame:
    """Successful runs only; mean NSE and KGE by horizon and mean MAE and val_loss by
    lookback, per model and period, in one GROUPING SETS aggregate."""
    d = results.filter(F.col("status") == "success")
    return d.groupingSets([["model", "period", "horizon"], ["model", "period", "lookback"]],
                          "model", "period", "horizon", "lookback").agg(
        F.avg("nse").alias("mean_nse"), F.avg("kge").alias("mean_kge"), F.avg("mae").alias("mean_mae"),
        F.avg("val_loss").alias("mean_val_loss"), F.grouping_id().alias("axis_id"))


def nse_by_lookback(results: DataFrame) -> DataFrame:
    """Successful runs, (model, period, lookback, nse) ordered by lookback."""
    return (results.filter(F.col("status") == "success")
                   .select("model", "period", "lookback", "horizon", "nse").orderBy("lookback"))


def status_counts(results: DataFrame, keys=("model", "period")) -> DataFrame:
    """success/failure counts."""
    return results.groupBy(*keys).agg(F.count_if(F.col("status") == "success").alias("n_success"),
                                      F.count_if(F.col("status") == "failed").alias("n_failed"))


def boxplot_stats(df: DataFrame, value: str = "LogNSE", keys=("period", "model"), exact: bool = True) -> DataFrame:
    """Quartiles (linear), 1.5·IQR whiskers (most extreme values inside the fences),
    outlier count and group size, per period × model. All of it comes from the values' counts, in which a group of
    any size is spread over ranges of its values; ``exact=False`` takes the quartiles from ``percentile_approx``."""
    qs, names, keys = [0.25, 0.5, 0.75], ["q1", "median", "q3"], list(keys)
    counts = value_counts(df, keys, value)
    if exact:
        q = quantiles_of_counts(counts, keys, qs, names).withColumnRenamed("total", "n")
    else:
        q = df.groupBy(*keys).agg(F.percentile_approx(value, qs, 100000).alias("_q"), F.count(value).alias("n"))
        q = q.select(*keys, "n", *(F.col("_q")[i].alias(c) for i, c in enumerate(names)))
    q = cut_lineage(q)
    j = counts.withColumnRenamed("n", "n_value").join(small(q), keys, "inner")
    lo = F.col("q1") - 1.5 * (F.col("q3") - F.col("q1"))
    hi = F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))
    v = F.col("value")
    w = j.groupBy(*keys).agg(F.min(F.when(v >= lo, v)).alias("whisker_low"),
                             F.max(F.when(v <= hi, v)).alias("whisker_high"),
                             F.sum(F.when((v < lo) | (v > hi), F.col("n_value")).otherwise(0)).alias("n_outliers"))
    return q.join(w, keys, "inner")


def mean_std_summary(results: DataFrame, metrics=("NSE", "KGE", "MAE", "RMSE", "LogNSE", "RMSE_dry"),
                     keys=("model", "horizon", "period")) -> DataFrame:
    """Mean ± sample std per model × horizon × period."""
    aggs = [F.count(F.lit(1)).alias("n_runs")]
    for m in metrics:
        aggs += [F.avg(m).alias(f"{m}_mean"), F.stddev_samp(m).alias(f"{m}_std")]
    return results.groupBy(*keys).agg(*aggs)
