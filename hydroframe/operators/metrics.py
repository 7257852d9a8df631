"""Forecast scores by group (A5 A6 A7), persistence baseline (M2) and truth/prediction pairing.

All metrics are one ``groupBy(keys).agg(...)`` (partial aggregation before the shuffle, so a
hot group costs one row per task, never a collected list).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hydroframe.functions.scalar import log_clipped
from hydroframe.operators.quantile import exact_quantiles
from hydroframe.operators.scan import blocked_scan, halo

EPS = 1e-8  # Fixed value: guard added to the KGE ratios and the sMAPE denominator.


def _corr(t: Column, p: Column) -> Column:
    """Pearson correlation that is null (not an error) for a constant series."""
    return F.try_divide(F.covar_pop(t, p), F.stddev_pop(t) * F.stddev_pop(p))


def hydro_metrics(df: DataFrame, keys: list[str], y_true: str = "y_true", y_pred: str = "y_pred") -> DataFrame:
    """A5: MAE, RMSE, R2 = NSE, KGE, sMAPE per group.

    NSE = 1 - SSres/SStot (0 when SStot = 0); KGE from correlation (0 when n ≤ 1, null for a
    constant series), std ratio and mean ratio (each denominator + 1e-8); sMAPE × 100.
    """
    t, p = F.col(y_true).cast("double"), F.col(y_pred).cast("double")
    d = df.select(*keys, t.alias("_t"), p.alias("_p"))
    t, p = F.col("_t"), F.col("_p")
    g = d.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), F.avg(F.abs(t - p)).alias("MAE"),
        F.sqrt(F.avg((t - p) * (t - p))).alias("RMSE"), F.sum((t - p) * (t - p)).alias("_ssr"),
        (F.var_pop(t) * F.count(F.lit(1))).alias("_sst"), _corr(t, p).alias("_corr"),
        F.stddev_pop(t).alias("_sdt"), F.stddev_pop(p).alias("_sdp"), F.avg(t).alias("_mt"), F.avg(p).alias("_mp"),
        (F.avg(F.lit(2.0) * F.abs(p - t) / (F.abs(t) + F.abs(p) + F.lit(EPS))) * 100.0).alias("sMAPE"))
    nse = F.when(F.col("_sst") > 0, F.lit(1.0) - F.col("_ssr") / F.col("_sst")).otherwise(F.lit(0.0))
    corr = F.when(F.col("_n") > 1, F.col("_corr")).otherwise(F.lit(0.0))
    alpha = F.col("_sdp") / (F.col("_sdt") + F.lit(EPS))
    beta = F.col("_mp") / (F.col("_mt") + F.lit(EPS))
    kge = F.lit(1.0) - F.sqrt((corr - 1) * (corr - 1) + (alpha - 1) * (alpha - 1) + (beta - 1) * (beta - 1))
    return g.select(*keys, "MAE", "RMSE", nse.alias("R2"), nse.alias("NSE"), kge.alias("KGE"), "sMAPE")


def low_flow_reference(df: DataFrame, keys: list[str], y: str = "y_true", q: float = 0.10,
                       exact: bool = True) -> DataFrame:
    """Per group exact linear quantile (default 10 %: the flow exceeded 90 % of the time), whose work is
    spread over ranges of values; ``exact=False`` uses ``percentile_approx``. A group without values has no row
    if exact, else a null."""
    if exact:
        return exact_quantiles(df, keys, y, [q], ["Q90_reference"])
    return df.groupBy(*keys).agg(F.percentile_approx(y, q, 100000).cast("double").alias("Q90_reference"))


def low_flow_metrics(df: DataFrame, keys: list[str], y_true: str = "y_true", y_pred: str = "y_pred",
                     q90: str = "Q90_reference") -> DataFrame:
    """LogNSE on ``ln(max(y, 1e-6))``; RMSE over rows with ``y_true ≤ Q90_reference`` only
    (null and 0 samples when none). ``q90`` is a column of ``df`` (join A7 first)."""
    t, p = F.col(y_true).cast("double"), F.col(y_pred).cast("double")
    lt, lp = log_clipped(t), log_clipped(p)
    dry = t <= F.col(q90)
    g = df.groupBy(*keys).agg(
        F.first(q90).alias("Q90_reference"), F.sum((lt - lp) * (lt - lp)).alias("_ssr"),
        (F.var_pop(lt) * F.count(F.lit(1))).alias("_sst"),
        F.sqrt(F.avg(F.when(dry, (t - p) * (t - p)))).alias("RMSE_dry"),
        F.count_if(dry).alias("n_dry_samples"))
    lognse = F.when(F.col("_sst") > 0, F.lit(1.0) - F.col("_ssr") / F.col("_sst")).otherwise(F.lit(0.0))
    return g.select(*keys, "Q90_reference", lognse.alias("LogNSE"), "RMSE_dry", "n_dry_samples")


def pair_truth_prediction(truth: DataFrame, pred: DataFrame, keys: list[str]) -> DataFrame:
    """Pair by key (station, issue date, step …), inner — never by position."""
    return truth.join(pred, keys, "inner")


def persistence_forecasts(daily: DataFrame, horizons: list[int], key: str = "station_id", date_col: str = "date",
                          y: str = "streamflow_m3s", block_rows: int = 4096) -> DataFrame:
    """M2: prediction for row t is the value H rows earlier (same station), for all horizons H in one pass: a row per
    row and horizon that has such a value, with ``horizon``.

    Rows go to position blocks with the largest horizon's rows before them copied in, and ``lag`` looks back within
    the block: no self-join, and no window spans a station.
    """
    reach = max(horizons)
    s = halo(blocked_scan(daily.select(key, date_col, y), [key], date_col, pos="_pos"), "_pos", reach, 0, max(block_rows, reach))
    w = Window.partitionBy(key, "_pb").orderBy("_pos")
    past = [F.struct(F.lit(h).alias("horizon"), F.lag("_pos", h).over(w).alias("p"), F.lag(date_col, h).over(w).alias("issue_date"),
                     F.lag(y, h).over(w).alias("y_pred")) for h in horizons]
    d = s.select(key, "_own", F.col(date_col).alias("target_date"), F.col(y).alias("y_true"), F.array(*past).alias("_past"))
    d = d.filter("_own").select(key, "target_date", "y_true", F.explode("_past").alias("f")).filter("f.p IS NOT NULL")
    return d.select(key, "f.horizon", "f.issue_date", "target_date", "y_true", "f.y_pred")


def persistence_forecast(daily: DataFrame, horizon: int, key: str = "station_id", date_col: str = "date",
                         y: str = "streamflow_m3s") -> DataFrame:
    """M2 for one horizon."""
    return persistence_forecasts(daily, [horizon], key, date_col, y).drop("horizon")


# ---- bootstrap intervals (documented extra) ---------------------------------------------

def poisson1_thresholds() -> list[float]:
    """Cumulative Poisson(1) probabilities P(K ≤ k), k = 0, 1, … (rule: e^-1 Σ 1/i!), to the end of
    double precision: the next term would not change the sum."""
    import math
    out, term, acc = [], math.exp(-1.0), 0.0
    while acc + term > acc:
        acc += term
        out.append(acc)
        term /= len(out)
    return out


def replicate_weight(block: Column, replicate: Column, seed: int) -> Column:
    """Poisson(1) weight of a block in a replicate, from 48 bits of md5 over seed, block and replicate:
    weights of two replicates, and of two blocks, are independent."""
    text = F.concat_ws(":", F.lit(str(seed)), block.cast("string"), replicate.cast("string"))
    return poisson1_weight(F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double") / F.lit(float(16 ** 12)))


def poisson1_weight(u: Column) -> Column:
    """Inverse CDF of Poisson(1) for a uniform ``u`` in [0, 1)."""
    th = poisson1_thresholds()
    expr = F.when(u < F.lit(th[0]), F.lit(0))
    for k, t in enumerate(th[1:], start=1):
        expr = expr.when(u < F.lit(t), F.lit(k))
    return expr.otherwise(F.lit(len(th)))


def _replicates(blocks: DataFrame, keys: list[str], sums: list[str], replicates: int, seed: int) -> DataFrame:
    """Per group and replicate the weighted sums over blocks: one row per block is repeated, not the data."""
    e = blocks.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    e = e.withColumn("_w", replicate_weight(F.col("_block"), F.col("replicate"), seed).cast("double"))
    return e.groupBy(*keys, "replicate").agg(*[F.sum(F.col("_w") * F.col(c)).alias(c) for c in sums])


def bootstrap_nse_difference(df: DataFrame, keys: list[str], block: str, y_true: str, pred_a: str, pred_b: str,
                             replicates: int = 1000, seed: int = 0,
                             quantiles=(0.025, 0.5, 0.975)) -> DataFrame:
    """Documented extra: block bootstrap interval of NSE(a) − NSE(b) per group, Poisson(1) weights.

    Rows of one ``block`` value (a station-month, a run of orders) are drawn together, which keeps
    their autocorrelation. Each block is summed up to one row of sufficient statistics; blocks, not
    rows, are repeated per replicate, and their weighted sums are partial aggregates.
    """
    t, a, b = (F.col(c).cast("double") for c in (y_true, pred_a, pred_b))
    blocks = df.groupBy(*keys, F.col(block).alias("_block")).agg(
        F.count(F.lit(1)).cast("double").alias("sw"), F.sum(t).alias("swt"), F.sum(t * t).alias("swt2"),
        F.sum((t - a) * (t - a)).alias("sa"), F.sum((t - b) * (t - b)).alias("sb"))
    g = _replicates(blocks, keys, ["sw", "swt", "swt2", "sa", "sb"], replicates, seed)
    sst = F.col("swt2") - F.col("swt") * F.col("swt") / F.col("sw")
    nse_a = F.when(sst > 0, F.lit(1.0) - F.col("sa") / sst).otherwise(F.lit(0.0))
    nse_b = F.when(sst > 0, F.lit(1.0) - F.col("sb") / sst).otherwise(F.lit(0.0))
    diffs = g.select(*keys, (nse_a - nse_b).alias("diff"))
    q = diffs.groupBy(*keys).agg(F.percentile("diff", list(quantiles)).alias("_q"), F.count(F.lit(1)).alias("replicates"))
    return q.select(*keys, "replicates", *[F.col("_q")[i].alias(f"q{int(round(p * 1000)):03d}")
                                          for i, p in enumerate(quantiles)])


def bootstrap_metric_differences(df: DataFrame, keys: list[str], block: str, y_true: str, pred_a: str,
                                 pred_b: str, replicates: int = 1000, seed: int = 0,
                                 quantiles=(0.025, 0.5, 0.975), eps_log: float = 1e-6) -> DataFrame:
    """Documented extra: bootstrap intervals of the differences (a − b) in NSE, KGE and LogNSE per
    group, one output row per group and metric. Same blocks and Poisson(1) replicate weights as
    ``bootstrap_nse_difference``; every metric comes from weighted sufficient statistics (sums of
    w, w·y, w·y², w·y·ŷ, … per block, then per group and replicate). KGE uses weighted population moments; correlation is 0 when the weight sum is ≤ 1 and
    null for a constant series, as in A5."""
    cols = {"t": F.col(y_true).cast("double"), "a": F.col(pred_a).cast("double"), "b": F.col(pred_b).cast("double")}
    d = df.select(*keys, F.col(block).alias("_block"), *[c.alias(f"_{n}") for n, c in cols.items()])
    for n in ("t", "a", "b"):
        d = d.withColumn(f"_l{n}", log_clipped(F.col(f"_{n}"), eps_log))

    def s(*names):  # sum of a product of columns
        e = F.lit(1.0)
        for n in names:
            e = e * F.col(n)
        return F.sum(e)
    aggs = [s().alias("sw")]
    for pre in ("", "l"):  # raw and log space
        t = f"_{pre}t"
        aggs += [s(t).alias(f"{pre}st"), s(t, t).alias(f"{pre}stt")]
        for m in ("a", "b"):
            p = f"_{pre}{m}"
            aggs += [F.sum((F.col(t) - F.col(p)) * (F.col(t) - F.col(p))).alias(f"{pre}r{m}")]
            if pre == "":
                aggs += [s(p).alias(f"s{m}"), s(p, p).alias(f"s{m}{m}"), s(t, p).alias(f"st{m}")]
    blocks = d.groupBy(*keys, "_block").agg(*aggs)
    g = _replicates(blocks, keys, [c for c in blocks.columns if c not in (*keys, "_block")], replicates, seed)
    sw = F.col("sw")

    def nse(pre, m):
        sst = F.col(f"{pre}stt") - F.col(f"{pre}st") * F.col(f"{pre}st") / sw
        return F.when(sst > 0, F.lit(1.0) - F.col(f"{pre}r{m}") / sst).otherwise(F.lit(0.0))

    def kge(m):
        mt, mp = F.col("st") / sw, F.col(f"s{m}") / sw
        vt = F.col("stt") / sw - mt * mt
        vp = F.col(f"s{m}{m}") / sw - mp * mp
        cov = F.col(f"st{m}") / sw - mt * mp
        corr = F.when(sw > 1, F.try_divide(cov, F.sqrt(vt * vp))).otherwise(F.lit(0.0))
        alpha = F.sqrt(vp) / (F.sqrt(vt) + F.lit(EPS))
        beta = mp / (mt + F.lit(EPS))
        return F.lit(1.0) - F.sqrt((corr - 1) * (corr - 1) + (alpha - 1) * (alpha - 1) + (beta - 1) * (beta - 1))
    diffs = g.select(*keys, F.explode(F.array(
        F.struct(F.lit("NSE").alias("metric"), (nse("", "a") - nse("", "b")).alias("diff")),
        F.struct(F.lit("KGE").alias("metric"), (kge("a") - kge("b")).alias("diff")),
        F.struct(F.lit("LogNSE").alias("metric"), (nse("l", "a") - nse("l", "b")).alias("diff")))).alias("x"))
    diffs = diffs.select(*keys, "x.metric", "x.diff")
    q = diffs.groupBy(*keys, "metric").agg(F.percentile("diff", list(quantiles)).alias("_q"),
                                           F.count("diff").alias("replicates"))
    return q.select(*keys, "metric", "replicates", *[F.col("_q")[i].alias(f"q{int(round(p * 1000)):03d}")
                                                    for i, p in enumerate(quantiles)])
