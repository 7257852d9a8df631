"""Model windows and splits.

Sliding windows are built by **row position** per station. Positions come from a blocked
scan; rows are then grouped in position blocks of ``block_rows`` with a halo of the
neighbouring rows copied in, so each ``collect_list`` frame runs inside a bounded
(station, block) partition whatever the series length.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hydroframe.functions.scalar import log1p_clipped
from hydroframe.operators.prepare import RECOMMENDED_DYNAMIC_FEATURES, period_label
from hydroframe.operators.quantile import small
from hydroframe.operators.scan import blocked_scan, halo
from hydroframe.session import cut_lineage

KEY = "station_id"


# ---- A4 ----------------------------------------------------------------------------------

def fit_scale(df: DataFrame, columns: list[str]) -> dict[str, tuple[float, float]]:
    """Mean and population std of each column over all rows (a std of 0 or null counts as 1): one aggregate, two numbers a column."""
    got = df.agg(*(f(c).alias(f"{c}__{n}") for c in columns for n, f in (("mu", F.avg), ("sd", F.stddev_pop)))).first()
    return {c: (got[f"{c}__mu"], got[f"{c}__sd"] or 1.0) for c in columns}


def standardise(df: DataFrame, columns: list[str], by: list[str] | None = None, suffix: str = "",
                fit: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """A4: z-score with population std (std 0 → divide by 1).

    ``by=None`` fits on all rows (the reference's default, trap T1), or takes ``fit`` (``fit_scale``), which F2 needs again;
    ``by=['station_id']`` fits per station (group fit), whose fit joins the rows by station, broadcast if it is counted and small.
    """
    if not by:
        fit = fit or fit_scale(df, columns)
        return df.withColumns({c + suffix: (F.col(c) - F.lit(fit[c][0])) / F.lit(fit[c][1]) for c in columns})
    aggs, out = [], {}
    for c in columns:
        aggs += [F.avg(c).alias(f"{c}__mu"), F.stddev_pop(c).alias(f"{c}__sd")]
    st = small(cut_lineage(df.groupBy(*by).agg(*aggs)))
    d = df.join(st, by, "left")
    for c in columns:
        sd = F.when(F.col(f"{c}__sd") == 0, F.lit(1.0)).otherwise(F.col(f"{c}__sd"))
        out[c + suffix] = (F.col(c) - F.col(f"{c}__mu")) / sd
    return d.withColumns(out).drop(*[f"{c}__{s}" for c in columns for s in ("mu", "sd")])


def log_target(df: DataFrame, target: str = "streamflow_m3s", name: str = "target_log") -> DataFrame:
    """F1 applied: ``log1p(max(y, 0))``."""
    return df.withColumn(name, log1p_clipped(target))


# ---- halo blocks -------------------------------------------------------------------------

# ---- W6 ----------------------------------------------------------------------------------

@dataclass(frozen=True)
class DateSplit:
    """W9 limits: train pool [train_start, train_end], test [test_start, test_end], and the pool's share for validation."""
    train_start: str
    train_end: str
    test_start: str
    test_end: str | None = None
    val_fraction: float = 0.15

    def in_pool(self, d: Column) -> Column:
        return d.between(F.lit(self.train_start).cast("date"), F.lit(self.train_end).cast("date"))

    def in_test(self, d: Column) -> Column:
        after = d >= F.lit(self.test_start).cast("date")
        return after if self.test_end is None else after & (d <= F.lit(self.test_end).cast("date"))


def _label_by_date(s: DataFrame, split: DateSplit, d: Column, order_col: str, counts: Column) -> DataFrame:
    """``split``, ``n_pool`` and ``split_error`` of each row where ``counts`` holds (a window's target row), one blocked scan."""
    pool, test = counts & split.in_pool(d), counts & split.in_test(d)
    s = blocked_scan(s, [KEY], order_col, pos=None, flags={"_pool_rank": pool}, totals={"n_pool": pool, "_n_test": test})
    n_val = F.least(F.greatest(F.bround(F.col("n_pool") * split.val_fraction, 0).cast("long"), F.lit(1)),
                    F.col("n_pool") - 1)
    label = (F.when(pool & (F.col("_pool_rank") > F.col("n_pool") - n_val), F.lit("val"))
              .when(pool, F.lit("train")).when(test, F.lit("test")))
    err = (F.when(F.col("n_pool") < 20, F.lit("too few training windows"))
            .when(F.col("_n_test") == 0, F.lit("no test window")))
    return s.withColumn("split", label).withColumn("split_error", err).drop("_pool_rank", "_n_test")


def lookback_windows(df: DataFrame, lookback: int, horizon: int, features: list[str], target: str,
                     date_col: str = "date", block_rows: int = 4096, split: DateSplit | None = None) -> DataFrame:
    """For each row t with a full lookback, inputs = rows t-L+1..t (``target`` first, then
    ``features``; a struct per step so nulls are kept), target = ``target`` at row t+H
    (direct H-step). Per station N = n - L - H + 1. Output: station_id, window_end_date,
    target_date, inputs ARRAY<STRUCT>, target, target_raw (when ``target_raw`` is a column), and with
    ``split`` (W9, as ``chronological_split``) also split, n_pool and split_error.

    Labels are those of the target's row, found on the narrow rows; the target comes from H rows ahead within the
    block and its halo. So once arrays exist they are neither joined nor shuffled.
    """
    fields = [target, *[f for f in features if f != target]]
    raw = ["target_raw"] if "target_raw" in df.columns else []
    s = blocked_scan(df.select(*dict.fromkeys([KEY, date_col, *fields, *raw])), [KEY], date_col, pos="_pos")
    ahead = {"target_date": date_col, "target": target, **{c: c for c in raw}}
    if split is not None:
        s = _label_by_date(s, split, F.col(date_col), date_col, F.col("_pos") >= lookback + horizon - 1)
        ahead |= {c: c for c in ("split", "n_pool", "split_error")}
    h = halo(s, "_pos", lookback - 1, horizon, max(block_rows, lookback, horizon))
    base = Window.partitionBy(KEY, "_pb").orderBy("_pos")
    step = F.struct(F.col(date_col).alias("date"), *[F.col(f) for f in fields])
    win = h.select(KEY, F.col(date_col).alias("window_end_date"), "_pos", "_own",
                   F.lead("_pos", horizon).over(base).alias("_target_pos"),
                   *[F.lead(c, horizon).over(base).alias(f"_{name}") for name, c in ahead.items()],
                   F.collect_list(step).over(base.rowsBetween(-(lookback - 1), 0)).alias("inputs"))
    win = win.filter(F.col("_own") & (F.col("_pos") >= lookback - 1) & F.col("_target_pos").isNotNull())
    named = {name: F.col(f"_{name}").alias(name) for name in ahead}
    return win.select(KEY, "window_end_date", named.pop("target_date"), "inputs", *named.values())


# ---- W8 ----------------------------------------------------------------------------------

def encoder_decoder_windows(df: DataFrame, lookback: int, horizon: int, encoder_fields: list[str],
                            target: str, date_col: str = "date", index_col: str = "time_idx",
                            min_prediction_idx: int | Column | None = None, strict: bool = False,
                            block_rows: int = 4096, decoder_fields: list[str] = (), carry: list[str] = ()) -> DataFrame:
    """encoder = exactly L rows ending at t, decoder = exactly H rows t+1..t+H (all targets,
    trap T6), per station. ``strict`` keeps only windows contiguous in ``index_col``;
    ``min_prediction_idx`` bounds the first decoder index from below (validation/test keep
    earlier rows for the encoder). ``decoder_fields``: columns known ahead that decoder steps hold, too; ``carry``:
    columns of the last encoder row that come with the window, so that nothing is joined to arrays later."""
    cols = list(dict.fromkeys([KEY, date_col, index_col, target, *encoder_fields, *decoder_fields, *carry]))
    s = blocked_scan(df.select(*cols), [KEY], date_col, pos="_pos")
    h = halo(s, "_pos", lookback - 1, horizon, max(block_rows, lookback, horizon))
    base = Window.partitionBy(KEY, "_pb").orderBy("_pos")
    enc_w, dec_w = base.rowsBetween(-(lookback - 1), 0), base.rowsBetween(1, horizon)
    enc_step = F.struct(F.col(index_col).alias("idx"), F.col(date_col).alias("date"),
                        *[F.col(f) for f in dict.fromkeys([target, *encoder_fields])])
    dec_step = F.struct(F.col(index_col).alias("idx"), F.col(date_col).alias("date"), F.col(target).alias("target"),
                        *[F.col(f) for f in decoder_fields])
    w = h.select(KEY, "_pos", "_own", *carry, F.collect_list(enc_step).over(enc_w).alias("encoder"),
                 F.collect_list(dec_step).over(dec_w).alias("decoder"))
    w = w.filter(F.col("_own") & (F.size("encoder") == lookback) & (F.size("decoder") == horizon))
    first_dec = F.col("decoder")[0]["idx"]
    if strict:
        w = w.filter(F.col("decoder")[horizon - 1]["idx"] - F.col("encoder")[0]["idx"] == lookback + horizon - 1)
    if min_prediction_idx is not None:
        lim = F.lit(min_prediction_idx) if isinstance(min_prediction_idx, int) else min_prediction_idx
        w = w.filter(first_dec >= lim)
    return w.select(KEY, F.col("decoder")[0]["date"].alias("decoder_start_date"), first_dec.alias("decoder_start_idx"),
                    "encoder", "decoder", *carry)


# ---- W9, A10 -----------------------------------------------------------------------------

def chronological_split(windows: DataFrame, train_start: str, train_end: str, test_start: str,
                        test_end: str | None = None, val_fraction: float = 0.15,
                        date_col: str = "target_date") -> DataFrame:
    """Label each window by its **target** date: the train pool is
    [train_start, train_end]; validation = the last ``round(f·n)`` pool windows per station
    (half-even, at least 1, at most n-1); test = [test_start, test_end]. Adds ``split`` and
    ``n_pool``; a station with fewer than 20 pool windows or no test window gets
    ``split_error`` set (the reference raises)."""
    split = DateSplit(train_start, train_end, test_start, test_end, val_fraction)
    return _label_by_date(windows, split, F.col(date_col), date_col, F.lit(True))


def positional_split(windows: DataFrame, date_col: str = "target_date") -> DataFrame:
    """W9 fallback: first 70 % train, next 15 % val, rest test, by position per station."""
    s = blocked_scan(windows, [KEY], date_col, pos="_p", totals={"_n": F.lit(True)})
    split = (F.when(F.col("_p") < F.floor(F.col("_n") * 0.7), F.lit("train"))
              .when(F.col("_p") < F.floor(F.col("_n") * 0.85), F.lit("val")).otherwise(F.lit("test")))
    return s.withColumn("split", split).drop("_p", "_n")


def first_index_at_or_after(df: DataFrame, date: str, index_col: str = "time_idx",
                            date_col: str = "date") -> DataFrame:
    """A10: per station the first index at or after ``date`` (null = the reference's error)."""
    return df.groupBy(KEY).agg(F.min(F.when(F.col(date_col) >= F.lit(date).cast("date"),
                                            F.col(index_col))).alias("first_idx"))


# ---- W7, A9, A11 -------------------------------------------------------------------------

def monthly_window_grid(df: DataFrame, window_min_months: int = 1, window_max_months: int = 24,
                        target_periods=("Teste",), required_columns: list[str] | None = None,
                        require_complete_data: bool = True, date_col: str = "date") -> DataFrame:
    """For every target month (month whose first non-null period is a target period, A9)
    and every window length 1..24 months: row and missing-value counts of the input months and
    the target month, and candidate flags (trap T13). ``required_columns`` (default: the target and the
    recommended dynamic features; those present count) must have no null in a candidate.

    Not a theta join over days: days are first aggregated per (station, month); each target
    month × window × month-offset is an exploded row that equi-joins the month table.
    """
    if window_min_months < 1:
        raise ValueError("window_min_months must be >= 1")
    if window_max_months < window_min_months:
        raise ValueError("window_max_months must be >= window_min_months")
    wanted = ["streamflow_m3s", *RECOMMENDED_DYNAMIC_FEATURES] if required_columns is None else required_columns
    req = [c for c in wanted if c in df.columns]
    miss = sum((F.col(c).isNull().cast("long") for c in req), F.lit(0).cast("long"))
    ms = F.trunc(F.col(date_col), "MM")
    months = df.groupBy(KEY, ms.alias("month_start")).agg(
        F.count(F.lit(1)).alias("rows"), F.sum(miss).alias("missing"),
        F.min_by(F.col("period"), F.when(F.col("period").isNotNull(), F.col(date_col))).alias("period"))
    targets = months.filter(F.col("period").isin(list(target_periods)))
    grid = targets.select(KEY, F.col("month_start").alias("target_start_date"),
                          F.col("rows").alias("target_rows"), F.col("missing").alias("target_missing_values"),
                          F.explode(F.sequence(F.lit(window_min_months), F.lit(window_max_months)))
                          .alias("window_months"))
    offs = grid.select(KEY, "target_start_date", "window_months",
                       F.explode(F.sequence(F.lit(1), F.col("window_months"))).alias("_k"))
    offs = offs.withColumn("month_start", F.add_months("target_start_date", -F.col("_k")))
    inp = offs.join(months.select(KEY, "month_start", "rows", "missing"), [KEY, "month_start"], "left")
    inp = inp.groupBy(KEY, "target_start_date", "window_months").agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("input_rows"),
        F.count("rows").alias("input_month_count"),
        F.coalesce(F.sum("missing"), F.lit(0)).alias("input_missing_values"))
    g = grid.join(inp, [KEY, "target_start_date", "window_months"], "inner")
    full = F.col("input_month_count") == F.col("window_months")
    has_t = F.col("target_rows") > 0
    complete = (F.col("input_missing_values") == 0) & (F.col("target_missing_values") == 0)
    cand = full & has_t & complete if require_complete_data else full & has_t
    return g.select(
        KEY, F.date_format("target_start_date", "yyyy-MM").alias("target_month"), "window_months",
        F.add_months("target_start_date", -F.col("window_months")).alias("input_start_date"),
        F.date_sub("target_start_date", 1).alias("input_end_date"), "target_start_date",
        F.last_day("target_start_date").alias("target_end_date"), F.col("input_rows").cast("long"),
        F.col("target_rows").cast("long"), full.alias("has_full_input_months"), has_t.alias("has_target_month"),
        F.col("input_missing_values").cast("long"), F.col("target_missing_values").cast("long"),
        complete.alias("has_complete_data"), cand.alias("is_candidate"))


def candidate_summary(grid: DataFrame) -> DataFrame:
    """Per target month, number of candidate windows and their shortest/longest length."""
    return grid.filter("is_candidate").groupBy(KEY, "target_month").agg(
        F.count(F.lit(1)).alias("candidate_windows"), F.min("window_months").alias("min_window_months"),
        F.max("window_months").alias("max_window_months"))


def label_periods(df: DataFrame, periods, date_col: str = "date") -> DataFrame:
    return df.withColumn("period", period_label(F.col(date_col), periods))


def _split_limits(df: DataFrame, split: DateSplit | None, lookback: int, target: str, date_col: str,
                  index_col: str) -> DataFrame:
    """Per station what ``tft_datasets`` needs to label windows: where validation and test predictions begin
    (``val_start_idx``, ``test_start_idx``), the target's centre and scale over the training rows, ``split_error``, and without
    dates the index limits ``_train_end`` and ``_val_end``."""
    d, idx = F.col(date_col), F.col(index_col)
    s = df.select(KEY, date_col, index_col, target)
    at = lambda cond: F.max(F.when(cond, idx))
    if split is None:
        s = blocked_scan(s, [KEY], date_col, pos="_pos", totals={"_n": F.lit(True)})
        s = s.withColumns({f"_{name}_end": F.floor(F.lit(share) * F.col("_n")) for name, share in (("train", 0.70), ("val", 0.85))})
        train, val_at, test_at = idx < F.col("_train_end"), at(F.col("_pos") == F.col("_train_end")), at(F.col("_pos") == F.col("_val_end"))
        extra = [F.first("_train_end").alias("_train_end"), F.first("_val_end").alias("_val_end"), F.lit(None).cast("string").alias("split_error")]
    else:
        pool = split.in_pool(d)
        s = blocked_scan(s, [KEY], date_col, pos=None, flags={"_prank": pool}, totals={"n_pool": pool})
        row = F.least(F.greatest(F.bround((1.0 - split.val_fraction) * F.col("n_pool"), 0).cast("long"), F.lit(1)), F.col("n_pool") - 1)
        train, val_at = pool & (F.col("_prank") <= row), at(pool & (F.col("_prank") == row + 1))
        test_at = F.min(F.when(d >= F.lit(split.test_start).cast("date"), idx))
        extra = [F.when(F.first("n_pool") < lookback + 2, F.lit("training window too short for the lookback")).alias("split_error")]
    own = F.when(train, F.col(target))
    return s.groupBy(KEY).agg(val_at.alias("val_start_idx"), test_at.alias("test_start_idx"), F.avg(own).alias("target_center"),
                              F.stddev_samp(own).alias("target_scale"), *extra)


def tft_datasets(df: DataFrame, lookback: int, horizon: int, encoder_fields: list[str], target: str,
                 train_start: str | None = None, train_end: str | None = None, test_start: str | None = None,
                 test_end: str | None = None, val_fraction: float = 0.15, date_col: str = "date",
                 index_col: str = "time_idx", decoder_fields: list[str] = (), carry: list[str] = ()) -> DataFrame:
    """W8 + W9 (encoder/decoder form): label each encoder/decoder window ``train``, ``val`` or
    ``test`` as the multi-step builder does, per station:

    - train pool = rows dated in [train_start, train_end]; split row = ``round((1-f)·n)`` on
      **rows** (half-even, at least 1, at most n-1); ``val_start_idx`` = index of that row; a
      station with fewer than L+2 pool rows gets ``split_error``;
    - train windows lie wholly inside the pool rows before the split row;
    - validation windows end on or before ``train_end`` and predict from ``val_start_idx`` on
      (earlier rows may feed the encoder);
    - test windows end on or before ``test_end`` and predict from the first index at or after
      ``test_start`` (A10) on.

    Unless train_start, train_end and test_start are all given, rows are split by number: with n rows, train windows have
    indexes under ``int(0.70 n)``, validation windows under ``int(0.85 n)`` and predict from the index of row
    ``int(0.70 n)`` on, test windows predict from that of row ``int(0.85 n)`` on.

    Adds the per-station target centre and scale (mean, sample std of the target over the train
    rows; group normalisation), the encoder length and each step's relative index
    (``(idx - first decoder idx) / L``) of the encoder and the decoder. The limits join the daily rows, one row a station, before
    any array exists.
    """
    d = F.col(date_col)
    by_date = train_start is not None and train_end is not None and test_start is not None
    split = DateSplit(train_start, train_end, test_start, test_end, val_fraction) if by_date else None
    limits = cut_lineage(_split_limits(df, split, lookback, target, date_col, index_col))
    base = df if not by_date or test_end is None else df.filter(d <= F.lit(test_end).cast("date"))
    held = [c for c in limits.columns if c != KEY]
    w = encoder_decoder_windows(base.join(small(limits), KEY), lookback, horizon, encoder_fields, target, date_col, index_col,
                                decoder_fields=decoder_fields, carry=[*held, *carry])
    first_dec, dec_last = F.col("decoder_start_idx"), F.col("decoder")[horizon - 1]
    if by_date:
        in_pool = dec_last["date"] <= F.lit(train_end).cast("date")
        is_train = ((F.col("encoder")[0]["date"] >= F.lit(train_start).cast("date"))
                    & (dec_last["idx"] < F.col("val_start_idx")) & in_pool)
    else:
        in_pool, is_train = dec_last["idx"] < F.col("_val_end"), dec_last["idx"] < F.col("_train_end")
    is_val, is_test = in_pool & (first_dec >= F.col("val_start_idx")), first_dec >= F.col("test_start_idx")
    label = F.when(is_train, F.lit("train")).when(is_val, F.lit("val")).when(is_test, F.lit("test"))
    relative = lambda steps: F.transform(steps, lambda e: (e["idx"] - first_dec) / F.lit(float(lookback)))
    return (w.withColumn("dataset", label).filter(F.col("dataset").isNotNull()).drop("_train_end", "_val_end")
             .withColumn("encoder_length", F.size("encoder")).withColumn("relative_idx", relative("encoder"))
             .withColumn("decoder_relative_idx", relative("decoder")))


def model_inputs(df: DataFrame, lookback: int, horizon: int, target: str, known_reals: list[str], static_categoricals: list[str] = (),
                 static_reals: list[str] = (), index_col: str = "time_idx", **split) -> DataFrame:
    """W8 with feature roles (P12): the windows of ``tft_datasets`` as a multi-step model takes them.

    ``encoder_reals`` and ``decoder_reals``: an array of each step's known reals, the index first, its relative index
    last (``known_names`` says which); ``encoder_target`` and ``decoder_target``: the target, of which the model sees the
    first alone; ``static_categoricals`` (as text) and ``static_reals``: structs; ``target_scales``: centre and scale.
    """
    known = [c for c in known_reals if c != index_col and c in df.columns]
    w = tft_datasets(df, lookback, horizon, known, target, index_col=index_col, decoder_fields=known,
                     carry=[*static_categoricals, *static_reals], **split)

    def reals(steps: str, relative: str) -> Column:
        row = lambda e, r: F.array(e["idx"].cast("double"), *[e[c].cast("double") for c in known], r)
        return F.zip_with(steps, relative, row)

    def held(names: list[str], kind: str) -> Column:
        return F.struct(*[F.col(c).cast(kind).alias(c) for c in names]) if names else F.lit(None)

    return w.select(
        KEY, "dataset", "decoder_start_date", "decoder_start_idx", "encoder_length", F.size("decoder").alias("decoder_length"),
        F.array(*[F.lit(c) for c in (index_col, *known, "relative_time_idx")]).alias("known_names"),
        reals("encoder", "relative_idx").alias("encoder_reals"), reals("decoder", "decoder_relative_idx").alias("decoder_reals"),
        F.transform("encoder", lambda e: e[target]).alias("encoder_target"), F.transform("decoder", lambda e: e["target"]).alias("decoder_target"),
        held(static_categoricals, "string").alias("static_categoricals"), held(static_reals, "double").alias("static_reals"),
        F.array("target_center", "target_scale").alias("target_scales"), "split_error")


def expanding_window_folds(windows: DataFrame, cutoff_years: list[int], date_col: str = "target_date",
                           val_years: int = 1) -> DataFrame:
    """Documented extra (expanding-window validation): for each cut-off year c, windows whose target
    date is before c train the fold and windows in [c, c + val_years) validate it. One explode of the
    cut-off list per window (a generator, no join); windows outside a fold are dropped from it."""
    y = F.year(F.col(date_col))
    folds = windows.select("*", F.explode(F.array(*[F.lit(c) for c in cutoff_years])).alias("fold_cutoff"))
    role = (F.when(y < F.col("fold_cutoff"), F.lit("train"))
             .when(y < F.col("fold_cutoff") + val_years, F.lit("val")))
    return folds.withColumn("fold_role", role).filter(F.col("fold_role").isNotNull())
