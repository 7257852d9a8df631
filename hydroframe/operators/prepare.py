"""Prepare: daily station frames → master / model-ready tables.

Covers J1 J2 J5 P1-P12 P15 W1 A3 A22 U1. Every function maps ``DataFrame → DataFrame``;
the key of every daily frame is ``(station_id, date)``.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hydroframe.functions.scalar import is_close, mask_sentinel
from hydroframe.operators.quantile import small
from hydroframe.operators.scan import blocked_scan, row_index
from hydroframe.session import cut_lineage

KEY = "station_id"

# Period labels and closed date ranges of the reference's protocol.
REFERENCE_PERIODS = (
    ("Passado", "1980-01-01", "1990-12-31"),
    ("Recente", "1991-01-01", "2010-12-31"),
    ("Teste", "2011-01-01", "2018-12-31"),
)
# Columns never interpolated or scaled.
EXCLUDED_NUMERIC = ("year", "month", "day", "time_idx")
# Preferred source column per variable.
PREFERRED_SOURCES = {
    "precipitation": "p_mswep",
    "temperature": "tmean_era5land",
    "actual_evapotransp": "aet_era5land",
    "streamflow_m3s": "streamflow_m3s",
}
# Default dynamic features of the curated table.
RECOMMENDED_DYNAMIC_FEATURES = (
    "p_mswep", "tmin_era5land", "tmean_era5land", "tmax_era5land", "aet_era5land",
    "oni", "month_sin", "month_cos",
)
RECOMMENDED_START_DATE = "1980-01-01"


def numeric_columns(df: DataFrame, exclude=EXCLUDED_NUMERIC) -> list[str]:
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, T.NumericType) and f.name not in exclude]


# ---- P1, P3, P4 ----------------------------------------------------------------------------

def build_date(df: DataFrame, strict: bool = True, drop_parts: bool = False) -> DataFrame:
    """Date from year/month/day. ``strict`` raises on an impossible date (ANSI
    ``make_date``); the lenient form gives null."""
    y, m, d = (F.col(c).cast("int") for c in ("year", "month", "day"))
    if strict:
        date = F.make_date(y, m, d)
    else:
        date = F.try_to_date(F.concat_ws("-", y, m, d), "y-M-d")
    out = df.withColumn("date", date)
    return out.drop("year", "month", "day") if drop_parts else out


def calendar_parts(df: DataFrame, date_col: str = "date") -> DataFrame:
    """Year, month, day, day_of_year."""
    d = F.col(date_col)
    return df.withColumns({"year": F.year(d), "month": F.month(d), "day": F.dayofmonth(d),
                           "day_of_year": F.dayofyear(d)})


def cyclic_encoding(df: DataFrame, origin: int = 1, date_col: str = "date") -> DataFrame:
    """P4 (trap T4). ``origin=0``: ``month_sin/cos`` of ``2π(month-1)/12``.
    ``origin=1``: ``sin/cos_month`` of ``2π·month/12`` and ``sin/cos_day`` of ``2π·doy/366``."""
    month = F.month(F.col(date_col))
    if origin == 0:
        a = F.lit(2 * math.pi) * (month - 1) / F.lit(12.0)
        return df.withColumns({"month_sin": F.sin(a), "month_cos": F.cos(a)})
    am = F.lit(2 * math.pi) * month / F.lit(12.0)
    ad = F.lit(2 * math.pi) * F.dayofyear(F.col(date_col)) / F.lit(366.0)
    return df.withColumns({"sin_day": F.sin(ad), "cos_day": F.cos(ad),
                           "sin_month": F.sin(am), "cos_month": F.cos(am)})


# ---- P2 ----------------------------------------------------------------------------------

def choose_sources(df: DataFrame, preferred: dict[str, str] | None = None) -> DataFrame:
    """Keep the preferred source column of each variable under the variable's name."""
    preferred = preferred or PREFERRED_SOURCES
    missing = [src for src in preferred.values() if src not in df.columns]
    if missing:
        raise ValueError(f"expected source columns not found: {missing}")
    keep = [c for c in df.columns if c not in preferred.values()]
    return df.select(*keep, *[F.col(src).alias(alias) for alias, src in preferred.items()])


# ---- P5 - P8, P15 -----------------------------------------------------------------------

def period_label(date: Column, periods=REFERENCE_PERIODS) -> Column:
    """P5: label by closed date ranges; null outside every range."""
    expr = None
    for label, start, end in periods:
        cond = date.between(F.lit(start).cast("date"), F.lit(end).cast("date"))
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr


def assign_period(df: DataFrame, periods=REFERENCE_PERIODS, date_col: str = "date") -> DataFrame:
    return df.withColumn("period", period_label(F.col(date_col), periods))


def keep_periods(df: DataFrame, periods=REFERENCE_PERIODS) -> DataFrame:
    """Drop dates outside the expected periods."""
    return df.filter(F.col("period").isin([p[0] for p in periods]))


def split_by_period(df: DataFrame, periods=REFERENCE_PERIODS) -> dict[str, DataFrame]:
    """One filtered view per period (on disk use ``partitionBy('period')``)."""
    return {p[0]: df.filter(F.col("period") == p[0]) for p in periods}


def complete_cases(df: DataFrame, subset: list[str] | None = None) -> DataFrame:
    """Drop rows with a null in ``subset`` (all columns when None). Trap T14."""
    return df.na.drop(how="any", subset=subset)


def date_range(df: DataFrame, start: str | None, end: str | None, date_col: str = "date") -> DataFrame:
    """Inclusive date filter (pushes down to Parquet row groups)."""
    d = F.col(date_col)
    if start is not None:
        df = df.filter(d >= F.lit(start).cast("date"))
    if end is not None:
        df = df.filter(d <= F.lit(end).cast("date"))
    return df


# ---- P9, P10 -----------------------------------------------------------------------------

def calendar_index(df: DataFrame, date_col: str = "date", name: str = "time_idx") -> DataFrame:
    """Days since the station's first kept date."""
    first = df.groupBy(KEY).agg(F.min(date_col).alias("_first"))
    return (df.join(first, KEY, "inner")
              .withColumn(name, F.datediff(F.col(date_col), F.col("_first")))
              .drop("_first"))


def row_position(df: DataFrame, date_col: str = "date", name: str = "time_idx") -> DataFrame:
    """P10: 0-based row number per station by date (blocked, skew-safe)."""
    return row_index(df, [KEY], date_col, name)


# ---- J1, J2, J5, U1 ----------------------------------------------------------------------

def outer_join_variables(frames: list[DataFrame]) -> DataFrame:
    """N-way full outer join on (station_id, date): union of dates, one row per date.

    Expressed as a union of the frames (each padded to all value columns) and one grouped
    ``first(ignorenulls)``, so the N-way join costs a single shuffle on the key whatever N is.
    Each input frame must be unique on (station_id, date).
    """
    types = {}
    for f in frames:
        for fld in f.schema.fields:
            if fld.name not in (KEY, "date"):
                types.setdefault(fld.name, fld.dataType)
    cols = list(types)
    padded = [f.select(KEY, "date", *[(F.col(c) if c in f.columns else F.lit(None)).cast(types[c]).alias(c)
                                      for c in cols]) for f in frames]
    union = reduce(lambda a, b: a.unionByName(b), padded)
    return union.groupBy(KEY, "date").agg(*[F.first(c, True).alias(c) for c in cols])


def monthly_index_long(wide: DataFrame, value_name: str = "oni", sentinel: float = -99.0) -> DataFrame:
    """U1 + F12: wide (year + one column per month, names ending in the 2-digit month) → long
    (year, month, value); values ≤ sentinel → null; years outside 1900-2100 dropped."""
    months = [c for c in wide.columns if c != "year"]
    long = wide.unpivot(["year"], months, "month_name", value_name)
    return (long.withColumn("year", F.col("year").cast("int"))
                .filter(F.col("year").between(1900, 2100))
                .select("year", F.substring("month_name", -2, 2).cast("int").alias("month"),
                        mask_sentinel(F.col(value_name).cast("double"), sentinel).alias(value_name)))


def monthly_lags(monthly: DataFrame, value: str = "oni", lags=(-3, -2, -1, 1, 2, 3)) -> DataFrame:
    """Documented extra: the monthly index shifted by ±k months (``<value>_lag<k>``, negative k =
    months ahead). Month index = 12·year + month; each shift is an equi-join on the shifted index
    of the (12 rows per year) monthly table, not a window over one partition."""
    idx = F.col("year") * 12 + F.col("month") - 1
    base = monthly.select("year", "month", value, idx.alias("_i"))
    out = base
    for k in lags:
        name = f"{value}_lag{k}" if k > 0 else f"{value}_lead{-k}"
        shifted = base.select((F.col("_i") + k).alias("_i"), F.col(value).alias(name))
        out = out.join(F.broadcast(shifted), "_i", "left")
    return out.drop("_i")


def attach_monthly(df: DataFrame, monthly: DataFrame, date_col: str = "date") -> DataFrame:
    """Daily × monthly left join on (year, month); the monthly table is tiny
    (12 rows per year, bounded by the calendar), so it is broadcast."""
    d = df
    drop = []
    if "year" not in d.columns:
        d = d.withColumn("year", F.year(date_col)); drop.append("year")
    if "month" not in d.columns:
        d = d.withColumn("month", F.month(date_col)); drop.append("month")
    out = d.join(F.broadcast(monthly), ["year", "month"], "left")
    return out.drop(*drop)


def first_row_per_station(static: DataFrame, order_col: str | None = None) -> DataFrame:
    """J5 helper: one row per station, the first by ``order_col``, or else the least by all columns, so that the
    result is the same on every run. One partial aggregate, no window per station."""
    others = [c for c in static.columns if c != KEY]
    order = F.struct(*([order_col] if order_col else []), *others) if others else F.lit(0)
    kept = static.groupBy(KEY).agg(F.min_by(F.struct(*static.columns), order).alias("_row"))
    return kept.select("_row.*")


def attach_static(df: DataFrame, static: DataFrame, prefix: str | None = None,
                  broadcast_max_cells: int = 5_000_000) -> DataFrame:
    """Attach constant per-station attributes to every day (left join).

    The attribute table has one row per station. It is broadcast only when its measured size
    (rows × columns, counted at plan time) is under ``broadcast_max_cells`` (a few tens of MB);
    otherwise it is a shuffled join on the station.
    """
    s = first_row_per_station(static)
    if prefix:
        s = s.select(KEY, *[F.col(c).alias(f"{prefix}{c}") for c in s.columns if c != KEY])
    small = broadcast_max_cells > 0 and s.count() * len(s.columns) <= broadcast_max_cells
    return df.join(F.broadcast(s) if small else s, KEY, "left")


# ---- W1 ----------------------------------------------------------------------------------

def fill_short_gaps(df: DataFrame, columns: list[str] | None = None, limit: int = 3,
                    mode: str = "inside", date_col: str = "date", keep_position: str | None = None) -> DataFrame:
    """Linear gap fill **by row position** per station (traps T2, T3, T16).

    ``mode='inside'`` (limit 3 preset): a null between two known rows is filled when it is
    within ``limit`` rows of either neighbour; leading/trailing nulls stay.
    ``mode='forward'`` (limit 5 preset): the first ``limit`` nulls after a known row are
    filled — linearly when a later known row exists, else with the last known value;
    leading nulls stay.
    Blocked scans carry the neighbours across (station, year) blocks. ``keep_position`` names a
    column that keeps the 0-based row position computed on the way (P10 for free).
    """
    if mode not in ("inside", "forward"):
        raise ValueError("mode must be 'inside' or 'forward'")
    columns = numeric_columns(df) if columns is None else columns
    columns = [c for c in columns if c in df.columns]
    if not columns:
        return df
    pos = keep_position or "_fill_pos"
    d = blocked_scan(df, [KEY], date_col, pos=pos, fill_cols=columns)
    p = F.col(pos)
    out = {}
    for c in columns:
        pv, pp, nv, np_ = (F.col(f"{c}__{s}") for s in ("pv", "pp", "nv", "np"))
        linear = pv + (nv - pv) * (p - pp) / (np_ - pp)
        if mode == "inside":
            ok = pp.isNotNull() & np_.isNotNull() & (((p - pp) <= limit) | ((np_ - p) <= limit))
            filled = F.when(ok, linear)
        else:
            ok = pp.isNotNull() & ((p - pp) <= limit)
            filled = F.when(ok & np_.isNotNull(), linear).when(ok, pv)
        out[c] = F.when(F.col(c).isNull(), filled.cast(df.schema[c].dataType)).otherwise(F.col(c))
    d = d.withColumns(out)
    helper = [f"{c}__{s}" for c in columns for s in ("pv", "pp", "nv", "np")]
    return d.drop(*helper) if keep_position else d.drop(*helper, pos)


# ---- A3, A22 -----------------------------------------------------------------------------

def _fit_wide(df: DataFrame, columns: list[str], fit_periods) -> DataFrame:
    fit = F.col("period").isin(list(fit_periods))
    aggs = []
    for c in columns:
        aggs += [F.min(F.when(fit, F.col(c))).cast("double").alias(f"{c}__min"),
                 F.max(F.when(fit, F.col(c))).cast("double").alias(f"{c}__max")]
    return df.groupBy(KEY).agg(*aggs)


def fit_min_max(df: DataFrame, columns: list[str] | None = None,
                fit_periods=("Passado", "Recente")) -> DataFrame:
    """A3 fit: long metadata (station_id, column, min, max) over the fit periods, nulls skipped;
    columns with no fit value are absent."""
    columns = numeric_columns(df) if columns is None else columns
    wide = _fit_wide(df, columns, fit_periods)
    stack = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"{c}__min").alias("min"),
                                         F.col(f"{c}__max").alias("max")) for c in columns]))
    return wide.select(KEY, stack.alias("s")).select(KEY, "s.*").filter(F.col("min").isNotNull())


def _apply_wide(df: DataFrame, wide: DataFrame, columns: list[str]) -> DataFrame:
    d = df.join(wide, KEY, "left")
    out = {}
    for c in columns:
        lo, hi = F.col(f"{c}__min"), F.col(f"{c}__max")
        x = F.col(c)
        out[c] = (F.when(lo.isNull(), x.cast("double"))
                   .when(is_close(lo, hi), F.when(x.isNotNull(), F.lit(0.0)))
                   .otherwise((x - lo) / (hi - lo)))
    return d.withColumns(out).drop(*[f"{c}__{s}" for c in columns for s in ("min", "max")])


def apply_min_max(df: DataFrame, meta: DataFrame, columns: list[str]) -> DataFrame:
    """A3 apply from the long metadata: ``(x-min)/(max-min)``; ``isclose(min,max)`` → 0.0 (null
    stays null); no fit value → unchanged."""
    aggs = []
    for c in columns:
        sel = F.col("column") == c
        aggs += [F.max(F.when(sel, F.col("min"))).alias(f"{c}__min"), F.max(F.when(sel, F.col("max"))).alias(f"{c}__max")]
    return _apply_wide(df, meta.groupBy(KEY).agg(*aggs), columns)


def min_max_scale(df: DataFrame, columns: list[str] | None = None, fit_periods=("Passado", "Recente")):
    """A3: returns (scaled frame, long metadata frame); the scale itself uses the one-row-per-station
    fit directly (one aggregate, one join)."""
    columns = numeric_columns(df) if columns is None else columns
    wide = _fit_wide(df, columns, fit_periods)
    return _apply_wide(df, wide, columns), fit_min_max(df, columns, fit_periods)


def period_counts(df: DataFrame) -> DataFrame:
    """Rows per station and period, null period counted."""
    return df.groupBy(KEY, "period").agg(F.count(F.lit(1)).alias("n_rows"))


# ---- P11, P12 ----------------------------------------------------------------------------

def training_ready(df: DataFrame, target: str = "streamflow_m3s", features=RECOMMENDED_DYNAMIC_FEATURES,
                   start_date: str | None = None, floor_date: str = RECOMMENDED_START_DATE) -> DataFrame:
    """Per station start = max(floor, first date with target) unless given; fixed column
    order of existing columns; complete cases on target + existing features."""
    static_cols = [c for c in df.columns if c.startswith("static_")]
    base = [KEY, "date", "period", "time_idx", "year", "month", "day", target, *features, *static_cols]
    selected = [c for c in dict.fromkeys(base) if c in df.columns]
    if start_date is not None:
        cur = df.filter(F.col("date") >= F.lit(start_date).cast("date"))
    else:
        starts = df.groupBy(KEY).agg(F.min(F.when(F.col(target).isNotNull(), F.col("date"))).alias("_s"))
        starts = starts.select(KEY, F.coalesce(F.greatest(F.col("_s"), F.lit(floor_date).cast("date")),
                                              F.lit(floor_date).cast("date")).alias("_start"))
        cur = df.join(small(cut_lineage(starts)), KEY, "inner").filter(F.col("date") >= F.col("_start"))
    required = [target, *[c for c in features if c in df.columns]]
    return cur.select(*selected).na.drop(subset=required)


def feature_roles(df: DataFrame, known=("time_idx", "oni", "month_sin", "month_cos"),
                  exclude=("time_idx", "year", "month", "day", "qual_control_by_ana", "qual_flag")) -> dict[str, list[str]]:
    """Driver-side role lists from the schema (no data read)."""
    fields = {f.name: f.dataType for f in df.schema.fields}
    static = [c for c in fields if c.startswith("static_")]
    static_cat = sorted(c for c in static if isinstance(fields[c], T.StringType))
    static_real = sorted(c for c in static if isinstance(fields[c], T.NumericType))
    known_reals = [c for c in [*known, *static_real] if c in fields]
    unknown = [c for c, t in fields.items() if isinstance(t, T.NumericType)
               and c not in set(exclude) | set(known) | set(static_real)]
    return {"static_categoricals": static_cat, "static_reals": static_real,
            "time_varying_known_reals": known_reals, "time_varying_unknown_reals": unknown}


def write_training_splits(df: DataFrame, path: str, periods=REFERENCE_PERIODS, **ready) -> DataFrame:
    """P11 + P7 + S10: the curated training rows (``training_ready``; ``ready`` are its arguments), labelled by period and written in one
    pass, a folder a period; periods that ``df`` has no rows of keep what they held (dynamic partition overwrite), rows outside all
    periods go. Returns the written table; ``split_by_period`` of it reads a period's folder alone.
    """
    d = keep_periods(assign_period(training_ready(df, **ready), periods), periods)
    d.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("period").parquet(path)
    return df.sparkSession.read.schema(d.schema).parquet(path)


def split_metadata(splits: DataFrame, target: str = "streamflow_m3s") -> DataFrame:
    """Per station and period of a written split: rows, first and last date, mean target; one aggregate."""
    return splits.groupBy(KEY, "period").agg(F.count(F.lit(1)).alias("n_rows"), F.min("date").alias("first_date"),
                                             F.max("date").alias("last_date"), F.avg(target).alias("mean_target"))
