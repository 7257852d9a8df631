"""Column-level helpers (F1-F15). Every function returns a Spark ``Column``; all run JVM-side."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

ColumnOrName = Column | str


def _c(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---- null / number hygiene ---------------------------------------------------------------

def nan_to_null(c: ColumnOrName) -> Column:
    """One null only: NaN becomes SQL NULL (NaN would win ``max`` and poison ``avg``)."""
    c = _c(c)
    return F.when(F.isnan(c), F.lit(None).cast("double")).otherwise(c)


def to_double(c: ColumnOrName) -> Column:
    """numeric coercion; unparsable text and 'nan' become null."""
    c = _c(c)
    return nan_to_null(F.trim(c.cast("string")).try_cast("double"))


def mask_sentinel(c: ColumnOrName, sentinel: float = -99.0) -> Column:
    """values at or below the sentinel become null."""
    c = _c(c)
    return F.when(c > F.lit(sentinel), c)


def is_close(a: ColumnOrName, b: ColumnOrName, rtol: float = 1e-5, atol: float = 1e-8) -> Column:
    """numpy ``isclose`` rule ``|a-b| <= atol + rtol*|b|``."""
    a, b = _c(a), _c(b)
    return F.abs(a - b) <= F.lit(atol) + F.lit(rtol) * F.abs(b)


def round4(c: ColumnOrName) -> Column:
    """half-even rounding to 4 places, done on the decimal value (first cut to 9 places, so the
    result does not depend on binary noise in the last bits)."""
    return F.bround(F.round(_c(c), 9).cast("decimal(38,9)"), 4).cast("double")


def normalise_text(c: ColumnOrName) -> Column:
    """``lower(trim(x))``."""
    return F.lower(F.trim(_c(c).cast("string")))


def get_or_default(m: ColumnOrName, key: str, default) -> Column:
    """``payload.get(key, default)`` for a map column."""
    return F.coalesce(F.try_element_at(_c(m), F.lit(key)), F.lit(default))


# ---- target transforms -------------------------------------------------------------------

def log1p_clipped(c: ColumnOrName) -> Column:
    """``log1p(max(y, 0))``; null stays null."""
    c = _c(c)
    return F.when(c.isNotNull(), F.log1p(F.greatest(c, F.lit(0.0))))


def inverse_target(z: ColumnOrName, mean: ColumnOrName, std: ColumnOrName) -> Column:
    """unscale, ``expm1``, clip at 0."""
    y = F.expm1(_c(z) * _c(std) + _c(mean))
    return F.when(y.isNotNull(), F.greatest(y, F.lit(0.0)))


def log_clipped(c: ColumnOrName, eps: float = 1e-6) -> Column:
    """``ln(max(y, eps))``."""
    c = _c(c)
    return F.when(c.isNotNull(), F.ln(F.greatest(c, F.lit(eps))))


# ---- dates -------------------------------------------------------------------------------

def month_start(d: ColumnOrName) -> Column:
    """first day of the month."""
    return F.trunc(_c(d), "MM")


def month_end(d: ColumnOrName) -> Column:
    """last day of the month."""
    return F.last_day(_c(d))


def months_back(d: ColumnOrName, n: ColumnOrName | int) -> Column:
    """``d - n months`` (calendar aware)."""
    n = F.lit(n) if isinstance(n, int) else _c(n)
    return F.add_months(_c(d), -n)


def day_before(d: ColumnOrName) -> Column:
    return F.date_sub(_c(d), 1)


def inclusive_days(start: ColumnOrName, end: ColumnOrName) -> Column:
    """``(end - start).days + 1``."""
    return F.datediff(_c(end), _c(start)) + 1


# ---- study names -------------------------------------------------------------------------

# Study name layout ``<model>_<period>_lb<lookback>[_h<horizon>]``.
STUDY_NAME_PATTERN = r"^(lstm|tft)_(passado|recente)_lb(\d+)(?:_h(\d+))?$"


def study_name(model: ColumnOrName, period: ColumnOrName, lookback: ColumnOrName,
               horizon: ColumnOrName | None = None) -> Column:
    """F8: build ``model_period_lbL[_hH]``."""
    base = F.format_string("%s_%s_lb%d", _c(model), _c(period), _c(lookback).cast("int"))
    if horizon is None:
        return base
    return F.format_string("%s_h%d", base, _c(horizon).cast("int"))


def parse_study_name(c: ColumnOrName) -> Column:
    """struct(model, period, lookback, horizon); null fields when the name does not match.

    A name without ``_hH`` has horizon 1 (the reader's fallback).
    """
    c = _c(c)
    ok = c.rlike(STUDY_NAME_PATTERN)
    hz = F.regexp_extract(c, STUDY_NAME_PATTERN, 4)
    return F.when(ok, F.struct(
        F.regexp_extract(c, STUDY_NAME_PATTERN, 1).alias("model"),
        F.regexp_extract(c, STUDY_NAME_PATTERN, 2).alias("period"),
        F.regexp_extract(c, STUDY_NAME_PATTERN, 3).cast("int").alias("lookback"),
        F.when(hz == "", F.lit(1)).otherwise(hz.cast("int")).alias("horizon"),
    ))


def name_matches(c: ColumnOrName, pattern: str) -> Column:
    """regex filter on a file or study name."""
    return _c(c).rlike(pattern)


# ---- series rescale ----------------------------------------------------------------------

def rescale_0_100(c: ColumnOrName, partition_cols: list[str]) -> Column:
    """min-max of a series to 0-100 per group; a flat series gives 0."""
    w = Window.partitionBy(*partition_cols)
    c = _c(c)
    lo, hi = F.min(c).over(w), F.max(c).over(w)
    return F.coalesce(F.try_divide((c - lo) * 100.0, hi - lo), F.lit(0.0))
