"""Feature-importance and attention summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hydroframe.functions.scalar import nan_to_null

# Importance file-name rule and the two periods it carries.
IMPORTANCE_FILE_PATTERN = r"^tft_(passado|recente)_lb\d+_h\d+_tft_feature_importance\.json$"
IMPORTANCE_PERIODS = ("passado", "recente")
INDEX_VARIABLE = "oni"  # Fixed value: always shown in the top-variable list.


def importance_rows(df: DataFrame, source_col: str = "source", map_col: str = "feature_importance") -> DataFrame:
    """Keep sources whose name matches the rule, period from the name, one row per
    (source, feature) with a double score."""
    d = df.filter(F.col(source_col).rlike(IMPORTANCE_FILE_PATTERN))
    d = d.withColumn("period", F.regexp_extract(source_col, IMPORTANCE_FILE_PATTERN, 1))
    e = d.select("period", F.col(source_col).alias("source"), F.explode(map_col).alias("feature", "score"))
    return e.select("period", F.col("feature").cast("string"), F.col("score").cast("double"), "source")


def mean_importance_pivot(rows: DataFrame, periods=IMPORTANCE_PERIODS) -> DataFrame:
    """A16 + U2: mean score per feature × period, pivoted with explicit period values (both
    always present, missing → 0), ``overall`` = mean of the period columns."""
    p = rows.groupBy("feature").pivot("period", list(periods)).agg(F.avg("score")).na.fill(0.0, list(periods))
    overall = sum((F.col(c) for c in periods), F.lit(0.0)) / F.lit(float(len(periods)))
    return p.withColumn("overall", overall)


def top_k_features(pivot: DataFrame, k: int) -> DataFrame:
    """K7: top k by overall (k at least 1); returned in ascending order as charted."""
    top = pivot.orderBy(F.col("overall").desc(), F.col("feature")).limit(max(1, k))
    return top.orderBy("overall")


def distinct_sources(rows: DataFrame) -> DataFrame:
    """Number of distinct source files per period."""
    return rows.groupBy("period").agg(F.count_distinct("source").alias("n_sources"))


def to_percent(df: DataFrame, keys: list[str], score: str = "score", name: str = "percent") -> DataFrame:
    """Score / total × 100 per group; nulls ignored in the total; total ≤ 0 → 0.
    The total is an aggregate joined back (map-side combined), not a window over the group."""
    tot = df.groupBy(*keys).agg(F.sum(nan_to_null(F.col(score))).alias("_tot"))
    j = df.join(tot, keys, "inner")
    pct = F.when(F.col("_tot") > 0, F.col(score) / F.col("_tot") * 100.0).otherwise(F.lit(0.0))
    return j.withColumn(name, pct).drop("_tot")


def top_in_map(m, k: int = 3):
    """K8: the k largest entries of a map, as an array of (key, value) structs, descending
    (ties by key)."""
    entries = F.map_entries(m)
    ordered = F.array_sort(entries, lambda a, b: F.when(a["value"] > b["value"], -1)
                           .when(a["value"] < b["value"], 1).when(a["key"] < b["key"], -1)
                           .when(a["key"] > b["key"], 1).otherwise(0))
    return F.slice(ordered, 1, k)


def attention_cells(df: DataFrame, study: str = "study", matrix: str = "attention",
                    max_samples: int | None = None) -> DataFrame:
    """Flatten: (study, sample_pos, lag, value) from an ARRAY<ARRAY<DOUBLE>>, all samples; NaN → null.
    K11: with ``max_samples``, the head by explicit position (for display, not for means)."""
    s = df.select(study, F.posexplode(matrix).alias("sample_pos", "row"))
    if max_samples is not None:
        s = s.filter(F.col("sample_pos") < max_samples)
    c = s.select(study, "sample_pos", F.posexplode("row").alias("lag", "value"))
    return c.withColumn("value", nan_to_null(F.col("value").cast("double")))


def attention_cells_long(df: DataFrame, study: str = "study", sample_col: str = "sample_pos",
                         row_col: str = "attention_row", max_samples: int | None = None) -> DataFrame:
    """Flatten for matrices stored one sample per row (study, sample_pos, ARRAY<DOUBLE>), all samples;
    K11: with ``max_samples``, the head."""
    s = df if max_samples is None else df.filter(F.col(sample_col) < max_samples)
    c = s.select(study, F.col(sample_col).alias("sample_pos"), F.posexplode(row_col).alias("lag", "value"))
    return c.withColumn("value", nan_to_null(F.col("value").cast("double")))


def mean_attention_per_lag(cells: DataFrame, study: str = "study") -> DataFrame:
    """Mean over samples per lag, nulls ignored (ragged rows are simply shorter)."""
    return cells.groupBy(study, "lag").agg(F.avg("value").alias("mean_attention"))


def smooth_lags(means: DataFrame, study: str = "study", max_bins: int = 120) -> DataFrame:
    """bin = max(1, n // max_bins) lags, mean per bin; Gaussian kernel σ = max(1, bin/2),
    radius int(3σ), normalised, zero-padded 'same' convolution. The kernel is a per-bin explode
    of offsets -r..r (a band, not all pairs) followed by an equi-join on the shifted bin."""
    n = means.groupBy(study).agg((F.max("lag") + 1).alias("_n"))
    d = means.join(n, study, "inner")
    d = d.withColumn("_bs", F.greatest(F.lit(1), F.floor(F.col("_n") / max_bins).cast("int")))
    binned = d.groupBy(study, (F.floor(F.col("lag") / F.col("_bs"))).cast("int").alias("bin")).agg(
        F.avg("mean_attention").alias("binned"), F.first("_bs").alias("_bs"), F.first("_n").alias("_n"))
    binned = binned.withColumn("_nb", F.ceil(F.col("_n") / F.col("_bs")).cast("int"))
    sigma = F.greatest(F.lit(1.0), F.col("_bs") / 2.0)
    radius = F.floor(sigma * 3).cast("int")
    b = binned.withColumn("_sigma", sigma).withColumn("_r", radius)
    norm = F.aggregate(F.sequence(-F.col("_r"), F.col("_r")), F.lit(0.0),
                       lambda acc, m: acc + F.exp(-(m * m) / (2 * F.col("_sigma") * F.col("_sigma"))))
    b = b.withColumn("_norm", norm)
    e = b.select(study, "bin", "_nb", F.coalesce(F.col("binned"), F.lit(0.0)).alias("v"), "_sigma", "_norm",
                 F.explode(F.sequence(-F.col("_r"), F.col("_r"))).alias("m"))
    e = e.withColumn("out_bin", F.col("bin") + F.col("m")).filter((F.col("out_bin") >= 0) & (F.col("out_bin") < F.col("_nb")))
    w = F.exp(-(F.col("m") * F.col("m")) / (2 * F.col("_sigma") * F.col("_sigma"))) / F.col("_norm")
    sm = e.groupBy(study, F.col("out_bin").alias("bin")).agg(F.sum(w * F.col("v")).alias("smoothed"))
    return binned.select(study, "bin", "binned").join(sm, [study, "bin"], "inner")


def encoder_variable_means(df: DataFrame, study: str = "study", col: str = "encoder_variables") -> DataFrame:
    """Per study and variable the mean importance over lags (list form) or the single
    value (map form); variables absent from an entry count as 0 (list form)."""
    dt = df.schema[col].dataType
    if isinstance(dt, T.MapType):
        return df.select(study, F.explode(col).alias("variable", "importance"))
    e = df.select(study, F.posexplode(col).alias("entry", "m"))
    names = e.filter(F.col("entry") == 0).select(study, F.explode(F.map_keys("m")).alias("variable"))
    per = e.join(names, study, "inner").select(study, "variable", "entry",
                                               F.coalesce(F.col("m")[F.col("variable")], F.lit(0.0)).alias("v"))
    return per.groupBy(study, "variable").agg(F.avg(nan_to_null(F.col("v"))).alias("importance"))


def encoder_variable_means_long(df: DataFrame, study: str = "study", entry: str = "entry",
                                map_col: str = "m") -> DataFrame:
    """A20 for the list form stored one entry per row (study, entry, MAP): names from the first
    entry, mean over all entries of the study with absent names counted as 0."""
    names = df.filter(F.col(entry) == 0).select(study, F.explode(F.map_keys(map_col)).alias("variable"))
    per = df.join(names, study, "inner").select(
        study, "variable", F.coalesce(F.col(map_col)[F.col("variable")], F.lit(0.0)).alias("v"))
    return per.groupBy(study, "variable").agg(F.avg(nan_to_null(F.col("v"))).alias("importance"))


def top_variable_names(means: DataFrame, k: int = 4) -> DataFrame:
    """K9: sort all (study, variable) by importance, take k, **then** drop duplicate names
    (may leave fewer than k), and put the index variable first when missing."""
    order = [F.col("importance").desc(), F.col("study"), F.col("variable")]
    top = means.orderBy(*order).limit(k)
    top = top.withColumn("_o", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)))  # k rows
    names = top.groupBy("variable").agg(F.min("_o").alias("position"))
    index_row = means.sparkSession.range(1).select(F.lit(INDEX_VARIABLE).alias("variable"),
                                                   F.lit(0).alias("position"))
    # the index row only survives when the name is absent (a present name keeps its position ≥ 1)
    return names.unionByName(index_row).groupBy("variable").agg(F.max("position").alias("position"))


def rescale_series(df: DataFrame, keys: list[str], col: str, name: str = "scaled") -> DataFrame:
    """min-max to 0-100 per group via an aggregate joined back; flat → 0."""
    mm = df.groupBy(*keys).agg(F.min(col).alias("_lo"), F.max(col).alias("_hi"))
    j = df.join(mm, keys, "inner")
    return j.withColumn(name, F.coalesce(F.try_divide((F.col(col) - F.col("_lo")) * 100.0,
                                                      F.col("_hi") - F.col("_lo")), F.lit(0.0))).drop("_lo", "_hi")



def series_downsample(entries: DataFrame, study: str = "study", entry: str = "entry", value: str = "v",
                      max_points: int = 200) -> DataFrame:
    """W12 (series variant) + F15: a per-study series longer than ``max_points`` is averaged in
    blocks of ``n // max_points`` consecutive entries (nulls ignored), then min-max scaled to
    0-100 per study (a flat series gives 0). Input: one row per (study, entry, value)."""
    n = entries.groupBy(study).agg(F.count(F.lit(1)).alias("_n"))
    d = entries.join(n, study, "inner")
    k = F.when(F.col("_n") > max_points, F.greatest(F.lit(1), F.floor(F.col("_n") / max_points))).otherwise(F.lit(1))
    d = d.withColumn("point", F.floor(F.col(entry) / k).cast("long"))
    b = d.groupBy(study, "point").agg(F.avg(nan_to_null(F.col(value).cast("double"))).alias("value"))
    return rescale_series(b, [study], "value", "scaled")


def entry_value(m: Column, name: Column) -> Column:
    """An entry's importance of one variable: 0 where the entry does not name it, null where its value is NaN or null."""
    return F.when(F.map_contains_key(m, name), nan_to_null(m[name])).otherwise(F.lit(0.0))


def bar_values(entries: DataFrame, names: DataFrame, study: str = "study", map_col: str = "m", most: int = 4) -> DataFrame:
    """A20 (bars): per study the mean importance over all entries of each of the first ``most`` K9 names, a name that an
    entry lacks counting as 0; a variable whose values are all ≤ 1 is shown in percent (× 100). ``entries``: one
    row per study and entry with its map. The names are few (``most``), so they are read to the driver and exploded per entry (no join)."""
    chosen = [r["variable"] for r in names.orderBy("position").limit(most).collect()]
    pairs = F.array(*[F.struct(F.lit(n).alias("variable"), entry_value(F.col(map_col), F.lit(n)).alias("v")) for n in chosen])
    j = entries.select(study, F.explode(pairs).alias("p")).groupBy(study, F.col("p.variable").alias("variable")).agg(F.avg("p.v").alias("importance"))
    most_of = j.groupBy("variable").agg(F.max("importance").alias("_mx"))
    j = j.join(F.broadcast(most_of), "variable", "inner")  # ``most`` rows
    return j.select("variable", study, F.when(F.col("_mx") <= 1.0, F.col("importance") * 100.0)
                    .otherwise(F.col("importance")).alias("bar_value"))


def season_of(date: Column) -> Column:
    """Meteorological season by its months: DJF, MAM, JJA or SON."""
    m = F.month(date)
    return F.when(m.isin(12, 1, 2), "DJF").when(m.isin(3, 4, 5), "MAM").when(m.isin(6, 7, 8), "JJA").when(m.isin(9, 10, 11), "SON")


def seasonal_attention(cells: DataFrame, horizon: str = "horizon", date_col: str = "date") -> DataFrame:
    """Documented extra: mean attention per forecast horizon, season of the sample's date and lag, and over all seasons
    (``season`` null there); nulls are ignored, samples without a date count over all seasons alone. One GROUPING SETS aggregate."""
    d = cells.withColumn("season", season_of(F.col(date_col)))
    g = d.groupingSets([[horizon, "season", "lag"], [horizon, "lag"]], horizon, "season", "lag").agg(
        F.avg("value").alias("mean_attention"), F.count("value").alias("n_samples"), (F.grouping("season") == 1).alias("all_seasons"))
    return g.filter(F.col("season").isNotNull() | F.col("all_seasons"))
