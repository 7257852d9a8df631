"""Station ranking."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hydroframe.operators.quantile import global_rank

GAUGE = "gauge_id"

# The columns each attribute table contributes to the star join.
STAR_COLUMNS = {
    "human_intervention": None,  # all columns
    "quality_check": None,
    "location": ["gauge_name", "gauge_lat", "gauge_lon", "area_ana", "area_gsim", "area_gsim_quality"],
    "topography": ["elev_mean", "slope_mean", "area"],
    "land_cover": ["crop_perc", "forest_perc", "imperv_perc", "dom_land_cover"],
    "climate": ["p_mean", "pet_mean", "aridity", "p_seasonality"],
}
# Score weights.
WEIGHTS = {"score_quality": 0.24, "score_regulation": 0.16, "score_consumptive": 0.16, "score_forest": 0.12,
           "score_imperv": 0.08, "score_reservoirs": 0.04, "score_data_availability": 0.20}
# The four daily files a gauge needs.
REQUIRED_SUFFIXES = ("_precipitation.txt", "_temperature.txt", "_actual_evapotransp.txt", "_streamflow_m3s.txt")
# Recommendation roles and rationale texts.
ROLES = (
    ("Bacia principal", "Melhor equilibrio entre baixa intervencao humana, alta qualidade hidrologica e "
                        "disponibilidade local das quatro series dinamicas."),
    ("Bacia reserva", "Melhor alternativa caso seja necessario trocar a bacia principal, mantendo alta qualidade e "
                      "baixa intervencao; pode exigir coleta adicional das series dinamicas."),
)
# The comparison table's columns.
COMPARISON_COLUMNS = ("rank", GAUGE, "gauge_name", "gauge_lat", "area", "has_local_dynamic_data",
                      "consumptive_use_perc", "regulation_degree", "reservoirs_vol", "q_quality_control_perc",
                      "q_stream_stage_perc", "forest_perc", "crop_perc", "imperv_perc", "dom_land_cover",
                      "recommended_score")


def star_join(tables: dict[str, DataFrame]) -> DataFrame:
    """Inner join of the six attribute tables on gauge_id, columns pre-selected (pruned
    before the join). Join strategy is left to the optimizer (attribute tables are one row per
    gauge; AQE broadcasts them when their measured size is small)."""
    frames = []
    for name, cols in STAR_COLUMNS.items():
        t = tables[name]
        frames.append(t if cols is None else t.select(GAUGE, *cols))
    return reduce(lambda a, b: a.join(b, GAUGE, "inner"), frames)


def southern_candidates(df: DataFrame) -> DataFrame:
    """Latitude in [-34, -22], high area quality, quality control ≥ 95 %."""
    return df.filter((F.col("gauge_lat") <= -22.0) & (F.col("gauge_lat") >= -34.0)
                     & (F.col("area_gsim_quality") == "high") & (F.col("q_quality_control_perc") >= 95.0))


def dynamic_availability(listing: DataFrame, file_col: str = "file_name") -> DataFrame:
    """Gauges with all four daily files, from a listing of file names (e.g. the distinct
    ``_metadata.file_name`` of the daily scan); no data is read."""
    suffix = None
    gid = None
    for s in REQUIRED_SUFFIXES:
        cond = F.col(file_col).endswith(s)
        suffix = F.when(cond, F.lit(s)) if suffix is None else suffix.when(cond, F.lit(s))
        g = F.expr(f"substring({file_col}, 1, length({file_col}) - {len(s)})")
        gid = F.when(cond, g) if gid is None else gid.when(cond, g)
    m = listing.select(gid.alias(GAUGE), suffix.alias("suffix")).filter(F.col("suffix").isNotNull())
    return (m.groupBy(GAUGE).agg(F.count_distinct("suffix").alias("_n"))
             .filter(F.col("_n") == len(REQUIRED_SUFFIXES)).select(GAUGE))


def score(df: DataFrame, available: DataFrame | None = None) -> DataFrame:
    """K1 + J6: seven sub-scores and the weighted score of each candidate."""
    if available is not None:
        flag = F.col("_avail").isNotNull()
        d = df.join(available.select(GAUGE, F.lit(True).alias("_avail")).distinct(), GAUGE, "left")
        d = d.withColumn("has_local_dynamic_data", flag).drop("_avail")
    else:
        d = df.withColumn("has_local_dynamic_data", F.lit(False))
    d = d.withColumns({
        "score_quality": F.col("q_quality_control_perc") / 100.0,
        "score_forest": F.col("forest_perc") / 100.0,
        "score_imperv": F.lit(1.0) - F.col("imperv_perc") / 100.0,
        "score_consumptive": F.lit(1.0) / (F.lit(1.0) + F.col("consumptive_use_perc")),
        "score_regulation": F.lit(1.0) / (F.lit(1.0) + F.col("regulation_degree") * 100.0),
        "score_reservoirs": F.lit(1.0) / (F.lit(1.0) + F.col("reservoirs_vol")),
        "score_data_availability": F.col("has_local_dynamic_data").cast("double"),
    })
    total = None
    for c, w in WEIGHTS.items():
        term = F.lit(w) * F.col(c)
        total = term if total is None else total + term
    return d.withColumn("recommended_score", total)


def rank_order() -> list[Column]:
    """Score desc, local data desc, regulation asc, consumptive asc, reservoirs asc, quality desc, gauge_id asc
    (explicit last key for ties)."""
    return [-F.col("recommended_score"), ~F.col("has_local_dynamic_data"), F.col("regulation_degree"),
            F.col("consumptive_use_perc"), F.col("reservoirs_vol"), -F.col("q_quality_control_perc"), F.col(GAUGE)]


def ranked(scored: DataFrame) -> DataFrame:
    """All scored rows with their rank 1..n, in tasks of like size however the scores cluster."""
    return global_rank(scored, rank_order())


def score_candidates(df: DataFrame, available: DataFrame | None = None) -> DataFrame:
    """K1 + J6 + W11: sub-scores, weighted score, and a dense 1..n rank."""
    return ranked(score(df, available))


def top_candidates(scored: DataFrame, n: int = 15) -> DataFrame:
    """K2 on scored rows without rank: the first n (TakeOrderedAndProject), ranked among themselves."""
    n = max(1, n)
    first = scored.orderBy(*rank_order()).limit(n)
    w = Window.partitionBy(F.lit(0)).orderBy(*rank_order())  # n rows
    return first.withColumn("rank", F.row_number().over(w).cast("int"))


def leaders(scored: DataFrame, target: str, n: int) -> DataFrame:
    """The first n of the scored rows and the target with their ranks, without ranking the others: the target's rank is one
    more than the number of rows before it, counted here. Write ``scored`` before (``cut_lineage``)."""
    top = top_candidates(scored, n)
    order = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(rank_order())])
    own = scored.filter(F.col(GAUGE) == target)
    at = own.agg(F.min(order).alias("at")).first()["at"]
    if at is None:
        return top
    key = F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(at, own.select(order.alias("o")).schema[0].dataType.fields, strict=True)])
    rank = scored.filter(order < key).count() + 1
    return top if rank <= n else top.unionByName(own.withColumn("rank", F.lit(rank)))


def top_n(scored: DataFrame, n: int = 15) -> DataFrame:
    """K2: the first n rows by rank (TakeOrderedAndProject)."""
    return scored.orderBy("rank").limit(max(1, n))


def comparison_table(scored: DataFrame, target: str, n: int = 5) -> DataFrame:
    """K3 + U3: target row first, then the top n, first occurrence wins; ``row_order`` keeps the
    table order. Without the target, just the top n rows (same 16 columns, a stable schema)."""
    cols = [c for c in COMPARISON_COLUMNS if c in scored.columns]
    tgt = scored.filter(F.col(GAUGE) == target)
    src = (tgt.select(*cols, F.lit(0).alias("_src"), F.col("rank").alias("_r"))
              .unionByName(scored.filter(F.col("rank") <= n).select(*cols, F.lit(1).alias("_src"),
                                                                     F.col("rank").alias("_r"))))
    w = Window.partitionBy(GAUGE).orderBy("_src", "_r")
    dedup = src.withColumn("_k", F.row_number().over(w)).filter("_k = 1")
    ow = Window.partitionBy(F.lit(0)).orderBy("_src", "_r")  # at most n + 1 rows
    return dedup.select(*cols, F.row_number().over(ow).alias("row_order"))


def recommendation(scored: DataFrame, target: str) -> DataFrame:
    """K4: principal = target if ranked, else rank 1; reserve = best-ranked other gauge.
    Only the target and the first two ranks can take part, so this runs on ≤ 3 rows."""
    c = scored.filter((F.col(GAUGE) == target) | (F.col("rank") <= 2))
    w = Window.partitionBy(F.lit(0)).orderBy(F.when(F.col(GAUGE) == target, 0).otherwise(1), "rank")
    c = c.withColumn("_k", F.row_number().over(w)).filter("_k <= 2")
    role = F.when(F.col("_k") == 1, F.lit(ROLES[0][0])).otherwise(F.lit(ROLES[1][0]))
    why = F.when(F.col("_k") == 1, F.lit(ROLES[0][1])).otherwise(F.lit(ROLES[1][1]))
    return c.select(role.alias("recommendation_role"), GAUGE, "gauge_name", "rank", "has_local_dynamic_data",
                    "recommended_score", "q_quality_control_perc", "consumptive_use_perc", "regulation_degree",
                    "reservoirs_vol", "forest_perc", "crop_perc", "imperv_perc", why.alias("rationale"))
