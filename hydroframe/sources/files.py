"""JSON, CSV and cached-table sources."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hydroframe.functions.scalar import name_matches

D = T.DoubleType()
S = T.StringType()

# Best-trial document layout (nested; params kept as a string map).
BEST_METRICS = ["MAE", "RMSE", "R2", "NSE", "KGE", "sMAPE", "Q90_reference", "LogNSE", "RMSE_dry",
                "n_dry_samples", "val_loss"]
SEARCH_CONFIG = [("n_trials", T.LongType()), ("timeout", D), ("max_epochs", T.LongType()), ("patience", T.LongType()),
                 ("data_dir", S), ("master_csv", S), ("rebuild_master_dataset", T.BooleanType()), ("seed", T.LongType()),
                 ("train_start", S), ("train_end", S), ("test_start", S), ("test_end", S), ("val_fraction", D)]
BEST_TRIAL_SCHEMA = T.StructType([
    T.StructField("study_name", S), T.StructField("metric", S), T.StructField("direction", S),
    T.StructField("best_value", D), T.StructField("best_trial", T.LongType()),
    T.StructField("best_params", T.MapType(S, S)),
    T.StructField("best_metrics", T.StructType([T.StructField(m, D) for m in BEST_METRICS])),
    T.StructField("use_static_features", T.BooleanType()),
    T.StructField("static_categoricals", T.ArrayType(S)), T.StructField("static_reals", T.ArrayType(S)),
    T.StructField("search_config", T.StructType([T.StructField(n, t) for n, t in SEARCH_CONFIG])),
])

# Interpretability payload: the two-shape fields are read as raw JSON text, then parsed.
IMPORTANCE_SCHEMA = T.StructType([
    T.StructField("study_name", S), T.StructField("forecast_horizon", T.LongType()),
    T.StructField("attention_prediction_horizon", T.LongType()), T.StructField("total_features", T.LongType()),
    T.StructField("feature_importance", T.MapType(S, D)), T.StructField("encoder_variables", S),
    T.StructField("decoder_variables", S), T.StructField("static_variables", T.MapType(S, D)),
    T.StructField("temporal_features", T.ArrayType(S)), T.StructField("top_features", T.ArrayType(S)),
    T.StructField("attention", T.ArrayType(T.ArrayType(D))), T.StructField("oni_curve", T.ArrayType(D)),
    T.StructField("period", S), T.StructField("lookback", T.LongType()),
])


def read_best_trials(spark: SparkSession, glob: str) -> DataFrame:
    """One nested best-trial document per study (``*_best.json``), explicit schema, with
    the source file name."""
    return (spark.read.schema(BEST_TRIAL_SCHEMA).option("multiLine", True).json(glob)
                 .withColumn("source", F.col("_metadata.file_name")))


def two_shape_map(raw: F.Column) -> F.Column:
    """A map field that may be a map or a list of maps: always ``ARRAY<MAP<STRING,DOUBLE>>``."""
    as_list = F.from_json(raw, T.ArrayType(T.MapType(S, D)))
    as_map = F.from_json(raw, T.MapType(S, D))
    return F.coalesce(as_list, F.when(as_map.isNotNull(), F.array(as_map)))


def read_importance(spark: SparkSession, directory: str,
                    pattern: str = r"^tft_(passado|recente)_lb\d+_h\d+_tft_feature_importance\.json$") -> DataFrame:
    """Interpretability payloads whose file name matches the rule; the two-shape fields become
    ``ARRAY<MAP>`` (a single map is a one-entry list). A folder without such a payload is an error."""
    df = (spark.read.schema(IMPORTANCE_SCHEMA).option("multiLine", True)
               .json(f"{directory}/*_tft_feature_importance.json")
               .withColumn("source", F.col("_metadata.file_name")))
    df = df.filter(name_matches(F.col("source"), pattern))
    if df.select("source").isEmpty():
        raise ValueError(f"no importance payload in {directory}")
    return df.withColumns({"encoder_variables": two_shape_map(F.col("encoder_variables")),
                           "decoder_variables": two_shape_map(F.col("decoder_variables"))})


def read_results_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Results CSV with header; an explicit schema avoids an inference pass."""
    r = spark.read.option("header", True)
    r = r.schema(schema) if schema is not None else r.option("inferSchema", True)
    return r.csv(path)


def read_or_build(spark: SparkSession, path: str, required: set[str],
                  build: Callable[[], DataFrame]) -> DataFrame:
    """Reuse a written table when it exists and holds every required column; else build it,
    write it (Parquet) and read it back (the written table also cuts the lineage)."""
    try:
        cached = spark.read.parquet(path)
        if required.issubset(set(cached.columns)):
            return cached
    except AnalysisException as e:  # nothing there yet; any other error must not overwrite the table
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
    build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
