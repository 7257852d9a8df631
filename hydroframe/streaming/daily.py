"""Daily files as a stream: parse, date, label and flag event days (stateless)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hydroframe.operators.prepare import REFERENCE_PERIODS, build_date, period_label
from hydroframe.sources.text import parse_whitespace_lines

KEY = "station_id"


def daily_stream(spark: SparkSession, directory: str, variable: str, columns: list[str],
                 periods=REFERENCE_PERIODS, max_files_per_trigger: int | None = None) -> DataFrame:
    """New ``<station>_<variable>.txt`` files in ``directory`` → (station_id, date, values, period)."""
    r = spark.readStream.format("text")
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    raw = r.load(directory).select("value", F.col("_metadata.file_name").alias("file_name"))
    raw = raw.filter(F.col("file_name").endswith(f"_{variable}.txt"))
    t = parse_whitespace_lines(raw, columns, keep=("file_name",))
    t = t.withColumn(KEY, F.regexp_extract("file_name", rf"^(.+)_{variable}\.txt$", 1)).drop("file_name")
    t = build_date(t, strict=False).filter(F.col("date").isNotNull())
    return t.withColumn("period", period_label(F.col("date"), periods))


def flag_event_days(stream: DataFrame, thresholds: DataFrame, flow: str = "streamflow_m3s") -> DataFrame:
    """Stream-static join with per-station thresholds (from the batch W2 step); event day = flow ≥
    threshold. Island grouping needs the ordered history, so it stays a batch step."""
    j = stream.join(thresholds.select(KEY, "event_threshold"), KEY, "left")
    return j.withColumn("is_event_day", F.coalesce(F.col(flow) >= F.col("event_threshold"), F.lit(False)))
