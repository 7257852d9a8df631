"""Sinks (S10-S13): partitioned tables instead of per-gauge files and workbooks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_by_period(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """One table, partitioned by period (a period without rows simply has no folder)."""
    w = df.write.mode(mode).partitionBy("period")
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.format(fmt).save(path)


def write_scaling_metadata(meta: DataFrame, path: str) -> None:
    """The long (station_id, column, min, max) table as JSON lines."""
    meta.write.mode("overwrite").json(path)


def write_report(tables: dict[str, DataFrame], path: str, fmt: str = "parquet") -> None:
    """A directory of named tables (the seven readiness tables)."""
    for name, df in tables.items():
        df.write.mode("overwrite").format(fmt).save(f"{path}/{name}")


def write_trials(frames: list[DataFrame], path: str, fmt: str = "parquet") -> DataFrame:
    """S13 + U4: ragged trial rows unioned by name (missing → null) and written."""
    df = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    df.write.mode("overwrite").format(fmt).save(path)
    return df


def tag_source(df: DataFrame, name: str) -> DataFrame:
    return df.withColumn("source", F.lit(name))
