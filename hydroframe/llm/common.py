"""Helpers that several operators share: row keys, checked broadcasts, written intermediate tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hydroframe.session import checkpoint_dir

#: Rows up to which a side with short rows is broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 200_000

#: Maximal runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str | Column = "text") -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def words_of(text: Column) -> Column:
    """The words of a text: maximal runs of anything but ASCII white space, as they are.

    White space becomes single spaces first: splitting at one plain character is several times as fast as a pattern.
    """
    return F.array_remove(F.split(F.regexp_replace(text, r"[\x09-\x0D]", " "), " "), "")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's path in the shared checkpoint folder."""
    return f"{checkpoint_dir(spark)}/llm-{uuid.uuid4().hex}/{name}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared checkpoint folder: cuts lineage, survives lost executors.

    Unlike an RDD checkpoint the table is compressed, and later reads prune columns and filter.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``max_rows`` rows (counted), else as it is.

    ``df`` should be a written table: it is counted here and read again by the join.
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def unit_hash(*columns: Column, seed: int | str = 0) -> Column:
    """A number in [0, 1) that depends on the columns' text and the seed alone (leading 12 hex digits of md5)."""
    parts = [F.lit(str(seed)), *(F.coalesce(c.cast("string"), F.lit("")) for c in columns)]
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 12), 16, 10).cast("double") / F.lit(float(16**12))
