"""Exact order statistics and ranks over groups of any size.

``percentile`` holds every distinct value of a group in one task. Here values are counted first, the
counts are dealt out by ranges of (group, value), and only sums per range meet: ranges of one group
stand in value order, so a wanted rank lies in one range, and only that range's rows are looked at.
The ranges are written to the shared checkpoint folder, as their bounds come from a sample and must
not be drawn twice.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hydroframe.session import cut_lineage

#: Rows up to which a per-group table is broadcast; beyond it the join shuffles (AQE splits hot groups).
SMALL_ROWS = 100_000

_PART, _BEFORE = "_part", "_before"


def small(df: DataFrame, max_rows: int = SMALL_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``max_rows`` rows, which are counted."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def value_counts(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Distinct non-null values per group with their counts ``n``, dealt by ranges of (group, value); ``_part``
    names the range. NaN counts as a value above all others."""
    c = df.select(*keys, F.col(value).cast("double").alias("value")).where(F.col("value").isNotNull())
    c = c.groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("n"))
    return cut_lineage(c.repartitionByRange(*keys, "value").withColumn(_PART, F.spark_partition_id()))


def _ranges(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Per group and range: rows before it in the group, and the group's ``total``. As many rows as ranges and groups."""
    r = counts.groupBy(*keys, _PART).agg(F.sum("n").alias("rows"))
    w = Window.partitionBy(*keys)
    return r.select(*keys, _PART, "rows", F.sum("rows").over(w).alias("total"),
                    (F.sum("rows").over(w.orderBy(_PART)) - F.col("rows")).alias(_BEFORE))


def _null_safe_join(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Inner join in which null keys meet, as they do in ``groupBy``."""
    right = right.withColumnsRenamed({c: f"_r_{c}" for c in on})
    same = [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in on]
    return left.join(right, reduce(lambda a, b: a & b, same)).drop(*(f"_r_{c}" for c in on))


def quantiles_of_counts(counts: DataFrame, keys: list[str], qs: list[float], names: list[str]) -> DataFrame:
    """Linear quantiles of ``value_counts``: per group one row with ``total`` and a column for each of ``names``.

    The quantile q of n values is at place ``(n - 1) q`` between the values of the two whole ranks around it.
    """
    r = _ranges(counts, keys)
    place = {n: (F.col("total") - 1) * F.lit(float(q)) for n, q in zip(names, qs, strict=True)}
    ranks = F.array(*(f(p).cast("long") for p in place.values() for f in (F.floor, F.ceil)))
    r = r.withColumn("_ranks", ranks)
    held = F.exists("_ranks", lambda k: (k >= F.col(_BEFORE)) & (k < F.col(_BEFORE) + F.col("rows")))
    wanted = r.where(held).select(*keys, _PART, _BEFORE, "total", "_ranks")
    d = _null_safe_join(counts, small(cut_lineage(wanted)), [*keys, _PART])
    upto = F.sum("n").over(Window.partitionBy(*keys, _PART).orderBy("value"))
    d = d.withColumn("_end", F.col(_BEFORE) + upto).withColumn("_start", F.col("_end") - F.col("n"))
    at = lambda i: F.max(F.when((F.col("_ranks")[i] >= F.col("_start")) & (F.col("_ranks")[i] < F.col("_end")), F.col("value")))
    d = d.groupBy(*keys).agg(F.max("total").alias("total"), *(at(i).alias(f"_v{i}") for i in range(2 * len(names))))
    out = []
    for i, (name, p) in enumerate(place.items()):
        low, high = F.col(f"_v{2 * i}"), F.col(f"_v{2 * i + 1}")
        between = (F.ceil(p) - p) * low + (p - F.floor(p)) * high
        out.append(F.when(low == high, low).otherwise(between).alias(name))
    return d.select(*keys, "total", *out)


def exact_quantiles(df: DataFrame, keys: list[str], value: str, qs: list[float], names: list[str]) -> DataFrame:
    """Per group the exact linear quantiles ``qs`` of the non-null values, as columns ``names``.

    A group without values has no row, an empty table gives none; a null key is a group of its own.
    """
    return quantiles_of_counts(value_counts(df, keys, value), keys, qs, names).drop("total")


def global_rank(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """All rows with their rank from 1 by ``order`` (name a last key that is unique), in tasks of like size whatever the
    values: rows are dealt by sampled ranges of the order and numbered in their range; the rows before it are added."""
    d = df.select("*", F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)]).alias("_order"))
    d = cut_lineage(d.repartitionByRange("_order").withColumn(_PART, F.spark_partition_id()))
    n = d.groupBy(_PART).agg(F.count(F.lit(1)).alias("rows"))
    n = n.select(_PART, (F.sum("rows").over(Window.orderBy(_PART)) - F.col("rows")).alias(_BEFORE))  # a row a range
    place = F.row_number().over(Window.partitionBy(_PART).orderBy("_order"))
    d = d.join(F.broadcast(n), _PART).withColumn(name, (F.col(_BEFORE) + place).cast("int"))
    return d.select(*df.columns, name)
