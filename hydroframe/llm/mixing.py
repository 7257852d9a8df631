"""Mixing sources to target weights: each document comes a Poisson number of times, then all are shuffled."""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hydroframe.llm.common import text_of, unit_hash

#: Name of what is in no named source, among the weights and in errors.
REST = None


def poisson_cdf(mean: float) -> list[float]:
    """P(count <= 0), P(count <= 1), ... up to where the hash's 48 bits cannot tell the rest from 1."""
    out, total, k = [], 0.0, 0
    while mean > 0:
        p = math.exp(k * math.log(mean) - mean - math.lgamma(k + 1))
        total += p
        out.append(min(total, 1.0))
        if k > mean and p < 2.0**-60:
            return out
        k += 1
    return [1.0]


def _bucket(weights: Mapping[str | None, float]) -> Column:
    named = [k for k in weights if k is not REST]
    return F.when(F.col("source").isin(named), F.col("source")) if named else F.lit(None).cast("string")


def source_sizes(docs: DataFrame, weights: Mapping[str | None, float]) -> dict[str | None, int]:
    """Characters and one more a document, by named source, and of all the others under ``REST``: at most a row for
    each weight and one, summed up before they are shuffled."""
    d = docs.select(_bucket(weights).alias("b"), (F.length(text_of()) + 1).alias("n"))
    return {r["b"]: r["n"] for r in d.groupBy("b").agg(F.sum("n").alias("n")).collect()}


def mix(docs: DataFrame, weights: Mapping[str | None, float], scale: float = 1.0, seed: int = 0) -> DataFrame:
    """Rows of ``docs``, each as often as a Poisson variable says, in a random order: all columns, then ``mix_copy``
    (1, 2, ...) and ``mix_order`` (rows are sorted by it over all partitions); columns
    of these names are replaced.

    ``weights``: share of the output's size for each source; what is in none of them has the weight of ``REST`` (default:
    what the others leave of 1). The output is ``scale`` times the input's size: a source's mean repetition rate
    is its part of that over its size. The count inverts the Poisson distribution at a number hashed from the seed,
    ``doc_id`` and text, so a lost task makes the same rows again. Null texts count as empty, a null source is among the rest, rows
    alike in id and text get the same count; an empty table gives an empty result.
    """
    if any(w < 0 for w in weights.values()) or sum(weights.values()) > 1 + 1e-9:
        raise ValueError("weights are shares: none under 0, 1 together at most")
    weights = {REST: 1 - sum(weights.values())} | dict(weights)
    sizes = source_sizes(docs, weights)
    total = sum(sizes.values())
    tables = {k: poisson_cdf(w * scale * total / sizes[k]) for k, w in weights.items() if k in sizes}
    b = _bucket(weights)
    cdf = F.array(*map(F.lit, tables.get(REST, [1.0])))
    for k, t in tables.items():
        if k is not REST:
            cdf = F.when(b == F.lit(k), F.array(*map(F.lit, t))).otherwise(cdf)
    text = F.md5(text_of().cast("binary"))
    u = unit_hash(F.col("doc_id"), text, seed=f"{seed}:count")
    own = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("mix_copy", "mix_order")]
    d = docs.select(F.struct(*own).alias("_row"), text.alias("_h"), u.alias("_u"), cdf.alias("_cdf"))
    d = d.select("_row", "_h", F.size(F.filter("_cdf", lambda c: c <= F.col("_u"))).alias("_n")).where("_n > 0")
    d = d.select("_row", "_h", F.explode(F.sequence(F.lit(1), F.col("_n"))).alias("mix_copy"))
    d = d.withColumn("mix_order", unit_hash(F.col("_row.doc_id"), F.col("_h"), F.col("mix_copy"), seed=f"{seed}:order")).drop("_h")
    d = d.withColumn("_i", F.monotonically_increasing_id())  # rows alike in all are dealt out too
    d = d.repartitionByRange("mix_order", "_i").sortWithinPartitions("mix_order", "_i")
    return d.select("_row.*", "mix_copy", "mix_order")
