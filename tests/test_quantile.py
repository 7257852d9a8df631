"""Exact quantiles and ranks spread over ranges of values."""

import random
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from hydroframe.operators import experiments as X
from hydroframe.operators import metrics as M
from hydroframe.operators import readiness as R
from hydroframe.operators.quantile import exact_quantiles, global_rank, value_counts


def rows(spark):
    """A hot group, one with ties, tiny ones, one without values, and a null group."""
    rng = random.Random(1)
    data = [("hot", rng.lognormvariate(3, 2)) for _ in range(3000)] + [("ties", float(rng.randrange(4))) for _ in range(500)]
    data += [("one", 5.0), ("two", 1.0), ("two", 2.0), ("none", None), (None, 7.0), (None, 9.0), ("hot", None)]
    rng.shuffle(data)
    return data, spark.createDataFrame(data, "g string, v double").repartition(7)


def test_quantiles_equal_numpy(spark):
    data, df = rows(spark)
    groups = defaultdict(list)
    for g, v in data:
        if v is not None:
            groups[g].append(v)
    qs = [0.0, 0.1, 0.25, 0.5, 0.9, 0.999, 1.0]
    got = {r["g"]: r for r in exact_quantiles(df, ["g"], "v", qs, [f"q{i}" for i in range(len(qs))]).collect()}
    assert got.keys() == groups.keys()
    for g, values in groups.items():
        assert np.allclose([got[g][f"q{i}"] for i in range(len(qs))], np.quantile(values, qs), rtol=1e-12)


def test_quantiles_of_several_keys_and_of_nothing(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (1, "a", 4.0), (1, "b", 2.0), (2, "a", 8.0)], "k int, l string, v double")
    got = {(r["k"], r["l"]): r["m"] for r in exact_quantiles(df, ["k", "l"], "v", [0.5], ["m"]).collect()}
    assert got == {(1, "a"): 2.5, (1, "b"): 2.0, (2, "a"): 8.0}
    assert not exact_quantiles(df.limit(0), ["k"], "v", [0.5], ["m"]).collect()


def test_a_hot_group_is_in_many_ranges(spark):
    _, df = rows(spark)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        parts = value_counts(df, ["g"], "v").where("g = 'hot'").groupBy("_part").count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(parts) >= 4 and max(r["count"] for r in parts) < 1500


def test_no_percentile_runs_on_raw_rows(spark):
    _, df = rows(spark)
    q = M.low_flow_reference(df, ["g"], "v")
    box = X.boxplot_stats(df.withColumnsRenamed({"v": "LogNSE"}), keys=["g"])
    days = spark.range(400).select(F.lit("s").alias("station_id"), F.date_add(F.lit("2000-01-01").cast("date"), F.col("id").cast("int")).alias("date"), (F.col("id") % 37).cast("double").alias("streamflow_m3s"))
    for d in (q, box, R.detect_events(days)):
        assert "percentile" not in d._jdf.queryExecution().executedPlan().toString()


def test_box_statistics_equal_numpy(spark):
    data, df = rows(spark)
    v = np.array([x for g, x in data if g == "hot" and x is not None])
    r = next(r for r in X.boxplot_stats(df, "v", ["g"]).collect() if r["g"] == "hot")
    q1, q2, q3 = np.quantile(v, [0.25, 0.5, 0.75])
    lo, hi = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
    assert np.allclose([r["q1"], r["median"], r["q3"], r["whisker_low"], r["whisker_high"]], [q1, q2, q3, v[v >= lo].min(), v[v <= hi].max()])
    assert (r["n"], r["n_outliers"]) == (len(v), int(((v < lo) | (v > hi)).sum()))


def test_global_rank_of_clustered_scores(spark):
    df = spark.range(5000).select("id", F.when(F.col("id") % 10 < 9, F.lit(0.5)).otherwise(F.rand(3)).alias("s")).repartition(5)
    got = [(r["rank"], r["s"], r["id"]) for r in global_rank(df, [-F.col("s"), F.col("id")]).collect()]
    assert [(s, i) for _, s, i in sorted(got)] == sorted(((s, i) for _, s, i in got), key=lambda x: (-x[0], x[1]))
    assert sorted(r for r, _, _ in got) == [*range(1, 5001)]
    assert not global_rank(df.limit(0), [F.col("id")]).collect()
