"""Stand-in inputs built from the driver's tables (see FIXTURES.md part C).

These functions only shape the test tables into the schemas the operators expect
(station daily series, forcings, monthly index, attribute tables, predictions, trials,
importance maps, attention rows). They do none of the operators' work.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

KEY = "station_id"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def daily_flow_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(station_id, date, streamflow_m3s): one row per customer nation and order day
    that has orders; flow = sum(o_totalprice)."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_totalprice", "o_orderdate")
    cust = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    j = orders.join(cust, orders.o_custkey == cust.c_custkey, "inner")
    return (j.groupBy(F.col("c_nationkey").cast("string").alias(KEY),
                      F.to_date("o_orderdate").alias("date"))
             .agg(F.sum("o_totalprice").alias("streamflow_m3s")))


def densify(sparse: DataFrame, date_col: str = "date") -> DataFrame:
    """Rows for every calendar day between each station's first and last day (a daily file
    has a row per day; absent days carry nulls). Per-station ``sequence`` + equi-join, no
    cross join."""
    span = sparse.groupBy(KEY).agg(F.min(date_col).alias("_a"), F.max(date_col).alias("_b"))
    cal = span.select(KEY, F.explode(F.sequence("_a", "_b")).alias(date_col))
    return cal.join(sparse, [KEY, date_col], "left")


def daily_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily streamflow file stand-in: every day of each station's span, nulls on days without orders."""
    return densify(daily_flow_sparse(spark, sf_dir))


def daily_forcings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forcing file per station (supplier nation) and ship day with three variables:
    precipitation = sum(l_quantity), temperature = avg(l_discount), actual_evapotransp = avg(l_tax).
    One scan of lineitem feeds all three."""
    li = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_quantity", "l_discount", "l_tax", "l_shipdate")
    sup = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    j = li.join(sup, li.l_suppkey == sup.s_suppkey, "inner")
    g = j.groupBy(F.col("s_nationkey").cast("string").alias(KEY), F.to_date("l_shipdate").alias("date"))
    return g.agg(F.sum("l_quantity").alias("precipitation"), F.avg("l_discount").alias("temperature"),
                 F.avg("l_tax").alias("actual_evapotransp"))


def monthly_index_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide monthly index: year + ``oni_01``..``oni_12`` of avg(l_discount) by ship month;
    the January cell of the first year is set to the -99.9 sentinel."""
    li = table(spark, sf_dir, "lineitem").select("l_discount", "l_shipdate")
    m = li.groupBy(F.year("l_shipdate").alias("year"), F.month("l_shipdate").alias("month")).agg(
        F.avg("l_discount").alias("v"))
    # earliest year with a January cell (window per month: a handful of rows each)
    first_year = F.min("year").over(Window.partitionBy("month"))
    m = m.withColumn("v", F.when((F.col("year") == first_year) & (F.col("month") == 1), F.lit(-99.9))
                     .otherwise(F.col("v")))
    wide = m.groupBy("year").pivot("month", list(range(1, 13))).agg(F.first("v"))
    return wide.select("year", *[F.col(str(i)).alias(f"oni_{i:02d}") for i in range(1, 13)])


def station_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Static attributes per station (nation): region key and name, supplier count and mean balance."""
    nation = table(spark, sf_dir, "nation")
    sup = table(spark, sf_dir, "supplier")
    s = sup.groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("n_suppliers"),
                                       F.avg("s_acctbal").alias("mean_acctbal"))
    return (nation.join(s, nation.n_nationkey == s.s_nationkey, "left")
                  .select(F.col("n_nationkey").cast("string").alias(KEY),
                          F.col("n_regionkey").cast("double").alias("region_key"),
                          F.col("n_name").alias("nation_name"),
                          F.col("n_suppliers").cast("double").alias("n_suppliers"),
                          F.col("mean_acctbal")))


def forcing_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All source columns of the forcing 'files' in one aggregate (one lineitem scan):
    p_total/p_large, tmean/tmax, aet_mean per supplier nation and ship day."""
    li = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_quantity", "l_discount", "l_tax", "l_shipdate")
    sup = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    j = li.join(sup, li.l_suppkey == sup.s_suppkey, "inner")
    return j.groupBy(F.col("s_nationkey").cast("string").alias(KEY), F.to_date("l_shipdate").alias("date")).agg(
        F.sum("l_quantity").alias("p_total"),
        F.sum(F.when(F.col("l_quantity") > 45, F.col("l_quantity"))).alias("p_large"),
        F.avg("l_discount").alias("tmean"), F.max("l_discount").alias("tmax"),
        F.avg("l_tax").alias("aet_mean"))


def forcing_files(forcing: DataFrame, flow: DataFrame) -> dict[str, DataFrame]:
    """Per-variable daily 'files' with several source columns each (for the best-source rule):
    precipitation, temperature, evapotransp (rows only on days with shipments) and streamflow
    (every day of the span)."""
    return {"precipitation": forcing.select(KEY, "date", "p_total", "p_large"),
            "temperature": forcing.select(KEY, "date", "tmean", "tmax"),
            "evapotransp": forcing.select(KEY, "date", "aet_mean"),
            "streamflow": flow}


def _gauge_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    sup = table(spark, sf_dir, "supplier")
    nation = table(spark, sf_dir, "nation")
    part = table(spark, sf_dir, "part")
    b = sup.join(nation, sup.s_nationkey == nation.n_nationkey, "inner")
    return b.join(part, b.s_suppkey == part.p_partkey, "left")


def gauge_attributes(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Six attribute tables, one gauge per supplier (``gauge_id`` = s_suppkey), values shaped
    from supplier, nation and the part with the same key."""
    b = _gauge_base(spark, sf_dir).withColumn("gauge_id", F.col("s_suppkey").cast("string"))
    frac = F.col("p_retailprice") - F.floor("p_retailprice")
    return {
        "human_intervention": b.select("gauge_id", (F.col("p_size") / 250.0).alias("consumptive_use_perc"),
                                       (frac / 50.0).alias("regulation_degree"),
                                       F.when(F.col("p_type").isin("SMALL", "PROMO"), F.lit(0.0))
                                       .otherwise(F.col("p_size") / 10.0).alias("reservoirs_vol")),
        "quality_check": b.select("gauge_id", (F.lit(100.0) - F.abs("s_acctbal") / 1000.0).alias("q_quality_control_perc"),
                                  (F.lit(100.0) - F.abs("s_acctbal") / 500.0).alias("q_stream_stage_perc")),
        "location": b.select("gauge_id", F.col("s_name").alias("gauge_name"),
                             (F.lit(-20.0) - F.col("n_nationkey") * 0.6).alias("gauge_lat"),
                             (F.lit(-40.0) - F.col("n_regionkey")).alias("gauge_lon"),
                             (F.col("p_retailprice") * 10.0).alias("area_ana"),
                             (F.col("p_retailprice") * 10.0).alias("area_gsim"),
                             F.when(F.col("n_regionkey") <= 2, F.lit("high")).otherwise(F.lit("low"))
                             .alias("area_gsim_quality")),
        "topography": b.select("gauge_id", (F.col("p_size") * 20.0).alias("elev_mean"),
                               (F.col("p_retailprice") / 100.0).alias("slope_mean"),
                               (F.col("p_retailprice") * 10.0).alias("area")),
        "land_cover": b.select("gauge_id", (F.lit(100.0) - F.col("p_size") * 2.0).alias("crop_perc"),
                               (F.col("p_size") * 2.0).alias("forest_perc"),
                               (F.col("p_retailprice") / 200.0).alias("imperv_perc"),
                               F.col("p_type").alias("dom_land_cover")),
        "climate": b.select("gauge_id", (F.col("s_acctbal") / 1000.0).alias("p_mean"),
                            (F.col("p_size") / 10.0).alias("pet_mean"),
                            (F.col("p_retailprice") / 1000.0).alias("aridity"),
                            (F.col("n_regionkey") / 4.0).alias("p_seasonality")),
    }


def station_attribute_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Attribute tables per station (= nation): over all its suppliers, the mean of each number and the
    least text."""
    g = gauge_attributes(spark, sf_dir)
    sup = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("gauge_id"),
                                                  F.col("s_nationkey").cast("string").alias(KEY))
    out = {}
    for name in ("human_intervention", "quality_check", "location", "land_cover"):
        t = g[name]
        one = [(F.min(c) if kind == "string" else F.avg(c)).alias(c) for c, kind in t.dtypes if c != "gauge_id"]
        out[name] = t.join(sup, "gauge_id", "inner").groupBy(KEY).agg(*one)
    return out


def file_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily-file listing stand-in: one file ``<gauge>_<variable>.txt`` per supplier and return
    flag/line status class seen on its lines."""
    li = table(spark, sf_dir, "lineitem")
    var = (F.when((F.col("l_returnflag") == "A"), F.lit("precipitation"))
            .when(F.col("l_returnflag") == "R", F.lit("temperature"))
            .when(F.col("l_linestatus") == "F", F.lit("actual_evapotransp"))
            .otherwise(F.lit("streamflow_m3s")))
    return li.select(F.format_string("%d_%s.txt", F.col("l_suppkey"), var).alias("file_name")).distinct()


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(group, split, y_true, y_pred): lineitem ⋈ part; group = return flag; train = shipped
    before 1999."""
    li = table(spark, sf_dir, "lineitem").select("l_partkey", "l_extendedprice", "l_quantity", "l_returnflag",
                                                  "l_shipdate")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_retailprice")
    j = li.join(part, li.l_partkey == part.p_partkey, "inner")
    return j.select(F.col("l_returnflag").alias("group"),
                    F.when(F.col("l_shipdate") < F.lit("1999-01-01").cast("timestamp_ntz"), F.lit("train"))
                    .otherwise(F.lit("test")).alias("split"),
                    F.col("l_extendedprice").alias("y_true"),
                    (F.col("l_quantity") * F.col("p_retailprice")).alias("y_pred"))


# Fixed values for the trial stand-in: metric per order priority.
TRIAL_METRICS = {"1-URGENT": "NSE", "2-HIGH": "RMSE", "3-MEDIUM": "KGE", "4-NOT SPECIFIED": "val_loss",
                 "5-LOW": "LogNSE"}


def trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trial rows: study = order priority, number = order key, value = total price,
    state COMPLETE/RUNNING/FAIL from the order status, metric from the priority."""
    o = table(spark, sf_dir, "orders")
    metric = F.create_map(*[x for k, v in TRIAL_METRICS.items() for x in (F.lit(k), F.lit(v))])[F.col("o_orderpriority")]
    state = (F.when(F.col("o_orderstatus") == "F", F.lit("COMPLETE"))
              .when(F.col("o_orderstatus") == "O", F.lit("RUNNING")).otherwise(F.lit("FAIL")))
    return o.select(F.col("o_orderpriority").alias("study_name"), F.col("o_orderkey").alias("number"),
                    F.col("o_totalprice").alias("value"), metric.alias("metric"), state.alias("state"))


def experiment_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Experiment result rows, one per line item: model from the return flag, period from the
    line status, lookback = 30 × line number, horizon from the tax band, metrics from price
    columns, status failed for quantity 50."""
    li = table(spark, sf_dir, "lineitem")
    model = F.when(F.col("l_returnflag") == "R", F.lit("lstm")).otherwise(F.lit("tft"))
    period = F.when(F.col("l_linestatus") == "F", F.lit("passado")).otherwise(F.lit("recente"))
    horizon = (F.when(F.col("l_tax") < 0.02, F.lit(1)).when(F.col("l_tax") < 0.04, F.lit(7))
                .when(F.col("l_tax") < 0.06, F.lit(15)).otherwise(F.lit(30)))
    lookback = (F.col("l_linenumber") * 30).cast("int")
    return li.select(
        model.alias("model"), period.alias("period"), lookback.alias("lookback"), horizon.alias("horizon"),
        F.format_string("%s_%s_lb%d_h%d", model, period, lookback, horizon).alias("study_name"),
        F.when(F.col("l_quantity") >= 50, F.lit("failed")).otherwise(F.lit("success")).alias("status"),
        (F.lit(1.0) - F.col("l_discount") * 5.0).alias("NSE"),
        (F.lit(1.0) - F.col("l_discount") * 4.0 - F.col("l_tax")).alias("LogNSE"),
        (F.lit(1.0) - F.col("l_tax") * 6.0).alias("KGE"),
        (F.col("l_extendedprice") / 1000.0).alias("MAE"),
        (F.col("l_extendedprice") / 700.0).alias("RMSE"),
        (F.col("l_quantity") / 10.0).alias("RMSE_dry"),
        (F.col("l_extendedprice") / 100000.0).alias("val_loss"))


def importance_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One interpretability payload per event: source file name built from the event type and day
    half (``tft_<period>_lb<L>_h7_tft_feature_importance.json``), importance map = the
    ``props`` JSON plus value and hour."""
    e = table(spark, sf_dir, "events")
    period = F.when(F.dayofmonth("ts") <= 15, F.lit("passado")).otherwise(F.lit("recente"))
    lb = F.length("event_type") * 30
    study = F.format_string("tft_%s_lb%d_h7", period, lb)
    props = F.from_json("props", "map<string,double>")
    fmap = F.map_concat(props, F.create_map(F.lit("value"), F.col("value").cast("double"),
                                            F.lit("hour"), F.hour("ts").cast("double")))
    return e.select(F.col("event_id"), study.alias("study"),
                    F.concat(study, F.lit("_tft_feature_importance.json")).alias("source"),
                    fmap.alias("feature_importance"), F.col("event_type"))


def attention_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attention samples: study = embedding label, one sample per embedding (64 lags)."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.format_string("study_%d", F.col("label")).alias("study"), F.col("vec_id"),
                    F.col("embedding").cast("array<double>").alias("attention_row"))


def dated_attention_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attention samples with a date and a horizon: a day of 1995-2001 from the vector's id, 7, 15 or 30 days from its label."""
    e = table(spark, sf_dir, "embeddings")
    horizon = F.element_at(F.array(F.lit(7), F.lit(15), F.lit(30)), F.pmod("label", F.lit(3)) + 1)
    day = F.date_add(F.lit("1995-01-01").cast("date"), F.pmod("vec_id", F.lit(2400)).cast("int"))
    return e.select(horizon.alias("horizon"), day.alias("date"), F.col("embedding").cast("array<double>").alias("attention_row"))
