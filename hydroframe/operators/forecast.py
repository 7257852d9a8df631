"""Forecasting jobs re-aimed at Spark (M1, M3): regressions over all stations' windows, fitted with MLlib on the
chronological split and scored with the hydrological metrics in the unit of the flow.

The reference trains single-machine neural networks; a Spark user would run a distributed
regressor over the same windows instead: a linear one or gradient-boosted trees. Windows and split labels come from
W6 and W9 in one pass, metrics from A5/A6; the fits are MLlib's distributed optimisers.
"""

from __future__ import annotations

from collections.abc import Callable
from multiprocessing.pool import ThreadPool

from py4j.protocol import Py4JJavaError
from pyspark import inheritable_thread_target
from pyspark.errors import PySparkException
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hydroframe.functions.scalar import inverse_target
from hydroframe.operators.experiments import experiment_grid
from hydroframe.operators.metrics import hydro_metrics, low_flow_metrics, low_flow_reference
from hydroframe.operators.windows import DateSplit, chronological_split, lookback_windows

KEY = "station_id"


def linear(reg_param: float = 0.01, max_iter: int = 50) -> LinearRegression:
    """Ridge regression; without regularisation, least squares by the normal equations."""
    return LinearRegression(regParam=reg_param, maxIter=max_iter, solver="auto" if reg_param else "normal")


def boosted_trees(trees: int = 20, depth: int = 4, step: float = 0.2, seed: int = 1) -> GBTRegressor:
    return GBTRegressor(maxIter=trees, maxDepth=depth, stepSize=step, seed=seed)


def window_features(windows: DataFrame, fields: list[str], steps: int | None = None) -> DataFrame:
    """Flatten each window's steps, or its last ``steps``, oldest first, into one feature vector; a null counts as 0."""
    of = F.col("inputs") if steps is None else F.slice("inputs", -steps, steps)
    flat = F.flatten(F.transform(of, lambda s: F.array(*[F.coalesce(s[f].cast("double"), F.lit(0.0)) for f in fields])))
    return windows.withColumn("features", array_to_vector(flat))


def fit_windows(windows: DataFrame, fields: list[str], estimator, target_fit: tuple[float, float] | None = None,
                steps: int | None = None):
    """M1: fit an MLlib regressor on the train windows (``lookback_windows`` with a split) and predict all labelled ones.

    ``target_fit``: mean and deviation of the scaled log target (``windows.fit_scale``): truth and prediction are
    then turned back into flows (F2: unscale, expm1, clip at 0) before anyone scores them, as the reference does. Without it
    they stay as they are. A null target is no row. Returns (model, predictions).
    """
    s = window_features(windows.filter(F.col("split").isNotNull() & F.col("target").isNotNull()), fields, steps)
    model = estimator.copy().setFeaturesCol("features").setLabelCol("target").setPredictionCol("prediction").fit(s.filter(F.col("split") == "train"))

    def flow(c: str):
        return F.col(c) if target_fit is None else inverse_target(c, F.lit(target_fit[0]), F.lit(target_fit[1]))

    pred = model.transform(s)
    return model, pred.select(KEY, "target_date", "split", flow("target").alias("y_true"), flow("prediction").alias("y_pred"))


def fit_lag_regression(data: DataFrame, fields: list[str], reg_param: float = 0.01, max_iter: int = 50,
                       train_start: str = "1980-01-01", train_end: str = "2010-12-31", test_start: str = "2011-01-01",
                       test_end: str | None = None, val_fraction: float = 0.15,
                       target_fit: tuple[float, float] | None = None):
    """M1 over windows without labels: W9 split, ridge regression, predictions. Returns (model, predictions)."""
    s = data if "split" in data.columns else chronological_split(data, train_start, train_end, test_start, test_end, val_fraction)
    return fit_windows(s, fields, linear(reg_param, max_iter), target_fit)


def score(pred: DataFrame, keys: list[str] = (KEY,)) -> DataFrame:
    """A5 + A6 (+ A7 from the train rows) per key and split (trap T8: the split column is kept)."""
    keys = list(keys)
    q = low_flow_reference(pred.filter(F.col("split") == "train"), keys, "y_true")
    base = hydro_metrics(pred, [*keys, "split"])
    lf = low_flow_metrics(pred.join(q, keys, "inner"), [*keys, "split"])
    return base.join(lf, [*keys, "split"], "inner")


def sweep(spark: SparkSession, scaled: DataFrame, features: list[str], target: str, lookbacks, horizons,
          periods, test_start: str, test_end: str | None = None, reg_param: float = 0.01,
          target_fit: tuple[float, float] | None = None, parallelism: int = 4,
          models: dict[str, Callable] | None = None) -> DataFrame:
    """M3: the J9 grid over ``models`` (name -> maker of an MLlib regressor; default: ridge regression) → one M1 fit per cell
    → one result row per cell with status and the metrics of the validation split, in flows with ``target_fit`` (as the
    reference records them, T8); a failing cell yields ``status='failed'`` and the error text instead of stopping the sweep.

    ``parallelism`` cells are fitted at once, from as many driver threads, so that one cell's small stages do not leave the
    cluster idle; each fit is a Spark job of its own. Rows are the same, and in the same order, for any ``parallelism``.
    """
    models = models or {"linreg": lambda: linear(reg_param)}
    grid = experiment_grid(spark, horizons, list(models), periods, lookbacks).collect()  # small config grid

    def run(cell) -> tuple:
        head = (cell.study_name, cell.model, cell.period, cell.lookback, cell.horizon)
        try:
            split = DateSplit(cell.train_start, cell.train_end, test_start, test_end)
            w = lookback_windows(scaled, cell.lookback, cell.horizon, features, target, split=split)
            _, pred = fit_windows(w, [target, *features], models[cell.model](), target_fit)
            m = hydro_metrics(pred.filter(F.col("split") == "val"), ["split"]).first()
            if m is None:
                return (*head, "failed", None, None, None, "no validation window")
            return (*head, "success", m["NSE"], m["KGE"], m["MAE"], None)
        except (PySparkException, Py4JJavaError, ArithmeticError) as e:  # a cell that cannot be fitted is a row; our own errors are raised
            return (*head, "failed", None, None, None, str(e))

    with ThreadPool(max(1, parallelism)) as pool:
        rows = pool.map(inheritable_thread_target(spark)(run), grid)
    schema = ("study_name string, model string, period string, lookback int, horizon int, status string, "
              "nse double, kge double, mae double, error string")
    return spark.createDataFrame(rows, schema)
