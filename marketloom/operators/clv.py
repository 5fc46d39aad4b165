"""Lifetime value: purchase-count model, spend model, backtest, regression."""

from __future__ import annotations

import datetime as dt
import math
from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Pipeline
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf
from pyspark.sql.types import DoubleType

from marketloom.functions.exprs import days_between, is_valid, n_rows, or_zero, ratio, with_one_row
from marketloom.functions.ml import fit_cached
from marketloom.functions.ordered import quantiles

PURCHASE_START = (0.5, 10.0, 0.5, 10.0)
SPEND_START = (2.0, 3.0, 100.0)


def purchase_summary(orders: DataFrame, as_of: dt.date) -> DataFrame:
    """Purchases, days from first to last (recency), days observed (T) and mean value of valid orders."""
    agg = orders.filter(is_valid() & (F.col("order_date") <= F.lit(as_of))).groupBy("customer_id").agg(
        n_rows().alias("frequency"), F.min("order_date").alias("f"), F.max("order_date").alias("l"), F.sum("order_total").alias("s"))
    return agg.select(
        "customer_id", "frequency", days_between("l", "f").alias("recency"), days_between(F.lit(as_of), "f").alias("T"), days_between(F.lit(as_of), "l").alias("days_since_last"), ratio("s", "frequency").alias("monetary_value"))


# --- likelihood fits ---------------------------------------------------------

_lgamma = np.vectorize(math.lgamma, otypes=[float])


def _purchase_loglik(theta: np.ndarray, x: np.ndarray, tx: np.ndarray, t: np.ndarray) -> np.ndarray:
    r, alpha, a, b = theta
    unique, at = np.unique(x, return_inverse=True)
    gammas = (_lgamma(r + unique) - math.lgamma(r) + math.lgamma(a + b) + _lgamma(b + unique) - math.lgamma(b) - _lgamma(a + b + unique))[at]
    alive = -(r + x) * np.log(alpha + t)
    gone = np.where(x > 0, np.log(a) - np.log(np.maximum(b + x - 1, 1e-12)) - (r + x) * np.log(alpha + tx), -np.inf)
    return gammas + r * math.log(alpha) + np.logaddexp(alive, gone)


def _spend_loglik(theta: np.ndarray, x: np.ndarray, m: np.ndarray) -> np.ndarray:
    p, q, g = theta
    unique, at = np.unique(x, return_inverse=True)
    gammas = (_lgamma(p * unique + q) - _lgamma(p * unique))[at] - math.lgamma(q)
    return gammas + q * math.log(g) + (p * x - 1) * np.log(m) + p * x * np.log(x) - (p * x + q) * np.log(g + x * m)


def _batched(data: DataFrame, columns: Sequence[str], loglik: Callable[..., np.ndarray]) -> Callable[[list[np.ndarray]], np.ndarray]:
    """Total log likelihood of many parameter vectors in one pass over the data; a task sends one sum a vector."""
    def evaluate(thetas: list[np.ndarray]) -> np.ndarray:
        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            totals = np.zeros(len(thetas))
            for batch in batches:
                args = [batch.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in columns]
                w = batch.column("w").cast(pa.float64()).to_numpy(zero_copy_only=False)
                for i, theta in enumerate(thetas):
                    totals[i] += float(np.dot(w, loglik(np.exp(theta), *args)))
            yield pa.record_batch([pa.array([totals.tolist()], pa.list_(pa.float64()))], ["ll"])

        sums = np.array([row["ll"] for row in data.mapInArrow(partial, "ll array<double>").collect()]).reshape(-1, len(thetas)).sum(axis=0)
        return np.where(np.isnan(sums), -np.inf, sums)

    return evaluate


#: Rows of sufficient statistics a task evaluates at least.
_FIT_ROWS = 20_000


def _statistics(data: DataFrame) -> DataFrame:
    """``data`` cached in as few partitions as its rows ask for: each pass of a fit starts one task for each."""
    cached = data.persist()
    n = max(1, cached.count() // _FIT_ROWS)
    return cached.coalesce(n) if n < cached.rdd.getNumPartitions() else cached


def maximize(evaluate: Callable[[list[np.ndarray]], np.ndarray], start: Sequence[float], iterations: int = 25, tol: float = 1e-4) -> tuple[np.ndarray, bool]:
    """Damped Newton ascent on the logarithms of positive parameters; the point, and whether it is a maximum.

    A maximum is a point of negative curvature whose Newton step, gradient over curvature, moves no
    parameter by more than the share ``tol``; that step is still taken.  Data whose likelihood rises
    without end have none, and a line search may find nothing better elsewhere: the last point is
    returned then, marked as no maximum.

    Each iteration asks at once for the step lengths and for the finite-difference points around the
    full step, which is nearly always taken: one pass over the data, two where a shorter step wins.
    """
    theta = np.log(np.asarray(start, float))
    k, h = len(theta), 1e-3
    pairs = [(i, j) for i in range(k) for j in range(i + 1, k)]

    def around(at: np.ndarray) -> list[np.ndarray]:
        points = [at]
        for i in range(k):
            for s in (h, -h):
                p = at.copy()
                p[i] += s
                points.append(p)
        for i, j in pairs:
            p = at.copy()
            p[i] += h
            p[j] += h
            points.append(p)
        return points

    converged, f = False, evaluate(around(theta))
    for n_done in range(iterations):
        up, down = f[1:2 * k + 1:2], f[2:2 * k + 1:2]
        gradient = (up - down) / (2 * h)
        hessian = np.diag((up - 2 * f[0] + down) / h**2)
        for n, (i, j) in enumerate(pairs):
            hessian[i, j] = hessian[j, i] = (f[2 * k + 1 + n] - up[i] - up[j] + f[0]) / h**2
        values, vectors = np.linalg.eigh(hessian)
        if values.max() < 0:
            newton = vectors @ ((vectors.T @ gradient) / -values)
            if np.max(np.abs(newton)) <= tol:
                theta, converged = theta + newton, True
                break
        curvature = np.maximum(np.abs(values), 1e-3 * max(1.0, float(np.max(np.abs(values)))))
        direction = vectors @ ((vectors.T @ gradient) / curvature)
        direction *= min(1.0, 2.0 / max(float(np.max(np.abs(direction))), 1e-12))
        lengths = (1.0, 0.5, 0.25, 0.1, 0.02, 0.004)
        found = evaluate([*(theta + s * direction for s in lengths[1:]), *around(theta + direction)])
        shorter, ahead = found[:len(lengths) - 1], found[len(lengths) - 1:]
        scores = np.r_[ahead[0], shorter]
        best = int(np.argmax(scores))
        if not scores[best] > f[0]:
            break
        theta = theta + lengths[best] * direction
        if n_done + 1 < iterations:
            f = evaluate(around(theta)) if best else ahead
    return np.exp(theta), converged


def fit_purchase_model(summary: DataFrame) -> dict[str, float]:
    """Maximum likelihood of the BG/NBD purchase-count model; equal histories are counted once."""
    data = summary.groupBy((F.col("frequency") - 1).alias("x"), F.col("recency").alias("tx"), F.col("T").alias("t")).agg(n_rows().alias("w"))
    try:
        fitted, converged = maximize(_batched(_statistics(data), ["x", "tx", "t"], _purchase_loglik), PURCHASE_START)
    finally:
        data.unpersist()
    return dict(zip(("r", "alpha", "a", "b"), map(float, fitted))) | {"converged": float(converged)}


def fit_spend_model(summary: DataFrame) -> dict[str, float]:
    """Maximum likelihood of the Gamma-Gamma spend model."""
    data = summary.filter(F.col("monetary_value") > 0).select(F.col("frequency").alias("x"), F.col("monetary_value").alias("m"), F.lit(1).alias("w"))
    try:
        cached = _statistics(data)
        scale = float(cached.agg(F.avg("m")).first()[0] or 1.0)
        (p, q, g), converged = maximize(_batched(cached, ["x", "m"], lambda theta, x, m: _spend_loglik(theta, x, m / scale)), (SPEND_START[0], SPEND_START[1], 1.0))
    finally:
        data.unpersist()
    return {"p": float(p), "q": float(q), "gamma": float(g * scale), "converged": float(converged)}


def parameter_row(df: DataFrame, parameters: Mapping[str, float]) -> DataFrame:
    return df.sparkSession.createDataFrame([tuple(parameters.values())], ", ".join(f"`{k}` double" for k in parameters))


# --- predictions -------------------------------------------------------------


def _dead_odds(p: Mapping[str, float]) -> Column:
    x = F.col("frequency") - 1
    log_ratio = (p["r"] + x) * (F.ln(p["alpha"] + F.col("T")) - F.ln(p["alpha"] + F.col("recency")))
    odds = F.exp(F.least(F.lit(700.0), math.log(max(p["a"], 1e-12)) - F.ln(F.greatest(p["b"] + x - 1, F.lit(1e-12))) + log_ratio))
    return F.when(x > 0, odds).otherwise(0.0)


def predict_alive(summary: DataFrame, p: Mapping[str, float]) -> DataFrame:
    """Probability of still being a customer."""
    return summary.withColumn("p_alive", F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 / (1 + _dead_odds(p)))))


@pandas_udf(DoubleType())
def _hypergeometric(a: pd.Series, b: pd.Series, c: pd.Series, z: pd.Series) -> pd.Series:
    """2F1(a, b; c; z) for 0 <= z < 1 as a power series over the batch, summed until no row's term counts."""
    a, b, c, z = (s.to_numpy(float) for s in (a, b, c, z))
    term = np.ones(len(a))
    out = np.ones(len(a))
    j = 0
    while True:
        ratio = (a + j) * (b + j) / ((c + j) * (j + 1)) * z
        term = term * ratio
        out += term
        j += 1
        # past its peak a term with ratio q leaves less than term * q / (1 - q)
        open_ = np.abs(term) > 1e-17 * np.abs(out) * np.maximum(1e-6, 1 - np.maximum(np.abs(ratio), z))
        if not (open_ & np.isfinite(term)).any():
            return pd.Series(out)


def predict_transactions(summary: DataFrame, p: Mapping[str, float], days: int = 90) -> DataFrame:
    """Expected purchases in the next ``days``.

    The series is the Euler transform of the usual one: only its third parameter grows
    with the number of purchases, so its terms fall from the start and neither they
    nor the power before them leave the range of a double, however many purchases a
    customer has.
    """
    x = (F.col("frequency") - 1).cast("double")
    r, alpha, a, b = (float(p[k]) for k in ("r", "alpha", "a", "b"))
    z = days / (alpha + F.col("T") + days)
    low = a + b + x - 1
    series = _hypergeometric(F.lit(a + b - 1 - r), F.lit(a - 1), low, z)
    expected = low / (a - 1) * (1 - F.pow(1 - z, F.lit(a - 1)) * series) / (1 + _dead_odds(p))
    return summary.withColumn("expected_transactions", F.greatest(F.lit(0.0), F.coalesce(F.nanvl(expected, F.lit(0.0)), F.lit(0.0))))


def predict_value(summary: DataFrame, purchase: Mapping[str, float], spend: Mapping[str, float], days: int = 90, monthly_discount: float = 0.01) -> DataFrame:
    """Expected transactions x expected value, discounted, with quartile tiers."""
    out = predict_transactions(summary, purchase, days)
    n, m = F.col("frequency"), F.col("monetary_value")
    value = spend["p"] * (spend["gamma"] + n * m) / (spend["p"] * n + spend["q"] - 1)
    out = out.withColumn("expected_monetary_value", value).withColumn("clv", F.col("expected_transactions") * value)
    out = out.withColumn("clv_discounted", F.col("clv") / (1 + monthly_discount) ** (days / 30))
    edges = quantiles(out, "clv", {"q1": 0.25, "q2": 0.5, "q3": 0.75})
    out = with_one_row(out, edges, "_q")
    tier = F.when(F.col("clv") <= F.col("_q.q1"), "Low").when(F.col("clv") <= F.col("_q.q2"), "Medium-Low").when(F.col("clv") <= F.col("_q.q3"), "Medium-High").otherwise("High")
    return out.withColumn("clv_tier", tier).drop("_q")


# --- backtest ----------------------------------------------------------------


def training_window(orders: DataFrame, train_end: dt.date, min_orders: int = 2) -> DataFrame:
    """Purchases before the end of training for customers with at least two."""
    end = F.lit(train_end)
    agg = orders.filter(F.col("order_date") < end).groupBy("customer_id").agg(
        n_rows().alias("frequency"), F.min("order_date").alias("f"), F.max("order_date").alias("l"), F.sum("order_total").cast("double").alias("monetary"))
    return agg.filter(F.col("frequency") >= min_orders).select("customer_id", "frequency", days_between(end, "l").alias("recency"), days_between(end, "f").alias("T"), "monetary")


def holdout_revenue(orders: DataFrame, start: dt.date, end: dt.date) -> DataFrame:
    return orders.filter(F.col("order_date").between(F.lit(start), F.lit(end))).groupBy("customer_id").agg(F.sum("order_total").cast("double").alias("actual_holdout_revenue"))


def evaluate_value(predicted: DataFrame, holdout: DataFrame, column: str, horizon_days: int = 180) -> DataFrame:
    """Errors, bias and fit of yearly predictions scaled to the horizon."""
    a = F.col("actual_holdout_revenue")
    data = predicted.join(holdout, "customer_id").select(a, (F.col(column) * (horizon_days / 365)).alias("p"))
    p = F.col("p")
    agg = data.agg(
        n_rows().alias("n_customers"), F.avg(F.abs(a - p)).alias("mae"), F.avg((a - p) * (a - p)).alias("_mse"), (F.avg(F.abs((a - p) / (a + 1e-6))) * 100).alias("mape"),
        F.sum(a).alias("total_actual_revenue"), F.sum(p).alias("total_predicted_revenue"), F.var_pop(a).alias("_var"))
    return agg.select(
        "n_customers", "mae", F.sqrt("_mse").alias("rmse"), "mape", "total_actual_revenue", "total_predicted_revenue",
        ((F.col("total_predicted_revenue") - F.col("total_actual_revenue")) / F.col("total_actual_revenue") * 100).alias("revenue_bias"), F.when(F.col("_var") > 0, 1 - F.col("_mse") / F.col("_var")).otherwise(0.0).alias("r_squared"))


def decile_lift(predicted: DataFrame, holdout: DataFrame, column: str, horizon_days: int = 180, k: int = 10) -> DataFrame:
    """Actual over predicted revenue per decile of the prediction."""
    data = predicted.join(holdout, "customer_id").select("actual_holdout_revenue", (F.col(column) * (horizon_days / 365)).alias("p"))
    edges = quantiles(data, "p", {f"e{i}": i / k for i in range(1, k)})
    tagged = with_one_row(data, edges, "_e")
    decile = sum(((F.col("p") > F.col(f"_e.e{i}")).cast("int") for i in range(1, k)), F.lit(0))
    per = tagged.groupBy(decile.alias("decile")).agg(F.sum("actual_holdout_revenue").alias("actual"), F.sum("p").alias("predicted"))
    return per.withColumn("lift", F.when(F.col("predicted") > 0, F.col("actual") / F.col("predicted")).otherwise(0.0))


def backtest(orders: DataFrame, train_end: dt.date, horizon_days: int = 180) -> DataFrame:
    """Fit on the past, predict each customer's value, score it on the following days."""
    past = orders.filter(F.col("order_date") < F.lit(train_end))
    summary = purchase_summary(past, train_end)
    predicted = predict_value(summary, fit_purchase_model(summary), fit_spend_model(summary), days=365)
    actual = holdout_revenue(orders, train_end, train_end + dt.timedelta(days=horizon_days))
    return evaluate_value(predicted.filter(F.col("frequency") >= 2), actual, "clv", horizon_days)


# --- regression --------------------------------------------------------------


def value_features(rfm: DataFrame, orders: DataFrame, as_of: dt.date) -> DataFrame:
    """Spend after three cutoffs as targets and the history before them as features."""
    known = orders.filter(F.col("order_date") <= F.lit(as_of))
    after = lambda d: F.sum(F.when(F.col("order_date") > F.lit(as_of - dt.timedelta(days=d)), F.col("order_total"))).cast("double")
    year = F.col("order_date") <= F.lit(as_of - dt.timedelta(days=365))
    total = F.col("order_total").cast("double")
    agg = known.groupBy("customer_id").agg(
        F.sum(F.when(year, F.col("order_total"))).cast("double").alias("historical_clv"), *[after(d).alias(f"future_clv_{d}d") for d in (90, 180, 365)],
        F.avg(total).alias("order_mean"), F.stddev_samp(total).alias("order_std"), F.min(total).alias("order_min"), F.max(total).alias("order_max"), F.count_if(year).alias("orders_before_year"))
    out = rfm.join(agg, "customer_id", "left")
    return out.select(*rfm.columns, *[or_zero(c).alias(c) for c in agg.columns if c != "customer_id"])


VALUE_FEATURES = ("historical_clv", "orders_before_year", "order_min")


def _estimator(kind: str):
    return {
        "gradient_boosting": GBTRegressor(maxIter=10, maxDepth=4, seed=42), "random_forest": RandomForestRegressor(numTrees=20, maxDepth=6, seed=42),
        "ridge": LinearRegression(regParam=1.0, elasticNetParam=0.0), "lasso": LinearRegression(regParam=1.0, elasticNetParam=1.0)}[kind]


def _value_pipeline(kind: str, features: Sequence[str]) -> Pipeline:
    return Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="_raw"), StandardScaler(inputCol="_raw", outputCol="features", withMean=True), _estimator(kind)])


def train_value_model(data: DataFrame, target: str = "future_clv_365d", kind: str = "ridge", features: Sequence[str] = VALUE_FEATURES, folds: int = 3):
    """Scaled regression with train, test and cross-validated errors; returns (model, metrics)."""
    labelled = data.withColumn("label", F.col(target).cast("double"))
    held = F.pmod(F.xxhash64("customer_id"), F.lit(5)) == 0
    train, test = labelled.filter(~held).persist(), labelled.filter(held)
    pipeline = _value_pipeline(kind, features)
    mae = RegressionEvaluator(metricName="mae")
    cv = CrossValidator(estimator=pipeline, estimatorParamMaps=ParamGridBuilder().build(), evaluator=mae, numFolds=folds, parallelism=folds, seed=42).fit(train)
    model = cv.bestModel
    scores = [float(RegressionEvaluator(metricName=m).evaluate(model.transform(d))) for d in (train, test) for m in ("mae", "rmse", "r2")]
    train.unpersist()
    row = (kind, target, *scores, float(cv.avgMetrics[0]))
    return model, data.sparkSession.createDataFrame([row], "model_type string, target string, train_mae double, train_rmse double, train_r2 double, test_mae double, test_rmse double, test_r2 double, cv_mae double")


def compare_value_models(data: DataFrame, target: str = "future_clv_365d", kinds: Sequence[str] = ("ridge", "lasso", "random_forest")) -> DataFrame:
    """Models ranked by test error."""
    parts = [train_value_model(data, target, k)[1] for k in kinds]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.withColumn("rank", F.row_number().over(W.partitionBy("target").orderBy("test_mae", "model_type")))  # one row per model


def predict_value_model(model, data: DataFrame) -> DataFrame:
    return model.transform(data).withColumn("predicted_clv", F.greatest(F.lit(0.0), F.col("prediction"))).select(*data.columns, "predicted_clv")


def compare_approaches(probabilistic: DataFrame, learned: DataFrame, historical: DataFrame) -> DataFrame:
    """Ratios and agreement of three estimates per customer.

    Each input holds ``customer_id`` and its estimate ``value``.
    """
    pick = lambda df, name: df.select("customer_id", F.col("value").alias(name))
    out = pick(probabilistic, "probabilistic_clv").join(pick(learned, "ml_clv"), "customer_id").join(pick(historical, "historical_clv"), "customer_id")
    p, m, h = F.col("probabilistic_clv"), F.col("ml_clv"), F.col("historical_clv")
    return out.select(
        "customer_id", p, m, h, F.try_divide(p, h).alias("probabilistic_vs_historical"), F.try_divide(m, h).alias("ml_vs_historical"), F.try_divide(m, p).alias("ml_vs_probabilistic"),
        ((p > h) == (m > h)).cast("int").alias("approach_agreement"))
