"""Churn models, classifier evaluation, calibration, costs and model monitoring."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator, MulticlassClassificationEvaluator
from pyspark.ml.feature import Imputer, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.ml.tuning import ParamGridBuilder, TrainValidationSplit
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marketloom.functions.exprs import days_between, n_rows, or_zero, ratio, with_one_row
from marketloom.functions.ml import fit_cached
from marketloom.functions.ordered import quantiles, running_totals
from marketloom.operators.quality import unpivot_numbers

# Model inputs and risk tiers.
NUMERIC_FEATURES = ("total_orders", "avg_order_value", "total_spend", "return_rate", "discount_usage_pct", "sessions_count", "customer_tenure_days", "review_count", "total_units_bought")
CATEGORICAL_FEATURES = ("customer_segment", "gender", "state")
RISK_EDGES = (0.2, 0.5)


# --- churn data --------------------------------------------------------------


def observed_features(customers: DataFrame, orders: DataFrame, sessions: DataFrame, reviews: DataFrame, observed: dt.date, window_days: int = 180) -> DataFrame:
    """Order, session and review features of the window before the observation date."""
    start, end = F.lit(observed - dt.timedelta(days=window_days)), F.lit(observed)
    inside = lambda c: (F.col(c) >= start) & (F.col(c) < end)
    per = orders.filter(inside("order_date")).groupBy("customer_id").agg(
        n_rows().alias("total_orders"), F.sum("order_total").cast("double").alias("total_spend"), ratio(F.sum("order_total"), n_rows()).alias("avg_order_value"),
        ratio(F.sum("discount_amount"), n_rows()).alias("avg_discount_amount"), (F.count_if(F.col("order_status") == "Returned") / n_rows()).alias("return_rate"), F.max("order_date").alias("_last"))
    visits = sessions.filter(inside("session_date")).groupBy("customer_id").agg(n_rows().alias("sessions_count"), F.avg("page_views").alias("avg_page_views"), F.avg("session_duration_sec").alias("avg_session_sec"))
    rated = reviews.filter(inside("review_date")).groupBy("customer_id").agg(F.avg("rating").alias("avg_review_rating"), n_rows().alias("review_count"))
    out = customers
    for child in (per, visits, rated):
        out = out.join(child, "customer_id", "left")
    tenure = days_between(end, "signup_date")
    zero = ("total_orders", "total_spend", "avg_order_value", "avg_discount_amount", "return_rate", "sessions_count", "avg_page_views", "avg_session_sec", "avg_review_rating", "review_count")
    return out.select(*customers.columns, *[or_zero(c).alias(c) for c in zero], F.coalesce(days_between(end, "_last"), F.lit(window_days)).alias("days_since_last_order"), tenure.alias("customer_tenure_days"))


def churn_target(customers: DataFrame, orders: DataFrame, observed: dt.date, horizon_days: int = 90) -> DataFrame:
    """1 for customers who bought before the date and not within the horizon after it."""
    before = F.max((F.col("order_date") < F.lit(observed)).cast("int"))
    after = F.max(F.col("order_date").between(F.lit(observed), F.lit(observed + dt.timedelta(days=horizon_days))).cast("int"))
    flags = orders.groupBy("customer_id").agg(before.alias("b"), after.alias("a"))
    return customers.select("customer_id").join(flags, "customer_id", "left").select("customer_id", ((or_zero("b") == 1) & (or_zero("a") == 0)).cast("int").alias("churn_label_90d"))


def churn_dataset(features: DataFrame, target: DataFrame, min_orders: int = 1) -> DataFrame:
    return features.join(target, "customer_id").filter(F.col("total_orders") >= min_orders)


def temporal_splits(dataset: DataFrame, train: float = 0.6, validation: float = 0.2) -> DataFrame:
    """Rows tagged train / validation / test in signup order."""
    ranked = running_totals(dataset, [F.col("signup_date"), F.col("customer_id")], rank="_r", count="_n")
    cut = lambda share: F.floor(F.col("_n") * share + 1e-9)
    split = F.when(F.col("_r") <= cut(train), "train").when(F.col("_r") <= cut(train + validation), "validation").otherwise("test")
    return ranked.withColumn("split", split).drop("_r", "_n")


# --- models ------------------------------------------------------------------


def preprocessing(numeric: Sequence[str], categorical: Sequence[str], output: str = "features") -> Pipeline:
    """Median imputation, one-hot categories, scaling."""
    filled = [f"_f_{c}" for c in numeric]
    stages = [Imputer(strategy="median", inputCols=list(numeric), outputCols=filled)]
    stages += [StringIndexer(inputCol=c, outputCol=f"_i_{c}", handleInvalid="keep") for c in categorical]
    if categorical:
        stages.append(OneHotEncoder(inputCols=[f"_i_{c}" for c in categorical], outputCols=[f"_o_{c}" for c in categorical]))
    stages += [VectorAssembler(inputCols=filled + [f"_o_{c}" for c in categorical], outputCol="_raw"), StandardScaler(inputCol="_raw", outputCol=output, withMean=True)]
    return Pipeline(stages=stages)


def as_double(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*[F.col(c).cast("double").alias(c) if c in columns else F.col(c) for c in df.columns])


def classifier(kind: str, **params):
    if kind == "random_forest":
        return RandomForestClassifier(**({"numTrees": 20, "maxDepth": 6, "seed": 42} | params))
    if kind == "gradient_boosting":
        return GBTClassifier(**({"maxIter": 10, "maxDepth": 4, "seed": 42} | params))
    if kind == "logistic":
        return LogisticRegression(**({"maxIter": 50, "regParam": 0.01} | params))
    raise ValueError(f"unknown model {kind}")


def probability(column: str = "probability") -> Column:
    return vector_to_array(column)[1]


def prepared(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], label: str, key: str = "customer_id") -> DataFrame:
    """Feature vectors and labels with a hash split column."""
    typed = as_double(df, numeric)
    fitted = fit_cached(preprocessing(numeric, categorical), typed)
    out = fitted.transform(typed).withColumn("label", F.col(label).cast("double")).withColumn("is_test", F.pmod(F.xxhash64(key), F.lit(5)) == 0)
    return out.select(*df.columns, "features", "label", "is_test")


def balanced(df: DataFrame) -> DataFrame:
    """Class weights that give both labels the same total weight."""
    s = df.agg(n_rows().alias("n"), F.sum("label").alias("p"))
    out = with_one_row(df, s, "_b")
    n, p = F.col("_b.n"), F.col("_b.p")
    return out.withColumn("weight", F.coalesce(F.when(F.col("label") == 1, F.try_divide(n, 2 * p)).otherwise(F.try_divide(n, 2 * (n - p))), F.lit(1.0))).drop("_b")


def train_churn(df: DataFrame, numeric: Sequence[str] = NUMERIC_FEATURES, categorical: Sequence[str] = CATEGORICAL_FEATURES, label: str = "churn_label_90d", test_share: float = 0.2):
    """Forest and logistic blend with a tenure-ordered test set.

    The newest customers by tenure are held out.  Returns (scored rows, metrics, forest).
    """
    data = prepared(df, numeric, categorical, label)
    ranked = running_totals(data.select("customer_id", "customer_tenure_days"), [F.col("customer_tenure_days").desc(), F.col("customer_id")], rank="_r", count="_n")
    test_ids = ranked.select("customer_id", (F.col("_r") > F.floor(F.col("_n") * (1 - test_share))).alias("held_out"))
    tagged = balanced(data.join(test_ids, "customer_id")).persist()
    train = tagged.filter(~F.col("held_out"))
    forest = classifier("random_forest", weightCol="weight").fit(train)
    logistic = classifier("logistic", weightCol="weight").fit(train)
    a = forest.transform(tagged).select("customer_id", probability().alias("_rf"))
    b = logistic.transform(tagged).select("customer_id", probability().alias("_lr"))
    scored = with_risk(tagged.join(a, "customer_id").join(b, "customer_id").withColumn("churn_probability", 0.7 * F.col("_rf") + 0.3 * F.col("_lr")))
    return scored, evaluate_scores(scored.filter("held_out"), "label", "churn_probability"), forest


def with_risk(df: DataFrame, probability_column: str = "churn_probability", edges: tuple[float, float] = RISK_EDGES) -> DataFrame:
    """Risk tier and score of a churn probability."""
    p = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col(probability_column)))
    out = df.withColumn(probability_column, p)
    p = F.col(probability_column)
    return out.withColumn("risk_tier", F.when(p <= edges[0], "Low").when(p <= edges[1], "Medium").otherwise("High")).withColumn("risk_score", F.round(p * 1000, 0).cast("int"))


def heuristic_scores(df: DataFrame, rising: Sequence[str] = ("days_since_last_order", "return_rate", "discount_usage_pct"), falling: Sequence[str] = ("total_orders", "total_spend")) -> DataFrame:
    """Mean of min-max scaled features, those that protect reversed."""
    columns = [c for c in (*rising, *falling) if c in df.columns]
    span = df.agg(*[x for c in columns for x in (F.min(F.col(c).cast("double")).alias(f"lo_{c}"), F.max(F.col(c).cast("double")).alias(f"hi_{c}"))])
    out = with_one_row(df, span, "_s")

    def scaled(c: str) -> Column:
        v = (F.coalesce(F.col(c).cast("double"), F.lit(0.0)) - F.col(f"_s.lo_{c}")) / (F.col(f"_s.hi_{c}") - F.col(f"_s.lo_{c}") + 1e-9)
        return v if c in rising else 1 - v

    terms = [scaled(c) for c in columns]
    score = reduce(lambda a, b: a + b, terms) / len(terms) if terms else F.lit(0.3)
    return with_risk(out.withColumn("churn_probability", score).drop("_s"))


def risk_drivers(scored: DataFrame, features: Sequence[str], top: int = 3, above: float = 0.15) -> DataFrame:
    """The features furthest above the median of the low-risk customers.

    ``scored`` carries ``risk_tier`` and ``churn_probability``.
    """
    low = scored.filter(F.col("risk_tier") == "Low")
    cut = quantiles(scored, "churn_probability", {"q": 0.3}).select("q").scalar()
    few = low.agg(n_rows() < 5).scalar()
    reference = scored.withColumn("_few", few).withColumn("_cut", cut).filter(F.when(F.col("_few"), F.col("churn_probability") <= F.col("_cut")).otherwise(F.col("risk_tier") == "Low"))
    med = quantiles(unpivot_numbers(reference, features), "value", {"median": 0.5}, keys=["feature"])
    pivot = med.agg(F.map_from_entries(F.collect_list(F.struct("feature", "median")))).scalar()  # one entry per feature
    out = scored.withColumn("_m", pivot)
    delta = lambda c: (F.col(c).cast("double") - F.col("_m")[c]) / (F.abs(F.col("_m")[c]) + 1e-9)
    ranked = F.slice(F.sort_array(F.array(*[F.struct(delta(c).alias("d"), F.lit(c).alias("f")) for c in features]), asc=False), 1, top)
    kept = F.filter(ranked, lambda x: x["d"] > above)
    text = F.array_join(F.transform(kept, lambda x: F.concat(x["f"], F.lit(" +"), F.floor(x["d"] * 100).cast("string"), F.lit("%"))), "; ")
    return out.withColumn("top_risk_drivers", F.when(F.size(kept) == 0, "No unusual drivers").otherwise(text)).drop("_m")


def recommended_actions(df: DataFrame) -> DataFrame:
    """Action by risk and value tier."""
    valuable = F.col("clv_tier").isin("High", "Medium-High")
    return df.withColumn(
        "recommended_action",
        F.when((F.col("risk_tier") == "High") & valuable, "Priority: 1:1 outreach + exclusive loyalty discount (15%+ 3mo)")
        .when(F.col("risk_tier") == "High", "Send targeted win-back coupon (10% off) + personalization campaign")
        .when(F.col("risk_tier") == "Medium", "Nurture: personalized product recommendations + limited-time free shipping")
        .otherwise("Maintain: periodic newsletter with curated deals"))


# --- evaluation --------------------------------------------------------------


def confusion(df: DataFrame, label: str, score: str, threshold: float | Column = 0.5, by: Sequence[str] = ()) -> DataFrame:
    y, hit = F.col(label) == 1, F.col(score) >= (F.lit(threshold) if isinstance(threshold, float) else threshold)
    return df.groupBy(*by).agg(F.count_if(y & hit).alias("tp"), F.count_if(~y & ~hit).alias("tn"), F.count_if(~y & hit).alias("fp"), F.count_if(y & ~hit).alias("fn"))


def confusion_metrics(c: DataFrame) -> DataFrame:
    """Accuracy, precision, recall and F1 of confusion counts."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    out = c.withColumn("accuracy", or_zero(ratio(tp + F.col("tn"), tp + F.col("tn") + fp + fn))).withColumn("precision", or_zero(ratio(tp, tp + fp))).withColumn("recall", or_zero(ratio(tp, tp + fn)))
    return out.withColumn("f1_score", or_zero(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))))


def auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """Area under the ROC curve from rank sums; ties count half."""
    counts = df.groupBy(F.col(score).alias("_score")).agg(n_rows().alias("_rows"), F.sum((F.col(label) == 1).cast("long")).alias("_hits"))
    run = running_totals(counts, [F.col("_score")], sums={"_hi": "_rows"}, totals={"np": "_hits", "nn": "_rows"}, rank=None)
    rank = F.col("_hi") - (F.col("_rows") - 1) / 2
    agg = run.agg(F.sum(F.col("_hits") * rank).alias("r"), F.max("np").alias("np"), F.max("nn").alias("nn"))
    p, n = F.col("np"), F.col("nn") - F.col("np")
    return agg.select(F.try_divide(F.col("r") - p * (p + 1) / 2, (p * n).cast("double")).alias("auc_roc"))


def evaluate_scores(df: DataFrame, label: str, score: str, threshold: float = 0.5) -> DataFrame:
    return confusion_metrics(confusion(df, label, score, threshold)).withColumn("auc_roc", auc(df, label, score).scalar())


def compare_classifiers(data: DataFrame, kinds: Sequence[str] = ("random_forest", "gradient_boosting", "logistic")) -> DataFrame:
    """Weighted metrics of several classifiers on the same split (``features``, ``label``, ``is_test``)."""
    train, test = data.filter(~F.col("is_test")).select("features", "label").persist(), data.filter("is_test").select("features", "label").persist()
    rows = []
    for kind in kinds:
        scored = classifier(kind).fit(train).transform(test).persist()
        multi = [float(MulticlassClassificationEvaluator(metricName=m).evaluate(scored)) for m in ("accuracy", "weightedPrecision", "weightedRecall", "f1")]
        rows.append((kind, *multi, float(BinaryClassificationEvaluator().evaluate(scored))))
        scored.unpersist()
    train.unpersist()
    test.unpersist()
    return data.sparkSession.createDataFrame(rows, "model_type string, accuracy double, precision double, recall double, f1_score double, auc_roc double")


def tune(data: DataFrame, kind: str = "logistic", grid: Mapping[str, Sequence] | None = None) -> DataFrame:
    """Grid search by accuracy on a validation split, candidates in parallel."""
    model = classifier(kind)
    grid = grid or {"regParam": (0.0, 0.01, 0.1)}
    builder = ParamGridBuilder()
    for name, values in grid.items():
        builder = builder.addGrid(model.getParam(name), list(values))
    maps = builder.build()
    tvs = TrainValidationSplit(estimator=model, estimatorParamMaps=maps, evaluator=MulticlassClassificationEvaluator(metricName="accuracy"), trainRatio=0.75, parallelism=4, seed=42)
    fitted = fit_cached(tvs, data.filter(~F.col("is_test")).select("features", "label"))
    rows = [(kind, ", ".join(f"{p.name}={v}" for p, v in m.items()), float(s)) for m, s in zip(maps, fitted.validationMetrics)]
    best = max(r[2] for r in rows)
    return data.sparkSession.createDataFrame([(*r, r[2] == best) for r in rows], "model_type string, parameters string, accuracy double, is_best boolean")


def importances(model, names: Sequence[str], like: DataFrame) -> DataFrame:
    """Tree importances by feature, largest first."""
    values = model.featureImportances.toArray()
    rows = [(n, float(values[i])) for i, n in enumerate(names)]
    return like.sparkSession.createDataFrame(rows, "feature string, importance double").orderBy(F.col("importance").desc())


# --- costs and calibration ---------------------------------------------------

Costs = Mapping[str, float]
DEFAULT_COSTS: Costs = {"tp": -100.0, "tn": 0.0, "fp": 10.0, "fn": 50.0}


def expected_cost(costs: Costs = DEFAULT_COSTS) -> Column:
    return sum((F.col(k) * float(v) for k, v in costs.items()), F.lit(0.0))


def threshold_costs(df: DataFrame, label: str, score: str, costs: Costs = DEFAULT_COSTS, steps: int = 100) -> DataFrame:
    """Confusion counts and cost at each of ``steps`` thresholds from 0 to 1.

    Scores are counted into the slots between thresholds, so the rows are read
    once and the cumulative step runs over the slots.
    """
    slot = F.floor(F.col(score) * (steps - 1) + 1e-12).cast("int")
    bins = df.groupBy(slot.alias("i")).agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("n"))
    grid = df.sparkSession.range(steps).select(F.col("id").cast("int").alias("i"))
    w = W.partitionBy(F.lit(0)).orderBy("i")  # one row per threshold
    up, down = w.rowsBetween(0, W.unboundedFollowing), w.rowsBetween(W.unboundedPreceding, -1)
    c = grid.join(bins, "i", "left").select("i", or_zero("p").alias("p"), or_zero("n").alias("n")).select(
        (F.col("i") / (steps - 1)).alias("threshold"), F.sum("p").over(up).alias("tp"), or_zero(F.sum("n").over(down)).alias("tn"), F.sum("n").over(up).alias("fp"), or_zero(F.sum("p").over(down)).alias("fn"))
    return c.withColumn("cost", expected_cost(costs))


def optimal_threshold(df: DataFrame, label: str, score: str, costs: Costs = DEFAULT_COSTS, steps: int = 100) -> DataFrame:
    """The cheapest threshold (the lowest of equals)."""
    best = threshold_costs(df, label, score, costs, steps).agg(F.min_by(F.struct("threshold", "cost", "tp", "tn", "fp", "fn"), F.struct("cost", "threshold")).alias("b"))
    return best.select(F.col("b.threshold").alias("optimal_threshold"), F.col("b.cost").alias("min_cost"), "b.tp", "b.tn", "b.fp", "b.fn")


def cost_benefit(df: DataFrame, label: str, score: str, benefit_tp: float = 100, benefit_tn: float = 0, cost_fp: float = 10, cost_fn: float = 50) -> DataFrame:
    best = optimal_threshold(df, label, score, {"tp": -benefit_tp, "tn": -benefit_tn, "fp": cost_fp, "fn": cost_fn})
    return best.withColumn("net_benefit", -F.col("min_cost"))


def thresholds_at(df: DataFrame, label: str, score: str, thresholds: Sequence[float], costs: Costs = DEFAULT_COSTS) -> DataFrame:
    """Confusion counts and cost at the given thresholds in one pass."""
    y = F.col(label) == 1
    agg = df.agg(*[F.struct(
        F.lit(float(t)).alias("threshold"), F.count_if(y & (F.col(score) >= t)).alias("tp"), F.count_if(~y & (F.col(score) < t)).alias("tn"), F.count_if(~y & (F.col(score) >= t)).alias("fp"),
        F.count_if(y & (F.col(score) < t)).alias("fn")).alias(f"t{i}") for i, t in enumerate(thresholds)])
    rows = agg.select(F.explode(F.array(*[F.col(f"t{i}") for i in range(len(thresholds))])).alias("r")).select("r.*")
    return rows.withColumn("cost", expected_cost(costs))


def cost_weights(df: DataFrame, label: str, cost_fp: float, cost_fn: float) -> DataFrame:
    """Training weight of a row: the cost of getting it wrong."""
    return df.withColumn("weight", F.when(F.col(label) == 1, F.lit(float(cost_fn))).otherwise(F.lit(float(cost_fp))))


def calibration_curve(df: DataFrame, label: str, score: str, bins: int = 10) -> DataFrame:
    """Positive rate and mean score per equal-width bin; a bin includes its upper edge."""
    b = sum(((F.col(score) > i / bins).cast("int") for i in range(1, bins)), F.lit(0))
    return df.groupBy(b.alias("bin")).agg(F.avg((F.col(label) == 1).cast("double")).alias("fraction_of_positives"), F.avg(score).alias("mean_predicted_value"), n_rows().alias("n"))


def calibration_error(curve: DataFrame) -> DataFrame:
    gap = F.abs(F.col("fraction_of_positives") - F.col("mean_predicted_value"))
    return curve.agg((F.sum(F.col("n") * gap) / F.sum("n")).alias("ece"))


def brier(label: str, score: str) -> Column:
    return F.avg((F.col(score) - F.col(label)) * (F.col(score) - F.col(label)))


def log_loss(label: str, score: str) -> Column:
    p = F.greatest(F.lit(1e-15), F.least(F.lit(1 - 1e-15), F.col(score)))
    return F.avg(-F.when(F.col(label) == 1, F.ln(p)).otherwise(F.ln(1 - p)))


def calibrate(train: DataFrame, df: DataFrame, label: str, score: str) -> DataFrame:
    """Sigmoid and isotonic versions of a score, fitted on ``train``."""
    shaped = lambda d: VectorAssembler(inputCols=[score], outputCol="features").transform(d.withColumn("label", F.col(label).cast("double")))
    base = shaped(train).select("features", "label", F.col(score))
    sigmoid = fit_cached(LogisticRegression(maxIter=50), base.select("features", "label"))
    isotonic = fit_cached(IsotonicRegression(featuresCol="features", labelCol="label"), base.select("features", "label"))
    out = sigmoid.transform(shaped(df)).withColumn("sigmoid_score", probability()).drop("rawPrediction", "probability", "prediction")
    out = isotonic.transform(out).withColumn("isotonic_score", F.col("prediction"))
    return out.select(*df.columns, "sigmoid_score", "isotonic_score")


def compare_calibrations(df: DataFrame, label: str, scores: Mapping[str, str]) -> DataFrame:
    """Brier score, calibration error and log loss per score column."""
    parts = []
    for method, column in scores.items():
        ece = calibration_error(calibration_curve(df, label, column)).scalar()
        parts.append(df.agg(brier(label, column).alias("brier_score"), log_loss(label, column).alias("log_loss")).select(F.lit(method).alias("method"), "brier_score", ece.alias("ece"), "log_loss"))
    return reduce(lambda a, b: a.unionByName(b), parts)


def temperature_scan(df: DataFrame, label: str, score: str, low: float = 0.1, high: float = 10.0, steps: int = 100) -> DataFrame:
    """Brier score of the logit divided by each temperature; rows multiply on the map side only."""
    p = F.greatest(F.lit(1e-12), F.least(F.lit(1 - 1e-12), F.col(score)))
    grid = df.select(F.col(label).alias("y"), F.ln(p / (1 - p)).alias("z"), F.explode(F.sequence(F.lit(0), F.lit(steps - 1))).alias("i"))
    t = F.lit(low) + F.col("i") * ((high - low) / (steps - 1))
    scaled = 1 / (1 + F.exp(-F.col("z") / t))
    return grid.groupBy("i").agg(F.avg((scaled - F.col("y")) * (scaled - F.col("y"))).alias("brier_score")).withColumn("temperature", t)


# --- monitoring --------------------------------------------------------------


def recent_degradation(history: DataFrame, window: int = 10, threshold: float = 0.05) -> DataFrame:
    """Mean of the last ``window`` metric values against the ``window`` before them, per model."""
    r = F.row_number().over(W.partitionBy("model_id").orderBy(F.col("period").desc()))
    ranked = history.withColumn("_r", r)
    agg = ranked.groupBy("model_id").agg(
        F.avg(F.when(F.col("_r") <= window, F.col("value"))).alias("recent_mean"), F.avg(F.when(F.col("_r").between(window + 1, 2 * window), F.col("value"))).alias("baseline_mean"), n_rows().alias("_n"))
    drop = F.when(F.col("baseline_mean") > 0, (F.col("baseline_mean") - F.col("recent_mean")) / F.col("baseline_mean")).otherwise(0.0)
    enough = F.col("_n") >= 2 * window
    return agg.select("model_id", F.col("_n").alias("n_observations"), F.when(enough, F.col("baseline_mean")).alias("baseline_mean"), F.when(enough, F.col("recent_mean")).alias("recent_mean"),
                      F.when(enough, drop * 100).alias("degradation_pct"), (enough & (drop > threshold)).alias("is_degraded"))


def metric_trend(history: DataFrame, tolerance: float = 0.001) -> DataFrame:
    """Slope over the observations, volatility and label per model."""
    numbered = history.withColumn("_x", (F.row_number().over(W.partitionBy("model_id").orderBy("period")) - 1).cast("double"))
    agg = numbered.groupBy("model_id").agg(
        F.regr_slope("value", "_x").alias("slope"), F.stddev_pop("value").alias("volatility"), F.max_by("value", "period").alias("current_value"), F.avg("value").alias("mean_value"), n_rows().alias("n_observations"))
    return agg.withColumn("trend", F.when(F.col("n_observations") < 2, "insufficient_data").when(F.col("slope") > tolerance, "improving").when(F.col("slope") < -tolerance, "declining").otherwise("stable"))


def retraining_decisions(history: DataFrame, min_observations: int = 20, threshold: float = 0.05) -> DataFrame:
    """Models that degraded or decline, once they have enough observations."""
    d = recent_degradation(history, threshold=threshold).select("model_id", "is_degraded", "degradation_pct")
    t = metric_trend(history).select("model_id", "trend", "slope", "n_observations")
    out = d.join(t, "model_id")
    enough = F.col("n_observations") >= min_observations
    reasons = F.concat_ws("; ", F.when(F.col("is_degraded"), "performance degraded"), F.when(F.col("trend") == "declining", "performance trend is declining"))
    return out.select("model_id", (enough & (F.col("is_degraded") | (F.col("trend") == "declining"))).alias("should_retrain"), F.when(~enough, "insufficient observations").otherwise(reasons).alias("reason"), "degradation_pct", "slope", "n_observations")


def learning_metrics(predictions: DataFrame, feedback: DataFrame, window: int = 100) -> DataFrame:
    """Accuracy over each model's last feedbacks and the share of predictions with feedback."""
    joined = feedback.join(predictions.select("prediction_id", "model_id", "prediction"), "prediction_id")
    r = F.row_number().over(W.partitionBy("model_id").orderBy(F.col("feedback_ts").desc(), F.col("prediction_id").desc()))
    last = joined.withColumn("_r", r).filter(F.col("_r") <= window)
    right = (F.col("prediction") == F.col("actual")).cast("int")
    agg = last.groupBy("model_id").agg(F.avg(right).alias("accuracy"), F.sum(right).alias("n_correct"), n_rows().alias("n_feedback"))
    made = predictions.groupBy("model_id").agg(n_rows().alias("n_predictions"))
    return agg.join(made, "model_id").withColumn("feedback_rate", F.col("n_feedback") / F.col("n_predictions"))


def analyze_mistakes(predictions: DataFrame, feedback: DataFrame, features: Sequence[str]) -> DataFrame:
    """Mean and deviation of each feature over the wrong predictions of each model."""
    wrong = predictions.join(feedback.select("prediction_id", "actual"), "prediction_id").filter(F.col("prediction") != F.col("actual"))
    return unpivot_numbers(wrong, features, ["model_id"]).groupBy("model_id", "feature").agg(F.avg("value").alias("avg_value"), F.stddev_pop("value").alias("std_value"), n_rows().alias("n_occurrences"))


# Promotion gates (metric, bound, limit, critical).
QUALITY_GATES = (("accuracy", "min", 0.8, True), ("precision", "min", 0.75, True), ("recall", "min", 0.7, True), ("f1_score", "min", 0.75, True), ("auc_roc", "min", 0.8, True), ("data_drift_score", "max", 0.3, False))


def quality_gates(metrics: DataFrame, gates: Sequence[tuple[str, str, float, bool]] = QUALITY_GATES) -> DataFrame:
    """PASSED, FAILED or SKIPPED per run and gate, and whether all critical gates passed.

    ``metrics`` is long: ``run_id``, ``metric``, ``value``.
    """
    listed = F.array(*[F.struct(F.lit(m).alias("metric"), F.lit(k).alias("bound"), F.lit(v).alias("limit"), F.lit(c).alias("critical")) for m, k, v, c in gates])
    grid = metrics.select("run_id").distinct().select("run_id", F.explode(listed).alias("g")).select("run_id", "g.*")
    out = grid.join(metrics, ["run_id", "metric"], "left")
    ok = F.when(F.col("bound") == "min", F.col("value") >= F.col("limit")).otherwise(F.col("value") <= F.col("limit"))
    out = out.withColumn("result", F.when(F.col("value").isNull(), "SKIPPED").when(ok, "PASSED").otherwise("FAILED"))
    failed = F.count_if((F.col("result") == "FAILED") & F.col("critical")).over(W.partitionBy("run_id"))  # one row per gate
    return out.select("run_id", "metric", "value", "limit", "result", (failed == 0).alias("all_passed"))


def leaderboard(runs: DataFrame, metric: str, by: str = "model_type", higher_is_better: bool = True) -> DataFrame:
    """Runs ranked by a metric within their type; ``runs`` carries a ``metrics`` map."""
    v = F.col("metrics")[metric]
    order = v.desc_nulls_last() if higher_is_better else v.asc_nulls_last()
    return runs.select(by, "run_id", "start_time", v.alias("value"), F.row_number().over(W.partitionBy(by).orderBy(order, "run_id")).alias("rank"))


def best_runs(runs: DataFrame, metrics: Mapping[str, bool], by: str = "model_type") -> DataFrame:
    """Best run per type and metric; the mapping says whether higher is better."""
    parts = [leaderboard(runs, m, by, up).filter((F.col("rank") == 1) & F.col("value").isNotNull()).select(by, F.lit(m).alias("metric"), "run_id", "value") for m, up in metrics.items()]
    return reduce(lambda a, b: a.unionByName(b), parts)


def recent_history(history: DataFrame, as_of: dt.date, days: int) -> DataFrame:
    return history.filter(F.col("period") >= F.lit(as_of - dt.timedelta(days=days)))


def snapshot_drops(history: DataFrame, threshold: float = 0.1) -> DataFrame:
    """Relative drop between consecutive snapshots of each model."""
    prior = F.lag("value").over(W.partitionBy("model_id").orderBy("period"))
    out = history.withColumn("previous_metric", prior)
    drop = F.when(F.col("previous_metric") > 0, (F.col("previous_metric") - F.col("value")) / F.col("previous_metric")).otherwise(0.0)
    return out.filter(F.col("previous_metric").isNotNull()).select("model_id", "period", "previous_metric", F.col("value").alias("current_metric"), drop.alias("degradation"), (drop > threshold).alias("is_degraded"))


def compare_versions(metrics: DataFrame, a: str, b: str) -> DataFrame:
    """Metric differences between two runs."""
    side = lambda r, n: metrics.filter(F.col("run_id") == r).select("metric", F.col("value").alias(n))
    return side(a, "value_a").join(side(b, "value_b"), "metric").withColumn("difference", F.col("value_b") - F.col("value_a"))
