"""Lifetime value, churn, classifier evaluation and monitoring queries."""

import datetime as dt

from pyspark.sql import functions as F

from marketloom.operators import clv, customers
from marketloom.operators import modeling as ml
from marketloom.plans.customers import RFM_SQL
from marketloom.plans.registry import query
from marketloom.sources.commerce import AS_OF

_SUM = """WITH ps AS (SELECT customer_id, COUNT(*) AS frequency, MAX(order_date) - MIN(order_date) AS recency, DATE '2001-08-01' - MIN(order_date) AS "T", DATE '2001-08-01' - MAX(order_date) AS days_since_last,
  CAST(SUM(order_total) AS DOUBLE) / COUNT(*) AS monetary_value FROM vord GROUP BY 1),
"""
#: Parameters used where a query is checked against SQL; the fits have queries of their own.
BUY = {"r": 1.5, "alpha": 300.0, "a": 1.4, "b": 6.0}
PAY = {"p": 4.0, "q": 3.5, "gamma": 150000.0}


def summary(c):
    return clv.purchase_summary(c.orders, AS_OF)


query("l1_purchase_summary", "customer_id:i frequency:i recency:i T:i days_since_last:i monetary_value:d2", _SUM + "z AS (SELECT 1) SELECT * FROM ps")(summary)
query("l2_fit_purchase_model", "r:d3 alpha:d2 a:d3 b:d3 converged:i")(lambda c: clv.parameter_row(c.orders, clv.fit_purchase_model(summary(c))))
query("l3_fit_spend_model", "p:d3 q:d3 gamma:d1 converged:i")(lambda c: clv.parameter_row(c.orders, clv.fit_spend_model(summary(c))))
_ODDS = "CASE WHEN frequency > 1 THEN exp(ln(1.4) - ln(6.0 + frequency - 2) + (1.5 + frequency - 1) * (ln(300 + \"T\") - ln(300 + recency))) ELSE 0 END"
query("l4_probability_alive", "customer_id:i p_alive:d6", _SUM + f"z AS (SELECT 1) SELECT customer_id, 1 / (1 + {_ODDS}) AS p_alive FROM ps")(lambda c: clv.predict_alive(summary(c), BUY))
_TX = _SUM + f"""hg AS (SELECT customer_id, k, ln((1.5 + frequency - 1 + k) * (6.0 + frequency - 1 + k) / ((1.4 + 6.0 + frequency - 2 + k) * (k + 1)) * (90 / (300 + "T" + 90))) l FROM ps, range(2500) r(k)),
lp AS (SELECT customer_id, (1.5 + frequency - 1) * ln((300 + "T") / (300 + "T" + 90)) w FROM ps),
hs AS (SELECT customer_id, ANY_VALUE(exp(w)) + SUM(exp(s + w)) h FROM (SELECT customer_id, SUM(l) OVER (PARTITION BY customer_id ORDER BY k) s FROM hg) JOIN lp USING (customer_id) GROUP BY 1),
tx AS (SELECT ps.*, GREATEST(0, (1.4 + 6.0 + frequency - 2) / 0.4 * (1 - h) / (1 + {_ODDS})) AS expected_transactions FROM ps JOIN hs USING (customer_id)),
vl AS (SELECT *, 4.0 * (150000 + frequency * monetary_value) / (4.0 * frequency + 2.5) AS expected_monetary_value FROM tx), cv AS (SELECT *, expected_transactions * expected_monetary_value AS clv FROM vl),
qt AS (SELECT quantile_cont(clv, 0.25) a, quantile_cont(clv, 0.5) b, quantile_cont(clv, 0.75) c FROM cv)
"""
query("l5_expected_transactions", "customer_id:i expected_transactions:d6", _TX + "SELECT * FROM tx")(lambda c: clv.predict_transactions(summary(c), BUY, 90))
query("l6_predict_value", "customer_id:i expected_transactions:d6 expected_monetary_value:d2 clv:d2 clv_discounted:d2 clv_tier:s",
      _TX + "SELECT *, clv / pow(1.01, 3) AS clv_discounted, CASE WHEN clv <= a THEN 'Low' WHEN clv <= b THEN 'Medium-Low' WHEN clv <= c THEN 'Medium-High' ELSE 'High' END AS clv_tier FROM cv, qt")(lambda c: clv.predict_value(summary(c), BUY, PAY, 90))
END = dt.date(2000, 12, 31)
_BT = """WITH tw AS (SELECT customer_id, COUNT(*) AS frequency, DATE '2000-12-31' - MAX(order_date) AS recency, DATE '2000-12-31' - MIN(order_date) AS "T", CAST(SUM(order_total) AS DOUBLE) AS monetary FROM ord WHERE order_date < DATE '2000-12-31' GROUP BY 1 HAVING COUNT(*) >= 2),
ho AS (SELECT customer_id, CAST(SUM(order_total) AS DOUBLE) AS actual_holdout_revenue FROM ord WHERE order_date BETWEEN DATE '2000-12-31' AND DATE '2001-06-29' GROUP BY 1),
bd AS (SELECT actual_holdout_revenue y, monetary / "T" * 365 * (180 / 365) p FROM tw JOIN ho USING (customer_id)),
"""


def _window(c):
    return clv.training_window(c.orders, END)


def _holdout(c):
    return clv.holdout_revenue(c.orders, END, END + dt.timedelta(days=180))


def _naive(c):
    return _window(c).withColumn("predicted_clv", F.col("monetary") / F.col("T") * 365)


query("l7_training_window", "customer_id:i frequency:i recency:i T:i monetary:d2", _BT + "z AS (SELECT 1) SELECT * FROM tw")(_window)
query("l8_holdout_revenue", "customer_id:i actual_holdout_revenue:d2", _BT + "z AS (SELECT 1) SELECT * FROM ho")(_holdout)
query("l9_evaluate_value", "n_customers:i mae:d2 rmse:d2 mape:d4 total_actual_revenue:d2 total_predicted_revenue:d2 revenue_bias:d4 r_squared:d6",
      _BT + """z AS (SELECT 1) SELECT COUNT(*) AS n_customers, AVG(ABS(y - p)) AS mae, sqrt(AVG((y - p) * (y - p))) AS rmse, AVG(ABS((y - p) / (y + 1e-6))) * 100 AS mape, SUM(y) AS total_actual_revenue, SUM(p) AS total_predicted_revenue, (SUM(p) - SUM(y)) / SUM(y) * 100 AS revenue_bias,
  1 - AVG((y - p) * (y - p)) / VAR_POP(y) AS r_squared FROM bd""")(lambda c: clv.evaluate_value(_naive(c), _holdout(c), "predicted_clv"))
query("l9_decile_lift", "decile:i actual:d2 predicted:d2 lift:d6",
      _BT + "e AS (SELECT " + ", ".join(f"quantile_cont(p, {i / 10}) e{i}" for i in range(1, 10)) + " FROM bd), t AS (SELECT y, p, " + " + ".join(f"CASE WHEN p > e{i} THEN 1 ELSE 0 END" for i in range(1, 10))
      + " AS decile FROM bd, e) SELECT decile, SUM(y) AS actual, SUM(p) AS predicted, SUM(y) / SUM(p) AS lift FROM t GROUP BY 1")(lambda c: clv.decile_lift(_naive(c), _holdout(c), "predicted_clv"))
query("l10_backtest", "n_customers:i mae:d2 rmse:d2 revenue_bias:d4 r_squared:d6")(lambda c: clv.backtest(c.orders, END))


def value_data(c):
    rfm = customers.rfm_ntile(c.customers, c.orders, AS_OF).select("customer_id", "recency_days", "frequency", "monetary_value", "r_score", "f_score", "m_score")
    return clv.value_features(rfm, c.orders, AS_OF)


query("l11_value_features", "customer_id:i recency_days:i frequency:i monetary_value:d2 r_score:i f_score:i m_score:i historical_clv:d2 future_clv_90d:d2 future_clv_180d:d2 future_clv_365d:d2 order_mean:d2 order_std:d2 order_min:d2 order_max:d2 orders_before_year:i",
      RFM_SQL.replace("WITH b AS", "WITH f AS (SELECT customer_id, COALESCE(SUM(order_total) FILTER (order_date <= DATE '2000-08-01'), 0) AS historical_clv, COALESCE(SUM(order_total) FILTER (order_date > DATE '2001-05-03'), 0) AS future_clv_90d, COALESCE(SUM(order_total) FILTER (order_date > DATE '2001-02-02'), 0) AS future_clv_180d, "
      "COALESCE(SUM(order_total) FILTER (order_date > DATE '2000-08-01'), 0) AS future_clv_365d, AVG(CAST(order_total AS DOUBLE)) AS order_mean, COALESCE(STDDEV_SAMP(CAST(order_total AS DOUBLE)), 0) AS order_std, MIN(order_total) AS order_min, MAX(order_total) AS order_max, COUNT(*) FILTER (order_date <= DATE '2000-08-01') AS orders_before_year FROM ord GROUP BY 1), b AS", 1).replace(
          "AS rfm_segment FROM s", "AS rfm_segment FROM s JOIN f USING (customer_id)"))(value_data)
query("l12_train_value_model", "model_type:s target:s train_mae:d2 train_rmse:d2 train_r2:d4 test_mae:d2 test_rmse:d2 test_r2:d4 cv_mae:d2")(lambda c: clv.train_value_model(value_data(c))[1])
query("l13_compare_value_models", "model_type:s test_mae:d2 test_r2:d4 rank:i")(lambda c: clv.compare_value_models(value_data(c)))


def _learned(c):
    data = value_data(c)
    return clv.predict_value_model(clv.train_value_model(data)[0], data)


query("l14_predict_value_model", "customer_id:i predicted_clv:d2")(_learned)
query("l15_compare_approaches", "customer_id:i probabilistic_clv:d2 ml_clv:d2 historical_clv:d2 probabilistic_vs_historical:d4 ml_vs_historical:d4 ml_vs_probabilistic:d4 approach_agreement:i",
      _TX + """, h AS (SELECT customer_id, CAST(SUM(order_total) AS DOUBLE) hv FROM vord WHERE order_date <= DATE '2000-08-01' GROUP BY 1), m AS (SELECT customer_id, CAST(SUM(order_total) AS DOUBLE) m FROM vord WHERE order_date > DATE '2000-08-01' GROUP BY 1)
SELECT customer_id, clv AS probabilistic_clv, m AS ml_clv, hv AS historical_clv, clv / hv AS probabilistic_vs_historical, m / hv AS ml_vs_historical, m / NULLIF(clv, 0) AS ml_vs_probabilistic, CASE WHEN (clv > hv) = (m > hv) THEN 1 ELSE 0 END AS approach_agreement FROM cv JOIN h USING (customer_id) JOIN m USING (customer_id)""")(
    lambda c: clv.compare_approaches(
        clv.predict_value(summary(c), BUY, PAY, 90).select("customer_id", F.col("clv").alias("value")),
        c.valid_orders.filter("order_date > DATE '2000-08-01'").groupBy("customer_id").agg(F.sum("order_total").cast("double").alias("value")),
        c.valid_orders.filter("order_date <= DATE '2000-08-01'").groupBy("customer_id").agg(F.sum("order_total").cast("double").alias("value"))))


def _fitted(c):
    bought = summary(c)
    return bought, clv.fit_purchase_model(bought), clv.fit_spend_model(bought)


def _fitted_alive(c):
    bought = summary(c)
    bought_by = clv.fit_purchase_model(bought)
    return clv.predict_alive(bought, bought_by).withColumn("converged", F.lit(int(bought_by["converged"])))


def _fitted_value(c):
    bought, bought_by, spent = _fitted(c)
    return clv.predict_value(bought, bought_by, spent, 90).withColumn("converged", F.lit(int(min(bought_by["converged"], spent["converged"]))))


query("l4_fitted_alive", "customer_id:i p_alive:d4 converged:i")(_fitted_alive)
query("l6_fitted_value", "customer_id:i clv:d2 converged:i")(_fitted_value)


def _estimates(c):
    """The fitted models over the same 365 days, for every customer with a purchase summary."""
    expected, learned = clv.predict_value(*_fitted(c), 365), _learned(c)
    return clv.compare_approaches(*(df.select("customer_id", F.col(name).alias("value")) for df, name in ((expected, "clv"), (learned, "predicted_clv"), (learned, "historical_clv"))))


#: The SQL of l15_compare_approaches checks the arithmetic with real later revenue in place of a model; this one compares the models.
query("l15_compare_estimates", "customer_id:i probabilistic_clv:d2 ml_clv:d2 historical_clv:d2 probabilistic_vs_historical:d4 ml_vs_historical:d4 ml_vs_probabilistic:d4 approach_agreement:i")(_estimates)

# --- churn -------------------------------------------------------------------

SEEN = dt.date(2001, 5, 3)
_F1 = """WITH fo AS (SELECT customer_id, COUNT(*) n, CAST(SUM(order_total) AS DOUBLE) sp, CAST(SUM(discount_amount) AS DOUBLE) di, COUNT(*) FILTER (order_status = 'Returned') rt, MAX(order_date) l FROM ord WHERE order_date >= DATE '2000-11-04' AND order_date < DATE '2001-05-03' GROUP BY 1),
fr AS (SELECT customer_id, AVG(rating) a, COUNT(*) n FROM rev WHERE review_date >= DATE '2000-11-04' AND review_date < DATE '2001-05-03' GROUP BY 1),
ft AS (SELECT c.customer_id, c.signup_date, COALESCE(fo.n, 0) AS total_orders, COALESCE(sp, 0) AS total_spend, COALESCE(sp / fo.n, 0) AS avg_order_value, COALESCE(di / fo.n, 0) AS avg_discount_amount, COALESCE(rt / fo.n, 0) AS return_rate, 0 AS sessions_count,
  COALESCE(fr.a, 0) AS avg_review_rating, COALESCE(fr.n, 0) AS review_count, COALESCE(DATE '2001-05-03' - l, 180) AS days_since_last_order, DATE '2001-05-03' - signup_date AS customer_tenure_days FROM cust c LEFT JOIN fo USING (customer_id) LEFT JOIN fr USING (customer_id)),
tg AS (SELECT c.customer_id, CASE WHEN COUNT(*) FILTER (order_date < DATE '2001-05-03') > 0 AND COUNT(*) FILTER (order_date BETWEEN DATE '2001-05-03' AND DATE '2001-08-01') = 0 THEN 1 ELSE 0 END AS churn_label_90d FROM cust c LEFT JOIN ord o ON o.customer_id = c.customer_id GROUP BY 1),
ds AS (SELECT * FROM ft JOIN tg USING (customer_id) WHERE total_orders >= 1),
"""
_F_SPEC = "customer_id:i total_orders:i total_spend:d2 avg_order_value:d2 avg_discount_amount:d4 return_rate:d4 sessions_count:i avg_review_rating:d4 review_count:i days_since_last_order:i customer_tenure_days:i"


def observed(c):
    return ml.observed_features(c.customers.select("customer_id", "signup_date", "customer_segment", "gender", "state"), c.orders, c.sessions, c.reviews, SEEN)


def dataset(c):
    return ml.churn_dataset(observed(c), ml.churn_target(c.customers_base, c.orders, SEEN))


query("h1_observed_features", _F_SPEC, _F1 + "z AS (SELECT 1) SELECT * FROM ft")(observed)
query("h2_churn_target", "customer_id:i churn_label_90d:i", _F1 + "z AS (SELECT 1) SELECT * FROM tg")(lambda c: ml.churn_target(c.customers_base, c.orders, SEEN))
query("h3_churn_dataset", _F_SPEC + " churn_label_90d:i", _F1 + "z AS (SELECT 1) SELECT * FROM ds")(dataset)
query("h4_temporal_splits", "customer_id:i signup_date:t split:s",
      _F1 + "k AS (SELECT *, ROW_NUMBER() OVER (ORDER BY signup_date, customer_id) r, COUNT(*) OVER () n FROM ds) SELECT *, CASE WHEN r <= floor(n * 0.6 + 1e-9) THEN 'train' WHEN r <= floor(n * 0.8 + 1e-9) THEN 'validation' ELSE 'test' END AS split FROM k")(lambda c: ml.temporal_splits(dataset(c)))


def churn_rows(c):
    return customers.churn_features_cutoff(c.customers, c.orders, c.order_items, c.reviews, c.sessions, AS_OF)


_METRICS = "tp:i tn:i fp:i fn:i accuracy:d4 precision:d4 recall:d4 f1_score:d4 auc_roc:d4"
query("h5_train_churn", _METRICS)(lambda c: ml.train_churn(churn_rows(c))[1])
query("h6_churn_scores", "customer_id:i churn_probability:d4 risk_tier:s risk_score:i")(lambda c: ml.train_churn(churn_rows(c))[0])
_HX = """WITH hb AS (SELECT customer_id, DATE '2001-08-01' - MAX(order_date) AS d, COUNT(*) FILTER (order_status = 'Returned') / COUNT(*) AS rt, COUNT(*) AS n, CAST(SUM(order_total) AS DOUBLE) AS sp, CASE WHEN MAX(order_date) < DATE '2001-05-03' THEN 1 ELSE 0 END AS label FROM ord GROUP BY 1),
sp AS (SELECT MIN(d) d0, MAX(d) d1, MIN(rt) r0, MAX(rt) r1, MIN(n) n0, MAX(n) n1, MIN(sp) s0, MAX(sp) s1 FROM hb),
hs AS (SELECT customer_id, label, d, rt, n, sp, LEAST(1, GREATEST(0, ((d - d0) / (d1 - d0 + 1e-9) + (rt - r0) / (r1 - r0 + 1e-9) + 1 - (n - n0) / (n1 - n0 + 1e-9) + 1 - (sp - s0) / (s1 - s0 + 1e-9)) / 4)) AS churn_probability FROM hb, sp),
hk AS (SELECT *, CASE WHEN churn_probability <= 0.2 THEN 'Low' WHEN churn_probability <= 0.5 THEN 'Medium' ELSE 'High' END AS risk_tier, ROUND(churn_probability * 1000) AS risk_score FROM hs),
"""


def heuristic(c):
    per = c.orders.groupBy("customer_id").agg(
        F.datediff(F.lit(AS_OF), F.max("order_date")).alias("days_since_last_order"), (F.count_if(F.col("order_status") == "Returned") / F.count("*")).alias("return_rate"), F.count("*").alias("total_orders"),
        F.sum("order_total").cast("double").alias("total_spend"), (F.max("order_date") < F.lit(SEEN)).cast("int").alias("label"))
    return ml.heuristic_scores(per)


query("h7_heuristic_scores", "customer_id:i churn_probability:d6 risk_tier:s risk_score:i", _HX + "z AS (SELECT 1) SELECT * FROM hk")(heuristic)
_DRIVE = ("days_since_last_order", "return_rate", "total_orders", "total_spend")
query("h8_risk_drivers", "customer_id:i risk_tier:s top_risk_drivers:s",
      _HX + "lm AS (SELECT quantile_cont(d, 0.5) a, quantile_cont(rt, 0.5) b, quantile_cont(n, 0.5) c, quantile_cont(sp, 0.5) e FROM hk WHERE risk_tier = 'Low' OR (SELECT COUNT(*) < 5 FROM hk WHERE risk_tier = 'Low') AND churn_probability <= (SELECT quantile_cont(churn_probability, 0.3) FROM hk)), "
      "dl AS (SELECT customer_id, 'days_since_last_order' f, (d - a) / (ABS(a) + 1e-9) v FROM hk, lm UNION ALL SELECT customer_id, 'return_rate', (rt - b) / (ABS(b) + 1e-9) FROM hk, lm UNION ALL SELECT customer_id, 'total_orders', (n - c) / (ABS(c) + 1e-9) FROM hk, lm UNION ALL SELECT customer_id, 'total_spend', (sp - e) / (ABS(e) + 1e-9) FROM hk, lm), "
      "tp AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY customer_id ORDER BY v DESC, f DESC) k FROM dl), tt AS (SELECT customer_id, string_agg(f || ' +' || CAST(CAST(floor(v * 100) AS BIGINT) AS VARCHAR) || '%', '; ' ORDER BY k) AS t FROM tp WHERE k <= 3 AND v > 0.15 GROUP BY 1) "
      "SELECT hk.customer_id, risk_tier, COALESCE(t, 'No unusual drivers') AS top_risk_drivers FROM hk LEFT JOIN tt USING (customer_id)")(lambda c: ml.risk_drivers(heuristic(c), _DRIVE))


def actions(c):
    tiers = customers.clv_simple(c.customers_base, c.orders, c.order_items, c.products).select("customer_id", F.col("customer_value_tier").alias("clv_tier"))
    return ml.recommended_actions(heuristic(c).join(tiers, "customer_id"))


_HACT = """, ha AS (SELECT hk.*, customer_value_tier AS clv_tier, CASE WHEN risk_tier = 'High' AND customer_value_tier IN ('High', 'Medium-High') THEN 'Priority: 1:1 outreach + exclusive loyalty discount (15%+ 3mo)' WHEN risk_tier = 'High' THEN 'Send targeted win-back coupon (10% off) + personalization campaign'
  WHEN risk_tier = 'Medium' THEN 'Nurture: personalized product recommendations + limited-time free shipping' ELSE 'Maintain: periodic newsletter with curated deals' END AS recommended_action FROM hk JOIN clv USING (customer_id)) """


def _with_clv(body):
    from marketloom.plans.customers import CLV_SQL

    return _HX.rstrip().rstrip(",") + ", " + CLV_SQL.strip()[5:].replace("WITH ", "", 1) + body


query("h9_recommended_actions", "customer_id:i risk_tier:s clv_tier:s recommended_action:s", _with_clv(_HACT + "SELECT * FROM ha"))(actions)

# --- classifier evaluation ---------------------------------------------------


def _prepared(c):
    return ml.prepared(churn_rows(c), ml.NUMERIC_FEATURES, ml.CATEGORICAL_FEATURES, "churn_label_90d")


query("n1_preprocess", "customer_id:i label:i is_test:b n_features:i")(lambda c: _prepared(c).withColumn("n_features", F.size(ml.vector_to_array("features"))))
_CM = "cm AS (SELECT COUNT(*) FILTER (label = 1 AND churn_probability >= 0.5) tp, COUNT(*) FILTER (label = 0 AND churn_probability < 0.5) tn, COUNT(*) FILTER (label = 0 AND churn_probability >= 0.5) fp, COUNT(*) FILTER (label = 1 AND churn_probability < 0.5) fn FROM hk), me AS (SELECT *, (tp + tn) / (tp + tn + fp + fn) AS accuracy, COALESCE(tp / NULLIF(tp + fp, 0), 0) AS \"precision\", COALESCE(tp / NULLIF(tp + fn, 0), 0) AS recall FROM cm)"
query("n2_evaluate_model", _METRICS,
      _HX + _CM + ", rk AS (SELECT label, RANK() OVER (ORDER BY churn_probability) + (COUNT(*) OVER (PARTITION BY churn_probability) - 1) / 2 AS r FROM hk), au AS (SELECT (SUM(r) FILTER (label = 1) - SUM(label) * (SUM(label) + 1) / 2) / (SUM(label) * (COUNT(*) - SUM(label))) AS auc_roc FROM rk) "
      "SELECT *, COALESCE(2 * \"precision\" * recall / NULLIF(\"precision\" + recall, 0), 0) AS f1_score FROM me, au")(lambda c: ml.evaluate_scores(heuristic(c), "label", "churn_probability"))
query("n3_grid_search", "model_type:s parameters:s accuracy:d4 is_best:b")(lambda c: ml.tune(_prepared(c)))
query("n4_compare_classifiers", "model_type:s accuracy:d4 precision:d4 recall:d4 f1_score:d4 auc_roc:d4")(lambda c: ml.compare_classifiers(_prepared(c)))
query("n18_train_logistic", "model_type:s accuracy:d4 f1_score:d4 auc_roc:d4")(lambda c: ml.compare_classifiers(_prepared(c), ["logistic"]))
_TC = "tc AS (SELECT i / 99 AS threshold, COUNT(*) FILTER (label = 1 AND churn_probability >= i / 99) tp, COUNT(*) FILTER (label = 0 AND churn_probability < i / 99) tn, COUNT(*) FILTER (label = 0 AND churn_probability >= i / 99) fp, COUNT(*) FILTER (label = 1 AND churn_probability < i / 99) fn FROM hk, range(100) r(i) GROUP BY i), tk AS (SELECT *, -100 * tp + 10 * fp + 50 * fn AS cost FROM tc)"
query("n5_optimal_threshold", "optimal_threshold:d6 min_cost:d2 tp:i tn:i fp:i fn:i", _HX + _TC + " SELECT *, threshold AS optimal_threshold, cost AS min_cost FROM tk ORDER BY cost, threshold LIMIT 1")(lambda c: ml.optimal_threshold(heuristic(c), "label", "churn_probability"))
query("n6_compare_thresholds", "threshold:d2 tp:i tn:i fp:i fn:i cost:d2",
      _HX + "t9 AS (SELECT i / 10 AS threshold, COUNT(*) FILTER (label = 1 AND churn_probability >= i / 10) tp, COUNT(*) FILTER (label = 0 AND churn_probability < i / 10) tn, COUNT(*) FILTER (label = 0 AND churn_probability >= i / 10) fp, COUNT(*) FILTER (label = 1 AND churn_probability < i / 10) fn FROM hk, range(1, 10) r(i) GROUP BY i) SELECT *, -100 * tp + 10 * fp + 50 * fn AS cost FROM t9")(
    lambda c: ml.thresholds_at(heuristic(c), "label", "churn_probability", [i / 10 for i in range(1, 10)]))
query("n7_cost_benefit", "optimal_threshold:d6 net_benefit:d2 tp:i tn:i fp:i fn:i", _HX + _TC + " SELECT *, threshold AS optimal_threshold, -cost AS net_benefit FROM tk ORDER BY cost, threshold LIMIT 1")(lambda c: ml.cost_benefit(heuristic(c), "label", "churn_probability"))
query("n8_cost_sensitive_evaluation", "tp:i tn:i fp:i fn:i accuracy:d6 precision:d6 recall:d6 cost:d2", _HX + _CM + " SELECT *, -100 * tp + 10 * fp + 50 * fn AS cost FROM me")(
    lambda c: ml.confusion_metrics(ml.confusion(heuristic(c), "label", "churn_probability")).withColumn("cost", ml.expected_cost()))


def _cost_model(c):
    data = ml.cost_weights(_prepared(c), "label", 10, 50)
    model = ml.fit_cached(ml.classifier("logistic", weightCol="weight"), data.filter("NOT is_test").select("features", "label", "weight"))
    return ml.evaluate_scores(model.transform(data.filter("is_test")).withColumn("score", ml.probability()), "label", "score")


query("n9_cost_weighted_model", _METRICS)(_cost_model)
_CC = "bn AS (SELECT " + " + ".join(f"CASE WHEN churn_probability > {i / 10} THEN 1 ELSE 0 END" for i in range(1, 10)) + " AS bin, label, churn_probability p FROM hk), cc AS (SELECT bin, AVG(label) AS fraction_of_positives, AVG(p) AS mean_predicted_value, COUNT(*) AS n FROM bn GROUP BY 1)"
query("n10_calibration_curve", "bin:i fraction_of_positives:d6 mean_predicted_value:d6 n:i", _HX + _CC + " SELECT * FROM cc")(lambda c: ml.calibration_curve(heuristic(c), "label", "churn_probability"))
query("n11_brier_score", "brier_score:d6", _HX + "z AS (SELECT 1) SELECT AVG((churn_probability - label) * (churn_probability - label)) AS brier_score FROM hk")(lambda c: heuristic(c).agg(ml.brier("label", "churn_probability").alias("brier_score")))
query("n12_calibration_error", "ece:d6", _HX + _CC + " SELECT SUM(n * ABS(fraction_of_positives - mean_predicted_value)) / SUM(n) AS ece FROM cc")(lambda c: ml.calibration_error(ml.calibration_curve(heuristic(c), "label", "churn_probability")))


def _calibrated(c):
    rows = heuristic(c).withColumn("half", F.pmod(F.xxhash64("customer_id"), F.lit(2)))
    return ml.calibrate(rows.filter("half = 0"), rows.filter("half = 1"), "label", "churn_probability")


query("n13_calibrated_scores", "customer_id:i churn_probability:d6 sigmoid_score:d4 isotonic_score:d4")(_calibrated)
query("n17_compare_calibrations", "method:s brier_score:d6 ece:d6 log_loss:d6")(
    lambda c: ml.compare_calibrations(_calibrated(c), "label", {"uncalibrated": "churn_probability", "sigmoid": "sigmoid_score", "isotonic": "isotonic_score"}))
query("n17_raw_score_losses", "method:s brier_score:d6 ece:d6 log_loss:d6",
      _HX + _CC + ", ce AS (SELECT SUM(n * ABS(fraction_of_positives - mean_predicted_value)) / SUM(n) AS ece FROM cc), pp AS (SELECT label, churn_probability q, GREATEST(1e-15, LEAST(1 - 1e-15, churn_probability)) p FROM hk) SELECT 'uncalibrated' AS method, AVG((q - label) * (q - label)) AS brier_score, ANY_VALUE(ece) AS ece, AVG(CASE WHEN label = 1 THEN -ln(p) ELSE -ln(1 - p) END) AS log_loss FROM pp, ce")(
    lambda c: ml.compare_calibrations(heuristic(c), "label", {"uncalibrated": "churn_probability"}))
query("n14_temperature_scan", "i:i temperature:d4 brier_score:d6",
      _HX + "lz AS (SELECT label, ln(p / (1 - p)) z FROM (SELECT label, GREATEST(1e-12, LEAST(1 - 1e-12, churn_probability)) p FROM hk)), tt AS (SELECT i, 0.1 + i * (9.9 / 99) AS temperature FROM range(100) r(i)) SELECT i, temperature, AVG(pow(1 / (1 + exp(-z / temperature)) - label, 2)) AS brier_score FROM lz, tt GROUP BY 1, 2")(
    lambda c: ml.temperature_scan(heuristic(c), "label", "churn_probability"))


def _importance(c):
    rows = ml.as_double(churn_rows(c), ml.NUMERIC_FEATURES)
    data = ml.VectorAssembler(inputCols=list(ml.NUMERIC_FEATURES), outputCol="features").transform(rows.withColumn("label", F.col("churn_label_90d").cast("double")))
    return ml.importances(ml.fit_cached(ml.classifier("random_forest"), data.select("features", "label")), ml.NUMERIC_FEATURES, rows)


query("n15_feature_importance", "feature:s importance:d6")(_importance)
query("n16_expected_cost", "expected_cost:d2", _HX + _CM + " SELECT -100 * tp + 10 * fp + 50 * fn AS expected_cost FROM cm")(lambda c: ml.confusion(heuristic(c), "label", "churn_probability").withColumn("expected_cost", ml.expected_cost()))

# --- monitoring --------------------------------------------------------------


def predictions(c):
    """One logged prediction per order and store model: will the order be delivered?"""
    return c.orders.select(F.col("order_id").alias("prediction_id"), F.concat(F.lit("store-"), F.col("store_id")).alias("model_id"), F.col("order_date").alias("prediction_ts"),
                           (F.col("order_total") > 250000).cast("int").alias("prediction"), "order_total", "discount_amount")


def feedback(c):
    """The outcome arrives some days later for four orders in five."""
    return c.orders.filter("order_id % 5 <> 0").select(F.col("order_id").alias("prediction_id"), F.expr("order_date + CAST(3 + order_id % 20 AS INT)").alias("feedback_ts"), (F.col("order_status") == "Delivered").cast("int").alias("actual"))


def history(c):
    joined = predictions(c).join(feedback(c), "prediction_id")
    return joined.groupBy("model_id", F.trunc("feedback_ts", "month").alias("period")).agg(F.avg((F.col("prediction") == F.col("actual")).cast("double")).alias("value"), F.count("*").alias("n"))


_MO = """WITH pl AS (SELECT order_id AS prediction_id, 'store-' || store_id AS model_id, order_date AS prediction_ts, CASE WHEN order_total > 250000 THEN 1 ELSE 0 END AS prediction, order_total, discount_amount FROM ord),
fl AS (SELECT order_id AS prediction_id, order_date + CAST(3 + order_id % 20 AS INT) AS feedback_ts, CASE WHEN order_status = 'Delivered' THEN 1 ELSE 0 END AS actual FROM ord WHERE order_id % 5 <> 0),
jo AS (SELECT * FROM pl JOIN fl USING (prediction_id)), hi AS (SELECT model_id, date_trunc('month', feedback_ts) AS period, AVG(CASE WHEN prediction = actual THEN 1 ELSE 0 END) AS value, COUNT(*) n FROM jo GROUP BY 1, 2),
hr AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY model_id ORDER BY period DESC) r, ROW_NUMBER() OVER (PARTITION BY model_id ORDER BY period) - 1 x, COUNT(*) OVER (PARTITION BY model_id) c FROM hi),
dg AS (SELECT model_id, ANY_VALUE(c) AS n_observations, AVG(value) FILTER (r <= 10) AS recent_mean, AVG(value) FILTER (r BETWEEN 11 AND 20) AS baseline_mean FROM hr GROUP BY 1), dh AS (SELECT *, (baseline_mean - recent_mean) / baseline_mean * 100 AS degradation_pct, (baseline_mean - recent_mean) / baseline_mean > 0.05 AS is_degraded FROM dg),
mt AS (SELECT model_id, REGR_SLOPE(value, x) AS slope, STDDEV_POP(value) AS volatility, max_by(value, period) AS current_value, AVG(value) AS mean_value, COUNT(*) AS n FROM hr GROUP BY 1), mu AS (SELECT *, n AS n_observations, CASE WHEN slope > 0.001 THEN 'improving' WHEN slope < -0.001 THEN 'declining' ELSE 'stable' END AS trend FROM mt),
"""
query("mo1_recent_degradation", "model_id:s n_observations:i baseline_mean:d6 recent_mean:d6 degradation_pct:d4 is_degraded:b", _MO + "z AS (SELECT 1) SELECT * FROM dh")(lambda c: ml.recent_degradation(history(c)))
query("mo2_metric_trend", "model_id:s slope:d6 volatility:d6 current_value:d6 mean_value:d6 n_observations:i trend:s", _MO + "z AS (SELECT 1) SELECT * FROM mu")(lambda c: ml.metric_trend(history(c)))
query("mo3_retraining_decisions", "model_id:s should_retrain:b reason:s n_observations:i",
      _MO + "z AS (SELECT 1) SELECT model_id, mu.n_observations, mu.n_observations >= 20 AND (is_degraded OR trend = 'declining') AS should_retrain, concat_ws('; ', CASE WHEN is_degraded THEN 'performance degraded' END, CASE WHEN trend = 'declining' THEN 'performance trend is declining' END) AS reason FROM dh JOIN mu USING (model_id)")(
    lambda c: ml.retraining_decisions(history(c)))
query("mo4_learning_metrics", "model_id:s accuracy:d6 n_correct:i n_feedback:i n_predictions:i feedback_rate:d6",
      _MO + "ls AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY model_id ORDER BY feedback_ts DESC, prediction_id DESC) r FROM jo), la AS (SELECT model_id, AVG(CASE WHEN prediction = actual THEN 1 ELSE 0 END) AS accuracy, COUNT(*) FILTER (prediction = actual) AS n_correct, COUNT(*) AS n_feedback FROM ls WHERE r <= 100 GROUP BY 1), pn AS (SELECT model_id, COUNT(*) AS n_predictions FROM pl GROUP BY 1) "
      "SELECT *, n_feedback / n_predictions AS feedback_rate FROM la JOIN pn USING (model_id)")(lambda c: ml.learning_metrics(predictions(c), feedback(c)))
query("mo5_analyze_mistakes", "model_id:s feature:s avg_value:d2 std_value:d2 n_occurrences:i",
      _MO + "w AS (SELECT * FROM jo WHERE prediction <> actual) SELECT model_id, 'order_total' AS feature, AVG(CAST(order_total AS DOUBLE)) AS avg_value, STDDEV_POP(CAST(order_total AS DOUBLE)) AS std_value, COUNT(*) AS n_occurrences FROM w GROUP BY 1 UNION ALL SELECT model_id, 'discount_amount', AVG(CAST(discount_amount AS DOUBLE)), STDDEV_POP(CAST(discount_amount AS DOUBLE)), COUNT(*) FROM w GROUP BY 1")(
    lambda c: ml.analyze_mistakes(predictions(c), feedback(c), ["order_total", "discount_amount"]))


def run_metrics(c):
    """Confusion metrics of each store model and year as one run."""
    joined = predictions(c).join(feedback(c), "prediction_id").withColumn("run_id", F.concat_ws("/", "model_id", F.year("feedback_ts").cast("string")))
    m = ml.confusion_metrics(ml.confusion(joined, "actual", "prediction", 0.5, ["run_id", "model_id"]))
    cols = ("accuracy", "precision", "recall", "f1_score")
    return m.select("run_id", "model_id", F.explode(F.array(*[F.struct(F.lit(x).alias("metric"), F.col(x).alias("value")) for x in cols])).alias("r")).select("run_id", "model_id", "r.*")


def runs(c):
    return run_metrics(c).groupBy("run_id", "model_id").agg(F.map_from_entries(F.collect_list(F.struct("metric", "value"))).alias("metrics")).select(
        "run_id", F.col("model_id").alias("model_type"), F.to_date(F.concat(F.split_part("run_id", F.lit("/"), F.lit(2)), F.lit("-01-01"))).alias("start_time"), "metrics")


_RUN = _MO + """cf AS (SELECT model_id || '/' || year(feedback_ts) AS run_id, model_id, COUNT(*) FILTER (actual = 1 AND prediction = 1) tp, COUNT(*) FILTER (actual = 0 AND prediction = 0) tn, COUNT(*) FILTER (actual = 0 AND prediction = 1) fp, COUNT(*) FILTER (actual = 1 AND prediction = 0) fn FROM jo GROUP BY 1, 2),
rm AS (SELECT run_id, model_id, (tp + tn) / (tp + tn + fp + fn) AS a, COALESCE(tp / NULLIF(tp + fp, 0), 0) AS p, COALESCE(tp / NULLIF(tp + fn, 0), 0) AS r FROM cf), rn AS (SELECT *, COALESCE(2 * p * r / NULLIF(p + r, 0), 0) AS f FROM rm),
rl AS (SELECT run_id, model_id, 'accuracy' AS metric, a AS value FROM rn UNION ALL SELECT run_id, model_id, 'precision', p FROM rn UNION ALL SELECT run_id, model_id, 'recall', r FROM rn UNION ALL SELECT run_id, model_id, 'f1_score', f FROM rn)
"""
query("mo6_quality_gates", "run_id:s metric:s value:d6 limit_value:d2 result:s all_passed:b",
      _RUN + ", gt AS (SELECT * FROM (VALUES ('accuracy', 0.8, TRUE), ('precision', 0.75, TRUE), ('recall', 0.7, TRUE), ('f1_score', 0.75, TRUE), ('auc_roc', 0.8, TRUE), ('data_drift_score', 0.3, FALSE)) v(metric, limit_value, critical)), "
      "gr AS (SELECT x.run_id, gt.metric, value, limit_value, critical, CASE WHEN value IS NULL THEN 'SKIPPED' WHEN value >= limit_value THEN 'PASSED' ELSE 'FAILED' END AS result FROM (SELECT DISTINCT run_id FROM rl) x CROSS JOIN gt LEFT JOIN rl ON rl.run_id = x.run_id AND rl.metric = gt.metric) SELECT *, COUNT(*) FILTER (result = 'FAILED' AND critical) OVER (PARTITION BY run_id) = 0 AS all_passed FROM gr")(
    lambda c: ml.quality_gates(run_metrics(c).select("run_id", "metric", "value")).withColumnRenamed("limit", "limit_value"))
query("mo7_leaderboard", "model_type:s run_id:s start_time:t value:d6 rank:i", _RUN + " SELECT model_id AS model_type, run_id, CAST(split_part(run_id, '/', 2) || '-01-01' AS DATE) AS start_time, f AS value, ROW_NUMBER() OVER (PARTITION BY model_id ORDER BY f DESC, run_id) AS rank FROM rn")(lambda c: ml.leaderboard(runs(c), "f1_score"))
query("mo8_recent_history", "model_id:s period:t value:d6 n:i", _MO + "z AS (SELECT 1) SELECT * FROM hi WHERE period >= DATE '2001-02-02'")(lambda c: ml.recent_history(history(c), AS_OF, 180))
query("mo9_snapshot_drops", "model_id:s period:t previous_metric:d6 current_metric:d6 degradation:d6 is_degraded:b",
      _MO + "lg AS (SELECT *, LAG(value) OVER (PARTITION BY model_id ORDER BY period) p FROM hi) SELECT model_id, period, p AS previous_metric, value AS current_metric, CASE WHEN p > 0 THEN (p - value) / p ELSE 0 END AS degradation, COALESCE((p - value) / NULLIF(p, 0) > 0.1, FALSE) AS is_degraded FROM lg WHERE p IS NOT NULL")(lambda c: ml.snapshot_drops(history(c)))
query("mo10_best_runs", "model_type:s metric:s run_id:s value:d6", _RUN + " SELECT model_id AS model_type, metric, run_id, value FROM rl WHERE metric IN ('f1_score', 'accuracy') QUALIFY ROW_NUMBER() OVER (PARTITION BY model_id, metric ORDER BY value DESC, run_id) = 1")(lambda c: ml.best_runs(runs(c), {"f1_score": True, "accuracy": True}))
query("mo11_compare_versions", "metric:s value_a:d6 value_b:d6 difference:d6", _RUN + " SELECT x.metric, x.value AS value_a, y.value AS value_b, y.value - x.value AS difference FROM rl x JOIN rl y ON x.metric = y.metric WHERE x.run_id = 'store-0/1999' AND y.run_id = 'store-0/2000'")(
    lambda c: ml.compare_versions(run_metrics(c), "store-0/1999", "store-0/2000"))
