"""Feature store, lineage, decisions, serving, dashboards and streaming queries."""

import datetime as dt

from pyspark.sql import functions as F

from marketloom.operators import customers, decisions, features, graph, inventory, marketing, quality, sales
from marketloom.operators import series as ts
from marketloom.plans import customers as cust_plans
from marketloom.plans import models as model_plans
from marketloom.plans import products as prod_plans
from marketloom.plans import series as series_plans
from marketloom.plans.registry import query
from marketloom.sources import io
from marketloom.sources.commerce import AS_OF
from marketloom.streaming import incremental

# --- feature store -----------------------------------------------------------


def monthly_features(c):
    """Spend and orders of each customer per month, stamped with the month."""
    return c.orders.groupBy("customer_id", F.trunc("order_date", "month").alias("feature_ts")).agg(F.sum("order_total").cast("double").alias("spend"), F.count("*").alias("orders"))


_MF = "WITH mf AS (SELECT customer_id, date_trunc('month', order_date) AS feature_ts, CAST(SUM(order_total) AS DOUBLE) AS spend, COUNT(*) AS orders FROM ord GROUP BY 1, 2)"
query("s1_feature_as_of", "customer_id:i feature_ts:t spend:d2 orders:i", _MF + " SELECT * FROM mf WHERE feature_ts <= DATE '2000-06-30' QUALIFY ROW_NUMBER() OVER (PARTITION BY customer_id ORDER BY feature_ts DESC) = 1")(
    lambda c: features.feature_as_of(monthly_features(c), "customer_id", "feature_ts", dt.date(2000, 6, 30)))


def _sets(c):
    orders = c.orders.groupBy("customer_id").agg(F.count("*").alias("total"))
    visits = c.sessions.groupBy("customer_id").agg(F.count("*").alias("total"))
    return features.feature_set({"orders": orders, "sessions": visits}, "customer_id")


_FS = "SELECT COALESCE(o.customer_id, s.customer_id) AS customer_id, o.n AS orders_total, s.n AS sessions_total FROM (SELECT customer_id, COUNT(*) n FROM ord GROUP BY 1) o FULL JOIN (SELECT customer_id, COUNT(*) n FROM sess GROUP BY 1) s ON s.customer_id = o.customer_id"
query("s2_feature_set", "customer_id:i orders_total:i sessions_total:i", _FS)(_sets)
query("s3_training_dataset", "customer_id:i orders_total:i sessions_total:i target:i", f"SELECT f.*, t.target FROM ({_FS}) f JOIN (SELECT customer_id, COUNT(*) AS target FROM ret JOIN ord USING (order_id) GROUP BY 1) t USING (customer_id)")(
    lambda c: features.training_dataset(_sets(c), c.returns.join(c.orders.select("order_id", "customer_id"), "order_id").groupBy("customer_id").agg(F.count("*").alias("target")), "customer_id"))
query("s3_point_in_time", "customer_id:i order_id:i order_date:t spend:d2 orders:i",
      _MF + " SELECT o.customer_id, o.order_id, o.order_date, mf.spend, mf.orders FROM ord o LEFT JOIN mf ON mf.customer_id = o.customer_id AND mf.feature_ts <= o.order_date QUALIFY ROW_NUMBER() OVER (PARTITION BY o.order_id ORDER BY mf.feature_ts DESC) = 1")(
    lambda c: features.point_in_time(monthly_features(c), c.orders.select("customer_id", "order_id", "order_date"), "customer_id", "feature_ts", "order_date", ["spend", "orders"]))
_MODELS = {
    "valid": ("SELECT * FROM {orders} WHERE order_status <> 'Cancelled'", ["orders"]),
    "spend": ("SELECT customer_id, SUM(order_total) AS spend, COUNT(*) AS n FROM {valid} GROUP BY customer_id", ["valid"]),
    "segments": ("SELECT c.customer_segment, SUM(s.spend) AS spend, SUM(s.n) AS n FROM {spend} s JOIN {customers} c ON c.customer_id = s.customer_id GROUP BY c.customer_segment", ["spend", "customers"]),
}
query("s4_sql_transformations", "customer_segment:s spend:d2 n:i", "SELECT customer_segment, SUM(order_total) AS spend, COUNT(*) AS n FROM vord JOIN cust USING (customer_id) GROUP BY 1")(
    lambda c: features.run_transformations(c.spark, {"orders": c.orders, "customers": c.customers_base}, _MODELS, ["segments"])["segments"])


def lineage(c):
    """Region to nation to customer to order, as lineage edges."""
    n = c.raw("nation").select(F.concat(F.lit("region/"), F.col("n_regionkey").cast("string")).alias("source"), F.concat(F.lit("nation/"), F.col("n_nationkey").cast("string")).alias("target"), F.lit("split_region").alias("transformation"))
    k = c.raw("customer").select(F.concat(F.lit("nation/"), F.col("c_nationkey").cast("string")).alias("source"), F.concat(F.lit("customer/"), F.col("c_custkey").cast("string")).alias("target"), F.lit("split_nation").alias("transformation"))
    o = c.raw("orders").select(F.concat(F.lit("customer/"), F.col("o_custkey").cast("string")).alias("source"), F.concat(F.lit("order/"), F.col("o_orderkey").cast("string")).alias("target"), F.lit("place_order").alias("transformation"))
    return n.unionByName(k).unionByName(o)


_LI = """WITH le AS (SELECT 'region/' || n_regionkey AS source, 'nation/' || n_nationkey AS target, 'split_region' AS tr FROM nation UNION ALL SELECT 'nation/' || c_nationkey, 'customer/' || c_custkey, 'split_nation' FROM customer UNION ALL SELECT 'customer/' || o_custkey, 'order/' || o_orderkey, 'place_order' FROM orders),
r1 AS (SELECT source AS root, target AS node, [tr] AS path FROM le WHERE source LIKE 'region/%'), r2 AS (SELECT root, target AS node, list_append(path, tr) AS path FROM r1 JOIN le ON source = node), r3 AS (SELECT root, target AS node, list_append(path, tr) AS path FROM r2 JOIN le ON source = node)
"""
query("s5_lineage_closure", "root:s node:s depth:i", _LI + "SELECT DISTINCT source AS root, source AS node, 0 AS depth FROM le WHERE source LIKE 'region/%' UNION ALL SELECT root, node, 1 FROM r1 UNION ALL SELECT root, node, 2 FROM r2 UNION ALL SELECT root, node, 3 FROM r3")(
    lambda c: graph.closure(lineage(c).select("source", "target"), c.raw("region").select(F.concat(F.lit("region/"), F.col("r_regionkey").cast("string")).alias("node"))))
query("s6_trace_flow", "node:s steps:s", _LI + "SELECT 'region/1' AS node, '' AS steps UNION ALL SELECT node, array_to_string(path, ' > ') FROM (FROM r1 UNION ALL FROM r2 UNION ALL FROM r3) WHERE root = 'region/1'".replace("(FROM r1 UNION ALL FROM r2 UNION ALL FROM r3)", "(SELECT * FROM r1 UNION ALL SELECT * FROM r2 UNION ALL SELECT * FROM r3)"))(
    lambda c: graph.trace_flow(lineage(c), "region/1").select("node", F.array_join("path", " > ").alias("steps")))

# --- decisions ---------------------------------------------------------------


def alerts(c):
    stock = inventory.inventory_analytics(c.inventory, c.products, c.stores, c.order_items, c.orders_between(AS_OF - dt.timedelta(days=90)), AS_OF).select(
        F.col("inventory_status").alias("stock_status"), (F.col("daily_demand_90d")).alias("demand_90d"), "product_id").join(c.products.select("product_id", "selling_price"), "product_id")
    return decisions.executive_alerts(
        ts.anomaly_alerts(series_plans.anomalies(c)), model_plans.heuristic(c), stock, prod_plans.matrix(c), marketing.campaign_performance(c.campaigns, c.spend, c.sessions, c.orders))


def _tail(sql):
    """Body of a WITH query, to continue another one."""
    return sql.strip()[5:]


_AL = (
    series_plans.ANOMALY_SQL.rstrip() + ", " + _tail(model_plans._HX).rstrip().rstrip(",").replace("sp AS (SELECT MIN(d)", "spn AS (SELECT MIN(d)").replace("FROM hb, sp)", "FROM hb, spn)")
    + ", " + _tail(prod_plans.MATRIX_SQL).replace("\nm AS (SELECT", "\nmm AS (SELECT").replace("FROM b, m)", "FROM b, mm)").strip() + """,
ik AS (SELECT product_id, order_date, SUM(quantity) q FROM itm JOIN vord USING (order_id) WHERE order_date >= DATE '2001-05-03' GROUP BY 1, 2), id AS (SELECT product_id, AVG(q) d90 FROM ik GROUP BY 1),
ie AS (SELECT COUNT(*) n, SUM(COALESCE(d90, 0) * CAST(selling_price AS DOUBLE)) e FROM inv JOIN prod USING (product_id) LEFT JOIN id USING (product_id) WHERE stock_quantity <= 50),
cs AS (SELECT campaign_id, CAST(SUM(spend_amount) AS DOUBLE) a FROM spend GROUP BY 1), cr AS (SELECT campaign_id, CAST(SUM(order_total) AS DOUBLE) r FROM vord GROUP BY 1), cw AS (SELECT COUNT(*) n, SUM(a) s FROM cs LEFT JOIN cr USING (campaign_id) WHERE COALESCE(r, 0) / a < 1),
aa AS (SELECT * FROM (SELECT 'ANOMALY' AS category, upper(severity) AS priority, kpi || ' ' || CAST(day AS VARCHAR) AS subject, ROUND(ABS(value - baseline_28d)) AS impact_revenue_inr, 0 AS impact_customers, 1 AS n_items FROM al WHERE severity IN ('critical', 'high') ORDER BY severity_score DESC, change_pct DESC, kpi, day LIMIT 5)
  UNION ALL SELECT 'CUSTOMER', CASE WHEN COUNT(*) > 500 THEN 'HIGH' ELSE 'MEDIUM' END, 'high churn risk', ROUND(COUNT(*) * quantile_cont(sp, 0.5) * 0.4), COUNT(*), COUNT(*) FROM hk WHERE risk_tier = 'High' HAVING COUNT(*) > 0
  UNION ALL SELECT 'INVENTORY', CASE WHEN n > 200 THEN 'CRITICAL' ELSE 'HIGH' END, 'stock-out within 14 days', ROUND(e / 90 * 14), 0, n FROM ie WHERE n > 0
  UNION ALL SELECT 'PRODUCT', 'MEDIUM', 'low revenue and margin', ROUND(SUM(revenue_inr) * 0.10), 0, COUNT(*) FROM mat WHERE quadrant = 'Remove' HAVING COUNT(*) > 0
  UNION ALL SELECT 'MARKETING', CASE WHEN s > 500000 THEN 'HIGH' ELSE 'MEDIUM' END, 'negative return', ROUND(s * 0.5), 0, n FROM cw WHERE n > 0),
ab AS (SELECT *, CASE priority WHEN 'CRITICAL' THEN 100 WHEN 'HIGH' THEN 50 WHEN 'MEDIUM' THEN 20 ELSE 5 END AS priority_score FROM aa), ac AS (SELECT *, ROW_NUMBER() OVER (ORDER BY priority_score DESC, impact_revenue_inr DESC, category, subject) AS alert_rank FROM ab)
""")
_ACT = ", tm AS (SELECT * FROM (VALUES " + ", ".join(
    f"('{cat}', {i + 1}, '{a.replace(chr(39), chr(39) * 2)}', {f}, '{t}')" for cat, rows in decisions.ACTIONS.items() for i, (a, f, _, t) in enumerate(rows)) + """) v(category, step, recommendation, factor, timeline)),
rc AS (SELECT ac.*, step, left(subject, 80) || ' → ' || recommendation AS recommendation, timeline, CASE category """ + " ".join(f"WHEN '{cat}' THEN '{who}'" for cat, who in decisions.OWNERS.items()) + """ ELSE 'TBD' END AS owner, 'OPEN' AS status, ROUND(factor * 100) AS estimated_impact_pct, ROUND(impact_revenue_inr * factor) AS estimated_revenue_impact_inr, ROUND(impact_customers * factor) AS estimated_customers_impact FROM ac JOIN tm USING (category))
"""
query("d10_executive_alerts", "alert_rank:i category:s priority:s priority_score:i subject:s impact_revenue_inr:d0 impact_customers:i n_items:i", _AL + "SELECT * FROM ac")(alerts)
query("d11_alert_recommendations", "alert_rank:i category:s priority:s step:i recommendation:s timeline:s estimated_impact_pct:d0 estimated_revenue_impact_inr:d0 estimated_customers_impact:d0 owner:s status:s", _AL + _ACT + "SELECT * FROM rc")(
    lambda c: decisions.alert_recommendations(alerts(c)))
query("d12_decision_summary", "category:s alerts:i recommendations:i potential_revenue_inr:d0 customers_retained:d0",
      _AL + _ACT + "SELECT category, COUNT(DISTINCT alert_rank) AS alerts, COUNT(*) AS recommendations, SUM(estimated_revenue_impact_inr) AS potential_revenue_inr, SUM(estimated_customers_impact) AS customers_retained FROM rc GROUP BY 1")(
    lambda c: decisions.decision_summary(decisions.alert_recommendations(alerts(c))))


def kpi_history(c):
    m = sales.monthly_trend(c.orders, c.order_items)
    return quality.unpivot_numbers(m, ["total_revenue_inr", "orders", "aov_inr", "units_sold"], ["month"]).select(F.col("feature").alias("kpi"), F.col("month").alias("period"), "value")


_KH = """WITH mo AS (SELECT date_trunc('month', order_date) AS period, CAST(SUM(CASE WHEN order_status <> 'Cancelled' THEN order_total ELSE 0 END) AS DOUBLE) AS rev, COUNT(*) AS n FROM ord GROUP BY 1), mu AS (SELECT date_trunc('month', order_date) AS period, SUM(quantity) u FROM ord JOIN itm USING (order_id) GROUP BY 1),
kh AS (SELECT 'total_revenue_inr' AS kpi, period, rev AS value FROM mo UNION ALL SELECT 'orders', period, n FROM mo UNION ALL SELECT 'aov_inr', period, rev / n FROM mo UNION ALL SELECT 'units_sold', period, u FROM mu),
tg AS (SELECT kpi AS metric, max_by(value, period) AS current_value, AVG(value) * 1.1 AS target FROM kh WHERE period < DATE '2001-08-01' GROUP BY 1), op AS (SELECT *, target - current_value AS gap, (target - current_value) / target * 100 AS gap_percentage FROM tg WHERE target > current_value)
"""
query("d13_kpi_trend", "kpi:s trend:s slope:d4 growth_rate:d6 volatility:d4 current_value:d2 forecast:d2 n_periods:i",
      _KH + ", r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY kpi ORDER BY period DESC) k FROM kh), t AS (SELECT kpi, REGR_SLOPE(value, -k) AS slope, min_by(value, period) f, max_by(value, period) AS current_value, STDDEV_POP(value) AS volatility, COUNT(*) AS n_periods FROM r WHERE k <= 7 GROUP BY 1) "
      "SELECT *, CASE WHEN slope > 0.01 THEN 'increasing' WHEN slope < -0.01 THEN 'decreasing' ELSE 'stable' END AS trend, (current_value - f) / ABS(f) AS growth_rate, current_value + slope AS forecast FROM t")(lambda c: decisions.kpi_trend(kpi_history(c)))


def risk_factors(c):
    joined = c.orders.join(c.customers_base.select("customer_id", "customer_segment"), "customer_id").groupBy(F.col("customer_segment").alias("entity")).agg(
        (F.count_if(F.col("order_status") == "Returned") / F.count("*")).alias("return_rate"), (F.count_if(F.col("order_status") == "Cancelled") / F.count("*")).alias("cancel_rate"))
    return quality.unpivot_numbers(joined, ["return_rate", "cancel_rate"], ["entity"]).withColumnRenamed("feature", "factor")


query("d14_assess_risk", "entity:s factor:s value:d6 threshold:d2 risk_score:d6 severity:s overall_risk:d6 risk_level:s",
      "WITH s AS (SELECT customer_segment AS entity, COUNT(*) FILTER (order_status = 'Returned') / COUNT(*) a, COUNT(*) FILTER (order_status = 'Cancelled') / COUNT(*) b FROM ord JOIN cust USING (customer_id) GROUP BY 1), f AS (SELECT entity, 'return_rate' AS factor, a AS value, 0.3 AS threshold FROM s UNION ALL SELECT entity, 'cancel_rate', b, 0.7 FROM s), "
      "r AS (SELECT *, LEAST(1, value / threshold) AS risk_score FROM f), o AS (SELECT *, AVG(risk_score) OVER (PARTITION BY entity) AS overall_risk FROM r) SELECT *, CASE WHEN risk_score > 0.8 THEN 'high' WHEN risk_score > 0.5 THEN 'medium' ELSE 'low' END AS severity, "
      "CASE WHEN overall_risk > 0.8 THEN 'critical' WHEN overall_risk > 0.6 THEN 'high' WHEN overall_risk > 0.4 THEN 'medium' ELSE 'low' END AS risk_level FROM o")(lambda c: decisions.assess_risk(risk_factors(c), {"return_rate": 0.3}))


def kpi_targets(c):
    """The last full month against a tenth more than the mean of all full months."""
    return kpi_history(c).filter(F.col("period") < "2001-08-01").groupBy(F.col("kpi").alias("metric")).agg(F.max_by("value", "period").alias("current_value"), (F.avg("value") * 1.1).alias("target"))


query("d15_opportunities", "metric:s current_value:d2 target:d2 gap:d2 gap_percentage:d4 priority:s potential_impact:s", _KH + "SELECT *, CASE WHEN gap_percentage > 20 THEN 'high' WHEN gap_percentage > 10 THEN 'medium' ELSE 'low' END AS priority, CASE WHEN gap_percentage > 20 THEN 'high' ELSE 'medium' END AS potential_impact FROM op")(
    lambda c: decisions.opportunities(kpi_targets(c)))
query("d16_kpi_variance", "metric:s current_value:d2 target:d2 variance:d6 alert_severity:s", _KH + ", v AS (SELECT *, (current_value - target) / target AS variance FROM tg) SELECT *, CASE WHEN ABS(variance) > 0.2 THEN 'high' WHEN ABS(variance) > 0.1 THEN 'medium' END AS alert_severity FROM v")(lambda c: decisions.kpi_variance(kpi_targets(c)))
query("d17_opportunity_plan", "action_id:s metric:s action:s gap:d2 priority:s estimated_effort:s timeline:s",
      _KH + "SELECT 'ACTION_' || ROW_NUMBER() OVER (ORDER BY gap_percentage DESC, metric) AS action_id, metric, 'Improve ' || metric || ' to reach target' AS action, gap, CASE WHEN gap_percentage > 20 THEN 'high' WHEN gap_percentage > 10 THEN 'medium' ELSE 'low' END AS priority, "
      "CASE WHEN gap_percentage > 20 THEN 'high' WHEN gap_percentage > 10 THEN 'medium' ELSE 'low' END AS estimated_effort, CAST(CAST(floor(gap_percentage / 10) AS BIGINT) + 1 AS VARCHAR) || ' weeks' AS timeline FROM op")(lambda c: decisions.opportunity_plan(decisions.opportunities(kpi_targets(c))))

# --- serving -----------------------------------------------------------------

query("q1_range_kpis", "total_revenue:d2 net_revenue:d2 total_orders:i unique_customers:i aov:d2 return_rate:d4 gross_margin_pct:d4",
      """WITH o AS (SELECT * FROM ord WHERE order_date BETWEEN DATE '2000-01-01' AND DATE '2000-12-31'), m AS (SELECT 100 * CAST(SUM(line_total - quantity * cost_price) AS DOUBLE) / CAST(SUM(line_total) AS DOUBLE) g FROM itm JOIN o USING (order_id) JOIN prod USING (product_id) WHERE order_status <> 'Cancelled')
SELECT SUM(order_total) FILTER (order_status <> 'Cancelled') AS total_revenue, SUM(order_total) FILTER (order_status IN ('Delivered', 'Shipped')) - SUM(order_total) FILTER (order_status = 'Cancelled') AS net_revenue, COUNT(*) FILTER (order_status <> 'Cancelled') AS total_orders,
  COUNT(DISTINCT customer_id) FILTER (order_status <> 'Cancelled') AS unique_customers, CAST(SUM(order_total) FILTER (order_status <> 'Cancelled') AS DOUBLE) / COUNT(*) FILTER (order_status <> 'Cancelled') AS aov, 100 * COUNT(*) FILTER (order_status = 'Returned') / COUNT(*) FILTER (order_status <> 'Cancelled') AS return_rate, ANY_VALUE(g) AS gross_margin_pct FROM o, m""")(
    lambda c: decisions.range_kpis(c.orders_between(dt.date(2000, 1, 1), dt.date(2000, 12, 31)), c.order_items, c.products))


def _q2(c):
    from marketloom.operators import recommend as rec

    lines = c.order_items.select("order_id", "product_id").join(c.orders.select("order_id", "customer_id"), "order_id").select("customer_id", "product_id")
    return rec.category_or_popular(c.customers_base.select("customer_id"), lines.distinct(), c.products, lines, rec.popular_products(c.order_items))


query("q2_category_recommendations", "customer_id:i product_id:i rank:i strategy:s",
      """WITH li AS (SELECT customer_id, product_id, category_name FROM itm JOIN ord USING (order_id) JOIN prod USING (product_id)), fv AS (SELECT customer_id, max_by(category_name, (n, category_name)) AS category_name FROM (SELECT customer_id, category_name, COUNT(*) n FROM li GROUP BY 1, 2) GROUP BY 1),
cd AS (SELECT customer_id, product_id FROM fv JOIN prod USING (category_name) ANTI JOIN li USING (customer_id, product_id)), pp AS (SELECT product_id, ROW_NUMBER() OVER (ORDER BY SUM(quantity) * 0.5 + COUNT(DISTINCT order_id) * 0.5 DESC, product_id) AS rank FROM itm GROUP BY 1)
SELECT *, ROW_NUMBER() OVER (PARTITION BY customer_id ORDER BY product_id) AS rank, 'category_based' AS strategy FROM cd QUALIFY rank <= 5 UNION ALL SELECT customer_id, product_id, rank, 'popular_products' FROM cust CROSS JOIN pp WHERE rank <= 5 AND customer_id NOT IN (SELECT customer_id FROM li)""")(_q2)
query("q3_customer_profiles", "customer_id:i customer_name:s customer_segment:s state:s total_orders:i total_spend:d2 avg_order_value:d2 last_order_date:t churn_probability:d6 risk_tier:s risk_score:i",
      model_plans._HX + "st AS (SELECT customer_id, COUNT(*) AS total_orders, SUM(order_total) AS total_spend, CAST(SUM(order_total) AS DOUBLE) / COUNT(*) AS avg_order_value, MAX(order_date) AS last_order_date FROM ord GROUP BY 1) SELECT c.*, st.* EXCLUDE (customer_id), churn_probability, risk_tier, risk_score FROM cust c LEFT JOIN st USING (customer_id) LEFT JOIN hk USING (customer_id)")(
    lambda c: decisions.customer_profiles(c.customers_base, c.orders, model_plans.heuristic(c)))
query("q4_forecast_response", "series_id:s step:i day:t forecast:d4 lower_bound:d4 upper_bound:d4",
      series_plans._F1C + f", m AS (SELECT series_id, ANY_VALUE(last_day) l, (AVG(units_sold) FILTER (k <= 7) + AVG(units_sold) FILTER (k <= 14) + AVG(units_sold) FILTER (k <= 28)) / 3 AS forecast FROM ts GROUP BY 1) SELECT series_id, step, l + CAST(step AS INT) AS day, forecast, forecast * 0.9 AS lower_bound, forecast * 1.1 AS upper_bound FROM m CROSS JOIN range(1, 8) h(step)")(
    lambda c: decisions.forecast_response(ts.forecast_moving_average(series_plans.categories(c), 30), 7))

# --- dashboards --------------------------------------------------------------

query("b1_yearly_growth", "month:t net_revenue:d2 previous_year:d2 growth_pct:d4",
      "WITH m AS (SELECT date_trunc('month', order_date) AS month, CAST(SUM(CASE WHEN order_status IN ('Delivered', 'Shipped') THEN order_total WHEN order_status = 'Returned' THEN -order_total ELSE 0 END) AS DOUBLE) n FROM ord GROUP BY 1) SELECT a.month, a.n AS net_revenue, b.n AS previous_year, (a.n - b.n) / b.n * 100 AS growth_pct FROM m a LEFT JOIN m b ON b.month = a.month - INTERVAL 1 YEAR")(
    lambda c: decisions.yearly_growth(c.orders))
query("b2_headline_ratios", "churn_rate_pct:d4 gross_margin_pct:d4 customer_lifetime_value:d2",
      """WITH p AS (SELECT c.customer_id, MAX(order_date) l, COUNT(order_id) n, SUM(order_total) r FROM cust c LEFT JOIN vord v ON v.customer_id = c.customer_id GROUP BY 1), m AS (SELECT CAST(SUM(line_total - quantity * cost_price) AS DOUBLE) / CAST(SUM(line_total) AS DOUBLE) m FROM itm JOIN vord USING (order_id) JOIN prod USING (product_id))
SELECT 100 * COUNT(*) FILTER (l IS NULL OR DATE '2001-08-01' - l > 90) / COUNT(*) AS churn_rate_pct, ANY_VALUE(m) * 100 AS gross_margin_pct, CAST(SUM(r) AS DOUBLE) / COUNT(*) FILTER (n > 0) * 36 * ANY_VALUE(m) AS customer_lifetime_value FROM p, m""")(
    lambda c: decisions.headline_ratios(c.customers_base, c.orders, c.order_items, c.products, AS_OF))
query("b3_daily_sales_of_range", "order_day:t gross_revenue:d2 net_revenue:d2 total_orders:i units_sold:i",
      "WITH o AS (SELECT * FROM ord WHERE order_date BETWEEN DATE '2001-01-01' AND DATE '2001-03-31'), l AS (SELECT order_date, SUM(quantity) u FROM itm JOIN o USING (order_id) GROUP BY 1) SELECT order_date AS order_day, SUM(CASE WHEN order_status <> 'Cancelled' THEN order_total ELSE 0 END) AS gross_revenue, "
      "SUM(CASE WHEN order_status IN ('Delivered', 'Shipped') THEN order_total WHEN order_status = 'Returned' THEN -order_total ELSE 0 END) AS net_revenue, COUNT(*) AS total_orders, COALESCE(ANY_VALUE(u), 0) AS units_sold FROM o LEFT JOIN l USING (order_date) GROUP BY 1")(
    lambda c: sales.daily_sales(c.orders_between(dt.date(2001, 1, 1), dt.date(2001, 3, 31)), c.order_items))
query("b4_status_mix", "order_status:s orders:i share_pct:d4", "SELECT order_status, COUNT(*) AS orders, 100 * COUNT(*) / (SELECT COUNT(*) FROM ord) AS share_pct FROM ord GROUP BY 1")(lambda c: decisions.status_mix(c.orders))
query("b4_weekday_revenue", "weekday:s revenue:d2 orders:i", "SELECT dayname(order_date) AS weekday, SUM(order_total) AS revenue, COUNT(*) AS orders FROM vord GROUP BY 1")(lambda c: decisions.weekday_revenue(c.orders))
query("b5_new_and_returning", "month:t active_customers:i new_customers:i returning_customers:i",
      "WITH n AS (SELECT date_trunc('month', signup_date) m, COUNT(*) n FROM cust GROUP BY 1) SELECT date_trunc('month', order_date) AS month, COUNT(DISTINCT customer_id) AS active_customers, COALESCE(ANY_VALUE(n), 0) AS new_customers, GREATEST(COUNT(DISTINCT customer_id) - COALESCE(ANY_VALUE(n), 0), 0) AS returning_customers FROM ord LEFT JOIN n ON m = date_trunc('month', order_date) GROUP BY 1")(
    lambda c: decisions.new_and_returning(c.customers, c.orders))


def _tops(c):
    from marketloom.operators import products as prod_ops

    cat = prod_ops.category_performance(c.products, c.order_items, c.orders, c.returns, c.reviews, sold_only=True).groupBy("category_name").agg(F.sum("revenue_inr").alias("v"))
    part = lambda df, kind, name, v, n: decisions.top_by(df, name, v, n).select(F.lit(kind).alias("kind"), "name", F.col("value").cast("double").alias("value"))
    sold = prod_ops.product_sales(c.order_items, c.orders, c.products).select(F.col("product_id").cast("string").alias("p"), "revenue")
    return part(cat, "category", "category_name", "v", 5).unionByName(part(sales.region_performance(c.customers_base, c.orders), "state", "state", "revenue_inr", 5)).unionByName(part(sold, "product", "p", "revenue", 10))


query("b6_top_lists", "kind:s name:s value:d2",
      "SELECT * FROM (SELECT 'category' AS kind, category_name AS name, CAST(SUM(line_total) AS DOUBLE) AS value FROM itm JOIN vord USING (order_id) JOIN prod USING (product_id) GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 5) UNION ALL SELECT * FROM (SELECT 'state', state, CAST(SUM(order_total) AS DOUBLE) FROM cust JOIN vord USING (customer_id) GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 5) "
      "UNION ALL SELECT * FROM (SELECT 'product', CAST(product_id AS VARCHAR), CAST(SUM(line_total) AS DOUBLE) FROM itm JOIN vord USING (order_id) GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 10)")(_tops)


def _summaries(c):
    part = lambda df, kind, g, v: decisions.group_summary(df, g, v).select(F.lit(kind).alias("kind"), "group_name", "members", "total", "mean")
    rfm = part(customers.rfm_ntile(c.customers, c.orders, AS_OF), "rfm", "rfm_segment", "monetary_value")
    clv = part(customers.clv_simple(c.customers_base, c.orders, c.order_items, c.products), "clv", "customer_value_tier", "total_revenue")
    return rfm.unionByName(clv).unionByName(part(prod_plans.matrix(c), "matrix", "quadrant", "revenue_inr"))


def _summary_sql(kind, base, tail, group, value):
    return base + tail + f"SELECT '{kind}' AS kind, {group} AS group_name, COUNT(*) AS members, CAST(SUM({value}) AS DOUBLE) AS total, CAST(SUM({value}) AS DOUBLE) / COUNT(*) AS mean FROM {{t}} GROUP BY 2"


_B7 = ("SELECT 'rfm' AS kind, rfm_segment AS group_name, COUNT(*) AS members, CAST(SUM(monetary_value) AS DOUBLE) AS total, CAST(SUM(monetary_value) AS DOUBLE) / COUNT(*) AS mean FROM (" + cust_plans.RFM_SQL + ") GROUP BY 2 UNION ALL "
       "SELECT 'clv', customer_value_tier, COUNT(*), CAST(SUM(total_revenue) AS DOUBLE), CAST(SUM(total_revenue) AS DOUBLE) / COUNT(*) FROM (" + cust_plans.CLV_SQL + " SELECT * FROM clv) GROUP BY 2 UNION ALL "
       "SELECT 'matrix', quadrant, COUNT(*), SUM(revenue_inr), SUM(revenue_inr) / COUNT(*) FROM (" + prod_plans.MATRIX_SQL + " SELECT * FROM mat) GROUP BY 2")
query("b7_group_summaries", "kind:s group_name:s members:i total:d2 mean:d2", _B7)(_summaries)

# --- streaming ---------------------------------------------------------------


@query("str1_drift_stream", "batches:i overall_drift_score:d4 n_total_features:i")
def _(c):
    """Recent order lines arrive as files; each file is one scored batch."""
    base = io.scratch_path(c.spark, "drift-stream")
    recent, past = series_plans._recent(c), series_plans._recent(c, False)
    kept = recent.select(*series_plans._FEATURES, "order_date")
    kept.repartition(4, F.trunc("order_date", "month")).write.parquet(f"{base}/in")
    stream = c.spark.readStream.schema(kept.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    incremental.drift_per_batch(stream, past, series_plans._FEATURES, f"{base}/out", f"{base}/checkpoint").awaitTermination()
    return c.spark.read.parquet(f"{base}/out").agg(F.count("*").alias("batches"), F.avg("overall_drift_score").alias("overall_drift_score"), F.max("n_total_features").alias("n_total_features"))


@query("str2_feedback_stream", "window_start:t model_id:s n_correct:i n:i accuracy:d6",
       model_plans._MO + "z AS (SELECT 1) SELECT CAST(epoch_ms(CAST(floor((feedback_ts - DATE '1970-01-01') / 30) * 30 AS BIGINT) * 86400000) AS DATE) AS window_start, model_id, SUM(CASE WHEN prediction = actual THEN 1 ELSE 0 END) AS n_correct, COUNT(*) AS n, AVG(CASE WHEN prediction = actual THEN 1 ELSE 0 END) AS accuracy FROM jo GROUP BY 1, 2")
def _(c):
    """Both logs are streamed; matches are written as they are found and then windowed."""
    base = io.scratch_path(c.spark, "feedback-stream")
    p = model_plans.predictions(c).select("prediction_id", "model_id", F.col("prediction_ts").cast("timestamp").alias("prediction_ts"), "prediction")
    f = model_plans.feedback(c).withColumn("feedback_ts", F.col("feedback_ts").cast("timestamp"))
    p.write.parquet(f"{base}/predictions")
    f.write.parquet(f"{base}/feedback")
    read = lambda df, name: c.spark.readStream.schema(df.schema).parquet(f"{base}/{name}")
    matched = incremental.match_feedback(read(p, "predictions"), read(f, "feedback"))
    incremental.write_matches(matched, f"{base}/out", f"{base}/checkpoint").awaitTermination()
    return incremental.windowed_accuracy(c.spark.read.parquet(f"{base}/out"))
