"""Inventory, pricing, allocation and what-if queries."""

import datetime as dt
from statistics import NormalDist

from pyspark.sql import functions as F

from marketloom.operators import inventory as inv
from marketloom.operators import pricing as px
from marketloom.plans.registry import query
from marketloom.sources.commerce import AS_OF

Z95 = repr(NormalDist().inv_cdf(0.95))

query(
    "sql06_inventory_health",
    "inventory_id:i product_id:i product_name:s category_name:s store_id:i store_name:s store_city:s stock_quantity:i reorder_level:i safety_stock:i average_daily_demand:d2 lead_time_days:i "
    "lead_time_demand:d2 recommended_reorder_point:d2 recommended_reorder_qty:d2 stock_status:s days_of_inventory:d1 last_restock_date:t inventory_value_cost:d2 inventory_value_retail:d2 overstock_flag:s",
    """SELECT inv.*, product_name, category_name, store_name, store_city, average_daily_demand * 7 AS lead_time_demand, average_daily_demand * 7 + 30 AS recommended_reorder_point,
  GREATEST(0, average_daily_demand * 14 + 30 - stock_quantity) AS recommended_reorder_qty,
  CASE WHEN stock_quantity = 0 THEN 'Out of Stock' WHEN stock_quantity <= 30 THEN 'Critical' WHEN stock_quantity <= 50 THEN 'Reorder' ELSE 'OK' END AS stock_status,
  CASE WHEN average_daily_demand > 0 THEN stock_quantity / CAST(average_daily_demand AS DOUBLE) END AS days_of_inventory, stock_quantity * cost_price AS inventory_value_cost,
  stock_quantity * selling_price AS inventory_value_retail, CASE WHEN stock_quantity > 250 THEN 'Overstock' ELSE 'Normal' END AS overstock_flag
FROM inv JOIN prod USING (product_id) JOIN stor USING (store_id)""",
)(lambda c: inv.inventory_health(c.inventory, c.products, c.stores))

query(
    "agg6_inventory_health",
    "inventory_id:i product_id:i store_id:i stock_quantity:i average_daily_demand:d4 lead_time_demand:d4 recommended_reorder_point:d4 recommended_reorder_qty:i stock_status:s days_of_inventory:d1 overstock_flag:s",
    """WITH d AS (SELECT product_id, SUM(quantity) / 30 d FROM itm JOIN ord USING (order_id) WHERE order_date >= (SELECT MAX(order_date) FROM ord) - 30 GROUP BY 1)
SELECT inv.* EXCLUDE (average_daily_demand), COALESCE(d, 0) AS average_daily_demand, COALESCE(d, 0) * 7 AS lead_time_demand, COALESCE(d, 0) * 7 + 30 AS recommended_reorder_point,
  ROUND(GREATEST(0, COALESCE(d, 0) * 14 + 30 - stock_quantity)) AS recommended_reorder_qty,
  CASE WHEN stock_quantity = 0 THEN 'Out of Stock' WHEN stock_quantity <= 30 THEN 'Critical' WHEN stock_quantity <= 50 THEN 'Reorder' ELSE 'OK' END AS stock_status,
  stock_quantity / d AS days_of_inventory, CASE WHEN stock_quantity > 250 THEN 'Overstock' ELSE 'Normal' END AS overstock_flag FROM inv LEFT JOIN d USING (product_id)""",
)(lambda c: inv.inventory_health_from_sales(c.inventory, c.products, c.stores, c.order_items, c.orders, 30))

query(
    "sql19_inventory_analytics",
    "inventory_id:i product_id:i product_name:s subcategory:s store_id:i store_name:s stock_quantity:i daily_demand_30d:d4 daily_demand_90d:d4 demand_volatility:d4 stockout_count_30d:i days_of_inventory:d1 "
    "stock_turnover_90d:d2 true_turnover_90d:d4 recommended_reorder_point:d0 recommended_reorder_qty:d0 safety_stock_calc:d0 inventory_value_cost:d2 inventory_value_retail:d2 cost_to_retail_pct:d2 inventory_status:s",
    """WITH q AS (SELECT product_id, order_date, SUM(quantity) q FROM itm JOIN vord USING (order_id) WHERE order_date >= DATE '2001-05-03' GROUP BY 1, 2),
d AS (SELECT product_id, AVG(q) FILTER (order_date >= DATE '2001-07-02') d30, AVG(q) d90, STDDEV_SAMP(q) sd, SUM(q) u FROM q GROUP BY 1),
b AS (SELECT *, COALESCE(d30, 0) x, COALESCE(d90, 0) y, COALESCE(sd, 0) s FROM inv JOIN prod USING (product_id) JOIN stor USING (store_id) LEFT JOIN d USING (product_id))
SELECT *, x AS daily_demand_30d, y AS daily_demand_90d, s AS demand_volatility, CASE WHEN stock_quantity = 0 THEN 1 ELSE 0 END AS stockout_count_30d, stock_quantity / d30 AS days_of_inventory,
  COALESCE(90.0 * stock_quantity / (d90 * 90), 0) AS stock_turnover_90d, u / NULLIF(stock_quantity, 0) AS true_turnover_90d, ROUND(x * 7 + 30) AS recommended_reorder_point,
  GREATEST(0, ROUND(x * 14 + 30 - stock_quantity)) AS recommended_reorder_qty, ROUND(1.645 * s * sqrt(7)) AS safety_stock_calc, stock_quantity * cost_price AS inventory_value_cost,
  stock_quantity * selling_price AS inventory_value_retail,
  100 * CAST(NULLIF(stock_quantity * cost_price, 0) AS DOUBLE) / CAST(NULLIF(stock_quantity * selling_price, 0) AS DOUBLE) AS cost_to_retail_pct,
  CASE WHEN stock_quantity > 250 AND COALESCE(stock_quantity / d30, 0) > 90 THEN 'Overstock' WHEN stock_quantity = 0 THEN 'Out of Stock' WHEN stock_quantity <= 30 THEN 'Critical'
    WHEN stock_quantity <= 50 THEN 'Reorder' ELSE 'Healthy' END AS inventory_status FROM b""",
)(lambda c: inv.inventory_analytics(c.inventory, c.products, c.stores, c.order_items, c.orders_between(AS_OF - dt.timedelta(days=90)), AS_OF))

_DEMAND = """
WITH q AS (SELECT product_id, order_date AS day, SUM(quantity) AS quantity FROM itm JOIN vord USING (order_id) GROUP BY 1, 2),
s AS (SELECT product_id, AVG(quantity) d, STDDEV_SAMP(quantity) sd, COUNT(*) n FROM q GROUP BY 1),
e AS (SELECT *, d * 365 a, sqrt(2 * d * 365 * 50 / 2) AS eoq, {z} * sqrt(7 * sd * sd + d * d * 1.5 * 1.5) AS ss FROM s),
pol AS (SELECT product_id, n AS n_days, d AS daily_demand, sd AS demand_std, a AS annual_demand, eoq, a / eoq AS orders_per_year, 365 * eoq / a AS time_between_orders_days, a / eoq * 50 AS total_ordering_cost,
  eoq AS total_holding_cost, a / eoq * 50 + eoq AS total_annual_cost, ss AS safety_stock, {z} * sd * sqrt(7) AS safety_stock_demand_only, d * 7 + ss AS reorder_point, 1 - 0.95 AS stockout_probability FROM e)
""".replace("{z}", Z95)
_EOQ_SPEC = "annual_demand:d4 eoq:d4 orders_per_year:d4 time_between_orders_days:d4 total_ordering_cost:d4 total_holding_cost:d4 total_annual_cost:d4"
_SS_SPEC = "daily_demand:d4 demand_std:d4 safety_stock:d4 safety_stock_demand_only:d4 reorder_point:d4 stockout_probability:d4"


def demand(c):
    return inv.product_daily_demand(c.order_items, c.orders)


query("i1_eoq", "product_id:i " + _EOQ_SPEC, _DEMAND + "SELECT * FROM pol")(lambda c: inv.eoq(demand(c)))
query("i2_safety_stock", "product_id:i " + _SS_SPEC, _DEMAND + "SELECT * FROM pol")(lambda c: inv.safety_stock(demand(c)))
query("i3_inventory_policies", "product_id:i n_days:i " + _EOQ_SPEC + " " + _SS_SPEC, _DEMAND + "SELECT * FROM pol WHERE n_days >= 10")(
    lambda c: inv.inventory_policies(demand(c)))
_KPI = _DEMAND + """, kpi AS (SELECT inventory_id, inv.product_id, store_id, stock_quantity AS current_stock, pol.* EXCLUDE (product_id), stock_quantity / daily_demand AS days_of_stock,
  CASE WHEN stock_quantity < reorder_point THEN 'below_rop' WHEN stock_quantity < reorder_point + eoq THEN 'normal' ELSE 'above_target' END AS stock_status,
  CASE WHEN stock_quantity < pol.safety_stock THEN 'high' WHEN stock_quantity < reorder_point THEN 'medium' ELSE 'low' END AS stockout_risk, stock_quantity * 10 AS annual_holding_cost,
  CASE WHEN stock_quantity / daily_demand < 7 THEN 'urgent' WHEN stock_quantity / daily_demand < 14 THEN 'soon' ELSE 'normal' END AS order_urgency
  FROM inv LEFT JOIN pol ON pol.product_id = inv.product_id AND n_days >= 10)
"""


def kpis(c):
    return inv.inventory_kpis(c.inventory, inv.inventory_policies(demand(c)))


query("i4_inventory_kpis", "inventory_id:i product_id:i store_id:i current_stock:i days_of_stock:d4 stock_status:s stockout_risk:s annual_holding_cost:d2 order_urgency:s", _KPI + "SELECT * FROM kpi")(kpis)
query("i5_reorder_recommendations", "inventory_id:i product_id:i action:s recommended_order_qty:d4 expected_delivery_days:i",
      _KPI + """, a AS (SELECT *, CASE WHEN stock_status = 'below_rop' OR order_urgency = 'urgent' THEN 'reorder_now' WHEN order_urgency = 'soon' THEN 'plan_reorder' ELSE 'no_action' END AS action FROM kpi)
SELECT *, CASE WHEN action = 'reorder_now' THEN eoq ELSE 0 END AS recommended_order_qty, CASE WHEN action = 'reorder_now' THEN 7 ELSE 0 END AS expected_delivery_days FROM a""")(
    lambda c: inv.reorder_recommendations(kpis(c)))


def echelon_demand(c):
    """Customer, store and warehouse demand: units per day, per store and day, per store and week."""
    lines = c.order_items.select("order_id", "quantity").join(c.valid_orders.select("order_id", "order_date", "store_id"), "order_id")
    store = lines.groupBy("store_id", "order_date").agg(F.sum("quantity").alias("quantity"))
    base = lines.groupBy("order_date").agg(F.sum("quantity").alias("quantity")).select(F.lit("customer").alias("echelon"), "quantity")
    weekly = store.groupBy("store_id", F.trunc("order_date", "week").alias("w")).agg(F.sum("quantity").alias("quantity"))
    return base.unionByName(store.select(F.lit("store").alias("echelon"), "quantity")).unionByName(weekly.select(F.lit("warehouse").alias("echelon"), "quantity"))


_ECH = """
WITH l AS (SELECT order_date, store_id, SUM(quantity) quantity FROM itm JOIN vord USING (order_id) GROUP BY 1, 2),
e AS (SELECT 'customer' AS echelon, SUM(quantity) AS quantity FROM l GROUP BY order_date UNION ALL SELECT 'store', quantity FROM l
  UNION ALL SELECT 'warehouse', SUM(quantity) FROM l GROUP BY store_id, date_trunc('week', order_date)),
"""
query(
    "i6_multi_echelon",
    "echelon:s safety_stock:d4 reorder_point:d4 economic_order_quantity:d4 total_cost:d2 holding_cost:d4 ordering_cost:d4 average_inventory:d4",
    _ECH + f"""s AS (SELECT echelon, AVG(quantity) d, STDDEV_SAMP(quantity) sd, CASE echelon WHEN 'store' THEN 3 WHEN 'warehouse' THEN 7 ELSE 1 END lt, CASE echelon WHEN 'store' THEN 0.5 WHEN 'warehouse' THEN 0.2 ELSE 0.1 END h,
  CASE echelon WHEN 'store' THEN 50 WHEN 'warehouse' THEN 200 ELSE 100 END oc, CASE echelon WHEN 'warehouse' THEN {NormalDist().inv_cdf(0.99)!r} ELSE {Z95} END z FROM e GROUP BY 1),
k AS (SELECT *, z * sqrt(lt * sd * sd + d * d * lt * 0.2 * lt * 0.2) AS safety_stock, sqrt(2 * d * 365 * oc / h) AS q FROM s)
SELECT echelon, safety_stock, d * lt + safety_stock AS reorder_point, q AS economic_order_quantity, d * 365 / q * oc + (q / 2 + safety_stock) * h + d * 3650 AS total_cost,
  (q / 2 + safety_stock) * h AS holding_cost, d * 365 / q * oc AS ordering_cost, q / 2 + safety_stock AS average_inventory FROM k""",
)(lambda c: inv.multi_echelon(echelon_demand(c), {"customer": 1, "store": 3, "warehouse": 7}, {"warehouse": 0.99}, {"store": 0.5, "warehouse": 0.2}, {"store": 50, "warehouse": 200}))
query("i7_bullwhip", "link:s bullwhip_ratio:d6",
      _ECH + """v AS (SELECT echelon, VAR_SAMP(quantity) v FROM e GROUP BY 1)
SELECT a.echelon || '_to_' || b.echelon AS link, b.v / a.v AS bullwhip_ratio FROM v a JOIN v b ON (a.echelon = 'customer' AND b.echelon = 'store') OR (a.echelon = 'store' AND b.echelon = 'warehouse')""")(
    lambda c: inv.bullwhip(echelon_demand(c), ["customer", "store", "warehouse"]))
query("i8_cross_docking", "product_id:i mean_demand:d4 std_demand:d4 cv:d4",
      "WITH q AS (SELECT product_id, date_trunc('year', order_date) AS y, SUM(quantity) AS quantity FROM itm JOIN vord USING (order_id) GROUP BY 1, 2) "
      "SELECT product_id, AVG(quantity) AS mean_demand, STDDEV_SAMP(quantity) AS std_demand, STDDEV_SAMP(quantity) / AVG(quantity) AS cv FROM q GROUP BY 1 HAVING STDDEV_SAMP(quantity) / AVG(quantity) < 0.3 AND AVG(quantity) > 100")(
    lambda c: inv.cross_docking(demand(c).groupBy("product_id", F.trunc("day", "year").alias("y")).agg(F.sum("quantity").alias("quantity"))))
query("i9_total_inventory_cost", "product_id:i annual_demand:d4 eoq:d4 number_of_orders:d4 ordering_cost:d4 average_inventory:d4 holding_cost:d4 purchase_cost:d2 total_cost:d2",
      _DEMAND + """SELECT pol.product_id, annual_demand, eoq, annual_demand / eoq AS number_of_orders, annual_demand / eoq * 50 AS ordering_cost, eoq / 2 + safety_stock AS average_inventory, (eoq / 2 + safety_stock) * 2 AS holding_cost,
  annual_demand * CAST(cost_price AS DOUBLE) AS purchase_cost, annual_demand / eoq * 50 + (eoq / 2 + safety_stock) * 2 + annual_demand * CAST(cost_price AS DOUBLE) AS total_cost FROM pol JOIN prod USING (product_id) WHERE n_days >= 10""")(
    lambda c: inv.inventory_total_cost(inv.inventory_policies(demand(c)), c.products))

# --- prices ------------------------------------------------------------------

_ELAST = """
WITH l AS (SELECT product_id, unit_price, quantity, ln(unit_price) lp, ln(quantity) lq FROM itm),
b AS (SELECT product_id, COUNT(*) n, quantile_cont(lp, 0.05) lo, quantile_cont(lp, 0.95) hi, AVG(quantity) AS demand FROM l GROUP BY 1),
f AS (SELECT product_id, COUNT(*) m, REGR_SLOPE(lq, lp) s FROM l JOIN b USING (product_id) WHERE lp > lo AND lp < hi GROUP BY 1),
el AS (SELECT product_id, n AS n_sales, demand, CASE WHEN n >= 10 AND m >= 5 THEN s ELSE -1.0 END AS elasticity FROM b LEFT JOIN f USING (product_id)),
pr AS (SELECT p.product_id, CAST(selling_price AS DOUBLE) cp, CAST(cost_price AS DOUBLE) k, CASE WHEN COALESCE(elasticity, -1) = -1 THEN -1.5 ELSE elasticity END e, COALESCE(demand, 10) d FROM prod p LEFT JOIN el USING (product_id)),
g AS (SELECT *, k * 1.1 + i * ((cp * 2 - k * 1.1) / 99) p FROM pr, range(100) t(i)),
v AS (SELECT *, d * pow(p / cp, e) q FROM g)
"""


def sales(c):
    return c.order_items.select("order_id", "product_id", F.col("unit_price").alias("price"), "quantity")


query("pr1_log_elasticity", "product_id:i n_sales:i elasticity:d6", _ELAST + "SELECT * FROM el")(lambda c: px.log_elasticity(sales(c)))
_OPT = _ELAST + """, o AS (SELECT product_id, max_by(i, ({goal}, -i)) bi FROM v GROUP BY 1), r AS (SELECT v.* FROM v JOIN o ON o.product_id = v.product_id AND o.bi = v.i)
SELECT product_id, cp AS current_price, e AS elasticity, p AS optimal_price, (p - cp) / cp * 100 AS price_change_pct, q AS optimal_demand, p * q AS optimal_revenue, (p - k) * q AS optimal_profit,
  (p * q - cp * d) / (cp * d) * 100 AS revenue_improvement_pct, ((p - k) * q - (cp - k) * d) / ((cp - k) * d) * 100 AS profit_improvement_pct FROM r"""
_OPT_SPEC = "product_id:i current_price:d2 elasticity:d6 optimal_price:d4 price_change_pct:d4 optimal_demand:d4 optimal_revenue:d4 optimal_profit:d4 revenue_improvement_pct:d4 profit_improvement_pct:d4"
query("pr2_optimize_price_revenue", _OPT_SPEC, _OPT.replace("{goal}", "p * q"))(lambda c: px.batch_prices(c.products, sales(c), "revenue"))
query("pr3_batch_prices", _OPT_SPEC, _OPT.replace("{goal}", "(p - k) * q"))(lambda c: px.batch_prices(c.products, sales(c)))


def _recommend(c):
    """Competitors of a product are the other products of its subcategory."""
    stats = c.products.groupBy("subcategory").agg(F.avg(F.col("selling_price").cast("double")).alias("competitor_avg_price"))
    stock = c.inventory.groupBy("product_id").agg(F.sum("stock_quantity").alias("inventory_level"))
    base = c.products.select("product_id", "subcategory", F.col("selling_price").cast("double").alias("current_price")).join(stats, "subcategory")
    return px.price_recommendations(base.join(stock, "product_id").join(px.log_elasticity(sales(c)), "product_id"), threshold=50)


query("pr4_price_recommendations", "product_id:i current_price:d2 competitor_avg_price:d2 inventory_level:i inventory_status:s competitor_position:s elasticity_sensitivity:s recommended_action:s",
      _ELAST + """, s AS (SELECT subcategory, AVG(CAST(selling_price AS DOUBLE)) a FROM prod GROUP BY 1), k AS (SELECT product_id, SUM(stock_quantity) u FROM inv GROUP BY 1),
z AS (SELECT p.product_id, CAST(selling_price AS DOUBLE) AS current_price, a AS competitor_avg_price, u AS inventory_level, CASE WHEN u < 50 THEN 'low' WHEN u > 500 THEN 'high' ELSE 'normal' END AS inventory_status,
  CASE WHEN selling_price > a * 1.2 THEN 'premium' WHEN selling_price < a * 0.8 THEN 'discounted' ELSE 'competitive' END AS competitor_position,
  CASE WHEN ABS(elasticity) > 2 THEN 'high' WHEN ABS(elasticity) > 1 THEN 'medium' ELSE 'low' END AS elasticity_sensitivity FROM prod p JOIN s USING (subcategory) JOIN k USING (product_id) JOIN el USING (product_id))
SELECT *, COALESCE(NULLIF(concat_ws(', ', CASE inventory_status WHEN 'low' THEN 'increase_price' WHEN 'high' THEN 'decrease_price' END,
  CASE competitor_position WHEN 'premium' THEN 'monitor_competitors' WHEN 'discounted' THEN 'consider_increase' END), ''), 'maintain_current_price') AS recommended_action FROM z""")(_recommend)


def _model_data(c):
    return c.order_items.select("order_id", "product_id", "line_number", "quantity", F.col("unit_price").alias("price"), F.col("discount_pct").cast("double").alias("discount_pct")).join(
        c.products.select("product_id", F.col("selling_price").cast("double").alias("list_price")), "product_id")


_FEATURES = ["price", "discount_pct", "list_price"]
query("pr5_demand_model", "split:s mae:d4 rmse:d4")(lambda c: px.train_demand_model(_model_data(c), _FEATURES)[1])
query("pr6_predict_demand", "product_id:i predicted_demand:d4")(
    lambda c: px.predict_demand(px.train_demand_model(_model_data(c), _FEATURES)[0], _model_data(c), _FEATURES).groupBy("product_id").agg(F.avg("predicted_demand").alias("predicted_demand")))

query("pr7_elasticity_by_quintile", "price_quantile:s elasticity:d6 n:i interpretation:s",
      """WITH e AS (SELECT quantile_cont(unit_price, 0.2) a, quantile_cont(unit_price, 0.4) b, quantile_cont(unit_price, 0.6) c, quantile_cont(unit_price, 0.8) d FROM itm),
q AS (SELECT CASE WHEN unit_price <= a THEN 'Q1' WHEN unit_price <= b THEN 'Q2' WHEN unit_price <= c THEN 'Q3' WHEN unit_price <= d THEN 'Q4' ELSE 'Q5' END g, ln(unit_price) x, ln(quantity) y FROM itm, e),
r AS (SELECT 'overall' AS price_quantile, CORR(x, y) AS elasticity, COUNT(*) AS n FROM q UNION ALL SELECT g, CORR(x, y), COUNT(*) FROM q GROUP BY 1)
SELECT *, CASE WHEN ABS(elasticity) > 1 THEN 'Elastic' ELSE 'Inelastic' END AS interpretation FROM r""")(
    lambda c: px.elasticity_by_quintile(c.order_items, "unit_price", "quantity"))


def _experiment(c):
    return c.order_items.select(F.when(F.col("order_id") % 2 == 0, "control").otherwise("treatment").alias("group"), "unit_price", "quantity")


query("pr8_price_experiment", "control_quantity:d4 treatment_quantity:d4 quantity_change_pct:d4 price_change_pct:d4 experimental_elasticity:d4 t_statistic:d4 degrees_of_freedom:i",
      """WITH s AS (SELECT AVG(quantity) FILTER (order_id % 2 = 0) a, AVG(quantity) FILTER (order_id % 2 = 1) b, AVG(unit_price) FILTER (order_id % 2 = 0) p, AVG(unit_price) FILTER (order_id % 2 = 1) q,
  COUNT(*) FILTER (order_id % 2 = 0) n, COUNT(*) FILTER (order_id % 2 = 1) m, VAR_SAMP(quantity) FILTER (order_id % 2 = 0) v, VAR_SAMP(quantity) FILTER (order_id % 2 = 1) w FROM itm)
SELECT a AS control_quantity, b AS treatment_quantity, (b - a) / a * 100 AS quantity_change_pct, (q - p) / p * 100 AS price_change_pct, ((b - a) / a) / ((q - p) / p) AS experimental_elasticity,
  (a - b) / sqrt(((n - 1) * v + (m - 1) * w) / (n + m - 2) * (1 / n + 1 / m)) AS t_statistic, n + m - 2 AS degrees_of_freedom FROM s""")(
    lambda c: px.price_experiment(_experiment(c), "unit_price", "quantity", "group"))
query("pr8_price_experiment_p", "t_statistic:d4 p_value:d6 significant:b")(lambda c: px.price_experiment(_experiment(c), "unit_price", "quantity", "group"))

_PSTATS = "WITH s AS (SELECT AVG(unit_price) p, AVG(quantity) q, AVG(CAST(cost_price AS DOUBLE)) k, CORR(ln(unit_price), ln(quantity)) e FROM itm JOIN prod USING (product_id)) "
query("pr9_counterfactual_demand", "current_price:d4 current_quantity:d4 current_revenue:d2 counterfactual_price:d4 counterfactual_quantity:d4 counterfactual_revenue:d2 revenue_change:d2 price_change_pct:d2 quantity_change_pct:d4 recommendation:s",
      _PSTATS + """SELECT p AS current_price, q AS current_quantity, p * q AS current_revenue, p * 1.1 AS counterfactual_price, q * (1 + e * 0.1) AS counterfactual_quantity, p * 1.1 * q * (1 + e * 0.1) AS counterfactual_revenue,
  p * 1.1 * q * (1 + e * 0.1) - p * q AS revenue_change, 10 AS price_change_pct, e * 10 AS quantity_change_pct, CASE WHEN 1.1 * (1 + e * 0.1) > 1 THEN 'Increase price' ELSE 'Decrease price' END AS recommendation FROM s""")(
    lambda c: px.counterfactual_demand(c.order_items, "unit_price", "quantity"))
query("pr10_markup_price", "current_price:d4 optimal_price:d4 current_profit:d2 optimal_profit:d2 profit_increase:d2 profit_increase_pct:d4 elasticity:d6",
      _PSTATS + """, o AS (SELECT *, GREATEST(p * 0.5, LEAST(CASE WHEN ABS(e) > 1 THEN k * ABS(e) / (ABS(e) + 1) ELSE p * 2 END, p * 2)) x FROM s),
r AS (SELECT *, (p - k) * q c, (x - k) * q * (1 + e * (x - p) / p) n FROM o) SELECT p AS current_price, x AS optimal_price, c AS current_profit, n AS optimal_profit, n - c AS profit_increase,
  CASE WHEN c > 0 THEN (n - c) / c * 100 ELSE 0 END AS profit_increase_pct, e AS elasticity FROM r""")(
    lambda c: px.markup_price(c.order_items.join(c.products.select("product_id", "cost_price"), "product_id"), "unit_price", "quantity", "cost_price"))
query("pr11_segment_sensitivity", "category_name:s elasticity:d6 n:i interpretation:s",
      "SELECT category_name, CORR(ln(unit_price), ln(quantity)) AS elasticity, COUNT(*) AS n, CASE WHEN ABS(CORR(ln(unit_price), ln(quantity))) > 1 THEN 'Elastic' ELSE 'Inelastic' END AS interpretation FROM itm JOIN prod USING (product_id) GROUP BY 1 HAVING COUNT(*) >= 100")(
    lambda c: px.segment_sensitivity(c.order_items.join(c.products.select("product_id", "category_name"), "product_id"), "unit_price", "quantity", "category_name"))
query("pr12_experiment_design", "product_id:i arm:s price_change_pct:d2 customer_id:s",
      """SELECT product_id, g AS arm, CASE g WHEN 'control' THEN 0 ELSE -5 END AS price_change_pct, product_id || '_' || g || '_' || i AS customer_id FROM prod, (VALUES ('control'), ('treatment')) v(g), range(10) r(i)""")(
    lambda c: px.experiment_design(c.products, -5.0, 10))


def _demand_products(c):
    units = c.order_items.groupBy("product_id").agg(F.sum("quantity").alias("demand"))
    return c.products.select("product_id", "cost_price", "selling_price").join(units, "product_id")


_KNAP = """WITH u AS (SELECT product_id, CAST(cost_price AS DOUBLE) c, CAST(selling_price AS DOUBLE) s, CAST(SUM(quantity) AS DOUBLE) d FROM itm JOIN prod USING (product_id) GROUP BY 1, 2, 3),
r AS (SELECT *, SUM(c * d) OVER (ORDER BY (s - c) / c DESC, product_id ROWS UNBOUNDED PRECEDING) cum FROM u),
k AS (SELECT product_id, d AS demand, GREATEST(0, LEAST(c * d, 50000000 - (cum - c * d))) AS cost, c, s FROM r),
kn AS (SELECT product_id, demand, cost / c AS optimal_quantity, cost, cost / c * (s - c) AS profit FROM k)
"""
query("o1_stock_allocation", "product_id:i demand:d2 optimal_quantity:d2 cost:d1 profit:d1", _KNAP + "SELECT * FROM kn")(
    lambda c: px.allocate_stock_budget(_demand_products(c), 5e7))


def _linear_demand(price):
    return F.greatest(F.lit(0.0), 100 - 0.03 * price)


_MULT = """WITH p AS (SELECT product_id, CAST(selling_price AS DOUBLE) s, CAST(cost_price AS DOUBLE) k, 0.5 + i * (1.5 / 150) m, i FROM prod, range(151) r(i)),
v AS (SELECT *, (s * m - k) * GREATEST(0, 100 - 0.03 * (s * m)) f FROM p),
b AS (SELECT product_id, max_by(m, (f, -i)) AS optimal_multiplier, MAX(f) AS optimal_profit, ANY_VALUE(s) s, ANY_VALUE(k) k FROM v GROUP BY 1),
mu AS (SELECT product_id, s AS current_price, optimal_multiplier, s * optimal_multiplier AS optimal_price, (s - k) * GREATEST(0, 100 - 0.03 * s) AS current_profit, optimal_profit FROM b)
"""
query("o3_price_multipliers", "product_id:i current_price:d2 optimal_multiplier:d4 optimal_price:d4 current_profit:d4 optimal_profit:d4", _MULT + "SELECT * FROM mu")(
    lambda c: px.best_multiplier(c.products, _linear_demand))
query("o4_action_plan", "action_type:s item_id:i current_value:d2 optimal_value:d2 change_pct:d2 priority:s",
      _MULT + _KNAP.replace("WITH u AS", ", u AS", 1) + """, a AS (SELECT 'price_change' AS action_type, product_id AS item_id, current_price AS current_value, optimal_price AS optimal_value, (optimal_price - current_price) / current_price * 100 AS change_pct, 20 h FROM mu
  UNION ALL SELECT 'inventory_adjustment', product_id, demand, optimal_quantity, (optimal_quantity - demand) / demand * 100, 50 FROM kn)
SELECT *, CASE WHEN ABS(change_pct) > h THEN 'high' ELSE 'medium' END AS priority FROM a WHERE ABS(change_pct) > 10""")(
    lambda c: px.action_plan(px.best_multiplier(c.products, _linear_demand), "product_id", "current_price", "optimal_price", "price_change").unionByName(
        px.action_plan(px.allocate_stock_budget(_demand_products(c), 5e7), "product_id", "demand", "optimal_quantity", "inventory_adjustment")))


def _what_if(c):
    d = c.order_items.groupBy("product_id").agg(F.sum("quantity").cast("double").alias("current_demand"))
    return c.products.select("product_id", F.col("selling_price").cast("double").alias("current_price"), F.col("cost_price").cast("double").alias("cost")).join(d, "product_id")


_W1 = """WITH b AS (SELECT product_id, CAST(selling_price AS DOUBLE) p, CAST(cost_price AS DOUBLE) k, SUM(quantity) d FROM itm JOIN prod USING (product_id) GROUP BY 1, 2, 3),
s AS (SELECT *, p * (1 + ch) np, d * (1 - 1.2 * ch) nd FROM b, (VALUES (-0.1), (0.05), (0.1)) v(ch)),
w AS (SELECT product_id, ch * 100 AS price_change_pct, np AS new_price, nd AS new_demand, np * nd - p * d AS revenue_change, (np * nd - p * d) / (p * d) * 100 AS revenue_change_pct,
  (np - k) * nd - (p - k) * d AS profit_change, ((np - k) * nd - (p - k) * d) / ((p - k) * d) * 100 AS profit_change_pct FROM s)
"""
query("w1_pricing_scenarios", "product_id:i price_change_pct:d2 new_price:d4 new_demand:d4 revenue_change:d2 revenue_change_pct:d4 profit_change:d2 profit_change_pct:d4", _W1 + "SELECT * FROM w")(
    lambda c: px.pricing_scenarios(_what_if(c), [-0.1, 0.05, 0.1], 1.2))
query("w4_compare_scenarios", "scenario_name:d2 profit_change:d2", _W1 + "SELECT price_change_pct AS scenario_name, SUM(profit_change) AS profit_change FROM w GROUP BY 1")(
    lambda c: px.compare_scenarios(px.pricing_scenarios(_what_if(c), [-0.1, 0.05, 0.1], 1.2), "price_change_pct", "profit_change"))


def segment_totals(c):
    value = c.valid_orders.groupBy("customer_id").agg(F.sum("order_total").alias("v"))
    return c.customers_base.select("customer_id", "customer_segment").join(value, "customer_id", "left").groupBy("customer_segment").agg(
        F.count("*").cast("double").alias("customers"), F.sum("v").cast("double").alias("revenue"))


_SEG = "WITH t AS (SELECT customer_segment, COUNT(*) AS n, CAST(SUM(v) AS DOUBLE) AS r FROM cust LEFT JOIN (SELECT customer_id, SUM(order_total) v FROM vord GROUP BY 1) USING (customer_id) GROUP BY 1)"
query("w2_retention_scenario", "customer_segment:s total_current_revenue:d1 total_new_revenue:d1 final_customers_current:d4 final_customers_new:d4 revenue_lift:d1 revenue_lift_pct:d4 customer_retention_lift:d4",
      _SEG + """, g AS (SELECT customer_segment, SUM(n * pow(0.9, m) * r / n) a, SUM(n * pow(0.93, m) * r / n) b, MIN(n * pow(0.9, m)) fa, MIN(n * pow(0.93, m)) fb FROM t, range(1, 13) x(m) GROUP BY 1)
SELECT customer_segment, a AS total_current_revenue, b AS total_new_revenue, fa AS final_customers_current, fb AS final_customers_new, b - a AS revenue_lift, (b - a) / a * 100 AS revenue_lift_pct, fb - fa AS customer_retention_lift FROM g""")(
    lambda c: px.retention_scenario(segment_totals(c).select("customer_segment", "customers", (F.col("revenue") / F.col("customers")).alias("revenue_per_customer")), 0.9, 0.93))
query("w5_marketing_scenario", "customer_segment:s marketing_spend:d2 expected_new_customers:d4 expected_new_revenue:d2 roi:d4 total_customers:d4 customer_growth_pct:d4 total_revenue:d2 revenue_growth_pct:d6",
      _SEG + """SELECT customer_segment, sp AS marketing_spend, sp / 1000 * 2.5 AS expected_new_customers, sp / 1000 * 250.0 AS expected_new_revenue, (sp / 1000 * 250.0 - sp) / sp AS roi, n + sp / 1000 * 2.5 AS total_customers,
  sp / 1000 * 2.5 / n * 100 AS customer_growth_pct, r + sp / 1000 * 250.0 AS total_revenue, sp / 1000 * 250.0 / r * 100 AS revenue_growth_pct FROM t, (VALUES (10000.0), (50000.0)) v(sp)""")(
    lambda c: px.marketing_scenarios(segment_totals(c), [10000.0, 50000.0], 2.5, 100.0))


def _stock_scenario(c):
    stats = demand(c).groupBy("product_id").agg(F.avg("quantity").alias("daily_demand"), F.stddev_samp("quantity").alias("demand_std"))
    stock = c.inventory.groupBy("product_id").agg(F.sum("stock_quantity").alias("current_stock"))
    return px.inventory_scenarios(stock.join(stats, "product_id"), [0.9, 0.95, 0.99])


query("w3_inventory_scenarios", "product_id:i service_level:d2 current_stock:i safety_stock:d4 reorder_point:d4 eoq:d4",
      _DEMAND + f""", k AS (SELECT product_id, SUM(stock_quantity) u FROM inv GROUP BY 1)
SELECT product_id, sl AS service_level, u AS current_stock, z * sd * sqrt(7) AS safety_stock, d * 7 + z * sd * sqrt(7) AS reorder_point, sqrt(2 * 50 * d * 365 / (0.25 * d)) AS eoq
FROM k JOIN s USING (product_id), (VALUES (0.9, {NormalDist().inv_cdf(0.9)!r}), (0.95, {Z95}), (0.99, {NormalDist().inv_cdf(0.99)!r})) v(sl, z)""")(_stock_scenario)
query("w3_stockout_probability", "product_id:i service_level:d2 stockout_probability:d6")(_stock_scenario)
