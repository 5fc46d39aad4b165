"""Product, category, supplier and store marts."""

from pyspark.sql import functions as F

from marketloom.operators import products as ops
from marketloom.plans.registry import query

_SOLD = """
WITH s AS (SELECT product_id, COUNT(DISTINCT order_id) AS total_orders, SUM(quantity) AS units_sold, SUM(line_total) AS revenue,
  SUM(quantity * cost_price) AS cogs, SUM(discount) AS discount_given, CAST(SUM(discount_pct) AS DOUBLE) / COUNT(*) AS avg_discount_pct
  FROM itm JOIN vord USING (order_id) JOIN prod USING (product_id) GROUP BY 1)"""
_P360_SPEC = (
    "product_id:i product_name:s sku_code:s brand_name:s cost_price:d2 selling_price:d2 product_margin_pct:d2 category_name:s subcategory:s supplier_name:s "
    "supplier_rating:d2 launch_date:t product_status:s total_orders:i units_sold:i revenue:d2 cogs:d2 gross_profit:d2 gross_margin_pct:d2 discount_given:d2 "
    "avg_discount_pct:d4 total_returns:i return_rate_pct:d2 avg_rating:d4 total_reviews:i five_star_reviews:i current_stock_units:i inventory_value_cost:d2 "
    "inventory_value_retail:d2 at_risk_stores_count:i"
)
_P360_SQL = _SOLD + """,
r AS (SELECT product_id, COUNT(*) n FROM ret GROUP BY 1), v AS (SELECT product_id, AVG(rating) a, COUNT(*) n, COUNT(*) FILTER (rating = 5) f FROM rev GROUP BY 1),
k AS (SELECT product_id, SUM(stock_quantity) u, COUNT(*) FILTER (stock_quantity <= 50) ar FROM inv GROUP BY 1)
SELECT p.*, 100 * CAST(selling_price - cost_price AS DOUBLE) / CAST(selling_price AS DOUBLE) AS product_margin_pct, supplier_name, q.rating AS supplier_rating,
  COALESCE(total_orders, 0) AS total_orders, COALESCE(units_sold, 0) AS units_sold, COALESCE(revenue, 0) AS revenue, COALESCE(cogs, 0) AS cogs,
  COALESCE(revenue - cogs, 0) AS gross_profit, 100 * CAST(revenue - cogs AS DOUBLE) / CAST(revenue AS DOUBLE) AS gross_margin_pct,
  COALESCE(discount_given, 0) AS discount_given, COALESCE(avg_discount_pct, 0) AS avg_discount_pct, COALESCE(r.n, 0) AS total_returns,
  COALESCE(100.0 * COALESCE(r.n, 0) / units_sold, 0) AS return_rate_pct, COALESCE(v.a, 0) AS avg_rating, COALESCE(v.n, 0) AS total_reviews,
  COALESCE(v.f, 0) AS five_star_reviews, k.u AS current_stock_units, k.u * cost_price AS inventory_value_cost, k.u * selling_price AS inventory_value_retail,
  k.ar AS at_risk_stores_count
FROM prod p LEFT JOIN supp q USING (supplier_id) LEFT JOIN s USING (product_id) LEFT JOIN r USING (product_id) LEFT JOIN v USING (product_id) LEFT JOIN k USING (product_id)"""


def _p360(c):
    return ops.product_360(c.products, c.suppliers, c.order_items, c.orders, c.returns, c.reviews, c.inventory)


query("sql02_product_360", _P360_SPEC, _P360_SQL)(_p360)
query("p1_product_360_active", _P360_SPEC, "SELECT * FROM (" + _P360_SQL.replace("WITH s AS", "WITH s AS", 1) + ") z WHERE product_status = 'Active'")(
    lambda c: _p360(c).filter(F.col("product_status") == "Active"))

_MATRIX = _SOLD + """,
b AS (SELECT p.product_id, product_name, category_name, subcategory, brand_name, COALESCE(units_sold, 0) AS units_sold, CAST(COALESCE(revenue, 0) AS DOUBLE) AS revenue_inr,
  CAST(COALESCE(revenue - cogs, 0) AS DOUBLE) AS profit_inr, COALESCE(CAST(revenue - cogs AS DOUBLE) / CAST(revenue AS DOUBLE), 0) AS margin_ratio
  FROM prod p LEFT JOIN s USING (product_id)),
m AS (SELECT quantile_cont(revenue_inr, 0.5) AS median_revenue, quantile_cont(margin_ratio, 0.5) AS median_margin FROM b),
mat AS (SELECT *, CASE WHEN revenue_inr >= median_revenue AND margin_ratio >= median_margin THEN 'Stars' WHEN revenue_inr >= median_revenue THEN 'Volume'
  WHEN margin_ratio < median_margin THEN 'Remove' ELSE 'Premium' END AS quadrant FROM b, m)
"""
_MATRIX_SPEC = "product_id:i product_name:s category_name:s subcategory:s brand_name:s units_sold:i revenue_inr:d2 profit_inr:d2 margin_ratio:d6 median_revenue:d2 median_margin:d6 quadrant:s"


def matrix(c):
    return ops.product_matrix(ops.product_sales(c.order_items, c.orders, c.products), c.products)


query("sql16_product_matrix", _MATRIX_SPEC, _MATRIX + "SELECT * FROM mat")(matrix)
query("p4_product_matrix", _MATRIX_SPEC, _MATRIX + "SELECT * FROM mat WHERE category_name = 'ECONOMY'")(
    lambda c: matrix(c).filter(F.col("category_name") == "ECONOMY"))
MATRIX_SQL = _MATRIX

_CAT = """
WITH s AS (SELECT category_name, subcategory, COUNT(DISTINCT order_id) o, SUM(line_total) r, SUM(line_total - quantity * cost_price) p, SUM(quantity) u,
  COUNT(DISTINCT product_id) sk FROM itm JOIN vord USING (order_id) JOIN prod USING (product_id) GROUP BY 1, 2),
t AS (SELECT category_name, subcategory, COUNT(*) n FROM ret JOIN prod USING (product_id) GROUP BY 1, 2),
v AS (SELECT category_name, subcategory, AVG(rating) a FROM rev JOIN prod USING (product_id) GROUP BY 1, 2),
k AS (SELECT category_name, subcategory, COUNT(*) n FROM prod GROUP BY 1, 2)
SELECT k.category_name, k.subcategory, COALESCE(o, 0) AS orders, COALESCE(r, 0) AS revenue_inr, 100 * CAST(p AS DOUBLE) / CAST(r AS DOUBLE) AS gross_margin_pct,
  COALESCE(p, 0) AS gross_profit_inr, COALESCE(u, 0) AS units_sold, {sk} AS skus, COALESCE(t.n, 0) AS returns, 100.0 * {tn} / u AS return_rate_pct, COALESCE(v.a, 0) AS avg_rating
FROM k {j} JOIN s USING (category_name, subcategory) LEFT JOIN t USING (category_name, subcategory) LEFT JOIN v USING (category_name, subcategory)"""
_CAT_SPEC = "category_name:s subcategory:s orders:i revenue_inr:d2 gross_margin_pct:d2 gross_profit_inr:d2 units_sold:i skus:i returns:i return_rate_pct:d2 avg_rating:d2"
query("sql11_category_performance", _CAT_SPEC, _CAT.replace("{sk}", "k.n").replace("{j}", "LEFT").replace("{tn}", "NULLIF(t.n, 0)"))(
    lambda c: ops.category_performance(c.products, c.order_items, c.orders, c.returns, c.reviews))
query("agg5_category_performance", _CAT_SPEC, _CAT.replace("{sk}", "s.sk").replace("{j}", "").replace("{tn}", "COALESCE(t.n, 0)"))(
    lambda c: ops.category_performance(c.products, c.order_items, c.orders, c.returns, c.reviews, sold_only=True))

_GRID = """
WITH d AS (SELECT CAST(UNNEST(generate_series((SELECT MIN(order_date) FROM {o}), (SELECT MAX(order_date) FROM {o}), INTERVAL 1 DAY)) AS DATE) AS day),
s AS (SELECT product_id, order_date AS day, SUM(quantity) u, SUM(line_total) r FROM itm JOIN vord USING (order_id) GROUP BY 1, 2),
a AS (SELECT day, COUNT(*) n FROM d JOIN camp ON day BETWEEN start_date AND end_date GROUP BY 1),
g AS (SELECT d.day, p.product_id, p.category_name, p.selling_price, COALESCE(u, 0) AS units_sold, COALESCE(r, 0) AS revenue_inr, COALESCE(a.n, 0) AS active_campaigns
  FROM d CROSS JOIN prod p LEFT JOIN s ON s.day = d.day AND s.product_id = p.product_id LEFT JOIN a ON a.day = d.day),
w AS (SELECT *, AVG(units_sold) OVER (PARTITION BY product_id ORDER BY day ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS units_7d_avg,
  AVG(units_sold) OVER (PARTITION BY product_id ORDER BY day ROWS BETWEEN 27 PRECEDING AND 1 PRECEDING) AS units_28d_avg,
  AVG(units_sold) OVER (PARTITION BY product_id ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS units_7d_ma,
  AVG(units_sold) OVER (PARTITION BY product_id ORDER BY day ROWS BETWEEN 27 PRECEDING AND CURRENT ROW) AS units_28d_ma,
  LAG(units_sold, 364) OVER (PARTITION BY product_id ORDER BY day) AS units_yoy_same_day FROM g)
"""


def _grid(c, full):
    return ops.demand_grid(c.order_items, c.orders, c.products, c.campaigns, full)


@query(
    "sql18_demand_forecast_train",
    "category_name:s day:t dow:i month:i quarter:i year:i is_weekend:i products:i units:i revenue:d2 price:d2 avg7:d4 avg28:d4 active_campaigns:i",
    _GRID.replace("{o}", "ord") + """SELECT category_name, day, isodow(day) AS dow, month(day) AS month, quarter(day) AS quarter, year(day) AS year,
  CASE WHEN isodow(day) >= 6 THEN 1 ELSE 0 END AS is_weekend, COUNT(*) AS products, SUM(units_sold) AS units, SUM(revenue_inr) AS revenue, SUM(selling_price) AS price,
  SUM(units_7d_avg) AS avg7, SUM(units_28d_avg) AS avg28, MAX(active_campaigns) AS active_campaigns FROM w GROUP BY 1, 2""",
)
def _(c):
    """Per category and day totals of the whole product x day grid."""
    g = _grid(c, False)
    return g.groupBy("category_name", "day", "dow", "month", "quarter", "year", "is_weekend").agg(
        F.count("*").alias("products"), F.sum("units_sold").alias("units"), F.sum("revenue_inr").alias("revenue"), F.sum("selling_price").alias("price"),
        F.sum("units_7d_avg").alias("avg7"), F.sum("units_28d_avg").alias("avg28"), F.max("active_campaigns").alias("active_campaigns"))


@query(
    "sql20_demand_daily",
    "category_name:s day:t dom:i iso_week:i diwali:i republic:i independence:i christmas:i units:i revenue:d2 ma7:d4 ma28:d4 yoy:i active_campaigns:i",
    _GRID.replace("{o}", "vord") + """SELECT category_name, day, day(day) AS dom, weekofyear(day) AS iso_week,
  MAX(CASE WHEN (month(day) = 10 AND day(day) BETWEEN 15 AND 25) OR (month(day) = 11 AND day(day) BETWEEN 1 AND 10) THEN 1 ELSE 0 END) AS diwali,
  MAX(CASE WHEN month(day) = 1 AND day(day) BETWEEN 20 AND 31 THEN 1 ELSE 0 END) AS republic, MAX(CASE WHEN month(day) = 8 AND day(day) BETWEEN 10 AND 20 THEN 1 ELSE 0 END) AS independence,
  MAX(CASE WHEN month(day) = 12 AND day(day) BETWEEN 20 AND 31 THEN 1 ELSE 0 END) AS christmas, SUM(units_sold) AS units, SUM(revenue_inr) AS revenue, SUM(units_7d_ma) AS ma7,
  SUM(units_28d_ma) AS ma28, SUM(units_yoy_same_day) AS yoy, MAX(active_campaigns) AS active_campaigns FROM w GROUP BY 1, 2""",
)
def _(c):
    """Per category and day totals of the whole product x day grid."""
    g = _grid(c, True)
    return g.groupBy("category_name", "day", "dom", "iso_week").agg(
        F.max("is_diwali_season").alias("diwali"), F.max("is_republic_day_sale").alias("republic"), F.max("is_independence_sale").alias("independence"),
        F.max("is_christmas_sale").alias("christmas"), F.sum("units_sold").alias("units"), F.sum("revenue_inr").alias("revenue"), F.sum("units_7d_ma").alias("ma7"),
        F.sum("units_28d_ma").alias("ma28"), F.sum("units_yoy_same_day").alias("yoy"), F.max("active_campaigns").alias("active_campaigns"))


query(
    "sql22_supplier_performance",
    "supplier_id:i supplier_name:s state:s supplier_rating:d2 reliability_score:d2 contract_lead_time_days:i sku_count:i orders_supplied:i units_supplied:i revenue_inr:d2 "
    "total_cogs_inr:d2 avg_margin_pct:d2 return_count:i return_qty:i return_rate_pct:d2 sku_store_count:i total_stock_units:i stock_value_cost_inr:d2 low_stock_sku_stores:i composite_score:d2",
    """
WITH s AS (SELECT supplier_id, COUNT(DISTINCT order_id) o, SUM(quantity) u, SUM(line_total) r, SUM(quantity * cost_price) g FROM itm JOIN vord USING (order_id) JOIN prod USING (product_id) GROUP BY 1),
t AS (SELECT supplier_id, COUNT(*) n, SUM(quantity_returned) q FROM ret JOIN prod USING (product_id) GROUP BY 1),
k AS (SELECT supplier_id, COUNT(*) n, SUM(stock_quantity) u, SUM(stock_quantity * cost_price) v, COUNT(*) FILTER (stock_quantity <= 50) l FROM inv JOIN prod USING (product_id) GROUP BY 1),
c AS (SELECT supplier_id, COUNT(*) n FROM prod GROUP BY 1)
SELECT supp.supplier_id, supplier_name, state, rating AS supplier_rating, reliability_score, lead_time_days AS contract_lead_time_days, COALESCE(c.n, 0) AS sku_count,
  COALESCE(o, 0) AS orders_supplied, COALESCE(s.u, 0) AS units_supplied, COALESCE(r, 0) AS revenue_inr, COALESCE(g, 0) AS total_cogs_inr,
  COALESCE(100 * CAST(r - g AS DOUBLE) / CAST(r AS DOUBLE), 0) AS avg_margin_pct, COALESCE(t.n, 0) AS return_count, COALESCE(t.q, 0) AS return_qty,
  100.0 * NULLIF(t.q, 0) / NULLIF(s.u, 0) AS return_rate_pct, COALESCE(k.n, 0) AS sku_store_count, COALESCE(k.u, 0) AS total_stock_units, COALESCE(k.v, 0) AS stock_value_cost_inr,
  COALESCE(k.l, 0) AS low_stock_sku_stores, CAST(rating AS DOUBLE) * 20 + CAST(reliability_score AS DOUBLE) * 0.4 - COALESCE(100.0 * t.q / NULLIF(s.u, 1), 0) * 0.5 AS composite_score
FROM supp LEFT JOIN s USING (supplier_id) LEFT JOIN t USING (supplier_id) LEFT JOIN k USING (supplier_id) LEFT JOIN c USING (supplier_id)""",
)(lambda c: ops.supplier_performance(c.suppliers, c.products, c.order_items, c.orders, c.returns, c.inventory))

query(
    "sql23_store_performance",
    "store_id:i store_name:s store_type:s store_city:s store_state:s opening_date:t orders:i revenue_inr:d2 unique_customers:i aov_inr:d2 return_rate_pct:d2 shipping_cost_inr:d2 skus_carried:i "
    "total_stock_units:i stock_value_cost_inr:d2 stock_value_retail_inr:d2 low_stock_skus:i headcount:i avg_staff_performance:d2 revenue_per_employee:d2 inventory_turns_ratio:d2 shipping_pct_of_revenue:d2",
    """
WITH s AS (SELECT store_id, COUNT(*) o, SUM(order_total) FILTER (order_status <> 'Cancelled') r, COUNT(DISTINCT customer_id) u, COUNT(*) FILTER (order_status = 'Returned') t,
  SUM(shipping_cost) FILTER (order_status <> 'Cancelled') h FROM ord GROUP BY 1),
k AS (SELECT store_id, COUNT(DISTINCT product_id) n, SUM(stock_quantity) u, SUM(stock_quantity * cost_price) c, SUM(stock_quantity * selling_price) p, COUNT(*) FILTER (stock_quantity <= 50) l
  FROM inv JOIN prod USING (product_id) GROUP BY 1),
e AS (SELECT store_id, COUNT(*) n, AVG(CAST(performance_score AS DOUBLE)) a FROM emp GROUP BY 1)
SELECT stor.*, o AS orders, r AS revenue_inr, s.u AS unique_customers, CAST(r AS DOUBLE) / o AS aov_inr, 100.0 * t / o AS return_rate_pct, h AS shipping_cost_inr, k.n AS skus_carried,
  k.u AS total_stock_units, k.c AS stock_value_cost_inr, k.p AS stock_value_retail_inr, k.l AS low_stock_skus, e.n AS headcount, e.a AS avg_staff_performance,
  CAST(r AS DOUBLE) / NULLIF(e.n, 1) AS revenue_per_employee, CAST(r AS DOUBLE) / CAST(k.c AS DOUBLE) AS inventory_turns_ratio, 100 * CAST(NULLIF(h, 0) AS DOUBLE) / CAST(r AS DOUBLE) AS shipping_pct_of_revenue
FROM stor LEFT JOIN s USING (store_id) LEFT JOIN k USING (store_id) LEFT JOIN e USING (store_id)""",
)(lambda c: ops.store_performance(c.stores, c.orders, c.inventory, c.products, c.employees))

query(
    "p2_product_lifecycle",
    "product_id:i product_name:s launch_date:t months_since_launch:i revenue_mom_growth_pct:d4 lifecycle_stage:s",
    """
WITH m AS (SELECT product_id, date_trunc('month', order_date) mo, CAST(SUM(line_total) AS DOUBLE) r FROM itm JOIN vord USING (order_id) GROUP BY 1, 2),
g AS (SELECT *, 100 * (r - LAG(r) OVER w) / LAG(r) OVER w g, ROW_NUMBER() OVER (PARTITION BY product_id ORDER BY mo DESC) k FROM m WINDOW w AS (PARTITION BY product_id ORDER BY mo)),
x AS (SELECT p.product_id, product_name, launch_date, (year(mo) - year(launch_date)) * 12 + month(mo) - month(launch_date) AS months_since_launch, g AS revenue_mom_growth_pct, mo
  FROM prod p LEFT JOIN g ON g.product_id = p.product_id AND k = 1)
SELECT *, CASE WHEN mo IS NULL THEN 'Not Launched / No Sales' WHEN months_since_launch <= 1 THEN 'Introduction' WHEN months_since_launch <= 3 AND COALESCE(revenue_mom_growth_pct, 0) >= 10 THEN 'Growth'
  WHEN COALESCE(revenue_mom_growth_pct, 0) > 5 THEN 'Growth' WHEN COALESCE(revenue_mom_growth_pct, 0) >= -10 THEN 'Maturity' ELSE 'Decline' END AS lifecycle_stage FROM x""",
)(lambda c: ops.product_lifecycle(c.order_items, c.orders, c.products))

query(
    "p3_price_elasticity",
    "product_id:i product_name:s samples:i avg_price:d2 avg_quantity:d2 price_std:d2 price_qty_correlation:d4 price_elasticity:d4 elasticity_type:s",
    """
WITH a AS (SELECT product_id, COUNT(*) AS samples, AVG(unit_price) AS avg_price, AVG(quantity) AS avg_quantity, STDDEV_POP(unit_price) AS price_std,
  CORR(unit_price, quantity) AS price_qty_correlation, REGR_SLOPE(quantity, unit_price) * AVG(unit_price) / AVG(quantity) AS price_elasticity FROM itm GROUP BY 1 HAVING COUNT(*) >= 10)
SELECT a.*, product_name, CASE WHEN ABS(price_elasticity) > 1 THEN 'Elastic' WHEN ABS(price_elasticity) < 1 THEN 'Inelastic' ELSE 'Unit Elastic' END AS elasticity_type FROM a JOIN prod USING (product_id)""",
)(lambda c: ops.price_quantity_elasticity(c.order_items, c.products))
