"""Customer marts."""

from pyspark.sql import functions as F

from marketloom.operators import customers as ops
from marketloom.plans.registry import query
from marketloom.sources.commerce import AS_OF

_C360_SPEC = (
    "customer_id:i customer_name:s gender:s age:i state:s customer_segment:s signup_channel:s signup_date:t "
    "total_orders:i cancelled_orders:i returned_orders:i total_revenue:d2 total_discount:d2 avg_order_value:d2 "
    "first_order_date:t last_order_date:t days_since_last_order:i active_months:i unique_products_bought:i "
    "total_returns:i avg_rating_given:d4 reviews_written:i total_paid:d2 website_sessions:i"
)
_C360_SQL = """
WITH o AS (SELECT customer_id, COUNT(*) n, COUNT(*) FILTER (order_status = 'Cancelled') cn, COUNT(*) FILTER (order_status = 'Returned') rn,
  SUM(CASE WHEN order_status <> 'Cancelled' THEN order_total ELSE 0 END) rev, SUM(CASE WHEN order_status <> 'Cancelled' THEN discount_amount ELSE 0 END) dis,
  COUNT(*) FILTER (order_status <> 'Cancelled') vn,
  MIN(order_date) f, MAX(order_date) l, COUNT(DISTINCT date_trunc('month', order_date)) am FROM ord GROUP BY 1),
p AS (SELECT customer_id, COUNT(DISTINCT product_id) u FROM ord JOIN itm USING (order_id) GROUP BY 1),
r AS (SELECT customer_id, COUNT(*) n FROM ret JOIN ord USING (order_id) GROUP BY 1),
v AS (SELECT customer_id, AVG(rating) a, COUNT(*) n FROM rev GROUP BY 1),
y AS (SELECT customer_id, SUM(amount) FILTER (payment_status = 'Success') s FROM pay GROUP BY 1),
w AS (SELECT customer_id, COUNT(*) n FROM sess GROUP BY 1)
SELECT c.*, COALESCE(o.n, 0) AS total_orders, COALESCE(cn, 0) AS cancelled_orders, COALESCE(rn, 0) AS returned_orders,
  COALESCE(o.rev, 0) AS total_revenue, COALESCE(dis, 0) AS total_discount, COALESCE(CAST(o.rev AS DOUBLE) / NULLIF(vn, 0), 0) AS avg_order_value,
  f AS first_order_date, l AS last_order_date, DATE '2001-08-01' - COALESCE(l, signup_date) AS days_since_last_order,
  COALESCE(am, 0) AS active_months, COALESCE(u, 0) AS unique_products_bought, COALESCE(r.n, 0) AS total_returns,
  COALESCE(v.a, 0) AS avg_rating_given, COALESCE(v.n, 0) AS reviews_written, COALESCE(y.s, 0) AS total_paid, COALESCE(w.n, 0) AS website_sessions
FROM cust c LEFT JOIN o USING (customer_id) LEFT JOIN p USING (customer_id) LEFT JOIN r USING (customer_id)
LEFT JOIN v USING (customer_id) LEFT JOIN y USING (customer_id) LEFT JOIN w USING (customer_id)"""


@query("sql01_customer_360", _C360_SPEC, _C360_SQL)
def _(c):
    return ops.customer_360(c.customers, c.orders, c.order_items, c.returns, c.reviews, c.payments, c.sessions, AS_OF)


@query("c1_customer_360_asof_2000", _C360_SPEC, _C360_SQL.replace("DATE '2001-08-01' - COALESCE", "DATE '2000-12-31' - COALESCE"))
def _(c):
    import datetime as dt

    return ops.customer_360(
        c.customers, c.orders, c.order_items, c.returns, c.reviews, c.payments, c.sessions, dt.date(2000, 12, 31)
    )


_SEGMENT_SQL = """CASE WHEN r_score = 5 AND f_score >= 4 AND m_score >= 4 THEN 'Champions'
  WHEN r_score >= 4 AND f_score >= 3 AND m_score >= 3 THEN 'Loyal Customers'
  WHEN r_score >= 4 AND f_score BETWEEN 1 AND 3 AND m_score BETWEEN 2 AND 3 THEN 'Potential Loyalists'
  WHEN r_score = 5 AND f_score <= 2 AND m_score <= 2 THEN 'New Customers'
  WHEN r_score = 2 AND f_score >= 2 AND m_score >= 2 THEN 'At Risk'
  WHEN r_score = 1 AND f_score >= 4 AND m_score >= 4 THEN 'Can''t Lose Them'
  WHEN r_score <= 2 AND f_score <= 2 AND m_score <= 2 THEN 'Lost Customers' ELSE 'Other' END"""
RFM_SQL = f"""
WITH b AS (SELECT c.customer_id, ANY_VALUE(customer_segment) AS assigned_segment, COALESCE(MAX(order_date), ANY_VALUE(signup_date)) AS last_order_date,
  COUNT(order_id) AS frequency, COALESCE(SUM(CASE WHEN order_status <> 'Cancelled' THEN order_total END), 0) AS monetary_value
  FROM cust c LEFT JOIN ord o ON o.customer_id = c.customer_id GROUP BY 1),
s AS (SELECT *, DATE '2001-08-01' - last_order_date AS recency_days,
  NTILE(5) OVER (ORDER BY last_order_date, customer_id) AS r_score,
  CASE WHEN frequency = 0 THEN 1 ELSE NTILE(5) OVER (ORDER BY frequency, customer_id) END AS f_score,
  CASE WHEN monetary_value = 0 THEN 1 ELSE NTILE(5) OVER (ORDER BY monetary_value, customer_id) END AS m_score FROM b)
SELECT *, r_score + f_score + m_score AS rfm_total, r_score * 100 + f_score * 10 + m_score AS rfm_cell, {_SEGMENT_SQL} AS rfm_segment FROM s"""


@query(
    "sql07_rfm_segments",
    "customer_id:i assigned_segment:s last_order_date:t recency_days:i frequency:i monetary_value:d2 r_score:i f_score:i m_score:i "
    "rfm_total:i rfm_cell:i rfm_segment:s",
    RFM_SQL,
)
def _(c):
    return ops.rfm_ntile(c.customers, c.orders, AS_OF)


RFM_ZERO_SQL = f"""
WITH b AS (SELECT c.customer_id, ANY_VALUE(customer_segment) AS customer_segment, COALESCE(MAX(order_date), ANY_VALUE(signup_date)) AS last_order_date,
  COUNT(order_id) AS frequency, COALESCE(SUM(order_total), 0) AS monetary_value
  FROM cust c LEFT JOIN vord o ON o.customer_id = c.customer_id GROUP BY 1),
b2 AS (SELECT *, (SELECT MAX(order_date) FROM vord) - last_order_date AS recency_days FROM b),
k AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY recency_days = 0 ORDER BY recency_days, customer_id) rr, COUNT(*) OVER (PARTITION BY recency_days = 0) rn,
  ROW_NUMBER() OVER (PARTITION BY frequency = 0 ORDER BY frequency, customer_id) fr, COUNT(*) OVER (PARTITION BY frequency = 0) fn,
  ROW_NUMBER() OVER (PARTITION BY monetary_value = 0 ORDER BY monetary_value, customer_id) mr, COUNT(*) OVER (PARTITION BY monetary_value = 0) mn FROM b2),
s AS (SELECT *, CASE WHEN recency_days = 0 THEN 1 ELSE 6 - GREATEST(1, ((rr - 1) * 5 + rn - 2) // (rn - 1)) END AS r_score,
  CASE WHEN frequency = 0 THEN 1 ELSE GREATEST(1, ((fr - 1) * 5 + fn - 2) // (fn - 1)) END AS f_score,
  CASE WHEN monetary_value = 0 THEN 1 ELSE GREATEST(1, ((mr - 1) * 5 + mn - 2) // (mn - 1)) END AS m_score FROM k)
SELECT *, r_score + f_score + m_score AS rfm_total, r_score * 100 + f_score * 10 + m_score AS rfm_cell, {_SEGMENT_SQL} AS rfm_segment FROM s"""


@query(
    "c4_rfm_zero_aware",
    "customer_id:i customer_segment:s last_order_date:t recency_days:i frequency:i monetary_value:d2 r_score:i f_score:i m_score:i "
    "rfm_total:i rfm_cell:i rfm_segment:s",
    RFM_ZERO_SQL,
)
def _(c):
    return ops.rfm_zero_aware(c.customers, c.orders)


@query(
    "sql12_lifetime_cohorts",
    "signup_month:t customer_segment:s cohort_size:i avg_ltv_inr:d2 avg_purchase_frequency:d2 avg_aov_inr:d2 avg_lifespan_days:d1 cohort_return_rate_pct:d2",
    """
WITH p AS (SELECT c.customer_id, date_trunc('month', signup_date) m, customer_segment s, COUNT(order_id) n,
  CAST(COALESCE(SUM(CASE WHEN order_status <> 'Cancelled' THEN order_total END), 0) AS DOUBLE) sp,
  MAX(order_date) - MIN(order_date) life, COUNT(*) FILTER (order_status = 'Returned') r
  FROM cust c LEFT JOIN ord o ON o.customer_id = c.customer_id GROUP BY 1, 2, 3)
SELECT m AS signup_month, s AS customer_segment, COUNT(*) AS cohort_size, SUM(sp) / COUNT(*) AS avg_ltv_inr, AVG(n) AS avg_purchase_frequency,
  AVG(NULLIF(sp, 0) / NULLIF(n, 0)) AS avg_aov_inr, AVG(life) AS avg_lifespan_days, 100.0 * NULLIF(SUM(r), 0) / NULLIF(SUM(n), 0) AS cohort_return_rate_pct
FROM p GROUP BY 1, 2""",
)
def _(c):
    return ops.lifetime_cohorts(c.customers, c.orders)


PROFIT_SQL = """
WITH pc AS (SELECT customer_id, COUNT(DISTINCT order_id) n, SUM(line_total) lr, SUM(line_total - quantity * cost_price) pr
  FROM vord JOIN itm USING (order_id) JOIN prod USING (product_id) GROUP BY 1),
orv AS (SELECT customer_id, SUM(order_total) r FROM vord WHERE order_id IN (SELECT order_id FROM itm) GROUP BY 1)"""


@query(
    "sql13_top_customers",
    "customer_id:i customer_name:s state:s customer_segment:s total_orders:i total_revenue:d2 total_profit:d2 profit_rank:i profit_share_pct:d4",
    PROFIT_SQL + """
SELECT * FROM (SELECT customer_id, customer_name, state, customer_segment, n AS total_orders, orv.r AS total_revenue, pr AS total_profit,
  ROW_NUMBER() OVER (ORDER BY pr DESC, customer_id) AS profit_rank, 100 * CAST(pr AS DOUBLE) / CAST(SUM(pr) OVER () AS DOUBLE) AS profit_share_pct
  FROM pc JOIN orv USING (customer_id) JOIN cust USING (customer_id)) WHERE profit_rank <= 10""",
)
def _(c):
    return ops.top_customers(c.customers_base, c.orders, c.order_items, c.products)


_PARETO_SQL = PROFIT_SQL + """,
par AS (SELECT customer_id, n AS total_orders, lr AS total_revenue, pr AS total_profit, ROW_NUMBER() OVER (ORDER BY pr DESC, customer_id) AS profit_rank,
  SUM(pr) OVER (ORDER BY pr DESC, customer_id ROWS UNBOUNDED PRECEDING) AS cumulative_profit, SUM(pr) OVER () al, COUNT(*) OVER () nn FROM pc)"""


@query(
    "c3_pareto",
    "customer_id:i customer_name:s customer_segment:s total_orders:i total_revenue:d2 total_profit:d2 profit_rank:i cumulative_profit:d2 "
    "cumulative_profit_pct:d4 percentile:d4",
    _PARETO_SQL + """
SELECT par.*, customer_name, customer_segment, 100 * CAST(cumulative_profit AS DOUBLE) / CAST(al AS DOUBLE) AS cumulative_profit_pct,
  100.0 * profit_rank / nn AS percentile FROM par JOIN cust USING (customer_id)""",
)
def _(c):
    return ops.pareto(c.customers_base, c.orders, c.order_items, c.products)


@query(
    "c3_pareto_shares",
    "total_customers:i total_profit_inr:d2 top_10pct_profit_share_pct:d2 top_20pct_profit_share_pct:d2 top_50pct_profit_share_pct:d2",
    _PARETO_SQL + """
SELECT COUNT(*) AS total_customers, SUM(total_profit) AS total_profit_inr,
  100 * CAST(SUM(total_profit) FILTER (profit_rank <= GREATEST(1, nn * 10 // 100)) AS DOUBLE) / CAST(SUM(total_profit) AS DOUBLE) AS top_10pct_profit_share_pct,
  100 * CAST(SUM(total_profit) FILTER (profit_rank <= GREATEST(1, nn * 20 // 100)) AS DOUBLE) / CAST(SUM(total_profit) AS DOUBLE) AS top_20pct_profit_share_pct,
  100 * CAST(SUM(total_profit) FILTER (profit_rank <= GREATEST(1, nn * 50 // 100)) AS DOUBLE) / CAST(SUM(total_profit) AS DOUBLE) AS top_50pct_profit_share_pct
FROM par""",
)
def _(c):
    return ops.pareto_shares(ops.pareto(c.customers_base, c.orders, c.order_items, c.products))


_COHORT = """
WITH s AS (SELECT customer_id, date_trunc('month', signup_date) AS cohort_month FROM cust),
z AS (SELECT cohort_month, COUNT(*) AS cohort_size FROM s GROUP BY 1),
a AS (SELECT cohort_month, date_diff('month', cohort_month, order_date) AS months_since_signup, COUNT(DISTINCT customer_id) AS active_customers,
  SUM(order_total) AS revenue_inr FROM vord JOIN s USING (customer_id) GROUP BY 1, 2),
f AS (SELECT *, 100.0 * active_customers / cohort_size AS retention_pct FROM a JOIN z USING (cohort_month) WHERE months_since_signup BETWEEN 0 AND 11)
"""


@query("sql15_cohort_retention", "cohort_month:t cohort_size:i months_since_signup:i active_customers:i retention_pct:d2",
       _COHORT + "SELECT * FROM f")
def _(c):
    return ops.cohort_activity(c.customers, c.orders)


@query("c2_cohort_revenue", "cohort_month:t months_since_signup:i revenue_inr:d2", _COHORT + "SELECT * FROM f")
def _(c):
    return ops.cohort_activity(c.customers, c.orders)


@query("c2_cohort_pivot", "cohort_month:t " + " ".join(f"m{i}:d2" for i in range(12)),
       _COHORT + "SELECT cohort_month, " + ", ".join(
           f"MAX(retention_pct) FILTER (months_since_signup = {i}) AS m{i}" for i in range(12)) + " FROM f GROUP BY 1")
def _(c):
    return ops.cohort_pivot(ops.cohort_activity(c.customers, c.orders))


CLV_SQL = """
WITH lp AS (SELECT order_id, SUM(line_total - quantity * cost_price) p FROM itm JOIN prod USING (product_id) GROUP BY 1),
a AS (SELECT customer_id, COUNT(*) n, CAST(SUM(order_total) AS DOUBLE) r, CAST(COALESCE(SUM(p), 0) AS DOUBLE) pr, MAX(order_date) - MIN(order_date) life
  FROM vord LEFT JOIN lp USING (order_id) GROUP BY 1),
g AS (SELECT SUM(pr) / SUM(r) gm FROM a),
b AS (SELECT c.customer_id, COALESCE(n, 0) AS total_orders, COALESCE(r, 0) AS total_revenue, COALESCE(pr, 0) AS total_profit, COALESCE(life, 0) AS lifespan_days FROM cust c LEFT JOIN a USING (customer_id)),
v AS (SELECT *, COALESCE(total_revenue / NULLIF(total_orders, 0), 0) AS avg_order_value,
  CASE WHEN lifespan_days > 0 THEN total_orders / (lifespan_days / 30.0) ELSE total_orders / 36.0 END AS purchase_frequency FROM b),
w AS (SELECT *, ROUND(avg_order_value * purchase_frequency * 36 * (SELECT gm FROM g) * 1.000000000001, 2) AS clv FROM v),
t AS (SELECT *, ROW_NUMBER() OVER (ORDER BY clv, customer_id) k, COUNT(*) OVER () m FROM w),
clv AS (SELECT *, CASE GREATEST(1, ((k - 1) * 5 + m - 2) // (m - 1)) WHEN 1 THEN 'Low' WHEN 2 THEN 'Medium-Low' WHEN 3 THEN 'Medium' WHEN 4 THEN 'Medium-High' ELSE 'High' END AS customer_value_tier FROM t)
"""


@query(
    "c5_clv_simple",
    "customer_id:i total_orders:i total_revenue:d2 total_profit:d2 avg_order_value:d2 lifespan_days:i purchase_frequency:d6 clv:d1 customer_value_tier:s",
    CLV_SQL + "SELECT * FROM clv",
)
def _(c):
    return ops.clv_simple(c.customers_base, c.orders, c.order_items, c.products)


@query(
    "c6_churn_features_cutoff",
    "customer_id:i state:s customer_segment:s age:i gender:s total_orders:i avg_order_value:d2 total_spend:d2 avg_discount_amount:d4 returns_count:i "
    "return_rate:d4 discount_usage_pct:d4 total_units_bought:i sessions_count:i avg_page_views:d4 avg_session_sec:d4 checkout_rate:d4 "
    "avg_review_rating:d4 review_count:i customer_tenure_days:i days_since_last_order:i churn_label_90d:i",
    """
WITH k AS (SELECT DATE '2001-05-01' d),
o AS (SELECT customer_id, MAX(order_date) l, COUNT(*) n, CAST(SUM(order_total) AS DOUBLE) sp, CAST(SUM(discount_amount) AS DOUBLE) di,
  COUNT(*) FILTER (order_status = 'Returned') rt FROM ord, k WHERE order_date <= d GROUP BY 1),
p AS (SELECT DISTINCT customer_id FROM ord, k WHERE order_date > d AND order_date <= DATE '2001-08-01'),
u AS (SELECT customer_id, SUM(quantity) u FROM ord JOIN itm USING (order_id), k WHERE order_date <= d GROUP BY 1),
w AS (SELECT customer_id, COUNT(*) n, AVG(page_views) pv, AVG(session_duration_sec) ss, AVG(checkout_completed) cr FROM sess, k WHERE session_date <= d GROUP BY 1),
v AS (SELECT customer_id, AVG(rating) a, COUNT(*) n FROM rev, k WHERE review_date <= d GROUP BY 1)
SELECT c.customer_id, c.state, c.customer_segment, c.age, c.gender, COALESCE(o.n, 0) AS total_orders, COALESCE(sp / o.n, 0) AS avg_order_value,
  COALESCE(sp, 0) AS total_spend, COALESCE(di / o.n, 0) AS avg_discount_amount, COALESCE(rt, 0) AS returns_count,
  COALESCE(1.0 * rt / o.n, 0) AS return_rate, COALESCE(100 * (di / o.n) / (sp / o.n), 0) AS discount_usage_pct, COALESCE(u.u, 0) AS total_units_bought,
  COALESCE(w.n, 0) AS sessions_count, COALESCE(pv, 0) AS avg_page_views, COALESCE(ss, 0) AS avg_session_sec, COALESCE(cr, 0) AS checkout_rate,
  COALESCE(v.a, 0) AS avg_review_rating, COALESCE(v.n, 0) AS review_count, k.d - signup_date AS customer_tenure_days,
  CASE WHEN o.n > 0 THEN k.d - o.l ELSE k.d - signup_date END AS days_since_last_order,
  CASE WHEN p.customer_id IS NULL AND o.n >= 1 THEN 1 ELSE 0 END AS churn_label_90d
FROM k, cust c LEFT JOIN o USING (customer_id) LEFT JOIN p USING (customer_id) LEFT JOIN u USING (customer_id) LEFT JOIN w USING (customer_id) LEFT JOIN v USING (customer_id)""",
)
def _(c):
    return ops.churn_features_cutoff(c.customers, c.orders, c.order_items, c.reviews, c.sessions, AS_OF)


@query(
    "sql17_churn_features",
    "customer_id:i age:i gender:s state:s customer_segment:s days_since_last_order:i total_orders:i avg_order_value:d2 total_spend:d2 return_rate:d4 "
    "avg_discount_used:d2 website_sessions:i avg_page_views:d2 avg_session_sec:d2 avg_review_rating:d2 customer_tenure_days:i churn_label_90d:i",
    """
WITH o AS (SELECT customer_id, MAX(order_date) l, COUNT(*) n, CAST(SUM(order_total) AS DOUBLE) sp, CAST(SUM(discount_amount) AS DOUBLE) di,
  COUNT(*) FILTER (order_status = 'Returned') rt FROM ord GROUP BY 1),
w AS (SELECT customer_id, COUNT(*) n, AVG(page_views) pv, AVG(session_duration_sec) ss FROM sess GROUP BY 1),
v AS (SELECT customer_id, AVG(rating) a FROM rev GROUP BY 1)
SELECT c.*, DATE '2001-08-01' - COALESCE(l, signup_date) AS days_since_last_order, COALESCE(o.n, 0) AS total_orders, COALESCE(sp / o.n, 0) AS avg_order_value,
  COALESCE(sp, 0) AS total_spend, COALESCE(1.0 * rt / o.n, 0) AS return_rate, COALESCE(di / o.n, 0) AS avg_discount_used, COALESCE(w.n, 0) AS website_sessions,
  COALESCE(pv, 0) AS avg_page_views, COALESCE(ss, 0) AS avg_session_sec, COALESCE(v.a, 0) AS avg_review_rating, DATE '2001-08-01' - signup_date AS customer_tenure_days,
  CASE WHEN DATE '2001-08-01' - COALESCE(l, signup_date) > 90 AND o.n >= 1 THEN 1 ELSE 0 END AS churn_label_90d
FROM cust c LEFT JOIN o USING (customer_id) LEFT JOIN w USING (customer_id) LEFT JOIN v USING (customer_id)""",
)
def _(c):
    return ops.churn_features_view(c.customers, c.orders, c.sessions, c.reviews, AS_OF)


_BEHAVIOUR = {
    "c8": """SELECT customer_id, COUNT(*) AS total_orders, COUNT(*) / (MAX(order_date) - MIN(order_date) + 1) AS purchase_frequency,
  CASE WHEN COUNT(*) FILTER (order_date < DATE '2001-05-03') > 0 THEN COUNT(*) FILTER (order_date >= DATE '2001-05-03') / COUNT(*) FILTER (order_date < DATE '2001-05-03')
    ELSE COUNT(*) FILTER (order_date >= DATE '2001-05-03') END AS purchase_acceleration,
  STDDEV_SAMP(order_date - DATE '1970-01-01') AS order_date_std FROM ord GROUP BY 1""",
    "c9": """SELECT customer_id, AVG(bs) AS avg_basket_size, CAST(SUM(order_total) AS DOUBLE) / COUNT(*) AS avg_basket_value,
  COALESCE((CAST(SUM(order_total) FILTER (order_date >= DATE '2001-05-03') AS DOUBLE) / COUNT(*) FILTER (order_date >= DATE '2001-05-03'))
   / (CAST(SUM(order_total) FILTER (order_date < DATE '2001-05-03') AS DOUBLE) / COUNT(*) FILTER (order_date < DATE '2001-05-03')), 1) AS basket_value_trend
  FROM ord LEFT JOIN (SELECT order_id, COUNT(*) bs FROM itm GROUP BY 1) USING (order_id) GROUP BY 1""",
    "c10": """SELECT customer_id, COUNT(*) AS total_sessions, AVG(session_duration_sec) AS avg_session_duration,
  COALESCE((COUNT(*) FILTER (cart_adds > 0) - COUNT(*) FILTER (checkout_completed > 0)) / NULLIF(COUNT(*) FILTER (cart_adds > 0), 0), 0) AS cart_abandonment_rate,
  COALESCE((COUNT(*) FILTER (checkout_started > 0) - COUNT(*) FILTER (checkout_completed > 0)) / NULLIF(COUNT(*) FILTER (checkout_started > 0), 0), 0) AS checkout_abandonment_rate
  FROM sess GROUP BY 1""",
    "c11": """SELECT customer_id, COUNT(*) FILTER (discount_pct > 0) / COUNT(*) AS discount_dependency, CAST(SUM(discount_pct) AS DOUBLE) / COUNT(*) AS avg_discount_pct,
  CASE WHEN COUNT(*) > 1 AND STDDEV_POP(quantity) > 0 AND STDDEV_POP(CAST(selling_price AS DOUBLE)) > 0 THEN CORR(CAST(selling_price AS DOUBLE), quantity) ELSE 0 END AS price_sensitivity
  FROM itm JOIN ord USING (order_id) JOIN prod USING (product_id) GROUP BY 1""",
    "c12": "SELECT customer_id, COUNT(*) FILTER (order_status = 'Returned') / COUNT(*) AS return_rate FROM ord GROUP BY 1",
    "c13": """SELECT customer_id, DATE '2001-08-01' - MIN(order_date) AS customer_tenure_days, DATE '2001-08-01' - MAX(order_date) AS days_since_last_order,
  COALESCE(AVG(gap), DATE '2001-08-01' - MIN(order_date)) AS avg_interpurchase_days, COALESCE(STDDEV_SAMP(gap), 0) AS std_interpurchase_days
  FROM (SELECT *, order_date - LAG(order_date) OVER (PARTITION BY customer_id ORDER BY order_date, order_id) gap FROM ord) GROUP BY 1""",
    "c14": """SELECT customer_id, COUNT(*) AS unique_categories, ANY_VALUE(ub) AS unique_brands, SUM((n / t) * (n / t)) AS category_concentration
  FROM (SELECT customer_id, category_name, COUNT(*) n FROM itm JOIN ord USING (order_id) JOIN prod USING (product_id) GROUP BY 1, 2)
  JOIN (SELECT customer_id, COUNT(*) t, COUNT(DISTINCT brand_name) ub FROM itm JOIN ord USING (order_id) JOIN prod USING (product_id) GROUP BY 1) USING (customer_id) GROUP BY 1""",
}
_BEHAVIOUR_SPEC = {
    "c8": "total_orders:i purchase_frequency:d6 purchase_acceleration:d6 order_date_std:d4",
    "c9": "avg_basket_size:d4 avg_basket_value:d2 basket_value_trend:d6",
    "c10": "total_sessions:i avg_session_duration:d4 cart_abandonment_rate:d4 checkout_abandonment_rate:d4",
    "c11": "discount_dependency:d4 avg_discount_pct:d4 price_sensitivity:d6",
    "c12": "return_rate:d6",
    "c13": "customer_tenure_days:i days_since_last_order:i avg_interpurchase_days:d4 std_interpurchase_days:d4",
    "c14": "unique_categories:i unique_brands:i category_concentration:d6",
}
_BEHAVIOUR_FN = {
    "c8": ("purchase_patterns", lambda c: ops.purchase_patterns(c.orders, AS_OF)),
    "c9": ("basket_characteristics", lambda c: ops.basket_characteristics(c.orders, c.order_items, AS_OF)),
    "c10": ("engagement_metrics", lambda c: ops.engagement_metrics(c.sessions)),
    "c11": ("price_sensitivity", lambda c: ops.price_sensitivity(c.orders, c.order_items, c.products)),
    "c12": ("return_propensity", lambda c: ops.return_propensity(c.orders)),
    "c13": ("temporal_patterns", lambda c: ops.temporal_patterns(c.orders, AS_OF)),
    "c14": ("diversity_metrics", lambda c: ops.diversity_metrics(c.orders, c.order_items, c.products)),
}
for _id, (_name, _fn) in _BEHAVIOUR_FN.items():
    query(f"{_id}_{_name}", "customer_id:i " + _BEHAVIOUR_SPEC[_id], _BEHAVIOUR[_id])(_fn)


def behaviour(c):
    return ops.behavioral_features(c.customers_base, c.orders, c.order_items, c.sessions, c.products, AS_OF)


_FILL = {"total_sessions", "avg_session_duration", "cart_abandonment_rate", "checkout_abandonment_rate", "discount_dependency",
         "avg_discount_pct", "price_sensitivity", "return_rate", "unique_categories", "unique_brands", "category_concentration",
         "customer_tenure_days", "days_since_last_order", "avg_interpurchase_days", "std_interpurchase_days"}
_COLS = [item.split(":")[0] for s in _BEHAVIOUR_SPEC.values() for item in s.split()]
BEHAVIOUR_SQL = (
    "WITH " + ", ".join(f"{k} AS ({v})" for k, v in _BEHAVIOUR.items())
    + ", beh AS (SELECT c.customer_id, " + ", ".join(f"COALESCE({n}, 0) AS {n}" if n in _FILL else n for n in _COLS)
    + " FROM cust c " + " ".join(f"LEFT JOIN {k} USING (customer_id)" for k in _BEHAVIOUR) + ")"
)


@query("c7_behavioral_features", "customer_id:i " + " ".join(_BEHAVIOUR_SPEC.values()), BEHAVIOUR_SQL + " SELECT * FROM beh")
def _(c):
    return behaviour(c)


@query(
    "c15_fingerprints",
    "customer_id:i purchase_pattern:s price_sensitivity_level:s engagement_level:s diversity_level:s actions:s",
    BEHAVIOUR_SQL + """, f AS (SELECT *,
  CASE WHEN COALESCE(purchase_acceleration, 0) > 1.2 THEN 'Accelerating' WHEN COALESCE(purchase_acceleration, 0) < 0.8 THEN 'Decelerating'
    WHEN purchase_frequency > 0.1 THEN 'High Frequency' WHEN purchase_frequency > 0.05 THEN 'Medium Frequency' ELSE 'Low Frequency' END AS purchase_pattern,
  CASE WHEN discount_dependency > 0.7 THEN 'High' WHEN discount_dependency > 0.4 THEN 'Medium' ELSE 'Low' END AS price_sensitivity_level,
  CASE WHEN total_sessions > 20 THEN 'High' WHEN total_sessions > 10 THEN 'Medium' ELSE 'Low' END AS engagement_level,
  CASE WHEN unique_categories > 5 THEN 'High' WHEN unique_categories > 3 THEN 'Medium' ELSE 'Low' END AS diversity_level FROM beh)
SELECT *, concat_ws('; ', CASE purchase_pattern WHEN 'Decelerating' THEN 'Re-engagement campaign recommended' WHEN 'Accelerating' THEN 'Upsell opportunity - customer is increasing activity' END,
  CASE price_sensitivity_level WHEN 'High' THEN 'Target with discount offers' WHEN 'Low' THEN 'Focus on value proposition rather than discounts' END,
  CASE WHEN engagement_level = 'Low' THEN 'Improve onboarding and engagement' END, CASE WHEN return_rate > 0.2 THEN 'Investigate product quality or fit issues' END,
  CASE WHEN cart_abandonment_rate > 0.7 THEN 'Implement cart recovery emails' END) AS actions FROM f""",
)
def _(c):
    return ops.fingerprints(behaviour(c)).withColumn("actions", F.array_join("recommendations", "; "))
