"""Marketing funnels, journeys, media mix and budgets."""

from pyspark.sql import functions as F

from marketloom.operators import marketing as ops
from marketloom.operators.products import CATEGORY  # noqa: F401
from marketloom.plans.registry import query
from marketloom.sources.commerce import CHANNELS

_FUNNEL = """
WITH v AS (SELECT sess.* EXCLUDE (channel), {ch} AS channel FROM sess LEFT JOIN camp c USING (campaign_id)),
f AS (SELECT channel, session_date AS day, COUNT(*) AS sessions, SUM(page_views) AS page_views, SUM(product_views) AS product_views, SUM(cart_adds) AS cart_adds,
  SUM(checkout_started) AS checkouts_started, SUM(checkout_completed) AS checkouts_completed, COUNT(DISTINCT customer_id) AS signed_in_users,
  COUNT(DISTINCT customer_id) FILTER (checkout_completed > 0) AS buyers FROM v GROUP BY 1, 2),
s AS (SELECT channel, spend_date AS day, SUM(impressions) i, SUM(clicks) c, CAST(SUM(spend_amount) AS DOUBLE) a FROM spend GROUP BY 1, 2),
o AS (SELECT v.channel, v.session_date AS day, COUNT(*) n, CAST(SUM(order_total) AS DOUBLE) r FROM vord JOIN v ON v.customer_id = vord.customer_id AND v.session_date = vord.order_date GROUP BY 1, 2)
"""
query(
    "sql05_marketing_channel_funnel",
    "channel:s day:t sessions:i page_views:i product_views:i cart_adds:i checkouts_started:i checkouts_completed:i signed_in_users:i conversion_rate_pct:d2 impressions:i clicks:i spend:d2 "
    "ctr_pct:d4 cpc:d4 cac:d0 roas:d2",
    _FUNNEL.replace("{ch}", "COALESCE(c.channel, sess.channel)") + """
SELECT f.*, 100.0 * NULLIF(checkouts_completed, 0) / sessions AS conversion_rate_pct, COALESCE(i, 0) AS impressions, COALESCE(c, 0) AS clicks, COALESCE(a, 0) AS spend,
  100.0 * c / i AS ctr_pct, a / c AS cpc, a / NULLIF(buyers, 0) AS cac, r / a AS roas FROM f LEFT JOIN s USING (channel, day) LEFT JOIN o USING (channel, day)""",
)(lambda c: ops.channel_day_funnel(c.sessions, c.campaigns, c.spend, c.orders))

query(
    "m1_marketing_funnel",
    "channel:s session_date:t sessions:i page_views:i product_views:i cart_adds:i checkouts_started:i checkouts_completed:i signed_in_users:i orders:i new_customers:i revenue_inr:d2 impressions:i "
    "clicks:i spend_inr:d2 ctr_pct:d4 cpc:d4 conversion_rate_pct:d2 cac:d2 roas:d2 session_to_cart_rate_pct:d2 cart_to_checkout_rate_pct:d2 checkout_completion_rate_pct:d2",
    _FUNNEL.replace("{ch}", "COALESCE(sess.channel, c.channel)") + """
SELECT f.*, day AS session_date, COALESCE(n, 0) AS orders, COALESCE(n, 0) AS new_customers, COALESCE(r, 0) AS revenue_inr, COALESCE(i, 0) AS impressions, COALESCE(c, 0) AS clicks, COALESCE(a, 0) AS spend_inr,
  COALESCE(100.0 * c / i, 0) AS ctr_pct, COALESCE(a / c, 0) AS cpc, 100.0 * checkouts_completed / sessions AS conversion_rate_pct, COALESCE(COALESCE(a, 0) / NULLIF(n, 0), 0) AS cac,
  COALESCE(COALESCE(r, 0) / a, 0) AS roas, 100.0 * cart_adds / sessions AS session_to_cart_rate_pct, COALESCE(100.0 * checkouts_started / NULLIF(cart_adds, 0), 0) AS cart_to_checkout_rate_pct,
  COALESCE(100.0 * checkouts_completed / NULLIF(checkouts_started, 0), 0) AS checkout_completion_rate_pct FROM f LEFT JOIN s USING (channel, day) LEFT JOIN o USING (channel, day)""",
)(lambda c: ops.marketing_funnel(c.sessions, c.campaigns, c.spend, c.orders, c.customers))

query(
    "m2_campaign_performance",
    "campaign_id:i campaign_name:s channel:s total_impressions:i total_clicks:i total_spend:d2 days_active:i total_sessions:i total_page_views:i total_cart_adds:i total_checkouts:i customers_reached:i "
    "total_orders:i total_revenue:d2 unique_customers:i ctr_pct:d4 cpc:d4 cac:d2 roas:d2 conversion_rate_pct:d2 budget_utilization_pct:d2 daily_spend_avg:d2",
    """
WITH s AS (SELECT campaign_id, SUM(impressions) i, SUM(clicks) c, CAST(SUM(spend_amount) AS DOUBLE) a, COUNT(DISTINCT spend_date) d FROM spend GROUP BY 1),
v AS (SELECT campaign_id, COUNT(*) n, SUM(page_views) p, SUM(cart_adds) k, SUM(checkout_completed) d, COUNT(DISTINCT customer_id) u FROM sess GROUP BY 1),
o AS (SELECT campaign_id, COUNT(*) n, CAST(SUM(order_total) AS DOUBLE) r, COUNT(DISTINCT customer_id) u FROM vord GROUP BY 1)
SELECT camp.*, s.i AS total_impressions, s.c AS total_clicks, s.a AS total_spend, s.d AS days_active, COALESCE(v.n, 0) AS total_sessions, COALESCE(v.p, 0) AS total_page_views,
  COALESCE(v.k, 0) AS total_cart_adds, COALESCE(v.d, 0) AS total_checkouts, COALESCE(v.u, 0) AS customers_reached, COALESCE(o.n, 0) AS total_orders, COALESCE(o.r, 0) AS total_revenue,
  COALESCE(o.u, 0) AS unique_customers, 100.0 * s.c / s.i AS ctr_pct, s.a / s.c AS cpc, COALESCE(s.a / o.u, 0) AS cac, COALESCE(o.r / s.a, 0) AS roas,
  COALESCE(100.0 * v.d / v.n, 0) AS conversion_rate_pct, 100 * s.a / CAST(total_budget AS DOUBLE) AS budget_utilization_pct, s.a / s.d AS daily_spend_avg
FROM camp LEFT JOIN s USING (campaign_id) LEFT JOIN v USING (campaign_id) LEFT JOIN o USING (campaign_id)""",
)(lambda c: ops.campaign_performance(c.campaigns, c.spend, c.sessions, c.orders))

query(
    "m3_overall_funnel",
    "total_sessions:i total_page_views:i total_product_views:i total_cart_adds:i total_checkouts_started:i total_checkouts_completed:i total_orders:i total_unique_customers:i session_to_pageview:d2 "
    "session_to_productview_pct:d2 session_to_cart_pct:d2 cart_to_checkout_pct:d2 checkout_completion_pct:d2 session_to_order_pct:d4 checkout_to_order_pct:d2",
    """
WITH s AS (SELECT COUNT(*) n, SUM(page_views) p, SUM(product_views) v, SUM(cart_adds) c, SUM(checkout_started) a, SUM(checkout_completed) b FROM sess),
o AS (SELECT COUNT(*) n, COUNT(DISTINCT customer_id) u FROM vord)
SELECT s.n AS total_sessions, p AS total_page_views, v AS total_product_views, c AS total_cart_adds, a AS total_checkouts_started, b AS total_checkouts_completed, o.n AS total_orders,
  u AS total_unique_customers, p / s.n AS session_to_pageview, 100.0 * v / s.n AS session_to_productview_pct, 100.0 * c / s.n AS session_to_cart_pct, 100.0 * a / c AS cart_to_checkout_pct,
  100.0 * b / a AS checkout_completion_pct, 100.0 * o.n / s.n AS session_to_order_pct, 100.0 * o.n / b AS checkout_to_order_pct FROM s, o""",
)(lambda c: ops.overall_funnel(c.sessions, c.orders))

_STAGE_VALUES = "(VALUES (0, 'signup'), (1, 'view'), (2, 'click'), (3, 'purchase')) g(k, stage)"
query(
    "m4_funnel",
    "stage_no:i stage:s customers:i conversion_to_next:d6 drop_off_to_next:d6 overall_conversion_rate:d6",
    f"""
WITH n AS (SELECT k, stage, (SELECT COUNT(DISTINCT customer_id) FROM ev WHERE event_type = stage) AS customers FROM {_STAGE_VALUES})
SELECT k AS stage_no, stage, customers, LEAD(customers) OVER (ORDER BY k) / customers AS conversion_to_next, 1 - LEAD(customers) OVER (ORDER BY k) / customers AS drop_off_to_next,
  (SELECT customers FROM n WHERE k = 3) / (SELECT customers FROM n WHERE k = 0) AS overall_conversion_rate FROM n""",
)(lambda c: ops.funnel_by_stage(c.events))

_PATHS = """
WITH k AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY customer_id ORDER BY event_ts, event_id) r FROM ev),
p AS (SELECT customer_id, string_agg(event_type, ' -> ' ORDER BY r) AS path, COUNT(*) AS path_length, max_by(event_type, r) AS final_stage FROM k WHERE r <= 10 GROUP BY 1)
"""
query("m5_journey_paths", "customer_id:i path:s path_length:i final_stage:s", _PATHS + "SELECT * FROM p")(lambda c: ops.journey_steps(c.events))
query("m5_top_paths", "path:s customers:i", _PATHS + "SELECT path, COUNT(*) AS customers FROM p GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")(
    lambda c: ops.top_paths(ops.journey_steps(c.events)))
query("m5_path_lengths", "n_unique_paths:i avg_path_length:d4 median_path_length:d2 max_path_length:i",
      _PATHS + "SELECT COUNT(DISTINCT path) AS n_unique_paths, AVG(path_length) AS avg_path_length, median(path_length) AS median_path_length, MAX(path_length) AS max_path_length FROM p")(
    lambda c: ops.path_length_stats(ops.journey_steps(c.events)))

query(
    "m6_drop_offs",
    "from_stage:s to_stage:s n_dropped_off:i drop_off_rate:d6 n_remaining:i is_largest:b",
    f"""
WITH c AS (SELECT DISTINCT customer_id, event_type FROM ev),
r AS (SELECT a.k, a.stage AS from_stage, b.stage AS to_stage,
  (SELECT COUNT(*) FROM c WHERE event_type = a.stage AND customer_id NOT IN (SELECT customer_id FROM c d WHERE d.event_type = b.stage)) AS n_dropped_off,
  (SELECT COUNT(*) FROM c WHERE event_type = a.stage) n, (SELECT COUNT(*) FROM c WHERE event_type = b.stage) AS n_remaining
  FROM {_STAGE_VALUES.replace("g(", "a(")} JOIN {_STAGE_VALUES.replace("g(", "b(")} ON b.k = a.k + 1)
SELECT *, n_dropped_off / n AS drop_off_rate, k = (SELECT k FROM r ORDER BY n_dropped_off / n DESC, k LIMIT 1) AS is_largest FROM r""",
)(lambda c: ops.drop_offs(c.events))

query(
    "m7_time_in_stage",
    "transition:s mean_hours:d4 median_hours:d4 std_hours:d4 min_hours:d4 max_hours:d4 n_transitions:i",
    """
WITH k AS (SELECT customer_id, event_type b, LAG(event_type) OVER w a, (epoch_us(event_ts) - epoch_us(LAG(event_ts) OVER w)) / 1e6 / 3600 AS h FROM ev
  WINDOW w AS (PARTITION BY customer_id ORDER BY event_ts, event_id))
SELECT a || '_to_' || b AS transition, AVG(h) AS mean_hours, quantile_cont(h, 0.5) AS median_hours, STDDEV_POP(h) AS std_hours, MIN(h) AS min_hours, MAX(h) AS max_hours, COUNT(*) AS n_transitions
FROM k WHERE a IN ('signup', 'view', 'click', 'purchase') AND b IN ('signup', 'view', 'click', 'purchase') GROUP BY 1""",
)(lambda c: ops.time_between_events(c.events))

query(
    "m8_funnel_value",
    "stage:s total_value:d2 avg_value_per_customer:d2 n_customers:i",
    f"""
SELECT stage, SUM(order_total) AS total_value, CAST(SUM(order_total) AS DOUBLE) / COUNT(*) AS avg_value_per_customer, COUNT(DISTINCT customer_id) AS n_customers
FROM {_STAGE_VALUES} JOIN (SELECT DISTINCT customer_id, event_type FROM ev) e ON e.event_type = stage JOIN ord USING (customer_id) GROUP BY 1""",
)(lambda c: ops.funnel_value(c.events, c.orders))

query(
    "m9_segment_journeys",
    "customer_segment:s overall_conversion_rate:d6 n_customers:i",
    """SELECT customer_segment, COUNT(DISTINCT customer_id) FILTER (event_type = 'purchase') / COUNT(DISTINCT customer_id) FILTER (event_type = 'signup') AS overall_conversion_rate,
  COUNT(DISTINCT customer_id) FILTER (event_type = 'signup') AS n_customers FROM ev JOIN cust USING (customer_id) GROUP BY 1""",
)(lambda c: ops.segment_funnels(c.events, c.customers_base, "customer_segment"))


def daily_revenue(c):
    return c.valid_orders.groupBy(F.col("order_date").alias("day")).agg(F.sum("order_total").alias("sales"))


def days(c):
    return ops.channel_days(c.spend, daily_revenue(c), CHANNELS)


_MMM = """
WITH sales AS (SELECT order_date AS day, SUM(order_total) AS sales FROM vord GROUP BY 1),
dd AS (SELECT DISTINCT spend_date AS day FROM spend), ch AS (SELECT DISTINCT channel FROM camp),
sp AS (SELECT spend_date AS day, channel, CAST(SUM(spend_amount) AS DOUBLE) a FROM spend GROUP BY 1, 2),
x AS (SELECT day, sales, channel, COALESCE(a, 0) AS spend, ROW_NUMBER() OVER (PARTITION BY channel ORDER BY day) t
  FROM dd JOIN sales USING (day) CROSS JOIN ch LEFT JOIN sp USING (day, channel)),
st AS (SELECT p.channel, p.day, ANY_VALUE(p.sales) AS sales, ANY_VALUE(p.spend) AS spend, SUM(q.spend * pow(0.5, p.t - q.t)) AS adstock FROM x p JOIN x q ON q.channel = p.channel AND q.t <= p.t GROUP BY 1, 2),
mmm AS (SELECT *, adstock / (adstock + 1000) AS saturated FROM st),
coef AS (SELECT channel, REGR_SLOPE(CAST(sales AS DOUBLE), saturated) AS coefficient FROM mmm GROUP BY 1)
"""


def _coefficients(c):
    return ops.media_mix_data(days(c)).groupBy("channel").agg(F.regr_slope(F.col("sales").cast("double"), F.col("saturated")).alias("coefficient"))


query("m10_adstock", "channel:s day:t spend:d2 adstock:d4", _MMM + "SELECT * FROM mmm")(
    lambda c: ops.adstock(days(c), ["channel"], "day", "spend", 0.5))
query("m11_saturation", "category_name:s day:t response:d6",
      "SELECT category_name, order_date AS day, CAST(SUM(line_total) AS DOUBLE) / (CAST(SUM(line_total) AS DOUBLE) + 1000000) AS response FROM itm JOIN vord USING (order_id) JOIN prod USING (product_id) GROUP BY 1, 2")(
    lambda c: category_days(c).select("category_name", "day", ops.saturation(F.col("revenue").cast("double"), 1e6).alias("response")))
query("m12_media_mix_data", "channel:s day:t sales:d2 spend:d2 adstock:d4 saturated:d6", _MMM + "SELECT * FROM mmm")(
    lambda c: ops.media_mix_data(days(c)))
for _model in ("linear", "ridge", "gradient_boosting"):
    query(f"m13_media_mix_{_model}", "model_type:s channel:s coefficient:d6 train_mae:d4 test_mae:d4 train_r2:d6 test_r2:d6")(
        lambda c, m=_model: ops.fit_media_mix(ops.media_mix_data(days(c)), CHANNELS, m))
query("m14_channel_roi", "channel:s total_spend:d2 coefficient:d2 estimated_contribution:d1 roi:d4",
      _MMM + """SELECT channel, SUM(spend) AS total_spend, ANY_VALUE(coefficient) AS coefficient, ANY_VALUE(coefficient) * SUM(saturated) AS estimated_contribution,
  (ANY_VALUE(coefficient) * SUM(saturated) - SUM(spend)) / SUM(spend) AS roi FROM mmm JOIN coef USING (channel) GROUP BY 1""")(
    lambda c: ops.channel_roi(ops.media_mix_data(days(c)), _coefficients(c)))
query("m15_budget_by_coefficient", "channel:s coefficient:d2 budget:d2 percentage:d4",
      _MMM + """, w AS (SELECT *, CASE WHEN SUM(coefficient) OVER () > 0 THEN coefficient / SUM(coefficient) OVER () ELSE 0.2 END w FROM coef)
SELECT channel, coefficient, 5000 + w * 75000 AS budget, (5000 + w * 75000) / 1000 AS percentage FROM w""")(
    lambda c: ops.allocate_by_coefficient(_coefficients(c), 100000.0))

_SERIES = """
WITH s AS (SELECT category_name, order_date AS day, CAST(SUM(line_total) AS DOUBLE) AS original FROM itm JOIN vord USING (order_id) JOIN prod USING (product_id) GROUP BY 1, 2),
t AS (SELECT *, ROW_NUMBER() OVER w - 1 AS t, SUM(original) OVER (PARTITION BY category_name ORDER BY day ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) / 7 AS trend FROM s WINDOW w AS (PARTITION BY category_name ORDER BY day))
"""


def category_days(c):
    return (
        c.order_items.select("order_id", "product_id", "line_total").join(c.valid_orders.select("order_id", F.col("order_date").alias("day")), "order_id")
        .join(c.products.select("product_id", "category_name"), "product_id").groupBy("category_name", "day").agg(F.sum("line_total").alias("revenue"))
    )


query("m16_decompose", "category_name:s day:t original:d2 trend:d4 seasonal:d4 residual:d4",
      _SERIES + "SELECT *, AVG(original - trend) OVER p AS seasonal, original - trend - AVG(original - trend) OVER p AS residual FROM t WINDOW p AS (PARTITION BY category_name, t % 7)")(
    lambda c: ops.decompose(category_days(c), ["category_name"], "day", "revenue", 7))
query("f14_decompose_multiplicative", "category_name:s day:t original:d2 trend:d4 seasonal:d6 residual:d6",
      _SERIES + "SELECT *, AVG(original / trend) OVER p AS seasonal, original / (trend * AVG(original / trend) OVER p) AS residual FROM t WINDOW p AS (PARTITION BY category_name, t % 7)")(
    lambda c: ops.decompose(category_days(c), ["category_name"], "day", "revenue", 7, "multiplicative"))
query("m17_baseline_sales", "day:t sales:d2 spend:d2 baseline_sales:d2 incremental_sales:d2",
      _MMM + """, d AS (SELECT day, CAST(ANY_VALUE(sales) AS DOUBLE) AS sales, SUM(spend) AS spend FROM x GROUP BY 1), k AS (SELECT 0.01 * quantile_cont(spend, 0.1) q FROM d),
b AS (SELECT COALESCE(AVG(sales) FILTER (spend < q), MIN(sales)) b FROM d, k) SELECT d.*, b AS baseline_sales, sales - b AS incremental_sales FROM d, b""")(
    lambda c: ops.baseline_sales(days(c)))
query("m18_attribution", "method:s channel:s share:d6",
      _MMM + """, a AS (SELECT channel, SUM(spend) v, max_by(spend, day) l FROM x GROUP BY 1)
SELECT 'spend_share' AS method, channel, v / SUM(v) OVER () AS share FROM a UNION ALL SELECT 'first_touch', channel, 1 / COUNT(*) OVER () FROM a
UNION ALL SELECT 'last_touch', channel, COALESCE(l / NULLIF(SUM(l) OVER (), 0), 0) FROM a""")(
    lambda c: _attributions(days(c)))


def _attributions(d):
    parts = [ops.attribution(d, m).select(F.lit(m).alias("method"), "channel", "share") for m in ("spend_share", "first_touch", "last_touch")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


query("m19_optimize_budget", "channel:s roi:d4 budget:d2",
      _MMM + """, r AS (SELECT channel, (SELECT CAST(SUM(sales) AS DOUBLE) FROM (SELECT DISTINCT day, sales FROM x)) / SUM(spend) AS roi FROM x GROUP BY 1),
b AS (SELECT *, GREATEST(roi / SUM(roi) OVER () * 100000, 5000) b FROM r) SELECT channel, roi, b / SUM(b) OVER () * 100000 AS budget FROM b""")(
    lambda c: ops.allocate_by_roi_share(days(c), 100000.0))
query("m20_marginal_roi", "channel:s marginal_roi:d4",
      _MMM + """, r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY channel ORDER BY spend, day) r, COUNT(*) OVER (PARTITION BY channel) n FROM x),
p AS (SELECT channel, LEAST((r - 1) // (n // 5), 4) s, SUM(spend) c, CAST(SUM(sales) AS DOUBLE) v FROM r GROUP BY 1, 2)
SELECT channel, max_by(v / c, s) AS marginal_roi FROM p WHERE c > 0 GROUP BY 1""")(
    lambda c: ops.marginal_roi(days(c)))

_ROI = """
WITH s AS (SELECT channel, CAST(SUM(spend_amount) AS DOUBLE) sp FROM spend GROUP BY 1),
r AS (SELECT channel, CAST(SUM(order_total) AS DOUBLE) rv FROM vord JOIN camp USING (campaign_id) GROUP BY 1), roi AS (SELECT channel, rv / sp AS roi FROM s JOIN r USING (channel)),
b AS (SELECT *, GREATEST(5000, LEAST(50000, roi / SUM(roi) OVER () * 100000)) b FROM roi), alloc AS (SELECT channel, roi, b * 100000 / SUM(b) OVER () AS budget, b * 100 / SUM(b) OVER () AS percentage FROM b),
lin AS (SELECT *, 5000 + GREATEST(0, LEAST({cap}, 75000 - (ROW_NUMBER() OVER (ORDER BY roi DESC, channel) - 1) * {cap})) AS budget FROM roi)
"""


def roi(c):
    return ops.channel_returns(c.spend, c.campaigns, c.orders)


query("m21_budget_by_roi", "channel:s roi:d4 budget:d2 percentage:d4", _ROI.replace("{cap}", "45000") + "SELECT * FROM alloc")(
    lambda c: ops.optimize_by_roi(roi(c), 100000.0))
query("m22_budget_with_constraints", "channel:s roi:d4 budget:d2 percentage:d4 expected_return:d2",
      _ROI.replace("{cap}", "45000") + "SELECT channel, roi, budget, budget / 1000 AS percentage, budget * roi AS expected_return FROM lin")(
    lambda c: ops.optimize_linear(roi(c), 100000.0))
query("o2_marketing_allocation", "channel:s roi:d4 budget:d2 percentage:d4 expected_return:d2",
      _ROI.replace("{cap}", "95000") + "SELECT channel, roi, budget, budget / 1000 AS percentage, budget * roi AS expected_return FROM lin")(
    lambda c: ops.optimize_linear(roi(c), 100000.0, 0.05, 1.0))
query("m23_scenarios", "scenario:s total_budget:d2 total_roi:d2 roi_change_pct:d4",
      _ROI.replace("{cap}", "45000") + """, sc AS (SELECT scenario, channel, roi, budget * CASE WHEN scenario = 'email_up' AND channel = 'Email' THEN 1.5 WHEN scenario = 'display_off' AND channel = 'Display' THEN 0.0 ELSE 1.0 END b
  FROM alloc, (VALUES ('base'), ('email_up'), ('display_off')) v(scenario))
SELECT scenario, SUM(b) AS total_budget, SUM(b * roi) AS total_roi, (SUM(b * roi) - (SELECT SUM(budget * roi) FROM alloc)) / (SELECT SUM(budget * roi) FROM alloc) * 100 AS roi_change_pct FROM sc GROUP BY 1""")(
    lambda c: ops.scenario_totals(ops.optimize_by_roi(roi(c), 100000.0), {"email_up": {"Email": 1.5}, "display_off": {"Display": 0.0}}))
query("m24_reallocation", "channel:s current_budget:d2 current_percentage:d4 roi:d4 action:s reason:s suggested_budget:d2 suggested_percentage:d4 change_pct:d1",
      _ROI.replace("{cap}", "45000") + """, k AS (SELECT *, CASE WHEN roi < 0 THEN -0.5 WHEN roi < 5000 THEN -0.2 WHEN roi > 7500 THEN 0.3 ELSE 0 END ch FROM alloc)
SELECT channel, budget AS current_budget, percentage AS current_percentage, roi, CASE WHEN roi < 5000 THEN 'decrease' WHEN roi > 7500 THEN 'increase' ELSE 'maintain' END AS action,
  CASE WHEN roi < 0 THEN 'negative_roi' WHEN roi < 5000 THEN 'below_target' WHEN roi > 7500 THEN 'above_target' ELSE 'on_target' END AS reason, ch * 100 AS change_pct,
  budget * (1 + ch) * SUM(budget) OVER () / SUM(budget * (1 + ch)) OVER () AS suggested_budget, 100 * budget * (1 + ch) / SUM(budget * (1 + ch)) OVER () AS suggested_percentage FROM k""")(
    lambda c: ops.recommend_reallocation(ops.optimize_by_roi(roi(c), 100000.0), target_roi=5000.0))
