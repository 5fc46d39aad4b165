"""Alerts, recommendations, KPI trends, risks, serving and dashboard queries."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marketloom.functions.exprs import is_net, is_valid, n_rows, or_zero, ratio, sum_if
from marketloom.functions.ordered import quantiles
from marketloom.operators.sales import status_is

# Priority scores and the three actions per alert category
# (action, share of the impact, detail, timeline).
PRIORITY = {"CRITICAL": 100, "HIGH": 50, "MEDIUM": 20, "LOW": 5, "INFO": 1}
ACTIONS = {
    "ANOMALY": (
        ("Launch forensic review", 0.4, "Category/channel root-cause drill-down", "24h"),
        ("Deploy ops team", 0.25, "Monitor next 3 days, reforecast if needed", "48h"),
        ("Notify senior leadership", 0.15, "Slack/email briefing packet", "1h"),
    ),
    "CUSTOMER": (
        ("Launch retention campaign", 0.35, "Personalized 15% off for High-risk customers", "3 days"),
        ("1:1 outreach for High CLV", 0.30, "Account manager outreach for top 100 CLV High-risk customers", "1 week"),
        ("Loyalty program refresh", 0.15, "Surprise points or tier bump for Medium-risk", "2 weeks"),
    ),
    "INVENTORY": (
        ("Raise emergency PO", 0.50, "Auto-generate PO for 2× safety stock on Critical", "48h"),
        ("Supplier escalation", 0.25, "Priority call to at-risk suppliers, expedite delivery", "24h"),
        ("Shift marketing spend", 0.10, "Reduce promo spend on out-of-stock products", "1 week"),
    ),
    "PRODUCT": (
        ("Clearance sale", 0.40, "End-of-season 25% off + bundling for REMOVE quadrant", "2 weeks"),
        ("SKU consolidation", 0.25, "Merge low-performing SKUs into hero variants", "1 month"),
        ("Supplier renegotiation", 0.15, "Target 7% cost reduction on Volume/Premium", "1 month"),
    ),
    "MARKETING": (
        ("Pause low-ROAS channels", 0.45, "Reallocate 60% of budget → top 3 performing campaigns", "Immediate"),
        ("A/B test creatives", 0.25, "New hero creative test for CTR < 2%", "2 weeks"),
        ("Audience retargeting", 0.20, "Launch cart-abandon retargeting for drop-off > 60%", "1 week"),
    ),
}


#: Fixed value: the action of any other category.
GENERAL_ACTION = ("General review", 0.10, "Manual investigation", "1 week")

#: Who acts on an alert of each category.
OWNERS = {
    "ANOMALY": "Head of Operations + Data Analyst",
    "CUSTOMER": "Customer Success + Marketing",
    "INVENTORY": "Operations + Procurement",
    "PRODUCT": "Merchandising + Category Manager",
    "MARKETING": "Digital Marketing Lead",
}
OTHER_OWNER = "TBD"


def _priority_score(priority: Column) -> Column:
    return F.coalesce(*[F.when(priority == k, v) for k, v in PRIORITY.items()], F.lit(20))


def executive_alerts(anomalies: DataFrame, churn: DataFrame, inventory: DataFrame, matrix: DataFrame, campaigns: DataFrame) -> DataFrame:
    """One alert per rule that fires, each from one aggregate; the five worst anomalies each get their own.

    ``anomalies`` has the columns of the anomaly alerts, ``churn`` ``risk_tier``
    and ``total_spend``, ``inventory`` ``stock_status``, ``demand_90d`` and
    ``selling_price``, ``matrix`` ``quadrant`` and ``revenue_inr``, ``campaigns``
    ``roas`` and ``total_spend``.
    """
    shape = lambda df, category, priority, key, impact, people, n: df.select(
        F.lit(category).alias("category"), priority.alias("priority"), key.alias("subject"), impact.cast("double").alias("impact_revenue_inr"), people.cast("long").alias("impact_customers"), n.cast("long").alias("n_items"))
    worst = anomalies.filter(F.col("severity").isin("critical", "high")).orderBy(F.col("severity_score").desc(), F.col("change_pct").desc(), "kpi", "day").limit(5)
    parts = [shape(worst, "ANOMALY", F.upper("severity"), F.concat_ws(" ", "kpi", F.col("day").cast("string")), F.round(F.abs(F.col("value") - F.col("baseline_28d")), 0), F.lit(0), F.lit(1))]
    high = churn.filter(F.col("risk_tier") == "High")
    spend = quantiles(high, "total_spend", {"m": 0.5}).select("m").scalar()
    risk = high.agg(n_rows().alias("n")).withColumn("m", spend).filter(F.col("n") > 0)
    parts.append(shape(risk, "CUSTOMER", F.when(F.col("n") > 500, "HIGH").otherwise("MEDIUM"), F.lit("high churn risk"), F.round(F.col("n") * F.coalesce("m", F.lit(15000.0)) * 0.4, 0), F.col("n"), F.col("n")))
    low = inventory.filter(F.col("stock_status").isin("Out of Stock", "Critical", "Reorder")).agg(n_rows().alias("n"), F.sum(or_zero("demand_90d") * or_zero("selling_price").cast("double")).alias("e")).filter(F.col("n") > 0)
    parts.append(shape(low, "INVENTORY", F.when(F.col("n") > 200, "CRITICAL").otherwise("HIGH"), F.lit("stock-out within 14 days"), F.round(or_zero("e") / 90 * 14, 0), F.lit(0), F.col("n")))
    drop = matrix.filter(F.lower("quadrant") == "remove").agg(n_rows().alias("n"), F.sum("revenue_inr").alias("r")).filter(F.col("n") > 0)
    parts.append(shape(drop, "PRODUCT", F.lit("MEDIUM"), F.lit("low revenue and margin"), F.round(F.col("r") * 0.10, 0), F.lit(0), F.col("n")))
    weak = campaigns.filter(F.col("roas") < 1.0).agg(n_rows().alias("n"), F.sum("total_spend").cast("double").alias("s")).filter(F.col("n") > 0)
    parts.append(shape(weak, "MARKETING", F.when(F.col("s") > 500000, "HIGH").otherwise("MEDIUM"), F.lit("negative return"), F.round(F.col("s") * 0.5, 0), F.lit(0), F.col("n")))
    every = reduce(lambda a, b: a.unionByName(b), parts).withColumn("priority_score", _priority_score(F.col("priority")))
    rank = F.row_number().over(W.partitionBy(F.lit(0)).orderBy(F.col("priority_score").desc(), F.col("impact_revenue_inr").desc(), "category", "subject"))  # at most nine alerts
    return every.withColumn("alert_rank", rank)


def alert_recommendations(alerts: DataFrame) -> DataFrame:
    """Three actions per alert with their share of the impact, an owner and the status OPEN; a general review for other categories."""
    steps = lambda ts: F.array(*[F.struct(F.lit(i + 1).alias("step"), F.lit(a).alias("recommendation"), F.lit(f).alias("factor"), F.lit(d).alias("action_details"), F.lit(t).alias("timeline")) for i, (a, f, d, t) in enumerate(ts)])
    chosen = F.coalesce(*[F.when(F.col("category") == c, steps(ts)) for c, ts in ACTIONS.items()], steps([GENERAL_ACTION]))
    out = alerts.select("alert_rank", "category", "subject", "priority", "priority_score", "impact_revenue_inr", "impact_customers", F.explode(chosen).alias("t"))
    return out.select(
        "alert_rank", "category", "subject", "priority", "t.step", F.concat(F.left("subject", F.lit(80)), F.lit(" → "), F.col("t.recommendation")).alias("recommendation"), "t.action_details", "t.timeline", F.round(F.col("t.factor") * 100, 0).alias("estimated_impact_pct"),
        F.round(F.col("impact_revenue_inr") * F.col("t.factor"), 0).alias("estimated_revenue_impact_inr"), F.round(F.col("impact_customers") * F.col("t.factor"), 0).alias("estimated_customers_impact"),
        F.coalesce(*[F.when(F.col("category") == c, F.lit(who)) for c, who in OWNERS.items()], F.lit(OTHER_OWNER)).alias("owner"), F.lit("OPEN").alias("status"))


def decision_summary(recommendations: DataFrame) -> DataFrame:
    """Alerts, actions and potential impact per category."""
    return recommendations.groupBy("category").agg(
        F.count_distinct("alert_rank").alias("alerts"), n_rows().alias("recommendations"), F.sum("estimated_revenue_impact_inr").alias("potential_revenue_inr"), F.sum("estimated_customers_impact").alias("customers_retained"))


def kpi_trend(history: DataFrame, periods: int = 7) -> DataFrame:
    """Slope, growth, volatility and next value over each KPI's last periods.

    ``history`` holds ``kpi``, ``period``, ``value``.
    """
    last = history.withColumn("_r", F.row_number().over(W.partitionBy("kpi").orderBy(F.col("period").desc()))).filter(F.col("_r") <= periods)
    x = (-F.col("_r")).cast("double")
    agg = last.groupBy("kpi").agg(
        F.regr_slope("value", x).alias("slope"), F.min_by("value", "period").alias("_first"), F.max_by("value", "period").alias("current_value"), F.stddev_pop("value").alias("volatility"), n_rows().alias("n_periods"))
    agg = agg.filter(F.col("n_periods") >= 2)
    return agg.select(
        "kpi", F.when(F.col("slope") > 0.01, "increasing").when(F.col("slope") < -0.01, "decreasing").otherwise("stable").alias("trend"), "slope",
        F.when(F.col("_first") != 0, (F.col("current_value") - F.col("_first")) / F.abs("_first")).otherwise(0.0).alias("growth_rate"), "volatility", "current_value", (F.col("current_value") + F.col("slope")).alias("forecast"), "n_periods")


def assess_risk(factors: DataFrame, thresholds: Mapping[str, float], default: float = 0.7) -> DataFrame:
    """Score per factor and overall level; ``factors`` holds ``entity``, ``factor``, ``value``."""
    limit = F.coalesce(*[F.when(F.col("factor") == k, F.lit(float(v))) for k, v in thresholds.items()], F.lit(default))
    out = factors.withColumn("threshold", limit)
    out = out.withColumn("risk_score", F.when(F.col("threshold") > 0, F.least(F.lit(1.0), F.col("value") / F.col("threshold"))).otherwise(0.0))
    overall = F.avg("risk_score").over(W.partitionBy("entity"))  # the factors of one entity
    out = out.withColumn("severity", F.when(F.col("risk_score") > 0.8, "high").when(F.col("risk_score") > 0.5, "medium").otherwise("low")).withColumn("overall_risk", overall)
    return out.withColumn("risk_level", F.when(F.col("overall_risk") > 0.8, "critical").when(F.col("overall_risk") > 0.6, "high").when(F.col("overall_risk") > 0.4, "medium").otherwise("low"))


def opportunities(metrics: DataFrame) -> DataFrame:
    """Positive gaps to target with priority; ``metrics`` holds ``metric``, ``current_value``, ``target``."""
    gap = F.col("target") - F.col("current_value")
    out = metrics.filter(gap > 0).withColumn("gap", gap).withColumn("gap_percentage", or_zero(F.try_divide(gap, F.col("target"))) * 100)
    g = F.col("gap_percentage")
    return out.withColumn("priority", F.when(g > 20, "high").when(g > 10, "medium").otherwise("low")).withColumn("potential_impact", F.when(g > 20, "high").otherwise("medium"))


def kpi_variance(metrics: DataFrame, alert_above: float = 0.1) -> DataFrame:
    """Relative variance from target with an alert beyond the limit."""
    v = F.when(F.col("target") != 0, (F.col("current_value") - F.col("target")) / F.col("target"))
    out = metrics.withColumn("variance", v)
    return out.withColumn("alert_severity", F.when(F.abs("variance") > 0.2, "high").when(F.abs("variance") > alert_above, "medium"))


def opportunity_plan(opps: DataFrame) -> DataFrame:
    """Numbered actions with effort and timeline; one row per metric with a gap."""
    g = F.col("gap_percentage")
    n = F.row_number().over(W.partitionBy(F.lit(0)).orderBy(g.desc(), "metric"))
    return opps.withColumn("_n", n).select(
        F.concat(F.lit("ACTION_"), F.col("_n").cast("string")).alias("action_id"), "metric", F.concat(F.lit("Improve "), "metric", F.lit(" to reach target")).alias("action"), "current_value", F.col("target").alias("target_value"), "gap", "priority",
        F.when(g > 20, "high").when(g > 10, "medium").otherwise("low").alias("estimated_effort"), F.when(g > 0, F.concat((F.floor(g / 10) + 1).cast("string"), F.lit(" weeks"))).otherwise("1 week").alias("timeline"))


# --- serving -----------------------------------------------------------------


def range_kpis(orders: DataFrame, items: DataFrame, products: DataFrame) -> DataFrame:
    """Revenue, net revenue, orders, customers, order value, return rate and margin of the given orders."""
    margin = items.join(orders.filter(is_valid()).select("order_id"), "order_id", "left_semi").join(products.select("product_id", "cost_price"), "product_id").agg(
        ratio(F.sum(F.col("line_total") - F.col("quantity") * F.col("cost_price")), F.sum("line_total"), 100)).scalar()
    agg = orders.agg(
        sum_if(is_valid(), "order_total").alias("total_revenue"), sum_if(status_is("Cancelled"), "order_total").alias("_c"), sum_if(status_is("Returned"), "order_total").alias("_r"), F.count_if(is_valid()).alias("total_orders"),
        F.count_distinct(F.when(is_valid(), F.col("customer_id"))).alias("unique_customers"), F.count_if(status_is("Returned")).alias("_n"))
    return agg.select(
        "total_revenue", (F.col("total_revenue") - F.col("_c") - F.col("_r")).alias("net_revenue"), "total_orders", "unique_customers", or_zero(ratio("total_revenue", "total_orders")).alias("aov"),
        or_zero(ratio("_n", "total_orders", 100)).alias("return_rate"), margin.alias("gross_margin_pct"))


def customer_profiles(customers: DataFrame, orders: DataFrame, churn: DataFrame, ids: Sequence[int] | None = None) -> DataFrame:
    """Customers with order statistics and churn score; a key filter reaches the scans."""
    base = customers.filter(F.col("customer_id").isin(list(ids))) if ids is not None else customers
    mine = orders.filter(F.col("customer_id").isin(list(ids))) if ids is not None else orders
    stats = mine.groupBy("customer_id").agg(n_rows().alias("total_orders"), F.sum("order_total").alias("total_spend"), F.max("order_date").alias("last_order_date"))
    out = base.join(stats, "customer_id", "left").join(churn.select("customer_id", "churn_probability", "risk_tier", "risk_score"), "customer_id", "left")
    return out.withColumn("total_orders", or_zero("total_orders")).withColumn("avg_order_value", ratio("total_spend", "total_orders"))


def forecast_response(forecast: DataFrame, horizon: int, band: float = 0.1) -> DataFrame:
    """The first days of a forecast with a proportional band."""
    return forecast.filter(F.col("step") <= horizon).select("series_id", "step", "day", "forecast", (F.col("forecast") * (1 - band)).alias("lower_bound"), (F.col("forecast") * (1 + band)).alias("upper_bound"))


# --- dashboards --------------------------------------------------------------


def yearly_growth(orders: DataFrame) -> DataFrame:
    """Net revenue per month against the same month a year before."""
    monthly = orders.groupBy(F.trunc("order_date", "month").alias("month")).agg((sum_if(is_net(), "order_total") - sum_if(status_is("Returned"), "order_total")).alias("net_revenue"))
    before = monthly.select(F.add_months("month", 12).alias("month"), F.col("net_revenue").alias("previous_year"))
    return monthly.join(before, "month", "left").withColumn("growth_pct", ratio(F.col("net_revenue") - F.col("previous_year"), "previous_year", 100))


def headline_ratios(customers: DataFrame, orders: DataFrame, items: DataFrame, products: DataFrame, as_of: dt.date) -> DataFrame:
    """Churn rate, gross margin and lifetime value measures."""
    per = orders.filter(is_valid()).groupBy("customer_id").agg(F.max("order_date").alias("l"), n_rows().alias("n"), F.sum("order_total").alias("r"))
    who = customers.select("customer_id").join(per, "customer_id", "left").agg(
        n_rows().alias("c"), F.count_if(F.col("l").isNull() | (F.datediff(F.lit(as_of), "l") > 90)).alias("gone"), F.count_if(F.col("n") > 0).alias("buyers"), F.sum("n").alias("n"), F.sum("r").alias("r"))
    profit = items.join(orders.filter(is_valid()).select("order_id"), "order_id", "left_semi").join(products.select("product_id", "cost_price"), "product_id").agg(
        ratio(F.sum(F.col("line_total") - F.col("quantity") * F.col("cost_price")), F.sum("line_total"))).scalar()
    out = who.withColumn("m", profit)
    return out.select(ratio("gone", "c", 100).alias("churn_rate_pct"), (F.col("m") * 100).alias("gross_margin_pct"), (ratio("r", "n") * ratio("n", "buyers") * 36 * F.col("m")).alias("customer_lifetime_value"))


def status_mix(orders: DataFrame) -> DataFrame:
    total = orders.agg(n_rows()).scalar()
    return orders.groupBy("order_status").agg(n_rows().alias("orders")).withColumn("share_pct", ratio("orders", total, 100))


def weekday_revenue(orders: DataFrame) -> DataFrame:
    return orders.filter(is_valid()).groupBy(F.date_format("order_date", "EEEE").alias("weekday")).agg(F.sum("order_total").alias("revenue"), n_rows().alias("orders"))


def new_and_returning(customers: DataFrame, orders: DataFrame) -> DataFrame:
    """Signups and active customers per month; the difference is returning customers."""
    new = customers.groupBy(F.trunc("signup_date", "month").alias("month")).agg(n_rows().alias("new_customers"))
    active = orders.groupBy(F.trunc("order_date", "month").alias("month")).agg(F.count_distinct("customer_id").alias("active_customers"))
    out = active.join(new, "month", "left").withColumn("new_customers", or_zero("new_customers"))
    return out.withColumn("returning_customers", F.greatest(F.col("active_customers") - F.col("new_customers"), F.lit(0)))


def top_by(df: DataFrame, name: str, value: str, n: int) -> DataFrame:
    """The ``n`` largest rows; only the n best of each task are merged."""
    return df.select(F.col(name).alias("name"), F.col(value).alias("value")).orderBy(F.col("value").desc(), "name").limit(n)


def group_summary(df: DataFrame, group: str, value: str) -> DataFrame:
    """Members, total and mean of a value per group."""
    return df.groupBy(F.col(group).alias("group_name")).agg(n_rows().alias("members"), F.sum(value).cast("double").alias("total"), ratio(F.sum(value), n_rows()).alias("mean"))
