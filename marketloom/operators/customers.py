"""Customer marts: 360 view, RFM, cohorts, value, churn features, behaviour."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marketloom.functions.exprs import correlation, days_between, is_valid, n_rows, or_zero, ratio, sum_if
from marketloom.functions.ordered import ntile_by, running_totals


def customer_360(
    customers: DataFrame, orders: DataFrame, items: DataFrame, returns: DataFrame, reviews: DataFrame,
    payments: DataFrame, sessions: DataFrame, as_of: dt.date,
) -> DataFrame:
    """One row per customer; each child table is aggregated before its join."""
    by_order = orders.groupBy("customer_id").agg(
        n_rows().alias("total_orders"),
        F.count_if(F.col("order_status") == "Cancelled").alias("cancelled_orders"),
        F.count_if(F.col("order_status") == "Returned").alias("returned_orders"),
        sum_if(is_valid(), "order_total").alias("total_revenue"),
        sum_if(is_valid(), "discount_amount").alias("total_discount"),
        F.count_if(is_valid()).alias("_valid"),
        F.min("order_date").alias("first_order_date"),
        F.max("order_date").alias("last_order_date"),
        F.count_distinct(F.trunc("order_date", "month")).alias("active_months"),
    ).withColumn("avg_order_value", ratio("total_revenue", "_valid"))
    owner = orders.select("order_id", "customer_id")
    bought = items.select("order_id", "product_id").join(owner, "order_id").groupBy("customer_id").agg(
        F.count_distinct("product_id").alias("unique_products_bought")
    )
    returned = returns.select("order_id").join(owner, "order_id").groupBy("customer_id").agg(
        n_rows().alias("total_returns")
    )
    reviewed = reviews.groupBy("customer_id").agg(
        F.avg("rating").alias("avg_rating_given"), n_rows().alias("reviews_written")
    )
    paid = payments.groupBy("customer_id").agg(
        sum_if(F.col("payment_status") == "Success", "amount").alias("total_paid")
    )
    visits = sessions.groupBy("customer_id").agg(n_rows().alias("website_sessions"))
    out = customers
    for child in (by_order, bought, returned, reviewed, paid, visits):
        out = out.join(child, "customer_id", "left")
    zero = ["total_orders", "cancelled_orders", "returned_orders", "total_revenue", "total_discount",
            "avg_order_value", "active_months", "unique_products_bought", "total_returns", "avg_rating_given",
            "reviews_written", "total_paid", "website_sessions"]
    return out.select(
        *customers.columns,
        *[or_zero(c).alias(c) for c in zero],
        "first_order_date", "last_order_date",
        days_between(F.lit(as_of), F.coalesce("last_order_date", "signup_date")).alias("days_since_last_order"),
    )


def rfm_segment(r: str, f: str, m: str) -> Column:
    r_, f_, m_ = F.col(r), F.col(f), F.col(m)
    return (
        F.when((r_ == 5) & (f_ >= 4) & (m_ >= 4), "Champions")
        .when((r_ >= 4) & (f_ >= 3) & (m_ >= 3), "Loyal Customers")
        .when((r_ >= 4) & f_.between(1, 3) & m_.between(2, 3), "Potential Loyalists")
        .when((r_ == 5) & (f_ <= 2) & (m_ <= 2), "New Customers")
        .when((r_ == 2) & (f_ >= 2) & (m_ >= 2), "At Risk")
        .when((r_ == 1) & (f_ >= 4) & (m_ >= 4), "Can't Lose Them")
        .when((r_ <= 2) & (f_ <= 2) & (m_ <= 2), "Lost Customers")
        .otherwise("Other")
    )


def _rfm_totals(df: DataFrame) -> DataFrame:
    return df.withColumn("rfm_total", F.expr("r_score + f_score + m_score")).withColumn(
        "rfm_cell", F.expr("r_score * 100 + f_score * 10 + m_score")
    ).withColumn("rfm_segment", rfm_segment("r_score", "f_score", "m_score"))


def rfm_ntile(customers: DataFrame, orders: DataFrame, as_of: dt.date) -> DataFrame:
    """Quintile scores by NTILE with ties broken by customer id, then segments."""
    agg = orders.groupBy("customer_id").agg(
        F.max("order_date").alias("_last"), n_rows().alias("frequency"),
        sum_if(is_valid(), "order_total").alias("monetary_value"),
    )
    base = customers.select("customer_id", F.col("customer_segment").alias("assigned_segment"), "signup_date").join(
        agg, "customer_id", "left"
    )
    base = base.select(
        "customer_id", "assigned_segment",
        F.coalesce("_last", "signup_date").alias("last_order_date"),
        days_between(F.lit(as_of), F.coalesce("_last", "signup_date")).alias("recency_days"),
        or_zero("frequency").alias("frequency"), or_zero("monetary_value").alias("monetary_value"),
    )
    scored = ntile_by(base, "r_score", 5, [F.col("recency_days").desc(), F.col("customer_id")])
    scored = ntile_by(scored, "_f", 5, [F.col("frequency"), F.col("customer_id")])
    scored = ntile_by(scored, "_m", 5, [F.col("monetary_value"), F.col("customer_id")])
    scored = scored.withColumn("f_score", F.when(F.col("frequency") == 0, 1).otherwise(F.col("_f"))).withColumn(
        "m_score", F.when(F.col("monetary_value") == 0, 1).otherwise(F.col("_m"))
    )
    return _rfm_totals(scored.drop("_f", "_m"))


def quantile_bin(rank: Column, n: Column, k: int) -> Column:
    """Bin 1..k of a unique rank when the edges are linear quantiles of the ranks."""
    return F.greatest(F.lit(1), F.ceil((rank - 1) * k / F.greatest(n - 1, F.lit(1)))).cast("int")


def score_nonzero(df: DataFrame, value: str, out: str, k: int, reverse: bool = False, tie: str = "customer_id") -> DataFrame:
    """Quantile score over the non-zero values; a zero scores 1."""
    flagged = df.withColumn("_zero", F.col(value) == 0)
    ranked = running_totals(flagged, [F.col(value), F.col(tie)], keys=["_zero"], rank="_r", count="_n")
    score = quantile_bin(F.col("_r"), F.col("_n"), k)
    score = (F.lit(k + 1) - score) if reverse else score
    return ranked.withColumn(out, F.when(F.col("_zero"), 1).otherwise(score)).drop("_zero", "_r", "_n")


def rfm_zero_aware(customers: DataFrame, orders: DataFrame, as_of: dt.date | None = None) -> DataFrame:
    """RFM over valid orders where zero values always score 1."""
    valid = orders.filter(is_valid())
    agg = valid.groupBy("customer_id").agg(
        F.max("order_date").alias("_last"), n_rows().alias("frequency"), F.sum("order_total").alias("monetary_value")
    )
    reference = F.lit(as_of) if as_of else valid.agg(F.max("order_date")).scalar()
    base = customers.select("customer_id", "customer_segment", "signup_date").join(agg, "customer_id", "left").select(
        "customer_id", "customer_segment",
        F.coalesce("_last", "signup_date").alias("last_order_date"),
        days_between(reference, F.coalesce("_last", "signup_date")).alias("recency_days"),
        or_zero("frequency").alias("frequency"), or_zero("monetary_value").alias("monetary_value"),
    )
    out = score_nonzero(base, "recency_days", "r_score", 5, reverse=True)
    out = score_nonzero(out, "frequency", "f_score", 5)
    return _rfm_totals(score_nonzero(out, "monetary_value", "m_score", 5))


def lifetime_cohorts(customers: DataFrame, orders: DataFrame) -> DataFrame:
    """Signup month and segment cohorts: size, value, frequency, lifespan, returns."""
    agg = orders.groupBy("customer_id").agg(
        n_rows().alias("n"), sum_if(is_valid(), "order_total").alias("spend"),
        days_between(F.max("order_date"), F.min("order_date")).alias("life"),
        F.count_if(F.col("order_status") == "Returned").alias("ret"),
    )
    per = customers.join(agg, "customer_id", "left")
    spend = or_zero("spend")
    return per.groupBy(F.trunc("signup_date", "month").alias("signup_month"), "customer_segment").agg(
        n_rows().alias("cohort_size"),
        ratio(F.sum(spend), n_rows()).alias("avg_ltv_inr"),
        F.avg(or_zero("n")).alias("avg_purchase_frequency"),
        F.avg(ratio(F.nullif(spend.cast("double"), F.lit(0.0)), "n")).alias("avg_aov_inr"),
        F.avg("life").alias("avg_lifespan_days"),
        ratio(F.nullif(F.sum("ret"), F.lit(0)), F.sum("n"), 100).alias("cohort_return_rate_pct"),
    )


def customer_profit(orders: DataFrame, items: DataFrame, products: DataFrame) -> DataFrame:
    """Revenue, profit and order count per customer over valid order lines."""
    lines = (
        items.select("order_id", "product_id", "quantity", "line_total")
        .join(products.select("product_id", "cost_price"), "product_id")
        .groupBy("order_id")
        .agg(
            F.sum("line_total").alias("rev"),
            F.sum(F.col("line_total") - F.col("quantity") * F.col("cost_price")).alias("profit"),
        )
    )
    # lines are now one row per order, so the order join cannot fan out
    return orders.filter(is_valid()).join(lines, "order_id").groupBy("customer_id").agg(
        n_rows().alias("total_orders"), F.sum("order_total").alias("order_revenue"),
        F.sum("rev").alias("line_revenue"), F.sum("profit").alias("total_profit"),
    )


def top_customers(customers: DataFrame, orders: DataFrame, items: DataFrame, products: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` most profitable customers with rank and share of all profit."""
    per = customer_profit(orders, items, products)
    total = per.agg(F.sum("total_profit")).scalar()
    top = per.orderBy(F.col("total_profit").desc(), "customer_id").limit(n)
    # the rank window sees only the n rows kept by the top-n
    ranked = top.withColumn("profit_rank", F.row_number().over(W.orderBy(F.col("total_profit").desc(), "customer_id")))
    return ranked.join(customers.select("customer_id", "customer_name", "state", "customer_segment"), "customer_id").select(
        "customer_id", "customer_name", "state", "customer_segment", "total_orders",
        F.col("order_revenue").alias("total_revenue"), "total_profit", "profit_rank",
        ratio("total_profit", total, 100).alias("profit_share_pct"),
    )


def pareto(customers: DataFrame, orders: DataFrame, items: DataFrame, products: DataFrame) -> DataFrame:
    """Customers by falling profit with running share and percentile."""
    per = customer_profit(orders, items, products)
    ranked = running_totals(
        per, [F.col("total_profit").desc(), F.col("customer_id")], sums={"cumulative_profit": "total_profit"},
        totals={"_all": "total_profit"}, rank="profit_rank", count="_n",
    )
    return ranked.join(customers.select("customer_id", "customer_name", "state", "customer_segment"), "customer_id", "left").select(
        "customer_id", "customer_name", "state", "customer_segment", "total_orders",
        F.col("line_revenue").alias("total_revenue"), "total_profit", "profit_rank", "cumulative_profit",
        ratio("cumulative_profit", "_all", 100).alias("cumulative_profit_pct"),
        ratio("profit_rank", "_n", 100).alias("percentile"),
    )


def pareto_shares(pareto_df: DataFrame, shares: tuple[int, ...] = (10, 20, 50)) -> DataFrame:
    """Profit share of the top 10, 20 and 50 % of customers."""
    n = pareto_df.agg(n_rows()).scalar()
    flagged = pareto_df.withColumn("_n", n)
    cut = lambda p: F.greatest(F.lit(1), F.floor(F.col("_n") * p / 100))
    agg = flagged.agg(
        n_rows().alias("total_customers"), F.sum("total_profit").alias("total_profit_inr"),
        *[F.sum(F.when(F.col("profit_rank") <= cut(p), F.col("total_profit"))).alias(f"_t{p}") for p in shares],
    )
    return agg.select(
        "total_customers", "total_profit_inr",
        *[ratio(f"_t{p}", "total_profit_inr", 100).alias(f"top_{p}pct_profit_share_pct") for p in shares],
    )


def months_between_months(later: Column, earlier: Column) -> Column:
    return (F.year(later) - F.year(earlier)) * 12 + F.month(later) - F.month(earlier)


def cohort_activity(customers: DataFrame, orders: DataFrame, horizon: int = 12) -> DataFrame:
    """Active customers, retention and revenue per signup month and month since signup."""
    signup = customers.select("customer_id", F.trunc("signup_date", "month").alias("cohort_month"))
    sizes = signup.groupBy("cohort_month").agg(n_rows().alias("cohort_size"))
    active = (
        orders.filter(is_valid())
        .join(signup, "customer_id")
        .withColumn("months_since_signup", months_between_months(F.col("order_date"), F.col("cohort_month")))
        .filter(F.col("months_since_signup").between(0, horizon - 1))
        .groupBy("cohort_month", "months_since_signup")
        .agg(F.count_distinct("customer_id").alias("active_customers"), F.sum("order_total").alias("revenue_inr"))
    )
    return active.join(sizes, "cohort_month").withColumn(
        "retention_pct", ratio("active_customers", "cohort_size", 100)
    )


def cohort_pivot(activity: DataFrame, horizon: int = 12) -> DataFrame:
    """Retention matrix: one row per cohort, one column per month since signup."""
    return activity.groupBy("cohort_month").agg(
        *[F.max(F.when(F.col("months_since_signup") == m, F.col("retention_pct"))).alias(f"m{m}") for m in range(horizon)]
    )


CLV_TIERS = ("Low", "Medium-Low", "Medium", "Medium-High", "High")


def clv_simple(
    customers: DataFrame, orders: DataFrame, items: DataFrame, products: DataFrame,
    gross_margin_pct: float | None = None, lifespan_months: float = 36.0,
) -> DataFrame:
    """CLV = order value x monthly frequency x lifespan x gross margin, with quintile tier."""
    line_profit = (
        items.select("order_id", "product_id", "quantity", "line_total")
        .join(products.select("product_id", "cost_price"), "product_id", "left")
        .groupBy("order_id")
        .agg(F.sum(F.col("line_total") - F.col("quantity") * F.col("cost_price")).alias("p"))
    )
    agg = orders.filter(is_valid()).join(line_profit, "order_id", "left").groupBy("customer_id").agg(
        n_rows().alias("total_orders"), F.sum("order_total").alias("total_revenue"),
        or_zero(F.sum("p")).alias("total_profit"),
        days_between(F.max("order_date"), F.min("order_date")).alias("lifespan_days"),
    )
    if gross_margin_pct is None:
        margin = agg.agg(
            F.when(F.sum("total_revenue") > 0, ratio(F.sum("total_profit"), F.sum("total_revenue"))).otherwise(0.3)
        ).scalar()
    else:
        margin = F.lit(gross_margin_pct / 100.0)
    zero = ("total_orders", "total_revenue", "total_profit", "lifespan_days")
    base = customers.select("customer_id").join(agg, "customer_id", "left").select(
        "customer_id", *[or_zero(c).alias(c) for c in zero]
    )
    base = base.select(
        "*",
        F.coalesce(ratio("total_revenue", "total_orders"), F.lit(0.0)).alias("avg_order_value"),
        F.when(F.col("lifespan_days") > 0, F.col("total_orders") / (F.col("lifespan_days") / 30.0))
        .otherwise(F.col("total_orders") / F.lit(lifespan_months)).alias("purchase_frequency"),
    ).withColumn("clv", F.col("avg_order_value") * F.col("purchase_frequency") * lifespan_months * margin)
    base = base.withColumn("clv", F.round(F.col("clv") * (1 + 1e-12), 2))
    ranked = running_totals(base, [F.col("clv"), F.col("customer_id")], rank="_r", count="_n")
    tiers = F.array(*[F.lit(t) for t in CLV_TIERS])
    return ranked.withColumn(
        "customer_value_tier", F.element_at(tiers, quantile_bin(F.col("_r"), F.col("_n"), 5))
    ).drop("_r", "_n")


def churn_features_cutoff(
    customers: DataFrame, orders: DataFrame, items: DataFrame, reviews: DataFrame, sessions: DataFrame,
    as_of: dt.date, window_days: int = 92,
) -> DataFrame:
    """Features known at the cutoff and a label for the days after it.

    The cutoff is ``as_of - window_days``; nothing after it enters a feature.
    """
    cutoff = as_of - dt.timedelta(days=window_days)
    known = F.col("order_date") <= F.lit(cutoff)
    per = orders.filter(F.col("order_date") <= F.lit(as_of)).groupBy("customer_id").agg(
        F.max(F.when(known, F.col("order_date"))).alias("last_order_date"),
        F.count_if(known).alias("total_orders"),
        F.sum(F.when(known, F.col("order_total"))).alias("total_spend"),
        F.sum(F.when(known, F.col("discount_amount"))).alias("_disc"),
        F.count_if(known & (F.col("order_status") == "Returned")).alias("returns_count"),
        F.count_if(~known).alias("_later"),
    )
    units = items.select("order_id", "quantity").join(
        orders.filter(known).select("order_id", "customer_id"), "order_id"
    ).groupBy("customer_id").agg(F.sum("quantity").alias("total_units_bought"))
    visits = sessions.filter(F.col("session_date") <= F.lit(cutoff)).groupBy("customer_id").agg(
        n_rows().alias("sessions_count"), F.avg("page_views").alias("avg_page_views"),
        F.avg("session_duration_sec").alias("avg_session_sec"), F.avg("checkout_completed").alias("checkout_rate"),
    )
    rated = reviews.filter(F.col("review_date") <= F.lit(cutoff)).groupBy("customer_id").agg(
        F.avg("rating").alias("avg_review_rating"), n_rows().alias("review_count")
    )
    out = customers
    for child in (per, units, visits, rated):
        out = out.join(child, "customer_id", "left")
    tenure = days_between(F.lit(cutoff), "signup_date")
    orders_n = or_zero("total_orders")
    aov = ratio("total_spend", "total_orders")
    return out.select(
        "customer_id", "state", "customer_segment", "age", "gender",
        orders_n.alias("total_orders"),
        or_zero(aov).alias("avg_order_value"),
        or_zero("total_spend").alias("total_spend"),
        or_zero(ratio("_disc", "total_orders")).alias("avg_discount_amount"),
        or_zero("returns_count").alias("returns_count"),
        or_zero(ratio("returns_count", "total_orders")).alias("return_rate"),
        or_zero(ratio(ratio("_disc", "total_orders"), aov, 100)).alias("discount_usage_pct"),
        *[or_zero(c).alias(c) for c in ("total_units_bought", "sessions_count", "avg_page_views", "avg_session_sec",
                                        "checkout_rate", "avg_review_rating", "review_count")],
        tenure.alias("customer_tenure_days"),
        F.when(orders_n > 0, days_between(F.lit(cutoff), "last_order_date")).otherwise(tenure).alias("days_since_last_order"),
        ((or_zero("_later") == 0) & (orders_n >= 1)).cast("int").alias("churn_label_90d"),
    )


def churn_features_view(customers: DataFrame, orders: DataFrame, sessions: DataFrame, reviews: DataFrame, as_of: dt.date) -> DataFrame:
    """Per-customer churn features with the simple 90-day idle label."""
    per = orders.groupBy("customer_id").agg(
        F.max("order_date").alias("last"), n_rows().alias("n"), F.sum("order_total").alias("spend"),
        F.sum("discount_amount").alias("disc"), F.count_if(F.col("order_status") == "Returned").alias("ret"),
    )
    visits = sessions.groupBy("customer_id").agg(
        n_rows().alias("sn"), F.avg("page_views").alias("pv"), F.avg("session_duration_sec").alias("sec")
    )
    rated = reviews.groupBy("customer_id").agg(F.avg("rating").alias("rating"))
    out = customers
    for child in (per, visits, rated):
        out = out.join(child, "customer_id", "left")
    idle = days_between(F.lit(as_of), F.coalesce("last", "signup_date"))
    return out.select(
        "customer_id", "age", "gender", "state", "customer_segment",
        idle.alias("days_since_last_order"), or_zero("n").alias("total_orders"),
        or_zero(ratio("spend", "n")).alias("avg_order_value"), or_zero("spend").alias("total_spend"),
        or_zero(ratio("ret", "n")).alias("return_rate"), or_zero(ratio("disc", "n")).alias("avg_discount_used"),
        or_zero("sn").alias("website_sessions"), or_zero("pv").alias("avg_page_views"),
        or_zero("sec").alias("avg_session_sec"), or_zero("rating").alias("avg_review_rating"),
        days_between(F.lit(as_of), "signup_date").alias("customer_tenure_days"),
        ((idle > 90) & (or_zero("n") >= 1)).cast("int").alias("churn_label_90d"),
    )


# --- behavioural features ---------------------------------------------------


def _known_orders(orders: DataFrame, as_of: dt.date) -> DataFrame:
    return orders.filter(F.col("order_date") <= F.lit(as_of))


def _purchase_aggs(cutoff: dt.date) -> list[Column]:
    recent = F.count_if(F.col("order_date") >= F.lit(cutoff))
    older = F.count_if(F.col("order_date") < F.lit(cutoff))
    span = days_between(F.max("order_date"), F.min("order_date")) + 1
    return [
        n_rows().alias("total_orders"),
        (n_rows() / span).alias("purchase_frequency"),
        F.when(older > 0, recent / older).otherwise(recent.cast("double")).alias("purchase_acceleration"),
        F.stddev_samp(F.unix_date("order_date")).alias("order_date_std"),
    ]


def purchase_patterns(orders: DataFrame, as_of: dt.date, recent_days: int = 90) -> DataFrame:
    """Order count, orders per tenure day, recent against older orders, date spread."""
    cutoff = as_of - dt.timedelta(days=recent_days)
    return _known_orders(orders, as_of).groupBy("customer_id").agg(*_purchase_aggs(cutoff))


def _basket_aggs(cutoff: dt.date) -> list[Column]:
    recent, older = F.col("order_date") >= F.lit(cutoff), F.col("order_date") < F.lit(cutoff)

    def mean_if(cond):
        return ratio(F.sum(F.when(cond, F.col("order_total"))), F.count_if(cond))

    return [
        F.avg("basket_size").alias("avg_basket_size"),
        ratio(F.sum("order_total"), n_rows()).alias("avg_basket_value"),
        F.coalesce(F.try_divide(mean_if(recent), mean_if(older)), F.lit(1.0)).alias("basket_value_trend"),
    ]


def _with_basket(orders: DataFrame, items: DataFrame) -> DataFrame:
    sizes = items.groupBy("order_id").agg(n_rows().alias("basket_size"))
    return orders.join(sizes, "order_id", "left")


def basket_characteristics(orders: DataFrame, items: DataFrame, as_of: dt.date, recent_days: int = 90) -> DataFrame:
    """Average basket size and value and the recent/older value ratio."""
    cutoff = as_of - dt.timedelta(days=recent_days)
    return _with_basket(_known_orders(orders, as_of), items).groupBy("customer_id").agg(*_basket_aggs(cutoff))


def engagement_metrics(sessions: DataFrame) -> DataFrame:
    """Sessions, duration, cart and checkout abandonment."""
    cart = F.count_if(F.col("cart_adds") > 0)
    bought = F.count_if(F.col("checkout_completed") > 0)
    started = F.count_if(F.col("checkout_started") > 0)
    return sessions.groupBy("customer_id").agg(
        n_rows().alias("total_sessions"), F.avg("session_duration_sec").alias("avg_session_duration"),
        F.when(cart > 0, (cart - bought) / cart).otherwise(0.0).alias("cart_abandonment_rate"),
        F.when(started > 0, (started - bought) / started).otherwise(0.0).alias("checkout_abandonment_rate"),
    )


def _owned_lines(orders: DataFrame, items: DataFrame, products: DataFrame) -> DataFrame:
    return (
        items.select("order_id", "product_id", "quantity", "discount_pct")
        .join(orders.select("order_id", "customer_id"), "order_id")
        .join(products.select("product_id", "category_name", "brand_name", "selling_price"), "product_id", "left")
    )


def price_sensitivity(orders: DataFrame, items: DataFrame, products: DataFrame) -> DataFrame:
    """Share of discounted lines, average discount, price/quantity correlation."""
    r = correlation(F.col("selling_price").cast("double"), F.col("quantity").cast("double"))
    return _owned_lines(orders, items, products).groupBy("customer_id").agg(
        (F.count_if(F.col("discount_pct") > 0) / n_rows()).alias("discount_dependency"),
        ratio(F.sum("discount_pct"), n_rows()).alias("avg_discount_pct"),
        F.when(n_rows() > 1, F.coalesce(F.nanvl(r, F.lit(0.0)), F.lit(0.0))).otherwise(0.0).alias("price_sensitivity"),
    )


def return_propensity(orders: DataFrame) -> DataFrame:
    """Returned orders over all orders."""
    return orders.groupBy("customer_id").agg(
        (F.count_if(F.col("order_status") == "Returned") / n_rows()).alias("return_rate")
    )


def temporal_patterns(orders: DataFrame, as_of: dt.date) -> DataFrame:
    """Tenure, recency and the mean and deviation of days between orders.

    Orders are counted per customer and day first.  The gaps inside a day are
    zero, so the window holds at most one row per calendar day of a customer.
    """
    days = _known_orders(orders, as_of).groupBy("customer_id", "order_date").agg(n_rows().alias("n"))
    w = W.partitionBy("customer_id").orderBy("order_date")
    gaps = days.withColumn("gap", F.datediff("order_date", F.lag("order_date").over(w)).cast("double"))
    agg = gaps.groupBy("customer_id").agg(
        F.min("order_date").alias("first"), F.max("order_date").alias("last"),
        (F.sum("n") - 1).alias("k"), F.sum("gap").alias("s"), F.sum(F.col("gap") * F.col("gap")).alias("ss"),
    )
    tenure = days_between(F.lit(as_of), "first")
    mean = F.try_divide(or_zero("s"), F.col("k"))
    return agg.select(
        "customer_id", tenure.alias("customer_tenure_days"), days_between(F.lit(as_of), "last").alias("days_since_last_order"),
        F.when(F.col("k") > 0, mean).otherwise(tenure.cast("double")).alias("avg_interpurchase_days"),
        F.when(F.col("k") > 1, F.sqrt(F.greatest(F.lit(0.0), F.try_divide(or_zero("ss") - F.col("k") * mean * mean, F.col("k") - 1))))
        .otherwise(0.0).alias("std_interpurchase_days"),
    )


def diversity_metrics(orders: DataFrame, items: DataFrame, products: DataFrame) -> DataFrame:
    """Distinct categories and brands and the category concentration index."""
    cells = _owned_lines(orders, items, products).groupBy("customer_id", "category_name", "brand_name").agg(n_rows().alias("n"))
    brands = cells.groupBy("customer_id", "brand_name").agg(F.sum("n").alias("n")).groupBy("customer_id").agg(n_rows().alias("unique_brands"))
    by_category = cells.groupBy("customer_id", "category_name").agg(F.sum("n").alias("n")).groupBy("customer_id").agg(
        n_rows().alias("unique_categories"), ratio(F.sum(F.col("n") * F.col("n")), F.sum("n") * F.sum("n")).alias("category_concentration"))
    return by_category.join(brands, "customer_id")


def behavioral_features(
    customers: DataFrame, orders: DataFrame, items: DataFrame, sessions: DataFrame, products: DataFrame, as_of: dt.date
) -> DataFrame:
    """All behavioural features; order-level ones share a single aggregation."""
    cutoff = as_of - dt.timedelta(days=90)
    known = _known_orders(orders, as_of)
    order_level = _with_basket(known, items).groupBy("customer_id").agg(
        *_purchase_aggs(cutoff), *_basket_aggs(cutoff),
        (F.count_if(F.col("order_status") == "Returned") / n_rows()).alias("return_rate"),
    )
    parts = [
        order_level, engagement_metrics(sessions), price_sensitivity(known, items, products),
        temporal_patterns(orders, as_of), diversity_metrics(known, items, products),
    ]
    out = customers.select("customer_id")
    for part in parts:
        out = out.join(part, "customer_id", "left")
    keep_null = {"customer_id", "total_orders", "purchase_frequency", "purchase_acceleration", "order_date_std",
                 "avg_basket_size", "avg_basket_value", "basket_value_trend"}
    return out.select(*[F.col(c) if c in keep_null else or_zero(c).alias(c) for c in out.columns])


def fingerprints(features: DataFrame) -> DataFrame:
    """Pattern, sensitivity, engagement and diversity classes with suggested actions."""
    v = lambda c: or_zero(c)
    pattern = (
        F.when(v("purchase_acceleration") > 1.2, "Accelerating")
        .when(v("purchase_acceleration") < 0.8, "Decelerating")
        .when(v("purchase_frequency") > 0.1, "High Frequency")
        .when(v("purchase_frequency") > 0.05, "Medium Frequency")
        .otherwise("Low Frequency")
    )
    level = lambda c, hi, mid: F.when(v(c) > hi, "High").when(v(c) > mid, "Medium").otherwise("Low")
    out = features.withColumn("purchase_pattern", pattern)
    out = out.withColumn("price_sensitivity_level", level("discount_dependency", 0.7, 0.4))
    out = out.withColumn("engagement_level", level("total_sessions", 20, 10))
    out = out.withColumn("diversity_level", level("unique_categories", 5, 3))
    actions = F.array_compact(F.array(
        F.when(F.col("purchase_pattern") == "Decelerating", "Re-engagement campaign recommended")
        .when(F.col("purchase_pattern") == "Accelerating", "Upsell opportunity - customer is increasing activity"),
        F.when(F.col("price_sensitivity_level") == "High", "Target with discount offers")
        .when(F.col("price_sensitivity_level") == "Low", "Focus on value proposition rather than discounts"),
        F.when(F.col("engagement_level") == "Low", "Improve onboarding and engagement"),
        F.when(v("return_rate") > 0.2, "Investigate product quality or fit issues"),
        F.when(v("cart_abandonment_rate") > 0.7, "Implement cart recovery emails"),
    ))
    return out.withColumn("recommendations", actions)
