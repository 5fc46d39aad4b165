"""Marketing: funnels, campaigns, journeys, media mix and budget allocation.

Channels and campaigns are small dimensions, so windows over channel tables are
bounded by the number of channels, and windows over daily series by the calendar.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marketloom.functions.exprs import is_valid, n_rows, or_zero, ratio
from marketloom.functions.ml import fit_cached
from marketloom.functions.ordered import decayed_totals, quantiles, running_totals

STAGES = ("signup", "view", "click", "purchase")


def _pos_ratio(num: str | Column, den: str | Column, scale: float = 1.0) -> Column:
    """Ratio that is 0 where the denominator is not positive."""
    return or_zero(ratio(num, den, scale))


def channel_day_funnel(sessions: DataFrame, campaigns: DataFrame, spend: DataFrame, orders: DataFrame) -> DataFrame:
    """Channel x day funnel; spend and orders are aggregated to the same key first."""
    camp = campaigns.select("campaign_id", F.col("channel").alias("camp_channel"))
    visits = sessions.join(camp, "campaign_id", "left").withColumn(
        "channel", F.coalesce("camp_channel", "channel", F.lit("Unknown"))
    )
    funnel = visits.groupBy("channel", F.col("session_date").alias("day")).agg(
        n_rows().alias("sessions"), F.sum("page_views").alias("page_views"), F.sum("product_views").alias("product_views"),
        F.sum("cart_adds").alias("cart_adds"), F.sum("checkout_started").alias("checkouts_started"),
        F.sum("checkout_completed").alias("checkouts_completed"), F.count_distinct("customer_id").alias("signed_in_users"),
        F.count_distinct(F.when(F.col("checkout_completed") > 0, F.col("customer_id"))).alias("_buyers"),
    )
    cost = spend.groupBy("channel", F.col("spend_date").alias("day")).agg(
        F.sum("impressions").alias("impressions"), F.sum("clicks").alias("clicks"), F.sum("spend_amount").alias("spend")
    )
    sales = orders.filter(is_valid()).select("customer_id", F.col("order_date").alias("day"), "order_total").join(
        visits.select("customer_id", F.col("session_date").alias("day"), "channel"), ["customer_id", "day"]
    ).groupBy("channel", "day").agg(F.sum("order_total").alias("_revenue"))
    out = funnel.join(cost, ["channel", "day"], "left").join(sales, ["channel", "day"], "left")
    return out.select(
        "channel", "day", "sessions", "page_views", "product_views", "cart_adds", "checkouts_started", "checkouts_completed",
        "signed_in_users", ratio(F.nullif("checkouts_completed", F.lit(0)), "sessions", 100).alias("conversion_rate_pct"),
        or_zero("impressions").alias("impressions"), or_zero("clicks").alias("clicks"), or_zero("spend").alias("spend"),
        ratio("clicks", "impressions", 100).alias("ctr_pct"), ratio("spend", "clicks").alias("cpc"),
        ratio("spend", "_buyers").alias("cac"), ratio("_revenue", "spend").alias("roas"),
    )


def marketing_funnel(sessions: DataFrame, campaigns: DataFrame, spend: DataFrame, orders: DataFrame, customers: DataFrame) -> DataFrame:
    """Channel x day funnel with step rates; an order belongs to its customer's session that day."""
    camp = campaigns.select("campaign_id", F.col("channel").alias("camp_channel"))
    visits = sessions.join(camp, "campaign_id", "left").withColumn(
        "channel", F.coalesce("channel", "camp_channel", F.lit("Unknown"))
    )
    funnel = visits.groupBy("channel", "session_date").agg(
        n_rows().alias("sessions"), F.sum("page_views").alias("page_views"), F.sum("product_views").alias("product_views"),
        F.sum("cart_adds").alias("cart_adds"), F.sum("checkout_started").alias("checkouts_started"),
        F.sum("checkout_completed").alias("checkouts_completed"), F.count("customer_id").alias("signed_in_users"),
    )
    first = orders.groupBy("customer_id").agg(F.min("order_date").alias("_first"))
    new = customers.select("customer_id", "signup_date").join(first, "customer_id").select(
        "customer_id", (F.col("_first") == F.col("signup_date")).cast("int").alias("is_new")
    )
    one_session = visits.groupBy("customer_id", "session_date").agg(F.min_by("channel", "session_id").alias("channel"))
    sales = (
        orders.filter(is_valid()).select("customer_id", F.col("order_date").alias("session_date"), "order_total")
        .join(one_session, ["customer_id", "session_date"]).join(new, "customer_id", "left")
        .groupBy("channel", "session_date")
        .agg(n_rows().alias("orders"), F.sum(or_zero("is_new")).alias("new_customers"), F.sum("order_total").alias("revenue_inr"))
    )
    cost = spend.groupBy("channel", F.col("spend_date").alias("session_date")).agg(
        F.sum("impressions").alias("impressions"), F.sum("clicks").alias("clicks"), F.sum("spend_amount").alias("spend_inr")
    )
    key = ["channel", "session_date"]
    out = funnel.join(sales, key, "left").join(cost, key, "left")
    out = out.select(*funnel.columns, *[or_zero(c).alias(c) for c in (
        "orders", "new_customers", "revenue_inr", "impressions", "clicks", "spend_inr")])
    return out.select(
        "*", _pos_ratio("clicks", "impressions", 100).alias("ctr_pct"), _pos_ratio("spend_inr", "clicks").alias("cpc"),
        _pos_ratio("checkouts_completed", "sessions", 100).alias("conversion_rate_pct"),
        _pos_ratio("spend_inr", "new_customers").alias("cac"), _pos_ratio("revenue_inr", "spend_inr").alias("roas"),
        _pos_ratio("cart_adds", "sessions", 100).alias("session_to_cart_rate_pct"),
        _pos_ratio("checkouts_started", "cart_adds", 100).alias("cart_to_checkout_rate_pct"),
        _pos_ratio("checkouts_completed", "checkouts_started", 100).alias("checkout_completion_rate_pct"),
    )


def campaign_performance(campaigns: DataFrame, spend: DataFrame, sessions: DataFrame, orders: DataFrame) -> DataFrame:
    """Spend, sessions, orders and efficiency ratios per campaign."""
    cost = spend.groupBy("campaign_id").agg(
        F.sum("impressions").alias("total_impressions"), F.sum("clicks").alias("total_clicks"),
        F.sum("spend_amount").alias("total_spend"), F.count_distinct("spend_date").alias("days_active"),
    )
    visits = sessions.filter(F.col("campaign_id").isNotNull()).groupBy("campaign_id").agg(
        n_rows().alias("total_sessions"), F.sum("page_views").alias("total_page_views"), F.sum("cart_adds").alias("total_cart_adds"),
        F.sum("checkout_completed").alias("total_checkouts"), F.count_distinct("customer_id").alias("customers_reached"),
    )
    sales = orders.filter(is_valid() & F.col("campaign_id").isNotNull()).groupBy("campaign_id").agg(
        n_rows().alias("total_orders"), F.sum("order_total").alias("total_revenue"),
        F.count_distinct("customer_id").alias("unique_customers"),
    )
    out = campaigns
    for child in (cost, visits, sales):
        out = out.join(child, "campaign_id", "left")
    counted = [c for c in out.columns if c not in campaigns.columns and c != "days_active"]
    out = out.select(*campaigns.columns, "days_active", *[or_zero(c).alias(c) for c in counted])
    return out.select(
        "*", _pos_ratio("total_clicks", "total_impressions", 100).alias("ctr_pct"), _pos_ratio("total_spend", "total_clicks").alias("cpc"),
        _pos_ratio("total_spend", "unique_customers").alias("cac"), _pos_ratio("total_revenue", "total_spend").alias("roas"),
        _pos_ratio("total_checkouts", "total_sessions", 100).alias("conversion_rate_pct"),
        _pos_ratio("total_spend", "total_budget", 100).alias("budget_utilization_pct"),
        _pos_ratio("total_spend", "days_active").alias("daily_spend_avg"),
    )


def overall_funnel(sessions: DataFrame, orders: DataFrame) -> DataFrame:
    """Totals of each funnel step and the ratios between them."""
    steps = sessions.agg(
        n_rows().alias("total_sessions"), F.sum("page_views").alias("total_page_views"), F.sum("product_views").alias("total_product_views"),
        F.sum("cart_adds").alias("total_cart_adds"), F.sum("checkout_started").alias("total_checkouts_started"),
        F.sum("checkout_completed").alias("total_checkouts_completed"),
    )
    valid = orders.filter(is_valid()).agg(F.struct(n_rows().alias("n"), F.count_distinct("customer_id").alias("c"))).scalar()
    out = steps.withColumn("o", valid).withColumn("total_orders", F.col("o.n")).withColumn("total_unique_customers", F.col("o.c")).drop("o")
    r = lambda a, b, s, n: _pos_ratio(a, b, s).alias(n)
    return out.select(
        "*", r("total_page_views", "total_sessions", 1, "session_to_pageview"),
        r("total_product_views", "total_sessions", 100, "session_to_productview_pct"),
        r("total_cart_adds", "total_sessions", 100, "session_to_cart_pct"),
        r("total_checkouts_started", "total_cart_adds", 100, "cart_to_checkout_pct"),
        r("total_checkouts_completed", "total_checkouts_started", 100, "checkout_completion_pct"),
        r("total_orders", "total_sessions", 100, "session_to_order_pct"),
        r("total_orders", "total_checkouts_completed", 100, "checkout_to_order_pct"),
    )


# --- journeys ----------------------------------------------------------------


def customer_stages(events: DataFrame, stages: Sequence[str] = STAGES, extra: Sequence[str] = ()) -> DataFrame:
    """One row per customer with a flag for each stage reached."""
    return events.groupBy("customer_id", *extra).agg(
        *[F.max((F.col("event_type") == s).cast("int")).alias(s) for s in stages]
    )


def funnel_by_stage(events: DataFrame, stages: Sequence[str] = STAGES, by: Sequence[str] = ()) -> DataFrame:
    """Distinct customers per stage with conversion and drop-off to the next one."""
    reached = customer_stages(events, stages, by)
    totals = reached.groupBy(*by).agg(*[F.sum(s).alias(s) for s in stages])
    rows = []
    for i, stage in enumerate(stages):
        nxt = F.col(stages[i + 1]) if i + 1 < len(stages) else F.lit(None).cast("long")
        rows.append(F.struct(
            F.lit(i).alias("stage_no"), F.lit(stage).alias("stage"), F.col(stage).alias("customers"), nxt.alias("next_customers"),
            F.col(stages[0]).alias("first"), F.col(stages[-1]).alias("last"),
        ))
    out = totals.select(*by, F.explode(F.array(*rows)).alias("r")).select(*by, "r.*")
    return out.select(
        *by, "stage_no", "stage", "customers", ratio("next_customers", "customers").alias("conversion_to_next"),
        (1 - ratio("next_customers", "customers")).alias("drop_off_to_next"),
        or_zero(ratio("last", "first")).alias("overall_conversion_rate"),
    )


def segment_funnels(events: DataFrame, segments: DataFrame, segment: str, stages: Sequence[str] = STAGES) -> DataFrame:
    """Overall conversion and entry size per customer segment, best first."""
    tagged = events.join(segments.select("customer_id", segment), "customer_id", "left")
    per = funnel_by_stage(tagged, stages, by=[segment]).filter(F.col("stage_no") == 0)
    return per.select(segment, "overall_conversion_rate", F.col("customers").alias("n_customers"))


def journey_steps(events: DataFrame, max_length: int = 10) -> DataFrame:
    """Each customer's first events in time order as a path of bounded length.

    The row limit per customer is applied before the shuffle, so a customer with
    very many events sends only ``max_length`` rows from each task.
    """
    w = W.partitionBy("customer_id").orderBy("event_ts", "event_id")
    first = events.select("customer_id", "event_ts", "event_id", "event_type").withColumn("_k", F.row_number().over(w)).filter(
        F.col("_k") <= max_length
    )
    steps = first.groupBy("customer_id").agg(F.array_sort(F.collect_list(F.struct("_k", "event_type"))).alias("s"))
    names = F.transform("s", lambda x: x["event_type"])
    return steps.select(
        "customer_id", F.array_join(names, " -> ").alias("path"), F.size("s").alias("path_length"),
        F.element_at(names, -1).alias("final_stage"),
    )


def top_paths(steps: DataFrame, n: int = 10) -> DataFrame:
    counts = steps.groupBy("path").agg(n_rows().alias("customers"))
    return counts.orderBy(F.col("customers").desc(), "path").limit(n)


def path_length_stats(steps: DataFrame) -> DataFrame:
    """Path totals; the lengths are bounded, so the median aggregate holds few values."""
    unique = steps.agg(F.count_distinct("path")).scalar()
    return steps.agg(
        F.avg("path_length").alias("avg_path_length"), F.percentile("path_length", 0.5).alias("median_path_length"),
        F.max("path_length").alias("max_path_length"),
    ).withColumn("n_unique_paths", unique)


def drop_offs(events: DataFrame, stages: Sequence[str] = STAGES) -> DataFrame:
    """Customers who reached a stage but not the next; marks the largest rate."""
    reached = customer_stages(events, stages)
    pairs = list(zip(stages, stages[1:]))
    agg = reached.agg(*[
        F.struct(
            F.lit(i).alias("step"), F.lit(a).alias("from_stage"), F.lit(b).alias("to_stage"),
            F.count_if((F.col(a) == 1) & (F.col(b) == 0)).alias("n_dropped_off"), F.sum(a).alias("_n"), F.sum(b).alias("n_remaining"),
        ).alias(f"p{i}")
        for i, (a, b) in enumerate(pairs)
    ])
    rows = agg.select(F.explode(F.array(*[F.col(f"p{i}") for i in range(len(pairs))])).alias("r")).select("r.*")
    rows = rows.withColumn("drop_off_rate", or_zero(ratio("n_dropped_off", "_n")))
    w = W.partitionBy(F.lit(0))  # one row per stage pair
    largest = F.max_by("step", F.struct(F.col("drop_off_rate"), -F.col("step"))).over(w)
    return rows.select("from_stage", "to_stage", "n_dropped_off", "drop_off_rate", "n_remaining", (F.col("step") == largest).alias("is_largest"))


def time_between_events(events: DataFrame, stages: Sequence[str] = STAGES) -> DataFrame:
    """Hours between consecutive events of a customer per kind of transition.

    The previous event is found on range-partitioned rows, so one customer's
    history may span many tasks.
    """
    base = events.select("customer_id", "event_ts", "event_id", "event_type", F.struct("event_type", "event_ts").alias("cur"))
    pairs = running_totals(base, [F.col("event_ts"), F.col("event_id")], keys=["customer_id"], carry={"prev": "cur"}, rank=None)
    seconds = (F.unix_micros(F.col("event_ts").cast("timestamp")) - F.unix_micros(F.col("prev.event_ts").cast("timestamp"))) / 1e6
    hours = pairs.filter(F.col("event_type").isin(*stages) & F.col("prev.event_type").isin(*stages)).select(
        F.concat_ws("_to_", "prev.event_type", "event_type").alias("transition"), (seconds / 3600).alias("hours")
    )
    stats = hours.groupBy("transition").agg(
        F.avg("hours").alias("mean_hours"), F.stddev_pop("hours").alias("std_hours"), F.min("hours").alias("min_hours"),
        F.max("hours").alias("max_hours"), n_rows().alias("n_transitions"),
    )
    return stats.join(quantiles(hours, "hours", {"median_hours": 0.5}, keys=["transition"]), "transition")


def funnel_value(events: DataFrame, orders: DataFrame, stages: Sequence[str] = STAGES) -> DataFrame:
    """Order value of the customers who reached each stage."""
    value = orders.groupBy("customer_id").agg(F.sum("order_total").alias("v"), n_rows().alias("n"))
    reached = customer_stages(events, stages).join(value, "customer_id", "left")
    per = reached.agg(*[
        F.struct(
            F.lit(s).alias("stage"), F.sum(F.when(F.col(s) == 1, F.col("v"))).alias("total_value"),
            F.sum(F.when(F.col(s) == 1, F.col("n"))).alias("_n"), F.sum(s).alias("n_customers"),
        ).alias(s) for s in stages
    ])
    rows = per.select(F.explode(F.array(*[F.col(s) for s in stages])).alias("r")).select("r.*")
    return rows.select("stage", or_zero("total_value").alias("total_value"), or_zero(ratio("total_value", "_n")).alias("avg_value_per_customer"), "n_customers")


# --- media mix ---------------------------------------------------------------


def adstock(df: DataFrame, series: Sequence[str], time: str, value: str, decay: float = 0.5, out: str = "adstock") -> DataFrame:
    """Carry-over a[t] = x[t] + decay * a[t-1] along each series, of any length."""
    valued = df.select(*series, time, F.col(value).cast("double").alias(value))
    return decayed_totals(valued, [time], value, out, decay, series)


def saturation(value: str | Column, point: float = 1000.0) -> Column:
    """Diminishing response x / (x + point)."""
    v = F.col(value) if isinstance(value, str) else value
    return F.try_divide(v, v + F.lit(float(point)))


def channel_days(spend: DataFrame, daily: DataFrame, channels: Sequence[str]) -> DataFrame:
    """Dense (day, channel) spend for the days that have both spend and sales.

    ``daily`` has one row per day with ``day`` and ``sales``.
    """
    days = spend.select(F.col("spend_date").alias("day")).distinct().join(daily, "day")
    dense = days.select("day", "sales", F.explode(F.array(*[F.lit(c) for c in channels])).alias("channel"))
    cost = spend.groupBy(F.col("spend_date").alias("day"), "channel").agg(F.sum("spend_amount").cast("double").alias("spend"))
    return dense.join(cost, ["day", "channel"], "left").withColumn("spend", F.coalesce("spend", F.lit(0.0)))


def media_mix_data(days: DataFrame, decay: float = 0.5, point: float = 1000.0) -> DataFrame:
    """Spend, adstock and saturated spend per channel and day next to the day's sales."""
    sales = days.select("day", "channel", "sales")
    stock = adstock(days, ["channel"], "day", "spend", decay)
    return stock.join(sales, ["channel", "day"]).withColumn("saturated", saturation("adstock", point))


def fit_media_mix(mmm: DataFrame, channels: Sequence[str], model_type: str = "linear") -> DataFrame:
    """Sales on saturated spend; coefficients and errors on a hash split by day."""
    wide = mmm.groupBy("day").agg(
        F.max("sales").cast("double").alias("label"),
        *[F.max(F.when(F.col("channel") == c, F.col("saturated"))).alias(f"x{i}") for i, c in enumerate(channels)],
    )
    data = VectorAssembler(inputCols=[f"x{i}" for i in range(len(channels))], outputCol="features").transform(wide)
    held_out = F.pmod(F.xxhash64("day"), F.lit(5)) == 0
    data = data.persist()  # one row per day
    train, test = data.filter(~held_out), data.filter(held_out)
    if model_type in ("linear", "ridge"):
        model = fit_cached(LinearRegression(regParam=1.0 if model_type == "ridge" else 0.0), train)
        weights = model.coefficients
    elif model_type == "gradient_boosting":
        model = fit_cached(GBTRegressor(maxIter=20, seed=42), train)
        weights = model.featureImportances
    else:
        raise ValueError(f"unknown model type {model_type}")
    score = lambda d, m: RegressionEvaluator(metricName=m).evaluate(model.transform(d))
    rows = [(model_type, c, float(weights[i])) for i, c in enumerate(channels)]
    out = mmm.sparkSession.createDataFrame(rows, "model_type string, channel string, coefficient double")
    return out.select(
        "*", F.lit(score(train, "mae")).alias("train_mae"), F.lit(score(test, "mae")).alias("test_mae"),
        F.lit(score(train, "r2")).alias("train_r2"), F.lit(score(test, "r2")).alias("test_r2"),
    )


def channel_roi(mmm: DataFrame, coefficients: DataFrame) -> DataFrame:
    """Contribution = coefficient x total saturated spend, and its return on spend."""
    totals = mmm.groupBy("channel").agg(F.sum("spend").alias("total_spend"), F.sum("saturated").alias("_sat"))
    out = totals.join(coefficients.select("channel", "coefficient"), "channel")
    contribution = F.col("coefficient") * F.col("_sat")
    return out.select(
        "channel", "total_spend", "coefficient", contribution.alias("estimated_contribution"),
        or_zero(F.try_divide(contribution - F.col("total_spend"), F.col("total_spend"))).alias("roi"),
    )


def allocate_by_coefficient(coefficients: DataFrame, total_budget: float, min_share: float = 0.05) -> DataFrame:
    """A floor for each channel and the rest by coefficient."""
    s = coefficients.agg(F.struct(F.sum("coefficient").alias("c"), n_rows().alias("n"))).scalar()
    out = coefficients.withColumn("s", s)
    weight = F.when(F.col("s.c") > 0, F.col("coefficient") / F.col("s.c")).otherwise(1 / F.col("s.n"))
    budget = F.lit(total_budget * min_share) + weight * (F.lit(total_budget) - F.lit(total_budget * min_share) * F.col("s.n"))
    return out.select("channel", "coefficient", budget.alias("budget"), (budget / total_budget * 100).alias("percentage"))


def decompose(df: DataFrame, series: Sequence[str], time: str, value: str, period: int = 7, model: str = "additive") -> DataFrame:
    """Moving-average trend, mean seasonal effect by phase, and residual.

    Rows beyond the ends of the series count as zero in the trend.
    """
    w = W.partitionBy(*series).orderBy(time)
    right = (period - 1) // 2
    v = F.col(value).cast("double")
    out = df.select(*series, time, v.alias("original"), (F.row_number().over(w) - 1).alias("_t"))
    out = out.withColumn("trend", F.sum("original").over(w.rowsBetween(right - (period - 1), right)) / period)
    off = F.col("original") - F.col("trend") if model == "additive" else F.try_divide(F.col("original"), F.col("trend"))
    out = out.withColumn("_off", off).withColumn("_phase", F.col("_t") % period)
    out = out.withColumn("seasonal", F.avg("_off").over(W.partitionBy(*series, "_phase")))
    rest = (
        F.col("original") - F.col("trend") - F.col("seasonal") if model == "additive"
        else F.try_divide(F.col("original"), F.col("trend") * F.col("seasonal"))
    )
    return out.select(*series, time, "original", "trend", "seasonal", rest.alias("residual"))


def baseline_sales(days: DataFrame) -> DataFrame:
    """Baseline = mean sales of days almost without spend, else the lowest day."""
    daily = days.groupBy("day").agg(F.max("sales").cast("double").alias("sales"), F.sum("spend").alias("spend"))
    cut = daily.agg(F.percentile("spend", 0.1) * 0.01).scalar()
    quiet = daily.withColumn("_cut", cut).agg(
        F.coalesce(F.avg(F.when(F.col("spend") < F.col("_cut"), F.col("sales"))), F.min("sales"))
    ).scalar()
    out = daily.withColumn("baseline_sales", quiet)
    return out.withColumn("incremental_sales", F.col("sales") - F.col("baseline_sales"))


def attribution(days: DataFrame, method: str = "spend_share") -> DataFrame:
    """Share of revenue credited to each channel."""
    per = days.groupBy("channel").agg(F.sum("spend").alias("v"), F.max_by("spend", "day").alias("last"))
    if method == "first_touch":
        n = per.agg(n_rows()).scalar()
        return per.select("channel", (1 / n).alias("share"))
    value = "last" if method == "last_touch" else "v"
    total = per.agg(F.sum(value)).scalar()
    return per.select("channel", or_zero(F.try_divide(F.col(value), total)).alias("share"))


def allocate_by_roi_share(days: DataFrame, total_budget: float, min_share: float = 0.05) -> DataFrame:
    """Split by revenue over spend, lift to the minimum, rescale to the budget."""
    revenue = days.groupBy("day").agg(F.max("sales").alias("s")).agg(F.sum("s").cast("double")).scalar()
    per = days.groupBy("channel").agg(F.sum("spend").alias("spend")).withColumn(
        "roi", or_zero(F.try_divide(revenue, F.col("spend")))
    )
    s = per.agg(F.struct(F.sum("roi").alias("roi"), n_rows().alias("n"))).scalar()
    share = F.when(F.col("s.roi") > 0, F.col("roi") / F.col("s.roi")).otherwise(1 / F.col("s.n"))
    raised = per.withColumn("s", s).withColumn("_b", F.greatest(share * total_budget, F.lit(total_budget * min_share)))
    total = raised.agg(F.sum("_b")).scalar()
    return raised.select("channel", "roi", (F.col("_b") / total * total_budget).alias("budget"))


def marginal_roi(days: DataFrame, slices: int = 5) -> DataFrame:
    """Revenue over spend in the highest-spend slice of days per channel."""
    w = W.partitionBy("channel")
    ranked = days.withColumn("_r", F.row_number().over(w.orderBy("spend", "day"))).withColumn("_n", n_rows().over(w))
    size = F.greatest(F.floor(F.col("_n") / slices), F.lit(1))
    part = F.least(F.floor((F.col("_r") - 1) / size), F.lit(slices - 1))
    per = ranked.groupBy("channel", part.alias("slice")).agg(F.sum("spend").alias("c"), F.sum("sales").cast("double").alias("v"))
    paid = per.filter(F.col("c") > 0).withColumn("roi", F.col("v") / F.col("c"))
    return per.select("channel").distinct().join(
        paid.groupBy("channel").agg(F.max_by("roi", "slice").alias("marginal_roi")), "channel", "left"
    ).withColumn("marginal_roi", or_zero("marginal_roi"))


# --- budget allocation over a (channel, roi) table ---------------------------


def channel_returns(spend: DataFrame, campaigns: DataFrame, orders: DataFrame) -> DataFrame:
    """Spend and campaign-attributed revenue per channel."""
    cost = spend.groupBy("channel").agg(F.sum("spend_amount").cast("double").alias("spend"))
    sales = orders.filter(is_valid()).groupBy("campaign_id").agg(F.sum("order_total").alias("r")).join(
        campaigns.select("campaign_id", "channel"), "campaign_id"
    ).groupBy("channel").agg(F.sum("r").cast("double").alias("revenue"))
    return cost.join(sales, "channel", "left").withColumn("roi", or_zero(F.try_divide(F.col("revenue"), F.col("spend"))))


def optimize_by_roi(roi: DataFrame, total_budget: float, min_share: float = 0.05, max_share: float = 0.5) -> DataFrame:
    """ROI-weighted split, clamped to the share bounds, rescaled to the budget."""
    positive = roi.select("channel", "roi", F.greatest(F.col("roi"), F.lit(0.0)).alias("_w"))
    s = positive.agg(F.struct(F.sum("_w").alias("w"), n_rows().alias("n"))).scalar()
    weight = F.when(F.col("s.w") > 0, F.col("_w") / F.col("s.w")).otherwise(1 / F.col("s.n"))
    clamped = positive.withColumn("s", s).withColumn(
        "_b", F.greatest(F.lit(total_budget * min_share), F.least(F.lit(total_budget * max_share), weight * total_budget))
    )
    total = clamped.agg(F.sum("_b")).scalar()
    budget = F.col("_b") * (F.lit(float(total_budget)) / total)
    return clamped.select("channel", "roi", budget.alias("budget"), (budget / total_budget * 100).alias("percentage"))


def optimize_linear(roi: DataFrame, total_budget: float, min_share: float = 0.05, max_share: float = 0.5) -> DataFrame:
    """Exact maximum of sum(budget x roi) with bounds per channel.

    The objective is linear, so after every channel has its minimum the rest
    fills the channels from the best return down.
    """
    low, cap = total_budget * min_share, total_budget * (max_share - min_share)
    n = roi.agg(n_rows()).scalar()
    w = W.partitionBy(F.lit(0)).orderBy(F.col("roi").desc(), "channel")  # a channel table
    ranked = roi.select("channel", "roi").withColumn("_k", F.row_number().over(w)).withColumn("_n", n)
    rest = F.lit(float(total_budget)) - F.col("_n") * low
    extra = F.greatest(F.lit(0.0), F.least(F.lit(cap), rest - (F.col("_k") - 1) * cap))
    budget = F.lit(low) + extra
    return ranked.select(
        "channel", "roi", budget.alias("budget"), (budget / total_budget * 100).alias("percentage"),
        (budget * F.col("roi")).alias("expected_return"),
    )


def scenario_totals(allocation: DataFrame, scenarios: Mapping[str, Mapping[str, float]]) -> DataFrame:
    """Total return of the allocation under multipliers per channel, against the base."""
    named = {"base": {}} | {k: dict(v) for k, v in scenarios.items()}
    factor = [
        F.struct(F.lit(name).alias("scenario"), F.coalesce(
            *[F.when(F.col("channel") == c, F.lit(float(m))) for c, m in adj.items()], F.lit(1.0)).alias("m"))
        for name, adj in named.items()
    ]
    per = allocation.select("budget", "roi", F.explode(F.array(*factor)).alias("s")).groupBy(F.col("s.scenario").alias("scenario")).agg(
        F.sum(F.col("budget") * F.col("s.m")).alias("total_budget"), F.sum(F.col("budget") * F.col("s.m") * F.col("roi")).alias("total_roi")
    )
    base = allocation.agg(F.sum(F.col("budget") * F.col("roi"))).scalar()
    return per.withColumn("_b", base).select(
        "scenario", "total_budget", "total_roi",
        F.when(F.col("_b") > 0, (F.col("total_roi") - F.col("_b")) / F.col("_b") * 100).otherwise(0.0).alias("roi_change_pct"),
    )


def recommend_reallocation(allocation: DataFrame, target_roi: float = 0.1) -> DataFrame:
    """Raise, keep or cut each channel against the target return, rescaled to the same total."""
    roi = F.col("roi")
    change = F.when(roi < 0, -0.5).when(roi < target_roi, -0.2).when(roi > target_roi * 1.5, 0.3).otherwise(0.0)
    out = allocation.select(
        "channel", F.col("budget").alias("current_budget"), F.col("percentage").alias("current_percentage"), "roi",
        F.when(roi < target_roi, "decrease").when(roi > target_roi * 1.5, "increase").otherwise("maintain").alias("action"),
        F.when(roi < 0, "negative_roi").when(roi < target_roi, "below_target").when(roi > target_roi * 1.5, "above_target")
        .otherwise("on_target").alias("reason"),
        (change * 100).alias("change_pct"), (F.col("budget") * (1 + change)).alias("_s"),
    )
    s = out.agg(F.struct(F.sum("current_budget").alias("b"), F.sum("_s").alias("s"))).scalar()
    out = out.withColumn("s", s).withColumn("suggested_budget", F.col("_s") * F.col("s.b") / F.col("s.s"))
    return out.withColumn("suggested_percentage", F.col("suggested_budget") / F.col("s.b") * 100).drop("s", "_s")
