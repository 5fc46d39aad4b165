"""Prices: elasticity, price search, experiments, allocation and what-if tables."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.functions.dist import normal_cdf, t_two_sided, z_value
from marketloom.functions.exprs import correlation, n_rows, or_zero, with_one_row
from marketloom.functions.ml import fit_cached
from marketloom.functions.ordered import quantiles, running_totals


def log_elasticity(sales: DataFrame, min_rows: int = 10, min_kept: int = 5, default: float = -1.0) -> DataFrame:
    """Slope of ln(quantity) on ln(price) per product after a 5/95 % price trim.

    ``sales`` holds ``product_id``, ``price`` and ``quantity``.
    """
    logs = sales.select("product_id", F.ln("price").alias("lp"), F.ln(F.when(F.col("quantity") == 0, 1).otherwise(F.col("quantity"))).alias("lq"))
    sizes = sales.groupBy("product_id").agg(n_rows().alias("n"))
    edges = quantiles(logs, "lp", {"lo": 0.05, "hi": 0.95}, keys=["product_id"])
    kept = logs.join(edges, "product_id").filter((F.col("lp") > F.col("lo")) & (F.col("lp") < F.col("hi")))
    fit = kept.groupBy("product_id").agg(F.regr_slope("lq", "lp").alias("slope"), n_rows().alias("m"))
    usable = (F.col("n") >= min_rows) & (F.col("m") >= min_kept)
    return sizes.join(fit, "product_id", "left").select(
        "product_id", F.col("n").alias("n_sales"), F.when(usable, or_zero("slope")).otherwise(F.lit(default)).alias("elasticity"))


def search_price(df: DataFrame, objective: str = "profit", points: int = 100) -> DataFrame:
    """Best price on a grid under constant elasticity.

    ``df`` holds ``current_price``, ``cost_price``, ``elasticity`` and ``demand``.
    The grid is an array inside the row: no rows are multiplied, nothing is shuffled.
    The lowest of equally good prices wins.
    """
    low, high = F.col("cost_price") * 1.1, F.col("current_price") * 2.0

    def demand(p: Column) -> Column:
        return F.col("demand") * F.pow(p / F.col("current_price"), F.col("elasticity"))

    goals: dict[str, Callable[[Column], Column]] = {
        "profit": lambda p: (p - F.col("cost_price")) * demand(p), "revenue": lambda p: p * demand(p), "demand": demand}
    goal = goals[objective]
    at = lambda i: low + i * ((high - low) / (points - 1))
    best = F.array_max(F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: F.struct(goal(at(i)).alias("v"), (-i).alias("i"))))
    out = df.withColumn("_best", best).withColumn("optimal_price", at(-F.col("_best.i")))
    p, c = F.col("optimal_price"), F.col("current_price")
    gain = lambda new, old: F.when(old > 0, (new - old) / old * 100).otherwise(0.0)
    return out.select(
        *df.columns, "optimal_price", ((p - c) / c * 100).alias("price_change_pct"), demand(p).alias("optimal_demand"),
        goals["revenue"](p).alias("optimal_revenue"), goals["profit"](p).alias("optimal_profit"),
        gain(goals["revenue"](p), goals["revenue"](c)).alias("revenue_improvement_pct"),
        gain(goals["profit"](p), goals["profit"](c)).alias("profit_improvement_pct"), F.lit(objective).alias("objective"),
    )


def batch_prices(products: DataFrame, sales: DataFrame, objective: str = "profit") -> DataFrame:
    """Elasticity and best price for every product; unknown elasticity becomes -1.5."""
    demand = sales.groupBy("product_id").agg(F.avg("quantity").alias("demand"))
    e = log_elasticity(sales).select("product_id", F.when(F.col("elasticity") == -1.0, -1.5).otherwise(F.col("elasticity")).alias("elasticity"))
    base = products.select(
        "product_id", F.col("selling_price").cast("double").alias("current_price"), F.col("cost_price").cast("double").alias("cost_price")
    ).join(e, "product_id", "left").join(demand, "product_id", "left")
    base = base.withColumn("elasticity", F.coalesce("elasticity", F.lit(-1.5))).withColumn("demand", F.coalesce("demand", F.lit(10.0)))
    return search_price(base, objective)


def price_recommendations(df: DataFrame, threshold: int = 10) -> DataFrame:
    """Stock, competitor and elasticity rules combined into one action.

    ``df`` holds ``current_price``, ``competitor_avg_price``, ``elasticity`` and ``inventory_level``.
    """
    stock, price, rival = F.col("inventory_level"), F.col("current_price"), F.col("competitor_avg_price")
    e = F.abs("elasticity")
    out = df.select(
        "*", F.when(stock < threshold, "low").when(stock > threshold * 10, "high").otherwise("normal").alias("inventory_status"),
        F.when(price > rival * 1.2, "premium").when(price < rival * 0.8, "discounted").otherwise("competitive").alias("competitor_position"),
        F.when(e > 2, "high").when(e > 1, "medium").otherwise("low").alias("elasticity_sensitivity"),
    )
    actions = F.concat_ws(
        ", ", F.when(F.col("inventory_status") == "low", "increase_price").when(F.col("inventory_status") == "high", "decrease_price"),
        F.when(F.col("competitor_position") == "premium", "monitor_competitors").when(F.col("competitor_position") == "discounted", "consider_increase"),
    )
    return out.withColumn("recommended_action", F.when(actions == "", "maintain_current_price").otherwise(actions))


def train_demand_model(sales: DataFrame, features: Sequence[str], label: str = "quantity", key: str = "order_id"):
    """Boosted-tree demand model on an 80/20 hash split; returns (model, metrics)."""
    data = VectorAssembler(inputCols=list(features), outputCol="features").transform(sales.withColumn("label", F.col(label).cast("double")))
    held = F.pmod(F.xxhash64(key), F.lit(10)) >= 8
    train, test = data.filter(~held), data.filter(held)
    model = fit_cached(GBTRegressor(maxIter=20, maxDepth=4, seed=42), train.select("features", "label"))
    rows = []
    for split, part in (("train", train), ("test", test)):
        scored = model.transform(part)
        rows.append((split, *[float(RegressionEvaluator(metricName=m).evaluate(scored)) for m in ("mae", "rmse")]))
    return model, sales.sparkSession.createDataFrame(rows, "split string, mae double, rmse double")


def predict_demand(model, df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Predicted demand, never below zero."""
    scored = model.transform(VectorAssembler(inputCols=list(features), outputCol="features").transform(df))
    return scored.withColumn("predicted_demand", F.greatest(F.col("prediction"), F.lit(0.0))).drop("features", "prediction")


# --- elasticity as the correlation of logarithms -----------------------------


def _positive(df: DataFrame, price: str, quantity: str) -> DataFrame:
    return df.filter((F.col(price) > 0) & (F.col(quantity) > 0)).select("*", F.ln(price).alias("_lp"), F.ln(quantity).alias("_lq"))


def correlation_elasticity(df: DataFrame, price: str, quantity: str, by: Sequence[str] = ()) -> DataFrame:
    out = _positive(df, price, quantity).groupBy(*by).agg(correlation("_lp", "_lq").alias("elasticity"), n_rows().alias("n"))
    return out.withColumn("interpretation", F.when(F.abs("elasticity") > 1, "Elastic").otherwise("Inelastic"))


def elasticity_by_quintile(df: DataFrame, price: str, quantity: str, min_rows: int = 10) -> DataFrame:
    """Correlation elasticity overall and within price quintiles of more than ``min_rows`` rows."""
    clean = _positive(df, price, quantity)
    edges = quantiles(clean, price, {f"e{i}": i / 5 for i in range(1, 5)})
    tagged = with_one_row(clean, edges, "_e")
    p = F.col(price)
    bucket = F.when(p <= F.col("_e.e1"), "Q1").when(p <= F.col("_e.e2"), "Q2").when(p <= F.col("_e.e3"), "Q3").when(p <= F.col("_e.e4"), "Q4").otherwise("Q5")
    per = tagged.groupBy(bucket.alias("price_quantile")).agg(correlation("_lp", "_lq").alias("elasticity"), n_rows().alias("n")).filter(F.col("n") > min_rows)
    whole = clean.agg(correlation("_lp", "_lq").alias("elasticity"), n_rows().alias("n")).select(F.lit("overall").alias("price_quantile"), "elasticity", "n")
    return whole.unionByName(per).withColumn("interpretation", F.when(F.abs("elasticity") > 1, "Elastic").otherwise("Inelastic"))


def segment_sensitivity(df: DataFrame, price: str, quantity: str, segment: str, min_rows: int = 100) -> DataFrame:
    sizes = df.groupBy(segment).agg(n_rows().alias("_all")).filter(F.col("_all") >= min_rows)
    return correlation_elasticity(df, price, quantity, [segment]).join(sizes, segment, "left_semi")


def price_experiment(df: DataFrame, price: str, quantity: str, group: str) -> DataFrame:
    """Control against treatment: mean changes, arc elasticity, pooled t-test."""
    q, p = F.col(quantity).cast("double"), F.col(price).cast("double")
    c, t = F.col(group) == "control", F.col(group) == "treatment"
    agg = df.agg(
        F.avg(F.when(c, q)).alias("control_quantity"), F.avg(F.when(t, q)).alias("treatment_quantity"),
        F.avg(F.when(c, p)).alias("_cp"), F.avg(F.when(t, p)).alias("_tp"),
        F.count(F.when(c, q)).alias("_nc"), F.count(F.when(t, q)).alias("_nt"),
        F.var_samp(F.when(c, q)).alias("_vc"), F.var_samp(F.when(t, q)).alias("_vt"),
    )
    dof = F.col("_nc") + F.col("_nt") - 2
    pooled = ((F.col("_nc") - 1) * F.col("_vc") + (F.col("_nt") - 1) * F.col("_vt")) / dof
    t_stat = (F.col("control_quantity") - F.col("treatment_quantity")) / F.sqrt(pooled * (1 / F.col("_nc") + 1 / F.col("_nt")))
    dq = (F.col("treatment_quantity") - F.col("control_quantity")) / F.col("control_quantity") * 100
    dp = (F.col("_tp") - F.col("_cp")) / F.col("_cp") * 100
    out = agg.select(
        "control_quantity", "treatment_quantity", dq.alias("quantity_change_pct"), dp.alias("price_change_pct"),
        or_zero(F.try_divide(dq, dp)).alias("experimental_elasticity"), t_stat.alias("t_statistic"), dof.alias("degrees_of_freedom"),
    ).withColumn("p_value", t_two_sided("t_statistic", "degrees_of_freedom"))
    return out.withColumn("significant", F.col("p_value") < 0.05)


def _price_stats(df: DataFrame, price: str, quantity: str, cost: str | None = None) -> DataFrame:
    e = _positive(df, price, quantity).agg(correlation("_lp", "_lq")).scalar()
    cols = [F.avg(price).alias("current_price"), F.avg(quantity).alias("current_quantity")]
    if cost:
        cols.append(F.avg(F.col(cost).cast("double")).alias("current_cost"))
    return df.agg(*cols).withColumn("elasticity", e)


def counterfactual_demand(df: DataFrame, price: str, quantity: str, change: float = 0.1) -> DataFrame:
    """Linear response of demand and revenue to a relative price change."""
    s = _price_stats(df, price, quantity)
    new_price = F.col("current_price") * (1 + change)
    dq = F.col("elasticity") * change
    new_quantity = F.col("current_quantity") * (1 + dq)
    delta = new_price * new_quantity - F.col("current_price") * F.col("current_quantity")
    return s.select(
        "current_price", "current_quantity", (F.col("current_price") * F.col("current_quantity")).alias("current_revenue"),
        new_price.alias("counterfactual_price"), new_quantity.alias("counterfactual_quantity"), (new_price * new_quantity).alias("counterfactual_revenue"),
        delta.alias("revenue_change"), F.lit(change * 100).alias("price_change_pct"), (dq * 100).alias("quantity_change_pct"),
        F.when(delta > 0, "Increase price").otherwise("Decrease price").alias("recommendation"),
    )


def markup_price(df: DataFrame, price: str, quantity: str, cost: str, bounds: tuple[float, float] = (0.5, 2.0)) -> DataFrame:
    """Markup rule from the elasticity, kept within bounds around the current price."""
    s = _price_stats(df, price, quantity, cost)
    e, p, k, q = F.abs("elasticity"), F.col("current_price"), F.col("current_cost"), F.col("current_quantity")
    raw = F.when(e > 1, k * (e / (e + 1))).otherwise(p * bounds[1])
    s = s.withColumn("optimal_price", F.greatest(p * bounds[0], F.least(raw, p * bounds[1])))
    new_q = q * (1 + F.col("elasticity") * (F.col("optimal_price") - p) / p)
    now, new = (p - k) * q, (F.col("optimal_price") - k) * new_q
    return s.select(
        "current_price", "optimal_price", now.alias("current_profit"), new.alias("optimal_profit"), (new - now).alias("profit_increase"),
        F.when(now > 0, (new - now) / now * 100).otherwise(0.0).alias("profit_increase_pct"), "elasticity",
    )


def experiment_design(products: DataFrame, change: Mapping[int, float] | float, sample_size: int) -> DataFrame:
    """Design rows: each product in a control and a treatment group of equal size."""
    if isinstance(change, Mapping):
        pct = F.coalesce(*[F.when(F.col("product_id") == k, F.lit(float(v))) for k, v in change.items()], F.lit(0.0))
    else:
        pct = F.lit(float(change))
    groups = F.explode(F.array(F.struct(F.lit("control").alias("g"), F.lit(0.0).alias("c")), F.struct(F.lit("treatment").alias("g"), pct.alias("c"))))
    return products.select("product_id", groups.alias("x"), F.lit(sample_size).alias("_n")).select(
        "product_id", F.col("x.g").alias("arm"), F.col("x.c").alias("price_change_pct"), F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("i")
    ).select("product_id", "arm", "price_change_pct", F.concat_ws("_", F.col("product_id").cast("string"), "arm", F.col("i").cast("string")).alias("customer_id"))


# --- prescriptive ------------------------------------------------------------


def allocate_stock_budget(products: DataFrame, budget: float) -> DataFrame:
    """Most profitable stock within a budget: fill by profit per unit of cost.

    With a single budget row the linear program is a fractional knapsack, so the
    running cost in ratio order gives the exact optimum.  ``products`` holds
    ``product_id``, ``cost_price``, ``selling_price`` and ``demand``.
    """
    base = products.select(
        "product_id", F.col("cost_price").cast("double").alias("cost_price"), F.col("selling_price").cast("double").alias("selling_price"),
        F.col("demand").cast("double").alias("demand"),
    ).withColumn("_profit", F.col("selling_price") - F.col("cost_price"))
    base = base.withColumn("_cost", F.when(F.col("_profit") > 0, F.col("cost_price") * F.col("demand")).otherwise(0.0)).withColumn(
        "_ratio", F.try_divide(F.col("_profit"), F.col("cost_price")))
    run = running_totals(base, [F.col("_ratio").desc_nulls_first(), F.col("product_id")], sums={"_cum": "_cost"}, rank=None)
    room = F.greatest(F.lit(0.0), F.least(F.col("_cost"), F.lit(float(budget)) - (F.col("_cum") - F.col("_cost"))))
    quantity = F.when(F.col("_profit") <= 0, 0.0).otherwise(F.coalesce(F.try_divide(room, F.col("cost_price")), F.col("demand")))
    return run.select("product_id", "demand", quantity.alias("optimal_quantity"), room.alias("cost"), (quantity * F.col("_profit")).alias("profit"))


def best_multiplier(products: DataFrame, demand: Callable[[Column], Column], bounds: tuple[float, float] = (0.5, 2.0), points: int = 151) -> DataFrame:
    """Price multiplier with the highest profit per product on a grid inside the bounds."""
    p, k = F.col("selling_price").cast("double"), F.col("cost_price").cast("double")
    at = lambda i: F.lit(bounds[0]) + i * ((bounds[1] - bounds[0]) / (points - 1))
    profit = lambda price: (price - k) * demand(price)
    best = F.array_max(F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: F.struct(profit(p * at(i)).alias("v"), (-i).alias("i"))))
    out = products.withColumn("_b", best).withColumn("optimal_multiplier", at(-F.col("_b.i")))
    return out.select(
        "product_id", p.alias("current_price"), "optimal_multiplier", (p * F.col("optimal_multiplier")).alias("optimal_price"),
        profit(p).alias("current_profit"), F.col("_b.v").alias("optimal_profit"),
    )


def action_plan(df: DataFrame, item: str, current: str, optimal: str, action_type: str, threshold: float = 0.1) -> DataFrame:
    """Changes above the threshold, high or medium priority."""
    high = 0.2 if action_type == "price_change" else 0.5
    change = F.try_divide(F.col(optimal) - F.col(current), F.col(current))
    out = df.select(F.lit(action_type).alias("action_type"), F.col(item).alias("item_id"), F.col(current).alias("current_value"),
                    F.col(optimal).alias("optimal_value"), (or_zero(change) * 100).alias("change_pct"))
    return out.filter(F.abs("change_pct") > threshold * 100).withColumn("priority", F.when(F.abs("change_pct") > high * 100, "high").otherwise("medium"))


# --- what-if -----------------------------------------------------------------


def pricing_scenarios(df: DataFrame, changes: Sequence[float], elasticity: float) -> DataFrame:
    """Demand, revenue and profit of each product for each relative price change.

    ``df`` holds ``product_id``, ``current_price``, ``current_demand`` and ``cost``.
    """
    rows = df.select("*", F.explode(F.array(*[F.lit(float(c)) for c in changes])).alias("change"))
    price, demand = F.col("current_price"), F.col("current_demand")
    new_price, new_demand = price * (1 + F.col("change")), demand * (1 - elasticity * F.col("change"))
    revenue, new_revenue = price * demand, new_price * new_demand
    profit, new_profit = (price - F.col("cost")) * demand, (new_price - F.col("cost")) * new_demand
    pct = lambda a, b: F.when(b > 0, (a - b) / b * 100).otherwise(0.0)
    return rows.select(
        "product_id", (F.col("change") * 100).alias("price_change_pct"), new_price.alias("new_price"), new_demand.alias("new_demand"),
        (new_revenue - revenue).alias("revenue_change"), pct(new_revenue, revenue).alias("revenue_change_pct"),
        (new_profit - profit).alias("profit_change"), pct(new_profit, profit).alias("profit_change_pct"),
    )


def retention_scenario(totals: DataFrame, current_rate: float, new_rate: float, months: int = 12) -> DataFrame:
    """Customers and revenue per month under two retention rates.

    ``totals`` is one row per group with ``customers`` and ``revenue_per_customer``.
    """
    grid = totals.select("*", F.explode(F.sequence(F.lit(1), F.lit(months))).alias("month"))
    now = F.col("customers") * F.pow(F.lit(current_rate), F.col("month"))
    new = F.col("customers") * F.pow(F.lit(new_rate), F.col("month"))
    keys = [c for c in totals.columns if c not in ("customers", "revenue_per_customer")]
    agg = grid.groupBy(*keys).agg(
        F.sum(now * F.col("revenue_per_customer")).alias("total_current_revenue"), F.sum(new * F.col("revenue_per_customer")).alias("total_new_revenue"),
        F.min(now).alias("final_customers_current"), F.min(new).alias("final_customers_new"),
    )
    lift = F.col("total_new_revenue") - F.col("total_current_revenue")
    return agg.select(
        "*", lift.alias("revenue_lift"), F.when(F.col("total_current_revenue") > 0, lift / F.col("total_current_revenue") * 100).otherwise(0.0).alias("revenue_lift_pct"),
        (F.col("final_customers_new") - F.col("final_customers_current")).alias("customer_retention_lift"),
    )


def inventory_scenarios(df: DataFrame, service_levels: Sequence[float], lead_days: int = 7, ordering_cost: float = 50.0, holding_pct: float = 0.25) -> DataFrame:
    """Safety stock, reorder point, EOQ and stock-out probability for each service level.

    ``df`` holds ``product_id``, ``current_stock``, ``daily_demand`` and ``demand_std``.
    """
    levels = F.array(*[F.struct(F.lit(s).alias("s"), F.lit(z_value(s)).alias("z")) for s in service_levels])
    rows = df.select("*", F.explode(levels).alias("x"))
    sd = F.col("demand_std") * F.sqrt(F.lit(float(lead_days)))
    d = F.col("daily_demand")
    gap = F.try_divide(F.col("current_stock") - d * lead_days, sd)
    out = rows.select(
        "product_id", F.col("x.s").alias("service_level"), "current_stock", (F.col("x.z") * sd).alias("safety_stock"),
        (d * lead_days + F.col("x.z") * sd).alias("reorder_point"), F.sqrt(2 * ordering_cost * d * 365 / (holding_pct * d)).alias("eoq"), gap.alias("_gap"),
    )
    return out.withColumn("stockout_probability", F.when(F.col("current_stock") > 0, 1 - normal_cdf("_gap")).otherwise(1.0)).drop("_gap")


def marketing_scenarios(totals: DataFrame, spends: Sequence[float], acquisition_per_1000: float, ltv: float) -> DataFrame:
    """New customers, revenue, return and growth for each spend level.

    ``totals`` holds ``customers`` and ``revenue`` per group.
    """
    rows = totals.select("*", F.explode(F.array(*[F.lit(float(s)) for s in spends])).alias("marketing_spend"))
    new = F.col("marketing_spend") / 1000 * acquisition_per_1000
    pct = lambda a, b: F.when(F.col(b) > 0, a / F.col(b) * 100).otherwise(0.0)
    return rows.select(
        *[c for c in totals.columns if c not in ("customers", "revenue")], "marketing_spend", new.alias("expected_new_customers"),
        (new * ltv).alias("expected_new_revenue"), or_zero(F.try_divide(new * ltv - F.col("marketing_spend"), F.col("marketing_spend"))).alias("roi"),
        (F.col("customers") + new).alias("total_customers"), pct(new, "customers").alias("customer_growth_pct"),
        (F.col("revenue") + new * ltv).alias("total_revenue"), pct(new * ltv, "revenue").alias("revenue_growth_pct"),
    )


def compare_scenarios(df: DataFrame, name: str, metric: str) -> DataFrame:
    """Scenario totals of a metric, best first."""
    return df.groupBy(F.col(name).alias("scenario_name")).agg(F.sum(metric).alias(metric)).orderBy(F.col(metric).desc())
