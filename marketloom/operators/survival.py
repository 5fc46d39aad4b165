"""Survival curves, hazards and the proportional hazards model.

Times are whole days, so every ordered step runs over one row per day and group.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marketloom.functions.exprs import days_between, n_rows, or_zero, with_lookup
from marketloom.functions.ordered import dominance, ntile_by, quantiles, running_totals
from marketloom.operators.quality import unpivot_numbers


def survival_data(orders: DataFrame, customers: DataFrame, as_of: dt.date, idle_days: int = 90) -> DataFrame:
    """Days from first to last order; the event is being idle for longer than ``idle_days``."""
    agg = orders.groupBy("customer_id").agg(
        F.min("order_date").alias("first_order"), F.max("order_date").alias("last_order"), n_rows().alias("total_orders"), F.sum("order_total").cast("double").alias("total_spend"))
    out = customers.join(agg, "customer_id", "left")
    event = (days_between(F.lit(as_of), "last_order") > idle_days) & (F.col("total_orders") >= 1)
    return out.select(
        *customers.columns, or_zero(days_between("last_order", "first_order")).alias("time"), F.coalesce(event, F.lit(False)).cast("int").alias("event"),
        or_zero("total_orders").alias("total_orders"), or_zero("total_spend").alias("total_spend"), or_zero(F.try_divide(F.col("total_spend"), F.col("total_orders"))).alias("avg_order_value"))


def survival_data_from_signup(customers: DataFrame, orders: DataFrame, as_of: dt.date, idle_days: int = 90) -> DataFrame:
    """Duration of at least one day; the event is a last order before the idle cutoff."""
    agg = orders.filter(F.col("order_date") <= F.lit(as_of)).groupBy("customer_id").agg(
        F.min("order_date").alias("f"), F.max("order_date").alias("l"), n_rows().alias("total_orders"))
    out = customers.join(agg, "customer_id", "left")
    first, last = F.coalesce("f", "signup_date"), F.coalesce("l", "signup_date")
    cutoff = F.lit(as_of - dt.timedelta(days=idle_days))
    return out.select(
        *customers.columns, (days_between(last, first) + 1).alias("duration"), ((last < cutoff) & (or_zero("total_orders") > 0)).cast("int").alias("event"), or_zero("total_orders").alias("total_orders"))


def kaplan_meier(df: DataFrame, time: str = "time", event: str = "event", by: Sequence[str] = ()) -> DataFrame:
    """Product-limit curve with numbers at risk, events and censored, per group."""
    counts = df.groupBy(*by, F.col(time).alias("time")).agg(F.sum(event).alias("n_events"), n_rows().alias("_n"))
    w = W.partitionBy(*(by or [F.lit(0)])).orderBy("time")
    at_risk = F.sum("_n").over(w.rowsBetween(0, W.unboundedFollowing))
    out = counts.withColumn("at_risk", at_risk).withColumn("n_censored", F.col("_n") - F.col("n_events"))
    step = 1 - F.col("n_events") / F.col("at_risk")
    curve = F.product(step).over(w.rowsBetween(W.unboundedPreceding, 0))
    return out.select(*by, "time", "at_risk", "n_events", "n_censored", curve.alias("survival_prob"))


def hazard_ratios(df: DataFrame, covariates: Sequence[str]) -> DataFrame:
    """Event-rate ratio above against below the median of each covariate."""
    long = unpivot_numbers(df, covariates, ["time", "event"]).filter(F.col("value").isNotNull())
    med = quantiles(long, "value", {"median": 0.5}, keys=["feature"])
    high = F.col("value") >= F.col("_m.median")
    agg = with_lookup(long, med, "feature", "_m").groupBy("feature").agg(
        F.sum(F.when(high, F.col("event"))).alias("e1"), F.sum(F.when(high, F.col("time"))).alias("t1"), F.sum(F.when(~high, F.col("event"))).alias("e0"), F.sum(F.when(~high, F.col("time"))).alias("t0"))
    rate = lambda i: F.try_divide(or_zero(f"e{i}").cast("double"), or_zero(f"t{i}").cast("double"))
    return agg.select("feature", F.coalesce(F.try_divide(rate(1), rate(0)), F.lit(1.0)).alias("hazard_ratio"))


def survival_at(curve: DataFrame, horizon: int, by: Sequence[str] = ()) -> DataFrame:
    """Survival at a horizon by linear interpolation; flat beyond the ends."""
    w = W.partitionBy(*(by or [F.lit(0)])).orderBy("time")
    seg = curve.select(*by, "time", "survival_prob", F.lead("time").over(w).alias("t2"), F.lead("survival_prob").over(w).alias("s2"))
    inside = (F.col("time") <= horizon) & (F.col("t2") > horizon)
    value = F.col("survival_prob") + (F.col("s2") - F.col("survival_prob")) * (F.lit(horizon) - F.col("time")) / (F.col("t2") - F.col("time"))
    agg = seg.groupBy(*by).agg(
        F.max(F.when(inside, value)).alias("_v"), F.min_by("survival_prob", "time").alias("_first"), F.min("time").alias("_t0"), F.max_by("survival_prob", "time").alias("_last"))
    out = F.coalesce("_v", F.when(F.lit(horizon) < F.col("_t0"), F.col("_first")).otherwise(F.col("_last")))
    return agg.select(*by, F.lit(horizon).alias("time_horizon_days"), out.alias("survival_probability"), (1 - out).alias("churn_probability"))


def expected_lifetime(curve: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Area under the curve by trapezoids, in days and months."""
    w = W.partitionBy(*(by or [F.lit(0)])).orderBy("time")
    seg = curve.select(*by, (F.lead("time").over(w) - F.col("time")).alias("dt"), (F.col("survival_prob") + F.lead("survival_prob").over(w)).alias("s"))
    days = or_zero(F.sum(F.col("dt") * F.col("s") / 2))
    return seg.groupBy(*by).agg(days.alias("estimated_lifetime_days"), (days / 30).alias("estimated_lifetime_months"))


def step_survival(curve: DataFrame, points: Sequence[int], by: Sequence[str] = ()) -> DataFrame:
    """Curve value at each time point (the last step at or before it, 1 before the first)."""
    agg = curve.groupBy(*by).agg(*[
        F.coalesce(F.max_by(F.when(F.col("time") <= p, F.col("survival_prob")), F.when(F.col("time") <= p, F.col("time"))), F.lit(1.0)).alias(f"p{p}") for p in points])
    return agg.select(*by, F.explode(F.array(*[F.struct(F.lit(p).alias("time_point"), F.col(f"p{p}").alias("survival_prob")) for p in points])).alias("r")).select(*by, "r.*")


def risk_groups(df: DataFrame, curve: DataFrame, by: str, horizon: int = 90) -> DataFrame:
    """Quartile risk groups of customers by their segment's survival at the horizon."""
    labels = ("High Risk", "Medium-High Risk", "Medium-Low Risk", "Low Risk")
    at = survival_at(curve, horizon, [by]).select(by, "survival_probability")
    scored = df.select("customer_id", by).join(at, by)
    tiled = ntile_by(scored, "_q", 4, [F.col("survival_probability"), F.col("customer_id")])
    return tiled.select("customer_id", by, "survival_probability", F.element_at(F.array(*[F.lit(x) for x in labels]), F.col("_q")).alias("survival_segment"))


def _cox_sums(df: DataFrame, x: Sequence[Column], beta: np.ndarray) -> list:
    """Risk sums per day: one aggregation, at most one row per day of follow-up."""
    k = len(x)
    eta = sum((x[i] * float(beta[i]) for i in range(1, k)), x[0] * float(beta[0]))
    r = F.exp(eta)
    d = F.col("event").cast("double")
    cols = [F.sum(r).alias("s0"), F.sum(r * d).alias("e0"), F.sum(d).alias("d"), F.sum(eta * d).alias("ll")]
    for i in range(k):
        cols += [F.sum(x[i] * r).alias(f"s{i + 1}"), F.sum(x[i] * r * d).alias(f"e{i + 1}"), F.sum(x[i] * d).alias(f"x{i}")]
        for j in range(i, k):
            cols += [F.sum(x[i] * x[j] * r).alias(f"s{i}_{j}"), F.sum(x[i] * x[j] * r * d).alias(f"e{i}_{j}")]
    return df.groupBy("duration").agg(*cols).orderBy(F.col("duration").desc()).collect()


def tie_sums(at_risk: float, tied: float, d: int) -> np.ndarray:
    """Sums over f = 0, 1/d, .. (d-1)/d of 1/a, f/a, 1/a^2, f/a^2 and (f/a)^2 for a = at_risk - f * tied.

    Many ties are summed in closed form: with u = at_risk * d / tied the sums of 1/(u - l) and its
    square over l are differences of the digamma and trigamma functions; the 64 terms next to the
    possible pole are added one by one, which leaves arguments large enough for their expansions.
    """
    if d <= 4096:
        frac = np.arange(d) / d
        inverse = 1 / (at_risk - frac * tied)
        return np.array([inverse.sum(), (frac * inverse).sum(), (inverse**2).sum(), (frac * inverse**2).sum(), (frac**2 * inverse**2).sum()])
    r = tied / at_risk
    if r < 1e-6:
        # two terms of 1 / (1 - f r) are exact to a double where it matters
        f1, f2 = (d - 1) / 2, (d - 1) * (2 * d - 1) / (6 * d)
        return np.array([(d + r * f1) / at_risk, (f1 + r * f2) / at_risk, (d + 2 * r * f1) / at_risk**2, (f1 + 2 * r * f2) / at_risk**2, f2 / at_risk**2])
    c, u, n = tied / d, at_risk * d / tied, d - 64
    last = u - np.arange(n, d)
    x, y = u + 1, u + 1 - n
    one = -np.log1p(-n / x) + n / (2 * x * y) + (y**-2 - x**-2) / 12 - (y**-4 - x**-4) / 120 + (y**-6 - x**-6) / 252 + (1 / last).sum()
    two = n / (x * y) + (y**-2 - x**-2) / 2 + (y**-3 - x**-3) / 6 - (y**-5 - x**-5) / 30 + (y**-7 - x**-7) / 42 + (last**-2.0).sum()
    return np.array([one / c, (u * one - d) / (c * d), two / c**2, (u * two - one) / (c**2 * d), (u**2 * two - 2 * u * one + d) / (c * d) ** 2])


def fit_cox(df: DataFrame, covariates: Sequence[str], iterations: int = 50) -> DataFrame:
    """Proportional hazards coefficients by Newton steps with Efron's handling of ties.

    Each step aggregates the data to one row per day; the driver holds only those
    daily sums.  Covariates are standardised for the fit and scaled back.
    """
    k = len(covariates)
    stats = df.agg(*[f(F.col(c).cast("double")).alias(f"{n}{i}") for i, c in enumerate(covariates) for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    means = np.array([stats[f"m{i}"] for i in range(k)])
    sds = np.array([stats[f"s{i}"] or 1.0 for i in range(k)])
    x = [(F.col(c).cast("double") - float(means[i])) / float(sds[i]) for i, c in enumerate(covariates)]
    data = df.select("duration", "event", *[c.alias(f"z{i}") for i, c in enumerate(x)]).persist()
    z = [F.col(f"z{i}") for i in range(k)]
    beta = np.zeros(k)
    information = np.eye(k)
    for _ in range(iterations):
        s0, s1, s2 = 0.0, np.zeros(k), np.zeros((k, k))
        gradient, information = np.zeros(k), np.zeros((k, k))
        for row in _cox_sums(data, z, beta):
            s0 += row["s0"]
            s1 += np.array([row[f"s{i + 1}"] for i in range(k)])
            pairs = np.array([[row[f"s{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
            s2 += pairs
            d = int(row["d"])
            if d == 0:
                continue
            e1 = np.array([row[f"e{i + 1}"] for i in range(k)])
            e2 = np.array([[row[f"e{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
            gradient += np.array([row[f"x{i}"] for i in range(k)])
            t = tie_sums(s0, row["e0"], d)
            gradient -= s1 * t[0] - e1 * t[1]
            cross = np.outer(s1, e1)
            information += s2 * t[0] - e2 * t[1] - (np.outer(s1, s1) * t[2] - (cross + cross.T) * t[3] + np.outer(e1, e1) * t[4])
        step = np.linalg.solve(information, gradient)
        beta = beta + step
        if np.max(np.abs(step)) < 1e-9:
            break
    else:
        raise RuntimeError(f"no convergence after {iterations} steps")
    data.unpersist()
    se = np.sqrt(np.diag(np.linalg.inv(information)))
    rows = [(c, float(beta[i] / sds[i]), float(np.exp(beta[i] / sds[i])), float(se[i] / sds[i]), float(means[i])) for i, c in enumerate(covariates)]
    return df.sparkSession.createDataFrame(rows, "covariate string, coefficient double, hazard_ratio double, standard_error double, mean double")


def relative_hazard(df: DataFrame, coefficients: Mapping[str, tuple[float, float]]) -> DataFrame:
    """exp((x - mean) . beta) for every row; ``coefficients`` maps covariate to (beta, mean)."""
    terms = [(F.col(c).cast("double") - mean) * beta for c, (beta, mean) in coefficients.items()]
    return df.withColumn("relative_hazard", F.exp(sum(terms[1:], terms[0])))


def concordance(df: DataFrame, risk: str) -> DataFrame:
    """Share of comparable pairs ordered by the risk score; pairs of equal scores count half.

    An event is compared with every row that lasts longer, or as long without an event.  Counts are exact.
    """
    # one axis for both: rows without an event come after events of the same duration
    rows = df.select(F.col(risk).cast("double").alias("risk"), (F.col("duration").cast("bigint") * 2 + 1 - F.col("event")).alias("end"), F.col("event").cast("bigint").alias("event"), F.lit(1).alias("one")).filter(F.col("risk").isNotNull() & F.col("end").isNotNull())
    concordant, tied = dominance(rows, "risk", "end", "event", "one")
    ends = rows.groupBy("end").agg(n_rows().alias("n"), F.sum("event").alias("d"))
    after = running_totals(ends, [F.col("end").desc()], sums={"upto": "n"}, rank=None)
    later = F.col("d") * (F.col("upto") - F.col("n"))
    total = int(after.agg(F.coalesce(F.sum(later.cast("decimal(38,0)")), F.lit(0))).first()[0])
    value = (concordant + 0.5 * tied) / total if total else 0.5
    return df.sparkSession.createDataFrame([(value, float(total))], "concordance double, comparable_pairs double")
