"""Causal estimates and their diagnostics."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.functions.dist import normal_two_sided, t_two_sided
from marketloom.functions.exprs import correlation, n_rows, or_zero, with_one_row
from marketloom.functions.ml import fit_cached
from marketloom.functions.ordered import quantiles, running_totals


def propensity_scores(df: DataFrame, treatment: str, features: Sequence[str]) -> DataFrame:
    """Probability of treatment by logistic regression on standardised features."""
    raw = VectorAssembler(inputCols=list(features), outputCol="_raw").transform(df.withColumn("label", F.col(treatment).cast("double")))
    scaled = StandardScaler(inputCol="_raw", outputCol="features", withMean=True).fit(raw).transform(raw)
    model = fit_cached(LogisticRegression(maxIter=100), scaled.select("features", "label"))
    scored = model.transform(scaled)
    return scored.withColumn("propensity_score", vector_to_array("probability")[1]).drop("_raw", "features", "label", "rawPrediction", "probability", "prediction")


def match_nearest(df: DataFrame, key: str, treatment: str, outcome: str, score: str = "propensity_score", ratio: int = 1, caliper: float | None = None) -> DataFrame:
    """Nearest controls by score, with replacement.

    In score order the nearest controls of a treated row are among the ``ratio``
    below and above it, so each row looks up a fixed number of control ranks:
    no pairs are formed beyond those.  Equal distances prefer the lower score.
    """
    base = df.select(F.col(key).alias("id"), F.col(treatment).cast("int").alias("t"), F.col(outcome).cast("double").alias("y"), F.col(score).alias("s"))
    ranked = running_totals(base.withColumn("is_control", 1 - F.col("t")), [F.col("s"), F.col("t"), F.col("id")], sums={"c": "is_control"}, totals={"n_control": "is_control"}, rank=None)
    control = ranked.filter("t = 0").select(F.col("c").alias("_rank"), F.col("id").alias("control_id"), F.col("y").alias("control_outcome"), F.col("s").alias("_cs"))
    treated = ranked.filter("t = 1").select("id", "y", "s", "c", "n_control")
    looked = treated.select("*", F.explode(F.sequence(F.col("c") - (ratio - 1), F.col("c") + ratio)).alias("_rank")).filter((F.col("_rank") >= 1) & (F.col("_rank") <= F.col("n_control")))
    pairs = looked.join(control, "_rank").withColumn("propensity_diff", F.abs(F.col("s") - F.col("_cs")))
    if caliper is not None:
        pairs = pairs.filter(F.col("propensity_diff") <= caliper)
    # at most 2 x ratio candidates per treated row
    above = (F.col("_rank") > F.col("c")).cast("int")
    order = F.struct(F.col("propensity_diff").alias("d"), above.alias("a"), F.when(above == 1, F.col("_rank")).otherwise(-F.col("_rank")).alias("r"), "control_id", "control_outcome")
    best = pairs.groupBy("id", "y").agg(F.slice(F.array_sort(F.collect_list(order)), 1, ratio).alias("m"))
    return best.select("id", "y", F.explode("m").alias("m")).select(
        F.col("id").alias("treated_id"), "m.control_id", F.col("y").alias("treated_outcome"), "m.control_outcome", F.col("m.d").alias("propensity_diff"), (F.col("y") - F.col("m.control_outcome")).alias("individual_effect"))


def matching_effect(pairs: DataFrame) -> DataFrame:
    """Average effect on the treated with its standard error and t-test."""
    e = F.col("individual_effect")
    out = pairs.agg(n_rows().alias("n_matches"), F.avg(e).alias("att"), F.stddev_samp(e).alias("_s"), F.avg("propensity_diff").alias("mean_propensity_diff"))
    se = F.col("_s") / F.sqrt(F.col("n_matches").cast("double"))
    out = out.select("n_matches", "att", se.alias("standard_error"), (F.col("att") / se).alias("t_statistic"), (F.col("n_matches") - 1).alias("_dof"), "mean_propensity_diff")
    return out.withColumn("p_value", t_two_sided("t_statistic", "_dof")).drop("_dof")


def _clipped_weights(df: DataFrame, treatment: str, score: str) -> DataFrame:
    w = F.when(F.col(treatment) == 1, 1 / F.col(score)).otherwise(1 / (1 - F.col(score)))
    weighted = df.withColumn("_w", w)
    edges = quantiles(weighted, "_w", {"lo": 0.01, "hi": 0.99})
    return with_one_row(weighted, edges, "_e").withColumn("weight", F.greatest(F.col("_e.lo"), F.least(F.col("_w"), F.col("_e.hi")))).drop("_w", "_e")


def _weighted_effect(t: Column, y: Column, w: Column) -> Column:
    mean = lambda v: F.try_divide(F.sum(F.when(t == v, w * y)), F.sum(F.when(t == v, w)))
    return mean(1) - mean(0)


def poisson_weight(key: str | Column, replicate: Column) -> Column:
    """Bootstrap multiplicity of a row: Poisson(1) from a hash of row and replicate."""
    u = F.pmod(F.xxhash64(F.col(key) if isinstance(key, str) else key, replicate), F.lit(1 << 30)) / float(1 << 30)
    # cumulative Poisson(1) probabilities
    edges = (0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940582, 0.99991676)
    return reduce(lambda acc, i: F.when(u < edges[i], i).otherwise(acc), range(len(edges) - 1, -1, -1), F.lit(len(edges)))


def _add_replicates(names: Sequence[str]):
    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            if b.num_rows:
                group = b.column(0).to_numpy(zero_copy_only=False)
                weights = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1).astype(float)
                values = np.column_stack([c.to_numpy(zero_copy_only=False) for c in b.columns[2:]])
                for g in np.unique(group).tolist():
                    own = group == g
                    held[g] = held.get(g, 0.0) + weights[own].T @ values[own]
        for g, sums in held.items():
            places = np.arange(1, len(sums) + 1)
            yield pa.record_batch([pa.array(np.full(len(sums), g), pa.int32()), pa.array(places, pa.int32()), *[pa.array(c.copy()) for c in sums.T]], ["group", "rep", *names])

    return add


def replicate_sums(df: DataFrame, group: str, values: Mapping[str, Column], key: str, replicates: int) -> DataFrame:
    """Poisson-weighted sums per group 0 or 1 and bootstrap replicate; null values count as zero.

    Each row is read once with its weights in all replicates, and a partition leaves one row per group and replicate.
    """
    weights = F.transform(F.sequence(F.lit(1), F.lit(replicates)), lambda r: poisson_weight(key, r).cast("tinyint"))
    rows = df.filter(F.col(group).isin(0, 1)).select(F.col(group).cast("int").alias("group"), weights.alias("_times"), *[or_zero(v.cast("double")).alias(n) for n, v in values.items()])
    schema = "group int, rep int, " + ", ".join(f"{n} double" for n in values)
    return rows.mapInArrow(_add_replicates(list(values)), schema).groupBy("group", "rep").agg(*[F.sum(n).alias(n) for n in values])


def inverse_probability_weighting(df: DataFrame, key: str, treatment: str, outcome: str, score: str = "propensity_score", replicates: int = 100) -> DataFrame:
    """Weighted effect with clipped weights and a Poisson bootstrap standard error.

    Rows are read once for all replicates (``replicate_sums``).
    """
    data = _clipped_weights(df.select(key, treatment, outcome, score), treatment, score)
    t, y, w = F.col(treatment), F.col(outcome).cast("double"), F.col("weight")
    sums = replicate_sums(data, treatment, {"wy": w * y, "w": w}, key, replicates)
    mean = lambda v: F.try_divide(F.max(F.when(F.col("group") == v, F.col("wy"))), F.max(F.when(F.col("group") == v, F.col("w"))))
    boot = sums.groupBy("rep").agg((mean(1) - mean(0)).alias("e"))
    out = data.agg(
        F.count_if(t == 1).alias("n_treated"), F.count_if(t == 0).alias("n_control"), _weighted_effect(t, y, w).alias("ate"), F.avg(w).alias("mean_weight"), F.max(w).alias("max_weight"))
    out = out.withColumn("standard_error", boot.agg(F.stddev_pop("e")).scalar())
    out = out.withColumn("t_statistic", F.col("ate") / F.col("standard_error")).withColumn("_dof", F.col("n_treated") + F.col("n_control") - 1)
    return out.withColumn("p_value", t_two_sided("t_statistic", "_dof")).drop("_dof")


def difference_in_differences(df: DataFrame, treatment: str, outcome: str, time: str, start: str) -> DataFrame:
    """Two-by-two means, the estimate, and its least-squares error from cell moments."""
    y = F.col(outcome).cast("double")
    post = (F.col(time) > F.lit(start).cast("date")).cast("int")
    cells = df.groupBy(F.col(treatment).cast("int").alias("t"), post.alias("p")).agg(n_rows().alias("n"), F.avg(y).alias("m"), F.var_samp(y).alias("v"))
    pick = lambda t, p: F.max(F.when((F.col("t") == t) & (F.col("p") == p), F.col("m")))
    r = cells.agg(
        pick(1, 0).alias("pre_treatment_mean"), pick(0, 0).alias("pre_control_mean"), pick(1, 1).alias("post_treatment_mean"), pick(0, 1).alias("post_control_mean"),
        F.sum("n").alias("_n"), F.sum((F.col("n") - 1) * F.col("v")).alias("_sse"), F.sum(1 / F.col("n")).alias("_inv"))
    did = F.col("post_treatment_mean") - F.col("pre_treatment_mean") - F.col("post_control_mean") + F.col("pre_control_mean")
    se = F.sqrt(F.col("_sse") / (F.col("_n") - 4) * F.col("_inv"))
    out = r.select(
        "pre_treatment_mean", "pre_control_mean", "post_treatment_mean", "post_control_mean", (F.col("post_treatment_mean") - F.col("pre_treatment_mean")).alias("treatment_diff"),
        (F.col("post_control_mean") - F.col("pre_control_mean")).alias("control_diff"), did.alias("did_estimator"), se.alias("did_se"), (did / se).alias("t_statistic"), (F.col("_n") - 4).alias("_dof"))
    return out.withColumn("did_p_value", t_two_sided("t_statistic", "_dof")).drop("_dof")


def compare_methods(**results: DataFrame) -> DataFrame:
    """Effect, error and p-value of several estimators side by side."""
    parts = []
    for method, df in results.items():
        effect = next(c for c in ("att", "ate", "did_estimator") if c in df.columns)
        error = "did_se" if "did_se" in df.columns else "standard_error"
        p = "did_p_value" if "did_p_value" in df.columns else "p_value"
        parts.append(df.select(F.lit(method).alias("method"), F.col(effect).alias("effect"), F.col(error).alias("standard_error"), F.col(p).alias("p_value")))
    return reduce(lambda a, b: a.unionByName(b), parts)


def parallel_trends(df: DataFrame, key: str, treatment: str, outcome: str, time: str, replicates: int = 200) -> DataFrame:
    """Pre-period slopes per group, their difference and a bootstrap interval."""
    x, y = F.col(time).cast("double"), F.col(outcome).cast("double")
    data = df.select(F.col(key).alias("k"), F.col(treatment).cast("int").alias("t"), x.alias("x"), y.alias("y")).filter(F.col("x").isNotNull() & F.col("y").isNotNull())
    centre = data.agg(F.avg("x")).scalar()
    data = data.withColumn("x", F.col("x") - centre)
    slope = lambda t: F.regr_slope(F.when(F.col("t") == t, F.col("y")), F.when(F.col("t") == t, F.col("x")))
    x, y = F.col("x"), F.col("y")
    sums = replicate_sums(data, "t", {"s": F.lit(1.0), "sx": x, "sy": y, "sxy": x * y, "sxx": x * x}, "k", replicates)
    b = F.try_divide(F.col("s") * F.col("sxy") - F.col("sx") * F.col("sy"), F.col("s") * F.col("sxx") - F.col("sx") * F.col("sx"))
    diffs = sums.groupBy("rep").agg((F.max(F.when(F.col("group") == 1, b)) - F.max(F.when(F.col("group") == 0, b))).alias("d"))
    ci = diffs.agg(F.struct(F.percentile("d", 0.025).alias("lo"), F.percentile("d", 0.975).alias("hi"))).scalar()
    out = data.agg(slope(1).alias("treated_trend"), slope(0).alias("control_trend")).withColumn("ci", ci)
    holds = (F.col("ci.lo") <= 0) & (F.col("ci.hi") >= 0)
    return out.select("treated_trend", "control_trend", (F.col("treated_trend") - F.col("control_trend")).alias("trend_difference"), F.col("ci.lo").alias("ci_95_lower"), F.col("ci.hi").alias("ci_95_upper"), holds.alias("parallel_trends_holds"))


def _pearson_p(r: str, n: str) -> Column:
    t = F.col(r) * F.sqrt(F.try_divide(F.col(n) - 2, 1 - F.col(r) * F.col(r)))
    return t_two_sided(t, F.col(n) - 2)


def validate_instrument(df: DataFrame, instrument: str, treatment: str, outcome: str) -> DataFrame:
    """Relevance, first-stage strength and exclusion correlation of an instrument."""
    z, t, y = (F.col(c).cast("double") for c in (instrument, treatment, outcome))
    out = df.agg(correlation(z, t).alias("relevance_correlation"), F.regr_r2(t, z).alias("first_stage_r_squared"), correlation(z, y).alias("exclusion_correlation"), F.regr_count(t, z).alias("n"))
    r2 = F.col("first_stage_r_squared")
    out = out.withColumn("first_stage_f_statistic", F.try_divide(r2, 1 - r2) * (F.col("n") - 2)).withColumn("instrument_strong", F.col("first_stage_f_statistic") > 10)
    return out.withColumn("relevance_p_value", _pearson_p("relevance_correlation", "n")).withColumn("exclusion_p_value", _pearson_p("exclusion_correlation", "n"))


def confounders(df: DataFrame, treatment: str, outcome: str, candidates: Sequence[str], limit: float = 0.1) -> DataFrame:
    """Candidates correlated with both treatment and outcome; one aggregation for all."""
    t, y = F.col(treatment).cast("double"), F.col(outcome).cast("double")
    agg = df.agg(*[x for c in candidates for x in (correlation(F.col(c).cast("double"), t).alias(f"t_{c}"), correlation(F.col(c).cast("double"), y).alias(f"y_{c}"))])
    rows = agg.select(F.explode(F.array(*[F.struct(F.lit(c).alias("confounder"), F.col(f"t_{c}").alias("correlation_with_treatment"), F.col(f"y_{c}").alias("correlation_with_outcome")) for c in candidates])).alias("r")).select("r.*")
    return rows.withColumn("is_confounder", (F.abs("correlation_with_treatment") > limit) & (F.abs("correlation_with_outcome") > limit))


def propensity_diagnostics(df: DataFrame, treatment: str, score: str = "propensity_score") -> DataFrame:
    """Overlap, standardised mean difference and common support of two score samples."""
    t, s = F.col(treatment), F.col(score)
    pick = lambda v: F.when(t == v, s)
    first = df.agg(
        F.min(pick(1)).alias("min1"), F.max(pick(1)).alias("max1"), F.min(pick(0)).alias("min0"), F.max(pick(0)).alias("max0"),
        F.avg(pick(1)).alias("m1"), F.avg(pick(0)).alias("m0"), F.var_pop(pick(1)).alias("v1"), F.var_pop(pick(0)).alias("v0"))
    out = with_one_row(df.select(treatment, score), first, "f")
    low, high = F.greatest("f.min1", "f.min0"), F.least("f.max1", "f.max0")
    share = lambda v, cond: F.avg(F.when(t == v, cond.cast("double")))
    inside = s.between(low, high)
    agg = out.agg(F.first("f").alias("f"), share(0, s >= F.col("f.min1")).alias("propensity_overlap"), share(1, inside).alias("i1"), share(0, inside).alias("i0"))
    pooled = F.sqrt((F.col("f.v1") + F.col("f.v0")) / 2)
    smd = or_zero(F.try_divide(F.col("f.m1") - F.col("f.m0"), pooled))
    support = F.when(high > low, (F.col("i1") + F.col("i0")) / 2).otherwise(0.0)
    return agg.select("propensity_overlap", smd.alias("standardized_mean_difference"), support.alias("histogram_overlap"), ((F.abs(smd) < 0.1) & (F.col("propensity_overlap") > 0.8)).alias("good_balance"))


def sensitivity_grid(effect: DataFrame, column: str, low: float = -0.9, high: float = 0.9, points: int = 100) -> DataFrame:
    """Bounds of an effect under hidden bias exp(rho) on a grid of rho."""
    grid = effect.select(F.col(column).alias("effect"), F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i"))
    rho = F.lit(low) + F.col("i") * ((high - low) / (points - 1))
    out = grid.select("i", "effect", rho.alias("rho"), F.exp(rho).alias("gamma"))
    out = out.withColumn("lower_bound", F.col("effect") / F.col("gamma")).withColumn("upper_bound", F.col("effect") * F.col("gamma"))
    return out.withColumn("effect_explained", (F.col("lower_bound") <= 0) & (F.col("upper_bound") >= 0))


# --- uplift ------------------------------------------------------------------


def uplift_data(treated: DataFrame, orders: DataFrame, days: int = 30) -> DataFrame:
    """Orders and revenue of each customer in the days after its campaign date.

    ``treated`` holds ``customer_id``, ``treatment`` and ``campaign_date``.
    """
    after = orders.select("customer_id", "order_date", "order_total").join(treated.select("customer_id", "campaign_date"), "customer_id").filter(
        (F.col("order_date") > F.col("campaign_date")) & (F.col("order_date") <= F.date_add("campaign_date", days)))
    agg = after.groupBy("customer_id").agg(n_rows().alias("n"), F.sum("order_total").alias("v"))
    return treated.join(agg, "customer_id", "left").select(*treated.columns, (or_zero("n") > 0).cast("int").alias("outcome"), or_zero("v").cast("double").alias("outcome_value"))


def true_uplift(df: DataFrame, treatment: str = "treatment", outcome: str = "outcome", by: str | None = None) -> DataFrame:
    """Difference in means with standard error and z-test, overall or per group."""
    y = F.col(outcome).cast("double")
    pick = lambda v: F.when(F.col(treatment) == v, y)
    key = F.col(by).cast("string") if by else F.lit("overall")
    agg = df.groupBy(key.alias("group_name")).agg(
        F.avg(pick(1)).alias("m1"), F.avg(pick(0)).alias("m0"), F.var_samp(pick(1)).alias("v1"), F.var_samp(pick(0)).alias("v0"), F.count(pick(1)).alias("n_treated"), F.count(pick(0)).alias("n_control"))
    agg = agg.filter((F.col("n_treated") > 0) & (F.col("n_control") > 0))
    se = F.sqrt(F.col("v1") / F.col("n_treated") + F.col("v0") / F.col("n_control"))
    out = agg.select("group_name", (F.col("m1") - F.col("m0")).alias("true_uplift"), se.alias("standard_error"), or_zero(F.try_divide(F.col("m1") - F.col("m0"), se)).alias("t_statistic"), "n_treated", "n_control")
    return out.withColumn("p_value", normal_two_sided("t_statistic"))


def uplift_segments(df: DataFrame, uplift: str, labels: Sequence[str] = ("Lost Causes", "Persuadables", "Sure Things", "Sleeping Dogs")) -> DataFrame:
    """Quantile groups of predicted uplift with their labels."""
    k = len(labels)
    edges = quantiles(df, uplift, {f"e{i}": i / k for i in range(1, k)})
    out = with_one_row(df, edges, "_e")
    segment = reduce(lambda acc, i: acc + (F.col(uplift) >= F.col(f"_e.e{i}")).cast("int"), range(1, k), F.lit(0))
    out = out.withColumn("uplift_segment", segment)
    return out.withColumn("segment_label", F.element_at(F.array(*[F.lit(x) for x in labels]), F.col("uplift_segment") + 1)).drop("_e")


def _ranked(df: DataFrame, uplift: str, key: str, treatment: str, outcome: str, by: Sequence[str]) -> DataFrame:
    base = df.select(
        *by, F.col(key).alias("_k"), F.col(uplift).alias("_u"), F.col(treatment).cast("long").alias("t1"), (1 - F.col(treatment).cast("long")).alias("t0"),
        (F.col(outcome) * F.col(treatment)).alias("y1"), (F.col(outcome) * (1 - F.col(treatment))).alias("y0"))
    return running_totals(base, [F.col("_u").desc(), F.col("_k")], keys=list(by), rank="_r", count="_n",
                          sums={"c1": "t1", "c0": "t0", "s1": "y1", "s0": "y0"}, totals={"a1": "t1", "a0": "t0", "b1": "y1", "b0": "y0"})


def targeting_metrics(df: DataFrame, uplift: str, key: str = "customer_id", treatment: str = "treatment", outcome: str = "outcome", shares: Sequence[int] = (10, 20, 30, 40, 50), target: int = 30) -> DataFrame:
    """Effect among the top 10..50 % by predicted uplift, and the gain over everyone."""
    ranked = _ranked(df, uplift, key, treatment, outcome, ())
    effect = lambda cond: F.try_divide(F.sum(F.when(cond, F.col("y1"))), F.sum(F.when(cond, F.col("t1")))) - F.try_divide(F.sum(F.when(cond, F.col("y0"))), F.sum(F.when(cond, F.col("t0"))))
    agg = ranked.agg(*[effect(F.col("_r") <= F.floor(F.col("_n") * p / 100)).alias(f"ate_at_{p}pct") for p in shares], effect(F.lit(True)).alias("overall_ate"))
    gain = F.col(f"ate_at_{target}pct")
    return agg.select("*", (gain - F.col("overall_ate")).alias("uplift_gain"), or_zero((F.try_divide(gain, F.col("overall_ate")) - 1) * 100).alias("uplift_gain_pct"))


def uplift_curves(df: DataFrame, uplift: str, key: str = "customer_id", treatment: str = "treatment", outcome: str = "outcome", by: Sequence[str] = ()) -> DataFrame:
    """Area under the running uplift and its sum over the overall uplift, per segment."""
    ranked = _ranked(df, uplift, key, treatment, outcome, by).filter((F.col("c1") > 0) & (F.col("c0") > 0))
    running = F.col("s1") / F.col("c1") - F.col("s0") / F.col("c0")
    overall = F.col("b1") / F.col("a1") - F.col("b0") / F.col("a0")
    return ranked.groupBy(*by).agg(F.avg(running).alias("auuc"), F.sum(running - overall).alias("qini_coefficient"), F.max("_n").alias("n_rows"))


def uplift_deciles(df: DataFrame, uplift: str, treatment: str = "treatment", outcome: str = "outcome", by: Sequence[str] = (), k: int = 10) -> DataFrame:
    """Predicted and actual uplift per decile of the prediction."""
    edges = quantiles(df, uplift, {f"e{i}": i / k for i in range(1, k)}, keys=by)
    tagged = df.join(edges, list(by)) if by else with_one_row(df, edges, "_e").select("*", "_e.*").drop("_e")
    decile = reduce(lambda acc, i: acc + (F.col(uplift) > F.col(f"e{i}")).cast("int"), range(1, k), F.lit(0))
    y = F.col(outcome).cast("double")
    pick = lambda v: F.when(F.col(treatment) == v, y)
    agg = tagged.groupBy(*by, decile.alias("decile")).agg(F.avg(uplift).alias("predicted_uplift"), (F.avg(pick(1)) - F.avg(pick(0))).alias("actual_uplift"))
    return agg.filter(F.col("actual_uplift").isNotNull())


def evaluate_uplift(df: DataFrame, uplift: str, key: str = "customer_id", treatment: str = "treatment", outcome: str = "outcome", by: Sequence[str] = (), min_rows: int = 100) -> DataFrame:
    """Decile correlation and calibration with the curve areas, overall or per large segment."""
    if by:
        sizes = df.groupBy(*by).agg(n_rows().alias("_n")).filter(F.col("_n") >= min_rows)
        df = df.join(sizes.select(*by), list(by), "left_semi")
    per = uplift_deciles(df, uplift, treatment, outcome, by).groupBy(*by).agg(
        or_zero(correlation("predicted_uplift", "actual_uplift")).alias("uplift_correlation"), F.avg(F.abs(F.col("predicted_uplift") - F.col("actual_uplift"))).alias("calibration_error"), n_rows().alias("n_deciles"))
    curves = uplift_curves(df, uplift, key, treatment, outcome, by)
    if by:
        return per.join(curves, list(by))
    return per.withColumn("c", curves.select(F.struct("*")).scalar()).select("uplift_correlation", "calibration_error", "n_deciles", "c.auuc", "c.qini_coefficient", "c.n_rows")


def _regressor(model_type: str, **columns: str):
    from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor

    if model_type == "linear":
        return LinearRegression(regParam=0.0, **columns)
    if model_type == "random_forest":
        return RandomForestRegressor(numTrees=20, maxDepth=6, seed=42, **columns)
    return GBTRegressor(maxIter=10, maxDepth=3, seed=42, **columns)


def t_learner(df: DataFrame, features: Sequence[str], model_type: str = "linear", treatment: str = "treatment", outcome: str = "outcome") -> DataFrame:
    """Uplift as the difference of two outcome models."""
    data = VectorAssembler(inputCols=list(features), outputCol="features").transform(df.withColumn("label", F.col(outcome).cast("double")))
    scored = data
    for side, name in ((1, "_mu1"), (0, "_mu0")):
        model = fit_cached(_regressor(model_type, predictionCol=name), data.filter(F.col(treatment) == side).select("features", "label"))
        scored = model.transform(scored)
    return scored.withColumn("predicted_uplift", F.col("_mu1") - F.col("_mu0")).drop("features", "label", "_mu1", "_mu0")


def x_learner(df: DataFrame, features: Sequence[str], model_type: str = "linear", treatment: str = "treatment", outcome: str = "outcome") -> DataFrame:
    """Cross-fitted effects blended by the propensity score."""
    scored = propensity_scores(df, treatment, features)
    data = VectorAssembler(inputCols=list(features), outputCol="features").transform(scored.withColumn("label", F.col(outcome).cast("double")))
    treated, control = data.filter(F.col(treatment) == 1), data.filter(F.col(treatment) == 0)
    mu1 = fit_cached(_regressor(model_type, predictionCol="_mu1"), treated.select("features", "label"))
    mu0 = fit_cached(_regressor(model_type, predictionCol="_mu0"), control.select("features", "label"))
    effect1 = mu0.transform(treated).select("features", (F.col("label") - F.col("_mu0")).alias("label"), (1 / F.col("propensity_score")).alias("w"))
    effect0 = mu1.transform(control).select("features", (F.col("_mu1") - F.col("label")).alias("label"), (1 / (1 - F.col("propensity_score"))).alias("w"))
    tau1 = fit_cached(_regressor(model_type, predictionCol="_t1", weightCol="w"), effect1)
    tau0 = fit_cached(_regressor(model_type, predictionCol="_t0", weightCol="w"), effect0)
    e = F.col("propensity_score")
    return tau0.transform(tau1.transform(data)).withColumn("predicted_uplift", e * F.col("_t0") + (1 - e) * F.col("_t1")).drop("features", "label", "_t0", "_t1")
