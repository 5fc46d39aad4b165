"""Statistics and experiments from aggregates; p-values are added to the result rows."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.functions.dist import chi2_upper, f_upper, normal_cdf, normal_two_sided, t_two_sided, z_value
from marketloom.functions.exprs import correlation, n_rows, or_zero, with_one_row
from marketloom.functions.ordered import dominance, quantiles, running_totals
from marketloom.functions.shared import materialize
from marketloom.operators.quality import unpivot_numbers


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count, centre, spread, quartiles and population shape per numeric column."""
    long = unpivot_numbers(df, columns).filter(F.col("value").isNotNull())
    v = F.col("value")
    agg = long.groupBy("feature").agg(
        n_rows().alias("count"), F.avg(v).alias("mean"), F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias("std"), F.coalesce(F.var_samp(v), F.lit(0.0)).alias("var"),
        F.min(v).alias("min"), F.max(v).alias("max"), F.skewness(v).alias("skewness"), F.kurtosis(v).alias("kurtosis"))
    out = agg.join(quantiles(long, "value", {"q25": 0.25, "median": 0.5, "q75": 0.75}, keys=["feature"]), "feature")
    return out.withColumn("iqr", F.col("q75") - F.col("q25")).withColumn("cv_pct", F.try_divide(F.col("std"), F.col("mean")) * 100)


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson correlations in long form; all pairs come from one aggregation."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    agg = df.agg(*[correlation(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"{a}|{b}") for a, b in pairs])
    both = [(a, b, f"{a}|{b}") for a, b in pairs] + [(b, a, f"{a}|{b}") for a, b in pairs if a != b]
    return agg.select(F.explode(F.array(*[
        F.struct(F.lit(a).alias("feature_a"), F.lit(b).alias("feature_b"), F.col(f"`{k}`").alias("correlation")) for a, b, k in both])).alias("r")).select("r.*")


def average_ranks(df: DataFrame, value: str, out: str = "rank") -> DataFrame:
    """Each distinct value with its mean rank and number of rows."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(value).agg(n_rows().alias("_w"))
    run = running_totals(counts, [F.col(value)], sums={"_hi": "_w"}, rank=None)
    return run.select(value, (F.col("_hi") - (F.col("_w") - 1) / 2).alias(out), F.col("_w").alias(f"{out}_ties"))


def spearman_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rank correlations: values are replaced by mean ranks, then correlated."""
    ranked = df.select(*columns)
    for i, c in enumerate(columns):
        ranks = average_ranks(df, c, f"_r{i}").select(c, f"_r{i}")
        ranked = ranked.join(ranks, c)
    out = correlation_matrix(ranked, [f"_r{i}" for i in range(len(columns))])
    name = F.create_map(*[x for i, c in enumerate(columns) for x in (F.lit(f"_r{i}"), F.lit(c))])
    return out.select(name[F.col("feature_a")].alias("feature_a"), name[F.col("feature_b")].alias("feature_b"), "correlation")


def kendall_tau(df: DataFrame, a: str, b: str) -> DataFrame:
    """Tau-b of two columns of any kind of number: discordant pairs are counted exactly, the others follow from ties."""
    rows = df.select(F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y")).filter("x IS NOT NULL AND y IS NOT NULL")
    cells = materialize(rows.groupBy("x", "y").agg(n_rows().alias("n")))
    discordant, _ = dominance(cells, "x", "y", "n", "n")

    def tied(*by: str) -> int:
        """Pairs of rows that agree in the columns."""
        n = cells.groupBy(*by).agg(F.sum("n").cast("decimal(38,0)").alias("n"))
        return int(n.agg(F.coalesce(F.sum((F.col("n") * (F.col("n") - 1)).cast("decimal(38,0)")), F.lit(0))).first()[0]) // 2

    pairs, in_x, in_y = tied(), tied("x"), tied("y")
    concordant = pairs - discordant - in_x - in_y + tied("x", "y")
    scale = math.sqrt((pairs - in_x) * (pairs - in_y))
    tau = (concordant - discordant) / scale if scale else None
    return df.sparkSession.createDataFrame([(a, b, float(concordant), float(discordant), tau)], "feature_a string, feature_b string, con double, dis double, tau double")


def normality_columns(n: Column, skew: Column, kurt: Column) -> tuple[Column, Column]:
    """Transformed skewness and kurtosis (D'Agostino and Pearson) of a sample."""
    n = n.cast("double")
    y = skew * F.sqrt((n + 1) * (n + 3) / (6 * (n - 2)))
    beta2 = 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w2 = F.sqrt(2 * (beta2 - 1)) - 1
    a = y / F.sqrt(2 / (w2 - 1))
    z_skew = F.ln(a + F.sqrt(a * a + 1)) / F.sqrt(0.5 * F.ln(w2))
    x = (kurt + 3 - 3 * (n - 1) / (n + 1)) / F.sqrt(24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5)))
    b1 = 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * F.sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    big = 6 + 8 / b1 * (2 / b1 + F.sqrt(1 + 4 / (b1 * b1)))
    denominator = 1 + x * F.sqrt(2 / (big - 4))
    cube = F.signum(denominator) * F.pow((1 - 2 / big) / F.abs(denominator), F.lit(1 / 3))
    return z_skew, (1 - 2 / (9 * big) - cube) / F.sqrt(2 / (9 * big))


def normality(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Omnibus normality test per column; two degrees of freedom give p = exp(-k2/2)."""
    long = unpivot_numbers(df, columns)
    agg = long.groupBy("feature").agg(F.count("value").alias("n"), F.skewness("value").alias("s"), F.kurtosis("value").alias("k")).filter(F.col("n") >= 8)
    zs, zk = normality_columns(F.col("n"), F.col("s"), F.col("k"))
    out = agg.select("feature", "n", (zs * zs + zk * zk).alias("statistic"))
    return out.withColumn("p_value", F.exp(-F.col("statistic") / 2)).withColumn("is_normal", F.col("p_value") > 0.05)


def ks_normal(df: DataFrame, value: str) -> DataFrame:
    """Distance of the sample from a normal with its own mean and deviation."""
    v = df.select(F.col(value).cast("double").alias("v")).filter(F.col("v").isNotNull())
    counts = v.groupBy("v").agg(n_rows().alias("w"))
    run = running_totals(counts, [F.col("v")], sums={"hi": "w"}, totals={"n": "w"}, rank=None)
    run = with_one_row(run, v.agg(F.avg("v").alias("m"), F.stddev_samp("v").alias("s")), "st")
    run = run.withColumn("cdf", normal_cdf((F.col("v") - F.col("st.m")) / F.col("st.s")))
    d = F.greatest(F.col("hi") / F.col("n") - F.col("cdf"), F.col("cdf") - (F.col("hi") - F.col("w")) / F.col("n"))
    return run.agg(F.lit(value).alias("feature"), F.max("n").alias("n"), F.max(d).alias("ks_statistic"))


# --- group differences -------------------------------------------------------


def group_moments(df: DataFrame, value: str, group: str) -> DataFrame:
    v = F.col(value).cast("double")
    return df.filter(F.col(value).isNotNull() & F.col(group).isNotNull()).groupBy(F.col(group).alias("g")).agg(n_rows().alias("n"), F.avg(v).alias("m"), F.var_samp(v).alias("v"))


def welch_t(df: DataFrame, value: str, group: str, a: object, b: object) -> DataFrame:
    """Two-sample t-test without equal variances."""
    s = group_moments(df, value, group)
    pick = lambda c, g: F.max(F.when(F.col("g") == g, F.col(c)))
    r = s.agg(*[pick(c, g).alias(f"{c}{i}") for i, g in ((1, a), (2, b)) for c in ("n", "m", "v")])
    e1, e2 = F.col("v1") / F.col("n1"), F.col("v2") / F.col("n2")
    t = (F.col("m1") - F.col("m2")) / F.sqrt(e1 + e2)
    dof = (e1 + e2) * (e1 + e2) / (e1 * e1 / (F.col("n1") - 1) + e2 * e2 / (F.col("n2") - 1))
    out = r.select(F.lit("t_test").alias("test"), t.alias("statistic"), dof.alias("dof"))
    return out.withColumn("p_value", t_two_sided("statistic", "dof"))


def anova(df: DataFrame, value: str, group: str) -> DataFrame:
    """One-way analysis of variance from group moments."""
    s = group_moments(df, value, group)
    r = s.agg(n_rows().alias("k"), F.sum("n").alias("nn"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("mm"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("q"),
              F.sum((F.col("n") - 1) * or_zero("v")).alias("within"))
    between = F.col("q") - F.col("nn") * F.col("mm") * F.col("mm")
    f = (between / (F.col("k") - 1)) / (F.col("within") / (F.col("nn") - F.col("k")))
    out = r.select(F.lit("anova").alias("test"), f.alias("statistic"), (F.col("k") - 1).alias("dof1"), (F.col("nn") - F.col("k")).alias("dof2"))
    return out.withColumn("p_value", f_upper("statistic", "dof1", "dof2"))


def _rank_sums(df: DataFrame, value: str, group: str) -> tuple[DataFrame, DataFrame]:
    """Rank sum and size per group, and the tie term of all values."""
    data = df.filter(F.col(value).isNotNull() & F.col(group).isNotNull()).select(F.col(value).alias("v"), F.col(group).alias("g"))
    ranks = average_ranks(data, "v", "rank")
    cells = data.groupBy("v", "g").agg(n_rows().alias("n")).join(ranks, "v")
    sums = cells.groupBy("g").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("rank")).alias("r"))
    t = F.col("rank_ties").cast("double")
    return sums, ranks.agg(F.sum(t * t * t - t).alias("tie"), F.sum(t).alias("nn"))


def kruskal(df: DataFrame, value: str, group: str) -> DataFrame:
    """Rank test of several groups with tie correction."""
    sums, ties = _rank_sums(df, value, group)
    r = sums.agg(F.sum(F.col("r") * F.col("r") / F.col("n")).alias("q"), n_rows().alias("k")).withColumn("t", ties.select(F.struct("*")).scalar())
    nn = F.col("t.nn")
    h = (12.0 / (nn * (nn + 1)) * F.col("q") - 3 * (nn + 1)) / (1 - F.col("t.tie") / (nn * nn * nn - nn))
    out = r.select(F.lit("kruskal").alias("test"), h.alias("statistic"), (F.col("k") - 1).alias("dof"))
    return out.withColumn("p_value", chi2_upper("statistic", "dof"))


def mann_whitney(df: DataFrame, value: str, group: str, a: object, b: object) -> DataFrame:
    """Two-sided rank test by the tie- and continuity-corrected normal form."""
    sums, ties = _rank_sums(df.filter(F.col(group).isin(a, b)), value, group)
    pick = lambda c, g: F.max(F.when(F.col("g") == g, F.col(c))).cast("double")
    r = sums.agg(pick("n", a).alias("n1"), pick("n", b).alias("n2"), pick("r", a).alias("r1")).withColumn("t", ties.select(F.struct("*")).scalar())
    u = F.col("r1") - F.col("n1") * (F.col("n1") + 1) / 2
    mean, nn = F.col("n1") * F.col("n2") / 2, F.col("n1") + F.col("n2")
    sd = F.sqrt(F.col("n1") * F.col("n2") / 12 * (nn + 1 - F.col("t.tie") / (nn * (nn - 1))))
    out = r.select(F.lit("mannwhitneyu").alias("test"), u.alias("statistic"), ((F.abs(u - mean) - 0.5) / sd).alias("z"))
    return out.withColumn("p_value", F.least(F.lit(1.0), normal_two_sided("z")))


def chi_square(df: DataFrame, a: str, b: str) -> DataFrame:
    """Independence of two categorical columns; continuity correction for one degree of freedom."""
    cells = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(n_rows().alias("n"))
    rows = cells.groupBy("a").agg(F.sum("n").alias("ra"))
    cols = cells.groupBy("b").agg(F.sum("n").alias("cb"))
    total = cells.agg(F.sum("n")).scalar()
    dof = (rows.agg(n_rows()).scalar() - 1) * (cols.agg(n_rows()).scalar() - 1)
    inverse = lambda d, c: d.agg(F.sum(1 / F.col(c))).scalar()
    seen = cells.join(rows, "a").join(cols, "b").withColumn("nn", total)
    e = F.col("ra") * F.col("cb") / F.col("nn")
    # unseen cells add nothing to sum(n^2 / e) - N; in a 2 x 2 table all gaps are equal
    agg = seen.agg(F.sum(F.col("n") * F.col("n") / e).alias("s"), F.max(F.abs(F.col("n") - e)).alias("gap"), F.max("nn").alias("n"))
    agg = agg.withColumn("dof", dof).withColumn("_inv", inverse(rows, "ra") * inverse(cols, "cb") * F.col("n"))
    gap = F.greatest(F.lit(0.0), F.col("gap") - 0.5)
    out = agg.select(F.when(F.col("dof") == 1, gap * gap * F.col("_inv")).otherwise(F.col("s") - F.col("n")).alias("chi2"), "dof", "n")
    return out.withColumn("p_value", chi2_upper("chi2", "dof")).withColumn("significant", F.col("p_value") < 0.05)


# --- experiments -------------------------------------------------------------


def assign_variants(customers: DataFrame, variants: Sequence[str], strata: Sequence[str] = (), salt: str = "experiment") -> DataFrame:
    """Equal chunks of a hashed order within each stratum; the last chunk takes the remainder.

    The order depends only on the customer and the salt, so it can be repeated.
    """
    base = customers.select("customer_id", *strata, F.md5(F.concat(F.lit(salt + ":"), F.col("customer_id").cast("string"))).alias("_h"))
    ranked = running_totals(base, [F.col("_h"), F.col("customer_id")], keys=list(strata), rank="_r", count="_n")
    size = F.greatest(F.floor(F.col("_n") / len(variants)), F.lit(1))
    chunk = F.least(F.floor((F.col("_r") - 1) / size), F.lit(len(variants) - 1))
    return ranked.select("customer_id", *strata, F.element_at(F.array(*[F.lit(v) for v in variants]), (chunk + 1).cast("int")).alias("variant"))


def variant_stats(df: DataFrame, metric: str, binary: bool = False) -> DataFrame:
    """Size and centre of the metric per variant."""
    v = F.col(metric).cast("double")
    if binary:
        return df.groupBy("variant").agg(n_rows().alias("n_samples"), F.avg(v).alias("conversion_rate"), F.sum(v).cast("long").alias("n_conversions"))
    agg = df.groupBy("variant").agg(n_rows().alias("n_samples"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"))
    return agg.join(quantiles(df, metric, {"median": 0.5}, keys=["variant"]), "variant")


def two_variant_t(df: DataFrame, metric: str, control: str, treatment: str, alpha: float = 0.05) -> DataFrame:
    """Pooled t-test, lift and standardised effect of a continuous metric."""
    s = group_moments(df, metric, "variant")
    pick = lambda c, g: F.max(F.when(F.col("g") == g, F.col(c)))
    r = s.agg(*[pick(c, g).alias(f"{c}{i}") for i, g in ((1, control), (2, treatment)) for c in ("n", "m", "v")])
    dof = F.col("n1") + F.col("n2") - 2
    pooled = ((F.col("n1") - 1) * F.col("v1") + (F.col("n2") - 1) * F.col("v2")) / dof
    t = (F.col("m1") - F.col("m2")) / F.sqrt(pooled * (1 / F.col("n1") + 1 / F.col("n2")))
    effect = (F.col("m2") - F.col("m1")) / F.sqrt((F.col("v1") + F.col("v2")) / 2)
    out = r.select(t.alias("t_statistic"), dof.alias("dof"), effect.alias("effect_size"), ((F.col("m2") - F.col("m1")) / F.col("m1")).alias("relative_lift"))
    return out.withColumn("p_value", t_two_sided("t_statistic", "dof")).withColumn("is_significant", F.col("p_value") < alpha)


def two_variant_z(df: DataFrame, metric: str, control: str, treatment: str, alpha: float = 0.05) -> DataFrame:
    """z-test of two proportions with lifts and normal confidence intervals."""
    s = variant_stats(df, metric, binary=True)
    pick = lambda c, g: F.max(F.when(F.col("variant") == g, F.col(c)))
    r = s.agg(*[pick(c, g).alias(f"{k}{i}") for i, g in ((1, control), (2, treatment)) for k, c in (("n", "n_samples"), ("x", "n_conversions"), ("p", "conversion_rate"))])
    pooled = (F.col("x1") + F.col("x2")) / (F.col("n1") + F.col("n2"))
    z = (F.col("p1") - F.col("p2")) / F.sqrt(pooled * (1 - pooled) * (1 / F.col("n1") + 1 / F.col("n2")))
    q = z_value(1 - alpha / 2)
    half = lambda i: q * F.sqrt(F.col(f"p{i}") * (1 - F.col(f"p{i}")) / F.col(f"n{i}"))
    lo = lambda i: F.greatest(F.lit(0.0), F.col(f"p{i}") - half(i))
    hi = lambda i: F.least(F.lit(1.0), F.col(f"p{i}") + half(i))
    out = r.select(
        z.alias("z_statistic"), (F.col("p2") - F.col("p1")).alias("absolute_lift"), or_zero(F.try_divide(F.col("p2") - F.col("p1"), F.col("p1"))).alias("relative_lift"),
        lo(1).alias("control_low"), hi(1).alias("control_high"), lo(2).alias("treatment_low"), hi(2).alias("treatment_high"))
    return out.withColumn("p_value", normal_two_sided("z_statistic")).withColumn("is_significant", F.col("p_value") < alpha)


def sample_size(df: DataFrame, baseline: str, effect: float, alpha: float = 0.05, power: float = 0.8) -> DataFrame:
    """Rows per group to detect a relative change of a conversion rate."""
    p1 = F.col(baseline)
    p2 = p1 * (1 + effect)
    pooled = (p1 + p2) / 2
    root = z_value(1 - alpha / 2) * F.sqrt(2 * pooled * (1 - pooled)) + z_value(power) * F.sqrt(p1 * (1 - p1) + p2 * (1 - p2))
    return df.withColumn("required_sample_size", F.ceil(root * root / ((p2 - p1) * (p2 - p1))))
