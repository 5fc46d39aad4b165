"""Statistics, experiments, causal, uplift and survival queries."""

from statistics import NormalDist

from pyspark.sql import functions as F

from marketloom.functions.exprs import with_lookup
from marketloom.operators import causal, stats, survival
from marketloom.plans.registry import query
from marketloom.sources.commerce import AS_OF

_N = ("quantity", "unit_price", "discount_pct", "line_total")
_LONG = " UNION ALL ".join(f"SELECT '{f}' AS feature, CAST({f} AS DOUBLE) AS value FROM itm" for f in _N)
_DESC = f"""WITH l AS ({_LONG}), m AS (SELECT feature, AVG(value) mu, STDDEV_POP(value) sp FROM l GROUP BY 1),
d AS (SELECT feature, COUNT(*) AS "count", AVG(value) AS mean, STDDEV_SAMP(value) AS std, VAR_SAMP(value) AS var, MIN(value) AS "min", MAX(value) AS "max", AVG(pow((value - mu) / sp, 3)) AS skewness, AVG(pow((value - mu) / sp, 4)) - 3 AS kurtosis,
  quantile_cont(value, 0.25) AS q25, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q75 FROM l JOIN m USING (feature) GROUP BY 1)
"""
query("t1_describe", "feature:s count:i mean:d4 std:d4 var:d2 min:d2 max:d2 skewness:d4 kurtosis:d4 q25:d4 median:d4 q75:d4 iqr:d4 cv_pct:d4", _DESC + "SELECT *, q75 - q25 AS iqr, std / mean * 100 AS cv_pct FROM d")(
    lambda c: stats.describe(c.order_items, _N))
query("t2_pearson", "feature_a:s feature_b:s correlation:d6",
      " UNION ALL ".join(f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, CORR(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)) AS correlation FROM itm" for a in _N for b in _N))(lambda c: stats.correlation_matrix(c.order_items, _N))
_S = ("quantity", "unit_price", "discount_pct")
query("t2_spearman", "feature_a:s feature_b:s correlation:d6",
      "WITH r AS (SELECT " + ", ".join(f"RANK() OVER (ORDER BY {x}) + (COUNT(*) OVER (PARTITION BY {x}) - 1) / 2 AS {x}" for x in _S) + " FROM itm) " + " UNION ALL ".join(f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, CORR({a}, {b}) AS correlation FROM r" for a in _S for b in _S))(
    lambda c: stats.spearman_matrix(c.order_items, _S))
query("t2_kendall", "feature_a:s feature_b:s con:d0 dis:d0 tau:d6",
      """WITH k AS (SELECT quantity x, discount_pct y, COUNT(*) n FROM itm GROUP BY 1, 2), p AS (SELECT SUM(a.n * b.n) FILTER (b.y < a.y) con, SUM(a.n * b.n) FILTER (b.y > a.y) dis FROM k a JOIN k b ON b.x < a.x),
t AS (SELECT (SELECT SUM(n * (n - 1) / 2) FROM (SELECT SUM(n) n FROM k GROUP BY x)) t1, (SELECT SUM(n * (n - 1) / 2) FROM (SELECT SUM(n) n FROM k GROUP BY y)) t2, (SELECT SUM(n) FROM k) n)
SELECT 'quantity' AS feature_a, 'discount_pct' AS feature_b, con, dis, (con - dis) / sqrt((n * (n - 1) / 2 - t1) * (n * (n - 1) / 2 - t2)) AS tau FROM p, t""")(lambda c: stats.kendall_tau(c.order_items, "quantity", "discount_pct"))
query("t2_kendall_order_totals", "feature_a:s feature_b:s con:d0 dis:d0 tau:d6",
      """WITH k AS (SELECT CAST(SUM(order_total) AS DOUBLE) x, CAST(MAX(order_total) AS DOUBLE) y FROM ord GROUP BY customer_id), p AS (SELECT COUNT(*) FILTER (b.y < a.y) con, COUNT(*) FILTER (b.y > a.y) dis FROM k a JOIN k b ON b.x < a.x),
t AS (SELECT (SELECT SUM(n * (n - 1) / 2) FROM (SELECT COUNT(*) n FROM k GROUP BY x)) t1, (SELECT SUM(n * (n - 1) / 2) FROM (SELECT COUNT(*) n FROM k GROUP BY y)) t2, (SELECT COUNT(*) FROM k) n)
SELECT 'total' AS feature_a, 'largest' AS feature_b, con, dis, (con - dis) / sqrt((n * (n - 1) / 2 - t1) * (n * (n - 1) / 2 - t2)) AS tau FROM p, t""")(
    lambda c: stats.kendall_tau(c.orders.groupBy("customer_id").agg(F.sum("order_total").alias("total"), F.max("order_total").alias("largest")), "total", "largest"))
query("t3_normality", "feature:s n:i statistic:d2 p_value:d6 is_normal:b")(lambda c: stats.normality(c.order_items, _N))
query("t3_ks_normal", "feature:s n:i ks_statistic:d6")(lambda c: stats.ks_normal(c.orders, "order_total"))


def _by_segment(c):
    return c.orders.join(c.customers_base.select("customer_id", "customer_segment"), "customer_id")


_SEGO = "SELECT o.*, customer_segment FROM ord o JOIN cust USING (customer_id)"
query("t4_welch_t", "test:s statistic:d4 dof:d2",
      f"WITH g AS (SELECT customer_segment g, COUNT(*) n, AVG(CAST(order_total AS DOUBLE)) m, VAR_SAMP(CAST(order_total AS DOUBLE)) v FROM ({_SEGO}) GROUP BY 1) "
      "SELECT 't_test' AS test, (a.m - b.m) / sqrt(a.v / a.n + b.v / b.n) AS statistic, pow(a.v / a.n + b.v / b.n, 2) / (pow(a.v / a.n, 2) / (a.n - 1) + pow(b.v / b.n, 2) / (b.n - 1)) AS dof FROM g a, g b WHERE a.g = 'FURNITURE' AND b.g = 'MACHINERY'")(
    lambda c: stats.welch_t(_by_segment(c), "order_total", "customer_segment", "FURNITURE", "MACHINERY"))
query("t4_anova", "test:s statistic:d4 dof1:i dof2:i",
      f"WITH g AS (SELECT customer_segment g, COUNT(*) n, AVG(CAST(order_total AS DOUBLE)) m, VAR_SAMP(CAST(order_total AS DOUBLE)) v FROM ({_SEGO}) GROUP BY 1), t AS (SELECT SUM(n * m) / SUM(n) mm FROM g) "
      "SELECT 'anova' AS test, (SUM(n * (m - mm) * (m - mm)) / (COUNT(*) - 1)) / (SUM((n - 1) * v) / (SUM(n) - COUNT(*))) AS statistic, COUNT(*) - 1 AS dof1, SUM(n) - COUNT(*) AS dof2 FROM g, t")(
    lambda c: stats.anova(_by_segment(c), "order_total", "customer_segment"))
_RK = f"WITH b AS (SELECT customer_segment g, order_total v FROM ({_SEGO}) {{w}}), r AS (SELECT g, RANK() OVER (ORDER BY v) + (COUNT(*) OVER (PARTITION BY v) - 1) / 2 AS rk FROM b), s AS (SELECT g, COUNT(*) n, SUM(rk) r FROM r GROUP BY 1), tt AS (SELECT SUM(CAST(t AS DOUBLE) * t * t - t) tie, SUM(t) nn FROM (SELECT COUNT(*) t FROM b GROUP BY v)) "
query("t4_kruskal", "test:s statistic:d4 dof:i",
      _RK.replace("{w}", "") + "SELECT 'kruskal' AS test, (12 / (nn * (nn + 1)) * SUM(r * r / n) - 3 * (nn + 1)) / (1 - tie / (CAST(nn AS DOUBLE) * nn * nn - nn)) AS statistic, COUNT(*) - 1 AS dof FROM s, tt GROUP BY nn, tie")(
    lambda c: stats.kruskal(_by_segment(c), "order_total", "customer_segment"))
query("t4_mann_whitney", "test:s statistic:d1 z:d4",
      _RK.replace("{w}", "WHERE customer_segment IN ('FURNITURE', 'MACHINERY')") + ", u AS (SELECT a.r - a.n * (a.n + 1) / 2 AS u, a.n n1, b.n n2 FROM s a, s b WHERE a.g = 'FURNITURE' AND b.g = 'MACHINERY') "
      "SELECT 'mannwhitneyu' AS test, u AS statistic, (ABS(u - n1 * n2 / 2) - 0.5) / sqrt(n1 * n2 / 12 * (n1 + n2 + 1 - tie / ((n1 + n2) * (n1 + n2 - 1)))) AS z FROM u, tt")(
    lambda c: stats.mann_whitney(_by_segment(c), "order_total", "customer_segment", "FURNITURE", "MACHINERY"))
_CHI = "WITH k AS ({k}), r AS (SELECT a, SUM(n) ra FROM k GROUP BY 1), c AS (SELECT b, SUM(n) cb FROM k GROUP BY 1), t AS (SELECT SUM(n) nn FROM k), d AS (SELECT ((SELECT COUNT(*) FROM r) - 1) * ((SELECT COUNT(*) FROM c) - 1) dof) "
query("t5_chi_square", "chi2:d4 dof:i n:i",
      _CHI.replace("{k}", f"SELECT customer_segment a, order_status b, COUNT(*) n FROM ({_SEGO}) GROUP BY 1, 2") + "SELECT SUM(pow(COALESCE(k.n, 0) - ra * cb / nn, 2) / (ra * cb / nn)) AS chi2, ANY_VALUE(dof) AS dof, ANY_VALUE(nn) AS n FROM r CROSS JOIN c CROSS JOIN t CROSS JOIN d LEFT JOIN k ON k.a = r.a AND k.b = c.b")(
    lambda c: stats.chi_square(_by_segment(c), "customer_segment", "order_status"))
query("t5_chi_square_2x2", "chi2:d4 dof:i n:i",
      _CHI.replace("{k}", f"SELECT customer_segment a, order_status b, COUNT(*) n FROM ({_SEGO}) WHERE customer_segment IN ('FURNITURE', 'MACHINERY') AND order_status IN ('Delivered', 'Returned') GROUP BY 1, 2")
      + "SELECT SUM(pow(ABS(COALESCE(k.n, 0) - ra * cb / nn) - LEAST(0.5, ABS(COALESCE(k.n, 0) - ra * cb / nn)), 2) / (ra * cb / nn)) AS chi2, ANY_VALUE(dof) AS dof, ANY_VALUE(nn) AS n FROM r CROSS JOIN c CROSS JOIN t CROSS JOIN d LEFT JOIN k ON k.a = r.a AND k.b = c.b")(
    lambda c: stats.chi_square(_by_segment(c).filter("customer_segment IN ('FURNITURE', 'MACHINERY') AND order_status IN ('Delivered', 'Returned')"), "customer_segment", "order_status"))
query("t6_analyze_dataset", "feature:s count:i mean:d4 median:d4 std:d4 skewness:d4 kurtosis:d4 outliers:i",
      _DESC + ", o AS (SELECT feature, COUNT(*) FILTER (value < q25 - 1.5 * (q75 - q25) OR value > q75 + 1.5 * (q75 - q25)) AS outliers FROM l JOIN (SELECT feature, q25, q75 FROM d) USING (feature) GROUP BY 1) SELECT d.*, outliers FROM d JOIN o USING (feature)")(
    lambda c: _analyze(c))


def _analyze(c):
    from marketloom.operators.quality import unpivot_numbers

    d = stats.describe(c.order_items, _N)
    fences = d.select("feature", (F.col("q25") - 1.5 * F.col("iqr")).alias("lo"), (F.col("q75") + 1.5 * F.col("iqr")).alias("hi"))
    long = with_lookup(unpivot_numbers(c.order_items, _N), fences, "feature", "f")
    out = long.groupBy("feature").agg(F.count_if((F.col("value") < F.col("f.lo")) | (F.col("value") > F.col("f.hi"))).alias("outliers"))
    return d.join(out, "feature")


_ASSIGN = "a AS (SELECT customer_id, customer_segment, ROW_NUMBER() OVER (PARTITION BY customer_segment ORDER BY md5('experiment:' || customer_id), customer_id) r, COUNT(*) OVER (PARTITION BY customer_segment) n FROM cust), asg AS (SELECT customer_id, customer_segment, [{l}][LEAST((r - 1) // (n // {k}), {k} - 1) + 1] AS variant FROM a)"
_A2, _A3 = _ASSIGN.replace("{l}", "'control', 'treatment'").replace("{k}", "2"), _ASSIGN.replace("{l}", "'a', 'b', 'c'").replace("{k}", "3")
query("t7_assign_variants", "customer_id:i customer_segment:s variant:s", "WITH " + _A3 + " SELECT * FROM asg")(lambda c: stats.assign_variants(c.customers_base, ["a", "b", "c"], ["customer_segment"]))


def _experiment(c, variants):
    assigned = stats.assign_variants(c.customers_base, variants, ["customer_segment"])
    per = c.orders.groupBy("customer_id").agg(F.sum("order_total").cast("double").alias("spend"), F.max((F.col("order_status") == "Returned").cast("int")).alias("returned"))
    return assigned.join(per, "customer_id")


_EXP = ", per AS (SELECT customer_id, CAST(SUM(order_total) AS DOUBLE) AS spend, MAX(CASE WHEN order_status = 'Returned' THEN 1 ELSE 0 END) AS returned FROM ord GROUP BY 1), ex AS (SELECT * FROM asg JOIN per USING (customer_id)), vs AS (SELECT variant, COUNT(*) n, AVG(spend) m, VAR_SAMP(spend) v, AVG(returned) p, SUM(returned) x FROM ex GROUP BY 1) "
query("t8_variant_stats", "variant:s n_samples:i mean:d4 std:d4 median:d4 min:d2 max:d2",
      "WITH " + _A3 + _EXP + 'SELECT variant, COUNT(*) AS n_samples, AVG(spend) AS mean, STDDEV_SAMP(spend) AS std, quantile_cont(spend, 0.5) AS median, MIN(spend) AS "min", MAX(spend) AS "max" FROM ex GROUP BY 1')(lambda c: stats.variant_stats(_experiment(c, ["a", "b", "c"]), "spend"))
query("t8_two_variant_t", "t_statistic:d4 dof:i effect_size:d6 relative_lift:d6",
      "WITH " + _A2 + _EXP + "SELECT (a.m - b.m) / sqrt(((a.n - 1) * a.v + (b.n - 1) * b.v) / (a.n + b.n - 2) * (1 / a.n + 1 / b.n)) AS t_statistic, a.n + b.n - 2 AS dof, (b.m - a.m) / sqrt((a.v + b.v) / 2) AS effect_size, (b.m - a.m) / a.m AS relative_lift FROM vs a, vs b WHERE a.variant = 'control' AND b.variant = 'treatment'")(
    lambda c: stats.two_variant_t(_experiment(c, ["control", "treatment"]), "spend", "control", "treatment"))
_Z = repr(NormalDist().inv_cdf(0.975))
query("t8_two_variant_z", "z_statistic:d4 absolute_lift:d6 relative_lift:d6 control_low:d6 control_high:d6 treatment_low:d6 treatment_high:d6",
      "WITH " + _A2 + _EXP + f"SELECT (a.p - b.p) / sqrt((a.x + b.x) / (a.n + b.n) * (1 - (a.x + b.x) / (a.n + b.n)) * (1 / a.n + 1 / b.n)) AS z_statistic, b.p - a.p AS absolute_lift, (b.p - a.p) / a.p AS relative_lift, GREATEST(0, a.p - {_Z} * sqrt(a.p * (1 - a.p) / a.n)) AS control_low, LEAST(1, a.p + {_Z} * sqrt(a.p * (1 - a.p) / a.n)) AS control_high, "
      f"GREATEST(0, b.p - {_Z} * sqrt(b.p * (1 - b.p) / b.n)) AS treatment_low, LEAST(1, b.p + {_Z} * sqrt(b.p * (1 - b.p) / b.n)) AS treatment_high FROM vs a, vs b WHERE a.variant = 'control' AND b.variant = 'treatment'")(
    lambda c: stats.two_variant_z(_experiment(c, ["control", "treatment"]), "returned", "control", "treatment"))
query("t8_multi_variant", "test:s statistic:d4 p_value:d4")(lambda c: stats.anova(_experiment(c, ["a", "b", "c"]), "spend", "variant").select("test", "statistic", "p_value").unionByName(
    stats.chi_square(_experiment(c, ["a", "b", "c"]), "variant", "returned").select(F.lit("chi_square").alias("test"), F.col("chi2").alias("statistic"), "p_value")))
_P = repr(NormalDist().inv_cdf(0.8))
query("t9_sample_size", "customer_segment:s rate:d6 required_sample_size:i",
      f"WITH r AS (SELECT customer_segment, COUNT(*) FILTER (order_status = 'Returned') / COUNT(*) AS rate FROM ({_SEGO}) GROUP BY 1) SELECT *, CAST(ceil(pow({_Z} * sqrt(2 * rate * 1.05 * (1 - rate * 1.05)) + {_P} * sqrt(rate * (1 - rate) + rate * 1.1 * (1 - rate * 1.1)), 2) / pow(rate * 0.1, 2)) AS BIGINT) AS required_sample_size FROM r")(
    lambda c: stats.sample_size(_by_segment(c).groupBy("customer_segment").agg((F.count_if(F.col("order_status") == "Returned") / F.count("*")).alias("rate")), "rate", 0.1))

# --- causal ------------------------------------------------------------------


def treated(c):
    """Customers with an even key were treated; scores are smoothed rates per segment and age group."""
    spend = c.orders.groupBy("customer_id").agg(F.sum("order_total").cast("double").alias("outcome"), F.count("*").alias("n_orders"))
    base = c.customers_base.select("customer_id", "customer_segment", "age", (F.col("customer_id") % 3 == 0).cast("int").alias("treatment")).join(spend, "customer_id")
    cells = base.groupBy("customer_segment", "age").agg(((F.sum("treatment") + 1) / (F.count("*") + 3)).alias("propensity_score"))
    return base.join(cells, ["customer_segment", "age"])


_TR = """WITH tb AS (SELECT customer_id, customer_segment, age, CASE WHEN customer_id % 3 = 0 THEN 1 ELSE 0 END AS treatment, outcome, n_orders FROM cust JOIN (SELECT customer_id, CAST(SUM(order_total) AS DOUBLE) AS outcome, COUNT(*) AS n_orders FROM ord GROUP BY 1) USING (customer_id)),
td AS (SELECT *, (SUM(treatment) OVER w + 1) / (COUNT(*) OVER w + 3) AS propensity_score FROM tb WINDOW w AS (PARTITION BY customer_segment, age)),
"""
query("t10_propensity_scores", "customer_id:i propensity_score:d6")(lambda c: causal.propensity_scores(treated(c).drop("propensity_score"), "treatment", ["age", "n_orders"]))
_MATCH = _TR + """mt AS (SELECT t.customer_id AS treated_id, k.customer_id AS control_id, t.outcome AS treated_outcome, k.outcome AS control_outcome, ABS(t.propensity_score - k.propensity_score) AS propensity_diff, t.outcome - k.outcome AS individual_effect
  FROM td t JOIN td k ON t.treatment = 1 AND k.treatment = 0 QUALIFY ROW_NUMBER() OVER (PARTITION BY t.customer_id ORDER BY ABS(t.propensity_score - k.propensity_score), k.propensity_score, CASE WHEN k.propensity_score <= t.propensity_score THEN -k.customer_id ELSE k.customer_id END) = 1)
"""


def _pairs(c, caliper=None):
    return causal.match_nearest(treated(c), "customer_id", "treatment", "outcome", caliper=caliper)


query("t11_nearest_matches", "treated_id:i control_id:i treated_outcome:d2 control_outcome:d2 propensity_diff:d6 individual_effect:d2", _MATCH + "SELECT * FROM mt")(_pairs)
query("t11_matching_effect", "n_matches:i att:d2 standard_error:d2 t_statistic:d4 mean_propensity_diff:d6",
      _MATCH + "SELECT COUNT(*) AS n_matches, AVG(individual_effect) AS att, STDDEV_SAMP(individual_effect) / sqrt(COUNT(*)) AS standard_error, AVG(individual_effect) / (STDDEV_SAMP(individual_effect) / sqrt(COUNT(*))) AS t_statistic, AVG(propensity_diff) AS mean_propensity_diff FROM mt WHERE propensity_diff <= 0.005")(
    lambda c: causal.matching_effect(_pairs(c, 0.005)))
query("t12_inverse_probability", "n_treated:i n_control:i ate:d2 mean_weight:d6 max_weight:d6",
      _TR + """w AS (SELECT *, CASE WHEN treatment = 1 THEN 1 / propensity_score ELSE 1 / (1 - propensity_score) END w0 FROM td), e AS (SELECT quantile_cont(w0, 0.01) lo, quantile_cont(w0, 0.99) hi FROM w), x AS (SELECT *, GREATEST(lo, LEAST(w0, hi)) w1 FROM w, e)
SELECT SUM(treatment) AS n_treated, COUNT(*) - SUM(treatment) AS n_control, SUM(w1 * outcome) FILTER (treatment = 1) / SUM(w1) FILTER (treatment = 1) - SUM(w1 * outcome) FILTER (treatment = 0) / SUM(w1) FILTER (treatment = 0) AS ate, AVG(w1) AS mean_weight, MAX(w1) AS max_weight FROM x""")(
    lambda c: causal.inverse_probability_weighting(treated(c), "customer_id", "treatment", "outcome"))
query("t12_ipw_bootstrap", "ate:d2 standard_error:d2 t_statistic:d4 p_value:d4")(lambda c: causal.inverse_probability_weighting(treated(c), "customer_id", "treatment", "outcome"))


def _did_rows(c):
    return c.orders.select("order_id", F.col("order_total").cast("double").alias("outcome"), "order_date", (F.col("customer_id") % 3 == 0).cast("int").alias("treatment"), F.datediff("order_date", F.lit("1995-01-01").cast("date")).alias("t"))


_DID = """WITH d AS (SELECT CAST(order_total AS DOUBLE) y, CASE WHEN customer_id % 3 = 0 THEN 1 ELSE 0 END t, CASE WHEN order_date > DATE '2000-06-01' THEN 1 ELSE 0 END p, order_date - DATE '1995-01-01' AS x FROM ord),
k AS (SELECT t, p, COUNT(*) n, AVG(y) m, VAR_SAMP(y) v FROM d GROUP BY 1, 2), e AS (SELECT MAX(m) FILTER (t = 1 AND p = 0) a, MAX(m) FILTER (t = 0 AND p = 0) b, MAX(m) FILTER (t = 1 AND p = 1) c, MAX(m) FILTER (t = 0 AND p = 1) f, sqrt(SUM((n - 1) * v) / (SUM(n) - 4) * SUM(1 / n)) AS did_se FROM k),
did AS (SELECT a AS pre_treatment_mean, b AS pre_control_mean, c AS post_treatment_mean, f AS post_control_mean, c - a AS treatment_diff, f - b AS control_diff, c - a - f + b AS did_estimator, did_se, (c - a - f + b) / did_se AS t_statistic FROM e)
"""


def did(c):
    return causal.difference_in_differences(_did_rows(c), "treatment", "outcome", "order_date", "2000-06-01")


query("t13_difference_in_differences", "pre_treatment_mean:d2 pre_control_mean:d2 post_treatment_mean:d2 post_control_mean:d2 treatment_diff:d2 control_diff:d2 did_estimator:d2 did_se:d2 t_statistic:d4", _DID + "SELECT * FROM did")(did)
query("t14_compare_methods", "method:s effect:d2 standard_error:d2 p_value:d4")(lambda c: causal.compare_methods(
    matching=causal.matching_effect(_pairs(c)), weighting=causal.inverse_probability_weighting(treated(c), "customer_id", "treatment", "outcome"), diff_in_diff=did(c)))
query("t15_parallel_trends", "treated_trend:d4 control_trend:d4 trend_difference:d4",
      _DID + "SELECT REGR_SLOPE(y, x) FILTER (t = 1) AS treated_trend, REGR_SLOPE(y, x) FILTER (t = 0) AS control_trend, REGR_SLOPE(y, x) FILTER (t = 1) - REGR_SLOPE(y, x) FILTER (t = 0) AS trend_difference FROM d WHERE x <= 1978")(
    lambda c: causal.parallel_trends(_did_rows(c).filter("t <= 1978"), "order_id", "treatment", "outcome", "t"))
query("t15_trend_interval", "trend_difference:d4 ci_95_lower:d4 ci_95_upper:d4 parallel_trends_holds:b")(lambda c: causal.parallel_trends(_did_rows(c).filter("t <= 1978"), "order_id", "treatment", "outcome", "t"))
query("t16_validate_instrument", "relevance_correlation:d6 first_stage_r_squared:d6 exclusion_correlation:d6 n:i first_stage_f_statistic:d4 instrument_strong:b",
      _TR + "r AS (SELECT CORR(n_orders, outcome) AS relevance_correlation, CORR(n_orders, outcome) * CORR(n_orders, outcome) AS r2, CORR(n_orders, age) AS exclusion_correlation, COUNT(*) AS n FROM td) SELECT *, r2 AS first_stage_r_squared, r2 / (1 - r2) * (n - 2) AS first_stage_f_statistic, r2 / (1 - r2) * (n - 2) > 10 AS instrument_strong FROM r")(
    lambda c: causal.validate_instrument(treated(c), "n_orders", "outcome", "age"))
query("t17_confounders", "confounder:s correlation_with_treatment:d6 correlation_with_outcome:d6 is_confounder:b",
      _TR + "u AS (SELECT 'age' AS confounder, CORR(age, treatment) a, CORR(age, outcome) b FROM td UNION ALL SELECT 'n_orders', CORR(n_orders, treatment), CORR(n_orders, outcome) FROM td UNION ALL SELECT 'propensity_score', CORR(propensity_score, treatment), CORR(propensity_score, outcome) FROM td) SELECT confounder, a AS correlation_with_treatment, b AS correlation_with_outcome, ABS(a) > 0.1 AND ABS(b) > 0.1 AS is_confounder FROM u")(
    lambda c: causal.confounders(treated(c), "treatment", "outcome", ["age", "n_orders", "propensity_score"]))
query("t18_propensity_diagnostics", "propensity_overlap:d6 standardized_mean_difference:d6 histogram_overlap:d6 good_balance:b",
      _TR + """f AS (SELECT MIN(propensity_score) FILTER (treatment = 1) a1, MAX(propensity_score) FILTER (treatment = 1) b1, MIN(propensity_score) FILTER (treatment = 0) a0, MAX(propensity_score) FILTER (treatment = 0) b0, AVG(propensity_score) FILTER (treatment = 1) m1, AVG(propensity_score) FILTER (treatment = 0) m0,
  VAR_POP(propensity_score) FILTER (treatment = 1) v1, VAR_POP(propensity_score) FILTER (treatment = 0) v0 FROM td),
g AS (SELECT AVG(CASE WHEN propensity_score >= a1 THEN 1 ELSE 0 END) FILTER (treatment = 0) AS propensity_overlap, ANY_VALUE((m1 - m0) / sqrt((v1 + v0) / 2)) AS smd,
  (AVG(CASE WHEN propensity_score BETWEEN GREATEST(a1, a0) AND LEAST(b1, b0) THEN 1 ELSE 0 END) FILTER (treatment = 1) + AVG(CASE WHEN propensity_score BETWEEN GREATEST(a1, a0) AND LEAST(b1, b0) THEN 1 ELSE 0 END) FILTER (treatment = 0)) / 2 AS histogram_overlap FROM td, f)
SELECT propensity_overlap, smd AS standardized_mean_difference, histogram_overlap, ABS(smd) < 0.1 AND propensity_overlap > 0.8 AS good_balance FROM g""")(
    lambda c: causal.propensity_diagnostics(treated(c), "treatment"))
query("t19_sensitivity_grid", "i:i rho:d6 gamma:d6 lower_bound:d2 upper_bound:d2 effect_explained:b",
      _DID + ", g AS (SELECT i, did_estimator e, -0.9 + i * (1.8 / 99) AS rho FROM did, range(100) r(i)) SELECT i, rho, exp(rho) AS gamma, e / exp(rho) AS lower_bound, e * exp(rho) AS upper_bound, e / exp(rho) <= 0 AND e * exp(rho) >= 0 AS effect_explained FROM g")(
    lambda c: causal.sensitivity_grid(did(c), "did_estimator"))

# --- uplift ------------------------------------------------------------------


def campaign_rows(c):
    return c.customers_base.select("customer_id", "customer_segment", "gender", "age", (F.col("customer_id") % 2).cast("int").alias("treatment"),
                                   F.date_add(F.lit("1998-01-01").cast("date"), (F.col("customer_id") % 300).cast("int")).alias("campaign_date"))


def uplifted(c):
    """Predicted uplift: effect of the segment and gender cell plus a small customer offset."""
    base = causal.uplift_data(campaign_rows(c), c.orders, 120)
    side = lambda v: F.avg(F.when(F.col("treatment") == v, F.col("outcome").cast("double")))
    cells = base.groupBy("customer_segment", "age").agg(F.coalesce(side(1) - side(0), F.lit(0.0)).alias("_e"))
    return base.join(cells, ["customer_segment", "age"]).withColumn("predicted_uplift", F.col("_e") + (F.col("customer_id") % 97) / 1000.0).drop("_e")


_UP = """WITH cr AS (SELECT customer_id, customer_segment, age, customer_id % 2 AS treatment, DATE '1998-01-01' + CAST(customer_id % 300 AS INT) AS campaign_date FROM cust),
oc AS (SELECT cr.*, COUNT(order_id) n, COALESCE(SUM(order_total), 0) AS outcome_value FROM cr LEFT JOIN ord o ON o.customer_id = cr.customer_id AND o.order_date > campaign_date AND o.order_date <= campaign_date + 120 GROUP BY ALL),
ud AS (SELECT *, CASE WHEN n > 0 THEN 1 ELSE 0 END AS outcome FROM oc),
up AS (SELECT *, COALESCE(AVG(CAST(outcome AS DOUBLE)) FILTER (treatment = 1) OVER w - AVG(CAST(outcome AS DOUBLE)) FILTER (treatment = 0) OVER w, 0) + (customer_id % 97) / 1000 AS predicted_uplift FROM ud WINDOW w AS (PARTITION BY customer_segment, age)),
"""
query("u1_uplift_data", "customer_id:i treatment:i campaign_date:t outcome:i outcome_value:d2", _UP + "z AS (SELECT 1) SELECT * FROM up")(lambda c: causal.uplift_data(campaign_rows(c), c.orders, 120))
for _kind, _fn in (("t", causal.t_learner), ("x", causal.x_learner)):
    query({"t": "u2_t_learner", "x": "u3_x_learner"}[_kind], "customer_id:i predicted_uplift:d6")(lambda c, fn=_fn: fn(causal.uplift_data(campaign_rows(c), c.orders, 120), ["age"]))
query("u11_predict_uplift_trees", "customer_segment:s mean_uplift:d6 n:i")(
    lambda c: causal.t_learner(causal.uplift_data(campaign_rows(c), c.orders, 120), ["age"], "gradient_boosting").groupBy("customer_segment").agg(F.avg("predicted_uplift").alias("mean_uplift"), F.count("*").alias("n")))
query("u4_uplift_segments", "customer_id:i predicted_uplift:d6 uplift_segment:i segment_label:s",
      _UP + """e AS (SELECT quantile_cont(predicted_uplift, 0.25) a, quantile_cont(predicted_uplift, 0.5) b, quantile_cont(predicted_uplift, 0.75) c FROM up), s AS (SELECT *, CASE WHEN predicted_uplift >= c THEN 3 WHEN predicted_uplift >= b THEN 2 WHEN predicted_uplift >= a THEN 1 ELSE 0 END AS uplift_segment FROM up, e)
SELECT *, ['Lost Causes', 'Persuadables', 'Sure Things', 'Sleeping Dogs'][uplift_segment + 1] AS segment_label FROM s""")(lambda c: causal.uplift_segments(uplifted(c), "predicted_uplift"))
query("u5_targeting_metrics", " ".join(f"ate_at_{p}pct:d6" for p in (10, 20, 30, 40, 50)) + " overall_ate:d6 uplift_gain:d6 uplift_gain_pct:d2",
      _UP + "r AS (SELECT *, ROW_NUMBER() OVER (ORDER BY predicted_uplift DESC, customer_id) k, COUNT(*) OVER () nn FROM up), m AS (SELECT "
      + ", ".join(f"AVG(outcome) FILTER (treatment = 1 AND k <= nn * {p} // 100) - AVG(outcome) FILTER (treatment = 0 AND k <= nn * {p} // 100) AS ate_at_{p}pct" for p in (10, 20, 30, 40, 50))
      + ", AVG(outcome) FILTER (treatment = 1) - AVG(outcome) FILTER (treatment = 0) AS overall_ate FROM r) SELECT *, ate_at_30pct - overall_ate AS uplift_gain, (ate_at_30pct / overall_ate - 1) * 100 AS uplift_gain_pct FROM m")(
    lambda c: causal.targeting_metrics(uplifted(c), "predicted_uplift"))
query("u6_true_uplift", "group_name:s true_uplift:d6 standard_error:d6 t_statistic:d4 n_treated:i n_control:i",
      _UP + "g AS (SELECT 'overall' AS g, treatment, outcome FROM up UNION ALL SELECT customer_segment, treatment, outcome FROM up) SELECT g AS group_name, AVG(outcome) FILTER (treatment = 1) - AVG(outcome) FILTER (treatment = 0) AS true_uplift, sqrt(VAR_SAMP(outcome) FILTER (treatment = 1) / SUM(treatment) + VAR_SAMP(outcome) FILTER (treatment = 0) / SUM(1 - treatment)) AS standard_error, "
      "(AVG(outcome) FILTER (treatment = 1) - AVG(outcome) FILTER (treatment = 0)) / sqrt(VAR_SAMP(outcome) FILTER (treatment = 1) / SUM(treatment) + VAR_SAMP(outcome) FILTER (treatment = 0) / SUM(1 - treatment)) AS t_statistic, SUM(treatment) AS n_treated, SUM(1 - treatment) AS n_control FROM g GROUP BY 1")(
    lambda c: causal.true_uplift(uplifted(c)).unionByName(causal.true_uplift(uplifted(c), by="customer_segment")))
_CURVE = """r AS (SELECT {g} AS g, treatment, outcome, ROW_NUMBER() OVER v k, SUM(treatment) OVER v c1, SUM(1 - treatment) OVER v c0, SUM(outcome * treatment) OVER v s1, SUM(outcome * (1 - treatment)) OVER v s0, AVG(outcome) FILTER (treatment = 1) OVER a o1, AVG(outcome) FILTER (treatment = 0) OVER a o0, COUNT(*) OVER a nn
  FROM up WINDOW v AS (PARTITION BY {g} ORDER BY predicted_uplift DESC, customer_id), a AS (PARTITION BY {g})),
cu AS (SELECT g, AVG(s1 / c1 - s0 / c0) AS auuc, SUM(s1 / c1 - s0 / c0 - (o1 - o0)) AS qini_coefficient, MAX(nn) AS n_rows FROM r WHERE c1 > 0 AND c0 > 0 GROUP BY 1),
qe AS (SELECT {g} AS g, """ + ", ".join(f"quantile_cont(predicted_uplift, {i / 10}) e{i}" for i in range(1, 10)) + """ FROM up GROUP BY 1),
dc AS (SELECT g, """ + " + ".join(f"CASE WHEN predicted_uplift > e{i} THEN 1 ELSE 0 END" for i in range(1, 10)) + """ AS decile, AVG(predicted_uplift) AS predicted_uplift, AVG(outcome) FILTER (treatment = 1) - AVG(outcome) FILTER (treatment = 0) AS actual_uplift FROM up JOIN qe ON qe.g = {g} GROUP BY 1, 2),
evl AS (SELECT g, COALESCE(CORR(predicted_uplift, actual_uplift), 0) AS uplift_correlation, AVG(ABS(predicted_uplift - actual_uplift)) AS calibration_error, COUNT(*) AS n_deciles FROM dc WHERE actual_uplift IS NOT NULL GROUP BY 1)
"""
_CA, _CS = _CURVE.replace("{g}", "'all'"), _CURVE.replace("{g}", "customer_segment")
query("u7_uplift_deciles", "decile:i predicted_uplift:d6 actual_uplift:d6", _UP + _CA + "SELECT * FROM dc WHERE actual_uplift IS NOT NULL")(lambda c: causal.uplift_deciles(uplifted(c), "predicted_uplift"))
query("u7_evaluate_uplift", "uplift_correlation:d6 calibration_error:d6 n_deciles:i auuc:d6 qini_coefficient:d4", _UP + _CA + "SELECT * FROM evl JOIN cu USING (g)")(lambda c: causal.evaluate_uplift(uplifted(c), "predicted_uplift"))
query("u8_auuc", "auuc:d6 n_rows:i", _UP + _CA + "SELECT * FROM cu")(lambda c: causal.uplift_curves(uplifted(c), "predicted_uplift"))
query("u9_qini", "qini_coefficient:d4", _UP + _CA + "SELECT * FROM cu")(lambda c: causal.uplift_curves(uplifted(c), "predicted_uplift"))
query("u10_uplift_by_segment", "customer_segment:s uplift_correlation:d6 calibration_error:d6 n_deciles:i auuc:d6 qini_coefficient:d4 n_rows:i", _UP + _CS + "SELECT g AS customer_segment, * FROM evl JOIN cu USING (g) WHERE n_rows >= 100")(
    lambda c: causal.evaluate_uplift(uplifted(c), "predicted_uplift", by=["customer_segment"]))

# --- survival ----------------------------------------------------------------


def survived(c):
    return survival.survival_data(c.orders, c.customers_base.select("customer_id", "customer_segment", "age"), AS_OF)


_SV = """WITH sv AS (SELECT c.customer_id, customer_segment, age, MAX(order_date) - MIN(order_date) AS "time", CASE WHEN DATE '2001-08-01' - MAX(order_date) > 90 THEN 1 ELSE 0 END AS event, COUNT(*) AS total_orders, CAST(SUM(order_total) AS DOUBLE) AS total_spend FROM cust c JOIN ord o ON o.customer_id = c.customer_id GROUP BY ALL),
kt AS (SELECT customer_segment g, "time" t, SUM(event) d, COUNT(*) m FROM sv GROUP BY 1, 2 UNION ALL SELECT 'all', "time", SUM(event), COUNT(*) FROM sv GROUP BY 2),
kr AS (SELECT *, SUM(m) OVER (PARTITION BY g ORDER BY t DESC) r FROM kt),
km AS (SELECT g, t, r AS at_risk, d AS n_events, m - d AS n_censored, CASE WHEN MIN(1 - d / r) OVER w = 0 THEN 0 ELSE exp(SUM(ln(CASE WHEN d = r THEN 1 ELSE 1 - d / r END)) OVER w) END AS survival_prob FROM kr WINDOW w AS (PARTITION BY g ORDER BY t)),
"""
query("v1_survival_data", "customer_id:i time:i event:i total_orders:i total_spend:d2 avg_order_value:d2", _SV + "z AS (SELECT 1) SELECT *, total_spend / total_orders AS avg_order_value FROM sv")(survived)
_KM_SPEC = "time:i at_risk:i n_events:i n_censored:i survival_prob:d6"
query("v2_kaplan_meier", _KM_SPEC, _SV + 'z AS (SELECT 1) SELECT *, t AS "time" FROM km WHERE g = \'all\'')(lambda c: survival.kaplan_meier(survived(c)))
query("v3_hazard_ratios", "feature:s hazard_ratio:d6",
      _SV + 'lo AS (SELECT \'age\' AS feature, CAST(age AS DOUBLE) v, "time" t, event e FROM sv UNION ALL SELECT \'total_orders\', total_orders, "time", event FROM sv UNION ALL SELECT \'total_spend\', total_spend, "time", event FROM sv), md AS (SELECT feature, quantile_cont(v, 0.5) m FROM lo GROUP BY 1) '
      "SELECT feature, (SUM(e) FILTER (v >= m) / SUM(t) FILTER (v >= m)) / (SUM(e) FILTER (v < m) / SUM(t) FILTER (v < m)) AS hazard_ratio FROM lo JOIN md USING (feature) GROUP BY 1")(
    lambda c: survival.hazard_ratios(survived(c), ["age", "total_orders", "total_spend"]))


def curves(c):
    return survival.kaplan_meier(survived(c), by=["customer_segment"])


_AT = """sg AS (SELECT *, LEAD(t) OVER w t2, LEAD(survival_prob) OVER w s2 FROM km WINDOW w AS (PARTITION BY g ORDER BY t)),
ath AS (SELECT g, COALESCE(MAX(survival_prob + (s2 - survival_prob) * ({h} - t) / (t2 - t)) FILTER (t <= {h} AND t2 > {h}), CASE WHEN {h} < MIN(t) THEN min_by(survival_prob, t) ELSE max_by(survival_prob, t) END) AS survival_probability FROM sg GROUP BY 1),
lt AS (SELECT g, SUM((t2 - t) * (survival_prob + s2) / 2) AS estimated_lifetime_days FROM sg GROUP BY 1)
"""
query("v4_survival_at_horizon", "customer_segment:s time_horizon_days:i survival_probability:d6 churn_probability:d6",
      _SV + _AT.replace("{h}", "1800") + "SELECT g AS customer_segment, 1800 AS time_horizon_days, survival_probability, 1 - survival_probability AS churn_probability FROM ath WHERE g <> 'all'")(lambda c: survival.survival_at(curves(c), 1800, ["customer_segment"]))
query("v5_expected_lifetime", "customer_segment:s estimated_lifetime_days:d4 estimated_lifetime_months:d4",
      _SV + _AT.replace("{h}", "1800") + "SELECT g AS customer_segment, estimated_lifetime_days, estimated_lifetime_days / 30 AS estimated_lifetime_months FROM lt WHERE g <> 'all'")(lambda c: survival.expected_lifetime(curves(c), ["customer_segment"]))
query("v6_segment_curves", "customer_segment:s " + _KM_SPEC, _SV + 'z AS (SELECT 1) SELECT *, t AS "time", g AS customer_segment FROM km WHERE g <> \'all\'')(curves)


def _cox_data(c):
    base = c.customers.select("customer_id", "signup_date", "age", (F.col("gender") == "F").cast("int").alias("is_female"))
    return survival.survival_data_from_signup(base, c.orders, AS_OF)


_COVARIATES = ["age", "is_female", "total_orders"]
query("v7_cox", "covariate:s coefficient:d6 hazard_ratio:d6 standard_error:d6")(lambda c: survival.fit_cox(_cox_data(c), _COVARIATES))
query("v8_risk_groups", "customer_id:i customer_segment:s survival_probability:d6 survival_segment:s",
      _SV + _AT.replace("{h}", "1800") + "SELECT customer_id, customer_segment, survival_probability, ['High Risk', 'Medium-High Risk', 'Medium-Low Risk', 'Low Risk'][NTILE(4) OVER (ORDER BY survival_probability, customer_id)] AS survival_segment FROM sv JOIN ath ON g = customer_segment")(
    lambda c: survival.risk_groups(survived(c), curves(c), "customer_segment", 1800))
query("v9_step_survival", "customer_segment:s time_point:i survival_prob:d6",
      _SV + "tp AS (SELECT UNNEST([365, 900, 1500, 1800, 2100]) AS p) SELECT g AS customer_segment, p AS time_point, COALESCE(max_by(survival_prob, t) FILTER (t <= p), 1) AS survival_prob FROM km, tp WHERE g <> 'all' GROUP BY 1, 2")(
    lambda c: survival.step_survival(curves(c), [365, 900, 1500, 1800, 2100], ["customer_segment"]))


def _relative(c):
    data = _cox_data(c)
    fitted = {r["covariate"]: (r["coefficient"], r["mean"]) for r in survival.fit_cox(data, _COVARIATES).collect()}
    return survival.relative_hazard(data, fitted)


query("v10_relative_hazard", "customer_id:i relative_hazard:d6")(_relative)
query("v7_concordance", "concordance:d4 comparable_pairs:d0")(lambda c: survival.concordance(_relative(c), "relative_hazard"))
query("v11_survival_from_signup", "customer_id:i duration:i event:i total_orders:i",
      "SELECT c.customer_id, COALESCE(MAX(order_date), signup_date) - COALESCE(MIN(order_date), signup_date) + 1 AS duration, CASE WHEN COALESCE(MAX(order_date), signup_date) < DATE '2001-05-03' AND COUNT(order_id) > 0 THEN 1 ELSE 0 END AS event, COUNT(order_id) AS total_orders FROM cust c LEFT JOIN ord o ON o.customer_id = c.customer_id GROUP BY 1, signup_date")(_cox_data)
