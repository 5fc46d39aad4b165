"""Anomaly, change point, drift and forecast queries."""

from functools import cache  # noqa: F401

from pyspark.sql import functions as F

from marketloom.operators import sales
from marketloom.operators import series as ops
from marketloom.plans.registry import query

KPIS = ("total_revenue_inr", "total_orders", "avg_order_value_inr", "units_sold")


def kpi_series(c):
    return ops.long_kpis(sales.daily_kpis(c.orders, c.order_items), "day", KPIS)


_KPI = """
WITH dl AS (SELECT order_date d, SUM(quantity) u FROM ord JOIN itm USING (order_id) GROUP BY 1),
dk AS (SELECT order_date AS day, CAST(SUM(CASE WHEN order_status <> 'Cancelled' THEN order_total ELSE 0 END) AS DOUBLE) AS total_revenue_inr, COUNT(*) AS total_orders FROM ord GROUP BY 1),
dd AS (SELECT dk.*, total_revenue_inr / total_orders AS avg_order_value_inr, COALESCE(u, 0) AS units_sold FROM dk LEFT JOIN dl ON d = day),
ks AS (SELECT 'total_revenue_inr' AS kpi, day, total_revenue_inr AS value FROM dd UNION ALL SELECT 'total_orders', day, total_orders FROM dd
  UNION ALL SELECT 'avg_order_value_inr', day, avg_order_value_inr FROM dd UNION ALL SELECT 'units_sold', day, units_sold FROM dd),
"""
_ANOM = _KPI + """st AS (SELECT kpi, AVG(value) m, STDDEV_POP(value) s, quantile_cont(value, 0.25) q1, quantile_cont(value, 0.75) q3 FROM ks GROUP BY 1),
rl AS (SELECT *, CASE WHEN COUNT(value) OVER w >= 5 THEN AVG(value) OVER w END AS rolling_mean, COALESCE(CASE WHEN COUNT(value) OVER w >= 5 THEN STDDEV_SAMP(value) OVER w END, 1) AS rs FROM ks
  WINDOW w AS (PARTITION BY kpi ORDER BY day ROWS BETWEEN 27 PRECEDING AND CURRENT ROW)),
z AS (SELECT kpi, day, value, rolling_mean, ABS(value - m) / s AS zscore, CASE WHEN rs > 0 THEN ABS(value - rolling_mean) / rs ELSE 0 END AS rolling_zscore, q1 - 3 * (q3 - q1) AS iqr_lower, q3 + 3 * (q3 - q1) AS iqr_upper FROM rl JOIN st USING (kpi)),
an AS (SELECT *, zscore > 3 OR value < iqr_lower OR value > iqr_upper OR COALESCE(rolling_zscore > 3, FALSE) AS is_anomaly, CASE WHEN value > rolling_mean THEN 'spike' ELSE 'drop' END AS direction,
  CASE WHEN zscore <= 2 THEN 'low' WHEN zscore <= 3 THEN 'medium' WHEN zscore <= 4 THEN 'high' ELSE 'critical' END AS severity FROM z),
al AS (SELECT *, CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END AS severity_score, COALESCE(rolling_mean, 0) AS baseline_28d,
  (value - COALESCE(rolling_mean, 0)) / (ABS(COALESCE(rolling_mean, 0)) + 1e-9) * 100 AS change_pct, CASE direction WHEN 'drop' THEN 'Drop' ELSE 'Spike' END AS anomaly_label
  FROM an WHERE is_anomaly QUALIFY ROW_NUMBER() OVER (PARTITION BY kpi ORDER BY day DESC) <= 20)
"""
ANOMALY_SQL = _ANOM


def anomalies(c):
    return ops.statistical_anomalies(kpi_series(c))


query("a1_statistical_anomalies", "kpi:s day:t value:d2 zscore:d3 rolling_zscore:d3 iqr_lower:d2 iqr_upper:d2 rolling_mean:d2 is_anomaly:b direction:s severity:s", _ANOM + "SELECT * FROM an")(anomalies)
query("a2_root_cause_hints", "day:t hint_rank:i kpi:s value:d2 baseline:d2 change_pct:d2",
      _KPI + """b AS (SELECT *, quantile_cont(value, 0.5) OVER w AS baseline, COUNT(value) OVER w n FROM ks WINDOW w AS (PARTITION BY kpi ORDER BY day ROWS BETWEEN 29 PRECEDING AND 2 PRECEDING)),
h AS (SELECT *, (value - baseline) / (ABS(baseline) + 1e-9) * 100 AS change_pct FROM b WHERE n >= 2)
SELECT *, ROW_NUMBER() OVER (PARTITION BY day ORDER BY ABS(change_pct) DESC, kpi) AS hint_rank FROM h WHERE ABS(change_pct) > 35 QUALIFY hint_rank <= 3""")(
    lambda c: ops.root_cause_hints(sales.daily_kpis(c.orders, c.order_items), "day", KPIS))
query("a3_anomaly_alerts", "kpi:s day:t anomaly_label:s severity:s severity_score:i value:d2 baseline_28d:d2 change_pct:d1 recommended_action:s",
      _ANOM + """SELECT *, CASE severity_score WHEN 4 THEN 'Investigate immediately + notify ops' WHEN 3 THEN 'Investigate cause within 48 hrs' ELSE 'Monitor + flag for weekly review' END AS recommended_action FROM al""")(
    lambda c: ops.anomaly_alerts(anomalies(c)))
query("a4_baseline_stats", "kpi:s mean:d2 std:d2 median:d2 q25:d2 q75:d2 min:d2 max:d2 rolling_mean:d2 rolling_std:d2 iqr:d2 lower_bound:d2 upper_bound:d2",
      _KPI + """r AS (SELECT *, AVG(value) OVER w rm, STDDEV_SAMP(value) OVER w rs FROM ks WINDOW w AS (PARTITION BY kpi ORDER BY day ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)),
b AS (SELECT kpi, AVG(value) AS mean, STDDEV_POP(value) AS std, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.25) AS q25, quantile_cont(value, 0.75) AS q75, MIN(value) AS "min", MAX(value) AS "max", max_by(rm, day) AS rolling_mean, max_by(rs, day) AS rolling_std FROM r GROUP BY 1)
SELECT *, q75 - q25 AS iqr, q25 - 1.5 * (q75 - q25) AS lower_bound, q75 + 1.5 * (q75 - q25) AS upper_bound FROM b""")(
    lambda c: ops.baseline_stats(kpi_series(c)))

_PT = "order_id:i order_total:d2 anomaly_score:d4 is_anomaly:b severity:s"
_SEV = "CASE WHEN anomaly_score > {t} * 2 THEN 'critical' WHEN anomaly_score > {t} * 1.5 THEN 'high' WHEN is_anomaly THEN 'medium' ELSE 'none' END AS severity"


def _totals(c):
    return c.orders.select("order_id", "order_total")


query("a5_zscore_anomalies", _PT, "WITH o AS (SELECT order_id, order_total, ABS(CAST(order_total AS DOUBLE) - AVG(CAST(order_total AS DOUBLE)) OVER ()) / STDDEV_POP(CAST(order_total AS DOUBLE)) OVER () AS anomaly_score FROM ord), f AS (SELECT *, anomaly_score > 1.7 AS is_anomaly FROM o) SELECT *, "
      + _SEV.replace("{t}", "1.7") + " FROM f")(lambda c: ops.point_anomalies(_totals(c), "order_total", "zscore", 1.7))
query("a5_modified_zscore_anomalies", _PT,
      "WITH m AS (SELECT quantile_cont(CAST(order_total AS DOUBLE), 0.5) m FROM ord), d AS (SELECT quantile_cont(ABS(CAST(order_total AS DOUBLE) - m), 0.5) d FROM ord, m), o AS (SELECT order_id, order_total, 0.6745 * ABS(CAST(order_total AS DOUBLE) - m) / d AS anomaly_score FROM ord, m, d), "
      "f AS (SELECT *, anomaly_score > 1.3 AS is_anomaly FROM o) SELECT *, " + _SEV.replace("{t}", "1.3") + " FROM f")(lambda c: ops.point_anomalies(_totals(c), "order_total", "modified_zscore", 1.3))
query("a9_iqr_outliers", "order_id:i product_id:i line_total:d2 anomaly_score:d6 is_anomaly:b severity:s",
      "WITH q AS (SELECT quantile_cont(CAST(line_total AS DOUBLE), 0.25) a, quantile_cont(CAST(line_total AS DOUBLE), 0.75) b FROM itm), e AS (SELECT a - 1.5 * (b - a) lo, b + 1.5 * (b - a) hi FROM q), "
      "o AS (SELECT order_id, product_id, CAST(line_total AS DOUBLE) AS line_total, lo, hi FROM itm, e), f AS (SELECT *, line_total < lo OR line_total > hi AS is_anomaly, CASE WHEN line_total < lo THEN (lo - line_total) / (hi - lo) WHEN line_total > hi THEN (line_total - hi) / (hi - lo) ELSE 0 END AS anomaly_score FROM o) SELECT *, "
      + _SEV.replace("{t}", "3.0") + " FROM f")(lambda c: ops.point_anomalies(c.order_items.select("order_id", "product_id", "line_total"), "line_total", "iqr", 3.0))

_FEATURES = ("quantity", "unit_price", "discount_pct", "line_total")


def _recent(c, recent=True):
    o = c.orders.select("order_id", "order_date").filter(F.col("order_date") >= "2001-01-01" if recent else F.col("order_date") < "2001-01-01")
    return c.order_items.join(o, "order_id")


_REC = "SELECT i.*, order_date FROM itm i JOIN ord USING (order_id) WHERE order_date {op} DATE '2001-01-01'"
_LONG = " UNION ALL ".join(f"SELECT '{f}' AS feature, CAST({f} AS DOUBLE) AS value, order_date FROM {{t}}" for f in _FEATURES)
_DRIFT = "WITH cu AS (" + _REC.replace("{op}", ">=") + "), ba AS (" + _REC.replace("{op}", "<") + "), lc AS (" + _LONG.replace("{t}", "cu") + "), lb AS (" + _LONG.replace("{t}", "ba") + ")"
query("a6_standardized_shift", "feature:s anomaly_mean:d4 baseline_mean:d4 deviation:d6 contribution:d6",
      _DRIFT + """, a AS (SELECT feature, AVG(value) m FROM lc GROUP BY 1), b AS (SELECT feature, AVG(value) m, STDDEV_POP(value) s FROM lb GROUP BY 1)
SELECT feature, a.m AS anomaly_mean, b.m AS baseline_mean, (a.m - b.m) / s AS deviation, ABS((a.m - b.m) / s) AS contribution FROM a JOIN b USING (feature)""")(
    lambda c: ops.standardized_shift(_recent(c), _recent(c, False), _FEATURES))


def _customer_numbers(c):
    return c.orders.groupBy("customer_id").agg(F.count("*").alias("n"), F.sum("order_total").cast("double").alias("spend"))


query("a7_mahalanobis", "customer_id:i squared_distance:d4 is_anomaly:b anomaly_score:d4 severity:s",
      """WITH k AS (SELECT customer_id, CAST(COUNT(*) AS DOUBLE) x, CAST(SUM(order_total) AS DOUBLE) y FROM ord GROUP BY 1),
s AS (SELECT AVG(x) mx, AVG(y) my, VAR_SAMP(x) vx, VAR_SAMP(y) vy, COVAR_SAMP(x, y) c FROM k),
d AS (SELECT customer_id, ((x - mx) * (x - mx) * vy - 2 * (x - mx) * (y - my) * c + (y - my) * (y - my) * vx) / (vx * vy - c * c) AS squared_distance FROM k, s)
SELECT *, squared_distance > 5.991464547107979 AS is_anomaly, squared_distance / 5.991464547107979 AS anomaly_score,
  CASE WHEN squared_distance / 5.991464547107979 > 2 THEN 'critical' WHEN squared_distance / 5.991464547107979 > 1.5 THEN 'high' WHEN squared_distance > 5.991464547107979 THEN 'medium' ELSE 'none' END AS severity FROM d""")(
    lambda c: ops.mahalanobis(_customer_numbers(c), ["n", "spend"], 5.991464547107979))
query("a8_max_abs_z", "customer_id:i is_anomaly:b anomaly_score:d4",
      """WITH k AS (SELECT customer_id, CAST(COUNT(*) AS DOUBLE) x, CAST(SUM(order_total) AS DOUBLE) y FROM ord GROUP BY 1), s AS (SELECT AVG(x) mx, AVG(y) my, STDDEV_POP(x) sx, STDDEV_POP(y) sy FROM k),
z AS (SELECT customer_id, GREATEST(ABS(x - mx) / (sx + 1e-9), ABS(y - my) / (sy + 1e-9)) z FROM k, s) SELECT customer_id, z > 3 AS is_anomaly, -z AS anomaly_score FROM z""")(
    lambda c: ops.max_abs_z(_customer_numbers(c), ["n", "spend"]))
query("a8_isolation_forest", "customer_id:i isolation_score:d4 is_anomaly:b")(lambda c: ops.isolation_forest(_customer_numbers(c), "customer_id", ["n", "spend"]))

# --- change points -----------------------------------------------------------

_SER = """
WITH RECURSIVE du AS (SELECT {k} AS series_id, order_date AS day, CAST(SUM(quantity) AS DOUBLE) u FROM itm JOIN ord USING (order_id) JOIN prod USING (product_id) GROUP BY 1, 2),
bo AS (SELECT series_id, MIN(day) a, MAX(day) b FROM du GROUP BY 1), gr AS (SELECT series_id, CAST(UNNEST(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS day FROM bo),
ts AS (SELECT series_id, day, COALESCE(u, 0) AS u, ROW_NUMBER() OVER (PARTITION BY series_id ORDER BY day) - 1 AS t, COUNT(*) OVER (PARTITION BY series_id) n FROM gr LEFT JOIN du USING (series_id, day))
"""
_CATS = _SER.replace("{k}", "category_name")


def categories(c):
    return ops.demand_series(c.order_items, c.orders, c.products, "category_name")


def _cusum(c):
    """Deviations from the series mean in deviations, so one threshold suits all series."""
    s = categories(c)
    stats = s.groupBy("series_id").agg(F.avg("units_sold").alias("m"), F.stddev_pop("units_sold").alias("sd"))
    z = s.join(stats, "series_id").select("series_id", "day", ((F.col("units_sold") - F.col("m")) / F.col("sd")).alias("z"))
    return ops.cusum(z, ["series_id"], "day", "z", threshold=0.5)


_CUSUM = _CATS + """, zz AS (SELECT series_id, day, t, (u - AVG(u) OVER (PARTITION BY series_id)) / STDDEV_POP(u) OVER (PARTITION BY series_id) z FROM ts),
cs AS (SELECT series_id, day, t, CAST(0 AS DOUBLE) AS p, CAST(0 AS DOUBLE) AS q FROM zz WHERE t = 0 UNION ALL
  SELECT zz.series_id, zz.day, zz.t, GREATEST(0, cs.p + zz.z - 0.5), LEAST(0, cs.q + zz.z + 0.5) FROM cs JOIN zz ON zz.series_id = cs.series_id AND zz.t = cs.t + 1),
cp AS (SELECT series_id, day, p AS cusum_pos, q AS cusum_neg, COALESCE((p = 0 AND LAG(p) OVER w > 0) OR (q = 0 AND LAG(q) OVER w < 0), FALSE) AS is_change_point FROM cs WINDOW w AS (PARTITION BY series_id ORDER BY t))
"""
query("cp1_cusum", "series_id:s day:t cusum_pos:d4 cusum_neg:d4 is_change_point:b", _CUSUM + "SELECT * FROM cp")(_cusum)
_TT = _CATS + """, tw AS (SELECT *, AVG(u) OVER a ma, VAR_SAMP(u) OVER a va, AVG(u) OVER b mb, VAR_SAMP(u) OVER b vb FROM ts
  WINDOW a AS (PARTITION BY series_id ORDER BY day ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING), b AS (PARTITION BY series_id ORDER BY day ROWS BETWEEN CURRENT ROW AND 29 FOLLOWING)),
tt AS (SELECT series_id, day, (ma - mb) / sqrt((29 * va + 29 * vb) / 58 * (2.0 / 30)) AS t_statistic FROM tw WHERE t >= 30 AND t < n - 30)
"""
query("cp2_sliding_t_test", "series_id:s day:t t_statistic:d4", _TT + "SELECT * FROM tt")(lambda c: ops.sliding_t_test(categories(c), ["series_id"], "day", "units_sold"))
query("cp2_sliding_ks", "series_id:s day:t ks_statistic:d4",
      _CATS + """, k AS (SELECT *, LIST(u) OVER (PARTITION BY series_id ORDER BY day ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING) a, LIST(u) OVER (PARTITION BY series_id ORDER BY day ROWS BETWEEN CURRENT ROW AND 29 FOLLOWING) b FROM ts)
SELECT series_id, day, list_max(list_transform(list_concat(a, b), lambda v: ABS(len(list_filter(a, lambda x: x <= v)) - len(list_filter(b, lambda x: x <= v))))) / 30 AS ks_statistic FROM k WHERE t >= 30 AND t < n - 30""")(
    lambda c: ops.sliding_ks(categories(c), ["series_id"], "day", "units_sold"))


def _year_starts(c):
    return categories(c).filter((F.month("day") == 1) & (F.dayofmonth("day") == 1) & (F.year("day") > 1995)).select("series_id", "day")


_EFFECT = _CATS + """, pt AS (SELECT series_id, day, t FROM ts WHERE month(day) = 1 AND day(day) = 1 AND year(day) > 1995),
ef AS (SELECT p.series_id, p.day AS change_point, AVG(s.u) FILTER (s.t < p.t) AS before_mean, AVG(s.u) FILTER (s.t >= p.t) AS after_mean, STDDEV_POP(s.u) FILTER (s.t < p.t) AS before_std, STDDEV_POP(s.u) FILTER (s.t >= p.t) AS after_std,
  VAR_SAMP(s.u) FILTER (s.t < p.t) va, VAR_SAMP(s.u) FILTER (s.t >= p.t) vb, COUNT(*) FILTER (s.t < p.t) na, COUNT(*) FILTER (s.t >= p.t) nb
  FROM pt p JOIN ts s ON s.series_id = p.series_id AND s.t >= p.t - 30 AND s.t < p.t + 30 GROUP BY 1, 2)
SELECT *, (after_mean - before_mean) / before_mean * 100 AS change_magnitude_pct, (before_mean - after_mean) / sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2) * (1 / na + 1 / nb)) AS t_statistic FROM ef"""
_EFFECT_SPEC = "series_id:s change_point:t before_mean:d4 after_mean:d4 before_std:d4 after_std:d4 change_magnitude_pct:d4 t_statistic:d4"
query("cp3_change_point_effect", _EFFECT_SPEC, _EFFECT)(lambda c: ops.change_point_effect(categories(c), _year_starts(c), ["series_id"], "day", "units_sold"))
query("cp7_rank_change_points", _EFFECT_SPEC + " magnitude_rank:i", "SELECT *, ROW_NUMBER() OVER (PARTITION BY series_id ORDER BY ABS(change_magnitude_pct) DESC, change_point) AS magnitude_rank FROM (" + _EFFECT + ")")(
    lambda c: ops.change_point_effect(categories(c), _year_starts(c), ["series_id"], "day", "units_sold").withColumn(
        "magnitude_rank", F.row_number().over(ops.W.partitionBy("series_id").orderBy(F.abs("change_magnitude_pct").desc(), "change_point"))))


def _points(c):
    """CUSUM returns and large t statistics."""
    t = ops.sliding_t_test(categories(c), ["series_id"], "day", "units_sold").filter(F.abs("t_statistic") > 2.0)
    return {"cusum": _cusum(c).filter("is_change_point"), "t_test": t}


_CONS = _CUSUM.rstrip() + _TT[len(_CATS):].rstrip() + ", cn AS (SELECT series_id, day FROM cp WHERE is_change_point INTERSECT SELECT series_id, day FROM tt WHERE ABS(t_statistic) > 2.0)"
query("cp4_consensus_points", "series_id:s day:t n_methods:i", _CONS + " SELECT *, 2 AS n_methods FROM cn")(lambda c: ops.consensus_points(_points(c), ["series_id"], "day"))
query("cp5_segments", "series_id:s segment_id:i days:i units:i first_day:t",
      _CATS + """, sg AS (SELECT *, SUM(CASE WHEN month(day) = 1 AND day(day) = 1 AND year(day) > 1995 THEN 1 ELSE 0 END) OVER (PARTITION BY series_id ORDER BY day) AS segment_id FROM ts)
SELECT series_id, segment_id, COUNT(*) AS days, SUM(u) AS units, MIN(day) AS first_day FROM sg GROUP BY 1, 2""")(
    lambda c: ops.segments(categories(c), _year_starts(c), ["series_id"], "day").groupBy("series_id", "segment_id").agg(
        F.count("*").alias("days"), F.sum("units_sold").alias("units"), F.min("day").alias("first_day")))
query("cp6_binary_segmentation", "series_id:s day:t gain:d2")(lambda c: ops.binary_segmentation(categories(c), "series_id", "day", "units_sold"))

# --- drift -------------------------------------------------------------------

query("d1_drift_baseline", "feature:s mean:d4 std:d4 min:d4 max:d4 median:d4 q25:d4 q75:d4 n_samples:i",
      _DRIFT + """ SELECT feature, AVG(value) AS mean, STDDEV_SAMP(value) AS std, MIN(value) AS "min", MAX(value) AS "max", quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.25) AS q25, quantile_cont(value, 0.75) AS q75, COUNT(*) AS n_samples FROM lb GROUP BY 1""")(
    lambda c: ops.drift_baseline(_recent(c, False), _FEATURES))
_PSI = _DRIFT + """, ed AS (SELECT feature, MIN(value) lo, MAX(value) hi, COUNT(*) nb FROM lb GROUP BY 1),
bb AS (SELECT feature, CASE WHEN value = hi THEN 9 ELSE CAST(floor((value - lo) / ((hi - lo) / 10)) AS INT) END b, COUNT(*) n FROM lb JOIN ed USING (feature) GROUP BY 1, 2),
cb AS (SELECT {p} feature, CASE WHEN value = hi THEN 9 ELSE CAST(floor((value - lo) / ((hi - lo) / 10)) AS INT) END b, COUNT(*) n FROM lc JOIN ed USING (feature) WHERE value BETWEEN lo AND hi GROUP BY ALL),
cn AS (SELECT {p} feature, COUNT(*) nc, AVG(value) cm, STDDEV_SAMP(value) cs FROM lc GROUP BY ALL HAVING COUNT(*) >= 10),
ps AS (SELECT {c} cn.feature, SUM((GREATEST(COALESCE(cb.n, 0) / nc, 0.0001) - GREATEST(COALESCE(bb.n, 0) / nb, 0.0001)) * ln(GREATEST(COALESCE(cb.n, 0) / nc, 0.0001) / GREATEST(COALESCE(bb.n, 0) / nb, 0.0001))) AS psi
  FROM cn JOIN ed USING (feature) CROSS JOIN range(10) r(b) LEFT JOIN bb ON bb.feature = cn.feature AND bb.b = r.b LEFT JOIN cb ON cb.feature = cn.feature AND cb.b = r.b {j} GROUP BY ALL),
bm AS (SELECT feature, AVG(value) bm FROM lb GROUP BY 1)
"""
_PSI1 = _PSI.replace("{p}", "").replace("{c}", "").replace("{j}", "")
_PSIM = _PSI.replace("{p}", "date_trunc('month', order_date) AS period,").replace("{c}", "cn.period,").replace("{j}", "AND cb.period = cn.period")
_SEVERITY = "CASE WHEN psi > 0.5 THEN 'high' WHEN psi > 0.2 THEN 'medium' WHEN psi > 0.1 THEN 'low' ELSE 'none' END AS drift_severity"
query("d2_psi", "feature:s psi:d6", _PSI1 + "SELECT * FROM ps")(lambda c: ops.psi(_recent(c, False), _recent(c), _FEATURES))
query("d3_statistical_drift", "feature:s baseline_mean:d4 current_mean:d4 mean_shift:d4 t_statistic:d4 psi:d6 drift_severity:s",
      _PSI1 + "SELECT feature, bm AS baseline_mean, cm AS current_mean, cm - bm AS mean_shift, (cm - bm) / (cs / sqrt(nc)) AS t_statistic, psi, " + _SEVERITY + " FROM ps JOIN cn USING (feature) JOIN bm USING (feature)")(
    lambda c: ops.statistical_drift(_recent(c, False), _recent(c), _FEATURES))
query("d4_ks_drift", "feature:s ks_statistic:d6 drift_severity:s",
      _DRIFT + """, v AS (SELECT feature, value, 1 a, 0 b FROM lb UNION ALL SELECT feature, value, 0, 1 FROM lc), g AS (SELECT feature, value, SUM(a) a, SUM(b) b FROM v GROUP BY 1, 2),
r AS (SELECT feature, SUM(a) OVER w / SUM(a) OVER (PARTITION BY feature) x, SUM(b) OVER w / SUM(b) OVER (PARTITION BY feature) y FROM g WINDOW w AS (PARTITION BY feature ORDER BY value)),
k AS (SELECT feature, MAX(ABS(x - y)) AS ks_statistic FROM r GROUP BY 1) SELECT *, CASE WHEN ks_statistic > 0.3 THEN 'high' WHEN ks_statistic > 0.15 THEN 'medium' WHEN ks_statistic > 0.05 THEN 'low' ELSE 'none' END AS drift_severity FROM k""")(
    lambda c: ops.ks_drift(_recent(c, False), _recent(c), _FEATURES))


def _monthly_drift(c):
    current = _recent(c).withColumn("period", F.trunc("order_date", "month"))
    return ops.statistical_drift(_recent(c, False), current, _FEATURES, ["period"])


_DS = _PSIM + ", sc AS (SELECT period, AVG(CASE WHEN psi > 0.5 THEN 3 WHEN psi > 0.2 THEN 2 WHEN psi > 0.1 THEN 1 ELSE 0 END) / 3 AS overall_drift_score, COUNT(*) AS n_total_features FROM ps GROUP BY 1)"
query("d5_drift_score", "overall_drift_score:d6 n_total_features:i", _PSI1 + "SELECT AVG(CASE WHEN psi > 0.5 THEN 3 WHEN psi > 0.2 THEN 2 WHEN psi > 0.1 THEN 1 ELSE 0 END) / 3 AS overall_drift_score, COUNT(*) AS n_total_features FROM ps")(
    lambda c: ops.drift_score(ops.statistical_drift(_recent(c, False), _recent(c), _FEATURES)))
query("d6_monthly_drift", "period:t overall_drift_score:d6 n_total_features:i", _DS + " SELECT * FROM sc")(lambda c: ops.drift_score(_monthly_drift(c), ["period"]))
query("d7_drift_alerts", "period:t overall_drift_score:d6 alert_triggered:b alert_level:s",
      _DS + " SELECT *, overall_drift_score > 0.3 AS alert_triggered, CASE WHEN overall_drift_score > 0.5 THEN 'critical' WHEN overall_drift_score > 0.3 THEN 'warning' ELSE 'none' END AS alert_level FROM sc")(
    lambda c: ops.drift_alert(ops.drift_score(_monthly_drift(c), ["period"])))

# --- forecasts ---------------------------------------------------------------

_F1 = """
WITH du AS (SELECT {k} AS series_id, order_date AS day, SUM(quantity) u, SUM(quantity * unit_price) r FROM itm JOIN ord USING (order_id) JOIN prod USING (product_id) GROUP BY 1, 2),
bo AS (SELECT series_id, MIN(day) a, MAX(day) b FROM du GROUP BY 1), gr AS (SELECT series_id, CAST(UNNEST(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS day FROM bo),
ts AS (SELECT series_id, day, COALESCE(u, 0) AS units_sold, COALESCE(r, 0) AS revenue_inr, ROW_NUMBER() OVER (PARTITION BY series_id ORDER BY day DESC) k, ROW_NUMBER() OVER (PARTITION BY series_id ORDER BY day) - 1 AS t, b AS last_day, COUNT(*) OVER (PARTITION BY series_id) n
  FROM gr LEFT JOIN du USING (series_id, day) JOIN bo USING (series_id))
"""
_F1C, _F1P = _F1.replace("{k}", "category_name"), _F1.replace("{k}", "CAST(product_id AS VARCHAR)")
query("f1_demand_series", "series_id:s day:t units_sold:i revenue_inr:d2", _F1C + "SELECT * FROM ts")(categories)


def product_series(c):
    return ops.demand_series(c.order_items, c.orders, c.products, "product_id")


_H = "CROSS JOIN range(1, 31) h(step)"
query("f2_moving_average", "series_id:s step:i day:t forecast:d4",
      _F1P + f", m AS (SELECT series_id, ANY_VALUE(last_day) l, (AVG(units_sold) FILTER (k <= 7 OR n < 7) + AVG(units_sold) FILTER (k <= 14 OR n < 14) + AVG(units_sold) FILTER (k <= 28 OR n < 28)) / 3 AS forecast FROM ts GROUP BY 1) SELECT series_id, step, l + CAST(step AS INT) AS day, forecast FROM m {_H}")(
    lambda c: ops.forecast_moving_average(product_series(c), 30))
_SES = _F1C.replace("WITH du", "WITH RECURSIVE du", 1) + """, al AS (SELECT UNNEST([0.2, 0.5, 0.8]) AS a),
se AS (SELECT series_id, a, t, CAST(units_sold AS DOUBLE) AS level, CAST(0 AS DOUBLE) AS err, 0 AS m FROM ts, al WHERE t = 0 UNION ALL
  SELECT se.series_id, a, ts.t, a * units_sold + (1 - a) * level, CASE WHEN units_sold <> 0 THEN err + ABS((units_sold - level) / units_sold) ELSE err END, CASE WHEN units_sold <> 0 THEN m + 1 ELSE m END FROM se JOIN ts ON ts.series_id = se.series_id AND ts.t = se.t + 1),
fi AS (SELECT se.series_id, a AS alpha, level AS forecast, 100 * err / m AS in_sample_mape, l FROM se JOIN (SELECT series_id, MAX(t) mt, MAX(day) l FROM ts GROUP BY 1) x ON x.series_id = se.series_id AND x.mt = se.t
  QUALIFY ROW_NUMBER() OVER (PARTITION BY se.series_id ORDER BY 100 * err / m, a) = 1)
"""
query("f3_exponential_smoothing", "series_id:s step:i day:t forecast:d4 alpha:d2 in_sample_mape:d4", _SES + f"SELECT *, l + CAST(step AS INT) AS day FROM fi {_H}")(lambda c: ops.forecast_smoothing(categories(c), 30))
query("f4_seasonal_naive", "series_id:s step:i day:t forecast:d4",
      _F1P + f", l AS (SELECT series_id, k, units_sold, last_day, LEAST(7, n) p FROM ts WHERE k <= LEAST(7, n)) SELECT series_id, step, last_day + CAST(step AS INT) AS day, units_sold AS forecast FROM l {_H} WHERE k = p - (step - 1) % p")(
    lambda c: ops.forecast_seasonal_naive(product_series(c), 30))
_LAGS = (3, 7, 14, 28)
query("f5_calendar_lag_features", "series_id:s day:t units_sold:i t:i dow:i dom:i week:i month:i quarter:i year:i is_weekend:i " + " ".join(f"lag_{k}:d4 ma_{k}:d4" for k in _LAGS),
      _F1C + ", lg AS (SELECT *, " + ", ".join(f"LAG(units_sold, {k}) OVER w AS l{k}, AVG(units_sold) OVER (PARTITION BY series_id ORDER BY day ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING) AS m{k}" for k in _LAGS)
      + " FROM ts WINDOW w AS (PARTITION BY series_id ORDER BY day)) SELECT *, isodow(day) - 1 AS dow, day(day) AS dom, weekofyear(day) AS week, month(day) AS month, quarter(day) AS quarter, year(day) AS year, CASE WHEN isodow(day) >= 6 THEN 1 ELSE 0 END AS is_weekend, "
      + ", ".join(f"COALESCE(FIRST_VALUE(l{k} IGNORE NULLS) OVER f, 0) AS lag_{k}, COALESCE(FIRST_VALUE(m{k} IGNORE NULLS) OVER f, 0) AS ma_{k}" for k in _LAGS)
      + " FROM lg WINDOW f AS (PARTITION BY series_id ORDER BY day ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)")(
    lambda c: ops.calendar_lag_features(categories(c)))
query("f6_tree_ensemble", "series_id:s step:i day:t forecast:d4")(lambda c: ops.forecast_trees(categories(c), 30))
_CVF = _F1C + """, fo AS (SELECT ts.*, f, n - (3 - f) * 30 AS st FROM ts, range(3) r(f)),
tr AS (SELECT series_id, f, day, units_sold, ROW_NUMBER() OVER (PARTITION BY series_id, f ORDER BY day DESC) kk FROM fo WHERE t < st),
ma AS (SELECT series_id, f, 'Moving Average' AS model, CAST(NULL AS BIGINT) AS p, (AVG(units_sold) FILTER (kk <= 7) + AVG(units_sold) FILTER (kk <= 14) + AVG(units_sold) FILTER (kk <= 28)) / 3 AS v FROM tr GROUP BY 1, 2),
sn AS (SELECT series_id, f, 'Seasonal Naive' AS model, 7 - kk AS p, CAST(units_sold AS DOUBLE) AS v FROM tr WHERE kk <= 7),
pr AS (SELECT fo.series_id, fo.f AS fold, fo.day, fo.units_sold, m.model, m.v AS forecast FROM fo JOIN (SELECT * FROM ma UNION ALL SELECT * FROM sn) m ON m.series_id = fo.series_id AND m.f = fo.f AND (m.p IS NULL OR m.p = (fo.t - fo.st) % 7) WHERE fo.t >= fo.st AND fo.t < fo.st + 30),
pe AS (SELECT series_id, model, fold, AVG(ABS(units_sold - forecast)) mae, sqrt(AVG((units_sold - forecast) * (units_sold - forecast))) rmse, AVG(ABS((units_sold - forecast) / units_sold)) FILTER (units_sold <> 0) * 100 mape FROM pr GROUP BY 1, 2, 3),
cv AS (SELECT series_id, model, AVG(mae) AS mae_mean, STDDEV_POP(mae) AS mae_std, AVG(rmse) AS rmse_mean, STDDEV_POP(rmse) AS rmse_std, AVG(mape) AS mape_mean, STDDEV_POP(mape) AS mape_std, COUNT(*) AS n_splits FROM pe GROUP BY 1, 2)
"""
_CV_SPEC = "series_id:s mae_mean:d4 mae_std:d4 rmse_mean:d4 rmse_std:d4 mape_mean:d4 mape_std:d4 n_splits:i"
query("f7_cross_validation", _CV_SPEC, _CVF + "SELECT * FROM cv WHERE model = 'Moving Average'")(lambda c: ops.cross_validation_metrics(ops.cross_validate(categories(c), "Moving Average")))
query("f8_forecast_errors", "series_id:s fold:i mae:d4 rmse:d4 mape:d4", _CVF + "SELECT * FROM pe WHERE model = 'Seasonal Naive'")(
    lambda c: ops.accuracy(ops.cross_validate(categories(c), "Seasonal Naive"), "units_sold", "forecast", ["series_id", "fold"]))


def _overall(c):
    return ops.demand_series(c.order_items, c.orders)


query("f9_compare_models", _CV_SPEC + " model:s is_best:b")(lambda c: ops.compare_models(_overall(c)))
query("f9_best_forecast", "series_id:s model:s step:i day:t forecast:d4")(lambda c: ops.forecast_best(categories(c), ops.compare_models(categories(c))))


def _brand_forecasts(c):
    series = ops.demand_series(c.order_items, c.orders, c.products.withColumn("leaf", F.concat_ws("/", "category_name", "brand_name")), "leaf")
    return ops.trend_season_forecast(series, 14)


_TS = """
WITH du AS (SELECT {k} AS series_id, order_date AS day, SUM(quantity) u FROM itm JOIN ord USING (order_id) JOIN prod USING (product_id) GROUP BY 1, 2),
bo AS (SELECT series_id, MIN(day) a, MAX(day) b FROM du GROUP BY 1), gr AS (SELECT series_id, CAST(UNNEST(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS day FROM bo),
ts AS (SELECT series_id, day, COALESCE(u, 0) AS y, ROW_NUMBER() OVER (PARTITION BY series_id ORDER BY day) - 1 AS t FROM gr LEFT JOIN du USING (series_id, day)),
li AS (SELECT series_id, REGR_SLOPE(y, t) b, AVG(y) my, AVG(t) mt, MAX(t) lt, MAX(day) l FROM ts GROUP BY 1),
re AS (SELECT series_id, t % 7 ph, y - (my + b * (t - mt)) r FROM ts JOIN li USING (series_id)), ef AS (SELECT series_id, ph, AVG(r) s FROM re GROUP BY 1, 2),
sp AS (SELECT series_id, STDDEV_SAMP(r - s) sd FROM re JOIN ef USING (series_id, ph) GROUP BY 1),
fc AS (SELECT li.series_id, l + CAST(step AS INT) AS day, my + b * (lt + step - mt) + s AS yhat, sd FROM li JOIN sp USING (series_id) CROSS JOIN range(1, 15) h(step) JOIN ef ON ef.series_id = li.series_id AND ef.ph = (lt + step) % 7),
fb AS (SELECT series_id, day, yhat, yhat - 1.2815515655446004 * sd AS yhat_lower, yhat + 1.2815515655446004 * sd AS yhat_upper FROM fc)
"""
query("f10_bottom_up", "level:s node:s day:t yhat:d4 yhat_lower:d4 yhat_upper:d4",
      _TS.replace("{k}", "category_name || '/' || brand_name") + """SELECT 'leaf' AS level, series_id AS node, day, yhat, yhat_lower, yhat_upper FROM fb
UNION ALL SELECT 'parent', split_part(series_id, '/', 1), day, SUM(yhat), SUM(yhat_lower), SUM(yhat_upper) FROM fb GROUP BY 2, 3 UNION ALL SELECT 'total', 'all', day, SUM(yhat), SUM(yhat_lower), SUM(yhat_upper) FROM fb GROUP BY 3""")(
    lambda c: (lambda f: ops.bottom_up(f, f.select("series_id", F.split_part("series_id", F.lit("/"), F.lit(1)).alias("parent")).distinct()))(_brand_forecasts(c)))
query("f11_top_down", "parent:s series_id:s day:t share:d6 yhat:d4 yhat_lower:d4 yhat_upper:d4",
      _TS.replace("{k}", "category_name") + """, hh AS (SELECT category_name AS parent, brand_name AS child, SUM(quantity) u FROM itm JOIN ord USING (order_id) JOIN prod USING (product_id) GROUP BY 1, 2),
sh AS (SELECT parent, child, u / SUM(u) OVER (PARTITION BY parent) AS share FROM hh) SELECT parent, child AS series_id, day, share, yhat * share AS yhat, yhat_lower * share AS yhat_lower, yhat_upper * share AS yhat_upper FROM fb JOIN sh ON parent = fb.series_id""")(
    lambda c: ops.top_down(ops.trend_season_forecast(categories(c), 14), c.order_items.join(c.orders.select("order_id"), "order_id").join(c.products, "product_id").groupBy(
        F.col("category_name").alias("parent"), F.col("brand_name").alias("series_id")).agg(F.sum("quantity").alias("units"))))
query("f12_forecast_accuracy", "series_id:s mae:d4 rmse:d4 mape:d4 smape:d4 n_observations:i",
      _CVF + """SELECT series_id, AVG(ABS(units_sold - forecast)) AS mae, sqrt(AVG((units_sold - forecast) * (units_sold - forecast))) AS rmse, AVG(ABS((units_sold - forecast) / units_sold)) FILTER (units_sold <> 0) * 100 AS mape,
  AVG(2 * ABS(units_sold - forecast) / NULLIF(ABS(units_sold) + ABS(forecast), 0)) * 100 AS smape, COUNT(*) AS n_observations FROM pr WHERE model = 'Seasonal Naive' GROUP BY 1""")(
    lambda c: ops.accuracy(ops.cross_validate(categories(c), "Seasonal Naive"), "units_sold", "forecast", ["series_id"]))
query("f13_interval_summary", "series_id:s mean_forecast:d4 forecast_std:d4 mean_interval_width:d4 mean_uncertainty_cv:d4",
      _TS.replace("{k}", "category_name") + "SELECT series_id, AVG(yhat) AS mean_forecast, STDDEV_SAMP(yhat) AS forecast_std, AVG(yhat_upper - yhat_lower) AS mean_interval_width, AVG((yhat_upper - yhat_lower) / (2 * yhat)) AS mean_uncertainty_cv FROM fb GROUP BY 1")(
    lambda c: ops.interval_summary(ops.trend_season_forecast(categories(c), 14)))
query("f15_arima", "series_id:s step:i day:t forecast:d2")(lambda c: ops.forecast_arima(categories(c), 30))
