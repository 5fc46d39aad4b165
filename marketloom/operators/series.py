"""Daily series: anomalies, change points, drift, forecasts.

Series are aggregated to one row per key and calendar day before any ordered
window, so a window never holds more rows than there are days.  Row-level
inputs (drift, multi-dimensional anomalies) use aggregates and the
range-partitioned quantiles instead.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marketloom.functions.calendar import fill_days
from marketloom.functions.dist import t_two_sided
from marketloom.functions.exprs import n_rows, or_zero, with_lookup, with_one_row
from marketloom.functions.ml import fit_cached
from marketloom.functions.ordered import materialize, quantiles, running_totals
from marketloom.operators.quality import unpivot_numbers


# --- anomalies ---------------------------------------------------------------


def long_kpis(daily: DataFrame, day: str, kpis: Sequence[str]) -> DataFrame:
    """(kpi, day, value) rows; a missing value is 0."""
    return unpivot_numbers(daily, kpis, [day]).select(
        F.col("feature").alias("kpi"), F.col(day).alias("day"), F.coalesce("value", F.lit(0.0)).alias("value"))


def statistical_anomalies(series: DataFrame, window: int = 28, z_limit: float = 3.0, k: float = 3.0) -> DataFrame:
    """Global z, quartile fence and rolling z per kpi series with direction, severity and label."""
    v = F.col("value")
    stats = series.groupBy("kpi").agg(
        F.avg(v).alias("m"), F.stddev_pop(v).alias("s"), F.percentile(v, 0.25).alias("q1"), F.percentile(v, 0.75).alias("q3"))
    w = W.partitionBy("kpi").orderBy("day").rowsBetween(-(window - 1), 0)
    enough = F.count(v).over(w) >= 5
    rolled = series.withColumn("rolling_mean", F.when(enough, F.avg(v).over(w))).withColumn(
        "_rs", F.coalesce(F.when(enough, F.stddev_samp(v).over(w)), F.lit(1.0)))
    out = rolled.join(stats, "kpi")
    sd = F.when(F.col("s") == 0, 1.0).otherwise(F.col("s"))
    z = F.abs((v - F.col("m")) / sd)
    rz = F.when(F.col("_rs") > 0, F.abs(v - F.col("rolling_mean")) / F.col("_rs")).otherwise(0.0)
    low, high = F.col("q1") - k * (F.col("q3") - F.col("q1")), F.col("q3") + k * (F.col("q3") - F.col("q1"))
    out = out.select(
        "kpi", "day", "value", z.alias("zscore"), rz.alias("rolling_zscore"), low.alias("iqr_lower"), high.alias("iqr_upper"), "rolling_mean",
        (z > z_limit).alias("anomaly_z"), ((v < low) | (v > high)).alias("anomaly_iqr"), F.coalesce(rz > z_limit, F.lit(False)).alias("anomaly_rolling"),
    )
    flagged = F.col("anomaly_z") | F.col("anomaly_iqr") | F.col("anomaly_rolling")
    return out.select(
        "*", flagged.alias("is_anomaly"), F.when(v > F.col("rolling_mean"), "spike").otherwise("drop").alias("direction"),
        F.when(F.col("zscore") <= 2, "low").when(F.col("zscore") <= 3, "medium").when(F.col("zscore") <= 4, "high").otherwise("critical").alias("severity"),
    ).withColumn("anomaly_label", F.when(~F.col("is_anomaly"), "Normal").when(F.col("direction") == "drop", "Drop").otherwise("Spike"))


def root_cause_hints(daily: DataFrame, day: str, kpis: Sequence[str], moved: float = 0.35, top: int = 3) -> DataFrame:
    """Per day the KPIs furthest from the median of the preceding 28 rows."""
    series = long_kpis(daily, day, kpis)
    w = W.partitionBy("kpi").orderBy("day").rowsBetween(-29, -2)
    base = F.percentile("value", 0.5).over(w)
    out = series.withColumn("baseline", base).withColumn("_n", F.count("value").over(w)).filter(F.col("_n") >= 2)
    change = (F.col("value") - F.col("baseline")) / (F.abs("baseline") + 1e-9)
    out = out.withColumn("change", change).filter(F.abs("change") > moved)
    rank = F.row_number().over(W.partitionBy("day").orderBy(F.abs("change").desc(), "kpi"))  # one row per kpi
    return out.withColumn("hint_rank", rank).filter(F.col("hint_rank") <= top).select("day", "hint_rank", "kpi", "value", "baseline", (F.col("change") * 100).alias("change_pct"))


def anomaly_alerts(anomalies: DataFrame, last: int = 20) -> DataFrame:
    """The last anomalies per kpi with severity score, change and action."""
    found = anomalies.filter("is_anomaly")
    recent = found.withColumn("_r", F.row_number().over(W.partitionBy("kpi").orderBy(F.col("day").desc()))).filter(F.col("_r") <= last)
    score = F.when(F.col("severity") == "critical", 4).when(F.col("severity") == "high", 3).when(F.col("severity") == "medium", 2).otherwise(1)
    base = or_zero("rolling_mean")
    return recent.select(
        "kpi", "day", "anomaly_label", "severity", score.alias("severity_score"), "value", base.alias("baseline_28d"),
        ((F.col("value") - base) / (F.abs(base) + 1e-9) * 100).alias("change_pct"),
        F.when(score == 4, "Investigate immediately + notify ops").when(score == 3, "Investigate cause within 48 hrs").otherwise("Monitor + flag for weekly review").alias("recommended_action"),
    )


def baseline_stats(series: DataFrame, window: int = 30) -> DataFrame:
    """Mean, deviation, quartiles, last rolling values and fences per kpi."""
    v = F.col("value")
    w = W.partitionBy("kpi").orderBy("day").rowsBetween(-(window - 1), 0)
    full = F.count(v).over(w) == window
    rolled = series.withColumn("_m", F.when(full, F.avg(v).over(w))).withColumn("_s", F.when(full, F.stddev_samp(v).over(w)))
    agg = rolled.groupBy("kpi").agg(
        F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.percentile(v, 0.5).alias("median"), F.percentile(v, 0.25).alias("q25"),
        F.percentile(v, 0.75).alias("q75"), F.min(v).alias("min"), F.max(v).alias("max"), F.max_by("_m", "day").alias("rolling_mean"), F.max_by("_s", "day").alias("rolling_std"))
    iqr = F.col("q75") - F.col("q25")
    return agg.select("*", iqr.alias("iqr"), (F.col("q25") - 1.5 * iqr).alias("lower_bound"), (F.col("q75") + 1.5 * iqr).alias("upper_bound"))


def point_anomalies(df: DataFrame, value: str, method: str = "zscore", threshold: float = 3.0) -> DataFrame:
    """Anomalous rows by z-score, quartile fence or median deviation, with severity.

    Works on any number of rows: statistics are scalar subqueries, quantiles
    are computed on range-partitioned values.
    """
    v = F.col(value).cast("double")
    if method == "zscore":
        out = with_one_row(df, df.agg(F.avg(v).alias("m"), F.stddev_pop(v).alias("s")), "_st")
        score = F.abs(or_zero(F.try_divide(v - F.col("_st.m"), F.col("_st.s"))))
        flag = score > threshold
    elif method == "iqr":
        out = with_one_row(df, quantiles(df, value, {"a": 0.25, "b": 0.75}), "_st")
        spread = F.col("_st.b") - F.col("_st.a")
        low, high = F.col("_st.a") - 1.5 * spread, F.col("_st.b") + 1.5 * spread
        flag = (v < low) | (v > high)
        score = F.when(v < low, (low - v) / (high - low)).when(v > high, (v - high) / (high - low)).otherwise(0.0)
    elif method == "modified_zscore":
        median = quantiles(df, value, {"m": 0.5}).select("m").scalar()
        away = df.withColumn("_med", median).withColumn("_d", F.abs(v - F.col("_med")))
        out = away.withColumn("_mad", quantiles(away, "_d", {"m": 0.5}).select("m").scalar())
        score = F.abs(F.when(F.col("_mad") > 0, 0.6745 * (v - F.col("_med")) / F.col("_mad")).otherwise(0.0))
        flag = score > threshold
    else:
        raise ValueError(f"unknown method {method}")
    out = out.withColumn("anomaly_score", score).withColumn("is_anomaly", flag)
    return out.select(*df.columns, "anomaly_score", "is_anomaly", F.when(F.col("anomaly_score") > threshold * 2, "critical").when(
        F.col("anomaly_score") > threshold * 1.5, "high").when(F.col("is_anomaly"), "medium").otherwise("none").alias("severity"))


def standardized_shift(current: DataFrame, baseline: DataFrame, features: Sequence[str], top: int = 5) -> DataFrame:
    """Mean shift in baseline deviations per feature, largest first."""
    a = unpivot_numbers(current, features).groupBy("feature").agg(F.avg("value").alias("anomaly_mean"))
    b = unpivot_numbers(baseline, features).groupBy("feature").agg(F.avg("value").alias("baseline_mean"), F.stddev_pop("value").alias("_s"))
    d = F.when(F.col("_s") > 0, (F.col("anomaly_mean") - F.col("baseline_mean")) / F.col("_s")).otherwise(0.0)
    out = a.join(b, "feature").select("feature", "anomaly_mean", "baseline_mean", d.alias("deviation"), F.abs(d).alias("contribution"))
    return out.orderBy(F.col("contribution").desc(), "feature").limit(top)


def mahalanobis(df: DataFrame, features: Sequence[str], chi2_limit: float) -> DataFrame:
    """Squared distance from the mean under the sample covariance against a chi-squared limit.

    The covariance is one aggregate; only its k x k inverse is formed on the driver.
    """
    k = len(features)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    row = df.agg(
        *[F.avg(F.col(c).cast("double")).alias(f"m{i}") for i, c in enumerate(features)],
        *[F.covar_samp(F.col(features[i]).cast("double"), F.col(features[j]).cast("double")).alias(f"c{i}_{j}") for i, j in pairs],
    ).first()
    cov = np.zeros((k, k))
    for i, j in pairs:
        cov[i, j] = cov[j, i] = row[f"c{i}_{j}"]
    if np.linalg.det(cov) == 0:
        cov += np.eye(k) * 1e-6
    inverse = np.linalg.inv(cov)
    diff = [F.col(c).cast("double") - F.lit(float(row[f"m{i}"])) for i, c in enumerate(features)]
    terms = [diff[i] * diff[j] * float(inverse[i, j] * (1 if i == j else 2)) for i, j in pairs]
    out = df.withColumn("squared_distance", reduce(lambda a, b: a + b, terms))
    score = F.col("squared_distance") / chi2_limit
    return out.select("*", (score > 1).alias("is_anomaly"), score.alias("anomaly_score"), F.when(score > 2, "critical").when(score > 1.5, "high").when(score > 1, "medium").otherwise("none").alias("severity"))


def max_abs_z(df: DataFrame, features: Sequence[str], limit: float = 3.0) -> DataFrame:
    """Largest absolute z over the features; anomalous above the limit."""
    stats = df.agg(*[x for c in features for x in (F.avg(F.col(c).cast("double")).alias(f"m_{c}"), F.stddev_pop(F.col(c).cast("double")).alias(f"s_{c}"))])
    out = with_one_row(df, stats, "_st")
    z = F.greatest(*[F.abs((F.col(c).cast("double") - F.col(f"_st.m_{c}")) / (F.col(f"_st.s_{c}") + 1e-9)) for c in features])
    return out.select(*df.columns, (z > limit).alias("is_anomaly"), (-z).alias("anomaly_score"))


def isolation_forest(df: DataFrame, key: str, features: Sequence[str], trees: int = 50, sample: int = 256, contamination: float = 0.05) -> DataFrame:
    """Isolation scores from small random trees.

    Each tree is grown from a hash-chosen sample of bounded size; the trees are
    broadcast and every row is scored where it lies.  The cut-off is the exact
    quantile of the scores.
    """
    n = max(df.count(), 1)
    numbers = df.select(key, *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in features])
    # every tree draws its own rows by hash, about twice the sample, and keeps `sample` of them
    draws, share = 1 << 40, min(1.0, 2.0 * sample / n)
    drawn = lambda t: F.pmod(F.xxhash64(t, key), F.lit(draws)) < int(share * draws)
    members = numbers.select("*", F.explode(F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), drawn)).alias("_tree"))
    order = F.row_number().over(W.partitionBy("_tree").orderBy(F.xxhash64(F.lit(13), "_tree", key), key))
    sampled = members.withColumn("_k", order).filter(F.col("_k") <= sample)
    cols = list(features)

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        rng = np.random.default_rng(int(pdf["_tree"].iloc[0]) + 42)
        x = pdf[cols].to_numpy(float)
        limit = int(np.ceil(np.log2(max(len(x), 2))))
        nodes: list[list[float]] = []

        def split(rows: np.ndarray, depth: int) -> int:
            node = len(nodes)
            nodes.append([-1.0, 0.0, -1.0, -1.0, float(depth) + _average_path(len(rows))])
            spread = [c for c in range(x.shape[1]) if len(rows) > 1 and x[rows, c].min() < x[rows, c].max()]
            if depth < limit and spread:
                c = int(rng.choice(spread))
                cut = float(rng.uniform(x[rows, c].min(), x[rows, c].max()))
                left = rows[x[rows, c] < cut]
                right = rows[x[rows, c] >= cut]
                if len(left) and len(right):
                    nodes[node][:4] = [float(c), cut, float(split(left, depth + 1)), float(split(right, depth + 1))]
            return node

        split(np.arange(len(x)), 0)
        return pd.DataFrame({"tree": int(pdf["_tree"].iloc[0]), "size": len(x), "nodes": [[list(map(float, r)) for r in nodes]]})

    forest = sampled.groupBy("_tree").applyInPandas(grow, "tree int, size int, nodes array<array<double>>").collect()  # bounded by trees x sample
    model = [(t["size"], np.array(t["nodes"])) for t in sorted(forest, key=lambda t: t["tree"])]
    shared = df.sparkSession.sparkContext.broadcast(model)
    scale = _average_path(float(np.mean([s for s, _ in model]))) or 1.0

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = pdf[cols].to_numpy(float)
            total = np.zeros(len(x))
            for _, nodes in shared.value:
                at = np.zeros(len(x), dtype=int)
                while True:
                    feature = nodes[at, 0].astype(int)
                    inner = feature >= 0
                    if not inner.any():
                        break
                    left = x[np.arange(len(x)), np.maximum(feature, 0)] < nodes[at, 1]
                    at = np.where(inner, np.where(left, nodes[at, 2], nodes[at, 3]).astype(int), at)
                total += nodes[at, 4]
            yield pdf.assign(isolation_score=2.0 ** (-(total / len(shared.value)) / scale))[[key, "isolation_score"]]

    scored = numbers.mapInPandas(score, f"`{key}` {dict(numbers.dtypes)[key]}, isolation_score double")
    cut = quantiles(scored, "isolation_score", {"q": 1 - contamination}).select("q").scalar()
    return scored.withColumn("_cut", cut).select(key, "isolation_score", (F.col("isolation_score") > F.col("_cut")).alias("is_anomaly"))


def _average_path(n: float) -> float:
    if n <= 1:
        return 0.0
    return 2.0 * (np.log(n - 1) + 0.5772156649) - 2.0 * (n - 1) / n if n > 2 else 1.0


# --- change points -----------------------------------------------------------


def cusum(series: DataFrame, keys: Sequence[str], time: str, value: str, threshold: float = 5.0, drift: float = 0.0) -> DataFrame:
    """Two-sided CUSUM with reset; a change point is a return to zero.

    The reset recursion equals the running sum less its running minimum, so two
    windows replace the loop.  The first row of a series starts at zero.
    """
    w = W.partitionBy(*keys).orderBy(time)
    run = w.rowsBetween(W.unboundedPreceding, 0)
    x = F.col(value).cast("double")
    first = F.row_number().over(w) == 1
    out = series.withColumn("_up", F.when(first, 0.0).otherwise(x - drift - threshold)).withColumn("_dn", F.when(first, 0.0).otherwise(x - drift + threshold))
    out = out.withColumn("_pu", F.sum("_up").over(run)).withColumn("_pd", F.sum("_dn").over(run))
    out = out.withColumn("cusum_pos", F.col("_pu") - F.min("_pu").over(run)).withColumn("cusum_neg", F.col("_pd") - F.max("_pd").over(run))
    tiny = 1e-9
    back = ((F.col("cusum_pos") <= tiny) & (F.lag("cusum_pos").over(w) > tiny)) | ((F.col("cusum_neg") >= -tiny) & (F.lag("cusum_neg").over(w) < -tiny))
    return out.select(*series.columns, "cusum_pos", "cusum_neg", F.coalesce(back, F.lit(False)).alias("is_change_point"))


def _welch_free_t(na: Column, ma: Column, va: Column, nb: Column, mb: Column, vb: Column) -> tuple[Column, Column]:
    """Pooled two-sample t statistic and its degrees of freedom."""
    dof = na + nb - 2
    pooled = F.try_divide((na - 1) * va + (nb - 1) * vb, dof)
    return F.try_divide(ma - mb, F.sqrt(pooled * (1 / na + 1 / nb))), dof


def sliding_t_test(series: DataFrame, keys: Sequence[str], time: str, value: str, window: int = 30, alpha: float = 0.05) -> DataFrame:
    """t-test of the ``window`` rows before against the ``window`` rows from each row on."""
    w = W.partitionBy(*keys).orderBy(time)
    before, after = w.rowsBetween(-window, -1), w.rowsBetween(0, window - 1)
    x = F.col(value).cast("double")
    out = series.select(
        *series.columns, F.count(x).over(before).alias("_na"), F.avg(x).over(before).alias("_ma"), F.var_samp(x).over(before).alias("_va"),
        F.count(x).over(after).alias("_nb"), F.avg(x).over(after).alias("_mb"), F.var_samp(x).over(after).alias("_vb"), F.lead(x, window).over(w).alias("_more"))
    t, dof = _welch_free_t(*[F.col(c) for c in ("_na", "_ma", "_va", "_nb", "_mb", "_vb")])
    inside = (F.col("_na") == window) & F.col("_more").isNotNull()
    tested = out.filter(inside).select(*series.columns, t.alias("t_statistic"), dof.alias("_dof"))
    tested = tested.withColumn("p_value", t_two_sided("t_statistic", "_dof")).drop("_dof")
    return tested.withColumn("is_change_point", F.col("p_value") < alpha)


def sliding_ks(series: DataFrame, keys: Sequence[str], time: str, value: str, window: int = 30) -> DataFrame:
    """Two-sample KS distance of the rows before and after each row.

    The two frames are arrays of ``window`` values; the distance is the largest
    gap between their step functions at any value of either frame.
    """
    w = W.partitionBy(*keys).orderBy(time)
    x = F.col(value).cast("double")
    out = series.select(
        *series.columns, F.collect_list(x).over(w.rowsBetween(-window, -1)).alias("_a"), F.collect_list(x).over(w.rowsBetween(0, window - 1)).alias("_b"), F.lead(x, window).over(w).alias("_more"))
    below = lambda arr, v: F.size(F.filter(arr, lambda u: u <= v))
    gap = F.array_max(F.transform(F.concat("_a", "_b"), lambda v: F.abs(below(F.col("_a"), v) - below(F.col("_b"), v))))
    return out.filter((F.size("_a") == window) & F.col("_more").isNotNull()).select(*series.columns, (gap / window).alias("ks_statistic"))


def change_point_effect(series: DataFrame, points: DataFrame, keys: Sequence[str], time: str, value: str, window: int = 30) -> DataFrame:
    """Before/after mean, deviation, change and t-test around each point.

    ``points`` holds ``keys`` and ``time``.  Rows are numbered per series and a
    point meets only its own ``2 x window`` rows through the shared row number.
    """
    w = W.partitionBy(*keys).orderBy(time)
    numbered = series.withColumn("_i", F.row_number().over(w))
    marked = points.select(*keys, F.col(time)).join(numbered.select(*keys, time, "_i"), [*keys, time]).select(*keys, F.col(time).alias("change_point"), F.col("_i").alias("_c"))
    spread = marked.select("*", F.explode(F.sequence(F.lit(-window), F.lit(window - 1))).alias("_o")).withColumn("_i", F.col("_c") + F.col("_o"))
    near = spread.join(numbered.select(*keys, "_i", F.col(value).cast("double").alias("v")), [*keys, "_i"])
    a, b = F.col("_o") < 0, F.col("_o") >= 0
    pick = lambda c: F.when(c, F.col("v"))
    agg = near.groupBy(*keys, "change_point").agg(
        F.avg(pick(a)).alias("before_mean"), F.avg(pick(b)).alias("after_mean"), F.stddev_pop(pick(a)).alias("before_std"), F.stddev_pop(pick(b)).alias("after_std"),
        F.count(pick(a)).alias("_na"), F.count(pick(b)).alias("_nb"), F.var_samp(pick(a)).alias("_va"), F.var_samp(pick(b)).alias("_vb"))
    t, dof = _welch_free_t(F.col("_na"), F.col("before_mean"), F.col("_va"), F.col("_nb"), F.col("after_mean"), F.col("_vb"))
    change = or_zero(F.try_divide(F.col("after_mean") - F.col("before_mean"), F.col("before_mean"))) * 100
    out = agg.select(*keys, "change_point", "before_mean", "after_mean", "before_std", "after_std", change.alias("change_magnitude_pct"), t.alias("t_statistic"), dof.alias("_dof"))
    return out.withColumn("p_value", t_two_sided("t_statistic", "_dof")).drop("_dof").withColumn("is_significant", F.col("p_value") < 0.05)


def consensus_points(methods: Mapping[str, DataFrame], keys: Sequence[str], time: str, at_least: int = 2) -> DataFrame:
    """Points reported by at least two of the methods."""
    parts = [df.select(*keys, time).withColumn("method", F.lit(m)) for m, df in methods.items()]
    found = reduce(lambda a, b: a.unionByName(b), parts).distinct()
    return found.groupBy(*keys, time).agg(n_rows().alias("n_methods")).filter(F.col("n_methods") >= at_least)


def segments(series: DataFrame, points: DataFrame, keys: Sequence[str], time: str) -> DataFrame:
    """Number the stretches between change points."""
    flags = points.select(*keys, time).distinct().withColumn("_cp", F.lit(1))
    w = W.partitionBy(*keys).orderBy(time).rowsBetween(W.unboundedPreceding, 0)
    return series.join(flags, [*keys, time], "left").withColumn("segment_id", F.sum(or_zero("_cp")).over(w)).drop("_cp")


def binary_segmentation(series: DataFrame, key: str, time: str, value: str, n_points: int = 3, min_size: int = 10) -> DataFrame:
    """Best splits by squared error, one calendar-bounded series per call."""
    def split(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(time).reset_index(drop=True)
        y = pdf[value].to_numpy(float)
        s, q = np.concatenate([[0], np.cumsum(y)]), np.concatenate([[0], np.cumsum(y * y)])

        def cost(a: int, b) -> np.ndarray:
            return q[b] - q[a] - (s[b] - s[a]) ** 2 / np.maximum(np.asarray(b) - a, 1)

        def best(a: int, b: int) -> tuple[float, int]:
            cuts = np.arange(a + min_size, b - min_size + 1)
            if len(cuts) == 0:
                return 0.0, -1
            right = q[b] - q[cuts] - (s[b] - s[cuts]) ** 2 / (b - cuts)
            gain = cost(a, np.array(b)) - (cost(a, cuts) + right)
            i = int(np.argmax(gain))
            return float(gain[i]), int(cuts[i])

        bounds, found = [(0, len(y))], []
        for _ in range(n_points):
            options = [(*best(a, b), (a, b)) for a, b in bounds]
            gain, cut, span = max(options, key=lambda o: o[0])
            if cut < 0 or gain <= 0:
                break
            bounds.remove(span)
            bounds += [(span[0], cut), (cut, span[1])]
            found.append((pdf[key].iloc[0], pdf[time].iloc[cut], gain))
        return pd.DataFrame(found, columns=[key, time, "gain"])

    types = dict(series.dtypes)
    return series.select(key, time, F.col(value).cast("double").alias(value)).groupBy(key).applyInPandas(split, f"`{key}` {types[key]}, `{time}` {types[time]}, gain double")


# --- drift -------------------------------------------------------------------


def drift_baseline(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Mean, deviation, range, quartiles and count per feature."""
    long = unpivot_numbers(df, features).filter(F.col("value").isNotNull())
    agg = long.groupBy("feature").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"), n_rows().alias("n_samples"))
    return agg.join(quantiles(long, "value", {"q25": 0.25, "median": 0.5, "q75": 0.75}, keys=["feature"]), "feature")


def psi(baseline: DataFrame, current: DataFrame, features: Sequence[str], period: Sequence[str] = (), bins: int = 10) -> DataFrame:
    """Population stability index over equal-width baseline bins, per feature (and period)."""
    base = unpivot_numbers(baseline, features).filter(F.col("value").isNotNull())
    cur = unpivot_numbers(current, features, list(period)).filter(F.col("value").isNotNull())
    edges = base.groupBy("feature").agg(F.min("value").alias("lo"), F.max("value").alias("hi"), n_rows().alias("nb"))

    def binned(df: DataFrame, *keys: str) -> DataFrame:
        # the last bin includes its upper edge; values outside fall in no bin
        lo, hi = F.col("_e.lo"), F.col("_e.hi")
        width = (hi - lo) / bins
        b = F.when(F.col("value") == hi, F.lit(bins - 1)).otherwise(F.floor(F.try_divide(F.col("value") - lo, width)).cast("int"))
        inside = F.col("value").between(lo, hi)
        return with_lookup(df, edges, "feature", "_e").filter(inside).groupBy(*keys, "feature", b.alias("bin")).agg(n_rows().alias("n"))

    grid = edges.select("feature", "nb", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    expected = grid.join(binned(base), ["feature", "bin"], "left").select("feature", "bin", F.greatest(or_zero("n") / F.col("nb"), F.lit(1e-4)).alias("b"))
    sizes = cur.groupBy(*period, "feature").agg(n_rows().alias("nc"))
    actual = sizes.join(expected, "feature").join(binned(cur, *period), [*period, "feature", "bin"], "left")
    c = F.greatest(or_zero("n") / F.col("nc"), F.lit(1e-4))
    return actual.groupBy(*period, "feature").agg(F.sum((c - F.col("b")) * F.ln(c / F.col("b"))).alias("psi"))


def statistical_drift(baseline: DataFrame, current: DataFrame, features: Sequence[str], period: Sequence[str] = (), alpha: float = 0.05) -> DataFrame:
    """One-sample t-test against the baseline mean and PSI severity per feature (and period)."""
    means = unpivot_numbers(baseline, features).groupBy("feature").agg(F.avg("value").alias("baseline_mean"))
    cur = unpivot_numbers(current, features, list(period)).groupBy(*period, "feature").agg(
        F.avg("value").alias("current_mean"), F.stddev_samp("value").alias("_s"), F.count("value").alias("_n")).filter(F.col("_n") >= 10)
    joined = cur.join(means, "feature").join(psi(baseline, current, features, period), [*period, "feature"])
    t = F.try_divide(F.col("current_mean") - F.col("baseline_mean"), F.col("_s") / F.sqrt(F.col("_n").cast("double")))
    out = joined.select(*period, "feature", "baseline_mean", "current_mean", (F.col("current_mean") - F.col("baseline_mean")).alias("mean_shift"), t.alias("t_statistic"), (F.col("_n") - 1).alias("_dof"), "psi")
    out = out.withColumn("p_value", t_two_sided("t_statistic", "_dof")).drop("_dof")
    return out.withColumn("is_drift", F.col("p_value") < alpha).withColumn(
        "drift_severity", F.when(F.col("psi") > 0.5, "high").when(F.col("psi") > 0.2, "medium").when(F.col("psi") > 0.1, "low").otherwise("none"))


def ks_drift(baseline: DataFrame, current: DataFrame, features: Sequence[str]) -> DataFrame:
    """Two-sample KS distance per feature with its asymptotic p-value and severity.

    Values are counted per sample, then both step functions are running totals
    over the range-partitioned distinct values.
    """
    a = unpivot_numbers(baseline, features).select("feature", "value", F.lit(1).alias("a"), F.lit(0).alias("b"))
    b = unpivot_numbers(current, features).select("feature", "value", F.lit(0).alias("a"), F.lit(1).alias("b"))
    counts = a.unionByName(b).filter(F.col("value").isNotNull()).groupBy("feature", "value").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    run = running_totals(counts, [F.col("value")], keys=["feature"], sums={"ca": "a", "cb": "b"}, totals={"na": "a", "nb": "b"}, rank=None)
    out = run.groupBy("feature").agg(F.max(F.abs(F.col("ca") / F.col("na") - F.col("cb") / F.col("nb"))).alias("ks_statistic"), F.max("na").alias("na"), F.max("nb").alias("nb"))
    d = F.col("ks_statistic")
    n = F.col("na") * F.col("nb") / (F.col("na") + F.col("nb"))
    lam2 = n * d * d
    tail = reduce(lambda x, y: x + y, [2.0 * (-1) ** (k - 1) * F.exp(-2.0 * k * k * lam2) for k in range(1, 21)])
    p = F.when(lam2 < 0.04, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), tail)))
    return out.select("feature", d, p.alias("ks_pvalue"), (p < 0.05).alias("is_drift"),
                      F.when(d > 0.3, "high").when(d > 0.15, "medium").when(d > 0.05, "low").otherwise("none").alias("drift_severity"))


def drift_score(drift: DataFrame, period: Sequence[str] = ()) -> DataFrame:
    weight = F.when(F.col("drift_severity") == "high", 3).when(F.col("drift_severity") == "medium", 2).when(F.col("drift_severity") == "low", 1).otherwise(0)
    return drift.groupBy(*period).agg(
        (F.avg(weight) / 3).alias("overall_drift_score"), F.count_if("is_drift").alias("n_features_drifted"), n_rows().alias("n_total_features"),
        (F.count_if("is_drift") / n_rows() * 100).alias("drift_percentage"))


def drift_alert(scores: DataFrame, threshold: float = 0.3) -> DataFrame:
    s = F.col("overall_drift_score")
    return scores.withColumn("alert_triggered", s > threshold).withColumn("alert_level", F.when(s > 0.5, "critical").when(s > threshold, "warning").otherwise("none"))


# --- forecasts ---------------------------------------------------------------


def demand_series(items: DataFrame, orders: DataFrame, products: DataFrame | None = None, by: str | None = None) -> DataFrame:
    """Units and revenue per day, zero-filled, for all sales or per product or category."""
    lines = items.select("order_id", "product_id", "quantity", "unit_price").join(orders.select("order_id", F.col("order_date").alias("day")), "order_id")
    if by and by != "product_id":
        lines = lines.join(products.select("product_id", by), "product_id")
    key = F.col(by).cast("string") if by else F.lit("all")
    daily = lines.groupBy(key.alias("series_id"), "day").agg(F.sum("quantity").alias("units_sold"), F.sum(F.col("quantity") * F.col("unit_price")).alias("revenue_inr"))
    return fill_days(daily, ["series_id"], "day", ["units_sold", "revenue_inr"])


def _horizon(level: DataFrame, horizon: int, keys: Sequence[str] = ("series_id",)) -> DataFrame:
    return level.select("*", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("step")).withColumn("day", F.date_add("last_day", F.col("step"))).drop("last_day")


def forecast_moving_average(series: DataFrame, horizon: int, windows: Sequence[int] = (7, 14, 28), keys: Sequence[str] = ("series_id",)) -> DataFrame:
    """Mean of the last 7/14/28-row averages, flat over the horizon."""
    w = W.partitionBy(*keys).orderBy(F.col("day").desc())
    recent = series.withColumn("_r", F.row_number().over(w)).withColumn("_n", n_rows().over(W.partitionBy(*keys)))
    level = recent.groupBy(*keys).agg(
        F.max("day").alias("last_day"),
        *[F.coalesce(F.avg(F.when((F.col("_r") <= k) | (F.col("_n") < k), F.col("units_sold"))), F.lit(0.0)).alias(f"_m{k}") for k in windows])
    mean = reduce(lambda a, b: a + b, [F.col(f"_m{k}") for k in windows]) / len(windows)
    return _horizon(level.select(*keys, "last_day", mean.alias("forecast")), horizon)


def smoothing_levels(series: DataFrame, alphas: Sequence[float] = (0.2, 0.5, 0.8), keys: Sequence[str] = ("series_id",)) -> DataFrame:
    """Final level and in-sample MAPE of exponential smoothing per series and alpha."""
    packed = series.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("day", F.col("units_sold").cast("double").alias("x")))).alias("_s"), F.max("day").alias("last_day"))
    tried = packed.select("*", F.explode(F.array(*[F.lit(float(a)) for a in alphas])).alias("alpha"))
    start = F.struct(F.element_at("_s", 1)["x"].alias("level"), F.lit(0.0).alias("err"), F.lit(0).alias("n"), F.lit(0).alias("i"))

    def step(acc: Column, s: Column) -> Column:
        scored = (acc["i"] > 0) & (s["x"] != 0)
        return F.struct(
            (F.col("alpha") * s["x"] + (1 - F.col("alpha")) * acc["level"]).alias("level"),
            F.when(scored, acc["err"] + F.abs((s["x"] - acc["level"]) / s["x"])).otherwise(acc["err"]).alias("err"),
            F.when(scored, acc["n"] + 1).otherwise(acc["n"]).alias("n"), (acc["i"] + 1).alias("i"))

    out = tried.withColumn("_f", F.aggregate("_s", start, step))
    return out.select(*keys, "last_day", "alpha", F.col("_f.level").alias("level"), (F.try_divide(F.col("_f.err"), F.col("_f.n")) * 100).alias("mape"))


def forecast_smoothing(series: DataFrame, horizon: int, alphas: Sequence[float] = (0.2, 0.5, 0.8), keys: Sequence[str] = ("series_id",)) -> DataFrame:
    """Flat forecast at the level of the alpha with the lowest in-sample MAPE."""
    best = smoothing_levels(series, alphas, keys).groupBy(*keys).agg(
        F.max("last_day").alias("last_day"), F.min_by(F.struct("alpha", "level", "mape"), F.struct(F.coalesce("mape", F.lit(float("inf"))), "alpha")).alias("b"))
    return _horizon(best.select(*keys, "last_day", F.col("b.level").alias("forecast"), F.col("b.alpha").alias("alpha"), F.col("b.mape").alias("in_sample_mape")), horizon)


def forecast_seasonal_naive(series: DataFrame, horizon: int, season: int = 7, keys: Sequence[str] = ("series_id",)) -> DataFrame:
    """Repeat the last season."""
    w = W.partitionBy(*keys)
    recent = series.withColumn("_r", F.row_number().over(w.orderBy(F.col("day").desc()))).withColumn("_n", n_rows().over(w))
    last = recent.withColumn("_p", F.least(F.lit(season), F.col("_n"))).filter(F.col("_r") <= F.col("_p"))
    span = last.groupBy(*keys).agg(F.max("day").alias("last_day"), F.max("_p").alias("_p"))
    steps = _horizon(span, horizon).withColumn("_r", F.col("_p") - (F.col("step") - 1) % F.col("_p"))
    return steps.join(last.select(*keys, "_r", F.col("units_sold").cast("double").alias("forecast")), [*keys, "_r"]).drop("_r", "_p")


def calendar_lag_features(series: DataFrame, target: str = "units_sold", lags: Sequence[int] = (3, 7, 14, 28), keys: Sequence[str] = ("series_id",)) -> DataFrame:
    """Calendar parts, lags and shifted means; leading gaps take the next known value."""
    w = W.partitionBy(*keys).orderBy("day")
    d = F.col("day")
    out = series.select(
        *series.columns, (F.row_number().over(w) - 1).alias("t"), F.weekday(d).alias("dow"), F.dayofmonth(d).alias("dom"), F.weekofyear(d).alias("week"), F.month(d).alias("month"),
        F.quarter(d).alias("quarter"), F.year(d).alias("year"), (F.weekday(d) >= 5).cast("int").alias("is_weekend"),
        *[x for k in lags for x in (F.lag(F.col(target).cast("double"), k).over(w).alias(f"lag_{k}"), F.avg(target).over(w.rowsBetween(-k, -1)).alias(f"ma_{k}"))])
    ahead = w.rowsBetween(0, W.unboundedFollowing)
    filled = [f"{p}_{k}" for k in lags for p in ("lag", "ma")]
    return out.select(*[c for c in out.columns if c not in filled], *[F.coalesce(F.first(c, ignorenulls=True).over(ahead), F.lit(0.0)).alias(c) for c in filled])


def forecast_trees(series: DataFrame, horizon: int, keys: Sequence[str] = ("series_id",)) -> DataFrame:
    """0.6 boosted trees + 0.4 random forest on calendar and lag features, never negative.

    One model is trained over all series; the future rows carry the last known
    lags with their own calendar.
    """
    features = calendar_lag_features(series, keys=keys)
    names = [c for c in features.columns if c not in (*keys, "day", "units_sold", "revenue_inr")]
    assembler = VectorAssembler(inputCols=names, outputCol="features")
    train = assembler.transform(features.withColumn("label", F.col("units_sold").cast("double"))).select("features", "label")
    train = materialize(train)  # both models read the same written features
    boosted = fit_cached(GBTRegressor(maxIter=20, maxDepth=4, seed=42), train)
    forest = fit_cached(RandomForestRegressor(numTrees=30, maxDepth=8, seed=42), train)
    lags = [c for c in names if c.startswith(("lag_", "ma_"))]
    last = features.groupBy(*keys).agg(F.max_by(F.struct("t", *lags), "day").alias("l"), F.max("day").alias("last_day"))
    future = _horizon(last, horizon)
    d = F.col("day")
    future = future.select(
        *keys, "day", "step", (F.col("l.t") + F.col("step")).alias("t"), F.weekday(d).alias("dow"), F.dayofmonth(d).alias("dom"), F.weekofyear(d).alias("week"), F.month(d).alias("month"),
        F.quarter(d).alias("quarter"), F.year(d).alias("year"), (F.weekday(d) >= 5).cast("int").alias("is_weekend"), *[F.col(f"l.{c}").alias(c) for c in lags])
    scored = forest.transform(boosted.transform(assembler.transform(future)).withColumnRenamed("prediction", "_g")).withColumn(
        "forecast", F.greatest(F.lit(0.0), 0.6 * F.col("_g") + 0.4 * F.col("prediction")))
    return scored.select(*keys, "step", "day", "forecast")


def forecast_arima(series: DataFrame, horizon: int, keys: Sequence[str] = ("series_id",)) -> DataFrame:
    """ARIMA(1,1,1) by conditional sum of squares, one calendar-bounded series per call."""
    key = keys[0]

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("day")
        y = pdf["units_sold"].to_numpy(float)
        last = pd.Timestamp(pdf["day"].iloc[-1])
        d = np.diff(y)
        if len(d) < 10 or np.allclose(d, d[0]):
            path = np.full(horizon, y[-1])
        else:
            def errors(phi: float, theta: float) -> np.ndarray:
                e = np.zeros(len(d))
                for i in range(1, len(d)):
                    e[i] = d[i] - phi * d[i - 1] - theta * e[i - 1]
                return e

            grid = np.linspace(-0.9, 0.9, 13)
            phi, theta = min(((p, t) for p in grid for t in grid), key=lambda pt: float(np.sum(errors(*pt) ** 2)))
            for width in (0.075, 0.02):
                near = np.linspace(-width, width, 5)
                phi, theta = min(((np.clip(phi + a, -0.99, 0.99), np.clip(theta + b, -0.99, 0.99)) for a in near for b in near), key=lambda pt: float(np.sum(errors(*pt) ** 2)))
            e = errors(phi, theta)
            step, path = phi * d[-1] + theta * e[-1], np.empty(horizon)
            level = y[-1]
            for h in range(horizon):
                level += step
                path[h] = level
                step *= phi
        days = [(last + pd.Timedelta(days=h + 1)).date() for h in range(horizon)]
        return pd.DataFrame({key: pdf[key].iloc[0], "step": np.arange(1, horizon + 1), "day": days, "forecast": path})

    return series.select(key, "day", F.col("units_sold").cast("double").alias("units_sold")).groupBy(key).applyInPandas(fit, f"`{key}` string, step int, day date, forecast double")


def accuracy(df: DataFrame, actual: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    """MAE, RMSE, MAPE over non-zero actuals, symmetric MAPE and the number of rows."""
    a, p = F.col(actual).cast("double"), F.col(predicted).cast("double")
    return df.groupBy(*by).agg(
        F.avg(F.abs(a - p)).alias("mae"), F.sqrt(F.avg((a - p) * (a - p))).alias("rmse"), (F.avg(F.when(a != 0, F.abs((a - p) / a))) * 100).alias("mape"),
        (F.avg(F.try_divide(2 * F.abs(a - p), F.abs(a) + F.abs(p))) * 100).alias("smape"), n_rows().alias("n_observations"))


METHODS = {"Moving Average": forecast_moving_average, "Exponential Smoothing": forecast_smoothing, "Seasonal Naive": forecast_seasonal_naive}


def cross_validate(series: DataFrame, method: str, n_splits: int = 3, horizon: int = 30) -> DataFrame:
    """Expanding-window folds: each fold is a series of its own, all forecast in one plan."""
    w = W.partitionBy("series_id")
    numbered = series.withColumn("_i", F.row_number().over(w.orderBy("day")) - 1).withColumn("_n", n_rows().over(w))
    folds = numbered.select("*", F.explode(F.sequence(F.lit(0), F.lit(n_splits - 1))).alias("fold")).withColumn(
        "_start", F.col("_n") - (n_splits - F.col("fold")) * horizon).filter(F.col("_start") >= horizon)
    keyed = folds.withColumn("_key", F.concat_ws("#", "series_id", F.col("fold").cast("string")))
    train = keyed.filter(F.col("_i") < F.col("_start")).select(F.col("_key").alias("series_id"), "day", "units_sold")
    test = keyed.filter((F.col("_i") >= F.col("_start")) & (F.col("_i") < F.col("_start") + horizon)).select("_key", "series_id", "fold", "day", "units_sold")
    predicted = METHODS[method](train, horizon).select(F.col("series_id").alias("_key"), "day", "forecast")
    return test.join(predicted, ["_key", "day"]).select("series_id", "fold", "day", "units_sold", "forecast")


def cross_validation_metrics(folds: DataFrame) -> DataFrame:
    per = accuracy(folds, "units_sold", "forecast", ["series_id", "fold"])
    return per.groupBy("series_id").agg(*[x for m in ("mae", "rmse", "mape") for x in (F.avg(m).alias(f"{m}_mean"), F.stddev_pop(m).alias(f"{m}_std"))], n_rows().alias("n_splits"))


def compare_models(series: DataFrame, n_splits: int = 3, horizon: int = 30) -> DataFrame:
    """Cross-validated errors per model with the lowest MAPE marked."""
    parts = [cross_validation_metrics(cross_validate(series, m, n_splits, horizon)).withColumn("model", F.lit(m)) for m in METHODS]
    out = reduce(lambda a, b: a.unionByName(b), parts)
    best = F.min_by("model", F.struct("mape_mean", "model")).over(W.partitionBy("series_id"))
    return out.withColumn("is_best", F.col("model") == best)


def forecast_best(series: DataFrame, comparison: DataFrame, horizon: int = 30) -> DataFrame:
    """The forecast of each series' best model, never below zero."""
    best = comparison.filter("is_best").select("series_id", "model")
    parts = [fn(series, horizon).select("series_id", "step", "day", "forecast").withColumn("model", F.lit(m)) for m, fn in METHODS.items()]
    every = reduce(lambda a, b: a.unionByName(b), parts)
    return every.join(best, ["series_id", "model"]).withColumn("forecast", F.greatest(F.col("forecast"), F.lit(0.0)))


def trend_season_forecast(series: DataFrame, horizon: int, season: int = 7, z: float = 1.2815515655446004) -> DataFrame:
    """Linear trend plus weekday effect per series with an 80 % band from the residuals.

    Trend and effects are aggregates, so every series is fitted in one plan.
    """
    w = W.partitionBy("series_id").orderBy("day")
    t = series.select("series_id", "day", F.col("units_sold").cast("double").alias("y"), (F.row_number().over(w) - 1).cast("double").alias("t"))
    line = t.groupBy("series_id").agg(F.coalesce(F.regr_slope("y", "t"), F.lit(0.0)).alias("b"), F.avg("y").alias("my"), F.avg("t").alias("mt"), F.max("t").alias("_last"), F.max("day").alias("last_day"))
    fit = t.join(line, "series_id").withColumn("r", F.col("y") - (F.col("my") + F.col("b") * (F.col("t") - F.col("mt")))).withColumn("ph", F.pmod(F.col("t").cast("int"), F.lit(season)))
    effect = fit.groupBy("series_id", "ph").agg(F.avg("r").alias("s"))
    spread = fit.join(effect, ["series_id", "ph"]).groupBy("series_id").agg(F.coalesce(F.stddev_samp(F.col("r") - F.col("s")), F.lit(0.0)).alias("sd"))
    future = _horizon(line.join(spread, "series_id"), horizon).withColumn("_t", F.col("_last") + F.col("step")).withColumn("ph", F.pmod(F.col("_t").cast("int"), F.lit(season)))
    out = future.join(effect, ["series_id", "ph"], "left").withColumn("yhat", F.col("my") + F.col("b") * (F.col("_t") - F.col("mt")) + or_zero("s"))
    return out.select("series_id", "day", "yhat", (F.col("yhat") - z * F.col("sd")).alias("yhat_lower"), (F.col("yhat") + z * F.col("sd")).alias("yhat_upper"))


def bottom_up(leaf_forecasts: DataFrame, parents: DataFrame) -> DataFrame:
    """Sum leaf forecasts and bands to their parents and to the total.

    ``parents`` maps ``series_id`` to ``parent``.
    """
    joined = leaf_forecasts.join(parents, "series_id")
    agg = [F.sum(c).alias(c) for c in ("yhat", "yhat_lower", "yhat_upper")]
    leaves = leaf_forecasts.select(F.lit("leaf").alias("level"), F.col("series_id").alias("node"), "day", "yhat", "yhat_lower", "yhat_upper")
    mid = joined.groupBy(F.col("parent").alias("node"), "day").agg(*agg).select(F.lit("parent").alias("level"), "node", "day", "yhat", "yhat_lower", "yhat_upper")
    top = leaf_forecasts.groupBy("day").agg(*agg).select(F.lit("total").alias("level"), F.lit("all").alias("node"), "day", "yhat", "yhat_lower", "yhat_upper")
    return leaves.unionByName(mid).unionByName(top)


def top_down(parent_forecasts: DataFrame, history: DataFrame) -> DataFrame:
    """Split parent forecasts to their own children by historical share.

    ``history`` holds ``parent``, ``series_id`` and ``units`` in total.
    """
    total = history.groupBy("parent").agg(F.sum("units").alias("_t"))
    share = history.join(total, "parent").select("parent", "series_id", F.try_divide(F.col("units").cast("double"), F.col("_t")).alias("share"))
    return parent_forecasts.withColumnRenamed("series_id", "parent").join(share, "parent").select(
        "parent", "series_id", "day", "share", *[(F.col(c) * F.col("share")).alias(c) for c in ("yhat", "yhat_lower", "yhat_upper")])


def interval_summary(forecast: DataFrame) -> DataFrame:
    """Interval width, relative uncertainty and means per series."""
    width = F.col("yhat_upper") - F.col("yhat_lower")
    return forecast.groupBy("series_id").agg(
        F.avg("yhat").alias("mean_forecast"), F.stddev_samp("yhat").alias("forecast_std"), F.avg(width).alias("mean_interval_width"),
        F.avg(F.try_divide(width, 2 * F.col("yhat"))).alias("mean_uncertainty_cv"))
