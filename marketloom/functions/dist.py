"""Tail probabilities for test statistics.

They are evaluated on aggregated rows (one per test), so an Arrow batch of a few
values reaches Python; the aggregation itself stays in the JVM.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf

_NORMAL = NormalDist()


def z_value(probability: float) -> float:
    """Standard normal quantile."""
    return _NORMAL.inv_cdf(probability)


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    if x > (a + 1) / (a + b + 2):
        return 1.0 - beta_inc(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    total = d
    for m in range(1, 500):
        for step in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + step * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + step / c
            c = c if abs(c) > tiny else tiny
            total *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * total


def gamma_upper(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function."""
    if x <= 0:
        return 1.0
    scale = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1.0 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= x / k
            total += term
        return 1.0 - total * scale
    b, c = x + 1 - a, 1e300
    d = total = 1 / b
    for i in range(1, 500):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b)
        c = b + an / c
        total *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return total * scale


def _t(t: float, df: float) -> float:
    return beta_inc(df / 2, 0.5, df / (df + t * t)) if df > 0 else math.nan


def _f(f: float, d1: float, d2: float) -> float:
    return beta_inc(d2 / 2, d1 / 2, d2 / (d2 + d1 * f)) if f > 0 else 1.0


def _vector(fn):
    def run(*args):
        values = np.broadcast_arrays(*[np.asarray(a, dtype=float) for a in args])
        return pd.Series([fn(*row) if not any(math.isnan(v) for v in row) else None for row in zip(*values)], dtype="float64")

    return run


def _call(fn, *columns) -> Column:
    arity = len(columns)
    vector = _vector(fn)
    if arity == 1:
        def body(a: pd.Series) -> pd.Series:
            return vector(a)
    elif arity == 2:
        def body(a: pd.Series, b: pd.Series) -> pd.Series:
            return vector(a, b)
    else:
        def body(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
            return vector(a, b, c)
    body.__annotations__ = {k: pd.Series for k in ("a", "b", "c", "return")[:arity]} | {"return": pd.Series}
    return pandas_udf(body, "double")(*[(F.col(c) if isinstance(c, str) else c).cast("double") for c in columns])


def t_two_sided(t, df) -> Column:
    """P(|T| > |t|) for Student's t."""
    return _call(_t, t, df)


def f_upper(f, d1, d2) -> Column:
    """P(F > f)."""
    return _call(_f, f, d1, d2)


def chi2_upper(x, df) -> Column:
    """P(X > x) for chi squared."""
    return _call(lambda v, k: gamma_upper(k / 2, v / 2), x, df)


def normal_two_sided(z) -> Column:
    """P(|Z| > |z|)."""
    return _call(lambda v: math.erfc(abs(v) / math.sqrt(2)), z)


def normal_cdf(z) -> Column:
    return _call(_NORMAL.cdf, z)
