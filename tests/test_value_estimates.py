"""The comparison of lifetime-value estimates takes the learned model, for all customers."""

import pytest

from marketloom.plans import catalog, models
from marketloom.sources.commerce import Commerce


def test_every_customer_is_compared_with_the_model(spark, data_path):
    c = Commerce(spark, data_path)
    everyone = {r.customer_id for r in models.summary(c).select("customer_id").collect()}
    model = {r.customer_id: r.predicted_clv for r in catalog.QUERIES["l14_predict_value_model"](spark, data_path).collect()}
    rows = {r.customer_id: r for r in catalog.QUERIES["l15_compare_estimates"](spark, data_path).collect()}
    assert set(rows) == everyone
    for i, r in rows.items():
        p, m, h = r.probabilistic_clv, r.ml_clv, r.historical_clv
        assert m == pytest.approx(model[i], abs=0.011)
        assert r.approach_agreement == int((p > h) == (m > h))
        for value, x, y in ((r.probabilistic_vs_historical, p, h), (r.ml_vs_historical, m, h), (r.ml_vs_probabilistic, m, p)):
            if y == 0:
                assert value is None
            elif y > 100:
                assert value == pytest.approx(x / y, rel=1e-3, abs=1e-3)


def test_only_a_maximum_counts_as_convergence():
    import numpy as np

    from marketloom.operators.clv import maximize

    hill = lambda points: np.array([-1000 * np.sum(np.cosh(p - np.array([1.0, -2.0]))) for p in points])
    rising = lambda points: np.array([-1000 * np.exp(-p[0]) - p[1] ** 2 for p in points])
    kink = lambda points: np.array([-1000 * abs(p[0] - 0.3) - p[1] ** 2 for p in points])
    found, converged = maximize(hill, (1.0, 1.0))
    assert converged and np.allclose(np.log(found), [1.0, -2.0], atol=1e-6)
    assert not maximize(rising, (1.0, 1.0))[1]
    assert not maximize(kink, (1.0, 1.0))[1]


def test_a_fit_of_simulated_spend_is_a_maximum_near_the_truth(spark):
    import numpy as np

    from marketloom.operators import clv

    rng = np.random.default_rng(5)
    n = rng.integers(1, 12, 6000)
    mean = rng.gamma(4.0 * n) / n / (rng.gamma(3.5, size=6000) / 500.0)
    bought = spark.createDataFrame(list(zip(n.tolist(), mean.tolist())), "frequency long, monetary_value double").coalesce(4)
    fit = clv.fit_spend_model(bought)
    assert fit["converged"] == 1
    data = bought.selectExpr("frequency AS x", "monetary_value AS m", "1 AS w")
    at = np.log([fit["p"], fit["q"], fit["gamma"]])
    f = clv._batched(data, ["x", "m"], clv._spend_loglik)([at, *[at + s * 1e-3 * np.eye(3)[i] for i in range(3) for s in (1, -1)], np.log([4.0, 3.5, 500.0])])
    # likelihood ratio against the truth: 99.9 % of a chi-square with three degrees of freedom
    assert 0 <= 2 * (f[0] - f[-1]) <= 16.27
    # per customer
    assert (abs(f[1:7:2] - f[2:7:2]) / 2e-3 <= 1e-4 * 6000).all()


def test_a_fit_passes_once_over_the_data_for_each_full_step():
    import numpy as np

    from marketloom.operators.clv import maximize

    passes = []

    def rising(points):  # full steps are always the best, and there is no maximum
        passes.append(len(points))
        return np.array([-1000 * np.exp(-p[0]) - p[1] ** 2 for p in points])

    maximize(rising, (1.0, 1.0), iterations=10)
    assert len(passes) <= 11  # 20 with a pass of its own for the step lengths


def test_a_pass_of_a_fit_starts_few_tasks_and_no_shuffle(spark):
    import numpy as np

    from marketloom.operators import clv

    data = spark.range(1000).selectExpr("id % 7 + 1 AS x", "id % 13 + 1.5D AS m", "1 AS w").repartition(8)
    cached = clv._statistics(data)
    try:
        assert cached.rdd.getNumPartitions() == 1
        points = [np.log([2.0, 3.0, 1.0]), np.log([4.0, 3.5, 2.0])]
        x, m = (np.array([r[c] for r in data.collect()], float) for c in "xm")
        expected = [clv._spend_loglik(np.exp(p), x, m).sum() for p in points]
        assert np.allclose(clv._batched(cached, ["x", "m"], clv._spend_loglik)(points), expected, rtol=1e-12)
    finally:
        data.unpersist()
