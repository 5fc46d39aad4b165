"""Helpers around MLlib estimators."""

from __future__ import annotations

from pyspark.sql import DataFrame


def fit_cached(estimator, train: DataFrame):
    """Fit on a cached frame: iterative estimators read their input many times."""
    data = train.persist()
    try:
        return estimator.fit(data)
    finally:
        data.unpersist()
