"""Imports every plan module so that all queries are registered."""

from marketloom.plans import customers, inference, marketing, models, operations, products, quality, relations, sales, series, serving  # noqa: F401
from marketloom.plans.registry import ORACLES, QUERIES  # noqa: F401
