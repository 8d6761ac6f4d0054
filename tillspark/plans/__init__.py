"""Registered queries and the SQL each one is checked against."""

from tillspark.plans import (  # noqa: F401  (each module registers its queries)
    carts,
    catalog,
    feeds,
    long_orders,
    orders,
    payments,
    stock,
    validation,
)
from tillspark.plans.registry import CHECKS, PLANS, runner

__all__ = ["CHECKS", "PLANS", "runner"]
