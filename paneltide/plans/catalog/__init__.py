"""Every operator bound to the benchmark tables, with a checking statement where SQL can say it."""

from paneltide.plans.catalog import (
    anomalies,
    charts,
    cleaning,
    features,
    forecasting,
    learning,
    profiling,
    regional,
    storage,
)
from paneltide.plans.catalog.base import ORACLES, QUERIES

__all__ = [
    "ORACLES",
    "QUERIES",
    "anomalies",
    "charts",
    "cleaning",
    "features",
    "forecasting",
    "learning",
    "profiling",
    "regional",
    "storage",
]
