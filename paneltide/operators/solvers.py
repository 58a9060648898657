"""Per-series model fits: one short numpy helper per model, run inside Spark tasks.

A series reaches a helper as the array of its daily training values, which the
calendar bounds; Spark partitions the series and batches the arrays.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from paneltide.spec import HORIZON, SEASON

# Smoothing parameters tried, and the shortest series each model accepts.
LEVELS = (0.05, 0.1, 0.2, 0.3, 0.5, 0.7, 0.9)
TRENDS = (0.0, 0.01, 0.05, 0.1, 0.3)
SEASONALS = (0.0, 0.05, 0.1, 0.3, 0.5)
DAMPINGS = (0.8, 0.9, 0.98)


def seasonal_repeat(y: np.ndarray, horizon: int, season: int = SEASON) -> np.ndarray:
    cycle = y[-min(season, len(y)) :]
    return np.resize(cycle, horizon)


def smooth_and_extend(y: np.ndarray, horizon: int, season: int = SEASON) -> np.ndarray:
    """Damped additive trend and season; the best parameters of a grid by squared error."""
    if len(y) < 2 * season + 2:
        return seasonal_repeat(y, horizon, season)
    grid = np.array(list(itertools.product(LEVELS, TRENDS, SEASONALS, DAMPINGS))).T
    alpha, beta, gamma, phi = grid
    first, second = y[:season].mean(), y[season : 2 * season].mean()
    level = np.full(alpha.shape, first)
    trend = np.full(alpha.shape, (second - first) / season)
    seasons = [np.full(alpha.shape, v - first) for v in y[:season]]
    error = np.zeros(alpha.shape)
    for t, value in enumerate(y):
        held = seasons[t % season]
        ahead = level + phi * trend
        miss = value - (ahead + held)
        error += miss * miss
        level = ahead + alpha * miss
        trend = phi * trend + alpha * beta * miss
        seasons[t % season] = held + gamma * (1 - alpha) * miss
    best = int(np.argmin(error))
    damp = np.cumsum(phi[best] ** np.arange(1, horizon + 1))
    repeat = [seasons[(len(y) + h) % season][best] for h in range(horizon)]
    return level[best] + trend[best] * damp + np.array(repeat)


def seasonal_arma(y: np.ndarray, horizon: int, season: int = SEASON) -> np.ndarray:
    """First differences on lags 1, m, m+1 of value and shock, in two least-squares steps."""
    if len(y) < 2 * season + 5:
        return seasonal_repeat(y, horizon, season)
    w = np.diff(y)
    lags = (1, season, season + 1)

    def lagged(series: np.ndarray, wanted, start: int) -> np.ndarray:
        return np.column_stack([series[start - k : len(series) - k] for k in wanted])

    long_lags = range(1, min(2 * season, len(w) // 3) + 1)
    start = max(long_lags)
    past = lagged(w, long_lags, start)
    shock = np.zeros(len(w))
    shock[start:] = w[start:] - past @ np.linalg.lstsq(past, w[start:], rcond=None)[0]
    start = max(start, season + 1)
    design = np.hstack([lagged(w, lags, start), lagged(shock, lags, start)])
    weights = np.linalg.lstsq(design, w[start:], rcond=None)[0]
    w_all, e_all = list(w), list(shock)
    for _ in range(horizon):
        row = [w_all[-k] for k in lags] + [e_all[-k] for k in lags]
        w_all.append(float(np.dot(row, weights)))
        e_all.append(0.0)
    path = y[-1] + np.cumsum(w_all[len(w) :])
    reach = 10 * (y.max() - y.min() + 1)
    if not np.isfinite(path).all() or np.abs(path - y[-1]).max() > reach:
        return seasonal_repeat(y, horizon, season)
    return path


Forecaster = Callable[[np.ndarray, int], np.ndarray]


def as_column(forecaster: Forecaster, horizon: int = HORIZON) -> Callable[[Column], Column]:
    """Wrap ``forecaster(values, horizon)`` as a column function; a failed fit gives null."""

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for values in batches:
            out = []
            for y in values:
                try:
                    path = np.asarray(forecaster(np.asarray(y, dtype=float), horizon), dtype=float)
                    out.append([v if np.isfinite(v) else None for v in path])
                except (ValueError, ArithmeticError, np.linalg.LinAlgError):
                    out.append(None)
            yield pd.Series(out)

    return run


ETS: Forecaster = smooth_and_extend
SARIMA: Forecaster = seasonal_arma
