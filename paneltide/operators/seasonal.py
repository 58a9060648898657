"""Seasonal-trend decomposition by local regression (Cleveland et al. 1990).

Spark reduces each series to monthly means; one task then decomposes one series
of months, a few hundred numbers at most.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paneltide.spec import WEATHER, PanelSpec

PERIOD = 12
MIN_MONTHS = 24
SEASONAL_SPAN = 7


@lru_cache(maxsize=256)
def kernel(n: int, span: int, first: int, last: int) -> np.ndarray:
    """Tricube weight of each of ``n`` positions for a line read off at each position from ``first`` to ``last``."""
    far = np.abs(np.arange(first, last + 1, dtype=float)[:, None] - np.arange(n, dtype=float))
    reach = np.sort(far, axis=1)[:, min(span, n) - 1] * max(1.0, span / n)
    return np.clip(1 - (far / np.maximum(reach, 1e-9)[:, None]) ** 3, 0, None) ** 3


def local_lines(y: np.ndarray, span: int, weight: np.ndarray, first: int, last: int) -> np.ndarray:
    """Locally weighted straight lines through each row of ``y``, read off at positions ``first`` to ``last``.

    Each row has its own weights; four matrix products serve all rows.
    """
    n = y.shape[1]
    x, at = np.arange(n, dtype=float), np.arange(first, last + 1, dtype=float)
    near = kernel(n, span, first, last).T
    total = weight @ near
    lost = total <= 0
    if lost.any():  # no weight near: the plain mean and slope of the row

        def summed(v: np.ndarray) -> np.ndarray:
            return np.where(lost, v.sum(axis=1, keepdims=True), (weight * v) @ near)

        total = np.where(lost, n, total)
    else:

        def summed(v: np.ndarray) -> np.ndarray:
            return (weight * v) @ near

    mean_x, mean_y = summed(np.broadcast_to(x, y.shape)) / total, summed(y) / total
    spread = summed(np.broadcast_to(x * x, y.shape)) / total - mean_x**2
    slope = (summed(x * y) / total - mean_x * mean_y) / np.where(spread > 1e-12, spread, np.inf)
    return mean_y + slope * (at - mean_x)


def decompose(
    y: np.ndarray, period: int = PERIOD, robust: bool = True
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Season, trend and remainder."""
    season, trend, left = decompose_all(np.asarray(y, dtype=float)[None], period, robust)
    return season[0], trend[0], left[0]


def moving_means(y: np.ndarray, n: int) -> np.ndarray:
    return np.lib.stride_tricks.sliding_window_view(y, n, axis=1).mean(axis=-1)


def decompose_all(
    y: np.ndarray, period: int = PERIOD, robust: bool = True
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Season, trend and remainder of series of one length, a row each."""
    n = y.shape[1]
    trend_span = int(np.ceil(1.5 * period / (1 - 1.5 / SEASONAL_SPAN))) | 1
    low_span = (period + 1) | 1
    weight, trend, season = np.ones(y.shape), np.zeros(y.shape), np.zeros(y.shape)
    going = np.arange(len(y))
    for _ in range(15 if robust else 1):
        mine, own, drift = y[going], weight[going], trend[going]
        for _ in range(2):
            cycle = np.zeros((len(mine), n + 2 * period))
            for phase in range(period):
                part = (mine - drift)[:, phase::period]
                smooth = local_lines(part, SEASONAL_SPAN, own[:, phase::period], -1, part.shape[1])
                room = cycle[:, phase::period]
                room[:, : smooth.shape[1]] = smooth[:, : room.shape[1]]
            low = moving_means(moving_means(moving_means(cycle, period), period), 3)
            now = cycle[:, period : period + n] - local_lines(low, low_span, np.ones(low.shape), 0, n - 1)
            drift = local_lines(mine - now, trend_span, own, 0, n - 1)
        season[going], trend[going] = now, drift
        left = np.abs(mine - now - drift)
        limit = 6 * np.median(left, axis=1)
        # the others fit exactly and are done
        open_rows = limit > 0
        going, left, limit = going[open_rows], left[open_rows], limit[open_rows]
        if not robust or not len(going):
            break
        weight[going] = np.clip(1 - (left / limit[:, None]) ** 2, 0, None) ** 2
    return season, trend, y - season - trend


def stl_residuals(
    df: DataFrame,
    spec: PanelSpec = WEATHER,
    value: str | None = None,
    period: int = PERIOD,
    robust: bool = True,
    min_months: int = MIN_MONTHS,
) -> DataFrame:
    """``(*keys, month, season, trend, residual)`` of monthly means.

    Missing months are filled linearly; series shorter than ``min_months`` are left out.
    """
    months = (
        df.where(F.col(value or spec.value).isNotNull())
        .groupBy(*spec.keys, F.to_date(F.date_trunc("month", spec.time)).alias("month"))
        .agg(F.avg(value or spec.value).alias("y"))
    )
    # one row for each series; a fixed number of partitions, since the work lies in the tasks and not in the bytes
    per_series = (
        months.groupBy(*spec.keys)
        .agg(F.sort_array(F.collect_list(F.struct("month", "y"))).alias("_m"))
        .repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *spec.keys)
        .select(F.struct(*spec.keys).alias("_key"), F.col("_m.month").alias("_month"), F.col("_m.y").alias("_y"))
    )
    key = per_series.schema["_key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths: dict[int, list[tuple[int, np.ndarray, np.ndarray]]] = {}
            for i in range(batch.num_rows):
                regular = _regular(batch.column("_month")[i].values, batch.column("_y")[i].values)
                if regular and len(regular[0]) >= min_months:
                    lengths.setdefault(len(regular[0]), []).append((i, *regular))
            for n, series in lengths.items():
                parts = decompose_all(np.stack([y for _, _, y in series]), period, robust)
                keys = batch.column("_key").take(pa.array(np.repeat([i for i, _, _ in series], n)))
                found = np.concatenate([m for _, m, _ in series])
                yield pa.RecordBatch.from_arrays(
                    [keys, pa.array(found.astype("datetime64[D]")), *[pa.array(p.ravel()) for p in parts]],
                    ["_key", "month", "season", "trend", "residual"],
                )

    kinds = f"_key {key}, month date, season double, trend double, residual double"
    return per_series.mapInArrow(run, kinds).select("_key.*", "month", "season", "trend", "residual")


def _regular(months: pa.Array, values: pa.Array) -> tuple[np.ndarray, np.ndarray] | None:
    """Every month from the first to the last, and its value; missing ones linearly between their neighbours."""
    known = months.is_valid().to_numpy(zero_copy_only=False)
    at = months.to_numpy(zero_copy_only=False)[known].astype("datetime64[M]")
    y = values.to_numpy(zero_copy_only=False)[known]
    if not len(at):
        return None
    every, have = np.arange(at[0], at[-1] + 1), ~np.isnan(y)
    if not have.any():
        return every, np.full(len(every), np.nan)
    return every, np.interp(every.astype(np.int64), at[have].astype(np.int64), y[have])
