"""Robust straight lines: the least sum of absolute residuals.

The minimum is found exactly: for a fixed slope the best intercept is a median,
the sum is convex in the slope, and an optimal line passes through two points,
so the slope is bracketed by repeated weighted medians (each a descent along the
lines through one point) until no point improves it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DAYS_PER_YEAR = 365.25


def weighted_median(values: np.ndarray, weights: np.ndarray) -> float:
    """Least value at which half of the weight is reached."""
    order = np.argsort(values, kind="stable")
    total = np.cumsum(weights[order])
    return float(values[order][np.searchsorted(total, total[-1] / 2)])


def _sum(x: np.ndarray, y: np.ndarray, w: np.ndarray, slope: float) -> tuple[float, float]:
    level = y - slope * x
    offset = weighted_median(level, w)
    return float(np.sum(w * np.abs(level - offset))), offset


def l1_line(x: np.ndarray, y: np.ndarray, weights: np.ndarray | None = None) -> tuple[float, float]:
    """(slope, intercept) that minimise the weighted sum of absolute residuals; NaN for fewer than two distinct x."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    w = np.ones(len(x)) if weights is None else np.abs(np.asarray(weights, float))
    if len(np.unique(x)) < 2:
        return np.nan, np.nan
    spread = np.ptp(x)
    guess = float(np.polyfit(x, y, 1)[0])
    reach = max(np.ptp(y) / spread, abs(guess), 1e-12)
    low, high = guess - reach, guess + reach
    while _sum(x, y, w, low)[0] < _sum(x, y, w, low + reach * 1e-3)[0]:
        low, reach = low - 2 * reach, 2 * reach
    while _sum(x, y, w, high)[0] < _sum(x, y, w, high - reach * 1e-3)[0]:
        high, reach = high + 2 * reach, 2 * reach
    golden = (np.sqrt(5) - 1) / 2
    a, b = high - golden * (high - low), low + golden * (high - low)
    fa, fb = _sum(x, y, w, a)[0], _sum(x, y, w, b)[0]
    for _ in range(90):
        if fa <= fb:
            high, b, fb = b, a, fa
            a = high - golden * (high - low)
            fa = _sum(x, y, w, a)[0]
        else:
            low, a, fa = a, b, fb
            b = low + golden * (high - low)
            fb = _sum(x, y, w, b)[0]
        if high - low <= 1e-13 * max(1.0, abs(low)):
            break
    best = (low + high) / 2
    value, offset = _sum(x, y, w, best)
    for _ in range(20):  # onto a vertex: the best line through a point that the last one passes
        near = int(np.argmin(np.abs(y - best * x - offset)))
        other = x != x[near]
        slope = weighted_median((y[other] - y[near]) / (x[other] - x[near]), w[other] * np.abs(x[other] - x[near]))
        new, shifted = _sum(x, y, w, slope)
        if new >= value - 1e-15 * max(1.0, value):
            break
        best, value, offset = slope, new, shifted
    return best, offset


def robust_linear_fit(x: np.ndarray, y: np.ndarray, w: np.ndarray | None = None, return_cov: bool = False):
    """Coefficients [slope, intercept] of one series, or of each column of ``y``; with the inverse of AᵀA if wanted."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    columns = y.reshape(len(x), -1)
    fits = np.array([l1_line(x, columns[:, k], w) for k in range(columns.shape[1])]).T
    fits = fits[:, 0] if y.ndim == 1 else fits
    if not return_cov:
        return fits
    a = np.stack([x, np.ones_like(x)], 1) * (1.0 if w is None else np.asarray(w, float)[:, None])
    return fits, np.linalg.inv(a.T @ a)


def robust_lines(df: DataFrame, value: str = "value", station: str = "station", date: str = "date") -> DataFrame:
    """(station, n, slope per year, intercept, objective) of the L1 line over years since the first row."""
    rows = df.where(F.col(value).isNotNull()).select(F.col(station).alias("station"), F.col(date).cast("date").alias("date"), F.col(value).cast("double").alias("value"))

    def one(key, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["date", "value"], kind="stable")
        days = pd.to_datetime(frame["date"])
        x, y = ((days - days.iloc[0]).dt.days / DAYS_PER_YEAR).to_numpy(), frame["value"].to_numpy()
        slope, offset = l1_line(x, y)
        return pd.DataFrame({"station": [key[0]], "n": [len(y)], "slope": [slope], "intercept": [offset], "objective": [np.sum(np.abs(y - slope * x - offset))]})

    return rows.groupBy("station").applyInPandas(one, "station string, n long, slope double, intercept double, objective double")
