"""MIDAS: medians of differences between epochs a year apart.

The choice of pairs carries state from epoch to epoch, so it runs per station in
an Arrow-backed grouped function; one station is a few thousand rows.  Epochs
that have a partner exactly one year on are found by binary search; only the
carry-over for gaps is walked.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

TOLERANCE_YEARS = 0.001
MOST_PAIRS = 19999
DAYS_PER_YEAR = 365.25


@dataclass(frozen=True)
class Midas:
    """Velocity and its uncertainty, offset, outlier share, scatter, residuals; NaN where undefined."""

    velocity: float = np.nan
    velocity_uncertainty: float = np.nan
    reference_position: float = np.nan
    outlier_fraction: float = np.nan
    velocity_scatter: float = np.nan
    residuals: np.ndarray | None = None

    def __mul__(self, factor: float) -> Midas:
        """Scaled rates and residuals; offset and outlier share stay."""
        residuals = None if self.residuals is None else self.residuals * factor
        return replace(self, velocity=self.velocity * factor, velocity_uncertainty=self.velocity_uncertainty * factor, velocity_scatter=self.velocity_scatter * factor, residuals=residuals)

    __rmul__ = __mul__


def year_pairs(t: np.ndarray, steps: Sequence[float] = (), tolerance: float = TOLERANCE_YEARS, most: int = MOST_PAIRS) -> np.ndarray:
    """(first, second) indices of epochs about a year apart that no step separates; ``t`` ascending, in years."""
    m = len(t)
    if m < 2:
        return np.zeros((0, 2), np.int64)
    t, steps = np.asarray(t, float), np.asarray(steps, float)
    reach = np.searchsorted(t, t + (1.0 - 2 * tolerance))
    index = np.arange(m)
    reach = np.maximum(reach, index + 1)
    for _ in range(m):  # settle by the difference itself, which rounds otherwise than the sum
        short = (reach < m) & (t[np.minimum(reach, m - 1)] - t - 1.0 < -tolerance)
        if not short.any():
            break
        reach[short] += 1
    passed = np.searchsorted(steps + tolerance, t, "right")
    has_step = passed < len(steps)
    step = np.where(has_step, steps[np.minimum(passed, len(steps) - 1)] if len(steps) else np.inf, np.inf)
    wall = np.searchsorted(t, step - tolerance, "right")  # first epoch at or beyond the step
    usable = (t <= t[-1] + tolerance - 1.0) & ~(t > step + tolerance - 1.0)
    out, cursor = [], 0
    for i in index[usable].tolist():
        if len(out) >= most:
            break
        j, end = int(reach[i]), int(wall[i])
        if j >= min(end, m):
            cursor = max(cursor, min(end, m - 1))
            continue
        cursor = max(cursor, j)
        partner = j
        if t[j] - t[i] - 1.0 >= tolerance:  # a gap: take the next epoch that no earlier one took
            if cursor >= end:  # it lies beyond the step, so begin again after j
                cursor = j + 1
                if cursor >= end:
                    continue
            partner = cursor
            cursor = 1 if cursor == m - 1 else cursor + 1
        out.append((i, partner))
    return np.array(out, np.int64).reshape(-1, 2)


def both_ways(t: np.ndarray, steps: Sequence[float] = ()) -> np.ndarray:
    """Pairs found forwards, then those found backwards; a pair found twice counts twice."""
    forward = year_pairs(t, steps)
    backward = year_pairs(-t[::-1], [-s for s in reversed(list(steps))])
    return np.concatenate([forward, len(t) - 1 - backward[:, ::-1]])


def midas(t: np.ndarray, y: np.ndarray, steps: Sequence[float] = (), pairs: np.ndarray | None = None) -> Midas:
    """MIDAS of one component; ``pairs`` may be given for components with the same epochs."""
    t, y = np.asarray(t, float), np.asarray(y, float)
    pairs = both_ways(t, steps) if pairs is None else pairs
    if not len(pairs):
        return Midas(residuals=np.zeros(0))
    rates = (y[pairs[:, 1]] - y[pairs[:, 0]]) / (t[pairs[:, 1]] - t[pairs[:, 0]])
    off = np.abs(rates - np.median(rates))
    scatter = 1.4826 * np.median(off)
    kept = rates[off < 2.0 * scatter]
    share = (len(rates) - len(kept)) / len(rates)
    if not len(kept):
        return Midas(outlier_fraction=share, velocity_scatter=float(scatter), residuals=np.full(len(y), np.nan))
    velocity = np.median(kept)
    error = 3.0 * 1.2533 * 1.4826 * np.median(np.abs(kept - velocity)) / np.sqrt(len(kept) / 4.0)
    level = y - velocity * (t - t[0])
    offset = np.median(level)
    return Midas(float(velocity), float(error), float(offset), share, float(scatter), level - offset)


def _years(dates: pd.Series) -> np.ndarray:
    days = pd.to_datetime(dates)
    return ((days - days.iloc[0]).dt.total_seconds() / 86400.0 / DAYS_PER_YEAR).to_numpy()


def midas_rates(df: DataFrame, value: str = "value", station: str = "station", date: str = "date", steps: dict[str, list[str]] | None = None, factor: float = 1.0) -> DataFrame:
    """(station, n, n_pairs, velocity …, residuals) per station; missing values are dropped, rows sorted by date.

    ``steps`` gives dates of steps by station.  Undefined results are NULL.
    """
    rows = df.where(df[value].isNotNull()).select(df[station].alias("station"), df[date].cast("date").alias("date"), df[value].cast("double").alias("value"))
    known = steps or {}

    def one(key, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("date", kind="stable")
        t, y = _years(frame["date"]), frame["value"].to_numpy()
        first = pd.to_datetime(frame["date"]).iloc[0]
        own = sorted((pd.Timestamp(s) - first).total_seconds() / 86400.0 / DAYS_PER_YEAR for s in known.get(key[0], []))
        pairs = both_ways(t, own)
        m = midas(t, y, pairs=pairs) * factor
        return pd.DataFrame({"station": [key[0]], "n": [len(y)], "n_pairs": [len(pairs)], "velocity": [m.velocity], "velocity_uncertainty": [m.velocity_uncertainty], "reference_position": [m.reference_position], "outlier_fraction": [m.outlier_fraction], "velocity_scatter": [m.velocity_scatter], "residuals": [m.residuals]})

    schema = "station string, n long, n_pairs long, velocity double, velocity_uncertainty double, reference_position double, outlier_fraction double, velocity_scatter double, residuals array<double>"
    return rows.groupBy("station").applyInPandas(one, schema)


def midas_pairs(df: DataFrame, value: str = "value", station: str = "station", date: str = "date", steps: dict[str, list[str]] | None = None) -> DataFrame:
    """(station, direction, first, second): the pairs as row numbers in date order, for inspection."""
    rows = df.where(df[value].isNotNull()).select(df[station].alias("station"), df[date].cast("date").alias("date"))
    known = steps or {}

    def one(key, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("date", kind="stable")
        t = _years(frame["date"])
        first = pd.to_datetime(frame["date"]).iloc[0]
        own = sorted((pd.Timestamp(s) - first).total_seconds() / 86400.0 / DAYS_PER_YEAR for s in known.get(key[0], []))
        both, forward = both_ways(t, own), len(year_pairs(t, own))
        return pd.DataFrame({"station": key[0], "direction": np.where(np.arange(len(both)) < forward, "forward", "backward"), "first": both[:, 0], "second": both[:, 1]})

    return rows.groupBy("station").applyInPandas(one, "station string, direction string, first long, second long")
