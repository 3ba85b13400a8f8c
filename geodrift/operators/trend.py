"""Least-squares trends of series as aggregates, Theil-Sen trends as a grouped function."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dated(df: DataFrame, value: str = "value", station: str = "station") -> DataFrame:
    """(station, date, t, y): rows with a value, t in days since the series' first such row."""
    held = df.where(F.col(value).isNotNull()).select(station, "date", F.col(value).cast("double").alias("y"))
    return held.select(station, "date", F.datediff("date", F.min("date").over(Window.partitionBy(station))).cast("double").alias("t"), "y")


def line_fit(df: DataFrame, value: str = "value", station: str = "station", median: bool = False) -> DataFrame:
    """(station, slope per day, intercept) by least squares, or by the median of inter-annual slopes."""
    if median:
        return theil_sen(df, value, station).select(station, "slope", "intercept")
    return dated(df, value, station).groupBy(station).agg(F.regr_slope("y", "t").alias("slope"), F.regr_intercept("y", "t").alias("intercept"))


def whole_year_distance(days: Column) -> Column:
    """Days to the nearest multiple of 365."""
    return F.abs(F.pmod(days + F.lit(180.0), F.lit(365.0)) - F.lit(180.0))


def interannual_slopes(t: np.ndarray, y: np.ndarray, tolerance_days: float = 30.0) -> np.ndarray:
    """Slopes of all pairs over 180 days apart and within the tolerance of a multiple of 365 days; ``t`` ascending.

    Partners of one number of years lie together, so they come from two binary
    searches per number of years; the rule itself then decides.
    """
    out = [np.zeros(0)]
    for years in range(1, int((t[-1] - t[0] + 182) // 365) + 1 if len(t) else 1):
        lo = np.searchsorted(t, t + 365.0 * years - tolerance_days, "left")
        hi = np.searchsorted(t, t + 365.0 * years + tolerance_days, "right")
        count = hi - lo
        first = np.repeat(np.arange(len(t)), count)
        second = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo, count)
        gap = t[second] - t[first]
        keep = (gap > 180) & (np.abs((gap + 180) % 365 - 180) < tolerance_days)
        out.append((y[second[keep]] - y[first[keep]]) / gap[keep])
    return np.concatenate(out)


def theil_sen(df: DataFrame, value: str = "value", station: str = "station", tolerance_days: float = 30.0) -> DataFrame:
    """(station, slope per day, intercept, uncertainty, n_pairs) from pairs about whole years apart.

    A series has up to millions of pairs but only thousands of rows, so rows are
    shuffled once by station and pairs are made where they are used.  A series
    without pairs gives NULL.
    """
    rows = dated(df, value, station).select(F.col(station).alias("station"), "t", "y")

    def one(key, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("t", kind="stable")
        t, y = frame["t"].to_numpy(), frame["y"].to_numpy()
        slopes = interannual_slopes(t, y, tolerance_days)
        if not len(slopes):
            return pd.DataFrame({"station": [key[0]], "slope": [np.nan], "intercept": [np.nan], "uncertainty": [np.nan], "n_pairs": [0]})
        slope = np.median(slopes)
        scatter = 1.4826 * np.median(np.abs(slopes - slope))
        error = 3 * math.sqrt(math.pi / 2) * scatter / math.sqrt(len(slopes) / 4)
        return pd.DataFrame({"station": [key[0]], "slope": [slope], "intercept": [np.median(y - slope * t)], "uncertainty": [error], "n_pairs": [len(slopes)]})

    found = rows.groupBy("station").applyInPandas(one, "station string, slope double, intercept double, uncertainty double, n_pairs long")
    return found.withColumnRenamed("station", station)


def linear_trend(df: DataFrame, value: str = "value", station: str = "station", median: bool = False, output: str = "trend") -> DataFrame:
    """(station, date, t, y, trend): the fitted line at each date."""
    return dated(df, value, station).join(line_fit(df, value, station, median), station).select(station, "date", "t", "y", (F.col("slope") * F.col("t") + F.col("intercept")).alias(output))


def trend_at(coefficients: DataFrame, dates: DataFrame, station: str = "station", output: str = "trend") -> DataFrame:
    """The line at other dates, counted from the first of those dates."""
    t = F.datediff("date", F.min("date").over(Window.partitionBy(station)))
    return dates.select(station, "date", t.cast("double").alias("t")).join(coefficients, station).select(station, "date", (F.col("slope") * F.col("t") + F.col("intercept")).alias(output))


def last_trend(df: DataFrame, value: str = "value", station: str = "station") -> DataFrame:
    """(station, trend): the fitted line at the last date."""
    return linear_trend(df, value, station).groupBy(station).agg(F.max_by("trend", "date").alias("trend"))


def flat_std(df: DataFrame, value: str = "value", station: str = "station") -> DataFrame:
    """(station, std): population standard deviation about the fitted line."""
    return linear_trend(df, value, station).groupBy(station).agg(F.stddev_pop(F.col("y") - F.col("trend")).alias("std"))


def mad(df: DataFrame, value: str, *keys: str) -> DataFrame:
    """Median absolute deviation by key."""
    middle = df.groupBy(*keys).agg(F.median(value).alias("_m"))
    return df.join(middle, list(keys)).groupBy(*keys).agg(F.median(F.abs(F.col(value) - F.col("_m"))).alias("mad"))
