"""Estimators as SQL functions over arrays, and the tables of the plans as views."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import pandas_udf


def _rows(function: Callable[[np.ndarray, np.ndarray], tuple], names: tuple[str, ...]) -> Callable[[pd.Series, pd.Series], pd.DataFrame]:
    def run(years: pd.Series, values: pd.Series) -> pd.DataFrame:
        made = []
        for t, y in zip(years, values):
            if t is None or y is None:
                made.append((None,) * len(names))
                continue
            t, y = np.asarray(t, float), np.asarray(y, float)
            there = np.isfinite(t) & np.isfinite(y)
            order = np.argsort(t[there], kind="stable")
            made.append(tuple(None if x is None or np.isnan(x) else float(x) for x in function(t[there][order], y[there][order])))
        return pd.DataFrame(made, columns=list(names), dtype="float64")

    return run


def register_functions(spark: SparkSession) -> None:
    """``midas``, ``tsia`` and ``robust_fit`` of (years array, values array) for SQL; each gives a struct of doubles.

    A missing array gives NULLs, as do series that are too short; values that are
    missing or no numbers are left out and epochs need no order.
    """
    from geodrift.operators.midas import midas
    from geodrift.operators.robust import l1_line
    from geodrift.operators.trend import interannual_slopes

    def by_midas(t: np.ndarray, y: np.ndarray) -> tuple:
        m = midas(t, y)
        return m.velocity, m.velocity_uncertainty, m.reference_position, m.outlier_fraction, m.velocity_scatter

    def by_tsia(t: np.ndarray, y: np.ndarray) -> tuple:
        slopes = interannual_slopes(np.round(t * 365.25), y) * 365.25
        slope = float(np.median(slopes)) if len(slopes) else np.nan
        return slope, float(np.median(y - slope * t)) if len(slopes) else np.nan

    def by_l1(t: np.ndarray, y: np.ndarray) -> tuple:
        return tuple(l1_line(t, y)[:2]) if len(t) > 1 else (np.nan, np.nan)

    for name, function, fields in (
        ("midas", by_midas, ("velocity", "velocity_uncertainty", "reference_position", "outlier_fraction", "velocity_scatter")),
        ("tsia", by_tsia, ("slope", "intercept")),
        ("robust_fit", by_l1, ("slope", "intercept")),
    ):
        spark.udf.register(name, pandas_udf(_rows(function, fields), ", ".join(f"{f} double" for f in fields)))


def create_views(**tables: DataFrame) -> None:
    """Each table as a temporary view of its name, for SQL over catalogues, series, rasters and results."""
    for name, table in tables.items():
        table.createOrReplaceTempView(name)
