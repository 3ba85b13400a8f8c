"""Rates per station from tidy rows, and statistics of the comparison."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .midas import DAYS_PER_YEAR, midas
from .reshape import wide
from .robust import l1_line
from .series import without_outliers

COLUMNS = (
    "station", "difference", "insar_velocity", "insar_velocity_l2", "temporal_coherence", "similarity", "num_gps_points", "gps_time_span_years",
    "gps_velocity_l2", "gps_velocity", "gps_velocity_uncertainty", "gps_outlier_fraction", "gps_velocity_scatter",
)


def _timed(tidy_rows: DataFrame, outlier_threshold: float) -> DataFrame:
    """Wide rows with ``years`` since the station's first row of any measurement."""
    rows = tidy_rows.withColumn("date", F.col("date").cast("date"))
    table = wide(without_outliers(rows, outlier_threshold))
    return table.withColumn("years", F.datediff("date", F.min("date").over(Window.partitionBy("station"))) / F.lit(DAYS_PER_YEAR))


def _native(timed: DataFrame, scale: float) -> DataFrame:
    """What aggregates give: least-squares rates, counts, span and first quality values."""
    n_gps, n_insar = F.count("los_gps"), F.count("los_insar")
    first = {c: F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("date"))) for c in ("temporal_coherence", "similarity")}
    return timed.groupBy("station").agg(
        F.when(n_insar > 2, F.regr_slope("los_insar", "years") * scale).alias("insar_velocity_l2"),
        *[F.when(n_insar > 2, first[c]).alias(c) for c in first],
        n_gps.alias("num_gps_points"),
        F.max("years").alias("gps_time_span_years"),
        F.when(n_gps > 2, F.regr_slope("los_gps", "years") * scale).alias("gps_velocity_l2"),
    )


def calculate_rates_l2(tidy_rows: DataFrame, outlier_threshold: float = 50.0, to_mm: bool = True) -> DataFrame:
    """The part of ``calculate_rates`` that needs no Python."""
    return _native(_timed(tidy_rows, outlier_threshold), 1000.0 if to_mm else 1.0)


def calculate_rates(tidy_rows: DataFrame, outlier_threshold: float = 50.0, to_mm: bool = True) -> DataFrame:
    """One row per station with COLUMNS; rates in mm (or m) a year.

    GPS and InSAR rates need more than two values each; absent measurements and
    undefined rates are NULL.
    """
    scale = 1000.0 if to_mm else 1.0
    timed = _timed(tidy_rows, outlier_threshold)

    def robust(key, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("years", kind="stable")
        out = dict.fromkeys(("insar_velocity", "gps_velocity", "gps_velocity_uncertainty", "gps_outlier_fraction", "gps_velocity_scatter"), np.nan)
        gps, insar = frame.dropna(subset=["los_gps"]), frame.dropna(subset=["los_insar"])
        if len(gps) > 2:
            t = gps["years"].to_numpy()
            m = midas(t - t[0], gps["los_gps"].to_numpy()) * scale
            out |= {"gps_velocity": m.velocity, "gps_velocity_uncertainty": m.velocity_uncertainty, "gps_outlier_fraction": m.outlier_fraction, "gps_velocity_scatter": m.velocity_scatter}
        if len(insar) > 2:
            out["insar_velocity"] = l1_line(insar["years"].to_numpy(), insar["los_insar"].to_numpy())[0] * scale
        return pd.DataFrame([{"station": key[0]} | out])

    schema = "station string, insar_velocity double, gps_velocity double, gps_velocity_uncertainty double, gps_outlier_fraction double, gps_velocity_scatter double"
    fitted = timed.select("station", "years", "los_gps", "los_insar").groupBy("station").applyInPandas(robust, schema)
    joined = _native(timed, scale).join(fitted, "station")
    return joined.withColumn("difference", F.col("insar_velocity") - F.col("gps_velocity")).select(*COLUMNS)


def midas_rate(tidy_rows: DataFrame, station: str, measurement: str) -> DataFrame:
    """MIDAS in metres a year of one station and measurement."""
    from .midas import midas_rates

    return midas_rates(tidy_rows.where((F.col("station") == station) & (F.col("measurement") == measurement)))


def comparison_stats(df: DataFrame, left: str = "los_gps", right: str = "los_insar", *keys: str) -> DataFrame:
    """Pearson correlation and root mean square difference where both are present."""
    both = df.where(F.col(left).isNotNull() & F.col(right).isNotNull())
    return both.groupBy(*keys).agg(F.count("*").alias("n"), F.corr(left, right).alias("pearson"), F.sqrt(F.avg(F.pow(F.col(left) - F.col(right), 2))).alias("rmse"))


def extreme_rates(rates: DataFrame, limit: float = 15.0) -> DataFrame:
    """Stations with a rate beyond the limit by either instrument."""
    return rates.where((F.abs("gps_velocity") > limit) | (F.abs("insar_velocity") > limit))
