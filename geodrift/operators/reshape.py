"""Wide and long forms, and the joins between the two instruments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geodrift.schemas import MEASUREMENTS


def tidy(wide: DataFrame, measurements: tuple[str, ...] = MEASUREMENTS) -> DataFrame:
    """(station, date, measurement, value); missing values keep their rows."""
    return wide.unpivot(["station", "date"], list(measurements), "measurement", "value")


def wide(tidy_rows: DataFrame, measurements: tuple[str, ...] = MEASUREMENTS) -> DataFrame:
    """(station, date, a column per measurement), the mean of duplicates; absent measurements are NULL."""
    return tidy_rows.groupBy("station", "date").pivot("measurement", list(measurements)).agg(F.avg("value"))


def with_insar(gps: DataFrame, insar: DataFrame) -> DataFrame:
    """GPS rows with the InSAR values of their day, if any."""
    return gps.join(insar, ["station", "date"], "left")


def relative_to(wide_rows: DataFrame, *, reference_station: str) -> DataFrame:
    """Both instruments less the reference station's values of the day, and their difference.

    One station's series is small (a row a day), whatever the number of stations.
    """
    reference = wide_rows.where(F.col("station") == reference_station).select("date", F.col("los_gps").alias("_gps"), F.col("los_insar").alias("_insar"))
    if reference.isEmpty():
        raise ValueError(f"no station {reference_station!r}")
    gps, insar = F.col("los_gps") - F.col("_gps"), F.col("los_insar") - F.col("_insar")
    return wide_rows.join(reference, "date").select("station", "date", gps.alias("relative_gps"), insar.alias("relative_insar"), (insar - gps).alias("difference"))


def stations_without_overlap(wide_rows: DataFrame, *, reference_station: str) -> DataFrame:
    """Stations that share no day with the reference."""
    days = wide_rows.where(F.col("station") == reference_station).select("date")
    return wide_rows.select("station").distinct().join(wide_rows.join(days, "date").select("station").distinct(), "station", "left_anti")


def with_lookup(series: DataFrame, lookup: DataFrame) -> DataFrame:
    """Grid series with the coordinates of their grid point, if known."""
    return series.join(lookup, "grid_point", "left")


def missing_stations(catalogue: DataFrame, series: DataFrame) -> DataFrame:
    """Catalogued stations without a loaded series."""
    return catalogue.join(series.select(F.col("station").alias("name")).distinct(), "name", "left_anti").select("name")
