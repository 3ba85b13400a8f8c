"""Operators on long series (station, date, components)."""

from __future__ import annotations

from datetime import date as Date

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geodrift.functions.columns import series_window

FIRST_ROWS = 10


def date_range(df: DataFrame, start: Date | str | None = None, end: Date | str | None = None, column: str = "date") -> DataFrame:
    """Rows from ``start`` to ``end``, both included, each optional."""
    if start is not None:
        df = df.where(F.col(column) >= F.lit(start).cast("date"))
    return df if end is None else df.where(F.col(column) <= F.lit(end).cast("date"))


def zeroed(df: DataFrame, columns: tuple[str, ...] = ("east", "north", "up"), by: str = "mean", station: str = "station", date: str = "date") -> DataFrame:
    """Series less their ``mean``, or less the mean of their first ten rows (``start``)."""
    how = by.lower()
    if how not in ("mean", "start"):
        raise ValueError(f"zero by mean or start, not {by!r}")
    whole = Window.partitionBy(station)
    if how == "mean":
        return df.withColumns({c: F.col(c) - F.avg(c).over(whole) for c in columns})
    placed = df.withColumn("_place", F.row_number().over(series_window(station, order=date)))
    early = {c: F.col(c) - F.avg(F.when(F.col("_place") <= FIRST_ROWS, F.col(c))).over(whole) for c in columns}
    return placed.withColumns(early).drop("_place")


def line_of_sight(series: DataFrame, vectors: DataFrame, station: str = "station", output: str = "los_gps") -> DataFrame:
    """Motion projected on each station's unit vector (e, n, u), less the mean of its first ten rows.

    Stations whose vector is zero within 1e-8 are left out.
    """
    seen = vectors.where(~((F.abs("e") <= 1e-8) & (F.abs("n") <= 1e-8) & (F.abs("u") <= 1e-8)))
    joined = series.join(seen.select(station, "e", "n", "u"), station)
    moved = joined.select(station, "date", (F.col("east") * F.col("e") + F.col("north") * F.col("n") + F.col("up") * F.col("u")).alias(output))
    return zeroed(moved, (output,), "start", station)


def unseen_stations(vectors: DataFrame) -> DataFrame:
    """Stations that ``line_of_sight`` leaves out."""
    return vectors.where((F.abs("e") <= 1e-8) & (F.abs("n") <= 1e-8) & (F.abs("u") <= 1e-8)).select("station")


def moving_average(df: DataFrame, column: str, size: int | None = 7, output: str = "smooth", station: str = "station", date: str = "date") -> DataFrame:
    """Trailing mean over ``size`` rows, NULL until all of them are there; without a size the values stay."""
    if not size:
        return df.withColumn(output, F.col(column))
    trailing = series_window(station, order=date).rowsBetween(1 - size, 0)
    return df.withColumn(output, F.when(F.count(column).over(trailing) == size, F.avg(column).over(trailing)))


def without_outliers(df: DataFrame, threshold: float = 50.0, column: str = "value") -> DataFrame:
    """Rows whose magnitude is strictly below the threshold; missing values go."""
    return df.where(F.abs(column) < F.lit(threshold))


def excluded(df: DataFrame, names: str | list[str] | None, column: str = "name") -> DataFrame:
    """Rows of other stations than those named, in any case; one name may be given as a string."""
    listed = [names] if isinstance(names, str) else list(names or [])
    return df.where(~F.upper(column).isin([x.upper() for x in listed])) if listed else df
