"""Column expressions: dates, longitudes, units and time scales."""

from __future__ import annotations

import math

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

SPEED_OF_LIGHT = 299792458.0
SENTINEL_1_FREQUENCY = 5.405e9
SENTINEL_1_WAVELENGTH = SPEED_OF_LIGHT / SENTINEL_1_FREQUENCY
DAYS_PER_YEAR = 365.25


def present(value: Column) -> Column:
    """NaN as NULL."""
    return F.when(~F.isnan(value), value)


def wrapped_longitude(lon: Column) -> Column:
    """Longitude in [-180, 180]; half turns stay on their side."""
    return lon - F.rint(lon / 360.0) * 360.0


def compact_date(text: Column) -> Column:
    """Date of ``yyMMMdd`` such as 94JAN02; years from 69 on are of the last century; bad text gives NULL."""
    year = F.substring(text, 1, 2).try_cast("int")
    return F.try_to_date(F.concat(F.when(year >= 69, "19").otherwise("20"), text), "yyyyMMMdd")


def decimal_year_date(year: Column) -> Column:
    """Date of a decimal year: days after 1 January are the fraction of 365.25, rounded half to even."""
    whole = F.floor(year).cast("int")
    return F.date_add(F.make_date(whole, F.lit(1), F.lit(1)), F.rint((year - whole) * F.lit(DAYS_PER_YEAR)).cast("int"))


def metres(value: Column, units: Column, wavelength: float = SENTINEL_1_WAVELENGTH) -> Column:
    """Displacement in metres: phase in radians is scaled, any other unit stays."""
    return F.when(F.lower(units) == "radians", value * F.lit(wavelength / (4 * math.pi))).otherwise(value)


def series_window(*keys: str, order: str = "date") -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(order)


def days_since_first(date: Column, *keys: str) -> Column:
    """Days since the first date of the series; timestamps count whole seconds as fractions."""
    seconds = F.unix_seconds(date.cast("timestamp"))
    return (seconds - F.min(seconds).over(Window.partitionBy(*keys))) / F.lit(86400.0)


def years_since_first(date: Column, *keys: str) -> Column:
    return days_since_first(date, *keys) / F.lit(DAYS_PER_YEAR)


def padded_grid_point(value: Column, width: int = 6) -> Column:
    """Zeros on the left up to ``width``; longer values stay whole."""
    return F.when(F.length(value) < width, F.lpad(value, width, "0")).otherwise(value)
